"""Shuffled slopes are made where a run's points are: no row per replicate is moved, joined or sent to all tasks."""

import re

import duckdb
import numpy as np
import pandas as pd

from conftest import rows

import __spark_entry__ as entry
from enanto.operators import resampling
from enanto.plans.contrast import points

NAN, INF = float("nan"), float("inf")


def test_replicates_are_no_rows_and_slopes_are_those_of_sql(spark, tmp_path):
    rng = np.random.default_rng(8)
    sizes = np.geomspace(8, 230, 24)
    data = [(run, float(L), float(0.02 * L**0.7 * np.exp(rng.normal(0, 0.4)))) for run in range(300) for L in rng.choice(sizes, rng.integers(2, 20), replace=False) for _ in range(2)]
    data += [(900, 10.0, 0.1), (901, 10.0, 0.1), (901, 20.0, 0.1), (901, 40.0, 0.1), (902, 10.0, 0.0), (902, 20.0, -0.3), (902, 40.0, NAN), (902, 80.0, INF)]
    data += [(903, -1.0, 0.1), (903, 0.0, 0.2), (904, None, 0.2), (None, 10.0, 0.1), (-5, 10.0, 0.3), (-5, 30.0, 0.1), (-5, 20.0, None)]
    data += [(905, 1.0 + i / 7, float(rng.random())) for i in range(1500)]
    spark.createDataFrame(data, "run_id bigint, L double, eta double").write.parquet(f"{tmp_path}/results.parquet")
    got = entry.queries()["null_gamma"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Join|Broadcast|Generate", plan), plan
    c = duckdb.connect()
    c.execute(f"CREATE VIEW results AS SELECT * FROM '{tmp_path}/results.parquet/*.parquet'")
    a, b = (x.sort_values("run_id").reset_index(drop=True) for x in (got.toPandas(), c.sql(entry.oracle_sql()["null_gamma"]).df()))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=2e-6, rtol=0)
    one = a[a.run_id == 900].iloc[0]
    assert np.isnan(one.gamma) and np.isnan(one.null_mean) and one.p_value == 1
    p = points(spark, str(tmp_path)).where("run_id is null or run_id in (1, 2, 900, 901, 905, -5)")
    assert repr(rows(resampling.null_slopes(p, "run_id"))) == repr(rows(resampling.null_slopes(p, "run_id", most=50)))
