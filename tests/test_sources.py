import datetime as dt
import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from enanto import cli
from enanto.sources import datasets
from enanto.streaming import slices


def small(spark, hands=("L", "R")):
    rng = np.random.default_rng(0)
    data = [("a", int(t), float(L), h, float(1 + (0.5 if h == "L" else -0.5) * 0.01 * L**0.9 * rng.uniform(0.95, 1.05))) for t in range(6) for L in (4, 6, 9, 13, 20, 30, 45, 60) for h in hands]
    return spark.createDataFrame(data, "case_id string, t bigint, L double, hand string, O double")


def test_dataset_round_trip_and_commands(spark, tmp_path):
    d = str(tmp_path / "set")
    datasets.write_dataset(small(spark).withColumn("t", (F.lit("2001-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("t").cast("int"))).cast("timestamp_ntz")), d, "custom", "one")
    assert cli.validate(spark, d) == {"valid": True, "completeness": 1.0, "issues": []}
    meta = cli.run(spark, d, str(tmp_path / "out"))
    assert 0.5 < meta["gamma"] < 1.4
    assert cli.audit(spark, str(tmp_path / "out"))["decision"] in ("accept", "reject")
    assert json.load(open(tmp_path / "out/metadata.json"))["dataset"] == "one"
    n = cli.diagnose(spark, d)
    assert (n["n_rows"], n["n_cases"], n["n_sizes"], n["n_keys"], n["n_complete"], n["fewest_sizes"]) == (96, 1, 8, 48, 48, 8)
    assert cli.schema(spark, d)["columns"]["L"] == "double"
    assert cli.calibrate(spark, f"{SMALL}/results.parquet", str(tmp_path / "limits.json")) == json.load(open(tmp_path / "limits.json"))
    twice = str(tmp_path / "twice")
    datasets.write_dataset(datasets.load_dataset(spark, d).samples.unionByName(datasets.load_dataset(spark, d).samples.limit(1)), twice, "custom", "two")
    with pytest.raises(datasets.DatasetError, match="more than one reading"):
        cli.run(spark, twice, str(tmp_path / "out2"))
    page = cli.report(spark, str(tmp_path / "out"))
    assert page.count("<circle") == 8 and page.count("<tr>") == 9


def test_invalid_datasets(spark, tmp_path):
    d = str(tmp_path / "half")
    datasets.write_dataset(small(spark, ("L",)), d, "custom", "half")
    r = cli.validate(spark, d)
    assert not r["valid"] and r["completeness"] == 0.0 and r["issues"][0]["code"] == "pairing_completeness"
    assert cli.validate(spark, d, allow_missing=True)["valid"]
    assert cli.validate(spark, str(tmp_path / "absent"))["issues"][0]["code"] == "io_error"
    with pytest.raises(datasets.DatasetError):
        datasets.write_dataset(small(spark).drop("O"), d, "custom", "x")


def test_configuration_precedence():
    c = datasets.configuration({"analysis": {"knee": {"rho": 2.0, "bootstrap_n": 5}}}, {"knee": {"rho": 3.0}}, {"seed": 7})
    assert (c["knee"]["rho"], c["knee"]["bootstrap_n"], c["knee"]["bic_delta_min"], c["seed"]) == (3.0, 5, 10.0, 7)
    with pytest.raises(datasets.DatasetError):
        datasets.configuration({}, {"scaling": {"method": "magic"}})


def test_arrays_by_path(spark, tmp_path):
    for i in range(3):
        np.save(tmp_path / f"{i}.npy", np.full((4, 4), float(i)))
    d = spark.createDataFrame([("a", 0, 1.0, "L", "0.npy"), ("a", 0, 1.0, "R", "2.npy"), ("a", 1, 1.0, "R", None)], "case_id string, t bigint, L double, hand string, O_path string")
    got = sorted((r.hand, r.O_array) for r in datasets.with_arrays(d, str(tmp_path)).where("O_path is not null").collect())
    assert got == [("L", 0.0), ("R", 2.0)]
    with pytest.raises(Exception, match="not an .npy file"):
        datasets.with_arrays(d.withColumn("O_path", F.lit("0.txt")), str(tmp_path)).collect()
    absolute = d.withColumn("O_path", F.concat(F.lit(f"{tmp_path}/"), "O_path"))
    assert sorted((r.hand, r.O_array) for r in datasets.with_arrays(absolute, str(tmp_path)).where("O_path is not null").collect()) == got


def test_tables_and_sweeps(spark, tmp_path):
    small(spark).coalesce(1).write.csv(str(tmp_path / "samples.csv"), header=True)
    assert datasets.read_table(spark, str(tmp_path)).count() == 96
    with pytest.raises(datasets.DatasetError):
        datasets.read_table(spark, str(tmp_path / "x.doc"))
    (tmp_path / "s.json").write_text(json.dumps([{"p": 1.0}, {"p": 2.0}]))
    (tmp_path / "l.json").write_text('{"p": 1.0}\n{"p": 2.0}\n')
    assert all(datasets.read_sweep(spark, str(tmp_path / n)).count() == 2 for n in ("s.json", "l.json"))
    n = datasets.write_partitioned(small(spark), str(tmp_path / "parts"), ["hand"])
    assert {r.hand: r.n_rows for r in n.collect()} == {"L": 48, "R": 48}


def test_content_hash_sees_names_and_bytes(tmp_path):
    (tmp_path / "a").write_text("1")
    first = datasets.content_hash(str(tmp_path))
    assert first == datasets.content_hash(str(tmp_path))
    (tmp_path / "a").write_text("2")
    second = datasets.content_hash(str(tmp_path))
    (tmp_path / "a").rename(tmp_path / "b")
    assert len({first, second, datasets.content_hash(str(tmp_path))}) == 3


def test_streams_match_batch(spark, tmp_path):
    a = slices.hourly(spark, f"{SMALL}/samples.parquet")
    b = spark.read.parquet(f"{SMALL}/samples.parquet").where("t is not null and hand in ('L', 'R')")
    closed = b.where(F.date_trunc("hour", "t") + F.expr("interval 1 hour") <= b.agg(F.max("t")).first()[0] - dt.timedelta(hours=1))
    assert a.agg(F.sum("n_rows")).first()[0] == closed.count()
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(2):  # two files arrive
        shutil.copy(f"{SMALL}/samples.parquet", folder / f"{i}.parquet")
    twice = slices.slice_counts(spark, str(folder))
    once = slices.slice_counts(spark, f"{SMALL}/samples.parquet")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
    b.limit(0).write.parquet(str(tmp_path / "none"))
    assert slices.slice_counts(spark, str(tmp_path / "none")).count() == 0


def test_whole_slices_are_flushed(spark, tmp_path):
    d = spark.createDataFrame([(f"2001-01-01 00:0{m}:00", i) for m, n in ((0, 2), (1, 1), (2, 3), (9, 2)) for i in range(n)], "t string, i int").select(F.col("t").cast("timestamp_ntz").alias("t"), "i")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = slices.flush_whole(slices.arriving(spark, str(tmp_path / "in")), 2, "2 minutes").writeStream.outputMode("append").format("memory").queryName("flushed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.status) for r in spark.sql("select * from flushed").collect()) == [(1, "short"), (2, "whole"), (3, "over")]
