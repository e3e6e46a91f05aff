import glob
import importlib
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from conftest import SMALL

import __spark_entry__ as entry

CORE = sorted(k for m in entry._MODULES for k in importlib.import_module(m).oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "" if v is None or v is pd.NaT or v != v else (f"{float(v) + 0.0:.6g}" if isinstance(v, float) else str(v)))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", CORE)
def test_query_matches_sql(spark, con, name):
    a, b = normal(entry.queries()[name](spark, SMALL).toPandas()), normal(con.sql(entry.oracle_sql()[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    if len(a):
        pd.testing.assert_frame_equal(a, b)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_alone():
    code = "import sys; sys.modules['enanto.llm'] = None; import __spark_entry__ as e; n = e.queries(); assert 'p1_found' in n and not any(k.startswith(('p5', 'p6', 'p7', 'p8')) for k in n)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
