import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from enanto import session


def fake(master, checkpoint=None):
    conf = SimpleNamespace(get=lambda key, default=None: checkpoint)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda key: None), master=master, applicationId=f"app-{master}"))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(fake("spark://host:7077"))
    assert session.scratch_dir(fake("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    assert session.scratch_dir(fake("local[4]")).startswith("file://")
    session.drop_scratch(fake("yarn"))


def test_partitions_grow_with_the_rows(spark):
    assert session.kernel_partitions(spark) == 4 and session.kernel_partitions(spark, 1_000_000, 100_000) == 10


def test_written_tables_are_dropped(spark):
    df = session.written(spark.range(5).toDF("id"), "five")
    at = session.tables_dir(spark).replace("file://", "")
    assert df.count() == 5 and os.listdir(at)
    assert session.written(spark.range(0).toDF("id"), "none").count() == 0


def test_joins_with_small_and_larger_tables(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("z", 5)], "k string, u bigint")
    small = spark.createDataFrame([("a", 10), ("b", 20)], "__k string, v int")
    want = [("a", 1, 10), ("a", 2, 10), ("b", 3, 20), (None, 4, None), ("z", 5, None)]
    for most in (100, 1):
        monkeypatch.setattr(session, "SMALL_ROWS", most)
        got = session.with_small(df, small, "k", "__k", F.col("u")).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
