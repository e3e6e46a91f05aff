"""Structured Streaming: completeness of time slices and hourly counts over arriving samples.

State is bounded by a watermark: a key is written once, when the watermark has passed it, and forgotten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tables_dir


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """The samples files of a folder (or one file) as a stream."""
    # As a pattern, a path may name a folder or a single file.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_appended(df: DataFrame, name: str) -> DataFrame:
    """Run a streaming query in append mode over all that has arrived and return the table it wrote.

    A batch writes its own folder, so one that is run again after a failure replaces what it had written.
    """
    spark = df.sparkSession
    base = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], df.schema).write.parquet(f"{base}/table/batch=none")

    def keep(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/table/batch={i}")

    q = df.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/table/*")


def _on_time(df: DataFrame, delay: str) -> DataFrame:
    return df.withColumn("at", F.col("t").cast("timestamp")).withWatermark("at", delay)


def slice_counts(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """Distinct (size, hand) per case and time of the slices that are closed: those no later than the latest time less
    ``delay``. Their state is dropped as they are written; rows that arrive for a closed slice are late and left out."""
    x = arriving(spark, path).where(F.col("case_id").isNotNull() & F.col("t").isNotNull() & F.col("L").isNotNull() & ~F.isnan("L") & F.col("hand").isin("L", "R"))
    g = _on_time(x, delay).groupBy("case_id", "at").agg(F.size(F.collect_set(F.struct("L", "hand"))).cast("long").alias("n_seen"))
    return run_appended(g.select("case_id", F.col("at").cast("timestamp_ntz").alias("t"), "n_seen"), "slices")


def hourly(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """Rows and readings per hour and hand, for the hours that have ended before the latest time less ``delay``."""
    x = arriving(spark, path).where(F.col("t").isNotNull() & F.col("hand").isin("L", "R"))
    g = _on_time(x, delay).groupBy(F.window("at", "1 hour").alias("w"), "hand").agg(F.count("*").alias("n_rows"), F.count("O").alias("n_readings"))
    return run_appended(g.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "hand", "n_rows", "n_readings"), "hourly")


def flush_whole(samples: DataFrame, expected: int, delay: str = "1 hour") -> DataFrame:
    """Streaming: slices (by t) in append mode once the watermark has passed, marked whole, short or over against the
    expected number of rows. Rows later than the delay are dropped, as the watermark defines."""
    x = samples.withColumn("at", F.col("t").cast("timestamp")).withWatermark("at", delay)
    g = x.groupBy(F.window("at", "1 second").alias("w")).agg(F.count("*").alias("n"))
    status = F.when(F.col("n") == expected, "whole").when(F.col("n") < expected, "short").otherwise("over")
    return g.select(F.col("w.start").alias("slice"), "n", status.alias("status"))
