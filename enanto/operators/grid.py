"""Problem 4: irregular readings onto a regular grid.

Readings are first combined per case and slot (map-side combine, so a hot case shrinks before it is shuffled). Slots are
then cut into blocks of ``BLOCK`` steps per case; a slot within the gap limit of its block's start is also given to the
block before, so the as-of merge inside a block sees both neighbours of every grid point. No task ever holds more than
``BLOCK`` plus the gap limit slots of a case, however large the case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch_micros, finite

GAP_STEPS = 96
BLOCK = 4096


def usable_slots(samples: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, step_s, slot_s, n_readings, mean instant within the slot (microseconds) and mean O of the usable readings."""
    steps = cases.where(F.col("case_id").isNotNull() & (F.col("step_s") > 0)).groupBy(F.col("case_id").alias("__case")).agg(F.min("step_s").cast("long").alias("step_s"))
    used = samples.where(F.col("case_id").isNotNull() & F.col("t").isNotNull() & finite(F.col("O")))
    x = used.select("case_id", epoch_micros(samples, "t").alias("us"), F.col("O").alias("o"))
    j = x.join(steps, F.col("case_id") == F.col("__case"))
    into = F.expr("pmod(us, step_s * 1000000L)")
    return (
        j.select("case_id", "step_s", F.expr("(us - pmod(us, step_s * 1000000L)) div 1000000L").alias("slot_s"), into.alias("into"), "o")
        .groupBy("case_id", "step_s", "slot_s")
        .agg(F.count("*").alias("n_readings"), F.avg("into").alias("into"), F.avg("o").alias("o"))
    )


def regular_grid(samples: DataFrame, cases: DataFrame, gap_steps: int = GAP_STEPS) -> DataFrame:
    """One row per step of each case from its first to its last usable slot, wide breaks left out.

    ``status`` is ``observed`` (``value``: mean O of the slot's usable readings) or ``filled``: no usable reading lies in
    the slot, and its neighbours, at most ``gap_steps`` steps apart, are interpolated linearly in time between their mean
    instants, at the middle of the slot. ``break_after`` marks an observed slot with no other usable slot in the next
    ``gap_steps`` steps. Usable: case_id and t not null, O finite; re-sent rows count as readings of their slot. Cases
    that are missing from ``cases`` or have no positive step give no rows.
    """
    s = usable_slots(samples, cases)
    index = F.expr("slot_s div step_s")
    block = F.expr(f"cast(floor((slot_s div step_s) / {BLOCK}D) as bigint)")
    near = F.expr(f"pmod(slot_s div step_s, {BLOCK})") < gap_steps
    spread = s.withColumn("own", block).withColumn("block", F.explode(F.when(near, F.array("own", F.col("own") - 1)).otherwise(F.array("own"))))
    w = Window.partitionBy("case_id", "block").orderBy("slot_s")
    nxt = F.lead(F.struct("slot_s", "into", "o")).over(w)
    seen = spread.withColumn("next", nxt).where(F.col("own") == F.col("block"))
    close = F.coalesce(F.col("next.slot_s") - F.col("slot_s") <= gap_steps * F.col("step_s"), F.lit(False))
    run = seen.withColumn("close", close).withColumn("g", F.explode(F.sequence("slot_s", F.when(F.col("close"), F.col("next.slot_s") - F.col("step_s")).otherwise(F.col("slot_s")), F.col("step_s"))))
    observed = F.col("g") == F.col("slot_s")
    t0 = F.col("into") / 1e6
    t1 = (F.col("next.slot_s") - F.col("slot_s")) + F.col("next.into") / 1e6
    at = (F.col("g") - F.col("slot_s")) + F.col("step_s") / 2.0
    between = F.col("o") + (F.col("next.o") - F.col("o")) * F.try_divide(at - t0, t1 - t0)
    return run.select(
        "case_id",
        F.col("g").alias("slot_s"),
        F.when(observed, "observed").otherwise("filled").alias("status"),
        F.when(observed, F.col("o")).otherwise(between).alias("value"),
        F.when(observed, F.col("n_readings")).otherwise(F.lit(0)).cast("long").alias("n_readings"),
        (observed & ~F.col("close")).alias("break_after"),
    )


def missing_slots(samples: DataFrame, cases: DataFrame, gap_steps: int = GAP_STEPS) -> DataFrame:
    """case_id and slot_s of the grid's steps without a usable reading."""
    return regular_grid(samples, cases, gap_steps).where(F.col("status") == "filled").select("case_id", "slot_s")
