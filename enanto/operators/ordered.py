"""Exact ranks and medians of groups of any size.

Values are counted per group and value first, so that ties and repeats shrink on the map side. A monotone code of the
value's magnitude cuts each group into narrow classes; running totals go over the classes, then over the values within a
class, so no task ever sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Classes per factor of two.
FINE = 4096


def _class(v: Column) -> Column:
    """A whole number that never falls as the double rises; infinite values have classes of their own."""
    a = F.abs(v)
    size = F.when(a == float("inf"), 1 << 40).otherwise(F.floor((F.log2(a) + 1100) * FINE) + 1)
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("long")


def _on(keys: list[str], *more: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    for k in more:
        on = on & (F.col(k) == F.col(f"__o_{k}"))
    return on


def ranked(df: DataFrame, keys: list[str], value: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """One row per group and distinct value (null and NaN left out): keys, value, ``c`` rows, ``below`` rows with a smaller
    value, ``n`` rows of the group, and for each of ``sums`` its own total and ``upto_<name>``, the total up to the value."""
    v = F.col(value).cast("double")
    x = df.select(*keys, v.alias("__v"), *sums).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    # -0.0 and 0.0 are one value.
    x = x.withColumn("__v", F.col("__v") + F.lit(0.0))
    x = x.groupBy(*keys, "__v").agg(F.count("*").alias("c"), *[F.sum(s).alias(s) for s in sums])
    x = written(x.withColumn("__k", _class(F.col("__v"))), "distinct")
    t = x.groupBy(*keys, "__k").agg(F.sum("c").alias("c"), *[F.sum(s).alias(s) for s in sums])
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = w.orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        *[F.col(k).alias(f"__o_{k}") for k in (*keys, "__k")],
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__b_c"),
        F.sum("c").over(w).alias("n"),
        *[F.coalesce(F.sum(s).over(before), F.lit(0.0)).alias(f"__b_{s}") for s in sums],
    )
    j = x.join(t, _on(keys, "__k"))
    inside = Window.partitionBy(*keys, "__k").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    return j.select(
        *keys,
        F.col("__v").alias(value),
        "c",
        (F.col("__b_c") + F.sum("c").over(inside) - F.col("c")).alias("below"),
        "n",
        *sums,
        *[(F.col(f"__b_{s}") + F.sum(s).over(inside)).alias(f"upto_{s}") for s in sums],
    )


def exact_medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Keys, the exact median of each group's values (null and NaN left out) and ``n``, their number."""
    r = ranked(df, keys, value)
    last = F.col("below") + F.col("c")
    lo, hi = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    hit = r.where((F.col("below") <= hi) & (last > lo))
    g = hit.groupBy(*keys).agg(
        ((F.max(F.when((F.col("below") <= lo) & (last > lo), F.col(value))) + F.max(F.when((F.col("below") <= hi) & (last > hi), F.col(value)))) / 2).alias(name), F.max("n").alias("n")
    )
    return g


def hash_ranks(df: DataFrame, keys: list[str], text: Column, tie: str, out: str, coarse: tuple[str, ...] = ()) -> DataFrame:
    """Adds each row's rank (from 1) in its group by ``coarse`` columns, then by the md5 of ``text``, ties by ``tie``.

    A row is ranked among those whose md5 begins alike; totals of earlier beginnings go on top, so a group of any size is
    spread. ``df`` is read twice: give a written table where it is costly.
    """
    x = df.withColumn("__h", F.md5(text)).withColumn("__b", F.substring("__h", 1, 1 if coarse else 3))
    cut = [*keys, *coarse, "__b"]
    n = x.groupBy(*[F.col(k).alias(f"__o_{k}") for k in cut]).agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*[f"__o_{k}" for k in keys]) if keys else Window.partitionBy(F.lit(0))
    before = before.orderBy(*[f"__o_{k}" for k in (*coarse, "__b")]).rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("__off", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    own = Window.partitionBy(*cut).orderBy("__h", tie)
    return x.withColumn("__rn", F.row_number().over(own)).join(n, _on(cut)).select(*df.columns, (F.col("__rn") + F.col("__off")).alias(out))
