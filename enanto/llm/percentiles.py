"""Problem 5: percentiles of very large numeric columns.

Values are counted per group and value (so ties and repeated rows shrink before they are shuffled), range-partitioned and
sorted by group and value, and written once with running counts per partition. Offsets of each group's share of each
partition come from those counts; they locate the target positions, and the neighbouring order statistics are
interpolated exactly. A group of any size is spread over as many partitions as its values need.

Summaries of single days or loads hold every s-th order statistic with its weight. Any number of them combine, through
the same sort, into percentiles of the whole whose rank error is bounded by the sum of (s - 1) over the summaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow, written

POINTS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Rank error a summary may have, as a share of its own rows.
EPSILON = 0.001


def _differs(col: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; null equals null and NaN equals NaN."""
    a, b = col[1:], col[:-1]
    out = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    if pa.types.is_floating(col.type):
        out &= ~pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy(zero_copy_only=False)
    return out


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the running count of each group (columns __g0..) within this partition; groups are contiguous."""
    last: list[pa.Array] | None = None
    total = 0
    for b in batches:
        if not len(b):
            continue
        keys, c = [b[n] for n in b.schema.names if n.startswith("__g")], b["__c"].to_numpy()
        new = np.zeros(len(b), bool)
        for k in keys:
            new[1:] |= _differs(k)
        new[0] = last is None or any(_differs(pa.concat_arrays([x, k[:1]]))[0] for x, k in zip(last, keys))
        run = np.cumsum(c)
        base = np.where(new, run - c, 0)
        start = np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))
        carried = np.cumsum(new) == 0
        upto = run - np.where(carried, -total, base[start])
        last, total = [k[-1:] for k in keys], int(upto[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto, pa.int64())], names=[*b.schema.names, "__upto"])


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & a[n].eqNullSafe(b[n])
    return on


class SortedRuns:
    """The written sort of a column: group columns g0.., value, count, partition and running count."""

    def __init__(self, df: DataFrame, groups: list[str], value: str, weight: str | None = None):
        self.groups = groups
        self.g = [f"__g{i}" for i in range(len(groups))]
        v = F.col(f"`{value}`").cast("double")
        w = F.col(f"`{weight}`").cast("long") if weight else F.lit(1).cast("long")
        x = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(groups, self.g)], v.alias("__v"), w.alias("__w"))
        x = x.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
        x = x.groupBy(*self.g, "__v").agg(F.sum("__w").alias("__c"))
        x = x.repartitionByRange(*self.g, "__v").sortWithinPartitions(*self.g, "__v").select("*", F.spark_partition_id().alias("__pid"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema) + ", `__upto` bigint"
        self.rows = written(map_arrow(x, _running, schema), "runs")

    def parts(self) -> DataFrame:
        """Per partition and group: offset of the group's rows before it, and the group's total n."""
        from pyspark.sql import Window

        counts = self.rows.groupBy(*self.g, "__pid").agg(F.max("__upto").alias("__m"))
        own = Window.partitionBy(*self.g) if self.g else Window.partitionBy(F.lit(0))
        before = own.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("*", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__off"), F.sum("__m").over(own).alias("__n"))

    def _placed(self, parts: DataFrame, *extra: str) -> DataFrame:
        """Rows with the global ranks [lo, hi) they take up in their group."""
        r = self.rows
        p = parts.select(*[F.col(n).alias(f"{n}p") for n in (*self.g, "__pid")], "__off", "__n", *extra)
        on = r["__pid"] == p["__pidp"]
        for n in self.g:
            on = on & r[n].eqNullSafe(p[f"{n}p"])
        j = r.join(p, on)
        hi = F.col("__off") + F.col("__upto")
        return j.select(*self.g, "__v", "__n", (hi - F.col("__c")).alias("__lo"), hi.alias("__hi"), *extra)

    def _named(self, df: DataFrame, *rest: str) -> DataFrame:
        return df.select(*[F.col(n).alias(c) for c, n in zip(self.groups, self.g)], *rest)

    def percentiles(self, points: tuple[float, ...] = POINTS) -> DataFrame:
        """Group columns, p, value, n and rank_error (0: exact up to the rounding of one interpolation)."""
        parts = self.parts()
        targets = []
        for p in points:
            pos = F.lit(p) * (F.col("__n") - 1)
            for up, rank in ((False, F.floor(pos)), (True, F.ceil(pos))):
                targets.append(F.struct(F.lit(p).alias("p"), F.lit(up).alias("up"), rank.cast("long").alias("rank")))
        here = F.filter(F.array(*targets), lambda t: (t["rank"] >= F.col("__off")) & (t["rank"] < F.col("__off") + F.col("__m")))
        parts = parts.withColumn("__t", here).where(F.size("__t") > 0)
        placed = self._placed(parts, "__t")
        hits = placed.withColumn("__t", F.filter("__t", lambda t: (t["rank"] >= F.col("__lo")) & (t["rank"] < F.col("__hi")))).where(F.size("__t") > 0)
        hits = hits.select(*self.g, "__v", "__n", F.inline("__t"))
        found = hits.groupBy(*self.g, "p").agg(
            F.max(F.when(~F.col("up"), F.col("__v"))).alias("a"), F.max(F.when(F.col("up"), F.col("__v"))).alias("b"), F.max("__n").alias("n")
        )
        pos = F.col("p") * (F.col("n") - 1)
        share = pos - F.floor(pos)
        value = F.when((F.col("a") == F.col("b")) | (share == 0), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * share)
        return self._named(found.select(*self.g, "p", value.alias("value"), "n", F.lit(0.0).alias("rank_error")), "p", "value", "n", "rank_error")

    def summaries(self, epsilon: float = EPSILON) -> DataFrame:
        """Group columns, value, weight, n, step: of each run of ``step`` order statistics the last, with their number."""
        placed = self._placed(self.parts())
        step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("__n") * F.lit(epsilon)).cast("long"))
        x = placed.withColumn("step", step)
        tail = F.when(F.col("__hi") == F.col("__n"), F.expr("__n % step")).otherwise(F.lit(0))
        weight = F.expr("(__hi div step - __lo div step) * step") + tail
        return self._named(x.select(*self.g, F.col("__v").alias("value"), weight.cast("long").alias("weight"), F.col("__n").alias("n"), "step").where("weight > 0"), "value", "weight", "n", "step")


def percentiles(df: DataFrame, groups: list[str], value: str, points: tuple[float, ...] = POINTS) -> DataFrame:
    """Exact percentiles per group, linearly interpolated between order statistics.

    Null and NaN values are left out, infinite ones kept; a null group is a group of its own, and a group without values
    gives no row. An empty table gives no rows. Other columns don't matter, whatever their names.
    """
    return SortedRuns(df, groups, value).percentiles(points)


def summarise(df: DataFrame, groups: list[str], value: str, epsilon: float = EPSILON) -> DataFrame:
    """Mergeable summaries per group, at most about 1/epsilon rows each; see :func:`combine`."""
    return SortedRuns(df, groups, value).summaries(epsilon)


def combine(summaries: DataFrame, groups: list[str], within: list[str], points: tuple[float, ...] = POINTS) -> DataFrame:
    """Percentiles per ``groups`` from summaries per ``groups`` and ``within``, with the bound of their rank error."""
    each = summaries.groupBy(*groups, *within).agg(F.max("n").alias("__n"), F.max("step").alias("__s"))
    bound = each.groupBy(*groups).agg((F.sum(F.col("__s") - 1) / F.sum("__n")).alias("__bound")) if groups else each.agg((F.sum(F.col("__s") - 1) / F.sum("__n")).alias("__bound"))
    whole = SortedRuns(summaries, groups, "value", "weight").percentiles(points)
    b = bound.select(*[F.col(f"`{c}`").alias(f"__b{i}") for i, c in enumerate(groups)], "__bound")
    on = F.lit(True)
    for i, c in enumerate(groups):
        on = on & whole[c].eqNullSafe(b[f"__b{i}"])
    return whole.join(b, on).select(*groups, "p", "value", "n", F.col("__bound").alias("rank_error"))
