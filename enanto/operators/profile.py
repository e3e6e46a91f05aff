"""Problem 2: column-level quality profile and shifts between loads.

One partially aggregated pass per load gives counts, nulls, ranges, pattern violations, mergeable exact power sums (of
whole numbers of steps, see :func:`_stepped`) and quantile points; distinct counts come from a grouped distinct. Whatever follows works on one row per load and column. A load that
holds a third of all rows is combined on the map side first, so it never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..session import written

NUMERIC = ("L", "O")
HAND_PATTERN = r"\A[LR]\z"
POINTS = (0.1, 0.5, 0.9)
#: Rank error of a quantile point is at most 1 / ACCURACY of the load's rows.
ACCURACY = 10_000

# Limits fixed by the problem statement.
NULL_EXCESS = 0.08
PATTERN_EXCESS = 0.05
POINT_FACTOR = 1.8
LEFT_SHARE = (0.35, 0.65)


#: Readings are counted in steps: so many on either side of their domain's middle.
HALF_BITS = 30


def _numeric(c: str, exact: bool = False) -> list[Column]:
    x = F.col(f"`{c}`")
    ok = F.when(finite(x), x)
    if exact:
        # Whole steps (null where the reading can't be) and their powers in halves below 2^61: sums are exact, whatever the order.
        q = F.col(f"__q_{c}")
        high, low = F.shiftright(q * q, HALF_BITS), (q * q).bitwiseAND(F.lit((1 << HALF_BITS) - 1))
        parts = {"e1": q, "e2": q * q, "e3h": high * q, "e3l": low * q, "e4hh": high * high, "e4hl": high * low, "e4ll": low * low}
        sums = [F.sum(v.cast("decimal(20,0)")).alias(f"{c}_{n}") for n, v in parts.items()]
        return [F.count(q).alias(f"{c}_s0"), *sums, F.max(f"__centre_{c}").alias(f"{c}_centre"), F.max(f"__unit_{c}").alias(f"{c}_unit"), *_counts(c, x, ok)]
    return [F.count(ok).alias(f"{c}_s0"), *[F.sum(p).alias(f"{c}_s{i}") for i, p in enumerate((ok, ok * ok, ok * ok * ok, ok * ok * ok * ok), 1)], *_counts(c, x, ok)]


def _powers(c: str) -> list[Column]:
    """The sums of the powers as doubles, each put together from its exact halves once."""
    d = lambda n: F.col(f"{c}_{n}").cast("double")
    one = float(1 << HALF_BITS)
    return [
        d("e1").alias(f"{c}_s1"),
        d("e2").alias(f"{c}_s2"),
        (d("e3h") * one + d("e3l")).alias(f"{c}_s3"),
        (d("e4hh") * (one * one) + d("e4hl") * (2 * one) + d("e4ll")).alias(f"{c}_s4"),
    ]


def _counts(c: str, x: Column, ok: Column) -> list[Column]:
    return [
        F.count_if(x.isNull()).alias(f"{c}_null"),
        F.count_if(F.isnan(x)).alias(f"{c}_nan"),
        F.min(ok).alias(f"{c}_min"),
        F.max(ok).alias(f"{c}_max"),
        F.percentile_approx(ok, list(POINTS), ACCURACY).alias(f"{c}_q"),
    ]


def _stepped(samples: DataFrame, loads: DataFrame, domains: DataFrame) -> DataFrame:
    """Samples with L and O as whole steps from the middle of their domain (``__q_L``, ``__q_O``), null where a reading
    isn't finite or O lies outside its domain's range, and with each domain's middle and step.

    The steps divide the range of the domain's possible readings; loads that aren't listed share one domain without a
    given range.
    """
    names = loads.groupBy(F.col("load_id").alias("__load")).agg(F.min("domain").alias("__domain"))
    known = domains.groupBy(F.col("domain").alias("__of")).agg(F.min("o_min").alias("__lo"), F.max("o_max").alias("__hi"))
    names = written(names.join(known, F.col("__domain") == F.col("__of"), "left").drop("__of"), "load-domains")  # likewise below
    x = samples.select("load_id", "L", "hand", "O").join(names, F.col("load_id") == F.col("__load"), "left").drop("__load")
    out = F.coalesce((F.col("O") < F.col("__lo")) | (F.col("O") > F.col("__hi")), F.lit(False))
    x = x.withColumns({"__x_L": F.when(finite(F.col("L")), F.col("L")), "__x_O": F.when(finite(F.col("O")) & ~out, F.col("O"))}).drop("__lo", "__hi")
    ends = x.groupBy(F.col("__domain").alias("__m")).agg(*[f(f"__x_{c}").alias(f"__{n}_{c}") for c in NUMERIC for n, f in (("least", F.min), ("most", F.max))])

    def scale(c: str) -> list[Column]:
        lo, hi = F.col(f"__least_{c}"), F.col(f"__most_{c}")
        return [F.coalesce((lo + hi) / 2.0, F.lit(0.0)).alias(f"__centre_{c}"), F.when(hi > lo, (hi - lo) / float(2 << HALF_BITS)).otherwise(1.0).alias(f"__unit_{c}")]

    mid = written(ends.select("__m", *scale("L"), *scale("O")), "domain-scales")  # of known size, so that no reading moves to meet it
    x = x.join(mid, F.col("__domain").eqNullSafe(F.col("__m"))).drop("__m")
    steps = {f"__q_{c}": F.rint((F.col(f"__x_{c}") - F.col(f"__centre_{c}")) / F.col(f"__unit_{c}")).cast("long") for c in NUMERIC}
    return x.withColumns(steps).drop(*[f"__x_{c}" for c in NUMERIC])


def load_stats(samples: DataFrame, exact: bool = False) -> DataFrame:
    """One row per load_id (null is a load of its own): counts, power sums, ranges and quantile points of L, hand and O.

    With ``exact`` samples come from :func:`_stepped`, and the sums are of whole steps from the domain's middle.
    """
    hand = F.col("hand")
    g = samples.groupBy("load_id").agg(
        F.count("*").alias("n"),
        *_numeric("L", exact),
        *_numeric("O", exact),
        F.count_if(hand.isNull()).alias("hand_null"),
        F.count_if(~hand.rlike(HAND_PATTERN)).alias("hand_bad"),
        F.count_if(hand == "L").alias("hand_left"),
        F.count_if(hand == "R").alias("hand_right"),
        F.min(hand).alias("hand_min"),
        F.max(hand).alias("hand_max"),
    )
    return g.select("*", *_powers("L"), *_powers("O")) if exact else g


def distinct_counts(samples: DataFrame) -> DataFrame:
    """Distinct non-null values of each column per load, as a grouped distinct followed by a count; NaN is one value."""
    # Numbers stay numbers: one row holds a value of one column, the others are null.
    none = {"L": "double", "hand": "string", "O": "double"}
    one = lambda c: F.struct(F.lit(c).alias("column_name"), *[(F.col(f"`{k}`") if k == c else F.lit(None)).cast(t).alias(f"v_{k}") for k, t in none.items()])
    long = samples.select("load_id", F.inline(F.array(*[one(c) for c in none])))
    return long.where((F.col("v_L").isNotNull() | F.col("v_hand").isNotNull() | F.col("v_O").isNotNull())).distinct().groupBy("load_id", "column_name").agg(F.count("*").alias("n_distinct"))


def column_profile(samples: DataFrame, loads: DataFrame | None = None, domains: DataFrame | None = None) -> DataFrame:
    """One row per load and column (L, hand, O).

    ``n_missing`` counts nulls and NaN; ``n_violations`` values that break the column's pattern (hand: other than exactly
    L or R; numbers: infinite ones). Mean, standard deviation, skewness and kurtosis come from the power sums of finite
    values, null where there are too few or none differ. Ranges and quantile points are text so that one column serves
    all types; distinct counts leave null out and count NaN as one value. An empty table gives no rows. Given loads and
    domains, O outside the range of the load's domain is a violation and stays out of the moments.
    """
    exact = loads is not None and domains is not None
    stats = load_stats(_stepped(samples, loads, domains), True) if exact else load_stats(samples)

    def number(c: str) -> Column:
        n, s1, s2, s3, s4 = (F.col(f"{c}_s{i}") for i in range(5))
        unit, centre = (F.col(f"{c}_unit"), F.col(f"{c}_centre")) if exact else (F.lit(1.0), F.lit(0.0))
        mean = F.try_divide(s1, n)
        m2 = F.greatest(F.try_divide(s2, n) - mean * mean, F.lit(0.0))
        m3 = F.try_divide(s3, n) - 3 * mean * F.try_divide(s2, n) + 2 * mean * mean * mean
        m4 = F.try_divide(s4, n) - 4 * mean * F.try_divide(s3, n) + 6 * mean * mean * F.try_divide(s2, n) - 3 * mean * mean * mean * mean
        return F.struct(
            F.lit(c).alias("column_name"),
            F.col("n").alias("n_rows"),
            (F.col(f"{c}_null") + F.col(f"{c}_nan")).alias("n_missing"),
            # Sums leave out what isn't finite and, where ranges are known, what is out of range.
            (F.col("n") - F.col(f"{c}_null") - F.col(f"{c}_nan") - n).alias("n_violations"),
            F.col(f"{c}_min").cast("string").alias("min_value"),
            F.col(f"{c}_max").cast("string").alias("max_value"),
            (mean * unit + centre).alias("mean"),
            (F.sqrt(m2) * unit).alias("std"),
            F.try_divide(m3, F.pow(m2, 1.5)).alias("skewness"),
            F.try_divide(m4, m2 * m2).alias("kurtosis"),
            F.array_join(F.transform(F.col(f"{c}_q"), lambda v: v.cast("string")), "|").alias("q10_q50_q90"),
        )

    none = F.lit(None).cast("double")
    hand = F.struct(
        F.lit("hand").alias("column_name"),
        F.col("n").alias("n_rows"),
        F.col("hand_null").alias("n_missing"),
        F.col("hand_bad").alias("n_violations"),
        F.col("hand_min").alias("min_value"),
        F.col("hand_max").alias("max_value"),
        none.alias("mean"),
        none.alias("std"),
        none.alias("skewness"),
        none.alias("kurtosis"),
        F.lit(None).cast("string").alias("q10_q50_q90"),
    )
    long = stats.select("load_id", F.explode(F.array(number("L"), hand, number("O"))).alias("p")).select("load_id", "p.*")
    d = distinct_counts(samples).select(F.col("load_id").alias("__load"), F.col("column_name").alias("__column"), "n_distinct")
    return long.join(d, F.col("load_id").eqNullSafe(F.col("__load")) & (F.col("column_name") == F.col("__column")), "left").select(*long.columns, F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def _with_domain(stats: DataFrame, loads: DataFrame) -> DataFrame:
    """Adds the load's domain; loads missing from the table of loads are compared with each other (null domain)."""
    names = loads.groupBy(F.col("load_id").alias("__load")).agg(F.min("domain").alias("domain"))
    return stats.where(F.col("load_id").isNotNull()).join(names, F.col("load_id") == F.col("__load"), "left").drop("__load")


def standardised_shifts(samples: DataFrame, loads: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """Each load's mean of L and O against all other loads of its domain, from merged power sums.

    ``shift`` is the difference of means over the root of the mean of both variances; null where a side has no possible
    value or neither side varies. O outside the domain's range (fill values) isn't in the sums; ``n_violations`` counts it
    beside infinite values. Sums are exact, of whole steps from the domain's middle, so they merge in any order.
    """
    none = samples.sparkSession.createDataFrame([], "domain string, o_min double, o_max double")
    stats = _with_domain(load_stats(_stepped(samples, loads, none if domains is None else domains), True), loads)
    violations = {c: F.col("n") - F.col(f"{c}_null") - F.col(f"{c}_nan") - F.col(f"{c}_s0") for c in NUMERIC}
    zero = F.lit(0).cast("decimal(38,0)")

    def fields(c: str) -> list[Column]:
        sums = [F.coalesce(F.col(f"{c}_{n}").cast("decimal(38,0)"), zero).alias(f"s{i}") for i, n in enumerate(("s0", "e1", "e2"))]
        return [violations[c].alias("n_violations"), F.col(f"{c}_centre").alias("centre"), F.col(f"{c}_unit").alias("unit"), *sums]

    long = stats.select("load_id", "domain", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *fields(c)) for c in NUMERIC])).alias("p")).select("load_id", "domain", "p.*")
    o = Window.partitionBy("domain", "column_name")  # one row a load
    j = long.select("*", *[(F.sum(f"s{i}").over(o) - F.col(f"s{i}")).cast("double").alias(f"r{i}") for i in range(3)])
    j = j.withColumns({f"s{i}": F.col(f"s{i}").cast("double") for i in range(3)})

    def moments(n: Column, s1: Column, s2: Column) -> tuple[Column, Column]:
        mean = F.try_divide(s1, n)
        return mean, F.greatest(F.try_divide(s2, n) - mean * mean, F.lit(0.0))

    own = moments(F.col("s0"), F.col("s1"), F.col("s2"))
    rest = moments(F.col("r0"), F.col("r1"), F.col("r2"))
    return j.select(
        "load_id",
        "domain",
        "column_name",
        F.col("s0").cast("long").alias("n_finite"),
        "n_violations",
        (own[0] * F.col("unit") + F.col("centre")).alias("mean"),
        (rest[0] * F.col("unit") + F.col("centre")).alias("mean_rest"),
        F.try_divide(own[0] - rest[0], F.sqrt((own[1] + rest[1]) / 2)).alias("shift"),
    )


def load_findings(samples: DataFrame, loads: DataFrame) -> DataFrame:
    """Loads that are out of line for their domain: load_id, column_name, finding.

    Medians run over the loads of the domain that have rows. A quantile point differs by a factor where one is more than
    1.8 times the other; with unlike signs or one of them zero it differs, with both zero it doesn't. A load without
    finite values has no distribution finding, one without a hand in L or R neither. Rows with null load_id are left out.
    """
    stats = _with_domain(load_stats(samples), loads)

    def share(a: Column, b: Column) -> Column:
        return F.try_divide(a.cast("double"), b.cast("double"))

    points = [F.get(F.col(f"{c}_q"), F.lit(i)).alias(f"{c}_p{i}") for c in NUMERIC for i in range(len(POINTS))]
    x = stats.select(
        "load_id",
        "domain",
        share(F.col("L_null") + F.col("L_nan"), F.col("n")).alias("L_missing"),
        share(F.col("O_null") + F.col("O_nan"), F.col("n")).alias("O_missing"),
        share(F.col("hand_null"), F.col("n")).alias("hand_missing"),
        share(F.col("hand_bad"), F.col("n") - F.col("hand_null")).alias("hand_broken"),
        share(F.col("hand_left"), F.col("hand_left") + F.col("hand_right")).alias("hand_left_share"),
        *points,
    )
    x = written(x, "load-stats")  # one row a load, met twice below
    compared = [c for c in x.columns if c not in ("load_id", "domain", "hand_left_share")]
    usual = x.groupBy(F.col("domain").alias("__domain")).agg(*[F.median(c).alias(f"m_{c}") for c in compared])
    j = x.join(usual, F.col("domain").eqNullSafe(F.col("__domain")))

    def off(c: str) -> Column:
        a, m = F.col(c), F.col(f"m_{c}")
        same = (a * m > 0) & (F.greatest(F.abs(a), F.abs(m)) <= POINT_FACTOR * F.least(F.abs(a), F.abs(m)))
        return a.isNotNull() & m.isNotNull() & ~(same | ((a == 0) & (m == 0)))

    def finding(column: str, kind: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(column).alias("column_name"), F.lit(kind).alias("finding")))

    found = [finding(c, "nulls", F.col(f"{c}_missing") > F.col(f"m_{c}_missing") + NULL_EXCESS) for c in ("L", "hand", "O")]
    found.append(finding("hand", "pattern", F.col("hand_broken") > F.col("m_hand_broken") + PATTERN_EXCESS))
    found += [finding(c, "distribution", off(f"{c}_p0") | off(f"{c}_p1") | off(f"{c}_p2")) for c in NUMERIC]
    found.append(finding("hand", "distribution", ~F.col("hand_left_share").between(*LEFT_SHARE)))
    return j.select("load_id", F.explode(F.filter(F.array(*found), lambda e: e.isNotNull())).alias("e")).select("load_id", "e.*")
