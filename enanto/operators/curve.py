"""Contrast against size, and closed-form fits over it.

A curve has one row per series and size, some tens of rows a series, whatever the number of readings behind it. Every fit
takes all series at once, keyed by the series column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import median, std_or_zero
from ..functions.scalars import LOG_FLOOR, safe_log


def eta_by_size(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Per series and size: median, mean and spread of eta, mean signed parity, number of pairs."""
    return pairs.groupBy(*by, "L").agg(
        median(F.col("eta")).alias("eta"),
        F.avg("eta").alias("eta_mean"),
        std_or_zero(F.col("eta")).alias("eta_std"),
        F.avg("signed_parity").alias("signed_mean"),
        F.count("*").alias("n"),
    )


def log_points(curve: DataFrame, series: str) -> DataFrame:
    """series, i (from 0 by size), n_points, L, x = ln L, y = ln eta and weight; sizes of at most 0 are left out."""
    w = Window.partitionBy(series).orderBy("L")
    x = curve.where(F.col(series).isNotNull() & (F.col("L") > 0) & F.col("eta").isNotNull())
    return x.select(
        series,
        (F.row_number().over(w) - 1).alias("i"),
        F.count("*").over(Window.partitionBy(series)).alias("n_points"),
        "L",
        F.log("L").alias("x"),
        safe_log(F.abs("eta")).alias("y"),
        F.col("n").cast("double").alias("weight"),
    )


def bic(rss: Column, n: Column, k: int) -> Column:
    return n * F.log(F.greatest(rss, F.lit(LOG_FLOOR)) / n) + F.lit(float(k)) * F.log(F.greatest(n, F.lit(2)).cast("double"))


def line_fits(points: DataFrame, series: str, least: int = 3) -> DataFrame:
    """Least-squares line per series of at least ``least`` points: slope, intercept, rss, bic."""
    g = points.groupBy(series).agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cxy")
    )
    slope = F.try_divide(F.col("cxy"), F.col("vx"))
    rss = F.greatest(F.col("n") * (F.col("vy") - slope * F.col("cxy")), F.lit(0.0))
    out = g.where((F.col("n") >= least) & (F.col("vx") > 0)).select(series, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), rss.alias("rss"))
    return out.withColumn("bic", bic(F.col("rss"), F.col("n"), 2))


def hinge_fits(points: DataFrame, series: str, least_side: int = 3, least_share: float = 0.2, apart: int | None = None) -> DataFrame:
    """Two joined lines with the break at each admissible point: slopes, rss and bic per candidate.

    A candidate has at least ``least_side`` points and that share of all on either side (itself on the left); where
    ``apart`` is given, every point with so many others on either side is one instead. The three-parameter fit is solved from centred moments; a series has some tens of points, so has its list of candidates.
    """
    c = points.where((F.col("i") >= 1) & (F.col("i") < F.col("n_points") - 1))
    left, right = F.col("i") + 1, F.col("n_points") - F.col("i") - 1
    if apart is None:
        c = c.where((left >= least_side) & (right >= least_side) & (left >= least_share * F.col("n_points")) & (right >= least_share * F.col("n_points")))
    else:
        c = c.where((left > apart) & (right >= apart))
    c = c.select(F.col(series).alias("__s"), F.col("i").alias("k"), F.col("L").alias("L_k"), F.col("x").alias("xk"))
    j = points.join(c, F.col(series) == F.col("__s"))
    d = F.col("x") - F.col("xk")
    j = j.select(series, "k", "L_k", "y", F.least(d, F.lit(0.0)).alias("u"), F.greatest(d, F.lit(0.0)).alias("v"))
    g = j.groupBy(series, "k", "L_k").agg(
        F.count("*").alias("n"),
        F.var_pop("u").alias("uu"),
        F.var_pop("v").alias("vv"),
        F.covar_pop("u", "v").alias("uv"),
        F.covar_pop("u", "y").alias("uy"),
        F.covar_pop("v", "y").alias("vy"),
        F.var_pop("y").alias("yy"),
    )
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    a = F.try_divide(F.col("uy") * F.col("vv") - F.col("vy") * F.col("uv"), det)
    b = F.try_divide(F.col("vy") * F.col("uu") - F.col("uy") * F.col("uv"), det)
    out = g.select(series, "k", "L_k", "n", "uy", "vy", "yy", a.alias("slope_left"), b.alias("slope_right"))
    rss = F.greatest(F.col("n") * (F.col("yy") - F.col("slope_left") * F.col("uy") - F.col("slope_right") * F.col("vy")), F.lit(0.0))
    out = out.select(series, "k", "L_k", "n", "slope_left", "slope_right", rss.alias("rss"))
    return out.withColumn("bic", bic(F.col("rss"), F.col("n"), 3))


def knee_candidates(points: DataFrame, series: str, slope_max: float = 6.0, edge_least: float = 0.15, apart: int | None = None) -> DataFrame:
    """Hinge candidates with their gain over the line, change of slope, distance from the edges, sanity and reasons."""
    line = line_fits(points, series).select(F.col(series).alias("__s"), F.col("bic").alias("bic_line"))
    ends = points.groupBy(F.col(series).alias("__e")).agg(F.min("L").alias("lo"), F.max("L").alias("hi"))
    h = hinge_fits(points, series, apart=apart).join(line, F.col(series) == F.col("__s")).join(ends, F.col(series) == F.col("__e"))
    edge = F.least(F.col("L_k") - F.col("lo"), F.col("hi") - F.col("L_k")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(LOG_FLOOR))
    h = h.withColumn("edge_fraction", edge).withColumn("delta_bic", F.col("bic_line") - F.col("bic"))
    steep = (F.abs("slope_left") > slope_max) | (F.abs("slope_right") > slope_max)
    why = [
        (F.col("slope_left").isNull() | F.col("slope_right").isNull(), "slope_non_finite"),
        (steep, "slope_unphysical"),
        (F.col("slope_right") > slope_max, "post_slope_too_flat"),
        (F.col("edge_fraction") < edge_least, "knee_at_edge"),
    ]
    reasons = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in why])), ";")
    return h.select(series, "k", "L_k", "delta_bic", F.abs(F.col("slope_right") - F.col("slope_left")).alias("delta_gamma"), "slope_left", "slope_right", "edge_fraction", reasons.alias("reasons"), (reasons == "").alias("sanity_ok"))


def robust_z(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Robust z of a column within its group: by median and MAD, by mean and deviation where the MAD is 0, else 0."""
    w = Window.partitionBy(*by)
    med = F.median(value).over(w)
    x = df.withColumn("__m", med).withColumn("__a", F.abs(F.col(value) - F.col("__m")))
    x = x.withColumn("__d", 1.4826 * F.median("__a").over(w)).withColumn("__sd", F.stddev_pop(value).over(w)).withColumn("__mean", F.avg(value).over(w))
    z = F.when(F.col("__d") > LOG_FLOOR, (F.col(value) - F.col("__m")) / F.col("__d")).when(F.col("__sd") > LOG_FLOOR, (F.col(value) - F.col("__mean")) / F.col("__sd")).otherwise(0.0)
    return x.withColumn(out, z).drop("__m", "__a", "__d", "__sd", "__mean")


def best_knees(points: DataFrame, series: str, delta_bic_least: float = 10.0, strength_least: float = 0.5) -> DataFrame:
    """Per series the strongest sane candidate over both minimums; strength sums the robust z of gain and slope change."""
    c = robust_z(robust_z(knee_candidates(points, series), [series], "delta_bic", "zb"), [series], "delta_gamma", "zg")
    c = c.withColumn("strength", F.col("zb") + F.col("zg")).where(F.col("sanity_ok") & (F.col("delta_bic") >= delta_bic_least) & (F.col("strength") >= strength_least))
    w = Window.partitionBy(series).orderBy(F.round("strength", 9).desc(), "k")
    return c.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(series, "L_k", "delta_bic", "delta_gamma", "strength", "slope_left", "slope_right")


def theil_sen(points: DataFrame, series: str, least: int = 2) -> DataFrame:
    """Median slope over all pairs of points of a series, and the intercept through the medians."""
    a = points.select(F.col(series), F.col("i").alias("ia"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = points.select(F.col(series).alias("__s"), F.col("i").alias("ib"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    pairs = a.join(b, (F.col(series) == F.col("__s")) & (F.col("ia") < F.col("ib")) & (F.col("xb") > F.col("xa")))
    slopes = pairs.groupBy(series).agg(F.median((F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa"))).alias("slope"))
    mid = points.groupBy(F.col(series).alias("__m")).agg(F.median("x").alias("mx"), F.median("y").alias("my"), F.count("*").alias("n"))
    j = slopes.join(mid, F.col(series) == F.col("__m")).where(F.col("n") >= least)
    return j.select(series, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def weighted_lines(points: DataFrame, series: str, least: int = 4) -> DataFrame:
    """Weighted least squares per series (weights above 0): gamma, intercept, delta = 2 - gamma, drift of the residuals.

    Drift is the distance between the mean residuals of the first and second half of the points.
    """
    p = points.where(F.col("weight") > 0)
    w = Window.partitionBy(series)
    p = p.withColumn("sw", F.sum("weight").over(w))
    p = p.withColumn("mx", F.sum(F.col("weight") * F.col("x")).over(w) / F.col("sw")).withColumn("my", F.sum(F.col("weight") * F.col("y")).over(w) / F.col("sw"))
    sxx = F.sum(F.col("weight") * (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx"))).over(w)
    sxy = F.sum(F.col("weight") * (F.col("x") - F.col("mx")) * (F.col("y") - F.col("my"))).over(w)
    p = p.withColumn("slope", F.try_divide(sxy, sxx)).withColumn("resid", F.col("y") - F.col("my") - F.col("slope") * (F.col("x") - F.col("mx")))
    early = F.col("i") < F.expr("n_points div 2")
    g = p.groupBy(series).agg(
        F.count("*").alias("n"),
        F.max("slope").alias("gamma"),
        (F.max("my") - F.max("slope") * F.max("mx")).alias("intercept"),
        F.abs(F.avg(F.when(early, F.col("resid"))) - F.avg(F.when(~early, F.col("resid")))).alias("drift"),
    )
    return g.where(F.col("n") >= least).select(series, "n", "gamma", (2.0 - F.col("gamma")).alias("Delta_hat"), "intercept", "drift")


def mean_shift(points: DataFrame, series: str) -> DataFrame:
    """The split of each series with the largest shift between the mean y left and right of it, over the spread of y."""
    w = Window.partitionBy(series)
    o = w.orderBy("i")
    x = points.withColumn("left", F.avg("y").over(o.rowsBetween(Window.unboundedPreceding, -1))).withColumn("right", F.avg("y").over(o.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("score", F.abs(F.col("right") - F.col("left")) / (F.stddev_pop("y").over(w) + LOG_FLOOR)).where((F.col("i") >= 1) & (F.col("i") < F.col("n_points") - 1))
    r = Window.partitionBy(series).orderBy(F.round("score", 9).desc(), "i")
    return x.withColumn("__r", F.row_number().over(r)).where("__r = 1").select(series, F.col("i").alias("split"), "L", "score")


def segmented_split(points: DataFrame, series: str) -> DataFrame:
    """Best split of each series of at least 5 points into two separate lines, and its quality 1 - sse / sse of one line."""
    cut = points.where((F.col("i") >= 2) & (F.col("i") < F.col("n_points") - 2)).select(F.col(series).alias("__s"), F.col("i").alias("k"))
    j = points.join(cut, F.col(series) == F.col("__s")).withColumn("late", F.col("i") >= F.col("k"))

    def sse() -> Column:
        return F.greatest(F.count("*") * (F.var_pop("y") - F.coalesce(F.try_divide(F.covar_pop("x", "y") * F.covar_pop("x", "y"), F.var_pop("x")), F.lit(0.0))), F.lit(0.0))

    two = j.groupBy(series, "k", "late").agg(sse().alias("sse")).groupBy(series, "k").agg(F.sum("sse").alias("sse"))
    one = points.groupBy(F.col(series).alias("__o")).agg(sse().alias("sse_one"), F.count("*").alias("n")).where("n >= 5")
    r = Window.partitionBy(series).orderBy(F.round("sse", 12), "k")
    best = two.withColumn("__r", F.row_number().over(r)).where("__r = 1").join(one, F.col(series) == F.col("__o"))
    quality = 1.0 - F.col("sse") / F.greatest(F.col("sse_one"), F.lit(LOG_FLOOR))
    return best.select(series, F.col("k").alias("split"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality)).alias("quality"))


def gradient(df: DataFrame, by: list[str], order: str, x: str, y: str, out: str) -> DataFrame:
    """Second-order gradient of y over unevenly spaced x, one-sided at the ends; null for a single point."""
    w = Window.partitionBy(*by).orderBy(order)
    xp, xn, yp, yn = F.lag(x).over(w), F.lead(x).over(w), F.lag(y).over(w), F.lead(y).over(w)
    z = df.select("*", xp.alias("__xp"), xn.alias("__xn"), yp.alias("__yp"), yn.alias("__yn"))
    hs, hd = F.col(x) - F.col("__xp"), F.col("__xn") - F.col(x)
    inner = F.try_divide(hs * hs * F.col("__yn") + (hd * hd - hs * hs) * F.col(y) - hd * hd * F.col("__yp"), hs * hd * (hd + hs))
    g = F.when(F.col("__xp").isNull(), F.try_divide(F.col("__yn") - F.col(y), hd)).when(F.col("__xn").isNull(), F.try_divide(F.col(y) - F.col("__yp"), hs)).otherwise(inner)
    return z.withColumn(out, g).drop("__xp", "__xn", "__yp", "__yn")


def curvature(points: DataFrame, series: str) -> DataFrame:
    """Curvature |y''| / (1 + y'^2)^1.5 of each point, its gradient (torsion) and radius of at most 1e12."""
    p = gradient(gradient(points, [series], "i", "x", "y", "d1"), [series], "i", "x", "d1", "d2")
    p = p.withColumn("kappa", F.abs("d2") / F.pow(1.0 + F.col("d1") * F.col("d1"), 1.5))
    p = gradient(p, [series], "i", "x", "kappa", "torsion")
    return p.select(series, "i", "L", "d1", "kappa", "torsion", (1.0 / F.greatest("kappa", F.lit(LOG_FLOOR))).alias("radius"))


def lag1_autocorrelation(points: DataFrame, series: str) -> DataFrame:
    """Correlation of successive y; 0 for fewer than 3 points or without spread."""
    w = Window.partitionBy(series).orderBy("i")
    x = points.withColumn("__n", F.lead("y").over(w))
    g = x.groupBy(series).agg(F.count("*").alias("n"), F.covar_pop("y", "__n").alias("c"), F.var_pop(F.when(F.col("__n").isNotNull(), F.col("y"))).alias("v0"), F.var_pop("__n").alias("v1"))
    d = F.sqrt(F.col("v0") * F.col("v1")) * (F.col("n") - 1)
    return g.select(series, "n", F.when((F.col("n") >= 3) & (d > LOG_FLOOR), F.col("c") / F.sqrt(F.col("v0") * F.col("v1"))).otherwise(0.0).alias("autocorrelation"))


def instability_band(points: DataFrame, series: str, window: int = 7, z: float = 2.0) -> DataFrame:
    """The longest stretch of at least two points whose local slopes vary and fit badly beyond robust limits.

    Each point's window of neighbours (at least 4 points) is fitted by the median of its pair slopes; a point counts where
    the variance of those slopes and the residual of its own window both exceed median + z MAD. Series of fewer than 6
    points have none.
    """
    half = window // 2
    p = points.where(F.col("n_points") >= 6)
    a = p.select(F.col(series), F.col("i").alias("c"))
    q = p.select(F.col(series).alias("__q"), F.col("i").alias("qi"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    inside = a.join(q, (F.col(series) == F.col("__q")) & (F.abs(F.col("qi") - F.col("c")) <= half)).drop("__q")
    r = inside.select(F.col(series).alias("__r"), F.col("c").alias("rc"), F.col("qi").alias("ri"), F.col("qx").alias("rx"), F.col("qy").alias("ry"))
    pair = inside.join(r, (F.col(series) == F.col("__r")) & (F.col("c") == F.col("rc")) & (F.col("qi") < F.col("ri")))
    slope = pair.groupBy(F.col(series).alias("__s"), F.col("c").alias("sc")).agg(F.median((F.col("ry") - F.col("qy")) / (F.col("rx") - F.col("qx"))).alias("slope"))
    mid = inside.groupBy(F.col(series).alias("__m"), F.col("c").alias("mc")).agg(F.median("qx").alias("mx"), F.median("qy").alias("my"), F.count("*").alias("n")).where("n >= 4")
    fit = slope.join(mid, (F.col("__s") == F.col("__m")) & (F.col("sc") == F.col("mc"))).select("__s", "sc", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("b"))
    res = inside.join(fit, (F.col(series) == F.col("__s")) & (F.col("c") == F.col("sc")))
    e = F.col("qy") - F.col("slope") * F.col("qx") - F.col("b")
    local = res.groupBy(series, "c").agg(F.max("slope").alias("slope"), F.sqrt(F.avg(e * e)).alias("resid"))
    near = Window.partitionBy(series).orderBy("c").rangeBetween(-half, half)
    local = local.withColumn("k", F.count("slope").over(near)).withColumn("var", F.when(F.col("k") >= 2, F.var_pop("slope").over(near)))
    whole = Window.partitionBy(series)

    def limit(d: DataFrame, col: str) -> DataFrame:
        d = d.withColumn("__m", F.median(col).over(whole)).withColumn("__a", F.abs(F.col(col) - F.col("__m")))
        return d.withColumn(f"{col}_limit", F.col("__m") + z * F.greatest(1.4826 * F.median("__a").over(whole), F.lit(LOG_FLOOR))).drop("__m", "__a")

    flagged = limit(limit(local, "var"), "resid").where((F.col("var") > F.col("var_limit")) & (F.col("resid") > F.col("resid_limit")))
    island = flagged.withColumn("g", F.col("c") - F.row_number().over(Window.partitionBy(series).orderBy("c")))
    runs = island.groupBy(series, "g").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("b > a")
    runs = runs.withColumn("__r", F.row_number().over(Window.partitionBy(series).orderBy((F.col("b") - F.col("a")).desc(), "a"))).where("__r = 1")
    lo = points.select(F.col(series).alias("__l"), F.col("i").alias("li"), F.col("L").alias("band_lo"))
    hi = points.select(F.col(series).alias("__h"), F.col("i").alias("hi_"), F.col("L").alias("band_hi"))
    j = runs.join(lo, (F.col(series) == F.col("__l")) & (F.col("a") == F.col("li"))).join(hi, (F.col(series) == F.col("__h")) & (F.col("b") == F.col("hi_")))
    return j.select(series, "band_lo", "band_hi")


TWO_PI = 2.0 * math.pi
