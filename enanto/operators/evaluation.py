"""Evaluation of results: rates, traces, calibration, ranking quality, thresholds and blocked splits.

Everything groups with map-side combine; scores are counted per distinct value before they are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranked
from ..functions.aggregates import ACCURACY, median
from ..functions.scalars import finite, null_nan


def runs(results: DataFrame) -> DataFrame:
    """One row per run_id (null left out) with its scalar columns; they repeat on each of the run's rows."""
    keep = ["domain", "test_name", "L_k", "knee_p", "knee_detected", "gamma", "stability_class", "knee_rejected_because"]
    per = results.where(F.col("run_id").isNotNull()).groupBy("run_id")
    return per.agg(*[F.max(c).alias(c) for c in keep], F.min("L").alias("L_min"), F.max("L").alias("L_max"), median(null_nan(F.col("eta_std"))).alias("spread"))


def case_metrics(r: DataFrame, by: list[str]) -> DataFrame:
    """Rates per group of runs: detected knees, confident ones, stable ones, rejected ones; medians of knee_p and gamma."""
    return r.groupBy(*by).agg(
        F.count("*").alias("n_runs"),
        F.avg(F.col("knee_detected").cast("double")).alias("knee_rate"),
        F.avg((F.col("knee_p") >= 0.5).cast("double")).alias("confident_rate"),
        F.avg((F.col("stability_class") == "stable").cast("double")).alias("stable_rate"),
        F.count_if(F.col("knee_rejected_because").isNotNull()).alias("n_rejected"),
        median(F.col("knee_p")).alias("knee_p_median"),
        median(F.col("gamma")).alias("gamma_median"),
    )


def reason_counts(r: DataFrame) -> DataFrame:
    """Runs per token of the semicolon-separated reasons; blank tokens don't count."""
    tokens = r.select(F.explode(F.split("knee_rejected_because", ";")).alias("token"))
    return tokens.select(F.trim("token").alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n_runs"))


def top_runs(r: DataFrame, by: str, k: int = 3) -> DataFrame:
    """The k most confident runs of each group (ties by run_id), with their rank."""
    w = Window.partitionBy(by).orderBy(F.col("knee_p").desc(), "run_id")
    return r.select(by, "run_id", "knee_p", "gamma", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def expected_class(gamma: Column, eps: float = 0.1) -> Column:
    return F.when(gamma > eps, "stable").when(gamma < -eps, "forbidden").when(gamma.isNotNull(), "marginal")


def confusion(r: DataFrame, labels: tuple[str, ...] = ("stable", "marginal", "forbidden")) -> DataFrame:
    """Counts of expected against reported class over all pairs of labels, zeros included."""
    inside = F.col("expected").isin(*labels) & F.col("reported").isin(*labels)
    counted = r.select(expected_class(F.col("gamma")).alias("expected"), F.col("stability_class").alias("reported")).where(inside)
    cells = F.array(*[F.struct(F.lit(a).alias("expected"), F.lit(b).alias("reported")) for a in labels for b in labels])
    grid = r.sparkSession.range(1).select(F.explode(cells).alias("c")).select("c.*", F.lit(0).cast("long").alias("n"))
    return counted.groupBy("expected", "reported").agg(F.count("*").alias("n")).unionByName(grid).groupBy("expected", "reported").agg(F.sum("n").alias("n_runs"))


def calibration_error(r: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error of knee_p against knee_detected per group; the last bin holds 1."""
    conf = F.greatest(F.col("knee_p"), 1.0 - F.col("knee_p"))
    right = ((F.col("knee_p") >= 0.5) == F.col("knee_detected")).cast("double")
    x = r.where(F.col("knee_p").between(0, 1) & F.col("knee_detected").isNotNull()).select(*by, conf.alias("conf"), right.alias("right"))
    b = x.groupBy(*by, F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg("right").alias("a"))
    return b.groupBy(*by).agg(F.sum("n").alias("n_runs"), (F.sum(F.abs(F.col("a") - F.col("c")) * F.col("n")) / F.sum("n")).alias("ece"))


def auroc(r: DataFrame, by: str, score: str = "knee_p", truth: str = "knee_detected") -> DataFrame:
    """Area under the ROC curve per group, tied scores averaged; null without both classes. Ordered over distinct scores."""
    x = r.where(finite(F.col(score)) & F.col(truth).isNotNull()).select(by, score, F.col(truth).cast("double").alias("p"), (~F.col(truth)).cast("double").alias("q"))
    d = ranked(x, [by], score, ("p", "q"))
    wins = F.col("p") * (F.col("upto_q") - F.col("q") / 2.0)
    g = d.groupBy(by).agg(F.sum("p").cast("long").alias("n_pos"), F.sum("q").cast("long").alias("n_neg"), F.sum(wins).alias("wins"))
    return g.select(by, "n_pos", "n_neg", F.try_divide("wins", F.col("n_pos") * F.col("n_neg")).alias("auroc"))


P_GRID = (0.25, 0.35, 0.45, 0.55)
G_GRID = (0.0, 0.5, 1.0, 1.5)
M_GRID = (0.05, 0.1, 0.2, 0.4)


def _level(c: Column, grid: tuple[float, ...]) -> Column:
    """How many limits of an ascending grid a value reaches; null reaches none."""
    return F.aggregate(F.array(*[F.coalesce(c >= g, F.lit(False)) for g in grid]), F.lit(0), lambda a, x: a + x.cast("int"))


def threshold_grid(r: DataFrame, fp_most: float = 0.10, beta: float = 1.0) -> DataFrame:
    """False positive and negative rates, precision, recall and F-beta of each threshold combination.

    A run is positive where knee_p and gamma reach their limits or its spread reaches the third; the truth is
    knee_detected. Runs are first counted by the levels they reach, so the grid is applied to at most
    ``(|p| + 1)(|g| + 1)(|m| + 1)`` cells however many runs there are. A rate without a base is null.
    """
    cells = r.where(F.col("knee_detected").isNotNull()).groupBy(
        _level(F.col("knee_p"), P_GRID).alias("lp"), _level(F.col("gamma"), G_GRID).alias("lg"), _level(F.col("spread"), M_GRID).alias("lm"), F.col("knee_detected").alias("truth")
    ).agg(F.count("*").alias("c"))
    combos = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in (("ip", i), ("ig", j), ("im", m), ("p_min", p), ("gamma_min", g), ("middle_min", q))]) for i, p in enumerate(P_GRID) for j, g in enumerate(G_GRID) for m, q in enumerate(M_GRID)])
    x = cells.select("*", F.explode(combos).alias("t")).select("*", "t.*")
    hit = ((F.col("lp") > F.col("ip")) & (F.col("lg") > F.col("ig"))) | (F.col("lm") > F.col("im"))

    def total(when: Column) -> Column:
        return F.sum(F.when(when, F.col("c")).otherwise(0))

    g = x.groupBy("ip", "ig", "im", "p_min", "gamma_min", "middle_min").agg(
        total(hit & F.col("truth")).alias("tp"), total(hit & ~F.col("truth")).alias("fp"), total(~hit & F.col("truth")).alias("fn"), total(~hit & ~F.col("truth")).alias("tn")
    )
    prec, rec = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    b2 = beta * beta
    g = g.withColumn("fp_rate", F.try_divide("fp", F.col("fp") + F.col("tn"))).withColumn("fn_rate", F.try_divide("fn", F.col("fn") + F.col("tp"))).withColumn("precision", prec).withColumn("recall", rec)
    g = g.withColumn("f_beta", F.coalesce(F.try_divide((1 + b2) * F.col("precision") * F.col("recall"), b2 * F.col("precision") + F.col("recall")), F.lit(0.0)))
    return g.withColumn("allowed", F.coalesce(F.col("fp_rate") <= fp_most, F.lit(True)))


def best_thresholds(r: DataFrame, fp_most: float = 0.10, beta: float = 1.0) -> DataFrame:
    """The allowed combination with the largest F-beta; of equal ones the first in the order of the grids."""
    g = threshold_grid(r, fp_most, beta).where("allowed")
    return g.orderBy(F.round("f_beta", 12).desc(), "ip", "ig", "im").limit(1).select("p_min", "gamma_min", "middle_min", "fp_rate", "fn_rate", "precision", "recall", "f_beta")


def error_quantiles(results: DataFrame, by: str, limit: float = 0.2) -> DataFrame:
    """Median and 90 % point (lower order statistic) of |eta - eta_mean| per group and the share beyond the limit."""
    e = F.abs(null_nan(F.col("eta")) - null_nan(F.col("eta_mean")))
    q = F.percentile_approx(e, [0.5, 0.9], ACCURACY)
    g = results.groupBy(by).agg(F.count(e).alias("n"), q.alias("q"), F.avg((e > limit).cast("double")).alias("catastrophic_rate"))
    return g.select(by, "n", F.get("q", F.lit(0)).alias("p50"), F.get("q", F.lit(1)).alias("p90"), "catastrophic_rate")


def recommended_limits(quantiles: DataFrame, by: str) -> DataFrame:
    """Limits from calibration: error points with 15 % headroom, catastrophic rate times 1.2 plus 0.02, at most 1."""
    return quantiles.select(by, (F.col("p50") * 1.15).alias("p50_max"), (F.col("p90") * 1.15).alias("p90_max"), F.least(F.lit(1.0), F.col("catastrophic_rate") * 1.2 + 0.02).alias("catastrophic_max"))


def tail_estimates(results: DataFrame, by: str, top: int = 32) -> DataFrame:
    """Kurtosis m4 / m2^2 and Hill's tail index over the ``top`` largest |eta|; null for fewer than 4 or 2 values."""
    a = F.abs(null_nan(F.col("eta")))
    x = results.select(by, "result_id", null_nan(F.col("eta")).alias("e"), a.alias("a")).where("e is not null")
    w = Window.partitionBy(by).orderBy(F.col("a").desc(), "result_id")
    tops = x.where("a > 0").withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)  # cut per partition before the shuffle
    h = tops.groupBy(F.col(by).alias("__h")).agg(F.min("a").alias("least"), F.avg(F.log("a")).alias("ml"), F.count("*").alias("k"))
    hill = F.when((F.col("k") >= 2) & (F.col("ml") > F.log("least")), F.col("k") / ((F.col("ml") - F.log("least")) * F.col("k")))
    m = x.groupBy(by).agg(F.count("*").alias("n"), F.when((F.count("*") >= 4) & (F.var_pop("e") > 1e-12), F.kurtosis("e") + 3.0).alias("kurtosis"))
    return m.join(h, F.col(by).eqNullSafe(F.col("__h")), "left").select(by, "n", "kurtosis", hill.alias("hill"))


def ks_distance(df: DataFrame, by: str, value: Column, first: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance between the rows where ``first`` holds and the others, per group.

    Exact over all distinct values; null where a side has none. Null, NaN and rows with a null ``first`` are left out.
    """
    x = df.select(by, value.alias("v"), first.cast("double").alias("a"), (~first).cast("double").alias("b")).where(F.col("a").isNotNull())
    d = ranked(x, [by], "v", ("a", "b"))
    n = d.groupBy(F.col(by).alias("__by")).agg(F.sum("a").cast("long").alias("n_first"), F.sum("b").cast("long").alias("n_second"))
    j = d.join(n, F.col(by).eqNullSafe(F.col("__by")))
    return j.groupBy(by, "n_first", "n_second").agg(F.max(F.abs(F.try_divide("upto_a", "n_first") - F.try_divide("upto_b", "n_second"))).alias("ks"))


def blocked_split(cases: DataFrame, boundary: str, buffer_days: int) -> DataFrame:
    """Cases with a known onset as train (before boundary - buffer), test (from boundary + buffer) or buffer."""
    d = F.lit(boundary).cast("timestamp_ntz")
    gap = F.make_dt_interval(F.lit(buffer_days))
    label = F.when(F.col("onset_time") < d - gap, "train").when(F.col("onset_time") >= d + gap, "test").otherwise("buffer")
    return cases.where(F.col("onset_time").isNotNull()).select("case_id", "domain", "onset_time", label.alias("split"))


def split_gaps(split: DataFrame) -> DataFrame:
    """For each test case the hours to the nearest train case of its domain, either way (as-of in both directions).

    Within a day rows see each other; beyond it the days' latest and earliest train cases stand for them, so a window
    holds a day's cases or one row per day.
    """
    train = F.when(F.col("split") == "train", F.col("onset_time"))
    x = split.select("case_id", "domain", "onset_time", "split", F.to_date("onset_time").alias("day"), train.alias("train"))
    o = Window.partitionBy("domain", "day").orderBy("onset_time")
    x = x.withColumn("before", F.last("train", True).over(o.rangeBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("after", F.first("train", True).over(o.rangeBetween(Window.currentRow, Window.unboundedFollowing)))
    days = x.groupBy(F.col("domain").alias("__d"), F.col("day").alias("__day")).agg(F.min("train").alias("lo"), F.max("train").alias("hi"))
    by_day = Window.partitionBy("__d").orderBy("__day")
    days = days.select("__d", "__day", F.max("hi").over(by_day.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.min("lo").over(by_day.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    x = x.where("split = 'test'").join(days, F.col("domain").eqNullSafe(F.col("__d")) & (F.col("day") == F.col("__day")))

    def hours(a: Column, b: Column) -> Column:
        return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 3.6e9

    before, after = F.coalesce("before", "earlier"), F.coalesce("after", "later")
    gap = F.least(hours(F.col("onset_time"), before), hours(after, F.col("onset_time")))
    return x.select("case_id", "domain", gap.alias("gap_hours"))


def stratified_folds(r: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold of each row, even within each class: rows are dealt in md5 order within 256 buckets per class."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    w = Window.partitionBy(label, F.substring("h", 1, 2)).orderBy("h")
    x = r.withColumn("h", h)
    start = F.conv(F.substring("h", 1, 2), 16, 10).cast("int")
    return x.select(key, label, F.pmod(F.row_number().over(w) - 1 + start, F.lit(k)).alias("fold"))
