"""Stability, bands, alignment, coherence and middle scores as column expressions and grouped aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import median
from ..functions.scalars import LOG_FLOOR

TWO_PI = 2.0 * math.pi


def stability(gamma: Column, base: float = 2.0, eps: float = 0.1) -> dict[str, Column]:
    """Class by gamma against +-eps (stable, marginal, forbidden), effective eigenvalue base^gamma, inequality."""
    return {
        "class_hat": F.when(gamma > eps, "stable").when(gamma < -eps, "forbidden").when(gamma.isNotNull(), "marginal"),
        "lambda_eff": F.pow(F.lit(base), gamma),
        "ineq_pass": gamma > eps,
    }


def stability_score(gamma: Column, mu: Column, tau: Column, base: float = 2.0) -> Column:
    return F.pow(F.lit(base), gamma) / F.sqrt(1.0 + mu * mu * tau * tau)


def stability_diagnostics(df: DataFrame, key: str, base: float = 2.0, eps_log: float = 0.15, grid: int = 128) -> DataFrame:
    """From gamma, mu and tau per key: score at mu, its log margin, band class and the width in ln mu where ln S is near 0.

    The width is taken over ``grid`` points spaced evenly in ln mu from mu / 20 to 20 mu. Where mu or tau isn't positive
    the class is ``incoherent`` and the rest null.
    """
    ok = (F.col("mu") > 0) & (F.col("tau") > 0)
    s = F.when(ok, stability_score(F.col("gamma"), F.col("mu"), F.col("tau"), base))
    margin = F.log(F.greatest(s, F.lit(LOG_FLOOR)))
    step = 2.0 * math.log(20.0) / (grid - 1)
    ln_mu = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda k: F.log("mu") - math.log(20.0) + k * F.lit(step))
    near = F.filter(ln_mu, lambda m: F.abs(F.log(F.greatest(stability_score(F.col("gamma"), F.exp(m), F.col("tau"), base), F.lit(LOG_FLOOR)))) <= eps_log)
    width = F.when(ok, F.when(F.size(near) > 0, F.array_max(near) - F.array_min(near)).otherwise(0.0))
    band = F.when(margin > eps_log, "coherent").when((margin < -eps_log) | margin.isNull(), "incoherent").otherwise("forbidden_middle")
    return df.select(key, s.alias("S_at_mu"), margin.alias("S_margin_log"), band.alias("band_class"), width.alias("W_mu"))


def predicted_bands(df: DataFrame, key: str, size: str, c_m: float = 1.0, n_max: int = 3) -> DataFrame:
    """n 2 pi c / L for n = 1..n_max; sizes of at most 0 give no bands."""
    x = df.where(F.col(size) > 0).select(key, size, F.explode(F.sequence(F.lit(1), F.lit(n_max))).alias("n"))
    return x.select(key, "n", (F.col("n") * F.lit(TWO_PI * c_m) / F.col(size)).alias("omega_pred"))


def band_hit_rate(predicted: DataFrame, observed: DataFrame, key: str, rel_tol: float = 0.15) -> DataFrame:
    """Share of each key's predictions that have an observed peak (column omega) within rel_tol; 0 without peaks."""
    o = observed.where(F.col("omega") > 0).select(F.col(key).alias("__k"), "omega")
    near = F.abs(F.col("omega") - F.col("omega_pred")) / F.col("omega_pred") <= rel_tol
    j = predicted.join(o, (F.col(key) == F.col("__k")) & near, "left")
    hit = j.groupBy(key, "n").agg(F.max(F.col("omega").isNotNull().cast("int")).alias("hit"))
    return hit.groupBy(key).agg(F.avg("hit").alias("hit_rate"))


def alignment_residual(omega: Column, size: Column, c_m: float = 1.0) -> Column:
    """ln(omega / (2 pi c / L)); null unless both are positive."""
    return F.when((omega > 0) & (size > 0), F.log(omega * size / F.lit(TWO_PI * c_m)))


def impedance(df: DataFrame, by: list[str], c_m: float = 30.0, tolerance: float = 0.1) -> DataFrame:
    """Median of omega L / (2 pi c) per group and whether it lies within the tolerance of 1; nulls are left out."""
    ratio = F.col("omega") * F.col("L") / F.lit(TWO_PI * c_m)
    g = df.groupBy(*by).agg(median(ratio).alias("ratio"), F.count(ratio).alias("n"))
    return g.select(*by, "n", "ratio", (F.abs(F.col("ratio") - 1.0) <= tolerance).alias("passed"))


def coherence(pairs: DataFrame, eps: float = LOG_FLOOR) -> DataFrame:
    """Per case: A (cosine of even and odd part), F = exp(-spread of successive odd steps / spread of the even part), P_lock.

    Steps run between successive pairs of one size: within a day by the pairs' order, from day to day between the last
    pair of one and the first of the next, so no series is ever ordered in one task. P_lock is the
    absolute mean sign times one minus the spread of the mean signs of three size segments (cut at the 33 and 66 % points
    of the sizes of the case's pairs; one segment where fewer than three sizes occur); zero signs are left out.
    """
    w = Window.partitionBy("case_id", "L", F.to_date("t")).orderBy("t")
    x = pairs.withColumn("step", F.col("X_minus") - F.lag("X_minus").over(w)).withColumn("s", F.signum("signed_parity"))
    days = pairs.groupBy("case_id", "L", F.to_date("t").alias("day")).agg(F.min_by("X_minus", "t").alias("first"), F.max_by("X_minus", "t").alias("last"))
    across = days.select("case_id", (F.col("first") - F.lag("last").over(Window.partitionBy("case_id", "L").orderBy("day"))).alias("step"))  # one row a day
    shear = x.select("case_id", "step").unionByName(across).groupBy(F.col("case_id").alias("__h")).agg(F.coalesce(F.stddev_pop("step"), F.lit(0.0)).alias("shear"))
    whole = x.groupBy("case_id").agg(
        F.sum(F.col("X_plus") * F.col("X_minus")).alias("pm"),
        F.sum(F.col("X_plus") * F.col("X_plus")).alias("pp"),
        F.sum(F.col("X_minus") * F.col("X_minus")).alias("mm"),
        F.stddev_pop("X_plus").alias("even"),
    )
    whole = whole.join(shear, F.col("case_id") == F.col("__h"))
    sizes = x.where("s <> 0").groupBy("case_id", "L").agg(F.count("*").alias("c"), F.sum("s").alias("ss"))
    cuts = sizes.groupBy(F.col("case_id").alias("__c")).agg(F.expr("percentile(L, array(0.33D, 0.66D), c)").alias("q"), F.count("*").alias("n_sizes"), (F.sum("ss") / F.sum("c")).alias("mean_sign"))
    label = F.when(F.col("n_sizes") < 3, 0).otherwise((F.col("L") >= F.col("q")[0]).cast("int") + (F.col("L") >= F.col("q")[1]).cast("int"))
    seg = sizes.join(cuts, F.col("case_id") == F.col("__c")).groupBy("case_id", label.alias("seg"), "mean_sign").agg((F.sum("ss") / F.sum("c")).alias("m"))
    lock = seg.groupBy(F.col("case_id").alias("__k"), "mean_sign").agg(F.coalesce(F.stddev_pop("m"), F.lit(0.0)).alias("spread"))
    j = whole.join(lock, F.col("case_id") == F.col("__k"), "left")
    p = F.abs("mean_sign") * F.greatest(F.lit(0.0), 1.0 - F.col("spread"))
    return j.select(
        "case_id",
        (F.col("pm") / (F.sqrt("pp") * F.sqrt("mm") + eps)).alias("A"),
        F.exp(-F.col("shear") / (F.col("even") + eps)).alias("F"),
        F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)), F.lit(0.0)).alias("P_lock"),
    )


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def middle_scores(p: Column, ci_share: Column, strength: Column, delta_gamma: Column, drift: Column, ridge: Column) -> dict[str, Column]:
    """Both middle scores: the detector's own, and the pipeline's with its label at 0.6.

    ``ci_share`` is the width of the knee's interval over the range of sizes; null (no interval) counts as 1.
    """
    q = clip(p)
    vague = 1.0 - F.abs(2.0 * q - 1.0)
    wide = clip(F.coalesce(ci_share, F.lit(1.0)))
    bent = clip(F.abs(F.coalesce(delta_gamma, F.lit(0.0))) / 0.35)
    own = clip(0.40 * vague + 0.30 * wide + 0.20 / (1.0 + F.exp(F.greatest(strength, F.lit(-6.0)))) + 0.10 * bent)
    full = clip(
        0.25 * vague
        + 0.25 * wide
        + 0.15 / (1.0 + F.exp(F.greatest(strength, F.lit(-4.0))))
        + 0.15 * bent
        + 0.10 * clip(F.greatest(drift, F.lit(0.0)) / 0.2)
        + 0.10 / (1.0 + F.greatest(ridge, F.lit(0.0)))
    )
    return {"detector_score": own, "middle_score": full, "middle_label": F.when(full >= 0.6, "forbidden_middle").otherwise("resolved")}
