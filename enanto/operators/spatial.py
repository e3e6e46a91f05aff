"""Gridded fields: tiles around events, mirroring in longitude, anomalies, matched and offset controls.

The grid is a long table (cell, time, lat, lon, u10, v10). Range conditions are carried by equi-joins on bins, with the
exact condition as a residual, so each plans as a hash or sort-merge join and splits where a bin is crowded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import hash_ranks
from ..functions.aggregates import median
from ..functions.scalars import floor_to, round_half_even
from ..session import written


def derived_grid(pairs: DataFrame, cases: DataFrame, composite: bool = False) -> DataFrame:
    """Hourly field per located case: u10 is the mean even, v10 the mean odd part of its pairs.

    Means are of exact decimal sums (twelve decimals), so they don't depend on the order of the pairs; parts of 1e16 and
    more are fill values and left out.

    A composite takes the same hour of all days together, dated 2000-01-01, so that all cells have the same times.
    """
    at = cases.where(F.col("case_id").isNotNull() & F.col("lat0").isNotNull() & F.col("lon0").isNotNull())
    at = at.groupBy(F.col("case_id").alias("cell")).agg(F.min("lat0").alias("lat"), F.min("lon0").alias("lon"))
    j = pairs.join(at, F.col("case_id") == F.col("cell"))
    hour = F.lit("2000-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour("t")) if composite else F.date_trunc("hour", "t").cast("timestamp_ntz")
    exact = {c: F.col(c).try_cast("decimal(28,12)") for c in ("X_plus", "X_minus")}
    j = j.withColumns(exact).where("X_plus is not null and X_minus is not null")
    g = j.groupBy("cell", "lat", "lon", hour.alias("time")).agg(F.sum("X_plus").alias("p"), F.sum("X_minus").alias("m"), F.count("*").alias("n"))
    return g.select("cell", "lat", "lon", "time", (F.col("p").cast("double") / F.col("n")).alias("u10"), (F.col("m").cast("double") / F.col("n")).alias("v10"), "n")


def storm_centres(cases: DataFrame) -> DataFrame:
    """Located cases with an onset, labelled storm where their domain has any storm, else near_storm."""
    c = cases.where(F.col("case_id").isNotNull() & F.col("onset_time").isNotNull() & F.col("lat0").isNotNull() & F.col("lon0").isNotNull())
    kind = c.groupBy(F.col("domain").alias("__d")).agg(F.max((F.col("case_type") == "storm").cast("int")).alias("__any"))
    j = c.join(kind, F.col("domain").eqNullSafe(F.col("__d")))
    label = F.when(F.col("__any") == 1, "storm").otherwise("near_storm")
    return j.where(F.col("case_type") == label).select("case_id", "domain", label.alias("event_label"), "lat0", "lon0", "onset_time", floor_to(F.abs("lat0"), 5.0).alias("lat_band"))


def _near(events: DataFrame, grid: DataFrame, widest: float, hours: int) -> DataFrame:
    """Grid rows with the events in whose box and window they lie."""
    days = F.sequence(F.to_date(F.col("onset_time") - F.expr(f"interval {hours} hours")), F.to_date(F.col("onset_time") + F.expr(f"interval {hours} hours")))
    bands = F.sequence(F.floor((F.col("lat0") - widest) / widest), F.floor((F.col("lat0") + widest) / widest))
    e = events.select("case_id", "lat0", "lon0", "onset_time", F.explode(days).alias("__day"), bands.alias("__bands")).withColumn("__band", F.explode("__bands"))
    g = grid.withColumn("__gday", F.to_date("time")).withColumn("__gband", F.floor(F.col("lat") / widest))
    near = (F.abs(F.col("lat") - F.col("lat0")) <= widest) & (F.abs(F.col("lon") - F.col("lon0")) <= widest)
    when = F.col("time").between(F.col("onset_time") - F.expr(f"interval {hours} hours"), F.col("onset_time") + F.expr(f"interval {hours} hours"))
    return g.join(e, (F.col("__gday") == F.col("__day")) & (F.col("__gband") == F.col("__band")) & near & when)


def tiles(events: DataFrame, grid: DataFrame, halves: tuple[float, ...] = (5.0, 15.0, 45.0), hours: int = 240) -> DataFrame:
    """Per event, half-width and time: mean and largest speed and mean components of the grid rows in the box.

    The window is ``hours`` either side of the onset, ends included. Events and rows meet on (day, latitude band): an
    event is laid out over the days and bands its widest box touches, a grid row is in one of each.
    """
    j = _near(events, grid, max(halves), hours)
    x = j.select("case_id", "time", "lat", "lon", "lat0", "lon0", "u10", "v10", F.explode(F.array(*[F.lit(h) for h in halves])).alias("half"))
    x = x.where((F.abs(F.col("lat") - F.col("lat0")) <= F.col("half")) & (F.abs(F.col("lon") - F.col("lon0")) <= F.col("half")))
    speed = F.sqrt(F.col("u10") * F.col("u10") + F.col("v10") * F.col("v10"))
    return x.groupBy("case_id", "half", "time").agg(F.avg("u10").alias("u_mean"), F.avg("v10").alias("v_mean"), F.avg(speed).alias("speed_mean"), F.max(speed).alias("speed_max"), F.count("*").alias("n_cells"))


def tangential(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north parts of the unit vector around (lat0, lon0); the radial one turned by a quarter, (0, 0) at the centre."""
    d = F.radians(lon) - F.radians(lon0)
    a, a0 = F.radians(lat), F.radians(lat0)
    east = F.cos(a) * F.sin(d)
    north = F.cos(a0) * F.sin(a) - F.sin(a0) * F.cos(a) * F.cos(d)
    norm = F.sqrt(east * east + north * north)
    norm = F.when(norm > 1e-12, norm).otherwise(1.0)
    return -north / norm, east / norm


def tangential_winds(events: DataFrame, grid: DataFrame, half: float = 15.0, hours: int = 240) -> DataFrame:
    """Per event and time the mean component along the circle around the event, and across it, of the grid rows in its box."""
    j = _near(events, grid, half, hours)
    te, tn = tangential(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    x = j.select("case_id", "time", "u10", "v10", te.alias("te"), tn.alias("tn"))
    along, across = F.col("u10") * F.col("te") + F.col("v10") * F.col("tn"), F.col("u10") * F.col("tn") - F.col("v10") * F.col("te")
    return x.groupBy("case_id", "time").agg(F.avg(along).alias("along"), F.avg(across).alias("across"), F.count("*").alias("n_cells"))


def mirrored(grid: DataFrame, lon0: float = 180.0, most: float = 20.0, lat_step: float = 20.0) -> DataFrame:
    """Each grid row with the row nearest to its mirror image in longitude at the same time and latitude bin.

    The image lies at 2 lon0 - lon; the nearest row within ``most`` degrees is taken (ties by cell), never the row
    itself. Components are mirrored (u to -u, v to v); rows without a partner have nulls there.
    """
    place = ["time", "lat_bin", "__bin"]
    x = grid.select("cell", "time", "lon", round_half_even(F.col("lat"), lat_step).alias("lat_bin"), F.floor(F.col("lon") / most).alias("__bin"), (F.lit(2.0 * lon0) - F.col("lon")).alias("target"), "u10", "v10")
    # Of rows at one longitude the first cell counts, for itself the second.
    same = Window.partitionBy("time", "lat_bin", "lon").orderBy("cell")
    e = F.struct("cell", "u10", "v10")
    g = x.withColumn("k", F.row_number().over(same)).where("k <= 2").groupBy(*place, "lon").agg(F.min(e).alias("a"), F.max(F.when(F.col("k") == 2, e)).alias("b"))
    o = Window.partitionBy(*place).orderBy("lon")
    near = F.struct("lon", "a")
    g = g.select(*place, F.col("lon").alias("pos"), F.struct("lon", "a", "b", F.lag(near).over(o).alias("before"), F.lead(near).over(o).alias("after")).alias("g"))
    q = x.select("time", "lat_bin", F.explode(F.sequence(F.floor((F.col("target") - most) / most), F.floor((F.col("target") + most) / most))).alias("__bin"), F.col("target").alias("pos"), "cell")
    o = Window.partitionBy(*place).orderBy("pos")
    below, above = o.rangeBetween(Window.unboundedPreceding, Window.currentRow), o.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    j = g.unionByName(q, allowMissingColumns=True).select("cell", "time", "pos", F.last("g", True).over(below).alias("lo"), F.first("g", True).over(above).alias("hi")).where("cell is not null")

    def found(side: str, further: str) -> Column:
        """The nearest row on one side that isn't the cell's own."""
        s = F.col(side)
        at = lambda lon, e: F.struct(F.abs(lon - F.col("pos")).alias("d"), e["cell"].alias("m_cell"), lon.alias("m_lon"), e["u10"].alias("__u"), e["v10"].alias("__v"))
        return F.when(s["a"]["cell"] != F.col("cell"), at(s["lon"], s["a"])).when(s["b"].isNotNull(), at(s["lon"], s["b"])).when(s[further].isNotNull(), at(s[further]["lon"], s[further]["a"]))

    best = j.select("cell", "time", F.explode(F.array_compact(F.array(found("lo", "before"), found("hi", "after")))).alias("m")).where(F.col("m.d") <= most)
    best = best.groupBy("cell", "time").agg(F.min("m").alias("m"))
    best = best.select(F.col("cell").alias("__c"), F.col("time").alias("__bt"), "m.*")
    j = grid.join(best, (F.col("cell") == F.col("__c")) & (F.col("time") == F.col("__bt")), "left")
    return j.select("cell", "time", "lat", "lon", "u10", "v10", "m_cell", "m_lon", F.col("d").alias("m_dist"), (-F.col("__u")).alias("u10_mirror"), F.col("__v").alias("v10_mirror"))


def parity_channels(df: DataFrame) -> DataFrame:
    """Speeds of both sides, even and odd parts and eta_parity = odd / (odd + even + 1e-8)."""
    u, v, um, vm = (F.col(c) for c in ("u10", "v10", "u10_mirror", "v10_mirror"))
    odd = F.sqrt(((u - um) / 2) * ((u - um) / 2) + ((v - vm) / 2) * ((v - vm) / 2))
    even = F.sqrt(((u + um) / 2) * ((u + um) / 2) + ((v + vm) / 2) * ((v + vm) / 2))
    return df.select("*", F.sqrt(u * u + v * v).alias("speed_l"), F.sqrt(um * um + vm * vm).alias("speed_r"), (odd / (odd + even + 1e-8)).alias("eta_parity"))


EDGES = (0.0, 1.0, 2.0, 5.0, 10.0, 20.0)


def mirror_audit(m: DataFrame) -> DataFrame:
    """One row: rows, partners found and their rate, distances and their histogram over fixed edges (the last one open)."""
    d = F.col("m_dist")
    hist = [F.count_if((d >= lo) & (d < hi)).alias(f"bin_{i}") for i, (lo, hi) in enumerate(zip(EDGES, (*EDGES[1:], float("inf"))))]
    return m.agg(F.count("*").alias("n_rows"), F.count(d).alias("n_hits"), F.avg(d.isNotNull().cast("double")).alias("hit_rate"), F.avg(d).alias("dist_mean"), F.min(d).alias("dist_min"), F.max(d).alias("dist_max"), *hist)


def axis_sensitivity(grid: DataFrame, events: DataFrame, axes: tuple[float, ...] = (170.0, 180.0, 190.0)) -> DataFrame:
    """Per mirror axis: rows with a partner, mean eta_parity of event cells and of the others, and their difference."""
    parts = None
    for axis in axes:  # a fixed list of axes
        p = parity_channels(mirrored(grid, axis)).select(F.lit(axis).alias("lon0"), "cell", "eta_parity")
        parts = p if parts is None else parts.unionByName(p)
    e = events.select(F.col("case_id").alias("__e")).distinct()
    x = parts.join(e, F.col("cell") == F.col("__e"), "left").where(F.col("eta_parity").isNotNull())
    hit = F.col("__e").isNotNull()
    g = x.groupBy("lon0").agg(F.count("*").alias("n_hits"), F.avg(F.when(hit, F.col("eta_parity"))).alias("event_mean"), F.avg(F.when(~hit, F.col("eta_parity"))).alias("background_mean"))
    return g.withColumn("contrast", F.col("event_mean") - F.col("background_mean"))


def axis_robustness(sensitivity: DataFrame) -> DataFrame:
    """Spread and sign consistency of the contrast over the axes, and the axes where it is largest and smallest."""
    s = sensitivity.where(F.col("contrast").isNotNull())
    return s.agg(
        F.count("*").alias("n_axes"), F.stddev_pop("contrast").alias("contrast_std"), F.abs(F.avg(F.signum("contrast"))).alias("sign_consistency"),
        F.regr_slope("contrast", "lon0").alias("slope"), F.max_by("lon0", "contrast").alias("lon0_max"), F.min_by("lon0", "contrast").alias("lon0_min"),
    )


def anomalies(grid: DataFrame, mode: str = "lat_hour", lat_step: float = 20.0, lon_step: float = 60.0) -> DataFrame:
    """u10 and v10 less the mean of their bin, with the bin's count; bins by place and hour, day of year or nothing."""
    keys = {"lat_hour": [F.hour("time").alias("k1"), F.month("time").alias("k2")], "lat_day": [F.dayofyear("time").alias("k1"), F.lit(0).alias("k2")], "none": [F.lit(0).alias("k1"), F.lit(0).alias("k2")]}[mode]
    x = grid.select("cell", "time", "u10", "v10", round_half_even(F.col("lat"), lat_step).alias("lat_bin"), round_half_even(F.col("lon"), lon_step).alias("lon_bin"), *keys)
    names = ["lat_bin", "lon_bin", "k1", "k2"]
    m = x.groupBy(*[F.col(c).alias(f"__{c}") for c in names]).agg(F.avg("u10").alias("mu"), F.avg("v10").alias("mv"), F.count("*").alias("bin_count"))
    j = x.join(m, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names])
    return j.select("cell", "time", (F.col("u10") - F.col("mu")).alias("u_anom"), (F.col("v10") - F.col("mv")).alias("v_anom"), "bin_count")


def anomaly_audit(grid: DataFrame, least: int = 3) -> DataFrame:
    """Per mode: median bin count, share of rows in bins of at least ``least`` rows, root mean squares; and the mode to use.

    The first of lat_hour, lat_day with a coverage of at least half is used, else none.
    """
    parts = None
    for i, mode in enumerate(("lat_hour", "lat_day", "none")):
        a = anomalies(grid, mode).agg(
            median(F.col("bin_count").cast("double")).alias("bin_count_median"), F.avg((F.col("bin_count") >= least).cast("double")).alias("coverage"),
            F.sqrt(F.avg(F.col("u_anom") * F.col("u_anom"))).alias("u_rms"), F.sqrt(F.avg(F.col("v_anom") * F.col("v_anom"))).alias("v_rms"),
        ).select(F.lit(mode).alias("mode"), F.lit(i).alias("i"), "*")
        parts = a if parts is None else parts.unionByName(a)
    fit = F.when((F.col("coverage") >= 0.5) | (F.col("mode") == "none"), F.col("i"))
    return parts.withColumn("used", F.col("i") == F.min(fit).over(Window.partitionBy(F.lit(0)))).drop("i")  # three rows


def offset_controls(events: DataFrame, offset: float = 60.0, lo: float = 0.0, hi: float = 360.0) -> DataFrame:
    """A control per event, moved in longitude by the offset, the other way where that leaves the range, then clipped."""
    moved = F.when(F.col("lon0") + offset > hi, F.col("lon0") - offset).otherwise(F.col("lon0") + offset)
    lon = F.greatest(F.lit(lo), F.least(F.lit(hi), moved))
    dist = F.abs(lon - F.col("lon0"))
    return events.select("case_id", F.replace("case_id", F.lit("storm_"), F.lit("ctrl_")).alias("control_id"), "lat0", lon.alias("lon0"), dist.alias("dist_deg"), floor_to(dist, 2.0).alias("dist_bin_deg"), F.lit("C").alias("control_tier"))


_TIERS = (("tier_a_exact", ("domain", "step_s", "lat_bin", "lon_bin")), ("tier_b_lat", ("domain", "lat_bin")), ("tier_c_domain", ("domain",)))


def _ranked(df: DataFrame, keys: tuple[str, ...], out: str) -> DataFrame:
    """Rank of each row within its stratum by the md5 of case_id."""
    return hash_ranks(df, list(keys), F.col("case_id"), "case_id", out)


def matched_controls(cases: DataFrame, lat_step: float = 20.0, lon_step: float = 60.0) -> DataFrame:
    """A control case for each event case, without replacement, from the strictest tier that has one left.

    Within a tier's stratum events and free controls are ranked by the md5 of their ids and matched rank to rank: a join
    in place of a greedy loop. What a tier leaves unmatched goes on to the next.
    """
    c = cases.where(F.col("case_id").isNotNull())
    c = c.select("case_id", "domain", "step_s", "case_type", F.coalesce(round_half_even(F.col("lat0"), lat_step), F.lit(0.0)).alias("lat_bin"), F.coalesce(round_half_even(F.col("lon0"), lon_step), F.lit(0.0)).alias("lon_bin"))
    events, controls = c.where(F.col("case_type").isin("storm", "near_storm")), c.where("case_type = 'control'")
    out = None
    for quality, keys in _TIERS:
        e = _ranked(events, keys, "r")
        k = _ranked(controls, keys, "__r").select(F.col("case_id").alias("control_id"), *[F.col(x).alias(f"__{x}") for x in keys], "__r")
        on = F.col("r") == F.col("__r")
        for x in keys:
            on = on & F.col(x).eqNullSafe(F.col(f"__{x}"))
        hit = e.join(k, on).select("case_id", "control_id", F.lit(quality).alias("match_quality"), control_tier(F.lit(quality)).alias("control_tier"))
        out = hit if out is None else out.unionByName(hit)
        taken = hit.select(F.col("case_id").alias("__a"), F.col("control_id").alias("__b"))
        events = events.join(taken, F.col("case_id") == F.col("__a"), "left_anti")
        controls = controls.join(taken, F.col("case_id") == F.col("__b"), "left_anti")
    return out


#: The reference's tiers from strict to loose; ``lon_near`` stands for the bin beside the event's, one side after the other.
_ALL_TIERS = (
    ("tier_a_exact", ("month", "hour", "lat_bin", "lon_bin")),
    ("tier_b_lon_adjacent", ("month", "hour", "lat_bin", "lon_near")),
    ("tier_b_month_hour_lat", ("month", "hour", "lat_bin")),
    ("tier_c_month_lat", ("month", "lat_bin")),
    ("tier_c_hour_lat", ("hour", "lat_bin")),
    ("tier_c_month_hour", ("month", "hour")),
    ("tier_c_month_only", ("month",)),
    ("tier_c_lat_only", ("lat_bin",)),
    ("tier_c_lead_only", ()),
)


def controls_for_all(cases: DataFrame, samples: DataFrame, lat_step: float = 20.0, lon_step: float = 60.0) -> DataFrame:
    """A control for every event case: case_id, control_id, match_quality, control_tier, lat0, lon0.

    The domain takes the place of the lead; month and hour are those of onset_time, or of a case's first reading where it
    has none (as controls do). Tiers are matched rank to rank as in
    :func:`matched_controls`. A domain of more events than controls frees its controls again, as the reference empties its
    set of used ones: each comes in as many copies as rounds are needed, so none is used more often than that. Events of a
    domain without controls get an offset one. Null month, hour or place matches nothing, but the tiers without it.
    """
    began = samples.where(F.col("case_id").isNotNull()).groupBy(F.col("case_id").alias("__s")).agg(F.min("t").alias("__t0"))
    c = cases.where(F.col("case_id").isNotNull()).join(began, F.col("case_id") == F.col("__s"), "left").withColumn("at", F.coalesce("onset_time", "__t0"))
    c = c.select(
        "case_id", "domain", "case_type", "lat0", "lon0", F.month("at").alias("month"), F.hour("at").alias("hour"),
        round_half_even(F.col("lat0"), lat_step).alias("lat_bin"), round_half_even(F.col("lon0"), lon_step).alias("lon_bin"),
    )
    c = written(c, "timed")
    events, controls = c.where(F.col("case_type").isin("storm", "near_storm")), c.where("case_type = 'control'")
    many = c.groupBy(F.col("domain").alias("__d")).agg(F.count_if(F.col("case_type").isin("storm", "near_storm")).alias("e"), F.count_if(F.col("case_type") == "control").alias("k"))
    rounds = many.where("k > 0").select("__d", F.greatest(F.lit(1), F.ceil(F.col("e") / F.col("k"))).cast("int").alias("__rounds"))
    controls = controls.withColumnRenamed("case_id", "control_id").join(rounds, F.col("domain").eqNullSafe(F.col("__d"))).withColumn("use", F.explode(F.sequence(F.lit(1), F.col("__rounds"))))
    controls = controls.withColumn("case_id", F.concat_ws("#", "control_id", "use")).drop("__d", "__rounds", "use")
    out = None
    steps = [(quality, keys, shift) for quality, keys in _ALL_TIERS for shift in ((-lon_step, lon_step) if "lon_near" in keys else (0.0,))]
    for quality, keys, shift in steps:
        keys = ("domain", *keys)
        e, k = events.withColumn("lon_near", F.col("lon_bin") + shift), controls.withColumn("lon_near", F.col("lon_bin"))
        for x in keys[1:]:
            e, k = e.where(F.col(x).isNotNull()), k.where(F.col(x).isNotNull())
        e = _ranked(e, keys, "r")
        k = _ranked(k, keys, "__r").select("control_id", F.col("case_id").alias("__copy"), F.col("lat0").alias("__lat"), F.col("lon0").alias("__lon"), *[F.col(x).alias(f"__{x}") for x in keys], "__r")
        on = F.col("r") == F.col("__r")
        for x in keys:
            on = on & F.col(x).eqNullSafe(F.col(f"__{x}"))
        hit = e.join(k, on).select("case_id", "control_id", F.lit(quality).alias("match_quality"), control_tier(F.lit(quality)).alias("control_tier"), F.col("__lat").alias("lat0"), F.col("__lon").alias("lon0"), "__copy")
        hit = written(hit, "matched")  # each tier rests on all before it
        out = hit if out is None else out.unionByName(hit)
        taken = hit.select(F.col("case_id").alias("__a"), F.col("__copy").alias("__b"))
        events = events.join(taken, F.col("case_id") == F.col("__a"), "left_anti")
        controls = controls.join(taken, F.col("case_id") == F.col("__b"), "left_anti")
        events, controls = written(events, "events"), written(controls, "controls")  # plans don't grow with the tiers
    out = out.drop("__copy")
    placed = events.where(F.col("lon0").isNotNull())
    o = offset_controls(placed).unionByName(offset_controls(events.where(F.col("lon0").isNull())).withColumn("lon0", F.lit(None).cast("double")))
    return out.unionByName(o.select("case_id", "control_id", F.lit("offset").alias("match_quality"), "control_tier", "lat0", "lon0"))


def control_tier(quality: Column) -> Column:
    """A, B or C by the prefix of a match quality, else unknown."""
    return F.when(quality.startswith("tier_a"), "A").when(quality.startswith("tier_b"), "B").when(quality.startswith("tier_c"), "C").otherwise("unknown")


def control_coverage(cases: DataFrame) -> DataFrame:
    """Per domain: events, controls, tiers present, and events per control."""
    event = F.col("case_type").isin("storm", "near_storm")
    g = cases.where(F.col("case_id").isNotNull()).groupBy("domain").agg(F.count_if(event).alias("n_events"), F.count_if(F.col("case_type") == "control").alias("n_controls"), F.count_distinct("control_tier").alias("n_tiers"))
    return g.withColumn("events_per_control", F.try_divide("n_events", "n_controls"))


def slice_status(samples: DataFrame) -> DataFrame:
    """Time slices of each case by completeness: a slice is whole with two hands for every size the case ever has.

    Counts distinct (size, hand) per slice, so re-sent rows don't make a slice overshoot; rows without key or with another
    hand don't count.
    """
    x = samples.where(F.col("case_id").isNotNull() & F.col("t").isNotNull() & F.col("L").isNotNull() & ~F.isnan("L") & F.col("hand").isin("L", "R"))
    want = x.groupBy(F.col("case_id").alias("__c")).agg((F.count_distinct("L") * 2).alias("expected"))
    have = x.groupBy("case_id", "t").agg(F.count_distinct("L", "hand").alias("n"))
    j = have.join(want, F.col("case_id") == F.col("__c"))
    return j.groupBy("case_id", F.when(F.col("n") == F.col("expected"), "whole").otherwise("partial").alias("status")).agg(F.count("*").alias("n_slices"))
