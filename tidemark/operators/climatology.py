"""Seasonal climatology, robust anomalies, baselines and series statistics.

Histories enter with one value per site and day (a map-side combine of whatever the day
holds), so a site's history is bounded by the calendar and may safely stand in one task.  Zones
and other groups without such a bound go through ``exact_quantiles``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import in_tasks, map_blocks
from tidemark.functions.joins import join_nulls, join_small
from tidemark.functions.nulls import clip, ratio
from tidemark.functions.quantiles import exact_quantiles, sorted_median
from tidemark.functions.seasonal import season_stats

# --- Fixed values: detection rule ------------------------------------------------------
FLOORS = {"NDCI": 0.02, "MCI": 0.002, "FAI": 0.002, "TUR_NECHAD2016": 1.0, "HUE_ANGLE": 5.0, "CDOM_RATIO": 0.1}
HYPOTHESES = {"BLOOM_LIKE": ["NDCI", "MCI"], "SEDIMENT_LIKE": ["TUR_NECHAD2016"], "SURFACE_FILM_LIKE": ["FAI"]}
Z_MIN, PCT_MIN, SECOND_Z, MIN_AREA_KM2, MIN_CLIM, MIN_WATER_PX = 3.0, 95.0, 1.0, 0.5, 6, 200
WINDOW_DAYS = 45
MAD_SCALE = 1.4826
STATE_LIMITS = (("HIGH_PRIORITY", 98.0), ("INVESTIGATE", 95.0), ("WATCH", 90.0))
BASELINE_PCTS = (1, 5, 10, 25, 50, 75, 90, 95, 98, 99)
ZONE_PCTS = (5, 25, 50, 75, 95, 99)


def doy_distance(a: Column, b: Column) -> Column:
    """Day-of-year distance wrapping at 365 (leap years too, as the rule is defined)."""
    gap = F.abs(a - b)
    return F.least(gap, 365 - gap)


def season_join(targets: DataFrame, history: DataFrame, keys: Sequence[str], values: Sequence[str] = (), date: str = "d",
                window_days: int = WINDOW_DAYS) -> DataFrame:
    """``targets`` with every same-season day of another year of the same site: ``clim_d`` and ``clim_<value>``.

    The day-of-year axis is cut into buckets as wide as the window; a target reads its own
    and the two neighbouring buckets, so the interval join is an equi-join plus a filter.
    """
    n_buckets = max(1, 365 // (window_days + 1))
    width = 366 / n_buckets
    doy = F.dayofyear(date)
    bucket = F.least(F.floor((doy - 1) / width), F.lit(n_buckets - 1)).cast("int")
    clim = history.select(*keys, F.col(date).alias("clim_d"), doy.alias("_cdoy"), bucket.alias("_b"), *[F.col(v).alias(f"clim_{v}") for v in values])
    near = F.array_distinct(F.array(*[F.pmod(bucket + i, F.lit(n_buckets)) for i in (-1, 0, 1)]))
    asked = targets.withColumns({"_doy": doy, "_b": F.explode(near)})
    pairs = asked.join(clim, [*keys, "_b"])
    return pairs.where((doy_distance(F.col("_doy"), F.col("_cdoy")) <= window_days) & (F.year(date) != F.year("clim_d"))).drop("_b", "_doy", "_cdoy")


def climatology_pairs(dates: DataFrame, keys: Sequence[str], date: str = "d", window_days: int = WINDOW_DAYS) -> DataFrame:
    """(target, same-season date of another year) pairs per site."""
    return season_join(dates.select(*keys, date), dates, keys, (), date, window_days).select(*keys, date, "clim_d")


def _season_columns(table: pa.Table, new: np.ndarray, floors: Mapping[str, float], window_days: int, min_n: int) -> pa.Table:
    site = np.cumsum(new) - 1
    doy, year = (table.column(c).to_numpy().astype(np.int64) for c in ("_doy", "_yr"))
    undated = year < 0
    for f, floor in floors.items():
        x = np.where(undated, np.nan, table.column(f).to_numpy().astype(np.float64))
        n, median, mad, below = season_stats(site, doy, year, x, window_days)
        n, median, mad = np.where(undated, 0, n), np.where(undated, np.nan, median), np.where(undated, np.nan, mad)
        scale = MAD_SCALE * mad + floor
        judged = (n >= min_n) & np.isfinite(x)
        with np.errstate(invalid="ignore", divide="ignore"):
            z, pct = (x - median) / scale, 100.0 * below / np.maximum(n, 1)
        table = (table.append_column(f"{f}_n", pa.array(n, pa.int32())).append_column(f"{f}_med", pa.array(median, mask=n == 0))
                 .append_column(f"{f}_scale", pa.array(scale, mask=n == 0)).append_column(f"{f}_z", pa.array(z, mask=~judged | (n == 0))).append_column(f"{f}_pct", pa.array(pct, mask=~judged)))
    return table.drop_columns(["_doy", "_yr"])


def robust_anomaly(daily: DataFrame, keys: Sequence[str], floors: Mapping[str, float], date: str = "d",
                   window_days: int = WINDOW_DAYS, min_n: int = MIN_CLIM, tasks: int | None = None) -> DataFrame:
    """Robust z, seasonal percentile, count, median and scale of every site-day and feature.

    One shuffle by site; sites follow each other in sorted partitions, and blocks of whole sites get
    their order statistics in numpy, n log n in the days of a site (``functions/seasonal.py``).  No array of a
    history is built.  NULL and non-finite values and rows without a date take part in no season; NULL keys are a
    site like any other.
    """
    keys, feats = list(keys), list(floors)
    day = {"_doy": F.coalesce(F.dayofyear(date), F.lit(1)), "_yr": F.coalesce(F.year(date), F.lit(-1))}
    src = daily.select(*keys, date, *[F.col(f).cast("double").alias(f) for f in feats]).withColumns(day)
    kinds = {c: src.schema[c].dataType.simpleString() for c in [*keys, date, *feats]}
    out = {f"{f}_{c}": t for f in feats for c, t in (("n", "int"), ("med", "double"), ("scale", "double"), ("z", "double"), ("pct", "double"))}
    return map_blocks(src, keys, lambda t, new: _season_columns(t, new, floors, window_days, min_n), ", ".join(f"`{c}` {t}" for c, t in (kinds | out).items()), tasks=tasks)


def order_stat_baseline(daily: DataFrame, keys: Sequence[str], value: str, share: float = 0.95) -> DataFrame:
    """Count, median, MAD, the ceil(share n)-th smallest value and the maximum of a site's history."""
    site = daily.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_s"))   # skips NULL
    n = F.size("_s")
    k = F.ceil(F.lit(share) * n - 1e-9).cast("int")
    out = site.withColumn("n", n).withColumn("median", sorted_median(F.col("_s")))
    mad = sorted_median(F.array_sort(F.transform("_s", lambda x: F.abs(x - F.col("median")))))
    return (out.withColumn("mad", mad).withColumn("q95", F.when(k >= 1, F.get("_s", k - 1)))
            .withColumn("max", F.array_max("_s")).drop("_s"))


def hits(anomalies: DataFrame, primary: str, secondary: Sequence[str] = (), z_min: float = Z_MIN,
         pct_min: float = PCT_MIN, second_z: float = SECOND_Z) -> DataFrame:
    """Pixels whose primary feature is anomalous and whose secondary features agree."""
    cond = (F.col(f"{primary}_z") >= z_min) & (F.col(f"{primary}_pct") >= pct_min)
    for f in secondary:
        cond = cond & (F.col(f"{f}_z") >= second_z)
    return anomalies.where(cond)


def hypothesis_hits(anomalies: DataFrame, hypotheses: Mapping[str, Sequence[str]] | None = None, water: Column | None = None, z_min: float = Z_MIN,
                    pct_min: float = PCT_MIN, second_z: float = SECOND_Z) -> DataFrame:
    """Hit pixels of every hypothesis at once: one row per pixel and hypothesis it meets.

    The first feature of a hypothesis must be anomalous, the others must agree; a hypothesis
    whose first feature is absent is left out, an absent other feature is not asked.
    ``primary_z`` is the z of the first feature.  Only ``water`` pixels count.
    """
    have = set(anomalies.columns)
    tests = []
    for name, (primary, *others) in (HYPOTHESES if hypotheses is None else hypotheses).items():
        if f"{primary}_z" in have:
            cond = (F.col(f"{primary}_z") >= z_min) & (F.col(f"{primary}_pct") >= pct_min)
            for f in others:
                if f"{f}_z" in have:
                    cond = cond & (F.col(f"{f}_z") >= second_z)
            tests.append(F.when(cond, F.struct(F.lit(name).alias("hypothesis"), F.col(f"{primary}_z").alias("primary_z"))))
    px = anomalies if water is None else anomalies.where(water)
    met = px.withColumn("_h", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())))
    return met.select(*anomalies.columns, "_h.hypothesis", "_h.primary_z")


def primary_z(hypotheses: Mapping[str, Sequence[str]]) -> Column:
    """z of the first feature of a row's ``hypothesis``."""
    return F.coalesce(*[F.when(F.col("hypothesis") == name, F.col(f"{parts[0]}_z")) for name, parts in hypotheses.items()])


def large_enough(regions: DataFrame, min_area_km2: float = MIN_AREA_KM2) -> DataFrame:
    return regions.where(F.col("area_km2") >= min_area_km2)


def eligible_scenes(anomalies: DataFrame, keys: Sequence[str], pairs: DataFrame, min_dates: int = MIN_CLIM,
                    min_water_px: int = MIN_WATER_PX) -> DataFrame:
    """Scenes with enough water pixels and enough climatology acquisitions."""
    water = anomalies.groupBy(*keys).agg(F.count(F.lit(1)).alias("water_px")).where(F.col("water_px") >= min_water_px)
    clim = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_climatology")).where(F.col("n_climatology") >= min_dates)
    return water.join(clim, list(keys))


def persistence(region_px: DataFrame, daily: DataFrame, keys: Sequence[str], site: Sequence[str], primary: str, date: str = "d",
                window_days: int = WINDOW_DAYS, z_min: float = Z_MIN) -> DataFrame:
    """Share of past same-season dates on which half of the region already passed half the threshold.

    ``region_px`` carries the site columns, the date, ``<primary>_med`` and ``<primary>_scale``.  Only the sites of region
    pixels are read from ``daily``, and only the season of each: no other pixel's history is built.
    """
    limit = F.col(f"{primary}_med") + 0.5 * z_min * F.col(f"{primary}_scale")
    asked = region_px.select(*keys, *site, date, limit.alias("_limit"))
    size = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    past = season_join(asked, daily.select(*site, date, primary).where(F.col(primary).isNotNull() & ~F.isnan(F.col(primary).cast("double"))), site, [primary], date, window_days)
    per_date = past.groupBy(*keys, "clim_d").agg(F.count(F.lit(1)).alias("_valid"), F.count_if(F.col(f"clim_{primary}") >= F.col("_limit")).alias("_exceed"))
    usable = join_nulls(per_date, size, keys).where(F.col("_valid") >= 0.5 * F.col("_size"))
    share = usable.groupBy(*keys).agg(F.avg((F.col("_exceed") >= 0.5 * F.col("_valid")).cast("double")).alias("persistence_frac"))
    return join_nulls(size.drop("_size"), share, keys, "left")


def region_medians(region_px: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Median of several columns per region; regions may be of any size."""
    long = region_px.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(list(keys), list(values), "_f", "_v")
    med = exact_quantiles(long, [*keys, "_f"], "_v", {"_m": 0.5})
    return med.groupBy(*keys).pivot("_f", list(values)).agg(F.first("_m"))


def zone_statistics(px: DataFrame, keys: Sequence[str], features: Sequence[str], min_n: int = 30,
                    pcts: Sequence[int] = ZONE_PCTS) -> DataFrame:
    """Percentiles, mean and count of every feature per zone (zones of any size); NULL below ``min_n``."""
    long = px.select(*keys, *features).unpivot(list(keys), list(features), "feature", "value")
    q = exact_quantiles(long, [*keys, "feature"], "value", {f"p{p}": p / 100 for p in pcts})
    mean = long.groupBy(*keys, "feature").agg(F.avg("value").alias("mean"))
    out = join_nulls(q, mean, [*keys, "feature"])
    enough = F.col("n") >= min_n
    return out.select(*keys, "feature", "n", *[F.when(enough, F.col(c)).alias(c) for c in [f"p{p}" for p in pcts] + ["mean"]])


def zone_quality(px: DataFrame, keys: Sequence[str], water: Column, valid: Column, cloudy: Column) -> DataFrame:
    """Pixels, water pixels, valid share and cloudy share of the valid pixels per zone: one combined aggregate."""
    ok = F.coalesce(valid, F.lit(False))
    g = px.groupBy(*keys).agg(F.count(F.lit(1)).alias("zone_px"), F.count_if(F.coalesce(water, F.lit(False))).alias("n_water"), F.count_if(ok).alias("_v"), F.count_if(ok & F.coalesce(cloudy, F.lit(False))).alias("_c"))
    return g.select(*keys, "zone_px", "n_water", (F.col("_v") / F.col("zone_px")).alias("valid_fraction"), (F.col("_c") / F.greatest("_v", F.lit(1))).alias("cloud_fraction_of_valid"))


def series_extract(stats: DataFrame, stat: str, n_water: str = "n_water", min_water_px: int = MIN_WATER_PX) -> DataFrame:
    return stats.where((F.col(n_water) >= min_water_px) & F.col(stat).isNotNull())


def baseline_stats(daily: DataFrame, keys: Sequence[str], value: str, date: str = "d",
                   pcts: Sequence[int] = BASELINE_PCTS) -> DataFrame:
    """Summary of a site's whole record (a calendar-bounded history)."""
    q = F.percentile(value, F.array(*[F.lit(p / 100) for p in pcts]))
    out = daily.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("first_d"), F.max(date).alias("last_d"),
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), q.alias("_q"))
    return out.select(*keys, "n", "first_d", "last_d", "mean", "std",
                      *[F.get("_q", i).alias(f"p{p}") for i, p in enumerate(pcts)])


def seasonal_baseline(daily: DataFrame, keys: Sequence[str], value: str, date: str = "d",
                      window_days: int = WINDOW_DAYS, min_n: int = 3) -> DataFrame:
    """Twelve month-centred views: each day contributes to the months whose centre is near."""
    centres = F.array(*[F.struct(F.lit(f"{m:02d}").alias("month"), F.lit(int((m - 0.5) * 30.44)).alias("centre")) for m in range(1, 13)])
    doy = F.dayofyear(date)
    near = F.filter(centres, lambda c: doy_distance(doy, c["centre"]) <= window_days)
    views = daily.where(F.col(value).isNotNull()).select(*keys, value, F.explode(near).alias("_c"))
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    out = views.groupBy(*keys, F.col("_c.month").alias("month")).agg(F.count(F.lit(1)).alias("n"), q.alias("_q")).where(F.col("n") >= min_n)
    return out.select(*keys, "month", "n", F.get("_q", 0).alias("median"), F.get("_q", 1).alias("p90"), F.get("_q", 2).alias("p95"))


def percentile_of(history: DataFrame, keys: Sequence[str], value: str, target: Column) -> DataFrame:
    """Strict percentile of a target value in a history; NULL when the history is empty."""
    return history.groupBy(*keys).agg((100.0 * ratio(F.count_if(F.col(value) < target).cast("double"),
                                                     F.count(value).cast("double"))).alias("pct"))


def seasonal_percentile(daily: DataFrame, targets: DataFrame, keys: Sequence[str], value: str, date: str = "d",
                        window_days: int = WINDOW_DAYS) -> DataFrame:
    """Same-season and all-time percentile of each target (own year included).

    ``targets``: keys, ``target_d``, ``target_value``.
    """
    hist = daily.where(F.col(value).isNotNull()).select(*keys, F.col(date).alias("_d"), F.col(value).alias("_v"))
    joined = targets.join(hist, list(keys), "left")
    season = doy_distance(F.dayofyear("_d"), F.dayofyear("target_d")) <= window_days
    below = F.col("_v") < F.col("target_value")
    g = joined.groupBy(*keys, "target_d", "target_value").agg(
        F.count("_v").alias("n_all_time"), F.count_if(season).alias("n_seasonal"),
        F.count_if(below).alias("_below"), F.count_if(season & below).alias("_sbelow"),
        F.percentile(F.when(season, F.col("_v")), 0.5).alias("_smed"))
    enough = F.col("n_seasonal") >= 3
    return g.select(*keys, "target_d", "target_value", "n_all_time", "n_seasonal",
                    F.when(enough, 100.0 * F.col("_sbelow") / F.col("n_seasonal")).alias("seasonal_percentile"),
                    (100.0 * ratio(F.col("_below").cast("double"), F.col("n_all_time").cast("double"))).alias("all_time_percentile"),
                    F.when(enough, F.col("_smed")).alias("seasonal_median"))


def trend(daily: DataFrame, keys: Sequence[str], value: str, date: str = "d", min_n: int = 4) -> DataFrame:
    """Least-squares slope per year, intercept at the first day, r squared, span; one pass plus a small join."""
    v = daily.where(F.col(value).isNotNull())
    t = F.datediff(date, F.lit("1970-01-01")) / 365.25
    out = v.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(F.col(value), t).alias("_s"), F.avg(value).alias("_my"), F.avg(t).alias("_mt"),
        F.regr_r2(F.col(value), t).alias("_r2"), F.var_pop(value).alias("_vy"), (F.max(t) - F.min(t)).alias("_span"), F.min(t).alias("_t0"))
    ok = F.col("n") >= min_n
    return out.select(*keys, "n", F.when(ok, F.col("_s")).alias("slope_per_year"),
                      F.when(ok, F.col("_my") - F.col("_s") * (F.col("_mt") - F.col("_t0"))).alias("intercept"),
                      F.when(ok & (F.col("_vy") > 0), F.col("_r2")).alias("r_squared"), F.when(ok, F.col("_span")).alias("span_years"))


def state_of(pct: Column, limits: Sequence[tuple[str, float]] = STATE_LIMITS) -> Column:
    out = F.when(pct.isNull(), "UNKNOWN")
    for name, lo in limits:
        out = out.when(pct >= lo, name)
    return out.otherwise("NORMAL")


def nearest_to(daily: DataFrame, keys: Sequence[str], target: Column, value: str, date: str = "d", max_days: int = 10) -> DataFrame:
    """The observation nearest to a target day within ``max_days`` (earliest on ties)."""
    gap = F.abs(F.datediff(F.col(date), target))
    return (daily.where(F.col(value).isNotNull() & (gap <= max_days)).groupBy(*keys)
            .agg(F.min_by(F.struct(F.col(date).alias("d"), F.col(value).alias("v"), gap.alias("gap")), F.struct(gap, F.col(date))).alias("_n"))
            .select(*keys, F.col("_n.d").alias("target_d"), F.col("_n.v").alias("target_value"), F.col("_n.gap").alias("days_from_target")))


def sensor_zscores(obs: DataFrame, keys: Sequence[str], indices: Sequence[str], limit: float = 1.5) -> DataFrame:
    """z of several indices against the sensor's own mean and population sd, worst index, flag.

    The sensor statistics are a combined aggregate joined back, so a sensor that holds most
    of the table is never gathered.
    """
    aggs = []
    for c in indices:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}")]
    stats = obs.groupBy(*keys).agg(*aggs)
    out = join_small(obs, stats, keys)
    for c in indices:
        out = out.withColumn(f"{c}_z", F.when(F.col(f"_s_{c}") > 1e-9, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")))
    out = out.withColumn("max_abs_z", F.array_max(F.array(*[F.abs(f"{c}_z") for c in indices])))
    worst = F.coalesce(*[F.when(F.abs(f"{c}_z") == F.col("max_abs_z"), F.lit(c)) for c in indices])
    flagged = F.coalesce(F.col("max_abs_z") > limit, F.lit(False))
    out = out.withColumn("flagged", flagged).withColumn("flagged_index", F.when(flagged, worst))
    return out.drop(*[f"_{k}_{c}" for c in indices for k in "ms"])


def chance_level(flags: DataFrame, keys: Sequence[str], p_one: float, n_indices: int) -> DataFrame:
    """Observed flags next to what pure noise would give if indices were equal or independent."""
    return flags.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("n_flagged")).withColumns({
        "expected_correlated": F.col("n") * p_one, "expected_independent": F.col("n") * (1 - (1 - p_one) ** n_indices)})


def asof_bracket(series: DataFrame, targets: DataFrame, keys: Sequence[str], order: str, payload: Sequence[str],
                 chunk: Column, tasks: int | None = None) -> DataFrame:
    """Nearest observation at or before and nearest after each target, per key.

    Observations and targets (``target`` carries their position) are merged and read in
    order inside time chunks; what lies beyond a chunk comes from a table of one row per
    key and chunk.  Linear in both sides, and a key of any size is split over its chunks.
    ``chunk`` is an expression of ``order`` that never decreases with it; ``tasks`` as of ``tasks_for``.
    """
    keys = list(keys)
    pack = F.struct(F.col(order), *[F.col(c) for c in payload])
    obs = series.select(*keys, F.col(order), pack.alias("_p"))
    both = obs.withColumn("_t", F.lit(False)).unionByName(
        targets.select(*keys, F.col("target").alias(order)).withColumn("_t", F.lit(True)), allowMissingColumns=True)
    both = in_tasks(both.withColumn("_c", chunk), tasks, [*keys, "_c"])
    w = Window.partitionBy(*keys, "_c").orderBy(F.col(order), F.col("_t").cast("int"))
    back = F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    inside = both.withColumn("_before", back).withColumn("_after", ahead).where("_t")
    ends = both.groupBy(*keys, "_c").agg(F.max("_p").alias("_last"), F.min("_p").alias("_first"))
    across = Window.partitionBy(*keys).orderBy("_c")
    ends = ends.select(*keys, "_c",
                       F.last("_last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_back"),
                       F.first("_first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_carry_ahead"))
    return (join_nulls(inside, ends, [*keys, "_c"])
            .select(*keys, F.col(order).alias("target"), F.coalesce("_before", "_carry_back").alias("before"),
                    F.coalesce("_after", "_carry_ahead").alias("after")))


def successive_change(lagged: DataFrame, keys: Sequence[str], value: str, previous: str, gap_days: Column, max_gap: float) -> DataFrame:
    """Quantiles of the absolute change between consecutive observations close in time."""
    change = lagged.where(F.col(previous).isNotNull() & (gap_days <= max_gap)).withColumn("_c", F.abs(F.col(value) - F.col(previous)))
    return exact_quantiles(change, keys, "_c", {"p50": 0.5, "p90": 0.9, "p95": 0.95}).withColumnRenamed("n", "n_pairs")


def persistent_mask(stack: DataFrame, keys: Sequence[str], date: str, brightness: str | None = None, mndwi: str | None = None,
                    darkness_max: float = 0.10, mndwi_min: float = 0.0) -> DataFrame:
    """Pixels that qualify on every date; at least two dates are needed (missing values fail)."""
    src = brightness or mndwi
    g = stack.groupBy(*keys).agg(F.countDistinct(date).alias("n_dates"), F.max(src).alias("_max"), F.min(src).alias("_min"),
                                 F.count_if(F.col(src).isNull()).alias("_missing"))
    ok = (F.col("_max") < darkness_max) if brightness else (F.col("_min") > mndwi_min)
    joint = F.col("_max") if brightness else F.col("_min")
    return g.where((F.col("n_dates") >= 2) & (F.col("_missing") == 0) & ok).select(*keys, joint.alias("joint"), "n_dates")


def threshold_sweep(stack: DataFrame, keys: Sequence[str], date: str, brightness: str, thresholds: Sequence[float]) -> DataFrame:
    """How many pixels stay dark on every date, per threshold (one pass)."""
    g = stack.groupBy(*keys).agg(F.countDistinct(date).alias("n_dates"), F.max(brightness).alias("_max")).where(F.col("n_dates") >= 2)
    return (g.select("_max", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
            .groupBy("threshold").agg(F.count_if(F.col("_max") < F.col("threshold")).alias("n_px")))


def good_bands(spectra: DataFrame, bad: Column, band: str = "ix") -> DataFrame:
    """Bands without a bad value anywhere, renumbered 0.. in band order (one row per band)."""
    usable = spectra.groupBy(band).agg(F.max(bad.cast("int")).alias("_bad")).where(F.col("_bad") == 0)
    return usable.select(band, (F.row_number().over(Window.orderBy(band)) - 1).alias("pos"))


def band_groups(spectra: DataFrame, keys: Sequence[str], good: DataFrame, n_good: int, n_groups: int, value: str, band: str = "ix") -> DataFrame:
    """Means of contiguous band groups with integer edges floor(i n / g)."""
    edges = [i * n_good // n_groups for i in range(n_groups + 1)]
    group = F.lit(0)
    for e in edges[1:-1]:
        group = group + (F.col("pos") >= e).cast("int")
    # The band table has one row per band of the instrument.
    return (spectra.join(F.broadcast(good), band).withColumn("_g", group).groupBy(*keys)
            .agg(*[F.avg(F.when(F.col("_g") == g, F.col(value))).alias(f"g{g}") for g in range(n_groups)],
                 F.avg(value).alias("brightness")))


def climatology_thin(dates: DataFrame, keys: Sequence[str], fraction: str, date: str, min_fraction: float = 0.25, keep: int = 36) -> DataFrame:
    """At most ``keep`` same-season dates with enough water, in a stable hash order.

    The report says how many qualified; rank filters of this form run as a partial top-k
    before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.sha2(F.col(date).cast("string"), 256), date)
    return dates.where(F.col(fraction) > min_fraction).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def candidate_pick(candidates: DataFrame, keys: Sequence[str], area: str, z: str, label: str) -> DataFrame:
    score = F.col(area) * F.coalesce(F.col(z), F.lit(0.0))
    return candidates.groupBy(*keys).agg(F.max_by(label, F.struct(score, -F.col(label))).alias(label), F.max(score).alias("score"))


def detection_context(event: DataFrame, background: DataFrame, keys: Sequence[str], value: str, depth: Column) -> DataFrame:
    """Percentile of the event mean among water, event / background ratio, bottom-influence risk."""
    e = event.groupBy(*keys).agg(F.avg(value).alias("event_mean"), F.avg(depth).alias("_depth"))
    j = join_small(background, e, keys)
    out = j.groupBy(*keys, "event_mean", "_depth").agg(F.avg(value).alias("background_mean"),
                                                       (100.0 * F.count_if(F.col(value) < F.col("event_mean")) / F.count(value)).alias("anomaly_percentile"))
    return out.withColumns({"magnitude_ratio": ratio(F.col("event_mean"), F.col("background_mean")),
                            "bottom_risk": clip(1 - F.col("_depth") / 600.0, 0.0, 1.0)}).drop("_depth")
