"""Field records against satellite scenes, and sensors against each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import lon_gap, neighbour_cells, sphere_cell
from tidemark.functions.joins import join_nulls

from tidemark.functions.nulls import ratio
from tidemark.functions.quantiles import exact_quantiles

# --- Fixed values: matchup criteria --------------------------------------------------------
MAX_DT_H, MIN_VALID, MAX_CV = 24.0, 0.5, 0.15
# --- Fixed values: cross-sensor reference rule ---------------------------------------------
CONTRAST = {"ratio_yes": 1.5, "value_yes": 2.0, "value_sure": 10.0, "ratio_no": 1.15, "value_no": 5.0, "min_region": 8, "min_background": 30}


def nearest_scenes(records: DataFrame, scenes: DataFrame, keys: Sequence[str], max_dt_h: float) -> DataFrame:
    """Scenes within the time tolerance of each record of the same area.

    ``records``: keys, record_id, t (seconds); ``scenes``: keys, scene_id, ts (seconds).
    Time is cut into buckets as wide as the tolerance; a record looks into three of them.
    """
    width = max_dt_h * 3600.0
    b = F.floor(F.col("t") / width)
    asked = records.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    keyed = scenes.withColumn("_b", F.floor(F.col("ts") / width))
    dt = (F.col("ts") - F.col("t")) / 3600.0
    return asked.join(keyed, [*keys, "_b"]).withColumn("dt_h", dt).where(F.abs("dt_h") <= max_dt_h).drop("_b")


def box_extract(records: DataFrame, raster: DataFrame, keys: Sequence[str], bands: Sequence[str], valid: Column, half: int = 1) -> DataFrame:
    """n x n box around each record's cell: valid share, and median / sd / n of every band over valid pixels.

    ``records``: record_id, keys, row, col; the box is 9 rows for the usual 3 x 3, so the
    per-record aggregate is bounded.
    """
    offsets = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in range(-half, half + 1) for j in range(-half, half + 1)])
    cells = records.select("record_id", *keys, F.col("row").alias("_r"), F.col("col").alias("_c"), F.explode(offsets).alias("_o"))
    cells = cells.select("record_id", *keys, (F.col("_r") + F.col("_o.dr")).alias("row"), (F.col("_c") + F.col("_o.dc")).alias("col"))
    px = raster.select(*keys, "row", "col", *bands, F.coalesce(valid, F.lit(False)).alias("_valid"))
    got = cells.join(px, [*keys, "row", "col"], "left")
    ok = F.coalesce("_valid", F.lit(False))
    aggs = [F.avg(ok.cast("double")).alias("valid_frac")]
    for b in bands:
        v = F.when(ok, F.col(b))
        aggs += [F.percentile(v, 0.5).alias(f"{b}_median"), F.stddev_pop(v).alias(f"{b}_std"), F.count(v).alias(f"{b}_n")]
    return got.groupBy("record_id", *keys).agg(*aggs)


def evaluate(df: DataFrame, band: str, pixel_m: float, max_dt_h: float = MAX_DT_H, min_valid: float = MIN_VALID, max_cv: float = MAX_CV,
             flags: Sequence[str] = ()) -> DataFrame:
    """Apply the criteria in order; ``reasons`` lists every failure, ``passed`` means none.

    Needs dt_h, valid_frac, distance_m, <band>_median / _std / _n and the boolean flag columns.
    """
    med, std, n = F.col(f"{band}_median"), F.col(f"{band}_std"), F.col(f"{band}_n")
    measurable = (n > 1) & med.isNotNull() & (med != 0)
    cv = F.when(F.coalesce(measurable, F.lit(False)), std / F.abs(med))
    dt, vf, dist = F.col("dt_h"), F.col("valid_frac"), F.col("distance_m")
    reasons = [
        F.when(dt.isNull(), "no scene time").when(F.abs(dt) > max_dt_h, F.format_string(f"|dt| %.1f h > {max_dt_h:g} h", F.abs(dt))),
        F.when(F.coalesce(vf, F.lit(0.0)) < min_valid, F.format_string(f"valid fraction %.2f < {min_valid:g}", F.coalesce(vf, F.lit(0.0)))),
        F.when(cv.isNull(), "primary band not measurable in box").when(cv > max_cv, F.format_string(f"box CV %.2f > {max_cv:g} (heterogeneous)", cv)),
        F.when(dist.isNull() | (dist > pixel_m), F.format_string(f"centre-pixel distance %s m > {pixel_m:g} m", dist.cast("string"))),
        *[F.when(F.coalesce(F.col(f), F.lit(False)), F.lit(f"flag {f}")) for f in flags],
    ]
    out = df.withColumn("cv_primary", cv).withColumn("reasons", F.array_compact(F.array(*reasons)))
    return out.withColumn("passed", F.size("reasons") == 0)


def build_matchups(records: DataFrame, evaluated: DataFrame, max_dt_h: float, keep: Sequence[str]) -> DataFrame:
    """One row per record: the closest passing scene, else the closest failure, else 'no scene'."""
    packed = F.struct("scene_id", "dt_h", "passed", "reasons", *keep)
    best = evaluated.groupBy("record_id").agg(F.min_by(packed, F.struct(~F.col("passed"), F.abs("dt_h"), F.col("scene_id"))).alias("_m"))
    out = records.join(best, "record_id", "left")
    none = F.array(F.lit(f"no scene within {max_dt_h:g} h"))
    return out.select(*records.columns, F.col("_m.scene_id").alias("scene_id"), F.col("_m.dt_h").alias("dt_h"), F.coalesce("_m.passed", F.lit(False)).alias("passed"),
                      F.coalesce("_m.reasons", none).alias("reasons"), *[F.col(f"_m.{c}").alias(c) for c in keep])


def summary(matchups: DataFrame, keys: Sequence[str] = (), station: str = "station") -> DataFrame:
    """Counts, pass rate, stations and the median |dt| of the passing matchups."""
    keys = list(keys)
    g = matchups.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records"), F.count_if("passed").alias("n_passed"),
                                    F.countDistinct(F.when(F.col("passed"), F.col(station))).alias("n_stations"))
    g = g.withColumn("pass_rate", F.round(ratio(F.col("n_passed").cast("double"), F.col("n_records").cast("double")), 4))
    med = exact_quantiles(matchups.where("passed").withColumn("_a", F.abs("dt_h")), keys, "_a", {"median_abs_dt_h": 0.5}).drop("n")
    if keys:
        return join_nulls(g, med, keys, "left")
    return g.withColumn("_k", F.lit(1)).join(med.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")


def failure_reasons(matchups: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Reasons tallied by their first word; flags keep their name."""
    r = matchups.select(*keys, F.explode("reasons").alias("_r"))
    word = F.when(F.col("_r").startswith("flag"), F.col("_r")).otherwise(F.substring_index("_r", " ", 1))
    return r.groupBy(*keys, word.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def footprint_match(fine: DataFrame, coarse: DataFrame, keys: Sequence[str], values: Sequence[str], half_m: float = 150.0,
                    min_count: int = 25) -> DataFrame:
    """Average the fine pixels inside each coarse footprint (lon / lat boxes), anywhere on the globe.

    Both sides are keyed by cubes of the sphere wider than a footprint's half diagonal; a
    coarse pixel reads 27 of them, a fine pixel only its own.  Pixels of one place are summed before they meet a
    footprint and footprints of one place are met once, so repeated passes over the same places cost no more pairs.
    """
    dlat, size = half_m / 111320.0, 3 * half_m
    at = sphere_cell(F.col("lon"), F.col("lat"), size)
    px = fine.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("_n"), *[f(v).alias(f"_{k}{i}") for i, v in enumerate(values) for k, f in (("s", F.sum), ("m", F.count))])
    px = px.withColumn("_c", F.struct(at[0].alias("x"), at[1].alias("y"), at[2].alias("z")))
    sums = ["_n", *[f"_{k}{i}" for i in range(len(values)) for k in "sm"]]
    places = coarse.select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).distinct()
    asked = places.withColumn("_c", F.explode(neighbour_cells(sphere_cell(F.col("_lon"), F.col("_lat"), size))))
    near = asked.join(px.hint("merge"), "_c").where((lon_gap(F.col("lon"), F.col("_lon")) <= half_m / (111320.0 * F.cos(F.radians("_lat")))) & (F.abs(F.col("lat") - F.col("_lat")) <= dlat))
    met = near.groupBy("_lon", "_lat").agg(*[F.sum(c).alias(c) for c in sums])
    named = coarse.select(*keys, F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).join(met.hint("merge"), ["_lon", "_lat"])
    out = named.groupBy(*keys).agg(F.sum("_n").alias("n_px"), *[F.try_divide(F.sum(f"_s{i}"), F.sum(f"_m{i}")).alias(v) for i, v in enumerate(values)])
    return out.where(F.col("n_px") >= min_count)


def contrast_label(px: DataFrame, keys: Sequence[str], value: str, region: Column, near: Column | None = None) -> DataFrame:
    """Region against background medians and the label they imply (1, 0 or NULL).

    Pixels near the region but outside it count on neither side.
    """
    side = F.when(region, "region").when(~(near if near is not None else region), "background")
    q = exact_quantiles(px.withColumn("_side", side).where(F.col("_side").isNotNull()), [*keys, "_side"], value, {"_m": 0.5})
    pick = lambda s, c: F.max(F.when(F.col("_side") == s, F.col(c)))                                          # noqa: E731
    out = q.groupBy(*keys).agg(F.coalesce(pick("region", "n"), F.lit(0)).alias("n_region"), F.coalesce(pick("background", "n"), F.lit(0)).alias("n_background"),
                               pick("region", "_m").alias("region_median"), pick("background", "_m").alias("background_median"))
    k = CONTRAST
    enough = (F.col("n_region") >= k["min_region"]) & (F.col("n_background") >= k["min_background"])
    r = F.when(F.col("background_median") > 0, F.col("region_median") / F.col("background_median")).otherwise(F.lit(float("inf")))
    out = out.withColumns({"ratio": F.when(enough, r), "reason": F.when(~enough, "too few valid pixels")})
    reg = F.col("region_median")
    yes = ((F.col("ratio") >= k["ratio_yes"]) & (reg >= k["value_yes"])) | (reg >= k["value_sure"])
    no = (F.col("ratio") <= k["ratio_no"]) & (reg < k["value_no"])
    out = out.withColumn("y", F.when(enough, F.when(yes, 1).when(no, 0)))
    return out.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("y").isNull(), "ambiguous contrast"))


def best_granule(px: DataFrame, keys: Sequence[str], granule: str, region: Column) -> DataFrame:
    """The granule with most pixels in the region (first in order on ties)."""
    n = px.groupBy(*keys, granule).agg(F.count_if(region).alias("n_region"))
    return n.groupBy(*keys).agg(F.min_by(granule, F.struct(-F.col("n_region"), F.col(granule))).alias(granule))


def seed_labels(candidates: DataFrame, contrast: DataFrame, on: Sequence[str], area: str, day: Column, hypothesis: Column, label: Column) -> DataFrame:
    """Candidates with a cross-sensor verdict as training labels; the reason stays for the others."""
    j = candidates.join(contrast, list(on), "left")
    text = F.concat_ws("|", F.col(area), day.cast("string"), hypothesis, label.cast("string"))
    return j.withColumns({
        "label_id": F.concat(F.lit("LB-S3-"), F.substring(F.sha2(text, 256), 1, 10)), "group_key": F.concat_ws("|", F.col(area), F.substring(day.cast("string"), 1, 7)),
        "class": F.when(F.col("y") == 1, hypothesis).when(F.col("y") == 0, "NOT_CONFIRMED"), "weight": F.lit(0.5), "source": F.lit("cross_sensor_reference"),
        "reason": F.coalesce("reason", F.when(F.col("n_region").isNull(), "no granule"))})


def band_agreement(sim: DataFrame, obs: DataFrame, keys: Sequence[str], cell: Sequence[str], value: str, min_px: int = 4, min_n: int = 10) -> DataFrame:
    """Two regridded sensors on common cells: n, bias, rmse, relative rmse, r2 to the 1:1 line, correlation, slope."""
    def grid(df, name):
        return df.groupBy(*keys, *cell).agg(F.avg(value).alias(name), F.count(value).alias(f"_{name}")).where(F.col(f"_{name}") >= min_px)
    j = grid(sim, "x").join(grid(obs, "y"), [*keys, *cell])
    d = F.col("x") - F.col("y")
    g = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"),
                             F.avg(F.abs("y")).alias("_ay"), F.sum(d * d).alias("_res"), (F.var_pop("y") * F.count(F.lit(1))).alias("_tot"),
                             F.corr("x", "y").alias("pearson_r"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    return g.where(F.col("n") >= min_n).select(*keys, "n", "bias", "rmse", "mae", F.when(F.col("_ay") > 0, 100.0 * F.col("rmse") / F.col("_ay")).alias("relative_rmse_pct"),
                                              F.when(F.col("_tot") > 0, 1 - F.col("_res") / F.col("_tot")).alias("r2_1to1"), "pearson_r", "slope", "intercept")
