"""Queries of the climatology, anomaly and series operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions.blocks import tasks_for
from tidemark.functions.joins import join_small
from tidemark.functions.ordering import previous_row
from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators import climatology as cl
from tidemark.operators import grid
from tidemark.operators import spectra as sp
from tidemark.operators.learn import TRIAGE_FEATURES
from tidemark.operators.pixels import feature_columns, scl_usable
from tidemark.plans.base import query, r6
from tidemark.session import cut_lineage
from tidemark.plans.grid import GRID_COLS, SHAPE, n_rows, sql_components, sql_diamond, sql_dilate, sql_erode
from tidemark.sources.tables import (BAND_COLUMNS, SQL_BANDS, SQL_OBS, SQL_SCENES, SQL_SITES, SQL_SPECTRA, SQL_STACK, bands,
                                     line_tasks, observations, scenes, sites, spectra, stack, table)


def rnd(c, digits=6):
    return F.round(c, digits)


def sql_season(a, b, days=45):
    return (f"least(abs(dayofyear({a}) - dayofyear({b})), 365 - abs(dayofyear({a}) - dayofyear({b}))) <= {days} "
            f"AND year({a}) <> year({b})")


def sql_anomaly(src, keys, feats, days=45, min_n=6, date="d"):
    """CTEs pr, md, ma, an: anomaly columns n, med, scale, z, pct for each feature, straight from pairs."""
    k = ", ".join(keys)
    on = " AND ".join(f"c.{x} = t.{x}" for x in keys)
    tk = ", ".join(f"t.{x}" for x in keys)
    pr = f"pr AS MATERIALIZED (SELECT {tk}, t.{date}, c.{date} AS cd, " + ", ".join(f"t.{f} AS x_{f}, c.{f} AS v_{f}" for f in feats) + (
        f" FROM {src} t JOIN {src} c ON {on} AND {sql_season(f't.{date}', f'c.{date}', days)})")
    md = f"md AS MATERIALIZED (SELECT {k}, {date}, " + ", ".join(
        f"count(v_{f}) AS n_{f}, median(v_{f}) AS med_{f}, count(CASE WHEN v_{f} < x_{f} THEN 1 END) AS b_{f}" for f in feats) + f" FROM pr GROUP BY {k}, {date})"
    ma = f"ma AS MATERIALIZED (SELECT {k}, {date}, " + ", ".join(f"median(abs(v_{f} - med_{f})) AS mad_{f}" for f in feats) + (
        f" FROM pr JOIN md USING ({k}, {date}) GROUP BY {k}, {date})")
    cols = []
    for f, floor in feats.items():
        sc = f"(1.4826 * mad_{f} + {floor})"
        cols += [f"coalesce(n_{f}, 0) AS n_{f}", f"med_{f}", f"{sc} AS scale_{f}", f"CASE WHEN n_{f} >= {min_n} THEN ({f} - med_{f}) / {sc} END AS z_{f}",
                 f"CASE WHEN n_{f} >= {min_n} THEN 100.0 * b_{f} / n_{f} END AS pct_{f}"]
    an = f"an AS MATERIALIZED (SELECT s.*, {', '.join(cols)} FROM {src} s LEFT JOIN md USING ({k}, {date}) LEFT JOIN ma USING ({k}, {date}))"
    return f"{pr}, {md}, {ma}, {an}"


@query("climatology_pairs", f"WITH {SQL_OBS} SELECT t.px, CAST(t.d AS VARCHAR) AS d, count(*) AS n_clim, CAST(min(c.d) AS VARCHAR) AS first_clim FROM obs t JOIN obs c ON c.px = t.px AND {sql_season('t.d', 'c.d')} GROUP BY t.px, t.d")
def climatology_pairs(spark, d):
    pairs = cl.climatology_pairs(observations(spark, d), ["px"])
    return pairs.groupBy("px", "d").agg(F.count(F.lit(1)).alias("n_clim"), F.min("clim_d").cast("string").alias("first_clim")).withColumn("d", F.col("d").cast("string"))


OBS_FEATS = {"ndci": 1.0, "tur": 2.0}


@query("robust_anomaly", f"""WITH {SQL_OBS}, {sql_anomaly('obs', ['px'], OBS_FEATS)}
SELECT px, CAST(d AS VARCHAR) AS d, {', '.join(f"CAST(n_{f} AS INTEGER) AS {f}_n, {r6(f'med_{f}', 9)} AS {f}_med, {r6(f'CASE WHEN n_{f} > 0 THEN scale_{f} END', 11)} AS {f}_scale, {r6(f'z_{f}')} AS {f}_z, {r6(f'pct_{f}')} AS {f}_pct" for f in OBS_FEATS)} FROM an""")
def robust_anomaly(spark, d):
    a = cl.robust_anomaly(observations(spark, d), ["px"], OBS_FEATS)
    cols = [F.col(f"{f}_n") for f in OBS_FEATS] + [rnd(F.col(f"{f}_{k}"), {"med": 9, "scale": 11}.get(k, 6)).alias(f"{f}_{k}") for f in OBS_FEATS for k in ("med", "scale", "z", "pct")]
    return a.select("px", F.col("d").cast("string").alias("d"), *cols)


@query("classify_state", f"""WITH {SQL_OBS}, {sql_anomaly('obs', ['px'], {'ndci': 1.0})}
SELECT px, CAST(d AS VARCHAR) AS d, {r6('ndci')} AS value, {r6('z_ndci')} AS z, {r6('pct_ndci')} AS pct, CAST(n_ndci AS INTEGER) AS n,
CASE WHEN pct_ndci IS NULL THEN 'UNKNOWN' WHEN pct_ndci >= 98 THEN 'HIGH_PRIORITY' WHEN pct_ndci >= 95 THEN 'INVESTIGATE' WHEN pct_ndci >= 90 THEN 'WATCH' ELSE 'NORMAL' END AS state
FROM an""")
def classify_state(spark, d):
    """Flagship: which observations are unusual for their place and season?"""
    a = cl.robust_anomaly(observations(spark, d), ["px"], {"ndci": 1.0})
    return (a.select("px", F.col("d").cast("string").alias("d"), rnd(F.col("ndci")).alias("value"), rnd(F.col("ndci_z")).alias("z"),
                    rnd(F.col("ndci_pct")).alias("pct"), F.col("ndci_n").alias("n"), cl.state_of(F.col("ndci_pct")).alias("state")))


@query("order_stat_baseline", f"""WITH {SQL_OBS}, m AS (SELECT px, count(*) AS n, median(ndci) AS med, list_sort(list(ndci)) AS s FROM obs GROUP BY px),
a AS (SELECT px, median(abs(ndci - med)) AS mad FROM obs JOIN m USING (px) GROUP BY px)
SELECT px, CAST(n AS INTEGER) AS n, {r6('med')} AS median, {r6('mad')} AS mad, {r6('s[CAST(ceil(0.95e0 * n - 1e-9) AS INTEGER)]')} AS q95, {r6('s[n]')} AS max FROM m JOIN a USING (px)""")
def order_stat_baseline(spark, d):
    out = cl.order_stat_baseline(observations(spark, d), ["px"], "ndci")
    return out.select("px", "n", *[rnd(F.col(c)).alias(c) for c in ("median", "mad", "q95", "max")])


# --- detection on the quarterly raster stack -------------------------------------------
FEATS = {"ndci": 0.02, "mci": 0.002, "tur": 1.0}
ALL_FEATS = FEATS | {"fai": 0.002, "hue": 5.0}
DAYS, MIN_N, Z, PCT, Z2 = 100, 4, 0.1, 45.0, -1.5


def sql_detect(feats):
    return f"""{SQL_STACK}, {sql_anomaly('stack', ['row', 'col'], feats, DAYS, MIN_N)}, {SHAPE},
h AS MATERIALIZED (SELECT scene, row, col FROM an WHERE z_ndci >= {Z} AND pct_ndci >= {PCT} AND z_mci >= {Z2}), {sql_erode('e', 'h', 1)}, {sql_dilate('g', 'e', 1, False)},
m AS MATERIALIZED (SELECT scene, row, col, row * 50 + col AS id FROM g), {sql_components('m')},
rp AS MATERIALIZED (SELECT cc.scene, cc.lbl AS label, an.* EXCLUDE (scene) FROM cc JOIN an ON an.scene = cc.scene AND an.row = cc.id // 50 AND an.col = cc.id % 50)"""


SQL_DETECT = sql_detect(FEATS)


def anomalies(st, feats, tasks=None):
    """Anomalies of the given pixels of the stack, each against its own season."""
    return cl.robust_anomaly(st, ["row", "col"], feats, window_days=DAYS, min_n=MIN_N, tasks=tasks).withColumn("scene", F.year("d") * 4 + F.quarter("d") - 1)


def region_anomalies(st, labelled, feats):
    """Region pixels with their anomalies: only the sites of regions are read, and only their histories are ordered."""
    sites = labelled.select("row", "col").distinct()
    return cut_lineage(labelled.join(anomalies(st.join(sites, ["row", "col"], "left_semi"), feats), ["scene", "row", "col"]))


def detected(spark, d, feats=FEATS):
    """The stack, the labelled pixels of the detected regions and their anomalies."""
    st = stack(spark, d)
    hit = cut_lineage(cl.hits(anomalies(st, {f: FEATS[f] for f in ("ndci", "mci")}, line_tasks(spark, d)), "ndci", ["mci"], Z, PCT, Z2).select("scene", "row", "col"))
    labelled = cut_lineage(grid.connected_components(grid.opening(hit, ["scene"], 1, n_rows(spark, d), GRID_COLS, tasks_for(hit)), ["scene"], GRID_COLS))
    return st, labelled, region_anomalies(st, labelled, feats)


# Every hypothesis; a raster of this size needs a smaller area rule.
HYPS = {"BLOOM_LIKE": ["ndci", "mci"], "SEDIMENT_LIKE": ["tur"], "SURFACE_FILM_LIKE": ["fai"]}
HYP_FEATS = {f: ALL_FEATS[f] for parts in HYPS.values() for f in parts}
MIN_AREA = 0.0016
WATER = "tur < 95"
_PRIMARY = "CASE {0} % 10 WHEN 0 THEN {1}ndci WHEN 1 THEN {1}tur ELSE {1}fai END"
SQL_HYPS = f"""{SQL_STACK}, {sql_anomaly('stack', ['row', 'col'], HYP_FEATS, DAYS, MIN_N)}, {SHAPE},
h AS MATERIALIZED (SELECT scene * 10 AS scene, row, col FROM an WHERE {WATER} AND z_ndci >= {Z} AND pct_ndci >= {PCT} AND z_mci >= {Z2}
  UNION ALL SELECT scene * 10 + 1, row, col FROM an WHERE {WATER} AND z_tur >= {Z} AND pct_tur >= {PCT}
  UNION ALL SELECT scene * 10 + 2, row, col FROM an WHERE {WATER} AND z_fai >= {Z} AND pct_fai >= {PCT}), {sql_erode('e', 'h', 1)}, {sql_dilate('g', 'e', 1, False)},
m AS MATERIALIZED (SELECT scene, row, col, row * 50 + col AS id FROM g), {sql_components('m')},
rh AS MATERIALIZED (SELECT cc.scene // 10 AS scene, CASE cc.scene % 10 WHEN 0 THEN 'BLOOM_LIKE' WHEN 1 THEN 'SEDIMENT_LIKE' ELSE 'SURFACE_FILM_LIKE' END AS hypothesis, cc.lbl AS label, an.row, an.col, {_PRIMARY.format('cc.scene', 'z_')} AS z
  FROM cc JOIN an ON an.scene = cc.scene // 10 AND an.row = cc.id // 50 AND an.col = cc.id % 50),
rg AS MATERIALIZED (SELECT scene, hypothesis, label, count(*) AS n_px, count(*) * 0.0004e0 AS area_km2, avg(row) AS centroid_row, avg(col) AS centroid_col, min(row) AS row0, min(col) AS col0, max(row) AS row1, max(col) AS col1, max(z) AS max_score
  FROM rh GROUP BY 1, 2, 3 HAVING count(*) * 0.0004e0 >= {MIN_AREA})"""


def hypothesis_regions(spark, d):
    """The stack and the regions of every hypothesis that pass the area rule.  Anomalies are computed once, for the
    hits; a hit row carries the score of its hypothesis, and opening keeps hit pixels only, so regions read theirs from the hits."""
    st, k = stack(spark, d), ["scene", "hypothesis"]
    found = cl.hypothesis_hits(anomalies(st, HYP_FEATS, line_tasks(spark, d)), HYPS, F.expr(WATER), Z, PCT, Z2)
    hit = cut_lineage(found.select(*k, "row", "col", F.col("primary_z").alias("z")))
    opened = grid.opening(hit.select(*k, "row", "col"), k, 1, n_rows(spark, d), GRID_COLS, tasks_for(hit))
    px = grid.connected_components(opened, k, GRID_COLS).join(hit, [*k, "row", "col"])
    return st, cl.large_enough(grid.region_stats(px, k, 20.0, "z"), MIN_AREA)


@query("detect_candidates", f"""WITH RECURSIVE {SQL_HYPS}, w AS (SELECT t.scene, count(*) AS water_px FROM stack t WHERE {WATER} GROUP BY 1),
cn AS (SELECT a.scene, count(*) AS n_climatology FROM (SELECT DISTINCT scene, d FROM stack) a JOIN (SELECT DISTINCT d FROM stack) b ON {sql_season('a.d', 'b.d', DAYS)} GROUP BY 1)
SELECT scene, hypothesis, CAST(label AS BIGINT) AS label, n_px, {r6('area_km2')} AS area_km2, {r6('centroid_row')} AS centroid_row, {r6('centroid_col')} AS centroid_col, row0, col0,
row1, col1, {r6('max_score')} AS max_score, n_climatology FROM rg JOIN w USING (scene) JOIN cn USING (scene) WHERE water_px >= 200 AND n_climatology >= 6""")
def detect_candidates(spark, d):
    st, regions = hypothesis_regions(spark, d)
    dates = st.select("scene", "d").distinct()
    # One row per scene: the acquisition list pairs with itself by season, never the pixels.
    pairs = cl.climatology_pairs(dates.select("d").withColumn("k", F.lit(0)), ["k"], window_days=DAYS).join(dates, "d")
    ok = cl.eligible_scenes(st.where(WATER), ["scene"], pairs)
    return regions.join(ok.select("scene", "n_climatology"), "scene").select(
        "scene", "hypothesis", "label", "n_px", "row0", "col0", "row1", "col1", "n_climatology",
        *[rnd(F.col(c)).alias(c) for c in ("area_km2", "centroid_row", "centroid_col", "max_score")])


SQL_PERSIST = f"""pe AS (SELECT rp.scene, rp.label, pr.cd, count(*) AS valid, count(CASE WHEN v_ndci >= med_ndci + 0.5 * {Z} * scale_ndci THEN 1 END) AS ex
 FROM rp JOIN pr ON pr.row = rp.row AND pr.col = rp.col AND pr.d = rp.d GROUP BY 1, 2, 3),
sz AS (SELECT scene, label, count(*) AS n FROM rp GROUP BY 1, 2),
ps AS (SELECT sz.scene, sz.label, avg(CASE WHEN valid >= 0.5 * n THEN CAST(ex >= 0.5 * valid AS INTEGER) END) AS persistence_frac FROM sz LEFT JOIN pe USING (scene, label) GROUP BY 1, 2)"""


@query("persistence_fraction", f"WITH RECURSIVE {SQL_DETECT}, {SQL_PERSIST} SELECT scene, CAST(label AS BIGINT) AS label, {r6('persistence_frac')} AS persistence_frac FROM ps")
def persistence_fraction(spark, d):
    st, _, px = detected(spark, d, {"ndci": FEATS["ndci"]})
    return cl.persistence(px, st, ["scene", "label"], ["row", "col"], "ndci", "d", DAYS, Z).withColumn("persistence_frac", rnd(F.col("persistence_frac")))


#: Water for the shore line: pixels that were clear enough on half of all acquisitions.
SHORE_WATER = "tur < 45"
_D3, _D2 = sql_diamond(3)[0], sql_diamond(2)[0]
SQL_SHORE = f"""pw AS MATERIALIZED (SELECT row, col FROM stack GROUP BY 1, 2 HAVING avg(CAST({SHORE_WATER} AS INTEGER)) >= 0.5),
land AS MATERIALIZED (SELECT * FROM (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM shape, generate_series(0, nr - 1) a(r), generate_series(0, nc - 1) b(c)) ANTI JOIN pw USING (row, col)),
sh AS MATERIALIZED (SELECT pw.row, pw.col, sqrt(min(pow(pw.row - land.row, 2) + pow(pw.col - land.col, 2))) AS px FROM pw, land GROUP BY 1, 2)"""


def shore_distance(spark, d, st):
    """Distance (pixels) of every persistently clear pixel to the nearest one that is not."""
    return grid.distance_transform(grid.static_water(st, [], F.expr(SHORE_WATER)).where("persistent"), [], n_rows(spark, d), GRID_COLS)


SQL_FEATURES = f"""{_D3}, {_D2}, cloud AS MATERIALIZED (SELECT scene, row, col FROM stack WHERE tur < 12),
cring AS MATERIALIZED (SELECT DISTINCT c.scene, c.row + dr AS row, c.col + dc AS col FROM cloud c, o3), cr AS MATERIALIZED (SELECT * FROM cring ANTI JOIN cloud USING (scene, row, col)),
ring AS (SELECT DISTINCT rp.scene, rp.label, rp.row + dr AS row, rp.col + dc AS col FROM rp, o2, shape WHERE rp.row + dr BETWEEN 0 AND nr - 1 AND rp.col + dc BETWEEN 0 AND 49),
rr AS (SELECT ring.* FROM ring ANTI JOIN rp USING (scene, label, row, col)),
ca AS (SELECT rr.scene, rr.label, avg(CAST(cr.row IS NOT NULL AS INTEGER)) AS cloud_adjacent_frac FROM rr LEFT JOIN cr USING (scene, row, col) GROUP BY 1, 2),
vf AS (SELECT scene, count(CASE WHEN {WATER} THEN 1 END) / CAST((SELECT nr * nc FROM shape) AS DOUBLE) AS valid_frac_aoi FROM stack GROUP BY 1),
{SQL_SHORE},
ds AS (SELECT rp.scene, rp.label, median(coalesce(px, 0)) * 20 / 1000.0e0 AS dist_shore_km FROM rp LEFT JOIN sh USING (row, col) GROUP BY 1, 2)"""


def sql_rx(src, keys, a, b, n_iter=3, trim=0.95):
    """Trimmed two-feature background per key with the 2 x 2 inverse written out."""
    k = ", ".join(keys)
    d2 = lambda s: (f"(({a} - {s}.ma) * ({a} - {s}.ma) * {s}.vb - 2 * ({a} - {s}.ma) * ({b} - {s}.mb) * {s}.vab + ({b} - {s}.mb) * ({b} - {s}.mb) * {s}.va) / ({s}.va * {s}.vb - {s}.vab * {s}.vab)")
    agg = f"count(*) AS n, avg({a}) AS ma, avg({b}) AS mb, var_samp({a}) AS va, var_samp({b}) AS vb, covar_samp({a}, {b}) AS vab"
    parts = [f"t0 AS MATERIALIZED (SELECT {k}, {agg} FROM {src} GROUP BY {k})", f"k0 AS MATERIALIZED (SELECT * FROM {src})"]
    for i in range(n_iter):
        parts.append(f"q{i} AS MATERIALIZED (SELECT {k}, quantile_cont({d2('s')}, {trim}) AS cut FROM k{i} JOIN t{i} s USING ({k}) GROUP BY {k})")
        parts.append(f"k{i + 1} AS MATERIALIZED (SELECT x.* FROM {src} x JOIN t{i} s USING ({k}) JOIN q{i} USING ({k}) WHERE {d2('s')} <= cut)")
        parts.append(f"t{i + 1} AS MATERIALIZED (SELECT {k}, {agg} FROM k{i + 1} GROUP BY {k})")
    return ", ".join(parts), d2


_RP, _RD2 = sql_rx("st2", ["scene"], "f1", "f2")
#: Spatial RX of region means among all pixels of their scene: CTE rx with scene, label, region_rx, rx_pct.
SQL_REGION_RX = f"""wn AS (SELECT scene, avg(ndci) AS m1, stddev_pop(ndci) AS s1, avg(tur) AS m2, stddev_pop(tur) AS s2 FROM an GROUP BY 1 HAVING count(*) >= 200),
st2 AS MATERIALIZED (SELECT scene, (ndci - m1) / s1 AS f1, (tur - m2) / s2 AS f2 FROM an JOIN wn USING (scene)), {_RP}, wr AS (SELECT x.scene, {_RD2('s')} AS rx FROM st2 x JOIN t3 s USING (scene)),
rm AS (SELECT rp.scene, rp.label, (avg(ndci) - any_value(m1)) / any_value(s1) AS f1, (avg(tur) - any_value(m2)) / any_value(s2) AS f2 FROM rp JOIN wn USING (scene) GROUP BY 1, 2), rs AS (SELECT x.scene, x.label, {_RD2('s')} AS rrx FROM rm x JOIN t3 s USING (scene)),
rx AS MATERIALIZED (SELECT scene, label, any_value(rrx) AS region_rx, 100.0 * avg(CAST(rx < rrx AS INTEGER)) AS rx_pct FROM rs JOIN wr USING (scene) GROUP BY 1, 2)"""
RX_FEATURES = ["ndci", "tur"]


@query("candidate_features", f"""WITH RECURSIVE {sql_detect(ALL_FEATS)}, {SQL_PERSIST}, {SQL_FEATURES}, {SQL_REGION_RX}
SELECT scene, CAST(label AS BIGINT) AS label, {r6('median(pct_ndci)')} AS seasonal_pct_primary, {r6('median(z_ndci)')} AS robust_z_primary, {r6('any_value(rx_pct)')} AS rx_pct, {r6('log10(count(*) * 0.0004e0)')} AS log10_area_km2,
{r6('any_value(persistence_frac)')} AS persistence_frac, {r6('any_value(dist_shore_km)')} AS dist_shore_km, {r6('median(ndci - med_ndci)')} AS ndci_delta, {r6('median(mci - med_mci)')} AS mci_delta, {r6('median(tur - med_tur)')} AS tur_delta,
{r6('median(fai)')} AS fai_mean, {r6('median(hue - med_hue)')} AS hue_delta_deg, {r6('any_value(cloud_adjacent_frac)')} AS cloud_adjacent_frac, {r6('any_value(valid_frac_aoi)')} AS valid_frac_aoi
FROM rp JOIN ps USING (scene, label) JOIN vf USING (scene) JOIN ds USING (scene, label) LEFT JOIN ca USING (scene, label) LEFT JOIN rx USING (scene, label) GROUP BY 1, 2""")
def candidate_features(spark, d):
    """The triage vector of every region, in the order that models are trained on."""
    st, labelled, px = detected(spark, d, ALL_FEATS)
    k, n = ["scene", "label"], n_rows(spark, d)
    px = px.join(shore_distance(spark, d, st), ["row", "col"], "left")
    deltas = px.select(*k, F.col("ndci_pct").alias("seasonal_pct_primary"), F.col("ndci_z").alias("robust_z_primary"), F.col("fai").alias("fai_mean"),
                       (F.coalesce("dist_px", F.lit(0.0)) * 20 / 1000).alias("dist_shore_km"), (F.col("hue") - F.col("hue_med")).alias("hue_delta_deg"),
                       *[(F.col(f) - F.col(f"{f}_med")).alias(f"{f}_delta") for f in FEATS])
    out = cl.region_medians(deltas, k, [c for c in deltas.columns if c not in k])
    area = px.groupBy(*k).agg(F.log10(F.count(F.lit(1)) * (20.0 ** 2 / 1e6)).alias("log10_area_km2"))
    cloud = st.where(F.col("tur") < 12).select("scene", "row", "col")
    cloud_ring = grid.dilate(cloud, ["scene"], 3, n, GRID_COLS).join(cloud, ["scene", "row", "col"], "left_anti").withColumn("c", F.lit(1.0))
    ring = grid.dilate(labelled, k, 2, n, GRID_COLS).join(labelled, [*k, "row", "col"], "left_anti")
    adjacent = ring.join(cloud_ring, ["scene", "row", "col"], "left").groupBy(*k).agg(F.avg(F.coalesce("c", F.lit(0.0))).alias("cloud_adjacent_frac"))
    valid = st.groupBy("scene").agg((F.count_if(F.expr(WATER)) / F.lit(float(n * GRID_COLS))).alias("valid_frac_aoi"))
    rx = sp.rx_percentile(st.select("scene", *RX_FEATURES), px.select(*k, *RX_FEATURES), ["scene"], RX_FEATURES).select(*k, "rx_pct")
    out = out.join(area, k).join(cl.persistence(px, st, k, ["row", "col"], "ndci", "d", DAYS, Z), k).join(adjacent, k, "left").join(valid, "scene").join(rx, k, "left")
    return out.select(*k, *[rnd(F.col(c)).alias(c) for c in TRIAGE_FEATURES])


@query("candidate_pick", f"""WITH RECURSIVE {SQL_DETECT}, c AS (SELECT scene, label, count(*) * 0.0004e0 AS area, median(z_ndci) AS z FROM rp GROUP BY 1, 2)
SELECT scene, CAST(label AS BIGINT) AS label, {r6('area * z', 7)} AS score FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY area * z DESC, label) AS r FROM c) WHERE r = 1""")
def candidate_pick(spark, d):
    _, _, px = detected(spark, d)
    c = cl.region_medians(px, ["scene", "label"], ["ndci_z"]).join(grid.region_stats(px, ["scene"], 20.0), ["scene", "label"])
    return cl.candidate_pick(c, ["scene"], "area_km2", "ndci_z", "label").withColumn("score", rnd(F.col("score"), 7))


@query("date_summary", f"""WITH RECURSIVE {SQL_HYPS} SELECT scene, {', '.join(f"count(CASE WHEN hypothesis = '{h}' THEN 1 END) AS {n}_n, {r6(f"coalesce(sum(CASE WHEN hypothesis = '{h}' THEN area_km2 END), 0)")} AS {n}_area, {r6(f"max(CASE WHEN hypothesis = '{h}' THEN max_score END)")} AS {n}_max_z" for n, h in (('bloom', 'BLOOM_LIKE'), ('sediment', 'SEDIMENT_LIKE'), ('surface_film', 'SURFACE_FILM_LIKE')))} FROM rg GROUP BY 1""")
def date_summary(spark, d):
    _, c = hypothesis_regions(spark, d)
    aggs = []
    for name in ("bloom", "sediment", "surface_film"):
        cond = F.col("hypothesis") == f"{name.upper()}_LIKE"
        aggs += [F.count_if(cond).alias(f"{name}_n"), rnd(F.coalesce(F.sum(F.when(cond, F.col("area_km2"))), F.lit(0.0))).alias(f"{name}_area"),
                 rnd(F.max(F.when(cond, F.col("max_score")))).alias(f"{name}_max_z")]
    return c.groupBy("scene").agg(*aggs)


@query("event_summary", f"""WITH RECURSIVE {SQL_DETECT}, {SQL_SHORE} SELECT scene, CAST(label AS BIGINT) AS label, count(*) AS n_px, {r6('count(*) * 0.0004e0')} AS area_km2, {r6('median(ndci)')} AS ndci, {r6('median(z_ndci)')} AS ndci_z,
{r6('median(pct_ndci)')} AS ndci_pct, {r6('median(med_ndci)')} AS ndci_med, {r6('median(n_ndci)')} AS ndci_n, {r6('median(mci)')} AS mci, {r6('median(z_mci)')} AS mci_z, {r6('median(tur)')} AS tur, {r6('median(coalesce(px, 0)) * 20 / 1000.0e0')} AS coast_km FROM rp LEFT JOIN sh USING (row, col) GROUP BY 1, 2""")
def event_summary(spark, d):
    st, _, px = detected(spark, d)
    px = px.join(shore_distance(spark, d, st), ["row", "col"], "left").withColumn("coast_km", F.coalesce("dist_px", F.lit(0.0)) * 20 / 1000)
    vals = ["coast_km", "ndci", "ndci_z", "ndci_pct", "ndci_med", "ndci_n", "mci", "mci_z", "tur"]
    out = cl.region_medians(px, ["scene", "label"], vals).join(grid.region_stats(px, ["scene"], 20.0).select("scene", "label", "n_px", "area_km2"), ["scene", "label"])
    return out.select("scene", "label", "n_px", *[rnd(F.col(c)).alias(c) for c in [*vals, "area_km2"]])


@query("region_reselect", f"""WITH RECURSIVE {SQL_DETECT}, b AS (SELECT scene, label, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM rp GROUP BY 1, 2)
SELECT b.scene, CAST(b.label AS BIGINT) AS label, count(*) AS n_px FROM b JOIN an ON an.scene = b.scene AND an.row BETWEEN r0 AND r1 AND an.col BETWEEN c0 AND c1 WHERE z_ndci >= {Z} AND pct_ndci >= {PCT} GROUP BY 1, 2""")
def region_reselect(spark, d):
    st, _, px = detected(spark, d)
    box = grid.region_stats(px, ["scene"], 20.0).select("scene", "label", "row0", "row1", "col0", "col1")
    return grid.select_in_boxes(cl.hits(anomalies(st, {"ndci": FEATS["ndci"]}), "ndci", (), Z, PCT), box, ["scene"]).groupBy("scene", "label").agg(F.count(F.lit(1)).alias("n_px"))


# --- zones and series ---------------------------------------------------------------------
ZONE_FEATURES = ["MNDWI", "SWIR_B11", "NDCI", "MCI", "FAI", "RE_RATIO", "CDOM_RATIO", "TUR_NECHAD2016", "SPM_NECHAD2016"]
ZONE_WATER = "scl NOT IN (0, 1, 3, 8, 9, 10, 11) AND (scl = 6 OR (b03 - b11) / (b03 + b11 + 1e-6) > 0.15) AND b8a < 0.10"
_ONS2A = "CASE WHEN platform LIKE '%A' THEN {} ELSE {} END"
SQL_ZONE = f"""zb AS MATERIALIZED (SELECT *, CAST(year(d) AS INTEGER) AS yr, aoi || CASE WHEN scl < 6 THEN '_near' ELSE '_off' END AS zone, {ZONE_WATER} AS water, b03 - b12 AS g, b04 - b12 AS r, b05 - b12 AS e, b06 - b12 AS i,
 {_ONS2A.format('(704.1e0 - 664.6e0) / (740.5e0 - 664.6e0)', '(703.8e0 - 664.9e0) / (739.1e0 - 664.9e0)')} AS fm, {_ONS2A.format('(864.7e0 - 664.6e0) / (1613.7e0 - 664.6e0)', '(864.0e0 - 664.9e0) / (1610.4e0 - 664.9e0)')} AS ff FROM bands),
zq AS (SELECT yr, zone, count(*) AS zone_px, count(CASE WHEN water THEN 1 END) AS n_water, count(CASE WHEN scl <> 0 THEN 1 END) / CAST(count(*) AS DOUBLE) AS valid_fraction, count(CASE WHEN scl IN (8, 9, 10) THEN 1 END) / CAST(greatest(count(CASE WHEN scl <> 0 THEN 1 END), 1) AS DOUBLE) AS cloud_fraction_of_valid FROM zb GROUP BY 1, 2),
zf AS (SELECT yr, zone, unnest({ZONE_FEATURES!r}) AS feature, unnest([(b03 - b11) / nullif(b03 + b11, 0), b11, (e - r) / nullif(e + r, 0), e - (r + (i - r) * fm), b8a - (b04 + (b11 - b04) * ff), CASE WHEN r > 1e-3 THEN e / r END, CASE WHEN r > 1e-3 THEN g / r END,
 CASE WHEN r < 0.5 * 0.19563e0 THEN 366.14e0 * r / (1 - r / 0.19563e0) END, CASE WHEN r < 0.5 * 0.19563e0 THEN 342.10e0 * r / (1 - r / 0.19563e0) END]) AS value, unnest([-1, NULL, -1, NULL, NULL, 0, 0, 0, 0]) AS lo, unnest([1, NULL, 1, NULL, NULL, 10, 20, 1000, 1000]) AS hi FROM zb WHERE water),
zv AS (SELECT yr, zone, feature, CASE WHEN lo IS NULL OR value BETWEEN lo AND hi THEN value END AS value FROM zf)"""


@query("zone_statistics", f"""WITH {SQL_BANDS}, {SQL_ZONE}, g AS (SELECT yr, zone, feature, count(value) AS n, quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q, avg(value) AS m FROM zv GROUP BY 1, 2, 3 HAVING count(value) > 0)
SELECT yr, zone, feature, n, {', '.join(f"{r6(f'CASE WHEN n >= 30 THEN q[{i + 1}] END', 4)} AS p{p}" for i, p in enumerate((5, 25, 50, 75, 95, 99)))}, {r6('CASE WHEN n >= 30 THEN m END', 4)} AS mean, zone_px, n_water, {r6('valid_fraction')} AS valid_fraction, {r6('cloud_fraction_of_valid')} AS cloud_fraction_of_valid FROM g JOIN zq USING (yr, zone)""")
def zone_statistics(spark, d):
    f = feature_columns(BAND_COLUMNS, F.col("platform"))
    px = bands(spark, d).withColumns({"yr": F.year("d"), "zone": F.concat("aoi", F.when(F.col("scl") < 6, "_near").otherwise("_off"))})
    quality = cl.zone_quality(px, ["yr", "zone"], F.expr(ZONE_WATER), F.col("scl") != 0, F.col("scl").isin(8, 9, 10))
    water = px.where(ZONE_WATER).select("yr", "zone", *[f[k].alias(k) for k in ZONE_FEATURES])
    out = join_small(cl.zone_statistics(water, ["yr", "zone"], ZONE_FEATURES), quality, ["yr", "zone"])
    stats = [f"p{p}" for p in cl.ZONE_PCTS] + ["mean"]
    return out.select("yr", "zone", "feature", "n", *[rnd(F.col(c), 4).alias(c) for c in stats], "zone_px", "n_water", rnd(F.col("valid_fraction")).alias("valid_fraction"), rnd(F.col("cloud_fraction_of_valid")).alias("cloud_fraction_of_valid"))


@query("zone_baseline_scene", f"""WITH {SQL_BANDS}, w AS (SELECT year(d) * 100 + month(d) AS ym, aoi, (b03 - b11) / (b03 + b11 + 1e-6) AS mndwi, (b05 - b04) / (b05 + b04 + 1e-6) AS ndci FROM bands
 WHERE scl NOT IN (0, 1, 3, 8, 9, 10, 11) AND (scl = 6 OR (b03 - b11) / (b03 + b11 + 1e-6) > 0.15) AND b8a < 0.10)
SELECT CAST(ym AS INTEGER) AS ym, aoi, count(*) AS n_water, {r6('median(mndwi)')} AS mndwi, {r6('quantile_cont(mndwi, 0.95)')} AS mndwi_p95, {r6('median(ndci)')} AS ndci, {r6('quantile_cont(ndci, 0.95)')} AS ndci_p95 FROM w GROUP BY 1, 2 HAVING count(*) >= 30""")
def zone_baseline_scene(spark, d):
    from tidemark.operators.pixels import guarded_indices
    ix = guarded_indices(*[F.col(c) for c in ("b03", "b04", "b05", "b8a", "b11")])
    w = bands(spark, d).where(scl_usable(F.col("scl")) & ((F.col("scl") == 6) | (ix["MNDWI"] > 0.15)) & (F.col("b8a") < 0.10))
    w = w.select((F.year("d") * 100 + F.month("d")).alias("ym"), "aoi", ix["MNDWI"].alias("mndwi"), ix["NDCI"].alias("ndci"))
    q = exact_quantiles(w.unpivot(["ym", "aoi"], ["mndwi", "ndci"], "f", "v"), ["ym", "aoi", "f"], "v", {"med": 0.5, "p95": 0.95})
    q = q.groupBy("ym", "aoi", F.col("n").alias("n_water")).agg(*[rnd(F.max(F.when(F.col("f") == f, F.col(c)))).alias(f + s) for f in ("mndwi", "ndci") for c, s in (("med", ""), ("p95", "_p95"))])
    return q.where(F.col("n_water") >= 30)


SQL_ZSERIES = """zs AS MATERIALIZED (SELECT aoi, f, d, count(*) AS n_water, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99 FROM
(SELECT aoi, 'b03' AS f, make_date(year(d), month(d), 1) AS d, b03 AS v FROM bands UNION ALL SELECT aoi, 'b05', make_date(year(d), month(d), 1), b05 FROM bands UNION ALL SELECT aoi, 'b8a', make_date(year(d), month(d), 1), b8a FROM bands) GROUP BY 1, 2, 3)"""


def zone_series(spark, d):
    b = bands(spark, d).select("aoi", F.trunc("d", "month").alias("d"), "b03", "b05", "b8a").unpivot(["aoi", "d"], ["b03", "b05", "b8a"], "f", "v")
    return exact_quantiles(b, ["aoi", "f", "d"], "v", {"p95": 0.95, "p99": 0.99}).withColumnRenamed("n", "n_water")


@query("zone_screen", f"""WITH {SQL_BANDS}, {SQL_ZSERIES}, us AS MATERIALIZED (SELECT * FROM zs WHERE n_water >= 50), {sql_anomaly('us', ['aoi', 'f'], {'p95': 0.001, 'p99': 0.001}, min_n=3)},
mx AS (SELECT aoi, d, max(greatest(pct_p95, pct_p99)) AS zone_pct FROM an GROUP BY 1, 2) SELECT aoi, CAST(d AS VARCHAR) AS d, {r6('zone_pct')} AS zone_pct, CAST(coalesce(zone_pct >= 80, false) AS INTEGER) AS passed FROM mx""")
def zone_screen(spark, d):
    s = zone_series(spark, d).where(F.col("n_water") >= 50)
    a = cl.robust_anomaly(s, ["aoi", "f"], {"p95": 0.001, "p99": 0.001}, min_n=3)
    m = a.groupBy("aoi", "d").agg(F.max(F.greatest("p95_pct", "p99_pct")).alias("zone_pct"))
    return m.select("aoi", F.col("d").cast("string").alias("d"), rnd(F.col("zone_pct")).alias("zone_pct"), F.coalesce(F.col("zone_pct") >= 80, F.lit(False)).cast("int").alias("passed"))


@query("series_extract", f"WITH {SQL_BANDS}, {SQL_ZSERIES} SELECT aoi, CAST(d AS VARCHAR) AS d, {r6('p95', 9)} AS p95 FROM zs WHERE f = 'b05' AND n_water >= 200")
def series_extract(spark, d):
    s = cl.series_extract(zone_series(spark, d).where(F.col("f") == "b05"), "p95")
    return s.select("aoi", F.col("d").cast("string").alias("d"), rnd(F.col("p95"), 9).alias("p95"))


@query("baseline_stats", f"""WITH {SQL_SITES}, b AS (SELECT site, count(*) AS n, min(d) AS a, max(d) AS z, avg(v) AS m, coalesce(stddev_samp(v), 0) AS s, quantile_cont(v, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99]) AS q FROM sites GROUP BY 1)
SELECT site, n, CAST(a AS VARCHAR) AS first_d, CAST(z AS VARCHAR) AS last_d, {r6('m')} AS mean, {r6('s')} AS std, {', '.join(f"{r6(f'q[{i + 1}]')} AS p{p}" for i, p in enumerate(cl.BASELINE_PCTS))} FROM b""")
def baseline_stats(spark, d):
    out = cl.baseline_stats(sites(spark, d), ["site"], "v")
    return out.select("site", "n", F.col("first_d").cast("string").alias("first_d"), F.col("last_d").cast("string").alias("last_d"), *[rnd(F.col(c)).alias(c) for c in out.columns[4:]])


@query("seasonal_baseline", f"""WITH {SQL_SITES}, c AS (SELECT m, CAST(floor((m - 0.5) * 30.44) AS INTEGER) AS centre FROM generate_series(1, 12) g(m))
SELECT site, lpad(CAST(m AS VARCHAR), 2, '0') AS month, count(*) AS n, {r6('median(v)')} AS median, {r6('quantile_cont(v, 0.9)')} AS p90, {r6('quantile_cont(v, 0.95)')} AS p95
FROM sites, c WHERE least(abs(dayofyear(d) - centre), 365 - abs(dayofyear(d) - centre)) <= 45 GROUP BY 1, 2 HAVING count(*) >= 3""")
def seasonal_baseline(spark, d):
    out = cl.seasonal_baseline(sites(spark, d), ["site"], "v")
    return out.select("site", "month", "n", *[rnd(F.col(c)).alias(c) for c in ("median", "p90", "p95")])


@query("percentile_of", f"WITH {SQL_SITES} SELECT site, {r6('100.0 * count(CASE WHEN v < 30 THEN 1 END) / count(v)')} AS pct FROM sites GROUP BY 1")
def percentile_of(spark, d):
    return cl.percentile_of(sites(spark, d), ["site"], "v", F.lit(30.0)).withColumn("pct", rnd(F.col("pct")))


SQL_TARGET = """tg AS (SELECT site, d AS td, v AS tv, abs(d - DATE '1998-06-01') AS gap FROM sites WHERE abs(d - DATE '1998-06-01') <= 10
 QUALIFY row_number() OVER (PARTITION BY site ORDER BY abs(d - DATE '1998-06-01'), d) = 1),
sp AS (SELECT tg.site, td, tv, gap, count(*) AS n_all, count(CASE WHEN s.v < tv THEN 1 END) AS below, count(CASE WHEN ok THEN 1 END) AS ns, count(CASE WHEN ok AND s.v < tv THEN 1 END) AS sb, median(CASE WHEN ok THEN s.v END) AS sm
 FROM tg JOIN (SELECT *, least(abs(dayofyear(d) - dayofyear(q.t)), 365 - abs(dayofyear(d) - dayofyear(q.t))) <= 45 AS ok FROM sites JOIN (SELECT site, td AS t FROM tg) q USING (site)) s USING (site) GROUP BY 1, 2, 3, 4)"""


@query("seasonal_percentile", f"""WITH {SQL_SITES}, {SQL_TARGET} SELECT site, CAST(td AS VARCHAR) AS target_d, n_all AS n_all_time, ns AS n_seasonal, {r6('CASE WHEN ns >= 3 THEN 100.0 * sb / ns END')} AS seasonal_percentile,
{r6('100.0 * below / n_all')} AS all_time_percentile, {r6('CASE WHEN ns >= 3 THEN sm END')} AS seasonal_median FROM sp""")
def seasonal_percentile(spark, d):
    s = sites(spark, d)
    t = cl.nearest_to(s, ["site"], F.lit("1998-06-01").cast("date"), "v").drop("days_from_target")
    out = cl.seasonal_percentile(s, t, ["site"], "v")
    return out.select("site", F.col("target_d").cast("string").alias("target_d"), "n_all_time", "n_seasonal", *[rnd(F.col(c)).alias(c) for c in ("seasonal_percentile", "all_time_percentile", "seasonal_median")])


@query("target_assessment", f"""WITH {SQL_SITES}, {SQL_TARGET}, p AS (SELECT *, CASE WHEN ns >= 3 THEN 100.0 * sb / ns END AS pct FROM sp) SELECT site, CAST(td AS VARCHAR) AS matched_date, CAST(gap AS INTEGER) AS days_from_target, {r6('pct')} AS seasonal_percentile,
CASE WHEN pct IS NULL THEN 'UNKNOWN' WHEN pct >= 98 THEN 'HIGH_PRIORITY' WHEN pct >= 95 THEN 'INVESTIGATE' WHEN pct >= 90 THEN 'WATCH' ELSE 'NORMAL' END AS state FROM p""")
def target_assessment(spark, d):
    s = sites(spark, d)
    t = cl.nearest_to(s, ["site"], F.lit("1998-06-01").cast("date"), "v")
    out = cl.seasonal_percentile(s, t.drop("days_from_target"), ["site"], "v").join(t.select("site", "days_from_target"), "site")
    return out.select("site", F.col("target_d").cast("string").alias("matched_date"), "days_from_target", rnd(F.col("seasonal_percentile")).alias("seasonal_percentile"), cl.state_of(F.col("seasonal_percentile")).alias("state"))


@query("trend", f"""WITH {SQL_SITES}, t AS (SELECT site, v, (d - DATE '1970-01-01') / 365.25e0 AS t FROM sites), o AS (SELECT site, min(t) AS t0 FROM t GROUP BY 1)
SELECT site, count(*) AS n, {', '.join(f"CASE WHEN count(*) >= 4 THEN {r6(e)} END AS {k}" for k, e in (('slope_per_year', 'regr_slope(v, t - t0)'), ('intercept', 'regr_intercept(v, t - t0)'), ('r_squared', 'regr_r2(v, t - t0)'), ('span_years', 'max(t) - min(t)')))} FROM t JOIN o USING (site) GROUP BY 1""")
def trend(spark, d):
    out = cl.trend(sites(spark, d), ["site"], "v")
    return out.select("site", "n", *[rnd(F.col(c)).alias(c) for c in ("slope_per_year", "intercept", "r_squared", "span_years")])


INDEX4 = ["b03", "b04", "b05", "b8a"]
SQL_ZS = f"""st AS (SELECT aoi, platform, {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in INDEX4)} FROM bands GROUP BY 1, 2),
zz AS (SELECT ok, px, ln, aoi, {', '.join(f'CASE WHEN s_{c} > 1e-9 THEN ({c} - m_{c}) / s_{c} END AS z_{c}' for c in INDEX4)} FROM bands JOIN st USING (aoi, platform)),
zm AS (SELECT *, greatest({', '.join(f'abs(z_{c})' for c in INDEX4)}) AS mz FROM zz)"""


@query("per_sensor_zscore", f"""WITH {SQL_BANDS}, {SQL_ZS} SELECT ok, px, ln, {', '.join(f"{r6(f'z_{c}')} AS {c}_z" for c in INDEX4)}, {r6('mz')} AS max_abs_z, CAST(mz > 1.5 AS INTEGER) AS flagged,
CASE WHEN mz > 1.5 THEN CASE {' '.join(f"WHEN abs(z_{c}) = mz THEN '{c}'" for c in INDEX4)} END END AS flagged_index FROM zm""")
def per_sensor_zscore(spark, d):
    out = cl.sensor_zscores(bands(spark, d), ["aoi", "platform"], INDEX4)
    return out.select("ok", "px", "ln", *[rnd(F.col(f"{c}_z")).alias(f"{c}_z") for c in INDEX4], rnd(F.col("max_abs_z")).alias("max_abs_z"), F.col("flagged").cast("int").alias("flagged"), "flagged_index")


P_ONE = math.erfc(1.5 / math.sqrt(2))


@query("chance_level", f"""WITH {SQL_BANDS}, {SQL_ZS} SELECT aoi, count(*) AS n, count(CASE WHEN mz > 1.5 THEN 1 END) AS n_flagged, {r6(f'count(*) * {P_ONE!r}', 3)} AS expected_correlated, {r6(f'count(*) * (1 - pow(1 - {P_ONE!r}, 4))', 3)} AS expected_independent FROM zm GROUP BY 1""")
def chance_level(spark, d):
    z = cl.sensor_zscores(bands(spark, d), ["aoi", "platform"], INDEX4)
    out = cl.chance_level(z, ["aoi"], P_ONE, 4)
    return out.select("aoi", "n", "n_flagged", rnd(F.col("expected_correlated"), 3).alias("expected_correlated"), rnd(F.col("expected_independent"), 3).alias("expected_independent"))


@query("asof_bracket", f"""WITH {SQL_SITES}, t AS (SELECT site, CAST(make_date(y, m, 1) AS DATE) AS target FROM (SELECT DISTINCT site FROM sites), generate_series(1995, 2001) a(y), generate_series(1, 12, 3) b(m))
SELECT t.site, CAST(target AS VARCHAR) AS target, CAST(b.d AS VARCHAR) AS before_d, {r6('b.v')} AS before_v, CAST(target - b.d AS INTEGER) AS before_gap, CAST(a.d AS VARCHAR) AS after_d, {r6('a.v')} AS after_v
FROM t ASOF LEFT JOIN sites b ON b.site = t.site AND b.d <= target ASOF LEFT JOIN sites a ON a.site = t.site AND a.d > target""")
def asof_bracket(spark, d):
    s = sites(spark, d)
    quarters = F.explode(F.expr("sequence(date'1995-01-01', date'2001-10-01', interval 3 month)"))
    t = s.select("site").distinct().select("site", quarters.alias("target"))
    out = cl.asof_bracket(s, t, ["site"], "d", ["v"], F.year("d"), line_tasks(spark, d))
    return out.select("site", F.col("target").cast("string").alias("target"), F.col("before.d").cast("string").alias("before_d"), rnd(F.col("before.v")).alias("before_v"),
                      F.datediff("target", "before.d").alias("before_gap"), F.col("after.d").cast("string").alias("after_d"), rnd(F.col("after.v")).alias("after_v"))


@query("successive_change", f"""WITH {SQL_SITES}, l AS (SELECT site, v, d - lag(d) OVER w AS gap, abs(v - lag(v) OVER w) AS c FROM sites WINDOW w AS (PARTITION BY site ORDER BY d)),
r AS (SELECT site, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS rg FROM sites GROUP BY 1)
SELECT site, count(*) AS n_pairs, {r6('quantile_cont(c, 0.5)')} AS p50, {r6('quantile_cont(c, 0.9)')} AS p90, {r6('quantile_cont(c, 0.95)')} AS p95, {r6('any_value(rg)')} AS record_range FROM l JOIN r USING (site) WHERE gap <= 6 GROUP BY 1""")
def successive_change(spark, d):
    s = sites(spark, d)
    lag = previous_row(s, ["site"], ["d"], F.year("d"), {"d": "prev_d", "v": "prev_v"})
    out = cl.successive_change(lag, ["site"], "v", "prev_v", F.datediff("d", "prev_d"), 6)
    rng = s.groupBy("site").agg((F.percentile("v", 0.95) - F.percentile("v", 0.05)).alias("record_range"))
    return out.join(rng, "site").select("site", "n_pairs", *[rnd(F.col(c)).alias(c) for c in ("p50", "p90", "p95", "record_range")])


@query("persistent_mask", f"""WITH {SQL_SCENES}, g AS (SELECT row, col, count(DISTINCT scene) AS n_dates, max(disc) AS mx, min(q / n) AS mn FROM scenes GROUP BY 1, 2)
SELECT row, col, n_dates, CAST(mx < 0.075 AS INTEGER) AS dark, CAST(mn > 15 AS INTEGER) AS wet, {r6('mx')} AS joint_dark, {r6('mn')} AS joint_wet FROM g WHERE n_dates >= 2 AND (mx < 0.075 OR mn > 15)""")
def persistent_mask(spark, d):
    s = scenes(spark, d).withColumn("index", F.col("q") / F.col("n"))
    dark = cl.persistent_mask(s, ["row", "col"], "scene", brightness="disc", darkness_max=0.075).withColumn("dark", F.lit(1))
    wet = cl.persistent_mask(s, ["row", "col"], "scene", mndwi="index", mndwi_min=15.0).withColumn("wet", F.lit(1))
    both = dark.select("row", "col", "dark").join(wet.select("row", "col", "wet"), ["row", "col"], "full").fillna(0)
    joint = s.groupBy("row", "col").agg(F.countDistinct("scene").alias("n_dates"), rnd(F.max("disc")).alias("joint_dark"), rnd(F.min("index")).alias("joint_wet"))
    return both.join(joint, ["row", "col"])


@query("threshold_sweep", f"""WITH {SQL_SCENES}, g AS (SELECT row, col, count(DISTINCT scene) AS nd, max(disc) AS mx FROM scenes GROUP BY 1, 2)
SELECT CAST(t AS DOUBLE) AS threshold, count(CASE WHEN mx < t THEN 1 END) AS n_px FROM g, unnest([0.05e0, 0.06e0, 0.07e0, 0.08e0, 0.09e0]) x(t) WHERE nd >= 2 GROUP BY 1""")
def threshold_sweep(spark, d):
    return cl.threshold_sweep(scenes(spark, d), ["row", "col"], "scene", "disc", [0.05, 0.06, 0.07, 0.08, 0.09])


@query("band_groups", f"""WITH {SQL_SPECTRA}, gd AS (SELECT ix, row_number() OVER (ORDER BY ix) - 1 AS pos FROM (SELECT ix FROM spectra GROUP BY 1 HAVING min(refl) >= 0.016)), n AS (SELECT count(*) AS n FROM gd),
s AS (SELECT vec_id, refl, CASE WHEN pos < n // 3 THEN 0 WHEN pos < 2 * n // 3 THEN 1 ELSE 2 END AS g FROM spectra JOIN gd USING (ix), n),
a AS (SELECT vec_id, avg(CASE WHEN g = 0 THEN refl END) AS a, avg(CASE WHEN g = 1 THEN refl END) AS b, avg(CASE WHEN g = 2 THEN refl END) AS c, avg(refl) AS m FROM s GROUP BY 1)
SELECT vec_id, {r6('a')} AS short, {r6('b')} AS mid, {r6('c')} AS long, {r6('m')} AS brightness, {r6('(a - c) / (a + c + 1e-9)')} AS short_long_index FROM a""")
def band_groups(spark, d):
    s = spectra(spark, d)
    good = cl.good_bands(s, F.col("refl") < 0.016)
    out = cl.band_groups(s, ["vec_id"], good, good.count(), 3, "refl")
    return out.select("vec_id", rnd(F.col("g0")).alias("short"), rnd(F.col("g1")).alias("mid"), rnd(F.col("g2")).alias("long"), rnd(F.col("brightness")).alias("brightness"),
                      rnd((F.col("g0") - F.col("g2")) / (F.col("g0") + F.col("g2") + 1e-9)).alias("short_long_index"))


@query("climatology_thin", f"""WITH {SQL_BANDS}, f AS (SELECT aoi, d, avg(CAST(scl NOT IN (0, 1, 3, 8, 9, 10, 11) AS INTEGER)) AS fr FROM bands GROUP BY 1, 2)
SELECT aoi, CAST(d AS VARCHAR) AS d, {r6('fr')} AS fraction FROM f WHERE fr > 0.25 QUALIFY row_number() OVER (PARTITION BY aoi ORDER BY sha256(CAST(d AS VARCHAR)), d) <= 36""")
def climatology_thin(spark, d):
    f = bands(spark, d).groupBy("aoi", "d").agg(F.avg(scl_usable(F.col("scl")).cast("double")).alias("fraction"))
    return cl.climatology_thin(f, ["aoi"], "fraction", "d").select("aoi", F.col("d").cast("string").alias("d"), rnd(F.col("fraction")).alias("fraction"))


@query("detection_context", f"""WITH {SQL_BANDS}, e AS (SELECT aoi, avg(b8a) AS em, avg(100.0 * scl) AS dp FROM bands WHERE b04 > 0.075 GROUP BY 1),
g AS (SELECT aoi, any_value(em) AS em, any_value(dp) AS dp, avg(b8a) AS bm, 100.0 * count(CASE WHEN b8a < em THEN 1 END) / count(*) AS ap FROM bands JOIN e USING (aoi) WHERE b04 <= 0.075 GROUP BY 1)
SELECT aoi, {r6('em')} AS event_mean, {r6('bm')} AS background_mean, {r6('ap')} AS anomaly_percentile, {r6('em / bm')} AS magnitude_ratio, {r6('least(greatest(1 - dp / 600.0, 0), 1)')} AS bottom_risk FROM g""")
def detection_context(spark, d):
    b = bands(spark, d)
    out = cl.detection_context(b.where(F.col("b04") > 0.075), b.where(F.col("b04") <= 0.075), ["aoi"], "b8a", 100.0 * F.col("scl"))
    return out.select("aoi", *[rnd(F.col(c)).alias(c) for c in out.columns if c != "aoi"])
