"""Queries of the matchup, cross-sensor, exposure, drift and sampling operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions.blocks import spread
from tidemark.functions.geo import bearing_deg, compass, haversine_m
from tidemark.operators.climatology import doy_distance
from tidemark.operators import exposure as ex
from tidemark.operators import matchup as mu
from tidemark.operators import pixels as px_ops
from tidemark.plans.base import query, r6
from tidemark.plans.climatology import FEATS, SQL_DETECT, anomalies, detected
from tidemark.plans.grid import GRID_COLS, n_rows
from tidemark.session import cut_lineage
from tidemark.sources.tables import SQL_BANDS, SQL_SCENES, bands, scenes, table


def rnd(c, digits=6):
    return F.round(c, digits)


EPOCH = "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {})"


def seconds(col):
    return F.expr(EPOCH.format(f"cast({col} as timestamp_ntz)"))


@query("nearest_scenes", f"""WITH e AS (SELECT event_id, user_id, event_type, date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) AS t FROM events)
SELECT r.event_id AS record_id, s.event_id AS scene_id, {r6('(s.t - r.t) / 3600.0')} AS dt_h, CAST(row_number() OVER (PARTITION BY r.event_id ORDER BY abs(s.t - r.t), s.event_id) AS INTEGER) AS rank
FROM e r JOIN e s ON r.user_id = s.user_id AND r.event_type = 'purchase' AND s.event_type = 'view' AND abs(s.t - r.t) <= 24 * 3600""")
def nearest_scenes(spark, d):
    from pyspark.sql import Window
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", seconds("ts").alias("t"))
    rec = e.where(F.col("event_type") == "purchase").select(F.col("event_id").alias("record_id"), "user_id", "t")
    sc = e.where(F.col("event_type") == "view").select(F.col("event_id").alias("scene_id"), "user_id", F.col("t").alias("ts"))
    near = mu.nearest_scenes(rec, sc, ["user_id"], 24.0)
    rank = F.row_number().over(Window.partitionBy("record_id").orderBy(F.abs("dt_h"), "scene_id"))
    return near.select("record_id", "scene_id", rnd(F.col("dt_h")).alias("dt_h"), rank.alias("rank"))


# --- boxes and matchups: customers as records, yearly rasters as scenes ---------------------
SQL_REC = """rec AS (SELECT c_custkey AS record_id, c_nationkey AS station, c_custkey * 3 % (SELECT max(p_partkey) // 50 + 1 FROM part) AS r, c_custkey * 7 % 50 AS c, 788918400 + (c_custkey * 37 % 2400) * 86400 AS t FROM customer),
sc AS (SELECT y AS scene, date_diff('second', TIMESTAMP '1970-01-01', make_timestamp(y, 7, 1, 12, 0, 0)) AS ts FROM (SELECT DISTINCT scene AS y FROM scenes)),
pr AS (SELECT record_id, station, scene, r, c, (ts - t) / 3600.0 AS dt_h FROM rec JOIN sc ON abs(ts - t) <= 7200 * 3600),
bx AS MATERIALIZED (SELECT record_id, any_value(station) AS station, pr.scene, any_value(dt_h) AS dt_h, avg(CAST(coalesce(s.q % 5 < 4, false) AS INTEGER)) AS vf, median(CASE WHEN s.q % 5 < 4 THEN s.q / s.n END) AS med,
 stddev_pop(CASE WHEN s.q % 5 < 4 THEN s.q / s.n END) AS sd, count(CASE WHEN s.q % 5 < 4 THEN 1 END) AS n, record_id % 40 AS dist FROM pr, unnest([-1, 0, 1]) x(dr), unnest([-1, 0, 1]) y(dc) LEFT JOIN scenes s ON s.scene = pr.scene AND s.row = r + dr AND s.col = c + dc GROUP BY record_id, pr.scene),
ev AS (SELECT *, CASE WHEN n > 1 AND med <> 0 THEN sd / abs(med) END AS cv FROM bx), re AS (SELECT *, list_filter([CASE WHEN abs(dt_h) > 5000 THEN '|dt|' END, CASE WHEN vf < 0.5 THEN 'valid' END, CASE WHEN cv IS NULL THEN 'primary' WHEN cv > 0.25 THEN 'box' END, CASE WHEN dist > 30 THEN 'centre-pixel' END,
 CASE WHEN record_id % 9 = 0 THEN 'flag cloud_in_box' END], lambda z: z IS NOT NULL) AS reasons FROM ev)"""


def records(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("record_id"), F.col("c_nationkey").alias("station"), (k * 3 % n_rows(spark, d)).cast("int").alias("row"),
                                              (k * 7 % GRID_COLS).cast("int").alias("col"), (788918400 + (k * 37 % 2400) * 86400).alias("t"))


def evaluated(spark, d, max_dt=5000.0):
    s = scenes(spark, d).withColumn("index", F.col("q") / F.col("n"))
    sc = s.select("scene").distinct().select(F.lit(0).alias("k"), F.col("scene").alias("scene_id"), seconds("make_timestamp_ntz(scene, 7, 1, 12, 0, 0)").alias("ts"))
    near = mu.nearest_scenes(records(spark, d).withColumn("k", F.lit(0)), sc, ["k"], 7200.0)
    asked = near.select("record_id", "station", "dt_h", "row", "col", F.col("scene_id").alias("scene"))
    box = mu.box_extract(asked, s, ["scene"], ["index"], F.col("q") % 5 < 4)
    j = asked.select("record_id", "station", "scene", "dt_h").join(box, ["record_id", "scene"]).withColumn("scene_id", F.col("scene"))
    j = j.withColumns({"distance_m": (F.col("record_id") % 40).cast("double"), "cloud_in_box": F.col("record_id") % 9 == 0})
    return mu.evaluate(j, "index", 30.0, max_dt, 0.5, 0.25, ["cloud_in_box"])


@query("box_extract", f"WITH {SQL_SCENES}, {SQL_REC} SELECT record_id, scene, {r6('vf')} AS valid_frac, {r6('med')} AS index_median, {r6('sd')} AS index_std, n AS index_n FROM bx")
def box_extract(spark, d):
    e = evaluated(spark, d)
    return e.select("record_id", "scene", rnd(F.col("valid_frac")).alias("valid_frac"), rnd(F.col("index_median")).alias("index_median"), rnd(F.col("index_std")).alias("index_std"), "index_n")


@query("matchup_evaluate", f"WITH {SQL_SCENES}, {SQL_REC} SELECT record_id, scene, CAST(len(reasons) = 0 AS INTEGER) AS passed, array_to_string(reasons, ';') AS reasons, {r6('cv')} AS cv FROM re")
def matchup_evaluate(spark, d):
    word = F.transform("reasons", lambda r: F.when(r.startswith("flag"), r).otherwise(F.substring_index(r, " ", 1)))
    return evaluated(spark, d).select("record_id", "scene", F.col("passed").cast("int").alias("passed"), F.array_join(word, ";").alias("reasons"), rnd(F.col("cv_primary")).alias("cv"))


SQL_MATCH = """mt AS (SELECT r.record_id, r.station, b.scene AS scene_id, b.dt_h, coalesce(len(b.reasons) = 0, false) AS passed, coalesce(b.reasons, ['no scene within 7200 h']) AS reasons FROM rec r
LEFT JOIN (SELECT * FROM re QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY len(reasons) = 0 DESC, abs(dt_h), scene) = 1) b USING (record_id))"""


def matched(spark, d):
    return mu.build_matchups(records(spark, d).select("record_id", "station"), evaluated(spark, d), 7200.0, ["valid_frac"])


@query("matchup_build", f"WITH {SQL_SCENES}, {SQL_REC}, {SQL_MATCH} SELECT record_id, scene_id, {r6('dt_h')} AS dt_h, CAST(passed AS INTEGER) AS passed, len(reasons) AS n_reasons FROM mt")
def matchup_build(spark, d):
    return matched(spark, d).select("record_id", "scene_id", rnd(F.col("dt_h")).alias("dt_h"), F.col("passed").cast("int").alias("passed"), F.size("reasons").alias("n_reasons"))


@query("matchup_summary", f"""WITH {SQL_SCENES}, {SQL_REC}, {SQL_MATCH} SELECT count(*) AS n_records, count(CASE WHEN passed THEN 1 END) AS n_passed, count(DISTINCT CASE WHEN passed THEN station END) AS n_stations,
round(count(CASE WHEN passed THEN 1 END) / CAST(count(*) AS DOUBLE), 4) AS pass_rate, {r6('median(CASE WHEN passed THEN abs(dt_h) END)')} AS median_abs_dt_h FROM mt""")
def matchup_summary(spark, d):
    return mu.summary(matched(spark, d)).withColumn("median_abs_dt_h", rnd(F.col("median_abs_dt_h")))


@query("matchup_reasons", f"WITH {SQL_SCENES}, {SQL_REC}, {SQL_MATCH}, u AS (SELECT unnest(reasons) AS r FROM mt) SELECT CASE WHEN r LIKE 'flag%' THEN r ELSE split_part(r, ' ', 1) END AS reason, count(*) AS n FROM u GROUP BY 1")
def matchup_reasons(spark, d):
    return mu.failure_reasons(matched(spark, d))


@query("matchup_sensitivity", f"""WITH {SQL_SCENES}, {SQL_REC}, tol AS (SELECT unnest([1500.0, 3000.0, 5000.0]) AS tol), ok AS (SELECT tol, record_id, min(abs(dt_h)) AS adt FROM re, tol WHERE len(list_filter(reasons, lambda z: z <> '|dt|')) = 0 AND abs(dt_h) <= tol GROUP BY 1, 2)
SELECT CAST(tol AS DOUBLE) AS max_dt_hours, (SELECT count(*) FROM rec) AS n_records, count(*) AS n_passed, {r6('median(adt)')} AS median_abs_dt_h FROM ok GROUP BY 1""")
def matchup_sensitivity(spark, d):
    e = evaluated(spark, d, 7200.0)
    rec = records(spark, d).select("record_id", "station")
    # A tolerance is a filter on the same evaluated pairs: the boxes are read once.
    tol = F.explode(F.array(*[F.lit(t) for t in (1500.0, 3000.0, 5000.0)]))
    swept = e.withColumn("max_dt_hours", tol).where(F.abs("dt_h") <= F.col("max_dt_hours"))
    best = swept.groupBy("max_dt_hours", "record_id").agg(F.min_by(F.struct("passed", "dt_h"), F.struct(~F.col("passed"), F.abs("dt_h"), F.col("scene_id"))).alias("m"))
    out = rec.withColumn("max_dt_hours", tol).join(best, ["max_dt_hours", "record_id"], "left")
    out = out.select("max_dt_hours", "station", F.coalesce("m.passed", F.lit(False)).alias("passed"), F.col("m.dt_h").alias("dt_h"))
    return mu.summary(out, ["max_dt_hours"]).select("max_dt_hours", "n_records", "n_passed", rnd(F.col("median_abs_dt_h")).alias("median_abs_dt_h"))


SQL_GEO = """pt AS (SELECT c_custkey AS k, c_acctbal AS v, 54 + (c_custkey * 37 % 1000) * 0.0031e0 AS lon, 24 + (c_custkey * 91 % 1000) * 0.0017e0 AS lat FROM customer),
ast AS (SELECT s_suppkey AS asset_id, 54 + (s_suppkey * 37 % 100) * 0.031e0 AS alon, 24 + (s_suppkey * 91 % 100) * 0.017e0 AS alat, 0.5 + (s_suppkey % 6) * 0.1e0 AS sens FROM supplier)"""


def points(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("k"), F.col("c_acctbal").alias("v"), (54 + (k * 37 % 1000) * 0.0031).alias("lon"), (24 + (k * 91 % 1000) * 0.0017).alias("lat"))


def asset_points(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("asset_id"), (54 + (k * 37 % 100) * 0.031).alias("alon"), (24 + (k * 91 % 100) * 0.017).alias("alat"), (0.5 + (k % 6) * 0.1).alias("sensitivity"))


@query("footprint_match", f"""WITH {SQL_GEO} SELECT asset_id, count(*) AS n_px, {r6('avg(v)')} AS v FROM ast JOIN pt ON abs(lon - alon) <= 9000.5e0 / (111320.0e0 * cos(radians(alat))) AND abs(lat - alat) <= 9000.5e0 / 111320.0e0 GROUP BY 1 HAVING count(*) >= 5""")
def footprint_match(spark, d):
    coarse = asset_points(spark, d).select("asset_id", F.col("alon").alias("lon"), F.col("alat").alias("lat"))
    return mu.footprint_match(points(spark, d), coarse, ["asset_id"], ["v"], 9000.5, 5).withColumn("v", rnd(F.col("v")))


SQL_CONTRAST = """v AS (SELECT aoi, year(d) * 100 + month(d) AS ym, b04 > 0.07 AS reg, b04 > 0.06 AS near, CASE WHEN b04 > 0.07 THEN b05 * 100 * (0.7 + (year(d) + month(d)) % 7 * 0.2e0) ELSE b05 * 100 END AS v FROM bands),
g AS (SELECT aoi, ym, count(CASE WHEN reg THEN 1 END) AS nr, count(CASE WHEN NOT near THEN 1 END) AS nb, median(CASE WHEN reg THEN v END) AS rm, median(CASE WHEN NOT near THEN v END) AS bm FROM v GROUP BY 1, 2),
ct AS (SELECT *, CASE WHEN nr >= 8 AND nb >= 30 THEN CASE WHEN (rm / bm >= 1.5 AND rm >= 2) OR rm >= 10 THEN 1 WHEN rm / bm <= 1.15 AND rm < 5 THEN 0 END END AS y, CASE WHEN nr >= 8 AND nb >= 30 THEN rm / bm END AS ratio,
 CASE WHEN nr < 8 OR nb < 30 THEN 'too few valid pixels' WHEN (rm / bm >= 1.5 AND rm >= 2) OR rm >= 10 OR (rm / bm <= 1.15 AND rm < 5) THEN NULL ELSE 'ambiguous contrast' END AS reason FROM g)"""


def contrast(spark, d):
    b = bands(spark, d).withColumn("ym", F.year("d") * 100 + F.month("d"))
    region = F.col("b04") > 0.07
    v = F.when(region, F.col("b05") * 100 * (0.7 + (F.year("d") + F.month("d")) % 7 * 0.2)).otherwise(F.col("b05") * 100)
    return mu.contrast_label(b.select("aoi", "ym", "b04", v.alias("v")), ["aoi", "ym"], "v", region, F.col("b04") > 0.06)


@query("region_contrast_label", f"WITH {SQL_BANDS}, {SQL_CONTRAST} SELECT aoi, CAST(ym AS INTEGER) AS ym, nr AS n_region, nb AS n_background, {r6('rm', 8)} AS region_median, {r6('bm', 8)} AS background_median, {r6('ratio')} AS ratio, y, reason FROM ct")
def region_contrast_label(spark, d):
    return contrast(spark, d).withColumns({"region_median": rnd(F.col("region_median"), 8), "background_median": rnd(F.col("background_median"), 8), "ratio": rnd(F.col("ratio"))})


@query("crosscheck_best", f"""WITH {SQL_BANDS}, n AS (SELECT aoi, ln, count(CASE WHEN b04 > 0.07 THEN 1 END) AS nr FROM bands GROUP BY 1, 2), b AS (SELECT aoi, arg_min(ln, (-nr, ln)) AS ln FROM n GROUP BY 1),
g AS (SELECT aoi, ln, count(CASE WHEN b04 > 0.07 THEN 1 END) AS nr, median(CASE WHEN b04 > 0.07 THEN b05 * 100 END) AS rm, median(CASE WHEN b04 <= 0.06 THEN b05 * 100 END) AS bm FROM bands JOIN b USING (aoi, ln) GROUP BY 1, 2)
SELECT aoi, ln AS granule, nr AS n_region, {r6('rm / bm')} AS ratio, CASE WHEN (rm / bm >= 1.5 AND rm >= 2) OR rm >= 10 THEN 1 WHEN rm / bm <= 1.15 AND rm < 5 THEN 0 END AS agrees, {r6('(ln - 4) * 17.5')} AS dt_minutes FROM g""")
def crosscheck_best(spark, d):
    b = bands(spark, d)
    region = F.col("b04") > 0.07
    best = mu.best_granule(b, ["aoi"], "ln", region)
    chosen = b.join(best, ["aoi", "ln"], "left_semi").select("aoi", "ln", "b04", (F.col("b05") * 100).alias("v"))
    c = mu.contrast_label(chosen, ["aoi", "ln"], "v", region, F.col("b04") > 0.06)
    return c.select("aoi", F.col("ln").alias("granule"), "n_region", rnd(F.col("ratio")).alias("ratio"), F.col("y").alias("agrees"), rnd((F.col("ln") - 4) * 17.5).alias("dt_minutes"))


SQL_SEED = """cd AS (SELECT o_orderkey AS label, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 2 = 0 THEN 'BLOOM_LIKE' ELSE 'SEDIMENT_LIKE' END AS hyp, CASE o_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' ELSE 'Z' END AS aoi FROM orders),
sl AS (SELECT cd.*, y, CASE WHEN g.aoi IS NULL THEN 'no granule' ELSE reason END AS why FROM cd LEFT JOIN ct g ON g.aoi = cd.aoi AND g.ym = year(cd.d) * 100 + month(cd.d))"""


def seeded(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("label"), F.to_date("o_orderdate").alias("d"), F.when(F.col("o_orderkey") % 2 == 0, "BLOOM_LIKE").otherwise("SEDIMENT_LIKE").alias("hyp"),
                                         F.element_at(F.array(*[F.lit(x) for x in "ANRZ"]), (F.col("o_custkey") % 4 + 1).cast("int")).alias("aoi"))
    o = o.withColumn("ym", F.year("d") * 100 + F.month("d"))
    return mu.seed_labels(o, contrast(spark, d), ["aoi", "ym"], "aoi", F.col("d"), F.col("hyp"), F.col("label"))


@query("seed_labels", f"""WITH {SQL_BANDS}, {SQL_CONTRAST}, {SQL_SEED} SELECT 'LB-S3-' || substr(sha256(aoi || '|' || CAST(d AS VARCHAR) || '|' || hyp || '|' || CAST(label AS VARCHAR)), 1, 10) AS label_id,
aoi || '|' || substr(CAST(d AS VARCHAR), 1, 7) AS group_key, y, CASE WHEN y = 1 THEN hyp ELSE 'NOT_CONFIRMED' END AS class, 0.5e0 AS weight FROM sl WHERE y IS NOT NULL""")
def seed_labels(spark, d):
    return seeded(spark, d).where(F.col("y").isNotNull()).select("label_id", "group_key", "y", "class", "weight")


@query("seed_label_reasons", f"WITH {SQL_BANDS}, {SQL_CONTRAST}, {SQL_SEED} SELECT aoi, why AS reason, count(*) AS n FROM sl WHERE y IS NULL GROUP BY 1, 2")
def seed_label_reasons(spark, d):
    return seeded(spark, d).where(F.col("y").isNull()).groupBy("aoi", "reason").agg(F.count(F.lit(1)).alias("n"))


def sql_haversine(a, b, c, d):
    return f"2 * 6371000e0 * asin(sqrt(least(1, pow(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2))))"


def sql_bearing(a, b, c, d):
    return (f"((degrees(atan2(sin(radians({c} - {a})) * cos(radians({d})), cos(radians({b})) * sin(radians({d})) - sin(radians({b})) * cos(radians({d})) * cos(radians({c} - {a})))) + 360) % 360)")


SQL_COMPASS = "(['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW'])[CAST(floor((({b}) + 11.25) % 360 / 22.5) AS INTEGER) + 1]"


@query("haversine", f"WITH {SQL_GEO} SELECT k, {r6(sql_haversine('lon', 'lat', '55.3e0', '24.9e0'), 3)} AS distance_m FROM pt")
def haversine(spark, d):
    return points(spark, d).select("k", rnd(haversine_m(F.col("lon"), F.col("lat"), F.lit(55.3), F.lit(24.9)), 3).alias("distance_m"))


@query("bearing", f"WITH {SQL_GEO}, b AS (SELECT k, {sql_bearing('lon', 'lat', '55.3e0', '24.9e0')} AS b FROM pt) SELECT k, {r6('b')} AS bearing_deg, {SQL_COMPASS.format(b='b')} AS direction FROM b")
def bearing(spark, d):
    b = bearing_deg(F.col("lon"), F.col("lat"), F.lit(55.3), F.lit(24.9))
    return points(spark, d).select("k", rnd(b).alias("bearing_deg"), compass(b).alias("direction"))


@query("compass", f"WITH {SQL_GEO} SELECT k, {SQL_COMPASS.format(b='(k * 7.5e0) % 360')} AS direction FROM pt")
def compass_points(spark, d):
    return points(spark, d).select("k", compass(F.col("k") * 7.5 % 360).alias("direction"))


RADIUS = 12_000.0
SQL_PAIRS = f"prs AS MATERIALIZED (SELECT k AS event_id, v, lon, lat, asset_id, alon, alat, sens, {sql_haversine('lon', 'lat', 'alon', 'alat')} AS dist FROM pt JOIN ast ON abs(lat - alat) < 0.2 AND abs(lon - alon) < 0.2 WHERE {sql_haversine('lon', 'lat', 'alon', 'alat')} <= {RADIUS})"


#: Reach of the nearest assets, as the reference asks for them; their box spans it at any latitude up to 26 degrees.
NEAR = 40_000.0
SQL_NEAR = f"near AS MATERIALIZED (SELECT k AS event_id, asset_id, {sql_haversine('lon', 'lat', 'alon', 'alat')} AS dist FROM pt JOIN ast ON abs(lat - alat) < 0.37 AND abs(lon - alon) < 0.41 WHERE {sql_haversine('lon', 'lat', 'alon', 'alat')} <= {NEAR})"


@query("nearest_asset_join", f"WITH {SQL_GEO}, {SQL_NEAR} SELECT event_id, asset_id, {r6('dist', 3)} AS distance_m, CAST(row_number() OVER (PARTITION BY event_id ORDER BY dist, asset_id) AS INTEGER) AS rank FROM near")
def nearest_asset_join(spark, d):
    def ranked(places):
        near = ex.nearest_assets(places, asset_points(spark, d), NEAR)
        return near.select("event_id", "asset_id", rnd(F.col("distance_m"), 3).alias("distance_m"), "rank")
    return ex.once_for_alike(points(spark, d).withColumnRenamed("k", "event_id"), ["lon", "lat"], ranked)


SQL_TRACK = "trk AS (SELECT k AS event_id, CAST(h AS INTEGER) AS hours, lon + h * 0.002e0 * (p - 2) + h * 0.0015e0 AS plon, lat + h * 0.001e0 * (k % 5 - 2) + 0.003e0 * p AS plat, lon AS lon0, lat AS lat0, (k + p + h) % 7 <> 0 AS active FROM pt, unnest([0, 6, 12, 24]) a(h), unnest([0, 1, 2, 3, 4]) b(p))"


def track(spark, d):
    p = spread(points(spark, d).select(F.col("k").alias("event_id"), "lon", "lat"), ["event_id"], 20)
    p = p.select("*", F.explode(F.array(*[F.lit(h) for h in (0, 6, 12, 24)])).alias("hours"))
    p = p.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return p.select("event_id", "hours", (F.col("lon") + F.col("hours") * 0.002 * (F.col("p") - 2) + F.col("hours") * 0.0015).alias("plon"),
                    (F.col("lat") + F.col("hours") * 0.001 * (F.col("event_id") % 5 - 2) + 0.003 * F.col("p")).alias("plat"), F.col("lon").alias("lon0"), F.col("lat").alias("lat0"),
                    ((F.col("event_id") + F.col("p") + F.col("hours")) % 7 != 0).alias("active"))


@query("exposure_assess", f"""WITH {SQL_GEO}, {SQL_PAIRS}, {SQL_TRACK}, st AS (SELECT event_id, asset_id, hours, min(dd) AS dmin, avg(CAST(dd <= 2000 AS INTEGER)) AS fr FROM (SELECT event_id, asset_id, hours, {sql_haversine('plon', 'plat', 'alon', 'alat')} AS dd FROM prs JOIN trk USING (event_id)) GROUP BY 1, 2, 3),
pa AS (SELECT event_id, asset_id, min(dmin) AS cl, arg_min(hours, (dmin, hours)) AS ch, min(CASE WHEN fr > 0.01 AND hours > 0 THEN hours END) AS eta FROM st GROUP BY 1, 2)
SELECT event_id, asset_id, {r6('dist', 3)} AS distance_m, {r6('least(cl, dist)', 3)} AS closest_approach_m, CASE WHEN cl < dist THEN CAST(ch AS DOUBLE) ELSE 0e0 END AS closest_approach_hours, eta AS eta_hours, CAST(eta IS NOT NULL AS INTEGER) AS intersects, {SQL_COMPASS.format(b=sql_bearing('lon', 'lat', 'alon', 'alat'))} AS direction,
{r6('least(greatest(exp(-least(cl, dist) / 5000) * CASE WHEN eta IS NOT NULL THEN 1.0 ELSE 0.35 END * sens, 0), 1)')} AS exposure_score FROM prs JOIN pa USING (event_id, asset_id)""")
def exposure_assess(spark, d):
    particles = track(spark, d).select("event_id", "hours", "plon", "plat")
    events = ex.with_track(points(spark, d).select(F.col("k").alias("event_id"), "lon", "lat"), particles)

    def exposed(places):
        places = cut_lineage(places)
        moved = particles.join(places.select("event_id").hint("merge"), "event_id", "left_semi")
        return exposure_columns(ex.assess(ex.asset_pairs(places.drop("track"), asset_points(spark, d), RADIUS), moved, F.lit(2000.0)))
    return ex.once_for_alike(cut_lineage(events), ["lon", "lat", "track"], exposed)


def exposure_columns(out):
    return out.select("event_id", "asset_id", rnd(F.col("distance_m"), 3).alias("distance_m"), rnd(F.col("closest_approach_m"), 3).alias("closest_approach_m"), "closest_approach_hours", "eta_hours",
                      F.col("intersects").cast("int").alias("intersects"), "direction", rnd(F.col("exposure_score")).alias("exposure_score"))


@query("track_spread", f"""WITH {SQL_GEO}, {SQL_TRACK}, c AS (SELECT event_id, hours, any_value(lon0) AS a, any_value(lat0) AS b, avg(plon) AS x, avg(plat) AS y, 1 - avg(CAST(active AS INTEGER)) AS be FROM trk GROUP BY 1, 2),
m AS (SELECT c.*, 111320e0 * cos(radians(b)) AS mx FROM c), s AS (SELECT m.event_id, m.hours, sqrt(avg(pow((plon - x) * mx, 2) + pow((plat - y) * 110574e0, 2))) AS sp FROM m JOIN trk USING (event_id, hours) GROUP BY 1, 2)
SELECT event_id, hours, {r6('x')} AS centroid_lon, {r6('y')} AS centroid_lat, {r6('sqrt(pow((x - a) * mx, 2) + pow((y - b) * 110574e0, 2))', 3)} AS displacement_m, {r6('sp', 3)} AS spread_radius_m, {r6('be')} AS beached_fraction,
{r6('CASE WHEN hours > 0 THEN (degrees(atan2((x - a) * mx, (y - b) * 110574e0)) + 360) % 360 END', 4)} AS bearing_deg FROM m JOIN s USING (event_id, hours)""")
def track_spread(spark, d):
    out = ex.track_spread(track(spark, d), ["event_id"], "lon0", "lat0", "active")
    return out.select("event_id", "hours", rnd(F.col("centroid_lon")).alias("centroid_lon"), rnd(F.col("centroid_lat")).alias("centroid_lat"), rnd(F.col("displacement_m"), 3).alias("displacement_m"),
                      rnd(F.col("spread_radius_m"), 3).alias("spread_radius_m"), rnd(F.col("beached_fraction")).alias("beached_fraction"), rnd(F.when(F.col("hours") > 0, F.col("bearing_deg")), 4).alias("bearing_deg"))


T = math.radians(-15.0)
CT, ST = repr(math.cos(T)), repr(math.sin(T))
SQL_WIND = f"""w0 AS (SELECT event_id, user_id, ts, value / 10 AS sp, CAST(json_extract(props, '$.k') AS DOUBLE) * 3.6e0 AS dir FROM events), w1 AS (SELECT *, -sp * sin(radians(dir)) AS u, -sp * cos(radians(dir)) AS v FROM w0),
w2 AS (SELECT *, 0.03e0 * (u * ({CT}) - v * ({ST})) AS du, 0.03e0 * (u * ({ST}) + v * ({CT})) AS dv FROM w1)"""


def wind(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("value") / 10).alias("speed"), (F.get_json_object("props", "$.k").cast("double") * 3.6).alias("dir"))
    u, v = ex.wind_components(F.col("speed"), F.col("dir"))
    du, dv = ex.surface_drift(u, v)
    return e.withColumns({"u": u, "v": v, "du": du, "dv": dv})


@query("surface_drift", f"WITH {SQL_WIND} SELECT event_id, {r6('u')} AS u, {r6('v')} AS v, {r6('du')} AS du, {r6('dv')} AS dv FROM w2")
def surface_drift(spark, d):
    return wind(spark, d).select("event_id", *[rnd(F.col(c)).alias(c) for c in ("u", "v", "du", "dv")])


SQL_DRIFT = f"""{SQL_WIND}, hr AS MATERIALIZED (SELECT user_id % 3 AS pt, CAST(date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS BIGINT) AS h, avg(du) AS du, avg(dv) AS dv FROM w2 GROUP BY 1, 2),
st AS (SELECT a.pt, a.h, hz, any_value(a.du) AS du, any_value(a.dv) AS dv, sum(b.du) * 3600 AS x, sum(b.dv) * 3600 AS y FROM hr a, unnest([6, 12, 24, 48]) z(hz) JOIN hr b ON b.pt = a.pt AND b.h BETWEEN a.h AND a.h + hz - 1 WHERE a.h % 6 = 0 AND a.h < (SELECT max(m.h) FROM hr m WHERE m.pt = a.pt) + 1 - 48
 AND (SELECT count(*) FROM hr c WHERE c.pt = a.pt AND c.h BETWEEN a.h AND a.h + 47) = 48 GROUP BY 1, 2, 3),
dp AS (SELECT pt, h, hz, unnest(['displacement', 'persistence_error']) AS measure, unnest([sqrt(x * x + y * y), sqrt(pow(x - du * 3600 * hz, 2) + pow(y - dv * 3600 * hz, 2))]) / 1000 AS km FROM st)"""


SEASON_CENTRE, SEASON_DAYS = 12, 6


@query("drift_bounds", f"WITH {SQL_DRIFT}, vw AS (SELECT *, 'all_year' AS view FROM dp UNION ALL SELECT *, 'season' FROM dp WHERE least(abs(dayofyear(TIMESTAMP '2024-01-01' + h * INTERVAL 1 HOUR) - {SEASON_CENTRE}), 365 - abs(dayofyear(TIMESTAMP '2024-01-01' + h * INTERVAL 1 HOUR) - {SEASON_CENTRE})) <= {SEASON_DAYS}) SELECT pt, view, hz AS horizon_h, measure, count(*) AS n, {r6('median(km)')} AS median_km, {r6('quantile_cont(km, 0.9)')} AS p90_km, {r6('quantile_cont(km, 0.95)')} AS p95_km, {r6('max(km)')} AS max_km FROM vw GROUP BY 1, 2, 3, 4")
def drift_bounds(spark, d):
    h = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    hourly = wind(spark, d).groupBy((F.col("user_id") % 3).alias("pt"), h.alias("h")).agg(F.avg("du").alias("du"), F.avg("dv").alias("dv"))
    day = F.dayofyear(F.timestamp_add("HOUR", F.col("h"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    out = ex.drift_bounds(ex.drift_starts(hourly, ["pt"]), ["pt"], doy_distance(day, F.lit(SEASON_CENTRE)) <= SEASON_DAYS)
    return out.select("pt", "view", "horizon_h", "measure", "n", *[rnd(F.col(c)).alias(c) for c in ("median_km", "p90_km", "p95_km", "max_km")])


_H = sql_haversine
SQL_PLAN = f"""wp AS MATERIALIZED (SELECT an.scene, an.row, an.col, 54 + an.col * 0.01e0 AS lon, 24 + an.row * 0.01e0 AS lat, an.z_ndci AS score, rp.label IS NOT NULL AS ev, an.row % 10 * 120 AS shore FROM an LEFT JOIN rp USING (scene, row, col)),
p1 AS (SELECT * FROM wp WHERE ev AND score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scene ORDER BY score DESC, row, col) = 1),
p2a AS (SELECT * FROM wp WHERE ev QUALIFY row_number() OVER (PARTITION BY scene ORDER BY {_H('lon', 'lat', '54.35e0', '24.05e0')}, row, col) = 1),
p2 AS (SELECT p2a.* FROM p2a JOIN p1 USING (scene) WHERE {_H('p2a.lon', 'p2a.lat', 'p1.lon', 'p1.lat')} >= 3000),
pre AS (SELECT scene, lon, lat FROM p1 UNION ALL SELECT scene, lon, lat FROM p2), p3 AS (SELECT w.* FROM wp w WHERE w.scene IN (SELECT scene FROM p1) AND NOT EXISTS (SELECT 1 FROM pre WHERE pre.scene = w.scene AND {_H('w.lon', 'w.lat', 'pre.lon', 'pre.lat')} < 3000) QUALIFY row_number() OVER (PARTITION BY scene ORDER BY {_H('w.lon', 'w.lat', '54.1e0', '24.3e0')}, row, col) = 1),
pr3 AS (SELECT * FROM pre UNION ALL SELECT scene, lon, lat FROM p3), p4 AS (SELECT w.* FROM wp w WHERE w.scene IN (SELECT scene FROM p1) AND NOT ev AND score IS NOT NULL AND shore > 800 AND NOT EXISTS (SELECT 1 FROM pr3 WHERE pr3.scene = w.scene AND {_H('w.lon', 'w.lat', 'pr3.lon', 'pr3.lat')} < 3000) QUALIFY row_number() OVER (PARTITION BY scene ORDER BY score, row, col) = 1),
lm AS (SELECT scene, quantile_cont(score, 0.85) AS lo, quantile_cont(score, 0.97) AS hi FROM wp GROUP BY 1), mg AS (SELECT wp.*, row_number() OVER (PARTITION BY scene ORDER BY row, col) - 1 AS i, count(*) OVER (PARTITION BY scene) AS n FROM wp JOIN lm USING (scene) WHERE score BETWEEN lo AND hi AND NOT ev AND shore < 300),
pr4 AS (SELECT * FROM pr3 UNION ALL SELECT scene, lon, lat FROM p4), p5 AS (SELECT m.* FROM mg m WHERE i = n // 2 AND m.scene IN (SELECT scene FROM p1) AND NOT EXISTS (SELECT 1 FROM pr4 WHERE pr4.scene = m.scene AND {_H('m.lon', 'm.lat', 'pr4.lon', 'pr4.lat')} < 3000)),
al AS (SELECT scene, row, col, score, 'EVENT_CORE' AS role, 1 AS priority, 0 AS o FROM p1 UNION ALL SELECT scene, row, col, score, 'LEADING_EDGE', 2, 1 FROM p2 UNION ALL SELECT scene, row, col, score, 'ASSET_BOUNDARY', 1, 2 FROM p3 UNION ALL SELECT scene, row, col, score, 'BACKGROUND_CONTROL', 2, 3 FROM p4 UNION ALL SELECT scene, row, col, score, 'UNCERTAINTY_POINT', 3, 4 FROM p5)"""


@query("sampling_plan", f"WITH RECURSIVE {SQL_DETECT}, {SQL_PLAN} SELECT scene, printf('S%02d', row_number() OVER (PARTITION BY scene ORDER BY priority, o)) AS sample_id, role, priority, row, col, {r6('score')} AS score FROM al")
def sampling_plan(spark, d):
    st, _, region = detected(spark, d, {"ndci": FEATS["ndci"]})
    px = anomalies(st, {"ndci": FEATS["ndci"]}).join(region.select("scene", "row", "col", F.lit(True).alias("in_event")), ["scene", "row", "col"], "left")
    px = px.select("scene", "row", "col", (54 + F.col("col") * 0.01).alias("lon"), (24 + F.col("row") * 0.01).alias("lat"), F.col("ndci_z").alias("score"),
                   F.coalesce("in_event", F.lit(False)).alias("in_event"), (F.col("row") % 10 * 120).alias("shore_m"))
    t = region.select("scene").distinct().select("scene", F.lit(54.35).alias("drift_lon"), F.lit(24.05).alias("drift_lat"), F.lit(54.1).alias("asset_lon"), F.lit(24.3).alias("asset_lat"))
    out = ex.sampling_plan(px, t, ["scene"], 3000.0)
    return out.select("scene", "sample_id", "role", "priority", "row", "col", rnd(F.col("score")).alias("score"))


@query("band_agreement", f"""WITH {SQL_BANDS}, s AS (SELECT ln % 2 AS surface, CAST(floor(px / 20) AS BIGINT) AS cell, band, side, v FROM (SELECT ln, px, 'b03' AS band, scl % 2 AS side, b03 AS v FROM bands UNION ALL SELECT ln, px, 'b8a', scl % 2, b8a FROM bands)),
c AS (SELECT surface, band, cell, avg(CASE WHEN side = 0 THEN v END) AS x, avg(CASE WHEN side = 1 THEN v END) AS y FROM s GROUP BY 1, 2, 3 HAVING count(CASE WHEN side = 0 THEN 1 END) >= 4 AND count(CASE WHEN side = 1 THEN 1 END) >= 4)
SELECT surface, band, count(*) AS n, {r6('avg(x - y)')} AS bias, {r6('sqrt(avg((x - y) * (x - y)))')} AS rmse, {r6('avg(abs(x - y))')} AS mae, {r6('100 * sqrt(avg((x - y) * (x - y))) / avg(abs(y))', 4)} AS relative_rmse_pct, {r6('1 - sum((x - y) * (x - y)) / (var_pop(y) * count(*))', 4)} AS r2_1to1,
{r6('corr(x, y)')} AS pearson_r, {r6('regr_slope(y, x)')} AS slope, {r6('regr_intercept(y, x)')} AS intercept FROM c GROUP BY 1, 2 HAVING count(*) >= 10""")
def band_agreement(spark, d):
    b = bands(spark, d).select((F.col("ln") % 2).alias("surface"), F.floor(F.col("px") / 20).alias("cell"), (F.col("scl") % 2).alias("side"), "b03", "b8a")
    b = b.unpivot(["surface", "cell", "side"], ["b03", "b8a"], "band", "v")
    out = mu.band_agreement(b.where("side = 0"), b.where("side = 1"), ["surface", "band"], ["cell"], "v")
    return out.select("surface", "band", "n", *[rnd(F.col(c), 4 if c in ("relative_rmse_pct", "r2_1to1") else 6).alias(c) for c in out.columns[3:]])
