"""Queries of the raster neighbourhood and region operators (one raster per year)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import grid, pixels
from tidemark.plans.base import query, r6
from tidemark.session import cut_lineage
from tidemark.sources.tables import GRID_COLS, SQL_BANDS, SQL_SCENES, bands, scenes, table

K = ["scene"]
MASK = "m AS MATERIALIZED (SELECT scene, row, col, row * 50 + col AS id FROM scenes WHERE q % 5 < 3)"
SHAPE = "shape AS MATERIALIZED (SELECT CAST(max(p_partkey) // 50 + 1 AS INTEGER) AS nr, 50 AS nc FROM part)"


def n_rows(spark, d) -> int:
    """Raster height: one number from the cell table."""
    return table(spark, d, "part").agg(F.max(F.floor(F.col("p_partkey") / GRID_COLS)) + 1).first()[0]


def mask(spark, d):
    return scenes(spark, d).where(F.col("q") % 5 < 3).select("scene", "row", "col")


def sql_diamond(k):
    cells = [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1) if abs(i) + abs(j) <= k]
    return f"o{k}(dr, dc) AS (VALUES {', '.join(str(c) for c in cells)})", len(cells)


def sql_erode(name, src, k):
    values, n = sql_diamond(k)
    return (f"{values}, {name} AS MATERIALIZED (SELECT a.scene, a.row, a.col FROM {src} a, o{k} JOIN {src} b ON "
            f"b.scene = a.scene AND b.row = a.row + dr AND b.col = a.col + dc GROUP BY 1, 2, 3 HAVING count(*) = {n})")


def sql_dilate(name, src, k, with_values=True):
    values, _ = sql_diamond(k)
    return ((values + ", " if with_values else "")
            + f"{name} AS MATERIALIZED (SELECT DISTINCT a.scene, a.row + dr AS row, a.col + dc AS col FROM {src} a, o{k}, shape "
              f"WHERE a.row + dr BETWEEN 0 AND nr - 1 AND a.col + dc BETWEEN 0 AND nc - 1)")


@query("erode", f"WITH {SQL_SCENES}, m AS MATERIALIZED (SELECT scene, row, col FROM scenes WHERE q % 17 < 16), {sql_erode('e', 'm', 2)} SELECT scene, row, col FROM e")
def erode(spark, d):
    return grid.erode(scenes(spark, d).where(F.col("q") % 17 < 16), K, 2)


@query("dilate", f"WITH {SQL_SCENES}, {MASK}, {SHAPE}, s AS (SELECT scene, row, col FROM scenes WHERE q % 29 = 0), {sql_dilate('g', 's', 3)} SELECT scene, row, col FROM g")
def dilate(spark, d):
    m = scenes(spark, d).where(F.col("q") % 29 == 0).select("scene", "row", "col")
    return grid.dilate(m, K, 3, n_rows(spark, d), GRID_COLS)


@query("opening", f"WITH {SQL_SCENES}, {MASK}, {SHAPE}, {sql_erode('e', 'm', 1)}, {sql_dilate('g', 'e', 1, False)} SELECT scene, row, col FROM g")
def opening(spark, d):
    return grid.opening(mask(spark, d), K, 1, n_rows(spark, d), GRID_COLS)


@query("closing", f"WITH {SQL_SCENES}, {MASK}, {SHAPE}, {sql_dilate('g', 'm', 1)}, {sql_erode('e', 'g', 1).replace(sql_diamond(1)[0] + ', ', '')} SELECT e.scene, e.row, e.col FROM e JOIN scenes USING (scene, row, col)")
def closing(spark, d):
    allowed = scenes(spark, d)
    return grid.closing(mask(spark, d), K, 1, n_rows(spark, d), GRID_COLS, allowed)


def sql_components(src, name="cc"):
    """Labels by spreading the smallest pixel index along the four neighbours."""
    sides = " UNION ALL ".join(
        f"SELECT a.scene, a.id AS a, b.id AS b FROM {src} a JOIN {src} b ON b.scene = a.scene AND b.row = a.row + {dr} AND b.col = a.col + {dc}"
        for dr, dc in ((0, 1), (0, -1), (1, 0), (-1, 0)))
    return (f"{name}_e AS MATERIALIZED ({sides}), {name}(scene, id, lbl) USING KEY (scene, id) AS (SELECT scene, id, id FROM {src} UNION "
            f"SELECT n.scene, n.id, min(c.lbl) FROM {name} c JOIN {name}_e e ON e.scene = c.scene AND e.a = c.id "
            f"JOIN recurring.{name} n ON n.scene = e.scene AND n.id = e.b WHERE c.lbl < n.lbl GROUP BY n.scene, n.id)")


CC = f"WITH RECURSIVE {SQL_SCENES}, {MASK}, {sql_components('m')}"
LAB = "lab AS (SELECT scene, id // 50 AS row, id % 50 AS col, lbl AS label FROM cc)"


def labelled(spark, d):
    return grid.connected_components(mask(spark, d), K, GRID_COLS)


@query("connected_components", f"{CC} SELECT scene, CAST(id // 50 AS INTEGER) AS row, CAST(id % 50 AS INTEGER) AS col, CAST(lbl AS BIGINT) AS label FROM cc")
def connected_components(spark, d):
    return labelled(spark, d)


@query("component_filter", f"{CC} SELECT scene, CAST(id // 50 AS INTEGER) AS row, CAST(id % 50 AS INTEGER) AS col FROM cc JOIN (SELECT scene, lbl FROM cc GROUP BY 1, 2 HAVING count(*) >= 25) USING (scene, lbl)")
def component_filter(spark, d):
    return grid.component_filter(mask(spark, d), K, GRID_COLS, 25).select("scene", "row", "col")


@query("region_stats", f"""{CC}, {LAB} SELECT scene, CAST(label AS BIGINT) AS label, count(*) AS n_px, {r6('count(*) * 0.0004e0')} AS area_km2,
{r6('avg(row)')} AS centroid_row, {r6('avg(col)')} AS centroid_col, min(row) AS row0, min(col) AS col0, max(row) AS row1, max(col) AS col1,
{r6('avg(q)')} AS mean_score, {r6('max(q)')} AS max_score, {r6('min(disc)')} AS min_p,
CAST(rank() OVER (PARTITION BY scene ORDER BY count(*) DESC) AS INTEGER) AS size_rank
FROM lab JOIN scenes USING (scene, row, col) GROUP BY scene, label HAVING count(*) >= 5""")
def region_stats(spark, d):
    px = labelled(spark, d).join(scenes(spark, d), ["scene", "row", "col"])
    s = grid.region_stats(px, K, 20.0, "q", "disc", min_px=5)
    from pyspark.sql import Window
    rank = F.rank().over(Window.partitionBy("scene").orderBy(F.col("n_px").desc()))
    return s.withColumn("size_rank", rank).select(
        "scene", "label", "n_px", "row0", "col0", "row1", "col1", "size_rank",
        *[F.round(c, 6).alias(c) for c in ("area_km2", "centroid_row", "centroid_col", "mean_score", "max_score", "min_p")])


@query("region_near_or_large", f"""{CC}, {LAB}, r AS (SELECT scene, label, count(*) AS n_px,
  max(CAST(row BETWEEN 10 - 4 AND 10 + 3 AND col BETWEEN 20 - 4 AND 20 + 3 AS INTEGER)) AS near FROM lab GROUP BY 1, 2),
b AS (SELECT scene, max(CAST(near = 1 OR n_px >= 200 AS INTEGER)) AS any_, max_by(label, n_px * 1000000 - label) AS big FROM r GROUP BY 1)
SELECT scene, CAST(label AS BIGINT) AS label, n_px, near FROM r JOIN b USING (scene) WHERE near = 1 OR n_px >= 200 OR (any_ = 0 AND label = big)""")
def region_near_or_large(spark, d):
    return grid.near_or_large(labelled(spark, d), K, F.lit(10), F.lit(20), 4, 200)


@query("region_boundary", f"""{CC}, {LAB}, s AS (SELECT l.scene, l.label, (SELECT count(*) FROM (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dr, dc)
  WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.scene = l.scene AND m.row = l.row + dr AND m.col = l.col + dc)) AS free FROM lab l)
SELECT scene, CAST(label AS BIGINT) AS label, CAST(sum(free) AS BIGINT) AS boundary_edges, count(*) AS n_px, {r6('sum(free) * 20.0')} AS perimeter_m,
  {r6('count(*) * 400.0')} AS area_m2 FROM s GROUP BY 1, 2""")
def region_boundary(spark, d):
    out = grid.region_boundary(labelled(spark, d), K, 20.0)
    return out.withColumns({"perimeter_m": F.round("perimeter_m", 6), "area_m2": F.round("area_m2", 6)})


GRID_CELLS = "cells AS (SELECT s.scene, r.row, c.col FROM (SELECT DISTINCT scene FROM scenes) s, shape, unnest(generate_series(0, nr - 1)) r(row), unnest(generate_series(0, nc - 1)) c(col))"
FILL_MASK = "m AS MATERIALIZED (SELECT scene, row, col FROM scenes WHERE q % 4 < 3)"


@query("fill_holes", f"""WITH RECURSIVE {SQL_SCENES}, {FILL_MASK}, {SHAPE}, {GRID_CELLS},
bg AS MATERIALIZED (SELECT scene, row, col, row * 50 + col AS id FROM cells ANTI JOIN m USING (scene, row, col)), {sql_components('bg', 'bc')},
open_ AS (SELECT DISTINCT scene, lbl FROM bc, shape WHERE id // 50 IN (0, nr - 1) OR id % 50 IN (0, nc - 1))
SELECT scene, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM m UNION ALL
SELECT scene, CAST(id // 50 AS INTEGER), CAST(id % 50 AS INTEGER) FROM bc ANTI JOIN open_ USING (scene, lbl)""")
def fill_holes(spark, d):
    s = scenes(spark, d)
    grids = s.select("scene").distinct().withColumns({"n_rows": F.lit(n_rows(spark, d)).cast("int"), "n_cols": F.lit(GRID_COLS)})
    return grid.fill_holes(s.where(F.col("q") % 4 < 3), grids, K, GRID_COLS)


SEA = "m AS MATERIALIZED (SELECT scene, row, col FROM scenes WHERE q % 17 < 16)"
SQL_DIST = f"""{SHAPE}, {GRID_CELLS}, land AS MATERIALIZED (SELECT scene, row, col FROM cells ANTI JOIN m USING (scene, row, col)),
dist AS (SELECT m.scene, m.row, m.col, sqrt(min(pow(m.row - l.row, 2) + pow(m.col - l.col, 2))) AS dist_px FROM m JOIN land l ON l.scene = m.scene
 AND l.row BETWEEN m.row - 20 AND m.row + 20 GROUP BY 1, 2, 3)"""


def sea_distance(spark, d):
    sea = scenes(spark, d).where(F.col("q") % 17 < 16)
    return grid.distance_transform(sea, K, n_rows(spark, d), GRID_COLS)


@query("distance_transform", f"WITH {SQL_SCENES}, {SEA}, {SQL_DIST} SELECT scene, row, col, {r6('dist_px')} AS dist_px FROM dist")
def distance_transform(spark, d):
    return sea_distance(spark, d).withColumn("dist_px", F.round("dist_px", 6))


@query("shore_zones", f"""WITH {SQL_SCENES}, {SEA}, {SQL_DIST} SELECT scene, CASE WHEN dist_px * 20 < 40 THEN 'nearshore' ELSE 'offshore' END AS zone,
count(*) AS n_px, {r6('max(dist_px)')} AS max_dist_px, count(CASE WHEN dist_px >= 3 THEN 1 END) AS n_background FROM dist GROUP BY 1, 2""")
def shore_zones(spark, d):
    return (grid.shore_zones(sea_distance(spark, d), 20.0, 40.0).groupBy("scene", "zone")
            .agg(F.count(F.lit(1)).alias("n_px"), F.round(F.max("dist_px"), 6).alias("max_dist_px"),
                 F.count_if(F.col("dist_px") >= 3).alias("n_background")))


@query("static_water", f"""WITH {SQL_SCENES} SELECT row, col, {r6('avg(CAST(q % 5 < 3 AS INTEGER))')} AS water_freq, count(*) AS n_acq,
CAST(avg(CAST(q % 5 < 3 AS INTEGER)) >= 0.5 AS INTEGER) AS persistent FROM scenes GROUP BY 1, 2""")
def static_water(spark, d):
    out = grid.static_water(scenes(spark, d), [], F.col("q") % 5 < 3)
    return out.withColumns({"water_freq": F.round("water_freq", 6), "persistent": F.col("persistent").cast("int")})


# A radar-like raster: decibels fall where the yearly sum is odd in blocks, water everywhere.
SAR_DB = "CASE WHEN (row // 4 + col // 5 + scene) % 5 = 0 THEN -24.0 ELSE -15.0 END + q % 7 * 0.31e0"


def sql_reach(name, size, half):
    """CTE (a, r, m): how often line r stands in the window around line a, border lines repeated."""
    return f"""{name} AS MATERIALIZED (SELECT CAST(a AS INTEGER) AS a, CAST(r AS INTEGER) AS r, CASE WHEN r = 0 THEN greatest(0, {half} - a + 1) WHEN r = n - 1 THEN greatest(0, {half} - (n - 1 - a) + 1) WHEN abs(r - a) <= {half} THEN 1 ELSE 0 END AS m
 FROM (SELECT {size} AS n FROM shape), generate_series(0, n - 1) x(a), generate_series(0, n - 1) y(r))"""


#: A window of 3 km on pixels of 20 m.
SAR_WINDOW = 151


@query("local_median_dark", f"""WITH RECURSIVE {SQL_SCENES}, {SHAPE}, s AS MATERIALIZED (SELECT scene, row, col, {SAR_DB} AS db FROM scenes), {sql_reach('rm', 'nr', SAR_WINDOW // 2)}, {sql_reach('cm', 'nc', SAR_WINDOW // 2)},
fm AS (SELECT scene, median(db) AS med FROM s GROUP BY 1),
fl AS MATERIALIZED (SELECT fm.scene, c.row, c.col, coalesce(s.db, med) AS db FROM fm CROSS JOIN (SELECT DISTINCT rm.a AS row, cm.a AS col FROM rm, cm) c LEFT JOIN s ON s.scene = fm.scene AND s.row = c.row AND s.col = c.col),
va AS MATERIALIZED (SELECT scene, a AS row, col, db, sum(m) AS m FROM fl JOIN rm ON rm.r = fl.row AND m > 0 GROUP BY 1, 2, 3, 4),
vb AS MATERIALIZED (SELECT scene, row, a AS col, db, sum(va.m * cm.m) AS m FROM va JOIN cm ON cm.r = va.col AND cm.m > 0 GROUP BY 1, 2, 3, 4),
vc AS (SELECT *, sum(m) OVER (PARTITION BY scene, row, col ORDER BY db) AS upto FROM vb),
bg AS MATERIALIZED (SELECT scene, row, col, min(db) AS bg FROM vc WHERE upto > {SAR_WINDOW ** 2 // 2} GROUP BY 1, 2, 3),
w AS MATERIALIZED (SELECT s.*, bg FROM s JOIN bg USING (scene, row, col)),
h AS MATERIALIZED (SELECT scene, row, col FROM w WHERE bg - db > 3), {sql_erode('e', 'h', 1)}, {sql_dilate('g', 'e', 1, False)},
m AS MATERIALIZED (SELECT scene, row, col, row * 50 + col AS id FROM g), {sql_components('m')},
p AS (SELECT cc.scene, cc.lbl, w.row, w.col, w.bg - w.db AS gap FROM cc JOIN w ON w.scene = cc.scene AND w.row = cc.id // 50 AND w.col = cc.id % 50),
r AS (SELECT scene, lbl, count(*) AS n, avg(row) AS cr, avg(col) AS ccol, var_samp(row) AS rr, var_samp(col) AS vc, covar_samp(row, col) AS rc, median(gap) AS gap FROM p GROUP BY 1, 2)
SELECT scene, CAST(lbl AS BIGINT) AS label, n AS n_px, {r6('n * 0.0004e0')} AS area_km2, {r6('cr')} AS centroid_row, {r6('ccol')} AS centroid_col, {r6('gap')} AS contrast_db,
{r6('sqrt(((rr + vc) / 2 + sqrt(pow((rr - vc) / 2, 2) + rc * rc)) / greatest((rr + vc) / 2 - sqrt(pow((rr - vc) / 2, 2) + rc * rc), 1e-9))', 3)} AS elongation,
{r6('least(1, gap / 6) * CASE WHEN scene % 3 = 0 THEN 0.3 WHEN scene % 3 = 1 THEN 0.5 ELSE 1.0 END', 3)} AS confidence,
CASE scene % 3 WHEN 0 THEN 'wind 2.0 m/s: most of the sea is smooth, lookalikes dominate' WHEN 1 THEN 'wind 13.0 m/s: surface films break up; a dark patch is unusual' ELSE '' END AS notes,
'SURFACE_DARK_ANOMALY' AS event_type, 6 AS n_lookalikes FROM r WHERE n * 0.0004e0 >= 0.003""")
def local_median_dark(spark, d):
    row, col, scene = F.col("row"), F.col("col"), F.col("scene")
    block = (F.floor(row / 4) + F.floor(col / 5) + scene) % 5 == 0
    s = scenes(spark, d).select("scene", "row", "col", (F.when(block, -24.0).otherwise(-15.0) + F.col("q") % 7 * 0.31).alias("db"))
    n = n_rows(spark, d)
    bg = s.join(grid.local_median(s, K, "db", SAR_WINDOW, n, GRID_COLS), ["scene", "row", "col"])
    bg = cut_lineage(bg.withColumn("drop", F.col("background") - F.col("db")))
    dark = grid.opening(bg.where(F.col("drop") > 3.0), K, 1, n, GRID_COLS)
    lab = grid.connected_components(dark, K, GRID_COLS).join(bg.select("scene", "row", "col", "drop"), ["scene", "row", "col"])
    wind = F.when(scene % 3 == 0, 2.0).when(scene % 3 == 1, 13.0).otherwise(6.0)
    out = grid.dark_regions(lab, K, "drop", 20.0, 0.003, wind)
    return out.select("scene", "label", "n_px", F.round("area_km2", 6).alias("area_km2"),
                      *[F.round(c, 6).alias(c) for c in ("centroid_row", "centroid_col", "contrast_db")],
                      F.round("elongation", 3).alias("elongation"), F.round("confidence", 3).alias("confidence"), F.array_join("notes", "; ").alias("notes"),
                      "event_type", F.size("lookalikes").alias("n_lookalikes"))


@query("mask_overlap", f"""WITH {SQL_SCENES}, a AS (SELECT scene, row, col FROM scenes WHERE q % 5 < 3), b AS (SELECT scene + 1 AS scene, row, col FROM scenes WHERE q % 5 < 3)
SELECT scene, count(*) AS n_shared FROM a JOIN b USING (scene, row, col) GROUP BY 1""")
def mask_overlap(spark, d):
    m = mask(spark, d)
    return grid.mask_overlap(m, m.withColumn("scene", F.col("scene") + 1), K)


# --- the two water masks, on one raster of the latest pass per cell -------------------
LATEST = """px AS MATERIALIZED (SELECT ln AS scene, CAST(px // 50 AS INTEGER) AS row, CAST(px % 50 AS INTEGER) AS col, min(scl) AS scl,
  avg(b03) AS b03, avg(b04) AS b04, avg(b8a) AS b8a, avg(b11) AS b11, avg(b12) AS b12 FROM bands GROUP BY 1, 2, 3)"""


def raster(spark, d):
    return (bands(spark, d).groupBy(F.col("ln").alias("scene"), F.floor(F.col("px") / GRID_COLS).cast("int").alias("row"),
                                    (F.col("px") % GRID_COLS).cast("int").alias("col"))
            .agg(F.min("scl").alias("scl"), *[F.avg(b).alias(b) for b in ("b03", "b04", "b8a", "b11", "b12")]))


@query("water_mask_simple", f"""WITH RECURSIVE {SQL_BANDS}, {LATEST},
m AS MATERIALIZED (SELECT scene, row, col, row * 50 + col AS id FROM px WHERE (b03 - b11) / (b03 + b11 + 1e-6) > -0.02 AND b8a < 0.06), {sql_components('m')},
f AS MATERIALIZED (SELECT scene, id // 50 AS row, id % 50 AS col FROM cc JOIN (SELECT scene, lbl FROM cc GROUP BY 1, 2 HAVING count(*) >= 10) USING (scene, lbl)),
{sql_erode('e', 'f', 1)}
SELECT p.scene, count(*) AS px_valid, count(m.id) AS px_raw, count(f.row) AS px_components, count(e.row) AS px_final FROM px p
LEFT JOIN m USING (scene, row, col) LEFT JOIN f USING (scene, row, col) LEFT JOIN e USING (scene, row, col) GROUP BY 1""")
def water_mask_simple(spark, d):
    px = raster(spark, d)
    raw = px.where(pixels.water_simple(F.col("b03"), F.col("b11"), F.col("b8a"), F.lit(True), -0.02, 0.06)).select("scene", "row", "col")
    kept = grid.component_filter(raw, K, GRID_COLS, 10).select("scene", "row", "col")
    final = grid.erode(kept, K, 1)
    count = lambda df, name: df.groupBy("scene").agg(F.count(F.lit(1)).alias(name))                      # noqa: E731
    out = count(px, "px_valid")
    for df, name in ((raw, "px_raw"), (kept, "px_components"), (final, "px_final")):
        out = out.join(count(df, name), "scene", "left")
    return out.fillna(0)


@query("water_mask_glint", f"""WITH RECURSIVE {SQL_BANDS}, {LATEST},
q AS MATERIALIZED (SELECT *, row * 50 + col AS id, scl NOT IN (0, 1, 3, 8, 9, 10, 11) AS usable, (b03 - b11) / nullif(b03 + b11, 0) > -0.05 AND b11 < 0.1 AS wet, b04 - b12 < 0.02 AS neg FROM px),
m AS MATERIALIZED (SELECT scene, row, col, id FROM q WHERE usable AND wet AND NOT neg), {sql_components('m')},
f AS MATERIALIZED (SELECT scene, id // 50 AS row, id % 50 AS col FROM cc JOIN (SELECT scene, lbl FROM cc GROUP BY 1, 2 HAVING count(*) >= 5) USING (scene, lbl)), {sql_erode('e', 'f', 1)}
SELECT scene, count(*) AS total_px, count(CASE WHEN NOT usable THEN 1 END) AS scl_unusable_px, count(e.row) AS water_px, count(CASE WHEN e.row IS NOT NULL AND b11 > 0.0215 THEN 1 END) AS glint_px,
count(CASE WHEN usable AND wet AND neg THEN 1 END) AS negative_red_px, {r6('median(CASE WHEN e.row IS NOT NULL THEN b11 END)')} AS median_b11_water FROM q LEFT JOIN e USING (scene, row, col) GROUP BY 1""")
def water_mask_glint(spark, d):
    from tidemark.functions.quantiles import exact_quantiles
    px = raster(spark, d)
    part = pixels.water_glint_parts(pixels.scl_usable(F.col("scl")), -0.05, 0.10, red_floor=0.02)
    px = px.withColumns(part)
    raw = px.where(F.col("open") & ~F.col("negative_red")).select("scene", "row", "col")
    water = grid.erode(grid.component_filter(raw, K, GRID_COLS, 5), K, 1).withColumn("water", F.lit(True))
    joined = px.join(water, ["scene", "row", "col"], "left").withColumn("water", F.coalesce("water", F.lit(False)))
    report = joined.groupBy("scene").agg(
        F.count(F.lit(1)).alias("total_px"), F.count_if(F.col("valid") & ~F.col("usable")).alias("scl_unusable_px"),
        F.count_if("water").alias("water_px"), F.count_if(F.col("water") & (F.col("b11") > 0.0215)).alias("glint_px"),
        F.count_if("negative_red").alias("negative_red_px"))
    med = exact_quantiles(joined.where("water"), ["scene"], "b11", {"median_b11_water": 0.5}).drop("n")
    return report.join(med, "scene", "left").withColumn("median_b11_water", F.round("median_b11_water", 6))


def sql_hole_free(k):
    values, _ = sql_diamond(k)
    return values


@query("water_mask_no_halo", f"""WITH RECURSIVE {SQL_BANDS}, {LATEST},
q AS MATERIALIZED (SELECT *, row * 50 + col AS id, scl NOT IN (0, 1, 3, 8, 9, 10, 11) AS usable, (b03 - b11) / nullif(b03 + b11, 0) > -0.05 AND b11 < 0.1 AS wet, b04 - b12 < 0.02 AS neg FROM px),
c AS MATERIALIZED (SELECT scene, row, col, id FROM q WHERE NOT usable), {sql_components('c', 'uc')},
bad AS (SELECT scene, id FROM uc JOIN (SELECT scene, lbl FROM uc GROUP BY 1, 2 HAVING count(*) >= 4) USING (scene, lbl)),
m AS MATERIALIZED (SELECT scene, row, col, id FROM q ANTI JOIN bad USING (scene, id) WHERE wet), {sql_components('m')},
f AS MATERIALIZED (SELECT scene, id // 50 AS row, id % 50 AS col FROM cc JOIN (SELECT scene, lbl FROM cc GROUP BY 1, 2 HAVING count(*) >= 5) USING (scene, lbl)), {sql_erode('e', 'f', 1)}
SELECT scene, row, col FROM q SEMI JOIN e USING (scene, row, col) WHERE usable AND NOT (usable AND wet AND neg)""")
def water_mask_no_halo(spark, d):
    """The variant that buffers only against land and real cloud areas, then drops single pixels."""
    px = raster(spark, d).withColumns(pixels.water_glint_parts(pixels.scl_usable(F.col("scl")), -0.05, 0.10, red_floor=0.02))
    cell = ["scene", "row", "col"]
    cloud = grid.component_filter(px.where(F.col("valid") & ~F.col("usable")), K, GRID_COLS, 4)
    body = px.where("wet").select(*cell).join(cloud.select(*cell), cell, "left_anti")
    water = grid.erode(grid.component_filter(body, K, GRID_COLS, 5), K, 1)
    return px.where(F.col("usable") & ~F.col("negative_red")).join(water, cell, "left_semi").select(*cell)
