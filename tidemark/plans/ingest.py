"""Queries of the catalog, decoding, regridding and import operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ingest as ig
from tidemark.plans.base import query, r6
from tidemark.streaming.incremental import shared_folder
from tidemark.sources import assets, sinks
from tidemark.sources.tables import table


def rnd(c, digits=6):
    return F.round(c, digits)


def items(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.to_date("o_orderdate").alias("d"), (F.col("o_custkey") % 7).alias("orbit"),
        F.concat(F.lit("Sentinel-2"), F.when(F.col("o_orderstatus") == "O", "A").otherwise("B")).alias("platform"),
        (F.floor("o_totalprice") % 101).cast("int").alias("cloud"), (F.col("o_custkey") % 10).alias("aoi"), F.col("o_orderpriority").alias("collection"))


SQL_ITEMS = """items AS (SELECT o_orderkey AS item_id, CAST(o_orderdate AS DATE) AS d, o_custkey % 7 AS orbit, CASE WHEN o_orderstatus = 'O' THEN 'Sentinel-2A' ELSE 'Sentinel-2B' END AS platform,
 CAST(floor(o_totalprice) % 101 AS INTEGER) AS cloud, o_custkey % 10 AS aoi, o_orderpriority AS collection FROM orders)"""


@query("datatake_group", f"WITH {SQL_ITEMS} SELECT CAST(d AS VARCHAR) AS d, orbit, platform, count(*) AS n_tiles, min(item_id) AS first_tile, max(item_id) AS last_tile, {r6('avg(cloud)')} AS mean_cloud FROM items WHERE cloud BETWEEN 1 AND 30 GROUP BY ALL")
def datatake_group(spark, d):
    return ig.overpasses(items(spark, d), 30).withColumns({"d": F.col("d").cast("string"), "mean_cloud": rnd(F.col("mean_cloud"))})


@query("datatake_tag", f"WITH {SQL_ITEMS} SELECT CAST(d AS VARCHAR) || '_R' || lpad(CAST(orbit AS VARCHAR), 3, '0') || '_' || right(platform, 2) AS tag, count(*) AS n FROM items GROUP BY 1")
def datatake_tag(spark, d):
    return items(spark, d).groupBy(ig.overpass_tag(F.col("d"), F.col("orbit"), F.col("platform")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


SQL_TAGS = f"{SQL_ITEMS}, tags AS (SELECT DISTINCT d, CAST(d AS VARCHAR) || '_R' || lpad(CAST(orbit AS VARCHAR), 3, '0') || '_' || right(platform, 2) AS tag FROM items WHERE cloud BETWEEN 1 AND 30)"


@query("incremental_screen", f"WITH {SQL_TAGS} SELECT tag, CASE WHEN year(d) < 1999 AND month(d) <> 4 THEN 'reused' ELSE 'new' END AS source FROM tags")
def incremental_screen(spark, d):
    o = ig.overpasses(items(spark, d), 30)
    acq = o.select("d", ig.overpass_tag(F.col("d"), F.col("orbit"), F.col("platform")).alias("tag"))
    done = acq.where((F.year("d") < 1999) & (F.month("d") != 4))
    reused, fresh = ig.split_new(acq, done)
    return reused.select("tag", F.lit("reused").alias("source")).unionByName(fresh.select("tag", F.lit("new").alias("source")))


@query("error_rows_kept", f"WITH {SQL_ITEMS} SELECT aoi, platform, count(*) AS n_datatakes, count(CASE WHEN cloud <= 95 THEN 1 END) AS n_ok, count(CASE WHEN cloud > 95 THEN 1 END) AS n_failed FROM items GROUP BY 1, 2")
def error_rows_kept(spark, d):
    rows = items(spark, d).withColumn("error", F.when(F.col("cloud") > 95, F.concat(F.lit("no valid pixels: cloud "), "cloud")))
    return ig.outcome_counts(rows, ["aoi", "platform"])


BASE = ["05.13", "02.12", "04.00", "03.01", "N/A", None, "05.09"]
_SQLB = " ".join(f"WHEN {i + 1} THEN " + (f"'{b}'" if b else "NULL") for i, b in enumerate(BASE))


@query("dn_to_reflectance", f"""WITH q AS (SELECT l_orderkey AS ok, l_partkey AS px, l_linenumber AS ln, CAST(floor(l_extendedprice) % 3000 AS BIGINT) AS dn, CASE l_linenumber {_SQLB} END AS b FROM lineitem)
SELECT ok, px, ln, dn, {r6("CASE WHEN dn <> 0 AND TRY_CAST(b AS DOUBLE) IS NOT NULL THEN (dn + CASE WHEN TRY_CAST(b AS DOUBLE) >= 4 THEN -1000 ELSE 0 END) / 10000.0 END")} AS reflectance,
CASE WHEN b IS NULL THEN 'baseline required' WHEN TRY_CAST(b AS DOUBLE) IS NULL THEN 'unparseable baseline' END AS problem FROM q""")
def dn_to_reflectance(spark, d):
    b = F.element_at(F.array(*[F.lit(x) for x in BASE]), F.col("l_linenumber"))
    px = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("px"), F.col("l_linenumber").alias("ln"),
                                            (F.floor("l_extendedprice") % 3000).alias("dn"), b.alias("baseline"))
    return ig.decode_dn(px).withColumn("reflectance", rnd(F.col("reflectance"))).drop("baseline")


@query("dn_harmonize_by_date", f"""WITH q AS (SELECT l_orderkey AS ok, l_partkey AS px, l_linenumber AS ln, CAST(floor(l_extendedprice) % 3000 AS BIGINT) AS dn, CAST(l_shipdate AS DATE) AS d FROM lineitem)
SELECT ok, px, ln, {r6("CASE WHEN dn <> 0 THEN (dn + CASE WHEN d >= DATE '1998-01-25' THEN -1000 ELSE 0 END) / 10000.0 END")} AS reflectance FROM q""")
def dn_harmonize_by_date(spark, d):
    px = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("px"), F.col("l_linenumber").alias("ln"),
                                            (F.floor("l_extendedprice") % 3000).alias("dn"), F.to_date("l_shipdate").alias("d"))
    return ig.decode_by_date(px, "dn", "d", "1998-01-25").select("ok", "px", "ln", rnd(F.col("reflectance")).alias("reflectance"))


@query("mosaic_first_valid", f"""WITH t AS (SELECT l_partkey AS px, year(l_shipdate) * 12 + month(l_shipdate) AS ym, CASE WHEN l_linenumber <= 3 THEN 0 ELSE 1 END AS zone, l_suppkey AS tile, l_orderkey AS item, l_extendedprice AS pr,
CASE WHEN l_discount > 0 THEN l_discount END AS a, CASE WHEN l_tax > 0 THEN l_tax END AS b FROM lineitem), f AS (SELECT px, ym, arg_min(a, (zone, tile, item, pr)) FILTER (a IS NOT NULL) AS a, arg_min(b, (zone, tile, item, pr)) FILTER (b IS NOT NULL) AS b,
arg_min(tile, (zone, tile, item, pr)) FILTER (a IS NOT NULL OR b IS NOT NULL) AS tile FROM t GROUP BY 1, 2) SELECT px, CAST(ym AS INTEGER) AS ym, {r6('a')} AS a, {r6('b')} AS b, tile AS winner_tile FROM f""")
def mosaic_first_valid(spark, d):
    t = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("px"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("ym"), F.when(F.col("l_linenumber") <= 3, 0).otherwise(1).alias("zone"),
        F.col("l_suppkey").alias("tile"), F.col("l_orderkey").alias("item"), F.col("l_extendedprice").alias("pr"),
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("a"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("b"))
    m = ig.mosaic(t, ["px", "ym"], ["zone", "tile", "item", "pr"], ["a", "b"])
    return m.select("px", "ym", rnd(F.col("a")).alias("a"), rnd(F.col("b")).alias("b"), F.col("winner.tile").alias("winner_tile"))


@query("mosaic_skipped_tiles", """WITH t AS (SELECT l_suppkey % 10 AS cell, l_orderkey AS tile, min(l_linenumber) AS ln FROM lineitem WHERE l_discount > 0 GROUP BY 1, 2),
w AS (SELECT cell, arg_min(tile, (ln, tile)) AS tile FROM t GROUP BY 1), a AS (SELECT DISTINCT l_orderkey AS tile FROM lineitem) SELECT count(*) AS n_skipped, CAST(min(tile) AS BIGINT) AS first_skipped FROM a ANTI JOIN w USING (tile)""")
def mosaic_skipped_tiles(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("cell"), F.col("l_orderkey").alias("tile"), F.col("l_linenumber").alias("ln"),
                                           F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("a"))
    m = ig.mosaic(t, ["cell"], ["ln", "tile"], ["a"])
    s = ig.skipped_tiles(t, m, ["tile"], ["tile"])
    return s.agg(F.count(F.lit(1)).alias("n_skipped"), F.min("tile").alias("first_skipped"))


SQL_CELL = "CAST(floor(((c_custkey * 37 % 1000) * 1.7e0 - 10) / 100) AS BIGINT) AS cx, CAST(floor(((c_custkey * 91 % 1000) * 2.3e0 - 20) / 100) AS BIGINT) AS cy"


@query("regrid_average", f"SELECT {SQL_CELL}, count(*) AS n, {r6('avg(c_acctbal)', 4)} AS c_acctbal FROM customer GROUP BY 1, 2 HAVING count(*) >= 4")
def regrid_average(spark, d):
    c = table(spark, d, "customer")
    out = ig.regrid(c, [], (F.col("c_custkey") * 37 % 1000) * 1.7, (F.col("c_custkey") * 91 % 1000) * 2.3, 10, 20, 100, ["c_acctbal"], min_count=4)
    return out.withColumn("c_acctbal", rnd(F.col("c_acctbal"), 4))


@query("regrid_mode", f"""WITH c AS (SELECT {SQL_CELL}, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2, 3)
SELECT cx, cy, CAST(sum(n) AS BIGINT) AS n, arg_min(c_mktsegment, (-n, c_mktsegment)) AS c_mktsegment FROM c GROUP BY 1, 2""")
def regrid_mode(spark, d):
    return ig.regrid(table(spark, d, "customer"), [], (F.col("c_custkey") * 37 % 1000) * 1.7, (F.col("c_custkey") * 91 % 1000) * 2.3, 10, 20, 100, category="c_mktsegment")


@query("grid_to_lonlat", f"""SELECT p_partkey, {r6('367950 + (p_partkey % 50 + 0.5) * 30')} AS x, {r6('4102500 + (p_partkey // 50 + 0.5) * -30')} AS y,
CAST((CASE WHEN p_size - 25 >= 0 THEN 32600 ELSE 32700 END) + floor((p_partkey % 360 - 180 + 180) / 6) + 1 AS INTEGER) AS epsg FROM part""")
def grid_to_lonlat(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 50).alias("col"), F.floor(F.col("p_partkey") / 50).alias("row"))
    out = ig.cell_centres(p, 367950.0, 30.0, 4102500.0, -30.0)
    return out.select("p_partkey", rnd(F.col("x")).alias("x"), rnd(F.col("y")).alias("y"), ig.utm_epsg(F.col("p_partkey") % 360 - 180, F.col("p_size") - 25).alias("epsg"))


@query("perimeter_bounds", """SELECT p_brand, min(367950 + (p_partkey % 50) * 30.0e0) AS west, max(367950 + (p_partkey % 50 + 1) * 30.0e0) AS east, min(4102500 - (p_partkey // 50 + 1) * 30.0e0) AS south, max(4102500 - (p_partkey // 50) * 30.0e0) AS north FROM part GROUP BY 1""")
def perimeter_bounds(spark, d):
    p = table(spark, d, "part").select("p_brand", (F.col("p_partkey") % 50).alias("col"), F.floor(F.col("p_partkey") / 50).alias("row"))
    return ig.perimeter_bounds(p, ["p_brand"], 367950.0, 30.0, 4102500.0, -30.0)


TYPES = ["DESALINATION_PLANT", "power_plant", "PORT", "Marina", "PUBLIC_BEACH"]
_SQLT = "CASE s_suppkey % 5 WHEN 0 THEN 'DESALINATION_PLANT' WHEN 1 THEN 'POWER_PLANT' WHEN 2 THEN 'PORT' WHEN 3 THEN 'CUSTOM' ELSE 'PUBLIC_BEACH' END"
_SQLS = "CASE s_suppkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.5 WHEN 3 THEN 0.6 ELSE 0.8 END"


def supplier_points(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k, F.col("s_name").alias("name"), F.element_at(F.array(*[F.lit(t) for t in TYPES]), (k % 5 + 1).cast("int")).alias("type"),
        (F.lit(54.0) + k * 37 % 100 * 0.25).alias("lon"), (F.lit(24.0) + k * 91 % 100 * 0.125).alias("lat"), F.when(k % 4 == 0, 0.25).alias("sensitivity"))


@query("assets_from_geojson", f"""SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, {_SQLT} AS type, 54 + (s_suppkey * 37 % 100) * 0.25e0 AS lon, 24 + (s_suppkey * 91 % 100) * 0.125e0 AS lat,
CAST(CASE WHEN s_suppkey % 4 = 0 THEN 0.25 ELSE {_SQLS} END AS DOUBLE) AS sensitivity FROM supplier WHERE s_suppkey % 6 <> 5""")
def assets_from_geojson(spark, d):
    p = supplier_points(spark, d)
    shape = F.when(F.col("s_suppkey") % 6 == 5, "LineString").otherwise("Point")
    doc = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(shape.alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
                             F.struct(F.col("s_suppkey").cast("string").alias("id"), "name", "type", "sensitivity").alias("properties")))
    parsed = p.select(F.from_json(doc, assets.FEATURE).alias("feature"))
    return assets.from_features(parsed).drop("notes")


@query("assets_from_csv", f"""SELECT s_name AS name, {_SQLT} AS type, 54 + (s_suppkey * 37 % 100) * 0.25e0 AS lon, 24 + (s_suppkey * 91 % 100) * 0.125e0 AS lat, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 0.25 ELSE {_SQLS} END AS DOUBLE) AS sensitivity
FROM supplier WHERE s_suppkey % 7 <> 6""")
def assets_from_csv(spark, d):
    p = supplier_points(spark, d)
    raw = p.select(F.col("name").alias(" Name "), F.col("type").alias("TYPE"), F.when(F.col("s_suppkey") % 7 == 6, F.lit("")).otherwise(F.col("lon").cast("string")).alias("Longitude"),
                   F.col("lat").cast("string").alias("y"), F.col("sensitivity").cast("string").alias("sensitivity"))
    return assets.from_table(raw).select("name", "type", "lon", "lat", "sensitivity")


@query("asset_classify", """WITH t AS (SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'water_works' END AS mm, CASE WHEN p_size > 25 THEN 'desalination' END AS ww, CASE WHEN p_type = 'PROMO' THEN 'plant' END AS pw, CASE WHEN p_name LIKE '%ring%' THEN 'solar' END AS src,
CASE WHEN p_type = 'LARGE' THEN 'oil_terminal' END AS ind, CASE WHEN p_type = 'MEDIUM' THEN 'port' END AS lu, CASE WHEN p_type = 'SMALL' THEN 'beach' END AS nat, CASE WHEN p_size % 5 <> 0 THEN p_name END AS nm FROM part)
SELECT p_partkey, CASE WHEN mm = 'water_works' AND ww LIKE '%desal%' THEN 'DESALINATION_PLANT' WHEN pw = 'plant' AND src = 'solar' THEN NULL WHEN pw = 'plant' THEN 'POWER_PLANT' WHEN ind = 'oil_terminal' THEN 'OIL_TERMINAL' WHEN lu = 'port' THEN 'PORT'
WHEN nat = 'beach' AND nm IS NOT NULL THEN 'PUBLIC_BEACH' END AS asset_type FROM t""")
def asset_classify(spark, d):
    p = table(spark, d, "part")
    tag = lambda k, cond, v: F.when(cond, F.struct(F.lit(k).alias("k"), v.alias("v")))                      # noqa: E731
    t = F.col("p_type")
    entries = F.array_compact(F.array(tag("man_made", t == "ECONOMY", F.lit("water_works")), tag("water_works", F.col("p_size") > 25, F.lit("desalination")), tag("power", t == "PROMO", F.lit("plant")),
                                      tag("plant:source", F.col("p_name").contains("ring"), F.lit("solar")), tag("industrial", t == "LARGE", F.lit("oil_terminal")), tag("landuse", t == "MEDIUM", F.lit("port")),
                                      tag("natural", t == "SMALL", F.lit("beach")), tag("name", F.col("p_size") % 5 != 0, F.col("p_name"))))
    return p.select("p_partkey", ig.asset_type(F.map_from_entries(entries)).alias("asset_type"))


SQL_PTS = "pts AS (SELECT c_custkey, 54 + (c_custkey * 37 % 1000) * 0.0031e0 AS lon, 24 + (c_custkey * 91 % 1000) * 0.0017e0 AS lat FROM customer)"


@query("asset_assign_aoi", f"""WITH {SQL_PTS}, a AS (SELECT n_name AS aoi, n_nationkey AS ord, 53.9 + (n_nationkey * 7 % 25) * 0.12e0 AS w, 23.9 + (n_nationkey * 11 % 25) * 0.07e0 AS s FROM nation)
SELECT c_custkey, arg_min(aoi, ord) AS aoi FROM pts JOIN a ON lon BETWEEN w AND w + 0.4 AND lat BETWEEN s AND s + 0.3 GROUP BY 1""")
def asset_assign_aoi(spark, d):
    pts = table(spark, d, "customer").select("c_custkey", (54 + (F.col("c_custkey") * 37 % 1000) * 0.0031).alias("lon"), (24 + (F.col("c_custkey") * 91 % 1000) * 0.0017).alias("lat"))
    k = F.col("n_nationkey")
    a = table(spark, d, "nation").select(F.col("n_name").alias("aoi"), k.alias("ord"), (53.9 + (k * 7 % 25) * 0.12).alias("west"), (23.9 + (k * 11 % 25) * 0.07).alias("south"))
    a = a.withColumns({"east": F.col("west") + 0.4, "north": F.col("south") + 0.3})
    return ig.assign_area(pts, a).select("c_custkey", "aoi")


@query("asset_dedup", f"""WITH RECURSIVE p AS (SELECT c_mktsegment AS typ, c_custkey AS k, (c_custkey * 37 % 1000) * 0.0003e0 AS x, (c_custkey * 91 % 1000) * 0.0002e0 AS y, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS i FROM customer),
f(typ, i, kept) AS (SELECT typ, 1::BIGINT, [{{'k': k, 'x': x, 'y': y}}] FROM p WHERE i = 1 UNION ALL SELECT f.typ, f.i + 1, CASE WHEN len(list_filter(f.kept, lambda q: abs(q.x - p.x) < 0.01 AND abs(q.y - p.y) < 0.01)) > 0 THEN f.kept ELSE list_append(f.kept, {{'k': p.k, 'x': p.x, 'y': p.y}}) END
 FROM f JOIN p ON p.typ = f.typ AND p.i = f.i + 1), z AS (SELECT typ, unnest(arg_max(kept, i)) AS e FROM f GROUP BY typ) SELECT typ AS asset_type, CAST(e.k AS BIGINT) AS id FROM z""")
def asset_dedup(spark, d):
    p = table(spark, d, "customer").select(F.col("c_mktsegment").alias("asset_type"), F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 37 % 1000) * 0.0003).alias("x"), ((F.col("c_custkey") * 91 % 1000) * 0.0002).alias("y"))
    return ig.keep_separated(p, ["asset_type"], "x", "y", "id", 0.01, 0.01).select("asset_type", "id")


LAB = [("chlorophyll_a", "mg m-3"), ("turbidity", "FNU"), ("temperature", "degC"), ("tss", "ppm"), ("plankton", "m"), ("ph", "pH"), ("salinity", "g/kg"), ("nitrate", "mg/L")]
_LABCASE = lambda j: "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{r[j]}'" for i, r in enumerate(LAB)) + " END"        # noqa: E731


def lab_rows(spark, d):
    k = (F.col("o_orderkey") % 8 + 1).cast("int")
    value = F.when(F.col("o_custkey") % 11 == 0, F.lit("n/a")).when(F.col("o_custkey") % 13 == 0, F.lit("NaN")).otherwise((F.col("o_custkey") % 50 - 5).cast("string"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("line"), F.element_at(F.array(*[F.lit(a) for a, _ in LAB]), k).alias("parameter"),
                                            F.element_at(F.array(*[F.lit(b) for _, b in LAB]), k).alias("unit"), value.alias("value"))


SQL_LAB = f"""lab AS (SELECT o_orderkey AS line, {_LABCASE(0)} AS parameter, {_LABCASE(1)} AS unit, CASE WHEN o_custkey % 11 = 0 THEN 'n/a' WHEN o_custkey % 13 = 0 THEN 'NaN' ELSE CAST(o_custkey % 50 - 5 AS VARCHAR) END AS value FROM orders),
chk AS (SELECT *, CASE WHEN parameter = 'plankton' THEN 'unsupported parameter' WHEN parameter = 'tss' THEN 'unit not accepted' WHEN value = 'n/a' THEN 'not a number' WHEN value = 'NaN' THEN 'value is NaN' WHEN parameter <> 'temperature' AND CAST(value AS DOUBLE) < 0 THEN 'cannot be negative' END AS problem FROM lab)"""


@query("lab_csv_import", f"WITH {SQL_LAB} SELECT line, parameter, problem FROM chk")
def lab_csv_import(spark, d):
    good, bad = ig.split_lab_rows(lab_rows(spark, d))
    return good.unionByName(bad).select("line", "parameter", "problem")


@query("measurement_units", f"WITH {SQL_LAB} SELECT parameter, unit, count(*) AS n, count(problem) AS n_rejected, count(CASE WHEN problem = 'unit not accepted' THEN 1 END) AS n_bad_unit FROM chk GROUP BY 1, 2")
def measurement_units(spark, d):
    rows = lab_rows(spark, d).withColumn("problem", ig.measurement_problem(F.col("parameter"), F.col("unit"), F.col("value")))
    return rows.groupBy("parameter", "unit").agg(F.count(F.lit(1)).alias("n"), F.count("problem").alias("n_rejected"), F.count_if(F.col("problem") == "unit not accepted").alias("n_bad_unit"))


@query("sinks", """SELECT s_suppkey, json_object('type', 'Feature', 'geometry', json_object('type', 'Point', 'coordinates', [54 + (s_suppkey * 37 % 100) * 0.25e0, 24 + (s_suppkey * 91 % 100) * 0.125e0]), 'properties', json_object('name', s_name)) AS feature FROM supplier""")
def geojson_sink(spark, d):
    """Written as one collection, read back line by line."""
    p = supplier_points(spark, d)
    path = shared_folder(spark, "features")
    sinks.write_geojson(p.select("lon", "lat", "name"), path, "lon", "lat", about={"note": "suggested locations"})
    lines = spark.read.text(path).where(F.col("value").startswith('{"type":"Feature",')).select(F.rtrim("value", F.lit(",")).alias("feature"))
    return lines.join(p.select("s_suppkey", "name"), F.get_json_object("feature", "$.properties.name") == F.col("name")).select("s_suppkey", "feature")


@query("archive_census", f"""WITH {SQL_ITEMS}, g AS (SELECT aoi, collection, count(*) AS n, count(DISTINCT d) AS nd, min(d) AS a, max(d) AS z, count(CASE WHEN cloud <= 10 THEN 1 END) AS c, count(DISTINCT CASE WHEN cloud <= 10 THEN d END) AS cd, list_sort(list(cloud)) AS s FROM items GROUP BY 1, 2)
SELECT aoi, collection, n AS n_items, nd AS n_dates, CAST(a AS VARCHAR) AS first_d, CAST(z AS VARCHAR) AS last_d, c AS n_items_clear, cd AS n_dates_clear, CAST(s[n // 2 + 1] AS DOUBLE) AS median_cloud FROM g""")
def archive_census(spark, d):
    return ig.census(items(spark, d), ["aoi", "collection"]).withColumns({"first_d": F.col("first_d").cast("string"), "last_d": F.col("last_d").cast("string")})


@query("archive_latest_clear", f"WITH {SQL_ITEMS} SELECT aoi, collection, item_id, CAST(d AS VARCHAR) AS d, cloud FROM items WHERE cloud BETWEEN 1 AND 5 QUALIFY row_number() OVER (PARTITION BY aoi, collection ORDER BY d DESC, item_id DESC) <= 5")
def archive_latest_clear(spark, d):
    return ig.latest_clear(items(spark, d), ["aoi", "collection"]).select("aoi", "collection", "item_id", F.col("d").cast("string").alias("d"), "cloud")
