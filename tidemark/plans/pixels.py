"""Queries of the pixel feature and mask operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.joins import join_small
from tidemark.functions.nulls import normalised_difference, within
from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators import pixels as px
from tidemark.plans.base import query, r6
from tidemark.sources.tables import BAND_COLUMNS, SQL_BANDS, bands, table

ID = ["ok", "px", "ln"]


def rnd(c, digits=6):
    return F.round(c, digits)


@query("surface_correction", f"""WITH {SQL_BANDS}
SELECT ok, px, ln, {r6('b04 - b12', 9)} AS w04, {r6('b05 - b12', 9)} AS w05, {r6('b8a - b12', 9)} AS w8a,
  {r6('b11', 9)} AS w11, {r6('b12', 9)} AS w12 FROM bands""")
def surface_correction(spark, d):
    w = px.surface_corrected(BAND_COLUMNS)
    return bands(spark, d).select(*ID, *[rnd(w[b], 9).alias("w" + b[1:]) for b in ("b04", "b05", "b8a", "b11", "b12")])


@query("nd_index", f"""WITH {SQL_BANDS}
SELECT ok, px, ln, {r6('(b03 - b11) / nullif(b03 + b11, 0)')} AS mndwi,
  {r6('((b05 - b12) - (b04 - b12)) / nullif((b05 - b12) + (b04 - b12), 0)', 4)} AS ndci FROM bands""")
def nd_index(spark, d):
    w = px.surface_corrected(BAND_COLUMNS)
    return bands(spark, d).select(
        *ID, rnd(normalised_difference(F.col("b03"), F.col("b11"))).alias("mndwi"),
        rnd(normalised_difference(w["b05"], w["b04"]), 4).alias("ndci"))


@query("nd_index_guarded", f"""WITH {SQL_BANDS}
SELECT ok, px, ln, {r6('(b03 - b8a) / (b03 + b8a + 1e-6)')} AS ndwi, {r6('(b03 - b11) / (b03 + b11 + 1e-6)')} AS mndwi,
  {r6('(b05 - b04) / (b05 + b04 + 1e-6)')} AS ndci, {r6('(b04 - b03) / (b04 + b03 + 1e-6)')} AS turbidity_proxy,
  {r6('b05 / (b04 + 1e-6)', 4)} AS chl_re_ratio FROM bands""")
def nd_index_guarded(spark, d):
    ix = px.guarded_indices(*[F.col(c) for c in ("b03", "b04", "b05", "b8a", "b11")])
    return bands(spark, d).select(
        *ID, *[rnd(ix[k], 4 if k == "CHL_RE_RATIO" else 6).alias(k.lower())
               for k in ("NDWI", "MNDWI", "NDCI", "TURBIDITY_PROXY", "CHL_RE_RATIO")])


SQL_PLATFORM = """CASE WHEN platform = 'Sentinel-2A' THEN {} ELSE {} END"""


@query("baseline_height", f"""WITH {SQL_BANDS}, f AS (SELECT *,
  {SQL_PLATFORM.format('(704.1e0 - 664.6e0) / (740.5e0 - 664.6e0)', '(703.8e0 - 664.9e0) / (739.1e0 - 664.9e0)')} AS fm,
  {SQL_PLATFORM.format('(864.7e0 - 664.6e0) / (1613.7e0 - 664.6e0)', '(864.0e0 - 664.9e0) / (1610.4e0 - 664.9e0)')} AS ff FROM bands)
SELECT ok, px, ln, {r6('(b05 - b12) - ((b04 - b12) + ((b06 - b12) - (b04 - b12)) * fm)')} AS mci,
  {r6('b8a - (b04 + (b11 - b04) * ff)')} AS fai FROM f""")
def baseline_height(spark, d):
    f = px.feature_columns(BAND_COLUMNS, F.col("platform"))
    return bands(spark, d).select(*ID, rnd(f["MCI"]).alias("mci"), rnd(f["FAI"]).alias("fai"))


@query("ratio_floor", f"""WITH {SQL_BANDS}, w AS (SELECT ok, px, ln, b03 - b12 AS g, b04 - b12 AS r, b05 - b12 AS e FROM bands),
q AS (SELECT ok, px, ln, CASE WHEN r > 1e-3 THEN e / r END AS re, CASE WHEN r > 1e-3 THEN g / r END AS cd FROM w)
SELECT ok, px, ln, {r6('CASE WHEN re BETWEEN 0 AND 10 THEN re END')} AS re_ratio,
  {r6('CASE WHEN cd BETWEEN 0 AND 20 THEN cd END')} AS cdom_ratio FROM q""")
def ratio_floor(spark, d):
    f = px.feature_columns(BAND_COLUMNS, F.col("platform"))
    return bands(spark, d).select(*ID, rnd(f["RE_RATIO"]).alias("re_ratio"), rnd(f["CDOM_RATIO"]).alias("cdom_ratio"))


@query("nechad", f"""WITH {SQL_BANDS}, w AS (SELECT ok, px, ln, b04 - b12 AS r FROM bands), t AS (SELECT *,
  CASE WHEN r < 0.5 * 0.19563e0 THEN 366.14e0 * r / (1 - r / 0.19563e0) END AS a,
  CASE WHEN r < 0.5 * 0.19563e0 THEN 342.10e0 * r / (1 - r / 0.19563e0) END AS b FROM w)
SELECT ok, px, ln, {r6('CASE WHEN a BETWEEN 0 AND 1000 THEN a END', 5)} AS tur,
  {r6('CASE WHEN b BETWEEN 0 AND 1000 THEN b END', 5)} AS spm FROM t""")
def nechad(spark, d):
    f = px.feature_columns(BAND_COLUMNS, F.col("platform"))
    return bands(spark, d).select(*ID, rnd(f["TUR_NECHAD2016"], 5).alias("tur"), rnd(f["SPM_NECHAD2016"], 5).alias("spm"))


@query("dogliotti_blend", f"""WITH {SQL_BANDS}, w AS (SELECT ok, px, ln, b04 - b12 AS r, b8a - b12 AS n FROM bands),
t AS (SELECT *, 228.1e0 * r / nullif(1 - r / 0.1641e0, 0) AS tr, 3078.9e0 * n / nullif(1 - n / 0.2112e0, 0) AS tn,
  least(greatest((r - 0.05e0) / (0.07e0 - 0.05e0), 0), 1) AS k FROM w), b AS (SELECT *, (1 - k) * tr + k * tn AS v FROM t)
SELECT ok, px, ln, {r6('CASE WHEN v BETWEEN 0 AND 4000 THEN v END', 5)} AS tur FROM b""")
def dogliotti_blend(spark, d):
    f = px.feature_columns(BAND_COLUMNS, F.col("platform"))
    return bands(spark, d).select(*ID, rnd(f["TUR_DOGLIOTTI2015"], 5).alias("tur"))


def _sql_weigh(ws):
    return " + ".join(f"w{i + 1} * {w}e0" for i, w in enumerate(ws))


def _sql_poly(cs):
    return " + ".join(f"({c}e0) * pow(h, {5 - i})" for i, c in enumerate(cs))


SQL_HUE = f"""w AS (SELECT ok, px, ln, platform, b01 - b12 AS w1, b02 - b12 AS w2, b03 - b12 AS w3, b04 - b12 AS w4, b05 - b12 AS w5 FROM bands),
xyz AS (SELECT *, {_sql_weigh(px.HUE_X)} AS x, {_sql_weigh(px.HUE_Y)} AS y, {_sql_weigh(px.HUE_Z)} AS z FROM w),
a AS (SELECT *, atan2(y / nullif(x + y + z, 0) - 1e0 / 3, x / nullif(x + y + z, 0) - 1e0 / 3) AS rad FROM xyz),
g AS (SELECT *, degrees(CASE WHEN rad < 0 THEN rad + 2 * pi() ELSE rad END) AS alpha FROM a), h AS (SELECT *, alpha / 100 AS h FROM g),
hue AS (SELECT ok, px, ln, alpha + CASE WHEN platform = 'Sentinel-2A' THEN {_sql_poly(px.HUE_POLY['Sentinel-2A'])}
  ELSE {_sql_poly(px.HUE_POLY['Sentinel-2B'])} END AS hue FROM h)"""


@query("hue_angle", f"""WITH {SQL_BANDS}, {SQL_HUE}
SELECT ok, px, ln, {r6('CASE WHEN hue BETWEEN 0 AND 360 THEN hue END', 5)} AS hue FROM hue""")
def hue_angle(spark, d):
    f = px.feature_columns(BAND_COLUMNS, F.col("platform"))
    return bands(spark, d).select(*ID, rnd(f["HUE_ANGLE"], 5).alias("hue"))


@query("valid_range_null", f"""WITH {SQL_BANDS}, w AS (SELECT aoi, scl, (b05 - b04) / nullif(b05 + b04 - 2 * b12, 0) AS ndci,
  b05 / (b04 + 1e-6) AS chl FROM bands)
SELECT aoi, scl, count(*) AS n, count(CASE WHEN ndci BETWEEN -1 AND 1 THEN 1 END) AS n_ndci,
  count(CASE WHEN chl BETWEEN 0 AND 5 THEN 1 END) AS n_chl,
  {r6('avg(CASE WHEN ndci BETWEEN -1 AND 1 THEN ndci END)')} AS mean_ndci,
  {r6('avg(CASE WHEN chl BETWEEN 0 AND 5 THEN chl END)')} AS mean_chl FROM w GROUP BY aoi, scl""")
def valid_range_null(spark, d):
    w = px.surface_corrected(BAND_COLUMNS)
    ndci = within(normalised_difference(w["b05"], w["b04"]), *px.INDEX_RANGES["NDCI"])
    chl = within(px.guarded_indices(*[F.col(c) for c in ("b03", "b04", "b05", "b8a", "b11")])["CHL_RE_RATIO"],
                 *px.INDEX_RANGES["CHL_RE_RATIO"])
    return (bands(spark, d).groupBy("aoi", "scl")
            .agg(F.count(F.lit(1)).alias("n"), F.count(ndci).alias("n_ndci"), F.count(chl).alias("n_chl"),
                 rnd(F.avg(ndci)).alias("mean_ndci"), rnd(F.avg(chl)).alias("mean_chl")))


@query("nd_uncertainty", f"""WITH {SQL_BANDS}, s AS (SELECT *, 0.004e0 + 0.02e0 * b04 AS s4, 0.003e0 + 0.05e0 * b05 AS s5 FROM bands)
SELECT ok, px, ln, {r6('(b05 - b04) / nullif(b05 + b04, 0)')} AS nd,
  {r6('2 * sqrt(pow(b04 * s5, 2) + pow(b05 * s4, 2)) / nullif(pow(b05 + b04, 2), 0)')} AS sigma FROM s""")
def nd_uncertainty(spark, d):
    b4, b5 = F.col("b04"), F.col("b05")
    s4, s5 = 0.004 + 0.02 * b4, 0.003 + 0.05 * b5
    return bands(spark, d).select(*ID, rnd(normalised_difference(b5, b4)).alias("nd"),
                                  rnd(px.nd_sigma(b5, b4, s5, s4)).alias("sigma"))


@query("significance_mask", f"""WITH {SQL_BANDS}, s AS (SELECT *, 0.01e0 AS sg, 0.013e0 + 0.02e0 * b04 AS sr, 0.012e0 AS se, 0.02e0 AS sn, 0.015e0 AS ss FROM bands)
SELECT ok, px, ln, {r6('CASE WHEN b05 + b04 > 3 * sqrt(se * se + sr * sr) AND abs(b05 - b04) <= b05 + b04 THEN (b05 - b04) / (b05 + b04) END')} AS ndci,
  {r6('CASE WHEN b03 + b8a > 3 * sqrt(sg * sg + sn * sn) AND abs(b03 - b8a) <= b03 + b8a THEN (b03 - b8a) / (b03 + b8a) END')} AS ndwi,
  {r6('CASE WHEN b05 + b04 > 3 * sqrt(se * se + sr * sr) THEN 2 * sqrt(pow(b04 * se, 2) + pow(b05 * sr, 2)) / pow(b05 + b04, 2) END')} AS ndci_sigma,
  {r6('b8a - (b04 + (b11 - b04) * ((859e0 - 665) / (1610e0 - 665)))')} AS fai,
  {r6('sqrt(pow(sn, 2) + pow((1 - (859e0 - 665) / (1610e0 - 665)) * sr, 2) + pow((859e0 - 665) / (1610e0 - 665) * ss, 2))')} AS fai_sigma FROM s""")
def significance_mask(spark, d):
    band = {"green": F.col("b03"), "red": F.col("b04"), "red_edge": F.col("b05"), "nir": F.col("b8a"), "swir": F.col("b11")}
    sigma = {"green": F.lit(0.01), "red": 0.013 + 0.02 * F.col("b04"), "red_edge": F.lit(0.012),
             "nir": F.lit(0.02), "swir": F.lit(0.015)}
    ix = px.significant_indices(band, sigma)
    return bands(spark, d).select(*ID, *[rnd(ix[k]).alias(k) for k in ("ndci", "ndwi", "ndci_sigma", "fai", "fai_sigma")])


@query("scl_usable", f"""WITH {SQL_BANDS} SELECT aoi, CAST(d AS VARCHAR) AS d, count(*) AS n, count(CASE WHEN scl NOT IN (0, 1, 3, 8, 9, 10, 11) THEN 1 END) AS n_usable
FROM bands GROUP BY aoi, d""")
def scl_usable(spark, d):
    out = bands(spark, d).groupBy("aoi", "d").agg(F.count(F.lit(1)).alias("n"), F.count_if(px.scl_usable(F.col("scl"))).alias("n_usable"))
    return out.withColumn("d", F.col("d").cast("string"))


FLAG_MASKS = {"INVALID": 1, "WATER": 2, "LAND": 4, "CLOUD": 8, "SNOW_ICE": 16, "COASTLINE": 32, "HIGHGLINT": 64, "AC_FAIL": 128}


@query("bitflag_reject", """SELECT l_orderkey AS ok, l_partkey AS px, l_linenumber AS ln, (l_suppkey * 37 + l_partkey * 11) % 256 AS flags,
  CAST((((l_suppkey * 37 + l_partkey * 11) % 256) & 221) = 0 AS INTEGER) AS valid FROM lineitem""")
def bitflag_reject(spark, d):
    flags = (F.col("l_suppkey") * 37 + F.col("l_partkey") * 11) % 256
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("px"), F.col("l_linenumber").alias("ln"), flags.alias("flags"),
        px.flags_accept(flags, FLAG_MASKS).cast("int").alias("valid"))


@query("log10_to_linear", f"""SELECT event_id, {r6("pow(10, value / 100 - 1)")} AS linear FROM events""")
def log10_to_linear(spark, d):
    return table(spark, d, "events").select("event_id", rnd(px.log10_to_linear(F.col("value") / 100 - 1)).alias("linear"))


@query("quality_screen", f"""WITH {SQL_BANDS}, q AS (SELECT aoi, scl <> 0 AND scl NOT IN (8, 9) AND scl <> 10 AS a, b8a < 0.05 AS b,
  abs(0.004e0 + 0.3e0 * b12) / greatest(abs(b04 - b12), 1e-4) <= 1 AS c FROM bands),
u AS (SELECT aoi, unnest(['product_quality_masks', 'sunglint_nir', 'uncertainty_ratio', 'combined']) AS step, unnest([a, b, c, a AND b AND c]) AS ok FROM q)
SELECT aoi, step, count(CASE WHEN ok THEN 1 END) AS kept, count(*) - count(CASE WHEN ok THEN 1 END) AS removed, count(*) AS total,
  {r6('count(CASE WHEN ok THEN 1 END) / CAST(count(*) AS DOUBLE)')} AS kept_fraction FROM u GROUP BY aoi, step""")
def quality_screen(spark, d):
    scl = F.col("scl")
    steps = px.quality_steps((scl == 0).cast("int"), scl.isin(8, 9).cast("int"), (scl == 10).cast("int"),
                             F.col("b8a"), F.col("b04") - F.col("b12"), 0.004 + 0.3 * F.col("b12"))
    return px.screen_report(bands(spark, d), steps, ["aoi"]).withColumn("kept_fraction", rnd(F.col("kept_fraction")))


@query("bbox_filter", f"""SELECT c_custkey, {r6('54 + (c_custkey * 37 % 1000) * 0.0031e0')} AS lon, {r6('24 + (c_custkey * 91 % 1000) * 0.0017e0')} AS lat FROM customer
WHERE 54 + (c_custkey * 37 % 1000) * 0.0031e0 BETWEEN 54.5 AND 56.2 AND 24 + (c_custkey * 91 % 1000) * 0.0017e0 BETWEEN 24.3 AND 25.1 AND c_acctbal > 0""")
def bbox_filter(spark, d):
    lon = 54 + (F.col("c_custkey") * 37 % 1000) * 0.0031
    lat = 24 + (F.col("c_custkey") * 91 % 1000) * 0.0017
    return (table(spark, d, "customer").where(px.in_bbox(lon, lat, (54.5, 24.3, 56.2, 25.1), F.col("c_acctbal") > 0))
            .select("c_custkey", rnd(lon).alias("lon"), rnd(lat).alias("lat")))


RING = [(54.4, 24.2), (55.9, 24.4), (56.6, 25.2), (55.2, 24.9), (54.7, 25.5)]
_EDGES = ", ".join(f"({i}, {x}e0, {y}e0, {RING[i - 1][0]}e0, {RING[i - 1][1]}e0)" for i, (x, y) in enumerate(RING))


@query("point_in_polygon", f"""WITH e(i, xi, yi, xj, yj) AS (VALUES {_EDGES}), p AS (SELECT c_custkey, c_nationkey,
  54 + (c_custkey * 37 % 1000) * 0.0031e0 AS x, 24 + (c_custkey * 91 % 1000) * 0.0017e0 AS y FROM customer),
s AS (SELECT c_custkey, c_nationkey, sum(CAST(((yi > y) <> (yj > y)) AND x < (xj - xi) * (y - yi) / (yj - yi) + xi AS INTEGER)) % 2 AS inside FROM p, e GROUP BY 1, 2)
SELECT c_nationkey, CAST(sum(inside) AS BIGINT) AS n_inside, CAST(sum(1 - inside) AS BIGINT) AS n_outside FROM s GROUP BY 1""")
def point_in_polygon(spark, d):
    pts = table(spark, d, "customer").select("c_nationkey", (54 + (F.col("c_custkey") * 37 % 1000) * 0.0031).alias("x"),
                                             (24 + (F.col("c_custkey") * 91 % 1000) * 0.0017).alias("y"))
    return (px.points_in_polygon(pts, "x", "y", RING).groupBy("c_nationkey")
            .agg(F.count_if("inside").alias("n_inside"), F.count_if(~F.col("inside")).alias("n_outside")))


@query("contrast_stretch", f"""WITH {SQL_BANDS}, p AS (SELECT aoi, quantile_cont(b8a, 0.02) AS lo, quantile_cont(b8a, 0.98) AS hi FROM bands GROUP BY aoi)
SELECT ok, px, ln, {r6('least(greatest((b8a - lo) / nullif(hi - lo, 0), 0), 1)')} AS stretched FROM bands JOIN p USING (aoi)""")
def contrast_stretch(spark, d):
    b = bands(spark, d)
    limits = exact_quantiles(b, ["aoi"], "b8a", {"lo": 0.02, "hi": 0.98}).select("aoi", "lo", "hi")
    return px.stretch(join_small(b, limits, ["aoi"]), "b8a", F.col("lo"), F.col("hi")).select(*ID, rnd(F.col("stretched")).alias("stretched"))


FEATURE_ROWS = ", ".join(f"('{n}', {r}, '{k}', '{u}')" for n, _, r, k, u, _, _ in px.FEATURES)


@query("feature_catalog", f"""WITH {SQL_BANDS}, c(feature, resolution_m, kind, units) AS (VALUES {FEATURE_ROWS}), {SQL_HUE.replace('ok, px, ln', 'ok, px, ln, aoi')},
wc AS (SELECT aoi, b03, b04, b11, b8a, b03 - b12 AS g, b04 - b12 AS r, b05 - b12 AS e, b06 - b12 AS i, b8a - b12 AS n,
  {SQL_PLATFORM.format('(704.1e0 - 664.6e0) / (740.5e0 - 664.6e0)', '(703.8e0 - 664.9e0) / (739.1e0 - 664.9e0)')} AS fm, {SQL_PLATFORM.format('(864.7e0 - 664.6e0) / (1613.7e0 - 664.6e0)', '(864.0e0 - 664.9e0) / (1610.4e0 - 664.9e0)')} AS ff FROM bands),
dg AS (SELECT aoi, 228.1e0 * r / nullif(1 - r / 0.1641e0, 0) AS tr, 3078.9e0 * n / nullif(1 - n / 0.2112e0, 0) AS tn, least(greatest((r - 0.05e0) / (0.07e0 - 0.05e0), 0), 1) AS k FROM wc),
v AS (SELECT aoi, 'MNDWI' AS feature, (b03 - b11) / (b03 + b11) AS v, -1 AS lo, 1 AS hi FROM wc
UNION ALL SELECT aoi, 'SWIR_B11', b11, NULL, NULL FROM wc
UNION ALL SELECT aoi, 'NDCI', (e - r) / nullif(e + r, 0), -1, 1 FROM wc
UNION ALL SELECT aoi, 'MCI', e - (r + (i - r) * fm), NULL, NULL FROM wc
UNION ALL SELECT aoi, 'FAI', b8a - (b04 + (b11 - b04) * ff), NULL, NULL FROM wc
UNION ALL SELECT aoi, 'RE_RATIO', CASE WHEN r > 1e-3 THEN e / r END, 0, 10 FROM wc
UNION ALL SELECT aoi, 'CDOM_RATIO', CASE WHEN r > 1e-3 THEN g / r END, 0, 20 FROM wc
UNION ALL SELECT aoi, 'TUR_NECHAD2016', CASE WHEN r < 0.5 * 0.19563e0 THEN 366.14e0 * r / (1 - r / 0.19563e0) END, 0, 1000 FROM wc
UNION ALL SELECT aoi, 'SPM_NECHAD2016', CASE WHEN r < 0.5 * 0.19563e0 THEN 342.10e0 * r / (1 - r / 0.19563e0) END, 0, 1000 FROM wc
UNION ALL SELECT aoi, 'TUR_DOGLIOTTI2015', (1 - k) * tr + k * tn, 0, 4000 FROM dg
UNION ALL SELECT aoi, 'HUE_ANGLE', hue, 0, 360 FROM hue)
SELECT feature, resolution_m, kind, units, aoi, count(*) AS n, count(CASE WHEN lo IS NULL AND v IS NOT NULL OR v BETWEEN lo AND hi THEN 1 END) AS n_valid,
  CAST(kind = 'PROXY' AND units IN ('mg m-3', 'g m-3', 'FNU', 'NTU', 'mg/L') AS INTEGER) AS proxy_with_units FROM v JOIN c USING (feature) GROUP BY ALL""")
def feature_catalog(spark, d):
    names = [n for n, *_ in px.FEATURES]
    f = px.feature_columns(BAND_COLUMNS, F.col("platform"))
    counted = (bands(spark, d).groupBy("aoi").agg(F.count(F.lit(1)).alias("n"), *[F.count(f[k]).alias(k) for k in names]))
    long = counted.unpivot(["aoi", "n"], names, "feature", "n_valid")
    catalog = spark.createDataFrame([(n, r, k, u) for n, _, r, k, u, _, _ in px.FEATURES],
                                    "feature string, resolution_m int, kind string, units string")
    # The catalog is a literal table of eleven rows.
    return long.join(F.broadcast(catalog), "feature").select(
        "feature", "resolution_m", "kind", "units", "aoi", "n", "n_valid",
        ((F.col("kind") == "PROXY") & F.col("units").isin("mg m-3", "g m-3", "FNU", "NTU", "mg/L")).cast("int").alias("proxy_with_units"))
