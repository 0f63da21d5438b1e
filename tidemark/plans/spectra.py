"""Queries of the spectral operators (spectra of 64 bands, ten labels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators import climatology as cl
from tidemark.operators import grid
from tidemark.operators import spectra as sp
from tidemark.plans.base import query, r6
from tidemark.plans.climatology import FEATS, RX_FEATURES, SQL_DETECT, SQL_REGION_RX, anomalies, detected, sql_rx
from tidemark.plans.grid import GRID_COLS, n_rows, sql_diamond
from tidemark.sources.tables import SQL_SPECTRA, spectra, table

NM = [400.0 + 8 * i for i in range(64)]


def rnd(c, digits=6):
    return F.round(c, digits)


def band_table(spark, d):
    return spectra(spark, d).select("ix", "nm").distinct()


MSI = list(zip(range(len(sp.MSI_CENTRES)), sp.MSI_CENTRES, sp.MSI_WIDTHS))
_MSI = ", ".join(f"({i}, {c}e0, {w}e0)" for i, c, w in MSI)
SQL_W = f"""tb(tix, tnm, fwhm) AS (VALUES {_MSI}), bt AS (SELECT DISTINCT ix, nm FROM spectra),
rw AS (SELECT tix, ix, exp(-0.5 * pow((tnm - nm) / (fwhm / (2 * sqrt(2 * ln(2)))), 2)) AS w FROM tb, bt WHERE abs(tnm - nm) <= 3 * fwhm / (2 * sqrt(2 * ln(2)))),
wt AS (SELECT tix, ix, w / sum(w) OVER (PARTITION BY tix) AS weight FROM rw)"""


def weights(spark, d):
    target = spark.createDataFrame(MSI, "tix int, tnm double, fwhm double")
    return sp.response_weights(band_table(spark, d), target)


@query("srf_matrix", f"WITH {SQL_SPECTRA}, {SQL_W} SELECT tix, CAST(ix AS INTEGER) AS ix, {r6('weight', 9)} AS weight FROM wt")
def srf_matrix(spark, d):
    return weights(spark, d).withColumn("weight", rnd(F.col("weight"), 9))


@query("spectral_resample", f"""WITH {SQL_SPECTRA}, {SQL_W}, g AS (SELECT vec_id, tix, sum(weight * CASE WHEN refl > 0.04 THEN refl END) AS num, coalesce(sum(CASE WHEN refl > 0.04 THEN weight END), 0) AS sup FROM spectra JOIN wt USING (ix) GROUP BY 1, 2)
SELECT vec_id, tix, {r6('sup')} AS support, {r6('CASE WHEN sup >= 0.5 THEN num / sup END')} AS refl FROM g""")
def spectral_resample(spark, d):
    s = spectra(spark, d).withColumn("refl", F.when(F.col("refl") > 0.04, F.col("refl")))
    return sp.resample(s, ["vec_id"], weights(spark, d)).withColumns({"support": rnd(F.col("support")), "refl": rnd(F.col("refl"))})


@query("nearest_band", f"""WITH {SQL_SPECTRA}, g AS (SELECT DISTINCT ix, nm FROM spectra WHERE ix % 7 <> 3), t(t) AS (VALUES (443.0), (560.0), (665.0), (704.0), (864.0))
SELECT CAST(t AS DOUBLE) AS target_nm, CAST(ix AS INTEGER) AS ix, nm, abs(nm - t) AS offset_nm FROM t, g QUALIFY row_number() OVER (PARTITION BY t ORDER BY abs(nm - t), ix) = 1""")
def nearest_band(spark, d):
    return sp.nearest_bands(band_table(spark, d).where(F.col("ix") % 7 != 3), [443.0, 560.0, 665.0, 704.0, 864.0])


@query("named_band_index", f"""WITH {SQL_SPECTRA}, w AS (SELECT vec_id, max(CASE WHEN ix = 20 THEN refl END) AS g, max(CASE WHEN ix = 58 THEN refl END) AS s FROM spectra WHERE refl >= 0.03 GROUP BY 1)
SELECT vec_id, {r6('(g - s) / (g + s + 1e-9)')} AS mndwi FROM (SELECT DISTINCT vec_id FROM spectra) LEFT JOIN w USING (vec_id)""")
def named_band_index(spark, d):
    s = spectra(spark, d).withColumn("refl", F.when(F.col("refl") >= 0.03, F.col("refl")))
    w = sp.at_bands(s, ["vec_id"], {"g": sp.nearest_index(NM, 560.0), "s": sp.nearest_index(NM, 864.0)})
    return w.select("vec_id", rnd((F.col("g") - F.col("s")) / (F.col("g") + F.col("s") + 1e-9)).alias("mndwi"))


@query("flag_runs", f"""WITH {SQL_SPECTRA}, f AS (SELECT vec_id, nm, ix - row_number() OVER (PARTITION BY vec_id ORDER BY ix) AS g FROM spectra WHERE refl < 0.055)
SELECT vec_id, min(nm) AS start_nm, max(nm) AS end_nm, count(*) AS n_bands FROM f GROUP BY vec_id, g""")
def flag_runs(spark, d):
    return sp.flag_runs(spectra(spark, d), ["vec_id"], F.col("refl") < 0.055)


@query("band_coverage", f"""WITH {SQL_SPECTRA}, a AS (SELECT min(nm) AS lo, max(nm) AS hi, count(DISTINCT ix) AS n FROM spectra), b AS (SELECT min(nm) + 50 AS lo, max(nm) + 300 AS hi, count(DISTINCT ix) AS n FROM spectra WHERE ix % 3 = 0)
SELECT a.n AS a_n, b.n AS b_n, greatest(a.lo, b.lo) AS overlap_lo, least(a.hi, b.hi) AS overlap_hi, greatest(least(a.hi, b.hi) - greatest(a.lo, b.lo), 0) AS overlap_nm, {r6('(a.hi - a.lo) / (a.n - 1)')} AS a_spacing, {r6('(b.hi - b.lo) / (b.n - 1)')} AS b_spacing FROM a, b""")
def band_coverage(spark, d):
    a = band_table(spark, d)
    b = a.where(F.col("ix") % 3 == 0).withColumn("nm", F.col("nm") + 50 + F.when(F.col("ix") == 63, 250.0).otherwise(0.0))
    return sp.coverage(a, b).withColumns({"a_spacing": rnd(F.col("a_spacing")), "b_spacing": rnd(F.col("b_spacing"))})


@query("band_snr", f"""WITH {SQL_SPECTRA} SELECT CAST(ix AS INTEGER) AS ix, nm, count(*) AS n, {r6('median(abs(refl) / sigma)')} AS snr, CAST(nm BETWEEN 400 AND 900 AND median(abs(refl) / sigma) >= 3 AS INTEGER) AS informative FROM spectra GROUP BY ix, nm""")
def band_snr(spark, d):
    return sp.band_snr(spectra(spark, d)).withColumns({"snr": rnd(F.col("snr")), "informative": F.col("informative").cast("int")})


@query("population_spectrum", f"""WITH {SQL_SPECTRA} SELECT label, CAST(ix AS INTEGER) AS ix, nm, count(*) AS n, {r6('avg(refl)')} AS mean, {r6('median(refl)')} AS median, {r6('stddev_pop(refl)')} AS std, {r6('quantile_cont(refl, 0.05)')} AS p05, {r6('quantile_cont(refl, 0.95)')} AS p95 FROM spectra GROUP BY label, ix, nm""")
def population_spectrum(spark, d):
    out = sp.population_spectrum(spectra(spark, d), ["label"])
    return out.select("label", "ix", "nm", "n", *[rnd(F.col(c)).alias(c) for c in ("mean", "median", "std", "p05", "p95")])


@query("difference_spectrum", f"""WITH {SQL_SPECTRA}, g AS (SELECT ix, nm, count(CASE WHEN label = 3 THEN 1 END) AS nh, count(CASE WHEN label <> 3 THEN 1 END) AS nb, avg(CASE WHEN label = 3 THEN refl END) - avg(CASE WHEN label <> 3 THEN refl END) AS df,
sqrt(var_pop(CASE WHEN label = 3 THEN refl END) / count(CASE WHEN label = 3 THEN 1 END) + var_pop(CASE WHEN label <> 3 THEN refl END) / count(CASE WHEN label <> 3 THEN 1 END)) AS se FROM spectra GROUP BY 1, 2)
SELECT CAST(ix AS INTEGER) AS ix, nm, nh AS n_hot, nb AS n_background, {r6('df')} AS difference, {r6('df / se')} AS z FROM g""")
def difference_spectrum(spark, d):
    out = sp.difference_spectrum(spectra(spark, d), F.col("label") == 3)
    return out.withColumns({"difference": rnd(F.col("difference")), "z": rnd(F.col("z"))})


def reference(spark, d):
    return spectra(spark, d).groupBy("ix").agg(F.avg("refl").alias("ref"))


SQL_SAM = """rf AS (SELECT ix, avg(refl) AS ref FROM spectra GROUP BY 1),
sam AS (SELECT vec_id, acos(least(greatest(sum(refl * ref) / (sqrt(sum(refl * refl)) * sqrt(sum(ref * ref))), -1), 1)) AS sam FROM spectra JOIN rf USING (ix) GROUP BY 1)"""


@query("spectral_angle", f"WITH {SQL_SPECTRA}, {SQL_SAM} SELECT vec_id, {r6('sam')} AS sam FROM sam")
def spectral_angle(spark, d):
    return sp.spectral_angle(spectra(spark, d), ["vec_id"], reference(spark, d)).withColumn("sam", rnd(F.col("sam")))


SQL_HULL = """hull AS (SELECT k.vec_id, k.nm, max(CASE WHEN b.nm > a.nm THEN a.refl + (b.refl - a.refl) * (k.nm - a.nm) / (b.nm - a.nm) ELSE a.refl END) AS cont, any_value(k.refl) AS refl
 FROM spectra k JOIN spectra a ON a.vec_id = k.vec_id AND a.nm <= k.nm JOIN spectra b ON b.vec_id = k.vec_id AND b.nm >= k.nm GROUP BY 1, 2)"""


@query("continuum_removal", f"WITH {SQL_SPECTRA}, {SQL_HULL} SELECT vec_id, nm, {r6('refl / cont')} AS removed FROM hull")
def continuum_removal(spark, d):
    return sp.continuum_removal(spectra(spark, d), ["vec_id"]).withColumn("removed", rnd(F.col("removed")))


@query("feature_depth", f"WITH {SQL_SPECTRA}, {SQL_HULL} SELECT vec_id, {r6('1 - min(refl / cont)')} AS depth FROM hull WHERE nm BETWEEN 655 AND 695 GROUP BY 1")
def feature_depth(spark, d):
    return sp.feature_depth(sp.continuum_removal(spectra(spark, d), ["vec_id"]), ["vec_id"], 675.0).withColumn("depth", rnd(F.col("depth")))


def sql_depth(name, w, value="refl"):
    m = [f"avg(CASE WHEN nm BETWEEN {x} - 5 AND {x} + 5 THEN {value} END)" for x in w]
    line = f"({m[0]} + ({m[2]} - {m[0]}) * {(w[1] - w[0]) / (w[2] - w[0])!r})"
    return f"CASE WHEN abs({line}) >= 1e-9 THEN 1 - {m[1]} / {line} END AS {name}"


SQL_DEPTHS = ", ".join(sql_depth(n, w) for n, w in sp.BAND_DEPTHS.items())


@query("band_depth", f"WITH {SQL_SPECTRA}, g AS (SELECT vec_id, {SQL_DEPTHS} FROM spectra GROUP BY 1) SELECT vec_id, {', '.join(f'{r6(n)} AS {n}' for n in sp.BAND_DEPTHS)} FROM g")
def band_depth(spark, d):
    out = sp.band_depths(spectra(spark, d), ["vec_id"])
    return out.select("vec_id", *[rnd(F.col(c)).alias(c) for c in sp.BAND_DEPTHS])


@query("event_spectrum_contrast", f"""WITH RECURSIVE {SQL_DETECT}, {sql_diamond(2)[0]}, rg AS MATERIALIZED (SELECT DISTINCT rp.scene, rp.row + dr AS row, rp.col + dc AS col FROM rp, o2),
ev AS (SELECT scene, unnest(['ndci', 'mci', 'tur']) AS band, unnest([ndci, mci, tur]) AS v FROM rp), bg AS (SELECT scene, unnest(['ndci', 'mci', 'tur']) AS band, unnest([ndci, mci, tur]) AS v FROM an ANTI JOIN rg USING (scene, row, col) WHERE coalesce(z_ndci, 0) < 1),
ee AS (SELECT scene, band, median(v) AS e FROM ev GROUP BY 1, 2), bb AS (SELECT scene, band, median(v) AS b, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.95) AS p95 FROM bg GROUP BY 1, 2)
SELECT scene, band, {r6('e', 8)} AS event_median, {r6('b', 8)} AS background_median, {r6('p05', 8)} AS background_p05, {r6('p95', 8)} AS background_p95 FROM ee JOIN bb USING (scene, band)""")
def event_spectrum_contrast(spark, d):
    st, lab, px = detected(spark, d)
    a = anomalies(st, FEATS)
    ring = grid.dilate(lab, ["scene"], 2, n_rows(spark, d), GRID_COLS)
    back = a.where(F.coalesce("ndci_z", F.lit(0.0)) < 1).join(ring, ["scene", "row", "col"], "left_anti")
    b = ["ndci", "mci", "tur"]
    long = lambda df: df.select("scene", *b).unpivot(["scene"], b, "band", "v")                       # noqa: E731
    ev = exact_quantiles(long(px), ["scene", "band"], "v", {"event_median": 0.5}).drop("n")
    bg = exact_quantiles(long(back), ["scene", "band"], "v", {"background_median": 0.5, "background_p05": 0.05, "background_p95": 0.95}).drop("n")
    out = ev.join(bg, ["scene", "band"])
    return out.select("scene", "band", *[rnd(F.col(c), 8).alias(c) for c in out.columns[2:]])


# --- fingerprints --------------------------------------------------------------------------
FP_BANDS = {"v443": 443, "v560": 560, "v665": 665, "v705": 705, "v865": 864, "v900": 900}
FP_IX = {n: sp.nearest_index(NM, t) for n, t in FP_BANDS.items()}
_FPW = ", ".join(f"max(CASE WHEN ix = {i} THEN refl END) AS {n}, max(CASE WHEN ix = {i} THEN ref END) AS b{n[1:]}" for n, i in FP_IX.items())
SQL_FP = f"""{SQL_SAM}, j AS (SELECT vec_id, ix, nm, refl, ref FROM spectra JOIN rf USING (ix)),
w AS (SELECT vec_id, {_FPW}, {sql_depth('d675s', (650.0, 675.0, 715.0))}, {sql_depth('d675b', (650.0, 675.0, 715.0), 'ref')}, {sql_depth('d620s', (600.0, 620.0, 650.0))}, {sql_depth('d620b', (600.0, 620.0, 650.0), 'ref')} FROM j GROUP BY 1),
f AS (SELECT vec_id, v443 / b443 AS a, v560 / b560 AS g, v665 / b665 AS r, v705 / b705 AS e, d675s - d675b AS d675, d620s - d620b AS d620, v865 - (v665 + (v900 - v665) * 0.85e0) - 0.01 AS fai, vec_id * 7.0 % 700 AS shore FROM w),
s1 AS (SELECT *, CASE WHEN e / r > 1.15 THEN least((e / r - 1) * 4, 4) ELSE 0 END + CASE WHEN d675 > 0.02 THEN least(d675 * 20, 3) ELSE 0 END AS bloom FROM f),
s2 AS (SELECT *, CASE WHEN r - a > 0.5 THEN least(r - a, 4) ELSE 0 END + CASE WHEN 0.5 * (g + r) > 1.8 THEN least(0.5 * (g + r) - 1, 3) ELSE 0 END AS sed, CASE WHEN d620 > 0.03 AND bloom > 1 THEN least(d620 * 20, 2) ELSE 0 END AS cyano,
 CASE WHEN r - a < -0.3 THEN least(a - r, 2) ELSE 0 END + CASE WHEN g - a > 0.6 AND bloom < 0.5 THEN least(g - a, 2) ELSE 0 END AS cdom, CASE WHEN fai > 0.005 THEN least(fai * 300, 3) ELSE 0 END AS film, CASE WHEN shore < 300 AND g - r > 0.8 THEN least(g - r, 2.5) ELSE 0 END AS bottom FROM s1),
s3 AS (SELECT *, sed + bloom + cyano + cdom + film + bottom AS tot FROM s2), s4 AS (SELECT *, CASE WHEN tot < 0.5 THEN 1 ELSE 0 END AS bgw FROM s3),
s5 AS (SELECT *, bgw / (tot + bgw) AS n0, sed / (tot + bgw) AS n1, bloom / (tot + bgw) AS n2, cyano / (tot + bgw) AS n3, cdom / (tot + bgw) AS n4, film / (tot + bgw) AS n5, bottom / (tot + bgw) AS n6 FROM s4),
s6 AS (SELECT *, list_reverse_sort([n0, n1, n2, n3, n4, n5, n6, 0]) AS o FROM s5)"""


#: Value, class it supports, weight and condition of each item of evidence.
SQL_EVIDENCE = [("r - a", "CASE WHEN r - a > 0.5 THEN 'SEDIMENT_LIKE' WHEN r - a < -0.3 THEN 'CDOM_LIKE' ELSE 'none' END", "abs(r - a)", "true"), ("0.5 * (g + r)", "CASE WHEN 0.5 * (g + r) > 1.8 THEN 'SEDIMENT_LIKE' ELSE 'none' END", "greatest(0.5 * (g + r) - 1, 0)", "true"),
                ("e / r", "CASE WHEN e / r > 1.15 THEN 'BLOOM_LIKE' ELSE 'none' END", "greatest((e / r - 1) * 3, 0)", "true"), ("d675", "CASE WHEN d675 > 0.02 THEN 'BLOOM_LIKE' ELSE 'none' END", "d675 * 10", "true"),
                ("d620", "CASE WHEN d620 > 0.03 AND bloom > 1 THEN 'CYANO_LIKE' ELSE 'none' END", "d620 * 10", "true"), ("g - a", "'CDOM_LIKE'", "least(g - a, 2)", "g - a > 0.6 AND bloom < 0.5"),
                ("fai", "CASE WHEN fai > 0.005 THEN 'SURFACE_FILM_LIKE' ELSE 'none' END", "greatest(fai * 200, 0)", "true"), ("g - r", "'BOTTOM_INFLUENCED'", "least(g - r, 2.5)", "shore < 300 AND g - r > 0.8")]


@query("fingerprint", f"""WITH {SQL_SPECTRA}, {SQL_FP} SELECT vec_id, {r6('n0')} AS background_water, {r6('n1')} AS sediment_like, {r6('n2')} AS bloom_like, {r6('n3')} AS cyano_like, {r6('n4')} AS cdom_like, {r6('n5')} AS surface_film_like, {r6('n6')} AS bottom_influenced,
CASE WHEN o[1] < 0.45 THEN 'UNKNOWN_ANOMALY' WHEN n0 = o[1] THEN 'BACKGROUND_WATER' WHEN n1 = o[1] THEN 'SEDIMENT_LIKE' WHEN n2 = o[1] THEN 'BLOOM_LIKE' WHEN n3 = o[1] THEN 'CYANO_LIKE' WHEN n4 = o[1] THEN 'CDOM_LIKE' WHEN n5 = o[1] THEN 'SURFACE_FILM_LIKE' ELSE 'BOTTOM_INFLUENCED' END AS top_class,
{r6('o[1] - o[2]')} AS confidence, 6 + CAST(g - a > 0.6 AND bloom < 0.5 AS INTEGER) + CAST(shore < 300 AND g - r > 0.8 AS INTEGER) AS n_evidence,
array_to_string(list_transform(list_sort(list_filter([{', '.join(f"CASE WHEN {c} THEN {{{{'o': -({w}), 'i': {i}, 't': '{n}=' || printf('%.4f', {v}) || ' ' || {s}}}}} END".replace('{{', '{').replace('}}', '}') for i, (n, (v, s, w, c)) in enumerate(zip(sp.EVIDENCE, SQL_EVIDENCE, strict=True)))}], lambda x: x IS NOT NULL)), lambda x: x.t), '; ') AS evidence,
array_to_string(list_filter([CASE WHEN shore < 300 THEN 'Pixel is ' || CAST(round_even(shore, 0) AS BIGINT) || '{sp.CAVEAT_SHALLOW}' END, CASE WHEN n0 = o[1] THEN '{sp.CAVEAT_BACKGROUND}' END,
CASE WHEN o[1] < 0.45 THEN 'Leading hypothesis (' || CASE {' '.join(f"WHEN n{i} = o[1] THEN '{sp.LABELS[c]}'" for i, c in enumerate(sp.CLASSES[:-1]))} END || ') scored only ' || CAST(round_even(100 * o[1], 0) AS BIGINT) || '%; reported as unclassified rather than asserted.' END], lambda x: x IS NOT NULL), ' ') AS caveats FROM s6""")
def fingerprint(spark, d):
    s = spectra(spark, d).join(reference(spark, d), "ix")
    wide = sp.at_bands(s, ["vec_id"], FP_IX)
    ref = sp.at_bands(s, ["vec_id"], {"b" + n[1:]: i for n, i in FP_IX.items()}, "ref")
    win = {"d675": (650.0, 675.0, 715.0), "d620": (600.0, 620.0, 650.0)}
    own = sp.band_depths(s, ["vec_id"], win)
    base = sp.band_depths(s, ["vec_id"], {f"{k}_bg": v for k, v in win.items()}, "ref")
    j = wide.join(ref, "vec_id").join(own, "vec_id").join(base, "vec_id")
    j = j.select("vec_id", *[F.when(F.col(f"b{n}") > 1e-9, F.col(f"v{n}") / F.col(f"b{n}")).alias(f"r{n}") for n in (443, 560, 665, 705)],
                 *[(F.col(k) - F.col(f"{k}_bg")).alias(k) for k in win],
                 (F.col("v865") - (F.col("v665") + (F.col("v900") - F.col("v665")) * 0.85) - 0.01).alias("fai"), (F.col("vec_id") * 7.0 % 700).alias("shore_m"))
    out = sp.fingerprint(j)
    listed = F.array_join(F.transform("evidence", lambda e: F.concat(e["name"], F.lit("="), F.format_string("%.4f", e["value"]), F.lit(" "), e["supports"])), "; ")
    return out.select("vec_id", "top_class", "n_evidence", listed.alias("evidence"), F.array_join("caveats", " ").alias("caveats"), *[rnd(F.col(c)).alias(c) for c in [x.lower() for x in sp.CLASSES[:-1]] + ["confidence"]])


NG = 6
_EDGES = [i * 64 // NG for i in range(NG + 1)]
_GRP = ", ".join(f"avg(CASE WHEN ix >= {_EDGES[i]} AND ix < {_EDGES[i + 1]} THEN refl END) AS g{i}" for i in range(NG))
SQL_GROUPS = f"gv AS (SELECT vec_id, label, {_GRP} FROM spectra GROUP BY 1, 2)"


def group_values(spark, d):
    return spectra(spark, d).groupBy("vec_id", "label").agg(
        *[F.avg(F.when((F.col("ix") >= _EDGES[i]) & (F.col("ix") < _EDGES[i + 1]), F.col("refl"))).alias(f"g{i}") for i in range(NG)])


SQL_FG = f"""{SQL_GROUPS}, {SQL_SAM}, dp AS (SELECT vec_id, {sql_depth('d620', (600.0, 620.0, 650.0))} FROM spectra GROUP BY 1), ds AS (SELECT avg(d620) AS dm, stddev_pop(d620) AS dd FROM dp),
bs AS (SELECT {', '.join(f'avg(g{i}) AS m{i}, stddev_pop(g{i}) AS s{i}' for i in range(NG))} FROM gv),
z AS (SELECT vec_id, sam * 0.4 AS sam, (d620 - dm) / dd AS d620_z, abs(g0 - m0) / s0 + abs(g5 - m5) / s5 AS rx, {', '.join(f'(g{i} - m{i}) / s{i} AS z{i}' for i in range(NG))} FROM gv JOIN sam USING (vec_id) JOIN dp USING (vec_id), ds, bs),
y AS (SELECT *, (z0 + z1 + z2 + z3 + z4 + z5) / 6 AS m, greatest({', '.join(f'abs(z{i})' for i in range(NG))}) AS mx, z3 - z0 AS edge FROM z),
x AS (SELECT *, sqrt(({' + '.join(f'pow(z{i} - m, 2)' for i in range(NG))}) / 6) AS sd FROM y),
c AS (SELECT *, greatest(0, 1.5 - mx) AS c0, CASE WHEN m > 0.5 THEN m * greatest(0, 1 - sd / (abs(m) + 1e-6)) ELSE 0 END AS c1, CASE WHEN edge > 0.5 AND z3 > 0.3 THEN edge + CASE WHEN z0 > 0.3 THEN -0.5 * z0 ELSE 0 END ELSE 0 END AS c2,
 CASE WHEN d620_z > 1 AND edge > 0 THEN least(d620_z, 3) ELSE 0 END AS c3, CASE WHEN z0 < -0.5 AND m < 0.3 THEN -z0 ELSE 0 END AS c4, CASE WHEN m > 0.5 AND greatest(0, 1 - sam / 0.3) > 0.3 THEN 0.4 * m * greatest(0, 1 - sam / 0.3) ELSE 0 END AS c5 FROM x),
u AS (SELECT *, CASE WHEN rx >= 1.5 AND greatest(c1, c2, c3, c4, c5, 0) < 0.3 THEN least(3, rx / 1.5) ELSE 0 END AS c6 FROM c), o AS (SELECT *, list_reverse_sort([c0, c1, c2, c3, c4, c5, c6]) AS o FROM u)"""


@query("fingerprint_groups", f"""WITH {SQL_SPECTRA}, {SQL_FG} SELECT vec_id, {', '.join(f"{r6(f'c{i}')} AS {c.lower()}" for i, c in enumerate(sp.GROUP_CLASSES))},
CASE {' '.join(f"WHEN c{i} = o[1] THEN '{c}'" for i, c in enumerate(sp.GROUP_CLASSES))} END AS top_class, {r6('CASE WHEN o[1] > 0 THEN least(greatest((o[1] - o[2]) / (abs(o[1]) + 1e-6), 0), 1) ELSE 0 END')} AS confidence FROM o""")
def fingerprint_groups(spark, d):
    g = group_values(spark, d).drop("label")
    sam = sp.spectral_angle(spectra(spark, d), ["vec_id"], reference(spark, d))
    depth = sp.band_depths(spectra(spark, d), ["vec_id"], {"d620": (600.0, 620.0, 650.0)})
    z = sp.standardise(g.join(sam, "vec_id").join(depth, "vec_id"), [], [f"g{i}" for i in range(NG)] + ["d620"])
    z = z.select("vec_id", (F.col("sam") * 0.4).alias("sam"), F.col("d620_std").alias("d620_z"), *[F.col(f"g{i}_std").alias(f"z{i}") for i in range(NG)])
    z = z.withColumns({"rx": F.abs("z0") + F.abs("z5"), "rx_limit": F.lit(1.5)})
    out = sp.fingerprint_groups(z, NG)
    return out.select("vec_id", "top_class", *[rnd(F.col(c)).alias(c) for c in [x.lower() for x in sp.GROUP_CLASSES] + ["confidence"]])


# --- RX ----------------------------------------------------------------------------------------
_RX, _D2 = sql_rx("gs", ["half"], "g1", "g4")
SQL_RX = f"{SQL_GROUPS}, gs AS MATERIALIZED (SELECT vec_id, label % 2 AS half, g1, g4 FROM gv), {_RX}"


def rx_input(spark, d):
    return group_values(spark, d).select("vec_id", (F.col("label") % 2).alias("half"), "g1", "g4")


@query("robust_background", f"WITH {SQL_SPECTRA}, {SQL_RX} SELECT half, n AS n_background, {r6('ma')} AS mean_g1, {r6('mb')} AS mean_g4, {r6('vb / (va * vb - vab * vab)', 3)} AS inv_11, {r6('-vab / (va * vb - vab * vab)', 3)} AS inv_12 FROM t3")
def robust_background(spark, d):
    bg = sp.robust_background(rx_input(spark, d), ["half"], ["g1", "g4"])
    return bg.select("half", "n_background", rnd(F.get("mu", 0)).alias("mean_g1"), rnd(F.get("mu", 1)).alias("mean_g4"), rnd(F.get("inv", 0), 3).alias("inv_11"), rnd(F.get("inv", 1), 3).alias("inv_12"))


@query("rx_anomaly", f"""WITH {SQL_SPECTRA}, {SQL_RX}, sc AS (SELECT x.*, {_D2('s')} AS rx FROM gs x JOIN t3 s USING (half)), th AS (SELECT half, quantile_cont(rx, 0.9) AS lim FROM sc GROUP BY 1)
SELECT vec_id, half, {r6('rx')} AS rx, {r6('exp(-rx / 2)')} AS p_chi2, CAST(rx >= lim AS INTEGER) AS anomalous FROM sc JOIN th USING (half)""")
def rx_anomaly(spark, d):
    x = rx_input(spark, d)
    s = sp.rx_scores(x, sp.robust_background(x, ["half"], ["g1", "g4"]), ["half"], ["g1", "g4"])
    limit = exact_quantiles(s, ["half"], "rx", {"limit": 0.9}).drop("n")
    out = s.join(limit, "half")
    return out.select("vec_id", "half", rnd(F.col("rx")).alias("rx"), rnd(sp.chi2_tail(F.col("rx"), 2)).alias("p_chi2"), (F.col("rx") >= F.col("limit")).cast("int").alias("anomalous"))


@query("rx_percentile_region", f"""WITH RECURSIVE {SQL_DETECT}, {SQL_REGION_RX} SELECT scene, CAST(label AS BIGINT) AS label, {r6('region_rx')} AS region_rx, {r6('rx_pct')} AS rx_pct FROM rx""")
def rx_percentile_region(spark, d):
    st, _, px = detected(spark, d, {"ndci": 0.02})
    px = px.select("scene", "label", "row", "col").join(st.select("scene", "row", "col", *RX_FEATURES), ["scene", "row", "col"])
    out = sp.rx_percentile(st.select("scene", *RX_FEATURES), px, ["scene"], RX_FEATURES)
    return out.select("scene", "label", rnd(F.col("region_rx")).alias("region_rx"), rnd(F.col("rx_pct")).alias("rx_pct"))


@query("anomaly_mass_rank", f"""WITH RECURSIVE {SQL_DETECT}, r AS (SELECT scene, label, avg(z_ndci) * count(*) AS mass FROM rp GROUP BY 1, 2)
SELECT scene, CAST(label AS BIGINT) AS label, {r6('mass')} AS mass, CAST(row_number() OVER (PARTITION BY scene ORDER BY mass DESC, label) AS INTEGER) AS mass_rank FROM r""")
def anomaly_mass_rank(spark, d):
    _, _, px = detected(spark, d)
    out = sp.anomaly_mass_rank(grid.region_stats(px, ["scene"], 20.0, "ndci_z"), ["scene"])
    return out.select("scene", "label", rnd(F.col("mass")).alias("mass"), "mass_rank")


# Pooled background: every label below 7, both halves together; features of two band groups.
_PX, _PD2 = sql_rx("gb", ["one"], "g1", "g4")
_SHRUNK = "ps AS MATERIALIZED (SELECT 1 AS one, n, ma, mb, 0.85e0 * va + 0.075e0 * (va + vb) AS va, 0.85e0 * vb + 0.075e0 * (va + vb) AS vb, 0.85e0 * vab AS vab FROM t3)"


@query("rx_pooled", f"""WITH {SQL_SPECTRA}, {SQL_GROUPS}, ga AS MATERIALIZED (SELECT vec_id, label % 2 AS half, label < 7 AS bg, g1, g4 FROM gv), gb AS MATERIALIZED (SELECT 1 AS one, g1, g4 FROM ga WHERE bg), {_PX}, {_SHRUNK},
rf AS (SELECT avg(g1) AS r1, avg(g4) AS r4 FROM gb), sc AS MATERIALIZED (SELECT x.*, {_PD2('s')} AS rx, n, acos(least(greatest((g1 * r1 + g4 * r4) / (sqrt(g1 * g1 + g4 * g4) * sqrt(r1 * r1 + r4 * r4)), -1), 1)) AS sam FROM ga x, ps s, rf), th AS (SELECT quantile_cont(rx, 0.9) AS lim FROM sc WHERE bg)
SELECT vec_id, half, {r6('rx')} AS rx, {r6('exp(-rx / 2)')} AS p_value, {r6('sam')} AS sam, CAST(rx >= lim AS INTEGER) AS anomalous, {r6('lim')} AS threshold, n AS n_background, 2 AS n_components, 1.0e0 AS explained_variance FROM sc, th""")
def rx_pooled(spark, d):
    """Spectra of both dates against one pooled, trimmed and shrunk background, in principal components."""
    x = group_values(spark, d).select("vec_id", (F.col("label") % 2).alias("half"), (F.col("label") < 7).alias("bg"), "g1", "g4")
    out = sp.pooled_rx(x, ["g1", "g4"], F.col("bg"), (), 2, 0.15, 0.10)
    return out.select("vec_id", "half", *[rnd(F.col(c)).alias(c) for c in ("rx", "p_value", "sam", "threshold", "explained_variance")], F.col("anomalous").cast("int").alias("anomalous"), "n_background", "n_components")


@query("rx_principal", f"""WITH {SQL_SPECTRA}, {SQL_GROUPS}, ga AS MATERIALIZED (SELECT vec_id, label % 2 AS half, label < 7 AS bg, g1, g4 FROM gv), mo AS (SELECT half, avg(g1) AS m1, avg(g4) AS m4, var_samp(g1) AS a, var_samp(g4) AS b, covar_samp(g1, g4) AS c FROM ga WHERE bg GROUP BY 1),
ei AS (SELECT *, (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c) AS l1 FROM mo), ax AS (SELECT *, c / sqrt(c * c + (l1 - a) * (l1 - a)) AS e1, (l1 - a) / sqrt(c * c + (l1 - a) * (l1 - a)) AS e4 FROM ei),
z0 AS MATERIALIZED (SELECT ga.*, ((g1 - m1) * e1 + (g4 - m4) * e4) AS z, l1 / (a + b) AS evr FROM ga JOIN ax USING (half)),
{', '.join(f"s{i} AS MATERIALIZED (SELECT half, count(*) AS n, avg(z) AS m, var_samp(z) AS v FROM {'z0 WHERE bg' if i == 0 else f'k{i}'} GROUP BY half), q{i} AS MATERIALIZED (SELECT half, quantile_cont((z - m) * (z - m) / v, 0.95) AS cut FROM {'(SELECT * FROM z0 WHERE bg)' if i == 0 else f'k{i}'} JOIN s{i} USING (half) GROUP BY half), k{i + 1} AS MATERIALIZED (SELECT z0.* FROM z0 JOIN s{i} USING (half) JOIN q{i} USING (half) WHERE bg AND (z - m) * (z - m) / v <= cut)" for i in range(3))},
s3 AS MATERIALIZED (SELECT half, count(*) AS n, avg(z) AS m, var_samp(z) AS v FROM k3 GROUP BY half), sc AS (SELECT z0.*, n, (z - m) * (z - m) / v AS rx FROM z0 JOIN s3 USING (half)), th AS (SELECT half, quantile_cont(rx, 0.99) AS lim FROM sc WHERE bg GROUP BY 1)
SELECT vec_id, half, {r6('rx', 5)} AS rx, {r6('evr')} AS explained_variance, CAST(rx >= lim AS INTEGER) AS anomalous, n AS n_background FROM sc JOIN th USING (half)""")
def rx_principal(spark, d):
    """The same per date on the first principal component alone."""
    x = group_values(spark, d).select("vec_id", (F.col("label") % 2).alias("half"), (F.col("label") < 7).alias("bg"), "g1", "g4")
    out = sp.pooled_rx(x, ["g1", "g4"], F.col("bg"), ["half"], 1)
    return out.select("vec_id", "half", rnd(F.col("rx"), 5).alias("rx"), rnd(F.col("explained_variance")).alias("explained_variance"), F.col("anomalous").cast("int").alias("anomalous"), "n_background")


_COV = ", ".join(f"covar_pop(g{min(i, j)}, g{max(i, j)})" for i in range(NG) for j in range(NG))
_IJ = f"list_transform(range({NG * NG}), lambda i: {{}})"
_SQUARE = _IJ.format(f"list_sum(list_transform(range({NG}), lambda k: p[(i // {NG}) * {NG} + k + 1] * p[k * {NG} + i % {NG} + 1]))")
_TRACE = "list_sum(list_transform(range({n}), lambda k: {m}[k * {s} + 1]))"


def sql_axes(k):
    """CTEs ax0 .. : eigenvectors of the band groups' covariance, each by repeated squaring of what the ones before leave."""
    parts = [f"a0 AS MATERIALIZED (SELECT [{_COV}] AS a FROM gv)"]
    for c in range(k):
        parts.append(f"""p{c}(step, p) AS (SELECT 0, list_transform(a, lambda v: v / {_TRACE.format(n=NG, m='a', s=NG + 1)}) FROM a{c} UNION ALL SELECT step + 1, list_transform(q, lambda v: v / {_TRACE.format(n=NG, m='q', s=NG + 1)}) FROM (SELECT step, {_SQUARE} AS q FROM p{c} WHERE step < 24)),
j{c} AS (SELECT p, list_position(list_transform(range({NG}), lambda k: p[k * {NG + 1} + 1]), list_max(list_transform(range({NG}), lambda k: p[k * {NG + 1} + 1]))) - 1 AS j FROM p{c} WHERE step = 24),
ax{c} AS MATERIALIZED (SELECT list_transform(range({NG}), lambda i: p[i * {NG} + j + 1] / sqrt(p[j * {NG + 1} + 1])) AS e FROM j{c}),
l{c} AS MATERIALIZED (SELECT list_sum({_IJ.format(f'e[i // {NG} + 1] * a[i + 1] * e[i % {NG} + 1]')}) AS l FROM a{c}, ax{c}),
a{c + 1} AS MATERIALIZED (SELECT {_IJ.format(f'a[i + 1] - l * e[i // {NG} + 1] * e[i % {NG} + 1]')} AS a FROM a{c}, ax{c}, l{c})""")
    return ", ".join(parts)


@query("pca_reduce", f"""WITH RECURSIVE {SQL_SPECTRA}, {SQL_GROUPS}, {sql_axes(4)}
SELECT vec_id, {', '.join(r6(' + '.join(f'g{i} * ax{c}.e[{i + 1}]' for i in range(NG))) + f' AS pc{c}' for c in range(4))} FROM gv, ax0, ax1, ax2, ax3""")
def pca_reduce(spark, d):
    """Component scores of every spectrum."""
    from pyspark.ml.functions import vector_to_array
    f = [f"g{i}" for i in range(NG)]
    _, out = sp.pca(group_values(spark, d), f, 4)
    arr = out.select("vec_id", vector_to_array("pc").alias("pc"))
    return arr.select("vec_id", *[rnd(F.get("pc", i)).alias(f"pc{i}") for i in range(4)])


SQL_PRODUCT = """pq AS (SELECT vec_id, ix, nm, CASE label WHEN 0 THEN 'Lw' WHEN 1 THEN 'rho_w' WHEN 2 THEN 'L_toa' WHEN 3 THEN 'Lw' ELSE 'Rrs' END AS quantity, CASE WHEN label = 3 THEN NULL ELSE 1.5e0 + 0.01e0 * ix END AS ed, refl - 0.05 AS v FROM spectra),
pn AS (SELECT vec_id, ix, quantity, CASE WHEN quantity = 'L_toa' THEN 'unknown quantity' WHEN quantity = 'Lw' AND ed IS NULL THEN 'Lw needs Ed' WHEN nm NOT BETWEEN 395 AND 1705 THEN 'band outside range' END AS refused,
CASE WHEN quantity = 'L_toa' THEN NULL WHEN quantity = 'Lw' THEN CASE WHEN ed > 0 THEN v / ed END WHEN quantity = 'rho_w' THEN v / pi() ELSE v END AS rrs FROM pq)"""


def products(spark, d):
    label = F.col("label")
    s = spectra(spark, d).withColumn("quantity", F.when(label.isin(0, 3), "Lw").when(label == 1, "rho_w").when(label == 2, "L_toa").otherwise("Rrs"))
    return s.withColumns({"ed": F.when(label != 3, 1.5 + 0.01 * F.col("ix")), "v": F.col("refl") - 0.05})


@query("real_product_normalise", f"""WITH {SQL_SPECTRA}, {SQL_PRODUCT} SELECT vec_id, ix, quantity, {r6('rrs', 8)} AS rrs, refused, CAST(coalesce(rrs < -0.01, false) AS INTEGER) AS negative FROM pn""")
def real_product_normalise(spark, d):
    from tidemark.operators.ingest import normalised_bands
    out = normalised_bands(products(spark, d), "v", "nm", "quantity", "ed")
    return out.select("vec_id", "ix", "quantity", rnd(F.col("rrs"), 8).alias("rrs"), "refused", F.col("negative").cast("int").alias("negative"))


@query("real_product_summary", f"""WITH {SQL_SPECTRA}, {SQL_PRODUCT} SELECT vec_id, quantity, max(refused) AS refused, count(rrs) AS n_bands, {r6('sum(rrs)')} AS sum_rrs, CAST(coalesce(bool_or(rrs < -0.01), false) AS INTEGER) AS negative_note FROM pn GROUP BY 1, 2""")
def real_product_summary(spark, d):
    from tidemark.operators.ingest import normalise_product
    out = normalise_product(products(spark, d), ["vec_id", "quantity"], "v", "nm", "quantity", "ed")
    return out.select("vec_id", "quantity", "refused", "n_bands", rnd(F.col("sum_rrs")).alias("sum_rrs"), F.col("negative_note").cast("int").alias("negative_note"))


@query("product_good_bands", f"""WITH {SQL_SPECTRA}, g AS (SELECT ix FROM spectra GROUP BY 1 HAVING avg(CAST(refl < 0.05 AS INTEGER)) < 0.22)
SELECT label, CAST(ix AS INTEGER) AS ix, count(*) AS n, {r6('avg(refl)')} AS mean FROM spectra SEMI JOIN g USING (ix) GROUP BY 1, 2""")
def product_good_bands(spark, d):
    s = spectra(spark, d)
    flags = s.groupBy("ix").agg((F.avg((F.col("refl") < 0.05).cast("double")) < 0.22).alias("good"))
    kept = s.join(flags.where("good"), "ix", "left_semi")
    return kept.groupBy("label", "ix").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("refl")).alias("mean"))
