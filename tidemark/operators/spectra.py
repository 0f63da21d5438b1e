"""Operators on long spectra (one row per spectrum and band) and on feature vectors."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.joins import join_small
from tidemark.functions.nulls import ratio
from tidemark.functions.ordering import running_sums
from tidemark.functions.quantiles import exact_quantiles

# --- Fixed values: shoulders of the diagnostic absorption features (nm) ----------------
BAND_DEPTHS = {"chl_a_675": (650.0, 675.0, 715.0), "phycocyanin_620": (600.0, 620.0, 650.0), "chl_a_443": (412.0, 443.0, 490.0)}
# --- Fixed values: optical classes in reporting order ----------------------------------
EVIDENCE = ["visible_tilt_665_over_443", "broadband_vis_enhancement", "red_edge_ratio_705_665", "chl_absorption_depth_675", "phycocyanin_absorption_620", "blue_depression_443", "floating_algae_index", "green_dominant_nearshore"]
LABELS = {
    "BACKGROUND_WATER": "Normal / background water", "SEDIMENT_LIKE": "High turbidity / suspended sediment signature", "BLOOM_LIKE": "Chlorophyll / bloom-like signature",
    "CYANO_LIKE": "Cyanobacteria-like pigment signature", "CDOM_LIKE": "Coloured dissolved organic matter signature", "SURFACE_FILM_LIKE": "Surface film / floating material signature",
    "BOTTOM_INFLUENCED": "Shallow water / bottom reflectance", "UNKNOWN_ANOMALY": "Unclassified spectral anomaly",
}
CAVEAT_SHALLOW = " m from shore. Bottom reflectance is a competing explanation that a single scene cannot exclude; the temporal baseline test is required."
CAVEAT_BACKGROUND = "No distinctive optical signature; treated as background."
CLASSES = ["BACKGROUND_WATER", "SEDIMENT_LIKE", "BLOOM_LIKE", "CYANO_LIKE", "CDOM_LIKE", "SURFACE_FILM_LIKE", "BOTTOM_INFLUENCED", "UNKNOWN_ANOMALY"]
GROUP_CLASSES = ["BACKGROUND_WATER", "SEDIMENT_LIKE", "BLOOM_LIKE", "CYANO_LIKE", "CDOM_LIKE", "SURFACE_FILM_LIKE", "UNKNOWN_ANOMALY"]
# --- Fixed values: multispectral sensor, band centres and widths (nm) ------------------
MSI_CENTRES = [443.0, 492.0, 560.0, 665.0, 704.0, 740.0, 783.0, 833.0, 865.0, 1610.0, 2190.0]
MSI_WIDTHS = [21.0, 66.0, 36.0, 31.0, 15.0, 15.0, 20.0, 106.0, 21.0, 91.0, 175.0]
FWHM_TO_SIGMA = 2.0 * math.sqrt(2.0 * math.log(2.0))


# ---------------------------------------------------------------- bands and resampling
def response_weights(source: DataFrame, target: DataFrame, truncate: float = 3.0) -> DataFrame:
    """Gaussian response of target bands (tix, tnm, fwhm) at source bands (ix, nm), rows summing to one.

    Band tables are instrument-sized; they still meet through wavelength buckets as wide as
    the widest response, so only overlapping bands pair up.
    """
    sigma = F.col("fwhm") / FWHM_TO_SIGMA
    width = target.agg(F.max(truncate * sigma)).first()[0] or 1.0
    src = source.select("ix", "nm", F.floor(F.col("nm") / width).alias("_b"))
    base = F.floor(F.col("tnm") / width)
    tgt = target.select("tix", "tnm", sigma.alias("_s"), F.explode(F.array(base - 1, base, base + 1)).alias("_b"))
    w = tgt.join(src, "_b").where(F.abs(F.col("tnm") - F.col("nm")) <= truncate * F.col("_s"))
    w = w.withColumn("_w", F.exp(-0.5 * F.pow((F.col("tnm") - F.col("nm")) / F.col("_s"), 2)))
    return w.select("tix", "ix", (F.col("_w") / F.sum("_w").over(Window.partitionBy("tix"))).alias("weight"))


def resample(spectra: DataFrame, keys: Sequence[str], weights: DataFrame, value: str = "refl", min_support: float = 0.5) -> DataFrame:
    """Weighted mean over the finite source bands; NULL below the minimum support."""
    joined = spectra.join(weights, "ix")
    have = F.when(F.col(value).isNotNull(), F.col("weight"))
    out = joined.groupBy(*keys, "tix").agg(F.sum(F.col("weight") * F.col(value)).alias("_num"), F.coalesce(F.sum(have), F.lit(0.0)).alias("support"))
    return out.select(*keys, "tix", "support", F.when(F.col("support") >= min_support, ratio(F.col("_num"), F.col("support"))).alias(value))


def nearest_bands(bands: DataFrame, targets: Sequence[float]) -> DataFrame:
    """For every wavelength the nearest band, its position and the offset (one aggregate of the band table)."""
    picks = [F.min_by(F.struct(F.lit(float(t)).alias("target_nm"), "ix", "nm", F.abs(F.col("nm") - t).alias("offset_nm")),
                      F.struct(F.abs(F.col("nm") - t), F.col("ix"))).alias(f"_{i}") for i, t in enumerate(targets)]
    return bands.agg(*picks).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(targets))])))


def nearest_index(grid_nm: Sequence[float], target: float) -> int:
    """Nearest band of a known wavelength grid (first on ties)."""
    return min(range(len(grid_nm)), key=lambda i: abs(grid_nm[i] - target))


def at_bands(spectra: DataFrame, keys: Sequence[str], wanted: Mapping[str, int], value: str = "refl") -> DataFrame:
    """Wide table of single bands, by conditional aggregation over the long one."""
    return (spectra.where(F.col("ix").isin(sorted(set(wanted.values())))).groupBy(*keys)
            .agg(*[F.max(F.when(F.col("ix") == i, F.col(value))).alias(n) for n, i in wanted.items()]))


def flag_runs(spectra: DataFrame, keys: Sequence[str], flag: Column) -> DataFrame:
    """Runs of consecutive flagged bands as [start_nm, end_nm, count] (a spectrum has a fixed number of bands)."""
    hit = spectra.where(flag)
    group = F.col("ix") - F.row_number().over(Window.partitionBy(*keys).orderBy("ix"))
    return (hit.withColumn("_g", group).groupBy(*keys, "_g")
            .agg(F.min("nm").alias("start_nm"), F.max("nm").alias("end_nm"), F.count(F.lit(1)).alias("n_bands")).drop("_g"))


def coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlap and mean spacing of two band tables (ix, nm); each side is one aggregated row."""
    def side(df, p):
        return df.agg(F.min("nm").alias(f"{p}_lo"), F.max("nm").alias(f"{p}_hi"), F.count(F.lit(1)).alias(f"{p}_n")).withColumn("_k", F.lit(1))
    j = side(a, "a").join(side(b, "b"), "_k")
    lo, hi = F.greatest("a_lo", "b_lo"), F.least("a_hi", "b_hi")
    spacing = {p: (F.col(f"{p}_hi") - F.col(f"{p}_lo")) / F.greatest(F.col(f"{p}_n") - 1, F.lit(1)) for p in "ab"}
    return j.select("a_n", "b_n", lo.alias("overlap_lo"), hi.alias("overlap_hi"), F.greatest(hi - lo, F.lit(0.0)).alias("overlap_nm"),
                    spacing["a"].alias("a_spacing"), spacing["b"].alias("b_spacing"))


# ---------------------------------------------------------------- populations
def band_snr(spectra: DataFrame, value: str = "refl", sigma: str = "sigma", min_n: int = 10, min_snr: float = 3.0,
             nm_range: tuple[float, float] = (400.0, 900.0)) -> DataFrame:
    """Median |value| / sigma per band and whether the band carries water colour."""
    ok = spectra.where(F.col(value).isNotNull() & (F.col(sigma) > 0)).select("ix", "nm", (F.abs(value) / F.col(sigma)).alias("_r"))
    q = exact_quantiles(ok, ["ix", "nm"], "_r", {"snr": 0.5})
    q = q.withColumn("snr", F.when(F.col("n") > min_n, F.col("snr")))
    good = F.col("nm").between(*nm_range) & F.coalesce(F.col("snr") >= min_snr, F.lit(False))
    return q.withColumn("informative", good)


def population_spectrum(spectra: DataFrame, keys: Sequence[str], value: str = "refl") -> DataFrame:
    """Mean, median, population sd, 5th and 95th percentile of every band of a population."""
    k = [*keys, "ix", "nm"]
    q = exact_quantiles(spectra, k, value, {"median": 0.5, "p05": 0.05, "p95": 0.95})
    m = spectra.groupBy(*k).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return q.join(m, k)


def difference_spectrum(spectra: DataFrame, hot: Column, value: str = "refl") -> DataFrame:
    """Hot minus background per band and the difference over its standard error, in one aggregate."""
    h, b = F.when(hot, F.col(value)), F.when(~hot, F.col(value))
    out = spectra.groupBy("ix", "nm").agg(F.avg(h).alias("_mh"), F.avg(b).alias("_mb"), F.var_pop(h).alias("_vh"), F.var_pop(b).alias("_vb"),
                                          F.count(h).alias("n_hot"), F.count(b).alias("n_background"))
    diff = F.col("_mh") - F.col("_mb")
    se = F.sqrt(F.col("_vh") / F.greatest("n_hot", F.lit(1)) + F.col("_vb") / F.greatest("n_background", F.lit(1)))
    return out.select("ix", "nm", "n_hot", "n_background", diff.alias("difference"), ratio(diff, se).alias("z"))


def spectral_angle(spectra: DataFrame, keys: Sequence[str], reference: DataFrame, value: str = "refl", ref: str = "ref") -> DataFrame:
    """Angle (radians) between every spectrum and a reference spectrum (ix, ref)."""
    j = spectra.join(reference.select("ix", ref), "ix")
    g = j.groupBy(*keys).agg(F.sum(F.col(value) * F.col(ref)).alias("_ab"), F.sum(F.col(value) * F.col(value)).alias("_aa"), F.sum(F.col(ref) * F.col(ref)).alias("_bb"))
    c = ratio(F.col("_ab"), F.sqrt("_aa") * F.sqrt("_bb"))
    return g.select(*keys, F.when(c.isNotNull(), F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))).alias("sam"))


def as_arrays(spectra: DataFrame, keys: Sequence[str], value: str = "refl") -> DataFrame:
    """One sorted array of (nm, value) per spectrum; its length is the instrument's band count."""
    return spectra.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("nm", F.col(value).alias("v")))).alias("pts"))


def continuum_removal(spectra: DataFrame, keys: Sequence[str], value: str = "refl") -> DataFrame:
    """Divide by the upper convex hull, found by walking to the steepest later point.

    Every step of the fold moves from a hull vertex to the next one, so a spectrum costs
    (bands x vertices) evaluations inside one array expression.
    """
    arr = as_arrays(spectra.where(F.col(value).isNotNull()), keys, value).where(F.size("pts") >= 3)

    def walk(state, _):
        cur = state[F.size(state) - 1]
        ahead = F.filter("pts", lambda p: p["nm"] > cur["nm"])
        steps = F.transform(ahead, lambda p: F.struct(((p["v"] - cur["v"]) / (p["nm"] - cur["nm"])).alias("slope"), p["nm"].alias("nm"), p["v"].alias("v")))
        nxt = F.array_max(steps)
        return F.when(F.size(ahead) == 0, state).otherwise(F.concat(state, F.array(F.struct(nxt["nm"].alias("nm"), nxt["v"].alias("v")))))

    hull = F.aggregate(F.sequence(F.lit(1), F.size("pts") - 1), F.slice("pts", 1, 1), walk)
    h = arr.withColumn("_hull", hull).select(*keys, "_hull", F.explode("pts").alias("_p"))
    nm, v = F.col("_p.nm"), F.col("_p.v")
    left = F.array_max(F.filter("_hull", lambda q: q["nm"] <= nm))
    right = F.array_min(F.filter("_hull", lambda q: q["nm"] >= nm))
    h = h.withColumn("_l", left).withColumn("_r", right)
    span = F.col("_r.nm") - F.col("_l.nm")
    cont = F.when(span > 0, F.col("_l.v") + (F.col("_r.v") - F.col("_l.v")) * (nm - F.col("_l.nm")) / span).otherwise(F.col("_l.v"))
    return h.select(*keys, nm.alias("nm"), ratio(v, cont).alias("removed"))


def feature_depth(removed: DataFrame, keys: Sequence[str], centre: float, half: float = 20.0) -> DataFrame:
    """1 - minimum of the continuum-removed spectrum inside a window."""
    return removed.where(F.col("nm").between(centre - half, centre + half)).groupBy(*keys).agg((1.0 - F.min("removed")).alias("depth"))


def depth_of(left: Column, centre: Column, right: Column, nm: tuple[float, float, float]) -> Column:
    """1 - R(centre) / local continuum; NULL when the continuum vanishes."""
    line = left + (right - left) * ((nm[1] - nm[0]) / (nm[2] - nm[0]))
    return F.when(F.abs(line) >= 1e-9, 1.0 - centre / line)


def band_depths(spectra: DataFrame, keys: Sequence[str], windows: Mapping[str, tuple[float, float, float]] = BAND_DEPTHS,
                value: str = "refl", half: float = 5.0) -> DataFrame:
    """Local band depths against the line between two shoulders, all windows in one aggregate."""
    aggs = [F.avg(F.when(F.col("nm").between(nm - half, nm + half), F.col(value))).alias(f"_{name}_{i}")
            for name, w in windows.items() for i, nm in enumerate(w)]
    g = spectra.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[depth_of(*[F.col(f"_{name}_{i}") for i in range(3)], w).alias(name) for name, w in windows.items()])


# ---------------------------------------------------------------- optical fingerprints
def _top(scores: Mapping[str, Column], order: Sequence[str]) -> Column:
    """Best and second score; earlier classes win ties."""
    return F.reverse(F.array_sort(F.array(*[F.struct(scores[c].alias("s"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, c in enumerate(order)])))


def fingerprint(df: DataFrame) -> DataFrame:
    """Evidence scores of the optical classes from enhancement ratios over background.

    Needs columns r443 r560 r665 r705 (ratios), d675 d620 (excess band depths), ``fai``
    (nullable) and ``shore_m`` (nullable).  Adds a normalised score per class, the top
    class, confidence (margin), the evidence (name, value, class it supports, weight; heaviest first), its number, and caveats.
    """
    z = F.lit(0.0)
    pos = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), v).otherwise(z)                  # noqa: E731
    r443, r560, r665, r705 = (F.col(c) for c in ("r443", "r560", "r665", "r705"))
    tilt = r665 - r443
    broad = 0.5 * (r560 + r665)
    edge = F.when(r665 > 1e-9, r705 / r665)
    d675, d620, fai = F.col("d675"), F.col("d620"), F.col("fai")
    blue = r560 - r443
    green = r560 - r665
    shallow = F.col("shore_m") < 300.0

    df = df.withColumn("_bloom", pos(edge > 1.15, F.least((edge - 1.0) * 4, F.lit(4.0))) + pos(d675 > 0.02, F.least(d675 * 20, F.lit(3.0))))
    bloom = F.col("_bloom")
    raw = {
        "SEDIMENT_LIKE": pos(tilt > 0.5, F.least(tilt, F.lit(4.0))) + pos(broad > 1.8, F.least(broad - 1.0, F.lit(3.0))),
        "BLOOM_LIKE": bloom,
        "CYANO_LIKE": pos((d620 > 0.03) & (bloom > 1.0), F.least(d620 * 20, F.lit(2.0))),
        "CDOM_LIKE": pos(tilt < -0.3, F.least(-tilt, F.lit(2.0))) + pos((blue > 0.6) & (bloom < 0.5), F.least(blue, F.lit(2.0))),
        "SURFACE_FILM_LIKE": pos(fai > 0.005, F.least(fai * 300, F.lit(3.0))),
        "BOTTOM_INFLUENCED": pos(shallow & (green > 0.8), F.least(green, F.lit(2.5))),
        "UNKNOWN_ANOMALY": z,
    }
    total = z
    for c in raw.values():
        total = total + c
    df = df.withColumns({f"_s_{k}": v for k, v in raw.items()}).withColumn("_total", total)
    df = df.withColumn("_s_BACKGROUND_WATER", F.when(F.col("_total") < 0.5, 1.0).otherwise(0.0))
    df = df.withColumn("_all", F.col("_total") + F.col("_s_BACKGROUND_WATER"))
    df = df.withColumns({c.lower(): F.when(F.col("_all") > 0, F.col(f"_s_{c}") / F.col("_all")).otherwise(z) for c in CLASSES})
    df = df.withColumn("_o", _top({c: F.col(c.lower()) for c in CLASSES}, CLASSES))
    best, second = F.get("_o", 0), F.get("_o", 1)
    none = F.lit("none")
    depressed, dominant = F.coalesce((blue > 0.6) & (bloom < 0.5), F.lit(False)), F.coalesce(shallow & (green > 0.8), F.lit(False))
    kept = [(tilt, F.when(tilt > 0.5, "SEDIMENT_LIKE").when(tilt < -0.3, "CDOM_LIKE").otherwise(none), F.abs(tilt)),
            (broad, F.when(broad > 1.8, "SEDIMENT_LIKE").otherwise(none), F.greatest(broad - 1.0, z)),
            (edge, F.when(edge > 1.15, "BLOOM_LIKE").otherwise(none), F.greatest((edge - 1.0) * 3, z)),
            (d675, F.when(d675 > 0.02, "BLOOM_LIKE").otherwise(none), d675 * 10),
            (d620, F.when((d620 > 0.03) & (bloom > 1.0), "CYANO_LIKE").otherwise(none), d620 * 10),
            (F.when(depressed, blue), F.lit("CDOM_LIKE"), F.least(blue, F.lit(2.0))),
            (fai, F.when(fai > 0.005, "SURFACE_FILM_LIKE").otherwise(none), F.greatest(fai * 200, z)),
            (F.when(dominant, green), F.lit("BOTTOM_INFLUENCED"), F.least(green, F.lit(2.5)))]
    items = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct((-w).alias("_o"), F.lit(i).alias("_i"), F.lit(name).alias("name"), v.alias("value"), s.alias("supports"), w.alias("weight")))
                                      for i, (name, (v, s, w)) in enumerate(zip(EVIDENCE, kept, strict=True))]))
    evidence = F.transform(F.array_sort(items), lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value"), e["supports"].alias("supports"), e["weight"].alias("weight")))
    weak = best["s"] < 0.45
    label = F.element_at(F.create_map(*[x for c in CLASSES for x in (F.lit(c), F.lit(LABELS[c]))]), best["c"])
    caveats = F.array_compact(F.array(
        F.when(shallow, F.concat(F.lit("Pixel is "), F.rint("shore_m").cast("long").cast("string"), F.lit(CAVEAT_SHALLOW))), F.when(best["c"] == "BACKGROUND_WATER", F.lit(CAVEAT_BACKGROUND)),
        F.when(weak, F.concat(F.lit("Leading hypothesis ("), label, F.lit(") scored only "), F.rint(best["s"] * 100).cast("long").cast("string"), F.lit("%; reported as unclassified rather than asserted.")))))
    n = F.size("evidence")
    df = df.withColumns({"evidence": evidence, "caveats": caveats})
    return df.withColumns({
        "top_class": F.when(best["s"] < 0.45, F.lit("UNKNOWN_ANOMALY")).otherwise(best["c"]),
        "confidence": F.least(F.greatest(best["s"] - second["s"], F.lit(0.0)), F.lit(1.0)), "n_evidence": n,
    }).drop("_bloom", "_total", "_all", "_o", *[f"_s_{c}" for c in CLASSES])


def fingerprint_groups(df: DataFrame, n_groups: int) -> DataFrame:
    """Class scores from band-group z-scores (z0..), spectral angle ``sam``, RX score and the 620 nm excess z.

    Needs z0..z{n-1}, ``sam``, ``rx``, ``rx_limit`` and ``d620_z`` (each nullable).
    """
    zero = F.lit(0.0)
    pos = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), v).otherwise(zero)               # noqa: E731
    zs = [F.col(f"z{i}") for i in range(n_groups)]
    count = sum([c.isNotNull().cast("int") for c in zs], F.lit(0))
    mean = ratio(sum([F.coalesce(c, zero) for c in zs], zero), count.cast("double"))
    df = df.withColumn("_mean", mean)
    sq = sum([F.coalesce(F.pow(c - F.col("_mean"), 2), zero) for c in zs], zero)
    df = df.withColumns({"_sd": F.sqrt(ratio(sq, count.cast("double"))), "_short": zs[0], "_mid": zs[n_groups // 2],
                         "_maxabs": F.greatest(*[F.abs(c) for c in zs])})
    m, short, mid = F.col("_mean"), F.col("_short"), F.col("_mid")
    edge = mid - short
    uniform = F.greatest(zero, 1.0 - F.col("_sd") / (F.abs(m) + 1e-6))
    similar = F.greatest(zero, 1.0 - F.col("sam") / 0.3)
    bloom = (edge > 0.5) & (mid > 0.3)
    raw = {
        "BACKGROUND_WATER": F.greatest(zero, 1.5 - F.col("_maxabs")),
        "SEDIMENT_LIKE": pos(m > 0.5, m * uniform),
        "BLOOM_LIKE": pos(bloom, edge) + pos(bloom & (short > 0.3), -0.5 * short),
        "CYANO_LIKE": pos((F.col("d620_z") > 1.0) & (edge > 0.0), F.least(F.col("d620_z"), F.lit(3.0))),
        "CDOM_LIKE": pos((short < -0.5) & (m < 0.3), -short),
        "SURFACE_FILM_LIKE": pos(F.col("sam").isNotNull() & (m > 0.5) & (similar > 0.3), 0.4 * m * similar),
    }
    df = df.withColumns({c.lower(): v for c, v in raw.items()})
    named = F.greatest(*[F.col(c.lower()) for c in GROUP_CLASSES[1:6]], zero)
    df = df.withColumn("unknown_anomaly", pos((F.col("rx") >= F.col("rx_limit")) & (named < 0.3),
                                              F.least(F.lit(3.0), F.col("rx") / F.greatest("rx_limit", F.lit(1e-6)))))
    df = df.withColumn("_o", _top({c: F.col(c.lower()) for c in GROUP_CLASSES}, GROUP_CLASSES))
    best, second = F.get("_o", 0), F.get("_o", 1)
    conf = F.least(F.greatest((best["s"] - second["s"]) / (F.abs(best["s"]) + 1e-6), zero), F.lit(1.0))
    return df.withColumns({"top_class": best["c"], "confidence": F.when(best["s"] > 0, conf).otherwise(zero)}).drop(
        "_o", "_mean", "_sd", "_short", "_mid", "_maxabs")


# ---------------------------------------------------------------- spatial / spectral anomaly (RX)
@F.pandas_udf(T.ArrayType(T.DoubleType()))
def pseudo_inverse(cov: pd.Series) -> pd.Series:
    """Flattened pseudo-inverse of a flattened d x d covariance, one small matrix per row."""
    def one(flat):
        if flat is None or any(v is None for v in flat):
            return None
        d = int(round(math.sqrt(len(flat))))
        return np.linalg.pinv(np.asarray(flat, dtype="float64").reshape(d, d)).ravel().tolist()
    return cov.map(one)


def moments(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Mean vector, sample covariance and its inverse per key, from one combined aggregate."""
    d = len(features)
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.avg(f).alias(f"_m{i}") for i, f in enumerate(features)]
    aggs += [F.covar_samp(features[i], features[j]).alias(f"_c{i}_{j}") for i in range(d) for j in range(i, d)]
    g = df.groupBy(*keys).agg(*aggs)
    cov = F.array(*[F.col(f"_c{min(i, j)}_{max(i, j)}") for i in range(d) for j in range(d)])
    return g.select(*keys, "_n", F.array(*[F.col(f"_m{i}") for i in range(d)]).alias("mu"), cov.alias("cov"), pseudo_inverse(cov).alias("inv"))


def shrink(cov: Column, d: int, amount: float) -> Column:
    """Blend a flattened covariance with its mean variance on the diagonal."""
    mean_var = sum([F.get(cov, i * d + i) for i in range(d)], F.lit(0.0)) / d
    return F.transform(cov, lambda c, i: (1.0 - amount) * c + F.when(i % (d + 1) == 0, amount * mean_var).otherwise(0.0))


def _distance(features: Sequence[str], mu: str, inv: str) -> Column:
    """Squared Mahalanobis distance as an unrolled quadratic form."""
    d = len(features)
    diff = [F.col(f) - F.get(mu, i) for i, f in enumerate(features)]
    total = F.lit(0.0)
    for i in range(d):
        for j in range(d):
            total = total + diff[i] * F.get(inv, i * d + j) * diff[j]
    return total


def _attach(df: DataFrame, params: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a parameter row per key; without keys it is a single row (none gives NULLs with ``how="left"``)."""
    return join_small(df, params, keys, how) if keys else df.join(F.broadcast(params), F.lit(True), how)


def robust_background(df: DataFrame, keys: Sequence[str], features: Sequence[str], n_iter: int = 3,
                      trim: float = 0.95, shrinkage: float = 0.0) -> DataFrame:
    """Iteratively trimmed mean and inverse covariance per key, plus the number kept.

    Each iteration is one combined aggregate and one exact percentile; a key whose trimmed
    population would fall below three times the dimension keeps its previous estimate.
    """
    from tidemark.session import cut_lineage
    df = cut_lineage(df.select(*keys, *features))                           # the input is read once, whatever comes before it
    current = cut_lineage(moments(df, keys, features)).withColumn("stop", F.lit(False))
    previous = None
    for _ in range(n_iter):
        scored = _attach(df, current.select(*keys, "mu", "inv", "stop"), keys).withColumn("_d2", _distance(features, "mu", "inv"))
        if previous is not None:
            old = previous.select(*keys, F.col("mu").alias("_mu0"), F.col("inv").alias("_inv0"), F.col("cut").alias("_cut0"))
            scored = _attach(scored, old, keys).withColumn("_kept", _distance(features, "_mu0", "_inv0") <= F.col("_cut0"))
        else:
            scored = scored.withColumn("_kept", F.lit(True))
        cut = exact_quantiles(scored.where("_kept"), keys, "_d2", {"cut": trim}).drop("n")
        with_cut = cut_lineage(_attach(current, cut, keys))
        kept = _attach(df, with_cut.select(*keys, "mu", "inv", "cut"), keys).where(_distance(features, "mu", "inv") <= F.col("cut"))
        fresh = moments(kept, keys, features).select(*keys, F.col("_n").alias("n1"), F.col("mu").alias("mu1"), F.col("cov").alias("cov1"), F.col("inv").alias("inv1"))
        merged = with_cut.join(fresh, list(keys), "left") if keys else with_cut.crossJoin(F.broadcast(fresh))
        halt = F.col("stop") | (F.coalesce("n1", F.lit(0)) < 3 * len(features))
        previous = with_cut
        current = cut_lineage(merged.select(
            *keys, F.when(F.col("stop"), F.col("_n")).otherwise(F.coalesce("n1", F.lit(0))).alias("_n"),
            F.when(halt, F.col("mu")).otherwise(F.col("mu1")).alias("mu"),
            F.when(halt, F.col("cov")).otherwise(F.col("cov1")).alias("cov"), F.when(halt, F.col("inv")).otherwise(F.col("inv1")).alias("inv"), halt.alias("stop")))
    if shrinkage:
        current = current.withColumn("inv", pseudo_inverse(shrink(F.col("cov"), len(features), shrinkage)))
    return current.select(*keys, F.col("_n").alias("n_background"), "mu", "inv")


def rx_scores(df: DataFrame, background: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Mahalanobis score of every row against its key's background."""
    return _attach(df, background.select(*keys, "mu", "inv"), keys).withColumn("rx", _distance(features, "mu", "inv")).drop("mu", "inv")


@F.pandas_udf(T.StructType([T.StructField("axes", T.ArrayType(T.DoubleType())), T.StructField("share", T.DoubleType())]))
def principal_axes(cov: pd.Series, k: pd.Series) -> pd.DataFrame:
    """First k eigenvectors of a flattened covariance, one after the other, and the share of variance they hold.

    The largest loading of an axis is positive.  One small matrix per row.
    """
    axes, share = [], []
    for flat, n in zip(cov, k, strict=True):
        if flat is None or any(v is None for v in flat):
            axes.append(None)
            share.append(None)
            continue
        d = int(round(math.sqrt(len(flat))))
        values, vectors = np.linalg.eigh(np.asarray(flat, dtype="float64").reshape(d, d))
        order = np.argsort(values)[::-1][:int(n)]
        v = vectors[:, order]
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
        axes.append(v.T.ravel().tolist())
        share.append(float(values[order].sum() / values.sum()) if values.sum() > 0 else 0.0)
    return pd.DataFrame({"axes": axes, "share": share})


def pooled_rx(px: DataFrame, features: Sequence[str], background: Column, keys: Sequence[str] = (), k: int = 4, shrinkage: float = 0.0,
              alpha: float = 0.01, robust: bool = True) -> DataFrame:
    """RX on principal components against one background pooled over whatever the keys leave together (all dates without keys).

    Every row with finite features gets ``rx``, ``p_value`` (even k only, else NULL), ``sam`` (angle to the mean background spectrum),
    ``anomalous`` (rx at or above the background's own 1 - alpha quantile), and its key's ``threshold``,
    ``explained_variance``, ``n_components`` and ``n_background`` (after trimming).  A background of fewer than three times as many rows as features
    gives NULL scores.  The input is read once; moments, axes and trimming work on the checked-out features, and the moments of
    the components need no second look at the spectra.  ``shrinkage`` blends the covariance with its mean variance after trimming.
    """
    from tidemark.session import cut_lineage
    keys, d = list(keys), len(features)
    whole = px.withColumn("_bg", F.coalesce(background, F.lit(False)))
    for f in features:
        whole = whole.where(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f)) < float("inf")))
    whole = cut_lineage(whole)
    base = cut_lineage(moments(whole.where("_bg"), keys, features)).where(F.col("_n") >= 3 * d)
    least = base.agg(F.min("_n")).first()[0]
    k = max(1, min(k, d, least // 3 - 1 if least else k))
    axes = cut_lineage(base.withColumn("_p", principal_axes("cov", F.lit(k))).select(*keys, F.col("mu").alias("_mu"), "_p.axes", F.col("_p.share").alias("explained_variance")))
    rows = _attach(whole, axes, keys, "left")
    z = [f"_z{i}" for i in range(k)]
    rows = rows.withColumns({z[i]: sum([(F.col(f) - F.get("_mu", j)) * F.get("axes", i * d + j) for j, f in enumerate(features)], F.lit(0.0)) for i in range(k)})
    dot = sum([F.col(f) * F.get("_mu", j) for j, f in enumerate(features)], F.lit(0.0))
    size = F.sqrt(sum([F.col(f) * F.col(f) for f in features], F.lit(0.0))) * F.sqrt(sum([F.get("_mu", j) * F.get("_mu", j) for j in range(d)], F.lit(0.0)))
    rows = cut_lineage(rows.withColumn("sam", F.when(size > 0, F.acos(F.least(F.greatest(dot / size, F.lit(-1.0)), F.lit(1.0))))).drop("_mu", "axes"))
    center = robust_background(rows.where("_bg").where(F.col("_z0").isNotNull()), keys, z, n_iter=3 if robust else 0, shrinkage=shrinkage)
    scored = cut_lineage(_attach(rows, center, keys, "left").withColumn("rx", _distance(z, "mu", "inv")).drop("mu", "inv", *z))
    cut = exact_quantiles(scored.where("_bg"), keys, "rx", {"threshold": 1.0 - alpha}).drop("n")
    out = _attach(scored, cut, keys, "left").drop("_bg")
    tail = chi2_tail(F.col("rx"), k) if k % 2 == 0 else F.lit(None).cast("double")
    return out.withColumns({"p_value": tail, "anomalous": F.col("rx") >= F.col("threshold"), "n_components": F.when(F.col("rx").isNotNull(), F.lit(k))})


def chi2_tail(x: Column, k: int) -> Column:
    """Upper chi-squared tail for an even number of degrees of freedom (closed form)."""
    if k % 2:
        raise ValueError("closed form needs an even k")
    total = F.lit(0.0)
    for i in range(k // 2):
        total = total + F.pow(x / 2, i) / float(math.factorial(i))
    return F.exp(-x / 2) * total


def standardise(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Centre and scale features per key by population moments (a zero sd counts as one)."""
    g = df.groupBy(*keys).agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    out = _attach(df, g, keys)
    z = {f"{f}_std": (F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") == 0, 1.0).otherwise(F.col(f"_s_{f}")) for f in features}
    return out.withColumns(z).drop(*[f"_{k}_{f}" for f in features for k in "ms"])


def rx_percentile(scene_px: DataFrame, region_px: DataFrame, keys: Sequence[str], features: Sequence[str], min_px: int = 200) -> DataFrame:
    """Percentile of each region's mean among the scene's own water population.

    ``scene_px``: water pixels (keys, features); ``region_px``: region pixels (keys, label, features).
    """
    from tidemark.session import cut_lineage
    full = cut_lineage(scene_px.select(*keys, *features).dropna(subset=list(features)))
    size = full.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_px).drop("_n")
    full = full.join(size, list(keys), "left_semi")
    stats = full.groupBy(*keys).agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    stats = cut_lineage(stats)
    z = {f: (F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") == 0, 1.0).otherwise(F.col(f"_s_{f}")) for f in features}
    std = full.join(stats, list(keys)).select(*keys, *[z[f].alias(f) for f in features])
    bg = robust_background(std, keys, features)
    water = rx_scores(std, bg, keys, features).select(*keys, "rx")
    means = region_px.dropna(subset=list(features)).groupBy(*keys, "label").agg(*[F.avg(f).alias(f) for f in features])
    regions = means.join(stats, list(keys)).select(*keys, "label", *[z[f].alias(f) for f in features])
    regions = rx_scores(regions, bg, keys, features).select(*keys, "label", F.col("rx").alias("region_rx"))
    # Pixels and regions in one order; a region's row reads how many pixels stand strictly below it.
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    merged = (water.select(*keys, F.col("rx").alias("_s"), one.alias("_px"), F.lit(None).cast(regions.schema["label"].dataType).alias("label"))
              .unionByName(regions.select(*keys, F.col("region_rx").alias("_s"), zero.alias("_px"), "label")))
    counted = running_sums(merged, keys, F.struct("_s", "_px", "label"), F.floor(F.log1p("_s") * 64), {"_px": "_below"})
    total = water.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    return (join_small(counted.where("_px = 0"), total, keys)
            .select(*keys, "label", F.col("_s").alias("region_rx"), (100.0 * F.col("_below") / F.col("_all")).alias("rx_pct")))


def anomaly_mass_rank(regions: DataFrame, keys: Sequence[str], score: str = "mean_score", size: str = "n_px", label: str = "label") -> DataFrame:
    """Rank the regions of a scene by mean score times size."""
    mass = F.col(score) * F.col(size)
    w = Window.partitionBy(*keys).orderBy(mass.desc(), F.col(label))
    return regions.withColumn("mass", mass).withColumn("mass_rank", F.row_number().over(w))


def pca(df: DataFrame, features: Sequence[str], k: int):
    """Spark ML principal components; returns the model and the projected frame.

    The sign of a component is free; here its largest loading is positive, so that scores
    do not flip between runs.
    """
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import array_to_vector, vector_to_array
    vec = VectorAssembler(inputCols=list(features), outputCol="_vec").transform(df)
    model = PCA(k=k, inputCol="_vec", outputCol="pc").fit(vec)
    loadings = model.pc.toArray()                                 # features x k
    flip = np.where(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])] < 0, -1.0, 1.0)
    scores = F.zip_with(vector_to_array("pc"), F.array(*[F.lit(float(x)) for x in flip]), lambda a, b: a * b)
    return model, model.transform(vec).withColumn("pc", array_to_vector(scores)).drop("_vec")
