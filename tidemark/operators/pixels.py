"""Pixel features, uncertainty and masks: column arithmetic on a wide pixel table.

Every function takes and returns a DataFrame and adds columns only, so a whole feature job
is one projection that stays inside code generation and reads only the bands it names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.nulls import clip, normalised_difference, ratio, within

# --- Fixed values: sensor band centres (nm) per platform -----------------------------
CENTRES_NM = {
    "Sentinel-2A": {"b04": 664.6, "b05": 704.1, "b06": 740.5, "b8a": 864.7, "b11": 1613.7},
    "Sentinel-2B": {"b04": 664.9, "b05": 703.8, "b06": 739.1, "b8a": 864.0, "b11": 1610.4},
    "Sentinel-2C": {"b04": 664.9, "b05": 703.8, "b06": 739.1, "b8a": 864.0, "b11": 1610.4},
}
# --- Fixed values: single-band turbidity / suspended matter (A, C) at B04 ------------
NECHAD_TURBIDITY = (366.14, 0.19563)
NECHAD_SUSPENDED = (342.10, 0.19563)
NECHAD_LIMIT = 0.5
# --- Fixed values: red / NIR switching turbidity -------------------------------------
DOGLIOTTI = {"a_red": 228.1, "c_red": 0.1641, "a_nir": 3078.9, "c_nir": 0.2112,
             "lower": 0.05, "upper": 0.07}
# --- Fixed values: hue angle weights of B01..B05 and correction polynomials ----------
HUE_BANDS = ["b01", "b02", "b03", "b04", "b05"]
HUE_X = [11.756, 6.423, 53.696, 32.028, 0.529]
HUE_Y = [1.744, 22.289, 65.702, 16.808, 0.192]
HUE_Z = [62.696, 31.101, 1.778, 0.015, 0.000]
HUE_POLY = {
    "Sentinel-2A": [-68.76, 495.18, -1315.60, 1547.60, -748.36, 113.25],
    "Sentinel-2B": [-70.78, 510.49, -1360.3, 1608.6, -785.63, 121.34],
    "Sentinel-2C": [-70.78, 510.49, -1360.3, 1608.6, -785.63, 121.34],
}
# --- Fixed values: scene classes that make a pixel unusable --------------------------
SCL_UNUSABLE = [0, 1, 3, 8, 9, 10, 11]
# --- Fixed values: water product flags that reject a pixel ---------------------------
REJECT_FLAGS = ["INVALID", "LAND", "CLOUD", "CLOUD_AMBIGUOUS", "CLOUD_MARGIN", "SNOW_ICE",
                "SUSPECT", "HISOLZEN", "SATURATED", "HIGHGLINT", "WHITECAPS", "AC_FAIL",
                "OC4ME_FAIL", "ANNOT_TAU06", "RWNEG_O2", "RWNEG_O3", "RWNEG_O4", "RWNEG_O5",
                "RWNEG_O6", "RWNEG_O7", "RWNEG_O8"]
# --- Fixed values: feature declarations ----------------------------------------------
# name, bands, native resolution in m (the coarsest band), kind, units, valid range
FEATURES = [
    ("MNDWI", ["b03", "b11"], 20, "MASK", "dimensionless", -1.0, 1.0),
    ("SWIR_B11", ["b11"], 20, "MASK", "reflectance", None, None),
    ("NDCI", ["b04", "b05"], 20, "PROXY", "dimensionless", -1.0, 1.0),
    ("MCI", ["b04", "b05", "b06"], 20, "PROXY", "reflectance", None, None),
    ("FAI", ["b04", "b8a", "b11"], 20, "PROXY", "reflectance", None, None),
    ("RE_RATIO", ["b04", "b05"], 20, "PROXY", "dimensionless", 0.0, 10.0),
    ("CDOM_RATIO", ["b03", "b04"], 10, "PROXY", "dimensionless", 0.0, 20.0),
    ("TUR_NECHAD2016", ["b04", "b12"], 10, "GENERIC_CALIBRATION", "FNU", 0.0, 1000.0),
    ("SPM_NECHAD2016", ["b04", "b12"], 10, "GENERIC_CALIBRATION", "g m-3", 0.0, 1000.0),
    ("TUR_DOGLIOTTI2015", ["b04", "b8a", "b12"], 20, "GENERIC_CALIBRATION", "FNU", 0.0, 4000.0),
    ("HUE_ANGLE", HUE_BANDS, 60, "COLORIMETRIC", "degrees", 0.0, 360.0),
]
INDEX_RANGES = {"NDWI": (-1.0, 1.0), "MNDWI": (-1.0, 1.0), "NDCI": (-1.0, 1.0),
                "TURBIDITY_PROXY": (-1.0, 1.0), "FAI": (-0.1, 0.3), "CHL_RE_RATIO": (0.0, 5.0)}
GUARD = 1e-6
FAI_NM = (665.0, 859.0, 1610.0)


def per_platform(values: Mapping[str, float], platform: Column, default: str = "Sentinel-2A") -> Column:
    """A platform constant as a CASE expression; unknown platforms use ``default``."""
    out = F
    first = True
    for name, v in values.items():
        out = (F.when if first else out.when)(platform == name, F.lit(v))
        first = False
    return out.otherwise(F.lit(values[default]))


def surface_corrected(bands: Sequence[str], swir: str = "b12", keep: Sequence[str] = ("b11", "b12")) -> dict[str, Column]:
    """Water-leaving estimate: subtract the SWIR residual from every band but the SWIR pair."""
    return {b: F.col(b) if b in keep else F.col(b) - F.col(swir) for b in bands}


def baseline_height(peak: Column, left: Column, right: Column, fraction: Column) -> Column:
    """Height of a band above the straight line between its shoulders."""
    return peak - (left + (right - left) * fraction)


def line_fraction(platform: Column, peak: str, left: str, right: str) -> Column:
    return per_platform({p: (c[peak] - c[left]) / (c[right] - c[left]) for p, c in CENTRES_NM.items()}, platform)


def nechad(rho: Column, coefficients: tuple[float, float], limit: float = NECHAD_LIMIT) -> Column:
    a, c = coefficients
    return F.when(rho < limit * c, ratio(a * rho, 1.0 - rho / c))


def dogliotti(red: Column, nir: Column) -> Column:
    k = DOGLIOTTI
    t_red = ratio(k["a_red"] * red, 1.0 - red / k["c_red"])
    t_nir = ratio(k["a_nir"] * nir, 1.0 - nir / k["c_nir"])
    w = clip((red - k["lower"]) / (k["upper"] - k["lower"]), 0.0, 1.0)
    return (1 - w) * t_red + w * t_nir


def hue_angle(bands: Mapping[str, Column], platform: Column) -> Column:
    def weigh(weights):
        terms = [bands[b] * w for b, w in zip(HUE_BANDS, weights)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total
    x, y, z = weigh(HUE_X), weigh(HUE_Y), weigh(HUE_Z)
    total = x + y + z
    angle = F.degrees(F.pmod(F.atan2(ratio(y, total) - 1 / 3, ratio(x, total) - 1 / 3), F.lit(2 * 3.141592653589793)))
    h = angle / 100.0
    poly = F.lit(0.0)
    for i in range(6):
        coef = per_platform({p: c[i] for p, c in HUE_POLY.items()}, platform)
        poly = poly + coef * F.pow(h, 5 - i)
    return angle + poly


def feature_columns(bands: Sequence[str], platform: Column) -> dict[str, Column]:
    """All features as expressions, valid ranges applied (outside becomes NULL)."""
    w = surface_corrected(bands)
    raw = {b: F.col(b) for b in bands}
    out = {
        "MNDWI": normalised_difference(raw["b03"], raw["b11"]),
        "SWIR_B11": raw["b11"],
        "NDCI": normalised_difference(w["b05"], w["b04"]),
        "MCI": baseline_height(w["b05"], w["b04"], w["b06"], line_fraction(platform, "b05", "b04", "b06")),
        "FAI": baseline_height(raw["b8a"], raw["b04"], raw["b11"], line_fraction(platform, "b8a", "b04", "b11")),
        "RE_RATIO": F.when(w["b04"] > 1e-3, ratio(w["b05"], w["b04"])),
        "CDOM_RATIO": F.when(w["b04"] > 1e-3, ratio(w["b03"], w["b04"])),
        "TUR_NECHAD2016": nechad(w["b04"], NECHAD_TURBIDITY),
        "SPM_NECHAD2016": nechad(w["b04"], NECHAD_SUSPENDED),
        "TUR_DOGLIOTTI2015": dogliotti(w["b04"], w["b8a"]),
        "HUE_ANGLE": hue_angle(w, platform),
    }
    ranges = {name: (lo, hi) for name, _, _, _, _, lo, hi in FEATURES}
    return {k: within(v, *ranges[k]) for k, v in out.items()}


def water_features(px: DataFrame, bands: Sequence[str], platform: str = "platform") -> DataFrame:
    """Append every feature, lower-cased, to a pixel table."""
    return px.withColumns({k.lower(): v for k, v in feature_columns(bands, F.col(platform)).items()})


def guarded_indices(green: Column, red: Column, red_edge: Column, nir: Column, swir: Column) -> dict[str, Column]:
    """The index set with a 1e-6 guard in every denominator."""
    red_nm, nir_nm, swir_nm = FAI_NM
    return {
        "NDWI": normalised_difference(green, nir, GUARD),
        "MNDWI": normalised_difference(green, swir, GUARD),
        "NDCI": normalised_difference(red_edge, red, GUARD),
        "TURBIDITY_PROXY": normalised_difference(red, green, GUARD),
        "CHL_RE_RATIO": ratio(red_edge, red + GUARD),
        "FAI": baseline_height(nir, red, swir, F.lit((nir_nm - red_nm) / (swir_nm - red_nm))),
    }


def nd_sigma(a: Column, b: Column, sa: Column, sb: Column) -> Column:
    """First-order propagated one-sigma of (a - b) / (a + b)."""
    return ratio(2.0 * F.sqrt(F.pow(b * sa, 2) + F.pow(a * sb, 2)), F.pow(a + b, 2))


def significant(a: Column, b: Column, sa: Column, sb: Column, k: float = 3.0) -> Column:
    """True where the denominator exceeds k times its own propagated uncertainty."""
    return F.coalesce((a + b) > k * F.sqrt(sa * sa + sb * sb), F.lit(False))


def significant_indices(band: Mapping[str, Column], sigma: Mapping[str, Column], k: float = 3.0) -> dict[str, Column]:
    """Value and sigma of each normalised difference, NULL where not significant, and of FAI."""
    pairs = {"ndwi": ("green", "nir"), "mndwi": ("green", "swir"),
             "ndci": ("red_edge", "red"), "turbidity_proxy": ("red", "green")}
    out = {}
    for name, (x, y) in pairs.items():
        keep = significant(band[x], band[y], sigma[x], sigma[y], k)
        lo, hi = INDEX_RANGES[name.upper()]
        out[name] = within(F.when(keep, normalised_difference(band[x], band[y])), lo, hi)
        out[f"{name}_sigma"] = F.when(keep, nd_sigma(band[x], band[y], sigma[x], sigma[y]))
    red_nm, nir_nm, swir_nm = FAI_NM
    f = (nir_nm - red_nm) / (swir_nm - red_nm)
    out["fai"] = baseline_height(band["nir"], band["red"], band["swir"], F.lit(f))
    out["fai_sigma"] = F.sqrt(F.pow(sigma["nir"], 2) + F.pow((1 - f) * sigma["red"], 2) + F.pow(f * sigma["swir"], 2))
    return out


def scl_usable(scl: Column) -> Column:
    return ~scl.isin(SCL_UNUSABLE)


def flags_accept(flags: Column, masks: Mapping[str, int], reject: Sequence[str] = REJECT_FLAGS) -> Column:
    """Valid where none of the named reject bits is set; the bit mask folds to one literal."""
    bits = 0
    for name in reject:
        bits |= masks.get(name, 0)
    return flags.bitwiseAND(F.lit(bits)) == 0


def log10_to_linear(c: Column) -> Column:
    return F.pow(F.lit(10.0), c)


def quality_steps(nodata: Column, cloud: Column, cirrus: Column, nir: Column, value: Column, sigma: Column,
                  nir_max: float = 0.05, max_ratio: float = 1.0, floor: float = 1e-4) -> dict[str, Column]:
    """The three screening steps as boolean columns (NULL inputs fail)."""
    sure = lambda c: F.coalesce(c, F.lit(False))                                   # noqa: E731
    spread = F.when(value.isNotNull(), F.abs(sigma) / F.greatest(F.abs(value), F.lit(floor)))
    return {
        "product_quality_masks": (nodata == 0) & (cloud == 0) & (cirrus == 0),
        "sunglint_nir": sure(nir < nir_max),
        "uncertainty_ratio": sure(spread <= max_ratio),
    }


def screen_report(df: DataFrame, steps: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """What each step kept and removed, in one pass: counts per step plus the combined result."""
    combined = None
    for c in steps.values():
        combined = c if combined is None else combined & c
    every = {**steps, "combined": combined}
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"),
                                    *[F.count_if(c).alias(f"_{k}") for k, c in every.items()])
    entries = F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"_{k}").alias("kept")) for k in every])
    return (counted.select(*keys, "total", F.explode(entries).alias("s"))
            .select(*keys, F.col("s.step").alias("step"), F.col("s.kept").alias("kept"),
                    (F.col("total") - F.col("s.kept")).alias("removed"), "total",
                    ratio(F.col("s.kept").cast("double"), F.col("total").cast("double")).alias("kept_fraction")))


def water_simple(green: Column, swir: Column, nir: Column, valid: Column,
                 mndwi_min: float = 0.15, nir_max: float = 0.10) -> Column:
    """Spectral part of the simple water mask."""
    ok = valid & (normalised_difference(green, swir, GUARD) > mndwi_min) & (nir < nir_max)
    return F.coalesce(ok, F.lit(False))


def water_glint_parts(usable: Column, mndwi_min: float = 0.0, swir_reject: float = 0.10,
                      red_floor: float = -0.002) -> dict[str, Column]:
    """Spectral parts of the glint-aware mask: valid, open, negative red."""
    valid = F.col("b03").isNotNull() & F.col("b11").isNotNull() & F.col("b04").isNotNull()
    wet = F.coalesce((normalised_difference(F.col("b03"), F.col("b11")) > mndwi_min)
                     & (F.col("b11") < swir_reject), F.lit(False))
    red = F.col("b04") - F.col("b12")
    return {"valid": valid, "usable": usable, "open": valid & usable & wet, "wet": valid & wet,
            "negative_red": valid & usable & wet & F.coalesce(red < red_floor, F.lit(False))}


def in_bbox(lon: Column, lat: Column, bbox: Sequence[float], valid: Column | None = None) -> Column:
    inside = lon.between(bbox[0], bbox[2]) & lat.between(bbox[1], bbox[3])
    return inside if valid is None else inside & valid


def points_in_polygon(points: DataFrame, x: str, y: str, ring: Sequence[tuple[float, float]]) -> DataFrame:
    """Ray casting against one polygon ring as a single boolean expression per point.

    The ring is a parameter of the job (site outline), so its edges fold into the plan and
    every point is decided in its own row without a join.
    """
    crossings = F.lit(0)
    for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]]):
        if yi == yj:
            continue
        edge_x = (xj - xi) * (F.col(y) - yi) / (yj - yi) + xi
        hit = ((F.lit(yi) > F.col(y)) != (F.lit(yj) > F.col(y))) & (F.col(x) < edge_x)
        crossings = crossings + hit.cast("int")
    return points.withColumn("inside", crossings % 2 == 1)


def stretch(df: DataFrame, value: str, lo: Column, hi: Column) -> DataFrame:
    """Rescale between two percentiles, clipped to [0, 1]."""
    return df.withColumn("stretched", clip(ratio(F.col(value) - lo, hi - lo), 0.0, 1.0))
