"""Acquisition catalog, decoding, mosaics, regridding and validated imports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.quantiles import select_ranks
from tidemark.session import cut_lineage

# --- Fixed values: integer encoding of the optical product --------------------------------
DN_SCALE, DN_OFFSET, DN_BASELINE = 10000.0, -1000.0, 4.0
OFFSET_DATE = "2022-01-25"
# --- Fixed values: accepted laboratory units, the first is canonical -----------------------
PARAMETER_UNITS = {
    "chlorophyll_a": ["mg m-3", "ug/L", "mg/m3"], "turbidity": ["NTU", "FNU"], "tss": ["mg/L", "g m-3"],
    "temperature": ["degC"], "salinity": ["PSU", "g/kg"], "conductivity": ["mS/cm"], "ph": ["pH"],
    "dissolved_oxygen": ["mg/L"], "nitrate": ["umol/L", "mg/L"], "phosphate": ["umol/L", "mg/L"],
    "secchi_depth": ["m"], "water_depth": ["m"], "hydrocarbon_indicator": ["qualitative"], "phytoplankton_id": ["qualitative"],
}
# --- Fixed values: product quantities and spectral range (nm) -------------------------------
QUANTITIES = ["Rrs", "rho_w", "Lw"]
SPECTRAL_RANGE = (400.0, 1700.0)


# ---------------------------------------------------------------- catalog
def cloud_or_hundred(cloud: Column, zero_is_missing: bool = True) -> Column:
    """Missing cloud cover counts as 100.  The source rule also treats 0.0 as missing; the flag keeps that."""
    return F.coalesce(F.nullif(cloud, F.lit(0)) if zero_is_missing else cloud, F.lit(100))


def clear_tiles(items: DataFrame, max_cloud: float, zero_is_missing: bool = True) -> DataFrame:
    return items.where(cloud_or_hundred(F.col("cloud"), zero_is_missing) <= max_cloud)


def overpasses(items: DataFrame, max_cloud: float, zero_is_missing: bool = True) -> DataFrame:
    """Clear items grouped into physical overpasses (date, relative orbit, platform).

    ``items``: item_id, d, orbit, platform, cloud.  An overpass of any size stays a combined
    aggregate; its tiles remain rows of the item table under the same three keys.
    """
    ok = clear_tiles(items, max_cloud, zero_is_missing)
    return (ok.groupBy("d", F.coalesce("orbit", F.lit(0)).alias("orbit"), "platform")
            .agg(F.count(F.lit(1)).alias("n_tiles"), F.min("item_id").alias("first_tile"), F.max("item_id").alias("last_tile"), F.avg("cloud").alias("mean_cloud")))


def overpass_tag(d: Column, orbit: Column, platform: Column) -> Column:
    """date_R###_xx"""
    return F.concat(d.cast("string"), F.lit("_R"), F.lpad(orbit.cast("string"), 3, "0"), F.lit("_"), F.right(F.coalesce(platform, F.lit("S2")), F.lit(2)))


def split_new(acquisitions: DataFrame, done: DataFrame, tag: str = "tag") -> tuple[DataFrame, DataFrame]:
    """(already screened rows to reuse, acquisitions still to process)."""
    reused = done.join(acquisitions.select(tag), tag, "left_semi")
    fresh = acquisitions.join(done.select(tag), tag, "left_anti")
    return reused, fresh


def outcome_counts(rows: DataFrame, keys: Sequence[str], error: str = "error") -> DataFrame:
    """Failed acquisitions stay as rows with their error; this counts both kinds."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_datatakes"), F.count_if(F.col(error).isNull()).alias("n_ok"), F.count(error).alias("n_failed"))


def census(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items, dates, clear items and dates, and the upper median cloud (the n // 2-th of the sorted list)."""
    base = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_items"), F.countDistinct("d").alias("n_dates"), F.min("d").alias("first_d"), F.max("d").alias("last_d"),
        F.count_if(F.col("cloud") <= 10).alias("n_items_clear"), F.countDistinct(F.when(F.col("cloud") <= 10, F.col("d"))).alias("n_dates_clear"))
    med = select_ranks(items, keys, "cloud", {"median_cloud": F.floor(F.col("n") / 2)}).drop("n")
    return base.join(med, list(keys), "left")


def latest_clear(items: DataFrame, keys: Sequence[str], max_cloud: float = 5.0, k: int = 5) -> DataFrame:
    """The k most recent clear items per key (a partial top-k before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(F.col("d").desc(), F.col("item_id").desc())
    return items.where(cloud_or_hundred(F.col("cloud")) <= max_cloud).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


# ---------------------------------------------------------------- decoding
def decode_dn(df: DataFrame, dn: str = "dn", baseline: str = "baseline") -> DataFrame:
    """Digital numbers to reflectance by the product's own processing baseline.

    0 is no-data; negatives are kept; a missing or unreadable baseline is reported in
    ``problem`` and never guessed.
    """
    b = F.expr(f"try_cast({baseline} AS double)")
    problem = F.when(F.col(baseline).isNull(), "baseline required").when(b.isNull(), "unparseable baseline")
    value = (F.col(dn) + F.when(b >= DN_BASELINE, DN_OFFSET).otherwise(0.0)) / DN_SCALE
    return df.withColumns({"problem": problem, "reflectance": F.when(b.isNotNull() & (F.col(dn) != 0), value)})


def decode_by_date(df: DataFrame, dn: str, date: str, change: str = OFFSET_DATE) -> DataFrame:
    """The older rule: the offset follows the acquisition date."""
    value = (F.col(dn) + F.when(F.col(date) >= F.lit(change).cast("date"), DN_OFFSET).otherwise(0.0)) / DN_SCALE
    return df.withColumn("reflectance", F.when(F.col(dn) != 0, value))


def mosaic(tiles: DataFrame, keys: Sequence[str], priority: Sequence[str], values: Sequence[str]) -> DataFrame:
    """First valid value per cell in tile priority order, for each band on its own (combinable)."""
    order = F.struct(*priority)
    return tiles.groupBy(*keys).agg(*[F.min_by(v, F.when(F.col(v).isNotNull(), order)).alias(v) for v in values],
                                    F.min(F.when(F.coalesce(*values).isNotNull(), order)).alias("winner"))


def skipped_tiles(tiles: DataFrame, mosaicked: DataFrame, tile_keys: Sequence[str], winner_fields: Sequence[str]) -> DataFrame:
    """Tiles without a winning cell."""
    used = mosaicked.where(F.col("winner").isNotNull()).select(*[F.col(f"winner.{f}").alias(k) for f, k in zip(winner_fields, tile_keys)]).distinct()
    return tiles.select(*tile_keys).distinct().join(used, list(tile_keys), "left_anti")


def regrid(df: DataFrame, keys: Sequence[str], x: Column, y: Column, x0: float, y0: float, cell: float,
           average: Sequence[str] = (), category: str | None = None, min_count: int = 1) -> DataFrame:
    """Average continuous values and take the most frequent category on a common grid (ties: smallest)."""
    cx, cy = F.floor((x - x0) / cell).alias("cx"), F.floor((y - y0) / cell).alias("cy")
    df = df.withColumns({"cx": cx, "cy": cy})
    k = [*keys, "cx", "cy"]
    out = df.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(a) for a in average]).where(F.col("n") >= min_count)
    if category:
        counts = df.groupBy(*k, category).agg(F.count(F.lit(1)).alias("_n"))
        mode = counts.groupBy(*k).agg(F.min_by(category, F.struct(-F.col("_n"), F.col(category))).alias(category))
        out = out.join(mode, k)
    return out


def cell_centres(df: DataFrame, x0: float, dx: float, y0: float, dy: float) -> DataFrame:
    """Affine cell centres of row / col."""
    return df.withColumns({"x": x0 + (F.col("col") + 0.5) * dx, "y": y0 + (F.col("row") + 0.5) * dy})


def perimeter_bounds(df: DataFrame, keys: Sequence[str], x0: float, dx: float, y0: float, dy: float) -> DataFrame:
    """Bounds over the whole perimeter of the cells."""
    xs = [x0 + F.col("col") * dx, x0 + (F.col("col") + 1) * dx]
    ys = [y0 + F.col("row") * dy, y0 + (F.col("row") + 1) * dy]
    return df.groupBy(*keys).agg(F.min(F.least(*xs)).alias("west"), F.max(F.greatest(*xs)).alias("east"),
                                 F.min(F.least(*ys)).alias("south"), F.max(F.greatest(*ys)).alias("north"))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a point."""
    return (F.when(lat >= 0, 32600).otherwise(32700) + F.floor((lon + 180) / 6) + 1).cast("int")


# ---------------------------------------------------------------- assets
def asset_type(tags: Column) -> Column:
    """Asset type by ordered tag rules; solar and wind plants are excluded (NULL)."""
    t = lambda k: F.coalesce(F.get(F.map_values(F.map_filter(tags, lambda n, _: n == k)), 0), F.lit(""))     # noqa: E731
    name = F.lower(F.when(t("name:en") != "", t("name:en")).otherwise(t("name")))
    desal = (((t("man_made") == "water_works") & (t("water_works").contains("desal") | name.contains("desal")))
             | (t("industrial") == "desalination") | name.contains("desalination") | (t("plant:output:water") != "") | name.contains("iwpp"))
    plant = t("power") == "plant"
    excluded = t("plant:source").isin("solar", "wind") | name.contains("solar") | name.contains("photovoltaic")
    return (F.when(desal, "DESALINATION_PLANT").when(plant & excluded, F.lit(None).cast("string")).when(plant, "POWER_PLANT")
            .when((t("industrial") == "oil_terminal") | name.contains("oil terminal"), "OIL_TERMINAL")
            .when((t("landuse") == "port") | (t("industrial") == "port") | (t("harbour") == "yes"), "PORT")
            .when((t("natural") == "beach") & (t("name") != ""), "PUBLIC_BEACH"))


def assign_area(points: DataFrame, areas: DataFrame, cell_deg: float = 0.5) -> DataFrame:
    """First area (by ``ord``) whose box holds the point.

    Boxes are cut into degree cells, points look only into their own cell, and the choice
    is a combinable minimum.  ``areas``: aoi, ord, west, south, east, north.
    """
    cells = (areas.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("west") / cell_deg), F.floor(F.col("east") / cell_deg))))
             .withColumn("_cy", F.explode(F.sequence(F.floor(F.col("south") / cell_deg), F.floor(F.col("north") / cell_deg)))))
    keyed = points.withColumns({"_cx": F.floor(F.col("lon") / cell_deg), "_cy": F.floor(F.col("lat") / cell_deg)})
    hit = (keyed.join(cells, ["_cx", "_cy"])
           .where(F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))))
    return hit.groupBy(*points.columns).agg(F.min_by("aoi", F.struct("ord", "aoi")).alias("aoi"))


def keep_separated(points: DataFrame, keys: Sequence[str], x: str, y: str, order: str, dx: float, dy: float) -> DataFrame:
    """Greedy thinning in ``order``: drop a point closer than (dx, dy) to an earlier kept one of its group.

    Same result as one ordered pass, computed in rounds.  Points live in cells of dx by dy,
    where any two exclude each other, so a cell offers only its earliest open point; an
    offer with no earlier open conflict nearby is kept, and what it excludes is closed.
    Every join meets at most nine offers per point.  ``order`` must be unique in a group and
    not null: the earliest open point is then always kept, so every round closes some.
    """
    keys = list(keys)
    k = [*keys, "_cx", "_cy"]
    open_ = cut_lineage(points.withColumns({"_cx": F.floor(F.col(x) / dx), "_cy": F.floor(F.col(y) / dy)}))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])

    def spread(offers, tag):
        s = offers.withColumn("_o", F.explode(around))
        return s.select(*keys, (F.col("_cx") + F.col("_o.i")).alias("_cx"), (F.col("_cy") + F.col("_o.j")).alias("_cy"),
                        F.col(x).alias(f"{tag}x"), F.col(y).alias(f"{tag}y"), F.col(order).alias(f"{tag}o"))

    def close(a, b):
        return (F.abs(F.col(x) - F.col(a)) < dx) & (F.abs(F.col(y) - F.col(b)) < dy)

    kept = None
    while not open_.isEmpty():
        first = open_.groupBy(*k).agg(F.min_by(F.struct(*[F.col(c) for c in points.columns]), order).alias("_f"))
        offers = first.select(*k, *[F.col(f"_f.{c}").alias(c) for c in points.columns if c not in k])
        blocked = (open_.join(spread(offers, "_f"), k).where(close("_fx", "_fy") & (F.col(order) < F.col("_fo")))
                   .select(*keys, F.col("_fo").alias(order)).distinct())
        chosen = cut_lineage(offers.join(blocked, [*keys, order], "left_anti"))
        kept = chosen if kept is None else kept.unionByName(chosen)
        gone = (open_.join(spread(chosen, "_g"), k).where(close("_gx", "_gy")).select(*keys, order).distinct())
        if gone.isEmpty():
            raise ValueError(f"{order} holds nulls: no point can be kept")
        open_ = cut_lineage(open_.join(gone, [*keys, order], "left_anti"))
    return points.limit(0) if kept is None else kept.select(*points.columns)


# ---------------------------------------------------------------- laboratory and products
def measurement_problem(parameter: Column, unit: Column, value: Column) -> Column:
    """Why a laboratory row is refused, in checking order; NULL when it is accepted."""
    number = value.try_cast("double")
    known = parameter.isin(list(PARAMETER_UNITS))
    accepted = F.lit(False)
    for p, units in PARAMETER_UNITS.items():
        accepted = accepted | ((parameter == p) & unit.isin(units))
    return (F.when(parameter.isNull() | ~known, "unsupported parameter").when(~F.coalesce(accepted, F.lit(False)), "unit not accepted")
            .when(number.isNull(), "not a number").when(F.isnan(number), "value is NaN")
            .when((parameter != "temperature") & (number < 0), "cannot be negative"))


def split_lab_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) of an import with parameter, value, unit."""
    checked = rows.withColumn("problem", measurement_problem(F.trim("parameter"), F.trim("unit"), F.col("value")))
    return checked.where(F.col("problem").isNull()), checked.where(F.col("problem").isNotNull())


def normalised_bands(spectra: DataFrame, value: str, nm: str, quantity: str, ed: str) -> DataFrame:
    """Every band as remote-sensing reflectance: Lw / Ed, rho_w / pi or Rrs; ``refused`` says why a band has none, ``negative`` marks
    values below the noise floor."""
    q = F.col(quantity)
    refused = (F.when(~q.isin(QUANTITIES), "unknown quantity").when((q == "Lw") & F.col(ed).isNull(), "Lw needs Ed")
               .when(~F.col(nm).between(SPECTRAL_RANGE[0] - 5, SPECTRAL_RANGE[1] + 5), "band outside range"))
    rrs = (F.when(q == "Lw", F.when(F.col(ed) > 0, F.col(value) / F.col(ed))).when(q == "rho_w", F.col(value) / F.pi()).when(q == "Rrs", F.col(value)))
    return spectra.withColumns({"refused": refused, "rrs": rrs}).withColumn("negative", F.coalesce(F.col("rrs") < -0.01, F.lit(False)))


def normalise_product(spectra: DataFrame, keys: Sequence[str], value: str, nm: str, quantity: str, ed: str) -> DataFrame:
    """What ``normalised_bands`` makes of each spectrum: refusal, bands with a value, their sum, note on negative values."""
    rows = normalised_bands(spectra, value, nm, quantity, ed)
    return rows.groupBy(*keys).agg(F.max("refused").alias("refused"), F.count("rrs").alias("n_bands"), F.sum("rrs").alias("sum_rrs"), F.bool_or("negative").alias("negative_note"))
