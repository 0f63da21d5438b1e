"""Assets, drift and sampling around an event."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import EARTH_RADIUS_M, bearing_deg, compass, haversine_m, neighbour_cells, sphere_cell
from tidemark.functions.joins import join_nulls, join_small
from tidemark.functions.nulls import clip
from tidemark.functions.quantiles import exact_quantiles, select_ranks
from tidemark.session import cut_lineage

# --- Fixed values: surface drift --------------------------------------------------------------
DRIFT_FACTOR, DEFLECTION_DEG = 0.03, 15.0
HORIZONS_H = (6, 12, 24, 48)
M_PER_DEG_LAT, M_PER_DEG_LON = 110_574.0, 111_320.0
# --- Fixed values: sampling roles and their priority -------------------------------------------
ROLE_PRIORITY = {"EVENT_CORE": 1, "LEADING_EDGE": 2, "ASSET_BOUNDARY": 1, "BACKGROUND_CONTROL": 2, "UNCERTAINTY_POINT": 3}


#: Assets up to this number are sent, 27 copies each, to the events; beyond it both sides are shuffled.
FEW_ASSETS = 4_000
#: Assets of a cube beyond which it is cut into finer cubes, and the finest cut (pieces along an edge).
DENSE, FINEST = 2_000, 8


def _chord(metres: Column | float) -> Column:
    """Straight distance, in radii, of points that far apart on the sphere."""
    return 2 * F.sin(F.least((metres if isinstance(metres, Column) else F.lit(float(metres))) / (2 * EARTH_RADIUS_M), F.lit(math.pi / 2)))


def _unit(lon: Column, lat: Column) -> list[Column]:
    p, q = F.radians(lat), F.radians(lon)
    return [F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)]


def _places(prefix: str, lon: Column, lat: Column) -> dict[str, Column]:
    return {f"{prefix}{c}": v for c, v in zip("xyz", _unit(lon, lat), strict=True)}


def _within(limit: Column) -> Column:
    """Squared chord of the two places at most ``limit`` squared: no angle is computed for the others."""
    d = [F.col(f"_e{c}") - F.col(f"_a{c}") for c in "xyz"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= limit * limit


def asset_pairs(events: DataFrame, assets: DataFrame, radius_m: float, few: int = FEW_ASSETS, dense: int = DENSE) -> DataFrame:
    """Event / asset pairs within a radius, anywhere on the globe.

    Cubes of the sphere no smaller than the radius turn the distance join into an equi-join.  Few (counted) assets
    go to the events with the 27 cubes they reach.  Otherwise events ask 27 cubes, and a cube that holds
    more than ``dense`` assets is cut into finer cubes, of which an event asks those its radius touches: no key holds many assets
    and most far pairs are never formed.  A squared chord decides before any angle is computed.
    """
    size = radius_m * 1.001                                       # room for rounding at a cell's edge
    edge = size / EARTH_RADIUS_M
    limit = _chord(radius_m) * (1 + 1e-9)
    cell = lambda lon, lat: [c.alias(n) for n, c in zip("xyz", sphere_cell(lon, lat, size), strict=True)]                # noqa: E731
    e = events.withColumns(_places("_e", F.col("lon"), F.col("lat")))
    a = assets.withColumns(_places("_a", F.col("alon"), F.col("alat")))
    d = haversine_m(F.col("lon"), F.col("lat"), F.col("alon"), F.col("alat"))
    extra = [f"_{s}{c}" for s in "ea" for c in "xyz"]
    if assets.limit(few + 1).count() <= few:
        a = a.withColumn("_c", F.explode(neighbour_cells(sphere_cell(F.col("alon"), F.col("alat"), size))))
        e = e.withColumn("_c", F.struct(*cell(F.col("lon"), F.col("lat"))))
        met = e.join(F.broadcast(a), "_c").where(_within(limit))
    else:
        a = a.withColumn("_c", F.struct(*cell(F.col("alon"), F.col("alat"))))
        counts = a.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > dense)
        cut = F.least(F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_n") / dense) / 2)), F.lit(float(FINEST))).cast("int")
        counts = cut_lineage(counts.select("_c", cut.alias("_m")))
        fine = lambda v, n: F.least(F.floor((F.col(v) / edge - F.col(f"_c.{n}")) * F.col("_m")), F.col("_m") - 1)         # noqa: E731
        piece = F.when(F.col("_m").isNull(), F.lit(0)).otherwise((fine("_ax", "x") * F.col("_m") + fine("_ay", "y")) * F.col("_m") + fine("_az", "z"))
        a = join_small(a, counts, ["_c"], "left").withColumn("_p", piece.cast("int")).drop("_m")
        e = e.withColumn("_c", F.explode(neighbour_cells(sphere_cell(F.col("lon"), F.col("lat"), size))))
        e = join_small(e, counts, ["_c"], "left")

        def gap(v, n, i):
            low = (F.col(f"_c.{n}") + i / F.col("_m")) * edge
            return F.greatest(low - F.col(v), F.col(v) - low - edge / F.col("_m"), F.lit(0.0))

        def touched(p):
            m = F.col("_m")
            x, y, z = gap("_ex", "x", F.floor(p / (m * m))), gap("_ey", "y", F.floor(p / m) % m), gap("_ez", "z", p % m)
            return x * x + y * y + z * z <= limit * limit * (1 + 1e-6)

        pieces = F.when(F.col("_m").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("_m") * F.col("_m") * F.col("_m") - 1), touched))
        met = e.withColumn("_p", F.explode(pieces)).drop("_m").join(a, ["_c", "_p"]).where(_within(limit)).drop("_p")
    return met.withColumn("distance_m", d).where(F.col("distance_m") <= radius_m).drop("_c", *extra)


def once_for_alike(events: DataFrame, alike: Sequence[str], solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of ``solve`` for every event, worked out once for all events that agree in the columns ``alike``.

    ``solve`` gets one event per such class (event_id: the smallest one, and ``alike``) and returns rows with that event_id; each
    member gets them under its own.  Pairs of a class and an asset are shuffled, pairs of an event and an asset only leave the last join.
    Both joins are merge joins: rows made of a small file look small to the optimiser and are not.  The last one keeps its number of
    partitions, for its input says nothing about the rows that leave it.
    """
    spark = events.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    first = events.groupBy(*alike).agg(F.min("event_id").alias("event_id"))
    members = join_nulls(events.select("event_id", *alike), first.withColumnRenamed("event_id", "_first").hint("merge"), alike).select("event_id", "_first")
    return members.repartition(parts, "_first").join(solve(first).withColumnRenamed("event_id", "_first").hint("merge"), "_first").drop("_first")


def with_track(events: DataFrame, track: DataFrame) -> DataFrame:
    """``events`` (event_id and columns) with the SHA-256 of their particles in order: events of one place and one digest are alike."""
    points = F.array_sort(F.collect_list(F.struct("hours", "plon", "plat")))
    digest = track.groupBy("event_id").agg(F.sha2(F.to_json(points), 256).alias("track"))
    return events.join(digest.hint("merge"), "event_id")


def nearest_assets(events: DataFrame, assets: DataFrame, radius_m: float = 40_000.0) -> DataFrame:
    """Event / asset pairs within a radius, ranked nearest first per event (``asset_pairs``).

    ``events``: event_id, lon, lat; ``assets``: asset_id, alon, alat and anything else.
    """
    w = Window.partitionBy("event_id").orderBy("distance_m", "asset_id")
    return asset_pairs(events, assets, radius_m).withColumn("rank", F.row_number().over(w))


def assess(pairs: DataFrame, track: DataFrame, event_radius_m: Column, sensitivity: str = "sensitivity") -> DataFrame:
    """Exposure of each asset: now, along the drift track, and the combined score.

    ``track``: event_id, hours, plon, plat (particles).  Each step of a track is first known by the box around its particles:
    a step that lies farther from the asset than the event does, and beyond its reach, changes nothing, so only the others
    meet their particles.  Tracks are merge joined: they are many times larger than the file they are made of.
    """
    pairs = cut_lineage(pairs)
    reach = F.greatest(event_radius_m, F.lit(250.0))
    placed = track.select("event_id", "hours", "plon", "plat", *[v.alias(k) for k, v in _places("_e", F.col("plon"), F.col("plat")).items()])
    boxes = placed.groupBy("event_id", "hours").agg(*[f(f"_e{c}").alias(f"_{n}{c}") for c in "xyz" for f, n in ((F.min, "l"), (F.max, "h"))])
    asked = pairs.select("event_id", "asset_id", "alon", "alat", "distance_m", reach.alias("_reach")).withColumns(_places("_a", F.col("alon"), F.col("alat")))
    off = [F.greatest(F.col(f"_l{c}") - F.col(f"_a{c}"), F.col(f"_a{c}") - F.col(f"_h{c}"), F.lit(0.0)) for c in "xyz"]
    bound = _chord(F.greatest("distance_m", "_reach")) * (1 + 1e-9)
    near = asked.join(boxes.hint("merge"), "event_id").where(off[0] * off[0] + off[1] * off[1] + off[2] * off[2] <= bound * bound)
    steps = (near.select("event_id", "asset_id", "hours", "alon", "alat", "_reach").join(placed.select("event_id", "hours", "plon", "plat").hint("merge"), ["event_id", "hours"])
             .withColumn("_d", haversine_m(F.col("plon"), F.col("plat"), F.col("alon"), F.col("alat")))
             .groupBy("event_id", "asset_id", "hours").agg(F.min("_d").alias("_dmin"), F.avg((F.col("_d") <= F.col("_reach")).cast("double")).alias("_frac")))
    path = steps.groupBy("event_id", "asset_id").agg(
        F.min("_dmin").alias("_closest"), F.min_by("hours", F.struct("_dmin", "hours")).alias("_ch"),
        F.min(F.when((F.col("_frac") > 0.01) & (F.col("hours") > 0), F.col("hours"))).alias("eta_hours"))
    out = pairs.join(path, ["event_id", "asset_id"], "left")
    nearer = F.coalesce(F.col("_closest") < F.col("distance_m"), F.lit(False))
    closest = F.when(nearer, F.col("_closest")).otherwise(F.col("distance_m"))
    hit = F.col("eta_hours").isNotNull()
    brg = bearing_deg(F.col("lon"), F.col("lat"), F.col("alon"), F.col("alat"))
    score = clip(F.exp(-closest / 5000.0) * F.when(hit, 1.0).otherwise(0.35) * F.col(sensitivity), 0.0, 1.0)
    return out.withColumns({"bearing_deg": brg, "direction": compass(brg), "closest_approach_m": closest,
                            "closest_approach_hours": F.when(nearer, F.col("_ch").cast("double")).otherwise(0.0), "intersects": hit, "exposure_score": score}).drop("_closest", "_ch")


def wind_components(speed: Column, direction_from: Column) -> tuple[Column, Column]:
    rad = F.radians(direction_from)
    return -speed * F.sin(rad), -speed * F.cos(rad)


def surface_drift(u: Column, v: Column, factor: float = DRIFT_FACTOR, deflection_deg: float = DEFLECTION_DEG, north: bool = True) -> tuple[Column, Column]:
    """Wind-driven surface current, turned clockwise in the northern hemisphere."""
    t = math.radians(-deflection_deg if north else deflection_deg)
    c, s = math.cos(t), math.sin(t)
    return factor * (u * c - v * s), factor * (u * s + v * c)


def drift_starts(wind: DataFrame, keys: Sequence[str], horizons: Sequence[int] = HORIZONS_H, every_h: int = 6) -> DataFrame:
    """Displacement and persistence error at each horizon from every sixth hour.

    ``wind``: keys, h (hour number from the start of the record), du, dv (m/s); one row per
    hour, so a point's record is bounded by the calendar.  A start with any missing hour in
    its longest horizon is dropped.
    """
    top = max(horizons)
    w = Window.partitionBy(*keys).orderBy("h")
    out = wind.withColumn("_n", F.count(F.lit(1)).over(w.rangeBetween(0, top - 1)))
    ends = Window.partitionBy(*keys)
    out = out.withColumn("_last", F.max("h").over(ends))
    cols = []
    for hz in horizons:
        span = w.rangeBetween(0, hz - 1)
        x, y = F.sum("du").over(span) * 3600.0, F.sum("dv").over(span) * 3600.0
        px, py = F.col("du") * 3600.0 * hz, F.col("dv") * 3600.0 * hz
        cols.append(F.struct(F.lit(hz).alias("horizon_h"), F.hypot(x, y).alias("displacement_m"), F.hypot(x - px, y - py).alias("persistence_error_m")))
    out = out.withColumn("_hz", F.array(*cols)).where((F.col("_n") == top) & (F.col("h") % every_h == 0) & (F.col("h") < F.col("_last") + 1 - top))
    return out.select(*keys, "h", F.explode("_hz").alias("_z")).select(*keys, "h", "_z.*")


def drift_bounds(starts: DataFrame, keys: Sequence[str], season: Column | None = None) -> DataFrame:
    """Median, p90, p95 and maximum (km) of displacement and persistence error.

    With ``season`` (a condition on the starts, such as days within 45 of a centre) a second view holds those starts alone:
    column ``view`` is ``all_year`` or ``season``.
    """
    if season is not None:
        views = F.when(season, F.array(F.lit("all_year"), F.lit("season"))).otherwise(F.array(F.lit("all_year")))
        return drift_bounds(starts.withColumn("view", F.explode(views)), [*keys, "view"])
    km = starts.select(*keys, "horizon_h", (F.col("displacement_m") / 1000).alias("displacement"), (F.col("persistence_error_m") / 1000).alias("persistence_error"))
    long = km.unpivot([*keys, "horizon_h"], ["displacement", "persistence_error"], "measure", "km")
    k = [*keys, "horizon_h", "measure"]
    q = exact_quantiles(long, k, "km", {"median_km": 0.5, "p90_km": 0.9, "p95_km": 0.95})
    return q.join(long.groupBy(*k).agg(F.max("km").alias("max_km")), k)


def track_spread(track: DataFrame, keys: Sequence[str], lon0: str, lat0: str, active: str) -> DataFrame:
    """Centroid, displacement, bearing, rms spread and beached share of the particles per step.

    Spread follows from second moments, so one aggregate suffices.
    """
    g = track.groupBy(*keys, "hours", lon0, lat0).agg(F.avg("plon").alias("centroid_lon"), F.avg("plat").alias("centroid_lat"), F.var_pop("plon").alias("_vx"), F.var_pop("plat").alias("_vy"),
                                                      (1.0 - F.avg(F.col(active).cast("double"))).alias("beached_fraction"))
    mx = M_PER_DEG_LON * F.cos(F.radians(F.col(lat0)))
    dx, dy = (F.col("centroid_lon") - F.col(lon0)) * mx, (F.col("centroid_lat") - F.col(lat0)) * M_PER_DEG_LAT
    return g.withColumns({"displacement_m": F.hypot(dx, dy), "bearing_deg": F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0)),
                          "spread_radius_m": F.sqrt(F.col("_vx") * mx * mx + F.col("_vy") * M_PER_DEG_LAT ** 2)}).drop("_vx", "_vy")


def sampling_plan(px: DataFrame, targets: DataFrame, keys: Sequence[str], min_separation_m: float = 400.0, max_points: int = 6,
                  control_shore_m: float = 800.0, shallow_m: float = 300.0) -> DataFrame:
    """Field sampling points per event: core, leading edge, asset boundary, control, uncertainty.

    ``px``: water pixels (keys, row, col, lon, lat, score, in_event, shore_m).  ``targets``
    (one row per event): keys, drift_lon, drift_lat, asset_lon, asset_lat, each nullable.
    Each role is a combinable arg-min over all pixels that keep their distance from the
    points chosen before; nothing is capped and no event is gathered.
    """
    keys = list(keys)
    t = targets
    chosen: list[str] = []
    point = F.struct("lon", "lat", "row", "col", "score")
    cell = (F.col("row"), F.col("col"))
    joined = px.join(t, keys)

    def far(frame):
        ok = F.lit(True)
        for c in chosen:
            d = haversine_m(F.col("lon"), F.col("lat"), F.col(f"{c}.lon"), F.col(f"{c}.lat"))
            ok = ok & F.coalesce(d >= min_separation_m, F.lit(True))
        return ok

    def first(cond, order, role, strict):
        """``strict`` picks the best pixel and drops the role if it is too close to earlier points."""
        nonlocal t, joined
        cond = F.coalesce(cond, F.lit(False))
        free = far(joined)
        rank = F.when(cond if strict else cond & free, F.struct(order, *cell))
        g = joined.groupBy(*keys).agg(F.min_by(F.struct(point.alias("p"), free.alias("free")), rank).alias("_b"))
        g = g.select(*keys, F.when(F.col("_b.free"), F.col("_b.p")).alias(role))
        t = cut_lineage(t.join(g, keys, "left"))                 # one row per event, so later roles read the pixels once
        joined = px.join(t, keys)
        chosen.append(role)

    here = lambda lon, lat: haversine_m(F.col("lon"), F.col("lat"), F.col(lon), F.col(lat))                    # noqa: E731
    first(F.col("in_event") & F.col("score").isNotNull(), -F.col("score"), "EVENT_CORE", True)
    first(F.col("in_event") & F.col("drift_lon").isNotNull(), here("drift_lon", "drift_lat"), "LEADING_EDGE", True)
    first(F.col("asset_lon").isNotNull(), here("asset_lon", "asset_lat"), "ASSET_BOUNDARY", False)
    first(~F.col("in_event") & F.col("score").isNotNull() & (F.col("shore_m") > control_shore_m), F.col("score"), "BACKGROUND_CONTROL", False)

    limits = exact_quantiles(px, keys, "score", {"_lo": 0.85, "_hi": 0.97}).drop("n")
    band = (px.join(limits, keys).where(F.col("score").between(F.col("_lo"), F.col("_hi")) & ~F.col("in_event") & (F.col("shore_m") < shallow_m))
            .withColumn("_lin", F.col("row").cast("double") * 1_000_000 + F.col("col")))
    middle = select_ranks(band, keys, "_lin", {"_lin": F.floor(F.col("n") / 2)}).drop("n")
    mid = band.join(middle, [*keys, "_lin"]).select(*keys, point.alias("p"))
    free = F.lit(True)
    for c in chosen:
        free = free & F.coalesce(haversine_m(F.col("p.lon"), F.col("p.lat"), F.col(f"{c}.lon"), F.col(f"{c}.lat")) >= min_separation_m, F.lit(True))
    t = t.join(mid, keys, "left").withColumn("UNCERTAINTY_POINT", F.when(free, F.col("p"))).drop("p")
    roles = list(ROLE_PRIORITY)
    entries = F.filter(F.array(*[F.struct(F.lit(ROLE_PRIORITY[r]).alias("priority"), F.lit(i).alias("ord"), F.lit(r).alias("role"), F.col(r).alias("p")) for i, r in enumerate(roles)]),
                       lambda e: e["p"].isNotNull())
    plan = t.select(*keys, F.posexplode(F.slice(F.array_sort(entries), 1, max_points)).alias("_i", "_e"))
    return plan.select(*keys, F.format_string("S%02d", F.col("_i") + 1).alias("sample_id"), F.col("_e.role").alias("role"), F.col("_e.priority").alias("priority"),
                       F.col("_e.p.row").alias("row"), F.col("_e.p.col").alias("col"), F.col("_e.p.lon").alias("lon"), F.col("_e.p.lat").alias("lat"), F.col("_e.p.score").alias("score"))
