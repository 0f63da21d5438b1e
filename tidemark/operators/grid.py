"""Neighbourhood and region operators on raster masks kept as tables.

A mask is a DataFrame of its *true* pixels: grid keys (area, date ...), ``row`` and ``col``.
Work is expressed on rows, columns and runs of one raster, whose length is bounded by the
raster's own shape, so no step ever gathers a whole raster; anything absent from the table
is false.  The cross of four neighbours is used throughout, so k iterations equal the L1
diamond of radius k.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.blocks import in_tasks, map_blocks
from tidemark.functions.joins import join_small
from tidemark.functions.quantiles import exact_quantiles
from tidemark.session import cut_lineage


# --- Fixed values: dark patches on radar -------------------------------------------------
DARK_TYPE = "SURFACE_DARK_ANOMALY"
LOOKALIKES = ("low wind area", "biogenic surface film (blooms)", "rain cell", "upwelling", "wind shadow behind land", "grease ice / newly formed ice (not in the UAE)")
CALM_MS, ROUGH_MS = 3.0, 12.0
CALM_NOTE = "most of the sea is smooth, lookalikes dominate"
ROUGH_NOTE = "surface films break up; a dark patch is unusual"


def _runs(df: DataFrame, keys: Sequence[str], line: str, along: str, run: str) -> DataFrame:
    """Mark maximal runs of consecutive pixels of one line: adds the run's first position."""
    w = Window.partitionBy(*keys, line).orderBy(along)
    start = F.col(along) - F.coalesce(F.lag(along).over(w), F.lit(-2)) > 1
    return df.withColumn(run, F.max(F.when(start, F.col(along))).over(w))


def row_runs(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Horizontal runs: keys, row, c0, c1 (inclusive)."""
    return (_runs(mask.select(*keys, "row", "col"), keys, "row", "col", "c0")
            .groupBy(*keys, "row", "c0").agg(F.max("col").alias("c1")))


def _depth(mask: DataFrame, keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Per pixel: row run [c0, c1], column run [r0, r1]."""
    m = _runs(mask, keys, "col", "row", "r0")
    m = m.withColumn("r1", F.max("row").over(Window.partitionBy(*keys, "col", "r0")))
    m = _runs(in_tasks(m, tasks, [*keys, "row"]), keys, "row", "col", "c0")
    return m.withColumn("c1", F.max("col").over(Window.partitionBy(*keys, "row", "c0")))


def erode(mask: DataFrame, keys: Sequence[str], k: int, tasks: int | None = None) -> DataFrame:
    """Shrink by k pixels; outside the grid counts as false.

    Uses the L1 distance to the nearest false pixel: the distance inside the column run,
    then the running minimum along the row run in both directions.  Two shuffles whatever
    k is, and no neighbour copies.  ``tasks`` as of ``tasks_for``.
    """
    m = _depth(in_tasks(mask.select(*keys, "row", "col"), tasks, [*keys, "col"]), keys, tasks)
    vertical = F.least(F.col("row") - F.col("r0"), F.col("r1") - F.col("row")) + 1
    m = m.withColumn("_g", vertical)
    left = Window.partitionBy(*keys, "row", "c0").orderBy("col")
    right = Window.partitionBy(*keys, "row", "c0").orderBy(F.col("col").desc())
    dist = F.least(F.min(F.col("_g") - F.col("col")).over(left) + F.col("col"),
                   F.min(F.col("_g") + F.col("col")).over(right) - F.col("col"),
                   F.col("col") - F.col("c0") + 1, F.col("c1") - F.col("col") + 1)
    return m.withColumn("_l1", dist).where(F.col("_l1") > k).select(*keys, "row", "col")


def dilate(mask: DataFrame, keys: Sequence[str], k: int, n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """Grow by k pixels, clipped to the grid.

    Works on runs: a run becomes one interval per touched row (2k + 1 copies of a run, not
    2k^2 + 2k + 1 copies of a pixel), intervals are merged per row and expanded once.
    """
    runs = row_runs(mask, keys).withColumn("_dr", F.explode(F.sequence(F.lit(-k), F.lit(k))))
    reach = F.lit(k) - F.abs("_dr")
    grown = runs.select(*keys, (F.col("row") + F.col("_dr")).alias("row"),
                        (F.col("c0") - reach).alias("a"), (F.col("c1") + reach).alias("b"))
    lo = F.greatest("a", F.lit(0))
    hi = F.col("b") if n_cols is None else F.least("b", F.lit(n_cols - 1))
    grown = grown.withColumns({"a": lo, "b": hi}).where((F.col("row") >= 0) & (F.col("a") <= F.col("b")))
    if n_rows is not None:
        grown = grown.where(F.col("row") < n_rows)
    w = Window.partitionBy(*keys, "row").orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    grown = (grown.withColumn("_new", F.coalesce(F.col("a") > before + 1, F.lit(True)))
             .withColumn("_i", F.sum(F.col("_new").cast("int")).over(w)))
    merged = grown.groupBy(*keys, "row", "_i").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.select(*keys, "row", F.explode(F.sequence("a", "b")).alias("col"))


def opening(mask: DataFrame, keys: Sequence[str], k: int = 1, n_rows: int | None = None, n_cols: int | None = None, tasks: int | None = None) -> DataFrame:
    return dilate(erode(mask, keys, k, tasks), keys, k, n_rows, n_cols)


def closing(mask: DataFrame, keys: Sequence[str], k: int = 1, n_rows: int | None = None, n_cols: int | None = None,
            allowed: DataFrame | None = None) -> DataFrame:
    """Dilate then erode; ``allowed`` re-masks the result (pixels that carry a value)."""
    closed = erode(dilate(mask, keys, k, n_rows, n_cols), keys, k)
    return closed if allowed is None else closed.join(allowed.select(*keys, "row", "col"), [*keys, "row", "col"], "left_semi")


TILE = 128


def _merge(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component for edges (a, b) between nodes 0..n-1."""
    root = np.arange(n)
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
    return root


def _tile_roots(pdf: pd.DataFrame) -> pd.DataFrame:
    """First pixel of each pixel's component inside one tile (at most TILE x TILE pixels)."""
    pdf = pdf.sort_values("_lin", ignore_index=True)
    r, c = (pdf[k].to_numpy() - pdf[k].min() for k in ("row", "col"))
    board = np.full((r.max() + 2, c.max() + 2), -1)
    board[r, c] = np.arange(len(pdf))
    sides = np.concatenate([np.stack([board[r, c], board[r, c + 1]]), np.stack([board[r, c], board[r + 1, c]])], axis=1)
    a, b = sides[:, sides[1] >= 0]
    return pdf.assign(_node=pdf["_lin"].to_numpy()[_merge(len(pdf), a, b)])


def connected_components(mask: DataFrame, keys: Sequence[str], n_cols: int, tile: int = TILE) -> DataFrame:
    """4-connected labels; the label is the linear index of the component's first pixel.

    Each tile of the raster (a bounded group) is labelled on its own; only pixels on tile
    borders then link tile components, through an equi-join on the shared edge.  That graph is
    contracted by alternating large-star and small-star rounds until it no longer changes,
    a logarithmic number of them, every second one ending in a reliable checkpoint.
    """
    keys = list(keys)
    m = mask.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    m = m.withColumns({"_tr": F.floor(F.col("row") / tile).cast("int"), "_tc": F.floor(F.col("col") / tile).cast("int"),
                       "_lin": F.col("row").cast("long") * n_cols + F.col("col")})
    schema = T.StructType([*m.schema.fields, T.StructField("_node", T.LongType())])
    px = cut_lineage(m.groupBy(*keys, "_tr", "_tc").applyInPandas(_tile_roots, schema).select(*keys, "row", "col", "_node"))
    low = px.where((F.col("row") % tile == 0) & (F.col("row") > 0)).select(*keys, (F.col("row") - 1).alias("row"), "col", F.col("_node").alias("u"))
    left = px.where((F.col("col") % tile == 0) & (F.col("col") > 0)).select(*keys, "row", (F.col("col") - 1).alias("col"), F.col("_node").alias("u"))
    border = px.where((F.col("row") % tile == tile - 1) | (F.col("col") % tile == tile - 1))
    pairs = low.unionByName(left).join(border.withColumnRenamed("_node", "v"), [*keys, "row", "col"])
    # The larger node points to the smaller one.
    edges = cut_lineage(pairs.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*edges.columns).cast("decimal(20,0)"))).first()
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
        for _ in range(2):
            edges = _small_star(_large_star(edges, keys), keys)
        edges = cut_lineage(edges)
    roots = edges.select(*keys, F.col("u").alias("_node"), F.col("v").alias("_root"))
    return (px.join(roots, [*keys, "_node"], "left")
            .select(*keys, "row", "col", F.coalesce("_root", "_node").alias("label")))


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*keys, "u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("_m", "u"))
    return (both.join(least, [*keys, "u"]).where(F.col("v") > F.col("u"))
            .select(*keys, F.col("v").alias("u"), F.col("_m").alias("v")).distinct())


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy(*keys, "u").agg(F.min("v").alias("_m"))
    side = (edges.join(least, [*keys, "u"]).where(F.col("v") != F.col("_m"))
            .select(*keys, F.col("v").alias("u"), F.col("_m").alias("v")))
    return side.unionByName(least.select(*keys, "u", F.col("_m").alias("v"))).distinct()


def component_filter(mask: DataFrame, keys: Sequence[str], n_cols: int, min_px: int) -> DataFrame:
    """Drop components smaller than ``min_px``; keeps the label column."""
    labelled = connected_components(mask, keys, n_cols)
    big = labelled.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_px)
    return labelled.join(big.drop("_n"), [*keys, "label"], "left_semi")


def region_stats(labelled: DataFrame, keys: Sequence[str], pixel_m: float, score: str | None = None,
                 p: str | None = None, min_px: int = 1) -> DataFrame:
    """Size, area, centroid, box and score summary of every region, one combined aggregate."""
    aggs = [F.count(F.lit(1)).alias("n_px"), F.avg("row").alias("centroid_row"), F.avg("col").alias("centroid_col"),
            F.min("row").alias("row0"), F.min("col").alias("col0"), F.max("row").alias("row1"), F.max("col").alias("col1")]
    if score:
        aggs += [F.avg(score).alias("mean_score"), F.max(score).alias("max_score")]
    if p:
        aggs += [F.min(p).alias("min_p")]
    out = labelled.groupBy(*keys, "label").agg(*aggs).where(F.col("n_px") >= min_px)
    return out.withColumn("area_km2", F.col("n_px") * (pixel_m ** 2 / 1e6))


def near_or_large(labelled: DataFrame, keys: Sequence[str], row: Column, col: Column, radius: int, min_px: int) -> DataFrame:
    """Regions with a pixel within ``radius`` of a point or of at least ``min_px``; else the largest."""
    near = (F.col("row").between(row - radius, row + radius - 1) & F.col("col").between(col - radius, col + radius - 1))
    regions = labelled.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n_px"), F.max(near.cast("int")).alias("near"))
    regions = regions.withColumn("keep", (F.col("near") == 1) | (F.col("n_px") >= min_px))
    # The fallback is an aggregate per grid joined back, not a window over all its regions.
    best = regions.groupBy(*keys).agg(F.max(F.col("keep").cast("int")).alias("_any"),
                                      F.max_by("label", F.struct("n_px", -F.col("label"))).alias("_largest"))
    chosen = (regions.join(best, list(keys)) if keys else regions.crossJoin(F.broadcast(best)))
    chosen = chosen.where(F.col("keep") | ((F.col("_any") == 0) & (F.col("label") == F.col("_largest"))))
    return chosen.select(*keys, "label", "n_px", "near")


def region_boundary(labelled: DataFrame, keys: Sequence[str], pixel_m: float) -> DataFrame:
    """Boundary edges, perimeter and area per region (edges = 4 n - 2 shared sides)."""
    px = labelled.select(*keys, "label", "row", "col")
    on = [*keys, "label", "row", "col"]
    right = px.select(*keys, "label", "row", (F.col("col") - 1).alias("col"), F.lit(1).alias("_r"))
    below = px.select(*keys, "label", (F.col("row") - 1).alias("row"), "col", F.lit(1).alias("_d"))
    joined = px.join(right, on, "left").join(below, on, "left")
    out = joined.groupBy(*keys, "label").agg(
        (4 * F.count(F.lit(1)) - 2 * (F.count("_r") + F.count("_d"))).alias("boundary_edges"), F.count(F.lit(1)).alias("n_px"))
    return out.withColumns({"perimeter_m": F.col("boundary_edges") * pixel_m, "area_m2": F.col("n_px") * pixel_m ** 2})


def complement(mask: DataFrame, grids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """False pixels of every grid; ``grids`` carries keys, n_rows and n_cols."""
    cells = (grids.select(*keys, "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"))
             .select(*keys, "row", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col")))
    return cells.join(mask.select(*keys, "row", "col"), [*keys, "row", "col"], "left_anti")


def fill_holes(mask: DataFrame, grids: DataFrame, keys: Sequence[str], n_cols: int) -> DataFrame:
    """Add background components that do not touch the grid's border."""
    back = connected_components(complement(mask, grids, keys), keys, n_cols)
    edge = grids.select(*keys, "n_rows", "n_cols")
    back = back.join(edge, list(keys)) if keys else back.crossJoin(F.broadcast(edge))
    border = ((F.col("row") == 0) | (F.col("col") == 0)
              | (F.col("row") == F.col("n_rows") - 1) | (F.col("col") == F.col("n_cols") - 1))
    open_ = back.groupBy(*keys, "label").agg(F.max(border.cast("int")).alias("_b")).where(F.col("_b") == 1)
    holes = back.join(open_.drop("_b"), [*keys, "label"], "left_anti")
    return mask.select(*keys, "row", "col").unionByName(holes.select(*keys, "row", "col"))


def nearest_squares(place: np.ndarray, height: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """min over j of (place - place_j) ** 2 + height_j ** 2 within each run [start, end) of ascending places.

    The lower envelope of the parabolas: the best j never moves back as the place moves on, so the best of
    a middle place parts the candidates of the places on either side.  All runs take a step together, every step
    reads each candidate about once, and there are log2 (longest run) steps.
    """
    out = np.empty(len(place))
    rise = height.astype(np.float64) ** 2
    x0, x1, j0, j1 = (np.asarray(v, np.int64) for v in (start, end, start, np.asarray(end) - 1))
    while len(x0):
        mid = (x0 + x1) // 2
        size = j1 - j0 + 1
        first = np.cumsum(size) - size
        j = np.repeat(j0 - first, size) + np.arange(int(size.sum()))
        cost = (np.repeat(place[mid], size) - place[j]).astype(np.float64) ** 2 + rise[j]
        least = np.minimum.reduceat(cost, first)
        out[mid] = least
        hit = np.flatnonzero(cost == np.repeat(least, size))
        best = j[hit[np.searchsorted(hit, first)]]
        x0, x1, j0, j1 = (np.concatenate(v) for v in ((x0, mid + 1), (mid, x1), (j0, best), (best, j1)))
        some = x0 < x1
        x0, x1, j0, j1 = x0[some], x1[some], j0[some], j1[some]
    return out


def _row_distances(table: pa.Table, new: np.ndarray, n_cols: int) -> pa.Table:
    col = table.column("col").to_numpy().astype(np.int64)
    gap = table.column("_g").to_numpy().astype(np.float64)
    gap = np.where(np.isnan(gap), np.inf, gap)
    head = new.copy()
    head[1:] |= col[1:] != col[:-1] + 1                                      # runs of neighbouring pixels
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(col)))
    tail = at + size - 1
    run = np.cumsum(head) - 1
    # each run stands between the pixels at its ends: false ones, or the border of the raster
    start = at + 2 * np.arange(len(at))
    place, height = np.empty(len(col) + 2 * len(at), np.int64), np.empty(len(col) + 2 * len(at))
    own = np.arange(len(col)) + 2 * run + 1
    place[own], height[own] = col, gap
    place[start], height[start] = col[at] - 1, np.where(col[at] > 0, 0.0, np.inf)
    place[start + size + 1], height[start + size + 1] = col[tail] + 1, np.where(col[tail] < n_cols - 1, 0.0, np.inf)
    d = np.sqrt(nearest_squares(place, height, start, start + size + 2)[own])
    return table.drop_columns(["_g"]).append_column("dist_px", pa.array(d, mask=~np.isfinite(d)))


def distance_transform(mask: DataFrame, keys: Sequence[str], n_rows: int, n_cols: int) -> DataFrame:
    """Exact Euclidean distance (pixels) from each true pixel to the nearest false pixel of the grid.

    Separable: the vertical distance comes from the column run; along a row run the lower envelope of
    the parabolas over those distances gives the nearest pixel (``nearest_squares``).  A task holds
    one row of a raster at a time; nothing is copied per pixel.  NULL where the grid has no false pixel in reach.
    """
    m = _runs(mask.select(*keys, "row", "col"), keys, "col", "row", "r0")
    m = m.withColumn("r1", F.max("row").over(Window.partitionBy(*keys, "col", "r0")))
    up = F.when(F.col("r0") > 0, F.col("row") - F.col("r0") + 1)
    down = F.when(F.col("r1") < n_rows - 1, F.col("r1") - F.col("row") + 1)
    m = m.select(*keys, "row", "col", F.least(up, down).cast("double").alias("_g"))                       # least skips NULL
    schema = ", ".join(f"`{c}` {m.schema[c].dataType.simpleString()}" for c in [*keys, "row", "col"])
    return map_blocks(m, [*keys, "row"], lambda t, new: _row_distances(t, new, n_cols), f"{schema}, dist_px double", ["col"])


def shore_zones(dist: DataFrame, pixel_m: float, nearshore_m: float = 1500.0) -> DataFrame:
    """Zone of each water pixel by its distance to land."""
    metres = F.col("dist_px") * pixel_m
    return dist.withColumn("zone", F.when(metres < nearshore_m, "nearshore").otherwise("offshore"))


def static_water(stack: DataFrame, keys: Sequence[str], water: Column, min_fraction: float = 0.5) -> DataFrame:
    """Water frequency of each pixel over the acquisitions and the persistent-water flag."""
    out = stack.groupBy(*keys, "row", "col").agg(F.avg(water.cast("double")).alias("water_freq"), F.count(F.lit(1)).alias("n_acq"))
    return out.withColumn("persistent", F.col("water_freq") >= min_fraction)


def sample_acquisitions(acquisitions: DataFrame, order: Sequence[str], total: int, sample: int) -> DataFrame:
    """Every ``total // sample``-th acquisition in order (the acquisition list is one row per scene)."""
    step = max(1, total // sample)
    numbered = acquisitions.withColumn("_i", F.row_number().over(Window.orderBy(*order)) - 1)
    return numbered.where(F.col("_i") % step == 0).drop("_i")


#: Side of the tiles of a moving median; a tile is read with a border of half a window.
MEDIAN_TILE = 128


def moving_medians(board: np.ndarray, window: int) -> np.ndarray:
    """Median of every full ``window`` x ``window`` square of ``board`` (odd window).

    Every cell gets its own rank once.  A row of output keeps which ranks its window holds, with counts per
    256 ranks; moving on by a column, one column of ranks enters and one leaves, for all rows at once.
    """
    tall, wide = board.shape
    rows, cols, half = tall - window + 1, wide - window + 1, window * window // 2
    order = np.argsort(board, axis=None, kind="stable")
    ranks = np.empty(board.size, np.int64)
    ranks[order] = np.arange(board.size)
    ranks = ranks.reshape(board.shape)
    values = board.ravel()[order]
    coarse = (board.size >> 8) + 1
    held = np.zeros((rows, coarse << 8), bool)
    count = np.zeros((rows, coarse), np.int64)
    down = np.arange(rows)[:, None] + np.arange(window)[None, :]             # the window's rows of each row of output
    line = np.broadcast_to(np.arange(rows)[:, None], down.shape)

    def turn(col: int, on: bool) -> None:
        r = ranks[down, col]
        held[line, r] = on
        moved = np.bincount((line * coarse + (r >> 8)).ravel(), minlength=rows * coarse).reshape(rows, coarse)
        count[...] += moved if on else -moved

    out, every = np.empty((rows, cols)), np.arange(rows)
    for col in range(wide):
        turn(col, True)
        if col >= window:
            turn(col - window, False)
        if col >= window - 1:
            upto = np.cumsum(count, axis=1)
            part = (upto > half).argmax(axis=1)
            rest = half - (upto[every, part] - count[every, part])
            inside = np.cumsum(held.reshape(rows, coarse, 256)[every, part], axis=1)
            out[:, col - window + 1] = values[(part << 8) + (inside > rest[:, None]).argmax(axis=1)]
    return out


def _tile_medians(keys: list[str], value: str, window: int, n_rows: int, n_cols: int, tile: int):
    half = window // 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["_tr"].iloc[0]) * tile, int(pdf["_tc"].iloc[0]) * tile
        r1, c1 = min(r0 + tile, n_rows), min(c0 + tile, n_cols)
        top, left, bottom, right = max(r0 - half, 0), max(c0 - half, 0), min(r1 + half, n_rows), min(c1 + half, n_cols)
        row, col = pdf["row"].to_numpy().astype(np.int64), pdf["col"].to_numpy().astype(np.int64)
        board = np.full((bottom - top, right - left), float(pdf["_fill"].iloc[0]))
        v = pdf[value].to_numpy(dtype=np.float64, na_value=np.nan)
        known = np.isfinite(v)
        board[row[known] - top, col[known] - left] = v[known]
        board = np.pad(board, ((half - (r0 - top), half - (bottom - r1)), (half - (c0 - left), half - (right - c1))), mode="edge")
        own = (row >= r0) & (row < r1) & (col >= c0) & (col < c1)
        out = pdf.loc[own, [*keys, "row", "col"]]
        if not own.any():
            return out.assign(background=np.zeros(0))
        return out.assign(background=moving_medians(board, window)[row[own] - r0, col[own] - c0])
    return run


def local_median(px: DataFrame, keys: Sequence[str], value: str, window: int, n_rows: int, n_cols: int, tile: int = MEDIAN_TILE) -> DataFrame:
    """Exact moving median over an odd square window of any size, edges replicated.

    Cells of the grid that are absent, NULL or not finite count with the scene's median.  The raster is cut into
    tiles that are read with a border of half a window, so a pixel is copied to the few tiles it reaches and a
    task holds one tile, whatever the raster's size.  NULL where a scene has no value at all.
    """
    keys, half = list(keys), window // 2
    known = F.when(~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value)) < float("inf")), F.col(value).cast("double"))
    cells = px.select(*keys, "row", "col", known.alias(value))
    fill = exact_quantiles(cells, keys, value, {"_fill": 0.5}).drop("n")
    reach = lambda c, n: F.sequence(F.greatest(F.floor((F.col(c) - half) / tile), F.lit(0)), F.least(F.floor((F.col(c) + half) / tile), F.lit((n - 1) // tile)))
    spread = (join_small(cells, fill, keys, "left") if keys else cells.crossJoin(F.broadcast(fill)))
    empty = spread.where(F.col("_fill").isNull()).select(*keys, "row", "col", F.lit(None).cast("double").alias("background"))
    spread = spread.where(F.col("_fill").isNotNull()).withColumn("_tr", F.explode(reach("row", n_rows))).withColumn("_tc", F.explode(reach("col", n_cols)))
    schema = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in [*keys, "row", "col"])
    medians = spread.groupBy(*keys, "_tr", "_tc").applyInPandas(_tile_medians(keys, value, window, n_rows, n_cols, tile), f"{schema}, background double")
    return medians.unionByName(empty)


def dark_regions(labelled: DataFrame, keys: Sequence[str], drop: str, pixel_m: float, min_area_km2: float,
                 wind: Column | None = None) -> DataFrame:
    """Dark patches: area, median contrast, elongation from the 2 x 2 covariance, confidence by wind, notes and lookalikes."""
    cov = labelled.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("n_px"), F.avg("row").alias("centroid_row"), F.avg("col").alias("centroid_col"),
        F.var_samp("row").alias("_rr"), F.var_samp("col").alias("_cc"), F.covar_samp("row", "col").alias("_rc"))
    area = F.col("n_px") * (pixel_m ** 2 / 1e6)
    cov = cov.withColumn("area_km2", area).where(F.col("area_km2") >= min_area_km2)
    contrast = exact_quantiles(labelled, [*keys, "label"], drop, {"contrast_db": 0.5}).drop("n")
    half = (F.col("_rr") + F.col("_cc")) / 2
    gap = F.sqrt(F.pow((F.col("_rr") - F.col("_cc")) / 2, 2) + F.pow("_rc", 2))
    stretch = F.when(F.col("n_px") > 2, F.sqrt((half + gap) / F.greatest(half - gap, F.lit(1e-9)))).otherwise(F.lit(1.0))
    out = cov.withColumn("elongation", stretch).drop("_rr", "_cc", "_rc").join(contrast, [*keys, "label"])
    factor, note = F.lit(1.0), F.lit(None).cast("string")
    if wind is not None:
        factor = F.when(wind < CALM_MS, 0.3).when(wind > ROUGH_MS, 0.5).otherwise(1.0)
        speed = F.format_string("wind %.1f m/s: ", wind)
        note = F.when(wind < CALM_MS, F.concat(speed, F.lit(CALM_NOTE))).when(wind > ROUGH_MS, F.concat(speed, F.lit(ROUGH_NOTE)))
    return out.withColumns({"confidence": F.least(F.lit(1.0), F.col("contrast_db") / 6.0) * factor, "notes": F.array_compact(F.array(note)),
                            "event_type": F.lit(DARK_TYPE), "lookalikes": F.array(*[F.lit(x) for x in LOOKALIKES])})


def mask_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels two masks share, per grid."""
    return (a.select(*keys, "row", "col").intersect(b.select(*keys, "row", "col"))
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("n_shared")))


def select_in_boxes(px: DataFrame, boxes: DataFrame, keys: Sequence[str], tile: int = 32) -> DataFrame:
    """Pixels inside each box (row0..row1, col0..col1): an equi-join on raster tiles, then the exact test."""
    tiles = (boxes.withColumn("_tr", F.explode(F.sequence(F.floor(F.col("row0") / tile), F.floor(F.col("row1") / tile))))
             .withColumn("_tc", F.explode(F.sequence(F.floor(F.col("col0") / tile), F.floor(F.col("col1") / tile)))))
    keyed = px.withColumns({"_tr": F.floor(F.col("row") / tile), "_tc": F.floor(F.col("col") / tile)})
    inside = F.col("row").between(F.col("row0"), F.col("row1")) & F.col("col").between(F.col("col0"), F.col("col1"))
    return keyed.join(tiles, [*keys, "_tr", "_tc"]).where(inside).drop("_tr", "_tc", "row0", "row1", "col0", "col1")
