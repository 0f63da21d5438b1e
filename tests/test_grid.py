"""Raster operators against brute force on a small mask with holes, touching corners and border regions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import grid

R, C = 12, 15
rng = np.random.default_rng(4)
MASK = rng.random((R, C)) < 0.68
MASK[3:7, 4:9] = True
MASK[4, 6] = False


@pytest.fixture(scope="module")
def mask(spark):
    return spark.createDataFrame([(1, int(r), int(c)) for r, c in np.argwhere(MASK)], "g int, row int, col int")


def board(df):
    out = np.zeros((R, C), bool)
    for r in df.collect():
        out[r["row"], r["col"]] = True
    return out


def step(m, grow):
    p = np.pad(m, 1, constant_values=False)
    n = [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]
    return np.any(n, axis=0) if grow else np.all(n, axis=0)


def flood(m):
    lab = np.full(m.shape, -1)
    for r, c in np.argwhere(m):
        if lab[r, c] >= 0:
            continue
        todo = [(r, c)]
        lab[r, c] = r * C + c
        while todo:
            a, b = todo.pop()
            for x, y in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= x < R and 0 <= y < C and m[x, y] and lab[x, y] < 0:
                    lab[x, y] = r * C + c
                    todo.append((x, y))
    return lab


@pytest.mark.parametrize("k", [1, 2])
def test_erode_and_dilate(mask, k):
    e = d = MASK
    for _ in range(k):
        e, d = step(e, False), step(d, True)
    np.testing.assert_array_equal(board(grid.erode(mask, ["g"], k)), e)
    np.testing.assert_array_equal(board(grid.dilate(mask, ["g"], k, R, C)), d)


@pytest.mark.parametrize("tile", [128, 5, 2])
def test_components(mask, tile):
    want = flood(MASK)
    got = {(r["row"], r["col"]): r["label"] for r in grid.connected_components(mask, ["g"], C, tile=tile).collect()}
    assert got == {(int(r), int(c)): int(want[r, c]) for r, c in np.argwhere(MASK)}


def test_components_of_a_long_line(spark):
    line = spark.createDataFrame([(1, 0, c) for c in range(64)], "g int, row int, col int")
    assert {r["label"] for r in grid.connected_components(line, ["g"], 64, tile=1).collect()} == {0}


def test_fill_holes_and_filter(spark, mask):
    grids = spark.createDataFrame([(1, R, C)], "g int, n_rows int, n_cols int")
    back = flood(~MASK)
    edge = {back[r, c] for r in range(R) for c in range(C) if (r in (0, R - 1) or c in (0, C - 1)) and back[r, c] >= 0}
    want = MASK | ((back >= 0) & ~np.isin(back, list(edge)))
    np.testing.assert_array_equal(board(grid.fill_holes(mask, grids, ["g"], C)), want)
    lab = flood(MASK)
    sizes = {x: (lab == x).sum() for x in set(lab[lab >= 0])}
    np.testing.assert_array_equal(board(grid.component_filter(mask, ["g"], C, 4)), np.vectorize(lambda x: sizes.get(x, 0) >= 4)(lab))


def test_distance_is_exact(mask):
    land = np.argwhere(~MASK)
    for r in grid.distance_transform(mask, ["g"], R, C).collect():
        want = np.sqrt(((land - [r["row"], r["col"]]) ** 2).sum(axis=1).min())
        assert abs(r["dist_px"] - want) < 1e-12


def test_distance_without_land_is_null(spark):
    full = spark.createDataFrame([(1, r, c) for r in range(3) for c in range(3)], "g int, row int, col int")
    assert {r["dist_px"] for r in grid.distance_transform(full, ["g"], 3, 3).collect()} == {None}


def test_boundary_of_a_square(spark):
    sq = spark.createDataFrame([(1, r, c, 7) for r in range(2, 5) for c in range(2, 5)], "g int, row int, col int, label int")
    r = grid.region_boundary(sq, ["g"], 20.0).first()
    assert (r["boundary_edges"], r["n_px"], r["perimeter_m"]) == (12, 9, 240.0)


def test_select_in_boxes(spark, mask):
    boxes = spark.createDataFrame([(1, 5, 2, 6, 3, 40)], "g int, label int, row0 int, row1 int, col0 int, col1 int")
    assert grid.select_in_boxes(mask, boxes, ["g"], tile=4).count() == MASK[2:7, 3:].sum()


def test_local_median_replicates_edges(spark):
    v = rng.normal(size=(R, C)).round(3)
    px = spark.createDataFrame([(1, r, c, float(v[r, c])) for r in range(R) for c in range(C)], "g int, row int, col int, v double")
    pad = np.pad(v, 1, mode="edge")
    for x in grid.local_median(px, ["g"], "v", 3, R, C).where(F.col("row") < 3).collect():
        assert x["background"] == np.median(pad[x["row"]:x["row"] + 3, x["col"]:x["col"] + 3])


@pytest.mark.parametrize(("window", "tile"), [(5, 4), (9, 5), (25, 128), (7, 3)])
def test_local_median_of_tiles_fills_with_the_scene_median(spark, window, tile):
    v = rng.normal(size=(R, C)).round(2)
    gone = rng.random((R, C)) < 0.3
    rows = [(1, r, c, None if gone[r, c] and (r + c) % 2 else float(v[r, c])) for r in range(R) for c in range(C) if not gone[r, c] or (r + c) % 2]
    board = np.full((R, C), np.nan)
    for _, r, c, x in rows:
        board[r, c] = np.nan if x is None else x
    board = np.where(np.isnan(board), np.nanmedian(board), board)
    pad = np.pad(board, window // 2, mode="edge")
    px = spark.createDataFrame([*rows, (2, 0, 0, None), (None, 3, 3, 4.0)], "g int, row int, col int, v double")
    got = grid.local_median(px, ["g"], "v", window, R, C, tile=tile).collect()
    assert len(got) == len(rows) + 2
    for x in got:
        if x["g"] == 1:
            assert x["background"] == np.median(pad[x["row"]:x["row"] + window, x["col"]:x["col"] + window])
        else:
            assert x["background"] == (4.0 if x["g"] is None else None)


def test_moving_median_of_a_wide_window():
    b = rng.normal(size=(170, 190)).round(1)
    got = grid.moving_medians(b, 151)
    assert got.shape == (20, 40)
    for r, c in [(0, 0), (19, 39), (7, 21)]:
        assert got[r, c] == np.median(b[r:r + 151, c:c + 151])


def test_distance_on_rows_wider_than_ten_thousand_pixels(spark):
    width = 12_000
    land = sorted(rng.choice(width, 25, replace=False).tolist())
    rows = [(r, c) for r in range(3) for c in range(width) if not (r == 1 and c in land)]
    got = {(x["row"], x["col"]): x["dist_px"] for x in grid.distance_transform(spark.createDataFrame(rows, "row int, col int"), [], 3, width).collect()}
    for r in range(3):
        want = np.sqrt(np.min((np.arange(width)[:, None] - np.array(land)[None, :]) ** 2, axis=1) + (r - 1) ** 2)
        for c in range(width):
            assert (r, c) not in got or got[r, c] == want[c]
    assert len(got) == len(rows)


def test_lower_envelope_of_many_runs():
    for _ in range(50):
        sizes = rng.integers(1, 60, 5)
        end = np.cumsum(sizes)
        start, n = end - sizes, int(end[-1])
        place = np.concatenate([np.arange(k) + rng.integers(0, 99) for k in sizes])
        height = np.where(rng.random(n) < 0.4, np.inf, rng.integers(0, 20, n))
        got = grid.nearest_squares(place, height, start, end)
        for a, z in zip(start, end):
            np.testing.assert_array_equal(got[a:z], ((place[a:z, None] - place[None, a:z]) ** 2 + height[None, a:z] ** 2).min(axis=1))


def test_dark_regions_tell_wind_and_lookalikes(spark):
    lab = spark.createDataFrame([(g, r, c, 7, 6.0) for g in (1, 2, 3) for r in range(4) for c in range(9)], "g int, row int, col int, label int, drop double")
    wind = F.when(F.col("g") == 1, 2.04).when(F.col("g") == 2, 13.0).otherwise(6.0)
    got = {x["g"]: x for x in grid.dark_regions(lab, ["g"], "drop", 20.0, 0.001, wind).collect()}
    assert got[1]["notes"] == ["wind 2.0 m/s: most of the sea is smooth, lookalikes dominate"] and got[3]["notes"] == []
    assert got[2]["notes"][0].startswith("wind 13.0 m/s") and [got[k]["confidence"] for k in (1, 2, 3)] == [0.3, 0.5, 1.0]
    assert all(x["event_type"] == "SURFACE_DARK_ANOMALY" and len(x["lookalikes"]) == 6 for x in got.values())
