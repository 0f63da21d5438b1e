"""Distance joins at any latitude and across the date line; thinning of long chains; scoring without a scorable group."""

import math

from pyspark.sql import functions as F

from tidemark.operators import exposure, ingest, learn, matchup


def metres(a, b):
    (x1, y1), (x2, y2) = ((math.radians(v) for v in p) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(1, h)))


EVENTS = [(10.0, 78.0), (179.9, 10.0), (0.0, 89.95), (-179.95, -85.0), (54.0, 24.0)]
ASSETS = [(11.6, 78.0), (-179.9, 10.0), (170.0, 89.9), (179.9, -85.1), (54.3, 24.1), (55.0, 24.0), (-10.0, 78.0)]


def test_nearest_assets_everywhere(spark):
    events = spark.createDataFrame([(k, *p) for k, p in enumerate(EVENTS)], "event_id int, lon double, lat double")
    assets = spark.createDataFrame([(k, *p) for k, p in enumerate(ASSETS)], "asset_id int, alon double, alat double")
    got = {(r.event_id, r.asset_id): r.distance_m for r in exposure.nearest_assets(events, assets).collect()}
    want = {(e, a): metres(p, q) for e, p in enumerate(EVENTS) for a, q in enumerate(ASSETS) if metres(p, q) <= 40_000}
    assert got.keys() == want.keys() and len(want) >= 5
    assert all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_footprints_everywhere(spark):
    coarse = [(0, 10.0, 78.0), (1, 180.0, 10.0), (2, -179.9999, 0.0), (3, 54.0, 24.0)]
    step = 30 / 111_320
    fine = [(lon + i * step / math.cos(math.radians(lat)), lat + j * step, 1.0) for _, lon, lat in coarse for i in range(-6, 7) for j in range(-6, 7)]
    fine = [((lon + 180) % 360 - 180, lat, v) for lon, lat, v in fine]
    got = matchup.footprint_match(spark.createDataFrame(fine, "lon double, lat double, v double"), spark.createDataFrame(coarse, "k int, lon double, lat double"), ["k"], ["v"]).collect()
    want = {}
    for k, x, y in coarse:
        want[k] = sum(min((lon - x) % 360, 360 - (lon - x) % 360) <= 150 / (111320 * math.cos(math.radians(y))) and abs(lat - y) <= 150 / 111320 for lat, lon in ((f[1], f[0]) for f in fine))
    assert {r.k: r.n_px for r in got} == want and len(want) == 4


def test_thinning_of_a_chain(spark):
    points = spark.createDataFrame([("g", float(k) * 0.9, 0.0, k) for k in range(12)], "g string, x double, y double, o int")
    kept = sorted(r.o for r in ingest.keep_separated(points, ["g"], "x", "y", "o", 1.0, 1.0).collect())
    assert kept == [0, 2, 4, 6, 8, 10]
    assert ingest.keep_separated(points.limit(0), ["g"], "x", "y", "o", 1.0, 1.0).collect() == []


def test_groups_that_cannot_be_scored_are_reported(spark):
    df = spark.createDataFrame([("a", 1.0, 1)] * 3 + [("b", 2.0, 0)] * 3, "g string, x double, y int")
    out = learn.leave_one_group_out(df, "g", ["x"], "y")
    assert {(r.held_out, r.n_test, r.test_positive, r.n_train, r.auroc, r.status) for r in out.collect()} == {(g, 3, p, 3, None, "needs both classes in train and test") for g, p in (("a", 3), ("b", 0))}
    some = spark.createDataFrame([(g, float(k), int(k % 2)) for g in "ab" for k in range(8)], "g string, x double, y int")
    full = learn.leave_one_group_out(some, "g", ["x"], "y")
    assert sorted(out.columns) == sorted(full.columns) and all(r.status is None and r.n == 8 for r in full.collect())
    assert learn.leave_one_group_out(df.limit(0), "g", ["x"], "y").collect() == []
    assert learn.compare_feature_sets(some, {"s": "g"}, {"one": ["x"]}, "y").collect() == []        # folds of eight rows are too small


def test_nearest_assets_of_the_query_reach_forty_kilometres(spark, tmp_path):
    from tidemark.plans.matchup import asset_points, nearest_asset_join, points
    spark.range(40).select(F.col("id").alias("c_custkey"), F.lit(0.0).alias("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(30).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    pairs = [(metres((e.lon, e.lat), (a.alon, a.alat)), e.k, a.asset_id) for e in points(spark, str(tmp_path)).collect() for a in asset_points(spark, str(tmp_path)).collect()]
    got = {(r.event_id, r.asset_id): (r.distance_m, r.rank) for r in nearest_asset_join(spark, str(tmp_path)).collect()}
    assert got.keys() == {(e, a) for m, e, a in pairs if m <= 40_000} and any(12_000 < m <= 40_000 for m, *_ in pairs)
    for event in {e for e, _ in got}:
        assert [got[event, a][1] for _, a in sorted((m, a) for m, e, a in pairs if e == event and m <= 40_000)] == list(range(1, sum(e == event for e, _ in got) + 1))
