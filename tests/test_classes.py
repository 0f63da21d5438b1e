"""Distance joins work out events of one place once and expand them last."""

from pyspark.sql import functions as F

from tidemark.operators import exposure as ex
from tidemark.operators import matchup


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def events(spark, n=60, places=3):
    k = F.col("id") % places
    return spark.range(n).select(F.col("id").alias("event_id"), (54 + k * 0.02).alias("lon"), (24 + k * 0.01).alias("lat"))


def assets(spark, n=40):
    return spark.range(n).select(F.col("id").alias("asset_id"), (54 + F.col("id") % 5 * 0.03).alias("alon"), F.lit(24.01).alias("alat"), F.lit(0.8).alias("sensitivity"))


def track(events):
    steps = events.select("*", F.explode(F.array(F.lit(0), F.lit(6))).alias("hours")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(2))))
    drift = 0.001 * (F.col("event_id") % 2)                                # two tracks for each place
    return steps.select("event_id", "hours", (F.col("lon") + F.col("hours") * drift).alias("plon"), (F.col("lat") + 0.002 * F.col("p")).alias("plat"))


def test_tracks_are_never_broadcast(spark):
    e = events(spark)
    out = ex.assess(ex.asset_pairs(e, assets(spark), 12_000.0), track(e), F.lit(2000.0))
    assert "BroadcastHashJoin" not in plan(out) and out.count() > 0


def test_alike_events_share_their_exposure(spark):
    e, t = events(spark), track(events(spark))
    seen = []

    def solve(places):
        seen.append(places.count())
        return ex.assess(ex.asset_pairs(places, assets(spark), 12_000.0), t, F.lit(2000.0))

    cols = ["event_id", "asset_id", "distance_m", "closest_approach_m", "eta_hours", "exposure_score"]
    got = ex.once_for_alike(ex.with_track(e, t), ["lon", "lat", "track"], solve).select(*cols)
    want = ex.assess(ex.asset_pairs(e, assets(spark), 12_000.0), t, F.lit(2000.0)).select(*cols)
    assert seen == [6] and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_pixels_of_one_place_are_summed_before_they_meet_a_footprint(spark):
    fine = events(spark).withColumn("v", F.when(F.col("event_id") % 4 > 0, F.col("event_id").cast("double")))
    coarse = assets(spark).select("asset_id", F.col("alon").alias("lon"), F.col("alat").alias("lat"))
    out = matchup.footprint_match(fine, coarse, ["asset_id"], ["v"], 3000.0, 1)
    assert "Aggregate [lon" in plan(out, "optimizedPlan")
    pairs = coarse.alias("c").crossJoin(fine.alias("f")).where("abs(f.lon - c.lon) <= 3000 / (111320 * cos(radians(c.lat))) and abs(f.lat - c.lat) <= 3000 / 111320")
    want = {r.asset_id: (r.n, r.v) for r in pairs.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("v")).collect()}
    assert {r.asset_id: (r.n_px, r.v) for r in out.collect()} == want and want


def test_nearest_assets_are_ranked_once_for_a_place(spark):
    cols = ["event_id", "asset_id", "distance_m", "rank"]
    e, a = events(spark), assets(spark)
    got = ex.once_for_alike(e, ["lon", "lat"], lambda places: ex.nearest_assets(places, a, 12_000.0)).select(*cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, ex.nearest_assets(e, a, 12_000.0).select(*cols).collect()))


def test_rows_are_spread_by_their_number(spark, monkeypatch):
    from tidemark.functions import blocks
    monkeypatch.setattr(blocks, "TASK_ROWS", 100)
    out = blocks.spread(spark.range(200).select((F.col("id") % 90).alias("k")), ["k"], 20)
    assert out.rdd.getNumPartitions() == 40
    assert out.select("k", F.spark_partition_id().alias("p")).distinct().count() == 90
