"""Skew-safe primitives against numpy and pandas, with one key that holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.geo import bearing_deg, compass, haversine_m
from tidemark.functions.joins import join_small
from tidemark.functions.nulls import clip, finite, ratio, within
from tidemark.functions.ordering import previous_row, running_sums
from tidemark.functions.quantiles import exact_quantiles, select_ranks


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    k = np.where(rng.random(6000) < 0.8, "hot", rng.choice(["a", "b", "c"], 6000))
    v = np.round(np.where(rng.random(6000) < 0.3, 2.5, rng.normal(0, 50, 6000) ** 3 / 1000), 4)
    pdf = pd.DataFrame({"k": k, "i": np.arange(6000), "v": v})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_exact_quantiles_match_numpy(skewed):
    pdf, df = skewed
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"a": 0.05, "m": 0.5, "z": 0.99}).collect()}
    for k, g in pdf.groupby("k"):
        assert got[k]["n"] == len(g)
        np.testing.assert_allclose([got[k][c] for c in "amz"], np.percentile(g.v, [5, 50, 99]), rtol=1e-12)


def test_exact_quantiles_without_keys_and_with_nulls(skewed):
    pdf, df = skewed
    r = exact_quantiles(df.withColumn("v", F.when(F.col("i") % 3 != 0, F.col("v"))), [], "v", {"m": 0.37}).first()
    np.testing.assert_allclose(r["m"], np.percentile(pdf.v[pdf.i % 3 != 0], 37), rtol=1e-12)


def test_bins_only_decide_balance(skewed):
    _, df = skewed
    a = select_ranks(df, ["k"], "v", {"r": F.floor(F.col("n") / 3)}, resolution=1).collect()
    b = select_ranks(df, ["k"], "v", {"r": F.floor(F.col("n") / 3)}, resolution=100_000).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_previous_row_crosses_chunks(skewed):
    pdf, df = skewed
    out = previous_row(df, ["k"], ["i"], F.floor(F.col("i") / 97), {"v": "pv", "i": "pi"}).toPandas().sort_values("i")
    want = pdf.assign(pv=pdf.groupby("k").v.shift(), pi=pdf.groupby("k").i.shift())
    np.testing.assert_array_equal(out.pv.to_numpy(), want.pv.to_numpy())
    np.testing.assert_array_equal(out.pi.to_numpy(dtype=float), want.pi.to_numpy(dtype=float))


def test_running_sums_cross_chunks(skewed):
    pdf, df = skewed
    out = running_sums(df, ["k"], F.col("i"), F.floor(F.col("i") / 131), {"i": "s"}).toPandas().sort_values("i")
    np.testing.assert_array_equal(out.s.to_numpy(), pdf.groupby("k").i.cumsum().to_numpy())


def test_null_policy(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 2.0), (float("inf"), 2.0), (-3.0, 2.0)], "a double, b double")
    r = df.select(ratio(F.col("a"), F.col("b")).alias("q"), finite(F.col("a")).alias("f"), within(F.col("a"), -1.0, 2.0).alias("w"), clip(finite(F.col("a")), 0, 1).alias("c")).collect()
    assert r[0]["q"] is None and r[1]["f"] is None and r[2]["f"] is None
    assert r[3]["w"] is None and r[3]["c"] == 0.0 and r[1]["c"] is None


def test_geography(spark):
    r = spark.range(1).select(haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"), bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("b"),
                              compass(F.lit(350.0)).alias("n"), compass(F.lit(200.0)).alias("s")).first()
    assert abs(r["d"] - 6371000 * np.pi / 180) < 1e-3 and abs(r["b"] - 90) < 1e-9
    assert (r["n"], r["s"]) == ("N", "SSW")


def test_null_keys_are_groups_of_their_own(spark):
    rows = [(None, 1, 4.0), (None, 2, 6.0), ("a", 1, 1.0), ("a", 2, 3.0), (None, 3, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    assert {r.k: (r.n, r.m) for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()} == {None: (2, 5.0), "a": (2, 2.0)}
    run = running_sums(df, ["k"], F.col("i"), F.floor(F.col("i") / 2), {"v": "s"}).collect()
    assert sorted(((r.k, r.i, r.s) for r in run), key=str) == sorted([(None, 1, 4.0), (None, 2, 10.0), (None, 3, 10.0), ("a", 1, 1.0), ("a", 2, 4.0)], key=str)
    lag = previous_row(df, ["k"], ["i"], F.floor(F.col("i") / 2), {"v": "p"}).collect()
    assert sorted(((r.k, r.i, r.p) for r in lag), key=str) == sorted([(None, 1, None), (None, 2, 4.0), (None, 3, 6.0), ("a", 1, None), ("a", 2, 1.0)], key=str)
    small = spark.createDataFrame([(None, 7), ("a", 8)], "k string, w int")
    for limit in (0, 10):
        assert sorted(((r.k, r.i, r.w) for r in join_small(df, small, ["k"], limit=limit).collect()), key=str) == sorted([(k, i, 8 if k else 7) for k, i, _ in rows], key=str)


def test_asof_bracket_and_sensor_scores_keep_null_keys(spark):
    from tidemark.operators import climatology as cl
    series = spark.createDataFrame([(None, 1, 0.5), (None, 5, 0.7), ("a", 2, 0.1)], "k string, t int, v double")
    targets = spark.createDataFrame([(None, 3), ("a", 1)], "k string, target int")
    got = {r.k: (r.before and r.before.v, r.after and r.after.v) for r in cl.asof_bracket(series, targets, ["k"], "t", ["v"], F.floor(F.col("t") / 2)).collect()}
    assert got == {None: (0.5, 0.7), "a": (None, 0.1)}
    obs = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "k string, x double")
    assert sorted(((r.k, r.x_z) for r in cl.sensor_zscores(obs, ["k"], ["x"]).collect()), key=str) == sorted([(None, -1.0), (None, 1.0), ("a", None)], key=str)
