"""Rules and edge cases of the operators on hand-made rows."""

import datetime as dt
import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import climatology as cl
from tidemark.operators import ingest as ig
from tidemark.operators import learn as le
from tidemark.operators import matchup as mu
from tidemark.operators import metrics as me
from tidemark.operators import pixels as px
from tidemark.operators import spectra as sp
from tidemark.operators import workflow as wf
from tidemark.sources import assets, sinks


def test_decode_follows_the_products_baseline(spark):
    df = spark.createDataFrame([(0, "05.13"), (1000, "05.13"), (1500, "05.13"), (900, "05.13"), (1500, "02.12"), (1500, None), (1500, "N/A")], "dn int, baseline string")
    got = [(r["reflectance"], r["problem"]) for r in ig.decode_dn(df).collect()]
    assert got == [(None, None), (0.0, None), (0.05, None), (-0.01, None), (0.15, None), (None, "baseline required"), (None, "unparseable baseline")]


def test_cloud_zero_quirk(spark):
    items = spark.createDataFrame([(1, dt.date(2024, 1, 1), 5, "S2A", 0), (2, dt.date(2024, 1, 1), 5, "S2A", 12), (3, dt.date(2024, 1, 1), 5, "S2A", None)], "item_id long, d date, orbit int, platform string, cloud int")
    assert ig.overpasses(items, 30).first()["n_tiles"] == 1
    assert ig.overpasses(items, 30, zero_is_missing=False).first()["n_tiles"] == 2


def test_features_keep_limits(spark):
    df = spark.createDataFrame([(0.02, 0.02, 0.03, 0.03, 0.09, 0.02, 0.02, 0.01, 0.0), (0.02, 0.02, 0.03, 0.12, 0.02, 0.02, 0.02, 0.01, 0.0)],
                               "b01 double, b02 double, b03 double, b04 double, b05 double, b06 double, b8a double, b11 double, b12 double").withColumn("platform", F.lit("Sentinel-2C"))
    a, b = px.water_features(df, ["b01", "b02", "b03", "b04", "b05", "b06", "b8a", "b11", "b12"]).collect()
    assert a["ndci"] == pytest.approx(0.5) and a["mci"] > 0
    assert b["tur_nechad2016"] is None and b["tur_dogliotti2015"] == pytest.approx(3078.9 * 0.02 / (1 - 0.02 / 0.2112))
    assert 0 <= a["hue_angle"] <= 360


def test_robust_anomaly_rules(spark):
    rows = [(1, dt.date(y, 6, day), 10.0 + y % 3) for y in range(2017, 2024) for day in (1, 11)]
    rows += [(1, dt.date(2024, 6, 5), 30.0), (1, dt.date(2024, 12, 24), 5.0)] + [(2, dt.date(y, 6, 1), 1.0) for y in range(2019, 2025)]
    df = spark.createDataFrame(rows, "px int, d date, v double")
    got = {(r["px"], r["d"]): r for r in cl.robust_anomaly(df, ["px"], {"v": 0.5}).collect()}
    hot = got[1, dt.date(2024, 6, 5)]
    hist = np.array([v for p, d, v in rows if p == 1 and d.month == 6 and d.year != 2024])
    med = np.median(hist)
    assert hot["v_n"] == 14 and hot["v_pct"] == 100.0
    assert hot["v_z"] == pytest.approx((30 - med) / (1.4826 * np.median(abs(hist - med)) + 0.5))
    assert got[1, dt.date(2024, 12, 24)]["v_z"] is None
    assert got[2, dt.date(2024, 6, 1)]["v_n"] == 5 and got[2, dt.date(2024, 6, 1)]["v_z"] is None


def test_pairs_match_brute_force(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=int(i)) for i in np.random.default_rng(2).choice(1400, 160, replace=False)]
    df = spark.createDataFrame([(1, x) for x in days], "k int, d date")
    def near(a, b):
        g = abs(a.timetuple().tm_yday - b.timetuple().tm_yday)
        return min(g, 365 - g) <= 45 and a.year != b.year
    for window in (45,):
        assert cl.climatology_pairs(df, ["k"], window_days=window).count() == sum(near(a, b) for a in days for b in days)


def test_thinning_equals_one_ordered_pass(spark):
    rng = np.random.default_rng(5)
    pts = [(g, int(i), float(x), float(y)) for g in ("a", "b") for i, (x, y) in enumerate(rng.random((150, 2)) * 0.06)]
    kept = []
    for g, i, x, y in pts:
        if not any(k[0] == g and abs(k[2] - x) < 0.01 and abs(k[3] - y) < 0.01 for k in kept):
            kept.append((g, i, x, y))
    got = ig.keep_separated(spark.createDataFrame(pts, "g string, i int, x double, y double"), ["g"], "x", "y", "i", 0.01, 0.01)
    assert {(r["g"], r["i"]) for r in got.collect()} == {(g, i) for g, i, _, _ in kept}


def test_matchup_reasons_and_fallback(spark):
    base = dict(record_id=1, scene_id=1, dt_h=1.0, valid_frac=1.0, distance_m=5.0, b_median=0.02, b_std=0.001, b_n=9, cloud=False)
    bad = [dict(base, scene_id=2, dt_h=-30.0), dict(base, scene_id=3, valid_frac=0.2), dict(base, scene_id=4, b_std=0.02), dict(base, scene_id=5, distance_m=99.0), dict(base, scene_id=6, cloud=True), dict(base, scene_id=7, b_median=0.0)]
    e = mu.evaluate(spark.createDataFrame([base, *bad]), "b", 20.0, flags=["cloud"])
    got = {r["scene_id"]: (r["passed"], r["reasons"]) for r in e.collect()}
    assert got[1] == (True, [])
    assert [got[i][1][0].split(" ")[0] for i in range(2, 8)] == ["|dt|", "valid", "box", "centre-pixel", "flag", "primary"]
    recs = spark.createDataFrame([(1, "s"), (2, "s")], "record_id long, station string")
    m = {r["record_id"]: r for r in mu.build_matchups(recs, e, 24.0, []).collect()}
    assert m[1]["passed"] and m[1]["scene_id"] == 1 and not m[2]["passed"] and m[2]["reasons"] == ["no scene within 24 h"]


def test_resample_keeps_a_flat_spectrum_and_refuses_gaps(spark):
    src = spark.createDataFrame([(i, 400.0 + 5 * i) for i in range(100)], "ix int, nm double")
    w = sp.response_weights(src, spark.createDataFrame([(0, 500.0, 10.0), (1, 700.0, 10.0)], "tix int, tnm double, fwhm double"))
    assert {r["tix"]: round(r["s"], 12) for r in w.groupBy("tix").agg(F.sum("weight").alias("s")).collect()} == {0: 1.0, 1: 1.0}
    s = src.select(F.lit(1).alias("v"), "ix", F.when(~F.col("nm").between(690, 710), 0.042).alias("refl"))
    got = {r["tix"]: r["refl"] for r in sp.resample(s, ["v"], w).collect()}
    assert got[0] == pytest.approx(0.042) and got[1] is None


def test_robust_background_and_rx_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(400, 3)) @ np.array([[1, .2, 0], [0, 1, .3], [0, 0, 1]]), rng.normal(6, 1, size=(20, 3))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    keep, mu_, cov = np.ones(len(x), bool), x.mean(0), np.cov(x, rowvar=False)
    for _ in range(3):
        d = np.einsum("ij,jk,ik->i", x - mu_, np.linalg.pinv(cov), x - mu_)
        keep = d <= np.percentile(d[keep], 95)
        mu_, cov = x[keep].mean(0), np.cov(x[keep], rowvar=False)
    bg = sp.robust_background(df, [], ["a", "b", "c"])
    r = bg.first()
    assert r["n_background"] == keep.sum()
    np.testing.assert_allclose(r["mu"], mu_, rtol=1e-9)
    np.testing.assert_allclose(np.reshape(r["inv"], (3, 3)), np.linalg.pinv(cov), rtol=1e-7)
    scores = sp.rx_scores(df, bg, [], ["a", "b", "c"]).orderBy("i").toPandas().rx
    np.testing.assert_allclose(scores, np.einsum("ij,jk,ik->i", x - mu_, np.linalg.pinv(cov), x - mu_), rtol=1e-7)
    model, _ = sp.pca(df, ["a", "b", "c"], 2)
    ev = np.sort(np.linalg.eigvalsh(np.cov(x, rowvar=False)))[::-1]
    np.testing.assert_allclose(model.explainedVariance.toArray(), (ev / ev.sum())[:2], rtol=1e-9)


def test_logistic_is_at_its_optimum_and_ridge_in_closed_form(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = (x[:, 0] + 0.2 * x[:, 1] + rng.normal(size=120) > 0.7).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t), float(10 ** (0.3 * r[0] + 0.1 * r[2])), i % 4) for i, (r, t) in enumerate(zip(x, y))], "a double, b double, c double, y int, q double, g int")
    f = ["a", "b", "c"]
    art = le.fit_logistic(df, f, "y")
    z = (x - x.mean(0)) / x.std(0)
    w = np.where(y == 1, 120 / (2 * y.sum()), 120 / (2 * (120 - y.sum())))
    p = 1 / (1 + np.exp(-(z @ np.array(art["coef"]) + art["intercept"])))
    assert abs(np.r_[z.T @ (w * (p - y)) + np.array(art["coef"]), (w * (p - y)).sum()]).max() < 1e-3
    assert all(r["passed"] for r in le.behaviour_tests(df, art).collect())
    ridge = le.fit_ridge_log10(df, f, "q", group="g")
    ly = np.log10(10 ** (0.3 * x[:, 0] + 0.1 * x[:, 2]))
    np.testing.assert_allclose(ridge["coef"], np.linalg.solve(z.T @ z + np.eye(3), z.T @ (ly - ly.mean())), rtol=1e-6)
    assert ridge["conformal_q90"] >= 0
    with pytest.raises(ValueError):
        le.fit_logistic(df.where("y = 1"), f, "y")


def test_ranking_handles_ties_and_single_class(spark):
    rows = [("x", 1, 0.9), ("x", 0, 0.9), ("x", 1, 0.4), ("x", 0, 0.1), ("x", 1, 1.0), ("one", 1, 0.3)]
    got = {r["k"]: r for r in me.ranking(spark.createDataFrame(rows, "k string, y int, p double"), ["k"], "y", "p").collect()}
    pos, neg = [0.9, 0.4, 1.0], [0.9, 0.1]
    assert got["x"]["auroc"] == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))
    assert got["x"]["auprc"] == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 4)
    assert got["one"]["auroc"] is None


def test_hash_mod_is_the_big_number_modulo(spark):
    words = ["", "a|2024-01", "ß", "group 7"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for n in (2, 5, 7, 10):
        got = [r[0] for r in df.select(le.hash_mod(F.col("w"), n)).collect()]
        assert got == [int(hashlib.sha256(w.encode()).hexdigest(), 16) % n for w in words]


def test_chain_detects_a_tampered_row(spark):
    prev, rows = wf.GENESIS, []
    for i in range(1, 41):
        h = hashlib.sha256((prev + f"e{i}").encode()).hexdigest()
        rows.append((1, i, f"e{i}", prev, h))
        prev = h
    bad = [(2, *r[1:]) if r[1] != 23 else (2, 23, "changed", *r[3:]) for r in rows]
    got = {r["k"]: r for r in wf.verify_chain(spark.createDataFrame(rows + bad, "k int, seq int, c string, prev string, hash string"), ["k"], "seq", "c", "prev", "hash", F.floor(F.col("seq") / 8)).collect()}
    assert got[1]["ok"] and got[1]["head"] == prev and got[1]["n"] == 40
    assert not got[2]["ok"] and got[2]["first_bad_seq"] == 23


def test_priority_veto_and_asymmetry(spark):
    df = spark.createDataFrame([(0.8, 0.6, 0.45, None, 97.0), (0.8, 0.6, 0.45, None, 40.0), (0.52, 0.3, 0.0, None, None), (0.1, 0.9, 0.1, None, None), (0.2, 0.9, 0.45, 12.0, 99.0)], "s double, c double, e double, eta double, h double")
    got = [(r["priority"], r["vetoed"]) for r in wf.priority(df, "s", "c", "e", "eta", "h").collect()]
    assert got == [("HIGH_PRIORITY", False), ("NORMAL", True), ("INVESTIGATE", False), ("NORMAL", False), ("HIGH_PRIORITY", False)]


def test_assets_and_sinks_round_trip(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [55.1, 25.2]}, "properties": {"id": "a", "name": "A", "type": "port"}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [55.3, 25.4]}, "properties": {"id": "b", "name": "B", "type": "marina", "sensitivity": 0.3}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [1.0, 2.0]}, "properties": {"id": "c"}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    got = {r["id"]: (r["type"], r["sensitivity"], r["lon"]) for r in assets.from_geojson(spark, str(tmp_path / "a.geojson")).collect()}
    assert got == {"a": ("PORT", 0.5, 55.1), "b": ("CUSTOM", 0.3, 55.3)}
    (tmp_path / "a.csv").write_text("ID,Longitude,y,type\nq,55,25,aquaculture\nr,,25,port\n")
    rows = assets.from_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["id"], r["lon"], r["sensitivity"]) for r in rows] == [("q", 55.0, 0.95)]
    df = assets.from_csv(spark, str(tmp_path / "a.csv")).select("id", "lon", "lat")
    sinks.write_geojson(df, str(tmp_path / "g"), "lon", "lat")
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_table(df, str(tmp_path / "t"))
    sinks.write_markdown(df, str(tmp_path / "m"))
    (f,) = json.loads((tmp_path / "g" / "features.geojson").read_text())["features"]
    assert f["geometry"] == {"type": "Point", "coordinates": [55.0, 25.0]} and f["properties"] == {"id": "q"}
    assert spark.read.csv(str(tmp_path / "c"), header=True).first()["id"] == "q"
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    assert "| q | 55.0 | 25.0 |" in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "m")).collect())


def test_chi2_tail(spark):
    r = spark.range(1).select(sp.chi2_tail(F.lit(15.0), 12).alias("p")).first()["p"]
    assert r == pytest.approx(math.exp(-7.5) * sum(7.5 ** i / math.factorial(i) for i in range(6)))
