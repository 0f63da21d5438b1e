"""Fold-wise fits against fits on the training rows alone: gaps, weights, one-class folds, NULL folds, many features."""

import numpy as np
import pytest

from tidemark.operators import folds, learn

rng = np.random.default_rng(3)
N, D = 240, 13
X = rng.normal(size=(N, D)) * rng.uniform(0.1, 20, D) + rng.normal(size=D) * 50
Y = (X[:, 0] / X[:, 0].std() - X[:, 5] / X[:, 5].std() + rng.normal(size=N) > 0).astype(int)
Q = 10 ** (0.02 * X[:, 1] / X[:, 1].std() + 0.1 * rng.normal(size=N))
W = rng.uniform(0.5, 2, N).round(3)
G = [None if k == 4 else f"a{k}" for k in rng.integers(0, 5, N)]
GAP = rng.random((N, D)) < 0.08
NAMES = [f"f{i}" for i in range(D)]


@pytest.fixture(scope="module")
def df(spark):
    rows = [(G[i], int(Y[i]), float(Q[i]), float(W[i]), *[(None if j % 2 else float("nan")) if GAP[i, j] else float(X[i, j]) for j in range(D)]) for i in range(N)]
    return spark.createDataFrame(rows, "g string, y int, q double, w double, " + ", ".join(f"{c} double" for c in NAMES)).repartition(3).cache()


def scaled(use):
    x = np.where(GAP, np.nan, X)
    med = np.nanmedian(x[use], axis=0)
    x = np.where(np.isnan(x), med, x)
    return med, x[use].mean(0), x[use].std(0)


def test_scalers_outside_each_fold(df):
    p = folds.prepare(df, NAMES, df["y"], None, "g")
    assert p.folds == [None, "a0", "a1", "a2", "a3"]
    for k, s in enumerate(p.scalers):
        use = np.array([True] * N) if k == 5 else np.array([g != p.folds[k] for g in G])
        for got, want in zip((s["median"], s["mean"], s["scale"]), scaled(use), strict=True):
            np.testing.assert_allclose(got, want, rtol=1e-9)


def test_all_folds_reach_their_own_optimum(df):
    p = folds.prepare(df, NAMES, df["y"], "w", "g")
    models = [folds.model(p, arm, k, NAMES[:n]) for arm, n in (("small", 2), ("full", D)) for k in range(6)]
    assert folds.newton(p, models) < 15
    for m in models:
        use = np.array([True] * N) if m.side == 5 else np.array([g != p.folds[m.side] for g in G])
        med, mu, sd = scaled(use)
        x = np.where(GAP, np.nan, X)
        z = np.column_stack([np.ones(use.sum()), ((np.where(np.isnan(x), med, x) - mu) / sd)[use][:, m.columns]])
        y, w = Y[use], W[use]
        w = w * np.where(y == 1, w.sum() / (2 * w[y == 1].sum()), w.sum() / (2 * w[y == 0].sum()))
        slope = z.T @ (w * (1 / (1 + np.exp(-(z @ m.beta))) - y)) + np.r_[0, m.beta[1:]]
        assert np.abs(slope).max() < 1e-7


def test_ridge_without_each_group_equals_a_fit_on_the_rest(df):
    art = learn.fit_ridge_log10(df, NAMES, "q", weight="w", group="g")
    ly, x = np.log10(Q), np.where(GAP, np.nan, X)
    med, mu, sd = scaled(np.ones(N, bool))
    xi = np.where(np.isnan(x), med, x)

    def solve(z, t, w):
        zc, tc = z - np.average(z, axis=0, weights=w), t - np.average(t, weights=w)
        c = np.linalg.solve((zc * w[:, None]).T @ zc + np.eye(D), (zc * w[:, None]).T @ tc)
        return c, np.average(t, weights=w) - np.average(z, axis=0, weights=w) @ c
    c, b = solve((xi - mu) / sd, ly, W)
    np.testing.assert_allclose(art["coef"], c, rtol=1e-7, atol=1e-10)
    np.testing.assert_allclose(art["intercept"], b, rtol=1e-9)
    resid = []
    for g in set(G):
        use = np.array([v != g for v in G])
        _, m2, s2 = scaled(use)
        c, b = solve((xi[use] - m2) / s2, ly[use], np.ones(use.sum()))
        resid += np.abs(ly[~use] - ((xi[~use] - m2) / s2 @ c + b)).tolist()
    assert art["conformal_q90"] == pytest.approx(np.quantile(resid, 0.9))
    with pytest.raises(ValueError):
        learn.fit_ridge_log10(df.selectExpr("f0", "CASE WHEN y = 1 THEN q ELSE -1.0 END AS q"), ["f0"], "q")


def test_one_class_training_rows_are_skipped(spark):
    rows = [("a", 1, 0.5)] * 60 + [("b", 0, 1.5)] * 60 + [("c", k % 2, float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "g string, y int, x double")
    got = learn.cross_validated(df, "g", {"one": ["x"]}, "y").groupBy("g").agg({"p_one": "count"}).collect()
    assert {r[0]: r[1] for r in got} == {"a": 60, "b": 60, "c": 60}
    got = learn.cross_validated(df.where("g <> 'c'"), "g", {"one": ["x"]}, "y").collect()
    assert len(got) == 120 and all(r.p_one is None for r in got)


def nipals(z, t, components):
    zc, tc = z - z.mean(0), t - t.mean()
    x, y, w_, p_, q_ = zc.copy(), tc.copy(), [], [], []
    for _ in range(components):
        w = x.T @ y / np.linalg.norm(x.T @ y)
        s = x @ w
        p, q = x.T @ s / (s @ s), y @ s / (s @ s)
        x, y = x - np.outer(s, p), y - s * q
        w_.append(w)
        p_.append(p)
        q_.append(q)
    w, p = np.array(w_).T, np.array(p_).T
    coef = w @ np.linalg.solve(p.T @ w, np.array(q_))
    return coef, t.mean() - z.mean(0) @ coef


def test_linear_zoo_equals_fits_on_the_rest(df):
    got = {(round(r.q, 12), round(r.w, 6)): r for r in learn.linear_zoo(df, "g", NAMES, "q").collect()}
    assert len(got) == N
    ly, x = np.log10(Q), np.where(GAP, np.nan, X)
    med = np.nanmedian(x, axis=0)
    xi = np.where(np.isnan(x), med, x)
    for g in set(G):
        use = np.array([v != g for v in G])
        mu, sd = xi[use].mean(0), xi[use].std(0)
        z = (xi - mu) / sd
        zc, tc = z[use] - z[use].mean(0), ly[use] - ly[use].mean()
        want = {"ridge_log10": np.linalg.solve(zc.T @ zc + np.eye(D), zc.T @ tc), "linear": np.linalg.solve(zc.T @ zc, zc.T @ tc), "plsr": nipals(z[use], ly[use], 3)[0]}
        for i in np.flatnonzero(~use):
            r = got[round(float(Q[i]), 12), round(float(W[i]), 6)]
            for name, coef in want.items():
                assert r[f"p_{name}"] == pytest.approx(ly[use].mean() + z[i] @ coef, abs=1e-8), name


def test_ensembles_and_intervals(df):
    small = df.select("g", "q", "f0", "f1")
    long = learn.model_zoo(small, "g", ["f0", "f1"], "q", forest={"numTrees": 3}, boosting={"maxIter": 3, "maxDepth": 2})
    rep = {r.model: r for r in learn.zoo_report(long, "g", 50).collect()}
    assert set(rep) == {"linear", "ridge_log10", "plsr", "random_forest", "gradient_boosting"}
    assert all(r.rmse_lo <= r.rmse_hi and r.n_boot == 50 for r in rep.values())
