"""Every held-out fit of a cross-validation at once.

The rows are read a fixed number of times, whatever the number of folds and feature sets.  Scalers come from
sums per fold, taken from the total (all rows minus the held-out fold); a Newton step adds up the gradients
and Hessians of all models in one pass, each task sending one small row per model; ridge fits need no further pass
because the Gram matrices of the folds are taken from the total as well.  Folds are a short list
(areas, or a handful of blocks): the models, never the rows, are held by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.quantiles import exact_quantiles
from tidemark.session import cut_lineage

STEPS, TOLERANCE = 40, 1e-10


def finite(c: Column) -> Column:
    """The value as a double, NULL unless finite."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


@dataclass
class Prepared:
    """Rows as (_f: number of the fold, _y, _w, x0 ..), and what is known of the folds."""

    rows: DataFrame
    folds: list
    features: list[str]
    count: np.ndarray           # folds x 3: rows, weight of class 1, weight of class 0
    classes: np.ndarray         # folds x 2: rows of class 1 and 0
    scalers: list[dict]         # outside each fold; last: of all rows


def prepare(df: DataFrame, features: Sequence[str], y: Column, weight: str | None = None, fold: str | None = None) -> Prepared:
    """Number the folds, cut the lineage and gather medians, means and scales outside each fold.

    Missing and non-finite features take the training rows' median before means and scales (sd below 1e-12 counts
    as one) are formed.  Rows without a label or a weight take no part.
    """
    folds = [] if fold is None else [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    number = F.lit(0)
    for k, value in enumerate(folds):
        number = F.when(F.col(fold).eqNullSafe(F.lit(value)), k).otherwise(number)
    d = len(features)
    rows = cut_lineage(df.select(number.cast("int").alias("_f"), y.cast("double").alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"),
                                 *[finite(F.col(f)).alias(f"x{i}") for i, f in enumerate(features)]).where(F.col("_y").isNotNull() & F.col("_w").isNotNull()))
    middle = rows.agg(*[F.coalesce(F.avg(f"x{i}"), F.lit(0.0)) for i in range(d)]).first() if d else ()
    aggs = [F.count(F.lit(1)), F.sum(F.when(F.col("_y") == 1, F.col("_w")).otherwise(0.0)), F.sum(F.when(F.col("_y") == 0, F.col("_w")).otherwise(0.0)),
            F.count_if(F.col("_y") == 1), F.count_if(F.col("_y") == 0)]
    for i in range(d):
        x = F.col(f"x{i}") - middle[i]
        aggs += [F.count(x), F.coalesce(F.sum(x), F.lit(0.0)), F.coalesce(F.sum(x * x), F.lit(0.0))]
    got = {r[0]: np.array(r[1:], float) for r in rows.groupBy("_f").agg(*aggs).collect()}
    n_folds = max(1, len(folds))
    table = np.array([got.get(k, np.zeros(5 + 3 * d)) for k in range(n_folds)])
    total = table.sum(axis=0)
    sides = [total - table[k] for k in range(len(folds))] + [total]
    # medians: only of features with gaps, outside each fold
    gaps = [i for i in range(d) if total[5 + 3 * i] < total[0]]
    medians = np.zeros((len(sides), d))
    if gaps:
        outside = F.array_append(F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda k: k != F.col("_f")), F.lit(len(folds))) if folds else F.array(F.lit(0))
        long = rows.select(F.explode(outside).alias("side"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("v")) for i in gaps])).alias("p")).select("side", "p.i", "p.v")
        for r in exact_quantiles(long, ["side", "i"], "v", {"m": 0.5}).collect():
            medians[r["side"], r["i"]] = r["m"]
    scalers = []
    for s, side in enumerate(sides):
        n = max(side[0], 1.0)
        have, sums, squares = side[5::3], side[6::3], side[7::3]
        fill = np.where(have < side[0], medians[s] - np.array(middle), 0.0)
        mean = (sums + (side[0] - have) * fill) / n
        var = np.maximum((squares + (side[0] - have) * fill ** 2) / n - mean ** 2, 0.0)
        sd = np.sqrt(var)
        scalers.append({"median": np.where(have < side[0], medians[s], np.array(middle) + mean), "mean": np.array(middle) + mean, "scale": np.where(sd > 1e-12, sd, 1.0)})
    return Prepared(rows, folds, list(features), table[:, :3], table[:, 3:5], scalers)


@dataclass
class Model:
    """One fit: the columns it uses, the side it trains on (a held-out fold, or the last: all rows) and its parameters."""

    arm: str
    side: int
    columns: list[int]
    beta: np.ndarray
    balance: tuple[float, float]


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.column_stack([batch.column(3 + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(d)]) if d else np.zeros((len(batch), 0))


def _scaled(x: np.ndarray, scaler: dict, columns: list[int]) -> np.ndarray:
    part = x[:, columns]
    part = np.where(np.isfinite(part), part, scaler["median"][columns])
    return np.column_stack([np.ones(len(x)), (part - scaler["mean"][columns]) / scaler["scale"][columns]])


def newton(p: Prepared, models: Sequence[Model], c: float = 1.0) -> int:
    """L2 logistic fits (the intercept is free) of all ``models`` together; returns the passes taken."""
    d, all_side = len(p.features), len(p.folds)
    sent = [(m.side, m.columns, m.balance) for m in models]
    scalers = p.scalers

    def sums(betas):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = [np.zeros((len(b), len(b) + 1)) for b in betas]
            for batch in batches:
                fold = batch.column(0).to_numpy(zero_copy_only=False)
                y, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                x = _matrix(batch, d)
                for k, (side, columns, (pos, neg)) in enumerate(sent):
                    use = np.ones(len(x), bool) if side == all_side else fold != side
                    z = _scaled(x[use], scalers[side], columns)
                    weight = w[use] * np.where(y[use] == 1, pos, neg)
                    prob = 0.5 * (1 + np.tanh(0.5 * (z @ betas[k])))
                    acc[k][:, 0] += z.T @ (weight * (prob - y[use]))
                    acc[k][:, 1:] += (z * (weight * prob * (1 - prob))[:, None]).T @ z
            at = [(k, i) for k, a in enumerate(acc) for i in range(a.size)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in at], pa.int32()), pa.array([i for _, i in at], pa.int32()), pa.array(np.concatenate([a.ravel() for a in acc]))], names=["model", "at", "v"])
        return p.rows.mapInArrow(run, "model int, at int, v double").groupBy("model", "at").agg(F.sum("v").alias("v"))

    for step in range(1, STEPS + 1):
        if not models:
            return 0
        grids = [np.zeros(len(m.beta) * (len(m.beta) + 1)) for m in models]
        for r in sums([m.beta.copy() for m in models]).collect():
            grids[r["model"]][r["at"]] = r["v"]
        largest = 0.0
        for m, g in zip(models, grids, strict=True):
            g = g.reshape(len(m.beta), -1) * c
            penalty = np.r_[0.0, np.ones(len(m.beta) - 1)]
            move = np.linalg.solve(g[:, 1:] + np.diag(penalty), g[:, 0] + penalty * m.beta)
            m.beta = m.beta - move
            largest = max(largest, float(np.abs(move).max()))
        if largest < TOLERANCE:
            return step
    return STEPS


def model(p: Prepared, arm: str, side: int, features: Sequence[str]) -> Model | None:
    """A class-balanced logistic model before its fit; None where its training rows lack a class."""
    outside = p.count.sum(axis=0) - (p.count[side] if side < len(p.folds) else 0)
    pos, neg = outside[1], outside[2]
    if pos <= 0 or neg <= 0:
        return None
    return Model(arm, side, [p.features.index(f) for f in features], np.zeros(len(features) + 1), ((pos + neg) / (2 * pos), (pos + neg) / (2 * neg)))


def artifact_of(p: Prepared, m: Model, kind: str = "logistic") -> dict:
    s = p.scalers[m.side]
    return {"kind": kind, "features": [p.features[i] for i in m.columns], "medians": s["median"][m.columns].tolist(), "mean": s["mean"][m.columns].tolist(),
            "scale": s["scale"][m.columns].tolist(), "coef": m.beta[1:].tolist(), "intercept": float(m.beta[0])}


def grams(p: Prepared, weighted: bool) -> list[np.ndarray]:
    """Per fold, and last of all rows: sums of products of (1, x - middle, log-target) in one pass, gaps filled by the overall median."""
    d, overall = len(p.features), p.scalers[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for batch in batches:
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            y, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            x = _matrix(batch, d)
            v = np.column_stack([np.ones(len(x)), np.where(np.isfinite(x), x, overall["median"]) - overall["mean"], y])
            for k in np.unique(fold).tolist():
                part = v[fold == k]
                one = (part * w[fold == k, None]).T @ part if weighted else part.T @ part
                acc[k] = acc.get(k, 0.0) + one
        for k, a in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * a.size, pa.int32()), pa.array(range(a.size), pa.int32()), pa.array(a.ravel())], names=["f", "at", "v"])

    n = max(1, len(p.folds))
    out = np.zeros((n, (d + 2) ** 2))
    for r in p.rows.mapInArrow(run, "f int, at int, v double").groupBy("f", "at").agg(F.sum("v").alias("v")).collect():
        out[r["f"], r["at"]] = r["v"]
    shaped = [a.reshape(d + 2, d + 2) for a in out]
    return [*shaped, sum(shaped)] if p.folds else shaped


def ridge(gram: np.ndarray, overall: dict, scaler: dict, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients (on the scaler's scale) and intercept of a ridge fit from a Gram matrix; the intercept is free."""
    n, d = gram[0, 0], len(gram) - 2
    shift = (scaler["mean"] - overall["mean"])
    sums, cross, target = gram[0, 1:d + 1] - n * shift, gram[1:d + 1, 1:d + 1], gram[1:d + 1, d + 1]
    total_y = gram[0, d + 1]
    cross = cross - np.outer(shift, gram[0, 1:d + 1]) - np.outer(gram[0, 1:d + 1], shift) + n * np.outer(shift, shift)
    target = target - shift * total_y
    s = scaler["scale"]
    zz, zt, z = cross / np.outer(s, s), target / s, sums / s
    centred = zz - np.outer(z, z) / n
    coef = np.linalg.solve(centred + alpha * np.eye(d), zt - z * total_y / n) if alpha else np.linalg.lstsq(centred, zt - z * total_y / n, rcond=None)[0]
    return coef, float(total_y / n - coef @ z / n)


def gram_scaler(gram: np.ndarray, overall: dict) -> dict:
    """Mean and scale of the rows of a Gram matrix, gaps filled by the overall median."""
    n, d = max(gram[0, 0], 1.0), len(gram) - 2
    shift = gram[0, 1:d + 1] / n
    sd = np.sqrt(np.maximum(np.diag(gram)[1:d + 1] / n - shift ** 2, 0.0))
    return {"median": overall["median"], "mean": overall["mean"] + shift, "scale": np.where(sd > 1e-12, sd, 1.0)}


def partial_least_squares(gram: np.ndarray, overall: dict, scaler: dict, components: int) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a one-target partial least squares fit from a Gram matrix.

    Scores are never formed: weights, loadings and their deflation need only the products of the scaled columns.
    """
    n, d = gram[0, 0], len(gram) - 2
    shift, s = scaler["mean"] - overall["mean"], scaler["scale"]
    sums = gram[0, 1:d + 1] - n * shift
    cross = gram[1:d + 1, 1:d + 1] - np.outer(shift, gram[0, 1:d + 1]) - np.outer(gram[0, 1:d + 1], shift) + n * np.outer(shift, shift)
    zz = cross / np.outer(s, s) - np.outer(sums / s, sums / s) / n
    zt = (gram[1:d + 1, d + 1] - shift * gram[0, d + 1]) / s - sums / s * gram[0, d + 1] / n
    weights, loadings, gains = [], [], []
    for _ in range(min(components, d)):
        size = np.linalg.norm(zt)
        if size < 1e-12:
            break
        w = zt / size
        spread = w @ zz @ w
        if spread < 1e-12:
            break
        load, gain = zz @ w / spread, zt @ w / spread
        zz, zt = zz - np.outer(load, load) * spread, zt - load * gain * spread
        weights.append(w)
        loadings.append(load)
        gains.append(gain)
    if not weights:
        return np.zeros(d), float(gram[0, d + 1] / n)
    w, p = np.array(weights).T, np.array(loadings).T
    coef = w @ np.linalg.solve(p.T @ w, np.array(gains))
    return coef, float(gram[0, d + 1] / n - coef @ (sums / s) / n)


def by_fold(fold: str, arts: Mapping, score) -> Column:
    """The score of the model that did not see the row's fold; NULL where there is none."""
    out = F.lit(None).cast("double")
    for value, art in arts.items():
        out = F.when(F.col(fold).eqNullSafe(F.lit(value)), score(art)).otherwise(out)
    return out
