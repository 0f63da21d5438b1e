"""Splits, scaling, portable linear models and cross-validation on Spark ML."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import join_nulls, join_small
from tidemark.functions.nulls import clip
from tidemark.functions.ordering import running_sums
from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators import folds as folds_
from tidemark.operators import metrics
from tidemark.session import cut_lineage

# --- Fixed values: triage features --------------------------------------------------------------
TRIAGE_FEATURES = ["seasonal_pct_primary", "robust_z_primary", "rx_pct", "log10_area_km2", "persistence_frac", "dist_shore_km", "ndci_delta",
                   "mci_delta", "tur_delta", "fai_mean", "hue_delta_deg", "cloud_adjacent_frac", "valid_frac_aoi"]


# ---------------------------------------------------------------- splits
def hash_mod(c: Column, n: int) -> Column:
    """sha256 of a text as one big number, modulo n: eight 32-bit digits folded in long arithmetic."""
    h = F.sha2(c, 256)
    base = pow(16, 8, n)
    acc = F.lit(0).cast("long")
    for i in range(8):
        acc = (acc * base + F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")) % n
    return acc


def group_split(group: Column, n_folds: int = 5, validation_fold: int = 0) -> Column:
    """The same group always lands on the same side."""
    return F.when(hash_mod(F.coalesce(group, F.lit("")), n_folds) == validation_fold, "validation").otherwise("train")


def stratified_groups(labels: DataFrame, group: str, y: str, fraction: float = 0.2) -> DataFrame:
    """Whole groups, in hash order, until about ``fraction`` of each class is held out.

    The choice depends on everything chosen before it, so it is a fold; it runs over one
    small record per group (area and month), never over the labels.
    """
    g = labels.groupBy(group).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) != 1).alias("n"))
    packed = g.agg(F.array_sort(F.collect_list(F.struct(F.sha2(F.col(group).cast("string"), 256).alias("h"), F.col(group).alias("g"), "p", "n"))).alias("_g"), F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    tp, tn = fraction * F.col("_p"), fraction * F.col("_n")
    start = F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("chosen"))

    def step(s, x):
        short_p, short_n = s["p"] < tp, s["n"] < tn
        helps = (short_p & (x["p"] > 0)) | (short_n & (x["n"] > 0))
        fits = (s["p"] + x["p"] <= 1.5 * tp + 1) & (s["n"] + x["n"] <= 1.5 * tn + 1)
        take = (short_p | short_n) & helps & fits
        taken = F.struct((s["p"] + x["p"]).alias("p"), (s["n"] + x["n"]).alias("n"), F.concat(s["chosen"], F.array(x["g"].cast("string"))).alias("chosen"))
        return F.when(take, taken).otherwise(s)

    return packed.select(F.explode(F.aggregate("_g", start, step)["chosen"]).alias(group))


def spatial_blocks(df: DataFrame, lon: str, lat: str, block_km: float) -> DataFrame:
    """Block number of each point from kilometre offsets to the south-west corner."""
    o = df.agg(F.min(lon).alias("_x0"), F.min(lat).alias("_y0"), F.avg(lat).alias("_lat0"))
    j = df.crossJoin(F.broadcast(o))                                             # one row of origins
    bx = F.floor((F.col(lon) - F.col("_x0")) * 111.320 * F.cos(F.radians("_lat0")) / block_km)
    by = F.floor((F.col(lat) - F.col("_y0")) * 110.574 / block_km)
    return j.withColumn("block", bx * 10_000 + by).drop("_x0", "_y0", "_lat0")


def pixel_blocks(row: Column, col: Column, size: int = 40) -> Column:
    return F.floor(row / size) * 10_000 + F.floor(col / size)


def blocked_folds(df: DataFrame, block: str, n_folds: int) -> DataFrame:
    """Whole blocks to folds in hash order; the order number is a chunked running count."""
    h = F.sha2(F.col(block).cast("string"), 256)
    blocks = df.select(block).distinct().withColumns({"_h": h, "_one": F.lit(1)})
    numbered = running_sums(blocks, [], F.struct("_h", block), F.substring("_h", 1, 2), {"_one": "_i"})
    return df.join(numbered.select(block, ((F.col("_i") - 1) % n_folds).cast("int").alias("fold")), block)


def class_cap(df: DataFrame, cls: str, key: str, n: int) -> DataFrame:
    """At most n rows per class in hash order: a sampling operator, ranked as a partial top-k."""
    w = Window.partitionBy(cls).orderBy(F.sha2(F.col(key).cast("string"), 256), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def dataset_hash(labels: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Order-free fingerprint of a label set.

    Row hashes are summed in four 60-bit lanes (a combinable aggregate), then the sums and
    the count are hashed once; no set is ever concatenated.
    """
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("null")) for f in fields]), 256)
    lanes = [F.sum(F.conv(F.substring(F.col("_h"), 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"_l{i}") for i in range(4)]
    g = labels.withColumn("_h", h).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *lanes)
    text = F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"_l{i}").cast("string") for i in range(4)])
    return g.select(*keys, "n", F.substring(F.sha2(text, 256), 1, 16).alias("dataset_hash"))


# ---------------------------------------------------------------- scaling and portable models
def scaler(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Median, mean and population sd per feature after median imputation (sd below 1e-12 counts as one)."""
    long = _long(df, features)
    med = exact_quantiles(long, ["feature"], "v", {"median": 0.5}).select("feature", F.coalesce("median", F.lit(0.0)).alias("median"))
    filled = join_small(long, med, ["feature"]).withColumn("v", F.coalesce("v", "median"))
    return filled.groupBy("feature", "median").agg(F.avg("v").alias("mean"), F.when(F.stddev_pop("v") > 1e-12, F.stddev_pop("v")).otherwise(1.0).alias("scale"))


def _long(df: DataFrame, features: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), folds_.finite(F.col(f)).alias("v")) for f in features])
    return df.select(F.explode(pairs).alias("_x")).select("_x.*")


def scaler_params(df: DataFrame, features: Sequence[str]) -> dict[str, dict[str, float]]:
    """The scaler as numbers (three per feature)."""
    return {r["feature"]: {"median": r["median"], "mean": r["mean"], "scale": r["scale"]} for r in scaler(df, features).collect()}


def standardised(params: Mapping[str, Mapping[str, float]], features: Sequence[str]) -> list[Column]:
    return [(F.coalesce(folds_.finite(F.col(f)), F.lit(params[f]["median"])) - params[f]["mean"]) / params[f]["scale"] for f in features]


def _vector(df: DataFrame, params, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn("_z", array_to_vector(F.array(*standardised(params, features))))


def fit_logistic(df: DataFrame, features: Sequence[str], y: str, weight: str | None = None, c: float = 1.0) -> dict:
    """Class-balanced L2 logistic regression as a portable artifact: Newton steps, one pass over the rows each."""
    p = folds_.prepare(df, features, F.col(y), weight)
    m = folds_.model(p, "all", 0, features)
    if m is None:
        raise ValueError("need both classes to train a triage model")
    folds_.newton(p, [m], c)
    return folds_.artifact_of(p, m)


def fit_ridge_log10(df: DataFrame, features: Sequence[str], y: str, weight: str | None = None, alpha: float = 1.0, group: str | None = None) -> dict:
    """Ridge on log10(y); with three groups or more, the 90th percentile of leave-group-out residuals.

    All held-out fits come from one pass: the Gram matrix of a group is taken from the total.  Held-out fits
    are unweighted and scale by their own training rows; gaps take the overall median.
    """
    if df.where(F.coalesce(~(folds_.finite(F.col(y)) > 0), F.lit(True))).limit(1).count():
        raise ValueError("regression targets must be positive and finite")
    p = folds_.prepare(df, features, F.log10(y), weight, group)
    overall = p.scalers[-1]
    full = folds_.grams(p, True)[-1]
    coef, intercept = folds_.ridge(full, overall, overall, alpha)
    art = artifact("ridge_log10", features, {f: {k: float(overall[k][i]) for k in ("median", "mean", "scale")} for i, f in enumerate(features)}, coef.tolist(), intercept)
    base = df.withColumn("_ly", F.log10(y))
    art["resid_sd"] = base.agg(F.stddev_samp(F.col("_ly") - decision(art))).first()[0]
    if group:
        art["conformal_q90"] = None
        if len(p.folds) >= 3:
            grams = folds_.grams(p, False)
            arts = {}
            for k, value in enumerate(p.folds):
                if p.count[:, 0].sum() - p.count[k, 0] >= 3:
                    own = p.scalers[k]
                    w, b = folds_.ridge(grams[-1] - grams[k], overall, own, alpha)
                    arts[value] = artifact("ridge_log10", features, {f: {"median": float(overall["median"][i]), "mean": float(own["mean"][i]), "scale": float(own["scale"][i])} for i, f in enumerate(features)}, w.tolist(), b)
            resid = base.select(F.abs(F.col("_ly") - folds_.by_fold(group, arts, decision)).alias("_r"))
            art["conformal_q90"] = metrics.residual_quantile(resid, "_r").first()["q"] if arts else None
    return art


def artifact(kind: str, features: Sequence[str], params, coef: Sequence[float], intercept: float) -> dict:
    return {"kind": kind, "features": list(features), "medians": [params[f]["median"] for f in features], "mean": [params[f]["mean"] for f in features],
            "scale": [params[f]["scale"] for f in features], "coef": list(coef), "intercept": intercept}


def decision(art: Mapping) -> Column:
    """Impute (missing and non-finite values), scale and dot product as one expression of literals."""
    s = F.lit(float(art["intercept"]))
    for f, med, mu, sd, c in zip(art["features"], art["medians"], art["mean"], art["scale"], art["coef"]):
        s = s + (F.coalesce(folds_.finite(F.col(f)), F.lit(float(med))) - float(mu)) / float(sd) * float(c)
    return s


def score(art: Mapping) -> Column:
    s = decision(art)
    return 1.0 / (1.0 + F.exp(-s)) if art["kind"] == "logistic" else F.pow(F.lit(10.0), s)


def interval(art: Mapping, q: float | None = None) -> tuple[Column, Column]:
    """90 % prediction interval of a ridge artifact."""
    half = q if q is not None else (art.get("conformal_q90") or 1.645 * (art.get("resid_sd") or 0.0))
    s = decision(art)
    return F.pow(F.lit(10.0), s - half), F.pow(F.lit(10.0), s + half)


def rules_score(pct: Column, persistence: Column, cloud: Column) -> Column:
    """Score of the rule-based triage."""
    s = clip((F.coalesce(pct, F.lit(50.0)) - 80.0) / 20.0, 0, 1)
    s = s * (1 - clip(F.coalesce(persistence, F.lit(0.0)), 0, 1)) * (1 - 0.6 * clip(F.coalesce(cloud, F.lit(0.0)), 0, 1))
    return clip(0.05 + 0.9 * s, 0, 1)


def behaviour_tests(df: DataFrame, art: Mapping) -> DataFrame:
    """Finite, in range, repeatable, unchanged by a JSON round trip, imputed, schema length: one pass.

    Repeatable means that a second execution over the rows gives the same bits: their hashes are summed in a job of its own.
    """
    again = json.loads(json.dumps(art))
    p1, rt = score(art), score(again)
    prints = F.coalesce(F.sum(F.xxhash64(p1, *[F.col(f) for f in art["features"]]).cast("decimal(20,0)")), F.lit(0)).cast("string")
    first = df.agg(prints).first()[0]
    blank = score({**art, "features": [f"_none_{i}" for i in range(len(art["features"]))]})
    rows = df.withColumns({f"_none_{i}": F.lit(None).cast("double") for i in range(len(art["features"]))})
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))                        # noqa: E731
    ranged = (p1 >= 0) & (p1 <= 1) if art["kind"] == "logistic" else p1 > 0
    checks = {"predictions_finite": finite(p1), "predictions_in_range": ranged, "deterministic": F.lit(True), "artifact_roundtrip_identical": F.abs(rt - p1) <= 1e-12,
              "missing_features_imputed_not_nan": finite(blank), "feature_schema_declared": F.lit(len(art["features"]) == len(art["coef"]))}
    agg = rows.agg(*[F.coalesce(F.bool_and(c), F.lit(False)).alias(n) for n, c in checks.items()], prints.alias("_print"))
    agg = agg.withColumn("deterministic", F.col("deterministic") & (F.col("_print") == first))
    return agg.select(F.explode(F.array(*[F.struct(F.lit(n).alias("test"), F.col(n).alias("passed")) for n in checks])).alias("_t")).select("_t.*")


def next_version(models: DataFrame, task: str, version: str, bump: str = "minor") -> DataFrame:
    """Semantic bump of the largest version per task."""
    parts = F.transform(F.split(version, r"\."), lambda s: s.cast("int"))
    top = models.groupBy(task).agg(F.max(F.struct(F.get(parts, 0).alias("a"), F.get(parts, 1).alias("b"), F.get(parts, 2).alias("c"))).alias("_v"))
    a, b, c = F.col("_v.a"), F.col("_v.b"), F.col("_v.c")
    new = {"major": (a + 1, F.lit(0), F.lit(0)), "minor": (a, b + 1, F.lit(0)), "patch": (a, b, c + 1)}[bump]
    return top.select(task, F.concat_ws(".", *[x.cast("string") for x in (a, b, c)]).alias("current"), F.concat_ws(".", *[x.cast("string") for x in new]).alias("next_version"))


# ---------------------------------------------------------------- cross-validation
#: A fold is scored if this many rows train its model and this many are held out.
MIN_TRAIN, MIN_TEST = 50, 10


def leave_one_group_out(df: DataFrame, group: str, features: Sequence[str], y: str, weight: str | None = None, rule: Column | None = None) -> DataFrame:
    """Metrics of a model trained without each area, on that area, beside those of the rule.

    All areas are fitted together (``operators/folds.py``).  Areas whose training or held-out rows lack a class are
    reported with their counts, a status and no metrics.  ``rule_*`` columns exist where ``rule`` is given.
    """
    df = cut_lineage(df)
    p = folds_.prepare(df, features, F.col(y), weight, group)
    sizes, total = p.classes, p.classes.sum(axis=0)
    models = {k: folds_.model(p, "all", k, features) for k in range(len(p.folds)) if (sizes[k] > 0).all() and (total - sizes[k] > 0).all()}
    models = {k: m for k, m in models.items() if m is not None}
    folds_.newton(p, list(models.values()))
    scored = df.withColumn("_p", folds_.by_fold(group, {p.folds[k]: folds_.artifact_of(p, m) for k, m in models.items()}, score))
    rows = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_test"), F.count_if(F.col(y) == 1).alias("test_positive"))
    every = rows.agg(F.sum("n_test").alias("_all"))
    out = rows.crossJoin(F.broadcast(every)).withColumn("n_train", F.col("_all") - F.col("n_test")).drop("_all")       # one row of totals
    report = metrics.classification(scored.where(F.col("_p").isNotNull()), [group], y, "_p")
    out = join_nulls(out, report, [group], "left")
    if rule is not None:
        base = metrics.classification(df.withColumn("_p", rule).join(report.select(group), group, "left_semi"), [group], y, "_p")
        out = join_nulls(out, base.select(group, *[F.col(c).alias(f"rule_{c}") for c in base.columns if c != group]), [group], "left")
    return out.withColumn("status", F.when(F.col("n").isNull(), "needs both classes in train and test")).withColumnRenamed(group, "held_out")


def cross_validated(df: DataFrame, fold: str, sets: Mapping[str, Sequence[str]], y: str, min_train: int = MIN_TRAIN, min_test: int = MIN_TEST) -> DataFrame:
    """Out-of-fold logistic probabilities ``p_<arm>`` of several feature sets, all fitted together.

    Folds with too few rows, or whose training rows lack a class, are skipped: their probabilities are NULL.
    """
    df = cut_lineage(df)
    features = list(dict.fromkeys(f for feats in sets.values() for f in feats))
    p = folds_.prepare(df, features, F.col(y), None, fold)
    total = p.count[:, 0].sum()
    use = [k for k in range(len(p.folds)) if p.count[k, 0] >= min_test and total - p.count[k, 0] >= min_train]
    models = [m for name, feats in sets.items() for k in use if (m := folds_.model(p, name, k, feats)) is not None]
    folds_.newton(p, models)
    return df.withColumns({f"p_{name}": folds_.by_fold(fold, {p.folds[m.side]: folds_.artifact_of(p, m) for m in models if m.arm == name}, score) for name in sets})


def compare_feature_sets(df: DataFrame, folds: Mapping[str, str], sets: Mapping[str, Sequence[str]], y: str) -> DataFrame:
    """The same rows under several feature sets and fold schemes: one report row per pair."""
    out = None
    for scheme, fold in folds.items():
        p = cross_validated(df, fold, sets, y)
        long = p.select(F.col(y), *[F.col(f"p_{a}").alias(a) for a in sets]).unpivot([y], list(sets), "arm", "_p").where(F.col("_p").isNotNull())
        one = metrics.classification(long, ["arm"], y, "_p").withColumn("scheme", F.lit(scheme))
        out = one if out is None else out.unionByName(one)
    size = F.create_map(*[x for a, f in sets.items() for x in (F.lit(a), F.lit(len(f)))])
    return out.withColumn("n_features", size[F.col("arm")])


LIFTED = ("f1", "auroc", "precision", "recall", "auprc")


def lift_table(oof: DataFrame, base: str, arms: Sequence[str], y: str, group: str, n_boot: int = 1000) -> DataFrame:
    """Gain of each arm over the base arm on the rows both could score.

    Absolute and relative gain of every metric in long form, and for F1 the paired 95 % interval, drawn over whole groups.
    ``oof`` carries ``p_<arm>``.
    """
    out = None
    for arm in arms:
        both = oof.where(F.col(f"p_{base}").isNotNull() & F.col(f"p_{arm}").isNotNull())
        long = both.select(y, F.col(f"p_{base}").alias("base"), F.col(f"p_{arm}").alias("arm")).unpivot([y], ["base", "arm"], "side", "_p")
        rep = metrics.classification(long, ["side"], y, "_p")
        of = lambda s, m: F.max(F.when(F.col("side") == s, F.col(m)))                                           # noqa: E731
        gains = rep.agg(F.array(*[F.struct(F.lit(m).alias("metric"), of("base", m).alias("baseline"), of("arm", m).alias("value")) for m in LIFTED]).alias("g"))
        gains = gains.select(F.explode("g").alias("g")).select("g.*")
        pos = F.col(y) == 1
        sums = {f"{k}_{s}": F.when(cond, 1).otherwise(0) for s, col in (("a", f"p_{base}"), ("b", f"p_{arm}"))
                for k, cond in (("tp", (F.col(col) >= 0.5) & pos), ("wrong", (F.col(col) >= 0.5) != pos))}
        f1 = lambda s: F.when(2 * F.col(f"tp_{s}") + F.col(f"wrong_{s}") > 0, 2.0 * F.col(f"tp_{s}") / (2 * F.col(f"tp_{s}") + F.col(f"wrong_{s}"))).otherwise(0.0)
        ci = metrics.grouped_bootstrap(both, group, sums, f1("a"), f1("b"), n_boot).select(F.lit("f1").alias("metric"), "ci_low", "ci_high", (F.col("ci_low") > 0).alias("significant"), F.col("share_positive").alias("p_gain_positive"))
        one = gains.join(ci, "metric", "left").select(F.lit(arm).alias("arm"), "metric", "baseline", "value", (F.col("value") - F.col("baseline")).alias("absolute_gain"),
                                                      F.when(F.col("baseline") != 0, 100 * (F.col("value") - F.col("baseline")) / F.col("baseline")).alias("relative_gain_pct"), "ci_low", "ci_high", "significant", "p_gain_positive")
        out = one if out is None else out.unionByName(one)
    return out


#: Trees, depth and step of the ensembles; components of partial least squares.
FOREST = {"numTrees": 300, "minInstancesPerNode": 3}
BOOSTING = {"maxIter": 200, "maxDepth": 2, "stepSize": 0.05, "subsamplingRate": 0.8}
COMPONENTS = 3


def linear_zoo(df: DataFrame, fold: str, features: Sequence[str], y: str) -> DataFrame:
    """Out-of-fold predictions of log10(y) by the linear regressors, all held-out fits from one pass.

    Columns ``p_linear``, ``p_ridge_log10`` (alpha 1) and ``p_plsr`` beside ``_ly``; gaps take the overall median and
    each fit scales by its own training rows.  Rows with y not above 0 go.
    """
    base = cut_lineage(df.where(folds_.finite(F.col(y)) > 0).withColumn("_ly", F.log10(y)))
    p = folds_.prepare(base, features, F.col("_ly"), None, fold)
    grams, overall = folds_.grams(p, False), p.scalers[-1]
    fits = {"linear": lambda g, s: folds_.ridge(g, overall, s, 0.0), "ridge_log10": lambda g, s: folds_.ridge(g, overall, s, 1.0),
            "plsr": lambda g, s: folds_.partial_least_squares(g, overall, s, max(1, min(COMPONENTS, len(features))))}
    arts: dict[str, dict] = {name: {} for name in fits}
    for k, value in enumerate(p.folds):
        rest = grams[-1] - grams[k]
        if rest[0, 0] < 1:
            continue
        own = folds_.gram_scaler(rest, overall)
        params = {f: {c: float(own[c][i]) for c in ("median", "mean", "scale")} for i, f in enumerate(features)}
        for name, fit in fits.items():
            coef, intercept = fit(rest, own)
            arts[name][value] = artifact(name, features, params, coef.tolist(), intercept)
    return base.withColumns({f"p_{name}": folds_.by_fold(fold, a, decision) for name, a in arts.items()})


def model_zoo(df: DataFrame, fold: str, features: Sequence[str], y: str, seed: int = 7, forest: Mapping = FOREST, boosting: Mapping = BOOSTING) -> DataFrame:
    """Grouped cross-validation of five regressors on log10(y): out-of-fold predictions in long form.

    The linear ones come from Gram matrices; the folds of the two ensembles are fitted side by side.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
    wide = cut_lineage(linear_zoo(df, fold, features, y))
    names = ["linear", "ridge_log10", "plsr"]
    out = wide.select(*df.columns, "_ly", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"p_{n}").alias("_pred")) for n in names])).alias("_m")).select(*df.columns, "_ly", "_m._pred", "_m.model")
    z = cut_lineage(_vector(wide.select(*df.columns, "_ly"), scaler_params(wide, features), features))
    makers = {"random_forest": lambda: RandomForestRegressor(featuresCol="_z", labelCol="_ly", seed=seed, **forest), "gradient_boosting": lambda: GBTRegressor(featuresCol="_z", labelCol="_ly", seed=seed, **boosting)}
    jobs = [(name, f) for name in makers for f in [r[0] for r in z.select(fold).distinct().orderBy(fold).collect()]]
    with ThreadPoolExecutor(8) as pool:
        fitted = list(pool.map(lambda j: makers[j[0]]().fit(z.where(~F.col(fold).eqNullSafe(F.lit(j[1])))), jobs))
    for (name, f), m in zip(jobs, fitted, strict=True):
        part = m.transform(z.where(F.col(fold).eqNullSafe(F.lit(f)))).select(*df.columns, "_ly", F.col("prediction").alias("_pred"), F.lit(name).alias("model"))
        out = out.unionByName(part)
    return out


def zoo_report(predictions: DataFrame, group: str, n_boot: int = 1000) -> DataFrame:
    """rmse, mae, bias and r2 in log10 per model with 95 % intervals drawn over whole groups."""
    r, t = F.col("_pred") - F.col("_ly"), F.col("_ly")
    sums = {"n": F.lit(1), "rr": r * r, "ra": F.abs(r), "rs": r, "t": t, "tt": t * t}
    spread = F.col("tt") - F.col("t") * F.col("t") / F.col("n")
    stats = {"rmse": F.sqrt(F.col("rr") / F.col("n")), "mae": F.col("ra") / F.col("n"), "bias": F.col("rs") / F.col("n"), "r2": F.when(spread > 1e-12, 1 - F.col("rr") / spread)}
    return metrics.bootstrap_intervals(predictions.where(F.col("_pred").isNotNull()), ["model"], group, sums, stats, n_boot)
