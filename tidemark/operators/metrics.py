"""Model evaluation: classification, ranking, calibration, regression, bootstrap and gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.nulls import ratio
from tidemark.functions.joins import join_nulls
from tidemark.functions.ordering import running_sums
from tidemark.functions.quantiles import BINS_PER_E, _bin, exact_quantiles
from tidemark.session import cut_lineage

# --- Fixed values: gates -----------------------------------------------------------------------
MAX_ECE, SUBGROUP_MIN, SUBGROUP_TOLERANCE = 0.15, 5, 0.05
MIN_MATCHUPS, MIN_GROUPS, MIN_R2 = 20, 5, 0.4
COMPLEXITY = ["linear", "ridge_log10", "plsr", "svr", "random_forest", "gradient_boosting"]
EDGES = [i * 0.1 for i in range(1, 10)]
CLIP = 1e-9


def _d(c: Column) -> Column:
    return c.cast("double")


def confusion(df: DataFrame, keys: Sequence[str], y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Counts, precision, recall, F1, Brier score and log loss in one combined aggregate."""
    yes, pos = F.col(p) >= threshold, F.col(y) == 1
    clipped = F.least(F.greatest(F.col(p), F.lit(CLIP)), F.lit(1 - CLIP))
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(pos).alias("positives"), F.count_if(yes & pos).alias("tp"), F.count_if(yes & ~pos).alias("fp"),
        F.count_if(~yes & pos).alias("fn"), F.count_if(~yes & ~pos).alias("tn"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"),
        F.avg(-(F.col(y) * F.log(clipped) + (1 - F.col(y)) * F.log(1 - clipped))).alias("log_loss"))
    prec, rec = ratio(_d(F.col("tp")), _d(F.col("tp") + F.col("fp"))), ratio(_d(F.col("tp")), _d(F.col("tp") + F.col("fn")))
    return g.withColumns({"precision": prec, "recall": rec, "f1": ratio(2 * prec * rec, prec + rec)})


def ranking(df: DataFrame, keys: Sequence[str], y: str, p: str, weight: str | None = None) -> DataFrame:
    """AUROC (ties at half) and average precision; NULL unless both classes are present.

    Rows collapse to one row per distinct score; cumulative counts run in score chunks, so a
    key with any number of distinct scores is spread over tasks.
    """
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1)
    pos = F.when(F.col(y) == 1, w).otherwise(0)
    neg = F.when(F.col(y) == 1, F.lit(0)).otherwise(w)
    per = df.groupBy(*keys, F.col(p).alias("_s")).agg(F.sum(pos).alias("_pos"), F.sum(neg).alias("_neg"))
    run = running_sums(per, keys, F.col("_s").desc(), -_bin(F.col("_s"), BINS_PER_E), {"_pos": "_tp", "_neg": "_fp"})
    g = run.groupBy(*keys).agg(
        F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"),
        # negatives scored lower = all negatives - those at or above this score
        F.sum(_d(F.col("_pos")) * (_d(F.col("_neg")) / 2 - _d(F.col("_fp")))).alias("_a"), F.sum(_d(F.col("_pos")) * ratio(_d(F.col("_tp")), _d(F.col("_tp") + F.col("_fp")))).alias("_ap"))
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return g.select(*keys, F.when(both, 1 + ratio(F.col("_a"), _d(F.col("_p")) * _d(F.col("_n")))).alias("auroc"), F.when(both, ratio(F.col("_ap"), _d(F.col("_p")))).alias("auprc"))


def ece(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """Expected calibration error over ten equal bins, the last one closed."""
    b = F.lit(0)
    for e in EDGES:
        b = b + (F.col(p) >= e).cast("int")
    bins = df.groupBy(*keys, b.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.avg(p).alias("_p"), F.avg(y).alias("_y"))
    return bins.groupBy(*keys).agg((F.sum(F.col("_n") * F.abs(F.col("_p") - F.col("_y"))) / F.sum("_n")).alias("ece"))


def classification(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """The whole classification report of one score column."""
    keys = list(keys)
    parts = [confusion(df, keys, y, p), ranking(df, keys, y, p), ece(df, keys, y, p)]
    if keys:
        out = parts[0]
        for x in parts[1:]:
            out = out.join(x, keys)
        return out
    out = parts[0].withColumn("_k", F.lit(1))
    for x in parts[1:]:
        out = out.join(x.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def regression(df: DataFrame, keys: Sequence[str], y: str, yhat: str) -> DataFrame:
    """rmse, mae, bias and r2 in linear and log10 space, correlation and slope."""
    aggs = [F.count(F.lit(1)).alias("n"), F.corr(y, yhat).alias("pearson_r"), F.regr_slope(yhat, y).alias("slope")]
    for name, a, b in (("linear", F.col(y), F.col(yhat)), ("log10", F.log10(y), F.log10(yhat))):
        r = b - a
        aggs += [F.sqrt(F.avg(r * r)).alias(f"rmse_{name}"), F.avg(F.abs(r)).alias(f"mae_{name}"), F.avg(r).alias(f"bias_{name}"),
                 F.avg(r * r).alias(f"_mse_{name}"), F.var_pop(a).alias(f"_var_{name}")]
    g = df.groupBy(*keys).agg(*aggs)
    for name in ("linear", "log10"):
        g = g.withColumn(f"r2_{name}", F.when(F.col(f"_var_{name}") > 0, 1 - F.col(f"_mse_{name}") / F.col(f"_var_{name}"))).drop(f"_mse_{name}", f"_var_{name}")
    return g


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Ranks with ties averaged, for groups of any size (counts per value, cumulated in chunks)."""
    keys = list(keys)
    df = df.where(F.col(value).isNotNull())
    per = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    run = running_sums(per, keys, F.col(value), _bin(F.col(value), BINS_PER_E), {"_c": "_cum"})
    ranks = run.select(*keys, value, (F.col("_cum") - (F.col("_c") - 1) / 2).alias(out))
    return join_nulls(df, ranks, [*keys, value])


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 5) -> DataFrame:
    ranked = average_ranks(average_ranks(df, keys, x, "_rx"), keys, y, "_ry")
    return (ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho")).where(F.col("n") >= min_n))


# ---------------------------------------------------------------- bootstrap
def bootstrap_draws(groups: DataFrame, group: str, n_boot: int) -> DataFrame:
    """How often each group is drawn in each replicate; draws come from a hash, so they repeat.

    ``groups`` has one row per group.  Group numbers are a running count over the hash
    order, so the numbering itself is spread over tasks.
    """
    h = F.sha2(F.col(group).cast("string"), 256)
    numbered = running_sums(groups.select(group).withColumns({"_h": h, "_one": F.lit(1)}), [], F.struct("_h", group), F.substring("_h", 1, 2), {"_one": "_i"})
    numbered = numbered.select(group, (F.col("_i") - 1).alias("_i"))
    total = numbered.agg(F.count(F.lit(1)).alias("_g"))
    slots = numbered.select(F.col("_i").alias("_slot")).crossJoin(F.broadcast(total))       # one row of totals
    draws = slots.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    pick = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("replicate").cast("string"), F.col("_slot").cast("string")), 256), 1, 8), 16, 10).cast("long") % F.col("_g")
    counts = draws.select("replicate", pick.alias("_i")).groupBy("replicate", "_i").agg(F.count(F.lit(1)).alias("times"))
    return counts.join(numbered, "_i").select("replicate", group, "times")


def bootstrap_intervals(df: DataFrame, keys: Sequence[str], group: str, sums: Mapping[str, Column], stats: Mapping[str, Column], n_boot: int) -> DataFrame:
    """Every statistic that follows from per-group sums, with its 95 % interval over replicates of whole groups.

    Rows collapse to one row of sums per key and group before any replicate is drawn, so the work is
    replicates x groups whatever the number of rows.  Per key: each statistic, ``<name>_lo``, ``<name>_hi`` and n_boot.
    """
    keys = list(keys)
    per_group = cut_lineage(df.groupBy(*keys, group).agg(*[F.sum(c).alias(n) for n, c in sums.items()]))
    draws = bootstrap_draws(per_group.select(group).distinct(), group, n_boot)
    reps = draws.join(per_group, group).groupBy(*keys, "replicate").agg(*[F.sum(F.col(n) * F.col("times")).alias(n) for n in sums])
    reps = reps.select(*keys, "replicate", *[c.alias(f"_{n}") for n, c in stats.items()])
    ends = F.array(F.lit(0.025), F.lit(0.975))
    ci = reps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_boot"), *[F.percentile(f"_{n}", ends).alias(f"_{n}") for n in stats])
    full = per_group.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums]).select(*keys, *[c.alias(n) for n, c in stats.items()])
    joined = join_nulls(full, ci, keys) if keys else full.crossJoin(F.broadcast(ci))                            # one row each without keys
    return joined.select(*keys, "n_boot", *[x for n in stats for x in (F.col(n), F.get(f"_{n}", 0).alias(f"{n}_lo"), F.get(f"_{n}", 1).alias(f"{n}_hi"))])


def grouped_bootstrap(df: DataFrame, group: str, sums: Mapping[str, Column], metric_a: Column, metric_b: Column, n_boot: int) -> DataFrame:
    """Paired difference of two metrics that follow from per-group sums: observed values and 95 % intervals of the
    difference and of each arm, over the replicates in which both arms have a value.

    Rows collapse to one row of sums per group before any replicate is drawn, so the work is
    replicates x groups whatever the number of rows.
    """
    per_group = cut_lineage(df.groupBy(group).agg(*[F.sum(c).alias(n) for n, c in sums.items()]))
    draws = bootstrap_draws(per_group, group, n_boot)
    reps = draws.join(per_group, group).groupBy("replicate").agg(*[F.sum(F.col(n) * F.col("times")).alias(n) for n in sums])
    reps = reps.select("replicate", metric_a.alias("_a"), metric_b.alias("_b")).withColumn("_d", F.col("_b") - F.col("_a")).where(F.col("_d").isNotNull())
    ends = F.array(F.lit(0.025), F.lit(0.975))
    ci = reps.agg(F.count(F.lit(1)).alias("n_boot"), *[F.percentile(f"_{x}", ends).alias(f"_{x}") for x in "dab"], F.avg((F.col("_d") > 0).cast("double")).alias("share_positive"))
    full = per_group.agg(*[F.sum(n).alias(n) for n in sums]).select((metric_b - metric_a).alias("difference"))
    return (full.crossJoin(F.broadcast(ci))                                                                     # one row each
            .select("difference", F.get("_d", 0).alias("ci_low"), F.get("_d", 1).alias("ci_high"), "n_boot", "share_positive",
                    *[F.get(f"_{x}", i).alias(f"{x}_{e}") for x in "ab" for i, e in ((0, "low"), (1, "high"))]))


def bootstrap_ranking(df: DataFrame, group: str, y: str, a: str, b: str, n_boot: int) -> DataFrame:
    """The same for average precision: rows are weighted by how often their group was drawn.

    Rows collapse to counts per (group, score, class) first.
    """
    def side(p, name):
        per = df.groupBy(group, F.col(p).alias("p"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("_c"))
        w = per.join(draws, group).withColumn("w", F.col("_c") * F.col("times"))
        return ranking(w, ["replicate"], "y", "p", "w").select("replicate", F.col("auprc").alias(name))
    draws = bootstrap_draws(df.select(group).distinct(), group, n_boot)
    j = side(a, "_a").join(side(b, "_b"), "replicate").withColumn("_d", F.col("_b") - F.col("_a")).where(F.col("_d").isNotNull())
    return j.agg(F.count(F.lit(1)).alias("n_boot"), F.percentile("_d", F.array(F.lit(0.025), F.lit(0.975))).alias("_q")).select(F.get("_q", 0).alias("ci_low"), F.get("_q", 1).alias("ci_high"), "n_boot")


# ---------------------------------------------------------------- comparisons and gates
def false_alarm_share(arms: DataFrame, arm: str, baseline: str) -> DataFrame:
    """fp / (fp + tp) of every arm and its relative reduction against a baseline arm."""
    a = arms.withColumn("share", F.col("fp") / F.greatest(F.col("fp") + F.col("tp"), F.lit(1))).withColumn("_k", F.lit(1))
    base = a.where(F.col(arm) == baseline).agg(F.max("share").alias("_base")).withColumn("_k", F.lit(1))
    out = a.join(base, "_k")
    return out.withColumn("reduction_pct", F.when(F.col("_base") > 0, 100 * (F.col("_base") - F.col("share")) / F.col("_base"))).drop("_k", "_base")


def select_parsimonious(models: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The simplest model whose rmse lies within the best model's upper limit.

    ``models``: keys, model, rmse, rmse_hi, r2, r2_lo; one row per model.
    """
    order = F.lit(len(COMPLEXITY))
    for i, name in enumerate(COMPLEXITY):
        order = F.when(F.col("model") == name, F.lit(i)).otherwise(order)
    best = models.groupBy(*keys).agg(F.min_by("rmse_hi", F.struct("rmse", "model")).alias("_hi"), F.min_by("model", F.struct("rmse", "model")).alias("best"))
    j = models.join(best, list(keys)) if keys else models.crossJoin(F.broadcast(best))
    ok = j.withColumn("_o", order).where((F.col("rmse") <= F.col("_hi")))
    return ok.groupBy(*keys).agg(F.min_by(F.struct("model", "rmse", "r2", "r2_lo"), F.struct("_o", "model")).alias("_m"), F.first("best").alias("best")).select(*keys, "best", "_m.*")


def calibration_verdict(n: Column, groups: Column, r2: Column, r2_lo: Column) -> Column:
    """Reasons against printing physical units; empty when the calibration may be used."""
    skill = F.when(r2.isNull(), "no model could be evaluated").when(~(r2 >= MIN_R2), "skill below threshold").when(~F.coalesce(r2_lo > 0, F.lit(False)), "R2 interval includes zero")
    return F.array_compact(F.array(F.when(n < MIN_MATCHUPS, "too few matchups"), F.when(groups < MIN_GROUPS, "too few groups"), skill))


#: What a gate row tells besides its verdict; fields that a check does not use are NULL.
DETAIL = ("metric", "candidate", "production", "ci_low", "ci_high", "n", "n_failed")


def _gate(row: DataFrame, checks: Sequence[tuple[str, Column, Mapping[str, Column]]]) -> DataFrame:
    kinds = {"metric": "string", "n": "long", "n_failed": "long"}
    told = lambda d: [d.get(k, F.lit(None)).cast(kinds.get(k, "double")).alias(k) for k in DETAIL]                        # noqa: E731
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed"), *told(d)) for n, c, d in checks])
    return row.select(F.explode(rows).alias("_c"), rows.alias("_all")).select("_c.*", F.forall("_all", lambda r: r["passed"]).alias("gate_passed"))


def subgroup_report(scored: DataFrame, y: str, candidate: str, production: str, subgroup: str, metric: str = "auprc") -> DataFrame:
    """Both models on every subgroup: n, both metrics, skipped (too few rows or one class) and regressed."""
    c = ranking(scored, [subgroup], y, candidate).select(subgroup, F.col(metric).alias("candidate"))
    p = ranking(scored, [subgroup], y, production).select(subgroup, F.col(metric).alias("production"))
    n = scored.groupBy(subgroup).agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col(y) == 1) * F.count_if(F.col(y) != 1) > 0).alias("_both"))
    j = join_nulls(join_nulls(n, c, [subgroup], "left"), p, [subgroup], "left")
    skipped = (F.col("n") < SUBGROUP_MIN) | ~F.col("_both")
    return j.withColumns({"skipped": skipped, "regressed": ~skipped & (F.col("candidate") < F.col("production") - SUBGROUP_TOLERANCE)}).drop("_both")


def promotion_gate(scored: DataFrame, y: str, candidate: str, production: str, subgroup: str, frozen_hash: Column, current_hash: Column, tests_passed: Column,
                   metric: str = "auprc", tolerance: float = 0.0, group: str | None = None, n_boot: int = 1000) -> DataFrame:
    """Every automatic check of a triage candidate against production on the frozen validation set.

    One row per check with its verdict, the numbers behind it (``DETAIL``) and the verdict of the whole gate.  With ``group`` the
    primary metric carries the 95 % interval of the paired difference over whole groups (average precision only).
    """
    one = F.lit(1).alias("_k")
    pick = ["n", "positives", metric, "ece", "brier"]
    c = classification(scored, [], y, candidate).select(one, *[F.col(x).alias(f"c_{x}") for x in pick])
    p = classification(scored, [], y, production).select(one, *[F.col(x).alias(f"p_{x}") for x in pick])
    sub = subgroup_report(scored, y, candidate, production, subgroup, metric)
    regressed = sub.agg(F.count_if("regressed").alias("n_regressed"), F.count_if(~F.col("skipped")).alias("n_subgroups")).select(one, "*")
    j = c.join(p, "_k").join(regressed, "_k")
    if group is not None and metric == "auprc":
        j = j.crossJoin(F.broadcast(bootstrap_ranking(scored, group, y, production, candidate, n_boot).select("ci_low", "ci_high")))          # one row
    else:
        j = j.withColumns({"ci_low": F.lit(None).cast("double"), "ci_high": F.lit(None).cast("double")})
    both = (F.col("c_positives") > 0) & (F.col("c_positives") < F.col("c_n"))
    return _gate(j, [
        ("model_test_suite", tests_passed, {}), ("validation_dataset_unchanged", frozen_hash == current_hash, {}),
        ("validation_has_both_classes", both, {"n": F.col("c_n"), "n_failed": F.col("c_positives")}),
        ("primary_metric_not_worse", F.col(f"c_{metric}") >= F.col(f"p_{metric}") - tolerance,
         {"metric": F.lit(metric), "candidate": F.col(f"c_{metric}"), "production": F.col(f"p_{metric}"), "ci_low": F.col("ci_low"), "ci_high": F.col("ci_high"), "n": F.col("c_n")}),
        ("calibration_acceptable", (F.col("c_ece") <= MAX_ECE) | (F.col("c_brier") <= F.col("p_brier")), {"metric": F.lit("brier"), "candidate": F.col("c_brier"), "production": F.col("p_brier")}),
        ("no_subgroup_regression", F.col("n_regressed") == 0, {"n": F.col("n_subgroups"), "n_failed": F.col("n_regressed")})])


#: Largest bias in log10 that a regression candidate may have.
MAX_BIAS_LOG10 = 0.1


def regression_gate(scored: DataFrame, y: str, candidate: str, production: str, frozen_hash: Column, current_hash: Column, tests_passed: Column,
                    tolerance: float = 0.0, group: str | None = None, n_boot: int = 1000) -> DataFrame:
    """The gate of a concentration model: rmse in log10 not worse, bias in log10 small; the interval is of the improvement."""
    err = lambda c: F.log10(c) - F.log10(y)                                                                    # noqa: E731
    pick = lambda c, k: regression(scored, [], y, c).select("n", F.col("rmse_log10").alias(f"{k}_rmse"), F.col("bias_log10").alias(f"{k}_bias"))
    j = pick(candidate, "c").crossJoin(F.broadcast(pick(production, "p").drop("n")))                                   # one row each
    if group is not None:
        sums = {"n_": F.lit(1), "a": err(production) * err(production), "b": err(candidate) * err(candidate)}
        ci = grouped_bootstrap(scored, group, sums, -F.sqrt(F.col("a") / F.col("n_")), -F.sqrt(F.col("b") / F.col("n_")), n_boot)
        j = j.crossJoin(F.broadcast(ci.select("ci_low", "ci_high")))
    else:
        j = j.withColumns({"ci_low": F.lit(None).cast("double"), "ci_high": F.lit(None).cast("double")})
    return _gate(j, [
        ("model_test_suite", tests_passed, {}), ("validation_dataset_unchanged", frozen_hash == current_hash, {}),
        ("primary_metric_not_worse", F.col("c_rmse") <= F.col("p_rmse") + tolerance,
         {"metric": F.lit("rmse_log10"), "candidate": F.col("c_rmse"), "production": F.col("p_rmse"), "ci_low": F.col("ci_low"), "ci_high": F.col("ci_high"), "n": F.col("n")}),
        ("calibration_acceptable", F.abs("c_bias") <= MAX_BIAS_LOG10, {"metric": F.lit("bias_log10"), "candidate": F.col("c_bias"), "production": F.col("p_bias")}),
        ("no_subgroup_regression", F.lit(True), {})])


def residual_quantile(residuals: DataFrame, column: str, q: float = 0.9) -> DataFrame:
    return exact_quantiles(residuals, [], column, {"q": q})
