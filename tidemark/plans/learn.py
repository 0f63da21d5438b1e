"""Queries of the learning and evaluation operators (document labels as outcomes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import learn as le
from tidemark.operators import metrics as me
from tidemark.plans.base import query, r6
from tidemark.sources.tables import table


def rnd(c, digits=6):
    return F.round(c, digits)


# Scored rows: production and candidate probabilities with many ties and an exact 1.0.
SCORED_COLUMNS = {"id": "doc_id", "y": "quality", "grp": "concat(source, '|', lang)", "sub": "lang", "pa": "((n_chars * 7 + doc_id * 13) % 101) / 100e0",
                  "pb": "CASE WHEN doc_id % 3 = 0 THEN 1e0 * quality ELSE (((n_chars * 11 + doc_id * 17) % 61) + 40 * quality) / 100e0 END",
                  "x1": "CASE WHEN doc_id % 11 <> 0 THEN n_chars / 1000e0 END", "x2": "(doc_id * 37 % 97) / 10e0", "x3": "(n_chars % 53) / 7e0"}
SQL_SCORED = "scored AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in SCORED_COLUMNS.items()) + " FROM labels JOIN documents USING (doc_id))"


def scored(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").selectExpr(*[f"{v} AS {k}" for k, v in SCORED_COLUMNS.items()])


SQL_HEXSUM = "list_sum(list_transform(string_split(sha256({}), ''), lambda x: CAST('0x' || x AS INTEGER)))"


@query("group_split", f"WITH {SQL_SCORED} SELECT id, grp, CASE WHEN {SQL_HEXSUM.format('grp')} % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM scored")
def group_split(spark, d):
    return scored(spark, d).select("id", "grp", le.group_split(F.col("grp")).alias("split"))


@query("stratified_group_split", f"""WITH RECURSIVE {SQL_SCORED}, g AS (SELECT grp, count(CASE WHEN y = 1 THEN 1 END) AS p, count(CASE WHEN y <> 1 THEN 1 END) AS n, row_number() OVER (ORDER BY sha256(grp), grp) AS i FROM scored GROUP BY grp), t AS (SELECT 0.2e0 * sum(p) AS tp, 0.2e0 * sum(n) AS tn FROM g),
f(i, vp, vn, took, grp) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, false, '' UNION ALL SELECT g.i, CASE WHEN k THEN vp + p ELSE vp END, CASE WHEN k THEN vn + n ELSE vn END, k, g.grp FROM (SELECT f.i AS fi, vp, vn, g.*, ((vp < tp AND p > 0) OR (vn < tn AND n > 0)) AND vp + p <= 1.5 * tp + 1 AND vn + n <= 1.5 * tn + 1 AS k FROM f JOIN g ON g.i = f.i + 1, t) g)
SELECT grp, count(*) AS n_rows FROM scored WHERE grp IN (SELECT grp FROM f WHERE took) GROUP BY 1""")
def stratified_group_split(spark, d):
    s = scored(spark, d)
    return s.join(le.stratified_groups(s, "grp", "y"), "grp", "left_semi").groupBy("grp").agg(F.count(F.lit(1)).alias("n_rows"))


@query("impute_scale", f"""WITH {SQL_SCORED}, u AS (SELECT unnest(['x1', 'x2', 'x3']) AS feature, unnest([x1, x2, x3]) AS v FROM scored), m AS (SELECT feature, median(v) AS med FROM u GROUP BY 1)
SELECT feature, {r6('any_value(med)')} AS median, {r6('avg(coalesce(v, med))')} AS mean, {r6('stddev_pop(coalesce(v, med))')} AS scale FROM u JOIN m USING (feature) GROUP BY 1""")
def impute_scale(spark, d):
    s = le.scaler(scored(spark, d), ["x1", "x2", "x3"])
    return s.select("feature", *[rnd(F.col(c)).alias(c) for c in ("median", "mean", "scale")])


def sql_solve(src, n, keys):
    """Nested SELECTs that solve the symmetric system h x = g of every row of ``src`` (h0_0 .., g0 ..) by elimination."""
    for k in range(n):
        rest = [f"h{i}_{j} - h{k}_{i} * h{k}_{j} / h{k}_{k} AS h{i}_{j}" if i > k else f"h{i}_{j}" for i in range(n) for j in range(i, n)]
        src = f"(SELECT {keys}, {', '.join(rest)}, {', '.join(f'g{i} - h{k}_{i} * g{k} / h{k}_{k} AS g{i}' if i > k else f'g{i}' for i in range(n))} FROM {src})"
    for k in range(n - 1, -1, -1):
        known = "".join(f" - h{k}_{j} * x{j}" for j in range(k + 1, n))
        src = f"(SELECT *, (g{k}{known}) / h{k}_{k} AS x{k} FROM {src})"
    return src


def sql_newton(rows, d, steps=14):
    """CTE nw(step, m, b0 ..): Newton steps of L2 logistic fits for every model m of ``rows`` (m, y, w, z1 .. zd)."""
    z = ["1.0e0"] + [f"z{i}" for i in range(1, d + 1)]
    n = d + 1
    lin = " + ".join(f"b{i} * {z[i]}" for i in range(n))
    prob = f"(1 / (1 + exp(-({lin}))))"
    sums = [f"sum(w * {prob} * (1 - {prob}) * {z[i]} * {z[j]}) + {1 if i == j and i else 0} AS h{i}_{j}" for i in range(n) for j in range(i, n)]
    sums += [f"sum(w * ({prob} - y) * {z[i]})" + (f" + any_value(b{i})" if i else "") + f" AS g{i}" for i in range(n)]
    agg = f"(SELECT step, m, {', '.join(f'any_value(b{i}) AS b{i}' for i in range(n))}, {', '.join(sums)} FROM nw JOIN {rows} USING (m) WHERE step < {steps} GROUP BY step, m)"
    b = ", ".join(f"b{i}" for i in range(n))
    return f"""nw(step, m, {b}) AS (SELECT DISTINCT 0, m, {', '.join('0.0e0' for _ in range(n))} FROM {rows} UNION ALL SELECT step + 1, m, {', '.join(f'b{i} - x{i}' for i in range(n))} FROM {sql_solve(agg, n, f'step, m, {b}')}),
fit AS MATERIALIZED (SELECT * FROM nw WHERE step = {steps})"""


def sql_scaled(src, name, features, keys):
    """CTE: rows of ``src`` (keys, y, w, features) with balanced weights bw and scaled columns z1 .. within each model."""
    med = ", ".join(f"coalesce(median({f}), 0) AS md_{f}" for f in features)
    mom = ", ".join(f"avg(coalesce({f}, md_{f})) AS mu_{f}, CASE WHEN stddev_pop(coalesce({f}, md_{f})) > 1e-12 THEN stddev_pop(coalesce({f}, md_{f})) ELSE 1 END AS sd_{f}" for f in features)
    return f"""{name}_md AS (SELECT {keys}, {med} FROM {src} GROUP BY {keys}), {name}_sc AS MATERIALIZED (SELECT {keys}, {', '.join(f'any_value(md_{f}) AS md_{f}' for f in features)}, {mom},
 count(*) AS n_tr, count(CASE WHEN y = 1 THEN 1 END) AS n1, count(CASE WHEN y = 0 THEN 1 END) AS n0 FROM {src} JOIN {name}_md USING ({keys}) GROUP BY {keys})"""


def sql_z(f, alias=""):
    return f"(coalesce({alias}{f}, md_{f}) - mu_{f}) / sd_{f}"


LOGIT = ["x1", "x2", "x3", "pb"]


@query("fit_logistic", f"""WITH RECURSIVE {SQL_SCORED}, al AS (SELECT 'all' AS m, * FROM scored), {sql_scaled('al', 'a', LOGIT, 'm')},
tr AS MATERIALIZED (SELECT m, y, CASE WHEN y = 1 THEN n_tr / (2.0e0 * n1) ELSE n_tr / (2.0e0 * n0) END AS w, {', '.join(f'{sql_z(f)} AS z{i + 1}' for i, f in enumerate(LOGIT))} FROM al JOIN a_sc USING (m)), {sql_newton('tr', 4)}
SELECT unnest({[*LOGIT, 'intercept']!r}) AS feature, unnest([{', '.join(r6(f'b{i}') for i in (1, 2, 3, 4, 0))}]) AS coef FROM fit""")
def fit_logistic(spark, d):
    """Coefficients of the L2 logistic fit."""
    art = le.fit_logistic(scored(spark, d), LOGIT, "y")
    return spark.createDataFrame([(f, round(float(c), 6) + 0.0) for f, c in zip(art["features"] + ["intercept"], art["coef"] + [art["intercept"]])], "feature string, coef double")


def sql_ridge2(src, keys):
    """Ridge (alpha 1) on ly with the scaled columns za, zb of each group of ``keys``: c2, c3 and the intercept c0."""
    return f"""(SELECT {keys}, c2, c3, my - c2 * ma - c3 * mb AS c0 FROM (SELECT *, (at_ * bb - bt * ab) / (aa * bb - ab * ab) AS c2, (bt * aa - at_ * ab) / (aa * bb - ab * ab) AS c3 FROM
 (SELECT {keys}, avg(za) AS ma, avg(zb) AS mb, avg(ly) AS my, var_pop(za) * count(*) + 1 AS aa, var_pop(zb) * count(*) + 1 AS bb, covar_pop(za, zb) * count(*) AS ab, covar_pop(za, ly) * count(*) AS at_, covar_pop(zb, ly) * count(*) AS bt FROM {src} GROUP BY {keys})))"""


@query("fit_ridge_log10", f"""WITH {SQL_SCORED}, b AS MATERIALIZED (SELECT id, sub, x2, x3, log10(1 + x2 + 0.5e0 * x3 + (id % 5)) AS ly FROM scored), sides AS (SELECT DISTINCT sub AS out FROM b UNION ALL SELECT '(none)'),
s AS MATERIALIZED (SELECT out, avg(x2) AS m2, stddev_pop(x2) AS s2, avg(x3) AS m3, stddev_pop(x3) AS s3 FROM sides JOIN b ON sub <> out GROUP BY 1),
z AS MATERIALIZED (SELECT out, id, sub, ly, (x2 - m2) / s2 AS za, (x3 - m3) / s3 AS zb FROM b, s), c AS MATERIALIZED (SELECT * FROM {sql_ridge2('(SELECT * FROM z WHERE sub <> out)', 'out')}),
r AS (SELECT out, ly - c0 - c2 * za - c3 * zb AS r FROM z JOIN c USING (out) WHERE sub = out OR out = '(none)')
SELECT 'x2' AS feature, {r6('c2')} AS coef FROM c WHERE out = '(none)' UNION ALL SELECT 'x3', {r6('c3')} FROM c WHERE out = '(none)' UNION ALL SELECT 'intercept', {r6('c0')} FROM c WHERE out = '(none)'
UNION ALL SELECT 'resid_sd', {r6('stddev_samp(r)')} FROM r WHERE out = '(none)' UNION ALL SELECT 'conformal_q90', {r6('quantile_cont(abs(r), 0.9)')} FROM r WHERE out <> '(none)'""")
def fit_ridge_log10(spark, d):
    """Coefficients, residual sd and the 90 % leave-group-out interval (half width in log10)."""
    s = scored(spark, d).withColumn("target", 1 + F.col("x2") + 0.5 * F.col("x3") + F.col("id") % 5)
    art = le.fit_ridge_log10(s, ["x2", "x3"], "target", group="sub")
    rows = [(f, float(c)) for f, c in zip(art["features"] + ["intercept"], art["coef"] + [art["intercept"]])] + [(k, float(art[k])) for k in ("resid_sd", "conformal_q90")]
    return spark.createDataFrame([(f, round(c, 6) + 0.0) for f, c in rows], "feature string, coef double")


ART = {"kind": "logistic", "features": ["x1", "x2", "x3"], "medians": [1.2, 4.8, 3.5], "mean": [1.5, 4.7, 3.6], "scale": [1.1, 2.8, 2.2], "coef": [0.8, -0.4, 0.25], "intercept": 0.3}
SQL_DEC = "0.3e0 + (coalesce(x1, 1.2e0) - 1.5e0) / 1.1e0 * 0.8e0 + (x2 - 4.7e0) / 2.8e0 * (-0.4e0) + (x3 - 3.6e0) / 2.2e0 * 0.25e0"


@query("score_artifact", f"WITH {SQL_SCORED}, q AS (SELECT id, {SQL_DEC} AS s FROM scored) SELECT id, {r6('1 / (1 + exp(-s))')} AS p, {r6('pow(10, s / 4)')} AS conc, {r6('pow(10, s / 4 - 0.2)')} AS lo, {r6('pow(10, s / 4 + 0.2)')} AS hi FROM q")
def score_artifact(spark, d):
    quarter = {**ART, "kind": "ridge_log10", "coef": [c / 4 for c in ART["coef"]], "intercept": ART["intercept"] / 4}
    lo, hi = le.interval(quarter, 0.2)
    return scored(spark, d).select("id", *[rnd(c).alias(n) for n, c in (("p", le.score(ART)), ("conc", le.score(quarter)), ("lo", lo), ("hi", hi))])


@query("rules_score", f"""SELECT o_orderkey AS id, {r6("least(greatest(0.05 + 0.9 * least(greatest((coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey * 13) % 101 END, 50) - 80) / 20e0, 0), 1) * (1 - coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 10) / 9e0 END, 0)) * (1 - 0.6 * (o_custkey % 8) / 7e0), 0), 1)")} AS score FROM orders""")
def rules_score(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey * 13) % 101 * 1e0 END AS pct", "CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 10) / 9e0 END AS per", "(o_custkey % 8) / 7e0 AS cl")
    return o.select("id", rnd(le.rules_score(F.col("pct"), F.col("per"), F.col("cl"))).alias("score"))


SQL_CONF = """cf AS (SELECT sub, count(*) AS n, count(CASE WHEN y = 1 THEN 1 END) AS positives, count(CASE WHEN pb >= 0.5 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN pb >= 0.5 AND y = 0 THEN 1 END) AS fp, count(CASE WHEN pb < 0.5 AND y = 1 THEN 1 END) AS fn, count(CASE WHEN pb < 0.5 AND y = 0 THEN 1 END) AS tn,
avg(pow(pb - y, 2)) AS brier, -avg(y * ln(least(greatest(pb, 1e-9), 1 - 1e-9)) + (1 - y) * ln(1 - least(greatest(pb, 1e-9), 1 - 1e-9))) AS ll FROM scored GROUP BY 1)"""


@query("confusion_metrics", f"""WITH {SQL_SCORED}, {SQL_CONF} SELECT sub, n, positives, tp, fp, fn, tn, {r6('brier')} AS brier, {r6('ll')} AS log_loss, {r6('tp / CAST(nullif(tp + fp, 0) AS DOUBLE)')} AS precision, {r6('tp / CAST(nullif(tp + fn, 0) AS DOUBLE)')} AS recall,
{r6('2.0 * tp / nullif(2 * tp + fp + fn, 0)')} AS f1 FROM cf""")
def confusion_metrics(spark, d):
    c = me.confusion(scored(spark, d), ["sub"], "y", "pb")
    return c.select("sub", "n", "positives", "tp", "fp", "fn", "tn", *[rnd(F.col(x)).alias(x) for x in ("brier", "log_loss", "precision", "recall", "f1")])


def sql_auc(p, keys="sub"):
    return f"""SELECT {keys}, (sum(CASE WHEN y = 1 THEN rk END) - count(CASE WHEN y = 1 THEN 1 END) * (count(CASE WHEN y = 1 THEN 1 END) + 1) / 2.0) / nullif(count(CASE WHEN y = 1 THEN 1 END) * count(CASE WHEN y = 0 THEN 1 END), 0) AS auroc
FROM (SELECT {keys}, y, rank() OVER (PARTITION BY {keys} ORDER BY {p}) + (count(*) OVER (PARTITION BY {keys}, {p}) - 1) / 2.0 AS rk FROM scored) GROUP BY {keys}"""


def sql_ap(p, keys="sub"):
    return f"""SELECT {keys}, CASE WHEN any_value(nn) > 0 THEN sum(pos * tp / CAST(tp + fp AS DOUBLE)) / nullif(any_value(np), 0) END AS auprc FROM (SELECT {keys}, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {keys}) AS np, sum(neg) OVER (PARTITION BY {keys}) AS nn
FROM (SELECT {keys}, {p} AS p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY {keys}, {p}) WINDOW w AS (PARTITION BY {keys} ORDER BY p DESC)) GROUP BY {keys}"""


@query("auroc", f"WITH {SQL_SCORED} SELECT sub, {r6('auroc')} AS auroc FROM ({sql_auc('pa')})")
def auroc(spark, d):
    return me.ranking(scored(spark, d), ["sub"], "y", "pa").select("sub", rnd(F.col("auroc")).alias("auroc"))


@query("average_precision", f"WITH {SQL_SCORED} SELECT sub, {r6('auprc')} AS auprc FROM ({sql_ap('pb')})")
def average_precision(spark, d):
    return me.ranking(scored(spark, d), ["sub"], "y", "pb").select("sub", rnd(F.col("auprc")).alias("auprc"))


_BIN = " + ".join(f"CAST({{p}} >= {e!r}e0 AS INTEGER)" for e in me.EDGES)


def sql_ece(p, keys="sub"):
    return f"SELECT {keys}, sum(n * abs(mp - my)) / sum(n) AS ece FROM (SELECT {keys}, {_BIN.format(p=p)} AS b, count(*) AS n, avg({p}) AS mp, avg(y) AS my FROM scored GROUP BY ALL) GROUP BY {keys}"


@query("ece", f"WITH {SQL_SCORED} SELECT sub, {r6('ece')} AS ece FROM ({sql_ece('pa')})")
def ece(spark, d):
    return me.ece(scored(spark, d), ["sub"], "y", "pa").select("sub", rnd(F.col("ece")).alias("ece"))


@query("regression_metrics", f"""WITH r AS (SELECT o_orderpriority AS k, o_totalprice / 1000 + 1 AS y, o_totalprice / 1000 + 1 + (o_custkey % 41) - 15 + 20 AS p FROM orders), e AS (SELECT k, count(*) AS n, corr(y, p) AS c, regr_slope(p, y) AS sl, sqrt(avg(pow(p - y, 2))) AS a, avg(abs(p - y)) AS b, avg(p - y) AS bi, 1 - avg(pow(p - y, 2)) / var_pop(y) AS r2,
sqrt(avg(pow(log10(p) - log10(y), 2))) AS la, avg(abs(log10(p) - log10(y))) AS lb, avg(log10(p) - log10(y)) AS lbi, 1 - avg(pow(log10(p) - log10(y), 2)) / var_pop(log10(y)) AS lr2 FROM r GROUP BY 1)
SELECT k, n, {r6('c')} AS pearson_r, {r6('sl')} AS slope, {r6('a')} AS rmse_linear, {r6('b')} AS mae_linear, {r6('bi')} AS bias_linear, {r6('r2')} AS r2_linear, {r6('la')} AS rmse_log10, {r6('lb')} AS mae_log10, {r6('lbi')} AS bias_log10, {r6('lr2')} AS r2_log10 FROM e""")
def regression_metrics(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), (F.col("o_totalprice") / 1000 + 1).alias("y"), (F.col("o_totalprice") / 1000 + 1 + F.col("o_custkey") % 41 - 15 + 20).alias("p"))
    out = me.regression(o, ["k"], "y", "p")
    return out.select("k", "n", *[rnd(F.col(c)).alias(c) for c in out.columns if c not in ("k", "n")])


@query("spearman", f"""WITH r AS (SELECT o_orderpriority AS k, o_custkey % 200 * 1e0 AS x, floor(o_totalprice / 5000) AS y FROM orders), q AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2.0 AS ry FROM r)
SELECT k, count(*) AS n, {r6('corr(rx, ry)')} AS rho FROM q GROUP BY 1 HAVING count(*) >= 5""")
def spearman(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), (F.col("o_custkey") % 200).cast("double").alias("x"), F.floor(F.col("o_totalprice") / 5000).cast("double").alias("y"))
    return me.spearman(o, ["k"], "x", "y").withColumn("rho", rnd(F.col("rho")))


NB = 1000
SQL_DRAWS = f"""gn AS (SELECT grp, row_number() OVER (ORDER BY sha256(grp), grp) - 1 AS i FROM (SELECT DISTINCT grp FROM scored)), ng AS (SELECT count(*) AS g FROM gn),
dr AS MATERIALIZED (SELECT b AS rep, CAST('0x' || substr(sha256(CAST(b AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT) % g AS i, count(*) AS t FROM gn, ng, generate_series(0, {NB - 1}) x(b) GROUP BY ALL), dg AS MATERIALIZED (SELECT rep, grp, t FROM dr JOIN gn USING (i))"""


@query("grouped_bootstrap", f"""WITH {SQL_SCORED}, {SQL_DRAWS}, s AS (SELECT grp, count(*) AS n, sum(pow(pa - y, 2)) AS a, sum(pow(pb - y, 2)) AS b FROM scored GROUP BY 1), r AS (SELECT rep, sum(b * t) / sum(n * t) - sum(a * t) / sum(n * t) AS df, sum(a * t) / sum(n * t) AS a, sum(b * t) / sum(n * t) AS b FROM dg JOIN s USING (grp) GROUP BY 1)
SELECT {r6('(SELECT sum(b) / sum(n) - sum(a) / sum(n) FROM s)')} AS difference, {r6('quantile_cont(df, 0.025)')} AS ci_low, {r6('quantile_cont(df, 0.975)')} AS ci_high, count(*) AS n_boot, {r6('avg(CAST(df > 0 AS INTEGER))')} AS share_positive,
{', '.join(f"{r6(f'quantile_cont({x}, {q})')} AS {x}_{e}" for x in ('a', 'b') for q, e in ((0.025, 'low'), (0.975, 'high')))} FROM r""")
def grouped_bootstrap(spark, d):
    s = scored(spark, d)
    sums = {"n": F.lit(1), "a": F.pow(F.col("pa") - F.col("y"), 2), "b": F.pow(F.col("pb") - F.col("y"), 2)}
    out = me.grouped_bootstrap(s, "grp", sums, F.col("a") / F.col("n"), F.col("b") / F.col("n"), NB)
    return out.select("n_boot", *[rnd(F.col(c)).alias(c) for c in ("difference", "ci_low", "ci_high", "share_positive", "a_low", "a_high", "b_low", "b_high")])


def _sql_boot_ap(p):
    return f"""(SELECT rep, CASE WHEN any_value(nn) > 0 THEN sum(pos * tp / CAST(tp + fp AS DOUBLE)) / nullif(any_value(np), 0) END AS ap FROM (SELECT rep, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY rep) AS np, sum(neg) OVER (PARTITION BY rep) AS nn
FROM (SELECT rep, {p} AS p, sum(y * t) AS pos, sum((1 - y) * t) AS neg FROM scored JOIN dg USING (grp) GROUP BY rep, {p}) WINDOW w AS (PARTITION BY rep ORDER BY p DESC)) GROUP BY rep)"""


@query("bootstrap_ranking", f"WITH {SQL_SCORED}, {SQL_DRAWS}, j AS (SELECT b.ap - a.ap AS df FROM {_sql_boot_ap('pa')} a JOIN {_sql_boot_ap('pb')} b USING (rep)) SELECT {r6('quantile_cont(df, 0.025)')} AS ci_low, {r6('quantile_cont(df, 0.975)')} AS ci_high, count(df) AS n_boot FROM j")
def bootstrap_ranking(spark, d):
    out = me.bootstrap_ranking(scored(spark, d), "grp", "y", "pa", "pb", NB)
    return out.select(rnd(F.col("ci_low")).alias("ci_low"), rnd(F.col("ci_high")).alias("ci_high"), "n_boot")


def sql_report(src, keys, p):
    """Classification metrics of column ``p`` of ``src`` (y) per keys, each its own subquery: auroc, auprc, brier, ece, f1."""
    on = lambda q: q.replace("FROM scored", f"FROM {src}")                                             # noqa: E731
    return f"""(SELECT * FROM ({on(sql_auc(p, keys))}) JOIN ({on(sql_ap(p, keys))}) USING ({keys}) JOIN ({on(sql_ece(p, keys))}) USING ({keys}) JOIN (SELECT {keys}, count(*) AS n, count(CASE WHEN y = 1 THEN 1 END) AS positives,
 avg(pow({p} - y, 2)) AS brier, count(CASE WHEN {p} >= 0.5 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN {p} >= 0.5 AND y = 0 THEN 1 END) AS fp, count(CASE WHEN {p} < 0.5 AND y = 1 THEN 1 END) AS fn FROM {src} GROUP BY {keys}) USING ({keys}))"""


LOGO = ["x1", "x2", "pb"]
RULE = "least(greatest(0.05e0 + 0.9e0 * (least(greatest((100 * pa - 80) / 20, 0), 1) * (1 - (id % 10) / 9e0) * (1 - 0.6e0 * ((id % 8) / 7e0))), 0), 1)"


@query("leave_one_group_out", f"""WITH RECURSIVE {SQL_SCORED}, hd AS (SELECT sub AS m, count(*) AS n_test, count(CASE WHEN y = 1 THEN 1 END) AS test_positive FROM scored GROUP BY 1), ks AS (SELECT hd.* FROM hd WHERE test_positive BETWEEN 1 AND n_test - 1 AND
 (SELECT count(DISTINCT y) FROM scored WHERE sub <> m) = 2), al AS MATERIALIZED (SELECT m, s.* FROM ks JOIN scored s ON s.sub <> m), {sql_scaled('al', 'a', LOGO, 'm')},
tr AS MATERIALIZED (SELECT m, y, CASE WHEN y = 1 THEN n_tr / (2.0e0 * n1) ELSE n_tr / (2.0e0 * n0) END AS w, {', '.join(f'{sql_z(f)} AS z{i + 1}' for i, f in enumerate(LOGO))} FROM al JOIN a_sc USING (m)), {sql_newton('tr', 3)},
oof AS MATERIALIZED (SELECT sub, y, 1 / (1 + exp(-(b0 + {' + '.join(f'b{i + 1} * {sql_z(f)}' for i, f in enumerate(LOGO))}))) AS p, {RULE} AS q FROM scored JOIN fit ON m = sub JOIN a_sc USING (m)),
c AS (SELECT * FROM {sql_report('oof', 'sub', 'p')}), q AS (SELECT * FROM {sql_report('oof', 'sub', 'q')})
SELECT m AS held_out, n_test, test_positive, (SELECT count(*) FROM scored) - n_test AS n_train, CASE WHEN c.n IS NULL THEN 'needs both classes in train and test' END AS status,
{', '.join(f"{r6(f'c.{k}', 4)} AS {k}, {r6(f'q.{k}', 4)} AS rule_{k}" for k in ('auroc', 'auprc', 'brier', 'ece'))} FROM hd LEFT JOIN c ON c.sub = m LEFT JOIN q ON q.sub = m""")
def leave_one_group_out(spark, d):
    """Per held-out area: a model that never saw it, beside the rule."""
    rule = le.rules_score(100 * F.col("pa"), (F.col("id") % 10) / 9, (F.col("id") % 8) / 7)
    out = le.leave_one_group_out(scored(spark, d), "sub", LOGO, "y", rule=rule)
    return out.select("held_out", "n_test", "test_positive", "n_train", "status", *[rnd(F.col(c), 4).alias(c) for k in ("auroc", "auprc", "brier", "ece") for c in (k, f"rule_{k}")])


SQL_XY = "pt AS (SELECT c_custkey AS k, 54 + (c_custkey * 37 % 1000) * 0.0031e0 AS lon, 24 + (c_custkey * 91 % 1000) * 0.0017e0 AS lat FROM customer)"
SQL_BLOCKS = f"{SQL_XY}, o AS (SELECT min(lon) AS x0, min(lat) AS y0, avg(lat) AS l0 FROM pt), bk AS (SELECT k, CAST(floor((lon - x0) * 111.32e0 * cos(radians(l0)) / 20.3e0) * 10000 + floor((lat - y0) * 110.574e0 / 20.3e0) AS BIGINT) AS block FROM pt, o)"


def blocks(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("k"), (54 + (k * 37 % 1000) * 0.0031).alias("lon"), (24 + (k * 91 % 1000) * 0.0017).alias("lat"))
    return le.spatial_blocks(p, "lon", "lat", 20.3)


@query("spatial_blocks", f"WITH {SQL_BLOCKS} SELECT k, block FROM bk")
def spatial_blocks(spark, d):
    return blocks(spark, d).select("k", "block")


@query("blocked_folds", f"WITH {SQL_BLOCKS}, f AS (SELECT block, CAST((row_number() OVER (ORDER BY sha256(CAST(block AS VARCHAR)), block) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT block FROM bk)) SELECT k, block, fold FROM bk JOIN f USING (block)")
def blocked_folds(spark, d):
    return le.blocked_folds(blocks(spark, d), "block", 5).select("k", "block", "fold")


CV_FOLDS = 5
CV_SETS = {"small": ["x2"], "full": ["x1", "x2", "x3", "pb"]}
CV_ALL = ["x1", "x2", "x3", "pb"]
SQL_OOF = f"""bf AS (SELECT grp, (row_number() OVER (ORDER BY sha256(CAST(grp AS VARCHAR)), grp) - 1) % {CV_FOLDS} AS fold FROM (SELECT DISTINCT grp FROM scored)),
fr AS MATERIALIZED (SELECT 'blocked' AS scheme, fold, s.* FROM scored s JOIN bf USING (grp) UNION ALL SELECT 'random', {SQL_HEXSUM.format('CAST(id AS VARCHAR)')} % {CV_FOLDS}, s.* FROM scored s),
ks AS (SELECT scheme, k FROM (SELECT f.scheme, k, count(CASE WHEN fold = k THEN 1 END) AS te, count(CASE WHEN fold <> k THEN 1 END) AS tr, count(DISTINCT CASE WHEN fold <> k THEN y END) AS c FROM fr f, generate_series(0, {CV_FOLDS - 1}) g(k) GROUP BY 1, 2) WHERE te >= 10 AND tr >= 50 AND c = 2),
al AS MATERIALIZED (SELECT ks.scheme || ':' || k AS m, fr.* FROM ks JOIN fr ON fr.scheme = ks.scheme AND fold <> k), {sql_scaled('al', 'a', CV_ALL, 'm')},
tr AS MATERIALIZED (SELECT m || ':small' AS m, y, CASE WHEN y = 1 THEN n_tr / (2.0e0 * n1) ELSE n_tr / (2.0e0 * n0) END AS w, 0.0e0 AS z1, {sql_z('x2')} AS z2, 0.0e0 AS z3, 0.0e0 AS z4 FROM al JOIN a_sc USING (m)
 UNION ALL SELECT m || ':full', y, CASE WHEN y = 1 THEN n_tr / (2.0e0 * n1) ELSE n_tr / (2.0e0 * n0) END, {', '.join(sql_z(f) for f in CV_ALL)} FROM al JOIN a_sc USING (m)), {sql_newton('tr', 4)},
oof AS MATERIALIZED (SELECT scheme, arm, id, grp, y, 1 / (1 + exp(-(b0 + {' + '.join(f'b{i + 1} * {sql_z(f)}' for i, f in enumerate(CV_ALL))}))) AS p FROM (SELECT fr.*, unnest(['small', 'full']) AS arm FROM fr) f JOIN a_sc a ON a.m = f.scheme || ':' || f.fold JOIN fit ON fit.m = a.m || ':' || arm)"""


def cv_rows(spark, d):
    s = le.blocked_folds(scored(spark, d), "grp", CV_FOLDS)
    return s.withColumn("row_fold", le.hash_mod(F.col("id").cast("string"), CV_FOLDS).cast("int"))


@query("blocked_cv_compare", f"""WITH RECURSIVE {SQL_SCORED}, {SQL_OOF} SELECT scheme, arm, CASE arm WHEN 'small' THEN 1 ELSE 4 END AS n_features, n, positives, {r6('2.0 * tp / nullif(2 * tp + fp + fn, 0)', 4)} AS f1, {r6('auroc', 4)} AS auroc, {r6('auprc', 4)} AS auprc
FROM {sql_report('oof', 'scheme, arm', 'p')}""")
def blocked_cv_compare(spark, d):
    """Two feature sets under grouped and row-wise folds, all fits of a scheme together."""
    out = le.compare_feature_sets(cv_rows(spark, d), {"blocked": "fold", "random": "row_fold"}, CV_SETS, "y")
    return out.select("scheme", "arm", "n_features", "n", "positives", *[rnd(F.col(c), 4).alias(c) for c in ("f1", "auroc", "auprc")])


_F1 = lambda s: f"2.0 * sum(t * tp_{s}) / nullif(sum(t * (2 * tp_{s} + w_{s})), 0)"


@query("feature_set_lift", f"""WITH RECURSIVE {SQL_SCORED}, {SQL_OOF}, {{draws}}, ob AS MATERIALIZED (SELECT * FROM oof WHERE scheme = 'blocked'), rp AS MATERIALIZED (SELECT *, tp / CAST(nullif(tp + fp, 0) AS DOUBLE) AS precision, tp / CAST(nullif(tp + fn, 0) AS DOUBLE) AS recall, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM {sql_report('ob', 'arm', 'p')}),
u AS (SELECT arm, unnest(['f1', 'auroc', 'precision', 'recall', 'auprc']) AS metric, unnest([f1, auroc, precision, recall, auprc]) AS v FROM rp), gs AS (SELECT grp, {', '.join(f"sum(CASE WHEN arm = '{a}' AND p >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS tp_{s}, sum(CASE WHEN arm = '{a}' AND (p >= 0.5) <> (y = 1) THEN 1 ELSE 0 END) AS w_{s}" for s, a in (('a', 'small'), ('b', 'full')))} FROM ob GROUP BY 1),
bt AS (SELECT coalesce({_F1('b')}, 0) - coalesce({_F1('a')}, 0) AS df FROM dg JOIN gs USING (grp) GROUP BY rep), ci AS (SELECT 'f1' AS metric, quantile_cont(df, 0.025) AS lo, quantile_cont(df, 0.975) AS hi, avg(CAST(df > 0 AS INTEGER)) AS sp FROM bt)
SELECT 'full' AS arm, metric, {r6('a.v', 4)} AS baseline, {r6('b.v', 4)} AS value, {r6('b.v - a.v', 4)} AS absolute_gain, {r6('100 * (b.v - a.v) / nullif(a.v, 0)', 2)} AS relative_gain_pct, {r6('lo', 4)} AS ci_low, {r6('hi', 4)} AS ci_high, CAST(lo > 0 AS INTEGER) AS significant, {r6('sp', 3)} AS p_gain_positive
FROM (SELECT * FROM u WHERE arm = 'small') a JOIN (SELECT * FROM u WHERE arm = 'full') b USING (metric) LEFT JOIN ci USING (metric)""".replace("{draws}", SQL_DRAWS))
def feature_set_lift(spark, d):
    """Gain of the full feature set over the small one on blocked folds, with the paired interval of F1."""
    oof = le.cross_validated(cv_rows(spark, d), "fold", CV_SETS, "y")
    out = le.lift_table(oof, "small", ["full"], "y", "grp", NB)
    return out.select("arm", "metric", *[rnd(F.col(c), 4).alias(c) for c in ("baseline", "value", "absolute_gain")], rnd(F.col("relative_gain_pct"), 2).alias("relative_gain_pct"),
                      rnd(F.col("ci_low"), 4).alias("ci_low"), rnd(F.col("ci_high"), 4).alias("ci_high"), F.col("significant").cast("int").alias("significant"), rnd(F.col("p_gain_positive"), 3).alias("p_gain_positive"))


@query("false_alarm_share", f"""WITH {SQL_SCORED}, c AS (SELECT 'base' AS arm, count(CASE WHEN pa >= 0.5 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN pa >= 0.5 AND y = 0 THEN 1 END) AS fp FROM scored UNION ALL SELECT 'full', count(CASE WHEN pb >= 0.5 AND y = 1 THEN 1 END), count(CASE WHEN pb >= 0.5 AND y = 0 THEN 1 END) FROM scored),
s AS (SELECT arm, tp, fp, fp / CAST(greatest(fp + tp, 1) AS DOUBLE) AS sh FROM c) SELECT arm, tp, fp, {r6('sh')} AS share, {r6("100 * ((SELECT sh FROM s WHERE arm = 'base') - sh) / nullif((SELECT sh FROM s WHERE arm = 'base'), 0)", 4)} AS reduction_pct FROM s""")
def false_alarm_share(spark, d):
    s = scored(spark, d)
    arms = me.confusion(s.select("y", "pa", "pb").unpivot(["y"], ["pa", "pb"], "arm", "p"), ["arm"], "y", "p").select(F.when(F.col("arm") == "pa", "base").otherwise("full").alias("arm"), "tp", "fp")
    out = me.false_alarm_share(arms, "arm", "base")
    return out.select("arm", "tp", "fp", rnd(F.col("share")).alias("share"), rnd(F.col("reduction_pct"), 4).alias("reduction_pct"))


@query("model_behaviour_tests", f"""WITH {SQL_SCORED}, q AS (SELECT {SQL_DEC} AS s FROM scored), p AS (SELECT 1 / (1 + exp(-s)) AS p FROM q), t AS (SELECT bool_and(isfinite(p)) AS a, bool_and(p BETWEEN 0 AND 1) AS b FROM p)
SELECT unnest(['predictions_finite', 'predictions_in_range', 'deterministic', 'artifact_roundtrip_identical', 'missing_features_imputed_not_nan', 'feature_schema_declared']) AS test, unnest([CAST(a AS INTEGER), CAST(b AS INTEGER), 1, 1, 1, 1]) AS passed FROM t""")
def model_behaviour_tests(spark, d):
    return le.behaviour_tests(scored(spark, d), ART).withColumn("passed", F.col("passed").cast("int"))


@query("class_cap_sample", f"WITH {SQL_SCORED} SELECT y, id FROM scored QUALIFY row_number() OVER (PARTITION BY y ORDER BY sha256(CAST(id AS VARCHAR)), id) <= 40")
def class_cap_sample(spark, d):
    return le.class_cap(scored(spark, d), "y", "id", 40).select("y", "id")


ZOO = ["x1", "x2", "x3"]


def zoo(spark, d):
    s = scored(spark, d).withColumn("target", 1 + F.col("x2") + 0.5 * F.col("x3") + F.col("id") % 5)
    return le.blocked_folds(s, "grp", CV_FOLDS).select("id", "grp", *ZOO, "target", "fold")


_CENTRED = ", ".join([f"covar_pop(z{i + 1}, z{j + 1}) * count(*) + {{a}} * {1 if i == j else 0} AS h{i}_{j}" for i in range(3) for j in range(i, 3)] + [f"covar_pop(z{i + 1}, ly) * count(*) AS g{i}" for i in range(3)])
_ZOO_FIT = lambda name, alpha: (f"SELECT '{name}' AS model, m, x0, x1, x2, my - x0 * a1 - x1 * a2 - x2 * a3 AS c FROM " + sql_solve(
    f"(SELECT m, avg(ly) AS my, avg(z1) AS a1, avg(z2) AS a2, avg(z3) AS a3, {_CENTRED.format(a=alpha)} FROM tz GROUP BY m)", 3, "m, my, a1, a2, a3"))
_ZOO_STATS = {"rmse": "sqrt(sum(t * rr) / sum(t * n))", "mae": "sum(t * ra) / sum(t * n)", "bias": "sum(t * rs) / sum(t * n)", "r2": "1 - sum(t * rr) / (sum(t * tt) - sum(t * ty) * sum(t * ty) / sum(t * n))"}


@query("model_zoo_linear", f"""WITH {SQL_SCORED}, {SQL_DRAWS}, bf AS (SELECT grp, (row_number() OVER (ORDER BY sha256(CAST(grp AS VARCHAR)), grp) - 1) % {CV_FOLDS} AS fold FROM (SELECT DISTINCT grp FROM scored)), md AS (SELECT median(x1) AS m1 FROM scored),
tg AS MATERIALIZED (SELECT id, grp, fold, coalesce(x1, m1) AS v1, x2 AS v2, x3 AS v3, log10(1 + x2 + 0.5e0 * x3 + (id % 5)) AS ly FROM scored JOIN bf USING (grp), md),
sc AS MATERIALIZED (SELECT m, {', '.join(f'avg(v{i}) AS mu{i}, stddev_pop(v{i}) AS sd{i}' for i in (1, 2, 3))} FROM generate_series(0, {CV_FOLDS - 1}) g(m) JOIN tg ON fold <> m GROUP BY m),
az AS MATERIALIZED (SELECT m, id, grp, fold, ly, {', '.join(f'(v{i} - mu{i}) / sd{i} AS z{i}' for i in (1, 2, 3))} FROM tg, sc), tz AS (SELECT * FROM az WHERE fold <> m), ft AS MATERIALIZED ({_ZOO_FIT('linear', 0)} UNION ALL {_ZOO_FIT('ridge_log10', 1)}),
pr AS (SELECT model, grp, ly, c + x0 * z1 + x1 * z2 + x2 * z3 - ly AS r FROM az JOIN ft USING (m) WHERE fold = m), gs AS MATERIALIZED (SELECT model, grp, count(*) AS n, sum(r * r) AS rr, sum(abs(r)) AS ra, sum(r) AS rs, sum(ly) AS ty, sum(ly * ly) AS tt FROM pr GROUP BY 1, 2),
fu AS (SELECT model, {', '.join(f'{e} AS {k}' for k, e in _ZOO_STATS.items())} FROM (SELECT *, 1 AS t FROM gs) GROUP BY 1), re AS (SELECT model, rep, {', '.join(f'{e} AS {k}' for k, e in _ZOO_STATS.items())} FROM dg JOIN gs USING (grp) GROUP BY 1, 2),
ci AS (SELECT model, count(*) AS n_boot, {', '.join(f'quantile_cont({k}, 0.025) AS {k}_lo, quantile_cont({k}, 0.975) AS {k}_hi' for k in _ZOO_STATS)} FROM re GROUP BY 1)
SELECT model, n_boot, {', '.join(f"{r6(k, 5)} AS {k}, {r6(f'{k}_lo', 5)} AS {k}_lo, {r6(f'{k}_hi', 5)} AS {k}_hi" for k in _ZOO_STATS)} FROM fu JOIN ci USING (model)""")
def model_zoo_linear(spark, d):
    """Grouped cross-validation of the linear and ridge regressors, intervals over whole groups."""
    wide = le.linear_zoo(zoo(spark, d), "fold", ZOO, "target")
    long = wide.select("grp", "_ly", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("_pred")) for m in ("linear", "ridge_log10")])).alias("_m")).select("grp", "_ly", "_m.*")
    out = le.zoo_report(long, "grp", NB)
    return out.select("model", "n_boot", *[rnd(F.col(c), 5).alias(c) for c in out.columns[2:]])


@query("model_zoo_cv")
def model_zoo_cv(spark, d):
    """Grouped cross-validation of five regressors with intervals (the ensembles have no SQL counterpart)."""
    out = le.zoo_report(le.model_zoo(zoo(spark, d), "fold", ZOO, "target"), "grp", NB)
    return out.select("model", "n_boot", *[rnd(F.col(c), 4).alias(c) for c in out.columns[2:]])


# Model reports per priority class, made of order statistics.
SQL_MODELS = """ms AS (SELECT o_orderpriority AS k, CASE o_custkey % 4 WHEN 0 THEN 'linear' WHEN 1 THEN 'ridge_log10' WHEN 2 THEN 'random_forest' ELSE 'gradient_boosting' END AS model, avg(o_totalprice) / 1000000 AS rmse, avg(o_totalprice) / 1000000 * 1.004e0 AS rmse_hi,
 count(*) / 2000e0 AS r2, count(*) / 2000e0 - 0.365e0 AS r2_lo FROM orders GROUP BY 1, 2)"""


def models(spark, d):
    m = F.expr("CASE o_custkey % 4 WHEN 0 THEN 'linear' WHEN 1 THEN 'ridge_log10' WHEN 2 THEN 'random_forest' ELSE 'gradient_boosting' END")
    a = F.avg("o_totalprice") / 1000000
    n = F.count(F.lit(1)) / 2000.0
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), m.alias("model")).agg(a.alias("rmse"), (a * 1.004).alias("rmse_hi"), n.alias("r2"), (n - 0.365).alias("r2_lo"))


SQL_SELECT = "sl AS (SELECT m.* FROM ms m JOIN (SELECT k, arg_min(rmse_hi, rmse) AS hi FROM ms GROUP BY 1) USING (k) WHERE rmse <= hi QUALIFY row_number() OVER (PARTITION BY k ORDER BY list_position(['linear', 'ridge_log10', 'random_forest', 'gradient_boosting'], model)) = 1)"


@query("select_parsimonious", f"WITH {SQL_MODELS}, {SQL_SELECT} SELECT k, model, {r6('rmse')} AS rmse FROM sl")
def select_parsimonious(spark, d):
    return me.select_parsimonious(models(spark, d), ["k"]).select("k", "model", rnd(F.col("rmse")).alias("rmse"))


@query("calibration_verdict", f"""WITH {SQL_MODELS}, {SQL_SELECT}, n AS (SELECT o_orderpriority AS k, count(DISTINCT o_custkey % 3) AS g FROM orders GROUP BY 1) SELECT k, array_to_string(list_filter([CASE WHEN g < 5 THEN 'too few groups' END, CASE WHEN NOT r2 >= 0.4 THEN 'skill below threshold' WHEN NOT r2_lo > 0 THEN 'R2 interval includes zero' END], lambda z: z IS NOT NULL), '; ') AS reasons,
'PROXY' AS quantity_kind FROM sl JOIN n USING (k)""")
def calibration_verdict(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.countDistinct(F.col("o_custkey") % 3).alias("g"), F.count(F.lit(1)).alias("n"))
    j = me.select_parsimonious(models(spark, d), ["k"]).join(g, "k")
    r = me.calibration_verdict(F.col("n"), F.col("g"), F.col("r2"), F.col("r2_lo"))
    return j.select("k", F.array_join(r, "; ").alias("reasons"), F.when(F.size(r) == 0, "CALIBRATED").otherwise("PROXY").alias("quantity_kind"))


_HASHED = lambda src: f"(SELECT count(*) || ':' || sum(CAST(CAST('0x' || substr(sha256(concat_ws('|', CAST(id AS VARCHAR), CAST(y AS VARCHAR), grp)), 1, 15) AS BIGINT) AS HUGEINT)) FROM {src})"
_NUMBERS = ("candidate", "production", "ci_low", "ci_high")


def gate_rows(out, name):
    return out.select(F.lit(name).alias("gate"), "check", F.col("passed").cast("int").alias("passed"), "metric", *[rnd(F.col(c), 5).alias(c) for c in _NUMBERS], "n", "n_failed", F.col("gate_passed").cast("int").alias("gate_passed"))


def _sql_gate(name, cand, prod, frozen):
    """The six checks of one triage gate over ``scored``."""
    sub = f"(SELECT x.auprc AS c, z.auprc AS p, n, both_ FROM ({sql_ap(cand)}) x JOIN ({sql_ap(prod)}) z USING (sub) JOIN (SELECT sub, count(*) AS n, count(DISTINCT y) = 2 AS both_ FROM scored GROUP BY 1) USING (sub))"
    one = lambda q: q.replace("FROM scored", "FROM (SELECT *, 1 AS one FROM scored)")                             # noqa: E731
    return f"""SELECT '{name}' AS gate, unnest(['model_test_suite', 'validation_dataset_unchanged', 'validation_has_both_classes', 'primary_metric_not_worse', 'calibration_acceptable', 'no_subgroup_regression']) AS "check",
unnest([true, {_HASHED(frozen)} = {_HASHED('scored')}, nc = 2, cap >= pap, cece <= 0.15 OR cb <= pb_, nr = 0]) AS ok, unnest([NULL, NULL, NULL, 'auprc', 'brier', NULL]) AS metric, unnest([NULL, NULL, NULL, cap, cb, NULL]) AS candidate, unnest([NULL, NULL, NULL, pap, pb_, NULL]) AS production,
unnest([NULL, NULL, NULL, lo, NULL, NULL]) AS ci_low, unnest([NULL, NULL, NULL, hi, NULL, NULL]) AS ci_high, unnest([NULL, NULL, rows_, rows_, NULL, ns]) AS n, unnest([NULL, NULL, np, NULL, NULL, nr]) AS n_failed
FROM (SELECT (SELECT auprc FROM ({one(sql_ap(cand, 'one'))})) AS cap, (SELECT auprc FROM ({one(sql_ap(prod, 'one'))})) AS pap, (SELECT ece FROM ({one(sql_ece(cand, 'one'))})) AS cece, (SELECT avg(pow({cand} - y, 2)) FROM scored) AS cb, (SELECT avg(pow({prod} - y, 2)) FROM scored) AS pb_, (SELECT count(DISTINCT y) FROM scored) AS nc,
 (SELECT count(*) FROM scored) AS rows_, (SELECT count(CASE WHEN y = 1 THEN 1 END) FROM scored) AS np, (SELECT count(*) FROM {sub} WHERE n >= 5 AND both_) AS ns, (SELECT count(*) FROM {sub} WHERE n >= 5 AND both_ AND c < p - 0.05) AS nr,
 (SELECT quantile_cont(b.ap - a.ap, 0.025) FROM {_sql_boot_ap(prod)} a JOIN {_sql_boot_ap(cand)} b USING (rep)) AS lo, (SELECT quantile_cont(b.ap - a.ap, 0.975) FROM {_sql_boot_ap(prod)} a JOIN {_sql_boot_ap(cand)} b USING (rep)) AS hi)"""


@query("promotion_gate", f"""WITH {SQL_SCORED}, {SQL_DRAWS}, changed AS (SELECT * FROM scored WHERE id % 7 <> 0), k AS MATERIALIZED ({_sql_gate('better', 'pb', 'pa', 'scored')} UNION ALL {_sql_gate('worse, rows changed', 'pa', 'pb', 'changed')})
SELECT gate, "check", CAST(ok AS INTEGER) AS passed, metric, {', '.join(f"{r6(c, 5)} AS {c}" for c in _NUMBERS)}, CAST(n AS BIGINT) AS n, CAST(n_failed AS BIGINT) AS n_failed, CAST(bool_and(ok) OVER (PARTITION BY gate) AS INTEGER) AS gate_passed FROM k""")
def promotion_gate(spark, d):
    """A candidate that passes and one that fails, each with the numbers behind every check."""
    s = scored(spark, d)
    stamp = lambda rows: F.lit(le.dataset_hash(rows, [], ["id", "y", "grp"]).first()["dataset_hash"])              # noqa: E731
    now, old = stamp(s), stamp(s.where("id % 7 <> 0"))
    good = me.promotion_gate(s, "y", "pb", "pa", "sub", now, now, F.lit(True), group="grp", n_boot=NB)
    bad = me.promotion_gate(s, "y", "pa", "pb", "sub", old, now, F.lit(True), group="grp", n_boot=NB)
    return gate_rows(good, "better").unionByName(gate_rows(bad, "worse, rows changed"))


@query("promotion_gate_regression", f"""WITH {SQL_SCORED}, {SQL_DRAWS}, rg AS MATERIALIZED (SELECT grp, log10(1 + x2) AS ly, log10(1 + x2 + (id % 4) * 0.3e0) - log10(1 + x2) AS ec, log10((1 + x2) * 1.6e0) - log10(1 + x2) AS ep FROM scored), gs AS (SELECT grp, count(*) AS n, sum(ep * ep) AS a, sum(ec * ec) AS b FROM rg GROUP BY 1),
bt AS (SELECT sqrt(sum(t * a) / sum(t * n)) - sqrt(sum(t * b) / sum(t * n)) AS df FROM dg JOIN gs USING (grp) GROUP BY rep), v AS (SELECT sqrt(avg(ec * ec)) AS c, sqrt(avg(ep * ep)) AS p, avg(ec) AS bc, avg(ep) AS bp, count(*) AS rows_, (SELECT quantile_cont(df, 0.025) FROM bt) AS lo, (SELECT quantile_cont(df, 0.975) FROM bt) AS hi FROM rg),
k AS (SELECT unnest(['model_test_suite', 'validation_dataset_unchanged', 'primary_metric_not_worse', 'calibration_acceptable', 'no_subgroup_regression']) AS "check", unnest([true, true, c <= p, abs(bc) <= 0.1, true]) AS ok, unnest([NULL, NULL, 'rmse_log10', 'bias_log10', NULL]) AS metric, unnest([NULL, NULL, c, bc, NULL]) AS candidate,
 unnest([NULL, NULL, p, bp, NULL]) AS production, unnest([NULL, NULL, lo, NULL, NULL]) AS ci_low, unnest([NULL, NULL, hi, NULL, NULL]) AS ci_high, unnest([NULL, NULL, rows_, NULL, NULL]) AS n FROM v)
SELECT 'regression' AS gate, "check", CAST(ok AS INTEGER) AS passed, metric, {', '.join(f"{r6(c, 5)} AS {c}" for c in _NUMBERS)}, CAST(n AS BIGINT) AS n, CAST(NULL AS BIGINT) AS n_failed, CAST((SELECT bool_and(ok) FROM k) AS INTEGER) AS gate_passed FROM k""")
def promotion_gate_regression(spark, d):
    s = scored(spark, d).withColumns({"t": 1 + F.col("x2"), "c": 1 + F.col("x2") + (F.col("id") % 4) * 0.3, "p": (1 + F.col("x2")) * 1.6})
    stamp = F.lit(le.dataset_hash(s, [], ["id", "t"]).first()["dataset_hash"])
    return gate_rows(me.regression_gate(s, "t", "c", "p", stamp, stamp, F.lit(True), group="grp", n_boot=NB), "regression")


@query("model_version_next", """WITH v AS (SELECT o_orderpriority AS task, o_custkey % 3 AS a, o_orderkey % 14 AS b, o_custkey % 5 AS c FROM orders), m AS (SELECT task, max((a, b, c)) AS v FROM v GROUP BY 1)
SELECT task, concat_ws('.', v[1], v[2], v[3]) AS current, concat_ws('.', v[1], v[2] + 1, 0) AS next_version FROM m""")
def model_version_next(spark, d):
    v = table(spark, d, "orders").select(F.col("o_orderpriority").alias("task"), F.concat_ws(".", (F.col("o_custkey") % 3).cast("string"), (F.col("o_orderkey") % 14).cast("string"), (F.col("o_custkey") % 5).cast("string")).alias("version"))
    return le.next_version(v, "task", "version")


@query("dataset_hash", f"""WITH {SQL_SCORED}, h AS (SELECT sub, sha256(concat_ws('|', CAST(id AS VARCHAR), CAST(y AS VARCHAR), grp)) AS h FROM scored), s AS (SELECT sub, count(*) AS n, {', '.join(f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS l{i}" for i in range(4))} FROM h GROUP BY 1)
SELECT sub, n, substr(sha256(concat_ws(':', CAST(n AS VARCHAR), l0, l1, l2, l3)), 1, 16) AS dataset_hash FROM s""")
def dataset_hash(spark, d):
    return le.dataset_hash(scored(spark, d), ["sub"], ["id", "y", "grp"])
