"""Queries of the scoring rules and workflow tables (orders stand in for incidents and reviews)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import workflow as wf
from tidemark.plans.base import query, r6
from tidemark.plans.learn import SQL_SCORED as SQL_LABEL_SCORES
from tidemark.plans.learn import sql_ap
from tidemark.plans.learn import scored as label_scores
from tidemark.sources.tables import table


def rnd(c, digits=6):
    return F.round(c, digits)


def pick(values, expr):
    """One of a list by a number expression, as text both engines read."""
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN " + (f"'{v}'" if v is not None else "NULL") for i, v in enumerate(values)) + " END"


# Input columns of one case per order; plain arithmetic shared by both sides.
CASE_COLUMNS = {
    "id": "o_orderkey", "area_km2": "o_totalprice / 45000e0", "anomaly_pct": "CASE WHEN o_orderkey % 7 <> 0 THEN (o_custkey * 13) % 101 * 1e0 END",
    "magnitude": "CASE WHEN o_orderkey % 3 <> 0 THEN 1e0 + (o_orderkey % 40) / 10e0 END", "hist": "CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey * 29 + o_orderkey) % 101 * 1e0 END",
    "growth": "CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 9 - 2) * 0.1e0 END", "valid": "(o_custkey % 11) / 10e0", "cloud": "(o_orderkey % 13) / 12e0",
    "n_px": "CASE WHEN o_orderkey % 19 <> 0 THEN (o_custkey * 7) % 900 END", "snr": "CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 45) * 1e0 END", "margin": "(o_orderkey % 21) / 20e0",
    "agreement": "CASE WHEN o_orderkey % 2 = 1 THEN (o_custkey % 4) / 3e0 END", "days": "(o_orderkey % 10) * 1e0", "bottom": "CASE WHEN o_orderkey % 8 <> 0 THEN (o_orderkey % 5) / 4e0 END",
    "in_situ": "o_orderkey % 17 = 0", "exposure": "(o_custkey % 100) / 100e0", "eta": "CASE WHEN o_orderkey % 3 <> 1 THEN (o_orderkey % 60) * 1e0 END"}
SQL_CASES = "cases AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in CASE_COLUMNS.items()) + " FROM orders)"


def cases(spark, d):
    return table(spark, d, "orders").selectExpr(*[f"{v} AS {k}" for k, v in CASE_COLUMNS.items()])


def sql_weighted(parts):
    num = " + ".join(f"coalesce(({e}) * {w}, 0)" for e, w in parts)
    den = " + ".join(f"CASE WHEN ({e}) IS NOT NULL THEN {w}e0 ELSE 0 END" for e, w in parts)
    return f"({num}) / nullif({den}, 0)"


def sql_clip(e):
    return f"CASE WHEN ({e}) IS NOT NULL THEN least(greatest({e}, 0), 1) END"


SQL_SEV = sql_weighted([(sql_clip("area_km2 / 10"), 0.20), (sql_clip("anomaly_pct / 100"), 0.25), (sql_clip("(magnitude - 1) / 4"), 0.20), (sql_clip("hist / 100"), 0.30), (sql_clip("growth / 0.5"), 0.15)])
SQL_CONF0 = sql_weighted([(sql_clip("valid"), 0.20), (sql_clip("1 - cloud"), 0.15), (sql_clip("log10(CASE WHEN n_px IS NOT NULL THEN greatest(n_px, 1) END) / log10(500)"), 0.15), (sql_clip("snr / 30"), 0.20), (sql_clip("margin"), 0.15),
                          (sql_clip("agreement"), 0.15), (sql_clip("1 - days / 7"), 0.10), (sql_clip("1 - bottom"), 0.20)])
SQL_SCORED = f"sc AS (SELECT *, {SQL_SEV} AS sev, CASE WHEN NOT in_situ THEN least({SQL_CONF0}, 0.75) ELSE {SQL_CONF0} END AS conf FROM cases)"


def scored(spark, d):
    c = cases(spark, d)
    sev = wf.severity(*[F.col(x) for x in ("area_km2", "anomaly_pct", "magnitude", "hist", "growth")])
    conf = wf.confidence(*[F.col(x) for x in ("valid", "cloud", "n_px", "snr", "margin", "agreement", "days", "bottom", "in_situ")])
    return c.withColumns({"sev": sev, "conf": conf})


@query("weighted_mean_present", f"WITH {SQL_CASES} SELECT id, {r6(sql_weighted([('hist', 0.3), ('snr', 0.2), ('growth', 0.15)]))} AS score FROM cases")
def weighted_mean_present(spark, d):
    w = {"hist": 0.3, "snr": 0.2, "growth": 0.15}
    return cases(spark, d).select("id", rnd(wf.weighted_mean({k: F.col(k) for k in w}, w)).alias("score"))


@query("severity", f"WITH {SQL_CASES}, {SQL_SCORED} SELECT id, {r6('sev')} AS severity FROM sc")
def severity(spark, d):
    return scored(spark, d).select("id", rnd(F.col("sev")).alias("severity"))


@query("confidence", f"WITH {SQL_CASES}, {SQL_SCORED} SELECT id, {r6('conf')} AS confidence FROM sc")
def confidence(spark, d):
    return scored(spark, d).select("id", rnd(F.col("conf")).alias("confidence"))


SQL_RULES = """ru AS (SELECT *, [CASE WHEN sev >= 0.35 THEN 'severity_watch' END, CASE WHEN sev >= 0.55 THEN 'severity_investigate' END, CASE WHEN exposure >= 0.3 THEN 'asset_exposed' END, CASE WHEN exposure >= 0.5 AND sev >= 0.3 THEN 'moderate_event_exposed_asset' END,
CASE WHEN eta <= 24 AND exposure >= 0.4 THEN 'drift_reaches_asset' END, CASE WHEN sev >= 0.7 AND exposure >= 0.4 THEN 'severe_and_exposed' END, CASE WHEN sev >= 0.5 AND conf < 0.45 THEN 'uncertain_but_significant' END, CASE WHEN sev < 0.35 AND exposure < 0.3 THEN 'below_thresholds' END] AS f,
CASE WHEN (eta <= 24 AND exposure >= 0.4) OR (sev >= 0.7 AND exposure >= 0.4) THEN 3 WHEN sev >= 0.55 OR (exposure >= 0.5 AND sev >= 0.3) OR (sev >= 0.5 AND conf < 0.45) THEN 2 WHEN sev >= 0.35 OR exposure >= 0.3 THEN 1 ELSE 0 END AS lv,
CASE WHEN exposure >= 0.5 THEN 1 ELSE 0 END AS cap FROM sc), rv AS (SELECT *, coalesce(hist <= 50, false) AND cap < lv AS veto FROM ru)"""


@query("priority_rules", f"""WITH {SQL_CASES}, {SQL_SCORED}, {SQL_RULES} SELECT id, (['NORMAL', 'WATCH', 'INVESTIGATE', 'HIGH_PRIORITY'])[CASE WHEN veto THEN cap ELSE lv END + 1] AS priority, CAST(veto AS INTEGER) AS vetoed,
array_to_string(list_filter(f, lambda z: z IS NOT NULL), ',') AS rules_fired, CASE WHEN veto THEN 'temporal_veto' ELSE list_filter(list_zip(f, [1, 2, 1, 2, 3, 3, 2, 0]), lambda z: z[1] IS NOT NULL AND z[2] = lv)[1][1] END AS reason FROM rv""")
def priority_rules(spark, d):
    out = wf.priority(scored(spark, d), "sev", "conf", "exposure", "eta", "hist")
    return out.select("id", "priority", F.col("vetoed").cast("int").alias("vetoed"), F.array_join("rules_fired", ",").alias("rules_fired"), "reason")


BEFORE = pick([*wf.STATES, "ARCHIVED"], "o_orderkey % 8")
DECIDE = pick([*wf.DECISIONS, "SHRUG"], "o_custkey % 6")
_VALID = ", ".join(str(r) for r in wf.REVIEW_TABLE)
SQL_REVIEWS = f"""rv AS (SELECT o_orderkey AS review_id, o_custkey AS incident_id, CAST(o_orderdate AS DATE) AS d, {BEFORE} AS status_before, {DECIDE} AS decision FROM orders), allowed(status_before, decision, status_after) AS (VALUES {_VALID})"""


def reviews(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS review_id", "o_custkey AS incident_id", "to_date(o_orderdate) AS d", f"{BEFORE} AS status_before", f"{DECIDE} AS decision", "o_orderkey")


@query("review_transition_check", f"""WITH {SQL_REVIEWS} SELECT review_id, status_before, decision, status_after, CASE WHEN status_before = 'ARCHIVED' THEN 'unknown status' WHEN decision = 'SHRUG' THEN 'unknown decision' WHEN status_after IS NULL THEN 'not allowed' END AS problem
FROM rv LEFT JOIN allowed USING (status_before, decision)""")
def review_transition_check(spark, d):
    return wf.check_transitions(reviews(spark, d)).select("review_id", "status_before", "decision", "status_after", "problem")


@query("replay_status", f"""WITH {SQL_REVIEWS}, r AS (SELECT * FROM rv JOIN allowed USING (status_before, decision)), l AS (SELECT *, lag(status_after) OVER (PARTITION BY incident_id ORDER BY d, review_id) AS p FROM r)
SELECT incident_id, count(*) AS n_reviews, arg_max(status_after, (d, review_id)) AS final_status, count(CASE WHEN p <> status_before THEN 1 END) AS n_breaks FROM l GROUP BY 1""")
def replay_status(spark, d):
    ok = wf.check_transitions(reviews(spark, d)).where(F.col("problem").isNull())
    return wf.replay(ok, ["incident_id"], ["d", "review_id"], F.year("d"))


HYPS = list(wf.EVENT_TYPES)
SQL_LBL = f"""lb AS (SELECT o_orderkey AS label_id, CASE WHEN o_orderkey % 2 = 0 THEN 'triage' ELSE 'quantify' END AS task, o_custkey AS incident_id, CAST(o_orderdate AS DATE) AS d, {pick(wf.DECISIONS, 'o_custkey % 5')} AS decision, {pick(HYPS, 'o_orderkey % 8')} AS prev,
CASE WHEN o_orderkey % 3 = 0 THEN {pick(HYPS, 'o_custkey % 8')} END AS new_, {pick(['field_measurement', 'in_situ_archive', 'analyst_review', 'cross_sensor_reference', 'other'], 'o_orderkey % 5')} AS source, CASE WHEN o_custkey % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM orders),
ll AS (SELECT *, CASE decision WHEN 'CONFIRM' THEN 1 WHEN 'FALSE_POSITIVE' THEN 0 END AS y, CASE decision WHEN 'CONFIRM' THEN coalesce(new_, prev) WHEN 'FALSE_POSITIVE' THEN coalesce(new_, 'FALSE_POSITIVE') WHEN 'RECLASSIFY' THEN new_ END AS class,
CASE source WHEN 'field_measurement' THEN 2e0 WHEN 'in_situ_archive' THEN 2e0 WHEN 'cross_sensor_reference' THEN 0.5e0 ELSE 1e0 END AS weight FROM lb)"""


def label_rows(spark, d):
    src = ["field_measurement", "in_situ_archive", "analyst_review", "cross_sensor_reference", "other"]
    r = table(spark, d, "orders").selectExpr(
        "o_orderkey AS label_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'triage' ELSE 'quantify' END AS task", "o_custkey AS incident_id", "to_date(o_orderdate) AS d", f"{pick(wf.DECISIONS, 'o_custkey % 5')} AS decision",
        f"{pick(HYPS, 'o_orderkey % 8')} AS prev", f"CASE WHEN o_orderkey % 3 = 0 THEN {pick(HYPS, 'o_custkey % 8')} END AS new_hyp", f"{pick(src, 'o_orderkey % 5')} AS source", "CASE WHEN o_custkey % 5 = 0 THEN 'validation' ELSE 'train' END AS split")
    lab = wf.label_of(F.col("decision"), F.col("prev"), F.col("new_hyp"))
    return r.withColumns({**lab, "weight": wf.source_weight(F.col("source"))})


@query("label_from_review", f"WITH {SQL_LBL} SELECT label_id, y, class, weight FROM ll WHERE y IS NOT NULL OR class IS NOT NULL")
def label_from_review(spark, d):
    return label_rows(spark, d).where(F.col("y").isNotNull() | F.col("class").isNotNull()).select("label_id", "y", "class", "weight")


SQL_ACTIVE = "act AS (SELECT * FROM ll WHERE y IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task, incident_id ORDER BY d DESC, label_id DESC) = 1)"


def active(spark, d):
    return wf.active_labels(label_rows(spark, d).where(F.col("y").isNotNull()), ["d", "label_id"])


@query("active_labels", f"WITH {SQL_LBL}, {SQL_ACTIVE} SELECT task, incident_id, label_id, y, class FROM act")
def active_labels(spark, d):
    return active(spark, d).select("task", "incident_id", "label_id", "y", "class")


@query("label_summary", f"WITH {SQL_LBL}, {SQL_ACTIVE} SELECT task, source, split, count(*) AS n FROM act GROUP BY 1, 2, 3")
def label_summary(spark, d):
    return wf.label_summary(active(spark, d))


SQL_INC = f"""inc AS (SELECT c_custkey AS incident_id, {pick(wf.STATES, 'c_custkey % 7')} AS status, CASE WHEN c_custkey % 9 = 0 THEN 'negative_control' ELSE 'operational' END AS role, c_nationkey AS aoi FROM customer)"""


def incidents(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey AS incident_id", f"{pick(wf.STATES, 'c_custkey % 7')} AS status", "CASE WHEN c_custkey % 9 = 0 THEN 'negative_control' ELSE 'operational' END AS role", "c_nationkey AS aoi",
                                                 "c_acctbal AS observation_time")


@query("incident_list", f"WITH {SQL_INC} SELECT incident_id, status, aoi FROM inc WHERE status = 'UNDER_REVIEW' AND role = 'operational'")
def incident_list(spark, d):
    return wf.incident_list(incidents(spark, d), "UNDER_REVIEW", False).select("incident_id", "status", "aoi")


REC_COLUMNS = {"id": "o_orderkey", "status": pick(wf.STATES, "o_custkey % 7"), "role": "CASE WHEN o_orderkey % 11 = 0 THEN 'negative_control' ELSE 'operational' END", "pct": "CASE WHEN o_orderkey % 6 <> 0 THEN 40e0 + (o_orderkey * 7) % 61 END",
               "severity": "CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey % 90) / 90e0 END", "has_field": "o_custkey % 4 = 0", "top_exposure": "(o_orderkey % 80) / 100e0",
               "rx_pct": "CASE WHEN o_orderkey % 3 = 0 THEN 1e0 * (o_custkey % 100) END", "confidence": "CASE WHEN o_orderkey % 7 <> 0 THEN (o_custkey % 75) / 100e0 END",
               "nearest_name": "CASE WHEN o_orderkey % 4 <> 1 THEN concat('Intake ', CAST(o_custkey % 9 AS VARCHAR(9))) END", "nearest_m": "100e0 * (o_custkey % 400)"}
AGREEING = "CASE o_orderkey % 3 WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END"
SQL_RECS = "rc AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in REC_COLUMNS.items()) + f", {AGREEING.format('[]', repr(['sentinel2']), repr(['sentinel2', 'landsat']))} AS agreeing, o_orderdate AS obs FROM orders)"


def rec_rows(spark, d):
    names = AGREEING.format("array()", "array('sentinel2')", "array('sentinel2', 'landsat')")
    return table(spark, d, "orders").selectExpr(*[f"{v} AS {k}" for k, v in REC_COLUMNS.items()], f"{names} AS agreeing", "cast(o_orderdate as timestamp_ntz) AS observation_time")


def _q(text):
    return "'" + text.replace("'", "''") + "'"


def sql_recommend(src):
    """CTEs ra, rb: action, level, reasons, needed and deadline of every row of ``src`` (rc's columns)."""
    ordinal = lambda c: f"CAST(CAST(round_even({c}, 0) AS BIGINT) AS VARCHAR) || 'th'"                                    # noqa: E731
    lists = lambda items: "[" + ", ".join(_q(x) for x in items) + "]"                                                   # noqa: E731
    return f"""ra AS (SELECT *, CASE WHEN status IN ('FALSE_POSITIVE', 'RESOLVED') THEN 'NO_ACTION' WHEN role = 'negative_control' OR pct <= 50 THEN 'STAND_DOWN_CONTINUE_MONITORING' WHEN status = 'CONFIRMED' AND has_field THEN 'MANAGE_CONFIRMED_EVENT'
WHEN NOT has_field AND (coalesce(pct, 0) >= 90 OR coalesce(severity, 0) >= 0.5) THEN 'FIELD_VERIFICATION' ELSE 'ANALYST_REVIEW' END AS action,
list_filter([CASE WHEN pct IS NOT NULL THEN 'Main indicator at the ' || {ordinal('pct')} || ' percentile for this place and season.' END, CASE WHEN rx_pct IS NOT NULL THEN 'Stands out from the surrounding water (' || {ordinal('rx_pct')} || ' percentile).' END,
 CASE WHEN len(agreeing) > 0 THEN len(agreeing) || ' satellite source(s) agree: ' || array_to_string(agreeing, ', ') || '.' END, CASE WHEN confidence IS NOT NULL THEN 'Model confidence ' || printf('%.2f', confidence) || '.' END,
 CASE WHEN NOT has_field THEN 'No water sample yet.' END, CASE WHEN nearest_name IS NOT NULL THEN 'Nearest asset: ' || nearest_name || ', ' || printf('%.1f', nearest_m / 1000) || ' km away.' END], lambda x: x IS NOT NULL) AS listed FROM {src}),
rb AS (SELECT *, CASE action WHEN 'NO_ACTION' THEN 'NONE' WHEN 'STAND_DOWN_CONTINUE_MONITORING' THEN 'LOW' WHEN 'MANAGE_CONFIRMED_EVENT' THEN 'HIGH' WHEN 'FIELD_VERIFICATION' THEN CASE WHEN top_exposure >= 0.5 OR coalesce(pct, 0) >= 97 THEN 'HIGH' ELSE 'MEDIUM' END ELSE 'MEDIUM' END AS action_priority,
CASE action WHEN 'NO_ACTION' THEN ['Incident closed.'] WHEN 'STAND_DOWN_CONTINUE_MONITORING' THEN list_concat(listed, {lists([wf.NORMAL_HERE])}) ELSE listed END AS reasons,
CASE action {' '.join(f"WHEN '{k}' THEN {lists(v) if v else 'CAST([] AS VARCHAR[])'}" for k, v in wf.NEEDED.items())} END AS needed,
CASE WHEN action <> 'NO_ACTION' THEN strftime(obs + CASE WHEN coalesce(severity, 0) >= 0.6 OR coalesce(top_exposure, 0) >= 0.5 THEN INTERVAL 24 HOUR ELSE INTERVAL 72 HOUR END, '%Y-%m-%d %H:%M:%S') END AS deadline FROM ra)"""


@query("recommend", f"""WITH {SQL_RECS}, {sql_recommend('rc')} SELECT id, action, action_priority, array_to_string(reasons, ' | ') AS reasons, array_to_string(needed, ' | ') AS evidence_needed, deadline, 2 AS n_not_recommended FROM rb""")
def recommend(spark, d):
    out = wf.recommend(rec_rows(spark, d))
    return out.select("id", "action", "action_priority", F.array_join("reasons", " | ").alias("reasons"), F.array_join("evidence_needed", " | ").alias("evidence_needed"),
                      F.date_format("decision_deadline", "yyyy-MM-dd HH:mm:ss").alias("deadline"), F.size("not_recommended").alias("n_not_recommended"))


DETAIL_PAGE = 12
DETAIL_COLUMNS = {"pct": "CASE WHEN c_custkey % 6 <> 0 THEN 40e0 + (c_custkey * 7) % 61 END", "severity": "CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 90) / 90e0 END", "top_exposure": "(c_custkey % 80) / 100e0",
                  "rx_pct": "CASE WHEN c_custkey % 3 = 0 THEN 1e0 * (c_custkey % 100) END", "confidence": "(c_custkey % 75) / 100e0", "nearest_name": "CASE WHEN c_custkey % 4 <> 1 THEN concat('Intake ', CAST(c_custkey % 9 AS VARCHAR(9))) END",
                  "nearest_m": "100e0 * (c_custkey % 400)"}
SAMPLE_STATUS = "CASE WHEN l_linenumber = 7 THEN 'REMOVED' WHEN l_linenumber = 3 THEN 'RESULT_RECEIVED' ELSE 'PLANNED' END"
_KINDS = {"reviews": ("rv", "strftime(created_at, '%Y-%m-%d') || ':' || review_id || ':' || decision", "created_at, review_id", "strftime(created_at, '%Y-%m-%d') || ':' || review_id"), "samples": ("sm", "code || ':' || status", "code", "code"),
          "measurements": ("ms", "measurement_id || ':' || round(value, 2)", "entered_at, measurement_id", "CAST(measurement_id AS VARCHAR)"), "predictions": ("pd", "prediction_id || ':' || model", "prediction_id", "CAST(prediction_id AS VARCHAR)")}


@query("incident_detail", f"""WITH {SQL_INC}, iw AS (SELECT inc.*, {', '.join(f'{v} AS {k}' for k, v in DETAIL_COLUMNS.items())}, ['sentinel2'] AS agreeing, TIMESTAMP '2024-01-05 06:00:00' + CAST(c_custkey % 20 AS INTEGER) * INTERVAL 1 DAY AS obs FROM inc JOIN customer ON c_custkey = incident_id),
rv AS MATERIALIZED (SELECT o_custkey AS incident_id, o_orderkey AS review_id, o_orderdate AS created_at, {DECIDE} AS decision FROM orders), sm AS MATERIALIZED (SELECT DISTINCT o_custkey AS incident_id, lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || l_linenumber AS code, {SAMPLE_STATUS} AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <> 7),
ms AS MATERIALIZED (SELECT user_id AS incident_id, event_id AS measurement_id, ts AS entered_at, value FROM events), pd AS MATERIALIZED (SELECT o_custkey AS incident_id, o_orderkey AS prediction_id, 'triage-' || (o_orderkey % 3) AS model FROM orders WHERE o_orderkey % 2 = 0),
{', '.join(f"c_{k} AS MATERIALIZED (SELECT incident_id, any_value(n) AS n, string_agg(x, ', ' ORDER BY r) FILTER (WHERE r <= {DETAIL_PAGE}) AS rows, max(CASE WHEN n > {DETAIL_PAGE} AND r = {DETAIL_PAGE} THEN key END) AS next FROM (SELECT incident_id, {x} AS x, {key} AS key, row_number() OVER (PARTITION BY incident_id ORDER BY {o}) AS r, count(*) OVER (PARTITION BY incident_id) AS n FROM {t}) GROUP BY 1)" for k, (t, x, o, key) in _KINDS.items())},
rc AS (SELECT iw.*, coalesce(c_measurements.n, 0) > 0 AS has_field FROM iw LEFT JOIN c_measurements USING (incident_id)), {sql_recommend('rc')}
SELECT incident_id, status, {', '.join(f"coalesce(c_{k}.n, 0) AS n_{k}, coalesce(c_{k}.rows, '') AS {k}, c_{k}.next AS next_{k}" for k in _KINDS)}, ld AS last_decision, coalesce(nr, 0) AS n_results, {r6('mv')} AS mean_value, action, action_priority, array_to_string(reasons, ' | ') AS reasons, array_to_string(needed, ' | ') AS evidence_needed, deadline
FROM rb {' '.join(f'LEFT JOIN c_{k} USING (incident_id)' for k in _KINDS)} LEFT JOIN (SELECT incident_id, arg_max(decision, (created_at, review_id)) AS ld FROM rv GROUP BY 1) USING (incident_id) LEFT JOIN (SELECT incident_id, count(CASE WHEN status = 'RESULT_RECEIVED' THEN 1 END) AS nr FROM sm GROUP BY 1) USING (incident_id)
LEFT JOIN (SELECT incident_id, avg(value) AS mv FROM ms GROUP BY 1) USING (incident_id)""")
def incident_detail(spark, d):
    """Incidents with a page of each kind of children and the recommendation."""
    r = table(spark, d, "orders").selectExpr("o_custkey AS incident_id", "o_orderkey AS review_id", "o_orderdate AS created_at", f"{DECIDE} AS decision")
    li = table(spark, d, "lineitem").selectExpr("l_orderkey AS review_id", "concat(lpad(cast(l_orderkey as string), 9, '0'), '-', l_linenumber) AS code", f"{SAMPLE_STATUS} AS status")
    s = li.join(r.select("incident_id", "review_id"), "review_id").drop("review_id").distinct()
    m = table(spark, d, "events").selectExpr("user_id AS incident_id", "event_id AS measurement_id", "ts AS entered_at", "value")
    p = table(spark, d, "orders").where("o_orderkey % 2 = 0").selectExpr("o_custkey AS incident_id", "o_orderkey AS prediction_id", "concat('triage-', o_orderkey % 3) AS model")
    more = table(spark, d, "customer").selectExpr("c_custkey AS incident_id", *[f"{v} AS {k}" for k, v in DETAIL_COLUMNS.items()], "array('sentinel2') AS agreeing",
                                                 "timestamp_ntz'2024-01-05 06:00:00' + make_dt_interval(cast(c_custkey % 20 as int)) AS observation_time")
    out = wf.incident_detail(incidents(spark, d).drop("observation_time").join(more, "incident_id"), r, s, m, p, DETAIL_PAGE)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")                                                                      # noqa: E731
    text = {"reviews": lambda x: F.concat_ws(":", day(x["created_at"]), x["review_id"].cast("string"), x["decision"]), "samples": lambda x: F.concat_ws(":", x["code"], x["status"]),
            "measurements": lambda x: F.concat_ws(":", x["measurement_id"].cast("string"), F.round(x["value"], 2).cast("string")), "predictions": lambda x: F.concat_ws(":", x["prediction_id"].cast("string"), x["model"])}
    key = {"reviews": F.concat_ws(":", day(F.col("next_reviews.created_at")), F.col("next_reviews.review_id").cast("string")), "samples": F.col("next_samples.code"), "measurements": F.col("next_measurements.measurement_id").cast("string"),
           "predictions": F.col("next_predictions.prediction_id").cast("string")}
    return out.select("incident_id", "status", *[c for k in text for c in (F.col(f"n_{k}"), F.coalesce(F.array_join(F.transform(k, text[k]), ", "), F.lit("")).alias(k), F.when(F.col(f"next_{k}").isNotNull(), key[k]).alias(f"next_{k}"))],
                      "last_decision", "n_results", rnd(F.col("mean_value")).alias("mean_value"), "recommendation.action", "recommendation.action_priority", F.array_join("recommendation.reasons", " | ").alias("reasons"),
                      F.array_join("recommendation.evidence_needed", " | ").alias("evidence_needed"), F.date_format("recommendation.decision_deadline", "yyyy-MM-dd HH:mm:ss").alias("deadline"))


SQL_TEXT = f"CASE {{}} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in wf.EVENT_TYPES.items()) + " ELSE 'Water anomaly' END"
ETYPE = pick([*HYPS, "OTHER"], "o_custkey % 9")


@query("alert_message", f"""WITH q AS (SELECT o_orderkey AS id, 'AOI-' || CAST(o_custkey % 10 AS VARCHAR) AS area, {ETYPE} AS et, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey % 101 END AS pct, o_orderkey % 3 AS na FROM orders)
SELECT id, concat_ws(' ', 'Unusual water spotted near ' || area || '.', 'Suspected: ' || {SQL_TEXT.format('et')} || '.', CAST(pct AS VARCHAR) || 'th percentile for this season.', CASE WHEN na > 1 THEN 'A second satellite source agrees.' ELSE 'One satellite source only.' END, 'Needs an analyst''s review.') AS message FROM q""")
def alert_message(spark, d):
    q = table(spark, d, "orders").selectExpr("o_orderkey AS id", "concat('AOI-', cast(o_custkey % 10 as string)) AS area", f"{ETYPE} AS et", "CASE WHEN o_orderkey % 4 <> 0 THEN cast(o_custkey % 101 as double) END AS pct", "o_orderkey % 3 AS na")
    return q.select("id", wf.alert_message(F.col("area"), F.col("et"), F.col("pct"), F.col("na")).alias("message"))


PRIO = "CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END"


@query("alert_new", f"""WITH q AS (SELECT o_orderkey AS incident_id, {pick(wf.STATES, 'o_custkey % 7')} AS status, CASE WHEN o_orderkey % 8 = 0 THEN 'negative_control' ELSE 'operational' END AS role, {PRIO} AS priority, year(o_orderdate) AS yr FROM orders)
SELECT incident_id, CASE WHEN upper(priority) IN ('HIGH', 'MEDIUM') THEN upper(priority) ELSE 'LOW' END AS level FROM q WHERE yr >= 2000 AND incident_id % 5 <> 2 AND role = 'operational' AND status IN ('MONITORING', 'DETECTED', 'UNDER_REVIEW', 'FIELD_VALIDATION_REQUIRED')""")
def alert_new(spark, d):
    q = table(spark, d, "orders").selectExpr("o_orderkey AS incident_id", f"{pick(wf.STATES, 'o_custkey % 7')} AS status", "CASE WHEN o_orderkey % 8 = 0 THEN 'negative_control' ELSE 'operational' END AS role", f"{PRIO} AS priority", "year(o_orderdate) AS yr")
    known = q.where((F.col("yr") < 2000) | (F.col("incident_id") % 5 == 2))
    return wf.new_alerts(q, known).select("incident_id", "level")


@query("alert_list", "SELECT event_id AS alert_id, event_type AS level FROM events WHERE user_id % 3 <> 0")
def alert_list(spark, d):
    a = table(spark, d, "events").select(F.col("event_id").alias("alert_id"), F.col("event_type").alias("level"), F.col("ts").alias("created_at"), F.when(F.col("user_id") % 3 == 0, F.col("ts")).alias("acknowledged_at"))
    return wf.alert_list(a).select("alert_id", "level")


@query("audit_log", "SELECT event_id AS seq, user_id AS entity_id, props AS detail FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 200")
def audit_log(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("entity_type"), F.col("user_id").alias("entity_id"), F.col("props").alias("detail"))
    return wf.audit_log(e, 200, "purchase").select("seq", "entity_id", "detail")


# --- payloads: JSON documents with planted faults ---------------------------------------------------
def payloads(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, d, "orders")
    est = F.create_map(F.lit("chl"), F.struct(F.when(c % 5 == 0, "CALIBRATED").otherwise("PROXY").alias("quantity_kind"), F.when(k % 6 == 0, "mg m-3").otherwise("1").alias("units")))
    fields = [
        k.cast("string").alias("id"), F.expr(BEFORE).alias("status"), F.when(k % 7 != 0, F.lit("A")).alias("aoi_id"), F.lit("t").alias("detected_at"), F.lit("t").alias("observation_time"), F.expr(ETYPE).alias("event_type_hypothesis"),
        ((c % 120) / 100.0).alias("severity"), ((k % 100) / 100.0).alias("confidence"), F.when(c % 11 != 0, F.lit("m")).alias("model_id"),
        F.struct(F.element_at(F.array(*[F.lit(x) for x in ("Polygon", "Point", "LineString", "MultiPolygon")]), (k % 4 + 1).cast("int")).alias("type")).alias("geometry"),
        F.struct(est.alias("estimates")).alias("water_quality"), F.struct(F.lit(1).alias("n")).alias("temporal"), F.struct(F.lit(1).alias("n")).alias("sensor_agreement"), F.array(F.lit("q")).alias("quality_flags"),
        F.array(F.lit(1)).alias("exposure"), F.struct(F.lit(1).alias("n")).alias("field_validation"), F.when(k % 13 != 0, F.struct(F.lit(1).alias("n"))).alias("provenance")]
    return o.select(k.alias("id"), F.to_json(F.struct(*fields)).alias("payload"))


@query("payload_validate", f"""WITH q AS (SELECT o_orderkey AS k, o_custkey AS c, {BEFORE} AS st, {ETYPE} AS et FROM orders)
SELECT k AS id, array_to_string(list_filter([CASE WHEN k % 7 = 0 THEN 'missing aoi_id' END, CASE WHEN c % 11 = 0 THEN 'missing model_id' END, CASE WHEN k % 13 = 0 THEN 'missing provenance' END, CASE WHEN st = 'ARCHIVED' THEN 'invalid status' END,
CASE WHEN et = 'OTHER' THEN 'invalid event type' END, CASE WHEN c % 120 > 100 THEN 'severity out of [0, 1]' END, CASE WHEN k % 4 = 2 THEN 'invalid geometry type' END, CASE WHEN k % 6 = 0 AND c % 5 <> 0 THEN 'chl: physical units on an uncalibrated proxy' END], lambda z: z IS NOT NULL), '; ') AS problems FROM q""")
def payload_validate(spark, d):
    return wf.payload_problems(payloads(spark, d), "payload").select("id", F.array_join("problems", "; ").alias("problems"))


SQL_SMP = """cur AS (SELECT DISTINCT l_orderkey AS incident_id, 'S0' || CAST(l_linenumber AS VARCHAR) AS code, CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'COLLECTED' WHEN 1 THEN 'REMOVED' ELSE 'PLANNED' END AS status FROM lineitem),
pln AS (SELECT o_orderkey AS incident_id, 'S0' || CAST(i AS VARCHAR) AS code, 'CORE' AS role FROM orders, generate_series(1, 3) g(i))"""


def samples(spark, d):
    cur = table(spark, d, "lineitem").selectExpr("l_orderkey AS incident_id", "concat('S0', cast(l_linenumber as string)) AS code", "CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'COLLECTED' WHEN 1 THEN 'REMOVED' ELSE 'PLANNED' END AS status").distinct()
    return cur.withColumn("role", F.lit("EDGE"))


@query("sample_plan_merge", f"WITH {SQL_SMP} SELECT incident_id, code, CASE WHEN c.status IS NULL THEN 'PLANNED' WHEN p.role IS NULL AND c.status = 'PLANNED' THEN 'REMOVED' WHEN p.role IS NOT NULL AND c.status IN ('REMOVED', 'PLANNED') THEN 'PLANNED' ELSE c.status END AS status, coalesce(p.role, 'EDGE') AS role FROM cur c FULL JOIN pln p USING (incident_id, code)")
def sample_plan_merge(spark, d):
    plan = table(spark, d, "orders").select(F.col("o_orderkey").alias("incident_id"), F.explode(F.array(*[F.lit(f"S0{i}") for i in (1, 2, 3)])).alias("code"), F.lit("CORE").alias("role"))
    return wf.merge_sample_plan(samples(spark, d), plan)


@query("field_result_effects", f"""WITH {SQL_SMP}, res AS (SELECT DISTINCT l_orderkey AS incident_id, 'S0' || CAST(l_linenumber AS VARCHAR) AS code FROM lineitem WHERE l_returnflag = 'R'),
i AS (SELECT o_orderkey AS incident_id, {pick(wf.STATES, 'o_custkey % 7')} AS status FROM orders)
SELECT 'sample' AS kind, CASE WHEN r.code IS NOT NULL THEN 'RESULT_RECEIVED' ELSE status END AS status, count(*) AS n FROM cur LEFT JOIN res r USING (incident_id, code) GROUP BY ALL
UNION ALL SELECT 'incident', CASE WHEN status = 'FIELD_VALIDATION_REQUIRED' AND incident_id IN (SELECT incident_id FROM res) THEN 'UNDER_REVIEW' ELSE status END, count(*) FROM i GROUP BY ALL""")
def field_result_effects(spark, d):
    res = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").selectExpr("l_orderkey AS incident_id", "concat('S0', cast(l_linenumber as string)) AS code")
    inc = table(spark, d, "orders").selectExpr("o_orderkey AS incident_id", f"{pick(wf.STATES, 'o_custkey % 7')} AS status")
    s, i = wf.field_result_effects(samples(spark, d), inc, res)
    n = F.count(F.lit(1)).alias("n")
    return s.groupBy("status").agg(n).select(F.lit("sample").alias("kind"), "status", "n").unionByName(i.groupBy("status").agg(n).select(F.lit("incident").alias("kind"), "status", "n"))


MODEL_COLUMNS = {"task": "o_orderpriority", "model_id": "o_custkey % 30", "seq": "o_orderkey", "action": pick(["promote", "rollback", "other", "promote"], "o_orderkey % 4"),
                 "status": pick(["PRODUCTION", "PRODUCTION", "REJECTED", "PRODUCTION"], "o_orderkey % 4"), "status_before": pick(["CANDIDATE", "STAGING", "RETIRED", "PRODUCTION"], "o_custkey % 4"),
                 "actor": pick(["ana", "system", "li", " Trainer "], "o_custkey % 4 + 0 * o_orderkey"), "gate_passed": "o_orderkey % 5 <> 0"}


@query("production_model", "WITH g AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in MODEL_COLUMNS.items()) + """ FROM orders), v AS (SELECT * FROM g WHERE action = 'other' OR (lower(trim(actor)) NOT IN ('', 'system', 'pipeline', 'trainer', 'gate', 'auto')
AND ((action = 'promote' AND status_before IN ('CANDIDATE', 'STAGING') AND gate_passed) OR (action = 'rollback' AND status_before IN ('RETIRED', 'STAGING'))))), l AS (SELECT * FROM v WHERE status = 'PRODUCTION' QUALIFY row_number() OVER (PARTITION BY task ORDER BY seq DESC) = 1)
SELECT task, model_id, actor, seq AS promoted_seq FROM l WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.task = l.task AND v.model_id = l.model_id AND v.seq > l.seq)""")
def production_model(spark, d):
    return wf.production_model(table(spark, d, "orders").selectExpr(*[f"{v} AS {k}" for k, v in MODEL_COLUMNS.items()]))


SEG = 64
CANON = "concat_ws('|', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), event_type, props)"


@query("audit_chain_verify", f"""WITH RECURSIVE c AS (SELECT event_id AS seq, event_id // {SEG} AS seg, event_id % {SEG} AS i, {CANON} AS canon FROM events),
t(seg, i, seq, canon, prev, h) AS (SELECT seg, i, seq, canon, repeat('0', 64), sha256(repeat('0', 64) || canon) FROM c WHERE i = 0 UNION ALL SELECT c.seg, c.i, c.seq, c.canon, t.h, sha256(t.h || c.canon) FROM t JOIN c ON c.seg = t.seg AND c.i = t.i + 1),
s AS (SELECT seg, seq, canon, prev, CASE WHEN seq % 397 = 11 THEN sha256(h) ELSE h END AS h FROM t), l AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY seg ORDER BY seq), repeat('0', 64)) AS before FROM s),
g AS (SELECT seg, count(*) AS n, min(CASE WHEN prev <> before OR h <> sha256(prev || canon) THEN seq END) AS bad, arg_max(h, seq) AS head FROM l GROUP BY 1)
SELECT seg, n, CAST(bad IS NULL AS INTEGER) AS ok, bad AS first_bad_seq, CASE WHEN bad IS NULL THEN head END AS head FROM g""")
def audit_chain_verify(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / SEG).alias("seg"), F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", "props").alias("canonical"))
    # Input chains restart at every 64th event, so one is folded from at most 64 rows.
    rows = e.groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("seq", "canonical"))).alias("r"))
    empty = F.array().cast("array<struct<seq:bigint,canonical:string,prev:string,hash:string>>")

    def link(acc, x):
        prev = F.coalesce(F.get(acc, F.size(acc) - 1)["hash"], F.lit(wf.GENESIS))
        return F.concat(acc, F.array(F.struct(x["seq"].alias("seq"), x["canonical"].alias("canonical"), prev.alias("prev"), wf.chain_hash(prev, x["canonical"]).alias("hash"))))

    chain = rows.select("seg", F.inline(F.aggregate("r", empty, link)))
    stored = chain.withColumn("hash", F.when(F.col("seq") % 397 == 11, F.sha2("hash", 256)).otherwise(F.col("hash")))
    out = wf.verify_chain(stored, ["seg"], "seq", "canonical", "prev", "hash", F.floor(F.col("seq") / 16))
    return out.withColumn("ok", F.col("ok").cast("int"))


PROV = {f: f"CASE WHEN (l_partkey + {i}) % {i + 5} <> 0 THEN 'x' WHEN l_partkey % 2 = 0 THEN '' END" for i, f in enumerate(wf.SOURCE_FIELDS)}
_HAVE = " + ".join(f"CASE WHEN coalesce({v}, '') <> '' THEN 1 ELSE 0 END" for v in PROV.values())


@query("provenance_completeness", f"""WITH s AS (SELECT l_orderkey AS rec, count(*) AS ns, sum({_HAVE}) AS have FROM lineitem GROUP BY 1), a AS (SELECT o_orderkey AS rec, 1 + CAST(o_custkey % 3 <> 0 AS INTEGER) AS alg FROM orders)
SELECT rec, coalesce(ns, 0) AS n_sources, {r6('(coalesce(have, 0) + alg) / CAST(coalesce(ns, 0) * 9 + 2 AS DOUBLE)')} AS completeness, CAST(coalesce(ns, 0) * 9 + 2 - coalesce(have, 0) - alg + CASE WHEN ns IS NULL THEN 1 ELSE 0 END AS BIGINT) AS n_missing FROM a LEFT JOIN s USING (rec)""")
def provenance_completeness(spark, d):
    s = table(spark, d, "lineitem").selectExpr("l_orderkey AS rec", *[f"{v} AS {k}" for k, v in PROV.items()])
    a = table(spark, d, "orders").selectExpr("o_orderkey AS rec", "'algo' AS name", "CASE WHEN o_custkey % 3 <> 0 THEN 'text' END AS description")
    return wf.provenance_completeness(s, "rec", a).withColumn("completeness", rnd(F.col("completeness")))


@query("provenance_missing", f"""SELECT field, count(*) AS n FROM (SELECT unnest([{', '.join(f"CASE WHEN coalesce({v}, '''') = '''' THEN '{k}' END".replace("''''", "''") for k, v in PROV.items())}]) AS field FROM lineitem) WHERE field IS NOT NULL GROUP BY 1""")
def provenance_missing(spark, d):
    s = table(spark, d, "lineitem").selectExpr("l_orderkey AS rec", "l_linenumber AS ord", *[f"{v} AS {k}" for k, v in PROV.items()])
    return wf.missing_fields(s, "rec", "ord").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


ROW_COLUMNS = {"aoi": "o_custkey % 10", "platform": "CASE WHEN o_orderstatus = 'O' THEN 'S2A' ELSE 'S2B' END", "orbit": "CASE WHEN o_orderkey % 12 <> 0 THEN o_custkey % 4 END", "n_water": "CAST(floor(o_totalprice) AS BIGINT) % 1500",
               "error": "CASE WHEN o_custkey % 23 = 0 THEN 'failed' END", "p95": "o_totalprice / 1000000e0", "baseline": "2e0 + (o_orderkey % 7) * 0.5e0", "valid_fraction": "(o_custkey % 37) / 36e0", "cloud_fraction": "(o_orderkey % 41) / 40e0",
               "water_fraction": "(o_orderkey % 53) / 52e0", "glint_fraction": "CASE WHEN o_orderkey % 9 <> 0 THEN (o_custkey % 31) / 300e0 END", "b11_water": "0.01e0 + (o_orderkey % 17) / 1000e0", "negative_red_fraction": "(o_custkey % 13) / 130e0"}
QUALITY = ["valid_fraction", "cloud_fraction", "water_fraction", "glint_fraction", "b11_water", "negative_red_fraction"]
SQL_ROWS = "rw AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in ROW_COLUMNS.items()) + ", o_orderdate AS tm FROM orders)"


def rows(spark, d):
    return table(spark, d, "orders").selectExpr(*[f"{v} AS {k}" for k, v in ROW_COLUMNS.items()], "cast(o_orderdate as timestamp_ntz) AS at", "to_date(o_orderdate) AS d")


NOW = "2001-08-03 09:30:00"


@query("aoi_status", f"""WITH {SQL_ROWS}, {SQL_INC}, g AS (SELECT *, error IS NULL AND n_water >= 200 AS ok FROM rw), a AS (SELECT aoi, max(CASE WHEN ok THEN tm END) AS lo, arg_max(platform, (tm, platform)) FILTER (ok) AS lp, count(CASE WHEN ok THEN 1 END) AS nv,
count(CASE WHEN ok AND floor((epoch(TIMESTAMP '{NOW}') - epoch(tm)) / 86400) <= 7 THEN 1 END) AS n7 FROM g GROUP BY 1), i AS (SELECT aoi, count(CASE WHEN status IN ('MONITORING', 'DETECTED', 'UNDER_REVIEW', 'FIELD_VALIDATION_REQUIRED') THEN 1 END) AS oi FROM inc GROUP BY 1)
SELECT aoi, strftime(lo, '%Y-%m-%d') AS last_observation, lp AS last_platform, nv AS n_valid, n7 AS n_obs_7d, coalesce(oi, 0) AS open_incidents FROM a LEFT JOIN i USING (aoi)""")
def aoi_status(spark, d):
    out = wf.aoi_status(rows(spark, d), incidents(spark, d), F.lit(NOW).cast("timestamp_ntz"))
    return out.select("aoi", F.date_format("last_observation", "yyyy-MM-dd").alias("last_observation"), "last_platform", "n_valid", "n_obs_7d", "open_incidents")


@query("next_pass", f"""WITH {SQL_ROWS}, p AS (SELECT aoi, platform, orbit, epoch(max(tm)) AS l FROM rw WHERE orbit IS NOT NULL GROUP BY 1, 2, 3), q AS (SELECT *, l + greatest(ceil((epoch(TIMESTAMP '{NOW}') - l) / 864000.0), 1) * 864000 AS nx FROM p)
SELECT aoi, platform, orbit, CAST(CASE WHEN nx <= epoch(TIMESTAMP '{NOW}') THEN nx + 864000 ELSE nx END AS BIGINT) AS next_at FROM q""")
def next_pass(spark, d):
    pattern = wf.pass_pattern(rows(spark, d))
    out = wf.next_pass(pattern, F.lit(NOW).cast("timestamp_ntz"))
    return out.select("aoi", "platform", "orbit", "next_at")


@query("next_pass_earliest", f"""WITH {SQL_ROWS}, p AS (SELECT aoi, platform, orbit, epoch(max(tm)) AS l FROM rw WHERE orbit IS NOT NULL GROUP BY 1, 2, 3), q AS (SELECT *, l + greatest(ceil((epoch(TIMESTAMP '{NOW}') - l) / 864000.0), 1) * 864000 AS nx FROM p),
n AS (SELECT aoi, platform, orbit, CAST(CASE WHEN nx <= epoch(TIMESTAMP '{NOW}') THEN nx + 864000 ELSE nx END AS BIGINT) AS next_at FROM q), b AS (SELECT *, CAST(round((next_at - epoch(TIMESTAMP '{NOW}')) / 60) AS BIGINT) AS m FROM n ORDER BY next_at, aoi, platform, orbit LIMIT 1)
SELECT next_at, aoi, platform, orbit, CASE WHEN m >= 1440 THEN (m // 1440) || 'd ' || (m % 1440 // 60) || 'h' ELSE (m // 60) || 'h ' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') || 'm' END AS in_text FROM b""")
def next_pass_earliest(spark, d):
    now = F.lit(NOW).cast("timestamp_ntz")
    return wf.earliest_pass(wf.next_pass(wf.pass_pattern(rows(spark, d)), now), now)


@query("data_quality_report", f"""WITH {SQL_ROWS} SELECT aoi, count(*) AS n_datatakes, count(CASE WHEN error IS NULL THEN 1 END) AS n_ok, count(error) AS n_failed, count(CASE WHEN error IS NULL AND n_water >= 500 THEN 1 END) AS n_usable, strftime(min(CASE WHEN error IS NULL THEN tm END), '%Y-%m-%d') AS first_d,
strftime(max(CASE WHEN error IS NULL THEN tm END), '%Y-%m-%d') AS last_d, count(CASE WHEN error IS NULL AND baseline >= 4 THEN 1 END) AS n_offset_applied, {r6('median(CASE WHEN error IS NULL THEN valid_fraction END)')} AS median_valid_fraction, {', '.join(f"{r6(f'median(CASE WHEN error IS NULL THEN {c} END)')} AS median_{c}" for c in QUALITY[1:])}, (SELECT string_agg(platform || ':' || n, ',' ORDER BY platform) FROM (SELECT platform, count(*) AS n FROM rw q WHERE q.aoi = rw.aoi AND error IS NULL GROUP BY 1)) AS platforms,
(SELECT string_agg(baseline || ':' || n, ',' ORDER BY CAST(baseline AS VARCHAR)) FROM (SELECT baseline, count(*) AS n FROM rw q WHERE q.aoi = rw.aoi AND error IS NULL GROUP BY 1)) AS processing_baselines FROM rw GROUP BY 1""")
def data_quality_report(spark, d):
    out = wf.data_quality(rows(spark, d), ["aoi"], QUALITY)
    listed = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")       # noqa: E731
    return out.withColumns({"first_d": F.date_format("first_d", "yyyy-MM-dd"), "last_d": F.date_format("last_d", "yyyy-MM-dd"), **{f"median_{c}": rnd(F.col(f"median_{c}")) for c in QUALITY}, "platforms": listed("platforms"), "processing_baselines": listed("processing_baselines")})


REGIMES = ["optically deep shelf", "shallow lagoon", "shallow shelf", "open shelf"]
SQL_AREAS = f"""ar AS (SELECT o_custkey % 25 AS aoi, count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS usable, {pick(REGIMES, 'o_custkey % 25 % 4')} AS regime, CASE WHEN o_custkey % 25 % 6 <> 0 THEN count(CASE WHEN o_totalprice > 480000 THEN 1 END) END AS positive,
 count(CASE WHEN o_totalprice < 20000 THEN 1 END) AS negative, o_custkey % 25 % 5 AS register, count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS critical FROM orders GROUP BY o_custkey % 25)"""


@query("aoi_tournament", f"""WITH {SQL_AREAS}, m AS (SELECT greatest(max(usable), 1) AS mu, greatest(max(critical), 1) AS mc FROM ar), s AS (SELECT aoi, usable / CAST(mu AS DOUBLE) AS a, CASE WHEN regime LIKE '%optically deep%' THEN 1.0 WHEN regime LIKE '%lagoon%' THEN 0.2 WHEN regime LIKE '%shallow%' THEN 0.4 ELSE 0.55 END AS b,
least(1, 0.5 * least(1, coalesce(positive, 0) / 10e0) + 0.5 * least(1, register / 3e0)) AS c, critical / CAST(mc AS DOUBLE) AS d, CASE WHEN positive IS NULL OR positive + negative = 0 THEN 0.5 ELSE positive / CAST(positive + negative AS DOUBLE) END AS e FROM ar, m)
SELECT aoi, CAST(row_number() OVER (ORDER BY 0.15e0 * a + 0.2e0 * b + 0.3e0 * c + 0.2e0 * d + 0.15e0 * e DESC, aoi) AS INTEGER) AS rank, {r6('0.15 * a + 0.2 * b + 0.3 * c + 0.2 * d + 0.15 * e')} AS total, {r6('a')} AS s_data, {r6('b')} AS s_optics, {r6('c')} AS s_evidence, {r6('d')} AS s_exposure, {r6('e')} AS s_burden FROM s""")
def aoi_tournament(spark, d):
    a = table(spark, d, "orders").withColumn("aoi", F.col("o_custkey") % 25).groupBy("aoi").agg(
        F.count_if(F.col("o_orderstatus") != "P").alias("usable"), F.count_if(F.col("o_totalprice") > 480000).alias("pos"), F.count_if(F.col("o_totalprice") < 20000).alias("negative"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("critical"))
    a = a.withColumns({"regime": F.expr(pick(REGIMES, "aoi % 4")), "positive": F.when(F.col("aoi") % 6 != 0, F.col("pos")), "register": F.col("aoi") % 5})
    return wf.tournament(a).select("aoi", "rank", *[rnd(F.col(c)).alias(c) for c in ("total", "s_data", "s_optics", "s_evidence", "s_exposure", "s_burden")])


SQL_REF = "rl AS (SELECT o_orderkey AS label_id, o_custkey % 12 AS aoi, 'coast' || CAST(o_custkey % 12 % 3 AS VARCHAR) AS coast, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS y, o_totalprice / 90000e0 AS area_km2 FROM orders)"


def ref_labels(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS label_id", "o_custkey % 12 AS aoi", "concat('coast', cast(o_custkey % 12 % 3 as string)) AS coast", "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS y", "o_totalprice / 90000e0 AS area_km2")


@query("confirmation_rates", f"WITH {SQL_REF} SELECT coast, aoi, count(*) AS referenced, count(CASE WHEN y = 1 THEN 1 END) AS confirmed, {r6('avg(y)')} AS rate FROM rl WHERE y IS NOT NULL GROUP BY GROUPING SETS ((coast, aoi), (coast))")
def confirmation_rates(spark, d):
    return wf.confirmation_rates(ref_labels(spark, d)).withColumn("rate", rnd(F.col("rate")))


@query("portability", f"WITH {SQL_REF}, {SQL_LABEL_SCORES}, g AS (SELECT aoi, avg(y) AS r FROM rl WHERE y IS NOT NULL GROUP BY 1), w AS (SELECT c.auprc AS c, r.auprc AS r FROM ({sql_ap('pb')}) c JOIN ({sql_ap('pa')}) r USING (sub) WHERE c.auprc IS NOT NULL AND r.auprc IS NOT NULL) SELECT count(*) AS n_areas, {r6('min(r)')} AS rate_min, {r6('max(r)')} AS rate_max, (SELECT count(CASE WHEN c > r THEN 1 END) FROM w) AS n_wins, (SELECT count(*) FROM w) AS n_scorable FROM g")
def portability(spark, d):
    from tidemark.operators import metrics as me
    s = label_scores(spark, d)
    both = me.ranking(s, ["sub"], "y", "pb").select("sub", F.col("auprc").alias("candidate")).join(me.ranking(s, ["sub"], "y", "pa").select("sub", F.col("auprc").alias("rule")), "sub")
    out = wf.portability(ref_labels(spark, d), both, "candidate", "rule")
    return out.withColumns({c: rnd(F.col(c)) for c in ("rate_min", "rate_max")})


@query("largest_rejections", f"WITH {SQL_REF} SELECT label_id, aoi, {r6('area_km2')} AS area_km2 FROM rl WHERE y = 0 ORDER BY rl.area_km2 DESC, label_id LIMIT 5")
def largest_rejections(spark, d):
    return wf.largest_rejections(ref_labels(spark, d)).select("label_id", "aoi", rnd(F.col("area_km2")).alias("area_km2"))
