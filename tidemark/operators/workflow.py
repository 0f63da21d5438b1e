"""Scoring rules and the analytics of the workflow tables (incidents, reviews, labels, models, audit)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import join_nulls
from tidemark.functions.nulls import clip, ratio
from tidemark.functions.ordering import previous_row
from tidemark.functions.quantiles import exact_quantiles

# --- Fixed values: severity and confidence weights ----------------------------------------------
SEVERITY_WEIGHTS = {"area": 0.20, "spectral_anomaly": 0.25, "magnitude": 0.20, "historical_rarity": 0.30, "growth": 0.15}
CONFIDENCE_WEIGHTS = {"valid_coverage": 0.20, "cloud_free": 0.15, "sample_size": 0.15, "spectral_snr": 0.20, "class_margin": 0.15,
                      "cross_sensor": 0.15, "recency": 0.10, "bottom_influence": 0.20}
NO_IN_SITU_CAP = 0.75
LEVELS = ["NORMAL", "WATCH", "INVESTIGATE", "HIGH_PRIORITY"]
VETO_PERCENTILE = 50.0
# --- Fixed values: incident states, decisions and transitions ------------------------------------
STATES = ["MONITORING", "DETECTED", "UNDER_REVIEW", "FIELD_VALIDATION_REQUIRED", "CONFIRMED", "FALSE_POSITIVE", "RESOLVED"]
OPEN_STATES = STATES[:4]
DECISIONS = ["CONFIRM", "FALSE_POSITIVE", "RECLASSIFY", "NEEDS_FIELD_SAMPLE", "INSUFFICIENT_EVIDENCE"]
REVIEW_TABLE = [
    ("DETECTED", "CONFIRM", "CONFIRMED"), ("UNDER_REVIEW", "CONFIRM", "CONFIRMED"),
    ("FIELD_VALIDATION_REQUIRED", "CONFIRM", "CONFIRMED"), ("MONITORING", "CONFIRM", "CONFIRMED"),
    ("DETECTED", "FALSE_POSITIVE", "FALSE_POSITIVE"), ("UNDER_REVIEW", "FALSE_POSITIVE", "FALSE_POSITIVE"),
    ("FIELD_VALIDATION_REQUIRED", "FALSE_POSITIVE", "FALSE_POSITIVE"), ("MONITORING", "FALSE_POSITIVE", "FALSE_POSITIVE"),
    ("DETECTED", "RECLASSIFY", "UNDER_REVIEW"), ("UNDER_REVIEW", "RECLASSIFY", "UNDER_REVIEW"),
    ("FIELD_VALIDATION_REQUIRED", "RECLASSIFY", "UNDER_REVIEW"), ("MONITORING", "RECLASSIFY", "UNDER_REVIEW"), ("CONFIRMED", "RECLASSIFY", "CONFIRMED"),
    ("DETECTED", "NEEDS_FIELD_SAMPLE", "FIELD_VALIDATION_REQUIRED"), ("UNDER_REVIEW", "NEEDS_FIELD_SAMPLE", "FIELD_VALIDATION_REQUIRED"), ("MONITORING", "NEEDS_FIELD_SAMPLE", "FIELD_VALIDATION_REQUIRED"),
    ("DETECTED", "INSUFFICIENT_EVIDENCE", "MONITORING"), ("UNDER_REVIEW", "INSUFFICIENT_EVIDENCE", "MONITORING"),
]
ADMIN_TABLE = [("MONITORING", "DETECTED"), ("DETECTED", "UNDER_REVIEW"), ("FIELD_VALIDATION_REQUIRED", "UNDER_REVIEW"),
               ("CONFIRMED", "RESOLVED"), ("FALSE_POSITIVE", "RESOLVED"), ("RESOLVED", "UNDER_REVIEW")]
EVENT_TYPES = {
    "BLOOM_LIKE": "Possible algae bloom (high chlorophyll)", "SEDIMENT_LIKE": "Muddy water (suspended sediment)",
    "SURFACE_FILM_LIKE": "Floating material or surface film", "SURFACE_DARK_ANOMALY": "Dark patch on radar (often an oil lookalike)",
    "CDOM_LIKE": "Stained water (dissolved organic matter)", "BOTTOM_INFLUENCED": "Seabed showing through (not a water event)",
    "PERSISTENT_FEATURE": "Permanent coastal feature (not a new event)", "UNKNOWN_ANOMALY": "Unusual water, type unclear"}
LABEL_WEIGHTS = {"field_measurement": 2.0, "in_situ_archive": 2.0, "analyst_review": 1.0, "cross_sensor_reference": 0.5}
REQUIRED_KEYS = ["id", "status", "aoi_id", "detected_at", "observation_time", "event_type_hypothesis", "severity", "confidence", "model_id",
                 "geometry", "water_quality", "temporal", "sensor_agreement", "quality_flags", "exposure", "field_validation", "provenance"]
PHYSICAL_UNITS = ["mg m-3", "mg/m3", "NTU", "mg/L", "g m-3"]
SOURCE_FIELDS = ["satellite", "sensor", "scene_id", "acquisition_utc", "product", "processing_level", "provider", "licence", "units"]
GENESIS = "0" * 64
TOURNAMENT_WEIGHTS = {"data": 0.15, "optics": 0.20, "evidence": 0.30, "exposure": 0.20, "burden": 0.15}
# Texts of recommendations; $name stands for a value.
REASONS = {
    "seasonal": ("Main indicator at the ", "$pct", " percentile for this place and season."),
    "spatial": ("Stands out from the surrounding water (", "$pct", " percentile)."),
    "agreement": ("$n", " satellite source(s) agree: ", "$names", "."),
    "confidence": ("Model confidence ", "$p", "."),
    "nearest": ("Nearest asset: ", "$name", ", ", "$km", " km away."),
}
NO_SAMPLE, CLOSED = "No water sample yet.", "Incident closed."
NORMAL_HERE = "Normal for this place and season. The contrast is a permanent feature, not a new event."
NEEDED = {
    "NO_ACTION": [],
    "STAND_DOWN_CONTINUE_MONITORING": ["Next clear satellite image"],
    "MANAGE_CONFIRMED_EVENT": ["Follow-up samples to track the decline", "Tell the asset operator (their own procedure)"],
    "FIELD_VERIFICATION": ["Water sample at the event centre, plus one from normal water the same day",
                           "Lab tests: chlorophyll-a, turbidity, suspended sediment, temperature, salinity", "Algae species ID if a bloom is suspected"],
    "ANALYST_REVIEW": ["Analyst review of the colour and history evidence"],
}
NOT_ADVISED = ["Automatic plant shutdown: not advised on satellite evidence alone.", "Public health warning: needs a lab result first."]
SYSTEM_ACTORS = ["", "system", "pipeline", "trainer", "gate", "auto"]


# ---------------------------------------------------------------- severity, confidence, priority
def weighted_mean(components: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted mean over the components that are present; NULL when none is."""
    num, den = F.lit(0.0), F.lit(0.0)
    for k, c in components.items():
        num = num + F.coalesce(c * weights[k], F.lit(0.0))
        den = den + F.when(c.isNotNull(), F.lit(weights[k])).otherwise(0.0)
    return F.when(den > 0, num / den)


def severity(area_km2: Column, anomaly_pct: Column, magnitude: Column, historical_pct: Column, growth: Column) -> Column:
    return weighted_mean({
        "area": clip(area_km2 / 10.0, 0, 1), "spectral_anomaly": clip(anomaly_pct / 100.0, 0, 1), "magnitude": clip((magnitude - 1.0) / 4.0, 0, 1),
        "historical_rarity": clip(historical_pct / 100.0, 0, 1), "growth": clip(growth / 0.5, 0, 1)}, SEVERITY_WEIGHTS)


def confidence(valid: Column, cloud: Column, n_px: Column, snr: Column, margin: Column, agreement: Column, days: Column, bottom: Column, in_situ: Column) -> Column:
    """Trust in measurement and method; capped while nothing was confirmed in the field."""
    raw = weighted_mean({
        "valid_coverage": clip(valid, 0, 1), "cloud_free": clip(1.0 - cloud, 0, 1), "sample_size": clip(F.log10(F.when(n_px.isNotNull(), F.greatest(n_px, F.lit(1)))) / math.log10(500), 0, 1),
        "spectral_snr": clip(snr / 30.0, 0, 1), "class_margin": clip(margin, 0, 1), "cross_sensor": clip(agreement, 0, 1),
        "recency": clip(1.0 - days / 7.0, 0, 1), "bottom_influence": clip(1.0 - bottom, 0, 1)}, CONFIDENCE_WEIGHTS)
    return F.when(~in_situ & (raw > NO_IN_SITU_CAP), NO_IN_SITU_CAP).otherwise(raw)


def priority(df: DataFrame, sev: str, conf: str, exposure: str, eta: str, hist: str) -> DataFrame:
    """Ordered rule table: the highest fired level wins, a usual place and season caps it; all fired rules are kept."""
    s, c, e = (F.coalesce(F.col(x), F.lit(0.0)) for x in (sev, conf, exposure))
    rules = [
        ("severity_watch", 1, s >= 0.35), ("severity_investigate", 2, s >= 0.55), ("asset_exposed", 1, e >= 0.30),
        ("moderate_event_exposed_asset", 2, (e >= 0.50) & (s >= 0.30)), ("drift_reaches_asset", 3, (F.col(eta) <= 24) & (e >= 0.40)),
        ("severe_and_exposed", 3, (s >= 0.70) & (e >= 0.40)), ("uncertain_but_significant", 2, (s >= 0.50) & (c < 0.45)),
        ("below_thresholds", 0, (s < 0.35) & (e < 0.30)),
    ]
    fired = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(lv).alias("level"))) for n, lv, cond in rules]))
    df = df.withColumn("_fired", fired).withColumn("_level", F.coalesce(F.array_max(F.transform("_fired", lambda r: r["level"])), F.lit(0)))
    cap = F.when(e >= 0.50, 1).otherwise(0)
    veto = F.coalesce(F.col(hist) <= VETO_PERCENTILE, F.lit(False)) & (cap < F.col("_level"))
    df = df.withColumn("vetoed", veto).withColumn("_final", F.when(F.col("vetoed"), cap).otherwise(F.col("_level")))
    reason = F.when(F.col("vetoed"), "temporal_veto").otherwise(
        F.coalesce(F.get(F.filter("_fired", lambda r: r["level"] == F.col("_final")), 0)["rule"], F.get(F.reverse("_fired"), 0)["rule"], F.lit("none")))
    return df.withColumns({"priority": F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("_final") + 1), "reason": reason,
                           "rules_fired": F.transform("_fired", lambda r: r["rule"])}).drop("_fired", "_level", "_final")


# ---------------------------------------------------------------- reviews and labels
def review_table(spark: SparkSession) -> DataFrame:
    """The allowed (state, decision) -> state rows, a fixed table of eighteen."""
    return spark.createDataFrame(REVIEW_TABLE, "status_before string, decision string, status_after string")


def check_transitions(reviews: DataFrame) -> DataFrame:
    """Target state of each review, or why it is not allowed."""
    t = F.broadcast(review_table(reviews.sparkSession))
    out = reviews.join(t, ["status_before", "decision"], "left")
    problem = (F.when(~F.col("status_before").isin(STATES), "unknown status").when(~F.col("decision").isin(DECISIONS), "unknown decision")
               .when(F.col("status_after").isNull(), "not allowed"))
    return out.withColumn("problem", problem)


def admin_allowed(before: Column, after: Column) -> Column:
    ok = F.lit(False)
    for a, b in ADMIN_TABLE:
        ok = ok | ((before == a) & (after == b))
    return ok


def replay(reviews: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column) -> DataFrame:
    """Final status per incident, and how many reviews do not start where the one before ended."""
    prev = previous_row(reviews, keys, order, chunk, {"status_after": "_prev"})
    broken = F.col("_prev").isNotNull() & (F.col("_prev") != F.col("status_before"))
    return prev.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reviews"), F.max_by("status_after", F.struct(*order)).alias("final_status"), F.count_if(broken).alias("n_breaks"))


def label_of(decision: Column, previous: Column, new: Column) -> dict[str, Column]:
    """Binary label and class an analyst decision implies (NULL y and class: no label)."""
    y = F.when(decision == "CONFIRM", 1).when(decision == "FALSE_POSITIVE", 0)
    cls = (F.when(decision == "CONFIRM", F.coalesce(new, previous)).when(decision == "FALSE_POSITIVE", F.coalesce(new, F.lit("FALSE_POSITIVE")))
           .when(decision == "RECLASSIFY", new))
    return {"y": y, "class": cls}


def source_weight(source: Column) -> Column:
    w = F.lit(1.0)
    for k, v in LABEL_WEIGHTS.items():
        w = F.when(source == k, F.lit(v)).otherwise(w)
    return w


def active_labels(labels: DataFrame, order: Sequence[str]) -> DataFrame:
    """The newest label of each (task, incident) supersedes the older ones; combinable, no window."""
    cols = [c for c in labels.columns if c not in ("task", "incident_id")]
    return (labels.groupBy("task", "incident_id").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_l"))
            .select("task", "incident_id", "_l.*"))


def label_summary(labels: DataFrame) -> DataFrame:
    return labels.groupBy("task", "source", "split").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- incidents
def incident_list(incidents: DataFrame, status: str | None = None, include_controls: bool = True) -> DataFrame:
    out = incidents
    if status:
        out = out.where(F.col("status") == status)
    if not include_controls:
        out = out.where(F.col("role") == "operational")
    return out.orderBy(F.col("observation_time").desc())


#: Children of one kind that a detail page shows; the rest follow by continuation key.
PAGE = 100


def child_page(children: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], page: int = PAGE, after: DataFrame | None = None) -> DataFrame:
    """First ``page`` children of every parent in ``order``: key, n (all children), rows (array), next (order values of the last row shown
    if more follow, else NULL).

    ``after`` (key, after: struct of the order columns, as ``next`` gave it) turns the page.  Ranks are cut per task before
    the shuffle, so a parent with any number of children sends a page from each task at most.  ``order`` should be unique per parent.
    """
    at = F.struct(*[F.col(o) for o in order])
    src = children
    if after is not None:
        src = src.join(after.select(key, "after"), key, "left").where(F.col("after").isNull() | (at > F.col("after"))).drop("after")
    w = Window.partitionBy(key).orderBy(*order)
    top = src.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= page + 1)
    entry = F.struct(F.col("_r").alias("r"), F.struct(*[F.col(f) for f in fields]).alias("row"), at.alias("at"))
    shown = top.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_a"))
    total = children.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    more = F.size("_a") > page
    out = total.join(shown, key, "left")
    return out.select(key, "n", F.transform(F.slice(F.coalesce("_a", F.array()), 1, page), lambda x: x["row"]).alias("rows"), F.when(more, F.get("_a", page - 1)["at"]).alias("next"))


def incident_detail(incidents: DataFrame, reviews: DataFrame, samples: DataFrame, measurements: DataFrame, predictions: DataFrame | None = None,
                    page: int = PAGE, after: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Incident rows with their children as nested arrays and the recommendation they lead to.

    Reviews by time, samples that were not removed by code, measurements by entry, predictions by id; each kind as
    ``child_page`` gives it (``<kind>``, ``n_<kind>``, ``next_<kind>``), besides the latest review, the results received and the
    mean measured value.  The recommendation is formed where the incident carries the columns that ``recommend`` needs;
    an incident with a measurement has field data.
    """
    after = dict(after or {})
    kept = samples.where(F.col("status") != "REMOVED")
    kinds = {"reviews": (reviews, ["created_at", "review_id"]), "samples": (kept, ["code"]), "measurements": (measurements, ["entered_at", "measurement_id"])}
    if predictions is not None:
        kinds["predictions"] = (predictions, ["prediction_id"])
    latest = reviews.groupBy("incident_id").agg(F.max_by("decision", F.struct("created_at", "review_id")).alias("last_decision"))
    results = kept.groupBy("incident_id").agg(F.count_if(F.col("status") == "RESULT_RECEIVED").alias("n_results"))
    means = measurements.groupBy("incident_id").agg(F.avg("value").alias("mean_value"))
    out = incidents
    for side in (latest, results, means):
        out = out.join(side, "incident_id", "left")
    for kind, (table, order) in kinds.items():
        one = child_page(table, "incident_id", order, [c for c in table.columns if c != "incident_id"], page, after.get(kind))
        out = out.join(one.withColumnsRenamed({"rows": kind, "n": f"n_{kind}", "next": f"next_{kind}"}), "incident_id", "left")
    out = out.fillna(0, [f"n_{k}" for k in kinds] + ["n_results"])
    if {"status", "role", "pct", "severity", "top_exposure", "observation_time"} <= set(out.columns):
        told = recommend(out.withColumn("has_field", F.col("n_measurements") > 0))
        parts = ["action", "action_priority", "reasons", "evidence_needed", "decision_deadline", "not_recommended"]
        out = told.withColumn("recommendation", F.struct(*parts)).drop(*parts, "has_field")
    return out


def ordinal(pct: Column) -> Column:
    """A percentile in words."""
    return F.when(pct.isNull() | F.isnan(pct.cast("double")), "unknown").otherwise(F.concat(F.rint(pct).cast("long").cast("string"), F.lit("th")))


def recommend(df: DataFrame) -> DataFrame:
    """Operator action, priority, reasons, evidence still needed, decision deadline and what is never advised.

    Needs status, role, pct, severity, has_field, top_exposure and observation_time; rx_pct, agreeing (array of source names), confidence,
    nearest_name and nearest_m add their reasons where they exist.
    """
    pct, sev, top = F.col("pct"), F.coalesce("severity", F.lit(0.0)), F.coalesce("top_exposure", F.lit(0.0))
    has = lambda c: c in df.columns                                                                            # noqa: E731
    no_field = ~F.coalesce("has_field", F.lit(False))
    closed = F.col("status").isin("FALSE_POSITIVE", "RESOLVED")
    stand_down = F.coalesce(F.col("role") == "negative_control", F.lit(False)) | F.coalesce(pct <= 50, F.lit(False))
    managed = (F.col("status") == "CONFIRMED") & ~no_field
    verify = no_field & ((F.coalesce(pct, F.lit(0.0)) >= 90) | (sev >= 0.5))
    action = (F.when(closed, "NO_ACTION").when(stand_down, "STAND_DOWN_CONTINUE_MONITORING").when(managed, "MANAGE_CONFIRMED_EVENT")
              .when(verify, "FIELD_VERIFICATION").otherwise("ANALYST_REVIEW"))
    urgent = (top >= 0.5) | (F.coalesce(pct, F.lit(0.0)) >= 97)
    level = (F.when(closed, "NONE").when(stand_down, "LOW").when(managed, "HIGH").when(verify, F.when(urgent, "HIGH").otherwise("MEDIUM")).otherwise("MEDIUM"))
    hours = F.when((sev >= 0.6) | (top >= 0.5), 24).otherwise(72)
    deadline = F.when(~closed, F.col("observation_time") + F.make_dt_interval(F.lit(0), hours))
    say = lambda which, **v: F.concat(*[v[p[1:]] if p[:1] == "$" else F.lit(p) for p in REASONS[which]])             # noqa: E731
    reasons = [F.when(pct.isNotNull(), say("seasonal", pct=ordinal(pct)))]
    if has("rx_pct"):
        reasons.append(F.when(F.col("rx_pct").isNotNull(), say("spatial", pct=ordinal(F.col("rx_pct")))))
    if has("agreeing"):
        reasons.append(F.when(F.size("agreeing") > 0, say("agreement", n=F.size("agreeing").cast("string"), names=F.array_join("agreeing", ", "))))
    if has("confidence"):
        reasons.append(F.when(F.col("confidence").isNotNull(), say("confidence", p=F.format_string("%.2f", F.col("confidence").cast("double")))))
    reasons.append(F.when(no_field, F.lit(NO_SAMPLE)))
    if has("nearest_name") and has("nearest_m"):
        reasons.append(F.when(F.col("nearest_name").isNotNull(), say("nearest", name=F.col("nearest_name"), km=F.format_string("%.1f", F.col("nearest_m") / 1000))))
    listed = F.array_compact(F.array(*reasons))
    texts = lambda items: F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")         # noqa: E731
    why = F.when(closed, texts([CLOSED])).when(stand_down, F.concat(listed, texts([NORMAL_HERE]))).otherwise(listed)
    needed = texts(NEEDED["ANALYST_REVIEW"])
    for name in ("FIELD_VERIFICATION", "MANAGE_CONFIRMED_EVENT", "STAND_DOWN_CONTINUE_MONITORING", "NO_ACTION"):
        needed = F.when(action == name, texts(NEEDED[name])).otherwise(needed)
    return df.withColumns({"action": action, "action_priority": level, "reasons": why, "evidence_needed": needed, "decision_deadline": deadline, "not_recommended": texts(NOT_ADVISED)})


def alert_message(area: Column, event_type: Column, pct: Column, n_agree: Column) -> Column:
    text = F.lit("Water anomaly")
    for k, v in EVENT_TYPES.items():
        text = F.when(event_type == k, F.lit(v)).otherwise(text)
    season = F.when(pct.isNotNull(), F.concat(F.format_string("%.0f", pct), F.lit("th percentile for this season.")))
    second = F.when(n_agree > 1, "A second satellite source agrees.").otherwise("One satellite source only.")
    return F.concat_ws(" ", F.concat(F.lit("Unusual water spotted near "), area, F.lit(".")), F.concat(F.lit("Suspected: "), text, F.lit(".")), season, second,
                       F.lit("Needs an analyst's review."))


def new_alerts(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Alerts for first-seen, operational, open incidents; the level follows the priority."""
    fresh = incoming.join(known.select("incident_id"), "incident_id", "left_anti")
    fresh = fresh.where((F.coalesce("role", F.lit("operational")) == "operational") & F.col("status").isin(OPEN_STATES))
    up = F.upper(F.coalesce("priority", F.lit("")))
    return fresh.withColumn("level", F.when(up.isin("HIGH", "MEDIUM"), up).otherwise("LOW"))


def alert_list(alerts: DataFrame, unacknowledged_only: bool = True) -> DataFrame:
    return (alerts.where(F.col("acknowledged_at").isNull()) if unacknowledged_only else alerts).orderBy(F.col("created_at").desc())


def audit_log(events: DataFrame, limit: int, entity_type: str | None = None, entity_id=None) -> DataFrame:
    """Newest audit rows, optionally of one entity."""
    out = events
    if entity_type is not None:
        out = out.where(F.col("entity_type") == entity_type)
    if entity_id is not None:
        out = out.where(F.col("entity_id") == entity_id)
    return out.orderBy(F.col("seq").desc()).limit(limit)


def payload_problems(df: DataFrame, payload: str) -> DataFrame:
    """Add ``problems``: missing keys, invalid enums, ranges and geometry, physical units on a proxy.

    ``payload`` is JSON text or already a VARIANT.  The document is parsed once; members are read from the binary
    form, and missing keys are one difference of arrays (a present null counts as present).  Text that is no object lacks every key.
    """
    parsed = F.col(payload) if df.schema[payload].dataType.simpleString() == "variant" else F.try_parse_json(payload)
    df = df.withColumn("_v", parsed)
    text = lambda path: F.try_variant_get("_v", f"$.{path}", "string")                                  # noqa: E731
    keys = F.coalesce(F.map_keys(F.try_variant_get("_v", "$", "map<string,variant>")), F.array().cast("array<string>"))
    missing = F.transform(F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), keys), lambda k: F.concat(F.lit("missing "), k))
    problems = [F.when(~F.coalesce(text("status").isin(STATES), F.lit(False)), "invalid status"),
                F.when(~F.coalesce(text("event_type_hypothesis").isin(list(EVENT_TYPES)), F.lit(False)), "invalid event type")]
    for k in ("severity", "confidence"):
        problems.append(F.when(~F.try_variant_get("_v", f"$.{k}", "double").between(0.0, 1.0), F.lit(f"{k} out of [0, 1]")))
    geometry = F.try_variant_get("_v", "$.geometry", "variant")
    kind = F.coalesce(text("geometry.type").isin("Polygon", "MultiPolygon", "Point"), F.lit(False))
    problems.append(F.when(geometry.isNotNull() & ~F.is_variant_null(geometry) & ~kind, "invalid geometry type"))
    member = lambda e, k: F.try_variant_get(e, f"$.{k}", "string")                                       # noqa: E731
    estimates = F.try_variant_get("_v", "$.water_quality.estimates", "map<string,variant>")
    uncalibrated = F.map_filter(estimates, lambda _, e: F.coalesce(member(e, "units").isin(PHYSICAL_UNITS), F.lit(False)) & ~F.coalesce(member(e, "quantity_kind").isin("CALIBRATED", "GENERIC_CALIBRATION"), F.lit(False)))
    named = F.coalesce(F.transform(F.array_sort(F.map_keys(uncalibrated)), lambda k: F.concat(k, F.lit(": physical units on an uncalibrated proxy"))), F.array().cast("array<string>"))
    return df.withColumn("problems", F.concat(missing, F.array_compact(F.array(*problems)), named)).drop("_v")


def merge_sample_plan(current: DataFrame, plan: DataFrame) -> DataFrame:
    """PLANNED points missing from the new plan become REMOVED, planned ones are upserted, other statuses stay."""
    c = current.select("incident_id", "code", F.col("status").alias("_old"), F.col("role").alias("_orole"))
    p = plan.select("incident_id", "code", F.col("role").alias("_nrole"), F.lit(True).alias("_new"))
    j = c.join(p, ["incident_id", "code"], "full")
    status = (F.when(F.col("_old").isNull(), "PLANNED").when(F.col("_new").isNull() & (F.col("_old") == "PLANNED"), "REMOVED")
              .when(F.col("_new") & F.col("_old").isin("REMOVED", "PLANNED"), "PLANNED").otherwise(F.col("_old")))
    return j.select("incident_id", "code", status.alias("status"), F.coalesce("_nrole", "_orole").alias("role"))


def field_result_effects(samples: DataFrame, incidents: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A result moves its sample to RESULT_RECEIVED and an incident waiting for it back to review."""
    hit = results.select("incident_id", "code").distinct().withColumn("_hit", F.lit(True))
    s = samples.join(hit, ["incident_id", "code"], "left").withColumn("status", F.when(F.col("_hit"), "RESULT_RECEIVED").otherwise(F.col("status"))).drop("_hit")
    touched = results.select("incident_id").distinct().withColumn("_hit", F.lit(True))
    i = incidents.join(touched, "incident_id", "left")
    i = i.withColumn("status", F.when(F.col("_hit") & (F.col("status") == "FIELD_VALIDATION_REQUIRED"), "UNDER_REVIEW").otherwise(F.col("status"))).drop("_hit")
    return s, i


# ---------------------------------------------------------------- models
def status_change_problem(action: Column, before: Column, actor: Column, gate_passed: Column) -> Column:
    """Why a promotion or rollback is not valid; NULL when it is."""
    human = ~F.lower(F.trim(F.coalesce(actor, F.lit("")))).isin(SYSTEM_ACTORS)
    promote, rollback = action == "promote", action == "rollback"
    return (F.when((promote | rollback) & ~human, "needs a named human")
            .when(promote & ~before.isin("CANDIDATE", "STAGING"), "only candidates can be promoted")
            .when(promote & ~F.coalesce(gate_passed, F.lit(False)), "gate not passed")
            .when(rollback & ~before.isin("RETIRED", "STAGING"), "only retired models can be rolled back"))


def production_model(log: DataFrame) -> DataFrame:
    """Current production model per task from the change log.

    ``log``: task, model_id, seq, action (promote, rollback, other), status, status_before,
    actor, gate_passed.  The latest valid promotion or rollback of a task retires every
    earlier one, unless its model was moved on afterwards.
    """
    problem = status_change_problem(F.col("action"), F.col("status_before"), F.col("actor"), F.col("gate_passed"))
    valid = log.where(problem.isNull())
    last = valid.where(F.col("status") == "PRODUCTION").groupBy("task").agg(F.max_by(F.struct("model_id", "seq", "actor"), "seq").alias("_p"))
    current = valid.groupBy("task", "model_id").agg(F.max("seq").alias("_last"))
    out = last.select("task", "_p.*").join(current, ["task", "model_id"])
    return out.where(F.col("seq") == F.col("_last")).select("task", "model_id", "actor", F.col("seq").alias("promoted_seq"))


# ---------------------------------------------------------------- audit chain and lineage
def chain_hash(prev: Column, canonical: Column) -> Column:
    return F.sha2(F.concat(prev, canonical), 256)


def verify_chain(events: DataFrame, keys: Sequence[str], seq: str, canonical: str, prev_hash: str, hash_: str, chunk: Column) -> DataFrame:
    """First bad sequence number, count and head of each hash chain; rows are recomputed in parallel."""
    linked = previous_row(events, keys, [seq], chunk, {hash_: "_before"})
    bad = ((F.col(prev_hash) != F.coalesce("_before", F.lit(GENESIS))) | (F.col(hash_) != chain_hash(F.col(prev_hash), F.col(canonical))))
    g = linked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(bad, F.col(seq))).alias("first_bad_seq"), F.max_by(hash_, seq).alias("_head"))
    return g.select(*keys, "n", F.col("first_bad_seq").isNull().alias("ok"), "first_bad_seq", F.when(F.col("first_bad_seq").isNull(), F.col("_head")).alias("head"))


def provenance_completeness(sources: DataFrame, record: str, algorithm: DataFrame) -> DataFrame:
    """Share of required lineage fields present per record, counted over its sources and algorithm.

    ``sources``: record, ord and the nine fields; ``algorithm``: record, name, description.
    """
    present = sum([F.when(F.coalesce(F.col(f), F.lit("")) != "", 1).otherwise(0) for f in SOURCE_FIELDS], F.lit(0))
    s = sources.groupBy(record).agg(F.count(F.lit(1)).alias("n_sources"), F.sum(present).alias("_have"))
    a = algorithm.select(record, sum([F.when(F.coalesce(F.col(f), F.lit("")) != "", 1).otherwise(0) for f in ("name", "description")], F.lit(0)).alias("_alg"))
    out = a.join(s, record, "left").fillna(0, ["n_sources", "_have"])
    total = F.col("n_sources") * len(SOURCE_FIELDS) + 2
    have = F.col("_have") + F.col("_alg")
    return out.select(record, "n_sources", (have / total).alias("completeness"), (total - have + F.when(F.col("n_sources") == 0, 1).otherwise(0)).alias("n_missing"))


def missing_fields(sources: DataFrame, record: str, order: str) -> DataFrame:
    """One row per missing source field."""
    gaps = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f), F.lit("")) == "", F.lit(f)) for f in SOURCE_FIELDS]))
    return sources.select(record, order, F.explode(gaps).alias("field"))


# ---------------------------------------------------------------- area status and reports
def aoi_status(rows: DataFrame, incidents: DataFrame, now: Column, min_water: int = 200) -> DataFrame:
    """Last usable observation, counts, recent activity and open incidents per area."""
    ok = F.col("error").isNull() & (F.col("n_water") >= min_water)
    elapsed = F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("at").cast("timestamp"))) / 86_400)     # whole days since, not midnights
    g = rows.groupBy("aoi").agg(
        F.max(F.when(ok, F.col("at"))).alias("last_observation"), F.max_by("platform", F.when(ok, F.struct("at", "platform"))).alias("last_platform"),
        F.max_by("p95", F.when(ok, F.struct("at", "platform"))).alias("last_p95"), F.count_if(ok).alias("n_valid"),
        F.count_if(ok & (elapsed <= 7)).alias("n_obs_7d"))
    i = incidents.groupBy("aoi").agg(F.count_if(F.col("status").isin(OPEN_STATES)).alias("open_incidents"))
    return g.join(i, "aoi", "left").fillna(0, ["open_incidents"])


def pass_pattern(rows: DataFrame) -> DataFrame:
    """Last pass of every platform and orbit over an area."""
    return rows.where(F.col("orbit").isNotNull()).groupBy("aoi", "platform", "orbit").agg(F.max("at").alias("last_pass"))


def next_pass(pattern: DataFrame, now: Column, repeat_days: int = 10) -> DataFrame:
    """The next expected pass of every pattern row: last + k repeats, strictly after now."""
    step = repeat_days * 86400
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    last, t = F.timestamp_diff("SECOND", origin, F.col("last_pass")), F.timestamp_diff("SECOND", origin, now)
    k = F.greatest(F.ceil((t - last) / step), F.lit(1))
    at = last + k * step
    return pattern.withColumn("next_at", F.when(at <= t, at + step).otherwise(at))


def earliest_pass(passes: DataFrame, now: Column) -> DataFrame:
    """The next pass over any of the areas, and the time until then in words; no row without a pattern."""
    best = passes.agg(F.min(F.struct("next_at", "aoi", "platform", "orbit")).alias("_b")).where(F.col("_b").isNotNull()).select("_b.*")
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    minutes = F.round((F.col("next_at") - F.timestamp_diff("SECOND", origin, now)) / 60).cast("long")
    days = F.format_string("%dd %dh", F.floor(minutes / 1440), F.floor(minutes % 1440 / 60))
    hours = F.format_string("%dh %02dm", F.floor(minutes / 60), minutes % 60)
    return best.withColumn("in_text", F.when(minutes >= 1440, days).otherwise(hours))


def counts_map(rows: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """How often each value occurs per key, as a map in order of the value."""
    per = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_v", "_n")))).alias(out))


def data_quality(rows: DataFrame, keys: Sequence[str], fractions: Sequence[str]) -> DataFrame:
    """Acquisition counts, usable share, range, offsets applied, platforms and processing baselines, and medians of the quality fractions."""
    ok = F.col("error").isNull()
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_datatakes"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.count_if(ok & (F.col("n_water") >= 500)).alias("n_usable"),
        F.min(F.when(ok, F.col("d"))).alias("first_d"), F.max(F.when(ok, F.col("d"))).alias("last_d"), F.count_if(ok & (F.col("baseline") >= 4.0)).alias("n_offset_applied"))
    long = rows.where(ok).select(*keys, *fractions).unpivot(list(keys), list(fractions), "_f", "_v")
    med = exact_quantiles(long, [*keys, "_f"], "_v", {"_m": 0.5}).groupBy(*keys).pivot("_f", list(fractions)).agg(F.first("_m"))
    g = join_nulls(g, med.select(*keys, *[F.col(f).alias(f"median_{f}") for f in fractions]), keys, "left")
    for value, name in (("platform", "platforms"), ("baseline", "processing_baselines")):
        g = join_nulls(g, counts_map(rows.where(ok), keys, value, name), keys, "left")
    return g


def tournament(areas: DataFrame) -> DataFrame:
    """Five criteria in [0, 1], weighted total and rank.

    Needs usable, regime, positive, negative, register, critical per area; the maxima are
    one aggregated row joined back.
    """
    top = areas.agg(F.greatest(F.max("usable"), F.lit(1)).alias("_mu"), F.greatest(F.max("critical"), F.lit(1)).alias("_mc")).withColumn("_k", F.lit(1))
    a = areas.withColumn("_k", F.lit(1)).join(top, "_k").drop("_k")
    regime = F.lower(F.coalesce("regime", F.lit("")))
    shallow = regime.contains("shallow")
    pos, neg = F.coalesce("positive", F.lit(0)), F.coalesce("negative", F.lit(0))
    scores = {
        "data": F.col("usable") / F.col("_mu"),
        "optics": F.when(regime.contains("optically deep"), 1.0).when(regime.contains("lagoon") & shallow, 0.2).when(shallow, 0.4).otherwise(0.55),
        "evidence": F.least(F.lit(1.0), 0.5 * F.least(F.lit(1.0), pos / 10) + 0.5 * F.least(F.lit(1.0), F.col("register") / 3)),
        "exposure": F.col("critical") / F.col("_mc"),
        "burden": F.when(F.col("positive").isNull() | (pos + neg == 0), 0.5).otherwise(ratio(pos.cast("double"), (pos + neg).cast("double"))),
    }
    total = sum([TOURNAMENT_WEIGHTS[k] * F.col(f"s_{k}") for k in scores], F.lit(0.0))
    a = a.withColumns({f"s_{k}": v for k, v in scores.items()}).withColumn("total", total).drop("_mu", "_mc")
    # one row per area: a short list
    return a.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "aoi")))


def confirmation_rates(labels: DataFrame) -> DataFrame:
    """Confirmed over referenced, per area and pooled per coast, in one grouping-sets pass."""
    known = labels.where(F.col("y").isNotNull())
    confirmed = F.count_if(F.col("y") == 1)
    return known.groupingSets([["coast", "aoi"], ["coast"]], "coast", "aoi").agg(
        F.count(F.lit(1)).alias("referenced"), confirmed.alias("confirmed"), (confirmed / F.count(F.lit(1))).alias("rate"))


def portability(labels: DataFrame, scores: DataFrame, candidate: str, rule: str) -> DataFrame:
    """Range of the areas' confirmation rates, and on how many held-out areas the candidate beats the rule.

    ``scores``: one row per held-out area; areas without both scores are not counted.
    """
    per_area = confirmation_rates(labels).where(F.col("aoi").isNotNull())
    rates = per_area.agg(F.count(F.lit(1)).alias("n_areas"), F.min("rate").alias("rate_min"), F.max("rate").alias("rate_max"))
    both = scores.where(F.col(candidate).isNotNull() & F.col(rule).isNotNull())
    wins = both.agg(F.count_if(F.col(candidate) > F.col(rule)).alias("n_wins"), F.count(F.lit(1)).alias("n_scorable"))
    return rates.crossJoin(F.broadcast(wins))                                                   # one row each


def largest_rejections(labels: DataFrame, k: int = 5) -> DataFrame:
    return labels.where(F.col("y") == 0).orderBy(F.col("area_km2").desc(), "label_id").limit(k)
