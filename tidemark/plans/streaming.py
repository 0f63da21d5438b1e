"""The streaming jobs over the order table, compared with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ingest as ig
from tidemark.operators import workflow as wf
from tidemark.plans.base import query
from tidemark.plans.ingest import SQL_TAGS, items
from tidemark.plans.workflow import PRIO, pick
from tidemark.sources.tables import table
from tidemark.streaming import incremental as inc


def order_stream(spark, d):
    """The order table as a file stream."""
    schema = table(spark, d, "orders").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(d)


@query("incremental_screen_stream", f"WITH {SQL_TAGS} SELECT tag FROM tags WHERE NOT (year(d) < 1999 AND month(d) <> 4)")
def incremental_screen_stream(spark, d):
    o = ig.overpasses(items(spark, d), 30)
    done = o.where((F.year("d") < 1999) & (F.month("d") != 4)).select(ig.overpass_tag(F.col("d"), F.col("orbit"), F.col("platform")).alias("tag"))
    stream = order_stream(spark, d).select(
        F.col("o_orderkey").alias("item_id"), F.to_date("o_orderdate").alias("d"), (F.col("o_custkey") % 7).alias("orbit"),
        F.concat(F.lit("Sentinel-2"), F.when(F.col("o_orderstatus") == "O", "A").otherwise("B")).alias("platform"), (F.floor("o_totalprice") % 101).cast("int").alias("cloud"))
    out = inc.shared_folder(spark, "screen")
    inc.run_to_end(inc.screen_overpasses(stream, done, out, out + "-log", 30))
    return spark.read.parquet(out).select("tag")


@query("alert_new_stream", f"""WITH q AS (SELECT o_orderkey AS incident_id, {pick(wf.STATES, 'o_custkey % 7')} AS status, CASE WHEN o_orderkey % 8 = 0 THEN 'negative_control' ELSE 'operational' END AS role, {PRIO} AS priority, year(o_orderdate) AS yr FROM orders)
SELECT incident_id, CASE WHEN upper(priority) IN ('HIGH', 'MEDIUM') THEN upper(priority) ELSE 'LOW' END AS level FROM q WHERE incident_id % 5 <> 2 AND role = 'operational' AND status IN ('MONITORING', 'DETECTED', 'UNDER_REVIEW', 'FIELD_VALIDATION_REQUIRED')""")
def alert_new_stream(spark, d):
    cols = ["o_orderkey AS incident_id", f"{pick(wf.STATES, 'o_custkey % 7')} AS status", "CASE WHEN o_orderkey % 8 = 0 THEN 'negative_control' ELSE 'operational' END AS role", f"{PRIO} AS priority", "cast(o_orderdate as timestamp) AS seen_at"]
    known = table(spark, d, "orders").where(F.col("o_orderkey") % 5 == 2).select(F.col("o_orderkey").alias("incident_id"))
    out = inc.shared_folder(spark, "alerts")
    inc.run_to_end(inc.raise_alerts(order_stream(spark, d).selectExpr(*cols), known, out, out + "-log", "seen_at"))
    return spark.read.parquet(out).select("incident_id", "level")
