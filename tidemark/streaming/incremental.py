"""The two incremental jobs as Structured Streaming: screening new overpasses, raising new alerts.

What has been seen is keyed state of the stream, held by a RocksDB store and its change log in the checkpoint
location; earlier output is never read again, so the time of a batch depends on the batch alone.  No watermark
drops what comes late, so the state keeps one small entry per overpass or incident ever seen.  Each micro-batch is
written to its own ``batch_id`` folder (overwritten on a replay), so a restarted batch leaves the same rows.
"""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ingest, workflow
from tidemark.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def on_rocksdb(spark: SparkSession) -> None:
    """Hold state outside the heap, its changes logged, unless the session already names such a store."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _started(stream: DataFrame, out: str, checkpoint: str, available_now: bool, mode: str = "append"):
    def batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    w = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def screen_overpasses(items: DataFrame, done: DataFrame | None, out: str, checkpoint: str, max_cloud: float, available_now: bool = True):
    """Append the overpasses not screened before; ``done`` is an existing table of tags.

    One overpass arrives as many tiles, in one batch or in several; the first clear tile brings its tag.
    """
    on_rocksdb(items.sparkSession)
    tags = ingest.clear_tiles(items, max_cloud).select("d", ingest.overpass_tag(F.col("d"), F.coalesce("orbit", F.lit(0)), F.col("platform")).alias("tag"))
    if done is not None:
        tags = tags.join(done.select("tag"), "tag", "left_anti")
    return _started(tags.select("d", "tag").dropDuplicates(["tag"]), out, checkpoint, available_now)


def raise_alerts(incidents: DataFrame, known: DataFrame, out: str, checkpoint: str, event_time: str, available_now: bool = True):
    """One alert per first-seen open incident, however late it comes; inside a micro-batch the first open row by ``event_time`` counts.

    The state of an incident is a native aggregate: the times of the batches (fixed for a batch, replayed or not) that brought it first
    and last.  Where they are equal every row of it came in this batch, so its least row is the alert.
    """
    on_rocksdb(incidents.sparkSession)
    fresh = workflow.new_alerts(incidents, known).select("incident_id", F.unix_micros(F.col(event_time).cast("timestamp")).alias("at"), "level")
    fresh = fresh.withColumn("_batch", F.current_timestamp())
    seen = fresh.groupBy("incident_id").agg(F.min(F.struct("at", "level")).alias("_first"), F.min("_batch").alias("_since"), F.max("_batch").alias("_until"))
    alerts = seen.where(F.col("_since") == F.col("_until")).select("incident_id", F.col("_first.level").alias("level"))
    return _started(alerts, out, checkpoint, available_now, "update")


def run_to_end(stream) -> None:
    """Wait for an available-now stream and surface its failure."""
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()
