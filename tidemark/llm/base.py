"""Registry of the operators' queries, table access and shared storage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Text bytes that one numpy step works on, whatever the size of the Arrow batch.
SLICE_BYTES = 2 << 20


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL."""
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder, as a URI."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir()
    return f"{root if ':' in root else 'file://' + root}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "step") -> DataFrame:
    """Cut the lineage with compressed Parquet in the shared folder."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Rows up to which a counted side is broadcast by ``join_counted``.
COUNTED_ROWS = 100_000


def join_counted(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner", limit: int = COUNTED_ROWS) -> DataFrame:
    """Null-safe join with a stored ``side``: broadcast if its counted rows are within ``limit``, else a shuffled join."""
    renamed = side.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(renamed[f"_k_{k}"])
    few = side.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(renamed) if few else renamed, on, how).drop(*[f"_k_{k}" for k in keys])


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], label: str = "numbered") -> DataFrame:
    """``df`` with ``rank`` (0-based place within its group in ``order``) and ``n`` (the group's rows), for groups of any size.

    Rows are range-sorted over all tasks and stored; a table of one row per task and group gives the place
    where each task's rows begin.  Ties get different places; a salt spreads them over tasks.  Nulls come first.
    """
    group = list(group)
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = (df.withColumn("_salt", F.monotonically_increasing_id())
            .repartitionByRange(parts, *group, *order, "_salt").sortWithinPartitions(*group, *order, "_salt").drop("_salt")
            .withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    laid = stored(laid, label)
    runs = laid.groupBy(*group, "_part").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(runs.select(*group, "_part", "_first", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_base"),
                              F.sum("_m").over(Window.partitionBy(*group)).alias("n")), label)
    placed = join_counted(laid, runs, [*group, "_part"])
    return placed.withColumn("rank", F.col("_base") + F.col("_pos") - F.col("_first")).drop("_part", "_pos", "_first", "_base")


def release() -> None:
    """Give freed memory of a Python worker back to the machine, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def utf8_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least: long texts stay whole."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(raw: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and its row, of texts laid end to end.

    ``at`` holds row offsets into ``raw`` and begins with 0; words never cross rows.
    """
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    inside = ~separator[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.empty(len(raw), bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    after = np.empty(len(raw), bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    start = np.flatnonzero(inside & (before | edge[:-1]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (unsigned 64-bit, wrapping)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Spans beyond this length are hashed one by one.
LONG_SPAN = 2048
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: eight bytes at a time enter a mixed state that begins with the length."""
    length = (end - start).astype(np.int64)
    padded = np.zeros(len(raw) + 16, np.uint8)
    padded[:len(raw)] = raw
    eight = np.ndarray((len(raw) + 8,), "<u8", buffer=padded, strides=(1,))
    h = mix64(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    live, k = np.flatnonzero((length > 0) & (length <= LONG_SPAN)), 0
    while len(live):
        part = eight[start[live] + k] & _MASKS[np.minimum(length[live] - k, 8)]
        h[live] = mix64((h[live] ^ part) + np.uint64(0xD6E8FEB86659FD93))
        k += 8
        live = live[length[live] > k]
    for i in np.flatnonzero(length > LONG_SPAN).tolist():
        h[i] = xxhash.xxh64_intdigest(padded[start[i]:end[i]].tobytes(), seed=42)
    return h
