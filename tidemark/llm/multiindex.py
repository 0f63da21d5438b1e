"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised apart, each by its own centroids (k-means on a
bounded, hash-drawn sample), so a vector falls in one of K x K cells.  A query ranks the
centroids of each half by inner product and walks the pairs of centroids by their sum, best
first, with a heap, until the cells it met hold the visiting share of all distinct vectors;
their entries are reranked by the exact inner product in double precision.  The share is
calibrated on the sample: the smallest that finds ``RECALL`` of the true neighbours there.

Every row is indexed.  Rows lie in shards of whole centroids of the first half, crowded ones
split by hash, and queries go to the shards that hold cells of theirs, in blocks, so a task
sees a bounded number of rows and queries.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part.  Ties go to the smaller id; a row is no neighbour of its own id;
queries that repeat an id count once (smallest vector); an empty table gives no rows;
columns other than id and vector are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import stored

SAMPLE = 20_000
CENTROIDS = 64
RECALL = 0.95
LEAST = 2_000
QUERY_BLOCK = 50_000


@dataclass
class Grid:
    halves: list[np.ndarray]
    share: float

    @property
    def k(self) -> int:
        return len(self.halves[0])

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        h = self.halves[0].shape[1]
        return [x[:, :h], x[:, h:]]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (_nearest(part, c) for part, c in zip(self.split(x), self.halves, strict=True))
        return a * self.k + b

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """Cells by falling sum of the two inner products."""
        scores = [(part @ c.T)[0] for part, c in zip(self.split(query[None]), self.halves, strict=True)]
        order = [np.argsort(-s, kind="stable").tolist() for s in scores]
        first, second = ([s[i] for i in o] for s, o in zip((scores[0].tolist(), scores[1].tolist()), order, strict=True))
        heap, k = [(-(first[0] + second[0]), 0, 0)], self.k
        while heap:
            _, i, j = heapq.heappop(heap)
            yield order[0][i] * k + order[1][j]
            if j + 1 < k:
                heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
            if j == 0 and i + 1 < k:
                heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))

    def visit(self, query: np.ndarray, sizes: np.ndarray, wanted: float) -> list[int]:
        met, held = [], 0
        for cell in self.walk(query):
            if sizes[cell]:
                met.append(cell)
                held += sizes[cell]
                if held >= wanted:
                    break
        return met


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *((x[k:k + 8192] @ c.T - (c ** 2).sum(1) / 2).argmax(1) for k in range(0, len(x), 8192))])


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    c = np.concatenate([c, np.repeat(c[:1], k - len(c), axis=0)])
    for _ in range(rounds):
        a = _nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(a, minlength=k)
        np.add.at(sums, a, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def fit_grid(x: np.ndarray, top: int, recall: float = RECALL, queries: int = 200) -> Grid:
    """Centroids from the sample and the smallest share (in twentieths) with the wanted recall in it."""
    k = int(min(CENTROIDS, max(2, np.sqrt(len(x)) / 2)))
    h = (x.shape[1] + 1) // 2
    grid = Grid([_kmeans(x[:, :h], k), _kmeans(x[:, h:], k)], 1.0)
    cells = grid.cells(x)
    sizes = np.bincount(cells, minlength=k * k)
    pick = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int)
    shares = np.arange(1, 21) / 20
    found = np.zeros(20)
    for i in pick:
        score = x @ x[i]
        score[i] = -np.inf
        truth = np.argsort(-score)[:min(top, len(x) - 1)]
        rank = np.full(k * k, np.inf)
        held = 0
        for cell in grid.walk(x[i]):
            rank[cell] = held                                     # rows met before this cell
            held += sizes[cell]
        found += [(rank[cells[truth]] < s * len(x)).mean() if len(truth) else 1.0 for s in shares]
    good = np.flatnonzero(found / max(len(pick), 1) >= recall)
    grid.share = float(shares[good[0]]) if len(good) else 1.0
    return grid


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.expr("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x != 0)"))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (usual.d if usual else 0))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, top: int = 20, recall: float = RECALL) -> DataFrame:
    """The ``top`` nearest found of each row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = stored(valid_vectors(vectors, id_col, vec_col), "vectors")
    schema = "query_id long, vec_id long, score double"
    sample = rows.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(SAMPLE).toPandas()             # bounded by SAMPLE
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    grid = spark.sparkContext.broadcast(fit_grid(np.stack(sample["v"].to_numpy()).astype(np.float64), top, recall))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = grid.value.cells(_matrix(batch.column(1), batch.num_rows))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

    placed = stored(rows.mapInArrow(place, "id long, v array<double>, cell int"), "placed")
    k = grid.value.k
    sizes, counts = np.zeros(k * k, np.int64), np.zeros(k, np.int64)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("v")).alias("m")).collect():      # K x K rows at most
        sizes[r.cell] = min(r.m, r.n)
        counts[r.cell // k] += r.n
    total = int(counts.sum())
    shard_rows = int(np.clip(total / (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))), 4096, 65_536))
    parts = np.maximum(1, -(-counts // shard_rows))                 # pieces of a crowded centroid
    first, shard, room, shards_of = [], -1, 0, []
    for c in range(k):
        if parts[c] > 1 or room < counts[c]:
            shard, room = shard + 1, shard_rows
        first.append(shard)
        shards_of.append(list(range(shard, shard + int(parts[c]))))
        room -= int(counts[c])
        if parts[c] > 1:
            shard, room = shard + int(parts[c]) - 1, 0
    wanted = max(LEAST, grid.value.share * sizes.sum())
    asked = stored(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grid.value
        for batch in batches:
            origin, shard_, bits = [], [], []
            for i, q in enumerate(_matrix(batch.column(1), batch.num_rows) if batch.num_rows else ()):
                flags = np.zeros(k * k, bool)
                flags[g.visit(q, sizes, wanted)] = True
                packed = np.packbits(flags).tobytes()
                for s in sorted({s for c in np.flatnonzero(flags.reshape(k, k).any(1)) for s in shards_of[c]}):
                    origin.append(i)
                    shard_.append(s)
                    bits.append(packed)
            at = pa.array(origin, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(shard_, pa.int32()), pa.array(bits, pa.binary())], ["query_id", "q", "shard", "bits"])

    starts = F.array(*[F.lit(x) for x in first])
    pieces = F.array(*[F.lit(int(x)) for x in parts])
    centroid = F.floor(F.col("cell") / k).cast("int")
    index = placed.select("id", "v", "cell", (F.get(starts, centroid) + F.pmod(F.xxhash64("id"), F.get(pieces, centroid).cast("long"))).cast("int").alias("shard"),
                          F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    probes = asked.repartition("id").mapInArrow(probe, "query_id long, q array<double>, shard int, bits binary").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            ids, x, cell = left.column("id").to_numpy(), _matrix(left.column("v"), left.num_rows), left.column("cell").to_numpy()
            asked_ids, q = right.column("query_id").to_numpy(), _matrix(right.column("q"), right.num_rows)
            bits = np.frombuffer(b"".join(right.column("bits").to_pylist()), np.uint8).reshape(right.num_rows, -1)
            for a in range(0, len(q), 128):
                score = q[a:a + 128] @ x.T
                score[~np.unpackbits(bits[a:a + 128], axis=1)[:, cell].astype(bool)] = -np.inf
                score[asked_ids[a:a + 128][:, None] == ids[None]] = -np.inf
                cut = np.partition(score, -min(top, len(x)), axis=1)[:, -min(top, len(x))]
                for i in range(len(score)):
                    near = np.flatnonzero((score[i] >= cut[i] - 1e-9 * (1 + abs(cut[i]))) & np.isfinite(score[i]) if np.isfinite(cut[i]) else np.isfinite(score[i]))
                    exact = (x[near] * q[a + i]).sum(axis=1)
                    best = np.lexsort((ids[near], -exact))[:top]
                    out[0].append(np.full(len(best), asked_ids[a + i]))
                    out[1].append(ids[near][best])
                    out[2].append(exact[best])
        return pa.table({n: np.concatenate(v) for n, v in zip(("query_id", "vec_id", "score"), out, strict=True)})

    found = index.groupBy("shard", "block").cogroup(probes.groupBy("shard", "block")).applyInArrow(rerank, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
