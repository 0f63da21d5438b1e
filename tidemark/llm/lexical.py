"""Ranked lexical search: many queries at once by sharing partial document accumulators.

Items (queries) that share words are laid next to each other and cut into blocks of bounded size.  For
each block one task mines the term sets that several items share: the largest set common to two items
becomes a node of a directed graph, replaces itself in every item that holds all of it, and may become
part of larger sets, until no two items share two nodes.  Documents are cut into slices; in a slice
each term's contributions are computed once, each node adds its children's accumulators once, and an
item adds the few nodes that are left of it.  So a word set shared by forty items is summed once, not
forty times, for every document.

Documents are read by Spark: one pass counts terms of the block's vocabulary (stored, two integers per
term and document), one native aggregate gives document frequencies, one pass scores.  What is broadcast
is one batch of blocks, at most ``BATCH_TERMS`` terms; more items mean more passes, not larger ones.
Each task keeps its best rows per item; a two-step window picks the best of all.

Results for odd input: null texts have no terms and are never ranked; items that are null, empty or of
unknown words return no rows; repeated documents are ranked each, equal scores by ascending id, null ids
last; equal rows of the item table count once, different texts of one item id form one item; empty
tables give no rows; long texts are counted in pieces cut at separators; columns other than the named
ones are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordering import running_sums
from tidemark.llm.base import numbered, release, stored

TOP = 10
#: k1 = 1, b = 0.75 as integers: a term's share is SCALE * tf / (1000 tf + 8 m), m = 25 + 75 n / mean n.
SCALE = 1_000_000_000
#: Items and distinct terms of a block; blocks up to BATCH_TERMS distinct terms are scored in one pass.
BLOCK_ITEMS, BLOCK_TERMS, BATCH_TERMS = 256, 32_768, 131_072
#: Bytes of text counted at once, and cells (nodes x documents) of a slice of accumulators.
PIECE, CELLS = 4 << 20, 2_000_000

PATTERN = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Separator bytes become blanks and A-Z small; every other byte stays.
FOLDED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(PATTERN), F.lit(0))


# ---- the queries -----------------------------------------------------------------------------

def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, the number of its row and its terms (term, times), bounded by the item's own text."""
    words = (items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
             .select("item_id", F.explode(terms_of(F.col("text"))).alias("term"))
             .groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")))
    whole = words.groupBy("item_id").agg(F.collect_list(F.struct("term", "times")).alias("terms"))
    return whole.withColumns({"near": F.array_min(F.transform("terms", lambda t: F.xxhash64(t["term"]))), "size": F.size("terms").cast("long")})


def blocks_of(items: DataFrame) -> DataFrame:
    """Items with ``block``: neighbours by their smallest hashed term, within the limits of a block."""
    placed = numbered(items, [], ["near", "item_id"], "items").withColumnRenamed("rank", "item").drop("n")
    summed = running_sums(placed, [], F.col("item"), F.floor(F.col("item") / 4096), {"size": "upto"})
    return summed.withColumn("block", F.struct(F.floor((F.col("upto") - F.col("size")) / BLOCK_TERMS).alias("a"), F.floor(F.col("item") / BLOCK_ITEMS).alias("b"))).drop("upto", "near")


def shared_sets(sets: list[set[int]], n_symbols: int) -> tuple[list[list[int]], list[list[int]]]:
    """Nodes of two or more children, and what is left of each set.  Node k is symbol n_symbols + k.

    Symbols of the same sets are merged first.  Then the largest overlap of two sets becomes a node and
    replaces itself wherever it is whole, until all overlaps are below two symbols.
    """
    nodes: list[list[int]] = []
    holders: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    alike: dict[tuple[int, ...], list[int]] = {}
    for x, who in sorted(holders.items()):
        if len(who) > 1:
            alike.setdefault(tuple(who), []).append(x)
    sets = [set(s) for s in sets]

    def replace(children: list[int], who) -> int:
        nodes.append(sorted(children))
        for i in who:
            sets[i] -= set(children)
            sets[i].add(n_symbols + len(nodes) - 1)
        return n_symbols + len(nodes) - 1

    for who, xs in alike.items():
        if len(xs) > 1:
            replace(xs, who)
    # overlaps of any two sets, over the symbols that several sets hold
    shared = sorted({x for x, c in Counter(x for s in sets for x in s).items() if c > 1})
    at = {x: k for k, x in enumerate(shared)}
    has = np.zeros((len(sets), max(len(shared), 1)), np.float32)
    for i, s in enumerate(sets):
        has[i, [at[x] for x in s if x in at]] = 1
    overlap = has @ has.T
    np.fill_diagonal(overlap, 0)
    while overlap.size and overlap.max() >= 2:
        i, j = np.unravel_index(int(overlap.argmax()), overlap.shape)
        columns = np.flatnonzero((has[i] > 0) & (has[j] > 0))
        who = np.flatnonzero(has[:, columns].all(axis=1))
        has[np.ix_(who, columns)] = 0
        if len(shared) == has.shape[1]:
            has = np.hstack([has, np.zeros_like(has)])
        has[who, len(shared)] = 1
        shared.append(replace([shared[c] for c in columns], who.tolist()))
        overlap[who] = has[who] @ has.T
        overlap[:, who] = overlap[who].T
        np.fill_diagonal(overlap, 0)
    return nodes, [sorted(s) for s in sets]


PLAN = "terms array<string>, times array<long>, nodes array<array<int>>, item array<long>, item_id array<string>, left array<array<int>>"


def _mine(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sharing graph of one block; symbols are (term, times), then nodes."""
    pdf = pdf.sort_values("item")
    bags = [{(t["term"], int(t["times"])) for t in terms} for terms in pdf["terms"]]
    symbols = sorted(set().union(*bags))
    number = {s: k for k, s in enumerate(symbols)}
    nodes, left = shared_sets([{number[s] for s in bag} for bag in bags], len(symbols))
    return pd.DataFrame({"terms": [[t for t, _ in symbols]], "times": [[c for _, c in symbols]], "nodes": [nodes],
                         "item": [pdf["item"].tolist()], "item_id": [pdf["item_id"].tolist()], "left": [left]})


def sharing_plan(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per block of items: its symbols, its nodes in the order of evaluation, what each item adds up."""
    blocks = blocks_of(item_terms(items, id_col, text_col)).withColumn("item_id", F.col("item_id").cast("string"))
    return stored(blocks.groupBy("block").applyInPandas(_mine, PLAN), "plan")


class Batch:
    """Blocks scored in one pass: accumulator rows are terms, then terms that count several times, then nodes."""

    def __init__(self, rows):
        vocabulary: dict[str, int] = {}
        for r in rows:
            for t in r.terms:
                vocabulary.setdefault(t, len(vocabulary))
        self.terms = list(vocabulary)
        several: dict[tuple[int, int], int] = {}
        for r in rows:
            for t, c in zip(r.terms, r.times, strict=True):
                if c > 1:
                    several.setdefault((vocabulary[t], c), len(vocabulary) + len(several))
        self.several = list(several)
        self.nodes: list[list[int]] = []
        self.item, self.item_id, self.sums = [], [], []
        for r in rows:
            row = [vocabulary[t] if c == 1 else several[vocabulary[t], c] for t, c in zip(r.terms, r.times, strict=True)]
            for children in r.nodes:
                self.nodes.append([row[c] for c in children])
                row.append(len(vocabulary) + len(several) + len(self.nodes) - 1)
            self.item += r.item
            self.item_id += r.item_id
            self.sums += [[row[c] for c in left] for left in r.left]
        self.height = len(vocabulary) + len(several) + len(self.nodes)

    def scores(self, base: np.ndarray) -> np.ndarray:
        """Items x documents from the terms' contributions (``base``, laid in the first rows)."""
        at = len(self.terms)
        for tid, times in self.several:
            np.multiply(base[tid], times, out=base[at])
            at += 1
        for children in self.nodes:
            np.add.reduce(base.take(children, axis=0), axis=0, out=base[at])
            at += 1
        return np.stack([np.add.reduce(base.take(rows, axis=0), axis=0) for rows in self.sums])


def batches_of(plan: DataFrame, limit: int = BATCH_TERMS) -> Iterator[Batch]:
    held, terms = [], 0
    for row in plan.toLocalIterator():
        if held and terms + len(row.terms) > limit:
            yield Batch(held)
            held, terms = [], 0
        held.append(row)
        terms += len(row.terms)
    if held:
        yield Batch(held)


# ---- the documents ---------------------------------------------------------------------------

def count_terms(raw: bytes, get, piece: int = PIECE) -> tuple[int, Counter]:
    """Terms of a text and the counts of those that ``get`` knows; long texts piece by piece."""
    n, found, rest = 0, Counter(), b""
    for a in range(0, len(raw), piece):
        part = rest + raw[a:a + piece].translate(FOLDED)
        cut = len(part) if a + piece >= len(raw) else part.rfind(b" ") + 1
        words, rest = part[:cut].split(), part[cut:]
        n += len(words)
        found.update(map(get, words))
    found.pop(None, None)
    return n, found


def counted(docs: DataFrame, batch: Batch, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms of the text) and the batch's terms in it: tid, tf."""
    sent = docs.sparkSession.sparkContext.broadcast([t.encode() for t in batch.terms])
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {t: k for k, t in enumerate(sent.value)}.get
        for b in rows:
            texts = b.column(1).cast(pa.large_binary())
            total, sizes, tids, tfs = [], [0], [], []
            for k in range(len(texts)):
                n, found = count_terms(texts[k].as_py() or b"", get)
                total.append(n)
                tids += found.keys()
                tfs += found.values()
                sizes.append(len(tids))
            at = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.ListArray.from_arrays(at, pa.array(tids, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))],
                                             names=["doc_id", "n", "tid", "tf"])
        release()

    kind = source.schema["doc_id"].dataType.simpleString()
    return stored(source.mapInArrow(run, f"doc_id {kind}, n long, tid array<int>, tf array<int>"), "counted")


def _best(item: np.ndarray, score: np.ndarray, null: np.ndarray, doc: np.ndarray, top: int):
    order = np.lexsort((doc, null, -score, item))
    item = item[order]
    first = np.searchsorted(item, item, "left")
    keep = order[np.arange(len(item)) - first < top]
    return keep


def scored(table: DataFrame, batch: Batch, weights: np.ndarray, top: int, kind: str) -> DataFrame:
    """The ``top`` documents of each item in every task: item, item_id, doc_id, score."""
    sent = table.sparkSession.sparkContext.broadcast((batch, weights))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, weights = sent.value
        width = max(1, CELLS // max(1, batch.height))
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        least = np.ones(len(batch.item), np.int64)
        for b in rows:
            if not len(b):
                continue
            ids = b.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
            m = b.column(1).to_numpy(zero_copy_only=False)
            lists, tf = b.column(2), b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tid = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy(zero_copy_only=False))
            share = weights[tid] * ((SCALE * tf) // (1000 * tf + 8 * m[row]))
            for a in range(0, len(b), width):
                z = min(a + width, len(b))
                i, j = np.searchsorted(row, (a, z))
                base = np.zeros((batch.height, z - a), np.int64)
                base[tid[i:j], row[i:j] - a] = share[i:j]
                found = batch.scores(base)
                which, at = np.nonzero(found >= least[:, None])
                new = [which, found[which, at], null[a + at], doc[a + at]]
                both = [np.concatenate(x) for x in zip(kept, new, strict=True)]
                keep = _best(*both, top)
                kept = [x[keep] for x in both]
                full = np.bincount(kept[0], minlength=len(least)) >= top
                low = np.full(len(least), np.iinfo(np.int64).max)
                np.minimum.at(low, kept[0], kept[1])
                least[full] = low[full]
        item, score, null, doc = kept
        yield pa.RecordBatch.from_arrays([pa.array(np.array(batch.item, np.int64)[item]), pa.array([batch.item_id[k] for k in item], pa.string()), pa.array(doc, mask=null), pa.array(score)],
                                         names=["item", "item_id", "doc_id", "score"])
        release()

    return table.mapInArrow(run, f"item long, item_id string, doc_id {kind}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", batch_terms: int = BATCH_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score (long): each item's ``top`` documents with a score above 0."""
    spark = docs.sparkSession
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = [spark.createDataFrame([], "item long, item_id string, doc_id long, score long")]
    for batch in batches_of(sharing_plan(items, item_id_col, item_text_col), batch_terms):
        table = counted(held, batch, "doc_id", "text")
        total = table.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("terms")).first()
        if not total.terms:
            break
        found = table.select(F.explode("tid").alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
        weights = np.zeros(len(batch.terms), np.int64)
        for r in found.select("tid", F.floor(1000 * F.log(F.lit(float(2 * total.n + 2)) / (2 * F.col("df") + 1))).alias("w")).toLocalIterator():
            weights[r.tid] = r.w
        lengths = table.select("doc_id", F.expr(f"25 + (75 * n * {total.n}L) div {total.terms}L").alias("m"), "tid", "tf")
        parts.append(stored(scored(lengths, batch, weights, top, "long"), "best"))
    best = parts[0]
    for p in parts[1:]:
        best = best.unionByName(p)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order)
    every = Window.partitionBy("item").orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top).withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= top)
    return best.select(F.col("item_id").cast(items.schema[item_id_col].dataType).alias(item_id_col), "rank", F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col), "score")
