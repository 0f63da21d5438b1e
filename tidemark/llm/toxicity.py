"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of three hashed rows: the lower-cased word and its first four
and six bytes, which lets inflected forms share what they mean.  Filters of widths 1, 2 and 3
run over the whole text, the largest response of each filter is kept, and a logistic layer
turns them into a margin.  The margin is calibrated to a probability on rows that training
did not see, and a threshold is chosen there for every language; the language only picks the
threshold, never the score.

Training uses at most ``SAMPLE`` labelled rows of each class, drawn by hash (a documented
bound); scoring covers every document.  Rows with crc32(id) mod 4 = 2 are never learnt from,
those with 3 calibrate, the rest train.

Null and empty texts score 0; null ids are not held out; labels that are null or contradict
each other count as null or as the larger one; without any label every score is 0; repeated
rows get equal scores; columns other than id, text and language are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import release, slices, span_hashes, utf8_parts, word_spans

SAMPLE = 4_000
BUCKETS = 1 << 18
WIDTH, FILTERS = 8, 8
SPANS = (1 << 30, 4, 6)
SIZES = (1, 2, 3)
PREDICT = 0.3

SEPARATOR = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def hashed_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers (one row per word, one column per span) and the text of each word."""
    raw = LOWER[raw]
    start, end, row = word_spans(raw, at, SEPARATOR)
    ids = np.empty((len(start), len(SPANS)), np.int32)
    for k, span in enumerate(SPANS):
        mixed = span_hashes(raw, start, np.minimum(end, start + span)) * np.uint64(2 * k + 1)
        ids[:, k] = (mixed >> np.uint64(40)) % np.uint64(BUCKETS)
    return ids, row


@dataclass
class Network:
    """Embeddings, filters and output layer; ``scale`` and ``shift`` calibrate the margin."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    intercept: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = PREDICT

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.02, (BUCKETS, WIDTH)).astype(np.float32)
        filters, bias = [], []
        for w in SIZES:
            f = rng.normal(0, 0.1, (w, WIDTH, FILTERS)).astype(np.float32)
            f[:, 0, :FILTERS // 2] += 1.0 / w
            filters.append(f)
            bias.append(np.full(FILTERS, -0.3, np.float32))
        out = rng.normal(0, 0.1, len(SIZES) * FILTERS).astype(np.float32)
        out.reshape(len(SIZES), FILTERS)[:, :FILTERS // 2] += 0.3
        return cls(table, filters, bias, out)

    def respond(self, ids: np.ndarray, row: np.ndarray, n: int):
        """Filter responses at every place of ``n`` padded texts; first place of each text, word places, word vectors."""
        pad = max(SIZES) - 1
        first = np.searchsorted(row, np.arange(n), "left") + pad * np.arange(n)
        place = np.arange(len(row)) + pad * row
        total = len(row) + pad * n
        vectors = np.zeros((total + pad, WIDTH), np.float32)
        vectors[place] = self.table[ids[:, 0]] + self.table[ids[:, 1]] + self.table[ids[:, 2]]
        off = np.ones(total, bool)
        off[place] = False
        maps = []
        for f, b in zip(self.filters, self.bias, strict=True):
            got = np.tile(b, (total, 1))
            for k in range(len(f)):
                got += vectors[k:total + k] @ f[k]
            got[off] = 0                                             # places of padding cannot win
            maps.append(got)
        return maps, first, place, vectors

    def pooled(self, ids: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        maps, first, *_ = self.respond(ids, row, n)
        return np.maximum(np.concatenate([np.maximum.reduceat(m, first, axis=0) for m in maps], axis=1), 0) if n else np.zeros((0, len(self.out)), np.float32)

    def margins(self, ids: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        return self.pooled(ids, row, n) @ self.out + self.intercept

    def score(self, ids: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        value = 1 / (1 + np.exp(-np.clip(self.scale * self.margins(ids, row, n).astype(float) + self.shift, -40, 40)))
        value[np.bincount(row, minlength=n) == 0] = 0.0
        return value


def _stack(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros((0, len(SPANS)), np.int32), *texts]), np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 6, batch: int = 64, seed: int = 7) -> Network:
    """Fit by Adam (filters, output) and Adagrad (touched embedding rows).

    The first embedding column starts from each bucket's shrunk log odds, so that pooling looks
    at telling words from the first step.
    """
    net = Network.fresh(seed)
    rng = np.random.default_rng(seed)
    seen = np.zeros((2, BUCKETS))
    for ids, y in zip(texts, labels, strict=True):
        seen[y, np.unique(ids)] += 1
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    net.table[:, 0] = np.clip(odds * (seen.sum(0) / (seen.sum(0) + 5)) / 3, -1, 1)
    memory = np.full(BUCKETS, 1e-3, np.float32)
    params = [*net.filters, *net.bias, net.out]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            step += 1
            ids, row = _stack([texts[i] for i in chosen])
            y, n = labels[chosen], len(chosen)
            maps, first, place, vectors = net.respond(ids, row, n)
            word_at = np.full(len(vectors), -1)
            word_at[place] = np.arange(len(place))
            last = np.append(first[1:], len(maps[0]))
            best = [np.stack([a + m[a:b].argmax(0) for a, b in zip(first, last, strict=True)]) for m in maps]
            top = np.concatenate([np.take_along_axis(m, p, 0) for m, p in zip(maps, best, strict=True)], axis=1)
            pool = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(pool @ net.out + net.intercept, -30, 30)))
            error = ((p - y) / n).astype(np.float32)
            back = (error[:, None] * net.out) * (top > 0)
            grads_f, grads_b = [], []
            rows, values = [], []
            for j, (f, where) in enumerate(zip(net.filters, best, strict=True)):
                g = back[:, j * FILTERS:(j + 1) * FILTERS]
                grads_b.append(g.sum(0))
                gf = np.zeros_like(f)
                for k in range(len(f)):
                    gf[k] = np.einsum("nfd,nf->df", vectors[where + k], g)
                    hit = word_at[where + k]
                    ok = (hit >= 0) & (g != 0)
                    rows.append(ids[hit[ok]])
                    values.append((g[..., None] * f[k].T[None])[ok])
                grads_f.append(gf)
            grads = [*(g + 1e-4 * f for g, f in zip(grads_f, net.filters, strict=True)), *grads_b, pool.T @ error + 1e-4 * net.out]
            for p_, g, (m, v) in zip(params, grads, moment, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= 0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            net.intercept -= 0.05 * float(error.sum())
            where, value = np.concatenate(rows), np.concatenate(values)
            for k in range(len(SPANS)):
                touched, inverse = np.unique(where[:, k], return_inverse=True)
                change = np.zeros((len(touched), WIDTH), np.float32)
                np.add.at(change, inverse, value)
                memory[touched] += (change ** 2).mean(1)
                net.table[touched] -= 0.05 * change / np.sqrt(memory[touched])[:, None]
    return net


def calibrate(net: Network, margins: np.ndarray, labels: np.ndarray, weights: np.ndarray, langs: list[str | None], least: int = 40) -> None:
    """Weighted logistic fit of the margin, then per language the threshold of best weighted F1 (geometric middle of the gap)."""
    if labels.min() == labels.max():                                  # one class only: its smoothed share, whatever the text
        net.scale, net.shift = 0.0, float(np.log((weights[labels == 1].sum() + 0.5) / (weights[labels == 0].sum() + 0.5)))
        return
    x = np.stack([margins, np.ones_like(margins)], 1).astype(float)
    beta, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    smooth = np.where(labels == 1, 0.999, 0.001)

    def loss(b):
        eta = x @ b
        return float((weights * (np.logaddexp(0, eta) - smooth * eta)).sum() + 5e-4 * ((b - prior) ** 2).sum())

    # Newton steps, each halved until the loss falls: on margins far apart a full step can leave the optimum for good
    for _ in range(100):
        p = 0.5 * (1 + np.tanh(0.5 * (x @ beta)))
        slope = x.T @ (weights * (p - smooth)) + 1e-3 * (beta - prior)
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
        now, part = loss(beta), 1.0
        while loss(beta - part * step) > now - 1e-4 * part * float(slope @ step) and part > 1e-12:
            part /= 2
        beta = beta - part * step
        if part * np.abs(step).max() < 1e-9:
            break
    net.scale, net.shift = float(max(beta[0], 1e-3)), float(beta[1])
    score = 1 / (1 + np.exp(-np.clip(net.scale * margins + net.shift, -40, 40)))

    def best(mask: np.ndarray) -> float:
        order = np.argsort(-score[mask], kind="stable")
        s, y, w = score[mask][order], labels[mask][order], weights[mask][order]
        hit, taken = np.cumsum(w * y), np.cumsum(w)
        f1 = 2 * hit / (taken + (w * y).sum())
        f1[:-1][s[:-1] == s[1:]] = 0                                  # a cut cannot part equal scores
        k = int(f1.argmax())
        return float(np.clip(np.sqrt(s[k] * max(s[k + 1] if k + 1 < len(s) else 0.0, 1e-3)), 0.1, 0.7))

    net.threshold = best(np.ones(len(score), bool))
    for lang in {x for x in langs if x is not None}:
        mask = np.array([x == lang for x in langs])
        if mask.sum() >= least and 0 < labels[mask].sum() < mask.sum():
            net.thresholds[lang] = best(mask)


def part_of(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", sample: int = SAMPLE) -> Network:
    """Train and calibrate on a bounded, hash-drawn sample of labelled rows; only hashed words come to the driver."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
             .groupBy("id").agg(F.max("y").alias("y")).withColumn("part", part_of(F.col("id"))).where("part != 2"))
    counts = {(r.y, r.part == 3): r["count"] for r in known.groupBy("y", "part").count().groupBy("y", (F.col("part") == 3).alias("late")).agg(F.sum("count").alias("count"))
              .select("y", F.when(F.col("late"), 3).otherwise(0).alias("part"), "count").collect()}
    draw = F.xxhash64("id", F.lit("draw"))
    picks = [known.where((F.col("y") == y) & late).orderBy(draw, "id").limit(sample if not held else sample // 2)
             for y in (0, 1) for held, late in ((False, F.col("part") != 3), (True, F.col("part") == 3))]
    picked = picks[0].unionByName(picks[1]).unionByName(picks[2]).unionByName(picks[3])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8_parts(batch.column(3))
            for a, b in slices(at):
                ids, row = hashed_words(data[at[a]:at[b]], at[a:b + 1] - at[a])
                cut = np.searchsorted(row, np.arange(b - a + 1))
                blobs = [ids[cut[k]:cut[k + 1]].tobytes() for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), pa.array(blobs, pa.binary())], ["y", "late", "lang", "words"])

    rows = (docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(picked), "id").select("y", (F.col("part") == 3).alias("late"), "lang", "text")
            .mapInArrow(features, "y int, late boolean, lang string, words binary"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)]
        if held:
            model = pickle.dumps(fitted(held, counts))
            held.clear()
            release()
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    # One task trains on the sample, which ``sample`` bounds; only the model comes to the driver.
    got = rows.repartition(1).mapInArrow(learn, "model binary").collect()
    if got:
        return pickle.loads(got[0].model)
    net = Network.fresh()
    net.scale, net.shift = 0.0, -40.0                                 # nothing to learn from
    return net


def fitted(rows: list[tuple[int, bool, str | None, bytes]], counts: dict[tuple[int, bool], int]) -> Network:
    """Train on the early rows and calibrate on the late ones (label, late, language, hashed words), weighted
    to the ``counts`` of all labelled rows."""
    rows = sorted(rows, key=lambda r: (r[1], r[3], r[0], r[2] or ""))
    unpack = lambda r: np.frombuffer(r[3], np.int32).reshape(-1, len(SPANS))                               # noqa: E731
    early = [r for r in rows if not r[1]] or rows
    net = train([unpack(r) for r in early], np.array([r[0] for r in early]))
    late = [r for r in rows if r[1]]
    if len({r[0] for r in late}) < 2:
        late = rows
    y = np.array([r[0] for r in late])
    held = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weights = np.array([max(1, counts.get((int(k), True), 0)) / held[int(k)] for k in y], float)
    margins = np.concatenate([net.margins(*_stack([unpack(r) for r in late[k:k + 64]]), len(late[k:k + 64])) for k in range(0, len(late), 64)])
    calibrate(net, margins, y, weights, [r[2] for r in late])
    net.table = net.table.astype(np.float32)
    return net


def score_documents(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: bool = False) -> DataFrame:
    """id, score, predicted, threshold (of the language) and rejected; with ``keep`` instead the rows of ``docs`` not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = docs.schema

    def scores(column, langs):
        model = shared.value
        data, at = utf8_parts(column)
        parts = [np.zeros(0)]
        for a, b in slices(at, 1 << 20):
            ids, row = hashed_words(data[at[a]:at[b]], at[a:b + 1] - at[a])
            parts.append(model.score(ids, row, b - a))
        return np.concatenate(parts), np.array([model.thresholds.get(x, model.threshold) for x in langs.to_pylist()], float)

    if keep:
        names = schema.fieldNames()

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score, limit = scores(batch.column(names.index(text_col)), batch.column(names.index(lang_col)))
                yield batch.filter(pa.array(score < limit))
            release()
        return docs.mapInArrow(drop, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, limit = scores(batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= PREDICT).astype(np.int32)), pa.array(limit), pa.array(score >= limit)],
                                             ["id", "score", "predicted", "threshold", "rejected"])

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    got = frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, score double, predicted int, threshold double, rejected boolean")
    return got.select(F.col("id").alias(id_col), (part_of(F.col("id")) == 2).alias("held_out"), "score", "predicted", "threshold", "rejected")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, fit(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that their language's threshold does not reject."""
    return score_documents(docs, fit(docs, labels), keep=True)
