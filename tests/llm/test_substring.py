"""Substring dedup against brute force, on both routes and with hot grams."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import fmdedup

SCHEMA = "doc_id long, text string, id string, words int, places int"


def brute(rows, window=13):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p:p + window])
                least[k] = min(least.get(k, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        off = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and least[tuple(w[p:p + window])] < i:
                off[p:p + window] = [True] * window
        out.append((i, len(w), sum(off), hashlib.sha256(b" ".join(x for x, o in zip(w, off) if not o)).hexdigest()))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(60)] + ["é", "日本"]
    passages = [" ".join(rng.choices(vocab, k=rng.choice([13, 14, 20, 60]))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choices(vocab, k=rng.randrange(0, 40)))]
        parts += rng.choices(passages, k=rng.randrange(3))
        rng.shuffle(parts)
        rows.append((i * 3 % 121, "\n".join(parts) + rng.choice(["", " ", "\t\x0b"])))
    rows += [(500, rows[0][1]), (500, rows[0][1]), (501, rows[5][1] + " tail"), (501, "other text"), (None, rows[0][1]), (7, None), (8, ""), (600, "a " * 5000), (601, "a " * 40), (602, "a b " * 30), (603, "a b " * 13)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"hot_segments": 0}, {"hot_segments": 3}, {"shard_segments": 20}])
def test_against_brute_force(spark, limits):
    rows = fixture()
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(4)
    got = sorted(map(tuple, fmdedup.substring_dedup(frame, **limits).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_plain(spark):
    assert fmdedup.substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    only = spark.createDataFrame([(1, "one two", "x", 1, 2)], SCHEMA)
    assert [r.n_removed for r in fmdedup.substring_dedup(only).collect()] == [0]


def test_texts(spark):
    p = " ".join(f"p{k}" for k in range(20))
    rows = [(1, f"a  b {p}", "x", 1, 2), (2, f"c {p} d", "y", 1, 2), (3, p, "z", 1, 2), (4, None, "n", 1, 2), (5, "", "e", 1, 2)]
    got = {r.doc_id: r.text for r in fmdedup.deduplicated_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: f"a  b {p}", 2: "c d", 4: None, 5: ""}


def test_index_statistics():
    rng = np.random.default_rng(1)
    seqs = [rng.integers(1, 5, rng.integers(1, 40)) for _ in range(20)]
    index = fmdedup.FMIndex(np.concatenate(seqs), np.array([len(s) for s in seqs]))
    query = rng.integers(0, 6, 200)
    query[query > 4] = 0
    length, low, high = index.matching_statistics(query, np.arange(1, 201), 6)
    texts = ["".join(map(str, s)) for s in seqs]
    for e in range(1, 201):
        best = 0
        while best < 6 and e - best - 1 >= 0 and any("".join(map(str, query[e - best - 1:e])) in t for t in texts):
            best += 1
        assert length[e - 1] == best
        if best:
            piece = "".join(map(str, query[e - best:e]))
            assert high[e - 1] - low[e - 1] == sum(sum(t.startswith(piece, k) for k in range(len(t))) for t in texts)


def test_doubling_words_are_different_words(spark):
    a, b = "a", "b"
    while len(a) < 4096:
        a, b = a + b, b + a
    rows = [(1, " ".join([a, *map(str, range(12))])), (2, " ".join([b, *map(str, range(12))])), (3, " ".join([a, *map(str, range(12))]))]
    got = fmdedup.substring_dedup(spark.createDataFrame([(*r, "x", 1, 1) for r in rows], SCHEMA)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert [r.n_removed for r in sorted(got)] == [0, 0, 13]
