"""Lexical search against a plain loop; the sharing graph against plain sums."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lexical

DOCS = "doc_id long, text string, item_id string, term string, n int, tid int, score int"
ITEMS = "item_id long, text string, doc_id long, block int, near int"
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    held = [sum(b.values()) for _, b in bags]
    n, total = sum(x > 0 for x in held), sum(held)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in set(items):
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, bag in asked.items():
        rows = []
        for k, (doc, b) in enumerate(bags):
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * (25 + 75 * held[k] * n // total))) for t, c in bag.items() if t in b)
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


def corpus(seed=0, n=300):
    rng = random.Random(seed)
    vocab = ["the", "of", "Über", "naïve", "日本", "x1", "42"] + ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 6))) for _ in range(400)]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    line = lambda k: rng.choice([" ", ", ", "-"]).join(rng.choices(vocab, weights, k=k))
    docs = [(k, line(rng.randrange(1, 80))) for k in range(n)]
    docs += [(n + k, docs[5][1]) for k in range(40)]                                    # copies: equal scores
    docs += [(7, docs[7][1]), (7, docs[7][1]), (None, docs[8][1]), (None, docs[8][1]), (n + 50, None), (n + 51, ""), (n + 52, " .,;\n"), (n + 53, line(20_000)), (n + 54, "THE Of"), (n + 55, "q" * 200_000)]
    items = [(k, line(rng.randrange(3, 40))) for k in range(60)]
    items += [(100, items[3][1]), (3, items[3][1]), (3, "the of the"), (101, None), (102, ""), (103, "unknownword"), (104, docs[5][1]), (None, "the"), (105, "the " * 9)]
    return docs, items


@pytest.mark.parametrize("seed", [0, 1])
def test_ranking(spark, seed):
    docs, items = corpus(seed)
    got = lexical.ranked_search(spark.createDataFrame([(*d, "x", "y", 1, 1, 1) for d in docs], DOCS).repartition(4), spark.createDataFrame([(*i, 1, 1, 1) for i in items], ITEMS))
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(docs, items)


def test_several_blocks_and_passes(spark, monkeypatch):
    docs, items = corpus(2)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 8)
    monkeypatch.setattr(lexical, "CELLS", 3000)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.sharing_plan(i).count() > 5
    got = lexical.ranked_search(d, i, top=4, batch_terms=120).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, 4)


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked_search(d, i).collect() == [] and lexical.ranked_search(d, some).collect() == []
    assert lexical.ranked_search(some.withColumnRenamed("item_id", "doc_id"), i).collect() == []


def test_shared_sets_sum_to_the_items():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 40)
        parts = [rng.sample(range(n), min(n, rng.randrange(1, 8))) for _ in range(4)]
        sets = [set().union(*rng.sample(parts, rng.randrange(1, 4)), rng.sample(range(n), rng.randrange(0, n))) for _ in range(rng.randrange(0, 12))]
        nodes, left = lexical.shared_sets([set(s) for s in sets], n)
        content = [{k} for k in range(n)]
        for children in nodes:
            assert len(children) > 1 and sum(len(content[c]) for c in children) == len(set().union(*[content[c] for c in children]))
            content.append(set().union(*[content[c] for c in children]))
        for s, rest in zip(sets, left, strict=True):
            assert set().union(*[content[c] for c in rest]) == s and sum(len(content[c]) for c in rest) == len(s)
        # nothing is left to share: no two items have two symbols in common
        assert all(len(set(a) & set(b)) < 2 for k, a in enumerate(left) for b in left[:k])
        assert sum(map(len, nodes)) + sum(map(len, left)) <= sum(map(len, sets)) + len(nodes)


def test_sharing_saves_additions():
    rng = random.Random(6)
    common = [rng.sample(range(500), 30) for _ in range(5)]
    sets = [set(common[k % 5]) | set(rng.sample(range(500), 5)) for k in range(100)]
    nodes, left = lexical.shared_sets([set(s) for s in sets], 500)
    assert sum(map(len, nodes)) + sum(map(len, left)) < 0.35 * sum(map(len, sets))


def test_long_texts_are_counted_in_pieces():
    text = ("alpha beta-gamma " * 50 + "x" * 100 + " alpha").encode()
    want = Counter(terms(text.decode()))
    for piece in (1, 3, 7, 64, 10_000):
        n, found = lexical.count_terms(text, {"alpha".encode(): 1, b"gamma": 2, b"x" * 100: 3}.get, piece)
        assert n == sum(want.values()) and found == Counter({1: 51, 2: 50, 3: 1})


def test_best_rows_keep_ties_by_id():
    item, score = np.array([0, 0, 0, 1, 1]), np.array([5, 5, 9, 1, 1])
    keep = lexical._best(item, score, np.array([True, False, False, False, False]), np.array([0, 8, 3, 2, 1]), 2)
    assert sorted(keep.tolist()) == [1, 2, 3, 4] and keep.tolist()[:2] == [2, 1]
