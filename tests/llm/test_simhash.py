"""SimHash components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash

SCHEMA = "doc_id long, text string, id string, fp int, point int"


def brute_print(text):
    words = [w for w in (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    if not words:
        return 0
    sh = [b" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items):
    """Smallest id reachable of each (id, fp)."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(items)):
        for b in range(a):
            if bin(items[a][1] ^ items[b][1]).count("1") <= 2:
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(items):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [low.get(find(k)) for k in range(len(items))]


def test_fingerprint():
    for text in ["", None, "One", "one Two", "a b c", "A\tb\nc d é É  d", "x " * 500, "  no break", "q w e r t y " * 9]:
        assert simhash.fingerprint(text) == brute_print(text), text


@pytest.mark.parametrize("cell", [64, 2])
def test_components_of_prints(spark, cell):
    rng = random.Random(3)
    prints = []
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            prints.append(x)
            for _ in range(rng.choice([0, 1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
    prints += [0, 1, 3, (1 << 64) - 1, (1 << 63), 7 << 61]
    items = [(rng.randrange(1000), p) for p in prints] + [(None, prints[0]), (None, 0xF0F0F0F0F0F0F0F0)]
    frame = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64)), k) for k, (i, p) in enumerate(items)], "id long, fp long, k int")
    got = {r.k: r.component_id for r in simhash.grouped(frame, cell).collect()}
    assert [got[k] for k in range(len(items))] == brute_components(items)


def test_distance_bound(spark):
    rng = random.Random(5)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(50)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", simhash.popcounts(F.col("a")).alias("x"), simhash.popcounts(F.col("b")).alias("y")).collect()
    for a, b, x, y in rows:
        digits = [(x >> 4 * k & 15, y >> 4 * k & 15) for k in range(16)]
        assert [d[0] for d in digits] == [bin(a >> 4 * k & 15).count("1") for k in range(16)]
        assert sum(abs(p - q) for p, q in digits) <= bin(a ^ b).count("1")


def test_documents(spark):
    base = " ".join(f"w{k}" for k in range(300))
    texts = [base, base.upper(), base + " tail", "other words here", None, "", "  ", "short", "short", base.replace("w7 ", "v7 ")]
    rows = [(k + 10, t, "x", 1, 1) for k, t in enumerate(texts)] + [(10, base, "x", 1, 1), (None, base, "x", 1, 1)]
    got = sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    items = [(r[0], brute_print(r[1])) for r in rows]
    want = sorted([(i, f"{p:016x}", c) for (i, p), c in zip(items, brute_components(items))], key=str)
    assert got == want
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("cell", [64, 2])
def test_blocks_link_what_the_grid_links_with_three_points_each(spark, cell):
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(4):
            prints.add(base)
            base ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    rows = [(k % 2, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(sorted(prints))]
    frame = spark.createDataFrame(rows, "t int, fp long")
    assert frame.select(F.size(simhash.block_points(F.col("fp"))).alias("n")).distinct().first().n == 3

    def groups(points_of):
        edges = [((r.t, r.u), (r.t, r.v)) for r in simhash.close_links(frame, cell, ("t",), points_of).collect()]
        root = {x: x for x in rows}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for u, v in edges:
            a, b = sorted((find(u), find(v)))
            root[b] = a
        return {x: find(x) for x in rows}
    links = {x: x for x in rows}
    got = groups(simhash.block_points)
    assert got == groups(simhash.embedded_points) and got != links
    for a in rows:
        for b in rows:
            if a[0] == b[0] and ((a[1] ^ b[1]) & (1 << 64) - 1).bit_count() <= 2:
                assert got[a] == got[b]
