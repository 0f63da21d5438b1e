"""Merkle manifest against a plain recursive tree: nulls, ties, repeats, one leaf, many superblocks, empty tables."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, hash string, g long, rank int, n long, idx int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, at, node):
    proof = []
    for level in levels[:-1]:
        pair = level[at & ~1:(at & ~1) + 2]
        proof += [x for k, x in enumerate(pair) if k != at & 1]
        pair[at & 1] = node
        node = h(*pair)
        at >>= 1
    return proof, node


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r[:5]), r))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in groups}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            i, s, lang, n, t = r[:5]
            bad = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
            given = leaf([i, s, lang, n + 1, t]) if bad else own
            inner, node = climb(trees[g], at, given)
            outer, node = climb(top, k, node)
            out.append((i, own, trees[g][-1][0], top[-1][0], h(*inner, *outer), node, node == top[-1][0]))
    return sorted(out, key=str)


def documents(n, seed=1):
    rng = random.Random(seed)
    rows = [(k * 3, rng.choice(["a", "b", None, ""]), rng.choice(["en"] * 6 + ["de", "zh", None, "", "Ü"]), rng.choice([k, None, 0]), rng.choice(["x" * k, "é日", "", None])) for k in range(n)]
    rows += [(6, "a", "en", 1, "tie"), (6, "a", "en", 1, "tie"), (6, "b", "en", 1, "tie"), (None, None, None, None, None), (None, "q", "en", 5, "t"), (2**62 + 1, "q", "en", 2**63 - 1, "t"), (-5, "q", "alone", 2, "y" * 300_000)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "h", 7, 7, 7, 7) for r in rows], SCHEMA)


@pytest.mark.parametrize(("n", "block"), [(130, 2), (130, 1), (257, 3), (60, 10), (0, 10)])
def test_digests(spark, n, block):
    rows = documents(n)
    got = merkle.tampered_proofs(frame(spark, rows).repartition(5), block).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_results_do_not_depend_on_order_or_superblocks(spark):
    rows = documents(300, 4)
    one = merkle.tampered_proofs(frame(spark, rows).repartition(3), 4)
    two = merkle.tampered_proofs(frame(spark, rows[::-1]).coalesce(1), 9)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)


def test_one_group_and_empty_table(spark):
    assert merkle.tampered_proofs(frame(spark, [])).collect() == []
    assert merkle.manifest(frame(spark, [])).collect() == []
    one = [(1, "s", "en", 3, "abc")]
    assert sorted(map(tuple, merkle.tampered_proofs(frame(spark, one)).collect()), key=str) == brute(one)
    assert merkle.tampered_proofs(frame(spark, one)).first().proof_sha256 == sha256(b"").hexdigest()


def test_proofs_and_manifest(spark):
    rows = documents(90, 2)
    docs = frame(spark, rows)
    for r in merkle.proofs(docs, block=3).collect():
        assert merkle.fold(r.leaf, r.sides, r.siblings) == r.root == r.folded_root
    want = {(r[2], r[3]) for r in brute(rows)}
    told = merkle.manifest(docs, block=3).collect()
    assert {(r.subroot, r.root) for r in told} == want and sum(r.n for r in told) == len(rows)
    assert {r.lang: r.n for r in told}[None] == sum(r[2] is None for r in rows)
    # any other field can be altered, and only altered rows fail
    bad = merkle.proofs(docs, altered={"text": F.when(F.col("source") == "a", F.concat("text", F.lit("!"))).otherwise(F.col("text"))}, block=3)
    source = {r.doc_id: r for r in docs.where("source = 'a' AND text IS NOT NULL").collect()}
    failed = [r.doc_id for r in bad.where("folded_root <> root").collect()]
    assert set(failed) == set(source)


def test_a_key_that_fills_a_third_of_the_table(spark):
    rows = [(9, "s", "en", 1, "same")] * 400 + documents(500, 3)
    assert sorted(map(tuple, merkle.tampered_proofs(frame(spark, rows), 4).collect()), key=str) == brute(rows)
