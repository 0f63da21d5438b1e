"""Quality rules and source mixing on small tables: nulls, ties, repeats, empty tables, skew."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, size long, row int, rate string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, 1, 1, "x") for i, t, lang, s in rows], SCHEMA)


def counts(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(ws[k:k + 5]) for k in range(len(ws) - 4)]
    seen, hit = Counter(grams), set()
    for k, g in enumerate(grams):
        if seen[g] > 1:
            hit.update(range(k, k + 5))
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(2)
    clean = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + str(rng.randrange(300)) for _ in range(rng.randrange(30, 90))) for _ in range(400)]
    odd = [None, "", " \t\n", "one\none\n \none", "a b c d e a b c d e f", "x " * 40, "é日本 #$%", "a b c d e f g h i j", "\nA\n\nA\r\nA"]
    rows = [(k, t, "en", "s1") for k, t in enumerate(clean)] + [(1000 + k, t, rng.choice(["en", None]), rng.choice(["s1", None, "tiny"])) for k, t in enumerate(odd)]
    rows += [(2000, " ".join(["#$%&*#$%&*"] * 3 + [f"w{k}" for k in range(40)] + ["||||||||||"] * 3), "en", "s1"), (3, clean[3], "en", "s1"), (None, clean[4], "en", "s1")]
    got = quality.quality_rules(frame(spark, rows)).collect()
    want = sorted(((i, *counts(t)) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == want
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert all(r.kept for k in range(400) for r in by[k])
    assert not by[2000][0].kept and not by[2000][0].base_failed
    assert quality.quality_rules(frame(spark, [])).collect() == []


def test_sketch_bins(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 1000, 12345, 10**12, 2**62]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bin_of(quality.F.col("v")).alias("b")).select("v", "b", quality.bin_value(quality.F.col("b")).alias("low")).collect()
    for v, b, low in rows:
        shift = max(v.bit_length() - 6, 0)
        assert low == v >> shift << shift
    assert [r.b for r in rows] == sorted(r.b for r in rows)


def brute_targets(size, cycle=3, most=3):
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: k % cycle + 1 for k, s in enumerate(names)}
    budget, capped = sum(size.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        if not rest:
            break
        level = (budget - sum(most * size[s] for s in capped)) / sum(weight[s] for s in rest)
        new = {s for s in rest if level * weight[s] > most * size[s]}
        if not new:
            break
        capped |= new
    return {s: float(most * size[s]) if s in capped else level * weight[s] for s in names}


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = [(k, " ".join("w" * rng.randrange(1, 3) for _ in range(rng.choice([0, 1, 5, 30, 200]))), "en", rng.choice(["a"] * 8 + ["b", "c", "é", None])) for k in range(300)]
    rows += [(k, "x " * 900, "en", "long") for k in (900,)] + [(901, None, "en", "void"), (905, "again", "en", "a"), (905, "again", "en", "a"), (None, "no id here", "en", "b")]
    got = mixing.mix_sources(frame(spark, rows).repartition(3)).collect()
    size = Counter()
    for i, t, _, s in rows:
        size[s] += len((t or "").split())
    target = brute_targets(size)
    by_source = Counter()
    names = {i: s for i, _, _, s in rows}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by_source[names[r.doc_id]] += r.taken
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((i, len((t or "").split())) for i, t, *_ in rows), key=str)
    for r in got:
        assert r.source_size == size[names[r.doc_id]] and abs(r.target - target[names[r.doc_id]]) < 1e-6
    for s, t in target.items():
        assert abs(by_source[s] - t) <= 1, (s, t, by_source[s])
    again = mixing.mix_sources(frame(spark, rows).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_edges(spark):
    assert mixing.mix_sources(frame(spark, [])).collect() == []
    assert [r.taken for r in mixing.mix_sources(frame(spark, [(1, None, "en", None)])).collect()] == [0]
    copies = mixing.mixed_documents(frame(spark, [(1, "a b c", "en", "a"), (2, "d e f", "en", "b")])).collect()
    assert {c.doc_id for c in copies} <= {1, 2} and copies[0].__fields__ == SCHEMA.replace(" ", "").replace("long", "").replace("string", "").replace("int", "").split(",")
    assert mixing.mixed_documents(frame(spark, [])).collect() == []
