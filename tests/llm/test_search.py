"""Multi-index search and license scans against brute force."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import license as lic
from tidemark.llm import multiindex

VEC = "vec_id long, embedding array<float>, label int, score int, cell int"


def truth(rows, every=20, top=20):
    good = {}
    ids, x = [], []
    for i, v, *_ in rows:
        if v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v):
            ids.append(i)
            x.append(np.array(v, np.float32).astype(float))
    ids, x = np.array(ids), np.array(x)
    for i, q in zip(ids, x):
        if i % every == 0:
            s = (x * q).sum(1)
            o = [k for k in np.lexsort((ids, -s)) if ids[k] != i][:top]
            good[i] = [(int(ids[k]), float(s[k])) for k in o]
    return good


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(c) for c in rng.normal(size=8)], 1, 1, 1) for k in range(300)]
    rows += [(k, rows[20][1], 1, 1, 1) for k in range(300, 420)]                      # copies: ties
    rows += [(500, None, 1, 1, 1), (520, [0.0] * 8, 1, 1, 1), (540, [1.0, None] * 4, 1, 1, 1), (560, [float("nan")] * 8, 1, 1, 1), (580, [1.0] * 3, 1, 1, 1), (600, [float("inf")] * 8, 1, 1, 1), (None, [1.0] * 8, 1, 1, 1)]
    got = {}
    for r in multiindex.nearest(spark.createDataFrame(rows, VEC)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = truth([r for r in rows if r[0] is not None])
    assert set(got) == set(want)
    for i in want:
        assert [v for v, _ in got[i]] == [v for v, _ in want[i]]
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]], rtol=0, atol=1e-12)


def test_few_and_none(spark):
    assert multiindex.nearest(spark.createDataFrame([], VEC)).collect() == []
    got = multiindex.nearest(spark.createDataFrame([(0, [1.0, 2.0], 1, 1, 1), (1, [1.0, 0.0], 1, 1, 1), (2, [0.0, 1.0], 1, 1, 1)], VEC)).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 2, 2.0), (0, 1, 1.0)]


def test_recall_and_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "LEAST", 50)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 8)) * 3
    rows = [(k, [float(c) for c in centres[k % 30] + rng.normal(size=8)], 1, 1, 1) for k in range(5000)]
    rows += [(k, rows[7][1], 1, 1, 1) for k in range(5000, 7500)]                     # a third: one vector
    want = truth(rows)
    got = {}
    for r in multiindex.nearest(spark.createDataFrame(rows, VEC)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = [len(got[i] & {v for v, _ in want[i]}) / 20 for i in want]
    assert set(got) == set(want) and np.mean(recall) >= 0.9


def test_walk_is_sorted():
    rng = np.random.default_rng(0)
    grid = multiindex.Grid([rng.normal(size=(6, 3)), rng.normal(size=(6, 3))], 1.0)
    q = rng.normal(size=6)
    cells = list(grid.walk(q))
    score = (grid.halves[0] @ q[:3])[:, None] + (grid.halves[1] @ q[3:])[None]
    assert sorted(cells) == list(range(36)) and np.all(np.diff(score.ravel()[cells]) <= 1e-12)


TEXTS = ["", None, "Released under the MIT License.", "licensed UNDER  the\nApache-License, Version 2.0; CC BY-NC 4.0 cc/by/nc", "This work is licensed under the GNU General Public License, version 3.", "under the mit licenses", "under the mît license",
         "under the mit license " * 3, "GNU General Public License as published by the Free Software Foundation, either version 2", "x " * 3000 + "cc by nc", "Released under the terms of the MIT licence", "cc by nc cc by nc",
         "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Éa cc\x00by\x7fnc é"]


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(k, label) for label, p in lic.PHRASES for k in range(len(words)) if words[k:k + len(p.split())] == p.split()]
    starts = [k for k, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_scans(spark):
    schema = "doc_id long, text string, id string, labels int, n_words int"
    rows = [(k, t, "x", 1, 1) for k, t in enumerate(TEXTS)] + [(None, TEXTS[2], "x", 1, 1), (2, TEXTS[2], "x", 1, 1)]
    got = lic.scan_licenses(spark.createDataFrame(rows, schema)).collect()
    text_of = dict(enumerate(TEXTS))
    text_of[None] = TEXTS[2]
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text_of[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    by = {r.doc_id: r.labels for r in got}
    assert (by[4], by[8], by[10], by[12], by[5]) == ("gpl-3", "gpl-2", "mit", "isc", "")
    assert lic.scan_licenses(spark.createDataFrame([], schema)).collect() == []


def test_automaton_against_regular_expressions():
    rng = random.Random(6)
    for _ in range(200):
        markup, pattern = "a", "a"
        for _ in range(rng.randrange(1, 5)):
            w = rng.choice("abc")
            k = rng.randrange(4)
            if k == 0:
                markup, pattern = f"{markup} {w}", f"{pattern} {w}"
            elif k == 1:
                markup, pattern = f"{markup} <<beginOptional>>{w} b<<endOptional>>", f"{pattern}(?: {w} b)?"
            elif k == 2:
                markup, pattern = f"{markup} <<var;words={0}..2>>", f"{pattern}(?: [a-z]+){{0,2}}"
            else:
                markup, pattern = f"{markup} <<alt;{w}|c>>", f"{pattern} (?:{w}|c)"
        auto = lic.compile_template("x", markup)
        for _ in range(20):
            words = rng.choices("abcd", k=rng.randrange(0, 9))
            assert auto.accepts([w.encode() for w in words], 0) == bool(re.match(pattern + r"(?: |$)", " ".join(words))), (markup, words)


def test_markup_needs_opening_words():
    with pytest.raises(ValueError):
        lic.compile_template("x", "<<var;words=0..3>> a")
