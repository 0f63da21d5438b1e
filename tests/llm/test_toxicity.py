"""Toxicity classifier: held-out accuracy, inputs, edge cases."""

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import toxicity as tox

DOCS = "doc_id long, text string, lang string, source string, score double, id int"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=1600, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randrange(2, 8))) for _ in range(1200)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randrange(20, 200))
        bad = rng.random() < 0.25
        lang = rng.choice(["en", "de"])
        if bad:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["scoundrel", "villain", "grubnark"]) if lang == "en" else "schurk" + rng.choice(["en", "erei", "ig", "isch", "e", "heit", "s"]))
        docs.append((i, " ".join(words), lang, "s", 0.0, 1))
        labels.append((i, 1, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = corpus()
    extra = [(9000, None, "en", "s", 0.0, 1), (9001, "", None, "s", 0.0, 1), (None, docs[0][1], "en", "s", 0.0, 1), (0, docs[0][1], "de", "t", 0.0, 1), (9002, " .,! ", "xx", "s", 0.0, 1), (9003, docs[0][1] * 100, "en", "s", 0.0, 1)]
    noise = [(3, 1, None), (None, 1, 1), (5, 0, labels[5][2])]
    out = tox.toxicity(spark.createDataFrame(docs + extra, DOCS).repartition(3), spark.createDataFrame(labels + noise, LABELS))
    return docs, labels, extra, out.collect()


def test_held_out_accuracy(scored):
    docs, labels, extra, rows = scored
    assert len(rows) == len(docs) + len(extra)
    truth = {i: y for i, _, y in labels}
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 9000 and r.held_out]
    assert len(held) > 200 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    pos, neg = ([r.score for r in held if truth[r.doc_id] == y] for y in (1, 0))
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    assert auc > 0.97
    right = np.mean([r.predicted == truth[r.doc_id] for r in held])
    assert right > 0.93 and all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_edges(scored):
    docs, _, _, rows = scored
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1 and r.rejected == (r.score >= r.threshold)
    assert by[9000][0].score == by[9001][0].score == by[9002][0].score == 0
    assert by[None][0].held_out is False
    assert len({r.score for r in [*by[0], *by[None]]}) == 1                     # language, source and id do not matter


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame(corpus(5)[0], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in tox.toxicity(docs, none).collect()} == {r.score for r in tox.toxicity(docs, none).collect()}
    assert all(r.score < 0.01 and not r.rejected for r in tox.toxicity(docs, none).collect())
    assert tox.without_toxic(docs, none).count() == 5
    assert tox.toxicity(docs.limit(0), none).collect() == []


def test_same_model_again():
    docs, labels = corpus(200)
    texts = []
    for _, t, *_ in docs:
        raw = np.frombuffer(t.encode(), np.uint8)
        texts.append(tox.hashed_words(raw, np.array([0, len(raw)]))[0])
    y = np.array([v for *_, v in labels])
    a, b = (tox.train(texts, y, epochs=1) for _ in range(2))
    assert np.array_equal(a.table, b.table)
    ids, row = tox._stack(texts[:5])
    whole = a.margins(ids, row, 5)
    single = [a.margins(*tox._stack([t]), 1)[0] for t in texts[:5]]
    assert np.allclose(whole, single, atol=1e-5)


@pytest.mark.parametrize("far", [3, 30, 300, 3000])
@pytest.mark.parametrize("middle", [0.0, -50.0, 400.0])
def test_calibration_of_margins_far_apart_keeps_the_classes_apart(far, middle):
    """A full Newton step from saturated margins leaves the optimum for good; every text then scored 1."""
    rng = np.random.default_rng(1)
    labels = np.r_[np.ones(300, int), np.zeros(2000, int)]
    margins = middle + np.where(labels == 1, far, -far) + rng.normal(0, 1 + far / 10, len(labels))
    net = tox.Network.fresh()
    tox.calibrate(net, margins, labels, np.where(labels == 1, 1.0, 40.0), ["en", None] * 1150)
    score = 1 / (1 + np.exp(-np.clip(net.scale * margins + net.shift, -40, 40)))
    assert (score[labels == 1] > net.threshold).mean() > 0.9 and (score[labels == 0] < net.threshold).mean() > 0.9
    beta = np.array([net.scale, net.shift])
    x, w = np.stack([margins, np.ones_like(margins)], 1), np.where(labels == 1, 1.0, 40.0)
    slope = x.T @ (w * (1 / (1 + np.exp(-np.clip(x @ beta, -500, 500))) - np.where(labels == 1, 0.999, 0.001))) + 1e-3 * (beta - [1.0, 0.0])
    assert np.abs(slope / np.abs(x).max(0)).max() < 1e-2
