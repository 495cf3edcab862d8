"""The attention classifier: gradients, the forward pass by loops, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest

from loomstone.llm import attention_quality as Q

SMALL = Q.Params(passage=4, words=64, width=5, attention=3, steps=60, batch=4)
TEXTS = ["", "one", "the the THE!! end.\n", "a b c d e f g h i j k l", "x*** y### " * 9, "word " * 23, "   "]


def model(p=SMALL):
    m, r = Q.new_model(p), np.random.default_rng(3)
    return {k: (v + 0.3 * r.standard_normal(v.shape)).astype(np.float32) for k, v in m.items()}


def plain(text, m, p):
    """Score and attention of one text by loops."""
    words = text.split()
    n, k = len(words), max(1, round(len(words) / p.passage))
    sig = lambda x: 1 / (1 + np.exp(-x))
    hs, es = [], []
    for i in range(k):
        part = words[i * n // k : (i + 1) * n // k]
        f = [Q.word_features(w, p.words) for w in part]
        inner = sum((m["words"][a].astype(float) + m["shapes"][b] for a, b, _, _ in f), np.zeros(p.width)) / max(1, len(part))
        chars = sum(x[2] for x in f)
        again = sum(x == y for x, y in zip(part, part[1:], strict=False))
        stats = np.array([np.log1p(len(part)) / 5, chars / max(1, len(part)) / 10, sum(x[3] for x in f) / max(1, chars), again / max(1, len(part)), 1 - len(set(part)) / len(part) if part else 0])
        h = np.tanh(inner + stats @ m["shares"] + m["bias"])
        hs.append(h)
        es.append(m["w"] @ (np.tanh(m["V"] @ h) * sig(m["U"] @ h)))
    a = np.exp(es) / np.exp(es).sum()
    return sig(m["out"] @ sum(x * h for x, h in zip(a, hs, strict=True)) + m["out_bias"][0]), a


def test_forward_is_the_plain_model():
    m = model()
    b = Q.bags(TEXTS, Q.Words(SMALL.words), SMALL.passage)
    f = Q.forward(m, b)
    for i, text in enumerate(TEXTS):
        score, a = plain(text, m, SMALL)
        assert f["score"][i] == pytest.approx(score, abs=1e-5)
        assert f["a"][b.docs[i] : b.docs[i] + f["n"][i]] == pytest.approx(a, abs=1e-5)


def test_gradients_are_the_loss_slopes():
    m = {k: v.astype(np.float64) for k, v in model().items()}
    b, y = Q.bags(TEXTS, Q.Words(SMALL.words), SMALL.passage), np.array([0, 1, 0, 1, 0, 1, 1.0])
    loss = lambda: -np.mean(np.log(np.where(y == 1, s := Q.forward(m, b)["score"], 1 - s)))
    got = Q.gradients(m, b, y)
    rows, d = got["words"]
    got["words"] = np.zeros_like(m["words"])
    got["words"][rows] = d
    for k, v in m.items():
        for i in np.random.default_rng(1).choice(v.size, min(20, v.size), replace=False):
            at = np.unravel_index(i, v.shape)
            was = v[at]
            v[at] = was + 1e-4
            up = loss()
            v[at] = was - 1e-4
            slope = (up - loss()) / 2e-4
            v[at] = was
            assert got[k][at] == pytest.approx(slope, abs=2e-4)


def test_words_beyond_the_memo(monkeypatch):
    texts = ["a b c d e f a", "g a h A!! h"]
    want = Q.forward(model(), Q.bags(texts, Q.Words(64), 4))["score"]
    monkeypatch.setattr(Q, "MEMO", 3)
    words = Q.Words(64)
    for _ in range(2):
        assert Q.forward(model(), Q.bags(texts, words, 4))["score"].tolist() == want.tolist()
        words.of(["q", "r", "s"])


def test_attention_finds_the_passage_that_decides():
    r = np.random.default_rng(0)
    say = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eta"], n))
    bad = "BUY!! NOW!! BUY!! CHEAP!!"
    texts = [f"{say(20)} {bad} {say(16)}" if i % 3 == 0 else say(40) for i in range(90)]
    p = Q.Params(passage=4, words=64, steps=400, batch=16)
    m = Q.fit(texts, [int(i % 3 != 0) for i in range(90)], p)
    b = Q.bags([f"{say(8)} {bad} {say(20)}", say(32)], Q.Words(64), 4)
    f = Q.forward(m, b)
    assert f["score"][0] < 0.1 < 0.9 < f["score"][1]
    assert f["a"][:8].argmax() == 2


def test_held_out_accuracy(spark):
    """Labels that were never learned from are told apart, and clean documents kept."""
    sf = "/root/testdata/sf0.01"
    rows = Q.op11_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    asked = [r for r in rows if r.held_out]
    good, bad = ([r.score for r in asked if r.quality == q] for q in (1, 0))
    assert np.mean([x > y for x in good for y in bad]) > 0.97
    assert np.mean([x >= 0.3 for x in good]) > 0.97 and np.mean([x >= 0.3 for x in bad]) < 0.2


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", "x", 0), (1, None, "y", 1), (None, "", "z", 1), (2, "Loud!! " * 3000, "", 0)], "doc_id long, text string, score string, quality int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, quality int")
    p = Q.Params(steps=5, words=64)
    rows = Q.scored(docs, Q.trained(docs, labels, p), p).collect()
    assert sorted((r.doc_id or 0, r.n_passages) for r in rows) == [(0, 1), (1, 1), (1, 1), (2, 60)]
    none = docs.limit(0)
    assert Q.scored(none, Q.trained(none, labels.limit(0), p), p).count() == 0


def test_sample_is_bounded_and_leaves_held_out_rows(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id) AS text").union(spark.range(500).selectExpr("7L AS doc_id", "concat('copy ', id) AS text"))
    labels = spark.range(2000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    every = Q.training_sample(docs, labels, Q.Params()).collect()
    assert len(every) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(2000))
    assert 150 < Q.training_sample(docs, labels, Q.Params(sample=200)).count() < 250
