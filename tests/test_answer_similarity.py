"""Stems against the published examples, scores of stems and alignments against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone import catalog
from loomstone.functions import providers
from loomstone.functions.text import simple_tokens
from loomstone.operators import answer_similarity as S
from loomstone.operators import evaluation

#: Words and stems of Porter's paper.
PAIRS = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


def test_stems():
    assert {w: S.stem(w) for w in PAIRS[::2]} == dict(zip(PAIRS[::2], PAIRS[1::2], strict=True))
    assert [S.stem(w) for w in ("", "a", "is", "über", "y")] == ["", "a", "is", "über", "y"]


def test_stemmed_rouge(spark):
    d = spark.createDataFrame([(1, "Cats were running happily", "the cat runs, happy"), (2, None, "a"), (3, "", "")], "id long, predicted string, gold string")
    got = {r.id: (r.rouge1, r.rouge2, r.rougel) for r in S.stemmed_rouge(d).collect()}
    # cat, run; happili is no happi.
    assert got == {1: (pytest.approx(0.5), 0.0, pytest.approx(0.5)), 2: (0, 0, 0), 3: (0, 0, 0)}


def test_stems_of_texts_are_scored_without_folds_over_arrays(spark):
    """The plan's scores of the stems' texts; fails where the plan has the fold."""
    words = "cats running happily a the relational formalize, pies. über ponies ties agreed".split()
    r = np.random.default_rng(4)
    texts = [" ".join(r.choice(words, n)) for n in (0, 1, 2, 3, 9, 40, 70, 130)]
    d = spark.createDataFrame([(i * 10 + j, p, g) for i, p in enumerate(texts) for j, g in enumerate(texts)], "id long, predicted string, gold string")
    got = S.stemmed_rouge(d)
    joined = lambda c: F.array_join(S.stems(simple_tokens(F.col(c))), " ")
    want = evaluation.rouge(d.withColumns({"p": joined("predicted"), "g": joined("gold")}), "p", "g").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()


def plain(p, g):
    tokens = lambda t: (t or "").lower().translate(str.maketrans(".,!?", "    ")).split()
    a, b = tokens(p), tokens(g)
    if not a or not b:
        return 0.0, 0.0, 0.0, 0.0
    v = lambda t: providers.hashed_trigrams([t])[0]
    cos = [[float(v(x) @ v(y)) for y in b] for x in a]
    pr, re = sum(map(max, cos)) / len(a), sum(max(row[j] for row in cos) for j in range(len(b))) / len(b)
    pr, re = max(0.0, pr), max(0.0, re)
    return pr, re, 2 * pr * re / (pr + re) if pr + re else 0.0, max(0.0, float(v(p) @ v(g)))


def test_alignment_is_the_plain_one(spark):
    pairs = [("the red apple", "a red apple pie"), ("x", "y"), (None, "a"), ("same words", "same words"), ("!!", "a b")]
    d = spark.createDataFrame([(i, p, g, "t") for i, (p, g) in enumerate(pairs)], "id long, predicted string, gold string, topic string")
    got = {r.id: (r.precision, r.recall, r.alignment, r.similarity) for r in S.aligned(d).collect()}
    assert got == {i: pytest.approx(plain(p, g)) for i, (p, g) in enumerate(pairs)} and got[3] == pytest.approx((1, 1, 1, 1))
    assert S.aligned(d.limit(0)).count() == 0


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    text = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    rows = catalog.QUERIES["answer_alignment"](spark, sf).collect()
    assert len(rows) == sum((c, t - 1) in text for c, t in text)
    for r in rows[:: max(1, len(rows) // 15)]:
        want = plain(text[r.conv_id, r.turn], text[r.conv_id, r.turn - 1])
        assert (r.alignment, r.similarity) == pytest.approx((want[2], want[3]), abs=2e-6)
    assert all(np.isfinite([r.alignment, r.similarity, r.rougel]).all() for r in rows)


def test_tokens_of_few_answers_are_held_at_once(spark):
    """Fails where a worker embeds all tokens of a batch of Arrow rows together."""
    def embed(texts):
        assert len(texts) <= 1100
        return np.array([[1.0, float(len(t))] for t in texts])

    d = spark.range(1500).selectExpr("id", "concat('a', id, ' b', id) AS predicted", "concat('a', id, ' b', id) AS gold").coalesce(1)
    got = S.aligned(d, embed=embed).collect()
    assert len(got) == 1500 and len({r.id for r in got}) == 1500 and all(r.alignment > 0.999 for r in got)
