"""Deltas and the lexical index over them, against plain state and an index built anew."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomstone.functions import text as X
from loomstone.operators import lexical
from loomstone.sources.deltas import Deltas
from loomstone.sources.lexical_index import LexicalIndex

SCHEMA = "k long, v string, user string"


def there(d):
    return sorted((r.k, r.v) for r in d.read().collect())


def rows(spark, *kv):
    return spark.createDataFrame([(k, v, f"u{k % 2}") for k, v in kv], SCHEMA)


def test_changes_are_as_in_a_dict(spark, tmp_path):
    d, state, r = Deltas(spark, f"file://{tmp_path}/d", SCHEMA, "k", "user"), {}, random.Random(4)
    assert there(d) == [] and not d.merge()
    for step in range(9):
        put = {r.randrange(8): f"{step}" for _ in range(3)}
        gone = set(put) | {r.randrange(8)}
        d.write(rows(spark, *put.items()), rows(spark, *((k, "") for k in gone)))
        state = {k: v for k, v in state.items() if k not in gone} | put
        if step % 3 == 2:
            old = d.read()
            merged = d.merge(every=step == 5)
            # A reader of before the merge has its folders until they are cleaned away.
            assert sorted((x.k, x.v) for x in old.collect()) == sorted(state.items())
            assert d.clean() > 0 if merged else True
        assert there(d) == sorted(state.items())
    assert len(d.folders()) < 9
    d.write(None, rows(spark, *((k, "") for k in range(8))))
    d.merge(every=True)
    assert there(d) == [] and len(d.folders()) == 1


def test_half_a_change_is_none(spark, tmp_path):
    d = Deltas(spark, f"file://{tmp_path}/d", SCHEMA, "k")
    d.write(rows(spark, (1, "a"), (2, "b")))
    d.write(rows(spark, (1, "c")), rows(spark, (1, ""), (2, "")))
    (tmp_path / "d" / "seg=00000001-00000001" / "_SUCCESS").unlink()
    assert there(d) == [(1, "a"), (2, "b")]

    def die(frames):
        raise OSError("lost")
        yield

    with pytest.raises(Exception, match="lost"):
        d.write(rows(spark, (3, "x")).mapInPandas(die, SCHEMA), rows(spark, (1, "")))
    assert there(d) == [(1, "a"), (2, "b")]
    d.write(rows(spark, (1, "d")), rows(spark, (1, "")))
    assert there(d) == [(1, "d"), (2, "b")]


WORDS = "red green blue apple pear plum tree house river stone".split()


def test_index_is_one_built_anew(spark, tmp_path):
    """Adds, updates, deletes and merges in a row; after each, kept frequencies and rankings are those of a new index."""
    r = random.Random(1)
    ix, state = LexicalIndex(spark, f"file://{tmp_path}/ix", parts=3), {}
    frame = lambda d: spark.createDataFrame([(u, k, t) for k, (u, t) in d.items()], "user_id string, doc long, text string")
    some = lambda ids: {i: (f"u{i % 3}", " ".join(r.choices(WORDS, k=r.randrange(0, 12))) or None) for i in ids}
    asked = spark.createDataFrame([(u, q, t) for u in ("u0", "u1") for q, t in enumerate(("red apple", "river river stone", "nothing"))], "user_id string, query_id long, text string").withColumn("query_id", F.col("query_id") * 10 + F.substring("user_id", 2, 1).cast("long")).withColumn("tokens", X.index_tokens(F.col("text")))
    for step in range(4):
        if step == 0:
            state = some(range(30))
            ix.add(frame(state))
            ix.add(frame(some(range(20))))
        elif step == 1:
            new = some([*range(5), 40, 41])
            ix.put(frame(new))
            state |= new
        elif step == 2:
            ix.delete(spark.createDataFrame([(3,), (40,), (99,)], "doc long"))
            ix.delete_users(spark.createDataFrame([("u2",)], "user_id string"))
            state = {k: v for k, v in state.items() if k not in (3, 40) and v[0] != "u2"}
        else:
            assert ix.merge(every=True) and ix.deltas.clean() >= 4
        docs = frame(state)
        for group in ([], ["user_id"]):
            post = lexical.postings(docs, X.index_tokens(F.col("text")), group).cache()
            want = lexical.topk(post, asked, group, 4)
            ranks = lambda d: sorted((x.query_id, x.rank, x.doc, round(x.score, 9)) for x in d.collect())
            assert ranks(ix.search(asked, 4, group)) == ranks(want)
        df = sorted(map(tuple, ix.frequencies(["user_id"]).collect()))
        assert df == sorted(map(tuple, post.groupBy("user_id", "term").count().collect()))
    assert {x.doc for x in ix.documents().collect()} == set(state)


def test_search_reads_parts_of_its_terms(spark, tmp_path):
    ix = LexicalIndex(spark, f"file://{tmp_path}/ix", parts=8)
    ix.add(spark.createDataFrame([("u", i, f"word{i} other") for i in range(50)], "user_id string, doc long, text string"))
    asked = spark.createDataFrame([(1, ["word7"])], "query_id long, tokens array<string>")
    plan = ix.search(asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert [x.doc for x in ix.search(asked, 3).collect()] == [7]
    assert Path(tmp_path / "ix" / "seg=00000000-00000000" / "kind=posting").is_dir()


def test_empty_index(spark, tmp_path):
    ix = LexicalIndex(spark, f"file://{tmp_path}/ix")
    asked = spark.createDataFrame([(1, ["a"])], "query_id long, tokens array<string>")
    assert ix.search(asked, 3).count() == 0 and ix.documents().count() == 0
    ix.add(spark.createDataFrame([], "user_id string, doc long, text string"))
    assert ix.search(asked, 3).count() == 0
