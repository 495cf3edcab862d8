"""Postings counted in their documents' rows, and rankings by blocks, against plain code."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from loomstone.operators import lexical


def words():
    return F.filter(F.split("text", " "), lambda t: t != "")


def test_postings_hold_no_more_than_a_document(spark):
    d = spark.createDataFrame([(1, "b a b"), (2, ""), (3, "a"), (4, None)], "doc long, text string")
    p = lexical.postings(d, words(), [])
    assert sorted(tuple(r) for r in p.select("doc", "dl", "term", "tf").collect()) == [(1, 3, "a", 1), (1, 3, "b", 2), (3, 1, "a", 1)]
    plan = p._jdf.queryExecution().toString()
    assert "Aggregate" not in plan and "Filter" not in plan.split("Physical Plan")[1]


def test_postings_of_repeated_ids_are_one(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "b a"), (1, "a")], "doc long, text string")
    assert sorted(tuple(r) for r in lexical.postings(d, words(), []).select("doc", "dl", "term", "tf").collect()) == [(1, 1, "a", 1), (1, 2, "a", 2), (1, 2, "b", 2)]


def plain(docs, asked, k):
    docs = {i: Counter(t.split()) for i, t in docs.items() if t.split()}
    n, avg = len(docs), sum(sum(c.values()) for c in docs.values()) / len(docs)
    raw = {t: math.log(n - df + 0.5) - math.log(df + 0.5) for t, df in Counter(t for c in docs.values() for t in c).items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if x < 0 else x for t, x in raw.items()}
    out = set()
    for q, text in asked.items():
        s = {i: sum(idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for t in text.split() if t in c) for i, c in docs.items()}
        best = sorted((-round(x, 9), i) for i, x in s.items() if x > 0)[:k]
        out |= {(q, i, r + 1, round(-x, 6)) for r, (x, i) in enumerate(best)}
    return out


def test_ranking_by_blocks_is_that_of_all(spark, monkeypatch):
    monkeypatch.setattr(lexical, "DOCS", 16)
    monkeypatch.setattr(lexical, "QUERIES", 5)
    r = random.Random(3)
    text = lambda n: " ".join(f"w{min(r.randrange(40), r.randrange(40), r.randrange(400))}" for _ in range(r.randrange(n)))
    docs = {i: text(30) for i in range(120)}
    docs |= {i + 500: t for i, t in docs.items() if i % 3 == 0}  # equal scores
    asked = {i: text(12) for i in range(23)}
    d, q = (spark.createDataFrame(list(x.items()), s) for x, s in ((docs, "doc long, text string"), (asked, "query_id long, text string")))
    out = lexical.topk(lexical.postings(d, words(), []).cache(), q.select("query_id", words().alias("tokens")), [], 4)
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().toString()
    assert {(x.query_id, x.doc, x.rank, round(x.score, 6)) for x in out.collect()} == plain(docs, asked, 4)


def test_a_block_gives_its_best_only(monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 90)
    for dense in (0, 1024):
        monkeypatch.setattr(lexical, "DENSE", dense)
        n, kind = 50, pa.schema([("query_id", pa.int64()), ("doc", pa.int64()), ("score", pa.float64())])
        right = pa.table({"doc": [i for i in range(n) for _ in "ab"], "term": ["a", "b"] * n, "part": [float(i % 7 + 1) if t == "a" else 0.5 for i in range(n) for t in "ab"]})
        left = pa.table({"query_id": [1, 2, 3], "terms": [["a"], ["b", "a"], ["z"]], "times": [[2], [1, 1], [1]]})
        got = lexical._block_best(left, right, 3, kind).to_pylist()
        assert [(r["query_id"], r["doc"], r["score"]) for r in got] == [(1, 6, 14.0), (1, 13, 14.0), (1, 20, 14.0), (2, 6, 7.5), (2, 13, 7.5), (2, 20, 7.5)]


def test_one_id_in_several_groups_is_not_summed(spark):
    """Fails where such ids make all postings move."""
    d = spark.createDataFrame([("x", 1, "a b a"), ("y", 1, "a")], "user string, doc long, text string")
    p = lexical.postings(d, words(), ["user"])
    assert sorted(tuple(r) for r in p.select("user", "doc", "dl", "term", "tf").collect()) == [("x", 1, 3, "a", 2), ("x", 1, 3, "b", 1), ("y", 1, 1, "a", 1)]
    assert "Aggregate" not in p._jdf.queryExecution().toString()


def test_several_tokenisers_share_one_shuffle_of_the_texts(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "doc long, text string")
    more = F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("tokens")) for k, t in (("w", words()), ("t", F.split(F.coalesce("text", F.lit("")), "")))))
    p = lexical.postings(d, F.filter("tokens", lambda t: t.isin("a", "b")), ["kind"], more=more)
    assert sorted(tuple(r) for r in p.select("kind", "doc", "dl", "term", "tf").collect()) == [("t", 1, 3, "a", 2), ("t", 1, 3, "b", 1), ("w", 1, 3, "a", 2), ("w", 1, 3, "b", 1)]
    plan = p._jdf.queryExecution().toString().split("Physical Plan")[1]
    # What moves is the text; tokens are made after it.
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "regexp" not in plan[plan.index("Exchange") :] and "split" not in plan[plan.index("Exchange") :]


def test_postings_do_not_meet_their_groups_in_as_few_tasks(spark, tmp_path):
    """Fails where the size of the groups' statistics is not known, so that postings are shuffled by group."""
    text = F.concat_ws(" ", *(F.concat(F.lit(c), (F.col("id") * n % 97).cast("string")) for n, c in enumerate("abcdefgh", 3)))
    d = spark.range(4000).select((F.col("id") % 2).cast("string").alias("g"), F.col("id").alias("doc"), text.alias("text"))
    lexical.postings(d, words(), ["g"]).write.parquet(f"file://{tmp_path}/post")
    post = spark.read.parquet(f"file://{tmp_path}/post")
    asked = d.filter("doc < 20").select("g", F.col("doc").alias("query_id"), words().alias("tokens"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        best = lexical.topk(post, asked, ["g"], 3)
        plan = best._jdf.queryExecution().executedPlan().toString()
        assert best.count() == 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"hashpartitioning\(g#\d+, \d+\)", plan)
