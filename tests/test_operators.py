"""Operators on hand-made fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.functions import providers
from loomstone.functions import text as X
from loomstone.functions import vectors as V
from loomstone.operators import adaptive_search as A
from loomstone.operators import evaluation, fusion, lexical, segments, themes
from loomstone.operators import vector_graph as G
from loomstone.sources.store import Store, read_json, scratch
from loomstone.streaming import buffers


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_vectors(spark):
    arr = lambda *xs: F.array(*map(F.lit, xs))
    assert one(spark, V.cosine(arr(0.0, 0.0), arr(1.0, 0.0))) == 0
    assert one(spark, V.cosine(arr(-1.0, 0.0), arr(1.0, 0.0), clip=True)) == 0
    assert one(spark, V.normalize(arr(0.0, 0.0))) == [0, 0] and one(spark, V.normalize(arr(3.0, 4.0))) == [0.6, 0.8]
    assert one(spark, V.manhattan(arr(1.0, 2.0), arr(3.0, -1.0))) == 5
    assert one(spark, V.online_centroid(arr(1.0, 1.0), arr(4.0, 1.0), F.lit(3))) == [2.0, 1.0]


def test_knn_ties_and_zero(spark):
    angles = [0, 10, 50, 60, 89, 180]
    rows = [(i, [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]) for i, a in enumerate(angles)] + [(9, [0.0, 0.0])]
    e = spark.createDataFrame(rows, "id long, v array<double>")
    got = [(r.src, r.dst) for r in G.knn(e, e, 2).orderBy("src", "rank").collect()]
    assert (0, 1) in got and not any(9 in g for g in got) and [g for g in got if g[0] == 5] == []
    comp = {r.id: r.component for r in G.components(e, G.pairs_above(e, 0.9), scratch(spark, "t")).collect()}
    assert comp == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 9: 9}


def test_bm25_tiny(spark):
    d = spark.createDataFrame([(1, "aa bb aa"), (2, "aa cc"), (3, "aa dd dd"), (4, ""), (5, None)], "doc long, text string")
    post = lexical.postings(d, X.index_tokens(F.col("text")), [])
    assert {r.doc for r in post.collect()} == {1, 2, 3}
    idf = {r.term: r.idf for r in lexical.idf(post, post.select("doc", "dl").distinct(), []).collect()}
    raw = {"aa": np.log(0.5 / 3.5), "bb": np.log(2.5 / 1.5), "cc": np.log(2.5 / 1.5), "dd": np.log(2.5 / 1.5)}
    assert idf["aa"] == pytest.approx(0.25 * np.mean(list(raw.values()))) and idf["bb"] == pytest.approx(raw["bb"])
    q = spark.createDataFrame([(1, ["bb"]), (2, ["bb", "bb"]), (3, ["zz"]), (4, [])], "query_id long, tokens array<string>")
    s = {r.query_id: r.score for r in lexical.topk(post, q, [], 5).collect()}
    assert set(s) == {1, 2} and s[2] == pytest.approx(2 * s[1])


def test_rrf(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, item long, rank long")
    b = spark.createDataFrame([(1, 9, 1), (1, 8, 2)], "query_id long, item long, rank long")
    got = [(r.item, round(r.fused_score, 9)) for r in fusion.reciprocal_rank([a, b], 3).orderBy("rank").collect()]
    assert got == [(8, round(2 / 62, 9)), (7, round(1 / 61, 9)), (9, round(1 / 61, 9))]


def test_segments(spark):
    m = spark.range(27).select(F.lit(1).alias("owner"), F.col("id").alias("seq"), F.lit("u").alias("role"), F.col("id").cast("string").alias("content"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, int(id), 0)").alias("ts"))
    n = {r.episode: r["count"] for r in segments.by_size(m, 25, 3).groupBy("episode").count().collect()}
    assert n == {0: 25}
    assert {r.episode: r["count"] for r in segments.by_size(m, 25, 3, drop_short=False).groupBy("episode").count().collect()} == {0: 25, 1: 2}
    e = segments.fallback_episodes(m, ["owner"]).first()
    assert e.title == "Conversation 2024-01-01 00:00 (27 messages)" and e.message_count == 27


def test_themes():
    r = np.random.default_rng(1)
    near = np.array([1.0, 0, 0, 0]) + r.normal(0, 0.02, (14, 4))
    got = themes.build(np.concatenate([near, [[0, 0, 1.0, 0]]]))
    assert sorted(i for t in got for i in t) == list(range(15)) and max(map(len, got)) <= 12
    assert [14] in got
    assert themes.objective([], near) == 0 and themes.objective([[0, 1]], near) == pytest.approx(2, abs=0.05)


def test_greedy_dedup(spark):
    d = spark.createDataFrame([("u", "k", 1, [1.0, 0.0]), ("u", "k", 2, [1.0, 0.01]), ("u", "j", 3, [1.0, 0.0])], "user_id string, kind string, fact long, v array<double>")
    assert {r.fact: r.duplicate_of for r in themes.greedy_dedup(d).collect()} == {1: None, 2: 1, 3: None}


def test_representatives():
    star = {(0, i): 0.9 for i in (1, 2, 3)} | {(i, 0): 0.9 for i in (1, 2, 3)}
    assert A.representatives([0.5] * 5, star, 5)[:2] == [0, 4]
    assert A.representatives([0.1, 0.1], {}, 1) == [0] and A.representatives([], {}, 3) == []


@pytest.mark.parametrize(("ig", "want"), [([-0.5, 0.0, 0.3], [1]), ([0.0, 0.3, 0.0, -0.5, 0.0, -0.6, 0.1], [1, 2, 3, 5]), ([0.0] * 4, [1, 2, 3, 4])])
def test_gate(spark, ig, want):
    d = spark.createDataFrame([(1, i, i, x) for i, x in enumerate(ig, 1)], "query_id long, episode long, rank long, ig double")
    assert sorted(r.rank for r in A.gate(d).collect()) == want


def test_evaluation(spark):
    f1 = lambda a, b: one(spark, evaluation.token_f1(F.lit(a), F.lit(b)))
    assert f1("", "a") == 0 and f1("a a b", "A, b!") == 1 and f1("a", "b") == 0
    assert one(spark, evaluation.bleu1(F.lit("a b"), F.lit("a b"))) == 1 and one(spark, evaluation.bleu1(F.lit(""), F.lit("a"))) == 0


def test_text(spark):
    j = lambda t: one(spark, X.json_object(F.lit(t)))
    assert j('{"a": 1}') == '{"a": 1}' and j('```json\n{"a": 1}\n```') == '{"a": 1}' and j('so: {"a": 1}.') == '{"a": 1}' and j("{a") is None
    assert str(one(spark, X.dialogue_time(F.lit("1:56 pm on 8 May, 2023")))) == "2023-05-08 13:56:00"
    assert one(spark, X.token_estimate(F.lit("日本語abcd"))) == 3
    assert one(spark, X.attribute(F.lit("\0a" * 3000))).endswith("…")


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    row = lambda i, u, c: (i, u, c, "k", "2024-01-0" + i[-1], None, [], 0.8, None, [], 1)
    make = lambda *rows: spark.createDataFrame(list(rows), "memory_id string, user_id string, content string, knowledge_type string, created_at string, updated_at string, source_episodes array<string>, confidence double, metadata map<string, string>, tags array<string>, revision_count int")
    assert s.read("semantic").count() == 0
    s.add_absent("semantic", make(row("m1", "a", "x"), row("m2", "b", "y"), row("m1", "a", "x")))
    s.add_absent("semantic", make(row("m1", "a", "changed"), row("m3", "a", "z")))
    assert [r.memory_id for r in s.of_user("semantic", "a").collect()] == ["m3", "m1"] and s.exists("semantic", "m2")
    s.update("semantic", make(row("m1", "a", "new")))
    assert {r.memory_id: r.content for r in s.read("semantic").collect()} == {"m1": "new", "m2": "y", "m3": "z"}
    assert {r.user_id: r["items"] for r in s.stats("semantic").collect()} == {"a": 2, "b": 1}
    s.delete_user("a")
    assert [r.memory_id for r in s.read("semantic").collect()] == ["m2"]


def test_lenient_read(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"theme_id": "t", "embedding": [1.0], "semantic_ids": ["a", "b"]}\n\nbroken\n')
    r = read_json(spark, f"file://{tmp_path}/t.jsonl", "themes").collect()
    assert [(x.theme_id, x.centroid, x.member_count) for x in r] == [("t", [1.0], 2)]


def test_stream(spark, tmp_path):
    rows = [(o, i, "u", f"m{i}") for o in (1, 2) for i in range(7)]
    spark.createDataFrame(rows, "owner long, seq long, role string, content string").coalesce(1).write.json(f"file://{tmp_path}/in")
    src = spark.readStream.schema("owner long, seq long, role string, content string").json(f"file://{tmp_path}/in")
    q = buffers.episodes(src, 3).writeStream.format("memory").queryName("cut").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.awaitTermination()
    got = sorted((r.owner, r.episode, r.first_seq, r.last_seq) for r in spark.table("cut").collect())
    assert got == [(o, k, 3 * k, 3 * k + 2) for o in (1, 2) for k in (0, 1)]


def test_providers(spark):
    d = spark.createDataFrame([(1, "hello there"), (2, None)], "id long, content string")
    got = {r.id: r.embedding for r in providers.embedded(d, "content").collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-5
    e = spark.createDataFrame([("e", "One. Two!  ")], "episode_id string, content string")
    assert [r.content for r in providers.statements(e).collect()] == ["One.", "Two!"]


def test_episode_pool(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<double>")
    episodes = spark.createDataFrame([(i, [float(20 - i), float(i)]) for i in range(20)] + [(30, None)], "episode long, v array<double>")
    sources = spark.createDataFrame([(7, 15), (7, 30), (8, 2), (9, 18), (7, 99)], "fact long, episode long")
    chosen = spark.createDataFrame([(1, 7), (1, 8)], "query_id long, fact long")
    got = {r.episode: r.score for r in A.episode_pool(chosen, sources, q, episodes, 3).collect()}
    assert set(got) == {0, 1, 2, 15, 30} and got[30] == 0.0 and abs(got[0] - 1) < 1e-9


def test_hier_search_pool_and_gate(spark):
    from loomstone.plans import memory_queries

    sf = "/root/testdata/sf0.001"
    picks = lambda **k: [(r.query_id, r.kind, r["item"], r["rank"]) for r in memory_queries.hier_search(spark, sf, **k).collect()]
    rows, shut = picks(), picks(uncertainty=lambda question, context: 5.0 + context.count("episode"))
    e = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    cents = {k: np.mean([v for i, v in e.items() if i % 97 == k], axis=0) for k in {i % 97 for i in e}}
    for q in {r[0] for r in rows}:
        facts = [x for i, kind, x, _ in rows if i == q and kind == "semantic"]
        near = sorted(cents, key=lambda k: (-round(cos(e[q], cents[k]), 9), k))[:10]
        pool = {x % 97 for x in facts} | set(near)
        score, all_ = {k: cos(e[q], cents[k]) for k in pool}, [cos(e[q], v) for v in e.values()]
        lo, hi = min(score.values()), max(score.values())
        norm = lambda x, q=q, all_=all_: (cos(e[q], e[x]) - min(all_)) / (max(all_) - min(all_))
        part = {k: (score[k] - lo) / (hi - lo) + 0.5 * max((norm(x) for x in facts if x % 97 == k), default=0) for k in pool}
        want = sorted(pool, key=lambda k: (-round(part[k], 9), k))[:10]
        got = [x for _, x in sorted((n, x) for i, kind, x, n in rows if i == q and kind == "episodic")]
        assert got == want
        assert [(x, n) for i, kind, x, n in shut if i == q and kind == "episodic"] == [(want[0], 1)]
