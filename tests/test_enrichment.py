"""Detectors, generation, retrieval, scores and the stream's flush against plain code."""

import datetime
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.functions import providers
from loomstone.functions import text as X
from loomstone.operators import evaluation, generation, retrieval, segments, themes
from loomstone.operators import vector_graph as G
from loomstone.sources.store import MemoryStore, Store
from loomstone.streaming import buffers

T0 = datetime.datetime(2024, 1, 1)


def messages(spark, minutes, owner=1):
    rows = [(owner, i, "u", f"m{i}", T0 + datetime.timedelta(minutes=m)) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "owner long, seq long, role string, content string, ts timestamp_ntz")


def test_detector_excludes_last_message(spark):
    # From the 12th message on the buffer has more than 10: the gap is then measured from the last but one.
    minutes = [20 * i for i in range(14)]
    d = {r.seq: (r.episode, r.should_end, r.reason) for r in segments.by_detector(messages(spark, minutes)).collect()}
    assert d[0][2] == "first" and all(not d[i][1] for i in range(11)) and d[11] == (1, True, "gap") and d[12] == (1, False, "")


def test_detector_errors_and_clamp():
    m = {"role": "u", "content": "x", "ts": T0}
    assert segments.judged_boundary(lambda b, x: 1 / 0, [m], m) == {"should_end": False, "confidence": 0.0, "reason": "error"}
    assert segments.judged_boundary(lambda b, x: {"should_end": 1, "confidence": 7}, [m], m)["confidence"] == 1.0
    assert not segments.judged_boundary(lambda b, x: {"should_end": True}, [], m)["should_end"]


def test_stream_flush(spark, tmp_path):
    rows = [(1, i, "u", f"m{i}") for i in range(5)] + [(1, 5, buffers.FLUSH, "")]
    spark.createDataFrame(rows, "owner long, seq long, role string, content string").coalesce(1).write.json(f"file://{tmp_path}/in")
    src = spark.readStream.schema("owner long, seq long, role string, content string").json(f"file://{tmp_path}/in")
    q = buffers.episodes(src, 3).writeStream.format("memory").queryName("flushed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.awaitTermination()
    assert sorted((r.first_seq, r.last_seq, r.reason) for r in spark.table("flushed").collect()) == [(0, 2, "size"), (3, 4, "flush")]


def test_json_answers():
    assert generation.salvaged('x {"a": {"b": 1}} y {"c": 2}') == {"a": {"b": 1}} and generation.salvaged('```json\n{"a": 1}\n```') == {"a": 1}
    assert generation.salvaged("{no} {\"a\": 1}") == {"a": 1} and generation.salvaged(None) is None
    heat = []
    model = lambda r, t: heat.append(round(t, 2)) or ('{"a": 1}' if len(heat) == 4 else "no")
    assert generation.asked_json(model, "q", {"d": 0}, tries=5) == {"a": 1} and heat == [0.2, 0.3, 0.4, 0.5]
    assert generation.asked_json(lambda r, t: 1 / 0, "q", {"d": 0}) == {"d": 0}
    assert "Ann" in generation.prompt("summary", facts="Ann") and all(json.dumps(p) for p in generation.PROMPTS.values())


def test_spoken():
    assert generation.spoken("<think>a {</think> Yes. ") == "Yes." and generation.salvaged('<think>{"x": 1}</think>{"a": 2}') == {"a": 2}
    left = ["", None, "Yes."]
    assert generation.asked_text(lambda r, t: left.pop(0), "q") == "Yes." and generation.asked_text(lambda r, t: 1 / 0, "q") == ""


def test_json_marker(spark):
    got = [r.x for r in spark.createDataFrame([('{"a": 1} or {b',), ("none",)], "t string").select(X.json_or_marker(F.col("t")).alias("x")).collect()]
    assert [json.loads(x) for x in got] == [{"a": 1}, {"error": "no_json"}]


def test_novel_and_dispatch(spark):
    s = spark.createDataFrame([("a", 1, "Likes tea."), ("a", 2, " likes tea. "), ("b", 3, "Likes tea."), ("b", 4, "Runs.")], "user_id string, pos long, statement string")
    known = spark.createDataFrame([("b", "likes tea.")], "user_id string, content string")
    assert {(r.user_id, r.pos, r.cold_start) for r in generation.novel(s, known).collect()} == {("a", 1, True), ("b", 4, False)}
    assert generation.dispatched(s, known, lambda d: d, predict=True).count() == 2 and generation.dispatched(s, known, lambda d: d, predict=False, each=False).count() == 0


def pair_texts():
    r = random.Random(3)
    words = ["a", "b", "c", "d", "e"]
    return [(" ".join(r.choices(words, k=r.randint(0, 9))), " ".join(r.choices(words, k=r.randint(0, 9)))) for _ in range(120)]


def test_rouge_l_and_meteor(spark):
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    def meteor(a, b):
        at, used = [], {}
        for x in a:
            places = [j for j, y in enumerate(b) if y == x]
            k = used.get(x, 0)
            at.append(places[k] if k < len(places) else None)
            used[x] = k + 1
        hits = [x for x in at if x is not None]
        if not hits:
            return 0.0
        chunks = sum(1 for i, x in enumerate(at) if x is not None and (i == 0 or at[i - 1] is None or at[i - 1] != x - 1))
        p, r = len(hits) / len(a), len(hits) / len(b)
        return p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (chunks / len(hits)) ** 3)

    pairs = pair_texts()
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, predicted string, gold string")
    got = {r.i: r for r in evaluation.rouge(d).withColumn("meteor", evaluation.meteor(F.col("predicted"), F.col("gold"))).collect()}
    for i, (a, b) in enumerate((x.split(), y.split()) for x, y in pairs):
        want = 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 0.0
        assert got[i].rougel == pytest.approx(want) and got[i].meteor == pytest.approx(meteor(a, b))


def test_key_text(spark):
    one = lambda t: spark.range(1).select(evaluation.key_text(F.lit(t)).alias("x")).first().x
    assert one("  Ｗhat\u3000 Ｉs\tﬁne… ") == "what is fine..." and one("") == ""


def test_vectors_of_other_sizes(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0, 0.0, 0.0]), (3, [1.0, 0.1]), (4, None), (5, [1.0])], "id long, v array<double>")
    assert [(r.a, r.b) for r in G.pairs_above(e, 0.5).collect()] == [(1, 3)]
    assert G.knn(e.filter("id > 9"), e).count() == 0


def test_blocks_make_no_difference(spark, monkeypatch):
    r = np.random.default_rng(1)
    e = spark.createDataFrame([(i, x) for i, x in enumerate(r.normal(size=(60, 4)).tolist())], "id long, v array<double>")
    rows = lambda: ({(x.src, x.dst, x["rank"]) for x in G.knn(e, e, 3).collect()}, {(x.a, x.b) for x in G.pairs_above(e, 0.7).collect()})
    want = rows()
    monkeypatch.setattr(G, "BLOCK", 7)
    assert rows() == want and len(want[0]) == 180


def test_known_vectors(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "")], "id long, text string")
    a = spark.createDataFrame([(1, [1.0])], "id long, v array<float>")
    got = {r.id: r.v for r in retrieval.known_vectors(rows, [a], lambda d: providers.embedded(d, "text", "v", lambda t: np.full((len(t), 1), 9.0))).collect()}
    assert got == {1: [1.0], 2: [9.0]}


def test_repositories_agree(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame([(i, u, c, "k", t, None, [], 0.8, None, [], 1) for i, u, c, t in rows], "memory_id string, user_id string, content string, knowledge_type string, created_at string, updated_at string, source_episodes array<string>, confidence double, metadata map<string, string>, tags array<string>, revision_count int")
    told = []
    for s in (Store(spark, f"file://{tmp_path}/s"), MemoryStore(spark)):
        s.add_absent("semantic", make(("m1", "a:b", "x", "2"), ("m1", "a:b", "first", "1"), ("m2", "b", "y", "1"), ("m3", "b", "z", "3")))
        s.update("semantic", make(("m2", "c", "moved", "1"), ("m9", "c", "not there", "1")))
        s.delete("semantic", make(("m3", "", "", "")).select("memory_id"))
        told.append(sorted((r.memory_id, r.user_id, r.content) for r in s.read("semantic").collect()))
        s.delete_user("a:b")
        s.delete_user("nobody")
        told.append(sorted((r.memory_id, r.user_id) for r in s.read("semantic").collect()))
    assert told[0] == told[2] == [("m1", "a:b", "first"), ("m2", "c", "moved")] and told[1] == told[3] == [("m2", "c")]


def test_greedy_dedup(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(40, 3))
    rows = [(f"u{i % 2}", i % 3, i, x) for i, x in enumerate(v.tolist())]
    d = spark.createDataFrame(rows, "user_id string, kind long, fact long, v array<double>")
    unit, kept, want = v / np.linalg.norm(v, axis=1, keepdims=True), {}, {}
    for u, k, i, _ in rows:
        hit = [j for j in kept.setdefault((u, k), []) if unit[j] @ unit[i] > 0.8]
        want[i] = hit[0] if hit else None
        if not hit:
            kept[u, k].append(i)
    assert {x.fact: x.duplicate_of for x in themes.greedy_dedup(d, 0.8).collect()} == want and any(x is not None for x in want.values())


def test_clusters_and_axis(monkeypatch):
    r = np.random.default_rng(2)
    near = themes._unit(np.array([1.0, 0, 0]) + 0.05 * r.normal(size=(30, 3)))
    far = themes._unit(np.array([0, 1.0, 0]) + 0.05 * r.normal(size=(5, 3)))
    v = np.concatenate([near, far])
    p = themes.Params()
    got = themes.linked(list(range(35)), v, p)
    assert sorted(x for t in got for x in t) == list(range(35)) and max(map(len, got)) <= p.most and set(range(30, 35)) in [set(t) for t in got]
    assert themes.linked([0, 31], v, p) == [[0, 31]]  # few facts are one cluster
    cut = themes.by_first_axis(list(range(35)), v, p)
    assert [len(t) for t in cut] == [12, 12, 11] and (set(range(30, 35)) <= set(cut[0]) or set(range(30, 35)) <= set(cut[-1]))

    def fails(*a, **k):
        raise np.linalg.LinAlgError

    monkeypatch.setattr(np.linalg, "svd", fails)
    assert sorted(x for t in themes.by_first_axis(list(range(35)), v, p) for x in t) == list(range(35))


def test_context_of_split():
    v = np.eye(4)
    p = themes.Params(context=1)
    assert themes._context([0], [[1], [0, 2], [3]], v, p) == [[0, 2]] and themes._context([0], [[1]], v, p) == [[1]]
