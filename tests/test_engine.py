"""The engine end to end, and the dialogue reader."""

import json

import pytest

from loomstone.engine import MemoryEngine
from loomstone.sources import dialogues

TALK = [{"conversation": {"speaker_a": "Ann", "speaker_b": "Bo", "session_10_date_time": "9:05 am on 1 June, 2023", "session_10": [{"speaker": "Bo", "text": "Late.", "blip_caption": "a cat", "query": "cats"}], "session_2_date_time": "1:56 pm on 8 May, 2023", "session_2": [{"speaker": "Ann", "text": "I like red apples. They are sweet."}, {"speaker": "Zed", "text": "Trains run fast."}]}, "qa": [{"question": "What does Ann like?", "answer": "apples", "category": 1, "evidence": ["D1"]}]}]


@pytest.fixture
def path(tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(TALK))
    return f"file://{tmp_path}/d.json"


def test_dialogues(spark, path):
    m = [(r.owner_id, r.session, r.role, r.content, str(r.ts)) for r in dialogues.messages(spark, path).orderBy("seq").collect()]
    assert m == [("Ann_0", "session_2", "Ann", "I like red apples. They are sweet.", "2023-05-08 13:56:00"), ("Ann_0", "session_2", "user", "Trains run fast.", "2023-05-08 13:56:00"), ("Ann_0", "session_10", "Bo", "Late. [Image: a cat] [Search: cats]", "2023-06-01 09:05:00")]
    q = dialogues.questions(spark, path).first()
    assert (q.owner_id, q.question_id, q.category, q.evidence) == ("Ann_0", 0, "1", ["D1"])


def test_engine(spark, path, tmp_path):
    e = MemoryEngine(spark, f"file://{tmp_path}/store")
    m = dialogues.messages(spark, path).withColumnRenamed("owner_id", "owner")
    e.add_messages(m)
    e.add_messages(m)
    e.derive_facts()
    assert e.store.read("episodes").count() == 1 and e.store.read("semantic").count() == 5
    q = spark.createDataFrame([(1, "sweet red apples")], "query_id long, text string")
    for method in ("bm25", "vector", "hybrid"):
        got = e.search(q, method=method, k=2).collect()
        assert got and {r.query_id for r in got} == {1}
    with pytest.raises(ValueError):
        e.search(q, method="other")
    assert e.themes().count() == 5 and e.stats().count() == 2
    e.delete_user("Ann_0")
    assert e.stats().count() == 0


def test_engine_buffers_and_graph(spark, tmp_path):
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    m = lambda a, b: spark.createDataFrame([(1, i, "u", f"Fact {'abcdefgh'[i] * 3} is told.", t0 + datetime.timedelta(minutes=i)) for i in range(a, b)], "owner long, seq long, role string, content string, ts timestamp_ntz")
    with MemoryEngine(spark, f"file://{tmp_path}/store", most=3) as e:
        e.add_messages(m(0, 4), flush=False)
        assert [r.message_count for r in e.store.read("episodes").collect()] == [3]
        e.add_messages(m(4, 8), flush=False)
        assert [r.message_count for r in e.store.read("episodes").collect()] == [3, 3]
        e.derive_facts()
        nodes, edges = e.update_graph()
        assert nodes == 6 + 2 + 6 + e.themes().select("theme").distinct().count() and edges == 6 + 6 + 6
        assert e.increment("semantic").count() == 0 and e.update_graph() == (nodes, edges)
        e.flush()
        assert e.increment("episodes").count() == 1
        q = spark.createDataFrame([(1, "ccc or ddd")], "query_id long, text string")
        got = e.search_all(q, k_episodes=0, k_facts=2, method="bm25", combined=3).collect()
        assert {r.category for r in got} == {"semantic", "combined"} and sum(r.category == "semantic" for r in got) == 2
    assert e.store.read("episodes").count() == 3


def test_engine_leaves_near_facts_out(spark, tmp_path):
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    said = ["The red apples are sweet.", "Trains run on rails.", "The red apples are sweet!!", "Rivers carry much water."]
    m = spark.createDataFrame([(1, i, "u", t, t0 + datetime.timedelta(minutes=i)) for i, t in enumerate(said)], "owner long, seq long, role string, content string, ts timestamp_ntz")
    e = MemoryEngine(spark, f"file://{tmp_path}/store", least=1)
    e.add_messages(m.filter("seq < 2"))
    e.derive_facts(dedup_above=0.8)
    e.add_messages(m.filter("seq >= 2"))
    e.derive_facts(dedup_above=0.8)
    assert sorted(r.content for r in e.store.read("semantic").collect()) == sorted([said[0], said[1], said[3]])
