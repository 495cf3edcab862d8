"""An engine's state outlives it: buffers, batches, consumption, graph and indexes; the store's changes are whole."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomstone.engine import MemoryEngine
from loomstone.sources.delta_store import DeltaStore
from loomstone.sources.store import MemoryStore

T0 = datetime.datetime(2024, 1, 1)
SAID = ["apples are red", "trains run fast", "rivers carry water", "stones lie still", "trees grow slowly", "birds sing songs", "houses have doors", "cats chase mice"]
MESSAGES = "owner long, seq long, role string, content string, ts timestamp_ntz"


def said(spark, a, b, owner=1):
    return spark.createDataFrame([(owner, i, "u", f"{SAID[i]}.", T0 + datetime.timedelta(minutes=i)) for i in range(a, b)], MESSAGES)


def episodes(e):
    return sorted((r.user_id, [m.content for m in r.original_messages]) for r in e.store.read("episodes").collect())


def test_a_new_engine_goes_on(spark, tmp_path):
    """Two engines in a row on one root have the rows of one."""
    root = f"file://{tmp_path}/a"
    MemoryEngine(spark, root, most=3).add_messages(said(spark, 0, 4), flush=False)
    e = MemoryEngine(spark, root, most=3)
    e.add_messages(said(spark, 4, 8).unionByName(said(spark, 0, 1, owner=2)), flush=False)
    assert episodes(e) == [("1", [f"{x}." for x in SAID[:3]]), ("1", [f"{x}." for x in SAID[3:6]])]
    e.derive_facts()
    done = e.update_graph()
    e = MemoryEngine(spark, root, most=3)
    assert e.increment("semantic").count() == 0 and e.increment("episodes").count() == 0 and e.update_graph() == done
    assert [d.count() for d in e.graph()] == list(done)
    with MemoryEngine(spark, root, most=3, least=1) as last:
        pass
    assert len(episodes(last)) == 4 and last._buffer.read().count() == 0


def test_a_repeated_batch_changes_nothing(spark, tmp_path, monkeypatch):
    e = MemoryEngine(spark, f"file://{tmp_path}/a", most=3)
    e.add_messages(said(spark, 0, 4), flush=False, batch="b0")
    e.add_messages(said(spark, 0, 4), flush=False, batch="b0")
    assert len(episodes(e)) == 1 and e._buffer.read().count() == 1
    # A call that dies after its episodes were stored, and is tried again by a new engine.
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(e._buffer, "write", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        e.add_messages(said(spark, 4, 8), flush=False, batch="b1")
    e = MemoryEngine(spark, f"file://{tmp_path}/a", most=3)
    assert not e.taken("b1") and len(episodes(e)) == 2
    e.add_messages(said(spark, 4, 8), flush=False, batch="b1")
    assert len(episodes(e)) == 2 and sorted(r.seq for r in e._buffer.read().collect()) == [6, 7] and e.taken("b1")


def test_stream_into_the_engine(spark, tmp_path):
    root = f"file://{tmp_path}"
    stream = lambda e: e.sink(spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), "talk").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    said(spark, 0, 4).coalesce(1).write.parquet(f"{root}/in")
    stream(MemoryEngine(spark, f"{root}/store", most=3))
    said(spark, 4, 8).coalesce(1).write.mode("append").parquet(f"{root}/in")
    e = MemoryEngine(spark, f"{root}/store", most=3)
    stream(e)
    assert len(episodes(e)) == 2 and e.taken("talk:0") and e.taken("talk:1") and e._buffer.read().count() == 2


def test_learning_by_prediction(spark, tmp_path):
    """A user's first episodes are taken as they are; of later ones what the facts found did not say. Each is learned from once."""
    root = f"file://{tmp_path}/a"
    e = MemoryEngine(spark, root, most=2, least=1)
    first = e.learn().count()
    e.add_messages(said(spark, 0, 8))
    told = e.learn().collect()
    assert first == 0 and len(told) == 8 and all(r.cold_start and r.confidence == 0.9 for r in told)
    again = spark.createDataFrame([(1, 20, "u", "Apples are red. Snow falls.", T0 + datetime.timedelta(days=1)), (2, 0, "u", "Apples are red.", T0)], MESSAGES)
    e = MemoryEngine(spark, root, most=2, least=1)
    e.add_messages(again)
    told = e.learn(least=0.1).collect()
    assert sorted((r.user_id, r.statement, r.cold_start) for r in told) == [("1", "Snow falls.", False), ("2", "Apples are red.", True)]
    assert MemoryEngine(spark, root).learn().count() == 0 and e.store.read("semantic").count() == 10
    # Merged folders can go; what is kept is the same.
    assert e.clean() > 0 and e.clean() == 0 and e.learn().count() == 0 and e.store.read("semantic").count() == 10
    facts = {r.content: r for r in e.store.of_user("semantic", "1").collect()}
    assert facts["Snow falls."].confidence == 0.9 and len(facts["Snow falls."].source_episodes) == 1


def test_kept_indexes_follow_the_store(spark, tmp_path):
    e = MemoryEngine(spark, f"file://{tmp_path}/a", most=4, least=1)
    q = spark.createDataFrame([(1, "red apples"), (2, "doors of houses")], "query_id long, text string")
    hits = lambda e, **kw: sorted((r.query_id, r.item) for r in e.search(q, k=2, **kw).collect())
    e.add_messages(said(spark, 0, 4))
    e.derive_facts()
    assert {i for i, _ in hits(e, method="bm25")} == {1}
    e.add_messages(said(spark, 4, 8, owner=2).unionByName(said(spark, 2, 4, owner=3)))
    e.derive_facts()
    # An episode's text tells its first and last message.
    assert {i for i, _ in hits(e, method="bm25")} == {1, 2} and {i for i, _ in hits(e, method="bm25", kind="episodes")} == {1}
    e = MemoryEngine(spark, f"file://{tmp_path}/a")
    # Methods go through one dispatch: an unknown one is hybrid unless strict.
    assert hits(e, method="other", strict=False) == hits(e, method="hybrid") and hits(e, method="vector_norlift")
    with pytest.raises(ValueError):
        e.search(q, method="other")
    e.delete_user("1")
    assert {i for i, _ in hits(e, method="bm25")} == {2} and {r.user_id for r in e._index["semantic"].documents().collect()} == {"2", "3"}


def facts(spark, *rows):
    schema = "memory_id string, user_id string, content string, knowledge_type string, created_at string, updated_at string, source_episodes array<string>, confidence double, metadata map<string, string>, tags array<string>, revision_count int"
    return spark.createDataFrame([(i, u, c, "k", t, None, [], 0.8, None, [], 1) for i, u, c, t in rows], schema)


def test_store_agrees_with_the_one_in_memory(spark, tmp_path):
    told = []
    for s in (DeltaStore(spark, f"file://{tmp_path}/s"), MemoryStore(spark)):
        rows = lambda s=s: sorted((r.memory_id, r.user_id, r.content) for r in s.read("semantic").collect())
        s.add_absent("semantic", facts(spark, ("m1", "a:b", "x", "2"), ("m1", "a:b", "first", "1"), ("m2", "b", "y", "1"), ("m3", "b", "z", "3")))
        s.add_absent("semantic", facts(spark, ("m2", "q", "again", "0"), ("m4", "007", "new", "0")))
        s.update("semantic", facts(spark, ("m2", "c", "moved", "1"), ("m9", "c", "not there", "1")))
        s.delete("semantic", facts(spark, ("m3", "", "", "")))
        told.append(rows())
        s.delete_user("a:b")
        s.delete_user("nobody")
        told += [rows(), sorted(r.memory_id for r in s.of_user("semantic", "007").collect()), s.exists("semantic", "m2"), s.exists("semantic", "m1")]
    assert told[:5] == told[5:] and told[0] == [("m1", "a:b", "first"), ("m2", "c", "moved"), ("m4", "007", "new")]


def test_a_change_that_dies_leaves_the_old_rows(spark, tmp_path):
    s = DeltaStore(spark, f"file://{tmp_path}/s")
    s.add_absent("semantic", facts(spark, ("m1", "a", "x", "1"), ("m2", "b", "y", "1")))
    snapshot = s.read("semantic")
    bad = facts(spark, ("m1", "a", "new", "1")).withColumn("content", F.expr("IF(memory_id = 'm1', CAST(raise_error('lost') AS STRING), content)"))
    with pytest.raises(Exception, match="lost"):
        s.update("semantic", bad)
    rows = lambda d: sorted((r.memory_id, r.content) for r in d.collect())
    assert rows(s.read("semantic")) == [("m1", "x"), ("m2", "y")]
    s.update("semantic", facts(spark, ("m1", "a", "new", "1")))
    s.delete_user("b")
    # A reader keeps what it planned with, until old folders are cleaned away.
    assert rows(snapshot) == [("m1", "x"), ("m2", "y")] and rows(s.read("semantic")) == [("m1", "new")]
    s._deltas["semantic"].merge(every=True)
    assert s.clean() > 0 and rows(s.read("semantic")) == [("m1", "new")]
