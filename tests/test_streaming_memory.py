"""The stateful buffers: streams against the batch folds, restarts, timers, late messages, life of state."""

import datetime
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from loomstone.operators import segments
from loomstone.streaming import memory
from loomstone.streaming.buffers import FLUSH

SCHEMA = "owner long, seq long, role string, content string, ts timestamp_ntz"
T0 = datetime.datetime(2024, 1, 1)


class Stream:
    """Runs of one stream with its input, checkpoint and output under a folder."""

    def __init__(self, spark, root, f, **settings):
        self.spark, self.root, self.f, self.settings = spark, f"file://{root}", f, settings

    def run(self, rows, clock=False):
        """clock: the stream runs on, as it waits for times of the clock, and is stopped once the rows are through."""
        d = rows if hasattr(rows, "write") else self.spark.createDataFrame(rows, SCHEMA)
        d.write.mode("append").parquet(f"{self.root}/in")
        with memory.rocksdb_state(self.spark):
            out = self.f(self.spark.readStream.schema(SCHEMA).parquet(f"{self.root}/in"), **self.settings)
            q = out.writeStream.format("parquet").option("path", f"{self.root}/out").option("checkpointLocation", f"{self.root}/checkpoint").outputMode("append").trigger(**({"processingTime": "1 second"} if clock else {"availableNow": True})).start()
            end = time.time() + 40
            while clock and time.time() < end and not any(p["numInputRows"] for p in q.recentProgress):
                time.sleep(0.2)
            q.stop() if clock else q.awaitTermination()
        return self.spark.read.parquet(f"{self.root}/out")

    def open(self):
        return memory.open_buffers(self.spark, f"{self.root}/checkpoint")


def events(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    return e.select(F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), F.lit("user").alias("role"), F.col("event_type").alias("content"), F.col("ts").cast("timestamp_ntz").alias("ts"))


def in_two(spark, root, f, **settings):
    """A stream's output after two runs, the second one from the checkpoint with later messages of the same owners."""
    s, e = Stream(spark, root, f, **settings), events(spark)
    middle = e.agg(F.percentile_approx("seq", 0.5)).first()[0]
    s.run(e.filter(F.col("seq") <= middle))
    return s.run(e.filter(F.col("seq") > middle))


def test_judged_is_the_batch_fold_by_detector(spark, tmp_path):
    detect = lambda buffer, m: segments.gap_detector(buffer, m, 360)
    got = in_two(spark, tmp_path, memory.judged, detect=detect, exclude_over=3).collect()
    want = segments.by_detector(events(spark), detect, exclude_over=3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r.episode for r in want}) > 3


def test_judged_is_the_batch_cut_by_size(spark, tmp_path):
    got = in_two(spark, tmp_path, memory.judged, most=7)
    want = segments.by_size(events(spark), 7, drop_short=False)
    assert sorted(map(tuple, got.select("owner", "seq", "episode").collect())) == sorted(map(tuple, want.select("owner", "seq", "episode").collect()))


def test_closed_and_open_are_all_messages(spark, tmp_path):
    s = Stream(spark, tmp_path, memory.closed, most=3)
    s.run([(o, i, "u", f"m{i}", T0) for o in (1, 2) for i in range(4)])
    out = s.run([(1, i, "u", None, T0) for i in range(4, 7)] + [(3, 0, "u", "x", T0)])
    got = out.select("owner", "episode", "first_seq", "last_seq", "n_messages", memory.text_of(F.col("messages")).alias("text"), "reason").orderBy("owner", "episode").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 2, 3, "u: m0\nu: m1\nu: m2", "size"), (1, 1, 3, 5, 3, "u: m3\nu: \nu: ", "size"), (2, 0, 0, 2, 3, "u: m0\nu: m1\nu: m2", "size")]
    assert sorted((r.owner, r.episode, r.seq, r.content) for r in s.open().collect()) == [(1, 2, 6, None), (2, 1, 3, "m3"), (3, 0, 0, "x")]


def test_late_and_repeated_messages_and_flush(spark, tmp_path):
    s = Stream(spark, tmp_path, memory.closed, most=2)
    first = [(1, i, "u", f"m{i}", T0) for i in (0, 1, 4)]
    s.run(first)
    s.run([*first, (1, 3, "u", "late", T0), (1, 5, FLUSH, "", T0), (1, 6, "u", "m6", T0), (2, 0, FLUSH, "", T0)])
    rows = sorted(((r.episode, r.first_seq, r.n_messages, r.reason) for r in s.run([(1, 7, FLUSH, "", T0)]).collect()), key=str)
    assert rows == [(0, 0, 2, "size"), (1, 4, 1, "flush"), (2, 6, 1, "flush"), *((None, i, 1, "late") for i in (0, 1, 3, 4))]
    assert s.open().count() == 0


def test_idle_by_event_time(spark, tmp_path):
    """Gaps end buffers; where no message follows, the watermark does. Owner 9's messages push it on."""
    at = lambda *minutes: [T0 + timedelta(minutes=m) for m in minutes]
    s = Stream(spark, tmp_path, memory.closed, idle=timedelta(minutes=20), late="1 minute")
    s.run([(1, i, "u", "a", t) for i, t in enumerate(at(0, 5, 40, 45))] + [(9, 0, "u", "z", *at(50))])
    out = s.run([(9, 1, "u", "z", *at(300))])
    got = sorted((r.owner, r.episode, r.first_seq, r.last_seq, r.reason) for r in out.collect())
    assert got == [(1, 0, 0, 1, "idle"), (1, 1, 2, 3, "idle"), (9, 0, 0, 0, "idle")]
    # The buffer of owner 1 went, its count of episodes did not.
    out = s.run([(1, 4, "u", "b", *at(310)), (9, 2, "u", "z", *at(700))])
    assert (1, 2, 4, 4, "idle") in {(r.owner, r.episode, r.first_seq, r.last_seq, r.reason) for r in out.collect()}


def test_state_of_limited_life(spark, tmp_path):
    s = Stream(spark, tmp_path, memory.judged, most=2, ttl=timedelta(seconds=3))
    s.run([(1, i, "u", "a", T0) for i in range(5)], clock=True)
    time.sleep(4)
    rows = sorted((r.seq, r.episode) for r in s.run([(1, 5, "u", "a", T0)], clock=True).collect())
    assert rows == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 0)]
    with pytest.raises(ValueError):
        memory.judged(spark.createDataFrame([], SCHEMA), late="1 minute", ttl=timedelta(seconds=3))


def test_setting_is_restored(spark):
    before = spark.conf.get(memory._PROVIDER, None)
    with pytest.raises(RuntimeError), memory.rocksdb_state(spark):
        raise RuntimeError
    assert spark.conf.get(memory._PROVIDER, None) == before
