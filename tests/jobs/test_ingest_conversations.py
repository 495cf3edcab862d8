"""The ingestion job on growing copies of a table, after failures, with files told twice, and by its command line."""

import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import ingest_conversations as job

SF = "/root/testdata/sf0.001"
CONFIG = json.loads(job.CONFIG.read_text())


class Place:
    """A folder with a growing table of messages and a job's tables."""

    def __init__(self, spark, root, config=CONFIG):
        self.spark, self.config, self.messages, self.out, self.checkpoint = spark, config, f"file://{root}/messages.parquet", f"file://{root}/out", f"file://{root}/checkpoint"

    def add(self, rows):
        rows.write.mode("append").parquet(self.messages)
        return rows.count()

    def run(self):
        return job.ingest(self.spark, self.messages, self.out, self.checkpoint, self.config)

    def rows(self):
        return sorted(map(tuple, job.output(self.spark, self.out).select("part", "owner", "episode", "first_seq", "last_seq", "n", "text").collect()), key=str)


def conversations(spark):
    return spark.read.parquet(f"{SF}/conversations.parquet")


@pytest.fixture(scope="module")
def want():
    """What the SQL says of the whole table."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    return sorted(con.execute(f"SELECT part, owner, episode, first_seq, last_seq, n, text FROM ({job.SQL})").fetchall(), key=str)


def test_growing_input(spark, tmp_path, want):
    place, every = Place(spark, tmp_path), conversations(spark)
    later = (F.col("conv_id") % 3 == 0) | (F.col("turn") >= 3)
    n = place.add(every.filter(~later))
    first = place.run()
    assert first["messages_read"] == n and place.rows() != want
    n = place.add(every.filter(later))
    second = place.run()
    # Only the new file is read, and only shards that got episodes are written.
    assert second["messages_read"] == n and second["episodes"] > first["episodes"] and 0 < len(second["shards_written"]) < CONFIG["shards"]
    assert place.rows() == want
    facts = sorted(Path(place.out.removeprefix("file://"), "facts").rglob("*.parquet"))
    third = place.run()
    assert third["messages_read"] == 0 and third["shards_written"] == [] and place.rows() == want
    assert sorted(Path(place.out.removeprefix("file://"), "facts").rglob("*.parquet")) == facts
    before = spark.conf.get(job.memory._PROVIDER, None)
    assert before is None or "RocksDB" not in before


def test_run_that_dies_is_made_good(spark, tmp_path, want, monkeypatch):
    place = Place(spark, tmp_path)
    place.add(conversations(spark))

    def die(*_):
        raise OSError("lost")

    for step in ("show_open", "refresh_facts"):
        with monkeypatch.context() as m, pytest.raises(OSError):
            m.setattr(job, step, die)
            place.run()
    # The marks are written last: a run that dies before them writes the same facts again.
    assert place.run()["messages_read"] == 0 and place.rows() == want
    spark.createDataFrame([], job.MARKS).coalesce(1).write.mode("overwrite").parquet(f"{place.out}/marks")
    assert len(place.run()["shards_written"]) > 0 and place.rows() == want


def test_messages_told_twice_are_late(spark, tmp_path, want):
    place = Place(spark, tmp_path, CONFIG | {"files_per_trigger": 1})
    n = place.add(conversations(spark).coalesce(1))
    place.run()
    place.add(conversations(spark).coalesce(1))
    assert place.run()["late"] == n
    assert [r for r in place.rows() if r[2] is not None] == want


def test_odd_rows(spark, tmp_path):
    place = Place(spark, tmp_path, {"most": 2, "shards": 3})
    schema = "conv_id long, turn long, role string, text string, owner string, n long"
    place.add(spark.createDataFrame([], schema))
    assert place.run()["messages_read"] == 0 and place.rows() == []
    place.add(spark.createDataFrame([(1, 0, None, None, "x", 1), (1, 1, " ", "One. Two!\nTwo!", "y", 2), (1, 2, "user", "One.", "z", 3), (None, 1, "user", "a", "", 0), (2, None, "user", "b", "", 0), (-4, 0, "user", "", "", 0)], schema))
    place.run()
    assert place.rows() == sorted([("closed", 1, 0, 0, 1, 2, "user: \nuser: One. Two!\nTwo!"), ("open", 1, 1, 2, 2, 1, "user: One."), ("open", -4, 0, 0, 0, 1, "user: "), ("fact", 1, 0, 1, 1, 1, "One."), ("fact", 1, 0, 1, 1, 2, "Two!")], key=str)


def test_command_line(spark, tmp_path):
    place = Place(spark, tmp_path)
    place.add(conversations(spark).filter("conv_id < 5"))
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"most": 2, "shards": 2}))
    done = subprocess.run([sys.executable, job.__file__, "--messages", place.messages, "--out", place.out, "--checkpoint", place.checkpoint, "--config", str(config)], capture_output=True, text=True, cwd=tmp_path, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "new messages of" in done.stderr and '"episodes"' in done.stderr
    assert {p.name for p in (tmp_path / "out" / "episodes").glob("shard=*")} == {"shard=0", "shard=1"} and place.rows()
