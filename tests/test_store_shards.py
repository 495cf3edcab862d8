"""The store's files are as many however many users there are, and a user's rows are in one shard."""

import re
from pathlib import Path

import pytest

from loomstone.sources.delta_store import DeltaStore
from loomstone.sources.deltas import Deltas
from loomstone.sources.store import KEYS, SCHEMAS


def facts(spark, n):
    """One fact of each of n users, and one of none."""
    return spark.range(n + 1).selectExpr("concat('m', id) AS memory_id", f"IF(id < {n}, concat('u', id), NULL) AS user_id", "concat('said ', id) AS content", "'k' AS knowledge_type", "'1' AS created_at", "CAST(NULL AS STRING) AS updated_at", "array('e') AS source_episodes", "0.8D AS confidence", "CAST(NULL AS MAP<STRING, STRING>) AS metadata", "array('t') AS tags", "1 AS revision_count")


def test_folders_do_not_grow_with_users(spark, tmp_path):
    s = DeltaStore(spark, f"file://{tmp_path}/s")
    s.add_absent("semantic", facts(spark, 60))
    files = lambda: list(Path(tmp_path, "s/semantic").rglob("kind=row/**/*.parquet"))
    assert 0 < len(files()) <= 32
    assert s.read("semantic").columns == spark.createDataFrame([], SCHEMAS["semantic"]).columns and s.read("semantic").count() == 61
    one = s.of_user("semantic", "u7")
    assert [r.memory_id for r in one.collect()] == ["m7"]
    assert re.search(r"PartitionFilters: \[[^\]]*\(shard#\d+ = \d+\)", one._jdf.queryExecution().executedPlan().toString())
    s.delete_user("u7")
    s.delete_user(None)
    assert s.read("semantic").count() == 59 and not s.exists("semantic", "m7") and not s.exists("semantic", "m60")
    # A key that moves to another user moves to that one's shard.
    s.update("semantic", facts(spark, 60).filter("memory_id = 'm3'").selectExpr("memory_id", "'u9' AS user_id", *facts(spark, 1).columns[2:]))
    assert sorted(r.memory_id for r in s.of_user("semantic", "u9").collect()) == ["m3", "m9"] and not s.of_user("semantic", "u3").count()


def test_a_store_by_user_is_told_and_can_be_taken_over(spark, tmp_path):
    old = Deltas(spark, f"file://{tmp_path}/old/semantic", SCHEMAS["semantic"], KEYS["semantic"], "user_id")
    old.write(facts(spark, 3))
    with pytest.raises(ValueError, match="partitioned by user"):
        DeltaStore(spark, f"file://{tmp_path}/old")
    s = DeltaStore(spark, f"file://{tmp_path}/new")
    s.add_absent("semantic", old.read())
    assert sorted(r.memory_id for r in DeltaStore(spark, f"file://{tmp_path}/new").read("semantic").collect()) == ["m0", "m1", "m2", "m3"]
