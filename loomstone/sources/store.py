"""A store of episodes, facts and themes in Parquet, partitioned by user; and scratch folders."""

from __future__ import annotations

import tempfile
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name in the folder of spark.checkpoint.dir; a local one only where that is unset and the master is this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="loomstone-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table: its lineage ends there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Fixed schemas; readers never infer.
SCHEMAS = {
    "episodes": "episode_id string, user_id string, title string, content string, original_messages array<struct<message_id: string, role: string, content: string, timestamp: string, metadata: map<string, string>>>, message_count int, boundary_reason string, created_at string, timestamp string, metadata map<string, string>, tags array<string>",
    "semantic": "memory_id string, user_id string, content string, knowledge_type string, created_at string, updated_at string, source_episodes array<string>, confidence double, metadata map<string, string>, tags array<string>, revision_count int",
    "themes": "theme_id string, user_id string, summary string, embedding array<float>, semantic_ids array<string>, created_at string, updated_at string, centroid array<float>, member_count int, neighbors array<string>, neighbor_sims array<double>",
}
KEYS = {"episodes": "episode_id", "semantic": "memory_id", "themes": "theme_id"}


def read_json(spark: SparkSession, path: str, kind: str, array: bool = False) -> DataFrame:
    """JSON lines (or whole-file arrays) of a kind, with missing fields filled as older writers left them."""
    d = spark.read.schema(SCHEMAS[kind]).option("mode", "PERMISSIVE").option("multiLine", array).json(path)
    d = d.filter(F.col(KEYS[kind]).isNotNull())
    if kind == "episodes":
        return d.withColumns({"timestamp": F.coalesce("timestamp", "created_at"), "message_count": F.coalesce("message_count", F.when(F.col("original_messages").isNotNull(), F.size("original_messages")))})
    if kind == "semantic":
        return d.withColumns({"confidence": F.coalesce("confidence", F.lit(0.8)), "revision_count": F.coalesce("revision_count", F.lit(1))})
    members = F.when(F.size("semantic_ids") > 0, F.size("semantic_ids")).otherwise(1)
    return d.withColumns({"centroid": F.coalesce("centroid", "embedding"), "member_count": F.coalesce("member_count", members)})


def write_json(rows: DataFrame, path: str) -> None:
    """Rows of a kind as JSON lines in place of what is there; nulls are left out, so a reader fills them as for older writers."""
    rows.write.mode("overwrite").json(path)


class Repository(Protocol):
    """What a store of entities can do; kind is one of SCHEMAS."""

    def read(self, kind: str) -> DataFrame: ...
    def get(self, kind: str, key: str) -> DataFrame: ...
    def exists(self, kind: str, key: str) -> bool: ...
    def of_user(self, kind: str, user_id: str) -> DataFrame: ...
    def add_absent(self, kind: str, rows: DataFrame) -> None: ...
    def update(self, kind: str, rows: DataFrame) -> None: ...
    def delete(self, kind: str, keys: DataFrame) -> None: ...
    def delete_user(self, user_id: str) -> None: ...
    def stats(self, kind: str) -> DataFrame: ...


class _Reads:
    """What follows from read() alone."""

    def of_user(self, kind: str, user_id: str) -> DataFrame:
        """A user's rows, the newest facts first; the filter prunes partitions."""
        d = self.read(kind).filter(F.col("user_id") == user_id)
        return d.orderBy(F.desc("created_at"), KEYS[kind]) if kind == "semantic" else d

    def get(self, kind: str, key: str) -> DataFrame:
        return self.read(kind).filter(F.col(KEYS[kind]) == key)

    def exists(self, kind: str, key: str) -> bool:
        return bool(self.get(kind, key).limit(1).take(1))

    def stats(self, kind: str) -> DataFrame:
        return self.read(kind).groupBy("user_id").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("content" if kind != "themes" else "summary")).alias("chars"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))

    def hierarchy(self) -> DataFrame:
        """user_id, episodes, facts, themes, theme_facts: the sizes of every user's hierarchy, in one pass over each kind."""
        n = lambda kind, c: F.count(F.lit(1)).alias(c)
        e, f = (self.read(k).groupBy("user_id").agg(n(k, c)) for k, c in (("episodes", "episodes"), ("semantic", "facts")))
        t = self.read("themes").groupBy("user_id").agg(n("themes", "themes"), F.sum(F.size("semantic_ids")).alias("theme_facts"))
        j = e.join(f, "user_id", "full").join(t, "user_id", "full")
        return j.select("user_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("episodes", "facts", "themes", "theme_facts")))


def _firsts(kind: str, rows: DataFrame) -> DataFrame:
    """One row of each key: the first created, then the first by text."""
    first = Window.partitionBy(KEYS[kind]).orderBy("created_at", "summary" if kind == "themes" else "content", "user_id")
    return rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


class MemoryStore(_Reads):
    """A repository of DataFrames in the session, for tests and for short-lived use."""

    def __init__(self, spark: SparkSession):
        self.spark, self._rows = spark, {k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()}

    def read(self, kind: str) -> DataFrame:
        return self._rows[kind]

    def add_absent(self, kind: str, rows: DataFrame) -> None:
        old = self._rows[kind]
        self._rows[kind] = old.unionByName(_firsts(kind, rows).join(old.select(KEYS[kind]), KEYS[kind], "left_anti").select(*old.columns))

    def update(self, kind: str, rows: DataFrame) -> None:
        old, key = self._rows[kind], KEYS[kind]
        new = _firsts(kind, rows).join(old.select(key), key, "left_semi").select(*old.columns)
        self._rows[kind] = old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new)

    def delete(self, kind: str, keys: DataFrame) -> None:
        old = self._rows[kind]
        self._rows[kind] = old.join(keys.select(KEYS[kind]), KEYS[kind], "left_anti").select(*old.columns)

    def delete_user(self, user_id: str) -> None:
        for kind, d in self._rows.items():
            self._rows[kind] = d.filter(~F.col("user_id").eqNullSafe(user_id))


class Store(_Reads):
    """Rows of a kind under root/kind/user_id=...; each write is a new set of files, so readers keep their snapshot."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, kind: str) -> str:
        return f"{self.root}/{kind}"

    def read(self, kind: str) -> DataFrame:
        """All rows; none where nothing was written."""
        try:
            return self.spark.read.schema(SCHEMAS[kind]).parquet(self._at(kind))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMAS[kind])

    def add_absent(self, kind: str, rows: DataFrame) -> None:
        """Appends rows whose key is new; of equal keys in rows, the first created."""
        new = _firsts(kind, rows).join(self.read(kind).select(KEYS[kind]), KEYS[kind], "left_anti")
        # One task a user's part: files are no more than users and splits.
        new.select(*self.spark.createDataFrame([], SCHEMAS[kind]).columns).repartition("user_id").write.mode("append").partitionBy("user_id").parquet(self._at(kind))

    def _drop(self, kind: str, user_id: str | None) -> None:
        jvm = self.spark.sparkContext._jvm
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("user_id", user_id)
        path = jvm.org.apache.hadoop.fs.Path(f"{self._at(kind)}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path) and not fs.delete(path, True):
            raise OSError(f"{path} was not deleted")

    def _rewrite(self, kind: str, rows: DataFrame, users: DataFrame) -> None:
        """Replaces the partitions of some users by rows, by way of a table, as a plan can't overwrite what it reads; users that have no rows left lose theirs."""
        at = scratch(self.spark, "rewrite")
        users = written(users.distinct(), f"{at}/users")
        # Any number of rows may be a user's; users are few against them.
        of = rows.join(users.withColumnRenamed("user_id", "of"), F.col("user_id").eqNullSafe(F.col("of")), "left_semi")
        rows = written(of, f"{at}/rows")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("user_id").parquet(self._at(kind))
        here = rows.select(F.col("user_id").alias("of")).distinct()
        for r in users.join(here, F.col("user_id").eqNullSafe(F.col("of")), "left_anti").toLocalIterator():
            self._drop(kind, r.user_id)

    def update(self, kind: str, rows: DataFrame) -> None:
        """Replaces the rows whose keys are there; a key may move to another user. Other keys are left out, and of equal ones the first created counts."""
        old, key = self.read(kind), KEYS[kind]
        new = _firsts(kind, rows).join(old.select(key), key, "left_semi").select(*old.columns)
        kept = old.join(new.select(key), key, "left_anti").select(*old.columns)
        users = old.join(new.select(key), key, "left_semi").select("user_id").unionByName(new.select("user_id"))
        self._rewrite(kind, kept.unionByName(new), users)

    def delete(self, kind: str, keys: DataFrame) -> None:
        """Drops the rows of these keys; only their users' partitions are written anew."""
        old, key = self.read(kind), KEYS[kind]
        self._rewrite(kind, old.join(keys.select(key), key, "left_anti").select(*old.columns), old.join(keys.select(key), key, "left_semi").select("user_id"))

    def delete_user(self, user_id: str) -> None:
        """Drops the user's partitions of all kinds, in the spelling that Spark gives the folder."""
        for kind in SCHEMAS:
            self._drop(kind, user_id)
