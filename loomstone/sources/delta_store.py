"""The store of episodes, facts and themes over deltas: each change is there as a whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.sources.deltas import Deltas
from loomstone.sources.store import KEYS, SCHEMAS, _firsts, _Reads, scratch, written

#: Hashes of users that folders are partitioned by; rows that are there lie by this number.
SHARDS = 16


class DeltaStore(_Reads):
    """A repository under root/kind; readers keep the rows that they planned with until clean().

    Folders are partitioned by SHARDS hashes of the user, so their files are
    as many however many users there are, and what is asked of one user reads
    one shard of each. A change costs what it changes: an update writes the
    new rows and the keys of the old ones, whatever the user's other rows are.
    Folders are merged when the newest are as large as the one before, so they
    stay few and a row is written again a logarithmic number of times.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._deltas = {kind: Deltas(spark, f"{self.root}/{kind}", f"{schema}, shard int", KEYS[kind], "shard") for kind, schema in SCHEMAS.items()}
        for d in self._deltas.values():
            if d.foreign():
                raise ValueError(f"{d.root} is partitioned by user, as a version before wrote it: read it as Deltas by user_id and add its rows to a new store")

    def _shard(self, user_id: Column) -> Column:
        return F.pmod(F.xxhash64(user_id), F.lit(SHARDS)).cast("int")

    def read(self, kind: str) -> DataFrame:
        return self._deltas[kind].read().drop("shard")

    def _of(self, kind: str, user_id: str | None) -> DataFrame:
        """A user's rows, from the user's shard alone."""
        user = F.lit(user_id).cast("string")
        return self._deltas[kind].read().filter((F.col("shard") == self._shard(user)) & F.col("user_id").eqNullSafe(user)).drop("shard")

    def of_user(self, kind: str, user_id: str) -> DataFrame:
        d = self._of(kind, user_id)
        return d.orderBy(F.desc("created_at"), KEYS[kind]) if kind == "semantic" else d

    def _change(self, kind: str, rows: DataFrame | None, gone: DataFrame | None) -> None:
        self._deltas[kind].write(None if rows is None else rows.withColumn("shard", self._shard(F.col("user_id"))), gone)
        self._deltas[kind].merge()

    def add_absent(self, kind: str, rows: DataFrame) -> None:
        """Adds rows whose key is new; of equal keys in rows, the first created."""
        self._change(kind, _firsts(kind, rows).join(self.read(kind).select(KEYS[kind]), KEYS[kind], "left_anti"), None)

    def update(self, kind: str, rows: DataFrame) -> None:
        """Replaces the rows whose keys are there; a key may move to another user. Other keys are left out, and of equal ones the first created counts."""
        new = _firsts(kind, rows).join(self.read(kind).select(KEYS[kind]), KEYS[kind], "left_semi")
        new = written(new, scratch(self.spark, "update"))
        self._change(kind, new, new)

    def delete(self, kind: str, keys: DataFrame) -> None:
        self._change(kind, None, self.read(kind).join(keys.select(KEYS[kind]), KEYS[kind], "left_semi"))

    def delete_user(self, user_id: str) -> None:
        for kind in SCHEMAS:
            self._change(kind, None, self._of(kind, user_id))

    def clean(self) -> int:
        """Deletes folders that no new plan reads; how many."""
        return sum(d.clean() for d in self._deltas.values())
