"""Message buffers as one stateful processor: detector, size, idle time and eviction.

An owner's state is a value (episode number, last seq and time taken) and the
list of messages in the buffer, so a run touches only the owners that have
new messages or whose timer is due. State survives in the checkpoint; a
restarted stream goes on where it ended. Needs the RocksDB state store
(see rocksdb_state).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from loomstone.operators.segments import Detector, judged_boundary
from loomstone.shipping import ship
from loomstone.streaming.buffers import FLUSH

_HEAD = "episode long, last_seq long, last_us long"
_HELD = "seq long, role string, content string, us long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """The session's streams that start within use the state store that lists, timers and TTL need; the setting is restored."""
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, was)


class _Buffers(StatefulProcessor):
    def __init__(self, columns: list[str], whole: bool, detect: Detector | None, most: int, exclude_over: int | None, idle: timedelta | None, event_time: bool, ttl: timedelta | None):
        self.columns, self.whole, self.detect, self.most, self.exclude_over = columns, whole, detect, most, exclude_over
        self.idle_us, self.event_time = round(idle.total_seconds() * 1e6) if idle else None, event_time
        self.ttl_ms = round(ttl.total_seconds() * 1e3) if ttl else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD, self.ttl_ms)
        self.held = handle.getListState("held", _HELD, self.ttl_ms)

    def _load(self) -> tuple[list, list[dict]]:
        head = list(self.head.get()) if self.head.exists() else [0, None, None]
        held = [dict(zip(("seq", "role", "content", "us"), m, strict=True)) for m in self.held.get()] if self.held.exists() else []
        return head, [m | {"ts": pd.Timestamp(m["us"], unit="us")} for m in held]

    def _store(self, head: list, held: list[dict]) -> None:
        self.head.update(tuple(head))
        if held:
            self.held.put([(m["seq"], m["role"], m["content"], m["us"]) for m in held])
        else:
            self.held.clear()

    def _closed(self, owner, episode: int | None, held: list[dict], reason: str) -> tuple:
        said = [{k: m[k] for k in ("seq", "role", "content")} for m in held]
        return owner, episode, held[0]["seq"], held[-1]["seq"], len(held), held[0]["ts"], held[-1]["ts"], said, reason

    def _frame(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        owner, out = key[0], []
        head, held = self._load()
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, role, content, us in zip(*(new[c].tolist() for c in ("seq", "role", "content", "us")), strict=True):
            m = {"seq": int(seq), "role": role, "content": content, "us": int(us), "ts": pd.Timestamp(int(us), unit="us")}
            if head[1] is not None and seq <= head[1]:
                # The buffer is past it: a message told twice, or too late.
                out.append(self._closed(owner, None, [m], "late") if self.whole else (owner, m["seq"], None, False, 0.0, "late"))
                continue
            if role == FLUSH:
                if held and self.whole:
                    out.append(self._closed(owner, head[0], held, "flush"))
                head, held = [head[0] + bool(held), m["seq"], m["us"]], []
                continue
            said = {"should_end": False, "confidence": 0.0, "reason": ""}
            if self.idle_us is not None and held and us - head[2] > self.idle_us:
                said = {"should_end": True, "confidence": 1.0, "reason": "idle"}
            elif self.detect is not None:
                seen = held[:-1] if self.exclude_over is not None and len(held) > self.exclude_over else held
                said = judged_boundary(self.detect, [{k: x[k] for k in ("seq", "role", "content", "ts")} for x in seen], {k: m[k] for k in ("seq", "role", "content", "ts")})
            elif len(held) >= self.most:
                said = {"should_end": True, "confidence": 1.0, "reason": "size"}
            if said["should_end"] and held:
                if self.whole:
                    out.append(self._closed(owner, head[0], held, said["reason"]))
                head[0], held = head[0] + 1, []
            held.append(m)
            head[1], head[2] = m["seq"], m["us"]
            if not self.whole:
                out.append((owner, m["seq"], head[0], said["should_end"], said["confidence"], said["reason"]))
        self._store(head, held)
        if self.idle_us is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            if held:
                now = None if self.event_time else timerValues.getCurrentProcessingTimeInMs()
                self.handle.registerTimer((head[2] if self.event_time else now * 1000) // 1000 + self.idle_us // 1000 + 1)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        head, held = self._load()
        if held:
            out = [self._closed(key[0], head[0], held, "idle")] if self.whole else []
            # The count of episodes goes on; only the messages leave the state.
            self._store([head[0] + 1, *head[1:]], [])
            yield from self._frame(out)

    def close(self) -> None:
        pass


def _run(messages: DataFrame, whole: bool, schema: str, detect: Detector | None, most: int, exclude_over: int | None, idle: timedelta | None, late: str | None, ttl: timedelta | None) -> DataFrame:
    if ttl is not None and late is not None:
        raise ValueError("state of limited life needs processing time")
    ship(messages.sparkSession)
    at = F.col("ts").cast("timestamp") if "ts" in messages.columns else F.lit(0).cast("timestamp")
    d = messages.select("owner", "seq", "role", "content", F.unix_micros(at).alias("us"), *([at.alias("at")] if late is not None else []))
    if late is not None:
        d = d.withWatermark("at", late)
    columns = StructType.fromDDL(schema).names
    mode = "EventTime" if late is not None else "ProcessingTime" if idle or ttl else "None"
    return d.groupBy("owner").transformWithStateInPandas(_Buffers(columns, whole, detect, most, exclude_over, idle, late is not None, ttl), schema, "Append", mode)


def judged(messages: DataFrame, detect: Detector | None = None, most: int = 25, exclude_over: int | None = 10, idle: timedelta | None = None, late: str | None = None, ttl: timedelta | None = None) -> DataFrame:
    """owner, seq, episode, should_end, confidence, reason of a stream of messages (owner, seq, role, content, ts): what segments.by_detector says of them, or by_size without a detector.

    Messages are taken by seq within a trigger; one at or before the last
    taken is late: it has no episode and changes nothing. With a detector,
    size cuts nothing. idle: a buffer whose last message is so old ends, by
    the next message or, if none comes, by a timer: of event time where late
    (the watermark's delay) is given, else of the clock. ttl: an owner's
    state goes so long after its last change, episode count included. A
    stream that watches the clock runs until it is stopped: the availableNow
    trigger never sees its end. A message of the role FLUSH ends the buffer and is in no episode.
    """
    types = dict(messages.dtypes)
    return _run(messages, False, f"owner {types['owner']}, seq long, episode long, should_end boolean, confidence double, reason string", detect, most, exclude_over, idle, late, ttl)


def closed(messages: DataFrame, detect: Detector | None = None, most: int = 25, exclude_over: int | None = 10, idle: timedelta | None = None, late: str | None = None, ttl: timedelta | None = None) -> DataFrame:
    """owner, episode, first_seq, last_seq, n_messages, first_ts, last_ts, messages (seq, role, content), reason: each episode once it has ended, as judged() cuts them. A late message is a row of its own without an episode.

    What has not ended is in the state; open_buffers() shows it.
    """
    types = dict(messages.dtypes)
    return _run(messages, True, f"owner {types['owner']}, episode long, first_seq long, last_seq long, n_messages int, first_ts timestamp_ntz, last_ts timestamp_ntz, messages array<struct<seq: long, role: string, content: string>>, reason string", detect, most, exclude_over, idle, late, ttl)


def text_of(messages: Column) -> Column:
    """'role: content' lines of an array of messages (seq, role, content)."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def open_buffers(spark: SparkSession, checkpoint: str) -> DataFrame:
    """owner, episode, seq, role, content of the messages that a stream of closed() or judged() still holds, read from its checkpoint."""
    state = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
    head = state("head").load().select("key.owner", "value.episode")
    held = state("held").option("flattenCollectionTypes", True).load().select("key.owner", "list_element.*")
    return held.join(head, "owner").select("owner", "episode", "seq", "role", "content")
