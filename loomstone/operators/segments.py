"""Message buffers, episodes and their text."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.shipping import ship


class Detector(Protocol):
    """Whether a message ends the episode of the messages before it: a dict with should_end, confidence and reason. Messages are dicts of role, content and ts."""

    def __call__(self, buffer: list[dict], message: dict) -> dict: ...


def gap_detector(buffer: list[dict], message: dict, minutes: int = 30) -> dict:
    """The default: more than so long since the last message that the buffer shows."""
    gap = (message["ts"] - buffer[-1]["ts"]).total_seconds() / 60
    return {"should_end": gap > minutes, "confidence": min(1.0, gap / (2 * minutes)), "reason": "gap" if gap > minutes else ""}


def judged_boundary(detect: Detector, buffer: list[dict], message: dict) -> dict:
    """What a detector says: never before the first message, confidence within 0 and 1, no boundary where it fails."""
    if not buffer:
        return {"should_end": False, "confidence": 0.0, "reason": "first"}
    try:
        said = dict(detect(buffer, message))
        return {"should_end": bool(said.get("should_end", False)), "confidence": min(1.0, max(0.0, float(said.get("confidence", 0.0)))), "reason": str(said.get("reason", ""))}
    except Exception:
        return {"should_end": False, "confidence": 0.0, "reason": "error"}


def by_detector(messages: DataFrame, detect: Detector = gap_detector, exclude_over: int | None = 10) -> DataFrame:
    """owner, seq, episode, should_end, confidence, reason: the buffer's fold, in which a detector judges each message.

    A buffer of more than exclude_over messages is shown without its last one,
    which may lead over to the next topic. With a detector, size cuts nothing.
    The fold is one owner's history in order, an Arrow group.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, buffer, episode = [], [], 0
        for m in pdf.sort_values("seq")[["seq", "role", "content", "ts"]].to_dict("records"):
            seen = buffer[:-1] if exclude_over is not None and len(buffer) > exclude_over else buffer
            said = judged_boundary(detect, seen, m)
            if said["should_end"] and buffer:
                buffer, episode = [], episode + 1
            buffer.append(m)
            out.append((pdf["owner"].iloc[0], m["seq"], episode, said["should_end"], said["confidence"], said["reason"]))
        return pd.DataFrame(out, columns=["owner", "seq", "episode", "should_end", "confidence", "reason"])

    ship(messages.sparkSession)
    types = dict(messages.dtypes)
    return messages.select("owner", "seq", "role", "content", "ts").groupBy("owner").applyInPandas(fold, f"owner {types['owner']}, seq {types['seq']}, episode long, should_end boolean, confidence double, reason string")


def normalised(raw: DataFrame, now: Column) -> DataFrame:
    """owner, seq, role, content, ts, metadata of incoming messages, whose fields are texts that may be missing.

    A role is user by default, a null content empty; a time is ISO, Z being
    +00:00, in UTC, and `now` where it can't be read. Columns besides are
    metadata, as texts, nulls left out.
    """
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    rest = [c for c in raw.columns if c not in ("owner", "seq", "role", "content", "timestamp")]
    zoned = F.try_to_timestamp(F.regexp_replace(have("timestamp"), "Z$", "+00:00"))
    meta = F.map_filter(F.create_map(*(x for c in rest for x in (F.lit(c), F.col(c).cast("string")))), lambda k, v: v.isNotNull()) if rest else F.lit(None).cast("map<string,string>")
    role = F.when(F.length(F.trim(have("role"))) > 0, F.trim(have("role"))).otherwise("user")
    return raw.select("owner", "seq", role.alias("role"), F.coalesce(have("content"), F.lit("")).alias("content"), F.coalesce(zoned.cast("timestamp_ntz"), now.cast("timestamp_ntz")).alias("ts"), meta.alias("metadata"))


def left_over(messages: DataFrame, most: int) -> DataFrame:
    """The messages that are still in their owners' buffers, with the episode they would be: those after the last full one."""
    d = by_size(messages, most, drop_short=False)
    last = Window.partitionBy("owner", "episode")
    return d.withColumn("_n", F.count(F.lit(1)).over(last)).filter(F.col("_n") < most).drop("_n")


def flushed(messages: DataFrame, most: int, least: int = 1) -> DataFrame:
    """owner, episode, n_messages, text, reason of what is left in all buffers; a rest of fewer than `least` messages is lost with its buffer."""
    return rendered(left_over(messages, most), ["owner", "episode"]).filter(F.col("n_messages") >= least).withColumn("reason", F.lit("flush"))


def timed_out(messages: DataFrame) -> DataFrame:
    """owner, timed_out: always false; time ends no buffer but by inactive()."""
    return messages.select("owner").distinct().withColumn("timed_out", F.lit(False))


def buffer_totals(messages: DataFrame, least: int, most: int) -> DataFrame:
    """One row over all buffers: buffers, messages, ready, full, avg_messages."""
    s = buffer_stats(messages, least, most)
    return s.agg(F.count(F.lit(1)).alias("buffers"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"), F.count_if("ready").alias("ready"), F.count_if("full").alias("full"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("avg_messages"))


def to_json(messages: DataFrame) -> DataFrame:
    """owner, buffer: each owner's messages in order as a JSON text."""
    m = F.array_sort(F.collect_list(F.struct("seq", "role", "content", F.col("ts").cast("string").alias("ts"))))
    return messages.groupBy("owner").agg(F.to_json(F.struct(m.alias("messages"), F.count(F.lit(1)).alias("size"))).alias("buffer"))


def from_json(buffers: DataFrame) -> DataFrame:
    """owner, seq, role, content, ts of JSON buffers."""
    kind = "struct<messages: array<struct<seq: long, role: string, content: string, ts: string>>>"
    d = buffers.select("owner", F.explode(F.from_json("buffer", kind)["messages"]).alias("m"))
    return d.select("owner", "m.seq", "m.role", "m.content", F.col("m.ts").cast("timestamp_ntz").alias("ts"))


def by_size(messages: DataFrame, most: int, least: int = 1, drop_short: bool = True) -> DataFrame:
    """messages (owner, seq, ...) with episode (from 0): a buffer is cut when it holds `most`; short rests go if drop_short."""
    order = Window.partitionBy("owner").orderBy("seq")
    d = messages.withColumn("episode", F.floor((F.row_number().over(order) - 1) / most).cast("bigint"))
    if not drop_short:
        return d
    return d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("owner", "episode"))).filter(F.col("_n") >= least).drop("_n")


def batched(rows: DataFrame, size: int, by: str = "owner", order: str = "seq") -> DataFrame:
    """rows with batch (from 0): so many of an owner in order, the last one shorter."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))


def by_boundary(messages: DataFrame, boundary: Column) -> DataFrame:
    """messages with episode: a running count of boundaries; the first message of an owner never is one."""
    order = Window.partitionBy("owner").orderBy("seq")
    cut = F.coalesce(boundary, F.lit(False)) & (F.row_number().over(order) > 1)
    return messages.withColumn("_c", cut.cast("bigint")).withColumn("episode", F.sum("_c").over(order)).drop("_c")


def gap_boundary(minutes: int = 30) -> Column:
    """A message comes more than so long after its owner's last one."""
    before = F.lag("ts").over(Window.partitionBy("owner").orderBy("seq"))
    return (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(before.cast("timestamp"))) > minutes * 60


def rendered(messages: DataFrame, keys: list[str], times: bool = False) -> DataFrame:
    """keys..., text: 'role: content' lines in order, with '[time] ' before if times; n messages."""
    stamp = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] ")) if times else F.lit("")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", "content", stamp.alias("stamp")))), lambda m: F.concat(m["stamp"], m["role"], F.lit(": "), m["content"]))
    return messages.groupBy(*keys).agg(F.array_join(lines, "\n").alias("text"), F.count(F.lit(1)).alias("n_messages"))


def fallback_episodes(messages: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., title, content, message_count, ts: episodes told from their first and last message alone."""
    d = messages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.min("ts").alias("ts"),
        F.min_by("content", "seq").alias("first"),
        F.max_by("content", "seq").alias("last"),
        F.max("ts").alias("until"),
    )
    short = lambda c: F.concat(F.substring(F.col(c), 1, 100), F.when(F.length(c) > 100, F.lit("...")).otherwise(F.lit("")))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    title = F.concat(F.lit("Conversation "), stamp("ts"), F.lit(" ("), F.col("message_count").cast("string"), F.lit(" messages)"))
    content = F.concat(F.lit("From "), stamp("ts"), F.lit(" to "), stamp("until"), F.lit(". First: "), short("first"), F.lit(" Last: "), short("last"))
    return d.select(*keys, title.alias("title"), content.alias("content"), "message_count", "ts")


def valid_episode() -> Column:
    return (F.length(F.trim("title")) > 0) & (F.length(F.trim("content")) > 0) & (F.col("message_count") > 0)


def buffer_stats(messages: DataFrame, least: int, most: int) -> DataFrame:
    """owner, n, ready, full, first_ts, last_ts."""
    return messages.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) >= least).alias("ready"), (F.count(F.lit(1)) >= most).alias("full"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def inactive(messages: DataFrame, now: Column, hours: float = 24) -> DataFrame:
    """owner, last_ts, age_hours of buffers whose last message is older."""
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_ts").cast("timestamp"))) / 3600
    return messages.groupBy("owner").agg(F.max("ts").alias("last_ts")).withColumn("age_hours", age).filter(F.col("age_hours") > hours)
