"""Dialogue JSON as flat messages and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.text import dialogue_time

_CHAT = "array<struct<speaker: string, text: string, blip_caption: string, query: string>>"


def _read(spark: SparkSession, path: str) -> DataFrame:
    """conv, conversation (map of JSON texts), qa of a file that holds an array of dialogues."""
    d = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.from_json("value", "array<struct<conversation: map<string, string>, qa: array<struct<question: string, answer: string, category: string, evidence: array<string>>>>>")).alias("conv", "d"))
    return d.select(F.col("conv").cast("long").alias("conv"), "d.conversation", "d.qa").withColumn("owner_id", F.concat_ws("_", F.coalesce(F.col("conversation")["speaker_a"], F.lit("speaker_a")), F.col("conv").cast("string")))


def messages(spark: SparkSession, path: str, sessions: int | None = None) -> DataFrame:
    """owner_id, seq, session, role, content, ts: chats of all sessions in the order of their keys' numbers.

    Captions and queries follow the text in brackets; the role is the speaker
    if it is one of the two, else user. A session's time is null if its key
    has none that can be read.
    """
    d = _read(spark, path)
    keys = F.filter(F.map_keys("conversation"), lambda k: ~k.startswith("speaker_") & ~k.endswith("_date_time"))
    number = lambda k: F.coalesce(F.try_to_number(F.regexp_extract(k, "([0-9]+)$", 1), F.lit("999999")).cast("int"), F.lit(0))
    d = d.withColumn("keys", F.array_sort(F.transform(keys, lambda k: F.struct(number(k).alias("n"), k.alias("key")))))
    if sessions is not None:
        d = d.withColumn("keys", F.slice("keys", 1, sessions))
    d = d.select("owner_id", "conversation", F.posexplode("keys").alias("s", "k")).select("owner_id", "conversation", "s", F.col("k.key").alias("session"))
    c = d.select("owner_id", "s", "session", F.col("conversation")["speaker_a"].alias("a"), F.col("conversation")["speaker_b"].alias("b"), F.try_element_at("conversation", F.concat("session", F.lit("_date_time"))).alias("when"), F.posexplode(F.from_json(F.try_element_at("conversation", "session"), _CHAT)).alias("p", "m"))
    put = lambda name, f: F.when(F.length(f) > 0, F.concat(F.lit(f"[{name}: "), f, F.lit("]")))
    content = F.concat_ws(" ", "m.text", put("Image", F.col("m.blip_caption")), put("Search", F.col("m.query")))
    role = F.when(F.col("m.speaker").isin(F.col("a"), F.col("b")), F.col("m.speaker")).otherwise("user")
    return c.select("owner_id", (F.col("s") * 1_000_000 + F.col("p")).cast("long").alias("seq"), "session", role.alias("role"), content.alias("content"), dialogue_time(F.col("when")).alias("ts"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """owner_id, question_id, question, answer, category, evidence."""
    return _read(spark, path).select("owner_id", F.posexplode("qa").alias("question_id", "q")).select("owner_id", F.col("question_id").cast("long").alias("question_id"), "q.question", "q.answer", "q.category", F.coalesce("q.evidence", F.array().cast("array<string>")).alias("evidence"))
