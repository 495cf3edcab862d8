"""Facts by prediction and correction: for each episode what its user's facts did not let expect.

Known facts near the episode are retrieved, a model predicts from them what
would be said under its title, and another compares what was said with that.
Users of whom nothing is known have their episodes taken as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import text as X
from loomstone.operators import generation
from loomstone.shipping import ship

Model = Callable[[str, float], str]


def sentences(text: str | None) -> list[str]:
    return [s for part in re.split(r"(?<=[.!?])\s+", text or "") if (s := part.strip(" "))]


def _key(sentence: str) -> str:
    if sentence.startswith("Time:"):
        sentence = re.sub(r"^(?:[^ ]* ){3}", "", sentence)
    return sentence.strip(" ").lower()


def predicted(facts: str, title: str, model: Model | None) -> str:
    """What is expected under a title; without a model the facts themselves."""
    return facts if model is None else generation.asked_text(model, generation.prompt("prediction", facts=facts, title=title))


def unexpected(expected: str, said: str, model: Model | None) -> list[str]:
    """The statements that were said and not expected; without a model the sentences that the expectation has not."""
    if model is None:
        had = {_key(s) for s in sentences(expected)}
        return [s for s in sentences(said) if _key(s) not in had]
    told = generation.asked_json(model, generation.prompt("comparison", expected=expected, said=said), {}).get("statements")
    return [s.strip() for s in told if isinstance(s, str) and s.strip()] if isinstance(told, list) else []


def learned(episodes: DataFrame, facts: DataFrame, near: DataFrame, model: Model | None = None, most: int = 10, least: float = 0.7, confidence: float = 0.9) -> DataFrame:
    """user_id, episode_id, pos, statement, cold_start, confidence, created_at of episodes (user_id, episode_id, title, said, ts).

    facts: user_id, fact, content, created_at. near: query_id (an
    episode_id), user_id, fact, rank, score, as any ranking within users
    gives, twice `most` of each. The first `most` of at least `least` are
    retrieved, else the user's newest. A statement is as old as its episode;
    a user's repeated statements stay once, in the first episode by (ts,
    episode_id). A model that fails or answers without statements gives none.
    Nothing said gives none. The prediction of an episode sees `most` facts
    at most; users of any size are no group.
    """
    ship(episodes.sparkSession)
    known = facts.select("user_id").distinct().withColumn("_known", F.lit(True))
    e = episodes.join(known, "user_id", "left").withColumn("cold_start", F.col("_known").isNull())
    # Episodes that no fact is near are asked for too: they fall back to the newest.
    asked = near.unionByName(e.filter("not cold_start").select(F.col("episode_id").alias("query_id"), "user_id", F.lit(None).cast(dict(near.dtypes)["fact"]).alias("fact"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast("double").alias("score")), allowMissingColumns=True)
    found = generation.relevant(asked, facts.select("user_id", "fact", "created_at"), most, least)
    lines = found.join(facts.select("fact", "content"), "fact").groupBy(F.col("query_id").alias("episode_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n").alias("facts"))
    d = e.join(lines, "episode_id", "left").select("user_id", "episode_id", "title", "said", "ts", "cold_start", F.coalesce("facts", F.lit("")).alias("facts"))

    def run(frames):
        for pdf in frames:
            out = []
            for title, said, cold, had in zip(pdf["title"], pdf["said"], pdf["cold_start"], pdf["facts"], strict=True):
                # Without facts there is nothing to expect, so all that was said is news.
                out.append(unexpected("" if cold else predicted(had, title or "", model), said or "", model))
            pdf["statements"] = out
            yield pdf[["user_id", "episode_id", "ts", "cold_start", "statements"]]

    types = dict(d.dtypes)
    told = d.mapInPandas(run, f"user_id {types['user_id']}, episode_id {types['episode_id']}, ts {types['ts']}, cold_start boolean, statements array<string>")
    each = told.select("user_id", "episode_id", "ts", "cold_start", F.posexplode("statements").alias("pos", "statement"))
    first = each.groupBy("user_id", X.statement_key(F.col("statement")).alias("_k")).agg(F.min(F.struct("ts", "episode_id", "pos", "statement", "cold_start")).alias("x"))
    return first.select("user_id", "x.episode_id", "x.pos", "x.statement", "x.cold_start", F.lit(confidence).alias("confidence"), F.col("x.ts").alias("created_at"))
