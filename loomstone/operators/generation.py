"""Episodes, facts and summaries from texts: what a model would write, with checks, retries and defaults that need none."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as X
from loomstone.functions import vectors as V
from loomstone.operators import segments
from loomstone.shipping import ship
from loomstone.sources.store import scratch, written

#: The types of facts in a typed answer, in the order in which they are read.
TYPES = ("user_profile", "experience", "knowledge", "other")

#: Requests to a model, by use; braces are filled in.
PROMPTS = {
    "boundary": "Messages of one conversation so far:\n{history}\n\nThe next one:\n{message}\n\nDoes the next message begin another topic? Answer with a JSON object of should_end (boolean), confidence (0 to 1) and reason.",
    "episode": "Describe this conversation as one event.\n{conversation}\n\nAnswer with a JSON object of title, content and timestamp.",
    "facts": "List what stays true after these events.\n{episodes}\n\nAnswer with a JSON object whose keys are user_profile, experience, knowledge and other, each a list of sentences.",
    "prediction": "Known facts:\n{facts}\n\nWhat would you expect to be said under the title: {title}?",
    "comparison": "Expected:\n{expected}\n\nSaid:\n{said}\n\nAnswer with a JSON object of statements: what was said and not expected.",
    "summary": "Sum these facts up in one sentence.\n{facts}",
    "judge": "Question: {question}\nReference: {gold}\nAnswer: {answer}\n\nIs the answer right? Answer with a JSON object of label, 1 or 0.",
}


def prompt(use: str, **fields: str) -> str:
    """The request of a use with its fields filled in; a missing field raises a KeyError."""
    return PROMPTS[use].format(**fields)


def salvaged(answer: str | None) -> dict | None:
    """The JSON object of a model's answer: all of it, inside a code fence, the first balanced {...} that can be read, or first { to last }."""
    t = spoken(answer)
    tries = [t]
    if t.startswith("```"):
        tries.append(t.split("\n", 1)[-1].rsplit("```", 1)[0])
    depth, start = 0, 0
    for i, c in enumerate(t):
        if c == "{":
            start, depth = (i if not depth else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                tries.append(t[start : i + 1])
    tries.append(t[t.find("{") : t.rfind("}") + 1])
    for x in tries:
        try:
            if isinstance(found := json.loads(x), dict):
                return found
        except ValueError:
            continue
    return None


def spoken(answer: str | None) -> str:
    """An answer without the thoughts that some models put before it, up to the last closing mark, and without white space around."""
    return (answer or "").rsplit("</think>", 1)[-1].strip()


def asked_text(model: Callable[[str, float], str], request: str, tries: int = 3, temperature: float = 0.2, wait: float = 0.0) -> str:
    """What a model answers in words: asked again where it fails or says nothing; then empty."""
    for k in range(max(1, tries)):
        try:
            if said := spoken(model(request, temperature)):
                return said
        except Exception:
            pass
        if wait:
            time.sleep(wait * 2**k)
    return ""


def asked_json(model: Callable[[str, float], str], request: str, default: dict, tries: int = 3, temperature: float = 0.2, wait: float = 0.0) -> dict:
    """The JSON object that a model answers: asked again, a tenth warmer each time up to one half, then the default."""
    for k in range(max(1, tries)):
        try:
            found = salvaged(model(request, min(0.5, temperature + 0.1 * k) if k else temperature))
            if found is not None:
                return found
        except Exception:
            pass
        if wait:
            time.sleep(wait * 2**k)
    return default


def generated_episodes(messages: DataFrame, keys: list[str], model: Callable[[str, float], str] | None = None) -> DataFrame:
    """keys..., title, content, message_count, ts, generated: a model's episode of each group of messages, or the plain one.

    A model's answer counts if title and content are texts that are not empty;
    its time counts if it can be read, else that of the first message. Each
    group falls back for itself.
    """
    plain = segments.fallback_episodes(messages, keys)
    if model is None:
        return plain.withColumn("generated", F.lit(False))

    def run(frames):
        for pdf in frames:
            said = [asked_json(model, prompt("episode", conversation=t), {}) for t in pdf["text"]]
            ok = [all(isinstance(a.get(c), str) and a[c].strip() for c in ("title", "content")) for a in said]
            for c in ("title", "content", "timestamp"):
                pdf[f"said_{c}"] = [str(a[c]) if o and a.get(c) else None for a, o in zip(said, ok, strict=True)]
            yield pdf.drop(columns=["text", "n_messages"])

    ship(messages.sparkSession)
    text = segments.rendered(messages, keys)
    types = dict(text.dtypes)
    told = text.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", said_title string, said_content string, said_timestamp string")
    said = F.try_to_timestamp(F.regexp_replace("said_timestamp", "Z$", "+00:00")).cast("timestamp_ntz")
    return plain.join(told, keys, "left").select(*keys, F.coalesce("said_title", "title").alias("title"), F.coalesce("said_content", "content").alias("content"), "message_count", F.coalesce(said, "ts").alias("ts"), F.col("said_title").isNotNull().alias("generated"))


def episode_time(said: Column, first: Column, now: Column) -> Column:
    """When an episode was: the time that was said, else that of its first message, else now."""
    read = F.try_to_timestamp(F.regexp_replace(said, "Z$", "+00:00")).cast("timestamp_ntz")
    return F.coalesce(read, first.cast("timestamp_ntz"), now.cast("timestamp_ntz"))


def flattened(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """The columns of answers but the answer, pos, statement: sentences of JSON answers by type, then of other keys in their order.

    A value is a text or a list of texts; anything else is skipped. Untyped
    answers have their sentences under statements, a key like any other.
    """
    others = [c for c in answers.columns if c != answer]
    values = F.from_json(answer, "map<string,variant>")
    keys = F.json_object_keys(answer)
    types = F.array(*map(F.lit, TYPES))
    order = F.concat(F.array_intersect(types, keys), F.array_except(keys, types))

    def texts(k: Column) -> Column:
        v = F.try_element_at(values, k)
        kind = F.schema_of_variant(v)
        listed = F.filter(v.cast("array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
        return F.when(kind == "STRING", F.array(v.cast("string"))).when(kind.startswith("ARRAY"), F.transform(listed, lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))

    each = F.flatten(F.transform(order, texts))
    return answers.select(*others, F.posexplode(each).alias("pos", "statement"))


def as_facts(statements: DataFrame, sources: DataFrame, confidence: float = 0.8) -> DataFrame:
    """memory_id, user_id, content, knowledge_type, confidence, created_at, source_episodes of statements (user_id, group, statement).

    sources (group, episode_id, created_at): a fact is as old as the first of
    its group's episodes. Texts are trimmed and empty ones left out.
    """
    of = sources.groupBy("group").agg(F.min("created_at").alias("created_at"), F.array_sort(F.collect_set("episode_id")).alias("source_episodes"))
    d = statements.withColumn("content", F.trim("statement")).filter("content <> ''").join(of, "group")
    key = F.sha2(F.concat_ws("\0", "user_id", "content"), 256)
    return d.select(key.alias("memory_id"), "user_id", "content", F.lit("knowledge").alias("knowledge_type"), F.lit(confidence).alias("confidence"), "created_at", "source_episodes")


def novel(statements: DataFrame, known: DataFrame) -> DataFrame:
    """What prediction and correction keeps: statements (user_id, statement, ...) that no known fact (user_id, content) has, compared as keys.

    Users without any known fact keep all: a cold start. Repeated statements
    of a user stay once, the first by `pos`.
    """
    key = X.statement_key(F.col("statement"))
    first = Window.partitionBy("user_id", "_k").orderBy("pos")
    d = statements.withColumn("_k", key).withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    had = known.select("user_id", X.statement_key(F.col("content")).alias("_k")).distinct()
    cold = d.join(known.select("user_id").distinct().withColumn("_had", F.lit(True)), "user_id", "left").withColumn("cold_start", F.col("_had").isNull()).drop("_had")
    return cold.join(had, ["user_id", "_k"], "left_anti").drop("_k")


def relevant(near: DataFrame, facts: DataFrame, most: int = 10, least: float = 0.7) -> DataFrame:
    """query_id, fact, pos of near (query_id, user_id, fact, rank, score), twice `most` of each: the first `most` whose score is at least `least`.

    A query without any falls back to its user's last `most` facts (user_id,
    fact, created_at), the newest first.
    """
    # A ranking is read three times below, and is dear to make.
    near = written(near, scratch(near.sparkSession, "near"))
    good = near.filter((F.col("rank") <= 2 * most) & (F.col("score") >= least))
    w = Window.partitionBy("query_id").orderBy("rank")
    good = good.withColumn("pos", F.row_number().over(w).cast("bigint")).filter(F.col("pos") <= most).select("query_id", "fact", "pos", F.lit(False).alias("fallback"))
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("fact"))
    last = facts.withColumn("pos", F.row_number().over(newest).cast("bigint")).filter(F.col("pos") <= most)
    lonely = near.select("query_id", "user_id").distinct().join(good.select("query_id").distinct(), "query_id", "left_anti")
    return good.unionByName(lonely.join(last, "user_id").select("query_id", "fact", "pos", F.lit(True).alias("fallback")))


def dispatched(episodes: DataFrame, known: DataFrame, extract: Callable[[DataFrame], DataFrame], predict: bool = True, each: bool = True) -> DataFrame:
    """user_id, episode_id, pos, statement of all users' episodes: by prediction and correction, else episode by episode, else none."""
    said = extract(episodes)
    if predict:
        return novel(said, known).drop("cold_start")
    return said if each else said.filter("false")


def extraction_text(episodes: DataFrame, by: list[str]) -> DataFrame:
    """by..., text: episodes (seq, title, content, created_at, original_messages) as numbered blocks, with their messages where there are any."""
    time_ = lambda m: F.when(F.length(m["timestamp"]) > 0, F.concat(F.lit("["), m["timestamp"], F.lit("] "))).otherwise(F.lit(""))
    said = F.array_join(F.transform("original_messages", lambda m: F.concat(F.lit("  "), time_(m), F.coalesce(m["role"], F.lit("Unknown")), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")
    body = F.when(F.size("original_messages") > 0, F.concat(F.lit("Original Conversation:\n"), said)).otherwise(F.concat(F.lit("Content: "), "content"))
    block = F.concat(F.lit("Title: "), "title", F.lit("\n"), body, F.lit("\nCreated at: "), F.col("created_at").cast("string"), F.lit("\n"))
    blocks = F.array_sort(F.collect_list(F.struct("seq", block.alias("block"))))
    return episodes.groupBy(*by).agg(F.array_join(F.transform(blocks, lambda b, i: F.concat(F.lit("Episode "), (i + 1).cast("string"), F.lit(":\n"), b["block"])), "\n").alias("text"))


def theme_summaries(facts: DataFrame, cents: DataFrame, batch: DataFrame | None = None) -> DataFrame:
    """theme, summary of facts (theme, fact, content, v): the one nearest its centroid, the smaller id of equal ones.

    With a batch (fact), only its texts can be chosen, as only they are at
    hand; a theme without any has the empty summary.
    """
    sim = V.cosine(F.col("v"), F.col("centroid"))
    d = facts if batch is None else facts.join(batch.select("fact"), "fact", "left_semi")
    best = d.join(cents.select("theme", "centroid"), "theme").groupBy("theme").agg(F.max_by("content", F.struct(F.round(sim, 9), -F.col("fact"))).alias("summary"))
    return cents.select("theme").join(best, "theme", "left").select("theme", F.coalesce("summary", F.lit("")).alias("summary"))
