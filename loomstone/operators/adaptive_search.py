"""The parts of the top-down search over themes, facts and episodes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import vectors as V
from loomstone.functions.providers import Scorer
from loomstone.operators import vector_search as VS
from loomstone.shipping import ship


def fact_pool(queries: DataFrame, facts: DataFrame, k: int = 40) -> DataFrame:
    """query_id, fact, score, norm, rank: the top k facts; norm is min-max over all facts, 0.5 if they are equal."""
    best = VS.block_best(queries, facts.select(F.col("id").alias("vec_id"), "v"), k, told=True)
    # A query's rows are the k best of each block: its least and largest score come with them.
    every = Window.partitionBy("query_id")
    top = VS.ranked(best.withColumns({"lo": F.min("low").over(every), "hi": F.max("score").over(every)}), k)
    norm = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).otherwise(0.5)
    return top.select("query_id", F.col("vec_id").alias("fact"), "score", norm.alias("norm"), "rank")


def candidate_themes(pool: DataFrame, members: DataFrame, queries: DataFrame, themes: DataFrame) -> DataFrame:
    """query_id, theme, score: themes that hold a pooled fact, by cosine of the query with their vector (0 without one)."""
    ids = pool.join(members, "fact").select("query_id", "theme").distinct()
    return ids.join(queries.select("query_id", "q"), "query_id").join(themes.select("theme", F.col("v").alias("tv")), "theme", "left").select("query_id", "theme", F.coalesce(V.cosine(F.col("q"), F.col("tv")), F.lit(0.0)).alias("score"))


def representatives(scores: list[float], edges: dict[tuple[int, int], float], most: int, coverage: float = 1.0, mix: float = 0.7) -> list[int]:
    """Greedy cover: each step takes the candidate with the best mix of newly covered weight and score.

    edges are between candidates' places; each covers itself with weight 1.
    Earlier candidates win ties; at least one is taken if there is any.
    """
    n = len(scores)
    if not n:
        return []
    w = np.eye(n)
    for (i, j), x in edges.items():
        w[i, j] = max(w[i, j], x)
    s = np.asarray(scores, float)
    norm = (s - s.min()) / (s.max() - s.min()) if s.max() > s.min() else np.full(n, 0.5)
    total = w[w > 0].sum()
    total = total if total > 0 else 1.0
    covered, taken = np.zeros(n, bool), []
    while len(taken) < most and not covered.all() and covered.mean() < coverage:
        gain = mix * (w * ~covered).clip(0).sum(axis=1) / total + (1 - mix) * norm
        gain[taken] = -np.inf
        i = int(gain.argmax())
        if not gain[i] > 0:
            break
        taken.append(i)
        covered |= w[i] > 0
    return taken or [0]


def pick(candidates: DataFrame, knn: DataFrame, most: int, coverage: float = 1.0) -> DataFrame:
    """query_id, item, step: representatives of candidates (query_id, item, score), over edges (src, dst, sim).

    A query's candidates are bounded by the pool size before.
    """
    near = candidates.alias("c").join(knn.alias("e"), F.col("c.item") == F.col("e.src")).join(candidates.select(F.col("query_id").alias("q2"), F.col("item").alias("dst2")), (F.col("q2") == F.col("c.query_id")) & (F.col("dst2") == F.col("e.dst"))).groupBy(F.col("c.query_id").alias("query_id"), F.col("c.item").alias("item")).agg(F.collect_list(F.struct(F.col("e.dst").alias("dst"), F.col("e.sim").alias("sim"))).alias("near"))
    rows = candidates.join(near, ["query_id", "item"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "item"], ascending=[False, True], ignore_index=True)
        place = {x: i for i, x in enumerate(pdf["item"])}
        edges = {(i, place[e["dst"]]): float(e["sim"]) for i, es in enumerate(pdf["near"]) if es is not None for e in es}
        got = representatives(pdf["score"].tolist(), edges, most, coverage)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[:1].tolist() * len(got), "item": pdf["item"].iloc[got].tolist(), "step": range(1, len(got) + 1)})

    ship(candidates.sparkSession)
    return rows.groupBy("query_id").applyInPandas(run, "query_id long, item long, step long")


def episode_pool(chosen: DataFrame, sources: DataFrame, queries: DataFrame, episodes: DataFrame, k: int = 10) -> DataFrame:
    """query_id, episode, score: source episodes of the chosen facts, and the top k of all episodes by cosine.

    chosen: query_id, fact; sources: fact, episode; episodes: episode, v. A
    null vector scores 0 and is in no top k; sources not in episodes are left out.
    """
    q = queries.select("query_id", "q")
    score = V.cosine(F.col("q"), F.col("v"))
    near = VS.topk(q, episodes.filter("v is not null").select(F.col("episode").alias("vec_id"), "v"), k).select("query_id", F.col("vec_id").alias("episode"), "score")
    of = chosen.join(sources, "fact").select("query_id", "episode").distinct().join(episodes, "episode").join(q, "query_id")
    both = of.select("query_id", "episode", F.coalesce(score, F.lit(0.0)).alias("score")).unionByName(near)
    return both.groupBy("query_id", "episode").agg(F.max("score").alias("score"))


def information_gain(probes: DataFrame, uncertainty: Scorer) -> DataFrame:
    """query_id, episode, rank, ig of probes (query_id, episode, rank, question, context, text).

    ig is the uncertainty from the context less that from the context with the episode's text.
    """

    def run(frames):
        for pdf in frames:
            before = {x: uncertainty(*x) for x in set(zip(pdf["question"], pdf["context"], strict=True))}
            pdf["ig"] = [float(before[q, c] - uncertainty(q, f"{c}\n{t}")) for q, c, t in zip(pdf["question"], pdf["context"], pdf["text"], strict=True)]
            yield pdf[["query_id", "episode", "rank", "ig"]]

    return probes.select("query_id", "episode", "rank", "question", "context", "text").mapInPandas(run, "query_id long, episode long, rank long, ig double")


def episode_priority(vec_scores: DataFrame, parents: DataFrame, probe: int = 10) -> DataFrame:
    """query_id, episode, priority, rank: min-max of the score over the pool plus half the best parent fact's norm.

    vec_scores: query_id, episode, score; parents: query_id, episode, norm.
    """
    w = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    spread = F.when(hi > lo, hi - lo).otherwise(1e-6)
    best = parents.groupBy("query_id", "episode").agg(F.max("norm").alias("parent"))
    p = vec_scores.withColumn("part", (F.col("score") - lo) / spread).join(best, ["query_id", "episode"], "left").withColumn("priority", F.col("part") + 0.5 * F.coalesce("parent", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.round("priority", 9).desc(), F.asc("episode"))
    return p.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= probe).select("query_id", "episode", "priority", "rank")


def gate(probes: DataFrame, most: int = 10, stop: float = -0.40, choose: float = -0.45, expand: float = 0.25) -> DataFrame:
    """query_id, episode, rank, expand of chosen probes (query_id, episode, rank, ig).

    A probe with ig <= stop is low. Probing ends after a low one within the
    first 3, after two within the first 10, or when `most` are chosen. If
    none is chosen, the first probe is.
    """
    w = Window.partitionBy("query_id").orderBy("rank")
    low = F.col("ig") <= stop
    d = probes.withColumn("low", low.cast("int")).withColumn("lows", F.sum("low").over(w)).withColumn("picked", F.sum((~low & (F.col("ig") > choose)).cast("int")).over(w))
    ends = ((F.col("low") == 1) & (((F.col("lows") >= 1) & (F.col("rank") <= 3)) | ((F.col("lows") >= 2) & (F.col("rank") <= 10)))) | ((F.col("low") == 0) & (F.col("picked") >= most))
    d = d.withColumn("end", F.min(F.when(ends, F.col("rank"))).over(Window.partitionBy("query_id")))
    d = d.withColumn("ok", (F.col("low") == 0) & (F.col("ig") > choose) & (F.col("end").isNull() | (F.col("rank") <= F.col("end"))))
    d = d.withColumn("any", F.max(F.col("ok").cast("int")).over(Window.partitionBy("query_id")))
    return d.filter(F.col("ok") | ((F.col("any") == 0) & (F.col("rank") == 1))).select("query_id", "episode", "rank", (F.col("ok") & (F.col("ig") > expand)).alias("expand"))
