"""Search over several kinds of memory: dispatch, categories, fallbacks, hydration, rendering, answers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as X
from loomstone.functions import vectors as V
from loomstone.operators import fusion
from loomstone.operators import vector_search as VS
from loomstone.shipping import ship
from loomstone.sources.store import scratch, written

METHODS = ("bm25", "vector", "vector_norlift", "hybrid")


def dispatched(method: str, words: Callable[[int], DataFrame], near: Callable[[int], DataFrame], k: int, lift: Callable[[int], DataFrame] | None = None, strict: bool = False) -> DataFrame:
    """query_id, item, rank, score by a method; words, near and lift make a ranked list of that many.

    An unknown method is hybrid, or an error if strict. vector_norlift is
    plain vector search where no lift is given.
    """
    if method not in METHODS:
        if strict:
            raise ValueError(f"unknown method: {method}")
        method = "hybrid"
    cut = lambda d: d.filter(F.col("rank") <= k).select("query_id", "item", "rank", "score")
    if method == "hybrid":
        return fusion.reciprocal_rank([words(2 * k), near(2 * k)], k).withColumnRenamed("fused_score", "score")
    return cut({"bm25": words, "vector": near, "vector_norlift": lift or near}[method](k))


def noisy_lift(queries: DataFrame, corpus: DataFrame, k: int, eps: float = 1e-6) -> DataFrame:
    """query_id, item, rank, score of all cosines of queries (query_id, q) with corpus (vec_id, v): z-scores through a sigmoid, over their mean.

    The mean of a query's sigmoids is one number, so items are ranked by
    similarity first and only k of each query are scored. Means are summed
    block by block; no pair but the best becomes a row.
    """
    ship(queries.sparkSession)
    best = VS.block_best(queries, corpus, k, told=True)
    n, total = F.sum("n"), F.sum("total")
    m = written(best.groupBy("query_id").agg(n.alias("n"), (total / n).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum("squares") / n - (total / n) * (total / n))).alias("spread")), scratch(queries.sparkSession, "lift"))
    sums = VS.block_sums(queries.join(m, "query_id"), corpus, lambda s, mean, spread: 1 / (1 + np.exp(-(s - mean) / (spread + eps))))
    base = sums.groupBy("query_id").agg(F.sum("total").alias("total"))
    p = 1 / (1 + F.exp(-(F.col("score") - F.col("mean")) / (F.col("spread") + eps)))
    top = VS.ranked(best, k).select("query_id", F.col("vec_id").alias("item"), "rank", "score")
    return top.join(m, "query_id").join(base, "query_id").select("query_id", "item", "rank", (p / (F.col("total") / F.col("n") + eps)).alias("score"))


def categorised(lists: dict[str, tuple[DataFrame, int]], combined: int | None = None) -> DataFrame:
    """category, query_id, kind, item, rank, score of lists by kind, each with its k; k = 0 gives none. combined adds a category of all, best first, so many."""
    out = None
    for kind, (d, k) in lists.items():
        d = d.filter(F.col("rank") <= k).select(F.lit(kind).alias("category"), "query_id", F.lit(kind).alias("kind"), "item", "rank", "score")
        out = d if out is None else out.unionByName(d)
    if combined is not None:
        both = fusion.merge_by_score([out.select("query_id", "kind", "item", "score")], combined)
        out = out.unionByName(both.select(F.lit("combined").alias("category"), "query_id", "kind", "item", "rank", "score"))
    return out


def flattened(results: DataFrame, order: tuple[str, ...] = ("episodic", "semantic")) -> DataFrame:
    """query_id, pos, kind, item: categories one after the other, each in its order; others than these are left out."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("category"))
    w = Window.partitionBy("query_id").orderBy("_c", "rank")
    return results.withColumn("_c", place).filter("_c > 0").withColumn("pos", F.row_number().over(w).cast("bigint")).select("query_id", "pos", "kind", "item")


def with_fallback(found: DataFrame, asked: DataFrame, plain: DataFrame) -> DataFrame:
    """found, and for queries of which it has no row the rows of plain; the column fallback tells them apart."""
    missing = asked.select("query_id").distinct().join(found.select("query_id").distinct(), "query_id", "left_anti")
    columns = found.columns
    return found.withColumn("fallback", F.lit(False)).unionByName(plain.join(missing, "query_id", "left_semi").select(*columns).withColumn("fallback", F.lit(True)))


def hydrated(results: DataFrame, rows: DataFrame, most: int, expand: Column | None = None) -> DataFrame:
    """results (query_id, item, rank) with rows (item, created_at, timestamp, metadata, ...): `most` of each query whose expand is true, the others bare.

    A missing created_at or timestamp comes from the metadata.
    """
    kept = results.withColumn("_go", F.coalesce(expand, F.lit(False)) if expand is not None else F.lit(True))
    w = Window.partitionBy("query_id", "_go").orderBy("rank")
    kept = kept.withColumn("_go", F.col("_go") & (F.row_number().over(w) <= most))
    filled = rows
    for c in ("created_at", "timestamp"):
        filled = filled.withColumn(c, F.coalesce(F.col(c), F.try_element_at("metadata", F.lit(c))))
    j = kept.join(filled.withColumnRenamed("item", "_item"), (F.col("item") == F.col("_item")) & F.col("_go"), "left")
    return j.withColumn("hydrated", F.col("_item").isNotNull()).drop("_item", "_go")


def context(results: DataFrame) -> DataFrame:
    """query_id, text of results (query_id, rank, ts, content, messages): '- [time] content' lines, a block of the messages under each that has some."""
    stamp = F.when(F.col("ts").isNotNull(), F.concat(F.lit("["), F.col("ts").cast("string"), F.lit("] "))).otherwise(F.lit(""))
    block = F.when(F.size("messages") > 0, F.concat(F.lit("\n  Original Messages:\n"), F.array_join(F.transform("messages", lambda m: F.concat(F.lit("    "), m)), "\n"))).otherwise(F.lit(""))
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), stamp, "content", block).alias("line"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def cut_to_tokens(text: Column, most: int) -> Column:
    """The start of a text of about so many tokens by the estimate: 1.5 characters each for CJK, 4 for others."""
    n = F.length(text)
    fits = F.greatest(F.lit(1), F.floor(n * most / F.greatest(X.token_estimate(text), F.lit(1))).cast("int"))
    return F.when(X.token_estimate(text) <= most, text).otherwise(F.substring(text, F.lit(1), fits))


def answered(asked: DataFrame, model: Callable[[str, str], str], most: int = 8000) -> DataFrame:
    """asked (query_id, question, text) with answer, context_tokens and answer_tokens; a context is cut to `most` tokens, a model that fails answers nothing."""

    def run(frames):
        for pdf in frames:
            out = []
            for q, c in zip(pdf["question"], pdf["text"], strict=True):
                try:
                    out.append(str(model(q, c)))
                except Exception:
                    out.append("")
            yield pdf.assign(answer=out)

    d = asked.withColumn("text", cut_to_tokens(F.col("text"), most))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    d = d.mapInPandas(run, f"{names}, answer string")
    return d.withColumns({"context_tokens": X.token_estimate(F.col("text")), "answer_tokens": X.token_estimate(F.col("answer"))})


def neighbourhood(seeds: DataFrame, stored: DataFrame, alive: DataFrame, cents: DataFrame, k: int) -> DataFrame:
    """theme: the seeds and the first k stored neighbours (src, dst, rank) of each that are alive; a seed without any stored takes its k nearest by centroid."""
    seeds = seeds.select("theme").join(alive.select("theme"), "theme", "left_semi").distinct()
    of = stored.join(seeds.select(F.col("theme").alias("src")), "src", "left_semi").join(alive.select(F.col("theme").alias("dst")), "dst", "left_semi")
    near = Window.partitionBy("src").orderBy("rank")
    of = of.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= k)
    lonely = seeds.join(stored.select(F.col("src").alias("theme")).distinct(), "theme", "left_anti").join(cents, "theme").select(F.col("theme").alias("src"), F.col("centroid").alias("q"))
    best = Window.partitionBy("src").orderBy(F.round("s", 9).desc(), "theme")
    # Seeds are a stated set; they meet the living themes.
    made = cents.join(alive.select("theme"), "theme", "left_semi").crossJoin(lonely).filter("theme <> src").withColumn("s", V.cosine(F.col("q"), F.col("centroid"))).withColumn("_r", F.row_number().over(best)).filter((F.col("_r") <= k) & (F.col("s") > 0))
    return seeds.unionByName(of.select(F.col("dst").alias("theme"))).unionByName(made.select("theme")).distinct()


def known_vectors(rows: DataFrame, sources: list[DataFrame], embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id, v of rows (id, text): from the first source (id, v) that has it, else by embedding the text; an empty text has none."""
    d = rows
    for i, s in enumerate(sources):
        d = d.join(s.select("id", F.col("v").alias(f"_v{i}")), "id", "left")
    have = F.coalesce(*(F.col(f"_v{i}") for i in range(len(sources)))) if sources else F.lit(None).cast("array<float>")
    d = d.withColumn("v", have)
    made = embed(d.filter("v is null and length(text) > 0").select("id", "text")).select("id", "v")
    return d.filter("v is not null").select("id", "v").unionByName(made)


def upserted(index: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """An index's rows with those of rows whose key is not there: bulk and single additions alike."""
    return index.unionByName(rows.dropDuplicates([key]).join(index.select(key), key, "left_anti").select(*index.columns))


def without_user(index: DataFrame, users: DataFrame) -> DataFrame:
    """An index without the rows of these users (user_id)."""
    return index.join(users.select("user_id"), "user_id", "left_anti")
