"""Fusion and merging of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """query_id, item, rank, fused_score: sums of 1 / (constant + rank) over lists (query_id, item, rank).

    Equal sums keep the order of the first list that has the item.
    """
    every = None
    for i, d in enumerate(lists):
        d = d.select("query_id", "item", "rank", F.lit(i).alias("list"))
        every = d if every is None else every.unionByName(d)
    fused = every.groupBy("query_id", "item").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("fused_score"), F.min(F.struct("list", "rank")).alias("seen"))
    best = Window.partitionBy("query_id").orderBy(F.round("fused_score", 12).desc(), F.asc("seen"), F.asc("item"))
    return fused.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= k).select("query_id", "item", "rank", "fused_score")


def merge_by_score(lists: list[DataFrame], k: int | None = None) -> DataFrame:
    """query_id, kind, item, rank, score of several lists (query_id, kind, item, score), best first."""
    every = lists[0]
    for d in lists[1:]:
        every = every.unionByName(d)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("kind"), F.asc("item"))
    out = every.withColumn("rank", F.row_number().over(best).cast("bigint"))
    return out if k is None else out.filter(F.col("rank") <= k)


def substring_search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc, rank, score: docs (doc, title, content) whose content (1.0) or title (0.5) has the query, in order.

    The stated query set goes to the executors in blocks of bounded size; an
    automaton finds all of a block's queries in one pass over a document.
    """
    import ahocorasick
    import pyarrow as pa

    asked = queries.select(F.col("query_id").cast("long"), F.lower("query").alias("query")).filter("query is not null")
    d = docs.select(F.col("doc").cast("long").alias("doc"), F.lower("content").alias("content"), F.lower("title").alias("title"))

    def send(block: list) -> DataFrame:
        def run(batches):
            auto, every = ahocorasick.Automaton(), [i for i, q in block if not q]
            of: dict[str, list[int]] = {}
            for i, q in block:
                if q:
                    of.setdefault(q, []).append(i)
            for q, ids in of.items():
                auto.add_word(q, ids)
            if of:
                auto.make_automaton()
            for b in batches:
                rows = []
                for doc, content, title in zip(*(b.column(c).to_pylist() for c in ("doc", "content", "title")), strict=True):
                    hit = {}
                    for score, t in ((0.5, title), (1.0, content)):
                        if t is not None:
                            hit |= dict.fromkeys(every, score)
                            if of:
                                hit |= {i: score for _, ids in auto.iter(t) for i in ids}
                    rows += [(i, doc, s) for i, s in hit.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "doc", "score"])

        return d.mapInArrow(run, "query_id long, doc long, score double")

    out, block, size = None, [], 0
    for r in asked.toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size > 8_000_000:
            out, block, size = (send(block) if out is None else out.unionByName(send(block))), [], 0
    if block or out is None:
        out = send(block) if out is None else out.unionByName(send(block))
    first = Window.partitionBy("query_id").orderBy("doc")
    return out.withColumn("rank", F.row_number().over(first).cast("bigint")).filter(F.col("rank") <= k).select("query_id", "doc", "rank", "score")
