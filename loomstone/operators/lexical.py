"""BM25 (Okapi) over DataFrames: postings, idf and top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomstone.shipping import ship
from loomstone.sources.store import scratch, written

#: Documents and queries of a block, about.
DOCS, QUERIES = 8192, 16384
#: Scores that a task holds at once, and terms that it scores by one matrix product.
CELLS, DENSE = 4_000_000, 1024


def _runs(docs: DataFrame, tokens: Column, group: list[str], more: Column | None) -> tuple[DataFrame, Column]:
    """group..., doc, dl of each document, and as a column of these rows the array of its terms with their tf.

    Documents are dealt by id before they are taken apart: texts are shuffled,
    not the far larger postings. A document's terms are counted in its own
    row, as runs of its sorted tokens, so no task holds more than a document.
    `more`, an array of structs, makes a row of each of its elements after
    the dealing, so group and tokens may be of its fields.
    """
    d = docs.repartition("doc")
    d = d if more is None else d.select(*docs.columns, F.inline(more))
    d = d.select(*group, "doc", F.sort_array(tokens).alias("_t")).withColumn("dl", F.size("_t"))
    # A filter here would be moved before the shuffle, so texts would be tokenised twice; no places give no rows.
    d = d.withColumn("_at", F.filter(F.when(F.col("dl") > 0, F.sequence(F.lit(0), F.col("dl") - 1)), lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1))))
    runs = F.transform("_at", lambda x, j: F.struct(F.get("_t", x).alias("term"), (F.coalesce(F.get("_at", j + 1), F.col("dl")) - x).cast("long").alias("tf")))
    return d, runs


def counted(docs: DataFrame, tokens: Column, group: list[str], more: Column | None = None) -> DataFrame:
    """group..., doc, dl, runs: a row of each document with its length and an array of its terms with their tf."""
    d, runs = _runs(docs, tokens, group, more)
    return d.select(*group, "doc", "dl", runs.alias("runs"))


def postings(docs: DataFrame, tokens: Column, group: list[str], more: Column | None = None) -> DataFrame:
    """group..., doc, dl, term, tf of counted(); documents without tokens are not there.

    Only where ids repeat, counts of rows of the same group, id and length are summed.
    """
    d, runs = _runs(docs, tokens, group, more)
    # Of an array that has a name, inline() would make a filter.
    rows = d.select(*group, "doc", "dl", F.inline(runs))
    # Rows of one id in several groups are of several documents.
    own = [c for c in group if c in docs.columns]
    if docs.groupBy(*own, "doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return rows
    return rows.groupBy(*group, "doc", "dl", "term").agg(F.sum("tf").alias("tf"))


def statistics(docs: DataFrame, tokens: Column, group: list[str]) -> DataFrame:
    """group..., docs, tokens, avg_tokens of an index; documents without tokens count as documents."""
    n = F.size("_t")
    return docs.select(*group, tokens.alias("_t")).groupBy(*group).agg(F.count(F.lit(1)).alias("docs"), F.sum(n).alias("tokens"), F.round(F.avg(n), 6).alias("avg_tokens"))


def idf(post: DataFrame, docs: DataFrame, group: list[str], eps: float = 0.25) -> DataFrame:
    """group..., term, df, idf. A negative idf becomes eps times the mean of the raw ones in its group.

    docs has a row for each indexed document: group..., doc, dl.
    """
    size = docs.groupBy(*group).agg(F.count(F.lit(1)).alias("n_docs"))
    if group:
        size = written(size, scratch(post.sparkSession, "sizes"))
    # Written, as the mean reads them too.
    df = written(post.groupBy(*group, "term").agg(F.count(F.lit(1)).alias("df")), scratch(post.sparkSession, "df"))
    return idf_of(df, size, group, eps)


def idf_of(df: DataFrame, size: DataFrame, group: list[str], eps: float = 0.25) -> DataFrame:
    """idf() from kept counts: df (group..., term, df) and size (group..., n_docs)."""
    raw = (df.join(size, group) if group else df.crossJoin(F.broadcast(size))).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy(*group).agg(F.avg("raw").alias("mean"))  # a row for each group
    j = raw.join(mean, group) if group else raw.crossJoin(F.broadcast(mean))
    return j.select(*group, "term", "df", F.when(F.col("raw") < 0, eps * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def topk(post: DataFrame, queries: DataFrame, group: list[str], k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, doc, rank, score: BM25 sums over query tokens (repeated ones count again), cut to k, then score > 0.

    queries: group..., query_id, tokens. Only postings of the query terms are
    joined, after the statistics are reduced to those terms. post is read
    three times, so it should be a written table.
    """
    # One pass over the postings tells all of the documents; a row of each is left.
    docs = written(post.groupBy(*group, "doc", "dl").agg(F.sum("tf").alias("tokens")), scratch(post.sparkSession, "lengths"))
    # The sum of all term frequencies is that of the lengths.
    stats = docs.groupBy(*group).agg((F.sum("tokens") / F.count_distinct("doc")).alias("avgdl"), F.count_distinct("doc").alias("n_docs"))
    return ranked(post, idf(post, docs, group), stats, queries, group, k, k1, b)


def ranked(post: DataFrame, terms: DataFrame, stats: DataFrame, queries: DataFrame, group: list[str], k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """topk() from kept statistics: terms (group..., term, idf) and stats (group..., n_docs, avgdl).

    A group's documents and queries are dealt into blocks, of which the scores
    are products of term weights; only a block's k best of a query become
    rows. A query_id is of one group.
    """
    asked = queries.select(*group, "query_id", F.explode("tokens").alias("term")).groupBy(*group, "query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    # Written, so that its size is known: where it is small, no posting moves to meet it.
    terms = written(terms.join(asked.select(*group, "term").distinct(), [*group, "term"], "left_semi"), scratch(post.sparkSession, "terms"))
    sized = queries.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("_b_q"))
    stats = (stats.join(sized, group) if group else stats.crossJoin(F.broadcast(sized))).withColumn("_b_v", F.ceil(F.col("n_docs") / DOCS).cast("int"))
    if group:
        # Written like the terms: of few groups, all postings would meet in as few tasks.
        stats = written(stats, scratch(post.sparkSession, "groups"))
    known = lambda d: d.join(stats, group) if group else d.crossJoin(F.broadcast(stats))
    p = known(post.join(terms, [*group, "term"]))
    p = p.withColumn("part", F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = known(asked.groupBy(*group, "query_id").agg(F.collect_list(F.struct("term", "times")).alias("_of"))).select(*group, "query_id", F.col("_of.term").alias("terms"), F.col("_of.times").alias("times"), block("query_id", "_b_q").alias("_q"), each("_b_v").alias("_v"))
    right = p.select(*group, "doc", "term", "part", block("doc", "_b_v").alias("_v"), each("_b_q").alias("_q"))
    types = dict(left.dtypes) | dict(right.dtypes)
    schema = f"query_id {types['query_id']}, doc {types['doc']}, score double"
    kind, keys = to_arrow_schema(StructType.fromDDL(schema)), [*group, "_q", "_v"]

    def unit(left: pa.Table, right: pa.Table) -> pa.Table:
        return _block_best(left, right, k, kind) if left.num_rows and right.num_rows else kind.empty_table()

    ship(post.sparkSession)
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(unit, schema)
    # Equal scores keep the order of documents; sums of different order differ in the last digits.
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.asc("doc"))
    return best.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(f"rank <= {int(k)}")


def _block_best(left: pa.Table, right: pa.Table, k: int, kind: pa.Schema) -> pa.Table:
    """query_id, doc, score: the k best documents above 0 of each query (query_id, terms, times) by sums of times * part over postings (doc, term, part)."""
    docs = pc.unique(right.column("doc"))
    docs = docs.take(pc.sort_indices(docs, null_placement="at_start"))  # so equal scores go by place
    words = pc.unique(right.column("term"))
    doc = np.asarray(pc.index_in(right.column("doc"), docs))
    term = np.asarray(pc.index_in(right.column("term"), words))
    n_d, n_w, n_q = len(docs), len(words), left.num_rows
    # A posting a document and term; rows of a repeated id are summed.
    cell, at = np.unique(term.astype(np.int64) * n_d + doc, return_inverse=True)
    part = np.bincount(at, np.asarray(right.column("part"), float), len(cell))
    term, doc = cell // n_d, cell % n_d
    size = np.bincount(term, minlength=n_w)
    first = np.cumsum(size) - size
    lists = left.column("terms").combine_chunks()
    query = np.repeat(np.arange(n_q), np.asarray(pc.list_value_length(lists)))
    asked = pc.index_in(lists.flatten(), words)
    there = np.asarray(asked.is_valid())
    query, asked = query[there], np.asarray(asked.drop_null())
    times = np.asarray(left.column("times").combine_chunks().flatten(), float)[there]
    # Terms of many queries and documents are one product, the others are added posting by posting.
    share = np.bincount(asked, minlength=n_w) / n_q * size / n_d
    dense = np.argsort(-share, kind="stable")[:DENSE]
    dense = dense[share[dense] > 0.005]
    column = np.full(n_w, -1)
    column[dense] = np.arange(len(dense))
    d = np.zeros((len(dense), n_d))
    of = column[term]
    d[of[of >= 0], doc[of >= 0]] = part[of >= 0]
    out, step = [kind.empty_table()], max(1, CELLS // n_d)
    border = np.searchsorted(query, np.arange(0, n_q + step, step))
    for n, a in enumerate(range(0, n_q, step)):
        i, t, x = (c[border[n] : border[n + 1]] for c in (query, asked, times))
        i, rows = i - a, min(step, n_q - a)
        by = column[t]
        q = np.zeros((rows, len(dense)))
        q[i[by >= 0], by[by >= 0]] = x[by >= 0]
        s = q @ d
        i, t, x = i[by < 0], t[by < 0], x[by < 0]
        # Entries are taken in runs of so many postings.
        upto = np.cumsum(size[t])
        cut = np.searchsorted(upto, np.arange(0, (upto[-1] if len(upto) else 0) + CELLS, CELLS), side="right")
        for lo, hi in zip(cut, [*cut[1:], len(t)], strict=True):
            if hi > lo:
                n_p = size[t[lo:hi]]
                from_ = np.repeat(first[t[lo:hi]] - (np.cumsum(n_p) - n_p), n_p) + np.arange(n_p.sum())
                s += np.bincount(np.repeat(i[lo:hi], n_p) * n_d + doc[from_], np.repeat(x[lo:hi], n_p) * part[from_], rows * n_d).reshape(rows, n_d)
        head = s[:, : max(4 * k, 2048)]
        least = np.partition(head, head.shape[1] - k, axis=1)[:, head.shape[1] - k] if head.shape[1] > k else np.zeros(rows)
        i, j = np.nonzero((s > 0) & (s >= least[:, None] - 1e-8))
        got = s[i, j]
        order = np.lexsort((j, -np.round(got, 9), i))
        i, j, got = i[order], j[order], got[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append(pa.table({"query_id": left.column("query_id").take(pa.array(a + i[keep])), "doc": docs.take(pa.array(j[keep])), "score": pa.array(got[keep])}).cast(kind))
    return pa.concat_tables(out).combine_chunks()
