"""A lexical index that is kept: postings, lengths and document frequencies in deltas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text as X
from loomstone.operators import lexical
from loomstone.sources.deltas import Deltas
from loomstone.sources.store import scratch, written


class LexicalIndex:
    """Documents (user_id, doc, text) under root, searchable by BM25 as if the index were built anew.

    Each change is one folder of deltas: a row of each new document with its
    length, its postings (in `parts` by term, so a search reads the parts of
    its terms), the keys of documents that are gone, and the change of each
    term's document frequency, so frequencies are sums and no posting is read
    for them. A null text is empty; a document without tokens is there, but
    counts in no statistic. Rows of equal doc are one, the first by user and text.
    """

    def __init__(self, spark: SparkSession, root: str, tokens: Callable[[Column], Column] = X.index_tokens, parts: int = 16):
        self.spark, self.tokens, self.parts = spark, tokens, parts
        self.deltas = Deltas(spark, root, "user_id string, doc long, term string, n long, dl long, part int", "doc", "part", ("doc", "posting"), {"term": "n"})

    def documents(self) -> DataFrame:
        """user_id, doc, dl."""
        return self.deltas.read("doc").select("user_id", "doc", "dl")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.parts)).cast("int").alias("part")

    def _postings(self, asked: DataFrame | None = None) -> DataFrame:
        """user_id, doc, dl, term, tf of all terms, or of those asked (term)."""
        of = None if asked is None else asked.select("term", self._part())
        return self.deltas.read("posting", of, ["part", "term"]).select("user_id", "doc", "dl", "term", F.col("n").alias("tf"))

    def _change(self, new: DataFrame | None, gone: DataFrame | None) -> None:
        at = scratch(self.spark, "index")
        rows, terms = {}, []
        if new is not None:
            one = new.groupBy("doc").agg(F.min(F.struct("user_id", F.coalesce("text", F.lit("")).alias("text"))).alias("x")).select("doc", "x.*")
            d = written(lexical.counted(one, self.tokens(F.col("text")), ["user_id"]), f"{at}/documents")
            post = d.select("user_id", "doc", "dl", F.inline("runs"))
            rows["doc"] = d.select("user_id", "doc", "dl", F.lit(0).alias("part"))
            rows["posting"] = post.select("user_id", "doc", "dl", "term", F.col("tf").alias("n"), self._part())
            terms.append(post.groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("n")))
        if gone is not None:
            gone = written(self.documents().join(gone.select("doc").distinct(), "doc", "left_semi").select("doc"), f"{at}/gone")
            lost = self._postings().join(gone, "doc", "left_semi")
            terms.append(lost.groupBy("user_id", "term").agg((-F.count(F.lit(1))).alias("n")))
        every = terms[0] if len(terms) == 1 else terms[0].unionByName(terms[1])
        rows["term"] = every.select("user_id", "term", "n", self._part())
        self.deltas.write(rows, None if gone is None else gone)

    def add(self, docs: DataFrame) -> None:
        """Takes documents that are not there yet; the others stay as they are."""
        self._change(docs.join(self.documents().select("doc"), "doc", "left_anti"), None)

    def put(self, docs: DataFrame) -> None:
        """Takes documents in place of those that are there."""
        self._change(docs, docs)

    def delete(self, docs: DataFrame) -> None:
        """Takes documents (doc) away."""
        self._change(None, docs)

    def delete_users(self, users: DataFrame) -> None:
        """Takes all documents of users (user_id) away."""
        self._change(None, self.documents().join(users.select("user_id").distinct(), "user_id", "left_semi"))

    def merge(self, every: bool = False) -> bool:
        return self.deltas.merge(every)

    def frequencies(self, group: list[str]) -> DataFrame:
        """group..., term, df from the kept sums; group is [] or ["user_id"]."""
        return self.deltas.read("term").groupBy(*group, "term").agg(F.sum("n").alias("df"))

    def statistics(self, group: list[str]) -> DataFrame:
        """group..., n_docs, avgdl of documents with tokens."""
        return self.documents().filter("dl > 0").groupBy(*group).agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))

    def search(self, queries: DataFrame, k: int, group: list[str] = (), k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """query_id, doc, rank, score for queries (group..., query_id, tokens): lexical.topk of what is there."""
        group = list(group)
        size = self.statistics(group)
        idf = lexical.idf_of(self.frequencies(group), size.select(*group, "n_docs"), group)
        post = self._postings(queries.select(F.explode("tokens").alias("term")))
        return lexical.ranked(post if group else post.drop("user_id"), idf, size, queries, group, k, k1, b)
