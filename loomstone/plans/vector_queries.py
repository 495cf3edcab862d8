"""Vector queries over the embeddings table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators.vector_search import L2, topk
from loomstone.sources.tables import table


def _sides(spark, sf_dir):
    """Every vector whose id 50 divides asks; all vectors answer."""
    e = table(spark, sf_dir, "embeddings")
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select("vec_id", F.col("embedding").alias("v"))


def vec_topk_cosine(spark, sf_dir):
    return topk(*_sides(spark, sf_dir), k=10).withColumn("score", F.round("score", 6))


def vec_topk_l2score(spark, sf_dir):
    return topk(*_sides(spark, sf_dir), k=10, score=L2).withColumn("score", F.round("score", 6))


def vec_topk_min_score(spark, sf_dir):
    return topk(*_sides(spark, sf_dir), k=10, min_score=0.3).withColumn("score", F.round("score", 6))


_TOPK = """
WITH s AS (
  SELECT a.vec_id AS query_id, b.vec_id, {score} AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10{more}"""
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_L2 = "1 - list_sum([(x[1]-x[2])*(x[1]-x[2]) for x in list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[])])"

QUERIES = {"vec_topk_cosine": vec_topk_cosine, "vec_topk_l2score": vec_topk_l2score, "vec_topk_min_score": vec_topk_min_score}
ORACLES = {
    "vec_topk_cosine": _TOPK.format(score=_COS, more=""),
    "vec_topk_l2score": _TOPK.format(score=_L2, more=""),
    "vec_topk_min_score": _TOPK.format(score=_COS, more=" AND score > 0.3"),
}
