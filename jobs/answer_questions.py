"""Answers a table of questions from a corpus of texts, and reports which sources the answers come from.

    python jobs/answer_questions.py --documents PATH --questions PATH --out PATH [--config FILE]

Under --out it writes, each time in place of what was there:

* index: the corpus's postings under two tokenisers, partitioned by shard
  (hash of the document); all rankings are made from it.
* hits, partitioned by source: for each question the k documents that the
  two rankings put first together, and in each the statement that shares most
  with the question.
* answers, partitioned by shard (question modulo `shards`): a context of the
  best statements, cut to so many tokens, the first of them as the answer,
  and its scores against the question.
* report: for each source its hits, questions, the mean of 1 / rank and of F1.

The same input gives the same rows. Paths may be of any file system that
Spark knows. Questions are a stated set; work and shuffles grow with the
corpus only in the postings.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
import uuid
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions import providers
from loomstone.functions import text as X
from loomstone.operators import evaluation, fusion, lexical, retrieval
from loomstone.sources.store import scratch, written

log = logging.getLogger("loomstone.jobs.answer_questions")
CONFIG = Path(__file__).with_suffix(".json")
INDEX = "kind string, doc long, dl int, term string, tf long, shard int"
HITS = "query_id long, rank long, doc long, fused_score double, statement string, f1 double, source string"
ANSWERS = "query_id long, doc long, answer string, context string, context_tokens int, f1 double, bleu1 double, shard int"
REPORT = "source string, hits long, questions long, mean_reciprocal_rank double, mean_f1 double"


def kinds() -> Column:
    """kind, tokens of a text by both tokenisers."""
    return F.array(*(F.struct(F.lit(n).alias("kind"), f(F.col("text")).alias("tokens")) for n, f in (("word", X.index_tokens), ("raw", X.raw_tokens))))


def build_index(docs: DataFrame, path: str, config: dict) -> DataFrame:
    post = lexical.postings(docs.select("doc", "text"), F.col("tokens"), ["kind"], more=kinds())
    shard = F.pmod(F.xxhash64("doc"), F.lit(config["shards"])).cast("int")
    post.select("kind", "doc", "dl", "term", "tf", shard.alias("shard")).write.mode("overwrite").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def ranked(post: DataFrame, questions: DataFrame, config: dict) -> DataFrame:
    """query_id, doc, rank, fused_score: the rankings of both tokenisers, fused."""
    # A question is one of each kind, which has an index of its own.
    asked = questions.select("query_id", F.inline(kinds())).select("kind", F.struct("kind", "query_id").alias("query_id"), "tokens")
    best = lexical.topk(post, asked, ["kind"], config["pool"]).select("query_id.kind", "query_id.query_id", F.col("doc").alias("item"), "rank")
    # Written, as each of the lists would rank all documents anew; and the result, as evidence reads it several times.
    at = scratch(post.sparkSession, "ranked")
    best = written(best, f"{at}/best")
    lists = [best.filter(F.col("kind") == kind).drop("kind") for kind in ("word", "raw")]
    return written(fusion.reciprocal_rank(lists, config["k"]).withColumnRenamed("item", "doc"), f"{at}/fused")


def with_evidence(hits: DataFrame, docs: DataFrame, questions: DataFrame) -> DataFrame:
    """hits with the statement of each document that shares most with the question, and its F1; the first one of equal."""
    # Only documents that a question hit are cut into statements.
    texts = docs.join(hits.select("doc").distinct(), "doc", "left_semi")
    said = providers.statements(texts.select(F.col("doc").alias("episode_id"), F.col("text").alias("content"))).select(F.col("episode_id").alias("doc"), "pos", F.col("content").alias("statement"))
    f1 = F.round(evaluation.token_f1(F.col("statement"), F.col("question")), 6)
    pairs = hits.select("query_id", "doc").join(questions.select("query_id", F.col("text").alias("question")), "query_id").join(said, "doc").withColumn("f1", f1)
    best = pairs.groupBy("query_id", "doc").agg(F.min_by(F.struct("statement", "f1"), F.struct(-F.col("f1"), "pos")).alias("e"))
    return hits.join(best, ["query_id", "doc"], "left").join(docs.select("doc", "source"), "doc").select("query_id", "rank", "doc", "fused_score", "e.statement", "e.f1", "source")


def answered(hits: DataFrame, questions: DataFrame, config: dict) -> DataFrame:
    """query_id, doc, answer, context, context_tokens, f1, bleu1 of questions with evidence."""
    order = Window.partitionBy("query_id").orderBy(F.desc("f1"), "rank")
    best = hits.filter("statement is not null").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= config["evidence"])
    lines = retrieval.context(best.select("query_id", F.col("place").alias("rank"), F.lit(None).cast("string").alias("ts"), F.col("statement").alias("content"), F.array().cast("array<string>").alias("messages")))
    context = lines.select("query_id", retrieval.cut_to_tokens(F.col("text"), config["context_tokens"]).alias("context"))
    first = best.filter("place = 1").select("query_id", "doc", F.col("statement").alias("predicted")).join(questions.select("query_id", F.col("text").alias("gold")), "query_id")
    scored = evaluation.scored(first).join(context, "query_id")
    return scored.select("query_id", "doc", F.col("predicted").alias("answer"), "context", X.token_estimate(F.col("context")).alias("context_tokens"), F.round("f1", 6).alias("f1"), F.round("bleu1", 6).alias("bleu1"))


def reported(hits: DataFrame) -> DataFrame:
    return hits.groupBy("source").agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct("query_id").alias("questions"), F.round(F.avg(1.0 / F.col("rank")), 6).alias("mean_reciprocal_rank"), F.round(F.avg(F.coalesce("f1", F.lit(0.0))), 6).alias("mean_f1")
    )


def answer(spark: SparkSession, documents: str, questions: str, out: str, config: dict) -> dict:
    """Makes all tables from both inputs; what was read and written. Rows without a doc_id or item_id can't be named and are left out."""
    out = out.rstrip("/")
    docs = spark.read.parquet(documents).filter("doc_id is not null").select(F.col("doc_id").alias("doc"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    asked = spark.read.parquet(questions).filter("item_id is not null").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))
    post = build_index(docs, f"{out}/index", config)
    with_evidence(ranked(post, asked, config), docs, asked).write.mode("overwrite").partitionBy("source").parquet(f"{out}/hits")
    hits = spark.read.schema(HITS).parquet(f"{out}/hits").withColumn("source", F.coalesce("source", F.lit("")))
    shard = F.pmod("query_id", F.lit(config["shards"])).cast("int")
    answered(hits, asked, config).withColumn("shard", shard).write.mode("overwrite").partitionBy("shard").parquet(f"{out}/answers")
    reported(hits).coalesce(1).write.mode("overwrite").parquet(f"{out}/report")
    n = lambda path, schema: spark.read.schema(schema).parquet(f"{out}/{path}").count()
    done = {"documents_read": docs.count(), "questions_read": asked.count(), "postings": post.count(), "hits": n("hits", HITS), "answers": n("answers", ANSWERS), "sources": n("report", REPORT)}
    log.info("read %s and %s, wrote %s: %s", documents, questions, out, json.dumps(done))
    return done


def output(spark: SparkSession, out: str) -> DataFrame:
    """part ("hit", "answer" or "source"), query_id, rank, doc, source, text, and three figures of all that was written but the index."""
    read = lambda path, schema: spark.read.schema(schema).parquet(f"{out}/{path}")
    null = lambda t: F.lit(None).cast(t)
    parts = [
        read("hits", HITS).select(F.lit("hit").alias("part"), "query_id", "rank", "doc", F.coalesce("source", F.lit("")).alias("source"), F.col("statement").alias("text"), F.round("fused_score", 6).alias("a"), F.col("f1").alias("b"), null("long").alias("n")),
        read("answers", ANSWERS).select(F.lit("answer"), "query_id", null("long"), "doc", null("string"), F.concat_ws("\n\n", "answer", "context"), "f1", "bleu1", F.col("context_tokens").cast("long")),
        read("report", REPORT).select(F.lit("source"), null("long"), F.col("questions"), null("long"), "source", null("string"), "mean_reciprocal_rank", "mean_f1", "hits"),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def job2_answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job on all documents and all benchmark items, twice into the same folder; its tables after the second run."""
    root, config = scratch(spark, f"job2-{uuid.uuid4().hex}"), json.loads(CONFIG.read_text())
    for _ in range(2):
        answer(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{root}/out", config)
    return output(spark, f"{root}/out")


_WORD = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda t: length(t) > 1)"
_RAW = "list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g')), lambda t: length(t) > 1)"
_SIMPLE = "list_filter(regexp_split_to_array(trim(translate(lower({c}), '.,!?', '    ')), '\\s+'), lambda t: t <> '')"
_EST = "CAST(trunc((length({c}) - c) / 4.0::DOUBLE + c / 1.5::DOUBLE) AS BIGINT)"
SQL = f"""WITH d AS (SELECT doc_id AS doc, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
qs AS (SELECT item_id AS query_id, coalesce(text, '') AS text FROM benchmark WHERE item_id IS NOT NULL),
t AS (SELECT 0 AS kind, doc, {_WORD} AS tokens FROM d UNION ALL SELECT 1, doc, {_RAW} FROM d),
p AS (SELECT kind, doc, dl, term, count(*) AS tf FROM (SELECT kind, doc, len(tokens) AS dl, unnest(tokens) AS term FROM t) GROUP BY ALL),
n AS (SELECT kind, count(*) AS n, avg(len(tokens)) AS avgdl FROM t WHERE len(tokens) > 0 GROUP BY kind),
r AS (SELECT kind, term, n, avgdl, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT kind, term, count(*) AS df FROM p GROUP BY kind, term) JOIN n USING (kind)),
i AS (SELECT r.*, CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean ELSE raw END AS idf FROM r JOIN (SELECT kind, avg(raw) AS mean FROM r GROUP BY kind) USING (kind)),
q AS (SELECT 0 AS kind, query_id, unnest({_WORD}) AS term FROM qs UNION ALL SELECT 1, query_id, unnest({_RAW}) FROM qs),
s AS (SELECT kind, query_id, doc, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM q JOIN p USING (kind, term) JOIN i USING (kind, term) GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM s) WHERE rank <= 20 AND score > 0),
f AS (SELECT query_id, doc, sum(1.0::DOUBLE / (60 + rank)) AS fused_score, min(kind * 1000 + rank) AS seen FROM k GROUP BY query_id, doc),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused_score, 12) DESC, seen, doc) AS rank FROM f) WHERE rank <= 10),
y AS (SELECT doc, generate_subscripts(x, 1) AS pos, trim(unnest(x)) AS statement FROM (SELECT doc, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM d WHERE doc IN (SELECT doc FROM h))),
z AS (SELECT h.query_id, doc, pos, statement, list_distinct({_SIMPLE.format(c='statement')}) AS a, list_distinct({_SIMPLE.format(c='qs.text')}) AS b FROM h JOIN y USING (doc) JOIN qs ON qs.query_id = h.query_id WHERE statement <> ''),
w AS (SELECT *, CASE WHEN len(list_intersect(a, b)) = 0 THEN 0.0::DOUBLE ELSE round(2 * (len(list_intersect(a, b)) / len(a)::DOUBLE) * (len(list_intersect(a, b)) / len(b)::DOUBLE) / (len(list_intersect(a, b)) / len(a)::DOUBLE + len(list_intersect(a, b)) / len(b)::DOUBLE), 6) END AS f1 FROM z),
e AS (SELECT query_id, doc, statement, f1 FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY f1 DESC, pos) AS r FROM w) WHERE r = 1),
hits AS (SELECT h.query_id, rank, h.doc, fused_score, statement, f1, source FROM h JOIN d ON d.doc = h.doc LEFT JOIN e ON e.query_id = h.query_id AND e.doc = h.doc),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f1 DESC, rank) AS place FROM hits WHERE statement IS NOT NULL) WHERE place <= 3),
c1 AS (SELECT query_id, string_agg('- ' || statement, chr(10) ORDER BY place) AS text FROM b GROUP BY query_id),
c2 AS (SELECT query_id, text, {_EST.format(c='text')} AS est FROM (SELECT *, length(regexp_replace(text, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS c FROM c1)),
c3 AS (SELECT query_id, CASE WHEN est <= 512 THEN text ELSE text[1:greatest(1, CAST(floor(length(text) * 512 / greatest(est, 1)::DOUBLE) AS INT))] END AS context FROM c2),
c4 AS (SELECT query_id, context, {_EST.format(c='context')} AS context_tokens FROM (SELECT *, length(regexp_replace(context, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS c FROM c3)),
g AS (SELECT b.*, {_SIMPLE.format(c='b.statement')} AS x, {_SIMPLE.format(c='qs.text')} AS y FROM b JOIN qs USING (query_id) WHERE place = 1),
g2 AS (SELECT *, CAST(coalesce(list_sum(list_transform(list_distinct(x), lambda t: least(len(list_filter(x, lambda u: u = t)), len(list_filter(y, lambda u: u = t))))), 0) AS DOUBLE) AS m FROM g)
SELECT 'hit' AS part, query_id, rank, doc, source, statement AS text, round(fused_score, 6) AS a, f1 AS b, NULL::BIGINT AS n FROM hits
UNION ALL SELECT 'answer', query_id, NULL, doc, NULL, statement || chr(10) || chr(10) || context, f1, CASE WHEN m = 0 THEN 0 ELSE round(m / len(x) * CASE WHEN len(x) > len(y) THEN 1.0::DOUBLE ELSE exp(1 - len(y)::DOUBLE / len(x)) END, 6) END, context_tokens FROM g2 JOIN c4 USING (query_id)
UNION ALL SELECT 'source', NULL, count(DISTINCT query_id), NULL, source, NULL, round(avg(1.0::DOUBLE / rank), 6), round(avg(coalesce(f1, 0)), 6), count(*) FROM hits GROUP BY source"""


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "questions", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("answer_questions").getOrCreate()
    try:
        answer(spark, args.documents, args.questions, args.out, json.loads(Path(args.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
