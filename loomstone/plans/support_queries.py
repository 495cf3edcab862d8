"""Queries over storage, rendering, parsing and reporting operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import text as X
from loomstone.operators import evaluation, lexical, retrieval, segments
from loomstone.operators.vector_search import topk
from loomstone.plans.memory_queries import _EP, _E, _M, _P, _answers, _episodes, _messages
from loomstone.plans.vector_queries import _sides
from loomstone.sources.tables import table


def relevant_statements(spark, sf_dir):
    """The first 3 of the 6 nearest facts whose score is at least 0.25."""
    q, v = _sides(spark, sf_dir)
    near = topk(q, v.select("vec_id", "v"), 6).filter(F.col("score") >= 0.25)
    w = Window.partitionBy("query_id").orderBy("rank")
    return near.withColumn("pos", F.row_number().over(w).cast("bigint")).filter("pos <= 3").select("query_id", "vec_id", "pos", F.round("score", 6).alias("score"))


def norlift_rank(spark, sf_dir):
    """z-scores of a query's similarities through a sigmoid, by their lift over the mean; an extension of plain search."""
    q, v = _sides(spark, sf_dir)
    return retrieval.noisy_lift(q, v, 10).select("query_id", F.col("item").alias("vec_id"), "rank", F.round("score", 6).alias("lift"))


def fact_batches(spark, sf_dir):
    """Messages of an owner in batches of 2."""
    return segments.batched(_messages(spark, sf_dir), 2).groupBy("owner", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def context_lines(spark, sf_dir):
    """'- [time] content' lines of the episodes of an owner, in order."""
    e = _episodes(spark, sf_dir)
    line = F.concat(F.lit("- ["), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("] "), "content")
    return e.groupBy("owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("episode", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def hydrate(spark, sf_dir):
    """Search results with the rows of their ids: at most 3 of each query, whether or not the row is there."""
    q, v = _sides(spark, sf_dir)
    r = topk(q, v, 5).filter("rank <= 3")
    return r.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "n_chars"), "vec_id", "left").select("query_id", "vec_id", "rank", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def attribute_sanitise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(X.attribute(F.col("html"), 500), 256).alias("attr_sha256"))


def json_salvage(spark, sf_dir):
    """The object in answers made of event properties: bare, fenced, with words around, and broken."""
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("Here: "), "props", F.lit(" ok"))).otherwise(F.concat(F.lit("x"), F.substring(F.col("props"), 1, 3)))
    return e.select("event_id", F.get_json_object(X.json_object(said), "$.k").cast("bigint").alias("k"))


def spoken_times(spark, sf_dir):
    """Event times written as in dialogues, read back to the minute."""
    e = table(spark, sf_dir, "events")
    said = F.concat(F.lower(F.date_format("ts", "h:mm a")), F.lit(" on "), F.date_format("ts", "d MMMM, yyyy"))
    return e.select("event_id", F.date_format(X.dialogue_time(said), "yyyy-MM-dd HH:mm").alias("at"))


def token_stats(spark, sf_dir):
    """Sums and means of token estimates over all questions."""
    return evaluation.token_totals(table(spark, sf_dir, "benchmark"), X.token_estimate(F.col("text")))


def category_report(spark, sf_dir):
    """Means by language and over all."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return evaluation.by_category(d, "lang", ["quality", "toxic"])


def index_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("source", "user_id")
    return lexical.statistics(d, X.index_tokens(F.col("text")), ["user_id"])


def rouge_n(spark, sf_dir):
    """ROUGE-1 recall of each turn against the one before it."""
    return evaluation.scored(_answers(spark, sf_dir)).select("conv_id", "turn", F.round("rouge1", 6).alias("rouge1"))


_S = "s AS (SELECT a.id AS query_id, b.id AS vec_id, {p} AS s FROM e a JOIN e b ON a.id % 50 = 0)".format(p=_P)
_R = f"WITH e AS ({_E}), {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s)"
_IT = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda t: length(t) > 1)"
_TOK = "list_filter(regexp_split_to_array(trim(translate(lower({c}), '.,!?', '    ')), '\\s+'), lambda t: t <> '')"

QUERIES = {f.__name__: f for f in (relevant_statements, norlift_rank, fact_batches, context_lines, hydrate, attribute_sanitise, json_salvage, spoken_times, token_stats, category_report, index_stats, rouge_n)}
ORACLES = {
    "relevant_statements": f"{_R}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM r WHERE rank <= 6 AND s >= 0.25) SELECT query_id, vec_id, CAST(pos AS BIGINT) AS pos, round(s, 6) AS score FROM k WHERE pos <= 3",
    "norlift_rank": f"""WITH e AS ({_E}), {_S}, m AS (SELECT query_id, avg(s) AS m, stddev_pop(s) AS d FROM s GROUP BY query_id), p AS (SELECT s.*, 1 / (1 + exp(-(s - m) / (d + 1e-6::DOUBLE))) AS p FROM s JOIN m ON s.query_id = m.query_id),
b AS (SELECT query_id, avg(p) AS base FROM p GROUP BY query_id), l AS (SELECT p.query_id, vec_id, p / (base + 1e-6::DOUBLE) AS lift FROM p JOIN b ON p.query_id = b.query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(lift, 9) DESC, vec_id) AS rank FROM l)
SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank, round(lift, 6) AS lift FROM r WHERE rank <= 10""",
    "fact_batches": f"WITH {_M}, b AS (SELECT owner, seq, (row_number() OVER (PARTITION BY owner ORDER BY seq) - 1) // 2 AS batch FROM m) SELECT owner, CAST(batch AS BIGINT) AS batch, count(*) AS n, min(seq) AS first_seq FROM b GROUP BY owner, batch",
    "context_lines": f"WITH {_EP}, j AS (SELECT te.owner, te.episode, '- [' || strftime(t0, '%Y-%m-%d %H:%M') || '] ' || content AS line FROM te JOIN ep ON te.owner = ep.owner AND te.episode = ep.episode) SELECT owner, string_agg(line, chr(10) ORDER BY episode) AS text FROM j GROUP BY owner",
    "hydrate": f"{_R} SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank, coalesce(lang, 'none') AS lang, coalesce(n_chars, 0) AS n_chars FROM r LEFT JOIN documents d ON r.vec_id = d.doc_id WHERE rank <= 3",
    "attribute_sanitise": "SELECT page_id, sha256(CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || '…' ELSE t END) AS attr_sha256 FROM (SELECT page_id, trim(html) AS t FROM pages)",
    "json_salvage": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events",
    "spoken_times": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS at FROM events",
    "token_stats": "SELECT count(*) AS num_questions, CAST(sum(n) AS BIGINT) AS sum_tokens, round(avg(n), 6) AS avg_tokens FROM (SELECT CAST(trunc(c / 1.5::DOUBLE + (length(text) - c) / 4.0::DOUBLE) AS INT) AS n FROM (SELECT text, length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) AS c FROM benchmark))",
    "category_report": "SELECT lang, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())",
    "index_stats": f"SELECT source AS user_id, count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS tokens, round(avg(len(t)), 6) AS avg_tokens FROM (SELECT source, {_IT} AS t FROM documents) GROUP BY source",
    "rouge_n": f"WITH p AS (SELECT a.conv_id, a.turn, {_TOK.format(c='a.text')} AS p, {_TOK.format(c='b.text')} AS g FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1) SELECT conv_id, turn, round(CASE WHEN len(g) = 0 THEN 0.0::DOUBLE ELSE coalesce(list_sum([least(len(list_filter(p, lambda y: y = t)), len(list_filter(g, lambda y: y = t))) for t in list_distinct(g)]), 0)::DOUBLE / len(g) END, 6) AS rouge1 FROM p",
}
