"""Text queries over documents, benchmark and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import text as X
from loomstone.operators import fusion, lexical
from loomstone.plans.vector_queries import _COS, vec_topk_cosine
from loomstone.sources.store import scratch, written
from loomstone.sources.tables import table


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("user_id"), F.col("doc_id").alias("doc"), "text")


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), X.index_tokens(F.col("text")).alias("tokens"))


def tokenize_index(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc", F.size(X.index_tokens(F.col("text"))).cast("long").alias("n_tokens"), F.sha2(F.array_join(X.index_tokens(F.col("text")), " "), 256).alias("tokens_sha256"))


def tokenize_raw(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc", F.size(X.raw_tokens(F.col("text"))).cast("long").alias("n_tokens"), F.sha2(F.array_join(X.raw_tokens(F.col("text")), " "), 256).alias("tokens_sha256"))


def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc", X.token_estimate(F.col("text")).alias("n_tokens"))


def _post(spark, sf_dir, group, tokens=X.index_tokens):
    """The postings, written: lengths, document frequencies and scores all read them, and texts are tokenised once."""
    return written(lexical.postings(_docs(spark, sf_dir), tokens(F.col("text")), group), scratch(spark, "postings"))


def bm25_postings(spark, sf_dir):
    return lexical.postings(_docs(spark, sf_dir), X.index_tokens(F.col("text")), []).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def bm25_idf(spark, sf_dir):
    post = _post(spark, sf_dir, ["user_id"])
    return _round(lexical.idf(post, post.select("user_id", "doc", "dl").distinct(), ["user_id"]), "idf")


def bm25_topk_global(spark, sf_dir):
    return _round(lexical.topk(_post(spark, sf_dir, []), _asked(spark, sf_dir), [], 10), "score")


def bm25_topk_per_user(spark, sf_dir):
    users = _docs(spark, sf_dir).select("user_id").distinct()
    # Each item asks the user whose number in order is its own, around again.
    w = users.withColumn("u", F.row_number().over(Window.orderBy("user_id")) - 1)
    n = w.agg(F.max("u").alias("most"))
    asked = _asked(spark, sf_dir).crossJoin(F.broadcast(n)).withColumn("u", (F.col("query_id") % (F.col("most") + 1)).cast("int")).join(w, "u").select("user_id", "query_id", "tokens")
    return _round(lexical.topk(_post(spark, sf_dir, ["user_id"]), asked, ["user_id"], 5), "score")


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def bm25_raw_messages(spark, sf_dir):
    d = _messages(spark, sf_dir).select((F.col("owner") * 1000 + F.col("seq")).alias("doc"), "content")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), X.raw_tokens(F.col("text")).alias("tokens"))
    return _round(lexical.topk(lexical.postings(d, X.raw_tokens(F.col("content")), []), asked, [], 10), "score")


def bm25_episode_blocks(spark, sf_dir):
    blocks = _messages(spark, sf_dir).groupBy(F.col("owner").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda m: m["content"]), " ").alias("content"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), X.raw_tokens(F.col("text")).alias("tokens"))
    return _round(lexical.topk(lexical.postings(blocks, X.raw_tokens(F.col("content")), []), asked, [], 10), "score")


def hybrid_rrf(spark, sf_dir):
    """BM25 over index tokens and over raw tokens, fused."""
    a = lexical.topk(_post(spark, sf_dir, []), _asked(spark, sf_dir), [], 20).select("query_id", F.col("doc").alias("item"), "rank")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), X.raw_tokens(F.col("text")).alias("tokens"))
    b = lexical.topk(_post(spark, sf_dir, [], X.raw_tokens), asked, [], 20).select("query_id", F.col("doc").alias("item"), "rank")
    return _round(fusion.reciprocal_rank([a, b], 10), "fused_score")


def unified_merge(spark, sf_dir):
    """Vector results by two scores, merged best first."""
    a = vec_topk_cosine(spark, sf_dir).select("query_id", F.lit("cosine").alias("kind"), F.col("vec_id").alias("item"), "score")
    b = a.select("query_id", F.lit("l2").alias("kind"), "item", F.round(2 * F.col("score") - 1, 6).alias("score"))
    return fusion.merge_by_score([a, b], 15)


def substring_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("title"), F.col("text").alias("content"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return fusion.substring_search(docs, asked, 10)


def statement_exact_dedup(spark, sf_dir):
    """Documents whose statement another one has: the newest (largest id) such."""
    d = _docs(spark, sf_dir).withColumn("key", X.statement_key(F.col("text")))
    newest = d.groupBy("user_id", "key").agg(F.max("doc").alias("duplicate_of"))
    return d.join(newest, ["user_id", "key"]).filter("doc <> duplicate_of").select("doc", "duplicate_of")


def user_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("user_id")).agg(F.count(F.lit(1)).alias("items"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("avg_chars"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count_distinct("lang").alias("langs"))


_IT = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda t: length(t) > 1)"
_RT = "list_filter(list_transform(regexp_split_to_array(lower(coalesce({c}, '')), '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda t: length(t) > 1)"


def _bm25(docs, asked, k, group=False, select="query_id, doc, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score"):
    g = "user_id, " if group else ""
    on = lambda *c: " AND ".join(f"x.{i} = y.{i}" for i in ([*c, "user_id"] if group else c)) or "TRUE"
    return f"""
d AS ({docs}), dd AS (SELECT {g}doc, len(tokens) AS dl, tokens FROM d WHERE len(tokens) > 0),
p AS (SELECT {g}doc, dl, term, count(*) AS tf FROM (SELECT {g}doc, dl, unnest(tokens) AS term FROM dd) GROUP BY {g}doc, dl, term),
n AS (SELECT {g}count(*) AS n, avg(dl) AS avgdl FROM dd {'GROUP BY user_id' if group else ''}),
f AS (SELECT {g}term, count(*) AS df FROM p GROUP BY {g}term),
r AS (SELECT x.*, n, avgdl, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM f x JOIN n y ON {on()}),
m AS (SELECT {g}avg(raw) AS mean FROM r {'GROUP BY user_id' if group else ''}),
i AS (SELECT x.*, CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean ELSE raw END AS idf FROM r x JOIN m y ON {on()}),
q AS ({asked}), qt AS (SELECT {g}query_id, unnest(tokens) AS term FROM q),
s AS (SELECT query_id, doc, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM (SELECT x.{'user_id, x.' if group else ''}doc, x.tf, x.dl, x.term, y.idf, y.avgdl FROM p x JOIN i y ON {on('term')}) x JOIN qt y ON {on('term')} GROUP BY query_id, doc),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM s)""", f"SELECT {select} FROM k WHERE rank <= {k} AND score > 0"


_D = f"SELECT source AS user_id, doc_id AS doc, {_IT} AS tokens FROM documents"
_Q = f"SELECT item_id AS query_id, {_IT} AS tokens FROM benchmark"
_QR = f"SELECT item_id AS query_id, {_RT.format(c='text')} AS tokens FROM benchmark"
_DR = f"SELECT doc_id AS doc, {_RT.format(c='text')} AS tokens FROM documents"
_U = f"SELECT user_id, b.item_id AS query_id, tokens FROM (SELECT item_id, {_IT} AS tokens FROM benchmark) b JOIN (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS u, count(*) OVER () AS n FROM (SELECT DISTINCT source AS user_id FROM documents)) w ON b.item_id % n = u"


def _sql(docs, asked, k, group=False):
    a, b = _bm25(docs, asked, k, group)
    return f"WITH {a.strip()} {b}"


_TOK = "SELECT doc_id AS doc, CAST(len(t) AS BIGINT) AS n_tokens, sha256(coalesce(array_to_string(t, ' '), '')) AS tokens_sha256 FROM (SELECT doc_id, {t} AS t FROM documents)"
_KEY = r"lower(trim(CASE WHEN starts_with(text, 'Time:') THEN regexp_replace(text, '^(?:[^ ]* ){3}', '') ELSE text END))"

QUERIES = {
    f.__name__: f
    for f in (tokenize_index, tokenize_raw, token_estimate, bm25_postings, bm25_idf, bm25_topk_global, bm25_topk_per_user, bm25_raw_messages, bm25_episode_blocks, hybrid_rrf, unified_merge, substring_search, statement_exact_dedup, user_stats)
}
_A = _bm25(_D.replace("source AS user_id, ", ""), _Q, 20)
_B = _bm25(_DR, _QR, 20)
ORACLES = {
    "tokenize_index": _TOK.format(t=_IT),
    "tokenize_raw": _TOK.format(t=_RT.format(c="text")),
    "token_estimate": "SELECT doc_id AS doc, CAST(trunc(c / 1.5::DOUBLE + (length(text) - c) / 4.0::DOUBLE) AS INT) AS n_tokens FROM (SELECT doc_id, coalesce(text, '') AS text, length(regexp_replace(coalesce(text, ''), '[^\\x{4e00}-\\x{9fff}]', '', 'g')) AS c FROM documents)",
    "bm25_postings": f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(tokens) AS term FROM ({_D})) GROUP BY doc, term) GROUP BY term",
    "bm25_idf": f"WITH {_bm25(_D, _U, 5, True)[0].strip()} SELECT user_id, term, df, round(idf, 6) AS idf FROM i",
    "bm25_topk_global": _sql(_D.replace("source AS user_id, ", ""), _Q, 10),
    "bm25_topk_per_user": _sql(_D, _U, 5, True),
    "bm25_raw_messages": _sql(f"SELECT conv_id * 1000 + turn AS doc, {_RT.format(c='text')} AS tokens FROM conversations", _QR, 10),
    "bm25_episode_blocks": _sql(f"SELECT doc, {_RT.format(c='text')} AS tokens FROM (SELECT conv_id AS doc, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)", _QR, 10),
    "hybrid_rrf": f"""WITH a AS (SELECT * FROM (WITH {_A[0].strip()} {_A[1]})), b AS (SELECT * FROM (WITH {_B[0].strip()} {_B[1]})),
e AS (SELECT query_id, doc, rank, 0 AS l FROM a UNION ALL SELECT query_id, doc, rank, 1 AS l FROM b),
f AS (SELECT query_id, doc AS item, sum(1.0::DOUBLE / (60 + rank)) AS fused_score, min(l * 1000 + rank) AS seen FROM e GROUP BY query_id, doc),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused_score, 12) DESC, seen, item) AS rank FROM f)
SELECT query_id, item, CAST(rank AS BIGINT) AS rank, round(fused_score, 6) AS fused_score FROM o WHERE rank <= 10""",
    "unified_merge": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0),
t AS (SELECT query_id, item, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS r FROM s) WHERE r <= 10),
e AS (SELECT query_id, 'cosine' AS kind, item, score FROM t UNION ALL SELECT query_id, 'l2', item, round(2 * score - 1, 6) FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, item) AS rank FROM e)
SELECT query_id, kind, item, score, CAST(rank AS BIGINT) AS rank FROM o WHERE rank <= 15""",
    "substring_search": """WITH h AS (SELECT item_id AS query_id, doc_id AS doc, CASE WHEN contains(lower(d.text), lower(b.text)) THEN 1.0::DOUBLE WHEN contains(lower(source), lower(b.text)) THEN 0.5::DOUBLE END AS score FROM documents d, benchmark b),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc) AS rank FROM h WHERE score IS NOT NULL)
SELECT query_id, doc, CAST(rank AS BIGINT) AS rank, score FROM o WHERE rank <= 10""",
    "statement_exact_dedup": f"SELECT doc, duplicate_of FROM (SELECT doc_id AS doc, max(doc_id) OVER (PARTITION BY source, {_KEY}) AS duplicate_of FROM documents) WHERE doc <> duplicate_of",
    "user_stats": "SELECT source AS user_id, count(*) AS items, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 6) AS avg_chars, min(doc_id) AS first_id, max(doc_id) AS last_id, count(DISTINCT lang) AS langs FROM documents GROUP BY source",
}
