"""Queries over the language model, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import text as X
from loomstone.operators import adaptive_search as A
from loomstone.operators import answer_similarity as similarity
from loomstone.operators import language_model as LM
from loomstone.operators import lexical, prediction
from loomstone.plans.lexical_queries import _D, _IT, _Q, _asked, _bm25, _docs, _post, _round
from loomstone.sources.store import scratch, written
from loomstone.sources.tables import table

def _words():
    return X.index_tokens(F.col("text"))


def _said(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


def lm_counts(spark, sf_dir):
    """The model of all conversations: distinct n-grams and their sum by length, and the most frequent history's."""
    m = LM.train(_said(spark, sf_dir), _words())
    return m.groupBy("n").agg(F.count(F.lit(1)).alias("grams"), F.sum("times").alias("tokens"), F.count_distinct("history").alias("histories"), F.max("of").alias("largest"))


def lm_uncertainty(spark, sf_dir):
    """How uncertain each message is by the model of all, given its conversation's message before."""
    d = _said(spark, sf_dir).withColumn("query_id", F.col("conv_id") * 1000 + F.col("turn"))
    model = written(LM.train(d, _words()), scratch(spark, "model"))
    words = LM.token_probabilities(d, _words(), model)
    before = d.select((F.col("query_id") + 1).alias("query_id"), F.lit(0).alias("context"), "text")
    return _round(LM.uncertainty(words, before, _words()).select("query_id", "nats"), "nats")


def gain_gate(spark, sf_dir):
    """For each benchmark item its two best documents as context; the next eight are probed, and the gate takes those after which it is less uncertain."""
    root, docs = scratch(spark, "gains"), _docs(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    # Of the model only what the items ask is made.
    model = written(LM.train(docs, _words(), asked=written(LM.grams(asked, _words()), f"{root}/grams")), f"{root}/model")
    best = written(lexical.topk(_post(spark, sf_dir, []), _asked(spark, sf_dir), [], 10).select("query_id", "doc", "rank"), f"{root}/best")
    texts = best.join(docs.select("doc", "text"), "doc")
    base = texts.filter("rank <= 2").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("text"))
    probes = texts.filter("rank > 2").select("query_id", F.col("doc").alias("episode"), (F.col("rank") - 2).alias("rank"), "text")
    words = written(LM.token_probabilities(asked, _words(), model), f"{root}/words")
    gains = written(LM.information_gain(words, base, probes, _words()).withColumn("ig", F.round("ig", 6)), f"{root}/gains")
    return A.gate(gains, most=4, stop=-0.02, choose=-0.03, expand=0.0).join(gains.select("query_id", "episode", "ig"), ["query_id", "episode"])


def predicted_facts(spark, sf_dir):
    """Messages from the fourth turn on as episodes, the others as facts, with those of even turns said before in lower case: what the two facts nearest by BM25, else the newest, did not let expect."""
    m = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).cast("string").alias("user_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn", "text")
    facts = m.filter("turn < 4").select("user_id", F.col("id").alias("fact"), F.col("text").alias("content"), F.col("id").alias("created_at"))
    facts = facts.unionByName(m.filter("turn >= 4 and turn % 2 = 0").select("user_id", (-F.col("id")).alias("fact"), F.lower("text").alias("content"), (-F.col("id")).alias("created_at"))).filter("user_id <> '0'")
    episodes = m.filter("turn >= 4").select("user_id", F.col("id").alias("episode_id"), F.lit("talk").alias("title"), F.col("text").alias("said"), F.col("id").alias("ts"))
    post = written(lexical.postings(facts.select("user_id", F.col("fact").alias("doc"), F.col("content").alias("text")), _words(), ["user_id"]), scratch(spark, "facts"))
    asked = episodes.select("user_id", F.col("episode_id").alias("query_id"), X.index_tokens(F.col("said")).alias("tokens"))
    near = lexical.topk(post, asked, ["user_id"], 4).join(asked.select("query_id", "user_id"), "query_id").select("query_id", "user_id", F.col("doc").alias("fact"), "rank", "score")
    out = prediction.learned(episodes, facts, near, most=2)
    return out.select("user_id", "episode_id", F.col("pos").cast("long").alias("pos"), "statement", "cold_start", "confidence")


def answer_alignment(spark, sf_dir):
    """Each message as an answer to the one before: tokens aligned by their vectors, vectors of both texts, and the common subsequence of stems."""
    d = _said(spark, sf_dir)
    before = d.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold"))
    pairs = d.withColumnRenamed("text", "predicted").join(before, ["conv_id", "turn"])
    out = similarity.stemmed_rouge(similarity.aligned(pairs))
    return _round(out.select("conv_id", "turn", "precision", "recall", "alignment", "similarity", "rouge1", "rouge2", "rougel"), "precision", "recall", "alignment", "similarity", "rouge1", "rouge2", "rougel")


def _model(of):
    """SQL of the model of `of` (text) as CTEs ending in m (n, history, word, times, of) and mt (total)."""
    return f"""t0 AS (SELECT row_number() OVER () AS id, {_IT} AS t FROM {of}), t1 AS (SELECT id, unnest(t) AS word, generate_subscripts(t, 1) AS i, t FROM t0),
t2 AS (SELECT 1 AS n, '' AS history, word FROM t1 UNION ALL SELECT 2, t[i - 1], word FROM t1 WHERE i > 1 UNION ALL SELECT 3, t[i - 2] || ' ' || t[i - 1], word FROM t1 WHERE i > 2),
m AS (SELECT *, sum(times) OVER (PARTITION BY n, history) AS of FROM (SELECT n, history, word, count(*) AS times FROM t2 GROUP BY n, history, word)), mt AS (SELECT count(*) AS total FROM t1)"""


def _probabilities(of):
    """SQL of `of` (query_id, text) as CTEs ending in w (query_id, i, word, p)."""
    return f"""q0 AS (SELECT query_id, unnest(t) AS word, generate_subscripts(t, 1) AS i, t FROM (SELECT query_id, {_IT} AS t FROM {of})),
w AS (SELECT query_id, i, q0.word, CASE WHEN c.times IS NOT NULL THEN c.times / c.of::DOUBLE WHEN b.times IS NOT NULL THEN pow(0.4::DOUBLE, CASE WHEN i > 2 THEN 1 ELSE 0 END) * b.times / b.of WHEN a.times IS NOT NULL THEN pow(0.4::DOUBLE, least(i, 3) - 1) * a.times / a.of ELSE pow(0.4::DOUBLE, least(i, 3)) / (1 + total) END AS p
FROM q0 CROSS JOIN mt LEFT JOIN m a ON a.n = 1 AND a.word = q0.word LEFT JOIN m b ON b.n = 2 AND i > 1 AND b.history = t[i - 1] AND b.word = q0.word LEFT JOIN m c ON c.n = 3 AND i > 2 AND c.history = t[i - 2] || ' ' || t[i - 1] AND c.word = q0.word)"""


def _nats(contexts):
    """SQL of the uncertainty of w from contexts (query_id, context, text)."""
    return f"""(SELECT query_id, context, avg(-ln(CASE WHEN len(c) = 0 THEN p ELSE 0.3::DOUBLE * len(list_filter(c, lambda x: x = word)) / len(c)::DOUBLE + 0.7::DOUBLE * p END)) AS nats
FROM (SELECT query_id, context, {_IT} AS c FROM {contexts}) JOIN w USING (query_id) GROUP BY query_id, context)"""


_A = _bm25(_D.replace("source AS user_id, ", ""), _Q, 10)
_F = """SELECT user_id, CAST(id AS BIGINT) AS doc, text FROM (SELECT CAST(conv_id % 5 AS VARCHAR) AS user_id, conv_id * 1000 + turn AS id, text FROM conversations WHERE turn < 4
UNION ALL SELECT CAST(conv_id % 5 AS VARCHAR), -(conv_id * 1000 + turn), lower(text) FROM conversations WHERE turn >= 4 AND turn % 2 = 0) WHERE user_id <> '0'"""
_EP = "SELECT CAST(conv_id % 5 AS VARCHAR) AS user_id, conv_id * 1000 + turn AS query_id, coalesce(text, '') AS text FROM conversations WHERE turn >= 4"
_NEAR = _bm25(f"SELECT user_id, doc, {_IT} AS tokens FROM ({_F})", f"SELECT user_id, query_id, {_IT} AS tokens FROM ({_EP})", 4, True, "query_id, doc, rank, score")
_CUT = "trim(unnest(string_split(regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))))"
_FACT_KEY = r"lower(trim(CASE WHEN starts_with({c}, 'Time:') THEN regexp_replace({c}, '^(?:[^ ]* ){{3}}', '') ELSE {c} END))"
QUERIES = {f.__name__: f for f in (lm_counts, lm_uncertainty, gain_gate, predicted_facts, answer_alignment)}
ORACLES = {
    "lm_counts": f"WITH {_model('conversations')} SELECT CAST(n AS INT) AS n, count(*) AS grams, CAST(sum(times) AS BIGINT) AS tokens, count(DISTINCT history) AS histories, CAST(max(of) AS BIGINT) AS largest FROM m GROUP BY n",
    "lm_uncertainty": f"""WITH d AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations), {_model('d')}, {_probabilities('d')}, b AS (SELECT query_id + 1 AS query_id, 0 AS context, text FROM d)
SELECT query_id, round(nats, 6) AS nats FROM {_nats('b')}""",
    "gain_gate": f"""WITH bm AS (SELECT * FROM (WITH {_A[0].strip()} SELECT query_id, doc, rank FROM k WHERE rank <= 10 AND score > 0)), x AS (SELECT query_id, doc, rank, text FROM bm JOIN documents ON doc_id = doc),
qd AS (SELECT item_id AS query_id, text FROM benchmark), {_model('documents')}, {_probabilities('qd')},
base AS (SELECT query_id, 0 AS context, string_agg(text, chr(10) ORDER BY rank) AS text FROM x WHERE rank <= 2 GROUP BY query_id),
ext AS (SELECT x.query_id, x.doc AS context, base.text || chr(10) || x.text AS text FROM x JOIN base ON x.query_id = base.query_id WHERE rank > 2),
g AS (SELECT x.query_id, x.doc AS episode, x.rank - 2 AS rank, round(n0.nats - n1.nats, 6) AS ig FROM x JOIN {_nats('base')} n0 ON n0.query_id = x.query_id JOIN {_nats('ext')} n1 ON n1.query_id = x.query_id AND n1.context = x.doc WHERE x.rank > 2),
l AS (SELECT *, ig <= -0.02 AS low, sum((ig <= -0.02)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS lows, sum((NOT ig <= -0.02 AND ig > -0.03)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS picked FROM g),
s AS (SELECT *, min(CASE WHEN (low AND (rank <= 3 OR (lows >= 2 AND rank <= 10))) OR (NOT low AND picked >= 4) THEN rank END) OVER (PARTITION BY query_id) AS stop FROM l),
o AS (SELECT *, NOT low AND ig > -0.03 AND (stop IS NULL OR rank <= stop) AS ok FROM s), a AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS any_ok FROM o)
SELECT query_id, episode, CAST(rank AS BIGINT) AS rank, ok AND ig > 0 AS expand, ig FROM a WHERE ok OR (NOT any_ok AND rank = 1)""",
    "predicted_facts": f"""WITH fa AS ({_F}), ep AS ({_EP}), nr AS (SELECT * FROM (WITH {_NEAR[0].strip()} {_NEAR[1]})),
good AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM nr WHERE score >= 0.7),
new AS (SELECT user_id, doc, row_number() OVER (PARTITION BY user_id ORDER BY doc DESC) AS pos FROM fa),
got AS (SELECT query_id, doc FROM good WHERE pos <= 2 UNION ALL SELECT ep.query_id, new.doc FROM ep JOIN new USING (user_id) WHERE new.pos <= 2 AND ep.query_id NOT IN (SELECT query_id FROM good)),
had AS (SELECT DISTINCT query_id, {_FACT_KEY.format(c='s')} AS k FROM (SELECT query_id, {_CUT.format(c='text')} AS s FROM got JOIN fa USING (doc)) WHERE s <> ''),
st AS (SELECT user_id, query_id, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS place, s FROM (SELECT user_id, query_id, {_CUT.format(c='text')} AS s, generate_subscripts(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS i FROM ep) WHERE s <> ''),
nov AS (SELECT user_id, query_id, place, s, {_FACT_KEY.format(c='s')} AS k FROM st WHERE NOT EXISTS (SELECT 1 FROM had WHERE had.query_id = st.query_id AND had.k = {_FACT_KEY.format(c='st.s')})),
num AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS pos FROM nov), one AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY query_id, pos) AS r FROM num)
SELECT user_id, query_id AS episode_id, CAST(pos AS BIGINT) AS pos, s AS statement, user_id = '0' AS cold_start, 0.9::DOUBLE AS confidence FROM one WHERE r = 1""",
}
