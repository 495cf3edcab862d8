"""Queries over buffers, generation, retrieval, the graph's increments and scores, with their SQL."""

from __future__ import annotations

import json
import string

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import providers
from loomstone.functions import text as X
from loomstone.operators import evaluation, fusion, generation, hierarchy, retrieval, segments
from loomstone.operators import vector_graph as G
from loomstone.operators.vector_search import MANHATTAN, topk
from loomstone.plans.memory_queries import _C, _E, _EP, _M, _P, _SEG, _answers, _messages, _vecs
from loomstone.plans.vector_queries import _sides
from loomstone.sources.tables import table


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def normalise_messages(spark, sf_dir):
    """Turns with times in several spellings, some that can't be read, and roles that are missing."""
    t = F.concat(F.lit("2024-01-02T03:0"), (F.col("turn") % 10).cast("string"), F.lit(":00"))
    said = F.when(F.col("turn") % 4 == 0, F.concat(t, F.lit("Z"))).when(F.col("turn") % 4 == 1, t).when(F.col("turn") % 4 == 2, F.concat(t, F.lit("+02:00"))).otherwise("yesterday")
    raw = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner"), F.col("turn").alias("seq"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("role"), F.when(F.col("turn") % 3 > 0, F.col("text")).alias("content"), said.alias("timestamp"), F.col("role").alias("speaker"))
    d = segments.normalised(raw, F.expr("timestamp_ntz'2000-01-01 00:00:00'"))
    return d.select("owner", "seq", "role", F.length("content").alias("n"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), F.col("metadata")["speaker"].alias("speaker"))


def segment_by_detector(spark, sf_dir):
    """Turns that come at growing distances, judged by the default detector."""
    m = _messages(spark, sf_dir).withColumn("ts", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, int(7 * seq * seq), 0)"))
    return segments.by_detector(m).select("owner", "seq", "episode", "should_end", F.round("confidence", 6).alias("confidence"), "reason")


def buffer_flush(spark, sf_dir):
    """What is left in all buffers of 3, of 2 messages or more."""
    return segments.flushed(_messages(spark, sf_dir), 3, 2)


def buffer_totals(spark, sf_dir):
    return segments.buffer_totals(_messages(spark, sf_dir), 2, 5)


def buffer_timeout(spark, sf_dir):
    return segments.timed_out(_messages(spark, sf_dir))


def buffer_json(spark, sf_dir):
    """Buffers as JSON texts, read back."""
    return segments.from_json(segments.to_json(_messages(spark, sf_dir))).select("owner", "seq", "role", "content", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"))


def conversation_text_times(spark, sf_dir):
    return segments.rendered(_messages(spark, sf_dir), ["owner"], times=True)


def episode_time(spark, sf_dir):
    """Times that were said, or not, before those of the events."""
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 3 == 0, F.lit("2024-05-06T07:08:09Z")).when(F.col("event_id") % 3 == 1, F.lit("soon"))
    first = F.when(F.col("event_id") % 2 == 0, F.col("ts").cast("timestamp_ntz"))
    at = generation.episode_time(said, first, F.expr("timestamp_ntz'2000-01-01 00:00:00'"))
    return e.select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm").alias("at"))


_ASKED = len(generation.prompt("episode", conversation=""))


def _model(request: str, temperature: float) -> str:
    """Stands for a model: an object in a fence for requests of even length, no object for others."""
    return "no" if len(request) % 2 else "```json\n" + json.dumps({"title": f"Talk of {len(request)}", "content": "told", "timestamp": "2024-05-06T07:08:09Z"}) + "\n```"


def episode_generated(spark, sf_dir):
    """Episodes by a stand-in model, where its answer can be used."""
    cut = segments.by_size(_messages(spark, sf_dir), 3, 2)
    d = generation.generated_episodes(cut, ["owner", "episode"], _model)
    return d.select("owner", "episode", "title", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), "message_count", "generated")


def typed_facts(spark, sf_dir):
    """Sentences of typed answers made of documents' ids."""
    i = F.col("doc_id").cast("string")
    said = F.concat(F.lit('{"hobby": ["h'), i, F.lit('", "g"], "n": 3, "other": ["x'), i, F.lit('"], "o": {"a": 1}, "knowledge": [], "user_profile": "p'), i, F.lit('"}'))
    return generation.flattened(table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("broken")).otherwise(said).alias("answer")))


def _statements(spark, sf_dir, said):
    return _messages(spark, sf_dir).select((F.col("owner") % 20).cast("string").alias("user_id"), F.col("owner").alias("group"), (F.col("owner") * 1000 + F.col("seq")).alias("pos"), F.concat(F.lit("  "), said).alias("statement"))


def fact_rows(spark, sf_dir):
    """Turns' first words as facts, as old as the first turn of the conversation."""
    m = _messages(spark, sf_dir)
    sources = m.select(F.col("owner").alias("group"), F.concat(F.lit("e"), F.col("seq").cast("string")).alias("episode_id"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("created_at"))
    d = generation.as_facts(_statements(spark, sf_dir, F.substring("content", 1, 12)), sources)
    return d.select("memory_id", "content", "created_at", F.size("source_episodes").alias("sources"), "confidence").distinct()


def novel_facts(spark, sf_dir):
    """Of all users' turns, whole texts, what no fact of theirs says; users 0 to 3 know nothing yet. Facts have A to Z in capitals; others, as of a sharp s, don't lead back."""
    s = _statements(spark, sf_dir, F.col("content"))
    known = s.filter("group % 5 = 0 and cast(user_id as int) > 3").select("user_id", F.translate("statement", string.ascii_lowercase, string.ascii_uppercase).alias("content"))
    return generation.novel(s, known).select("user_id", "pos", "cold_start")


def facts_dispatched(spark, sf_dir):
    """The dispatcher without prediction: each episode's sentences."""
    e = _messages(spark, sf_dir).select(F.col("owner").cast("string").alias("user_id"), F.col("seq").cast("string").alias("episode_id"), F.col("content"))
    extract = lambda d: d.select("user_id", "episode_id", F.lit(0).alias("pos"), F.substring("content", 1, 5).alias("statement"))
    return generation.dispatched(e, e.limit(0), extract, predict=False).select("user_id", "episode_id", "statement")


def relevant_fallback(spark, sf_dir):
    """The 2 nearest facts of a score of 0.3 or more, else the user's last 2."""
    q, v = _sides(spark, sf_dir)
    near = topk(q, v, 4).select("query_id", (F.col("query_id") % 5).cast("long").alias("user_id"), F.col("vec_id").alias("fact"), "rank", "score").filter("fact <> query_id")
    facts = v.select((F.col("vec_id") % 5).cast("long").alias("user_id"), F.col("vec_id").alias("fact"), F.col("vec_id").alias("created_at"))
    return generation.relevant(near, facts, 2, 0.3)


def extraction_text(spark, sf_dir):
    """Conversations as numbered blocks by user, those of odd ids without their messages."""
    m = _messages(spark, sf_dir)
    time = F.when(F.col("seq") % 2 == 0, F.lit("noon"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("seq", time.alias("timestamp"), "role", "content"))), lambda x: F.struct(x["timestamp"].alias("timestamp"), x["role"].alias("role"), x["content"].alias("content")))
    e = m.groupBy("owner").agg(said.alias("original_messages")).withColumn("original_messages", F.when(F.col("owner") % 2 == 0, F.col("original_messages")))
    e = e.select((F.col("owner") % 10).alias("user_id"), F.col("owner").alias("seq"), F.concat(F.lit("c"), F.col("owner").cast("string")).alias("title"), F.lit("text").alias("content"), F.lit("2024").alias("created_at"), "original_messages")
    return generation.extraction_text(e, ["user_id"]).select("user_id", F.sha2("text", 256).alias("text_sha256"))


def theme_summary(spark, sf_dir):
    """The member nearest each theme's centroid, of even ids, as if only these were in the batch; theme 0 has none."""
    e = _vecs(spark, sf_dir)
    facts = e.select("theme", F.col("id").alias("fact"), F.concat(F.lit("fact "), F.col("id").cast("string")).alias("content"), "v")
    return generation.theme_summaries(facts, G.centroids(e, "theme"), facts.filter("fact % 2 = 0 and theme <> 0"))


def _l2(spark, sf_dir, k):
    q, v = _sides(spark, sf_dir)
    return topk(q.withColumn("q", F.slice("q", 1, 8)), v.withColumn("v", F.slice("v", 1, 8)), k, MANHATTAN).withColumnRenamed("vec_id", "item")


def _cos(spark, sf_dir, k):
    return topk(*_sides(spark, sf_dir), k=k).withColumnRenamed("vec_id", "item")


def search_methods(spark, sf_dir):
    """One dispatch for all methods; distances over the first 8 dimensions stand for the lexical side."""
    out = None
    for m in ("bm25", "vector", "vector_norlift", "other"):
        d = retrieval.dispatched(m, lambda k: _l2(spark, sf_dir, k), lambda k: _cos(spark, sf_dir, k), 5).select(F.lit(m).alias("method"), "query_id", "item", "rank")
        out = d if out is None else out.unionByName(d)
    return out


def _categories(spark, sf_dir, combined):
    # Rounded, as equal scores of both kinds would be ordered by their last digits.
    near = _round(_cos(spark, sf_dir, 4), "score")
    other = _round(_l2(spark, sf_dir, 4).withColumn("score", 1 / (1 - F.col("score"))), "score")
    return retrieval.categorised({"episodic": (near, 4), "semantic": (other, 3), "none": (near, 0)}, combined)


def search_categories(spark, sf_dir):
    """Results by category, none of a category with k = 0, and all of them best first."""
    return _categories(spark, sf_dir, 5).select("category", "query_id", "kind", "item", "rank")


def search_flatten(spark, sf_dir):
    """Categories one after the other."""
    return retrieval.flattened(_categories(spark, sf_dir, None))


def search_fallback(spark, sf_dir):
    """Queries of which the strict search finds fewer than two get the plain one's first two."""
    strict = _cos(spark, sf_dir, 10).filter("score > 0.3 and query_id <> item").select("query_id", "item")
    return retrieval.with_fallback(strict, _sides(spark, sf_dir)[0], _cos(spark, sf_dir, 2).select("query_id", "item"))


def hydrate_expanded(spark, sf_dir):
    """Results that are marked, at most 2 of each query, with their rows; times come from the metadata where they are missing."""
    r = _cos(spark, sf_dir, 6).select("query_id", "item", "rank")
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("item"), F.when(F.col("doc_id") % 2 == 0, F.lit("made")).alias("created_at"), F.lit(None).cast("string").alias("timestamp"), F.create_map(F.lit("created_at"), F.lit("meta"), F.lit("timestamp"), F.col("lang")).alias("metadata"), "n_chars")
    return retrieval.hydrated(r, rows, 2, F.col("item") % 3 > 0).select("query_id", "item", "rank", "hydrated", "created_at", "timestamp", "n_chars")


def context_block(spark, sf_dir):
    """Lines of episodes with the messages under those of even owners."""
    m = _messages(spark, sf_dir)
    said = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat("role", F.lit(": "), "content").alias("x")))), lambda s: s["x"])
    d = m.groupBy("owner").agg(said.alias("messages"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm").alias("ts"), F.count(F.lit(1)).alias("n"))
    d = d.select((F.col("owner") % 12).alias("query_id"), F.col("owner").alias("rank"), F.when(F.col("owner") % 3 > 0, F.col("ts")).alias("ts"), F.concat(F.lit("talk of "), F.col("n").cast("string")).alias("content"), F.when(F.col("owner") % 2 == 0, F.col("messages")).alias("messages"))
    return retrieval.context(d).select("query_id", F.sha2("text", 256).alias("text_sha256"))


def answer_tokens(spark, sf_dir):
    """Answers of a stand-in model from contexts that are cut to 20 tokens; it fails where the context has 9 characters more than ten's multiples."""

    def model(question: str, text: str) -> str:
        if len(text) % 10 == 9:
            raise ValueError
        return question[::-1]

    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 40).alias("question"), "text")
    return retrieval.answered(b, model, 20).select("query_id", F.length("text").alias("chars"), "context_tokens", "answer_tokens", (F.col("answer") == F.reverse("question")).alias("answered"))


def context_neighbourhood(spark, sf_dir):
    """Themes 0 and 5 with the two nearest of each that are alive, 5 by stored edges and 0, which has none, by centroid."""
    c = G.centroids(_vecs(spark, sf_dir), "theme")
    ids = c.select(F.col("theme").alias("id"), F.col("centroid").alias("v"))
    seeds = c.filter(F.col("theme").isin(0, 5))
    return retrieval.neighbourhood(seeds, G.knn(ids, ids, 4).filter("src = 5"), c.filter("theme <> 3").select("theme"), c, 2)


def graph_increment(spark, sf_dir):
    """Edges of a batch: orders that were not consumed with their lines, customers, nations."""
    o = hierarchy.unconsumed(table(spark, sf_dir, "orders"), table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0"), "o_orderkey")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.array(F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("message_ids"))
    episodes = o.join(l, "o_orderkey").select(F.col("o_orderkey").cast("string").alias("episode_id"), "message_ids")
    facts = table(spark, sf_dir, "orders").withColumn("source_episodes", F.array(F.col("o_orderkey").cast("string"))).select(F.col("o_custkey").cast("string").alias("memory_id"), "source_episodes")
    themes = table(spark, sf_dir, "customer").withColumn("semantic_ids", F.array(F.col("c_custkey").cast("string"))).select(F.col("c_nationkey").cast("string").alias("theme_id"), "semantic_ids")
    e = hierarchy.simple_edges(hierarchy.increment_edges(episodes, facts, themes))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("a").alias("firsts"), F.count_distinct("b").alias("lasts"))


def graph_neighbours(spark, sf_dir):
    """Nations of each region, and a region without any."""
    from loomstone.plans.memory_queries import _graph

    nodes, edges = _graph(spark, sf_dir)
    return hierarchy.neighbour_counts(nodes.unionByName(spark.createDataFrame([("r99", 3)], "node string, level int")), edges)


def graph_extras(spark, sf_dir):
    """Nations' extras are merged with new ones, which win; a customer comes in with its own."""
    n = table(spark, sf_dir, "nation")
    m = lambda *x: F.create_map(*x)
    old = n.select(F.col("n_nationkey").cast("long").alias("node_id"), F.lit(2).alias("level"), F.col("n_nationkey").cast("long").alias("raw_id"), F.col("n_name").alias("text"), m(F.lit("a"), F.lit("old"), F.lit("b"), F.col("n_name")).alias("extras"))
    new = n.filter("n_nationkey % 2 = 0").select(F.lit(2).alias("level"), F.col("n_nationkey").cast("long").alias("raw_id"), F.lit("").alias("text"), m(F.lit("a"), F.lit("new")).alias("extras"))
    new = new.unionByName(table(spark, sf_dir, "customer").select(F.lit(1).alias("level"), F.col("c_custkey").cast("long").alias("raw_id"), F.col("c_name").alias("text"), m(F.lit("c"), F.col("c_mktsegment")).alias("extras")))
    d = hierarchy.upsert_nodes(old, new)
    return d.select("node_id", "level", "raw_id", "text", *(F.col("extras")[k].alias(k) for k in "abc"))


def bleu_n(spark, sf_dir):
    """BLEU-1 to BLEU-4 of each turn against the one before it."""
    names = [f"bleu{n}" for n in range(1, 5)]
    return _round(evaluation.bleu(_answers(spark, sf_dir)).select("conv_id", "turn", *names), *names)


def rouge_f(spark, sf_dir):
    """ROUGE-1 and ROUGE-2 F1 of each turn against the one before it."""
    return _round(evaluation.rouge(_answers(spark, sf_dir)).select("conv_id", "turn", "rouge1", "rouge2"), "rouge1", "rouge2")


def score_countable(spark, sf_dir):
    """Turns of all categories but 5, which are the turns' numbers modulo 6."""
    d = evaluation.countable(_answers(spark, sf_dir).withColumn("category", F.when(F.col("turn") != 7, F.col("turn") % 6)))
    return _round(evaluation.scored(d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("f1").alias("f1")), "f1")


def judge_accuracy(spark, sf_dir):
    """A judge that counts characters: right where both texts have as many, modulo 3; it fails on turn 4."""

    def judge(question, gold, answer) -> int:
        if question == "4":
            raise ValueError
        return len(gold) % 3 == len(answer) % 3

    d = evaluation.judged(_answers(spark, sf_dir).withColumn("question", F.col("turn").cast("string")), judge)
    return _round(d.groupBy("turn").agg(F.count("label").alias("judged"), F.avg("label").alias("accuracy")), "accuracy")


def compare_runs(spark, sf_dir):
    """Two runs by BLEU-1, their questions spelled otherwise in case, width and white space; one run lacks some values."""
    d = evaluation.scored(_answers(spark, sf_dir)).select("conv_id", "turn", F.round("bleu1", 6).alias("bleu"))
    half = lambda k, q: d.filter(F.col("turn") % 2 == k).select(evaluation.key_text(q).alias("question"), F.col("turn").alias("seq"), F.when(F.col("conv_id") % 11 > k, F.col("bleu")).alias("bleu"))
    a = half(0, F.concat(F.lit("  What　OF\t"), F.col("conv_id").cast("string")))
    b = half(1, F.concat(F.lit("Ｗhat of  "), F.col("conv_id").cast("string"), F.lit("\n")))
    return evaluation.compare(a, b, ["question"], "bleu")


_R = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, item) AS rank FROM s)"
_COSS = f"e AS ({_E}), s AS (SELECT a.id AS query_id, b.id AS item, {_P} AS s FROM e a JOIN e b ON a.id % 50 = 0), {_R}"
_L2S = f"{_R.replace('r AS', 'l AS').replace('FROM s)', 'FROM m)')}"
_MAN = "m AS (SELECT a.id AS query_id, b.id AS item, -list_sum([abs(x[1] - x[2]) for x in list_zip(a.v[1:8], b.v[1:8])]) AS s FROM e a JOIN e b ON a.id % 50 = 0)"
_BOTH = f"{_COSS}, {_MAN}, {_L2S}"
_RRF = "f AS (SELECT query_id, item, sum(1.0::DOUBLE / (60 + rank)) AS s, min(list * 1000 + rank) AS seen FROM (SELECT query_id, item, rank, 0 AS list FROM l WHERE rank <= 10 UNION ALL SELECT query_id, item, rank, 1 FROM r WHERE rank <= 10) GROUP BY 1, 2), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, seen, item) AS rank FROM f)"
_CATS = "c AS (SELECT 'episodic' AS kind, query_id, item, CAST(rank AS BIGINT) AS rank, round(s, 6) AS score FROM r WHERE rank <= 4 UNION ALL SELECT 'semantic', query_id, item, CAST(rank AS BIGINT), round(1 / (1 - s), 6) FROM l WHERE rank <= 3)"
_TOK = "list_filter(regexp_split_to_array(trim(translate(lower({c}), '.,!?', '    ')), '\\s+'), lambda t: t <> '')"
_PAIRS = f"p AS (SELECT a.conv_id, a.turn, a.text AS pt, b.text AS gt, {_TOK.format(c='a.text')} AS a, {_TOK.format(c='b.text')} AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)"
_GRAM = "[array_to_string({x}[i:i + {n} - 1], chr(1)) for i in generate_series(1, len({x}) - {n} + 1)]"
_HIT = "CAST(coalesce(list_sum([least(len(list_filter(a{n}, lambda y: y = t)), len(list_filter(b{n}, lambda y: y = t))) for t in list_distinct(a{n})]), 0) AS BIGINT) AS h{n}"
_GRAMS = f"{_PAIRS}, g AS (SELECT *, {', '.join(_GRAM.format(x=x, n=n) + f' AS {x}{n}' for x in 'ab' for n in range(1, 5))} FROM p), n AS (SELECT *, {', '.join(_HIT.format(n=n) for n in range(1, 5))} FROM g)"
_LOG = "ln(CASE WHEN h{n} = 0 THEN 0.1::DOUBLE ELSE h{n} END / greatest(len(a) - {n} + 1, 1))"
_BREV = "CASE WHEN len(a) > len(b) THEN 1.0::DOUBLE ELSE exp(1 - len(b)::DOUBLE / len(a)) END"


def _bleu(n):
    logs = " + ".join(f"{w}::DOUBLE * {_LOG.format(n=i)}" for i, w in enumerate(evaluation.WEIGHTS[n], 1))
    return f"round(CASE WHEN h1 = 0 THEN 0.0::DOUBLE ELSE {_BREV} * exp({logs}) END, 6) AS bleu{n}"


_ST = "st AS (SELECT CAST(conv_id % 20 AS VARCHAR) AS user_id, conv_id AS grp, conv_id * 1000 + turn AS pos, '  ' || substr(text, 1, 12) AS statement FROM conversations)"
_WHOLE = _ST.replace("substr(text, 1, 12)", "text")
_KEY = "lower(trim(statement))"
_TXT = "x AS (SELECT g.owner, g.episode, string_agg(role || ': ' || content, chr(10) ORDER BY seq) AS text FROM g GROUP BY g.owner, g.episode)"

QUERIES = {
    f.__name__: f
    for f in (
        normalise_messages, segment_by_detector, buffer_flush, buffer_totals, buffer_timeout, buffer_json, conversation_text_times, episode_time, episode_generated, typed_facts, fact_rows, novel_facts, facts_dispatched,
        relevant_fallback, extraction_text, theme_summary, search_methods, search_categories, search_flatten, search_fallback, hydrate_expanded, context_block, answer_tokens, context_neighbourhood,
        graph_increment, graph_neighbours, graph_extras, bleu_n, rouge_f, score_countable, judge_accuracy, compare_runs,
    )
}
ORACLES = {
    "normalise_messages": """SELECT conv_id AS owner, turn AS seq, CASE WHEN turn % 2 = 0 THEN role ELSE 'user' END AS role, CASE WHEN turn % 3 > 0 THEN CAST(length(text) AS INT) ELSE 0 END AS n,
CASE turn % 4 WHEN 3 THEN '2000-01-01 00:00' WHEN 2 THEN '2024-01-02 01:0' || (turn % 10) ELSE '2024-01-02 03:0' || (turn % 10) END AS ts, role AS speaker FROM conversations""",
    "segment_by_detector": """WITH d AS (SELECT conv_id AS owner, turn AS seq, 7 * (turn * turn - t0 * t0)::DOUBLE AS gap, t0 FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS t0 FROM conversations)),
j AS (SELECT *, coalesce(gap > 30, false) AS should_end FROM d) SELECT owner, seq, CAST(sum(should_end::INT) OVER (PARTITION BY owner ORDER BY seq) AS BIGINT) AS episode, should_end, round(coalesce(least(1, greatest(0, gap / 60)), 0.0::DOUBLE), 6) AS confidence,
CASE WHEN t0 IS NULL THEN 'first' WHEN gap > 30 THEN 'gap' ELSE '' END AS reason FROM j""",
    "buffer_flush": f"WITH {_M}, b AS (SELECT *, (row_number() OVER (PARTITION BY owner ORDER BY seq) - 1) // 3 AS episode FROM m) SELECT owner, CAST(episode AS BIGINT) AS episode, string_agg(role || ': ' || content, chr(10) ORDER BY seq) AS text, count(*) AS n_messages, 'flush' AS reason FROM b GROUP BY owner, episode HAVING count(*) = 2",
    "buffer_totals": "SELECT count(*) AS buffers, CAST(sum(n) AS BIGINT) AS messages, count(*) FILTER (n >= 2) AS ready, count(*) FILTER (n >= 5) AS full, round(avg(n), 6) AS avg_messages FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)",
    "buffer_timeout": "SELECT DISTINCT conv_id AS owner, false AS timed_out FROM conversations",
    "buffer_json": f"WITH {_M} SELECT owner, seq, role, content, strftime(ts, '%Y-%m-%d %H:%M') AS ts FROM m",
    "conversation_text_times": f"WITH {_M} SELECT owner, string_agg('[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || role || ': ' || content, chr(10) ORDER BY seq) AS text, count(*) AS n_messages FROM m GROUP BY owner",
    "episode_time": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '2024-05-06 07:08' WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M') ELSE '2000-01-01 00:00' END AS at FROM events",
    "episode_generated": f"WITH {_EP}, {_TXT}, o AS (SELECT x.*, (length(text) + {_ASKED}) % 2 = 0 AS ok, length(text) + {_ASKED} AS n FROM x) SELECT te.owner, te.episode, CASE WHEN ok THEN 'Talk of ' || n ELSE title END AS title, CASE WHEN ok THEN '2024-05-06 07:08' ELSE strftime(t0, '%Y-%m-%d %H:%M') END AS ts, te.message_count, ok AS generated FROM te JOIN ep ON te.owner = ep.owner AND te.episode = ep.episode JOIN o ON o.owner = te.owner AND o.episode = te.episode",
    "typed_facts": "SELECT doc_id, CAST(pos AS INT) AS pos, CASE pos WHEN 0 THEN 'p' || doc_id WHEN 1 THEN 'x' || doc_id WHEN 2 THEN 'h' || doc_id ELSE 'g' END AS statement FROM documents, generate_series(0, 3) AS g(pos) WHERE doc_id % 7 <> 0",
    "fact_rows": f"""WITH {_ST}, {_M}, o AS (SELECT owner, strftime(min(ts), '%Y-%m-%d %H:%M') AS created_at, CAST(count(DISTINCT seq) AS INT) AS sources FROM m GROUP BY owner)
SELECT DISTINCT sha256(user_id || chr(0) || trim(statement)) AS memory_id, trim(statement) AS content, created_at, sources, 0.8::DOUBLE AS confidence FROM st JOIN o ON grp = owner WHERE trim(statement) <> ''""",
    "novel_facts": f"""WITH {_WHOLE}, k AS (SELECT DISTINCT user_id, {_KEY} AS k FROM st WHERE grp % 5 = 0 AND CAST(user_id AS INT) > 3), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, {_KEY} ORDER BY pos) AS r FROM st)
SELECT user_id, pos, user_id NOT IN (SELECT user_id FROM k) AS cold_start FROM f WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = f.user_id AND k.k = lower(trim(f.statement)))""",
    "facts_dispatched": "SELECT CAST(conv_id AS VARCHAR) AS user_id, CAST(turn AS VARCHAR) AS episode_id, substr(text, 1, 5) AS statement FROM conversations",
    "relevant_fallback": f"""WITH {_COSS}, n AS (SELECT * FROM r WHERE rank <= 4 AND query_id <> item), g AS (SELECT query_id, item AS fact, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM n WHERE s >= 0.3),
k AS (SELECT query_id, fact, pos, false AS fallback FROM g WHERE pos <= 2), w AS (SELECT id AS fact, id % 5 AS user_id, row_number() OVER (PARTITION BY id % 5 ORDER BY id DESC) AS pos FROM e)
SELECT query_id, fact, CAST(pos AS BIGINT) AS pos, fallback FROM k UNION ALL SELECT q.query_id, fact, CAST(pos AS BIGINT), true FROM (SELECT DISTINCT query_id FROM n WHERE query_id NOT IN (SELECT query_id FROM k)) q JOIN w ON q.query_id % 5 = w.user_id WHERE pos <= 2""",
    "extraction_text": """WITH b AS (SELECT conv_id, string_agg('  ' || CASE WHEN turn % 2 = 0 THEN '[noon] ' ELSE '' END || role || ': ' || text, chr(10) ORDER BY turn) AS said FROM conversations GROUP BY conv_id),
n AS (SELECT conv_id % 10 AS user_id, conv_id, 'Episode ' || row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id) || ':' || chr(10) || 'Title: c' || conv_id || chr(10) || CASE WHEN conv_id % 2 = 0 THEN 'Original Conversation:' || chr(10) || said ELSE 'Content: text' END || chr(10) || 'Created at: 2024' || chr(10) AS t FROM b)
SELECT user_id, sha256(string_agg(t, chr(10) ORDER BY conv_id)) AS text_sha256 FROM n GROUP BY user_id""",
    "theme_summary": f"WITH {_C}, s AS (SELECT a.theme, a.id, {_P} AS s FROM e a JOIN c b ON a.theme = b.theme WHERE a.id % 2 = 0 AND a.theme <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY round(s, 9) DESC, id) AS r FROM s) SELECT c.theme, coalesce('fact ' || id, '') AS summary FROM c LEFT JOIN r ON c.theme = r.theme AND r = 1",
    "search_methods": f"WITH {_BOTH}, {_RRF} SELECT 'bm25' AS method, query_id, item, CAST(rank AS BIGINT) AS rank FROM l WHERE rank <= 5 UNION ALL SELECT unnest(['vector', 'vector_norlift']), query_id, item, CAST(rank AS BIGINT) FROM r WHERE rank <= 5 UNION ALL SELECT 'other', query_id, item, CAST(rank AS BIGINT) FROM h WHERE rank <= 5",
    "search_categories": f"WITH {_BOTH}, {_CATS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, item) AS pos FROM c) SELECT kind AS category, query_id, kind, item, rank FROM c UNION ALL SELECT 'combined', query_id, kind, item, CAST(pos AS BIGINT) FROM o WHERE pos <= 5",
    "search_flatten": f"WITH {_BOTH}, {_CATS} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY kind, rank) AS BIGINT) AS pos, kind, item FROM c",
    "search_fallback": f"WITH {_COSS}, k AS (SELECT query_id, item FROM r WHERE rank <= 10 AND s > 0.3 AND query_id <> item) SELECT query_id, item, false AS fallback FROM k UNION ALL SELECT query_id, item, true FROM r WHERE rank <= 2 AND query_id NOT IN (SELECT query_id FROM k)",
    "hydrate_expanded": f"""WITH {_COSS}, k AS (SELECT query_id, item, rank, item % 3 > 0 AS go, row_number() OVER (PARTITION BY query_id, item % 3 > 0 ORDER BY rank) AS n FROM r WHERE rank <= 6)
SELECT query_id, item, CAST(rank AS BIGINT) AS rank, doc_id IS NOT NULL AS hydrated, CASE WHEN doc_id % 2 = 0 THEN 'made' WHEN doc_id IS NOT NULL THEN 'meta' END AS created_at, lang AS timestamp, n_chars FROM k LEFT JOIN documents d ON d.doc_id = k.item AND go AND n <= 2""",
    "context_block": f"""WITH {_M}, o AS (SELECT owner, strftime(min(ts), '%Y-%m-%d %H:%M') AS t, count(*) AS n, string_agg('    ' || role || ': ' || content, chr(10) ORDER BY seq) AS said FROM m GROUP BY owner),
l AS (SELECT owner, '- ' || CASE WHEN owner % 3 > 0 THEN '[' || t || '] ' ELSE '' END || 'talk of ' || n || CASE WHEN owner % 2 = 0 THEN chr(10) || '  Original Messages:' || chr(10) || said ELSE '' END AS line FROM o)
SELECT owner % 12 AS query_id, sha256(string_agg(line, chr(10) ORDER BY owner)) AS text_sha256 FROM l GROUP BY 1""",
    "answer_tokens": """WITH b AS (SELECT item_id AS query_id, substr(text, 1, 40) AS q, text, CAST(trunc(length(text) / 4.0::DOUBLE) AS INT) AS n FROM benchmark),
c AS (SELECT *, CASE WHEN n <= 20 THEN length(text) ELSE greatest(1, CAST(floor(length(text) * 20 / greatest(n, 1)) AS INT)) END AS chars FROM b)
SELECT query_id, CAST(chars AS INT) AS chars, CAST(trunc(chars / 4.0::DOUBLE) AS INT) AS context_tokens, CASE WHEN chars % 10 = 9 THEN 0 ELSE CAST(trunc(length(q) / 4.0::DOUBLE) AS INT) END AS answer_tokens, chars % 10 <> 9 AS answered FROM c""",
    "context_neighbourhood": f"""WITH {_C}, s AS (SELECT a.theme AS src, b.theme AS dst, {_P} AS s FROM c a JOIN c b ON a.theme <> b.theme WHERE a.theme IN (0, 5)), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(s, 9) DESC, dst) AS rank FROM s),
st AS (SELECT *, row_number() OVER (ORDER BY rank) AS n FROM r WHERE src = 5 AND rank <= 4 AND s > 0 AND dst <> 3), z AS (SELECT *, row_number() OVER (ORDER BY rank) AS n FROM r WHERE src = 0 AND dst <> 3)
SELECT theme FROM c WHERE theme IN (0, 5) UNION SELECT dst FROM st WHERE n <= 2 UNION SELECT dst FROM z WHERE n <= 2 AND s > 0""",
    "graph_increment": """WITH o AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)), l AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)), cu AS (SELECT c_nationkey, c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))
SELECT 'part_of' AS kind, count(*) AS edges, count(*) AS firsts, count(DISTINCT l_orderkey) AS lasts FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM l) UNION ALL SELECT 'supports', count(*), count(DISTINCT o_orderkey), count(DISTINCT o_custkey) FROM o UNION ALL SELECT 'in_theme', count(*), count(DISTINCT c_custkey), count(DISTINCT c_nationkey) FROM cu""",
    "graph_neighbours": "SELECT 'r' || r_regionkey AS node, count(n_nationkey) AS neighbours FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey UNION ALL SELECT 'r99', 0",
    "graph_extras": "SELECT n_nationkey::BIGINT AS node_id, 2 AS level, n_nationkey::BIGINT AS raw_id, n_name AS text, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS a, n_name AS b, NULL AS c FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY c_custkey), 1, c_custkey, c_name, NULL, NULL, c_mktsegment FROM customer",
    "bleu_n": f"WITH {_GRAMS} SELECT conv_id, turn, {', '.join(map(_bleu, range(1, 5)))} FROM n",
    "rouge_f": f"WITH {_GRAMS} SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * h1 / (len(a) + len(b)) END, 6) AS rouge1, round(CASE WHEN len(a2) + len(b2) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * h2 / (len(a2) + len(b2)) END, 6) AS rouge2 FROM n",
    "score_countable": f"""WITH {_PAIRS}, q AS (SELECT CASE WHEN turn <> 7 THEN turn % 6 END AS category, len(list_intersect(list_distinct(a), list_distinct(b))) AS s, len(list_distinct(a)) AS na, len(list_distinct(b)) AS nb FROM p)
SELECT category, count(*) AS n, round(avg(CASE WHEN s = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * s / (na + nb) END), 6) AS f1 FROM q WHERE category IS DISTINCT FROM 5 GROUP BY category""",
    "judge_accuracy": f"WITH {_PAIRS} SELECT turn, count(*) FILTER (turn <> 4) AS judged, round(avg(CASE WHEN turn <> 4 THEN (length(pt) % 3 = length(gt) % 3)::INT END), 6) AS accuracy FROM p GROUP BY turn",
    "compare_runs": f"""WITH {_GRAMS}, v AS (SELECT conv_id, turn, {_bleu(1)} FROM n), l AS (SELECT conv_id, max(turn) AS t, arg_max(CASE WHEN conv_id % 11 > 0 THEN [bleu1] ELSE [NULL] END, turn)[1] AS l FROM v WHERE turn % 2 = 0 GROUP BY conv_id), r AS (SELECT conv_id, max(turn) AS t, arg_max(CASE WHEN conv_id % 11 > 1 THEN [bleu1] ELSE [NULL] END, turn)[1] AS r FROM v WHERE turn % 2 = 1 GROUP BY conv_id)
SELECT 'what of ' || coalesce(l.conv_id, r.conv_id) AS question, l, r, CASE WHEN r.t IS NULL THEN 'only_left' WHEN l.t IS NULL THEN 'only_right' WHEN l IS NULL OR r IS NULL THEN 'missing' WHEN l > r THEN 'better' WHEN l < r THEN 'worse' ELSE 'equal' END AS outcome FROM l FULL JOIN r ON l.conv_id = r.conv_id""",
}
