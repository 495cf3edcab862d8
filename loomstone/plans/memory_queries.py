"""Queries over vector graphs, episodes, the hierarchy and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import vectors as V
from loomstone.operators import adaptive_search as A
from loomstone.functions import providers
from loomstone.operators import evaluation, hierarchy, metric_index, segments, themes
from loomstone.operators import vector_graph as G
from loomstone.sources.store import scratch, written
from loomstone.sources.tables import table


def _vecs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("theme"))


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def vec_distance_metrics(spark, sf_dir):
    """Each vector against the next one."""
    e = _vecs(spark, sf_dir)
    a, b = F.col("a"), F.col("v")
    j = e.join(e.select((F.col("id") + 1).alias("id"), F.col("v").alias("a")), "id")
    return _round(j.select("id", V.cosine(a, b).alias("cos"), V.euclidean(a, b).alias("euclid"), V.manhattan(a, b).alias("manhattan")), "cos", "euclid", "manhattan")


def vec_normalize(spark, sf_dir):
    e = _vecs(spark, sf_dir).withColumn("u", V.normalize(F.transform("v", lambda x: x * 3)))
    return e.select("id", F.round(V.norm(F.col("u")), 6).alias("length"), F.round(F.col("u")[0], 6).alias("first"))


def knn_graph_full(spark, sf_dir):
    e = _vecs(spark, sf_dir)
    return _round(G.knn(e, e), "sim")


def knn_graph_incremental(spark, sf_dir):
    """New facts are those of the last theme; old rows stay as they are."""
    e = _vecs(spark, sf_dir)
    return _round(G.knn(e.filter("theme = 9"), e), "sim")


def theme_knn(spark, sf_dir):
    """The nearest themes of each theme by centroid, all anew."""
    c = G.centroids(_vecs(spark, sf_dir), "theme").select(F.col("theme").cast("long").alias("id"), F.col("centroid").alias("v"))
    return _round(G.knn(c, c, 3), "sim")


def threshold_pairs(spark, sf_dir):
    return _round(G.pairs_above(_vecs(spark, sf_dir), 0.35), "sim")


def threshold_pairs_cells(spark, sf_dir):
    """The same pairs by cells around pivots: vectors that are far apart never meet."""
    return _round(metric_index.pairs_above(_vecs(spark, sf_dir), 0.35), "sim")


def threshold_components(spark, sf_dir):
    e = _vecs(spark, sf_dir)
    return G.components(e, G.linking(e, 0.35), scratch(spark, "components"))


def theme_centroids(spark, sf_dir):
    c = G.centroids(_vecs(spark, sf_dir), "theme")
    return c.select("theme", "n", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


def theme_mean_intra(spark, sf_dir):
    return _round(G.mean_intra(_vecs(spark, sf_dir), "theme"), "mean_intra")


def theme_cohesion(spark, sf_dir):
    e = _vecs(spark, sf_dir)
    return _round(G.cohesion(e, G.centroids(e, "theme"), "theme"), "cohesion")


def theme_objective(spark, sf_dir):
    return _round(G.objective(_vecs(spark, sf_dir), "theme"), "sparsity", "sem", "f")


def theme_assign_step(spark, sf_dir):
    e = _vecs(spark, sf_dir)
    return _round(G.assign_step(e.select("id", "v"), G.centroids(e, "theme"), 0.3, 0.2, 1_000_000), "sim")


def theme_merge_candidates(spark, sf_dir):
    c = G.centroids(_vecs(spark, sf_dir), "theme").select(F.col("theme").alias("id"), F.col("centroid").alias("v"))
    return _round(G.pairs_above(c, 0.0), "sim")


def semantic_dup_pairs(spark, sf_dir):
    return _round(G.pairs_above(_vecs(spark, sf_dir), 0.3, same="theme", strict=True), "sim")


def _messages(spark, sf_dir):
    ts = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(int(conv_id), 0, int(turn), 0)")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), ts.alias("ts"))


def segment_by_size(spark, sf_dir):
    return segments.by_size(_messages(spark, sf_dir), 3, 2).select("owner", "seq", "episode")


def segment_by_gap(spark, sf_dir):
    """Events of a user, cut where six hours pass."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), "ts")
    return segments.by_boundary(e, segments.gap_boundary(360)).groupBy("owner", "episode").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def conversation_text(spark, sf_dir):
    return segments.rendered(_messages(spark, sf_dir), ["owner"])


def _episodes(spark, sf_dir):
    return segments.fallback_episodes(segments.by_size(_messages(spark, sf_dir), 3, 2), ["owner", "episode"])


def episode_fallback(spark, sf_dir):
    return _episodes(spark, sf_dir).select("owner", "episode", "title", "content", "message_count")


def episode_validate(spark, sf_dir):
    return _episodes(spark, sf_dir).groupBy(segments.valid_episode().alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def buffer_stats(spark, sf_dir):
    return segments.buffer_stats(_messages(spark, sf_dir), 2, 5).select("owner", "n", "ready", "full")


def buffer_eviction(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), "ts")
    out = segments.inactive(e, F.expr("timestamp_ntz '2024-02-01 00:00:00'"), 24)
    return out.select("owner", F.round("age_hours", 6).alias("age_hours"))


def upsert_absent(spark, sf_dir):
    """Documents by text: a row is inserted if no earlier id has its text."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2("text", 256).alias("text_id")).agg(F.min("doc_id").alias("doc_id"))


def _asked(spark, sf_dir):
    return _vecs(spark, sf_dir).filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))


def hier_pool(spark, sf_dir):
    return _round(A.fact_pool(_asked(spark, sf_dir), _vecs(spark, sf_dir)), "score", "norm")


def _themes(spark, sf_dir, kept=lambda pool: pool):
    """The pooled facts (as `kept` gives them back) and the themes that hold one."""
    e, q = _vecs(spark, sf_dir), _asked(spark, sf_dir)
    pool = kept(A.fact_pool(q, e))
    cents = G.centroids(e, "theme").select("theme", F.col("centroid").alias("v"))
    return pool, A.candidate_themes(pool, e.select(F.col("id").alias("fact"), "theme"), q, cents)


def hier_candidate_themes(spark, sf_dir):
    return _round(_themes(spark, sf_dir)[1], "score")


def _priority(spark, sf_dir):
    pool, _ = _themes(spark, sf_dir)
    of = pool.select("query_id", (F.col("fact") % 97).cast("bigint").alias("episode"), "score", "norm")
    best = of.groupBy("query_id", "episode").agg(F.max("score").alias("score"))
    return A.episode_priority(best, of.select("query_id", "episode", "norm"))


def hier_episode_priority(spark, sf_dir):
    return _round(_priority(spark, sf_dir), "priority")


def ig_gate(spark, sf_dir):
    """Gains made from ids, low and high ones among them."""
    e = _vecs(spark, sf_dir).select((F.col("id") / 10).cast("int").cast("bigint").alias("query_id"), F.col("id").alias("episode"), (F.col("id") % 10 + 1).alias("rank"), (((F.col("id") * 37) % 100) / 100.0 - 0.5).cast("double").alias("ig"))
    return A.gate(e, most=6)


def _named(df, kind, item):
    """query_id and the items in order of their step, a line each."""
    steps = F.array_sort(F.collect_list(F.struct("step", F.concat(F.lit(f"{kind} "), F.col(item).cast("string")).alias("line"))))
    return df.groupBy("query_id").agg(F.array_join(F.transform(steps, lambda x: x["line"]), "\n").alias(kind))


def hier_search(spark, sf_dir, uncertainty=providers.constant_uncertainty):
    """The top-down search: pooled facts, representative themes, their facts, then episodes by priority and gate.

    Episodes are those of the chosen facts and the nearest by vector. The table
    has no texts, so the scorer of uncertainty is given the items' names.
    """
    e, q = _vecs(spark, sf_dir), _asked(spark, sf_dir)
    root = scratch(spark, "search")
    # Written, as each is used several times: the plan would double with every use.
    pool, themes = _themes(spark, sf_dir, lambda pool: written(pool, f"{root}/pool"))
    themes = written(themes, f"{root}/themes")
    cents = G.centroids(e, "theme").select(F.col("theme").cast("long").alias("id"), F.col("centroid").alias("v"))
    chosen = written(A.pick(themes.select("query_id", F.col("theme").cast("long").alias("item"), "score"), G.knn(cents, cents), 5), f"{root}/chosen")
    of = e.select(F.col("id").alias("fact"), F.col("theme").cast("long").alias("theme"))
    facts = pool.join(of, "fact").join(chosen.select("query_id", F.col("item").alias("theme")), ["query_id", "theme"], "left_semi").select("query_id", F.col("fact").alias("item"), "score")
    # Only pooled facts can be picked, so only their neighbours are looked for.
    near = G.knn(e.join(facts.select(F.col("item").alias("id")).distinct(), "id", "left_semi"), e)
    picked = A.pick(facts, near, 20)
    # A query whose themes leave no fact has its nearest one.
    lonely = pool.filter("rank = 1").join(picked.select("query_id").distinct(), "query_id", "left_anti")
    best = written(picked.unionByName(lonely.select("query_id", F.col("fact").alias("item"), F.lit(1).cast("long").alias("step"))), f"{root}/best")
    episode = (F.col("id") % 97).cast("bigint").alias("episode")
    sources = e.select(F.col("id").alias("fact"), episode)
    vectors = G.centroids(e.select("id", "v", episode), "episode").select("episode", F.col("centroid").alias("v"))
    taken = best.select("query_id", F.col("item").alias("fact"))
    parents = taken.join(pool, ["query_id", "fact"]).join(sources, "fact").select("query_id", "episode", "norm")
    probes = A.episode_priority(A.episode_pool(taken, sources, q, vectors), parents)
    context = _named(chosen, "theme", "item").join(_named(best, "fact", "item"), "query_id").select("query_id", F.concat_ws("\n", "theme", "fact").alias("context"))
    question = F.concat(F.lit("query "), F.col("query_id").cast("string"))
    probes = probes.join(context, "query_id").withColumns({"question": question, "text": F.concat(F.lit("episode "), F.col("episode").cast("string"))})
    episodes = A.gate(written(A.information_gain(probes, uncertainty), f"{root}/gains"))
    # Every row counts alike, so the score is 1; an episode says whether its messages are to be shown too.
    row = lambda d, kind, item, rank: d.select("query_id", F.lit(kind).alias("kind"), F.col(item).cast("long").alias("item"), F.col(rank).cast("long").alias("rank"), F.lit(1.0).alias("score"), (F.col("expand") if kind == "episodic" else F.lit(None).cast("boolean")).alias("expand"))
    return row(chosen, "theme", "item", "step").unionByName(row(best, "semantic", "item", "step")).unionByName(row(episodes, "episodic", "episode", "rank"))


def theme_build(spark, sf_dir):
    """Themes of all documents' hashed vectors, user by user."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("user_id"), F.col("doc_id").alias("fact"), "text")
    return themes.build_themes(providers.embedded(d, "text", "v").select("user_id", "fact", "v"))


def theme_counts(spark, sf_dir):
    """Facts of each user in all themes of the build."""
    return themes.theme_counts(theme_build(spark, sf_dir)).select("user_id", "facts")


def semantic_dedup(spark, sf_dir):
    """Facts that repeat an accepted one of their theme."""
    e = _vecs(spark, sf_dir).select(F.lit("all").alias("user_id"), F.col("theme").alias("kind"), F.col("id").alias("fact"), "v")
    return themes.greedy_dedup(e, 0.3)


def _graph(spark, sf_dir):
    n, c, o = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    k = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    nodes = (
        table(spark, sf_dir, "region").select(k("r", "r_regionkey").alias("node"), F.lit(3).alias("level"))
        .unionByName(n.select(k("n", "n_nationkey").alias("node"), F.lit(2).alias("level")))
        .unionByName(c.select(k("c", "c_custkey").alias("node"), F.lit(1).alias("level")))
        .unionByName(o.select(k("o", "o_orderkey").alias("node"), F.lit(0).alias("level")))
    )
    e = lambda d, a, b, kind: d.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"), F.lit(0).alias("seq"))
    edges = (
        e(n, k("n", "n_nationkey"), k("r", "n_regionkey"), "abstracted_by")
        .unionByName(e(c, k("c", "c_custkey"), k("n", "c_nationkey"), "supports"))
        .unionByName(e(o, k("o", "o_orderkey"), k("c", "o_custkey"), "belongs_to"))
    )
    return nodes, hierarchy.simple_edges(edges)


def graph_build(spark, sf_dir):
    return _graph(spark, sf_dir)[1].groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("a").alias("firsts"))


def graph_report(spark, sf_dir):
    return hierarchy.report(*_graph(spark, sf_dir))


def graph_upsert(spark, sf_dir):
    """Nations are there; customers' names come as new nodes and nations' texts are replaced."""
    n = table(spark, sf_dir, "nation")
    old = n.select(F.col("n_nationkey").cast("long").alias("node_id"), F.lit(2).alias("level"), F.col("n_nationkey").cast("long").alias("raw_id"), F.col("n_name").alias("text"))
    new = n.select(F.lit(2).alias("level"), F.col("n_nationkey").cast("long").alias("raw_id"), F.concat(F.lit("nation "), "n_name").alias("text")).unionByName(table(spark, sf_dir, "customer").select(F.lit(1).alias("level"), F.col("c_custkey").alias("raw_id"), F.col("c_name").alias("text")))
    return hierarchy.upsert_nodes(old, new)


def theme_consistency(spark, sf_dir):
    """Documents as facts, labels' toxic and quality marks as themes."""
    m = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("fact"), F.explode(F.array(F.lit("quality"), F.when(F.col("toxic") == 1, F.lit("toxic")))).alias("theme")).filter("theme is not null")
    return hierarchy.theme_consistency(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fact")), m)


def _answers(spark, sf_dir):
    """Each conversation turn answers the one before it."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("predicted")).join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), "role", F.col("text").alias("gold")), ["conv_id", "turn"])


def qa_f1(spark, sf_dir):
    return _round(evaluation.scored(_answers(spark, sf_dir)).select("conv_id", "turn", "exact", "f1", "bleu1"), "f1", "bleu1")


def metric_aggregate(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.lit("chars").alias("metric"), F.col("lang").alias("category"), F.col("n_chars").cast("double").alias("value"))
    return evaluation.aggregate(d)


def run_compare(spark, sf_dir):
    """Even and odd turns of a conversation as two runs, by length."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", F.col("turn").alias("seq"), F.length("text").alias("value"))
    return evaluation.compare(c.filter("seq % 2 = 0"), c.filter("seq % 2 = 1"), ["conv_id", "role"], "value")


_E = "SELECT vec_id AS id, embedding::DOUBLE[] AS v, label AS theme FROM embeddings"
_P = "list_cosine_similarity(a.v, b.v)"
_C = f"e AS ({_E}), x AS (SELECT theme, unnest(v) AS x, unnest(generate_series(0, len(v) - 1)) AS i FROM e), cd AS (SELECT theme, i, avg(x) AS x, count(*) AS n FROM x GROUP BY theme, i), c AS (SELECT theme, max(n) AS n, list(x ORDER BY i) AS v FROM cd GROUP BY theme)"
_PAIRS = "WITH e AS ({e}) SELECT a.id AS a, b.id AS b, round({p}, 6) AS sim FROM e a JOIN e b ON a.id < b.id WHERE {p} {t}"
_KNN = f"WITH e AS ({_E}), s AS (SELECT a.id AS src, b.id AS dst, {_P} AS sim FROM e a JOIN e b ON a.id <> b.id{{w}}), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) AS rank FROM s) SELECT src, dst, round(sim, 6) AS sim, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10 AND sim > 0"
_M = "m AS (SELECT conv_id AS owner, turn AS seq, role, text AS content, TIMESTAMP '2024-01-01' + to_days(CAST(conv_id AS INT)) + to_minutes(turn) AS ts FROM conversations)"
_SEG = f"{_M}, g0 AS (SELECT *, (row_number() OVER (PARTITION BY owner ORDER BY seq) - 1) // 3 AS episode FROM m), g AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY owner, episode) AS size FROM g0) WHERE size >= 2)"
_EP = f"""{_SEG}, ep AS (SELECT owner, episode, count(*) AS message_count, min(ts) AS t0, max(ts) AS t1, arg_min(content, seq) AS f, arg_max(content, seq) AS l FROM g GROUP BY owner, episode),
te AS (SELECT owner, CAST(episode AS BIGINT) AS episode, message_count, 'Conversation ' || strftime(t0, '%Y-%m-%d %H:%M') || ' (' || message_count || ' messages)' AS title,
 'From ' || strftime(t0, '%Y-%m-%d %H:%M') || ' to ' || strftime(t1, '%Y-%m-%d %H:%M') || '. First: ' || substr(f, 1, 100) || CASE WHEN length(f) > 100 THEN '...' ELSE '' END || ' Last: ' || substr(l, 1, 100) || CASE WHEN length(l) > 100 THEN '...' ELSE '' END AS content FROM ep)"""
_POOL = f"""e AS ({_E}), s AS (SELECT a.id AS query_id, b.id AS fact, {_P} AS score FROM e a JOIN e b ON a.id % 50 = 0),
sp AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM s GROUP BY query_id),
pool AS (SELECT s.query_id, fact, score, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END AS norm, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fact) AS rank FROM s) s JOIN sp ON s.query_id = sp.query_id WHERE rank <= 40)"""
_TOK = "list_filter(regexp_split_to_array(trim(translate(lower({c}), '.,!?', '    ')), '\\s+'), lambda t: t <> '')"

QUERIES = {
    f.__name__: f
    for f in (
        vec_distance_metrics, vec_normalize, knn_graph_full, knn_graph_incremental, theme_knn, threshold_pairs, threshold_pairs_cells, threshold_components, theme_centroids, theme_mean_intra, theme_cohesion, theme_objective, theme_assign_step,
        theme_merge_candidates, semantic_dup_pairs, segment_by_size, segment_by_gap, conversation_text, episode_fallback, episode_validate, buffer_stats, buffer_eviction, upsert_absent, hier_pool,
        hier_candidate_themes, hier_episode_priority, ig_gate, hier_search, theme_build, theme_counts, semantic_dedup, graph_build, graph_report, graph_upsert, theme_consistency, qa_f1, metric_aggregate, run_compare,
    )
}
ORACLES = {
    "vec_distance_metrics": f"WITH e AS ({_E}) SELECT b.id, round({_P}, 6) AS cos, round(list_distance(a.v, b.v), 6) AS euclid, round(list_sum([abs(x[1] - x[2]) for x in list_zip(a.v, b.v)]), 6) AS manhattan FROM e a JOIN e b ON b.id = a.id + 1",
    "vec_normalize": f"WITH e AS ({_E}), n AS (SELECT id, v, sqrt(list_sum([x * x for x in v])) AS n FROM e) SELECT id, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS length, round(v[1] / n, 6) AS first FROM n",
    "knn_graph_full": _KNN.format(w=""),
    "knn_graph_incremental": _KNN.format(w=" AND a.theme = 9"),
    "theme_knn": f"WITH {_C}, s AS (SELECT a.theme AS src, b.theme AS dst, {_P} AS sim FROM c a JOIN c b ON a.theme <> b.theme), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) AS rank FROM s) SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, round(sim, 6) AS sim, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 3 AND sim > 0",
    "threshold_pairs": _PAIRS.format(e=_E, p=_P, t=">= 0.35"),
    "threshold_pairs_cells": _PAIRS.format(e=_E, p=_P, t=">= 0.35"),
    "threshold_components": f"WITH RECURSIVE e AS ({_E}), p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id <> b.id WHERE {_P} >= 0.35), w AS (SELECT id, id AS c FROM e UNION SELECT p.b, w.c FROM w JOIN p ON w.id = p.a) SELECT id, min(c) AS component FROM w GROUP BY id",
    "theme_centroids": f"WITH {_C} SELECT theme, n, CAST(i AS INT) AS i, round(x, 6) AS x FROM cd",
    "theme_mean_intra": f"WITH e AS ({_E}) SELECT theme, round((sum(sim) - m) / (m * (m - 1) + 1e-6::DOUBLE), 6) AS mean_intra FROM (SELECT a.theme, {_P} AS sim, n.m FROM e a JOIN e b ON a.theme = b.theme JOIN (SELECT theme, count(*) AS m FROM e GROUP BY theme) n ON a.theme = n.theme) GROUP BY theme, m",
    "theme_cohesion": f"WITH {_C} SELECT a.theme, round(avg({_P}), 6) AS cohesion FROM e a JOIN c b ON a.theme = b.theme GROUP BY a.theme",
    "theme_objective": f"""WITH {_C}, co AS (SELECT a.theme, avg({_P}) AS cohesion FROM e a JOIN c b ON a.theme = b.theme GROUP BY a.theme),
s AS (SELECT a.theme, a.n, max({_P}) AS s FROM c a JOIN c b ON a.theme <> b.theme GROUP BY a.theme, a.n), m AS (SELECT median(s) AS m FROM s), d AS (SELECT s.*, m, abs(s - m) AS dev FROM s, m), g AS (SELECT median(dev) + 1e-8::DOUBLE AS sigma FROM d),
o AS (SELECT count(*) AS k, sum(n)::DOUBLE AS al, sum(n * n)::DOUBLE AS sq, avg(cohesion * exp(-(s - m) * (s - m) / (2 * sigma * sigma))) AS sem FROM d JOIN co ON d.theme = co.theme, g)
SELECT k, round(al / k * al / sq, 6) AS sparsity, round(sem, 6) AS sem, round(al / k * al / sq + sem, 6) AS f FROM o""",
    "theme_assign_step": f"WITH {_C}, s AS (SELECT a.id, b.theme, {_P} AS sim FROM e a, c b), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, theme) AS r FROM s) SELECT id, CASE WHEN sim >= 0.2 THEN theme END AS theme, round(sim, 6) AS sim, CASE WHEN sim >= 0.3 THEN 'attach' WHEN sim >= 0.2 THEN 'lenient' ELSE 'new' END AS decision FROM r WHERE r = 1",
    "theme_merge_candidates": f"WITH {_C} SELECT a.theme AS a, b.theme AS b, round({_P}, 6) AS sim FROM c a JOIN c b ON a.theme < b.theme WHERE {_P} >= 0",
    "semantic_dup_pairs": _PAIRS.format(e=_E, p=_P, t="> 0.3 AND a.theme = b.theme"),
    "segment_by_size": f"WITH {_SEG} SELECT owner, seq, CAST(episode AS BIGINT) AS episode FROM g",
    "segment_by_gap": "WITH e AS (SELECT user_id AS owner, event_id AS seq, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events), c AS (SELECT owner, seq, CAST(sum(CASE WHEN floor(epoch(ts)) - floor(epoch(b)) > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY seq) AS BIGINT) AS episode FROM e) SELECT owner, episode, count(*) AS n, min(seq) AS first_seq FROM c GROUP BY owner, episode",
    "conversation_text": "SELECT conv_id AS owner, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text, count(*) AS n_messages FROM conversations GROUP BY conv_id",
    "episode_fallback": f"WITH {_EP} SELECT owner, episode, title, content, message_count FROM te",
    "episode_validate": f"WITH {_EP} SELECT length(trim(title)) > 0 AND length(trim(content)) > 0 AND message_count > 0 AS valid, count(*) AS n FROM te GROUP BY 1",
    "buffer_stats": "SELECT conv_id AS owner, count(*) AS n, count(*) >= 2 AS ready, count(*) >= 5 AS full FROM conversations GROUP BY conv_id",
    "buffer_eviction": "SELECT * FROM (SELECT user_id AS owner, round((floor(epoch(TIMESTAMP '2024-02-01')) - floor(epoch(max(ts)))) / 3600, 6) AS age_hours FROM events GROUP BY user_id) WHERE age_hours > 24",
    "upsert_absent": "SELECT sha256(text) AS text_id, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "hier_pool": f"WITH {_POOL} SELECT query_id, fact, round(score, 6) AS score, round(norm, 6) AS norm, CAST(rank AS BIGINT) AS rank FROM pool",
    "hier_candidate_themes": f"WITH {_POOL}, {_C[_C.index('x AS') :]}, t AS (SELECT DISTINCT query_id, theme FROM pool JOIN e ON pool.fact = e.id) SELECT t.query_id, t.theme, round({_P}, 6) AS score FROM t JOIN e a ON a.id = t.query_id JOIN c b ON b.theme = t.theme",
    "hier_episode_priority": f"""WITH {_POOL}, o AS (SELECT query_id, fact % 97 AS episode, max(score) AS score, max(norm) AS parent FROM pool GROUP BY 1, 2),
q AS (SELECT *, (score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1e-6 END + 0.5::DOUBLE * parent AS priority FROM o WINDOW w AS (PARTITION BY query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(priority, 9) DESC, episode) AS rank FROM q)
SELECT query_id, episode, round(priority, 6) AS priority, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10""",
    "ig_gate": """WITH p AS (SELECT vec_id // 10 AS query_id, vec_id AS episode, vec_id % 10 + 1 AS rank, ((vec_id * 37) % 100) / 100.0::DOUBLE - 0.5::DOUBLE AS ig FROM embeddings),
l AS (SELECT *, ig <= -0.40::DOUBLE AS low, sum((ig <= -0.40::DOUBLE)::INT) OVER w AS lows, sum((ig > -0.40::DOUBLE)::INT) OVER w AS picked FROM p WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
z AS (SELECT *, min(CASE WHEN low AND (rank <= 3 OR lows >= 2 AND rank <= 10) OR NOT low AND picked >= 6 THEN rank END) OVER (PARTITION BY query_id) AS stop FROM l),
k AS (SELECT *, NOT low AND (stop IS NULL OR rank <= stop) AS ok FROM z), y AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS chosen FROM k)
SELECT query_id, episode, rank, ok AND ig > 0.25::DOUBLE AS expand FROM y WHERE ok OR NOT chosen AND rank = 1""",
    "theme_counts": "SELECT source AS user_id, count(*) AS facts FROM documents GROUP BY source",
    "graph_build": "SELECT 'abstracted_by' AS kind, count(*) AS edges, count(DISTINCT n_nationkey) AS firsts FROM nation UNION ALL SELECT 'supports', count(*), count(DISTINCT c_custkey) FROM customer UNION ALL SELECT 'belongs_to', count(*), count(DISTINCT o_custkey) FROM orders",
    "graph_report": """WITH n AS (SELECT 'r' || r_regionkey AS node, 3 AS level FROM region UNION ALL SELECT 'n' || n_nationkey, 2 FROM nation UNION ALL SELECT 'c' || c_custkey, 1 FROM customer UNION ALL SELECT 'o' || o_orderkey, 0 FROM orders),
e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
d AS (SELECT node, count(*) AS d FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node), g AS (SELECT level, coalesce(d, 0) AS d FROM n LEFT JOIN d ON n.node = d.node)
SELECT level, count(*) AS nodes, min(d) AS min_degree, max(d) AS max_degree, round(avg(d), 6) AS avg_degree, round(median(d), 6) AS median_degree FROM g GROUP BY level""",
    "graph_upsert": "SELECT n_nationkey::BIGINT AS node_id, 2 AS level, n_nationkey::BIGINT AS raw_id, 'nation ' || n_name AS text FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY c_custkey), 1, c_custkey, c_name FROM customer",
    "theme_consistency": "SELECT themes, count(*) AS facts FROM (SELECT CASE WHEN l.doc_id IS NULL THEN '0' WHEN toxic = 1 THEN '>1' ELSE '1' END AS themes FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY themes",
    "qa_f1": f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS pt, b.text AS gt, {_TOK.format(c='a.text')} AS p, {_TOK.format(c='b.text')} AS g FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
q AS (SELECT *, len(list_intersect(list_distinct(p), list_distinct(g))) AS shared, len(list_distinct(p)) AS np, len(list_distinct(g)) AS ng, coalesce(list_sum([least(len(list_filter(p, lambda y: y = t)), len(list_filter(g, lambda y: y = t))) for t in list_distinct(p)]), 0) AS hits FROM p)
SELECT conv_id, turn, CAST(lower(trim(pt)) = lower(trim(gt)) AS INT) AS exact, round(CASE WHEN shared = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * shared / (np + ng) END, 6) AS f1,
 round(CASE WHEN len(p) = 0 THEN 0.0::DOUBLE ELSE hits::DOUBLE / len(p) * CASE WHEN len(p) > len(g) THEN 1.0::DOUBLE ELSE exp(1 - len(g)::DOUBLE / len(p)) END END, 6) AS bleu1 FROM q""",
    "metric_aggregate": "SELECT 'chars' AS metric, lang AS category, round(avg(n_chars), 6) AS mean, round(coalesce(stddev_samp(n_chars), 0), 6) AS std, round(median(n_chars), 6) AS median, round(min(n_chars)::DOUBLE, 6) AS min, round(max(n_chars)::DOUBLE, 6) AS max, count(*) AS count FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang))",
    "run_compare": """WITH l AS (SELECT conv_id, role, arg_max(length(text), turn) AS l FROM conversations WHERE turn % 2 = 0 GROUP BY 1, 2), r AS (SELECT conv_id, role, arg_max(length(text), turn) AS r FROM conversations WHERE turn % 2 = 1 GROUP BY 1, 2)
SELECT conv_id, role, CAST(l AS INT) AS l, CAST(r AS INT) AS r, CASE WHEN r IS NULL THEN 'only_left' WHEN l IS NULL THEN 'only_right' WHEN l > r THEN 'better' WHEN l < r THEN 'worse' ELSE 'equal' END AS outcome FROM l FULL JOIN r USING (conv_id, role)""",
}
