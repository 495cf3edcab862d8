"""Queries that run the store, its files and the ingestion, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone import runtime
from loomstone.operators import retrieval
from loomstone.sources import store as S
from loomstone.sources.tables import table


def _rows(spark, kind, d):
    """d with the columns of a kind that it has not, as nulls."""
    empty = spark.createDataFrame([], S.SCHEMAS[kind])
    return d.select(*(F.col(f.name).cast(f.dataType) if f.name in d.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema))


def _facts(spark, sf_dir, key=None, user=None):
    d = table(spark, sf_dir, "documents")
    key = F.concat(F.lit("f"), F.col("doc_id").cast("string")) if key is None else key
    return _rows(spark, "semantic", d.select(key.alias("memory_id"), (F.col("source") if user is None else user).alias("user_id"), F.col("n_chars").cast("string").alias("content"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("created_at"), F.lit(0.5).alias("confidence")))


def _themes(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings")
    return _rows(spark, "themes", d.select(F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("theme_id"), F.concat(F.lit("u"), F.col("label").cast("string")).alias("user_id"), F.lit("").alias("summary"), F.col("embedding"), F.array(F.lit("a"), F.lit("b")).alias("semantic_ids"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("created_at")))


def _store(spark):
    return S.Store(spark, S.scratch(spark, "store"))


def store_add_absent(spark, sf_dir):
    """Facts by text: those of odd documents first, then all, of which only new texts are added."""
    s, d = _store(spark), _facts(spark, sf_dir, F.sha2(F.coalesce("text", F.lit("")), 256))
    odd = F.col("created_at").cast("long") % 2 == 1
    s.add_absent("semantic", d.filter(odd))
    s.add_absent("semantic", d)
    return s.read("semantic").select("memory_id", "user_id", "created_at")


def store_update(spark, sf_dir):
    """Labelled documents' facts get their quality; toxic ones move to another user; a key that is not there stays out."""
    s, d = _store(spark), _facts(spark, sf_dir)
    s.add_absent("semantic", d)
    labels = table(spark, sf_dir, "labels").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("memory_id"), "quality", "toxic")
    new = d.drop("content").join(labels, "memory_id").withColumn("content", F.concat(F.lit("q"), F.col("quality").cast("string"))).withColumn("user_id", F.when(F.col("toxic") == 1, "moved").otherwise(F.col("user_id")))
    s.update("semantic", _rows(spark, "semantic", new).unionByName(_rows(spark, "semantic", spark.range(1).select(F.lit("none").alias("memory_id"), F.lit("moved").alias("user_id"), F.lit("x").alias("content")))))
    return s.read("semantic").select("memory_id", "user_id", "content")


def store_delete(spark, sf_dir):
    """What stays without the facts of documents of quality 0."""
    s = _store(spark)
    s.add_absent("semantic", _facts(spark, sf_dir))
    s.delete("semantic", table(spark, sf_dir, "labels").filter("quality = 0").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("memory_id")))
    return s.read("semantic").select("memory_id", "user_id")


def store_delete_user(spark, sf_dir):
    """Statistics of what stays when a user goes whose id has signs that folder names escape."""
    s = _store(spark)
    s.add_absent("semantic", _facts(spark, sf_dir, user=F.concat("source", F.lit(":/% =x"))))
    s.delete_user("src0:/% =x")
    return s.stats("semantic")


def store_user_items(spark, sf_dir):
    """A user's facts, the newest first."""
    s = _store(spark)
    s.add_absent("semantic", _facts(spark, sf_dir))
    assert s.exists("semantic", "f1") and not s.exists("semantic", "none")
    d = s.of_user("semantic", "src1")
    return d.select("memory_id", "created_at")


def store_get(spark, sf_dir):
    """A fact by its key, in a store of all."""
    s = _store(spark)
    s.add_absent("semantic", _facts(spark, sf_dir))
    return s.get("semantic", "f7").select("memory_id", "user_id", "content")


def store_memory(spark, sf_dir):
    """The repository in the session does the same as the one in files."""
    s, d = S.MemoryStore(spark), _facts(spark, sf_dir)
    s.add_absent("semantic", d)
    s.delete("semantic", table(spark, sf_dir, "labels").filter("quality = 0").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("memory_id")))
    s.update("semantic", d.filter("user_id = 'src2'").withColumn("user_id", F.lit("src3")))
    s.delete_user("src1")
    return s.stats("semantic")


def hierarchy_scan(spark, sf_dir):
    """Every user's numbers of episodes, facts and themes."""
    s = _store(spark)
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("message_count"))
    s.add_absent("episodes", _rows(spark, "episodes", c.select(F.concat(F.lit("e"), F.col("conv_id").cast("string")).alias("episode_id"), F.concat(F.lit("src"), (F.col("conv_id") % 30).cast("string")).alias("user_id"), "message_count", F.lit("").alias("content"))))
    s.add_absent("semantic", _facts(spark, sf_dir))
    s.add_absent("themes", _themes(spark, sf_dir))
    return s.hierarchy()


def theme_sink(spark, sf_dir):
    """Themes with their vectors are written, some vectors replaced, others deleted."""
    s, t = _store(spark), _themes(spark, sf_dir)
    s.add_absent("themes", t)
    n = F.substring("theme_id", 2, 20).cast("long")
    s.update("themes", t.filter(n % 3 == 0).withColumn("embedding", F.transform("embedding", lambda x: F.lit(1.0).cast("float"))))
    s.delete("themes", t.filter(n % 5 == 0))
    return s.read("themes").select("theme_id", "user_id", F.size("embedding").alias("size"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


def _json(spark, rows, kind, array=False, broken=()):
    at = S.scratch(spark, "json")
    if array:
        # A file of one array, as older writers left it: a stated small set.
        rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("*"))), ","), F.lit("]"))).coalesce(1).write.text(at)
    else:
        S.write_json(rows, at)
    if broken:
        spark.createDataFrame([(x,) for x in broken], "value string").coalesce(1).write.mode("append").text(at)
    return S.read_json(spark, at, kind, array)


def semantic_json(spark, sf_dir):
    """Facts as JSON lines without their confidence, and lines that are empty or broken."""
    d = _facts(spark, sf_dir).withColumn("confidence", F.lit(None).cast("double"))
    return _json(spark, d, "semantic", broken=("", "   ", '{"memory_id": ', "[1]")).select("memory_id", "user_id", "content", "confidence", "revision_count")


def _episode_rows(spark, sf_dir):
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(F.lit(None).cast("string").alias("message_id"), x["role"].alias("role"), x["text"].alias("content"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("map<string,string>").alias("metadata")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(m.alias("original_messages"))
    return _rows(spark, "episodes", c.select(F.concat(F.lit("e"), F.col("conv_id").cast("string")).alias("episode_id"), F.lit("u").alias("user_id"), "original_messages", F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("created_at")))


def episode_json(spark, sf_dir):
    """Episodes as JSON lines without time and count, which the reader fills."""
    return _json(spark, _episode_rows(spark, sf_dir), "episodes", broken=("{",)).select("episode_id", "timestamp", "message_count", F.col("original_messages")[0]["role"].alias("first_role"))


def episode_json_array(spark, sf_dir):
    """The same, from one array."""
    return _json(spark, _episode_rows(spark, sf_dir), "episodes", array=True).select("episode_id", "timestamp", "message_count")


def theme_json(spark, sf_dir):
    """Themes as JSON lines without centroid and count."""
    return _json(spark, _themes(spark, sf_dir), "themes").select("theme_id", "member_count", F.round(F.col("centroid")[1].cast("double"), 5).alias("second"))


def results_json(spark, sf_dir):
    """Token statistics written as JSON and read back."""
    from loomstone.plans.support_queries import token_stats

    at = S.scratch(spark, "results")
    d = token_stats(spark, sf_dir)
    S.write_json(d, at)
    return spark.read.schema(d.schema).json(at)


def ingest_summary(spark, sf_dir):
    """Documents taken in language by language; one language fails twice, another for good."""
    s, d, seen = _store(spark), table(spark, sf_dir, "documents"), {}

    def load(part):
        lang = part.select("lang").first()[0]
        seen[lang] = seen.get(lang, 0) + 1
        if lang == "de" and seen[lang] < 3 or lang == "fr":
            raise ValueError(lang)
        s.add_absent("semantic", _rows(spark, "semantic", part.select(F.col("doc_id").cast("string").alias("memory_id"), F.col("lang").alias("user_id"), F.lit("").alias("content"))))

    langs = [r.lang for r in d.select("lang").distinct().orderBy("lang").collect()]  # a row a language
    return runtime.summary(spark, runtime.ingest(d, langs, load, "lang"))


def index_upkeep(spark, sf_dir):
    """An index of even documents takes all in, then loses a user's."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("user_id"), F.col("n_chars"))
    index = retrieval.upserted(d.filter("doc % 2 = 0").withColumn("n_chars", F.lit(-1).cast(d.schema["n_chars"].dataType)), d, "doc")
    return retrieval.without_user(index, spark.createDataFrame([("src3",)], "user_id string")).select("doc", "user_id", "n_chars")


_F = "f AS (SELECT 'f' || doc_id AS memory_id, source AS user_id, CAST(n_chars AS VARCHAR) AS content, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS created_at, doc_id FROM documents)"
_N = "sum(length(content)) AS chars, min(created_at) AS first, max(created_at) AS last"
QUERIES = {f.__name__: f for f in (store_add_absent, store_update, store_delete, store_delete_user, store_user_items, store_get, store_memory, hierarchy_scan, theme_sink, semantic_json, episode_json, episode_json_array, theme_json, results_json, ingest_summary, index_upkeep)}
ORACLES = {
    "store_add_absent": "SELECT sha256(coalesce(text, '')) AS memory_id, arg_min(source, (doc_id % 2 = 0)::INT * 1000000000000 + doc_id) AS user_id, lpad(CAST(min((doc_id % 2 = 0)::INT * 1000000000000 + doc_id) % 1000000000000 AS VARCHAR), 12, '0') AS created_at FROM documents GROUP BY 1",
    "store_update": f"WITH {_F} SELECT memory_id, CASE WHEN toxic = 1 THEN 'moved' ELSE user_id END AS user_id, coalesce('q' || quality, content) AS content FROM f LEFT JOIN labels l ON f.doc_id = l.doc_id",
    "store_delete": f"WITH {_F} SELECT memory_id, user_id FROM f WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "store_delete_user": f"WITH {_F} SELECT user_id || ':/% =x' AS user_id, count(*) AS items, CAST(sum(length(content)) AS BIGINT) AS chars, min(created_at) AS first, max(created_at) AS last FROM f WHERE user_id <> 'src0' GROUP BY user_id",
    "store_user_items": f"WITH {_F} SELECT memory_id, created_at FROM f WHERE user_id = 'src1' ORDER BY created_at DESC",
    "store_get": f"WITH {_F} SELECT memory_id, user_id, content FROM f WHERE memory_id = 'f7'",
    "store_memory": f"WITH {_F}, k AS (SELECT memory_id, CASE WHEN user_id = 'src2' THEN 'src3' ELSE user_id END AS user_id, content, created_at FROM f WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) SELECT user_id, count(*) AS items, CAST(sum(length(content)) AS BIGINT) AS chars, min(created_at) AS first, max(created_at) AS last FROM k WHERE user_id <> 'src1' GROUP BY user_id",
    "hierarchy_scan": """WITH e AS (SELECT 'src' || (conv_id % 30) AS user_id, count(*) AS episodes FROM (SELECT DISTINCT conv_id FROM conversations) GROUP BY 1), f AS (SELECT source AS user_id, count(*) AS facts FROM documents GROUP BY 1), t AS (SELECT 'u' || label AS user_id, count(*) AS themes FROM embeddings GROUP BY 1)
SELECT user_id, coalesce(episodes, 0) AS episodes, coalesce(facts, 0) AS facts, coalesce(themes, 0) AS themes, 2 * coalesce(themes, 0) AS theme_facts FROM e FULL JOIN f USING (user_id) FULL JOIN t USING (user_id)""",
    "theme_sink": "SELECT 't' || vec_id AS theme_id, 'u' || label AS user_id, CAST(len(embedding) AS INT) AS size, CASE WHEN vec_id % 3 = 0 THEN 1.0::DOUBLE ELSE round(embedding[1]::DOUBLE, 6) END AS first FROM embeddings WHERE vec_id % 5 <> 0",
    "semantic_json": f"WITH {_F} SELECT memory_id, user_id, content, 0.8::DOUBLE AS confidence, 1 AS revision_count FROM f",
    "episode_json": "SELECT 'e' || conv_id AS episode_id, lpad(CAST(conv_id AS VARCHAR), 12, '0') AS timestamp, CAST(count(*) AS INT) AS message_count, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id",
    "episode_json_array": "SELECT 'e' || conv_id AS episode_id, lpad(CAST(conv_id AS VARCHAR), 12, '0') AS timestamp, CAST(count(*) AS INT) AS message_count FROM conversations GROUP BY conv_id",
    "theme_json": "SELECT 't' || vec_id AS theme_id, 2 AS member_count, round(embedding[2]::DOUBLE, 5) AS second FROM embeddings",
    "results_json": "SELECT count(*) AS num_questions, CAST(sum(n) AS BIGINT) AS sum_tokens, round(avg(n), 6) AS avg_tokens FROM (SELECT CAST(trunc(c / 1.5::DOUBLE + (length(text) - c) / 4.0::DOUBLE) AS INT) AS n FROM (SELECT text, length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) AS c FROM benchmark))",
    "ingest_summary": "SELECT lang <> 'fr' AS success, count(*) AS parts, CAST(sum(CASE WHEN lang IN ('de', 'fr') THEN 3 ELSE 1 END) AS BIGINT) AS tries FROM (SELECT DISTINCT lang FROM documents) GROUP BY 1",
    "index_upkeep": "SELECT doc_id AS doc, source AS user_id, CASE WHEN doc_id % 2 = 0 THEN -1 ELSE n_chars END AS n_chars FROM documents WHERE source <> 'src3'",
}
