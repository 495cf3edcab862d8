"""Secret scan: patterns, and two character Markov models.

One model is of random strings, one of ordinary identifiers. Both are
bigram counts over the ASCII characters of a token's alphabet, trained from
labelled samples: a table of (value, random), which a caller may give. By
default the whole corpus is labelled by what its patterns find: access keys,
hex runs, and assigned values that mix digits with letters are random, words
of letters are ordinary. A long token is a secret where the log-likelihood
ratio of the models, per character, is above a threshold over the whole
token, or else in those stretches of it where it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import scratch, sha256_hex, text_of, written
from loomstone.llm.spans import matches, spelled

KINDS = ["assign", "access", "hex", "random"]
_TOKEN = "[A-Za-z0-9+/_=-]"
_KEYWORD = "(?i:password|passwd|secret|token|api_?key)"
_ASSIGN = rf"{_KEYWORD}[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.=-]++"
_VALUE = rf"^{_KEYWORD}[\"']?+\x20*+[:=]\x20*+[\"']?+([A-Za-z0-9+/_.=-]++)$"


@dataclass(frozen=True)
class Params:
    #: Characters of a token, and of a stretch of it, that the models judge.
    min_length: int = 20
    #: Log-likelihood ratio per character, in nats.
    min_ratio: float = 0.5
    #: Words of letters from this length are samples of ordinary identifiers, unless so many letters in a row are to be judged themselves.
    min_word: int = 6


def _patterns(t: Column, p: Params) -> dict[str, tuple[str, Column]]:
    return {
        "assign": (_ASSIGN, t.rlike(_KEYWORD)),
        "access": (r"AKIA[A-Z0-9]++", t.contains("AKIA")),
        # The whole runs of 24 or more; shorter ones fail anyway.
        "hex": (r"[0-9a-f]{24,}+", t.rlike("[0-9a-f]{24}")),
        "random": (rf"{_TOKEN}{{{p.min_length},}}+", t.rlike(rf"{_TOKEN}{{{p.min_length}}}")),
    }


def candidates(docs: DataFrame, p: Params) -> DataFrame:
    """rk, doc_id, kind, start, end, value: matches that hold; nulls for a document of none."""
    d = docs.select(F.monotonically_increasing_id().alias("rk"), F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    found = matches(d, "text", _patterns(F.col("text"), p), ["rk", "doc_id"])
    m, kind = F.col("match"), F.col("kind")
    value = F.when(kind == 0, F.regexp_extract(m, _VALUE, 1)).otherwise(m)
    ok = F.when(kind == 0, F.length(value) >= 6).when(kind == 1, F.length(m) >= 20).otherwise(True)
    bad = kind.isNotNull() & ~ok
    return found.select("rk", "doc_id", *(F.when(~bad, c).alias(n) for n, c in (("kind", kind), ("start", F.col("start")), ("end", F.col("end")), ("value", value))))


def corpus_samples(found: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """value, random: the labelled samples that come without any from outside, each once.

    An assigned value of letters or of digits alone is no sample: it may be a
    word, a name or a date.
    """
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    secret = found.filter((F.col("kind").isin(1, 2)) | ((F.col("kind") == 0) & mixed)).select("value")
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text_of(docs), F.lit(f"[A-Za-z_]{{{p.min_word},}}+"), F.lit(0)))).alias("value")).filter(~F.col("value").rlike(f"[A-Za-z]{{{p.min_length}}}")).groupBy("value").agg(F.lit(1).alias("one")).select("value")
    # Letters within a base match are no ordinary word.
    within = found.filter("kind < 3").select(F.explode(F.split("value", "[^A-Za-z_]+")).alias("value")).distinct()
    return secret.distinct().withColumn("random", F.lit(True)).unionByName(words.join(within, "value", "left_anti").withColumn("random", F.lit(False)))


def models(samples: DataFrame, root: str) -> DataFrame:
    """gram, ratio: log P(second | first) under the random model less that under the ordinary one.

    At most a row for each pair of the 66 characters of tokens, whatever the
    samples, so the table may be broadcast. Counts start at one half. Ordinary
    words have no + / = -, so pairs with one of these tell nothing: ratio 0.
    """
    spark = samples.sparkSession
    a = F.split(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), "")
    grid = spark.range(1).select(F.explode(F.flatten(F.transform(a, lambda x: F.transform(a, lambda y: F.concat(x, y))))).alias("gram"), F.lit(0).alias("s"), F.lit(0).alias("o"))
    chars = F.split("value", "")
    grams = samples.select("random", F.explode(F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1))), lambda x, y: F.concat(x, y))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count_if("random").alias("s"), F.count_if(~F.col("random")).alias("o")).unionByName(grid)
    counts = written(counts.groupBy("gram").agg((F.sum("s") + 0.5).alias("s"), (F.sum("o") + 0.5).alias("o")).filter(F.col("gram").rlike(f"^{_TOKEN}{{2}}$")), f"{root}/bigrams")
    first = counts.groupBy(F.substring("gram", 1, 1).alias("first")).agg(F.sum("s").alias("ss"), F.sum("o").alias("oo"))
    ratio = F.when(F.col("gram").rlike("[+/=-]"), 0.0).otherwise(F.log(F.col("s") / F.col("ss")) - F.log(F.col("o") / F.col("oo")))
    return counts.join(F.broadcast(first), F.substring("gram", 1, 1) == F.col("first")).select("gram", ratio.alias("ratio"))


def _stretches(tokens: DataFrame, ratios: DataFrame, p: Params) -> DataFrame:
    """token, at, array of (from, to): the random stretches of tokens (token, value); tokens of none are left out.

    One stretch is the whole token if its mean ratio is high enough; else all
    windows of min_length characters whose mean is, overlapping ones as one.
    """
    chars = F.split("value", "")
    grams = tokens.select("token", F.posexplode(F.zip_with(chars, F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, b))).alias("i", "gram"))
    n = p.min_length - 1
    along = Window.partitionBy("token").orderBy("i")
    d = grams.join(F.broadcast(ratios), "gram").withColumn("mean", F.avg("ratio").over(along.rowsBetween(1 - n, 0)))
    d = d.withColumn("good", (F.col("i") >= n - 1) & (F.col("mean") >= p.min_ratio))
    last = F.max(F.when(F.col("good"), F.col("i"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("new", (F.col("good") & (last.isNull() | (F.col("i") - last > p.min_length))).cast("int")).withColumn("part", F.sum("new").over(along))
    # The rows before the first good window are part 0; they count in the token's mean alone.
    parts = d.groupBy("token", "part").agg(F.sum("ratio").alias("ratio"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("good"), F.col("i"))).alias("lo"), F.max(F.when(F.col("good"), F.col("i"))).alias("hi"))
    part = F.when(F.col("lo").isNotNull(), F.struct((F.col("lo") - n + 1).cast("bigint").alias("from"), (F.col("hi") + 2).cast("bigint").alias("to")))
    t = parts.groupBy("token").agg((F.sum("ratio") / F.sum("n")).alias("mean"), F.sum("n").alias("n"), F.collect_list(part).alias("at"))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("from"), (F.col("n") + 1).alias("to")))
    return t.select("token", F.when(F.col("mean") >= p.min_ratio, whole).otherwise(F.col("at")).alias("at")).filter(F.size("at") > 0)


def find_secrets(docs: DataFrame, p: Params = Params(), samples: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """One row per row of docs: rk, doc_id, base and spans, sorted arrays of (start, kind, end); kind is the place in KINDS.

    A null text is empty and has no spans; rows of equal or null doc_id stay
    apart; other columns are not read. A very long text is searched whole, in
    time in proportion to its length. Spans of kind random do not touch base
    ones. samples (value string, random boolean) are what the models are
    trained from; those of the corpus where it is not given.
    """
    root = scratch(docs.sparkSession, "secrets")
    found = written(candidates(docs, p), f"{root}/candidates")
    # A digest names a token: its value may be long and would be in the row of each of its pairs.
    runs = found.filter("kind = 3").withColumn("token", F.md5("value"))
    judged = _stretches(runs.groupBy("token").agg(F.first("value").alias("value")), models(corpus_samples(found, docs, p) if samples is None else samples, root), p)
    random = runs.select("rk", "doc_id", "kind", "start", "token").join(judged, "token").select("rk", "doc_id", "kind", "start", F.explode("at").alias("at"))
    random = random.select("rk", "doc_id", "kind", (F.col("start") + F.col("at.from")).alias("start"), (F.col("start") + F.col("at.to")).alias("end"), F.lit(None).cast("string").alias("value"))
    every = found.filter("kind is null or kind < 3").unionByName(random)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    # A document whose only matches are judged ordinary stays, with nulls.
    others = found.filter("kind = 3").select("rk", "doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("kind", "int"), ("start", "bigint"), ("end", "bigint"), ("value", "string"))))
    d = every.unionByName(others).groupBy("rk", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    d = d.withColumn("base", F.filter("spans", lambda s: s["kind"] < 3))
    apart = F.filter("spans", lambda s: (s["kind"] < 3) | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return d.withColumn("spans", apart)


def op10_secrets(spark, sf_dir):
    """Secrets of all documents, in the contract's columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return find_secrets(docs).select("doc_id", *map(n, range(3)), sha256_hex(spelled(F.col("base"), KINDS)).alias("base_sha256"), spelled(F.col("spans"), KINDS).alias("spans"))
