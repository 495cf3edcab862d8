"""Quality rules of documents, and host verdicts by an empirical beta prior.

Each document gets counts and rule failures in one pass. A host (the source
column) gets the number of its documents and of those that fail. The failure
rates of all hosts give a beta prior by moments, less the share of their
spread that chance alone makes; a host's rate is shrunk towards the prior's
mean by the prior's weight. A host is refused, with all its documents, where
the lower quantile of its posterior is above one half and above the prior's
mean: most of its documents fail, not by chance, and it is worse than the
corpus. A document is kept if it does not fail and its host
is not refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import SPACE, scratch, text_of, written


@dataclass(frozen=True)
class Params:
    min_words: int = 50
    #: Percent of words in repeated 3-word windows.
    max_repeat: int = 50
    #: Symbols for each 100 words; more fails the document.
    max_symbols: int = 50
    #: Percent of lines that repeat an earlier one; more fails the document.
    max_dup_lines: int = 50
    #: A host is refused if its failure rate is above this and above the corpus's...
    max_host_rate: float = 0.5
    #: ...by so many standard deviations of its posterior: with a probability of 97.5 %, about.
    deviations: float = 1.96
    #: Bounds of the correlation of failures within hosts; the prior weighs 1 / correlation - 1 documents.
    min_correlation: float = 0.001
    max_correlation: float = 0.5
    #: Parts that a host's documents are dealt to, in the counts and in the join back.
    salts: int = 32


def counts(docs: DataFrame, text: Column) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words of the text."""
    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))
    d = docs.withColumns(
        {
            "_w": F.array_remove(F.split(text, rf"[{SPACE}]+"), ""),
            "_l": worded,
            "word_chars": F.length(F.array_join(F.split(text, rf"[{SPACE}]+"), "")).cast("bigint"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint"),
        }
    )
    d = d.withColumns(
        {
            "n_words": F.size("_w").cast("bigint"),
            "n_lines": F.size("_l").cast("bigint"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"),
            "_h": F.transform("_w", lambda x: F.xxhash64(x)),
        }
    ).drop("_w", "_l")
    # Windows sorted by hash: equal ones are neighbours.
    d = d.withColumn("_g", F.array_sort(F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2)).alias("h"), i.alias("i"))))).drop("_h")
    same = lambda x, i, j: F.coalesce(F.get("_g", j)["h"] == x["h"], F.lit(False))
    d = d.withColumn("_s", F.array_sort(F.transform(F.filter("_g", lambda x, i: same(x, i, i + 1) | F.when(i > 0, same(x, i, i - 1)).otherwise(False)), lambda x: x["i"]))).drop("_g")
    # A window covers 3 words, or up to the next window's start.
    return d.withColumn(
        "n_repeat_words",
        F.aggregate(F.zip_with(F.col("_s"), F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda s, x: s + x).cast("bigint"),
    ).drop("_s")


def base_failed(p: Params) -> Column:
    return (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat * F.col("n_words"))


def failed(p: Params) -> Column:
    """The method's own rules, besides base_failed."""
    return (100 * F.col("n_symbols") > p.max_symbols * F.col("n_words")) | (100 * F.col("n_dup_lines") > p.max_dup_lines * F.col("n_lines"))


def host_verdicts(parts: DataFrame, p: Params, host: str = "_host") -> DataFrame:
    """host, n, bad, rate (shrunk), host_ok; parts has host, n and bad, in any number of rows a host.

    The prior's mean m is the share of all documents that fail. With K hosts
    of n documents each, N in all, the spread S = sum n (bad / n - m)^2 is
    m (1 - m) ((K - 1) (1 - r) + r (N - sum n^2 / N)) on average, where r is
    the correlation of failures within a host; that gives r, and the weight
    1 / r - 1. Hosts of one document each tell nothing of r, which is then
    the least: a host is shrunk almost wholly.
    """
    by = parts.groupBy(host).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    sums = by.agg((F.sum("bad") / F.sum("n")).alias("m"), F.sum("n").alias("N"), F.count(F.lit(1)).alias("K"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("of_bad"))
    m, chance = F.col("m"), F.col("K") - 1
    known = F.col("N") - F.col("squares") / F.col("N") - chance
    r = F.when((m > 0) & (m < 1) & (known > 1e-9), ((F.col("of_bad") - F.col("N") * m * m) / (m * (1 - m)) - chance) / F.when(known > 1e-9, known).otherwise(1.0)).otherwise(0.0)
    prior = sums.select("m", (1 / F.least(F.lit(p.max_correlation), F.greatest(F.lit(p.min_correlation), r)) - 1).alias("weight"))
    d = by.crossJoin(F.broadcast(prior)).withColumn("rate", (F.col("bad") + F.col("weight") * F.col("m")) / (F.col("n") + F.col("weight")))  # prior: one row
    low = F.col("rate") - p.deviations * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("weight") + 1))
    return d.withColumn("host_ok", low <= F.greatest(F.lit(p.max_host_rate), F.col("m")))


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "kept"]


def quality_rules(docs: DataFrame, p: Params = Params(), host: str = "source", keep_text: bool = True) -> DataFrame:  # noqa: B008
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate and kept.

    A null or empty text has no words and fails; a null host is a host of its
    own. Rows are judged each on its own, repeated ones too. Columns of docs
    with the names of results are replaced, all others are kept whatever
    their names. The counts are made in one narrow pass and written to the
    shared folder, with the text only if keep_text; hosts are judged from that
    table, so no text, however long, is shuffled or counted twice.
    """
    stay = [c for c in docs.columns if c.lower() not in RESULTS and (keep_text or c.lower() != "text")]
    # The input's columns are in one struct, so none meets a name used here.
    d = docs.select(F.struct(*(docs[c] for c in stay), F.lit(0).alias("\0")).alias("_in"), text_of(docs).alias("_text"), F.coalesce(docs[host].cast("string"), F.lit("\0none")).alias("_host"))
    d = counts(d, F.col("_text")).drop("_text").withColumn("base_failed", base_failed(p)).withColumn("_own", failed(p))
    # One host may have a third of all rows: its documents are counted and joined back in parts, dealt by a number that is written with them.
    d = d.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(p.salts)))
    d = written(d, f"{scratch(docs.sparkSession, 'quality')}/counts")
    parts = d.groupBy("_host", "_salt").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("base_failed") | F.col("_own")).cast("bigint")).alias("bad"))
    judged = host_verdicts(parts, p).select("_host", F.col("rate").alias("host_rate"), F.col("host_ok").alias("_host_ok"))
    verdicts = parts.join(judged, "_host").select(F.col("_host").alias("_of"), F.col("_salt").alias("_part"), "host_rate", "_host_ok")
    out = d.join(verdicts, (d["_host"] == verdicts["_of"]) & (d["_salt"] == verdicts["_part"]), "left")
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.col("_own") & F.coalesce("_host_ok", F.lit(True)))
    return out.select(*(F.col(f"_in.`{c}`").alias(c) for c in stay), *RESULTS)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op5_quality_rules(spark, sf_dir):
    """The rules over all documents, in the contract's columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return quality_rules(docs, keep_text=False).select(*COLUMNS)


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 3)),
s AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM s) GROUP BY doc_id),
c AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 50 * n_words OR 100 * n_dup_lines > 50 * n_lines AS own FROM c),
h AS (SELECT source, count(*) AS n, sum((base_failed OR own)::INT)::DOUBLE AS bad FROM f GROUP BY source),
m AS (SELECT sum(bad) / sum(n) AS m, sum(n) AS docs, count(*) - 1 AS chance, sum(n::DOUBLE * n) / sum(n) AS squares, sum(bad * bad / n) AS of_bad FROM h),
r AS (SELECT m, CASE WHEN m > 0 AND m < 1 AND docs - squares - chance > 1e-9
  THEN ((of_bad - docs * m * m) / (m * (1 - m)) - chance) / (docs - squares - chance) ELSE 0 END AS r FROM m),
p AS (SELECT m, 1 / least(0.5, greatest(0.001, r)) - 1 AS weight FROM r),
v AS (SELECT source, m, n + weight + 1 AS size, (bad + weight * m) / (n + weight) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT own AND rate - 1.96 * sqrt(rate * (1 - rate) / size) <= greatest(0.5, m) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""
