"""Scores of answers, their aggregates and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.text import simple_tokens


def _f1(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    p, r = both / F.nullif(F.size(a), F.lit(0)), both / F.nullif(F.size(b), F.lit(0))
    return F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 of the sets of simple tokens; 0 where either is empty."""
    return _f1(simple_tokens(predicted), simple_tokens(gold))


def shared(a: Column, b: Column) -> Column:
    """How many tokens two arrays share, each as often as in both."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))


def scored(answers: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """answers with exact, f1, bleu1 and rouge1; each text is tokenised once."""
    d = answers.withColumns({"_a": simple_tokens(F.col(predicted)), "_b": simple_tokens(F.col(gold))})
    d = d.withColumn("_hits", shared(F.col("_a"), F.col("_b")))
    recall = F.coalesce(F.col("_hits") / F.nullif(F.size("_b"), F.lit(0)), F.lit(0.0))
    return d.withColumns({"exact": exact_match(F.col(predicted), F.col(gold)), "f1": _f1(F.col("_a"), F.col("_b")), "bleu1": _bleu1(F.col("_a"), F.col("_b"), F.col("_hits")), "rouge1": recall}).drop("_a", "_b", "_hits")


def exact_match(predicted: Column, gold: Column) -> Column:
    return (F.lower(F.trim(F.coalesce(predicted, F.lit("")))) == F.lower(F.trim(F.coalesce(gold, F.lit(""))))).cast("int")


def _bleu1(a: Column, b: Column, hits: Column) -> Column:
    n, m = F.size(a), F.size(b)
    precision = hits.cast("double") / F.nullif(n, F.lit(0))
    brevity = F.when(n > m, F.lit(1.0)).otherwise(F.exp(1 - m / F.nullif(n, F.lit(0))))
    return F.coalesce(precision * brevity, F.lit(0.0))


def bleu1(predicted: Column, gold: Column) -> Column:
    """Clipped unigram precision with a brevity penalty; 0 without a common word."""
    a, b = simple_tokens(predicted), simple_tokens(gold)
    return _bleu1(a, b, shared(a, b))


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of an array of tokens, each as one string."""
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), "\0"))


#: The weights of 1- to 4-grams in BLEU-1 to BLEU-4.
WEIGHTS = {1: (1.0,), 2: (0.5, 0.5), 3: (0.33, 0.33, 0.33), 4: (0.25, 0.25, 0.25, 0.25)}


def bleu(answers: DataFrame, predicted: str = "predicted", gold: str = "gold", eps: float = 0.1) -> DataFrame:
    """answers with bleu1 to bleu4: clipped n-gram precisions, weighted geometric mean, brevity penalty.

    No match of n-grams counts as eps of a match; an answer of fewer than n
    words has one n-gram; without a single common word all are 0.
    """
    d = answers.withColumns({"_a": simple_tokens(F.col(predicted)), "_b": simple_tokens(F.col(gold))})
    d = d.withColumns({f"_h{n}": shared(ngrams(F.col("_a"), n), ngrams(F.col("_b"), n)) for n in WEIGHTS})
    n, m = F.size("_a"), F.size("_b")
    brevity = F.when(n > m, F.lit(1.0)).otherwise(F.exp(1 - m / F.nullif(n, F.lit(0))))
    logs = {k: F.log(F.when(F.col(f"_h{k}") == 0, F.lit(eps)).otherwise(F.col(f"_h{k}").cast("double")) / F.greatest(n - k + 1, F.lit(1))) for k in WEIGHTS}
    for k, weights in WEIGHTS.items():
        mean = F.exp(sum((w * logs[i] for i, w in enumerate(weights, 1)), F.lit(0.0)))
        d = d.withColumn(f"bleu{k}", F.when(F.col("_h1") == 0, 0.0).otherwise(F.coalesce(brevity * mean, F.lit(0.0))))
    return d.drop("_a", "_b", *(f"_h{k}" for k in WEIGHTS))


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays: a fold over one, with the row of the table as state."""
    zero = F.transform(b, lambda _: F.lit(0))

    def step(row: Column, x: Column) -> Column:
        # From left to right, best is the new row so far; above and before it come from the old one.
        cells = F.arrays_zip(b.alias("y"), row.alias("up"), F.concat(F.array(F.lit(0)), row).alias("corner"))
        new = F.aggregate(
            F.slice(cells, 1, F.size(b)),
            F.array(F.lit(0)),
            lambda out, c: F.concat(out, F.array(F.when(c["y"] == x, c["corner"] + 1).otherwise(F.greatest(c["up"], F.element_at(out, -1))))),
        )
        return F.slice(new, 2, F.size(b))

    return F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), F.aggregate(a, zero, step)), -1), F.lit(0))


def rouge(answers: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """answers with rouge1, rouge2 and rougel: F1 of shared 1-grams, 2-grams and the longest common subsequence; 0 where either text has none."""
    d = answers.withColumns({"_a": simple_tokens(F.col(predicted)), "_b": simple_tokens(F.col(gold))})

    def f(hits: Column, n: Column, m: Column) -> Column:
        return F.coalesce(2.0 * hits / F.nullif(n + m, F.lit(0)), F.lit(0.0))

    one, two = (shared(ngrams(F.col("_a"), n), ngrams(F.col("_b"), n)) for n in (1, 2))
    n, m = F.size("_a"), F.size("_b")
    less = lambda x: F.greatest(x - 1, F.lit(0))
    return d.withColumns({"rouge1": f(one, n, m), "rouge2": f(two, less(n), less(m)), "rougel": f(lcs(F.col("_a"), F.col("_b")), n, m)}).drop("_a", "_b")


def meteor(predicted: Column, gold: Column, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> Column:
    """METEOR by exact words: each word of the answer takes the first free equal one of the reference; chunks are stretches in both.

    A word's k-th place in the answer goes with its k-th in the reference.
    """
    a, b = simple_tokens(predicted), simple_tokens(gold)
    times = lambda xs, i: F.size(F.filter(F.slice(xs, 1, i + 1), lambda y: y == F.get(xs, i)))
    numbered = lambda xs: F.transform(xs, lambda x, i: F.concat_ws("\0", x, times(xs, i).cast("string")))
    nb = numbered(b)
    at = F.transform(numbered(a), lambda x: F.array_position(nb, x))
    hits = F.size(F.filter(at, lambda p: p > 0))
    before = lambda i: F.coalesce(F.when(i > 0, F.get(at, i - 1)), F.lit(0))
    chunks = F.size(F.filter(F.transform(at, lambda p, i: (p > 0) & ((before(i) == 0) | (before(i) != p - 1))), lambda x: x))
    p, r = hits / F.nullif(F.size(a), F.lit(0)), hits / F.nullif(F.size(b), F.lit(0))
    mean = p * r / F.nullif(alpha * p + (1 - alpha) * r, F.lit(0.0))
    return F.coalesce(mean * (1 - gamma * F.pow(chunks / F.nullif(hits, F.lit(0)), F.lit(beta))), F.lit(0.0))


def judged(answers: DataFrame, judge, question: str = "question", predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """answers with label (1 or 0) from judge(question, gold, predicted) in Arrow batches; a judge that fails on a row gives null."""

    def run(frames):
        for pdf in frames:
            labels = []
            for q, g, a in zip(pdf[question], pdf[gold], pdf[predicted], strict=True):
                try:
                    labels.append(int(bool(judge(q, g, a))))
                except Exception:
                    labels.append(None)
            yield pdf.assign(label=labels).astype({"label": "Int32"})

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in answers.schema)
    return answers.mapInPandas(run, f"{names}, label int")


def countable(records: DataFrame, skipped: tuple[str, ...] = ("5",), category: str = "category") -> DataFrame:
    """The records that are scored: all but those of the skipped categories."""
    return records.filter(~F.coalesce(F.col(category).cast("string").isin(*skipped), F.lit(False)))


def key_text(text: Column) -> Column:
    """A comparison key: wide and compatibility forms as plain ones, lower case, white space collapsed.

    Of Unicode's compatibility forms, full-width ASCII, ideographic and other
    spaces, and the usual ligatures are mapped; SQL has no whole NFKC.
    """
    wide = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
    plain = "".join(chr(c) for c in range(0x21, 0x7F))
    t = F.translate(text, wide, plain)
    for a, b in (("\ufb01", "fi"), ("\ufb02", "fl"), ("\u2026", "...")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.lower(t), "[\\s\u00a0\u2000-\u200a\u202f\u3000]+", " "))


def token_totals(questions: DataFrame, tokens: Column) -> DataFrame:
    """One row: num_questions, sum_tokens, avg_tokens; zeros without any."""
    d = questions.select(tokens.alias("n")).agg(F.count(F.lit(1)).alias("num_questions"), F.coalesce(F.sum("n"), F.lit(0)).alias("sum_tokens"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("avg_tokens"))
    return d


def by_category(records: DataFrame, category: str, metrics: list[str]) -> DataFrame:
    """category (null: all records), the means of metrics to four digits, n."""
    return records.rollup(category).agg(*(F.round(F.avg(m), 4).alias(m) for m in metrics), F.count(F.lit(1)).alias("n"))


def aggregate(scores: DataFrame, metric: str = "metric", value: str = "value", category: str = "category") -> DataFrame:
    """metric, category (null: all), mean, std (sample; 0 of one), median, min, max, count."""
    d = scores.select(metric, category, value)
    agg = [F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std"), F.round(F.median(value), 6).alias("median"), F.round(F.min(value), 6).alias("min"), F.round(F.max(value), 6).alias("max"), F.count(value).alias("count")]
    return d.groupingSets([[F.col(metric)], [F.col(metric), F.col(category)]], F.col(metric), F.col(category)).agg(*agg)


def compare(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys..., outcome of two runs (keys, seq, value): better, worse, equal, missing (a value is null), only_left or only_right; the last row of a key counts."""
    last = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    one = lambda d, name: d.withColumn("_r", F.row_number().over(last)).filter("_r = 1").select(*keys, F.col(value).alias(name), F.lit(True).alias(f"in_{name}"))
    j = one(left, "l").join(one(right, "r"), keys, "full")
    outcome = F.when(F.col("in_r").isNull(), "only_left").when(F.col("in_l").isNull(), "only_right").when(F.col("l").isNull() | F.col("r").isNull(), "missing").when(F.col("l") > F.col("r"), "better").when(F.col("l") < F.col("r"), "worse").otherwise("equal")
    return j.select(*keys, "l", "r", outcome.alias("outcome"))
