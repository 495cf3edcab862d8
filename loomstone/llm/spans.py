"""Places of regular expressions in texts, by DataFrame functions alone.

Spark has no function for match positions. Matches are set off by a mark, the
text is split there, and running sums of the pieces' lengths give positions in
code points. Texts that hold the mark themselves take a slower equal way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK = "﷐﷑"


def pieces(text: Column, pattern: str, guard: Column) -> Column:
    """array<string>: text, match, text, ... (odd places are matches); empty where guard is false."""
    quick = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK)
    between, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    slow = F.flatten(F.transform(between, lambda x, i: F.when(i < F.size(found), F.array(x, F.get(found, i))).otherwise(F.array(x))))
    return F.when(~guard, F.array().cast("array<string>")).when(~text.contains(MARK), quick).otherwise(slow)


def matches(docs: DataFrame, text: str, kinds: dict[str, tuple[str, Column]], keep: list[str], around: int = 0) -> DataFrame:
    """keep..., kind (place in kinds), start, end, match, left, right; a row of nulls for a document of no match.

    keep must tell rows apart. left and right are up to `around` code points
    beside the match, within the text between matches of its kind. Only
    lengths and matches are shuffled, by the row's key.
    """
    t = F.col(text)

    def of(n: int) -> Column:
        p = F.col(f"_p{n}")
        return F.transform(
            p,
            lambda x, i: F.struct(
                F.lit(n).alias("kind"),
                i.alias("i"),
                F.length(x).alias("n"),
                F.when(i % 2 == 1, x).alias("match"),
                F.when((i % 2 == 1) & F.lit(around > 0), F.substring(F.get(p, i - 1), -around, around)).alias("left"),
                F.when((i % 2 == 1) & F.lit(around > 0), F.substring(F.get(p, i + 1), 1, around)).alias("right"),
            ),
        )

    d = docs.select(*keep, *(pieces(t, pattern, guard).alias(f"_p{n}") for n, (pattern, guard) in enumerate(kinds.values())))
    d = d.select(*keep, F.explode_outer(F.concat(*(of(n) for n in range(len(kinds))))).alias("x")).select(*keep, "x.*")
    so_far = Window.partitionBy(*keep, "kind").orderBy("i")
    d = d.withColumn("end", F.sum("n").over(so_far).cast("bigint")).withColumn("start", (F.col("end") - F.col("n")).cast("bigint"))
    # The text before the first match stands for the document.
    d = d.filter(F.col("kind").isNull() | (F.col("i") % 2 == 1) | (F.col("i") == 0))
    none = F.col("match").isNull()
    return d.select(*keep, F.when(~none, F.col("kind")).alias("kind"), F.when(~none, F.col("start")).alias("start"), F.when(~none, F.col("end")).alias("end"), "match", "left", "right")


def spelled(spans: Column, names: list[str]) -> Column:
    """kind:start:end, comma-joined, of sorted structs with fields kind (place in names), start and end."""
    kind = lambda s: F.get(F.array(*map(F.lit, names)), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
