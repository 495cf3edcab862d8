"""Personal data, and terms that reveal it.

Entities are found by patterns. Terms are the words of the documents that hold
an entity; over the whole corpus the co-occurrence of term and entity estimates
how strongly the term reveals it: the share of the term's documents that hold
the entity, and the pointwise mutual information of the two. Most values are
in one document only, so the estimate backs off to the kind: a term may also
reveal that some e-mail, address, card or phone number is there. Terms above both
thresholds, seen in enough different contexts, are sanitised wherever they
stand in the documents of the entity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import bit_filter, hot_join, keyed, maybe_in, scratch, sha256_hex, written
from loomstone.llm.spans import MARK, matches, pieces, spelled

KINDS = ["email", "ip", "card", "phone", "term"]


@dataclass(frozen=True)
class Params:
    #: Documents of different texts in which term and entity meet; copies and near copies count once.
    min_contexts: int = 3
    #: The same for a term and a kind of entity: chance brings rare words and a frequent kind together more often.
    kind_contexts: int = 5
    #: Part of their five-word sequences, as estimated, that near copies have in common.
    near: float = 0.8
    #: Least hashes of these sequences kept of a text for the estimate.
    sketch: int = 64
    #: Share of the term's documents that hold the entity.
    min_share: float = 0.5
    #: Bits of pointwise mutual information.
    min_bits: float = 3.0
    #: Bits of the filter of words whose documents are counted, 8 MB: fixed, whatever the corpus.
    filter_bits: int = 1 << 26


def _patterns(t: Column) -> dict[str, tuple[str, Column]]:
    """Possessive forms of the patterns: nothing that follows could use what they would give back, and long runs take linear time."""
    local = r"[A-Za-z0-9._%+-]"
    return {
        # A run of these characters is tried from its start or from the last match's end only.
        "email": (rf"(?:\G|(?<!{local})){local}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", t.contains("@")),
        "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", t.rlike(r"[0-9]\.[0-9]")),
        "card": (r"[0-9](?:[\x20-]?[0-9])++", t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", t.contains("+")),
    }


def _valid() -> Column:
    m, kind = F.col("match"), F.col("kind")
    digits = F.regexp_replace(m, "[^0-9]", "")
    byte = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

    def luhn(x: Column, i: Column) -> Column:
        n = x.cast("int")
        twice = n * 2
        return F.when(i % 2 == 0, n).when(twice > 9, twice - 9).otherwise(twice)

    card = F.length(digits).between(13, 19)
    total = F.aggregate(F.transform(F.split(F.reverse(F.when(card, digits)), ""), luhn), F.lit(0), lambda s, x: s + x)
    return (
        F.when(kind == 0, True)
        .when(kind == 1, m.rlike(rf"^{byte}(?:\.{byte}){{3}}$"))
        .when(kind == 2, card & F.coalesce(total % 10 == 0, F.lit(False)))
        .otherwise(F.length(digits).between(9, 15))
    )


def entities(d: DataFrame) -> DataFrame:
    """rk, doc_id, kind, start, end, match of valid entities of keyed documents; nulls for a document of none."""
    found = matches(d, "text", _patterns(F.col("text")), ["rk", "doc_id"])
    bad = F.col("kind").isNotNull() & ~_valid()
    return found.select("rk", "doc_id", *(F.when(~bad, F.col(c)).alias(c) for c in ("kind", "start", "end", "match")))


def _held(d: DataFrame) -> DataFrame:
    """Documents that may hold an entity."""
    t = F.col("text")
    some = F.lit(False)
    for pattern, guard in _patterns(t).values():
        some = some | (guard & t.rlike(pattern))
    return d.filter(some)


def _words() -> Column:
    """Hashes of the text's different words of four letters or more; a word that touches an entity, which only e-mails have letters for, is none."""
    t = F.col("text")
    bare = F.when(t.contains("@"), F.regexp_replace(F.regexp_replace(t, _patterns(t)["email"][0], MARK), rf"(?<!\p{{L}})\p{{L}}*+(?:{MARK}\p{{L}}*+)+", " ")).otherwise(t)
    return F.transform(F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(r"\p{L}{4,}+"), F.lit(0))), lambda w: F.xxhash64(w))


def _sketch(p: Params) -> Column:
    """The least hashes of the text's five-word sequences, sorted; fewer words are one sequence."""
    w = F.split(F.lower(F.trim("text")), r"\s+")
    grams = F.arrays_zip(*(F.slice(w, i + 1, F.greatest(F.size(w) - 4, F.lit(1))).alias(f"w{i}") for i in range(5)))
    return F.slice(F.array_sort(F.array_distinct(F.transform(grams, lambda g: F.xxhash64(*(g[f"w{i}"] for i in range(5)))))), 1, p.sketch)


def _apart(met: DataFrame, sketches: DataFrame, p: Params, root: str) -> DataFrame:
    """term, entity, n of the pairs of met (rk, term, entity, need) with `need` documents or more that are no near copies of one another.

    Each round takes a pair's first document, and its near copies with it. A
    pair may be in any number of documents, so its first one comes back by a
    join without a hot task.
    """
    left, pair = met.join(sketches, "rk"), ["term", "entity"]
    for i in range(1, max(p.min_contexts, p.kind_contexts)):
        first = written(left.filter(F.col("need") > i).groupBy(*pair).agg(F.min_by("sketch", "rk").alias("first"), F.count(F.lit(1)).alias("n")), f"{root}/first-{i}")
        least = F.slice(F.array_sort(F.array_union("sketch", "first")), 1, p.sketch)
        both = F.size(F.array_intersect(F.array_intersect("sketch", "first"), least))
        others = hot_join(left.filter(F.col("need") > i), first, pair, "n").filter(both < p.near * F.size(least)).drop("first")
        left = left.filter(F.col("need") <= i).unionByName(others)
        if i % 2 == 0:
            left = written(left, f"{root}/left-{i}")
    return left.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"))


def _document_counts(d: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """term, n_term: documents of the corpus that hold the word, of the wanted terms and few others; the rest of the corpus's words are not shuffled."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}+"), F.lit(0)))
    each = d.select(F.explode(words).alias("w")).select(F.xxhash64("w").alias("term"))
    return maybe_in(each, F.col("term"), bit_filter(wanted, F.col("term"), p.filter_bits), p.filter_bits, "some").filter("some").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def disclosing(d: DataFrame, found: DataFrame, p: Params, root: str) -> DataFrame:
    """rk, terms: documents that hold an entity, and their words that disclose it or its kind.

    Entities and words that cannot pass the thresholds go first: a share is at
    most n_entity / n_term, and the bits are at most log2(n_docs / n_entity).
    """
    total = found.agg(F.count_distinct("rk").alias("n_docs"))
    value = F.struct(F.xxhash64("kind", "match").alias("entity"), F.lit(p.min_contexts).alias("need"))
    kind = F.struct(F.xxhash64(F.lit("kind"), "kind").alias("entity"), F.lit(p.kind_contexts).alias("need"))
    holders = found.filter("kind is not null").select("rk", F.explode(F.array(value, kind)).alias("e")).select("rk", "e.*").distinct()
    of_entity = holders.groupBy("entity", "need").agg(F.count(F.lit(1)).alias("n_entity")).crossJoin(F.broadcast(total))  # one row
    of_entity = of_entity.filter((F.col("n_entity") >= F.col("need")) & (F.col("n_entity") * 2**p.min_bits <= F.col("n_docs")))
    live = written(hot_join(holders.drop("need"), written(of_entity.withColumn("n", F.col("n_entity")), f"{root}/of_entity"), ["entity"], "n"), f"{root}/live")
    most = live.groupBy("rk").agg(F.max("n_entity").alias("most"))
    texts = written(_held(d).join(most, "rk").select("rk", "most", _words().alias("words"), _sketch(p).alias("sketch")), f"{root}/texts")
    words = texts.select("rk", "most", F.explode("words").alias("term"))
    wanted = words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(p.min_contexts, p.kind_contexts))
    counts = written(_document_counts(d, wanted, p).join(wanted, "term").select("term", "n_term", "n"), f"{root}/counts")
    rare = hot_join(words, counts, ["term"], "n").filter(F.col("n_term") * p.min_share <= F.col("most"))
    met = written(rare.join(live, "rk").filter(F.col("n_term") * p.min_share <= F.col("n_entity")).select("rk", "term", "entity", "need", "n_term", "n_entity", "n_docs"), f"{root}/met")
    pairs = met.groupBy("term", "entity", "need", "n_term", "n_entity", "n_docs").agg(F.count(F.lit(1)).alias("n"))
    bits = F.log2(F.col("n") * F.col("n_docs") / (F.col("n_term") * F.col("n_entity")))
    share = F.col("n") / F.col("n_term")
    pairs = written(pairs.filter((F.col("n") >= F.col("need")) & (share >= p.min_share) & (bits >= p.min_bits)).select("term", "entity", "n"), f"{root}/pairs")
    met = written(hot_join(met.select("rk", "term", "entity", "need"), pairs, ["term", "entity"], "n"), f"{root}/scored")
    pairs = written(_apart(met, texts.select("rk", "sketch"), p, root), f"{root}/apart")
    return hot_join(met.select("rk", "term", "entity"), pairs, ["term", "entity"], "n").groupBy("rk").agg(F.collect_set("term").alias("terms"))


def _places(d: DataFrame, marks: DataFrame) -> DataFrame:
    """rk, doc_id, kind, start, end of each place of the marked terms (rk, terms)."""
    parts = F.transform(pieces(F.col("text"), r"\p{L}{4,}+", F.lit(True)), lambda x, i: F.struct(i.alias("i"), F.length(x).alias("n"), ((i % 2 == 1) & F.array_contains("terms", F.xxhash64(F.lower(x)))).alias("hit")))
    x = _held(d).join(marks, "rk").select("rk", "doc_id", F.explode(parts).alias("x")).select("rk", "doc_id", "x.*")
    x = x.withColumn("end", F.sum("n").over(Window.partitionBy("rk", "doc_id").orderBy("i")).cast("bigint")).filter("hit")
    return x.select("rk", "doc_id", F.lit(4).alias("kind"), (F.col("end") - F.col("n")).alias("start"), "end")


def find_pii(docs: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """One row per row of docs: rk, doc_id, base and spans, sorted arrays of (kind, start, end); kind is the place in KINDS.

    A null text is empty and has no spans. Rows of equal or null doc_id stay
    apart and count as documents of their own, but near copies are one context.
    Other columns are not read. Term spans may not touch an entity. A very
    long text is searched whole, in time in proportion to its length.
    """
    root = scratch(docs.sparkSession, "pii")
    return _find(keyed(docs, root), p, root)


def _find(d: DataFrame, p: Params, root: str) -> DataFrame:
    found = written(entities(d), f"{root}/entities")
    near = _places(d, written(disclosing(d, found, p, root), f"{root}/marks"))
    every = found.select("rk", "doc_id", "kind", "start", "end").unionByName(near)
    span = F.when(F.col("kind").isNotNull(), F.struct("kind", "start", "end"))
    all_ = F.array_sort(F.collect_list(span)).alias("spans")
    out = every.groupBy("rk", "doc_id").agg(all_)
    base = F.filter("spans", lambda s: s["kind"] < 4)
    apart = F.filter("spans", lambda s: (s["kind"] < 4) | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.withColumn("base", base).withColumn("spans", apart)


def sanitise(docs: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """doc_id and text, with entities generalised to their kind and disclosing terms removed.

    Overlapping spans are one, named by the first.
    """
    root = scratch(docs.sparkSession, "pii")
    d = keyed(docs, root)
    one = F.aggregate(
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                F.concat(a["out"], F.array(F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int")), F.when(s["start"] < a["at"], "").otherwise(F.get(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]], F.lit("")), s["kind"])))).alias("out"),
                s["end"].alias("at"),
            )
        ),
    )
    j = _find(d, p, root).join(d.select("rk", "text"), "rk")
    j = j.withColumn("_a", one)
    return j.select("doc_id", F.concat(F.array_join("_a.out", ""), F.substring(F.col("text"), (F.col("_a.at") + 1).cast("int"), F.length("text"))).alias("text"))


def op8_pii(spark, sf_dir):
    """Entities and terms of all documents, in the contract's columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return find_pii(docs).select("doc_id", *map(n, range(4)), sha256_hex(spelled(F.col("base"), KINDS)).alias("base_sha256"), spelled(F.col("spans"), KINDS).alias("spans"))


