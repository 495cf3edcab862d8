"""The pipeline on sf0.001 against plain code for its filters, and whole tokens at its end."""

import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    at, docs, out = tmp_path_factory.mktemp("p"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, SF).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        out.append(docs)
    return out


def test_columns(spark, stages):
    want = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(sorted(d.columns) == sorted(want) for d in stages[:-1])


def test_quality_keeps_clean(spark, stages):
    kept = {r.doc_id for r in stages[0].collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(g)
        rep = len({k + j for k in range(len(g)) if n[g[k]] > 1 for j in range(3)})
        failed = len(w) < 50 or 100 * rep > 50 * len(w)
        symbols = len(re.findall(r"[#*$%&|<>]", r.text or ""))
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        own = 100 * symbols > 50 * len(w) or 100 * (len(lines) - len(set(lines))) > 50 * len(lines)
        assert (r.doc_id in kept) == (not failed and not own)


def test_near_duplicates_leave_one(stages):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
        n = min(5, len(w))
        return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()

    sets = {r.doc_id: grams(r.text) for r in stages[1].collect()}
    up = {i: i for i in sets}
    find = lambda x: x if up[x] == x else find(up[x])
    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                up[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.doc_id for r in stages[2].collect()} == {i for i in sets if find(i) == i}


def test_benchmark_is_gone(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = stages[2].collect(), {r.doc_id for r in stages[3].collect()}
    for r in before:
        assert (r.doc_id in after) or any(t[:20] in r.text for t in items)
        if r.doc_id in after:
            assert not any(t in r.text for t in items)


def test_packing_has_all(stages):
    docs = {r.doc_id for r in stages[3].collect()}
    n = {r.doc_id: [0, r.doc_tokens] for r in stages[4].collect()}
    for r in stages[4].collect():
        n[r.doc_id][0] += r.length
    assert set(n) == docs and all(a == b for a, b in n.values())


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, ties, empty and very long texts, an empty table, and extra columns with clashing names."""
    import corpus_pipeline

    words = [f"word{i % 97}x{i * i % 89}" for i in range(400)]
    clean = " ".join(words[:120])
    rows = [(None, None, None, None, None), (1, clean, "en", None, 5), (1, clean, "en", None, 5), (None, clean + " more", None, "s", 5), (2, "", "en", "s", 0), (3, " ".join(f"{w}{i}" for i, w in enumerate(words * 2000)), "en", "s", 1), (4, "\n".join([clean] * 3), "en", "s", 9)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for k, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, kind)
        for j, (name, f) in enumerate(corpus_pipeline.STAGES):
            d = docs.withColumns({"rk": F.lit(1), "owner": F.lit("x"), "_host": F.lit(2), "text_": F.lit(3)}) if j < 4 else docs
            out = f(spark, d, SF)
            out.write.parquet(f"{tmp_path}/{k}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}/{name}")
            if j < 4:
                assert set(kind.replace(",", "").split()[::2]) == set(docs.columns)
                if data and j == 3:
                    assert docs.count() >= 2 and docs.filter("doc_id = 3").count() == 1
        assert (docs.count() > 0) == bool(data)


def test_run_leaves_no_scratch(spark):
    import corpus_pipeline
    from loomstone.llm import common

    mark = common.scratch_mark()
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0
    left = [x for x in common._made[mark:]]
    assert len(left) <= 4
