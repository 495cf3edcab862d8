"""Lasting runs of line hashes: calls that are repeated, that die, and that are empty; merges without a sort."""

import pytest
from pyspark.sql import functions as F

from loomstone.llm import line_dedup as L

SCHEMA = "doc_id long, text string"


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def lines(i, n=6):
    return "\n".join(f"line number {(i * 7 + k * k) % 23} of some text" for k in range(n))


def texts(df):
    return sorted((r.doc_id, r.text, r.n_dropped) for r in df.collect())


def test_a_repeated_call_gives_the_same_rows(spark, tmp_path):
    at = f"file://{tmp_path}/runs"
    a, b = (docs(spark, *((i, lines(i)) for i in ids)) for ids in (range(40), range(40, 60)))
    both = dict((r[0], r) for r in texts(L.line_dedup(a.unionByName(b))))
    call = lambda d, **kw: texts(L.line_dedup(d, L.Params(batches=3, **kw), runs=L.Runs(spark, at)))
    first = call(a)
    assert first == [both[i] for i in range(40)] and sum(r[2] for r in first) > 100
    second = call(b)
    assert second == [both[i] for i in range(40, 60)]
    # Again, also in other batches and together: what was owned stays owned.
    assert call(a) == first and call(b, fanout=3) == second and call(b.unionByName(a)) == first + second


def test_rows_without_an_id_lose_what_an_earlier_call_has(spark, tmp_path):
    d = docs(spark, (None, "a line of no id\nanother one of none"), (1, "the line of one"))
    call = lambda: texts(L.line_dedup(d, runs=L.Runs(spark, f"file://{tmp_path}/runs")).fillna(-1, ["doc_id"]))
    assert [r[2] for r in call()] == [0, 0] and [r[2] for r in call()] == [2, 0]


def test_a_call_that_dies_leaves_the_runs(spark, tmp_path, monkeypatch):
    at, d = f"file://{tmp_path}/runs", docs(spark, *((i, lines(i)) for i in range(40)))
    want = texts(L.line_dedup(d))
    L.line_dedup(docs(spark, (100, "nothing like the others")), runs=L.Runs(spark, at)).count()
    before, n, append = L.Runs(spark, at).levels, [], L.Runs._append

    def die(self, batch):
        n.append(1)
        if len(n) == 3:
            raise OSError("lost")
        return append(self, batch)

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(L.Runs, "_append", die)
        L.line_dedup(d, L.Params(batches=4), runs=L.Runs(spark, at))
    assert L.Runs(spark, at).levels == before
    assert texts(L.line_dedup(d, L.Params(batches=4), runs=L.Runs(spark, at))) == want


def test_calls_without_a_key(spark, tmp_path):
    at = f"file://{tmp_path}/runs"
    call = lambda *rows: texts(L.line_dedup(docs(spark, *rows), runs=L.Runs(spark, at)))
    assert call((1, "short"), (2, None)) == [(1, "short", 0), (2, "", 0)]
    assert call() == []
    assert call((3, "a line that is long"), (4, "a line that is long"))[1] == (4, "", 1)
    assert call((5, "x")) == [(5, "x", 0)] and call((6, "A line that is long")) == [(6, "", 1)]


def test_runs_are_merged_without_a_sort(spark, tmp_path):
    runs = L.Runs(spark, f"file://{tmp_path}/runs")
    made = lambda a, b: spark.range(a, b).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", "id").alias("h2"), F.col("id").alias("owner"), F.col("id").alias("last"), F.lit(1).cast("long").alias("n")).repartition(runs.buckets, "h1", "h2")
    setting = spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering")
    runs.append(made(0, 3000))
    assert runs.append(made(2000, 4000)).filter("of is not null").count() == 1000
    with L._ordered_scans(spark):
        one, two = (runs._new(r) for r in runs.levels[0])
        plan = one.hint("merge").join(two.hint("merge").withColumnRenamed("owner", "other"), ["h1", "h2"], "full")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Sort [" not in plan and "Exchange" not in plan
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == setting
    assert runs.append(made(3500, 4200)).filter("of is not null").count() == 500
    runs.close()
