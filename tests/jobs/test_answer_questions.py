"""The question job against its SQL, over changed input, on odd rows, and by its command line."""

import json
import subprocess
import sys

import duckdb

from jobs import answer_questions as job

SF = "/root/testdata/sf0.001"
CONFIG = json.loads(job.CONFIG.read_text())
COLUMNS = ["part", "query_id", "rank", "doc", "source", "text", "a", "b", "n"]


def rows(spark, out):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in job.output(spark, out).select(*COLUMNS).collect()), key=str)


def test_job_is_its_sql_each_time(spark, tmp_path):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({job.SQL})").fetchall()), key=str)
    out = f"file://{tmp_path}/out"
    # A first run on fewer documents leaves nothing behind.
    few = f"file://{tmp_path}/few"
    spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40").write.parquet(few)
    job.answer(spark, few, f"{SF}/benchmark.parquet", out, CONFIG)
    assert rows(spark, out) != want
    done = [job.answer(spark, f"{SF}/documents.parquet", f"{SF}/benchmark.parquet", out, CONFIG) for _ in range(2)]
    assert done[0] == done[1] and rows(spark, out) == want
    assert done[0]["hits"] == sum(r[0] == "hit" for r in want) and done[0]["documents_read"] == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_odd_rows(spark, tmp_path):
    docs, asked, out = (f"file://{tmp_path}/{x}" for x in ("docs", "asked", "out"))
    schema = "doc_id long, text string, source string, query_id long, kind string"
    texts = [(1, "Red apples. Sweet red apples!", "a", 9, "k"), (2, "Red apples. Sweet red apples!", None, 9, "k"), (3, None, "a", 9, "k"), (4, "", "b/c =", 9, "k"), (None, "red apples", "a", 9, "k"), (5, "word " * 5000 + "pear.", "b/c =", 9, "k"), *((i, f"Other thing number{i}.", "d", 0, "") for i in range(6, 12))]
    spark.createDataFrame(texts, schema).write.parquet(docs)
    spark.createDataFrame([(1, "sweet apples"), (2, "pear"), (3, ""), (4, None), (None, "red"), (5, "absent")], "item_id long, text string").write.parquet(asked)
    done = job.answer(spark, docs, asked, out, CONFIG)
    got = rows(spark, out)
    assert done["questions_read"] == 5 and done["answers"] == 2
    # Equal documents are in the order of their ids; a missing source is the empty one.
    assert [r[1:6] for r in got if r[0] == "hit"] == [(1, 1, 1, "a", "Sweet red apples!"), (1, 2, 2, "", "Sweet red apples!"), (2, 1, 5, "b/c =", "word " * 5000 + "pear.")]
    assert [r[5] for r in got if r[0] == "answer"][0] == "Sweet red apples!\n\n- Sweet red apples!\n- Sweet red apples!"
    long = next(r for r in got if r[0] == "answer" and r[1] == 2)
    assert long[8] <= CONFIG["context_tokens"]
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(docs)
    assert job.answer(spark, docs, asked, out, CONFIG)["hits"] == 0 and rows(spark, out) == []


def test_command_line(tmp_path):
    done = subprocess.run([sys.executable, job.__file__, "--documents", f"{SF}/documents.parquet", "--questions", f"{SF}/benchmark.parquet", "--out", str(tmp_path / "out")], capture_output=True, text=True, cwd=tmp_path, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert '"postings"' in done.stderr and list((tmp_path / "out" / "hits").glob("source=*")) and list((tmp_path / "out" / "index").glob("shard=*"))


def test_ranking_is_made_once(spark, tmp_path):
    """Fails where each of the fused lists, and each use of them, ranks all documents anew."""
    docs = spark.createDataFrame([(1, "Red apples."), (2, "Pears and apples."), *((i, f"Other thing number{i}.") for i in range(3, 12))], "doc long, text string")
    asked = spark.createDataFrame([(7, "apples"), (8, "pears")], "query_id long, text string")
    hits = job.ranked(job.build_index(docs, f"file://{tmp_path}/index", CONFIG), asked, CONFIG)
    assert "CoGroup" not in hits._jdf.queryExecution().toString()
    assert sorted((r.query_id, r.rank, r.doc) for r in hits.collect()) == [(7, 1, 1), (7, 2, 2), (8, 1, 2)]
