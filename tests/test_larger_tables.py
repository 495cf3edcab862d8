"""Queries against their SQL on tables that have what larger ones have: long histories, many keys, other letters."""

import datetime

import duckdb

from loomstone import catalog
from tests.test_queries import norm


def agree(spark, at, name, **tables):
    con = duckdb.connect()
    for t, d in tables.items():
        d.coalesce(1).write.parquet(f"{at}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet/*.parquet')")
    got = catalog.QUERIES[name](spark, f"file://{at}")
    cur = con.execute(catalog.ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = sorted(repr([norm(dict(zip(cols, r, strict=True))[c]) for c in sorted(cols)]) for r in cur.fetchall())
    assert sorted(repr([norm(r[c]) for c in sorted(got.columns)]) for r in got.collect()) == want and want


def test_novel_facts_of_letters_without_capitals(spark, tmp_path):
    rows = [(i, 0, "user", t) for i, t in ((5, "Straße eins"), (25, "straße EINS"), (45, "Strasse eins"), (6, "Straße eins"))]
    agree(spark, tmp_path, "novel_facts", conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def test_novel_facts_of_whole_texts(spark, tmp_path):
    """Fails where texts that begin alike are taken for one."""
    rows = [(i, 0, "user", t) for i, t in ((5, "one beginning, first end"), (25, "one beginning, second end"), (45, "one beginning, first end"), (6, "one beginning, first end"), (26, "one beginning, second end"), (46, None))]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    agree(spark, tmp_path, "novel_facts", conversations=d)
    assert {r.pos for r in catalog.QUERIES["novel_facts"](spark, f"file://{tmp_path}").collect()} == {6000, 26000, 46000}


def test_judged_stream_of_many_events_without_a_gap(spark, tmp_path):
    at = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k)
    rows = [(i, at(i if i < 30 else i + 9), i % 2 if i < 40 else 2, "view", 1.0, "{}") for i in range(70)]
    agree(spark, tmp_path, "stream_judged", events=spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"))


def test_dense_ids_of_many_new_nodes(spark, tmp_path):
    n = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    c = spark.range(0, 120_000, numPartitions=6).selectExpr("id * 7 as c_custkey", "concat('c', id) as c_name", "0 as c_nationkey", "0d as c_acctbal", "'m' as c_mktsegment")
    agree(spark, tmp_path / "a", "graph_upsert", nation=n, customer=c)
    agree(spark, tmp_path / "b", "graph_extras", nation=n, customer=c)
