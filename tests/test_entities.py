"""Entity changes and the graph file."""

from pyspark.sql import functions as F

from loomstone.functions import entities as N
from loomstone.sources.graph_files import read_gexf, write_gexf


def test_changes(spark):
    r = (
        spark.sql("select map('timestamp', 'x', 'a', '1', 'b', null, 'c', null) m, array('t') tags, named_struct('content', 'old', 'source_episodes', array('e1'), 'updated_at', cast(null as string), 'revision_count', 1) f, timestamp_ntz'2024-01-01 00:00:00' c, timestamp_ntz'2024-01-31 23:00:00' n")
        .select(
            N.clean_metadata(F.col("m"), kept=("c",)).alias("m"),
            N.add_tag(F.col("tags"), F.lit("u")).alias("added"),
            N.remove_tag(F.col("tags"), F.lit("t")).alias("removed"),
            N.has_tag(F.lit(None).cast("array<string>"), F.lit("t")).alias("has"),
            N.revised(F.col("f"), F.lit("new"), F.array(F.lit("e1"), F.lit("e2")), F.lit("now")).alias("f"),
            N.age_days(F.col("c"), F.col("n")).alias("age"),
            N.is_recent(F.col("c"), F.col("n")).alias("recent"),
            N.summary(F.repeat(F.lit("x"), 120)).alias("s"),
        )
        .first()
    )
    assert r.m == {"a": "1", "c": None} and r.added == ["t", "u"] and r.removed == [] and not r.has
    assert (r.f.content, r.f.source_episodes, r.f.updated_at, r.f.revision_count) == ("new", ["e1", "e2"], "now", 2)
    assert r.age == 30 and r.recent and r.s == "x" * 100 + "..."


def test_gexf(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 2, 'a "q" <b>', [1.0]), (2, 3, None, [2.0])], "node_id long, level int, text string, embedding array<double>")
    edges = spark.createDataFrame([(1, 2, "supports")], "a long, b long, kind string")
    write_gexf(nodes, edges, f"{tmp_path}/g.gexf")
    n, e = read_gexf(spark, f"file://{tmp_path}/g.gexf")
    assert {r.node_id: r["values"] for r in n.collect()} == {1: {"0": "2", "1": 'a "q" <b>'}, 2: {"0": "3"}}
    assert [tuple(r) for r in e.collect()] == [(1, 2, "supports")]


def test_gexf_marks(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0, 'a "b" & <c>'), (2, 1, None)], "node_id long, level int, text string")
    edges = spark.createDataFrame([(1, 2, "is & <has>")], "a long, b long, kind string")
    write_gexf(nodes, edges, f"{tmp_path}/g.gexf")
    n, e = read_gexf(spark, f"{tmp_path}/g.gexf")
    assert {r.node_id: r["values"].get("1") for r in n.collect()} == {1: 'a "b" & <c>', 2: None} and e.first().kind == "is & <has>"
