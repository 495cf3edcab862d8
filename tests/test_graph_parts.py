"""GEXF in parts: one well-formed document in order, read back as it was."""

import xml.etree.ElementTree as ET
from pathlib import Path

from loomstone.sources import graph_files
from loomstone.sources.graph_parts import numbered, read_gexf_parts, write_gexf_parts


def whole(at):
    return "".join(p.read_text() for p in sorted(Path(at).glob("part-*")))


def test_parts_are_one_document(spark, tmp_path):
    odd = 'a "b" <c> & d\n\te\x01'
    nodes = spark.createDataFrame([(i, i % 4, odd if i == 7 else f"t{i}", [1.0] if i else None, {"k": "v"}) for i in range(200)], "node_id long, level int, text string, embedding array<double>, extras map<string,string>")
    edges = spark.createDataFrame([(i, (i * 7) % 200, "next") for i in range(199)] + [(0, 0, None), (5, 35, "next")], "a long, b long, kind string")
    at = f"{tmp_path}/g"
    for parts in (5, 1):
        write_gexf_parts(nodes, edges, f"file://{at}", parts)
        assert len(list(Path(at).glob("part-*"))) <= parts
        ns = "{http://gexf.net/1.3}"
        graph = ET.fromstring(whole(at).encode())[0]
        assert [a.get("title") for a in graph.find(f"{ns}attributes")] == ["level", "text", "extras"]
        assert [int(n.get("id")) for n in graph.find(f"{ns}nodes")] == list(range(200))
        seven = graph.find(f"{ns}nodes")[7][0]
        assert [(v.get("for"), v.get("value")) for v in seven] == [("0", "3"), ("1", odd.replace("\x01", " ")), ("2", '{"k":"v"}')]
        told = [(int(e.get("id")), int(e.get("source")), int(e.get("target"))) for e in graph.find(f"{ns}edges")]
        assert told == [(i, *e) for i, e in enumerate(sorted((r.a, r.b) for r in edges.collect()))]
        n, e = read_gexf_parts(spark, f"file://{at}")
        assert n.count() == 200 and n.filter("node_id = 7").first()["values"] == {"0": "3", "1": odd.replace("\x01", " "), "2": '{"k":"v"}'}
        assert sorted((int(r.a), int(r.b), r.kind or "") for r in e.collect()) == sorted((r.a, r.b, r.kind or "") for r in edges.collect())
    # One part is a file that the other reader takes too.
    n, e = graph_files.read_gexf(spark, f"file://{at}")
    assert n.count() == 200 and e.count() == 201


def test_empty_graph(spark, tmp_path):
    write_gexf_parts(spark.createDataFrame([], "node_id long, text string"), spark.createDataFrame([], "a long, b long, kind string"), f"file://{tmp_path}/g")
    assert ET.fromstring(whole(tmp_path / "g").encode()) is not None


def test_numbers_are_dense(spark):
    rows = numbered(spark.range(1000).selectExpr("pmod(xxhash64(id), 50) AS k", "id"), ["k", "id"], "n", 7).orderBy("k", "id").collect()
    assert [r.n for r in rows] == list(range(1000))
