"""The hierarchy graph as a GEXF file."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.text import attribute

#: Attributes that are not written.
LEFT_OUT = {"embedding", "message_ids", "source_episodes", "semantic_ids", "raw_messages", "vectors"}


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes (node_id, level, ...) and edges (a, b, kind) to a local file, row by row as they come to the driver."""
    names = [c for c in nodes.columns if c != "node_id" and c not in LEFT_OUT]
    text = lambda c: attribute(F.col(c)) if dict(nodes.dtypes)[c] == "string" else attribute(F.col(c).cast("string") if not dict(nodes.dtypes)[c].startswith(("array", "map", "struct")) else F.to_json(c))
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected">\n<attributes class="node">')
        f.write("".join(f'<attribute id="{i}" title={quoteattr(c)} type="string"/>' for i, c in enumerate(names)))
        f.write("</attributes>\n<nodes>\n")
        for r in nodes.select("node_id", *(text(c).alias(c) for c in names)).orderBy("node_id").toLocalIterator():
            values = "".join(f'<attvalue for="{i}" value={quoteattr(r[c])}/>' for i, c in enumerate(names) if r[c] is not None)
            f.write(f'<node id="{r.node_id}"><attvalues>{values}</attvalues></node>\n')
        f.write("</nodes>\n<edges>\n")
        for i, r in enumerate(edges.select("a", "b", "kind").orderBy("a", "b").toLocalIterator()):
            f.write(f'<edge id="{i}" source="{r.a}" target="{r.b}" kind={quoteattr(r.kind)}/>\n')
        f.write("</edges>\n</graph></gexf>\n")


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """node_id and values (map of attribute number to value), and a, b, kind."""
    value = "array<struct<_for: string, _value: string>>"
    n = spark.read.format("xml").option("rowTag", "node").schema(f"_id long, attvalues struct<attvalue: {value}>").load(path)
    e = spark.read.format("xml").option("rowTag", "edge").schema("_source long, _target long, _kind string").load(path)
    pairs = F.map_from_entries(F.coalesce("attvalues.attvalue", F.array().cast(value)))
    return n.select(F.col("_id").alias("node_id"), pairs.alias("values")), e.select(F.col("_source").alias("a"), F.col("_target").alias("b"), F.col("_kind").alias("kind"))
