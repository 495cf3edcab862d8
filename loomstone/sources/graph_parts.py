"""The hierarchy graph as GEXF in parts: Spark writes the lines, and the part files in order are one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions.text import attribute
from loomstone.sources.graph_files import LEFT_OUT
from loomstone.sources.store import scratch, written


def quoted(c: Column) -> Column:
    """A text as the value of an XML attribute, quotes included."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    # Characters that XML 1.0 has no way to write.
    return F.concat(F.lit('"'), F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", " "), F.lit('"'))


def numbered(rows: DataFrame, order: list[str], name: str, parts: int) -> DataFrame:
    """rows with their numbers from 0 in an order: places within ranges, after prefix sums of the ranges' sizes."""
    d = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    # Written, as ranges are drawn from samples and must be the same in both uses.
    d = written(d, f"{scratch(rows.sparkSession, 'numbered')}/rows")
    # A row for each range.
    sizes = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return d.join(F.broadcast(base), "_part").withColumn(name, (F.col("_base") + place).cast("long")).drop("_part", "_base")


def write_gexf_parts(nodes: DataFrame, edges: DataFrame, path: str, parts: int = 16) -> None:
    """nodes (node_id long, level, ...) and edges (a, b, kind) as text files under path, in place of what is there.

    Part files in the order of their names are one GEXF document, with nodes
    by id and edges by their ends; no row passes through the driver. Attributes
    are texts, others JSON; those of LEFT_OUT and nulls are not written.
    Equal edges are edges of their own.
    """
    spark = nodes.sparkSession
    names = [c for c in nodes.columns if c != "node_id" and c not in LEFT_OUT]
    types = dict(nodes.dtypes)
    value = lambda c: attribute(F.col(c) if types[c] == "string" else F.to_json(c) if types[c].startswith(("array", "map", "struct")) else F.col(c).cast("string"))
    values = [F.coalesce(F.concat(F.lit(f'<attvalue for="{i}" value='), quoted(value(c)), F.lit("/>")), F.lit("")) for i, c in enumerate(names)]
    node = F.concat(F.lit('<node id="'), F.col("node_id").cast("string"), F.lit('"><attvalues>'), *values, F.lit("</attvalues></node>"))
    edge = F.concat(F.lit('<edge id="'), F.col("_id").cast("string"), F.lit('" source='), quoted(F.col("a").cast("string")), F.lit(" target="), quoted(F.col("b").cast("string")), F.coalesce(F.concat(F.lit(" kind="), quoted(F.col("kind").cast("string"))), F.lit("")), F.lit("/>"))
    titles = "".join(f'<attribute id="{i}" title="{c}" type="string"/>' for i, c in enumerate(names))
    fixed = [
        (0, 0, f'<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected">\n<attributes class="node">{titles}</attributes>\n<nodes>'),
        (2, 0, "</nodes>\n<edges>"),
        (4, 0, "</edges>\n</graph></gexf>"),
    ]
    lines = spark.createDataFrame(fixed, "section int, place long, value string")
    lines = lines.unionByName(nodes.select(F.lit(1).alias("section"), F.col("node_id").cast("long").alias("place"), node.alias("value")))
    lines = lines.unionByName(numbered(edges.select("a", "b", "kind"), ["a", "b", "kind"], "_id", parts).select(F.lit(3).alias("section"), F.col("_id").alias("place"), edge.alias("value")))
    lines.repartitionByRange(parts, "section", "place").sortWithinPartitions("section", "place").select("value").write.mode("overwrite").text(path)


def read_gexf_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """node_id and values (map of attribute number to value), and a, b, kind of what write_gexf_parts wrote: a line is an element, so files are split freely."""
    lines = spark.read.text(path)
    value = "array<struct<_for: string, _value: string>>"
    of = lambda tag, schema: lines.filter(F.col("value").startswith(f"<{tag} ")).select(F.from_xml("value", schema, {"ignoreSurroundingSpaces": "false"}).alias("x"))
    n, e = of("node", f"_id long, attvalues struct<attvalue: {value}>"), of("edge", "_source string, _target string, _kind string")
    pairs = F.map_from_entries(F.coalesce("x.attvalues.attvalue", F.array().cast(value)))
    return n.select(F.col("x._id").alias("node_id"), pairs.alias("values")), e.select(F.col("x._source").alias("a"), F.col("x._target").alias("b"), F.col("x._kind").alias("kind"))
