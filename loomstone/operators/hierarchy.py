"""The four-level graph of messages, episodes, facts and themes, and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.sources.store import scratch, written


def upsert_nodes(old: DataFrame, new: DataFrame, parts: int = 64) -> DataFrame:
    """node_id, level, raw_id, text, extras: old nodes with new non-empty texts, and absent ones with ids after the largest.

    New ids are dense in the order of (level, raw_id). extras (map of texts)
    of old and new rows are merged, the new ones win; the column may be
    missing on both sides. Ranks are counted in `parts` ranges with prefix
    sums of their sizes, so no task has all rows of a level. The dealt rows are
    written: ranges come from a sample, which would be another one each time.
    """
    extra = "map<string,string>"
    has = "extras" in old.columns or "extras" in new.columns
    o, n = ((d if "extras" in d.columns else d.withColumn("extras", F.lit(None).cast(extra))) for d in (old, new))
    merged = F.map_from_entries(F.array_sort(F.transform(F.collect_set(F.struct("key", "value")), lambda x: x)))
    latest = n.groupBy("level", "raw_id").agg(F.max(F.when(F.length("text") > 0, F.col("text"))).alias("new_text"))
    pairs = n.select("level", "raw_id", F.explode("extras")).groupBy("level", "raw_id", "key").agg(F.max("value").alias("value"))
    latest = latest.join(pairs.groupBy("level", "raw_id").agg(merged.alias("new_extras")), ["level", "raw_id"], "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    both = F.map_concat(F.map_filter(F.coalesce("extras", none), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("new_extras", none)), k)), F.coalesce("new_extras", none))
    kept = o.join(latest, ["level", "raw_id"], "left").select("node_id", "level", "raw_id", F.coalesce("new_text", "text").alias("text"), both.alias("extras"))
    most = old.agg(F.coalesce(F.max("node_id"), F.lit(-1)).alias("most"))
    absent = latest.join(old, ["level", "raw_id"], "left_anti")
    absent = written(absent.repartitionByRange(parts, "level", "raw_id").withColumn("part", F.spark_partition_id()), scratch(old.sparkSession, "absent"))
    absent = absent.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("level", "raw_id")))
    # A row a part.
    base = absent.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("level", "raw_id")).alias("first"))
    base = base.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    fresh = absent.join(F.broadcast(base), "part").crossJoin(F.broadcast(most)).select((F.col("most") + F.col("base") + F.col("r")).cast("bigint").alias("node_id"), "level", "raw_id", F.col("new_text").alias("text"), F.coalesce("new_extras", none).alias("extras"))
    out = kept.unionByName(fresh)
    return out if has else out.drop("extras")


def increment_edges(episodes: DataFrame, facts: DataFrame, themes: DataFrame) -> DataFrame:
    """src, dst, kind, seq of one batch: message to episode, episode to fact, fact to theme, between ids of the batch only.

    episodes (episode_id, message_ids), facts (memory_id, source_episodes),
    themes (theme_id, semantic_ids); a list may be on several rows of its
    owner, so none need be gathered in one task. Names carry their level, as raw ids may
    be equal on two levels.
    """
    name = lambda level, c: F.concat(F.lit(f"L{level}:"), c)
    a = episodes.select("episode_id", F.explode("message_ids").alias("message_id")).select(name(0, F.col("message_id")).alias("src"), name(1, F.col("episode_id")).alias("dst"), F.lit("part_of").alias("kind"))
    of_fact = facts.select("memory_id", F.explode("source_episodes").alias("episode_id")).join(episodes.select("episode_id").distinct(), "episode_id", "left_semi")
    b = of_fact.select(name(1, F.col("episode_id")).alias("src"), name(2, F.col("memory_id")).alias("dst"), F.lit("supports").alias("kind"))
    of_theme = themes.select("theme_id", F.explode("semantic_ids").alias("memory_id")).join(facts.select("memory_id").distinct(), "memory_id", "left_semi")
    c = of_theme.select(name(2, F.col("memory_id")).alias("src"), name(3, F.col("theme_id")).alias("dst"), F.lit("in_theme").alias("kind"))
    return a.unionByName(b).unionByName(c).withColumn("seq", F.lit(0))


def unconsumed(rows: DataFrame, consumed: DataFrame, key: str) -> DataFrame:
    """The increment: rows whose key is not in the table of consumed ones. Writing their keys there consumes them."""
    return rows.join(consumed.select(key), key, "left_anti")


def neighbour_counts(nodes: DataFrame, edges: DataFrame, of: int = 3, other: int = 2) -> DataFrame:
    """node, neighbours: for each node of a level how many of the other level it has an edge with, either way; most first by (neighbours, node)."""
    ways = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
    there = nodes.filter(F.col("level") == other).select(F.col("node").alias("to"))
    n = ways.join(there, "to", "left_semi").groupBy("node").agg(F.count_distinct("to").alias("neighbours"))
    return nodes.filter(F.col("level") == of).select("node").join(n, "node", "left").select("node", F.coalesce("neighbours", F.lit(0)).cast("long").alias("neighbours"))


def simple_edges(edges: DataFrame) -> DataFrame:
    """a, b, kind of edges (src, dst, kind, seq): undirected, no loops, the latest kind of each pair."""
    return edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max_by("kind", "seq").alias("kind"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, level, degree; 0 for a node without edges."""
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("node", "level").join(ends, "node", "left").select("node", "level", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """level, nodes, and the least, largest, mean and median degree."""
    return degrees(nodes, edges).groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.round(F.median("degree"), 6).alias("median_degree"))


def theme_consistency(facts: DataFrame, members: DataFrame) -> DataFrame:
    """themes ('0', '1' or '>1'), facts: how many facts are in so many themes."""
    n = facts.select("fact").join(members.groupBy("fact").agg(F.count_distinct("theme").alias("n")), "fact", "left")
    kind = F.when(F.coalesce("n", F.lit(0)) == 0, "0").when(F.col("n") == 1, "1").otherwise(">1")
    return n.groupBy(kind.alias("themes")).agg(F.count(F.lit(1)).alias("facts"))
