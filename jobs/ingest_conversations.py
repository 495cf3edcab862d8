"""Conversations into memory, message by message as they come: episodes, open buffers and facts.

    python jobs/ingest_conversations.py --messages PATH --out PATH --checkpoint PATH [--config FILE]

Run it again whenever files were added under --messages: only new files are
read. Under --out it keeps three tables, partitioned by shard (conversation
modulo `shards`):

* episodes: cut at `most` messages; a message at or before its
  conversation's last one is a row without an episode and the reason "late".
  A stream's file sink, so each episode is there once whatever fails.
* open: what is in the buffers, read from the stream's state after the run.
* facts: the distinct statements of each conversation's episodes, with where
  and how often they were said. Only shards with new episodes are written
  anew; marks holds how many episodes a shard's facts were made from, and is
  written last, so a run that dies is made good by the next one.

Paths may be of any file system that Spark knows. Rows without conv_id or
turn have no place in a conversation and are left out.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
import uuid
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import providers
from loomstone.functions import text as X
from loomstone.operators import segments
from loomstone.sources.store import scratch
from loomstone.streaming import memory

log = logging.getLogger("loomstone.jobs.ingest_conversations")
CONFIG = Path(__file__).with_suffix(".json")
INPUT = "conv_id long, turn long, role string, text string"
EPISODES = "owner long, episode long, first_seq long, last_seq long, n_messages int, messages array<struct<seq: long, role: string, content: string>>, reason string, shard int"
FACTS = "owner long, statement string, episode long, first_seq long, last_seq long, times long, shard int"
MARKS = "shard int, episodes long"


def pattern(path: str) -> str:
    """A path as a pattern that only it matches: the file stream then takes single files as well as folders."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows at a path; none where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def take_new(spark: SparkSession, messages: str, out: str, checkpoint: str, config: dict) -> int:
    """Runs the stream until all files are taken; how many messages it read."""
    source = spark.readStream.schema(INPUT)
    if config.get("files_per_trigger"):
        source = source.option("maxFilesPerTrigger", config["files_per_trigger"])
    raw = source.parquet(pattern(messages)).filter("conv_id is not null and turn is not null")
    said = segments.normalised(raw.select(F.col("conv_id").alias("owner"), F.col("turn").alias("seq"), "role", F.col("text").alias("content")), F.lit("1970-01-01").cast("timestamp"))
    cut = memory.closed(said.drop("metadata"), most=config["most"]).drop("first_ts", "last_ts")
    rows = cut.withColumn("shard", F.pmod("owner", F.lit(config["shards"])).cast("int"))
    with memory.rocksdb_state(spark):
        query = rows.writeStream.format("parquet").partitionBy("shard").option("path", f"{out}/episodes").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def show_open(spark: SparkSession, out: str, checkpoint: str, config: dict) -> int:
    """Writes what the buffers hold in place of what they held before."""
    held = memory.open_buffers(spark, checkpoint).groupBy("owner", "episode").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))).alias("messages"))
    rows = held.select("owner", "episode", F.array_min("messages")["seq"].alias("first_seq"), F.array_max("messages")["seq"].alias("last_seq"), F.size("messages").alias("n_messages"), "messages", F.lit("open").alias("reason"), F.pmod("owner", F.lit(config["shards"])).cast("int").alias("shard"))
    rows.write.mode("overwrite").partitionBy("shard").parquet(f"{out}/open")
    return table(spark, f"{out}/open", EPISODES).count()


def facts_of(episodes: DataFrame) -> DataFrame:
    """The distinct statements of each owner, as they were first said."""
    said = episodes.select("shard", "owner", "episode", F.explode("messages").alias("m"))
    parts = providers.statements(said.select(F.struct("shard", "owner", "episode", "m.seq").alias("episode_id"), F.col("m.content").alias("content")))
    first = parts.groupBy("episode_id.shard", "episode_id.owner", X.statement_key(F.col("content")).alias("key")).agg(
        F.min(F.struct("episode_id.seq", "pos", "content", "episode_id.episode")).alias("f"), F.max("episode_id.seq").alias("last_seq"), F.count(F.lit(1)).alias("times")
    )
    return first.select("owner", F.col("f.content").alias("statement"), "f.episode", F.col("f.seq").alias("first_seq"), "last_seq", "times", "shard")


def refresh_facts(spark: SparkSession, out: str) -> list[int]:
    """Writes the facts of the shards that have episodes since they were last written; which."""
    episodes = table(spark, f"{out}/episodes", EPISODES).filter("episode is not null")
    n = episodes.groupBy("shard").agg(F.count(F.lit(1)).alias("now"))
    # A row for each shard.
    now = {r.shard: r.now for r in n.collect()}
    was = {r.shard: r.episodes for r in table(spark, f"{out}/marks", MARKS).collect()}
    due = sorted(s for s, k in now.items() if was.get(s) != k)
    if due:
        # The hint splits large shards over tasks and keeps small ones in one file.
        facts = facts_of(episodes.filter(F.col("shard").isin(due))).hint("rebalance", "shard")
        facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{out}/facts")
        spark.createDataFrame(sorted(now.items()), MARKS).coalesce(1).write.mode("overwrite").parquet(f"{out}/marks")
    return due


def ingest(spark: SparkSession, messages: str, out: str, checkpoint: str, config: dict) -> dict:
    """Takes the new messages and brings all tables up to date; what was read and written."""
    out, checkpoint = out.rstrip("/"), checkpoint.rstrip("/")
    read = take_new(spark, messages, out, checkpoint, config)
    log.info("read %d new messages of %s", read, messages)
    held = show_open(spark, out, checkpoint, config)
    due = refresh_facts(spark, out)
    cut = table(spark, f"{out}/episodes", EPISODES).agg(F.count("episode").alias("episodes"), F.count_if(F.col("episode").isNull()).alias("late")).first()
    done = {"messages_read": read, "episodes": cut.episodes, "late": cut.late, "open": held, "shards_written": due, "facts": table(spark, f"{out}/facts", FACTS).count()}
    log.info("%s holds %s", out, json.dumps(done))
    return done


def output(spark: SparkSession, out: str) -> DataFrame:
    """part ("closed", "open" or "fact"), owner, episode, first_seq, last_seq, n (messages, or times said), text of all that is under out."""
    columns = ["owner", "episode", "first_seq", "last_seq"]
    episode = lambda d, part: d.select(F.lit(part).alias("part"), *columns, F.col("n_messages").cast("long").alias("n"), memory.text_of(F.col("messages")).alias("text"))
    closed, held = table(spark, f"{out}/episodes", EPISODES), table(spark, f"{out}/open", EPISODES)
    facts = table(spark, f"{out}/facts", FACTS).select(F.lit("fact").alias("part"), *columns, F.col("times").alias("n"), F.col("statement").alias("text"))
    return episode(closed, "closed").unionByName(episode(held, "open")).unionByName(facts)


def job1_ingest_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job on the whole table of conversations, twice into the same folder and checkpoint; its tables after the second run."""
    root, config = scratch(spark, f"job1-{uuid.uuid4().hex}"), json.loads(CONFIG.read_text())
    for _ in range(2):
        ingest(spark, f"{sf_dir}/conversations.parquet", f"{root}/out", f"{root}/checkpoint", config)
    return output(spark, f"{root}/out")


SQL = r"""WITH m AS (SELECT conv_id AS owner, turn AS seq, CASE WHEN length(trim(coalesce(role, ''))) > 0 THEN trim(role) ELSE 'user' END AS role, coalesce(text, '') AS content FROM conversations),
n AS (SELECT *, CAST((row_number() OVER (PARTITION BY owner ORDER BY seq) - 1) // 4 AS BIGINT) AS episode FROM m),
o AS (SELECT *, episode < max(episode) OVER (PARTITION BY owner) AS closed FROM n),
e AS (SELECT CASE WHEN closed THEN 'closed' ELSE 'open' END AS part, owner, episode, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n, string_agg(role || ': ' || content, chr(10) ORDER BY seq) AS text FROM o GROUP BY owner, episode, closed),
s AS (SELECT owner, episode, seq, generate_subscripts(p, 1) AS pos, trim(unnest(p)) AS content FROM (SELECT *, string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM o WHERE closed)),
k AS (SELECT *, lower(trim(CASE WHEN starts_with(content, 'Time:') THEN regexp_replace(content, '^(?:[^ ]* ){3}', '') ELSE content END)) AS key FROM s WHERE content <> ''),
f AS (SELECT owner, arg_min(content, seq * 1000000 + pos) AS text, arg_min(episode, seq * 1000000 + pos) AS episode, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM k GROUP BY owner, key)
SELECT part, owner, episode, first_seq, last_seq, n, text FROM e UNION ALL SELECT 'fact', owner, episode, first_seq, last_seq, n, text FROM f"""


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("messages", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("ingest_conversations").getOrCreate()
    try:
        ingest(spark, args.messages, args.out, args.checkpoint, json.loads(Path(args.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
