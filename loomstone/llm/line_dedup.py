"""Line dedup over levelled sorted runs of line hashes.

The runs are a lasting table in a folder: levels of tables bucketed and
sorted by hash, listed in a manifest. A batch's line hashes (with the
smallest doc_id that holds each) are merged with the runs in one pass: a hash
that a run has is owned by an earlier document, one that none has (the
anti-join) is new and becomes part of the batch's own run. Before a batch,
full levels are compacted: `fanout` runs are merged bucket by bucket, without
a shuffle, into one of the next level. Batches of one call come in doc_id
order; a later call with the same runs goes on where the last one ended.
The manifest is written once a call, when all that its result needs is; a
call that dies leaves the runs as they were. A key belongs to the document
that its run names, also when this document comes again, so a repeated call
gives the rows that the first one gave.

Only hashes are shuffled. Texts of documents that lose no line pass straight
through: a bit filter of fixed size tells them; the others are joined with
the places of their lines.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import bit_filter, hot_join, keyed, maybe_in, scratch, sha256_hex, written
from loomstone.llm.storage import Out, open_fs

#: Sorts after every document, for a null doc_id.
LAST = 2**63 - 1


@dataclass(frozen=True)
class Params:
    #: Code points of the shortest key that counts.
    min_chars: int = 10
    batches: int = 4
    #: Runs of a level that are merged into one of the next.
    fanout: int = 2
    #: Bits of the filter of documents that lose lines, a multiple of 65,536: 16 MB, broadcast. With many more documents than bits it lets all through to the join.
    filter_bits: int = 1 << 27
    #: A key with more than this part of all (key, document) pairs is joined by broadcast: at most its inverse are there.
    hot_part: float = 1 / 1000


def line_keys(text: Column) -> Column:
    """The keys of a text's lines: without white space at the ends, A-Z lower-cased (other letters stay)."""
    ascii_ = F.octet_length(text) == F.length(text)
    low = F.when(ascii_, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.transform(F.split(low, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r")))


@contextmanager
def _ordered_scans(spark):
    """Scans of bucketed tables tell that a bucket's one file is sorted, so runs are merged without a sort; the setting is restored."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


class Runs:
    """Levelled runs in a folder: each a table (h1, h2, owner), bucketed and sorted by h1, h2.

    A folder that has runs already is opened as it is. The batch's own table
    also says what the merge found, in the column `of`; its run is the rows
    where that is null. What was appended lasts once it is published. One
    writer at a time.
    """

    #: Columns of a run that was compacted, and of a batch's.
    _COLUMNS = {"c": "h1 BIGINT, h2 BIGINT, owner BIGINT", "b": "h1 BIGINT, h2 BIGINT, owner BIGINT, last BIGINT, n BIGINT, of BIGINT"}

    def __init__(self, spark, root: str, fanout: int = 2):
        self.spark, self.root, self.fanout, self.names = spark, root, fanout, {}
        fs, path = open_fs(f"{root}/manifest.json")
        if fs.get_file_info(path).is_file:
            with fs.open_input_stream(path) as f:
                told = json.loads(f.read())
            self.buckets, self.levels = told["buckets"], told["levels"]
        else:
            self.buckets, self.levels = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), [[]]

    def _write(self, df: DataFrame, kind: str) -> str:
        """df, whose rows are dealt by h1, h2 into the buckets already, as the table of a new run."""
        run = kind + uuid.uuid4().hex
        self.names[run] = f"line_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", f"{self.root}/{run}").saveAsTable(self.names[run])
        return run

    def _table(self, run: str) -> DataFrame:
        if run not in self.names:
            name = f"line_run_{uuid.uuid4().hex}"
            # A run of no rows has no file that would tell its columns.
            self.spark.sql(f"CREATE TABLE {name} ({self._COLUMNS[run[0]]}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{run}'")
            self.names[run] = name
        return self.spark.table(self.names[run])

    def _new(self, run: str) -> DataFrame:
        """h1, h2, owner of the hashes that this run was the first to have."""
        t = self._table(run)
        return (t.filter("of is null") if run[0] == "b" else t).select("h1", "h2", "owner")

    def publish(self) -> None:
        """From now on the runs are found with what was appended."""
        out = Out(f"{self.root}/manifest.json")
        out.write(json.dumps({"buckets": self.buckets, "levels": self.levels}).encode())
        out.done()

    def compact(self) -> None:
        """Merges the runs of each full level, bucket by bucket, into one of the next."""
        for i, level in enumerate(self.levels):
            if len(level) < self.fanout:
                continue
            merged = self._new(level[0])
            for run in level[1:]:
                # No hash is in two runs, so a full merge join has each row of both.
                other = self._new(run).withColumnRenamed("owner", "other").hint("merge")
                merged = merged.join(other, ["h1", "h2"], "full").select("h1", "h2", F.coalesce("owner", "other").alias("owner"))
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(self._write(merged, "c"))
            level.clear()

    def append(self, batch: DataFrame) -> DataFrame:
        """Merges a batch (h1, h2 unique, owner, last, n) with the runs and adds its own; the batch with `of`, the owner in an earlier one or null."""
        with _ordered_scans(self.spark):
            return self._append(batch)

    def _append(self, batch: DataFrame) -> DataFrame:
        self.compact()
        now = batch.select("h1", "h2", "owner", "last", "n").withColumn("of", F.lit(None).cast("long"))
        for run in [r for level in self.levels for r in level]:
            now = now.join(self._new(run).withColumnRenamed("owner", "in_run").hint("merge"), ["h1", "h2"], "left").withColumn("of", F.coalesce("of", "in_run")).drop("in_run")
        # The batch's own shuffle deals it into the buckets, unless a session has other partitions than the one that made the runs.
        if self.spark.conf.get("spark.sql.shuffle.partitions") != str(self.buckets):
            now = now.repartition(self.buckets, "h1", "h2")
        run = self._write(now, "b")
        self.levels[0].append(run)
        return self._table(run)

    def close(self) -> None:
        """Takes the tables out of the session's catalog; the files stay."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = {}


def _bounds(d: DataFrame, n: int) -> list[int]:
    """Greatest owner of each batch but the last, by approximate quantiles."""
    q = d.select(F.percentile_approx("owner", [i / n for i in range(1, n)], 1000)).first()[0]
    return sorted(set(q or []))


def _batch(owner: Column, bounds: list[int]) -> Column:
    out = F.lit(0)
    for b in bounds:
        out = out + (owner > b).cast("int")
    return out


def _with_gone(d: DataFrame, gone: DataFrame, p: Params) -> DataFrame:
    """d with the column gone, of the rows of gone (rk, gone) or null."""
    tested = maybe_in(d, F.col("rk"), bit_filter(gone, F.col("rk"), p.filter_bits), p.filter_bits, "hit")
    through = tested.filter(~F.col("hit")).drop("hit").withColumn("gone", F.lit(None).cast("array<int>"))
    others = tested.filter("hit").drop("hit").hint("merge").join(gone.withColumnRenamed("rk", "of_rk"), F.col("rk") == F.col("of_rk"), "left").drop("of_rk")
    return through.unionByName(others)


def line_dedup(docs: DataFrame, p: Params = Params(), keep: list[str] = (), runs: Runs | None = None) -> DataFrame:  # noqa: B008
    """One row per row of docs: rk, doc_id, text (the kept lines), n_lines, n_dropped, and the columns of keep.

    A null or empty text is one empty line. The owner of a key is the
    smallest doc_id that holds it; a null doc_id comes after all others, and
    rows of one doc_id are one holder, so none of them loses a line to
    another. With runs, lines of documents of earlier calls are owned by
    these, whatever their ids, and the lines of docs are added; a document
    of an earlier call that comes again keeps what it owns, but rows without
    a doc_id can't be known again and lose it. A text that
    loses all its lines is empty. Other columns of docs are not read. Keys are
    told apart by 128 bits of hash. A very long text is one row with as many
    keys as lines; only its hashes are shuffled, unless it loses a line.
    """
    spark = docs.sparkSession
    root = scratch(spark, "lines")
    runs = runs or Runs(spark, f"{root}/runs", p.fanout)
    d = keyed(docs, root, keep).withColumn("owner", F.coalesce("doc_id", F.lit(LAST)))
    bounds = _bounds(d, p.batches)
    keys = d.select("rk", "owner", _batch(F.col("owner"), bounds).alias("batch"), F.posexplode(line_keys(F.col("text"))).alias("pos", "key")).filter(F.length("key") >= p.min_chars)
    keys = written(keys.select("rk", "owner", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"), "batch"), f"{root}/keys", ["batch"])
    repeated = None
    try:
        for b in range(len(bounds) + 1):
            # What a batch knows of a key: its first holder, and whether there is another.
            each = keys.filter(F.col("batch") == b).groupBy("h1", "h2").agg(F.min("owner").alias("owner"), F.max("owner").alias("last"), F.count(F.lit(1)).alias("n"))
            now = runs.append(each).filter("of is not null or last > owner")
            again = now.select("h1", "h2", F.coalesce("of", "owner").alias("of"), F.col("of").isNotNull().alias("earlier"), "n", F.lit(b).alias("batch"))
            repeated = again if repeated is None else repeated.unionByName(again)
        owners = written(repeated, f"{root}/owners")
    finally:
        runs.close()
    drops = _dropped(keys, owners, p)
    gone = written(drops.groupBy("rk").agg(F.collect_list("pos").alias("gone")), f"{root}/gone")
    runs.publish()
    j = _with_gone(d, gone, p)
    kept = _without(F.split("text", "\n"), F.col("gone"))
    return j.select(
        "rk",
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        *keep,
    )


def _without(lines: Column, gone: Column) -> Column:
    """lines but those at the places in gone: the stretches between them."""
    at = F.array_sort(gone)
    starts = F.concat(F.array(F.lit(0)), F.transform(at, lambda x: x + 1))
    ends = F.concat(at, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s)))


def _dropped(keys: DataFrame, owners: DataFrame, p: Params) -> DataFrame:
    """rk, pos of lines whose key an earlier document owns: of an earlier batch or call any other one, within a batch one of a smaller id.

    Keys with a large part of all repeated lines are joined by broadcast, at
    most 1 / hot_part of them; any other key is small against the whole.
    """
    return hot_join(keys, owners, ["batch", "h1", "h2"], "n", part=p.hot_part).filter(F.when(F.col("earlier"), (F.col("owner") != F.col("of")) | (F.col("owner") == LAST)).otherwise(F.col("owner") > F.col("of"))).select("rk", "pos")


def op4_line_dedup(spark, sf_dir):
    """Line dedup of all documents, in the contract's columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("text")).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
o AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM o GROUP BY doc_id"""
