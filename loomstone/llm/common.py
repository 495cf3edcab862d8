"""Scratch folders in the cluster's shared storage, row keys, and text helpers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spans of white space and of other ASCII that is neither a digit nor a letter (text lower-cased).
SPACE = r"\x20\x09-\x0D"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one is made only where that is unset and the master is this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="loomstone-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name in the shared folder; files under it outlive lost executors."""
    ship(spark)
    _made.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


#: Scratch folders of this process that may still be there.
_made: list[str] = []


def scratch_mark() -> int:
    return len(_made)


def drop_scratch(spark: SparkSession, mark: int = 0) -> None:
    """Deletes the scratch folders that were made since a mark. What an operator returned reads from them, so its rows must have been written before."""
    jvm = spark.sparkContext._jvm
    for at in _made[mark:]:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _made[mark:]


_shipped: list[str] = []


def ship(spark: SparkSession) -> None:
    """Sends this library to the Python workers, which may be on machines or in folders without it; once an application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.append(app)
        at = Path(__file__).resolve().parents[2]
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/loomstone", "zip", at, "loomstone"))


def written(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(docs: DataFrame) -> Column:
    """The text, a null one as empty; made from the column's name, so extra columns don't matter."""
    return F.coalesce(docs["text"], F.lit(""))


def keyed(docs: DataFrame, root: str, keep: list[str] = ()) -> DataFrame:
    """doc_id, text, the columns of keep, and a row key rk (long, unique, never null).

    The key is the doc_id itself where doc_ids are unique and present, which
    one pass over that column shows; else rows get numbers, in a written table,
    so that equal or null ids stay separate rows.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"), *keep)
    doubled = d.groupBy("doc_id").count().filter((F.col("count") > 1) | F.col("doc_id").isNull())
    if not doubled.limit(1).take(1):
        return d.withColumn("rk", F.col("doc_id"))
    return written(d.withColumn("rk", F.monotonically_increasing_id()), f"{root}/keyed")


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def join_sorted(c: Column) -> Column:
    return F.array_join(F.array_sort(c), ",")


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, how: str = "inner", least: int = 10_000, part: float = 1 / 1000) -> DataFrame:
    """left joined with right (keys unique there, n rows of left for each) without a hot task.

    Keys of more than `part` of all rows and more than `least` are at most
    1 / part, so they are broadcast; the others' rows are shuffled, and none
    of these keys is large against the whole. how: inner or left. The column
    n is not in the result. right must be a written table.
    """
    total = right.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = F.col(n) > max(least, total * part)
    few = right.filter(hot).drop(n)
    # The hint keeps one plan at every size, and the planner can split its skewed partitions.
    rest = right.filter(~hot | F.col(n).isNull()).drop(n).hint("merge")
    if not few.limit(1).take(1):
        return left.join(rest, keys, how)
    of_hot = left.join(F.broadcast(few), keys)
    others = left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return of_hot.unionByName(others)


def _bit_of(x: Column, bits: int) -> tuple[Column, Column, Column]:
    h = F.xxhash64(F.lit(3), x)
    low = F.shiftrightunsigned(h, 32)
    return F.pmod(h, F.lit(bits // 65536)).cast("int"), (F.shiftrightunsigned(low, 6) % 1024).cast("int"), (low % 64).cast("int")


def bit_filter(rows: DataFrame, x: Column, bits: int) -> DataFrame:
    """_slot, _words: a bit for the hash of each x. A multiple of 65,536 bits, bits / 8 bytes, whatever the number of rows, so it may be broadcast."""
    slot, word, bit = _bit_of(x, bits)
    d = rows.select(slot.alias("_slot"), word.alias("_word"), bit.alias("_bit")).groupBy("_slot", "_word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))).alias("_x"))
    of = d.groupBy("_slot").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_x"))).alias("_of"))
    return of.select("_slot", F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.coalesce(F.element_at("_of", i), F.lit(0).cast("long"))).alias("_words"))


def maybe_in(rows: DataFrame, x: Column, filter_: DataFrame, bits: int, name: str) -> DataFrame:
    """rows with a column of that name: true where x is in the bit filter's rows, and for some others; no row moves."""
    slot, word, bit = _bit_of(x, bits)
    d = rows.withColumn("_slot", slot).join(F.broadcast(filter_), "_slot", "left")
    hit = F.call_function("shiftrightunsigned", F.get("_words", word), bit).bitwiseAND(F.lit(1)) == 1
    return d.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_slot", "_words")
