"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import decontamination, line_dedup, near_duplicates, packing, quality_rules
from loomstone.llm.common import drop_scratch, keyed, scratch, scratch_mark

#: The columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules.quality_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one has."""
    out = line_dedup.line_dedup(docs, keep=["lang", "source"])
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, and all others that are in none."""
    d = keyed(docs, scratch(spark, "duplicates"), keep=["lang", "source", "n_chars"])
    groups = near_duplicates.near_duplicates(d.select(F.col("rk").alias("doc_id"), "text"))
    later = groups.filter("doc_id <> class_id").select(F.col("doc_id").alias("later"))
    return d.join(later, F.col("rk") == F.col("later"), "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.decontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", duplicates), ("decontamination", benchmark), ("packing", pack)]
#: Edit distances and packing have no SQL form; tests hold the result against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row over documents; the last one's rows. What a stage wrote besides its rows is deleted once these are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        mark = scratch_mark()
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        drop_scratch(spark, mark)
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
