"""Token ids of a corpus as flat files, in ascending doc_id order.

Each shard has three files: NAME.ids, unsigned integers (16 bits where the
vocabulary fits, else 32); NAME.offsets, 64-bit counts of ids before each of
its documents and at its end, within the shard; NAME.docs, its doc_ids, 64
bits each, of which a last byte file NAME.null tells the missing ones. The
file index.json lists the shards with their bases: the ids and documents in
all shards before, prefix sums of one row a shard. All files can be mapped.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import keyed, scratch
from loomstone.llm.storage import Out, mapped, open_fs
from loomstone.llm.tokens import encoder, public_path


@dataclass(frozen=True)
class Params:
    tokenizer: str = "byte_bpe_50k.json"
    end_id: int = 2
    #: Documents that are encoded together.
    step: int = 256
    #: Bytes of input, as its files have them, for each shard; there are as many as shuffle partitions at least.
    shard_bytes: int = 256 << 20


_SHARD = "shard long, documents long, ids long"


def _writer(root: str, path: str, p: Params):
    def write(batches):
        enc = encoder(path)
        end = np.array([p.end_id], enc.dtype).tobytes()
        n = TaskContext.get().partitionId()
        ids, offsets, docs, null = (Out(f"{root}/{n:06d}.{x}") for x in ("ids", "offsets", "docs", "null"))
        at = rows = 0
        for batch in batches:
            for i in range(0, batch.num_rows, p.step):
                part = batch.slice(i, p.step)
                encoded = [b + end for b in enc.many(part.column("text").to_pylist())]
                ids.write(b"".join(encoded))
                sizes = np.array([len(b) // enc.dtype.itemsize for b in encoded], np.uint64)
                starts = at + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.uint64)
                offsets.write(starts.astype("<u8").tobytes())
                who = part.column("doc_id")
                docs.write(np.asarray(who.fill_null(0)).astype("<i8").tobytes())
                null.write(np.asarray(who.is_null().cast("uint8")).tobytes())
                at += int(sizes.sum())
                rows += part.num_rows
        offsets.write(np.array([at], "<u8").tobytes())
        for f in (ids, offsets, docs, null):
            f.done()
        yield pa.RecordBatch.from_pydict({"shard": [n], "documents": [rows], "ids": [at]}, pa.schema([("shard", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())]))

    return write


def write_tokens(docs: DataFrame, root: str, p: Params = Params()) -> dict:  # noqa: B008
    """Writes the files of docs under root and returns what index.json holds.

    A null text is empty; a null doc_id comes last; rows of equal doc_id are
    in the order of the input. An empty table has shards without documents.
    The range shuffle deals (doc_id, row) pairs, so no key is too large. A
    very long text is encoded whole.
    """
    spark = docs.sparkSession
    path = public_path(p.tokenizer)
    d = keyed(docs, scratch(spark, "tokens"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Without statistics the planner says a size near 2^63; partitions are then what the session has.
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // p.shard_bytes) if size < 1 << 60 else 0)
    order = [F.col("doc_id").asc_nulls_last(), F.col("rk").asc()]
    placed = d.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    # One row a shard comes to the driver.
    rows = sorted(map(tuple, placed.mapInArrow(_writer(root, path, p), _SHARD).collect()))
    shards, first, base = [], 0, 0
    for shard, documents, ids in rows:
        shards.append({"name": f"{shard:06d}", "documents": documents, "ids": ids, "first_document": first, "base": base})
        first, base = first + documents, base + ids
    index = {"dtype": encoder(path).dtype.str, "end_id": p.end_id, "documents": first, "ids": base, "shards": shards}
    out = Out(f"{root}/index.json")
    out.write(json.dumps(index).encode())
    out.done()
    return index


def read_index(root: str) -> dict:
    fs, path = open_fs(f"{root}/index.json")
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def _reader(root: str, dtype: str, step: int = 512):
    def read(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                name = f"{root}/{shard['name']}"
                ids, offsets, docs, null = mapped(f"{name}.ids", dtype), mapped(f"{name}.offsets", "<u8"), mapped(f"{name}.docs", "<i8"), mapped(f"{name}.null", "u1")
                for i in range(0, len(docs), step):
                    j = min(i + step, len(docs))
                    at = offsets[i : j + 1].astype(np.int64)
                    part, first = ids[int(at[0]) : int(at[-1])], int(at[0])
                    crc = [zlib.crc32(part[a - first : b - first].astype("<u4")) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.asarray(docs[i:j]), mask=np.asarray(null[i:j], bool)), pa.array(at[:-1] + shard["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return read


def read_tokens(spark, root: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files under root."""
    index = read_index(root)
    shards = spark.createDataFrame([(s["name"], s["base"]) for s in index["shards"]], "name string, base long")
    return shards.repartition(max(1, len(index["shards"]))).mapInArrow(_reader(root, index["dtype"]), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark, sf_dir):
    """Writes the files of all documents to the shared folder and reads them back."""
    root = scratch(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), root)
    return read_tokens(spark, root)
