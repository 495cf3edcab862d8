"""N-gram Jaccard join by MinHash banding, and the groups that its links make.

Documents with equal n-gram sets are one class, kept by its first row. Band
keys of the classes are shuffled; those that share one are candidates, in
the first band that they share. A bucket is cut into blocks of bounded size
and each pair of blocks is a task's unit, so no bucket is a task's alone.
Pairs are verified on their full n-gram sets, by a product of incidence
matrices, and are never rows: what leaves a unit is the number of links of
each class and a spanning forest of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import hot_join, keyed, scratch, written
from loomstone.llm.shingles import band_keys, set_hash, shingles, texts


@dataclass(frozen=True)
class Params:
    words: int = 5
    similarity: float = 0.8
    #: The share of pairs at exactly that similarity that bands must bring together.
    recall: float = 0.9995
    #: Rows (permutations) of a band.
    rows: int = 4
    #: Classes and n-grams of a block.
    block: int = 384
    block_grams: int = 500_000

    @property
    def bands(self) -> int:
        """The fewest bands that give the recall."""
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.similarity**self.rows))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of batches in which equal keys come together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([np.asarray(b.column(x)) for x in keys])
        cut = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        if held and any(held[-1].column(x)[-1].as_py() != b.column(x)[0].as_py() for x in keys):
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            held.append(b.slice(i, j - i))
            if j < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _sign(p: Params):
    def run(batches):
        for b in batches:
            n, c1, c2, keys = [], [], [], []
            for data in texts(b.column("text")):
                s = shingles(data, p.words)
                n.append(len(s))
                a, z = set_hash(s)
                c1.append(a)
                c2.append(z)
                keys.append(band_keys(s, p.bands, p.rows) if len(s) else np.zeros(0, np.int64))
            sizes = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("rk"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), bands], names=["rk", "doc_id", "n", "c1", "c2", "bands"])

    return run


_SIGNED = "rk long, doc_id long, n long, c1 long, c2 long, bands array<long>"
_UNIT = ["band", "key", "low", "high"]


def _first(bands: np.ndarray, band: int, block: np.ndarray, cross: bool) -> np.ndarray:
    """Which pairs of rows are this unit's: of different blocks in a cross unit, and not together in an earlier band."""
    own = ~np.eye(len(bands), dtype=bool) if not cross else block[:, None] != block[None, :]
    for b in range(band):
        own &= bands[:, b][:, None] != bands[:, b][None, :]
    return own


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    c = t.column(name).combine_chunks()
    return np.asarray(c.flatten()).reshape(len(c), -1)


def _active(batches):
    """Rows of units in which they have a candidate."""
    for t in groups(batches, _UNIT):
        band, low, high = (t.column(k)[0].as_py() for k in ("band", "low", "high"))
        if t.num_rows < 2:
            continue
        if band or low != high:
            own = _first(_matrix(t, "bands"), band, np.asarray(t.column("block")), low != high)
            t = t.filter(pa.array(own.any(axis=1)))
        yield from t.select([*_UNIT, "block", "rk"]).combine_chunks().to_batches()


def _sets(p: Params):
    """Unit rows with their n-gram sets, made once for each document."""

    def run(batches):
        for b in batches:
            units = b.column("units").to_pylist()
            for i, (data, us) in enumerate(zip(texts(b.column("text")), units, strict=True)):
                s = shingles(data, p.words).tobytes()
                rk, bands, copies = (b.column(c)[i].as_py() for c in ("rk", "bands", "copies"))
                for at in range(0, len(us), 64):
                    yield pa.RecordBatch.from_pylist([u | {"rk": rk, "bands": bands, "copies": copies, "grams": s} for u in us[at : at + 64]], _SCHEMA)

    return run


_SCHEMA = pa.schema([("band", pa.int32()), ("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("block", pa.int32()), ("rk", pa.int64()), ("bands", pa.list_(pa.int64())), ("copies", pa.int64()), ("grams", pa.binary())])
_WITH_SETS = "band int, key long, low int, high int, block int, rk long, bands array<long>, copies long, grams binary"


def shared_grams(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """The size of each two sets' intersection."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    union, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(sets), len(sets)))
    for at in range(0, len(union), width):
        i, j = np.searchsorted(place, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[i:j], place[i:j] - at] = 1
        out += m @ m.T
    return np.rint(out).astype(np.int64)


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left, edges = np.ones(len(links), bool), []
    for i in range(len(links)):
        if not left[i]:
            continue
        left[i] = False
        queue = [i]
        while queue:
            a = queue.pop()
            new = np.flatnonzero(links[a] & left)
            left[new] = False
            edges += [(a, int(x)) for x in new]
            queue += new.tolist()
    return edges


def _verify(p: Params):
    def run(batches):
        for t in groups(batches, _UNIT):
            band, low, high = (t.column(k)[0].as_py() for k in ("band", "low", "high"))
            rk, copies = np.asarray(t.column("rk")), np.asarray(t.column("copies"))
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("grams")]
            if len(sets) < 2:
                continue
            both, n = shared_grams(sets), np.array([len(s) for s in sets])
            near = both >= p.similarity * (n[:, None] + n[None, :] - both) - 1e-9
            near &= _first(_matrix(t, "bands"), band, np.asarray(t.column("block")), low != high)
            k, docs = near.sum(axis=1), near.astype(np.int64) @ copies
            some = np.flatnonzero(k)
            edges = forest(near)
            a, b = (rk[[e[i] for e in edges]] if edges else rk[:0] for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([rk[some], np.minimum(a, b)])),
                    pa.array(np.concatenate([k[some], np.zeros(len(a), np.int64)])),
                    pa.array(np.concatenate([docs[some], np.zeros(len(a), np.int64)])),
                    pa.array(np.concatenate([rk[some], np.maximum(a, b)]), mask=np.arange(len(some) + len(a)) < len(some)),
                ],
                names=["rk", "links", "linked_docs", "other"],
            )

    return run


def components(edges: DataFrame, root: str, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node that paths of edges lead to, for each node of an edge.

    Alternates large and small stars (each node's neighbours are tied to the
    smallest of them) until nothing moves. Every round is a table in the
    shared folder. A node's smallest neighbour is a partial aggregate, so a
    node with most of the edges is not gathered.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), f"{root}/edges-0")
    for i in range(1, 64):
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(ways.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), f"{root}/large-{i}")
        # Only neighbours above the node move.
        large = hot_join(ways, low, ["u"], "n").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = written(large, f"{root}/star-{i}")
        low = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), f"{root}/small-{i}")
        j = hot_join(large, low, ["u"], "n")
        small = j.select("u", F.col("m").alias("v")).unionByName(j.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        new = written(small, f"{root}/edges-{i}")
        told = lambda d: d.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if told(new) == told(now):
            break
        now = new
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """One row per row of docs: rk, doc_id, label, class_id, set_id, n_links, n_linked_docs, n_copies.

    label is the first row (by key) of the group that links lead to, class_id
    its doc_id; set_id is the doc_id of the first row with the same n-gram
    set, n_copies the number of those rows and n_links the number of other
    sets at or above the similarity; n_linked_docs counts these sets' rows.
    A text of fewer words than an n-gram has one gram, of all its words. One
    without words, or null, is alone. Rows of equal or null doc_id are rows of
    their own. Other columns are not read. A very long text is hashed whole,
    in blocks that end between words; a word of any length has one hash.
    """
    spark = docs.sparkSession
    root = scratch(spark, "near")
    d = keyed(docs, root).select("rk", "doc_id", "text")
    signed = written(d.mapInArrow(_sign(p), _SIGNED), f"{root}/signed")
    some = signed.filter("n > 0")
    classes = written(
        some.groupBy("c1", "c2", "n").agg(F.min(F.struct("rk", "doc_id", "bands")).alias("first"), F.count(F.lit(1)).alias("copies")).select("c1", "c2", "n", F.col("first.rk").alias("set_rk"), F.col("first.doc_id").alias("set_id"), F.col("first.bands").alias("bands"), "copies"),
        f"{root}/classes",
    )
    each = classes.select(F.col("set_rk").alias("rk"), F.col("n").alias("grams"), F.posexplode("bands").alias("band", "key"))
    buckets = written(each.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("grams").alias("all")).filter("n > 1"), f"{root}/buckets")
    parts = F.greatest(F.ceil(F.col("size") / p.block), F.ceil(F.col("all") / p.block_grams)).cast("int")
    # Only rows of buckets of two or more get all their bands again.
    members = hot_join(each.drop("grams"), buckets.withColumn("size", F.col("n")), ["band", "key"], "n").hint("merge").join(classes.select(F.col("set_rk").alias("rk"), "bands"), "rk").withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("rk"), F.col("parts")).cast("int"))
    units = members.select("rk", "bands", "band", "key", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with")).select("band", "key", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "rk", "bands")
    active = units.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(_active, "band int, key long, low int, high int, block int, rk long")
    active = written(active, f"{root}/active")
    wanted = active.groupBy("rk").agg(F.collect_list(F.struct(*_UNIT, "block")).alias("units")).join(classes.select(F.col("set_rk").alias("rk"), "bands", "copies"), "rk")
    # The planner could broadcast a small side; the hint keeps one plan at every size.
    full = wanted.hint("merge").join(d.select("rk", "text"), "rk").select("rk", "units", "bands", "copies", "text").mapInArrow(_sets(p), _WITH_SETS)
    verified = written(full.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(_verify(p), "rk long, links long, linked_docs long, other long"), f"{root}/verified")
    labels = written(components(verified.filter("other is not null"), f"{root}/components", "rk", "other"), f"{root}/labels")
    links = verified.filter("other is null").groupBy("rk").agg(F.sum("links").alias("n_links"), F.sum("linked_docs").alias("n_linked_docs"))
    ids = classes.select(F.col("set_rk").alias("label"), F.col("set_id").alias("class_id"))
    sets = classes.join(labels.withColumnRenamed("node", "set_rk"), "set_rk", "left").withColumn("label", F.coalesce("label", "set_rk")).join(links.withColumnRenamed("rk", "set_rk"), "set_rk", "left").join(ids, "label")
    zero = F.lit(0).cast("long")
    sets = written(sets.select("c1", "c2", "n", "label", "class_id", "set_id", F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_linked_docs", zero).alias("n_linked_docs"), F.col("copies").alias("n_copies"), F.col("copies").alias("_n")), f"{root}/sets")
    out = ["rk", "doc_id", "label", "class_id", "set_id", "n_links", "n_linked_docs", "n_copies"]
    alone = signed.filter("n = 0").select("rk", "doc_id", F.col("rk").alias("label"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"), zero.alias("n_links"), zero.alias("n_linked_docs"), F.lit(1).cast("long").alias("n_copies"))
    return hot_join(some.select("rk", "doc_id", "c1", "c2", "n"), sets, ["c1", "c2", "n"], "_n").select(*out).unionByName(alone.select(*out))


def op2_ngram_jaccard(spark, sf_dir):
    """Classes and links of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "class_id", "set_id", "n_links", "n_linked_docs", "n_copies")
