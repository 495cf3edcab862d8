"""Exact similarity pairs by cells around pivots, so that far vectors never meet.

Vectors are compared by their angle, which is a metric. Each lies in the cell
of its nearest pivot. By the triangle inequality a vector within the angle t
of one in a cell of radius R lies within R + t of the cell's pivot, and, as
that one is nearest to this pivot, within 2 t of the vector's own nearest
pivot's angle. Vectors visit only the cells that pass both bounds, and of two
cells the later one. No pair is lost; how many are compared depends on how
the vectors lie, at worst all. Where cells are visited by most vectors, there
are fewer of them, and blocks grow with the table, so what moves stays
bounded for each vector: at most about VISITS cells and as many blocks as all
pairs by blocks would need.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import vectors as V
from loomstone.operators import vector_graph as G
from loomstone.shipping import ship
from loomstone.sources.store import scratch, written

#: Pivots at most; they go to all tasks.
PIVOTS = 512
#: Cells that a vector visits on average, at most; with more, a fourth of the pivots is taken.
VISITS = 16


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ pivots.T, -1.0, 1.0))


def _placed(pivots: np.ndarray, angle: float, radius: np.ndarray | None):
    """cell and its pivot's angle of each vector; once the cells' radii are known, also the later cells that it visits."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            a = _angles(G._matrix(pa.chunked_array([b.column("v")])), pivots)
            cell = a.argmin(axis=1)
            own = a[np.arange(len(a)), cell]
            if radius is None:
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(own)], names=["cell", "angle"])
                continue
            # Arc cosines of rounded products may be off by some 1e-8 near 0.
            go = (a <= np.minimum(radius[None, :] + angle, own[:, None] + 2 * angle) + 1e-6) & (np.arange(len(pivots))[None, :] > cell[:, None]) & (radius >= 0)[None, :]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell, pa.int32()), pa.array([np.flatnonzero(g).tolist() for g in go], pa.list_(pa.int32()))], names=["id", "v", "cell", "visits"])

    return run


class Cells:
    """The vectors (id, v) dealt into cells for one threshold of cosine, above 0. Null vectors, zero ones, and those of another size than most are left out."""

    def __init__(self, vecs: DataFrame, threshold: float, block: int | None = None, pivots: int | None = None):
        if not threshold > 0:
            raise ValueError("cells need a threshold above 0")
        spark = vecs.sparkSession
        ship(spark)
        self.threshold, root = threshold, scratch(spark, "cells")
        self.kind = vecs.schema["id"].dataType.simpleString()
        d = vecs.filter("v is not null").select(F.col("id").cast("long").alias("id"), V.doubles(F.col("v")).alias("v")).filter(F.exists("v", lambda x: x != 0))
        n, size = d.agg(F.count(F.lit(1)), F.mode(F.size("v"))).first()
        d = d.filter(F.size("v") == (size or 0))
        self.block = block = block or max(G.BLOCK, min(G.PAIRS, -(-n // 12)))
        m = min(PIVOTS, pivots or max(8, -(-n // 256)))
        # A bounded number of vectors, those of the smallest hashes.
        chosen = d.select("v", F.xxhash64(F.lit("pivot"), "id").alias("h"), "id").orderBy("h", "id").limit(m).collect()
        p = G._matrix(pa.chunked_array([pa.array([list(r.v) for r in chosen] or [[1.0]], pa.list_(pa.float64()))]))
        angle = math.acos(min(1.0, threshold))
        while True:
            radius = np.full(len(p), -1.0)
            for r in d.select("v").mapInArrow(_placed(p, angle, None), "cell int, angle double").groupBy("cell").agg(F.max("angle").alias("r")).collect():
                radius[r.cell] = r.r
            if len(p) <= 2 * VISITS:
                break
            visits = d.mapInArrow(_placed(p, angle, radius), "id long, v array<double>, cell int, visits array<int>").agg(F.sum(F.size("visits"))).first()[0]
            if visits <= VISITS * n:
                break
            p = p[: max(2 * VISITS, len(p) // 4)]
        self.pivots = len(p)
        self._read = lambda: spark.read.schema("id long, v array<double>, cell int, visits array<int>").parquet(f"{root}/rows")
        self.rows = written(d.mapInArrow(_placed(p, angle, radius), "id long, v array<double>, cell int, visits array<int>"), f"{root}/rows")
        home = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("home"))
        guests = self.rows.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("guests"))
        #: cell, home, guests, and in how many blocks either are: a row for each pivot at most.
        self.sizes = written(home.join(guests, "cell", "left").select("cell", "home", F.coalesce("guests", F.lit(0)).alias("guests")).withColumns({"h": F.ceil(F.col("home") / block).cast("int"), "g": F.ceil(F.col("guests") / block).cast("int")}), f"{root}/sizes")

    def comparisons(self) -> int:
        """How many pairs meet."""
        return self.sizes.agg(F.coalesce(F.sum(F.col("home") * (F.col("home") - 1) / 2 + F.col("home") * F.col("guests")), F.lit(0)).cast("long")).first()[0]

    def pairs(self, strict: bool = False) -> DataFrame:
        """a, b, sim for a < b with sim at or above the threshold (above it if strict). A pair of blocks of a cell is a task's unit."""
        sizes, t = F.broadcast(self.sizes), self.threshold
        block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        # Both sides of a unit read the table anew, so their columns are told apart.
        of_home = lambda: self._read().select("id", "v", "cell").join(sizes, "cell").withColumn("r", block("h"))
        # A cell's blocks are those at home, then those of guests; the first one of a unit is at home.
        left = of_home().select("id", "v", "cell", "r", F.explode(F.sequence(F.col("r"), F.col("h") + F.col("g") - 1)).alias("s"))
        also = of_home().select("id", "v", "cell", F.col("r").alias("s"), F.explode(F.sequence(F.lit(0), F.col("r"))).alias("r"))
        guests = self._read().select("id", "v", F.explode("visits").alias("cell")).join(sizes, "cell")
        right = also.unionByName(guests.select("id", "v", "cell", (F.col("h") + block("g")).alias("s"), F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("r")))

        def unit(key, one: pa.Table, two: pa.Table) -> pa.Table:
            return _near(one, two, t, strict, key[1].as_py() == key[2].as_py())

        keys = ["cell", "r", "s"]
        out = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(unit, "a long, b long, sim double")
        return out.select(F.col("a").cast(self.kind).alias("a"), F.col("b").cast(self.kind).alias("b"), "sim")


def _near(one: pa.Table, two: pa.Table, t: float, strict: bool, own: bool) -> pa.Table:
    """a, b, sim of the pairs of two blocks (id, v), own if they are the same, step by step: so many similarities are held at once."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if one.num_rows and two.num_rows:
        x, y = np.asarray(one.column("id")), np.asarray(two.column("id"))
        left, right = G._matrix(one.column("v")), G._matrix(two.column("v"))
        step = max(1, G.CELLS // len(x))
        for at in range(0, len(y), step):
            few = y[at : at + step]
            sims = right[at : at + step] @ left.T
            mark = sims > t if strict else sims >= t
            if own:
                mark &= x[None, :] < few[:, None]
            i, j = np.nonzero(mark)
            found.append((np.minimum(x[j], few[i]), np.maximum(x[j], few[i]), sims[i, j]))
    return pa.table({c: pa.array(np.concatenate(v), k) for c, v, k in zip(("a", "b", "sim"), zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)})


def pairs_above(vecs: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """vector_graph.pairs_above by cells; thresholds of 0 and less, which most pairs pass, go to the blocks of all pairs."""
    return Cells(vecs, threshold).pairs(strict) if threshold > 0 else G.pairs_above(vecs, threshold, strict=strict)
