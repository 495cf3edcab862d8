"""kNN graphs, threshold graphs, components and clusters of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import vectors as V
from loomstone.shipping import ship


#: Vectors of a block at least; and at most where neighbours are looked for, and where any number of pairs may come of it.
BLOCK, MOST, PAIRS = 2048, 65536, 16384
#: Similarities that a task holds at once.
CELLS = 4_000_000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length from an Arrow column of lists of one size; a zero row stays."""
    column = column.combine_chunks()
    m = np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _blocks(n: int, most: int) -> int:
    """So many blocks that there is work for a cluster, of bounded size: vectors move once for each block of the other side."""
    return max(1, -(-n // max(BLOCK, min(most, -(-n // 12)))))


def _against(asked: DataFrame, known: DataFrame, judge, same: str | None = None, most: int = PAIRS, once: bool = False, told=None) -> DataFrame:
    """src, dst, sim of the pairs whose places judge(sims, src ids, dst ids) gives, sims being asked by known.

    Both sides are dealt into blocks of bounded size by hash, and a pair of
    blocks is a task's unit: matrix products, step by step, of which only
    those pairs become rows. once: both sides are the same, and a pair comes
    once, its smaller id as src. told(src, dst, sim) may make less of a unit's
    rows. Null vectors are left out, and so are, on both sides, those of
    another size than most of the asked ones.
    """
    more = [F.col(same).alias("_same")] if same else []
    kind = asked.schema["id"].dataType
    side = lambda d: d.filter("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").alias("v"), *more)
    a, k = side(asked), side(known)
    n_a, size = a.agg(F.count(F.lit(1)), F.mode(F.size("v"))).first()
    if not n_a:
        return asked.sparkSession.createDataFrame([], f"src {kind.simpleString()}, dst {kind.simpleString()}, sim double")
    a, k = (d.filter(F.size("v") == size) for d in (a, k))
    blocks_a, blocks_k = _blocks(n_a, most), _blocks(n_a if known is asked else k.count(), most)
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    # Of a block with itself, or of two once, the first one asks.
    a = a.withColumn("_a", own(blocks_a)).withColumn("_k", F.explode(F.sequence(F.col("_a") if once else F.lit(0), F.lit(blocks_k - 1))))
    k = k.withColumn("_k", own(blocks_k)).withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_k") if once else F.lit(blocks_a - 1))))

    def unit(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            src, dst = np.asarray(left.column("id")), np.asarray(right.column("id"))
            x, y = _matrix(left.column("v")), _matrix(right.column("v"))
            if same:
                code: dict = {}
                kinds = [np.array([code.setdefault(v, len(code)) for v in t.column("_same").to_pylist()]) for t in (left, right)]
            step = max(1, CELLS // len(y))
            for at in range(0, len(x), step):
                sims = x[at : at + step] @ y.T
                i, j = judge(sims, src[at : at + step], dst)
                ok = np.ones(len(i), bool)
                if same:
                    ok &= kinds[0][at + i] == kinds[1][j]
                if once and key[0].as_py() == key[1].as_py():
                    ok &= src[at + i] < dst[j]
                i, j = i[ok], j[ok]
                found.append((src[at + i], dst[j], sims[i, j]))
        one, two, sim = (np.concatenate(c) for c in zip(*found, strict=True))
        if once:
            one, two = np.minimum(one, two), np.maximum(one, two)
        if told is not None:
            one, two, sim = told(one, two, sim)
        return pa.table({c: pa.array(v, t) for c, v, t in (("src", one, pa.int64()), ("dst", two, pa.int64()), ("sim", sim, pa.float64()))})

    ship(asked.sparkSession)
    keys = ["_a", "_k"]
    out = a.groupBy(*keys).cogroup(k.groupBy(*keys)).applyInArrow(unit, "src long, dst long, sim double")
    return out.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), "sim")


def knn(new: DataFrame, known: DataFrame, k: int = 10) -> DataFrame:
    """src, dst, rank, sim: for each new vector (id, v) the k nearest known ones, itself left out, sim > 0."""

    def nearest(sims: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        head = sims[:, : max(4 * k, 4096)]
        at = max(0, head.shape[1] - k - 1)  # itself may be among them
        least = np.maximum(np.partition(head, at, axis=1)[:, at] - 1e-9, 0.0) if at else np.zeros(len(sims))
        i, j = np.nonzero(sims >= least[:, None])
        ok = (sims[i, j] > 0) & (src[i] != dst[j])
        i, j = i[ok], j[ok]
        # The k nearest of all are among the k nearest of a block.
        by = np.lexsort((dst[j], -np.round(sims[i, j], 9), i))
        i, j = i[by], j[by]
        keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(sims)))[i] < k
        return i[keep], j[keep]

    best = Window.partitionBy("src").orderBy(F.round("sim", 9).desc(), F.asc("dst"))
    return _against(new, known, nearest, most=MOST).withColumn("rank", F.row_number().over(best).cast("bigint")).filter(f"rank <= {int(k)}")


def pairs_above(vecs: DataFrame, threshold: float, same: str | None = None, strict: bool = False, told=None) -> DataFrame:
    """a, b, sim for a < b with sim at or above the threshold (above it if strict); of equal `same` only, where given."""

    def near(sims: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero((sims > threshold) if strict else (sims >= threshold))

    return _against(vecs, vecs, near, same, once=True, told=told).withColumnsRenamed({"src": "a", "dst": "b"})


def _forest(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges that connect what these connect, one for each node but the smallest of a component; they have no sim."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[rest]], nodes[rest], np.full(len(rest), np.nan)


def linking(vecs: DataFrame, threshold: float) -> DataFrame:
    """a, b: edges with the components of pairs_above's, of each pair of blocks no more than it has vectors."""
    return pairs_above(vecs, threshold, told=_forest).select("a", "b")


def components(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """id, component: the smallest id that edges (a, b) lead to.

    Labels move along edges and then to their labels' labels (pointer
    jumping), so paths halve in each round; every round is a written table.
    """
    spark = nodes.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both.write.parquet(f"{root}/edges")
    both = spark.read.parquet(f"{root}/edges")
    now = nodes.select("id", F.col("id").alias("component"))
    for i in range(64):
        near = both.join(now.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = now.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.least("component", F.coalesce("c", "component")).alias("component"))
        jump = step.join(step.select(F.col("id").alias("component"), F.col("component").alias("up")), "component").select("id", F.col("up").alias("component"))
        jump.write.parquet(f"{root}/labels-{i}")
        new = spark.read.parquet(f"{root}/labels-{i}")
        if not new.join(now.withColumnRenamed("component", "was"), "id").filter("was <> component").limit(1).take(1):
            return new
        now = new
    raise RuntimeError("the components did not settle")


def centroids(members: DataFrame, group: str) -> DataFrame:
    """group, centroid (array<double>), n: means of vectors v, dimension by dimension, with partial sums."""
    d = members.select(group, F.posexplode(V.doubles(F.col("v"))).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return d.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"), F.max("n").alias("n"))


def cohesion(members: DataFrame, cents: DataFrame, group: str) -> DataFrame:
    """group, cohesion: the mean cosine of members with their centroid."""
    return members.join(cents, group).groupBy(group).agg(F.avg(V.cosine(F.col("v"), F.col("centroid"))).alias("cohesion"))


def mean_intra(members: DataFrame, group: str) -> DataFrame:
    """group, mean_intra: mean cosine of different members, (sum of all - m) / (m (m - 1) + 1e-6).

    The sum of all pairs' cosines is the squared length of the sum of unit vectors, so no pair is made.
    """
    unit = members.select(group, F.posexplode(V.normalize(F.col("v"))).alias("i", "x"))
    sums = unit.groupBy(group, "i").agg(F.sum("x").alias("x")).groupBy(group).agg(F.sum(F.col("x") * F.col("x")).alias("all"))
    m = F.col("m")
    return sums.join(members.groupBy(group).agg(F.count(F.lit(1)).alias("m")), group).select(group, ((F.col("all") - m) / (m * (m - 1) + 1e-6)).alias("mean_intra"))


def objective(members: DataFrame, group: str) -> DataFrame:
    """One row: k, sparsity, sem, f.

    sparsity is (N / K) (N / sum n^2); sem the mean of cohesion times a
    Gaussian of how far the similarity to the nearest other theme is from the
    median, in median absolute deviations (+ 1e-8).
    """
    cents = centroids(members, group)
    a = cents.select(F.col(group).alias("a"), F.col("centroid").alias("ca"), "n")
    b = cents.select(F.col(group).alias("b"), F.col("centroid").alias("cb"))
    # Themes, not members, meet each other here.
    near = a.join(b, F.col("a") != F.col("b"), "left").groupBy("a").agg(F.coalesce(F.max(V.cosine(F.col("ca"), F.col("cb"))), F.lit(0.0)).alias("s"), F.first("n").alias("n"))
    mid = near.agg(F.median("s").alias("m"))
    dev = near.crossJoin(F.broadcast(mid)).withColumn("dev", F.abs(F.col("s") - F.col("m")))
    mad = dev.agg((F.median("dev") + 1e-8).alias("sigma"))
    g = dev.crossJoin(F.broadcast(mad)).withColumn("g", F.exp(-F.pow(F.col("s") - F.col("m"), 2) / (2 * F.pow("sigma", F.lit(2)))))
    j = g.join(cohesion(members, cents, group).withColumnRenamed(group, "a"), "a")
    out = j.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.avg(F.col("cohesion") * F.col("g")).alias("sem"))
    return out.select("k", (F.col("all") / F.col("k") * F.col("all") / F.col("squares")).alias("sparsity"), "sem").withColumn("f", F.col("sparsity") + F.col("sem"))


def assign_step(vecs: DataFrame, cents: DataFrame, attach: float = 0.62, lenient: float = 0.52, most: int = 12) -> DataFrame:
    """id, theme, sim, decision for vectors against fixed themes: attach, lenient (if the theme has room) or new."""
    best = Window.partitionBy("id").orderBy(F.round("sim", 9).desc(), F.asc("theme"))
    j = vecs.crossJoin(cents.select("theme", "centroid", "n")).select("id", "theme", "n", V.cosine(F.col("v"), F.col("centroid")).alias("sim")).withColumn("r", F.row_number().over(best)).filter("r = 1")
    decision = F.when(F.col("sim") >= attach, "attach").when((F.col("sim") >= lenient) & (F.col("n") < most), "lenient").otherwise("new")
    return j.select("id", F.when(decision != "new", F.col("theme")).alias("theme"), "sim", decision.alias("decision"))
