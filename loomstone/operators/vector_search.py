"""Exact vector search of a query set against a corpus."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomstone.shipping import ship

#: Queries of a block at most, and vectors of one at least and at most.
QUERIES, LEAST, MOST = 16384, 1024, 65536
#: The blocks of vectors that a search is dealt into, where they are of such sizes.
BLOCKS = 64
#: Scores that a task holds at once.
CELLS = 4_000_000


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


@dataclass(frozen=True)
class Score:
    """cosine (0 where a norm is 0), l2 (1 less the squared distance) or manhattan (the negative distance)."""

    name: str

    def near(self, v: np.ndarray):
        """Scores of any rows with all of v, and by how much they may be off."""
        if self.name == "cosine":
            u = _unit(v)
            return lambda q: (_unit(q) @ u.T, np.full(len(q), 1e-9))
        if self.name == "l2":
            s = (v * v).sum(axis=1)
            return lambda q: (1 - ((q * q).sum(axis=1)[:, None] + s[None, :] - 2 * (q @ v.T)), 1e-9 + 1e-13 * ((q * q).sum(axis=1) + s.max(initial=0.0)))

        def manhattan(q):
            out = np.zeros((len(q), len(v)))
            for d in range(v.shape[1]):
                out -= np.abs(q[:, d, None] - v[None, :, d])
            return out, np.full(len(q), 1e-9)

        return manhattan

    def exact(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Scores row by row."""
        if self.name == "cosine":
            den = np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1))
            return np.where(den == 0, 0.0, (q * v).sum(axis=1) / np.where(den == 0, 1.0, den))
        return 1 - ((q - v) ** 2).sum(axis=1) if self.name == "l2" else -np.abs(q - v).sum(axis=1)


COSINE, L2, MANHATTAN = Score("cosine"), Score("l2"), Score("manhattan")


def _padded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of doubles from an Arrow column of lists, filled up with zeros, and their sizes: -1 for a null one or one with a null in it."""
    column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(int)
    flat = column.flatten()
    there = np.arange(max(1, sizes.max(initial=0)))[None, :] < sizes[:, None]
    m = np.zeros(there.shape)
    m[there] = np.asarray(pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False), dtype=float)
    if flat.null_count:
        lost = np.zeros(there.shape, bool)
        lost[there] = flat.is_null().to_numpy(zero_copy_only=False)
        sizes[lost.any(axis=1)] = -1
    return m, sizes


def _scored(left: pa.Table, right: pa.Table, score: Score):
    """The queries of left from a place on with their scores of all vectors of right, how far these may be off, and exact scores of pairs; a null score is NaN in `void`."""
    (q, n_q), (v, n_v) = _padded(left.column("q")), _padded(right.column("v"))
    width = max(q.shape[1], v.shape[1])
    q, v = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, v))
    one = len(set(n_q.tolist()) | set(n_v.tolist())) == 1 and n_q[0] >= 0
    near, step = score.near(v), max(1, CELLS // len(v))

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        parts = [score.exact(q[i[a : a + 65536]], v[j[a : a + 65536]]) for a in range(0, len(i), 65536)]
        return np.concatenate(parts) if parts else np.zeros(0)

    for a in range(0, len(q), step):
        with np.errstate(all="ignore"):
            s, off = near(q[a : a + step])
        void = None if one else (n_q[a : a + step, None] != n_v[None, :]) | (n_q[a : a + step, None] < 0)
        yield a, s, off, void, exact


def _dealt(queries: DataFrame, corpus: DataFrame, unit, schema: str) -> DataFrame:
    """What unit(queries, vectors) makes of all pairs of blocks, a pair being a task's unit. Sizes of blocks are bounded; vectors move once for each block of queries."""
    n_q, n_v = queries.count(), corpus.count()
    b_q = max(1, -(-n_q // QUERIES))
    b_v = max(1, -(-n_v // min(MOST, max(LEAST, -(-n_v // BLOCKS)))))
    side = lambda d, key, own, n, other, m: d.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).groupBy("_q", "_v")
    ship(queries.sparkSession)
    return side(queries, "query_id", "_q", b_q, "_v", b_v).cogroup(side(corpus, "vec_id", "_v", b_v, "_q", b_q)).applyInArrow(unit, schema)


def _types(queries: DataFrame, corpus: DataFrame) -> str:
    return f"query_id {dict(queries.dtypes)['query_id']}, vec_id {dict(corpus.dtypes)['vec_id']}"


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def block_best(queries: DataFrame, corpus: DataFrame, k: int, score: Score = COSINE, told: bool = False) -> DataFrame:
    """query_id, vec_id, score: of each query the k best of each block of vectors, so all of its k best are among them.

    told: also low, n, total and squares, on one row of a query and block the
    least score of the block, how many scores are not null, their sum and
    that of their squares.
    """
    schema = _types(queries, corpus) + ", score double" + ", low double, n long, total double, squares double" * told
    kind = _arrow(schema)

    def unit(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [kind.empty_table()]
        if left.num_rows and right.num_rows:
            right = right.sort_by("vec_id")  # so equal scores go by place
            for a, s, off, void, exact in _scored(left, right, score):
                order = s
                if not np.isfinite(s).all():
                    order = np.where(np.isnan(s), np.inf, s)  # the largest, as in SQL
                if void is not None:
                    order = np.where(void, -np.inf, order)  # the last
                head = order[:, : max(4 * k, 2048)]
                least = np.partition(head, head.shape[1] - k, axis=1)[:, head.shape[1] - k] if head.shape[1] > k else np.full(len(s), -np.inf)
                i, j = np.nonzero(order >= (least - off)[:, None])
                got = exact(a + i, j)
                null = np.zeros(len(i), bool) if void is None else void[i, j]
                key = np.where(null, np.inf, np.where(np.isnan(got), -np.inf, -np.round(got, 9)))
                by = np.lexsort((j, key, i))
                i, j, got, null = i[by], j[by], got[by], null[by]
                at = np.searchsorted(i, np.arange(len(s)))
                keep = np.arange(len(i)) - at[i] < k
                i, j, got, null = i[keep], j[keep], got[keep], null[keep]
                cols = {"query_id": left.column("query_id").take(pa.array(a + i)), "vec_id": right.column("vec_id").take(pa.array(j)), "score": pa.array(got, mask=null)}
                if told:
                    ok = np.ones(s.shape, bool) if void is None else ~void
                    x = np.where(ok, s, 0.0)
                    up = np.where(ok, s, np.inf)
                    low = np.full(len(s), np.inf)
                    li, lj = np.nonzero(up <= (up.min(axis=1) + off)[:, None])
                    lo = np.where(ok[li, lj], exact(a + li, lj), np.inf)
                    np.minimum.at(low, li, lo)
                    first = np.r_[True, i[1:] != i[:-1]][: len(i)]
                    some = first & ok.any(axis=1)[i]
                    cols |= {"low": pa.array(low[i], mask=~some), "n": pa.array(ok.sum(axis=1)[i], mask=~some), "total": pa.array(x.sum(axis=1)[i], mask=~some), "squares": pa.array((x * x).sum(axis=1)[i], mask=~some)}
                out.append(pa.table(cols).cast(kind))
        return pa.concat_tables(out).combine_chunks()

    return _dealt(queries.select("query_id", "q"), corpus.select("vec_id", "v"), unit, schema)


def block_sums(queries: DataFrame, corpus: DataFrame, f, score: Score = COSINE) -> DataFrame:
    """query_id, total: for each query and block of vectors the sum of f(scores, mean, spread) over scores that are not null; queries have the columns mean and spread too."""
    schema = f"query_id {dict(queries.dtypes)['query_id']}, total double"
    kind = _arrow(schema)

    def unit(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [kind.empty_table()]
        if left.num_rows and right.num_rows:
            mean, spread = (np.asarray(left.column(c).to_numpy(), dtype=float) for c in ("mean", "spread"))
            for a, s, _, void, _ in _scored(left, right, score):
                p = f(s, mean[a : a + len(s), None], spread[a : a + len(s), None])
                p = p if void is None else np.where(void, 0.0, p)
                out.append(pa.table({"query_id": left.column("query_id").slice(a, len(s)), "total": pa.array(p.sum(axis=1))}).cast(kind))
        return pa.concat_tables(out).combine_chunks()

    return _dealt(queries.select("query_id", "q", "mean", "spread"), corpus.select("vec_id", "v"), unit, schema)


def ranked(best: DataFrame, k: int) -> DataFrame:
    """best (query_id, vec_id, score) with rank, cut to k. Ties go to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.asc("vec_id"))
    return best.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def topk(queries: DataFrame, corpus: DataFrame, k: int, score: Score = COSINE, min_score: float | None = None) -> DataFrame:
    """queries(query_id, q), corpus(vec_id, v) -> query_id, vec_id, rank, score.

    Both sides are dealt into blocks, of which the scores are a matrix
    product; only a block's k best of a query become rows. Scores are exact:
    the product only says which pairs may be among the best. A null vector,
    or one of another size than the query, has a null score, which is last.
    The score threshold is strict and applies after the cut to k.
    """
    out = ranked(block_best(queries, corpus, k, score), k)
    if min_score is not None:
        out = out.filter(F.col("score") > min_score)
    return out.select("query_id", "vec_id", "rank", "score")
