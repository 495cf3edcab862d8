"""Packing of token sequences by column generation for the cutting-stock problem.

A document's whole multiples of the sequence length are sequences of their
own. Its rest is an item, or two where it is cut at half the sequence length:
long items would leave gaps that nothing fills, half ones pair. The histogram
of item lengths, at most one bar for each length, gives a linear program over
patterns (multisets of lengths that fit a sequence), solved by the revised
simplex method; a knapsack dynamic program prices columns. Patterns are used
a whole number of times, rounded down; the items of each length, ranked
without gaps, take the patterns' slots. Items that no slot is left for, less
than a use of each pattern, are laid end to end and cut at sequence bounds,
the last part into powers of two, which need no padding. So only the linear
program is on the driver, with data bounded by the sequence length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import keyed, scratch, written
from loomstone.llm.tokens import encoder, public_path


@dataclass(frozen=True)
class Params:
    tokenizer: str = "byte_bpe_50k.json"
    end_id: int = 0
    size: int = 1024
    #: The linear program ends within this part of its bound.
    gap: float = 0.002
    step: int = 256
    #: Documents of a rank chunk, about.
    chunk: int = 20_000


def _knapsack(value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the largest total value in each room up to size, and a length to take there (0: none). value[w] is of length w."""
    best, take = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for c in range(1, size + 1):
        got = best[c - 1 :: -1] + value[1 : c + 1]
        w = int(got.argmax())
        best[c], take[c] = (got[w], w + 1) if got[w] > best[c - 1] else (best[c - 1], 0)
    return best, take


def _pattern(take: np.ndarray, size: int) -> np.ndarray:
    """How often each length is in the knapsack's best pattern."""
    counts, c = np.zeros(len(take)), size
    while c > 0:
        if take[c]:
            counts[take[c]] += 1
            c -= int(take[c])
        else:
            c -= 1
    return counts


def _priced(prices: np.ndarray, lengths: np.ndarray, demand: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The largest value of a pattern under the prices, and columns: the best pattern, then the best ones of the lengths that those before, used as often as can be, leave a demand of."""
    left, value, columns, most = demand.copy(), np.full(size + 1, -1.0), [], 0.0
    while (left > 0).any():
        value[lengths] = np.where(left > 0, prices, -1.0)
        best, take = _knapsack(value, size)
        column = _pattern(take, size)[lengths]
        if not column.any():
            break
        most = most or float(best[size])
        columns.append(column)
        used = column > 0
        times = (left[used] / column[used]).min()
        left[used] -= times * column[used]
        left[left < 1e-9] = 0
    return most, np.array(columns).T if columns else np.zeros((len(lengths), 0))


def _inverse(a: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan steps. Numpy's own may start threads, which can hang in a process that holds a JVM."""
    a, out = a.copy(), np.eye(len(a))
    for k in range(len(a)):
        i = k + int(np.abs(a[k:, k]).argmax())
        for m in (a, out):
            m[[k, i]] = m[[i, k]]
        out[k] /= a[k, k]
        a[k] /= a[k, k]
        f = a[:, k].copy()
        f[k] = 0
        rows = np.flatnonzero(f)
        a[rows] -= np.outer(f[rows], a[k])
        out[rows] -= np.outer(f[rows], out[k])
    return out


@dataclass(frozen=True)
class Solution:
    #: Patterns (length -> times) and how often the linear program uses each.
    patterns: list[tuple[dict[int, int], float]]
    #: The program's value, and a bound that no solution is below.
    value: float = 0.0
    bound: float = 0.0
    #: Knapsacks solved, and columns that came into the basis.
    priced: int = 0
    pivots: int = 0


def cutting_stock(demand: dict[int, int], size: int, gap: float = 0.002) -> Solution:
    """The linear program of few sequences with all demand met exactly, by column generation.

    It starts from patterns of one length each. The knapsack on the duals
    gives new columns, which enter by the revised simplex method; then prices
    change and the knapsack is solved anew. Duals swing widely from round to
    round, so they are smoothed towards the ones of the best bound so far, at
    first each length's part of a sequence. It ends where the value is within
    the gap of a bound: Farley's, the duals' value divided by that of the best
    pattern under them.
    """
    lengths = np.array(sorted(w for w, n in demand.items() if n > 0), np.int64)
    if not len(lengths):
        return Solution([])
    d = np.array([demand[int(w)] for w in lengths], float)
    # Demands moved a little, each otherwise: no two rows tie, so the simplex method can't go in circles.
    moved = d + 1e-6 * np.random.default_rng(1).random(len(d))
    columns = np.diag((size // lengths).astype(float))
    inverse = np.diag(1 / (size // lengths))
    x = inverse.diagonal() * moved
    centre = lengths / size
    bound, pool, priced, pivots = float((centre * d).sum()), np.zeros((len(lengths), 0)), 0, 0
    while x.sum() > bound * (1 + gap):
        duals = inverse.sum(axis=0)  # all columns cost 1
        gain = np.einsum("i,ij->j", duals, pool) if pool.size else np.zeros(1)
        best = int(gain.argmax())
        if gain[best] <= 1 + 1e-9:
            for smooth in (0.9, 0.6, 0.0):
                prices = smooth * centre + (1 - smooth) * duals
                top, pool = _priced(prices, lengths, d, size)
                priced += 1
                if (found := float((prices * d).sum()) / top) > bound:
                    bound, centre = found, prices / top
                pool = pool[:, np.einsum("i,ij->j", duals, pool) > 1 + 1e-9]
                if pool.size:
                    break
            else:
                break
            continue
        column = pool[:, best]
        u = np.einsum("ij,j->i", inverse, column)
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * u, 0)
        x[out] = step
        row = inverse[out] / u[out]
        inverse -= np.outer(u, row)
        inverse[out] = row
        columns[:, out] = column
        pivots += 1
        if pivots % 500 == 0:  # rounding errors grow with the steps
            inverse = _inverse(columns)
            x = np.maximum(np.einsum("ij,j->i", inverse, moved), 0)
    x = np.maximum(np.einsum("ij,j->i", inverse, d), 0)
    used = [({int(w): int(n) for w, n in zip(lengths, columns[:, k], strict=True) if n}, float(x[k])) for k in range(len(x)) if x[k] > 1e-9]
    return Solution(used, float(x.sum()), bound, priced, pivots)


def slots(patterns: list[tuple[dict[int, int], float]], demand: dict[int, int]) -> tuple[dict[str, np.ndarray], int]:
    """The slots of the patterns used, by length and rank; and how many sequences they make.

    What is left for no slot is less than one use of each pattern, so at most
    `size` patterns' items, whatever the number of documents.
    """
    left, seq, rows = dict(demand), 0, []
    for pattern, times in sorted(patterns, key=lambda p: -p[1]):
        times = min([int(times + 1e-4), *(left[w] // n for w, n in pattern.items())])
        if times <= 0:
            continue
        at = 0
        for w, n in sorted(pattern.items()):
            rows.append((w, demand[w] - left[w], n, seq, at))
            left[w] -= n * times
            at += w * n
        seq += times
    rows.sort()
    names = ["length", "first", "each", "sequence", "offset"]
    table = {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}
    used = {w: demand[w] - left[w] for w in demand}
    table["of"] = np.array(sorted(used), np.int64)
    table["used"] = np.array([used[w] for w in sorted(used)], np.int64)
    return table, seq


def _encode(path: str, p: Params):
    def run(batches):
        enc = encoder(path)
        end = np.array([p.end_id], enc.dtype).tobytes()
        crc = lambda b: zlib.crc32(np.frombuffer(b, enc.dtype).astype("<u4"))
        one, whole = enc.dtype.itemsize, p.size * enc.dtype.itemsize
        half = whole // 2
        for batch in batches:
            for i in range(0, batch.num_rows, p.step):
                part = batch.slice(i, p.step)
                ids = [b + end for b in enc.many(part.column("text").to_pylist())]
                full = [[crc(b[k : k + whole]) for k in range(0, len(b) - whole + 1, whole)] for b in ids]
                rest = [b[len(f) * whole :] for b, f in zip(ids, full, strict=True)]
                cuts = [[0, half, len(b)] if len(b) > half else [0, len(b)] for b in rest]
                items = [[{"at": i // one, "n": (j - i) // one, "crc": crc(b[i:j])} for i, j in zip(c[:-1], c[1:], strict=True) if j > i] for b, c in zip(rest, cuts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("rk"),
                        part.column("doc_id"),
                        pa.array([len(b) // one for b in ids], pa.int64()),
                        pa.array(full, pa.list_(pa.int64())),
                        pa.array([len(f) * p.size for f in full], pa.int64()),
                        pa.array(items, pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())]))),
                        pa.array(rest, pa.binary()),
                    ],
                    names=["rk", "doc_id", "doc_tokens", "full", "whole", "items", "rest_ids"],
                )

    return run


_ENCODED = "rk long, doc_id long, doc_tokens long, full array<long>, whole long, items array<struct<at: long, n: long, crc: long>>, rest_ids binary"
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def running(df: DataFrame, by: list[str], n: str, out: str, chunks: int, order: list[str]) -> DataFrame:
    """df with the sum of n over the rows before, in each group of `by`, in a fixed order; the columns of order tell rows apart.

    Rows are dealt to chunks, so a group with most of the rows is no task's
    alone; a table of one row for each chunk and group has the bases.
    """
    d = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    # Each group's chunks are at most `chunks` rows.
    each = d.groupBy(*by, "_chunk").agg(F.sum(n).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select(*by, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_own", F.coalesce(F.sum(n).over(within), F.lit(0)))
    return d.join(base, [*by, "_chunk"]).withColumn(out, (F.col("_base") + F.col("_own")).cast("long")).drop("_chunk", "_own", "_base")


def _fill(table: dict[str, np.ndarray]):
    """Pieces of the items that have a slot."""

    def run(batches):
        key = (table["length"] << 40) + table["first"]
        for b in batches:
            c = {k: np.asarray(b.column(k)) for k in ("doc_tokens", "start", "n", "crc", "rank")}
            i = np.searchsorted(key, (c["n"] << 40) + c["rank"], "right") - 1
            k, each = c["rank"] - table["first"][i], table["each"][i]
            cols = [b.column("doc_id"), *map(pa.array, (c["start"], c["n"], c["crc"], c["doc_tokens"], table["sequence"][i] + k // each, table["offset"][i] + k % each * c["n"]))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def _cut(total: int, size: int, first: int, dtype):
    """Pieces of the items that are laid end to end: `laid` is the item's place."""
    whole = total - total % size
    bounds, at = [], whole
    for k in reversed(range(size.bit_length())):
        if total % size >> k & 1:
            bounds.append(at)
            at += 1 << k
    tails = np.array([*bounds, total], np.int64)

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], dtype)
                lo, hi = r["laid"], r["laid"] + r["n"]
                while lo < hi:
                    if lo < whole:
                        begin, end, seq = lo // size * size, lo // size * size + size, lo // size
                    else:
                        j = int(np.searchsorted(tails, lo, "right")) - 1
                        begin, end, seq = int(tails[j]), int(tails[j + 1]), whole // size + j
                    to = min(hi, end)
                    piece = ids[lo - r["laid"] : to - r["laid"]]
                    out.append({"doc_id": r["doc_id"], "start": r["start"] + lo - r["laid"], "length": to - lo, "ids_crc32": zlib.crc32(piece.astype("<u4")), "doc_tokens": r["doc_tokens"], "sequence_id": first + seq, "offset": lo - begin})
                    lo = to
            yield pa.RecordBatch.from_pylist(out, pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]))

    return run


def pack(docs: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Rows of equal or null doc_id
    are documents of their own. Other columns of docs are not read. A very
    long text fills sequences of its own, but for its rest. Sequence
    ids are dense: first those of patterns, then cut ones, then whole pieces
    of long documents.
    """
    spark = docs.sparkSession
    root = scratch(spark, "packing")
    path = public_path(p.tokenizer)
    d = written(keyed(docs, root).select("rk", "doc_id", "text").mapInArrow(_encode(path, p), _ENCODED), f"{root}/encoded")
    size = encoder(path).dtype.itemsize
    items = d.select("rk", "doc_id", "doc_tokens", "whole", "rest_ids", F.explode("items").alias("i")).select("rk", "doc_id", "doc_tokens", "i.at", "i.n", "i.crc", (F.col("whole") + F.col("i.at")).alias("start"), "rest_ids")
    demand = {r["n"]: r["count"] for r in items.groupBy("n").count().collect()}  # at most `size` rows
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(demand.values()) // p.chunk))
    table, filled = slots(cutting_stock(demand, p.size, p.gap).patterns, demand)
    light = items.select("rk", "at", "doc_id", "doc_tokens", "n", "crc", "start", F.lit(1).alias("one"))
    ranked = running(light, ["n"], "one", "rank", chunks, ["rk", "at"]).drop("one")
    used = spark.createDataFrame([(int(w), int(n)) for w, n in zip(table["of"], table["used"], strict=True)], "n long, used long")
    ranked = written(ranked.join(F.broadcast(used), "n"), f"{root}/ranked")  # used: a row for each length
    fitted = ranked.filter("rank < used").mapInArrow(_fill(table), _PIECE)
    # Bounded by the patterns, so broadcast: the ids of all items stay where they are.
    over = items.join(F.broadcast(ranked.filter("rank >= used").select("rk", "at")), ["rk", "at"], "left_semi")
    over = over.select("rk", "at", "doc_id", "doc_tokens", "n", "start", F.substring(F.col("rest_ids"), (F.col("at") * size + 1).cast("int"), (F.col("n") * size).cast("int")).alias("ids"))
    total = sum(w * (demand[w] - int(n)) for w, n in zip(table["of"].tolist(), table["used"], strict=True))
    laid = running(over.withColumn("all", F.lit(0)), ["all"], "n", "laid", chunks, ["rk", "at"]).select("doc_id", "doc_tokens", "n", "start", "ids", "laid")
    cut = laid.mapInArrow(_cut(total, p.size, filled, encoder(path).dtype), _PIECE)
    first = filled + total // p.size + bin(total % p.size).count("1")
    long = running(d.filter(F.size("full") > 0).select("rk", "doc_id", "doc_tokens", "full", F.size("full").cast("long").alias("n"), F.lit(0).alias("all")), ["all"], "n", "before", chunks, ["rk"])
    whole = long.select("doc_id", "doc_tokens", "before", F.posexplode("full").alias("i", "crc")).select(
        "doc_id",
        (F.col("i") * F.lit(p.size).cast("long")).alias("start"),
        F.lit(p.size).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        (F.lit(first).cast("long") + F.col("before") + F.col("i")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return fitted.unionByName(cut).unionByName(whole)


def op7_packing(spark, sf_dir):
    """All documents, packed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
