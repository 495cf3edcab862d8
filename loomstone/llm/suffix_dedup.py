"""Removal of long repeated byte strings by suffix arrays over anchored groups.

Every window of `width` bytes has an anchor: its gram of the smallest hash,
the leftmost of equal ones. Equal windows have equal grams at equal places,
so all places of a repeated window meet in the group of their anchor's hash,
and a window is in one group only. Each anchor comes with its context, the
bytes of all windows that it is the anchor of. Places with equal contexts are
one, with a weight. What is left of a group's contexts, cut to what a
neighbour in sorted order can share, goes into one suffix array, made by
linear grouping; windows that are there twice, by weight, are repeated.

A group may hold any number of different contexts, a passage of every
document, say. One that is too large for a task is split by the bytes beside
its gram: the windows of a context fall into classes by where the gram stands
in them, those of a class have all but few bytes in common, and the hash of
these names the smaller group. The same steps follow for it, in the last
round with one place a class. A window is in one group still, so nothing is
lost. A hash with a large part of all rows is counted by partial sums and
joined back without a hot task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import hot_join, keyed, scratch, written
from loomstone.llm.shingles import _BASE, _INVERSE, mix, texts
from loomstone.llm.suffix_groups import repeated_starts


@dataclass(frozen=True)
class Params:
    width: int = 200
    #: Bytes of a gram.
    gram: int = 48
    #: Different contexts of a group that goes into one suffix array; a larger group is split into smaller ones first.
    most: int = 5_000
    #: Places of the gram in a class of windows, by round of splitting; the last must be 1.
    classes: tuple[int, ...] = (20, 1)
    #: A hash with more than this part of all rows is counted by partial sums: at most the inverse of it are there.
    hot_part: float = 1 / 1000
    hot_rows: int = 1_000


#: Bytes that are searched for anchors at a time, besides the overlap.
BLOCK = 1 << 20
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(n, BLOCK + 4096)
    if not _tables or next(iter(_tables)) < n:
        _tables.clear()
        both = []
        for b in (_BASE, _INVERSE):
            p = np.full(size + 1, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _tables[size] = tuple(both)
    return next(iter(_tables.values()))


def _window_min(key: np.ndarray, w: int) -> np.ndarray:
    """The least of each w keys in a row: prefix and suffix minima of blocks of w."""
    n = len(key)
    pad = -n % w
    blocks = np.concatenate([key, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
    """first, last (starts of the anchor's windows), hash of the gram and of the context, of each anchor of a text."""
    out, n = [], len(data)
    for at in range(0, n - p.width + 1, BLOCK):
        part = data[at : at + BLOCK + p.width - 1]
        power, inverse = _powers(len(part))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], dtype=np.uint64)])
        h = mix((total[p.gram :] - total[: -p.gram]) * inverse[: len(part) - p.gram + 1])
        # The place breaks ties, so the leftmost of equal grams is the least.
        place = np.arange(len(h), dtype=np.uint64)
        low = _window_min((h >> np.uint64(22) << np.uint64(22)) | place, p.width - p.gram + 1)
        a = (low & np.uint64(2**22 - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(a) - 1]])
        a = a[first]
        context = mix((total[last + p.width] - total[first]) * inverse[first] + ((a - first) * 4096 + last - first).astype(np.uint64))
        out.append((first + at, last + at, h[a], context))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


def _find(p: Params):
    def run(batches):
        for b in batches:
            rks, found = np.asarray(b.column("rk")), []
            for rk, data in zip(rks.tolist(), texts(b.column("text")), strict=True):
                if len(data) >= p.width:
                    first, last, h, c = anchors(data, p)
                    found.append((np.full(len(first), rk), first, last - first, h.view(np.int64), c.view(np.int64)))
            if found:
                rk, first, more, h, c = (np.concatenate(x) for x in zip(*found, strict=True))
                # A text that repeats itself has an anchor at every period: equal ones of a text are one row.
                order = np.lexsort((first, c, h, rk))
                rk, first, more, h, c = (x[order] for x in (rk, first, more, h, c))
                new = np.concatenate([[True], (rk[1:] != rk[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
                at = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([at, [len(rk)]]).astype(np.int32)), pa.array(first, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(rk[at]), lists, pa.array(more[at].astype(np.int32)), pa.array(h[at]), pa.array(c[at]), pa.array(np.ones(len(at), np.int64))], names=["rk", "firsts", "more", "h", "c", "each"])

    return run


#: Windows that start at one of firsts or up to `more` places after; each of these places stands for `each` ones.
_PLACED = "rk long, firsts array<long>, more int, h long, c long, each long"


def _split(p: Params, k: int):
    """Contexts of large groups as rows of smaller ones: the windows of a class have the gram in one of k places."""

    def digest(*parts: bytes) -> int:
        out = hashlib.blake2b(digest_size=8)
        for x in parts:
            out.update(x)
        return int.from_bytes(out.digest(), "little", signed=True)

    def run(batches):
        for b in batches:
            rows = []
            for h, rk, first, n, s in zip(*(b.column(c).to_pylist() for c in ("h", "rk", "first", "n", "context")), strict=True):
                gram = _gram_place(s, p)
                least = gram - (len(s) - p.width)
                for low in range(least // k * k, gram + 1, k):
                    # From the windows' last start to their first end: all of them have these bytes.
                    common = s[max(0, gram - low) : gram - (low + k - 1) + p.width]
                    # The gram's places in the class's windows that are here.
                    a, z = max(low, least), min(low + k - 1, gram)
                    part = s[gram - z : gram - a + p.width]
                    rows.append((rk, [first + gram - z], z - a, digest(h.to_bytes(8, "little", signed=True), low.to_bytes(2, "little"), common), digest(z.to_bytes(2, "little"), part), n))
            for at in range(0, len(rows), 10_000):
                cols = list(zip(*rows[at : at + 10_000], strict=True))
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["rk", "firsts", "more", "h", "c", "each"])

    return run


def _contexts(p: Params):
    """The bytes of wanted contexts, from each document's list."""

    def run(batches):
        for b in batches:
            for i, (data, want) in enumerate(zip(texts(b.column("text")), b.column("want").to_pylist(), strict=True)):
                rk = b.column("rk")[i].as_py()
                for at in range(0, len(want), 512):
                    w = want[at : at + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["h"] for x in w], pa.int64()), pa.array([rk] * len(w), pa.int64()), pa.array([x["first"] for x in w], pa.int64()), pa.array([x["n"] for x in w], pa.int64()), pa.array([data[x["first"] : x["first"] + x["more"] + p.width].tobytes() for x in w], pa.binary())],
                        names=["h", "rk", "first", "n", "context"],
                    )

    return run


def _common(a: bytes, b: bytes) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _shared(strings: list[bytes]) -> list[int]:
    """For each string, how much of its start it shares with the one that it shares most with."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    out = [0] * len(strings)
    for x, y in zip(order[:-1], order[1:], strict=True):
        k = _common(strings[x], strings[y])
        out[x] = max(out[x], k)
        out[y] = max(out[y], k)
    return out


def _gram_place(s: bytes, p: Params) -> int:
    """Where the anchor is in a context: the gram of the smallest hash in its first window."""
    part = np.frombuffer(s[: p.width], np.uint8)
    power, inverse = _powers(p.width)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], dtype=np.uint64)])
    h = mix((total[p.gram :] - total[: -p.gram]) * inverse[: len(part) - p.gram + 1])
    return int((h >> np.uint64(22)).argmin())


def repeated_in_group(contexts: list[bytes], weights: list[int], p: Params) -> list[list[tuple[int, int]]]:
    """For each context of weight 1 in a group, stretches (from, to) of bytes whose windows are repeated."""
    at = [_gram_place(s, p) for s in contexts]
    right = _shared([s[k:] for s, k in zip(contexts, at, strict=True)])
    left = _shared([s[:k][::-1] for s, k in zip(contexts, at, strict=True)])
    # No other context shares more than this with it around the anchor.
    cut = [(max(0, k - lo), min(len(s), k + hi)) for s, k, lo, hi in zip(contexts, at, left, right, strict=True)]
    merged: dict[bytes, int] = {}
    for s, (a, b), n in zip(contexts, cut, weights, strict=True):
        if b - a >= p.width:
            merged[s[a:b]] = merged.get(s[a:b], 0) + n
    keys = list(merged)
    starts = dict(zip(keys, repeated_starts(keys, [merged[k] for k in keys], p.width), strict=True)) if keys else {}
    out = []
    for s, (a, b), n in zip(contexts, cut, weights, strict=True):
        spans: list[tuple[int, int]] = []
        if n == 1 and b - a >= p.width:
            for i in starts[s[a:b]]:
                if spans and a + i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], a + i + p.width)
                else:
                    spans.append((a + i, a + i + p.width))
        out.append(spans)
    return out


def _group_rows(batches):
    """h and the rows of each group, of batches in which equal h come together."""
    now, rows = None, []
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("h", "rk", "first", "n", "context")]
        for h, *row in zip(*cols, strict=True):
            if h != now:
                if len(rows) > 1:
                    yield rows
                now, rows = h, []
            rows.append(row)
    if len(rows) > 1:
        yield rows


def _judge(p: Params):
    def run(batches):
        out = []
        for rows in _group_rows(batches):
            spans = repeated_in_group([r[3] for r in rows], [r[2] for r in rows], p)
            out += [(r[0], r[1] + a, r[1] + b) for r, found in zip(rows, spans, strict=True) for a, b in found]
            if len(out) > 10_000:
                yield _spans(out)
                out = []
        yield _spans(out)

    return run


def _spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["rk", "a", "b"])


def _kept(batches):
    for b in batches:
        rows = []
        for data, spans in zip(texts(b.column("text")), b.column("spans").to_pylist(), strict=True):
            out, at, removed, n = [], 0, 0, 0
            end = -1
            for s in sorted((s["a"], s["b"]) for s in spans or ()):
                if s[0] > end:
                    out.append(data[at : s[0]])
                    n += 1
                    end = at = s[0]
                if s[1] > end:
                    removed += s[1] - end
                    end = at = s[1]
            out.append(data[at:])
            rows.append((len(data), removed, n, b"".join(x.tobytes() for x in out)))
        yield pa.RecordBatch.from_arrays([b.column("rk"), b.column("doc_id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.binary())], names=["rk", "doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _hot(rows: DataFrame, p: Params) -> list[int]:
    """Hashes of more than hot_part of all rows and more than hot_rows, and perhaps some that are little less frequent."""
    k = int(1 / p.hot_part)
    total, top = rows.agg(F.count(F.lit(1)), F.expr(f"approx_top_k(h, {k}, {10 * k})")).first()
    return [x[0] for x in top or [] if x[1] > max(p.hot_rows, total * p.hot_part)]


def _meet(rows: DataFrame, p: Params, root: str) -> tuple[DataFrame, DataFrame]:
    """Rows of _PLACED by group: those whose context is there twice (rk, firsts, more, each), and one row of each context that has others beside it (rk, first, more, h, n, big)."""
    hot = _hot(rows, p)
    cold = rows.filter(~F.col("h").isin(hot)) if hot else rows
    same, group = Window.partitionBy("h", "c"), Window.partitionBy("h")
    n = F.col("each") * F.size("firsts")
    # Both windows follow the repartition, one shuffle for all.
    placed = cold.repartition("h").withColumns({"n": F.sum(n).over(same), "i": F.row_number().over(same.orderBy("rk", "firsts")), "all": F.sum(n).over(group)}).filter("all > 1")
    placed = written(placed.withColumn("different", F.sum((F.col("i") == 1).cast("long")).over(group)).select("rk", "firsts", "more", "each", "h", "n", "i", "different"), f"{root}/repeated")
    big = (F.col("different") > p.most).alias("big")
    copies = placed.filter("n > 1").select("rk", "firsts", "more", "each")
    beside = placed.filter("i = 1 and different > 1").select("rk", F.col("firsts")[0].alias("first"), "more", "h", "n", big)
    if hot:
        few = rows.filter(F.col("h").isin(hot))
        told = written(few.groupBy("h", "c").agg(F.sum(n).alias("n"), F.min(F.struct("rk", F.col("firsts")[0].alias("first"), "more")).alias("one"), F.count(F.lit(1)).alias("rows")), f"{root}/hot")
        different = told.groupBy("h").agg(F.count(F.lit(1)).alias("different")).filter("different > 1")
        copies = copies.unionByName(hot_join(few, told.filter("n > 1").select("h", "c", "rows"), ["h", "c"], "rows").select("rk", "firsts", "more", "each"))
        # different: at most 1 / hot_part rows.
        beside = beside.unionByName(told.join(F.broadcast(different), "h").select("one.rk", "one.first", "one.more", "h", "n", big))
    return copies, beside


def suffix_dedup(docs: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """One row per row of docs: rk, doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    A byte goes if it is in a string of `width` bytes that starts anywhere
    else too. A null text is empty; rows of equal or null doc_id are texts of
    their own, so all of an exact copy of enough bytes goes. Other columns of
    docs are not read. A very long text is searched in blocks that overlap,
    with the same result.
    """
    root = scratch(docs.sparkSession, "suffix")
    d = keyed(docs, root).select("rk", "doc_id", "text")
    rows, spans = written(d.mapInArrow(_find(p), _PLACED), f"{root}/anchors"), None

    def contexts(beside: DataFrame, which: Column) -> DataFrame:
        wanted = beside.filter(which).groupBy("rk").agg(F.collect_list(F.struct("h", "first", "more", "n")).alias("want"))
        return wanted.hint("merge").join(d.select("rk", "text"), "rk").select("rk", "text", "want").mapInArrow(_contexts(p), "h long, rk long, first long, n long, context binary")

    for i, k in enumerate((*p.classes, 0)):
        copies, beside = _meet(rows, p, f"{root}/{i}")
        # A place that stands for several is repeated by itself, and was found before.
        found = copies.filter("each = 1").select("rk", "more", F.explode("firsts").alias("a")).select("rk", "a", (F.col("a") + F.col("more") + p.width).alias("b"))
        spans = found if spans is None else spans.unionByName(found)
        if not k:
            break
        spans = spans.unionByName(contexts(beside, ~F.col("big")).repartition("h").sortWithinPartitions("h").mapInArrow(_judge(p), "rk long, a long, b long"))
        if not beside.filter("big").limit(1).take(1):
            break
        rows = written(contexts(beside, F.col("big")).mapInArrow(_split(p, k), _PLACED), f"{root}/split-{i}")
    spans = spans.groupBy("rk").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return d.hint("merge").join(spans, "rk", "left").select("rk", "doc_id", "text", "spans").mapInArrow(_kept, "rk long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix_dedup(spark, sf_dir):
    """All documents, in the contract's columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
