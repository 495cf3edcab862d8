"""Benchmark decontamination by pigeonhole edit matching.

A test item may be in a text with up to a budget of edits. Cut into one piece
more than that, at least one piece of it must be there unchanged. An
automaton finds all pieces of a block of items in one pass over each text;
the surroundings of a hit are verified by Myers' bit-parallel edit distance
of the whole item. Texts are compared in lower case, with each run of other
characters than letters and digits as one space.

Items go to the executors in blocks of bounded size, each a pass over the
texts, so the benchmark may be of any size; texts are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import ship

_OTHER = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Params:
    #: Edits allowed for each character of a normalised item.
    rate: float = 0.08
    #: Normalised characters of the shortest item that edits are allowed for; shorter ones are looked for exactly, as whole words.
    min_chars: int = 30
    #: Characters of items that are sent to the executors at a time.
    block_chars: int = 8_000_000


def normalised(text: str) -> tuple[str, str]:
    """The text in lower case with its length kept, and that with runs of other characters as a space."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low, _OTHER.sub(" ", low)


def places(low: str) -> list[int]:
    """For each character of the normalised text, and its end, the place in the text."""
    out, at = [], 0
    for m in _OTHER.finditer(low):
        out += range(at, m.start())
        out.append(m.start())
        at = m.end()
    return [*out, *range(at, len(low) + 1)]


class Item:
    """A test item with the bit masks of its characters, forwards and backwards."""

    def __init__(self, item_id: int | None, text: str, budget: int, whole: bool = False):
        self.id, self.text, self.budget = item_id, text, budget
        #: Short items stand on word bounds.
        self.whole = whole
        self.forward, self.backward = self._masks(text), self._masks(text[::-1])

    @staticmethod
    def _masks(text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, c in enumerate(text):
            out[c] = out.get(c, 0) | 1 << i
        return out

    def pieces(self) -> list[tuple[str, int]]:
        """Budget + 1 pieces of about equal length, with their offsets."""
        n, k = len(self.text), self.budget + 1
        cuts = [n * j // k for j in range(k + 1)]
        return [(self.text[a:b], a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(masks: dict[str, int], m: int, text: str, budget: int, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of the pattern to a stretch of text, and where it ends first; -1 beyond the budget.

    The stretch may start anywhere, or only at the text's start if anchored.
    """
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, at = ones, 0, m, budget + 1, -1
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & ones
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | anchored) & ones
        mh = mh << 1 & ones
        plus = mh | ~(xv | ph) & ones
        minus = ph & xv
        if score < best:
            best, at = score, j + 1
        elif score - (len(text) - j - 1) >= best:
            break  # each further character lowers the score by one at most
    return best, at


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[Item]):
        import ahocorasick

        self.auto, found = ahocorasick.Automaton(), {}
        for item in items:
            for piece, at in item.pieces():
                found.setdefault(piece, []).append((item, at))
        for piece, of in found.items():
            self.auto.add_word(piece, (len(piece), of))
        if items:
            self.auto.make_automaton()
        self.empty = not items

    @staticmethod
    def _covered(windows: list[tuple[int, int, int]], a: int, b: int, oldest: int) -> bool:
        for lo, hi, hit in reversed(windows):
            if hit < oldest:
                return False
            if lo <= a and b <= hi:
                return True
        return False

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """item_id, start, end, distance of the best place of each item that is in the text; the first of equal ones."""
        if self.empty or not text:
            return []
        low, flat = normalised(text)
        tried: dict[Item, list[tuple[int, int, int]]] = {}
        best: dict[Item, tuple[int, int, int]] = {}
        for last, (n, of) in self.auto.iter(flat):
            for item, at in of:
                k, m = item.budget, len(item.text)
                start = last - n + 1 - at
                if item.whole:
                    if item not in best and (start == 0 or flat[start - 1] == " ") and (start + m == len(flat) or flat[start + m] == " "):
                        best[item] = (0, start, start + m)
                    continue
                # A window already searched holds whatever this hit could be part of. Hits come in the order of their ends, so only the last windows can.
                if self._covered(tried.setdefault(item, []), start - k, start + m + k, last - 2 * (m + k)):
                    continue
                lo, hi = max(0, start - 2 * k), start + m + 2 * k
                tried[item].append((start - 2 * k, hi, last))
                had = best.get(item)
                if had and had[0] == 0:
                    continue
                window = flat[lo:hi]
                i = window.find(item.text)
                if i >= 0:
                    best[item] = (0, lo + i, lo + i + m)
                    continue
                d, e = myers(item.forward, m, window, k)
                if e >= 0 and (not had or d < had[0]):
                    _, back = myers(item.backward, m, window[:e][::-1], d, True)
                    best[item] = (d, lo + e - back, lo + e)
        if not best:
            return []
        where = places(low)
        return [(i.id, where[s], where[e], d) for i, (d, s, e) in sorted(best.items(), key=lambda x: (x[0].id is None, x[0].id or 0, x[1]))]


def items_of(benchmark: DataFrame, p: Params) -> Iterator[list[Item]]:
    """The benchmark's items in blocks. Ones without letters and digits match nothing and are left out; equal texts, and null or equal ids, stay items of their own."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text")).filter("text is not null").toLocalIterator()
    for item_id, text in rows:
        flat = normalised(text)[1].strip()
        if not flat:
            continue
        short = len(flat) < p.min_chars
        block.append(Item(item_id, flat, 0 if short else int(p.rate * len(flat)), short))
        size += len(flat)
        if size >= p.block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(items: list[tuple[int | None, str, int, bool]]):
    def run(batches):
        match = Matcher([Item(*i) for i in items])
        for b in batches:
            out = [(i, *m) for i, t in enumerate(b.column("text").to_pylist()) if t for m in match.find(t)]
            ids = b.column("doc_id").take(pa.array([r[0] for r in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in out], pa.int64()) for k in range(1, 5))], names=["doc_id", "item_id", "start", "end", "distance"])

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """One row per row of docs and item that is in it: doc_id, item_id, start, end, distance.

    The place is the best one, the first of equal ones. start and end are code points of the text. Null and empty texts hold
    nothing; rows of equal or null doc_id are searched each on its own; other
    columns are not read. Without items the result is empty. A text is
    searched whole, in time in proportion to its length however often it
    repeats a piece.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    schema = "doc_id long, item_id long, start long, end long, distance long"
    out = None
    for block in items_of(benchmark, p):
        found = d.mapInArrow(_search([(i.id, i.text, i.budget, i.whole) for i in block]), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _clean(items: list[tuple[int | None, str, int, bool]]):
    def run(batches):
        match = Matcher([Item(*i) for i in items])
        for b in batches:
            yield b.filter(pa.array([not (t and match.find(t)) for t in b.column("text").to_pylist()], pa.bool_()))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """The rows of docs, with all their columns, that hold no item; nothing is shuffled."""
    ship(docs.sparkSession)
    for block in items_of(benchmark, p):
        docs = docs.mapInArrow(_clean([(i.id, i.text, i.budget, i.whole) for i in block]), docs.schema)
    return docs


def op3_decontamination(spark, sf_dir):
    """The best place of each benchmark item in each document that holds it."""
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
