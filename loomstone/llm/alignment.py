"""Tokens of two tokenizers on the same bytes: overlaps, groups and links.

Both end arrays are joined into the sorted set of all ends, which cuts the
bytes into elementary intervals. Each interval lies in one token of either
side, found by binary search, so it is one overlap. Where both sides end, a
group closes: the smallest stretch that both cut in the same way, whose
overlaps lie within its product of tokens.

Texts are taken in slices at single spaces between other characters, where
both tokenizers start anew (checked for the piece model when it is loaded),
so a very long text needs memory for its bytes and one slice's arrays. A
stretch without such a space is one slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import hot_join, keyed, scratch, written
from loomstone.llm.tokens import encoder, public_path


@dataclass(frozen=True)
class Params:
    tokenizer: str = "byte_bpe_50k.json"
    pieces: str = "piece_bpe_32k.model"
    #: What is a link: tokens that "end" together, each "overlap", or all pairs of a group ("product").
    links: str = "end"
    #: Characters of a slice, where there is a space to cut at, and of the slices taken together.
    slice_chars: int = 65_536
    step_chars: int = 500_000
    #: Pairs in more than this share of all (document, pair) rows are joined by broadcast; there are at most 1 / hot.
    hot: float = 1e-5


class Spelling:
    """What each id stands for in bytes; sequences of ids are spelled without a loop."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        total = int(n.sum())
        return self.flat[np.repeat(self.at[ids] - (np.cumsum(n) - n), n) + np.arange(total)]


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes in: printable Latin-1 ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers of a process with their spellings."""

    def __init__(self, tokenizer: str, pieces: str):
        import sentencepiece

        self.a, self.b = encoder(tokenizer), sentencepiece.SentencePieceProcessor(model_file=pieces)
        alphabet, vocabulary = byte_alphabet(), self.a.tok.get_vocab()
        a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            a[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        #: Whether a space always starts a piece.
        self.cuts = not any("▁" in x.lstrip("▁") for x in names) and self.a.chunked
        self.bytes_a, self.bytes_b = Spelling(a), Spelling(b)
        self.n_b = len(b)
        self.most = len(a) * len(b)
        # Decimal ids of A with "," or "|" after them, then those of B with "," or ";".
        self.written = Spelling([f"{i}{x}".encode() for n, last in ((len(a), "|"), (len(b), ";")) for i in range(n) for x in (",", last)])
        self.first_b = 2 * len(a)


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(tokenizer: str, pieces: str) -> Pair:
    if (tokenizer, pieces) not in _pairs:
        _pairs[tokenizer, pieces] = Pair(tokenizer, pieces)
    return _pairs[tokenizer, pieces]


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The elementary intervals' ends, the token of either side that each lies in, and whether both end there. Both sides cover the same bytes."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


def products(a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an A and a B token of one group, group after group."""
    last_a, last_b = a[shared], b[shared]
    na, nb = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    n = na * nb
    i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(nb, n)
    return np.repeat(last_a - na + 1, n) + i // wide, np.repeat(last_b - nb + 1, n) + i % wide


def slices(text: str, most: int) -> Iterator[str]:
    """The text in parts of about so many characters, without the single spaces between them."""
    at = 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        while cut > 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace() or cut + 1 == len(text)):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


@dataclass
class Part:
    """What a slice has."""

    n_a: int
    n_b: int
    n_groups: int
    n_overlaps: int
    n_products: int
    groups: bytes
    pairs: np.ndarray
    times: np.ndarray


def aligned(pair: Pair, texts: list[str], links: str) -> list[Part | None]:
    """Each text's part; None where a side's bytes are not those of the space and the text."""
    spaced = [" " + t for t in texts]
    raw_a, raw_b = pair.a.many(spaced), pair.b.encode(texts, num_threads=1)
    n_a, n_b = np.array([len(x) // pair.a.dtype.itemsize for x in raw_a]), np.array([len(x) for x in raw_b])
    ids_a = np.frombuffer(b"".join(raw_a), pair.a.dtype).astype(np.int64)
    ids_b = np.fromiter(chain.from_iterable(raw_b), np.int64, int(n_b.sum()))
    said = [t.encode() for t in spaced]
    want = np.frombuffer(b"".join(said), np.uint8)
    n_bytes = np.array([len(x) for x in said])
    bytes_a, bytes_b = pair.bytes_a.of(ids_a), pair.bytes_b.of(ids_b)
    if not (np.array_equal(bytes_a, want) and np.array_equal(bytes_b, want)):
        # Some text is not spelled by its tokens: each is compared, and the others are aligned without these.
        if len(texts) == 1:
            return [None]
        keep = []
        for spelling, ids, n, spelled in ((pair.bytes_a, ids_a, n_a, bytes_a), (pair.bytes_b, ids_b, n_b, bytes_b)):
            size = np.bincount(np.repeat(np.arange(len(texts)), n), spelling.size[ids], len(texts)).astype(int)
            keep.append([spelled[j - m : j].tobytes() == x for j, m, x in zip(np.cumsum(size), size, said, strict=True)])
        good = [i for i in range(len(texts)) if keep[0][i] and keep[1][i]]
        out: list[Part | None] = [None] * len(texts)
        for i, part in zip(good, aligned(pair, [texts[i] for i in good], links) if good else [], strict=True):
            out[i] = part
        return out
    ends_a, ends_b = np.cumsum(pair.bytes_a.size[ids_a]), np.cumsum(pair.bytes_b.size[ids_b])
    ends, own_a, own_b, shared = intervals(ends_a, ends_b)
    last_a, last_b = own_a[shared], own_b[shared]
    in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    # Texts end where both sides do, so each interval and group is one text's.
    of_end = np.searchsorted(np.cumsum(n_bytes), ends)
    of_group = of_end[shared]
    count = lambda of, w=None: np.bincount(of, w, len(texts)).astype(np.int64)
    # A's tokens of a group come after B's of earlier groups, B's after A's of this one too.
    end_a, end_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    end_a[last_a], end_b[last_b] = 1, 1
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]] = 2 * ids_a + end_a
    order[np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]] = pair.first_b + 2 * ids_b + end_b
    spelled = pair.written.of(order)
    until = np.cumsum(pair.written.size[order])[np.cumsum(n_a + n_b) - 1]
    if links == "end":
        a, b, of = last_a, last_b, of_group
    elif links == "overlap":
        a, b, of = own_a, own_b, of_end
    else:
        a, b = products(own_a, own_b, shared)
        of = np.repeat(of_group, in_a * in_b)
    key, times = np.unique(of * pair.most + ids_a[a] * pair.n_b + ids_b[b], return_counts=True)
    first = np.searchsorted(key, np.arange(len(texts) + 1) * pair.most)
    key %= pair.most
    overlaps, groups, product = count(of_end), count(of_group), count(of_group, in_a * in_b)
    start = 0
    out = []
    for i, end in enumerate(until.tolist()):
        j, k = first[i], first[i + 1]
        out.append(Part(int(n_a[i]), int(n_b[i]), int(groups[i]), int(overlaps[i]), int(product[i]), spelled[start : end - 1].tobytes(), key[j:k], times[j:k]))
        start = end
    return out


_TOKENS = "rk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, n_products long, groups_sha256 string, pairs array<long>, times array<long>"


class _Document:
    """A document's parts in order, put together."""

    def __init__(self):
        self.sums, self.links, self.sha, self.pairs, self.good, self.any = np.zeros(5, np.int64), 0, hashlib.sha256(), [], True, False

    def add(self, part: Part | None) -> None:
        self.good = self.good and part is not None
        if not self.good:
            self.pairs = []
            return
        if self.any:
            self.sha.update(b";")
        self.any = True
        self.sha.update(part.groups)
        self.sums += [part.n_a, part.n_b, part.n_groups, part.n_overlaps, part.n_products]
        self.pairs.append((part.pairs, part.times))

    def row(self) -> tuple:
        if not self.any or not self.good:
            return 0, 0, 0, 0, 0, 0, "", [], []
        pairs, times = self.pairs[0]
        if len(self.pairs) > 1:
            pairs, at = np.unique(np.concatenate([x for x, _ in self.pairs]), return_inverse=True)
            times = np.bincount(at, np.concatenate([x for _, x in self.pairs])).astype(np.int64)
        n_a, n_b, n_groups, n_overlaps, n_products = self.sums.tolist()
        return n_a, n_b, n_groups, int(times.sum()), n_overlaps, n_products, self.sha.hexdigest(), pairs, times


def _align(tokenizer: str, pieces: str, p: Params):
    names = [x.split()[0] for x in _TOKENS.split(", ")]
    schema = pa.schema([(c, pa.string() if c == "groups_sha256" else pa.list_(pa.int64()) if c in ("pairs", "times") else pa.int64()) for c in names])

    def steps(pair: Pair, texts: list[str]):
        """(place in texts, slice) in runs of about step_chars."""
        run, n = [], 0
        for i, text in enumerate(texts):
            for part in (slices(text, p.slice_chars) if pair.cuts else [text]) if text else []:
                run.append((i, part))
                n += len(part)
                if n >= p.step_chars:
                    yield run
                    run, n = [], 0
        if run:
            yield run

    def align(batches):
        pair = pair_of(tokenizer, pieces)
        for batch in batches:
            documents: list[_Document | None] = [_Document() for _ in range(batch.num_rows)]
            rows: list[tuple] = [()] * batch.num_rows
            done = 0

            def close(until: int, documents=documents, rows=rows):
                nonlocal done
                for i in range(done, until):
                    rows[i], documents[i] = documents[i].row(), None
                done = max(done, until)

            for run in steps(pair, batch.column("text").to_pylist()):
                close(run[0][0])
                for (i, _), part in zip(run, aligned(pair, [t for _, t in run], p.links), strict=True):
                    documents[i].add(part)
            close(batch.num_rows)
            if rows:
                columns = [batch.column("rk"), batch.column("doc_id"), *([r[k] for r in rows] for k in range(len(rows[0])))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return align


def align(docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B008
    """Three tables in the shared folder.

    documents: rk (row key), doc_id, n_a, n_b, n_groups, n_links, n_overlaps
    (elementary intervals), n_products (pairs within groups), groups_sha256.
    links: rk, pair, n: how often a document links an id pair; pair is
    a * (size of B's vocabulary) + b. counts: pair, a, b, total (its links in
    all documents), docs, best (none of its B id has more).

    A null or empty text, and one that either side does not spell byte by
    byte, has no tokens: zeros, an empty digest, no links. Rows of equal or
    null doc_id stay rows of their own; of an empty table all three are
    empty. Columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    root = scratch(spark, "alignment")
    tokenizer, pieces = public_path(p.tokenizer), public_path(p.pieces)
    n_b = pair_of(tokenizer, pieces).n_b
    d = keyed(docs, root).select("rk", "doc_id", "text")
    tokens = written(d.mapInArrow(_align(tokenizer, pieces, p), _TOKENS), f"{root}/tokens")
    links = tokens.select("rk", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("rk", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    sums = written(links.groupBy("pair").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("docs")).withColumns({"a": F.floor(F.col("pair") / n_b).cast("long"), "b": F.col("pair") % n_b}), f"{root}/sums")
    # A row for each entry of B's vocabulary at most.
    most = sums.groupBy("b").agg(F.max("total").alias("most"))
    counts = written(sums.join(F.broadcast(most), "b").select("pair", "a", "b", "total", "docs", (F.col("total") == F.col("most")).alias("best")), f"{root}/counts")
    return tokens.drop("pairs", "times"), links, counts


def linked(documents: DataFrame, links: DataFrame, counts: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """documents with n_best (links whose pair is a best one of its B id) and count_sum (the totals of all links' pairs)."""
    told = hot_join(links, counts.select("pair", "total", "best", "docs"), ["pair"], "docs", least=0, part=p.hot)
    sums = told.groupBy("rk").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    return documents.join(sums, "rk", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def op12_token_alignment(spark, sf_dir):
    """Every whole text by both tokenizers; links are tokens that end together."""
    p = Params()
    out = linked(*align(spark.read.parquet(f"{sf_dir}/documents.parquet"), p), p)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_products")
