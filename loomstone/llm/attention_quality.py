"""Document quality by attention over passages, learned from labels of whole documents.

A document is a bag of passages of about 50 words. A passage is encoded by
the mean of its words' vectors (one for the word's hash, one for its shape)
and a few shares, through a layer with tanh. Gated attention, a softmax over
the document's passages of w (tanh(V h) * sigmoid(U h)), weighs them, and the
weighted sum of encodings goes into a logistic output. All of it is learned
together from the documents' labels alone, so the attention finds by itself
which passages decide. Labels, languages, sources and ids are no inputs.

The model is fitted on a bounded sample in one task and kept as a table;
documents are scored where they are.
"""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import scratch, text_of, written


@dataclass(frozen=True)
class Params:
    passage: int = 50
    #: Rows of the table of word vectors, width of an encoding, width of the attention.
    words: int = 1 << 14
    width: int = 16
    attention: int = 8
    #: Labelled documents to learn from, about; longer ones than so many characters are scored, but not learned from.
    sample: int = 8_000
    sample_chars: int = 50_000
    steps: int = 900
    batch: int = 32
    rate: float = 0.01
    decay: float = 1e-4
    threshold: float = 0.3
    seed: int = 7
    #: Words that are encoded together, about.
    step: int = 100_000


SHAPES = 4 * 64
STATS = 5
#: A worker keeps the features of this many words.
MEMO = 300_000


def word_features(word: str, rows: int) -> tuple[int, int, int, int]:
    """Hash row, shape (case and the punctuation at its end), length, characters of punctuation."""
    bare = word.rstrip(string.punctuation)
    tail = word[len(bare) :]
    case = 0 if not bare else 1 if bare.islower() else 2 if len(bare) > 1 and bare.isupper() else 3
    symbols = len(tail) if bare.isalnum() else sum(c in string.punctuation for c in word)
    return zlib.crc32(bare.lower().encode("utf-8", "surrogatepass")) % rows, case * 64 + (zlib.crc32(tail.encode()) % 63 + 1 if tail else 0), len(word), symbols


class Words:
    """Features of words, each found once as long as there is room."""

    def __init__(self, rows: int):
        self.rows, self.known = rows, {}
        self.table = np.zeros((MEMO, 4), np.int32)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A number for each word, equal for equal words of this call, and the table of features that it counts in."""
        at = list(map(self.known.get, words))
        table = self.table
        if None in at:
            fresh = list(dict.fromkeys(w for w, k in zip(words, at, strict=True) if k is None))
            made = np.array([word_features(w, self.rows) for w in fresh], np.int32)
            n = len(self.known)
            more = dict(zip(fresh, range(n, n + len(fresh)), strict=True))
            if n + len(fresh) <= MEMO:
                self.table[n : n + len(fresh)] = made
                self.known.update(more)
            else:
                table = np.concatenate([self.table[:n], made])
            at = [more[w] if k is None else k for w, k in zip(words, at, strict=True)]
        return np.array(at, np.int64), table


@dataclass
class Bags:
    """Documents' passages: each word's row and shape, each passage's first word and shares, each document's first passage."""

    rows: np.ndarray
    shapes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    stats: np.ndarray
    docs: np.ndarray


def bags(texts: list[str], words: Words, passage: int) -> Bags:
    """A document without words is one passage of none."""
    split = [t.split() for t in texts]
    sizes, docs = [], []
    for w in split:
        n, k = len(w), max(1, round(len(w) / passage))
        docs.append(len(sizes))
        sizes += [(i + 1) * n // k - i * n // k for i in range(k)]
    size = np.array(sizes, np.int64)
    at, table = words.of(list(chain.from_iterable(split)))
    f = table[at] if len(at) else np.zeros((0, 4), np.int32)
    of = np.repeat(np.arange(len(size)), size)
    total = lambda x: np.bincount(of, x, len(size))
    n = np.maximum(size, 1)
    again = np.zeros(len(at))
    again[1:] = (at[1:] == at[:-1]) & (of[1:] == of[:-1])
    distinct = np.bincount(np.unique(of * (len(table) + 1) + at) // (len(table) + 1), minlength=len(size))
    chars = total(f[:, 2])
    stats = np.stack([np.log1p(size) / 5, chars / n / 10, total(f[:, 3]) / np.maximum(chars, 1), total(again) / n, np.where(size, 1 - distinct / n, 0)], 1)
    return Bags(f[:, 0].astype(np.int64), f[:, 1].astype(np.int64), np.cumsum(size) - size, size, stats.astype(np.float32), np.array(docs, np.int64))


def sums_of(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of rows, 0 for an empty run."""
    out = np.zeros((len(sizes), *x.shape[1:]), x.dtype)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(x, starts[some], axis=0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))))


def new_model(p: Params) -> dict[str, np.ndarray]:
    r = np.random.default_rng(p.seed)
    n = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-1])).astype(np.float32)
    zero = lambda *shape: np.zeros(shape, np.float32)
    # Word vectors begin at nothing: a word that no label speaks of stays without effect.
    return {"words": zero(p.words, p.width), "shapes": n(SHAPES, p.width), "shares": n(STATS, p.width), "bias": zero(p.width), "V": n(p.attention, p.width), "U": n(p.attention, p.width), "w": n(p.attention), "out": n(p.width), "out_bias": zero(1)}


def forward(m: dict[str, np.ndarray], b: Bags) -> dict[str, np.ndarray]:
    """h (encodings), t and g (the attention's two halves), a (weights, 1 over each document), z (weighted encodings), score."""
    inner = sums_of(m["words"][b.rows] + m["shapes"][b.shapes], b.starts, b.sizes) / np.maximum(b.sizes, 1)[:, None]
    h = np.tanh(inner + b.stats @ m["shares"] + m["bias"])
    t, g = np.tanh(h @ m["V"].T), sigmoid(h @ m["U"].T)
    e = (t * g) @ m["w"]
    n = np.diff(b.docs, append=len(e))
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, b.docs), n))
    a = e / np.repeat(np.add.reduceat(e, b.docs), n)
    z = np.add.reduceat(a[:, None] * h, b.docs, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": sigmoid(z @ m["out"] + m["out_bias"][0]), "n": n}


def gradients(m: dict[str, np.ndarray], b: Bags, y: np.ndarray) -> dict[str, np.ndarray | tuple]:
    """Of the mean cross-entropy; those of words are (rows, their gradients)."""
    f = forward(m, b)
    h, t, g, a, n = (f[k] for k in ("h", "t", "g", "a", "n"))
    d = ((f["score"] - y) / len(y)).astype(np.float32)
    dz = np.repeat(d[:, None] * m["out"], n, axis=0)
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, b.docs), n))
    dt, dg = de[:, None] * m["w"] * g * (1 - t * t), de[:, None] * m["w"] * t * g * (1 - g)
    dx = (a[:, None] * dz + dt @ m["V"] + dg @ m["U"]) * (1 - h * h)
    of_word = np.repeat(dx / np.maximum(b.sizes, 1)[:, None], b.sizes, axis=0)
    rows, at = np.unique(b.rows, return_inverse=True)
    spread = lambda where, k: np.stack([np.bincount(where, of_word[:, i], k) for i in range(of_word.shape[1])], 1).astype(np.float32)
    return {"words": (rows, spread(at, len(rows))), "shapes": spread(b.shapes, SHAPES), "shares": b.stats.T @ dx, "bias": dx.sum(0), "V": dt.T @ h, "U": dg.T @ h, "w": (t * g).T @ de, "out": f["z"].T @ d, "out_bias": d.sum(keepdims=True)}


def fit(texts: list[str], labels: list[int], p: Params) -> dict[str, np.ndarray]:
    """A model by Adam on batches of documents; without labels of both kinds the output is their share alone."""
    m, y = new_model(p), np.array(labels, np.float32)
    share = (y.sum() + 1) / (len(y) + 2)
    m["out_bias"][:] = np.log(share / (1 - share))
    if len(set(labels)) < 2:
        m["out"][:] = 0
        return m
    words, r = Words(p.words), np.random.default_rng(p.seed + 1)
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    order = np.empty(0, np.int64)
    for step in range(1, p.steps + 1):
        if len(order) < p.batch:
            order = np.concatenate([order, r.permutation(len(texts))])
        batch, order = order[: p.batch].tolist(), order[p.batch :]
        grads = gradients(m, bags([texts[i] for i in batch], words, p.passage), y[batch])
        rate = p.rate * min(1.0, 2 * (1 - (step - 1) / p.steps)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, got in grads.items():
            at, d = got if isinstance(got, tuple) else (slice(None), got)
            d = d + p.decay * m[k][at]
            first[k][at] = 0.9 * first[k][at] + 0.1 * d
            second[k][at] = 0.999 * second[k][at] + 0.001 * d * d
            m[k][at] -= (rate * first[k][at] / (np.sqrt(second[k][at]) + 1e-8)).astype(np.float32)
    return m


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text is divisible by 5; those without an id too."""
    return F.coalesce(F.crc32(doc_id.cast("bigint").cast("string")) % 5 == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """text, y, h of about p.sample labelled documents that are not held out, chosen by a hash of their id; of an id's texts the smallest, of its labels too."""
    d = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1)").filter(~held_out(F.col("id")))
    d = d.groupBy("id").agg(F.min("y").alias("y"))
    n = d.count()
    chance = 1.0 if n <= p.sample else p.sample / n
    h = F.xxhash64(F.lit("quality"), "id")
    # Independent draws: p.sample of them on average, hardly ever 10 % more.
    few = d.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 30)) < int(chance * (1 << 30)))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), text_of(docs).alias("text")).filter(F.length("text") <= p.sample_chars)
    return texts.join(F.broadcast(few), "id").groupBy("id", "y", "h").agg(F.min("text").alias("text")).select("text", "y", "h")


def _fit(p: Params):
    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        model = fit([r["text"] for r in rows], [r["y"] for r in rows], p)
        yield pa.RecordBatch.from_pydict({"name": list(model), "shape": [list(v.shape) for v in model.values()], "data": [v.astype("<f4").tobytes() for v in model.values()]}, pa.schema([("name", pa.string()), ("shape", pa.list_(pa.int64())), ("data", pa.binary())]))

    return run


def trained(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> dict[str, np.ndarray]:  # noqa: B008
    """The model of docs' labels, fitted in one task on the sample, whose size is bounded, and written; about a megabyte comes to the driver."""
    root = scratch(docs.sparkSession, "quality-model")
    sample = written(training_sample(docs, labels, p), f"{root}/sample")
    model = written(sample.repartition(1).sortWithinPartitions("h", "text").mapInArrow(_fit(p), "name string, shape array<long>, data binary"), f"{root}/model")
    return {r.name: np.frombuffer(bytes(r.data), "<f4").reshape(r.shape) for r in model.collect()}


def _score(model: dict[str, np.ndarray], p: Params):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_passages", pa.int64()), ("top_passage", pa.int64()), ("top_weight", pa.float64())])

    def score(batches):
        words = Words(len(model["words"]))
        for batch in batches:
            texts, i = batch.column("text").to_pylist(), 0
            while i < len(texts):
                j, n = i, 0
                while j < len(texts) and (j == i or n + len(texts[j]) // 6 <= p.step):
                    n += len(texts[j]) // 6
                    j += 1
                b = bags(texts[i:j], words, p.passage)
                f = forward(model, b)
                top = np.array([int(x.argmax()) for x in np.split(f["a"], b.docs[1:])])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *map(pa.array, (f["score"].astype(np.float64), f["n"], top, f["a"][b.docs + top].astype(np.float64)))], schema=schema)
                i = j

    return score


def scored(docs: DataFrame, model: dict[str, np.ndarray], p: Params = Params()) -> DataFrame:  # noqa: B008
    """doc_id, score (0 to 1, how likely label 1 is), predicted, n_passages, top_passage and top_weight (the passage with most attention, from 0).

    Every row is scored by its whole text, equal and null ids included; a null
    or empty text is one empty passage. A very long text is one list of words
    in memory. Columns besides doc_id and text are not read.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    out = d.mapInArrow(_score(model, p), "doc_id long, score double, n_passages long, top_passage long, top_weight double")
    return out.withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))


def op11_quality_classifier(spark, sf_dir):
    """Every document's score by a model of the labels that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs, trained(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages", "top_passage", "top_weight")
