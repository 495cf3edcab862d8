"""Scores of answers beyond equal words: stems, tokens aligned by their vectors, vectors of whole texts."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import providers
from loomstone.functions.text import simple_tokens
from loomstone.shipping import ship

#: Answers whose tokens' vectors a worker holds at once.
BATCH = 512
#: The endings of steps 2, 3 and 4 of Porter's stemmer (1980) and what takes their place.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _kinds(stem: str) -> str:
    """c or v for each letter; y after a consonant is a vowel."""
    out = ""
    for i, x in enumerate(stem):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", _kinds(stem)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last one not w, x or y."""
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, endings: dict[str, str]) -> str:
    """The longest ending that the word has is replaced if what stands before it has a measure."""
    for end in sorted((e for e in endings if word.endswith(e)), key=len, reverse=True):
        stem = word[: -len(end)]
        return stem + endings[end] if _measure(stem) > 0 else word
    return word


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word by Porter's rules; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: -len(end)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                if "v" in _kinds(word[: -len(end)]):
                    word = word[: -len(end)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif _doubled(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP2), STEP3)
    for end in sorted((e for e in STEP4 if word.endswith(e)), key=len, reverse=True):
        rest = word[: -len(end)]
        if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
            word = rest
        break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stems(tokens: Column) -> Column:
    """The stems of an array of lower-case tokens; those of up to three letters stay."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda xs: None if xs is None else [stem(x) if len(x) > 3 else x for x in xs])

    return run(tokens)


def _stemmed(tokens) -> list[str]:
    return [s for x in tokens if (s := stem(x) if len(x) > 3 else x)]


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a bit for each place of b, which is 0 once the row of the table rises there."""
    at: dict[str, int] = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << i
    row = whole = (1 << len(b)) - 1
    for x in a:
        if here := row & at.get(x, 0):
            row = (row + here | row - here) & whole
    return len(b) - row.bit_count()


def _rouge(a: list[str], b: list[str]) -> tuple[float, float, float]:
    pairs = [Counter(map("\0".join, zip(x, x[1:], strict=False))) for x in (a, b)]
    hits = (Counter(a) & Counter(b)).total(), (pairs[0] & pairs[1]).total(), _common(a, b)
    n, two = len(a) + len(b), max(len(a) - 1, 0) + max(len(b) - 1, 0)
    return tuple(2.0 * h / m if m else 0.0 for h, m in zip(hits, (n, two, n), strict=True))


def stemmed_rouge(answers: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """evaluation.rouge of stems: answers with rouge1, rouge2 and rougel. A null text is empty.

    Counted in Python: a fold over arrays takes the square of a text's length in copies.
    """
    ship(answers.sparkSession)
    d = answers.withColumns({"_a": simple_tokens(F.col(predicted)), "_b": simple_tokens(F.col(gold))})

    def run(frames):
        for pdf in frames:
            rows = [_rouge(_stemmed(a), _stemmed(b)) for a, b in zip(pdf["_a"], pdf["_b"], strict=True)]
            scores = pd.DataFrame(rows, columns=["rouge1", "rouge2", "rougel"], index=pdf.index, dtype=float)
            yield pd.concat([pdf.drop(columns=["_a", "_b"]), scores], axis=1)

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in answers.schema)
    return d.mapInPandas(run, f"{names}, rouge1 double, rouge2 double, rougel double")


def aligned(answers: DataFrame, predicted: str = "predicted", gold: str = "gold", embed: providers.Embedder = providers.hashed_trigrams) -> DataFrame:
    """answers with precision, recall, alignment (their F1) and similarity, all at least 0.

    Each token of the answer goes with the token of the reference whose
    vector is nearest by cosine, and the other way; precision and recall are
    the means of these cosines. similarity is the cosine of both texts'
    vectors. 0 where either text has no token. An embedder is asked for each
    distinct token of a batch of BATCH rows at most once.
    """
    ship(answers.sparkSession)
    d = answers.withColumns({"_a": simple_tokens(F.col(predicted)), "_b": simple_tokens(F.col(gold))})

    def unit(v) -> np.ndarray:
        v = np.asarray(v, float)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, n, out=np.zeros_like(v), where=n > 0)

    def run(frames):
        for pdf in (f.iloc[a : a + BATCH] for f in frames for a in range(0, max(1, len(f)), BATCH)):
            words = sorted({w for c in ("_a", "_b") for xs in pdf[c] for w in xs})
            of, place = unit(embed(words)) if words else None, {w: i for i, w in enumerate(words)}
            texts = sorted({x or "" for c in (predicted, gold) for x in pdf[c]})
            at = {x: i for i, x in enumerate(texts)}
            vecs = unit(embed(texts)) if texts else None
            whole = [[vecs[at[x or ""]] for x in pdf[c]] for c in (predicted, gold)]
            rows = []
            for a, b, x, y in zip(pdf["_a"], pdf["_b"], *whole, strict=True):
                if not len(a) or not len(b):
                    rows.append((0.0, 0.0, 0.0, 0.0))
                    continue
                sims = of[[place[w] for w in a]] @ of[[place[w] for w in b]].T
                p, r = max(0.0, float(sims.max(axis=1).mean())), max(0.0, float(sims.max(axis=0).mean()))
                rows.append((p, r, 2 * p * r / (p + r) if p + r else 0.0, max(0.0, float(x @ y))))
            scores = pd.DataFrame(rows, columns=["precision", "recall", "alignment", "similarity"], index=pdf.index, dtype=float)
            yield pd.concat([pdf.drop(columns=["_a", "_b"]), scores], axis=1)

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in answers.schema)
    return d.mapInPandas(run, f"{names}, precision double, recall double, alignment double, similarity double")
