"""Sets of word n-gram hashes, and their MinHash signatures, over Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes that words are hashed in at a time; powers of the base for so many.
BLOCK = 1 << 20
_tables: list[np.ndarray] = []
#: Digits, letters of either case and all bytes of other characters.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> list[np.ndarray]:
    if not _tables:
        for b in (_BASE, _INVERSE):
            p = np.full(BLOCK + 1, b, np.uint64)
            p[0] = 1
            _tables.append(np.cumprod(p, dtype=np.uint64))
    return _tables


def _block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a block of bytes."""
    power, inverse = _powers()
    word = _IS_WORD[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
    return s, mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))


def _long_word(data: np.ndarray) -> np.ndarray:
    """The hash of one word of any length, block by block; the same as _block_words gives."""
    power, _ = _powers()
    total, shift = 0, 1
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        total += int(((_LOWER[part].astype(np.uint64) + np.uint64(1)) * power[: len(part)]).sum(dtype=np.uint64)) * shift
        shift = shift * pow(int(_BASE), BLOCK, 1 << 64) % (1 << 64)
    return mix(np.array([(total + len(data)) % (1 << 64)], np.uint64))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all words: runs of digits, letters and non-ASCII, A-Z lower-cased."""
    if len(data) <= BLOCK:
        return _block_words(data)
    starts, hashes, at = [], [], 0
    while at < len(data):
        to = min(at + BLOCK, len(data))
        breaks = np.flatnonzero(~_IS_WORD[data[at:to]])
        if to < len(data) and not len(breaks):  # a word that is longer than a block
            while to < len(data) and not len(breaks):
                breaks = np.flatnonzero(~_IS_WORD[data[to : to + BLOCK]])
                to = to + int(breaks[0]) if len(breaks) else min(to + BLOCK, len(data))
            s, h = np.zeros(1, np.int64), _long_word(data[at:to])
        else:
            if to < len(data):
                to = at + int(breaks[-1]) + 1
            s, h = _block_words(data[at:to])
        starts.append(s + at)
        hashes.append(h)
        at = to
    return np.concatenate(starts), np.concatenate(hashes)


def texts(column: pa.Array) -> list[np.ndarray]:
    """The bytes of each text, without copies; a null as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    empty = np.asarray(column.is_null())
    return [data[a:b] if not n else data[:0] for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), empty, strict=True)]


def shingles(data: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams; of all its words where they are fewer; empty without any."""
    _, w = words(data)
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        h = h * _BASE + w[i : len(w) - k + 1 + i]
    return np.unique(mix(h))


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed integers."""
    a = np.bitwise_xor.reduce(mix(s + np.uint64(1))) if len(s) else np.uint64(0)
    b = mix(s + np.uint64(2)).sum(dtype=np.uint64) if len(s) else np.uint64(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def band_keys(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key a band, each of the least values that `rows` permutations give the set."""
    rng = np.random.default_rng(20240229)
    seeds = rng.integers(0, 2**64, (bands * rows, 2), np.uint64)
    low = np.array([((s ^ a) * (b | np.uint64(1))).min() for a, b in seeds])
    key = np.full(bands, np.uint64(bands))
    for i in range(rows):
        key = mix(key * _BASE + low[i::rows])
    return key.view(np.int64)
