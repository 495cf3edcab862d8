"""Token ids of whole texts, by the tokenizers library, as flat little-endian bytes.

Byte-level BPE works on pieces that a fixed pattern cuts from the text. Where
a text has no two white-space characters in a row, each space starts a new
piece and each line break is one, so the ids of the text are those of its
space-separated chunks in a row. Chunks repeat a lot, so each worker keeps a
bounded memo of the library's ids for them. Other texts, and other kinds of
tokenizer, are encoded whole.
"""

from __future__ import annotations

import os
import sys
from array import array

import numpy as np

#: A worker keeps the ids of about this many chunks, the first that it meets, so mostly frequent ones.
MEMO = 400_000
#: What the chunks can't be trusted with: white space in a row, and white space and separators besides space and line break.
_ODD = ("  ", "\n\n", " \n", "\n ", *map(chr, (0, 9, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)))
_encoders: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tok.no_truncation()
        self.tok.no_padding()
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        assert sys.byteorder == "little"
        pre = self.tok.pre_tokenizer
        self.chunked = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and self.tok.normalizer is None and type(self.tok.model).__name__ == "BPE"
        self.memo: dict[str, bytes] = {}
        self.ends = {c: b for c, b in zip(".,", self._whole([".", ","]), strict=True)} if self.chunked else {}
        #: Whether an id starts with a space or a line break, in the alphabet that bytes are written in.
        self.opens = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        self.opens[[i for t, i in self.tok.get_vocab().items() if t[:1] in ("\u0120", "\u010a")]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        kind = self.code
        return [array(kind, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _ended(self, chunk: str) -> bytes | None:
        end = self.ends.get(chunk[-1:])
        if end is not None and chunk[-2:-1].isalpha():
            known = self.memo.get(chunk[:-1])
            if known is not None:
                return known + end
        return None

    def one(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of self.dtype."""
        if not self.chunked:
            return self._whole(texts)
        get, known, asked = self.memo.get, [], []
        for text in texts:
            if any(x in text for x in _ODD):
                known.append(None)
                asked += [(text, None)]
                continue
            chunks = text.replace("\n", " \n").split(" ")
            head, chunks[0] = chunks[0], ""
            ids = list(map(get, chunks))
            ids[0] = b""
            if None in ids:
                # A known chunk and a full stop or comma are a known piece and another one.
                ids = [b if b is not None else self._ended(c) for c, b in zip(chunks, ids, strict=True)]
            new = [c for c, b in zip(chunks, ids, strict=True) if b is None] if None in ids else []
            known.append(ids)
            # The unknown chunks in a row are a text in which each starts with its space or line break.
            asked += [(head, None), ((" " + " ".join(new)).replace(" \n", "\n") if new else "", new)]
        told = iter(self._whole([t for t, _ in asked]))
        places, out = iter(asked), []
        for ids in known:
            _, first = next(places), next(told)
            if ids is None:
                out.append(first)
                continue
            (_, new), rest = next(places), next(told)
            if new:
                at = (np.flatnonzero(self.opens[np.frombuffer(rest, self.dtype)]) * self.dtype.itemsize).tolist()
                parts = [rest[i:j] for i, j in zip(at, [*at[1:], len(rest)], strict=True)]
                if len(self.memo) < MEMO:
                    self.memo.update(zip(new, parts, strict=True))
                more = iter(parts)
                ids = [next(more) if b is None else b for b in ids]
            out.append(first + b"".join(ids))
        return out


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the machine keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
