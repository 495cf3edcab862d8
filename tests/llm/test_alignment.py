"""Token alignment against plain code, document by document."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.llm import alignment as A
from loomstone.llm.tokens import public_path

ODD = [None, "", " ", "  two  spaces ", "line\nbreak\t tab", "▁mark", "say <|endoftext|> and <s> </s> <unk>", "naïve 日本語 \U0001f600", "é   x", "a" * 3000, "don't stop", "\x00\x7f", "x " * 500]


def plain(texts, links="end"):
    """Each text's row by loops over tokens, with the library called on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(public_path()), sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    alphabet = A.byte_alphabet()
    rows, total, linked = [], Counter(), []
    for text in texts:
        full = (" " + (text or "")).encode()
        x = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(full.decode(), add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text or "")]
        if not text or b"".join(t for _, t in x) != full or b"".join(t for _, t in y) != full:
            rows.append((0, 0, 0, 0, ""))
            linked.append([])
            continue
        spans = []
        for side in (x, y):
            at = 0
            spans.append([(i, at, at := at + len(t)) for i, t in side])
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, start = [], 0
        for end in ends:
            groups.append([[i for i, s, e in side if start <= s and e <= end] for side in spans])
            start = end
        if links == "end":
            pairs = [(i, j) for e in ends for i, _, e1 in spans[0] if e1 == e for j, _, e2 in spans[1] if e2 == e]
        elif links == "overlap":
            pairs = [(i, j) for i, s1, e1 in spans[0] for j, s2, e2 in spans[1] if max(s1, s2) < min(e1, e2)]
        else:
            pairs = [(i, j) for g in groups for i in g[0] for j in g[1]]
        total.update(pairs)
        linked.append(pairs)
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        rows.append((len(x), len(y), len(groups), len(pairs), hashlib.sha256(said.encode()).hexdigest()))
    best = Counter()
    for (_, j), n in total.items():
        best[j] = max(best[j], n)
    return [(*r[:4], sum(total[q] == best[q[1]] for q in pairs), sum(total[q] for q in pairs), r[4]) for r, pairs in zip(rows, linked, strict=True)]


def result(spark, texts, p):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pair string")
    rows = A.linked(*A.align(docs, p), p).orderBy("doc_id").collect()
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


@pytest.mark.parametrize("links", ["end", "overlap", "product"])
def test_alignment_of_odd_texts(spark, links):
    texts = [*ODD, "the same text", "the same text", "one two three four " * 40]
    # Slices of a few characters put every cut to the test; a hot share of 0.01 sends pairs both ways.
    assert result(spark, texts, A.Params(links=links, slice_chars=12, step_chars=100, hot=0.01)) == plain(texts, links)
    assert result(spark, texts, A.Params(links=links)) == plain(texts, links)


def test_alignment_of_a_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = A.op12_token_alignment(spark, sf).collect()
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows}
    assert got == dict(zip(texts, plain(list(texts.values())), strict=True))


def test_alignment_of_no_rows_and_of_repeated_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert A.linked(*A.align(none)).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = A.linked(*A.align(twice)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_links) for r in rows] == [(None, 1), (1, 2), (1, 2)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.lists(st.integers(1, 5), min_size=1, max_size=12))
def test_intervals_are_the_overlaps(x, y):
    n = max(sum(x), sum(y))
    x, y = [*x, n - sum(x)] if sum(x) < n else x, [*y, n - sum(y)] if sum(y) < n else y
    ends, a, b, shared = A.intervals(np.cumsum(x), np.cumsum(y))
    span = lambda sizes: [(sum(sizes[:i]), sum(sizes[: i + 1])) for i in range(len(sizes))]
    want = {(i, j) for i, s in enumerate(span(x)) for j, t in enumerate(span(y)) if max(s[0], t[0]) < min(s[1], t[1])}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(ends) == len(want)
    pa, pb = A.products(a, b, shared)
    assert want <= set(zip(pa.tolist(), pb.tolist(), strict=True))
    assert set(ends[shared].tolist()) == set(np.cumsum(x).tolist()) & set(np.cumsum(y).tolist())


def test_slices_lose_single_spaces_only():
    text = "ab cd  ef gh\n ij kl "
    for most in (1, 3, 7, 50):
        assert " ".join(A.slices(text, most)) == text
