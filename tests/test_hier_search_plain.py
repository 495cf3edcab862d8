"""The flagship's themes and facts, in their order, against loops over all vectors."""

import math

import pytest

from loomstone import catalog

SF = "/root/testdata/sf0.001"


def cos(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


def nearest(of, vectors, k=10):
    """The k nearest others of a vector, with their cosines, which are above 0."""
    sims = sorted((-round(cos(vectors[of], v), 9), i) for i, v in vectors.items() if i != of)
    return {i: cos(vectors[of], vectors[i]) for s, i in sims[:k] if cos(vectors[of], vectors[i]) > 0}


def cover(scores, vectors, most):
    """Items picked one by one for what they newly cover and their score."""
    items = sorted(scores, key=lambda i: (-scores[i], i))
    reach = {i: {i: 1.0} | {j: s for j, s in nearest(i, vectors).items() if j in scores} for i in items}
    low, high = min(scores.values()), max(scores.values())
    norm = {i: (scores[i] - low) / (high - low) if high > low else 0.5 for i in items}
    total = sum(s for r in reach.values() for s in r.values()) or 1.0
    covered, taken = set(), []
    while len(taken) < most and len(covered) < len(items):
        gain = {i: 0.7 * sum(s for j, s in reach[i].items() if j not in covered) / total + 0.3 * norm[i] for i in items if i not in taken}
        best = max(gain, key=lambda i: (gain[i], -items.index(i)))
        if gain[best] <= 0:
            break
        taken.append(best)
        covered |= set(reach[best])
    return taken or items[:1]


@pytest.fixture(scope="module")
def got(spark):
    rows = catalog.QUERIES["hier_search"](spark, SF).filter("kind <> 'episodic'").collect()
    return {(r.query_id, r.kind, r.rank): r.item for r in rows}


def test_themes_and_facts(spark, got):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    v, theme = {r.vec_id: [float(x) for x in r.embedding] for r in e}, {r.vec_id: r.label for r in e}
    members = {t: [i for i in v if theme[i] == t] for t in set(theme.values())}
    cents = {t: [sum(v[i][d] for i in m) / len(m) for d in range(len(v[m[0]]))] for t, m in members.items()}
    want = {}
    for q in (i for i in v if i % 50 == 0):
        score = {i: cos(v[q], x) for i, x in v.items()}
        pool = sorted(v, key=lambda i: (-round(score[i], 9), i))[:40]
        themes = cover({t: cos(v[q], cents[t]) for t in {theme[i] for i in pool}}, cents, 5)
        facts = {i: score[i] for i in pool if theme[i] in themes}
        picked = cover(facts, v, 20) if facts else pool[:1]
        want |= {(q, "theme", n): t for n, t in enumerate(themes, 1)} | {(q, "semantic", n): i for n, i in enumerate(picked, 1)}
    assert got == want
