"""Searches by blocks against plain loops, and that no pair but the best becomes a row."""

import math

import numpy as np
import pytest

from loomstone import catalog
from loomstone.operators import adaptive_search as A
from loomstone.operators import retrieval
from loomstone.operators import vector_search as VS

SEARCHES = "vec_topk_cosine vec_topk_l2score vec_topk_min_score hier_pool hier_candidate_themes hier_episode_priority hydrate hydrate_expanded norlift_rank relevant_fallback relevant_statements search_categories search_fallback search_flatten search_methods unified_merge"


@pytest.fixture
def small(monkeypatch):
    """Many blocks of both sides, and many steps of a block."""
    for name, n in (("QUERIES", 4), ("LEAST", 16), ("MOST", 32), ("CELLS", 40)):
        monkeypatch.setattr(VS, name, n)


def sides(spark, more=()):
    r = np.random.default_rng(2)
    v = r.normal(size=(90, 6)).tolist()
    # Large groups of copies: ties go to the smaller id.
    rows = [(i, v[i % 90] if i < 90 else v[i % 3]) for i in range(200)] + list(more)
    d = spark.createDataFrame(rows, "vec_id long, v array<double>")
    return d.filter("vec_id % 20 = 0").selectExpr("vec_id as query_id", "v as q"), d, dict(rows)


def plain(name, q, v):
    if q is None or v is None or len(q) != len(v):
        return None
    if name == "cosine":
        den = math.hypot(*q) * math.hypot(*v)
        return sum(a * b for a, b in zip(q, v, strict=True)) / den if den else 0.0
    return 1 - sum((a - b) ** 2 for a, b in zip(q, v, strict=True)) if name == "l2" else -sum(abs(a - b) for a, b in zip(q, v, strict=True))


@pytest.mark.parametrize("name", ["cosine", "l2", "manhattan"])
def test_topk_with_odd_vectors(spark, small, name):
    q, d, v = sides(spark, [(300, None), (301, [1.0]), (302, [0.0] * 6), (320, None), (340, [0.0] * 6), (360, [1.0, 2.0])])
    got = {}
    for r in VS.topk(q, d, 7, VS.Score(name)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, None if r.score is None else round(r.score, 9) + 0.0))
    for i in (i for i in v if i % 20 == 0):
        s = [(j, plain(name, v[i], x)) for j, x in v.items()]
        best = sorted(((x is None, 0.0 if x is None else -round(x, 9), j) for j, x in s))[:7]
        assert sorted(got[i]) == [(k + 1, j, None if none else -x + 0.0) for k, (none, x, j) in enumerate(best)]


def test_lift_and_pool(spark, small):
    q, d, v = sides(spark)
    lift = {(r.query_id, r.item): round(r.score, 7) for r in retrieval.noisy_lift(q, d, 5).collect()}
    pool = {(r.query_id, r.fact): (round(r.norm, 7), r["rank"]) for r in A.fact_pool(q, d.withColumnRenamed("vec_id", "id"), 5).collect()}
    for i in range(0, 200, 20):
        s = np.array([plain("cosine", v[i], v[j]) for j in range(200)])
        p = 1 / (1 + np.exp(-(s - s.mean()) / (s.std() + 1e-6)))
        best = sorted(range(200), key=lambda j: (-round(s[j], 9), j))[:5]  # noqa: B023
        assert {k[1]: x for k, x in lift.items() if k[0] == i} == {j: round(p[j] / (p.mean() + 1e-6), 7) for j in best}
        assert {k[1]: x for k, x in pool.items() if k[0] == i} == {j: (round((s[j] - s.min()) / (s.max() - s.min()), 7), n + 1) for n, j in enumerate(best)}


def test_pool_of_equal_facts(spark, small):
    d = spark.createDataFrame([(i, [0.3, 0.7, 0.1]) for i in range(100)], "id long, v array<double>")
    got = A.fact_pool(d.filter("id = 5").selectExpr("id as query_id", "v as q"), d, 3).collect()
    assert sorted((r.fact, r.norm) for r in got) == [(0, 0.5), (1, 0.5), (2, 0.5)]


@pytest.mark.parametrize("name", SEARCHES.split())
def test_no_nested_loop_of_pairs(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
