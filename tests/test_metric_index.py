"""Pairs by cells against all pairs, and how much is compared."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loomstone.operators import metric_index as M
from loomstone.operators import vector_graph as G


def vectors(spark, n, clusters, spread, dim=12, seed=3):
    r = np.random.default_rng(seed)
    cents = r.normal(size=(clusters, dim))
    rows = [(i * 3, (cents[i % clusters] + spread * r.normal(size=dim)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, v array<double>")


def rows(d):
    return sorted((r.a, r.b, round(r.sim, 9)) for r in d.collect())


@pytest.mark.parametrize(("threshold", "clusters", "spread"), [(0.95, 20, 0.1), (0.4, 5, 0.8), (0.7, 1, 1.0), (1.0, 4, 0.0)])
def test_no_pair_is_lost(spark, threshold, clusters, spread):
    d = vectors(spark, 300, clusters, spread)
    # Small blocks make many units of a cell.
    for strict in (False, True):
        threshold_ = min(threshold, 0.999999)
        assert rows(M.Cells(d, threshold_, block=16, pivots=12).pairs(strict)) == rows(G.pairs_above(d, threshold_, strict=strict))
    assert rows(M.pairs_above(d, threshold_)) == rows(G.pairs_above(d, threshold_))


def test_work_grows_slower_than_the_square(spark):
    n = [400, 1600]
    work = [M.Cells(vectors(spark, k, k // 20, 0.05), 0.95, pivots=k // 20).comparisons() for k in n]
    assert work[1] < 8 * work[0] and work[1] < n[1] * (n[1] - 1) / 2 / 8


def test_odd_vectors(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [0.0, 1.0])], "id int, v array<double>")
    got = M.pairs_above(d, 0.5)
    assert rows(got) == [(1, 2, 1.0)] and dict(got.dtypes)["a"] == "int"
    assert M.pairs_above(d.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError):
        M.Cells(d, 0.0)
    assert M.pairs_above(d.filter("id in (1, 6)"), -1.0).count() == 1


def test_cells_that_all_vectors_visit_become_few(spark):
    """Fails where each vector is copied to every later one of the cells."""
    d = vectors(spark, 400, 400, 1.0)
    wide = M.Cells(d, 0.35, pivots=128)
    visits = wide.rows.selectExpr("avg(size(visits))").first()[0]
    assert wide.pivots == 32 and visits <= M.VISITS
    assert rows(wide.pairs()) == rows(G.pairs_above(d, 0.35))
    # Cells that keep vectors apart stay.
    assert M.Cells(vectors(spark, 400, 100, 0.001), 0.9999, pivots=64).pivots == 64


def test_a_unit_holds_few_similarities_at_once():
    """Fails where all similarities of two blocks are made together."""
    r = np.random.default_rng(1)
    v = r.normal(size=(6000, 8))
    block = pa.table({"id": pa.array(np.arange(6000)), "v": pa.array(list(v), pa.list_(pa.float64()))})
    tracemalloc.start()
    got = M._near(block, block, 0.995, False, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All at once are 288 MB.
    assert peak < 100e6
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.995, 1))
    assert len(i) and sorted(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)) == list(zip(i.tolist(), j.tolist(), strict=True))
