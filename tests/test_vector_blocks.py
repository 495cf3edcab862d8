"""All pairs by blocks: vectors move for few blocks, and components need few edges."""

import numpy as np

from loomstone.operators import vector_graph as G


def test_blocks_grow_with_the_table():
    assert G._blocks(1_000, G.MOST) == 1 and G._blocks(5_000, G.MOST) == 3
    # 313 blocks before, so a vector moved as many times.
    assert G._blocks(640_000, G.MOST) == 12 and G._blocks(640_000, G.PAIRS) == 40
    assert 6_400_000 / G._blocks(6_400_000, G.MOST) <= G.MOST


def test_pairs_and_components_by_blocks(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = [*r.normal(size=(70, 4)).tolist(), *[[1.0, 2.0, 0.0, 0.5]] * 30]
    e = spark.createDataFrame([(int(i), x, "a" if i % 3 else "b") for i, x in zip(r.permutation(100), v, strict=True)], "id long, v array<double>, kind string")
    monkeypatch.setattr(G, "BLOCK", 9)
    d = {x.id: (np.array(x.v) / np.linalg.norm(x.v), x.kind) for x in e.collect()}
    want = {(a, b) for a in d for b in d if a < b and d[a][0] @ d[b][0] >= 0.9}
    got = [(x.a, x.b) for x in G.pairs_above(e, 0.9).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(x.a, x.b) for x in G.pairs_above(e, 0.9, same="kind").collect()} == {(a, b) for a, b in want if d[a][1] == d[b][1]}
    edges = [(x.a, x.b) for x in G.linking(e, 0.9).collect()]

    def parts(pairs):
        of = {i: i for i in d}
        while any(of[a] != of[b] for a, b in pairs):
            for a, b in pairs:
                of[a] = of[b] = min(of[a], of[b])
        return of

    assert parts(edges) == parts(want) and len(edges) < len(want)
    for a in list(d)[:20]:
        s = sorted(((-round(float(d[a][0] @ d[b][0]), 9), b) for b in d if b != a and d[a][0] @ d[b][0] > 0))[:4]
        assert [b for _, b in s] == [x.dst for x in G.knn(e.filter(f"id = {a}"), e, 4).orderBy("rank").collect()] if a < 3 else True
