"""The flat graph against brute force."""

import numpy as np
import pytest

from partloom.llm import flatgraph

ROWS = "vec_id long, embedding array<float>, label int, links string"


def expected(rows, least=flatgraph.LEAST):
    """Links by comparing all pairs, and the smallest id reachable of every row."""
    ok = [k for k, (i, v, *_) in enumerate(rows) if i is not None and v and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    links, of = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while of[a] != a:
            a = of[a]
        return a

    for dim in {len(rows[k][1]) for k in ok}:
        own = [k for k in ok if len(rows[k][1]) == dim]
        x = flatgraph.unit(np.array([np.float32(rows[k][1]) for k in own], np.float64))
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1))):
            links[own[a]] += 1
            links[own[b]] += 1
            of[find(own[a])] = find(own[b])
    least_of = {}
    for k in ok:
        least_of[find(k)] = min(least_of.get(find(k), rows[k][0]), rows[k][0])
    return [(i, links[k], least_of.get(find(k), i) if k in ok else i) for k, (i, *_) in enumerate(rows)]


def clouds(seed, n, groups, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for size, noise in groups:
        x = np.vstack([x, rng.normal(size=dim) + noise * rng.normal(size=(size, dim))])
    return x[rng.permutation(len(x))]


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] if r[2] is not None else -1)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"] or r["vec_id"] is None) for r in got)


@pytest.mark.parametrize("part", [64, 4096])
def test_links_are_those_of_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(flatgraph, "PART", part)
    x = clouds(3, 500, [(60, 0.1), (40, 0.22), (2, 0.05), (3, 0.01)])
    rows = [(int(3 * k), [float(e) for e in v], k % 3, "a") for k, v in enumerate(x)]
    rows += [(5, rows[0][1], 0, ""), (6, rows[0][1], 0, ""), (6, rows[0][1], 1, "")]  # copies, one with an id of its own twice
    got = flatgraph.digest(spark.createDataFrame(rows, ROWS)).collect()
    want = expected(rows)
    if part == 4096:
        same(got, want)
    found, whole = sum(r["n_links"] for r in got), sum(n for _, n, _ in want)
    assert 0.98 * whole <= found <= whole and got[0]["audited_recall"] >= flatgraph.RECALL


def test_odd_vectors_stay_alone(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 0.0]), (None, [1.0, 2.0]), (11, [-0.0, 1.0]), (10, [0.0, 1.0])]
    rows = [(i, v, None, None) for i, v in odd]
    same(flatgraph.digest(spark.createDataFrame(rows, ROWS)).collect(), expected(rows))
    assert flatgraph.digest(spark.createDataFrame([], ROWS)).collect() == []
    assert [tuple(r)[:4] for r in flatgraph.digest(spark.createDataFrame([(1, None, 1, "")], ROWS)).collect()] == [(1, 0, 1, True)]


def test_parts_of_one_shard_meet(spark, monkeypatch):
    """Points that centroids don't part, in several parts: all of them linked, whichever part they are in."""
    monkeypatch.setattr(flatgraph, "PART", 50)
    monkeypatch.setattr(flatgraph, "FIT_BYTES", 0)
    x = clouds(5, 60, [(90, 0.05)])
    rows = [(k, [float(e) for e in v], 0, "") for k, v in enumerate(x)]
    same(flatgraph.digest(spark.createDataFrame(rows, ROWS)).collect(), expected(rows))


def test_a_graph_finds_its_points():
    x = flatgraph.unit(clouds(8, 1500, [(300, 0.15)]))
    g = flatgraph.Graph(x, flatgraph.build(x))
    assert (g.links >= 0).sum(1).max() <= 4 * flatgraph.DEGREE and ((g.links >= 0).sum(1) > 0).all()
    got = {(a, b) for i, j in g.in_range(x, 0.95) for a, b in zip(i.tolist(), j.tolist())}
    want = set(zip(*(c.tolist() for c in np.nonzero(x @ x.T >= 0.95))))
    assert got <= want and len(got) >= 0.99 * len(want)


def test_the_audit_sees_what_is_lost(spark):
    x = clouds(9, 20, [(50, 0.1)])
    _, points = flatgraph.points_of(spark.createDataFrame([(k, [float(e) for e in v], 0, "") for k, v in enumerate(x)], ROWS))
    counted, _, recall = flatgraph.near_duplicates(points)
    assert recall == 1.0 and flatgraph.audited(points, counted.where("point % 2 = 0")) < 0.9
