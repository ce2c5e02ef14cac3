"""Nearest positions and density clusters against all pairs."""

import numpy as np
import pytest

from voxelweave.operators import density, mergetree
from voxelweave.scratch import Scratch


def points(spark, x):
    names = ["x", "y", "z"][: x.shape[1]]
    return names, spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id bigint, " + ", ".join(f"{n} double" for n in names))


def squares(x):
    return sum((x[:, None, a] - x[None, :, a]) ** 2 for a in range(x.shape[1]))


def roots_at(m, core, h2):
    """Smallest member of each core point's component, by plain search."""
    left, out = {i for i in range(len(core)) if core[i] <= h2}, {}
    while left:
        first = min(left)
        left.discard(first)
        queue, out[first] = [first], first
        while queue:
            a = queue.pop()
            for b in [b for b in left if m[a, b] <= h2]:
                left.discard(b)
                out[b] = first
                queue.append(b)
    return out


def clumps(seed, d):
    rng = np.random.default_rng(seed)
    # no clump is so tight that the heights of the search become many
    parts = [rng.normal(0, 0.2, (80, d)), rng.normal(3, 0.3, (60, d)), rng.normal(0, 0.02, (50, d)) + 1.5, rng.uniform(-4, 7, (40, d)), np.full((9, d), 2.25)]
    return np.concatenate(parts)


@pytest.mark.parametrize(("d", "k"), [(2, 5), (3, 1), (1, 4)])
def test_nearest_positions(spark, d, k):
    x = np.round(clumps(3, d), 2)
    names, df = points(spark, x)
    got = {}
    for r in density.nearest(density.positions(df, "id", names), names, k).collect():
        got.setdefault(r["id"], {})[r["place"]] = (r["n_id"], r["n_w"], r["d2"])
    _, first, count = np.unique(x, axis=0, return_index=True, return_counts=True)
    d2, w = squares(x), dict(zip(first.tolist(), count.tolist(), strict=True))
    assert set(got) == set(w)
    for i in w:
        want = sorted((d2[i, j], j != i, j) for j in w)[: k + 1]
        assert [got[i][p] for p in range(k + 1)] == [(j, w[j], v) for v, _, j in want]


@pytest.mark.parametrize(("d", "seed", "leaf"), [(2, 2, 2), (3, 4, 32)])
def test_graph_has_the_components_of_every_height(spark, monkeypatch, d, seed, leaf):
    monkeypatch.setattr(density, "LEAF", leaf)
    x = clumps(seed, d)
    names, df = points(spark, x)
    pts, graph = density.reachability_graph(df, "id", names, 4)
    d2 = squares(x)
    core = np.sort(d2, axis=1)[:, 3]
    m = np.maximum(np.maximum(d2, core[:, None]), core[None])
    assert {r["id"]: r["core"] for r in pts.collect()} == {r["id"]: core[r["id"]] for r in pts.collect()}
    heights = [0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.0]
    got = {}
    for r in density.clusters_at(pts, graph, heights).collect():
        got.setdefault(r["level"], {})[r["id"]] = r["cluster"]
    same = 230  # first of the rows at one position
    for level, h in enumerate(heights):
        want = roots_at(m, core, h * h)
        assert got.get(level, {}) == {i: c for i, c in want.items() if i <= same}
    forest = mergetree.spanning_forest(graph)
    weights = sorted(r["weight"] for r in forest.collect())
    # a plain minimum spanning tree of all pairs, without the zero edges of one position
    inside, best, tree = {0}, m[0].copy(), []
    while len(inside) < len(x):
        best[list(inside)] = np.inf
        j = int(np.argmin(best))
        if j <= same or same not in inside:
            tree.append(best[j])
        inside.add(j)
        best = np.minimum(best, m[j])
    assert weights == pytest.approx(sorted(t for t in tree if t > 0)) or sorted(weights) == sorted(tree)[len(tree) - len(weights) :]


def plain_stable(levels, heights, least, single):
    """Stability selection over dictionaries ``{member: cluster}`` of each height."""
    live = []
    for lab in levels:
        groups = {}
        for i, c in lab.items():
            groups.setdefault(c, set()).add(i)
        live.append({c: g for c, g in groups.items() if len(g) >= least})

    def kids(i, c):
        return [] if i == 0 else [k for k, g in live[i - 1].items() if g <= live[i][c]]

    def branch(i, c):
        s = 0.0
        while True:
            s += len(live[i][c]) * (1 / heights[i - 1] - 1 / heights[i] if i else 0.0)
            k = kids(i, c)
            if len(k) != 1:
                break
            i, c = i - 1, k[0]
        return s, [(i - 1, x) for x in k]

    def best(i, c, may):
        s, below = branch(i, c)
        inner = [best(*x, True) for x in below]
        total = sum(v for v, _ in inner)
        return (s, {(c, frozenset(live[i][c]))}) if may and s >= total else (total if not may else max(s, total), set().union(*(p for _, p in inner)) if inner else set())

    top = len(heights) - 1
    return set().union(*(best(top, c, single or len(live[top]) > 1)[1] for c in live[top]), set())


def test_stable_clusters_against_plain_search(spark):
    x = clumps(7, 2)
    names, df = points(spark, x)
    pts, graph = density.reachability_graph(df, "id", names, 4)
    heights = [0.01, 0.02, 0.06, 0.1, 0.15, 0.25, 0.5, 1.0, 2.0, 4.0]
    levels = density.clusters_at(pts, graph, heights)
    d2 = squares(x)
    core = np.sort(d2, axis=1)[:, 3]
    m = np.maximum(np.maximum(d2, core[:, None]), core[None])
    plain = [roots_at(m, core, h * h) for h in heights]
    for single, least in ((False, 12), (True, 12), (True, 120)):
        got = {}
        for r in density.rows_of(df, "id", names, density.stable_clusters(levels, heights, least, single), pts).collect():
            got.setdefault(r["cluster"], set()).add(r["id"])
        want = plain_stable(plain, heights, least, single)
        assert {(c, frozenset(g)) for c, g in got.items()} == want and len(want) >= 1


def test_few_odd_and_no_rows(spark):
    schema = "id bigint, x double, y double"
    nan, inf = float("nan"), float("inf")
    odd = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, None, 1.0), (4, nan, 1.0), (5, inf, 0.0), (None, 2.0, 2.0)], schema)
    pts, graph = density.reachability_graph(odd, "id", ["x", "y"], 2)
    assert [tuple(r) for r in pts.collect()] == [(1, 2, 0.0, 0.0, 0.0)] and graph.count() == 0
    assert [tuple(r) for r in density.clusters_at(pts, graph, [1.0]).collect()] == [(0, 1, 2, 1)]
    pts, graph = density.reachability_graph(odd, "id", ["x", "y"], 3)
    assert pts.first()["core"] is None and density.clusters_at(pts, graph, [1.0]).count() == 0
    pts, graph = density.reachability_graph(odd.limit(0), "id", ["x", "y"], 3, Scratch(spark, "none"))
    levels = density.clusters_at(pts, graph, [1.0, 2.0])
    assert pts.count() == graph.count() == levels.count() == density.stable_clusters(levels, [1.0, 2.0], 2).count() == 0
    with pytest.raises(ValueError, match="ascend"):
        density.stable_clusters(levels, [2.0, 1.0], 2)


def test_edges_follow_the_rows(spark):
    """Four times as many points in two neighbouring crowds: edges grow like the points, not like their pairs."""
    rng, edges = np.random.default_rng(0), []
    for m in (100, 400):
        names, df = points(spark, np.concatenate([rng.random((m, 2)), rng.random((m, 2)) + [3.0, 0.0]]))
        edges.append(density.reachability_graph(df, "id", names, 5)[1].count())
    assert edges[1] < 8 * edges[0], edges


def test_exploded_copies_are_not_broadcast(spark):
    """Spark rates copies at all depths, and of all heights, by the small file they come from: no join may send them all."""
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(0, 9, (400, 2)), 3)
    names, df = points(spark, x)
    scratch = Scratch(spark, "plans")
    pts = scratch.keep(density.positions(df, "id", names), "positions")
    plan = density.nearest(pts, names, 3, scratch)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_closest_pairs_meet_once_in_blocks(spark):
    """Components a reach apart, at block borders and with negative places: every pair once, as by plain search."""
    x = np.array([[-1.0, 0.0], [0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [-1.0, -1.0], [0.0, 1.0], [0.75, -0.5], [2.5, 2.5]])
    act = spark.createDataFrame([(i, *map(float, p), 0.0, i) for i, p in enumerate(x)], "id bigint, x double, y double, core double, comp bigint")
    got = [(r["ca"], r["cb"], r["weight"]) for r in density.closest_pairs(act, ["x", "y"], 0.25, 1.0, Scratch(spark, "blocks"), "t").collect()]
    d2 = squares(x)
    assert sorted(got) == sorted((i, j, d2[i, j]) for i in range(len(x)) for j in range(i + 1, len(x)) if d2[i, j] <= 1.0)
