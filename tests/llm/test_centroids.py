"""Kd-tree filtering against all distances."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelweave.llm import centroids as C


def nearest(points, centres):
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c, strict=True)) for c in centres] for p in points]
    return [row.index(min(row)) for row in d], [min(row) for row in d]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 5), st.integers(1, 9), st.integers(1, 4), st.integers(0, 10_000))
def test_filter_is_exact(n, d, k, spread, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-spread, spread + 1, (n, d)).astype(np.int64)
    centres = rng.integers(-spread, spread + 1, (k, d)).astype(np.int64)  # small integers: many ties, equal centres
    tree = C.build_tree(points, 4)
    ordered = points[tree["order"]]
    cluster, count, total, _ = C.filter_tree(tree, ordered, centres)
    want, _ = nearest(ordered, centres)
    assert cluster.tolist() == want and sorted(tree["order"].tolist()) == list(range(n))
    assert count.tolist() == [want.count(z) for z in range(k)]
    assert total.tolist() == [ordered[np.array(want) == z].sum(0).tolist() for z in range(k)]


def test_nodes_are_assigned_whole():
    rng = np.random.default_rng(0)
    middles = rng.integers(-500, 500, (8, 64))
    points = np.concatenate([m + rng.integers(-10, 11, (500, 64)) for m in middles])
    tree = C.build_tree(points)
    cluster, _, _, looked = C.filter_tree(tree, points[tree["order"]], middles)
    assert looked < 0.05 * len(points) * 8
    assert cluster.tolist() == (tree["order"] // 500).tolist()
    assert (tree["total"][0] == points.sum(0)).all() and (tree["low"][0] == points.min(0)).all()


def brute(rows, k, rounds):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(64 * x) < C.LIMIT for x in v)]
    seeds = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in seeds[:k]]
    for _ in range(rounds):
        who, _ = nearest([v for _, v in kept], centres)
        for z in range(len(centres)):
            own = [v for (_, v), w in zip(kept, who, strict=True) if w == z]
            if own:
                centres[z] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    who, dist = nearest([v for _, v in kept], centres) if kept else ([], [])
    return sorted(((i, w, x) for (i, _), w, x in zip(kept, who, dist, strict=True)), key=str), centres


def rows_of(seed, n):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=64) * 0.1 + (i % 5 == 0)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.5] * 63), (n + 3, [0.5] * 65), (n + 4, [0.5] * 63 + [None]), (n + 5, [float("nan")] + [0.1] * 63), (n + 6, [float("inf")] + [0.1] * 63), (n + 7, [-1e30] + [0.1] * 63)]
    rows += [(n + 8, [-0.0] * 64), (n + 9, [1.99e6] * 64), (None, [0.25] * 64), (3, rows[3][1]), (3, [0.75] * 64), (n + 10, rows[4][1]), (n + 11, rows[4][1])]
    return rows


@pytest.mark.parametrize(("n", "k", "rounds", "parts"), [(80, 16, 3, 3), (5, 16, 3, 1), (80, 3, 0, 2)])
def test_equals_brute_force(spark, n, k, rounds, parts):
    rows = rows_of(n, n)
    table = spark.createDataFrame([(*r, None, "x") for r in rows], "vec_id bigint, embedding array<float>, cluster int, point string").repartition(parts)
    got, centres = C.cluster_vectors(table, k=k, rounds=rounds)
    want, middles = brute(rows, k, rounds)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()), key=str) == want
    assert centres.tolist() == middles
    report = {(r["vec_id"], r["cluster"], r["distance"]): r for r in C.cluster_report(got, centres).collect()}
    assert len(report) == len({(i, w, x) for i, w, x in want})
    for (_, z, _), r in report.items():
        assert r["cluster_inertia"] == sum(x for _, w, x in want if w == z) and r["inertia"] == sum(x for *_, x in want)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, middles[z])).encode()).hexdigest()


def test_empty(spark):
    table = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id bigint, embedding array<float>")
    got, centres = C.cluster_vectors(table)
    assert got.collect() == [] and centres.shape == (0, 64) and C.cluster_report(got, centres).collect() == []
