"""Distances on meshes against Dijkstra's rule, labels, smoothing and morphs against dense matrices."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurolattice.operators import mesh as M


def nearest(near, seeds, limit=float("inf")):
    """(distance, seed) of each node, ties to the least seed."""
    best, heap = {}, sorted((0.0, s, n) for n, s in seeds)
    while heap:
        d, s, n = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = (d, s)
        for m, w in near.get(n, {}).items():
            if m not in best and d + w <= limit:
                heapq.heappush(heap, (d + w, s, m))
    return best


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(60), 2))): float(rng.randint(1, 9)) for _ in range(110)} | {(70, 71): 2.0}
    near = {}
    for (a, b), w in pairs.items():
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    rows = [(a, b, w) for a, m in near.items() for b, w in m.items()]
    return near, spark.createDataFrame(rows, "a long, b long, weight double").repartition(3)


def test_distances(spark, graph):
    near, edges = graph
    got = {(r["a"], r["b"]): r["dist"] for r in M.distances(edges, spark.createDataFrame([(0,), (7,), (70,), (99,)], "node long"), 11.0).collect()}
    assert got == {(s, n): d for s in (0, 7, 70, 99) for n, (d, _) in nearest(near, [(s, s)], 11.0).items()}


def test_labels(spark, graph):
    near, edges = graph
    seeds = [(3, 1), (9, 1), (20, 2), (41, 5)]
    table = spark.createDataFrame([(s, n) for n, s in seeds], "label long, node long")
    got = {(r["label"], r["node"]): r["dist"] for r in M.grow_labels(edges, table, 9.0).collect()}
    assert got == {(k, n): d for k in (1, 2, 5) for n, (d, _) in nearest(near, [x for x in seeds if x[1] == k], 9.0).items()}
    got = {r["node"]: (r["dist"], r["label"]) for r in M.grow_labels(edges, table, 9.0, overlap=False).collect()}
    assert got == nearest(near, seeds, 9.0)
    nodes = spark.createDataFrame([(n,) for n in [*range(60), 70, 71, 99]], "node long")
    got = {r["node"]: r["label"] for r in M.random_parcellation(edges, nodes, 3, F.col("node") * 7 % 61).collect()}
    first = sorted([*range(60), 70, 71, 99], key=lambda n: (n * 7 % 61, n))[:3]
    want = nearest(near, [(n, n) for n in first])
    assert got == {n: want[n][1] if n in want else None for n in [*range(60), 70, 71, 99]}
    assert M.grow_labels(edges, table.limit(0), 9.0).count() == 0


def test_triangles(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 3.0, 0.0, 0.0), (2, 0.0, 4.0, 0.0), (3, 3.0, 4.0, 12.0)], "node long, x double, y double, z double")
    tris = spark.createDataFrame([(0, 1, 2), (1, 3, 2)], "v0 long, v1 long, v2 long")
    got = {(r["a"], r["b"]): r["weight"] for r in M.edges_of_triangles(tris, points).collect()}
    one = {(0, 1): 3.0, (1, 2): 5.0, (0, 2): 4.0, (1, 3): np.sqrt(160), (2, 3): np.sqrt(153)}
    assert got.keys() == one.keys() | {(b, a) for a, b in one} and all(np.isclose(got[k], one.get(k, one.get(k[::-1]))) for k in got)


def averaged(near, known, steps, n):
    """Rows by known nodes, dense: the mean over known neighbours and itself, step by step."""
    cols = {k: i for i, k in enumerate(known)}
    value = {k: np.eye(len(known))[cols[k]] for k in known}
    while steps is None or steps > 0:
        new = {}
        for a in range(n):
            have = [value[b] for b in {a, *near.get(a, {})} if b in value]
            if have:
                new[a] = np.mean(have, 0)
        done = steps is None and len(new) == len(value)
        value = new
        if done:
            break
        steps = None if steps is None else steps - 1
    return value


@pytest.mark.parametrize("steps", [0, 1, 3])
def test_smoothing(spark, graph, steps):
    near, edges = graph
    known = [0, 5, 33, 59]
    got = {}
    for r in M.smoothing(edges, spark.createDataFrame([(k,) for k in known], "node long"), steps).collect():
        got.setdefault(r["row"], np.zeros(4))[known.index(r["col"])] = r["weight"]
    want = averaged(near, known, steps, 80)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_smoothing_fills_and_morphs(spark, graph):
    near, edges = graph
    known = [0, 33]
    table = spark.createDataFrame([(k,) for k in known], "node long")
    rows = M.smoothing(edges, table).groupBy("row").agg(F.sum("weight").alias("w")).collect()
    reach = nearest(near, [(0, 0), (33, 33)])
    assert {r["row"] for r in rows} == reach.keys() and all(abs(r["w"] - 1) < 1e-9 for r in rows)
    mapping = spark.createDataFrame([(500, 1, 0.5), (500, 2, 0.5), (501, 3, 1.0), (502, 71, 1.0)], "row long, col long, weight double")
    values = spark.createDataFrame([(0, 0, 2.0), (33, 0, -1.0)], "node long, t long, value double")
    dense = averaged(near, known, 4, 80)
    full = {k: v @ np.array([2.0, -1.0]) for k, v in dense.items()}
    got = {r["node"]: r["value"] for r in M.applied(M.morph(edges, table, mapping, 4), values).collect()}
    want = {500: 0.5 * full.get(1, 0) + 0.5 * full.get(2, 0), 501: full.get(3, 0)}
    assert got.keys() <= {500, 501} and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_split_label(spark):
    rng = np.random.default_rng(2)
    x = np.outer(np.linspace(-5, 5, 40), [0.6, 0.8, 0.0]) + 0.01 * rng.standard_normal((40, 3))
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "node long, x double, y double, z double")
    got = {r["node"]: r["part"] for r in M.split_label(points, points.filter("node < 40"), 4).collect()}
    assert [got[i] for i in range(40)] == sorted(got.values()) and set(got.values()) == {0, 1, 2, 3} and all(8 <= list(got.values()).count(k) <= 12 for k in range(4))
    assert M.split_label(points, points.limit(0), 4).count() == 0
