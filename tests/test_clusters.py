"""Clusters on any adjacency and threshold-free enhancement, against enumeration."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurolattice.operators import clusters as C
from neurolattice.operators import stats as S


def labelled(nodes, edges):
    """The least node that each node reaches."""
    near = {n: {n} for n in nodes}
    for a, b in edges:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for n in sorted(nodes):
        if n in out:
            continue
        todo, seen = [n], {n}
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out |= {m: n for m in seen}
    return out


def test_components(spark):
    rng = random.Random(1)
    shapes = {0: ([*range(40)], [(i, i + 1) for i in range(39)]), 1: ([*range(60)], [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]), 2: ([5, 9], [])}
    shuffled = rng.sample(range(50), 50)
    shapes[3] = (shuffled, list(zip(shuffled[:-1], shuffled[1:], strict=True)))  # a path that visits its nodes in no order
    shapes[4] = ([*range(30)], [(0, i) for i in range(1, 30)])
    nodes = spark.createDataFrame([(k, 1, n) for k, (ns, _) in shapes.items() for n in ns], "perm long, sign long, node long")
    edges = spark.createDataFrame([(k, 1, *e) for k, (_, es) in shapes.items() for a, b in es for e in ((a, b), (b, a))], "perm long, sign long, a long, b long")
    got = {(r["perm"], r["node"]): r["label"] for r in C.components(nodes, edges).collect()}
    assert got == {(k, n): c for k, (ns, es) in shapes.items() for n, c in labelled(ns, es).items()}
    assert C.components(nodes.limit(0), edges).count() == 0


def maps_of(spark, values):
    """values: draws x channels x times."""
    rows = [(int(p), int(c), int(t), float(v)) for (p, c, t), v in np.ndenumerate(values)]
    return spark.createDataFrame(rows, "perm long, ch long, t long, t_value double")


def space_of(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


PAIRS = [(0, 1), (1, 2), (2, 0), (3, 4)]


def clusters_of(x, threshold, max_step, tail):
    out = []
    for sign in (1, -1):
        if tail and sign != tail:
            continue
        nodes = [(c, t) for (c, t), v in np.ndenumerate(x) if sign * v > threshold]
        edges = [((c, t), (c, t + d)) for c, t in nodes for d in range(1, max_step + 1)] + [((a, t), (b, t)) for a, b in PAIRS for t in range(x.shape[1])]
        label = labelled(nodes, edges)
        for name in sorted(set(label.values())):
            cells = [n for n in nodes if label[n] == name]
            out.append((sign, name, len(cells), sum(x[n] for n in cells), cells))
    return out


@pytest.mark.parametrize(("max_step", "tail"), [(1, 0), (2, 1)])
def test_cluster_test(spark, max_step, tail):
    x = np.random.default_rng(3).standard_normal((12, 5, 7)) * 1.5
    judged, own = C.cluster_test(C.as_nodes(maps_of(spark, x)), 12, 1.0, C.in_time(space_of(spark, PAIRS), max_step), tail)
    found = [clusters_of(m, 1.0, max_step, tail) for m in x]
    tops = [max((abs(c[3]) for c in f), default=0) for f in found]
    want = {(s, name): (n, round(mass, 9), sum(t >= abs(mass) * (1 - 1e-12) for t in tops) / 12) for s, name, n, mass, _ in found[0]}
    got = {(r["sign"], (r["label"]["ch"], r["label"]["t"])): (r["size"], round(r["mass"], 9), r["p_value"]) for r in judged.collect()}
    assert got == want and own.count() == sum(v[0] for v in want.values())


def test_general_adjacency_exclusion_and_power(spark):
    x = np.random.default_rng(5).standard_normal((4, 1, 30)) * 2
    cells = maps_of(spark, x).select("perm", F.col("t").alias("node"), "t_value")
    pairs = [(i, (i * 7 + 3) % 30) for i in range(30)]
    gone = [3, 11]
    judged, _ = C.cluster_test(cells, 4, 1.2, C.by(space_of(spark, pairs)), t_power=0, exclude=spark.createDataFrame([(g,) for g in gone], "node long"))
    want = {}
    for sign in (1, -1):
        nodes = [i for i in range(30) if sign * x[0, 0, i] > 1.2 and i not in gone]
        label = labelled(nodes, pairs)
        want |= {(sign, name): sign * sum(v == name for v in label.values()) for name in label.values()}
    assert {(r["sign"], r["label"]): r["mass"] for r in judged.collect()} == want
    alone, _ = C.cluster_test(cells, 4, 1.2, C.none)
    assert alone.count() == sum(abs(v) > 1.2 for v in x[0, 0])


def test_step_down(spark):
    """A cluster under the level is left out of the draws, so a smaller one gets a smaller p."""
    x = np.zeros((10, 1, 12))
    x[0, 0, :4], x[0, 0, 8:10] = 9, 3
    for p in range(1, 10):
        x[p, 0, 0:2] = 5 if p < 6 else 0
        x[p, 0, 8] = 2
    maps = C.as_nodes(maps_of(spark, x))
    plain = {r["size"]: r["p_value"] for r in C.cluster_test(maps, 10, 1.0, C.in_time(None))[0].collect()}
    down = {r["size"]: r["p_value"] for r in C.cluster_test(maps, 10, 1.0, C.in_time(None), step_down_p=0.2)[0].collect()}
    assert plain == {4: 0.1, 2: 0.6} and down == {4: 0.1, 2: 0.1}


def test_chain_is_runs(spark):
    """Without adjacency in space, clusters are the runs over time of each channel."""
    x = np.random.default_rng(8).standard_normal((1, 6, 40))
    cells = maps_of(spark, x)
    runs = {(r["ch"], r["start"], r["sign"]): round(r["mass"], 9) for r in S.clusters(cells, 0.3).collect()}
    got = {(r["label"]["ch"], r["label"]["t"], r["sign"]): round(r["mass"], 9) for r in C.masses(C.members(C.as_nodes(cells), 0.3, C.in_time(None))).collect()}
    assert got == runs


def grid_scores(x, start, step, h_power, e_power, tail):
    score = np.zeros(x.shape)
    levels = np.arange(start, np.abs(x).max(), step)
    for i, level in enumerate(levels):
        h = (abs(level) if i == 0 else step) ** h_power
        for *_, cells in clusters_of(x, level, 1, tail):
            for c in cells:
                score[c] += h * len(cells) ** e_power
    return score


@pytest.mark.parametrize(("start", "step", "h_power", "e_power", "tail"), [(0.0, 0.1, 2, 0.5, 0), (0.3, 0.07, 1, 1, 0), (0.5, 0.25, 2, 0.5, 1), (0.2, 0.1, 2, 0.5, -1), (9.0, 1.0, 2, 0.5, 0)])
def test_tfce(spark, start, step, h_power, e_power, tail):
    x = np.round(np.random.default_rng(7).standard_normal((2, 5, 9)) * 1.3, 1)  # with ties, and values on thresholds
    how = {"start": -start, "step": -step} if tail < 0 else {"start": start, "step": step}
    got = C.tfce(maps_of(spark, x), space_of(spark, PAIRS), h_power=h_power, e_power=e_power, tail=tail, **how).collect()
    want = [grid_scores(m, start, step, h_power, e_power, tail) for m in x]
    assert len(got) == x.size
    for r in got:
        assert abs(r["score"] - want[r["perm"]][r["ch"], r["t"]]) < 1e-9


def test_tfce_does_not_grow_with_thresholds(spark):
    """The closed form between levels: ten million thresholds."""
    x = np.random.default_rng(9).standard_normal((1, 5, 9))
    fine, coarse = (np.array([r["score"] for r in C.tfce(maps_of(spark, x), space_of(spark, PAIRS), step=s, h_power=1).orderBy("ch", "t").collect()]) for s in (1e-7, 1e-3))
    assert np.abs(fine - coarse).max() < 0.02


def test_flips_and_dealing(spark):
    """Sums by matrices of weights are those of single draws; a dealt draw keeps the groups' sizes."""
    rng = np.random.default_rng(2)
    rows = [(k, int(k % 3), c, t, float(v)) for k in range(20) for (c, t), v in np.ndenumerate(rng.standard_normal((2, 3)))]
    df = spark.createDataFrame(rows, "epoch long, condition long, ch long, t long, value double").repartition(3)
    got = {(r["perm"], r["ch"], r["t"]): r["t_value"] for r in S.flipped(df, 9, "epoch").collect()}
    rule = df.select("epoch").distinct().select("epoch", *(S.drawn(F.lit(p), F.col("epoch")).alias(str(p)) for p in range(9))).collect()
    sign = {(r["epoch"], p): -1 if p and r[str(p)] // 65536 % 2 else 1 for r in rule for p in range(9)}
    for p, c, t in got:
        v = np.array([v * sign[e, p] for e, _, cc, tt, v in rows if (cc, tt) == (c, t)])
        assert abs(got[p, c, t] - v.mean() / np.sqrt(v.var(ddof=1) / 20)) < 1e-9
    deal = {r["number"]: list(r["groups"]) for r in C.dealt(df.select("epoch", "condition").distinct(), 9, "epoch", "condition").collect()}
    assert all([sorted(d[p] for d in deal.values()) == sorted(k % 3 for k in range(20)) for p in range(9)]) and all(d[0] == k % 3 for k, d in deal.items())
    assert len({tuple(d[p] for d in deal.values()) for p in range(9)}) == 9
    f = {(r["perm"], r["ch"], r["t"]): r["t_value"] for r in C.permuted_f(df, 9, "epoch", "condition").collect()}
    for p in (0, 4):
        for c, t in ((0, 0), (1, 2)):
            by = [[v for e, _, cc, tt, v in rows if (cc, tt) == (c, t) and deal[e][p] == g] for g in range(3)]
            m = np.mean(sum(by, []))
            b = sum(len(g) * (np.mean(g) - m) ** 2 for g in by)
            w = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in by)
            assert abs(f[p, c, t] - b / 2 / (w / 17)) < 1e-9
    ratio = C.permuted_f(df, 3, "epoch", "condition", stat=lambda b, w, g, n: b / w)
    assert all(abs(r["t_value"] - f[r["perm"], r["ch"], r["t"]] * 2 / 17) < 1e-9 for r in ratio.filter("perm < 1").collect())
