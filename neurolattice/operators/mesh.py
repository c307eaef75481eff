"""Meshes as tables of edges: distances along them, labels grown by distance, smoothing and sparse morphs.

Shortest paths go on in rounds of a frontier: what was reached or improved in the last round is joined with
the edges, the best offer for each node is compared with what is known, and better ones are the next frontier.
Known distances are a log that only grows, so a round shuffles the frontier and not the mesh. A round more than
the hops of the longest of the shortest paths ends it. Only whether a frontier is empty comes to the driver.

Matrices of vertices by vertices are tables (row, col, weight) of their elements that are not 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def edges_of_triangles(triangles: DataFrame, points: DataFrame) -> DataFrame:
    """a, b, weight: the sides of triangles (v0, v1, v2), each once both ways, and their lengths. points: node, x, y, z."""
    sides = triangles.select(F.explode(F.array(*(F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))).alias("s")).select("s.*")
    sides = sides.union(sides.select("b", "a")).distinct()
    a, b = (points.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in "xyz")) for s in "ab")
    length = F.sqrt(sum(((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in "xyz"), F.lit(0.0)))
    return sides.join(a, "a").join(b, "b").select("a", "b", length.alias("weight"))


def shortest(edges: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = (), limit: float | None = None) -> DataFrame:
    """edges: a, b, weight (not negative), both ways; seeds: keys, node, seed. keys, node, dist, seed: the least distance
    from a seed of the same keys, as far as limit, and the seed; of equally near seeds the least."""
    on = [*keys, "node"]
    edges = cut(edges.select(F.col("a").alias("_from"), F.col("b").alias("_to"), F.col("weight").cast("double").alias("_far")))
    frontier = cut(seeds.groupBy(*on).agg(F.min("seed").alias("seed")).select(*on, F.struct(F.lit(0.0).alias("dist"), "seed").alias("best")))
    known = frontier
    while True:
        offers = frontier.join(edges, F.col("node") == F.col("_from")).select(*keys, F.col("_to").alias("node"), F.struct((F.col("best.dist") + F.col("_far")).alias("dist"), F.col("best.seed").alias("seed")).alias("best"))
        if limit is not None:
            offers = offers.filter(F.col("best.dist") <= limit)
        offers = offers.groupBy(*on).agg(F.min("best").alias("best"))
        before = known.join(offers.select(*on), on).groupBy(*on).agg(F.min("best").alias("had"))
        frontier = cut(offers.join(before, on, "left").filter(F.col("had").isNull() | (F.col("best") < F.col("had"))).select(*on, "best"))
        if frontier.isEmpty():
            return known.groupBy(*on).agg(F.min("best").alias("best")).select(*on, "best.dist", "best.seed")
        known = known.union(frontier)


def relaxed(a: np.ndarray, b: np.ndarray, w: np.ndarray, nodes: np.ndarray, offers: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distance and seed of each of nodes (sorted) by edges within them, from offers (node, dist, seed)."""
    order = np.argsort(a, kind="stable")
    a, w, to = np.searchsorted(nodes, a[order]), w[order], np.searchsorted(nodes, b[order])
    start = np.searchsorted(a, np.arange(len(nodes) + 1))
    dist, seed = np.full(len(nodes), np.inf), np.full(len(nodes), np.iinfo(np.int64).max)
    at, d, s = offers
    while len(at):
        best = np.lexsort((s, d, at))
        best = best[np.r_[True, at[best][1:] != at[best][:-1]]]
        at, d, s = at[best], d[best], s[best]
        better = (d < dist[at]) | ((d == dist[at]) & (s < seed[at]))
        at, d, s = at[better], d[better], s[better]
        dist[at], seed[at] = d, s
        many = start[at + 1] - start[at]
        edge = np.repeat(start[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        d, s, at = np.repeat(d, many) + w[edge], np.repeat(s, many), to[edge]
    return dist, seed


def nearest_seeds(edges: DataFrame, seeds: DataFrame, size: int = 1 << 17) -> DataFrame:
    """node, dist, seed: shortest() without a limit, of nodes that are whole numbers, whose numbers should lie near where
    the nodes do. A block is the edges from size numbers; it goes on by itself until nothing in it improves, then hands
    offers over its border. A round reads the blocks with new offers, so rounds are as many as blocks that the longest
    of the shortest paths passes through, not its hops. Offers, a table of border nodes, are all that is kept."""
    block = F.floor(F.col("node") / size)
    packed = cut(edges.select(F.floor(F.col("a") / size).alias("block"), F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("weight").cast("double").alias("w")).alias("e")).groupBy("block").agg(F.collect_list("e").alias("e")))
    told = cut(seeds.groupBy(F.col("node").cast("long").alias("node")).agg(F.struct(F.lit(0.0).alias("dist"), F.min("seed").cast("long").alias("seed")).alias("best")).withColumn("block", block))

    def solve(over: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    e, o = (batch.column(c).slice(i, 1).flatten() for c in ("e", "offers"))
                    a, b, w = (e.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "w"))
                    node, d, s = (o.field(c).to_numpy(zero_copy_only=False) for c in ("node", "dist", "seed"))
                    own = b // size == batch.column("block")[i].as_py()
                    nodes = np.unique(np.concatenate([a, b[own], node]))
                    dist, seed = relaxed(a[own], b[own], w[own], nodes, (np.searchsorted(nodes, node), d, s))
                    if over:
                        at = np.searchsorted(nodes, a[~own])
                        nodes, dist, seed = b[~own], dist[at] + w[~own], seed[at]
                    some = np.isfinite(dist)
                    yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (nodes, dist, seed)], ["node", "dist", "seed"])

        return run

    def reached(blocks: DataFrame, over: bool) -> DataFrame:
        given = blocks.groupBy("block").agg(F.collect_list(F.struct("node", "best.dist", "best.seed")).alias("offers"))
        made = packed.join(given, "block").mapInArrow(solve(over), "node long, dist double, seed long")
        return made.select("node", F.struct("dist", "seed").alias("best"))

    new = told
    while True:
        active = told.join(new.select("block").distinct(), "block", "left_semi")
        offers = reached(active, True).groupBy("node").agg(F.min("best").alias("best")).withColumn("block", block)
        had = told.select("node", F.col("best").alias("had"))
        new = cut(offers.join(had, "node", "left").filter(F.col("had").isNull() | (F.col("best") < F.col("had"))).select("node", "best", "block"))
        if new.isEmpty():
            break
        told = cut(told.union(new).groupBy("node", "block").agg(F.min("best").alias("best")).select("node", "best", "block"))
    found = reached(told, False).union(told.select("node", "best")).groupBy("node").agg(F.min("best").alias("best"))
    return found.select("node", "best.dist", "best.seed")


def distances(edges: DataFrame, nodes: DataFrame, limit: float) -> DataFrame:
    """a, b, dist: for each of nodes (node) all nodes within limit of it."""
    own = nodes.select(F.col("node").alias("a"), "node", F.col("node").alias("seed"))
    return shortest(edges, own, ("a",), limit).select("a", F.col("node").alias("b"), "dist")


def grow_labels(edges: DataFrame, seeds: DataFrame, extent: float, overlap: bool = True) -> DataFrame:
    """label, node, dist: the nodes within extent of a label's seeds (label, node). Without overlap a node belongs to
    the nearest label, of equally near ones to the least."""
    if overlap:
        return shortest(edges, seeds.select("label", "node", F.col("label").alias("seed")), ("label",), extent).select("label", "node", "dist")
    return shortest(edges, seeds.select("node", F.col("label").alias("seed")), (), extent).select(F.col("seed").alias("label"), "node", "dist")


def random_parcellation(edges: DataFrame, nodes: DataFrame, n: int, order: Column) -> DataFrame:
    """label, node: the mesh dealt to the nearest of n nodes, those that come first in order (a hash of node). A node
    that no seed reaches has a null label."""
    seeds = nodes.orderBy(order, "node").limit(n).select(F.col("node").alias("label"), "node")
    found = nearest_seeds(edges, seeds.select("node", F.col("label").alias("seed")))
    return nodes.select("node").join(found, "node", "left").select(F.col("seed").alias("label"), "node")


def split_label(points: DataFrame, members: DataFrame, parts: int) -> DataFrame:
    """node, part: members (node) of a label in parts of even length along their main axis (the points' first principal
    direction, its largest component positive). points: node, x, y, z."""
    own = points.join(members.select("node"), "node")
    sums = own.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "xyz"), *(F.covar_pop(c, d).alias(c + d) for c in "xyz" for d in "xyz")).first()
    if not sums["n"]:
        return own.select("node", F.lit(0).cast("long").alias("part"))
    axis = np.linalg.eigh(np.array([[sums[c + d] for d in "xyz"] for c in "xyz"]))[1][:, -1]
    axis = axis if axis[np.abs(axis).argmax()] > 0 else -axis
    along = sum(((F.col(c) - sums[c]) * float(v) for c, v in zip("xyz", axis, strict=True)), F.lit(0.0))
    ends = own.select(along.alias("p")).agg(F.min("p").alias("low"), F.max("p").alias("high")).first()
    part = F.least(F.floor((along - ends["low"]) / max(ends["high"] - ends["low"], 1e-300) * parts), F.lit(parts - 1))
    return own.select("node", part.cast("long").alias("part"))


# --- sparse matrices


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """row, col, weight of left times right."""
    inner = right.select(F.col("row").alias("col"), F.col("col").alias("out"), F.col("weight").alias("w"))
    return left.join(inner, "col").groupBy("row", F.col("out").alias("col")).agg(F.sum(F.col("weight") * F.col("w")).alias("weight"))


def applied(matrix: DataFrame, values: DataFrame) -> DataFrame:
    """node, t, value: the matrix times values (node, t, value)."""
    met = matrix.join(values.withColumnRenamed("node", "col"), "col")
    return met.groupBy(F.col("row").alias("node"), "t").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def smoothing(edges: DataFrame, known: DataFrame, steps: int | None = None, keep: DataFrame | None = None) -> DataFrame:
    """row, col, weight: what repeated averaging makes of values at known nodes (node). In a step, a node that is known or
    has known neighbours gets the mean of those and itself (if known), and is known from then on. steps None: until
    no step reaches a new node. keep: the rows (node) that are wanted."""
    around = edges.select("a", "b")
    around = cut(around.union(around.select(F.col("a"), F.col("a").alias("b"))).union(known.select(F.col("node").alias("a"), F.col("node").alias("b"))).distinct())
    matrix = known.select(F.col("node").alias("row"), F.col("node").alias("col"), F.lit(1.0).alias("weight"))
    reached, many, done = cut(known.select("node").distinct()), -1, 0
    while steps is None or done < steps:
        have = reached.count()
        if steps is None and have == many:
            break
        many, done = have, done + 1
        near = around.join(reached.withColumnRenamed("node", "b"), "b")
        share = near.groupBy("a").agg(F.count("*").alias("n"))
        step = near.join(share, "a").select(F.col("a").alias("row"), F.col("b").alias("col"), (1.0 / F.col("n")).alias("weight"))
        matrix = cut(product(step, matrix))
        reached = cut(share.select(F.col("a").alias("node")))
    return matrix if keep is None else matrix.join(keep.select(F.col("node").alias("row")).distinct(), "row", "left_semi")


def morph(edges: DataFrame, known: DataFrame, mapping: DataFrame, steps: int | None = None) -> DataFrame:
    """row (a node of another mesh), col (a known node), weight: smoothing on this mesh, then mapping (row, col, weight:
    where each node of the other mesh lies on this one)."""
    return product(mapping, smoothing(edges, known, steps, mapping.select(F.col("col").alias("node"))))
