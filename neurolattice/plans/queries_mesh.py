"""Queries of distances, labels and morphs on a mesh: parts in a grid of rows of 50."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mesh as M
from . import views as V
from .registry import query, r6

#: Neighbours in a row and between rows; an edge is longer where the parts' sizes differ.
MESH = "n AS (SELECT p_partkey AS node, p_size AS size, p_retailprice::DOUBLE AS price FROM part), e AS (SELECT a.node AS a, b.node AS b, (abs(a.size - b.size) + 1)::DOUBLE AS weight FROM n a JOIN n b ON (abs(a.node - b.node) = 1 AND (a.node - 1) // 50 = (b.node - 1) // 50) OR abs(a.node - b.node) = 50)"


def nodes(spark, d):
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("size"), F.col("p_retailprice").cast("double").alias("price"))


def edges(spark, d):
    n = nodes(spark, d)
    side = F.when((F.col("node") - 1) % 50 < 49, F.array(F.lit(1), F.lit(50))).otherwise(F.array(F.lit(50)))
    on = n.select(F.col("node").alias("a"), F.col("size").alias("s"), F.explode(side).alias("by")).withColumn("b", F.col("a") + F.col("by"))
    one = on.join(n.select(F.col("node").alias("b"), "size"), "b").select("a", "b", (F.abs(F.col("s") - F.col("size")) + 1).cast("double").alias("weight"))
    return one.union(one.select("b", "a", "weight"))


def paths(seeds: str, limit: float) -> str:
    """SQL of p(seed, node, dist): all lengths of ways up to limit."""
    return f"p AS ({seeds} UNION SELECT seed, e.b, dist + weight FROM p JOIN e ON e.a = p.node WHERE dist + weight <= {limit})"


@query("source_space_distances", f"WITH RECURSIVE {MESH}, {paths('SELECT node AS seed, node, 0.0::DOUBLE AS dist FROM n WHERE node % 40 = 0', 25)} SELECT seed AS a, node AS b, min(dist) AS dist FROM p GROUP BY ALL")
def _(spark, d):
    return M.distances(edges(spark, d), nodes(spark, d).filter("node % 40 = 0"), 25.0)


SEEDS = "SELECT node % 7 AS seed, node, 0.0::DOUBLE AS dist FROM n WHERE node % 97 = 1"


def label_seeds(spark, d):
    return nodes(spark, d).filter("node % 97 = 1").select((F.col("node") % 7).alias("label"), "node")


@query("grow_labels", f"WITH RECURSIVE {MESH}, {paths(SEEDS, 20)} SELECT seed AS label, node, min(dist) AS dist FROM p GROUP BY ALL")
def _(spark, d):
    return M.grow_labels(edges(spark, d), label_seeds(spark, d), 20.0)


@query("grow_labels_disjoint", f"WITH RECURSIVE {MESH}, {paths(SEEDS, 20)} SELECT min(struct_pack(dist := dist, seed := seed)).seed AS label, node, min(dist) AS dist FROM p GROUP BY node")
def _(spark, d):
    return M.grow_labels(edges(spark, d), label_seeds(spark, d), 20.0, overlap=False)


#: Rounds over the whole mesh, each with every node's best so far.
@query("random_parcellation", f"WITH RECURSIVE {MESH}, e0 AS (SELECT * FROM e UNION ALL SELECT node, node, 0 FROM n), s AS (SELECT node FROM n ORDER BY node * 7919 % 10007, node LIMIT 12), p AS (SELECT 0 AS step, node, struct_pack(dist := 0.0::DOUBLE, seed := node) AS best FROM s UNION ALL SELECT step + 1, e0.b, min(struct_pack(dist := best.dist + weight, seed := best.seed)) FROM p JOIN e0 ON e0.a = p.node WHERE step < 400 GROUP BY step, e0.b) SELECT n.node, best.seed AS label FROM n LEFT JOIN (SELECT * FROM p WHERE step = 400) p ON p.node = n.node")
def _(spark, d):
    return M.random_parcellation(edges(spark, d), nodes(spark, d), 12, F.col("node") * 7919 % 10007)


COURSES = "v AS (SELECT node, t, price * (t + 1) + size * t AS value FROM n, range(0, 3) r(t) WHERE node % 3 = 0), e0 AS (SELECT a, b FROM e UNION SELECT node, node FROM n)"


def courses(spark, d):
    t = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("t")
    return nodes(spark, d).filter("node % 3 = 0").select("node", "size", "price", t).select("node", "t", (F.col("price") * (F.col("t") + 1) + F.col("size") * F.col("t")).alias("value"))


@query("smooth_sources", f"WITH {MESH}, {COURSES}, w AS (SELECT e0.a AS node, t, avg(value) AS value FROM e0 JOIN v ON v.node = e0.b GROUP BY ALL), x AS (SELECT e0.a AS node, t, avg(value) AS value FROM e0 JOIN w ON w.node = e0.b GROUP BY ALL) SELECT node, t, round(value, 6) AS value FROM x")
def _(spark, d):
    """Two steps of averaging, as a sparse matrix."""
    own = courses(spark, d)
    matrix = M.smoothing(edges(spark, d), own.select("node").distinct(), 2)
    return M.applied(matrix, own).withColumn("value", r6(F.col("value")))


@query("source_morph", f"WITH {MESH}, {COURSES}, w AS (SELECT e0.a AS node, t, avg(value) AS value FROM e0 JOIN v ON v.node = e0.b GROUP BY ALL), m AS (SELECT node + 1000000 AS row, node AS col, 0.75::DOUBLE AS weight FROM n WHERE node % 2 = 1 UNION ALL SELECT node + 1000000, node + 1, 0.25 FROM n WHERE node % 2 = 1) SELECT row AS node, t, round(sum(weight * value), 6) AS value FROM m JOIN w ON w.node = m.col GROUP BY ALL")
def _(spark, d):
    """One step of averaging, then a mesh of half the nodes, each between two of this one's."""
    own, odd = courses(spark, d), nodes(spark, d).filter("node % 2 = 1")
    mapping = odd.select((F.col("node") + 1_000_000).alias("row"), F.col("node").alias("col"), F.lit(0.75).alias("weight")).union(odd.select(F.col("node") + 1_000_000, F.col("node") + 1, F.lit(0.25)))
    matrix = M.morph(edges(spark, d), own.select("node").distinct(), mapping, 1)
    return M.applied(matrix, own).withColumn("value", r6(F.col("value")))
