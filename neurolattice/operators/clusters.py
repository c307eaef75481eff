"""Cluster statistics on cells with any adjacency.

A map is one draw's statistic over all cells; cells are nodes of any orderable type, (ch, t) as a struct
in space and time. Clusters are connected components of the cells beyond a threshold, found for all draws
and both signs at once: labels spread over edges, hook the label they replace and jump along labels, so
the rounds are few (logarithmic in the cells) whatever the draws are. Nothing but one flag a round comes to
the driver.

Threshold-free enhancement needs the components at every threshold: a map's cells, met in falling order,
make a tree of components (union-find), and what the thresholds between two of its levels add is a closed
form, so the work does not grow with the number of thresholds. A map is a group, its cells carry their
neighbours' names, so nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .stats import CELL, drawn, grouped_sums

MAP = ("perm", "sign")


def symmetric(adjacency: DataFrame) -> DataFrame:
    """a, b of an undirected table, both ways, without loops and repeats."""
    return adjacency.select("a", "b").union(adjacency.select("b", "a")).filter("a != b").distinct()


def components(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = MAP) -> DataFrame:
    """nodes: keys, node; edges: keys, a, b, both ways, between nodes. keys, node, label: the least node that a
    node reaches over edges of its own keys."""
    keys = list(keys)
    labels = cut(nodes.select(*keys, "node", F.col("node").alias("label")))
    edges = cut(edges.select(*keys, "a", F.col("b").alias("node")))
    while True:
        met = edges.join(labels, [*keys, "node"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("label").alias("met"))
        spread = labels.join(met, [*keys, "node"], "left").withColumn("less", F.least("label", "met"))
        # the node that gave the old label takes the new one as well
        hook = spread.filter("less < label").groupBy(*keys, F.col("label").alias("node")).agg(F.min("less").alias("hook"))
        hooked = spread.join(hook, [*keys, "node"], "left").select(*keys, "node", F.col("label").alias("old"), F.least("less", "hook").alias("label"))
        up = hooked.select(*keys, F.col("node").alias("label"), F.col("label").alias("higher"))
        jumped = cut(hooked.join(up, [*keys, "label"], "left").select(*keys, "node", F.least("label", "higher").alias("label"), (F.least("label", "higher") < F.col("old")).alias("moved")))
        labels = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return labels


def beyond(cells: DataFrame, threshold: float, tail: int = 0, value: str = "t_value") -> DataFrame:
    """cells with sign: those strictly beyond the threshold in a direction of the tail."""
    high = F.when(F.col(value) > threshold, 1) if tail >= 0 else F.lit(None)
    low = F.when(F.col(value) < (threshold if tail < 0 else -threshold), -1) if tail <= 0 else F.lit(None)
    return cells.withColumn("sign", F.coalesce(high, low).cast("long")).filter("sign IS NOT NULL")


def edges_of(active: DataFrame, adjacency: DataFrame) -> DataFrame:
    """perm, sign, a, b: the adjacent pairs of active nodes."""
    near = symmetric(adjacency)
    at = active.select(*MAP, "node")
    return at.withColumnRenamed("node", "a").join(near, "a").join(at.withColumnRenamed("node", "b"), [*MAP, "b"]).select(*MAP, "a", "b")


def edges_in_time(active: DataFrame, space: DataFrame | None, max_step: int = 1) -> DataFrame:
    """The same for nodes that are structs (ch, t): channels adjacent in space at one time, and one channel at
    times at most max_step apart."""
    at = active.select(*MAP, F.col("node.ch").alias("ch"), F.col("node.t").alias("t"))
    shift = F.explode(F.array(*(F.lit(k) for d in range(1, max_step + 1) for k in (d, -d))))
    moved = at.select(*MAP, F.struct("ch", "t").alias("a"), "ch", "t", shift.alias("by")).select(*MAP, "a", "ch", (F.col("t") + F.col("by")).alias("t"))
    if space is not None:
        near = symmetric(space).select(F.col("a").alias("ch"), F.col("b").alias("other"))
        moved = moved.union(at.join(near, "ch").select(*MAP, F.struct("ch", "t").alias("a"), F.col("other").alias("ch"), "t"))
    return moved.join(at, [*MAP, "ch", "t"]).select(*MAP, "a", F.struct("ch", "t").alias("b"))


def as_nodes(cells: DataFrame) -> DataFrame:
    return cells.withColumn("node", F.struct(*CELL)).drop(*CELL)


Linker = Callable[[DataFrame], DataFrame]


def by(adjacency: DataFrame) -> Linker:
    return lambda active: edges_of(active, adjacency)


def in_time(space: DataFrame | None, max_step: int = 1) -> Linker:
    return lambda active: edges_in_time(active, space, max_step)


def none(active: DataFrame) -> DataFrame:
    """No adjacency: every cell is a cluster."""
    return active.select(*MAP, F.col("node").alias("a"), F.col("node").alias("b")).filter("false")


def members(cells: DataFrame, threshold: float, link: Linker, tail: int = 0) -> DataFrame:
    """cells: perm, node, t_value. Those beyond the threshold with sign and label, their cluster's least node."""
    active = cut(beyond(cells.filter(~F.isnan("t_value")), threshold, tail).select(*MAP, "node", "t_value"))
    return active.join(components(active, link(active)), [*MAP, "node"])


def masses(found: DataFrame, t_power: float = 1.0) -> DataFrame:
    """perm, sign, label, size, mass of clusters: values to the power t_power, their signs kept (0: the size)."""
    weight = F.lit(1.0) * F.col("sign") if t_power == 0 else F.col("t_value") if t_power == 1 else F.signum("t_value") * F.abs("t_value") ** t_power
    return found.groupBy(*MAP, "label").agg(F.count("*").alias("size"), F.sum(weight).alias("mass"))


def shares(observed: DataFrame, drawn_: DataFrame, value: str, n: int, tail: int = 0) -> DataFrame:
    """observed with p_value: the share of n draws whose most extreme value in drawn_ (perm, value) reaches its
    own; draws without one count as 0."""
    size = F.col(value) * tail if tail else F.abs(value)
    top = drawn_.groupBy("perm").agg(F.max(size).alias("top"))
    tops = top.agg(F.sort_array(F.collect_list("top")).alias("tops"))  # one number a draw
    reach = F.size(F.filter("tops", lambda x: x >= size * (1 - 1e-12)))
    return observed.crossJoin(F.broadcast(tops)).withColumn("p_value", reach / n).drop("tops")  # one row


def cluster_test(maps: DataFrame, n: int, threshold: float, link: Linker, tail: int = 0, t_power: float = 1.0, exclude: DataFrame | None = None, step_down_p: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """maps: perm, node, t_value of n draws, the observed one being 0. exclude: nodes to leave out. Clusters of the
    observed map (sign, label, size, mass, p_value), and their members (sign, label, node, t_value). With
    step_down_p, clusters under that p are left out of the draws, which are judged again, until none is new."""
    maps = cut(maps if exclude is None else maps.join(exclude.select("node"), "node", "left_anti"))
    found = members(maps, threshold, link, tail)
    own, all_ = found.filter("perm = 0"), masses(found, t_power)
    observed, gone = all_.filter("perm = 0"), 0
    while True:
        judged = cut(shares(observed, all_, "mass", n, tail).drop("perm"))
        out = judged.filter(F.col("p_value") < step_down_p)
        many = out.count() if step_down_p else 0
        if many <= gone:
            return judged, own.select("sign", "label", "node", "t_value")
        gone = many
        left = own.join(out.select("sign", "label"), ["sign", "label"]).select("node")
        all_ = observed.union(masses(members(maps.filter("perm != 0").join(left, "node", "left_anti"), threshold, link, tail), t_power))


def dealt(df: DataFrame, n: int, number: str, group: str) -> DataFrame:
    """number, groups (bytes: the group that each draw puts an observation in), of a table with one row an
    observation: group numbers 0, 1 ... are dealt out again in the order of a hash, so their sizes stay."""
    own = df.select(F.col(number).alias("number"), F.col(group).alias("group"))
    sizes = own.groupBy("group").count()
    ends = sizes.agg(F.sort_array(F.collect_list(F.struct("group", "count"))).alias("g"))  # one entry a group
    each = own.crossJoin(F.broadcast(ends)).select("*", F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("perm"))
    rank = F.row_number().over(Window.partitionBy("perm").orderBy(drawn(F.col("perm"), F.col("number")), "number")) - 1
    each = each.withColumn("rank", rank)
    upto = F.aggregate("g", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("k")), lambda a, x: F.struct((a["end"] + x["count"]).alias("end"), (a["k"] + F.when(F.col("rank") >= a["end"] + x["count"], 1).otherwise(0)).alias("k")))["k"]
    drawn_ = each.select("number", "perm", upto.alias("k"))
    place = own.crossJoin(F.broadcast(ends)).select("number", F.lit(0).alias("perm"), (F.expr("array_position(transform(g, x -> x.group), group)") - 1).alias("k"))
    hexed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("perm", "k"))), lambda x: F.lpad(F.hex(x["k"]), 2, "0")), "")
    return drawn_.union(place).groupBy("number").agg(F.unhex(hexed).alias("groups"))


def permuted_f(df: DataFrame, n: int, number: str, group: str, stat: Callable[[Column, Column, Column, Column], Column] | None = None) -> DataFrame:
    """perm, ch, t, t_value: the one-way F of n draws that deal the observations to the groups anew (at most 255).
    stat: another statistic, of the sum of squares between groups, the one within, groups and observations."""
    own = df.withColumnRenamed(number, "number").withColumnRenamed(group, "group")
    deal = cut(dealt(own.select("number", "group").distinct(), n, "number", "group"))
    groups = own.select("group").distinct().count()
    sums = grouped_sums(own.join(deal, "number"), n, "number", "groups", groups)
    # how many observations of a group have a cell: as observed, cells being whole
    counts = grouped_sums(own.join(deal, "number").withColumn("value", F.lit(1.0)), n, "number", "groups", groups).withColumnRenamed("s", "c")
    cells = df.groupBy(*CELL).agg(F.sum(F.col("value") ** 2).alias("q"), F.sum("value").alias("whole"), F.count("*").alias("n"))
    between = sums.join(counts, ["perm", "k", *CELL]).filter("c > 0").groupBy("perm", *CELL).agg(F.sum(F.col("s") ** 2 / F.col("c")).alias("b"), F.count("*").alias("g")).join(cells, list(CELL))
    ssb = F.col("b") - F.col("whole") ** 2 / F.col("n")
    ssw = F.col("q") - F.col("b")
    value = (stat or (lambda b, w, g, n_: b / (g - 1) / (w / (n_ - g))))(ssb, ssw, F.col("g"), F.col("n"))
    return between.select("perm", *CELL, value.alias("t_value"))


# --- threshold-free enhancement


def passed(x: np.ndarray, start: float, step: float) -> np.ndarray:
    """How many of the thresholds start, start + step ... are under x, strictly."""
    k = np.maximum(np.ceil((x - start) / step), 0)
    k = np.where((k > 0) & (start + (k - 1) * step >= x), k - 1, k)
    return np.where(start + k * step < x, k + 1, k)


def worth(k: np.ndarray, start: float, step: float, h_power: float) -> np.ndarray:
    """What the first k thresholds weigh: each the power h_power of its distance from the one before."""
    return np.where(k > 0, abs(start) ** h_power + (k - 1) * abs(step) ** h_power, 0.0)


def enhanced(value: np.ndarray, near: list[np.ndarray], start: float, step: float, h_power: float, e_power: float) -> np.ndarray:
    """Scores of the cells of one sign (values positive). near[i]: the neighbours of cell i, as numbers.

    Cells are met in falling order; a component is a node of a tree whose size holds until a cell of a lower
    value joins it. Each node's share is what the thresholds between its level and its parent's weigh, times
    its size to the power e_power; a cell's score is the sum of the shares on its way to the root."""
    n = len(value)
    order = np.argsort(-value, kind="stable")
    rank = np.empty(n, int)
    rank[order] = np.arange(n)
    top = np.arange(n)  # of a component (a cell that stands for it): its current node, which is a cell's number
    root, size, parent = list(range(n)), [1] * n, np.full(n, -1)
    level, final = value.copy(), np.ones(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in order.tolist():
        total, joined = 1, i
        for j in near[i].tolist():
            if rank[j] < rank[i]:
                r = find(j)
                if r != joined:
                    parent[top[r]] = i  # the component's node ends where cell i joins
                    total += size[r]
                    a, b = (r, joined) if size[r] >= size[joined] else (joined, r)
                    root[b] = a
                    size[a] = total
                    joined = a
        size[joined] = total
        top[joined] = i
        final[i] = total
    upto = worth(passed(level, start, step), start, step, h_power)
    below = np.where(parent >= 0, upto[np.maximum(parent, 0)], 0.0)
    score = (upto - below) * final**e_power
    for i in order[::-1].tolist():  # from the roots up
        if parent[i] >= 0:
            score[i] += score[parent[i]]
    return score


def neighbour_lists(space: DataFrame) -> DataFrame:
    """ch, near (channels adjacent in space): one row a channel that has any."""
    return symmetric(space).groupBy(F.col("a").alias("ch")).agg(F.collect_list("b").alias("near"))


def tfce(maps: DataFrame, space: DataFrame | None = None, max_step: int = 1, start: float = 0.0, step: float = 0.2, h_power: float = 2.0, e_power: float = 0.5, tail: int = 0) -> DataFrame:
    """maps: perm, ch, t, t_value. The same cells with score: the sum over the thresholds start, start + step ...
    (of the sign's direction) of the distance from the one before to the power h_power, times the size of the
    cell's component beyond the threshold to the power e_power. Cells that are adjacent: channels adjacent in space
    (a, b) at one time, and a channel at times at most max_step apart."""
    if tail < 0:
        start, step = -start, -step
    if step <= 0 or start < 0:
        raise ValueError("thresholds have to go away from zero in the direction of the tail")
    kinds = dict(maps.dtypes)
    rows = maps.select("perm", *CELL, F.col("t_value").cast("double").alias("t_value"))
    if space is not None:
        rows = rows.join(neighbour_lists(space), "ch", "left")
    else:
        rows = rows.withColumn("near", F.array().cast(f"array<{kinds['ch']}>"))
    sign = F.when(F.col("t_value") > 0, 1).when(F.col("t_value") < 0, -1).otherwise(0)
    if tail:
        sign = F.when(sign == tail, sign).otherwise(0)

    def run(table: pa.Table) -> pa.Table:
        ch, t, near = table["ch"].to_pylist(), table["t"].to_pylist(), table["near"].to_pylist()
        of, lists = {cell: i for i, cell in enumerate(zip(ch, t, strict=True))}, []
        for c, when, others in zip(ch, t, near, strict=True):
            cells = [(o, when) for o in others or ()] + [(c, when + s) for d in range(1, max_step + 1) for s in (d, -d)]
            lists.append(np.array([of[x] for x in cells if x in of], int))
        score = enhanced(np.abs(table["t_value"].to_numpy()), lists, start, step, h_power, e_power)
        return pa.table([table["perm"], table["ch"], table["t"], table["t_value"], pa.array(score)], ["perm", *CELL, "t_value", "score"])

    # cells that no threshold can pass need no map; a map of one sign is a group
    rows = rows.withColumn("side", F.when(F.abs("t_value") > start, sign).otherwise(0))
    rest = rows.filter("side = 0").select("perm", *CELL, "t_value", F.lit(0.0).alias("score"))
    done = rows.filter("side != 0").groupBy("perm", "side").applyInArrow(run, f"perm {kinds['perm']}, ch {kinds['ch']}, t {kinds['t']}, t_value double, score double")
    return done.union(rest)


def tfce_test(maps: DataFrame, n: int, **how) -> DataFrame:
    """ch, t, t_value, score, p_value of the observed map (perm 0): the share of n draws whose largest score
    reaches the cell's."""
    scores = cut(tfce(maps, **how))
    return shares(scores.filter("perm = 0"), scores, "score", n, 0).drop("perm")
