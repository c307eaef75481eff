"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. The flow runs from a start node to
each pattern in layers, one per copy of its documents (the k-th copy of a token costs k, so repeats
are convex), on to each of the pattern's sources, and on to the end within the source's quota. It is
solved on the driver: its size is patterns x sources, never documents, and is checked. A pattern that
gets q copies and a rest takes every document q times and, for the rest, each document that still fits,
in the order of a seeded hash: whole hash buckets up to the one in which the rest ends (histograms of
at most 2^11 buckets a pattern, refined until that bucket is small), there one by one, and then on in
the same way among the later documents that are no longer than what is left, until none is.

Defined results: a null or wordless text has size 0 and takes part with it; a null source is a source
of its own, last; a document whose membership is null or empty is in the null source; texts of any
length count whole; repeated rows (same id and text) are taken or left together; an empty table gives
an empty result; extra columns of any name are left alone.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, written

SEED, REPEATS, LEVEL_BITS, FINE, MOST_PATTERNS = 17, 3, 11, 1024, 100_000
HASH_BITS = 60


def targets(sizes: list[int], weights: list[float], cap: float = REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight; none above cap times its size, the excess reshared by weight."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def route(capacity: list[int], members: list[list[int]], quota: list[int], repeats: int = REPEATS) -> list[int]:
    """Tokens that each pattern gives: the largest flow within quotas, of least repetition cost.
    Successive shortest paths with potentials."""
    n, m = len(capacity), len(quota)
    start, end = n + m, n + m + 1
    to, room, cost, at = [], [], [], [[] for _ in range(n + m + 2)]

    def arc(u: int, v: int, c: int, w: int) -> None:
        for x, y, r, k in ((u, v, c, w), (v, u, 0, -w)):
            at[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(k)

    for p, size in enumerate(capacity):
        for k in range(repeats):
            arc(start, p, size, k + 1)
        for s in members[p]:
            arc(p, n + s, repeats * size, 0)
    for s, q in enumerate(quota):
        arc(n + s, end, q, 0)
    high = [0] * len(at)
    while True:
        far, via, queue = {start: 0}, {}, [(0, start)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for e in at[u]:
                if room[e] and (x := d + cost[e] + high[u] - high[to[e]]) < far.get(to[e], 1 << 62):
                    far[to[e]], via[to[e]] = x, e
                    heapq.heappush(queue, (x, to[e]))
        if end not in far:
            break
        most = max(far.values())
        for v in range(len(at)):
            high[v] += far.get(v, most)
        path, v = [], end
        while v != start:
            path.append(via[v])
            v = to[via[v] ^ 1]
        flow = min(room[e] for e in path)
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow
    return [sum(room[e ^ 1] for e in at[p] if to[e] != start and e % 2 == 0) for p in range(n)]


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits that order documents."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 64 - HASH_BITS)


class Rest:
    """What is left to take from a pattern's documents of hashes in [low, end) and sizes up to longest, in
    order of hashes. until, if not 0: documents below it are few and next looked at one by one. Taken are
    the hashes in chosen, and documents of hashes from low to high and sizes up to longest in ranges."""

    def __init__(self, left: int, longest: int, shift: int):
        self.left, self.longest, self.shift, self.top, self.low, self.end, self.until = left, longest, shift, shift, 0, 1 << HASH_BITS, 0
        self.ranges, self.chosen = [], []

    def walk(self, cells: dict) -> None:
        """Takes whole buckets (sum, rows) up to the first that is more than what is left, which is next
        looked at one by one, with more of them up to FINE rows, or else cut finer."""
        order, start = sorted(cells), self.low
        if not self.shift:
            return self.pick([(b, cells[b][0]) for b in order])
        for k, b in enumerate(order):
            (s, count), end = cells[b], b + 1
            if s > self.left:
                self.low = max(self.low, b << self.shift)
                self.ranges.append((start, self.low, self.longest))
                if count > FINE:
                    self.end, self.shift = min(self.end, end << self.shift), max(0, self.shift - LEVEL_BITS)
                    return None
                for x in order[k + 1 :]:
                    if count + cells[x][1] > FINE:
                        break
                    count, end = count + cells[x][1], x + 1
                self.until = min(self.end, end << self.shift)
                return None
            self.left -= s
        self.ranges.append((start, self.end, self.longest))
        return self._onward(self.end)

    def pick(self, found: list[tuple[int, int]]) -> None:
        """Takes those of (hash, words), in order, that fit."""
        for h, s in found:
            if s <= self.left:
                self.chosen.append(h)
                self.left -= s
        self._onward(self.until or self.end)

    def _onward(self, low: int) -> None:
        """To all later hashes, and to documents that still fit."""
        self.low, self.end, self.until, self.shift, self.longest = low, 1 << HASH_BITS, 0, self.top, self.left


class Mix:
    """The plan of a mix: sizes and targets by source, and which documents of each pattern are taken."""

    def __init__(self, rows: DataFrame, weights=None, repeats: int = REPEATS):
        """rows: __pattern array<string>, __size long, __h long; read several times."""
        self.repeats = repeats
        shift = HASH_BITS - LEVEL_BITS
        cells = rows.groupBy("__pattern", F.shiftrightunsigned("__h", shift).alias("b")).agg(F.sum("__size").alias("s"), F.count("*").alias("n"))
        if (n := cells.select("__pattern").distinct().count()) > MOST_PATTERNS:
            raise ValueError(f"{n} membership patterns; at most {MOST_PATTERNS} are solved")
        by: dict[tuple, dict] = {}
        for r in cells.toLocalIterator():
            by.setdefault(tuple(r["__pattern"]), {})[r["b"]] = (r["s"], r["n"])
        order = lambda p: [(x is None, x or "") for x in p]
        self.patterns = sorted(by, key=order)
        at = {p: i for i, p in enumerate(self.patterns)}
        self.capacity = [sum(s for s, _ in by[p].values()) for p in self.patterns]
        self.sources = sorted({x for p in self.patterns for x in p}, key=lambda x: (x is None, x or ""))
        own = {s: i for i, s in enumerate(self.sources)}
        members = [[own[x] for x in dict.fromkeys(p)] for p in self.patterns]
        self.sizes = [0] * len(self.sources)
        for size, m in zip(self.capacity, members, strict=True):
            for s in m:
                self.sizes[s] += size
        given = weights or (lambda i, _: i % 3 + 1)
        w = [float(given(i, s)) for i, s in enumerate(self.sources)]
        total = sum(self.capacity)
        self.targets = targets(self.sizes, w, repeats) if sum(self.sizes) == total else [t * total / max(1, sum(self.sizes)) for t in targets(self.sizes, w, repeats)]
        self.given = route(self.capacity, members, [round(t) for t in self.targets], repeats)
        # copies of all, and what is taken once more
        self.full, self.rests = [], []
        for i, p in enumerate(self.patterns):
            q, rest = divmod(self.given[i], self.capacity[i]) if self.capacity[i] else (0, 0)
            self.full.append(q)
            self.rests.append(Rest(rest, self.capacity[i], shift))
            self.rests[i].walk(by[p])
        going = lambda: {i: x for i, x in enumerate(self.rests) if x.left and x.low < x.end}
        while open_ := going():
            if few := {i: x for i, x in open_.items() if x.until}:
                found: dict[int, list] = {}
                for r in self._within(rows, few).groupBy("__pattern", "__h").agg(F.sum("__size").alias("s")).toLocalIterator():
                    found.setdefault(at[tuple(r["__pattern"])], []).append((r["__h"], r["s"]))
                for i, x in few.items():
                    x.pick(sorted(found.get(i, [])))
            if open_ := going():
                cells = {i: {} for i in open_}
                b = F.expr("shiftrightunsigned(__h, __shift)").alias("b")
                for r in self._within(rows, open_).groupBy("__pattern", b).agg(F.sum("__size").alias("s"), F.count("*").alias("n")).toLocalIterator():
                    cells[at[tuple(r["__pattern"])]][r["b"]] = (r["s"], r["n"])
                for i, x in open_.items():
                    x.walk(cells[i])

    def _within(self, rows: DataFrame, open_: dict) -> DataFrame:
        """Rows that can still be taken: one range a pattern, so the small side is bounded by the patterns."""
        schema = "__pattern array<string>, __shift int, __low long, __end long, __longest long"
        small = rows.sparkSession.createDataFrame([(list(self.patterns[i]), x.shift, x.low, x.until or x.end, x.longest) for i, x in open_.items()], schema)
        may = (F.col("__h") >= F.col("__low")) & (F.col("__h") < F.col("__end")) & F.col("__size").between(1, F.col("__longest"))
        return rows.join(F.broadcast(small), "__pattern").filter(may)

    def plan(self, spark) -> DataFrame:
        """One row per pattern, at most MOST_PATTERNS: __pattern, source_size, target, __full, __ranges, __chosen."""
        own = {s: i for i, s in enumerate(self.sources)}
        schema = "__pattern array<string>, source_size long, target double, __full int, __ranges array<struct<low: long, high: long, longest: long>>, __chosen array<long>"
        rows = [(list(p), self.sizes[own[p[0]]], self.targets[own[p[0]]], self.full[i], [x for x in self.rests[i].ranges if x[0] < x[1]], self.rests[i].chosen) for i, p in enumerate(self.patterns) if p]
        return spark.createDataFrame(rows, schema)


def prepared(docs: DataFrame, pattern: Column, seed: int) -> DataFrame:
    """own (a row of docs, so that no name clashes), __pattern, __size, __h. No membership is that of no source."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")
    held = F.when(F.size(pattern) > 0, pattern).otherwise(F.array(F.lit(None).cast("string")))
    return docs.select(own, held.alias("__pattern"), size_of(F.col("text")).alias("__size"), seeded(F.col("doc_id"), F.col("text"), seed).alias("__h"))


def with_copies(rows: DataFrame, mix: Mix) -> DataFrame:
    """rows with source_size, target and copies: how often the mix takes the row's document."""
    plan = mix.plan(rows.sparkSession)
    within = F.exists("__ranges", lambda x: (F.col("__h") >= x["low"]) & (F.col("__h") < x["high"]) & (F.col("__size") <= x["longest"]))
    one = within | F.array_contains("__chosen", F.col("__h"))
    return rows.join(F.broadcast(plan), "__pattern").withColumn("copies", F.col("__full") + F.when(one, 1).otherwise(0)).drop("__full", "__ranges", "__chosen")


def mix_documents(docs: DataFrame, sources: Column | None = None, weights=None, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """docs, each row as often as the mix takes it. sources: an array of the sources a document is in."""
    pattern = F.array_sort(F.array_distinct(sources.cast("array<string>"))) if sources is not None else F.array(F.col("source").cast("string"))
    rows = prepared(docs, pattern, seed)
    mix = Mix(written(rows.select("__pattern", "__size", "__h")), weights, repeats)
    out = with_copies(rows, mix).filter("copies > 0")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).select("own.*")


def mix_report(docs: DataFrame, weights=None, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    rows = written(prepared(docs.select("doc_id", "source", "text"), F.array(F.col("source").cast("string")), seed).select("own.doc_id", "__pattern", "__size", "__h"))
    out = with_copies(rows, Mix(rows, weights, repeats))
    return out.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("copies") * F.col("__size")).alias("taken"), "copies")
