"""A Merkle manifest of a dataset: a tree for each group of rows, and one over the groups' roots.

Leaves are hashed where rows are read, written as a narrow table, and sorted by group and key as one range-partitioned RDD; range
bounds are within groups too, so a hot group spreads. Then
  1. each partition counts the rows of its first and last group; from these counts (one short row a
     partition, the only thing that the driver sees) follow the offset of its first group in that
     group's order and the sizes of both, all other groups being whole in it;
  2. each partition builds the complete aligned subtrees of its range and gives out the nodes at its
     ragged ends whose run goes on in another partition, at most FANOUT - 1 a level and end;
  3. ragged nodes are shuffled by coordinate (group, level, run) and finished level by level;
  4. the groups' roots are numbered in the order of groups and finished in the same way;
  5. each partition asks for the finished runs at its ends (two a level) and for its groups' paths,
     and gives every row its proof.
A partition's digests are held in its task (some 80 bytes a row), nothing else is. Lost executors only
repeat work: ranges are fixed, and equal sort keys are equal rows.

H is the lowercase hex SHA-256; a node is H of its run's digests as hex text; a last run may be short,
even of one node.

Defined results: null values hash as `-`; null groups and keys come first; rows of one group and key
are ordered by leaf, then by the kept columns; repeated rows are leaves each; texts of any length are
hashed whole; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import CRC_SQL, crc_sql, written

FANOUT, HEX = 8, 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODES = "grp string, level int, idx long, n long, digest string, pid int"


def leaf(columns: dict[str, Column]) -> Column:
    """H of the values of columns, in order: `-` if null, else UTF-8 byte count, `:` and value."""
    parts = []
    for c in columns.values():
        value = c.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def node(run: str) -> str:
    return sha256(run.encode()).hexdigest()


class Block:
    """The rows of a partition: for each of its groups, in order, (group, keys, joined leaves, kept values)."""

    def __init__(self, rows: Iterator[tuple]):
        self.groups: list[tuple] = []
        for group, key, leaf_, *kept in rows:
            if not self.groups or self.groups[-1][0] != group:
                self.groups.append((group, [], [], []))
            own = self.groups[-1]
            own[1].append(key)
            own[2].append(leaf_)
            own[3].append(tuple(kept))
        self.groups = [(g, keys, "".join(leaves), kept) for g, keys, leaves, kept in self.groups]


def spans(counts: list[tuple]) -> dict[int, tuple[int, int, int]]:
    """counts: (partition, groups, first group, its rows, last group, its rows). For each partition:
    the offset of its first group, and the sizes of the first and the last group."""
    sizes, begun, out = [], {}, {}
    last = None
    for pid, many, first, n_first, end, n_end in sorted(counts):
        if last is None or last[0] != first:
            sizes.append(0)
        at = len(sizes) - 1
        offset, sizes[at] = sizes[at], sizes[at] + n_first
        if many > 1:
            sizes.append(n_end)
        begun[pid] = (offset, at, len(sizes) - 1)
        last = (end,)
    for pid, (offset, a, b) in begun.items():
        out[pid] = (offset, sizes[a], sizes[b])
    return out


def placed(block: Block, span: tuple[int, int, int]) -> Iterator[tuple]:
    """(group, keys, leaves, kept, offset, size) for each group of a block."""
    for i, (group, keys, leaves, kept) in enumerate(block.groups):
        offset = span[0] if i == 0 else 0
        size = span[1] if i == 0 else span[2] if i == len(block.groups) - 1 else len(keys)
        yield group, keys, leaves, kept, offset, size


def grown(leaves: str, offset: int, size: int) -> list[tuple[int, str, int, int, int]]:
    """Levels from the leaves at offset on, of a tree of size leaves: (first node, joined digests, nodes of the
    whole level, and the nodes whose runs are whole here: from, to). The last level is the root, if it is here."""
    levels, a, data = [], offset, leaves
    while True:
        b = a + len(data) // HEX
        first, end = -(-a // FANOUT), -(-size // FANOUT) if b == size else b // FANOUT
        whole = (min(FANOUT * first, b), max(min(FANOUT * first, b), min(FANOUT * end, b)))
        levels.append((a, data, size, *whole))
        if size == 1 or end <= first:
            return levels
        data = "".join(node(data[HEX * (FANOUT * j - a) : HEX * (FANOUT * (j + 1) - a)]) for j in range(first, end))
        a, size = first, -(-size // FANOUT)


def height(size: int) -> int:
    h = 0
    while size > 1:
        size, h = -(-size // FANOUT), h + 1
    return h


def ragged(pid: int, block: Block, span: tuple[int, int, int]) -> Iterator[tuple]:
    """Rows of NODES: nodes whose run is not whole here and roots that are; and, without a digest, what this
    partition needs: runs (idx) by level, and its groups' paths (level -1)."""
    for group, keys, leaves, _, offset, size in placed(block, span):
        yield group, -1, 0, 0, None, pid
        for level, (a, data, n, whole_from, whole_to) in enumerate(grown(leaves, offset, size)):
            b = a + len(data) // HEX
            for i in [a] if n == 1 else [*range(a, whole_from), *range(whole_to, b)]:
                yield group, level, i, n, data[HEX * (i - a) : HEX * (i - a + 1)], pid
        if offset or len(keys) < size:
            for level in range(height(size)):
                step = FANOUT ** (level + 1)
                for run in {offset // step, (offset + len(keys) - 1) // step}:
                    yield group, level, run, 0, None, pid


def finished(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """nodes: grp, level, idx, n, digest. Runs (grp, level, run, digests joined) by the shuffle of nodes to their
    coordinates, one level after the other; and roots (grp, digest)."""
    nodes = nodes.select("grp", "level", "idx", "n", "digest")
    runs, tops, made = None, nodes.filter("n = 1"), None
    for level in range(levels):
        here = nodes.filter((F.col("level") == level) & (F.col("n") > 1))
        here = here if made is None else here.union(made.filter("n > 1"))
        # at most FANOUT members each
        run = written(here.groupBy("grp", F.floor(F.col("idx") / FANOUT).alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x.digest), "").alias("digests"), F.first("n").alias("n")))
        made = run.select("grp", F.lit(level + 1).alias("level"), F.col("run").alias("idx"), F.ceil(F.col("n") / FANOUT).alias("n"), F.sha2("digests", 256).alias("digest"))
        one = run.select("grp", F.lit(level).alias("level"), "run", "digests")
        runs = one if runs is None else runs.union(one)
        tops = tops.union(made.filter("n = 1"))
    empty = nodes.filter("false").select("grp", "level", F.col("idx").alias("run"), F.col("digest").alias("digests"))
    return (empty if runs is None else runs), tops.select("grp", "digest")


def paths(tops: DataFrame) -> DataFrame:
    """The tree over the groups' roots, in the order of groups: grp, subroot, root, path (an array of before and
    after, level by level)."""
    spark = tops.sparkSession
    ranked = tops.orderBy("grp").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1], x[0][1]))
    ranked = written(spark.createDataFrame(ranked, "grp string, idx long, digest string"))
    n = ranked.count()
    # all roots are in one tree, whose nodes are all ragged
    runs, root = finished(ranked.select(F.lit(None).cast("string").alias("grp"), F.lit(0).alias("level"), "idx", F.lit(n).alias("n"), "digest"), height(n))
    out = ranked.select("grp", "idx", F.col("digest").alias("subroot")).crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))  # one row
    out = out.withColumn("path", F.array().cast("array<struct<before:string,after:string>>"))
    for level in range(height(n)):
        step, here = FANOUT**level, runs.filter(F.col("level") == level).select("run", "digests")
        place = F.floor(F.col("idx") / step) % FANOUT
        out = out.withColumn("run", F.floor(F.col("idx") / (step * FANOUT))).join(here, "run").withColumn("path", F.array_append("path", siblings(F.col("digests"), place))).drop("run", "digests")
    return out.drop("idx")


def siblings(digests: Column, place: Column) -> Column:
    at = (place * HEX).cast("int")
    return F.struct(F.substr(digests, F.lit(1), at).alias("before"), F.substr(digests, at + HEX + 1).alias("after"))


def proven(block: Block, span: tuple[int, int, int], given: list[tuple]) -> Iterator[tuple]:
    """Rows (group, key, leaf, kept values, subroot, root, proof) of a block. given: finished runs
    (group, level, run, digests) and paths (group, -1, subroot, root, path)."""
    runs = {tuple(g[:3]): g[3] for g in given if g[1] >= 0}
    top = {g[0]: (g[2], g[3], [tuple(x) for x in g[4]]) for g in given if g[1] < 0}
    for group, keys, leaves, kept, offset, size in placed(block, span):
        subroot, root, path = top[group]
        levels, h = grown(leaves, offset, size), height(size)
        known: list[tuple] = [None] * h
        for k, key in enumerate(keys):
            i = offset + k
            for level in range(h):
                at = i // FANOUT**level
                if known[level] and known[level][0] == at:
                    break  # as for the row before, from here on
                run, place = divmod(at, FANOUT)
                found = None
                if level < len(levels):
                    a, data, _, whole_from, whole_to = levels[level]
                    if whole_from <= at < whole_to:
                        found = data[HEX * (FANOUT * run - a) : HEX * (FANOUT * (run + 1) - a)]
                found = runs[group, level, run] if found is None else found
                known[level] = (at, (found[: HEX * place], found[HEX * (place + 1) :]))
            yield group, key, leaves[HEX * k : HEX * (k + 1)], *kept[k], subroot, root, [x[1] for x in known] + path


def manifest(rows: DataFrame, group: str = "lang", key: str = "doc_id", leaf: str = "leaf", keep: tuple[str, ...] = ()) -> DataFrame:
    """rows: a group (text), a key, a leaf (hex digest) and columns to keep. For each row these columns, and
    subroot, root and proof: for each level from the leaf to the root, the run's digests before and after."""
    spark = rows.sparkSession
    names = [group, key, leaf, *keep]
    flat = written(rows.select(*[F.col(f"`{c}`") for c in names]))  # so leaves are hashed once, not again for the range bounds
    ordered = flat.repartitionByRange(*[F.col(f"`{c}`") for c in names]).sortWithinPartitions(*[F.col(f"`{c}`") for c in names])
    blocks = ordered.rdd.mapPartitions(lambda part: [Block(part)])
    many = blocks.getNumPartitions()

    def count(pid: int, part: Iterator[Block]) -> Iterator[tuple]:
        for b in part:
            if b.groups:
                yield pid, len(b.groups), b.groups[0][0], len(b.groups[0][1]), b.groups[-1][0], len(b.groups[-1][1])

    span = spans(blocks.mapPartitionsWithIndex(count).collect())
    nodes = written(spark.createDataFrame(blocks.mapPartitionsWithIndex(lambda pid, part: (x for b in part if b.groups for x in ragged(pid, b, span[pid]))), NODES, verifySchema=False))
    runs, tops = finished(nodes.filter("digest IS NOT NULL"), height(max((max(s[1:]) for s in span.values()), default=0)))
    top = paths(tops)
    wanted = nodes.filter("digest IS NULL").select("grp", "level", "idx", "pid")
    met = wanted.filter("level >= 0").alias("w").join(runs.alias("r"), F.col("w.grp").eqNullSafe(F.col("r.grp")) & (F.col("w.level") == F.col("r.level")) & (F.col("w.idx") == F.col("r.run")))
    met = met.select("pid", F.col("w.grp").alias("grp"), F.col("w.level").alias("level"), "idx", "digests").rdd.map(lambda r: (r[0], tuple(r[1:])))
    own = wanted.filter("level < 0").alias("w").join(top.alias("t"), F.col("w.grp").eqNullSafe(F.col("t.grp")))
    own = own.select("pid", F.col("w.grp").alias("grp"), "subroot", "root", "path").rdd.map(lambda r: (r[0], (r[1], -1, *r[2:])))
    given = met.union(own).partitionBy(many, lambda pid: pid).mapPartitions(lambda part: [[x for _, x in part]])
    done = blocks.zip(given).mapPartitionsWithIndex(lambda pid, part: (x for b, g in part if b.groups for x in proven(b, span[pid], g)))
    text = StructType.fromDDL("subroot string, root string, proof array<struct<before: string, after: string>>")
    return spark.createDataFrame(done, StructType([StructField(c, flat.schema[i].dataType) for i, c in enumerate(names)] + text.fields), verifySchema=False)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda digest, x: F.sha2(F.concat(x.before, digest, x.after), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x.before, x.after)), ""), 256)


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of docs and a trial of it: rows whose id's CRC-32 is divisible by 3 are tampered with (their
    texts' A-Z lower-cased) and checked by their proofs."""
    values = {c: F.col(c) for c in COLUMNS}
    picked = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    other = F.when(picked, leaf(values | {"text": F.translate("text", UPPER, LOWER)}))
    rows = manifest(docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), leaf(values).alias("leaf"), other.alias("other")), keep=("other",))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf(text: str) -> str:
    values = {c: f"({c})::VARCHAR" for c in COLUMNS} | {"text": text}
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({v})) || ':' || {v} END" for c, v in values.items()) + ")"


_LOWER = f"translate(text, '{UPPER}', '{LOWER}')"
ORACLE_SQL = f"""
WITH RECURSIVE {CRC_SQL},
leaves AS MATERIALIZED (SELECT doc_id, lang, {_leaf("text")} AS leaf, CASE WHEN {crc_sql("coalesce(doc_id::VARCHAR, '')")} % 3 = 0 THEN {_leaf(_LOWER)} ELSE {_leaf("text")} END AS tampered FROM documents, crc_table),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, tampered) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, i, n, leaf AS digest FROM placed
  UNION ALL SELECT lang, level + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 8),
tree AS MATERIALIZED (SELECT * FROM nodes),
subroots AS MATERIALIZED (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang COLLATE "C" NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, n, subroot AS digest FROM subroots
  UNION ALL SELECT level + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 8),
top AS MATERIALIZED (SELECT * FROM tops),
runs AS MATERIALIZED (
  SELECT lang, level, i // 8 AS run, string_agg(digest, '' ORDER BY i) AS digests FROM tree WHERE n > 1 GROUP BY ALL),
top_runs AS MATERIALIZED (SELECT level, i // 8 AS run, string_agg(digest, '' ORDER BY i) AS digests FROM top WHERE n > 1 GROUP BY ALL),
fold AS (
  SELECT p.lang, p.doc_id, p.leaf, p.tampered, p.i AS start, 0 AS level, p.i, '' AS proof, p.tampered AS folded FROM placed p
  UNION ALL SELECT f.lang, f.doc_id, f.leaf, f.tampered, f.start, f.level + 1, f.i // 8,
    f.proof || substr(r.digests, 1, 64 * (f.i % 8)) || substr(r.digests, 64 * (f.i % 8) + 65),
    sha256(substr(r.digests, 1, 64 * (f.i % 8)) || f.folded || substr(r.digests, 64 * (f.i % 8) + 65))
  FROM fold f JOIN runs r ON r.lang IS NOT DISTINCT FROM f.lang AND r.level = f.level AND r.run = f.i // 8),
below AS MATERIALIZED (SELECT f.lang, f.doc_id, f.leaf, f.start, f.proof, f.folded FROM fold f JOIN tree t ON t.lang IS NOT DISTINCT FROM f.lang AND t.level = f.level AND t.i = f.i AND t.n = 1),
above AS (
  SELECT b.lang, b.start, 0 AS level, s.i, b.proof, b.folded FROM below b JOIN subroots s ON s.lang IS NOT DISTINCT FROM b.lang
  UNION ALL SELECT f.lang, f.start, f.level + 1, f.i // 8,
    f.proof || substr(r.digests, 1, 64 * (f.i % 8)) || substr(r.digests, 64 * (f.i % 8) + 65),
    sha256(substr(r.digests, 1, 64 * (f.i % 8)) || f.folded || substr(r.digests, 64 * (f.i % 8) + 65))
  FROM above f JOIN top_runs r ON r.level = f.level AND r.run = f.i // 8),
ends AS (SELECT a.* FROM above a JOIN top t ON t.level = a.level AND t.i = a.i AND t.n = 1)
SELECT b.doc_id, b.leaf, s.subroot, t.digest AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = t.digest AS verified
FROM below b JOIN subroots s ON s.lang IS NOT DISTINCT FROM b.lang JOIN ends e ON e.lang IS NOT DISTINCT FROM b.lang AND e.start = b.start, (SELECT digest FROM top WHERE n = 1) t
"""
