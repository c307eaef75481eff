"""Near-duplicate documents by min-max hashing.

A document's set is its distinct word shingles. Each of 96 permutations gives two signature values,
the least and the largest permuted hash, so hash evaluations are half of what as many values cost;
48 bands of four values (two permutations) make the buckets. Two sets of similarity 0.75 miss every
band with a chance of about 1e-8.

Sets that are equal are one node from the start. Buckets are never expanded into pairs:
  1. a bucket's leader is the member with most neighbours in its buckets; each node is tried on full
     sets against the leader it shares most bands with, then, while they are still in different
     components, against the next few;
  2. buckets within one component need nothing more;
  3. in every other bucket, blocks of members of different components are compared, each pair in its
     first common band only, by sketches of BINS bytes (the least hash of each bin of a one-permutation
     sketch), and those that may reach the threshold are tried on full sets.
Links are confirmed on the exact shingle sets (64-bit shingle hashes), so the result has no false
link, and none is lost but by the chance above.

Nodes are pairs of id and text (by a 64-bit hash, as shingles are); an id only names a component.

Defined results: null, empty and wordless texts have no shingles and are alone; fewer words than a
shingle has are one shingle; texts of one id, or of a null id, are linked only if they are near copies;
a component's name is its least id, null being the least; an empty table gives an empty result; extra
columns of any name are left alone; texts of any length are read whole. near_dedup leaves out a wordless
row where a text of the same id stays; of rows with one id and text it keeps the one whose columns' hash
is least (maps aside), so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, each_text, fresh, written
from .components import components

SHINGLE, PERMUTATIONS, PER_BAND, BLOCK, BATCH, LEADERS, SHARES = 5, 96, 2, 512, 2048, 6, 64
BANDS = PERMUTATIONS // PER_BAND
#: Bins of a sketch; an estimate that is ERRORS standard errors and SLACK under the threshold rules a pair out.
BINS, ERRORS, SLACK = 512, 5, 0.01
_random = np.random.Generator(np.random.PCG64(20))
TIMES = _random.integers(0, 1 << 32, (PERMUTATIONS, 1), np.uint32, endpoint=False) | np.uint32(1)
PLUS = _random.integers(0, 1 << 32, (PERMUTATIONS, 1), np.uint32, endpoint=False)
PLACE = _random.integers(0, 1 << 64, 64, np.uint64, endpoint=False) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, 500_000)


def shingle_set(text: bytes, memo: Memo, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word k-shingles."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    size = min(n, k)
    out = w[: n - size + 1] * PLACE[0]
    for i in range(1, size):
        out = out + w[i : n - size + 1 + i] * PLACE[i]
    return np.unique(mixed(out + np.uint64(size)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """(PERMUTATIONS, 2): the least and the largest value under each permutation of the 32-bit hashes."""
    h, out = (shingles >> np.uint64(32)).astype(np.uint32), None
    for i in range(0, len(h), BATCH):
        x = TIMES * h[None, i : i + BATCH] + PLUS
        low, high = x.min(1), x.max(1)
        out = (low, high) if out is None else (np.minimum(out[0], low), np.maximum(out[1], high))
    return np.stack(out, 1)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, 2 * PER_BAND).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * PLACE[8]
    for i in range(2 * PER_BAND):
        key = mixed(key + rows[:, i] * PLACE[9 + i])
    return key.view(np.int64)


def sketch(shingles: np.ndarray) -> bytes:
    """For each bin of the sorted hashes, a byte of the least one in it, not 0; 0 where it is empty."""
    out = np.zeros(BINS, np.uint8)
    bins = (shingles >> np.uint64(64 - 9)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out[bins[first]] = (shingles[first] % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def may_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether the rows' sketches allow the similarity. The bins that either fills are a sample of the
    union without replacement, so the estimate's error falls with the share of the union that it is."""
    same, filled = ((a == b) & (a > 0)).sum(1), ((a > 0) | (b > 0)).sum(1)
    goal = percent / 100
    union = (na + nb) / (1 + goal)
    error = np.sqrt(goal * (1 - goal) / np.maximum(filled, 1) * np.clip(1 - filled / union, 0, 1))
    return same >= (goal - ERRORS * error - SLACK) * filled


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, node, n_shingles, digest of the set, band keys, sketch with 32 bits of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in batches:
            n, digests, keys, sketches = [], [], [], []
            for text in each_text(batch.column("text")):
                found = shingle_set(text, memo)
                n.append(len(found))
                if len(found):
                    sig = signature(found)
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    keys.append(band_keys(sig))
                    sketches.append(sketch(found) + keys[-1].astype(np.uint32).tobytes())
                else:
                    digests.append(None), keys.append(None), sketches.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "node", "n_shingles", "digest", "keys", "sketch"])

    return docs.mapInArrow(run, "doc_id long, node long, n_shingles long, digest binary, keys array<long>, sketch binary")


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach percent. Texts of a and its b's meet in blocks: a's goes to
    each block of BLOCK b's, and comes first there, so a worker keeps one set at a time."""
    # only heads of more than one block need their number, so a head's pairs meet it by shares of its b's
    salt, shares = F.pmod(F.xxhash64(F.lit(3), "b"), F.lit(SHARES)), F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).withColumn("salt", F.explode(shares))
    salted = pairs.withColumn("salt", salt).join(many, ["a", "salt"], "left")
    dealt = salted.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("n", F.lit(1)) / BLOCK)).alias("block"))
    heads = dealt.select("a", F.col("a").alias("node"), "block", F.lit(0).alias("role")).distinct()
    roles = dealt.select("a", F.col("b").alias("node"), "block", F.lit(1).alias("role")).unionByName(heads)
    placed = docs.join(roles.hint("shuffle_hash"), "node").repartition("a", "block").sortWithinPartitions("a", "block", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, at, heads = word_memo(), None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "block", "role", "node")), each_text(batch.column("text")), strict=True)
            for a, block, role, node, text in rows:
                if at != (a, block):
                    at, heads = (a, block), []
                own = shingle_set(text, memo)
                if not role:
                    heads.append(own)
                    continue
                for head in heads:  # one
                    both = len(np.intersect1d(head, own, assume_unique=True))
                    if 100 * both >= percent * (len(head) + len(own) - both) and both:
                        out.append((a, node))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return placed.select("a", "block", "role", "node", "text").mapInArrow(run, "a long, b long")


def differing(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are not in one component."""
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), F.col("component").alias(f"in_{end}"))
        pairs = pairs.join(own, end, "left").withColumn(f"in_{end}", F.coalesce(f"in_{end}", end))
    return pairs.filter("in_a <> in_b").select("a", "b")


def survivors(rows: DataFrame, percent: int) -> DataFrame:
    """rows: key, band, node, component, sketch, n_shingles of buckets with several components. Pairs of
    different components that may reach percent; buckets are compared block by block."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("m"))
    cut = rows.join(sizes, "key").withColumn("blocks", F.ceil(F.col("m") / BLOCK)).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")))
    spread = cut.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pieces = spread.select("key", "band", "node", "component", "sketch", "n_shingles", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, band = pdf.x.iloc[0], pdf.y.iloc[0], int(pdf.band.iloc[0])
        left, right = pdf[pdf.i == x], pdf[pdf.i == y]
        a, b = (np.frombuffer(b"".join(d.sketch), np.uint8).reshape(len(d), BINS + 4 * BANDS) for d in (left, right))
        ka, kb = (np.ascontiguousarray(d[:, BINS:]).view(np.uint32)[:, :band] for d in (a, b))
        a, b = a[:, :BINS], b[:, :BINS]
        ca, cb, na, nb, ia, ib = (d[c].to_numpy() for c in ("component", "n_shingles", "node") for d in (left, right))
        may = (ca[:, None] != cb) & (100 * np.minimum(na[:, None], nb) >= percent * np.maximum(na[:, None], nb))  # at most BLOCK x BLOCK
        may &= (ia[:, None] < ib) if x == y else True
        i, j = np.nonzero(may)
        kept = []
        for at in range(0, len(i), 8 * BLOCK):  # a few pairs at a time
            p, q = i[at : at + 8 * BLOCK], j[at : at + 8 * BLOCK]
            new = ~(ka[p] == kb[q]).any(1)  # else an earlier band has the pair
            p, q = p[new], q[new]
            reach = may_reach(a[p], b[q], na[p], nb[q], percent)
            kept.append((p[reach], q[reach]))
        i, j = (np.concatenate([k[n] for k in kept]) if kept else np.zeros(0, int) for n in (0, 1))
        return pd.DataFrame({"a": np.minimum(ia[i], ib[j]), "b": np.maximum(ia[i], ib[j])}, dtype="int64")

    return pieces.groupBy("key", "x", "y").applyInPandas(compare, "a long, b long").distinct()


def node_of(docs: DataFrame) -> Column:
    """One node for each pair of id and text."""
    return F.xxhash64(F.lit(20), F.col("doc_id").cast("long"), F.col("text"))


def near_nodes(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row of docs: doc_id, node, n_shingles, component_id, kept (of one node a component)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_of(docs).alias("node"), "text")
    rows = written(signed(texts))
    first = F.struct("doc_id", "node")  # null ids come first
    sets = written(rows.filter("n_shingles > 0").groupBy("digest").agg(F.min(first).alias("first")).select("digest", "first", "first.node"))
    bands = rows.join(sets.select("node", "digest"), ["node", "digest"], "left_semi").dropDuplicates(["node", "digest"])
    members = bands.select("node", F.posexplode("keys").alias("band", "key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    shared = written(members.join(sizes, "key"))
    # whole texts are shuffled once: those of nodes that share a bucket
    texts = texts.select("node", "text").join(shared.select("node").distinct().hint("shuffle_hash"), "node", "left_semi")
    texts = written(texts.dropDuplicates(["node"]))
    # a bucket's leader is the member with most neighbours in all its buckets: the text that others vary
    many = shared.groupBy("node").agg(F.sum("m").alias("many"))
    leaders = shared.join(many, "node").groupBy("key").agg(F.max("many").alias("many"), F.max_by("node", F.struct("many", F.bitwise_not("node"))).alias("leader")).drop("many")
    tried = shared.join(leaders, "key").filter("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "leader"))  # at most BANDS rows a node
    tried = written(tried.withColumn("rank", rank).filter(F.col("rank") <= LEADERS).select(F.col("leader").alias("a"), F.col("node").alias("b"), "rank"))
    first = tried.filter("rank = 1").select("a", "b")
    found = written(verified(first, texts, percent))
    labels = components(found)
    apart = written(differing(tried.filter("rank > 1").select("a", "b"), labels))
    found = written(found.unionByName(verified(apart, texts, percent)))
    labels = components(found)
    pairs = first.unionByName(apart)
    label = lambda df: df.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = label(shared)
    mixed_keys = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m")).filter("x < y").select("key")
    sketches = bands.select("node", "sketch", "n_shingles")
    rest = survivors(written(named.join(mixed_keys, "key").select("key", "band", "node", "component").join(sketches, "node")), percent)
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = written(verified(written(rest.join(done, ["a", "b"], "left_anti")), texts, percent))
    if not more.isEmpty():
        labels = components(found.unionByName(more))
    by_set = label(sets)
    names = by_set.groupBy("component").agg(F.min("first").alias("name"))
    named_sets = by_set.join(names, "component").select("digest", "name")
    return rows.join(named_sets, "digest", "left").select(
        "doc_id",
        "node",
        "n_shingles",
        F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("name.doc_id")).alias("component_id"),
        F.coalesce(F.col("name.node") == F.col("node"), F.lit(True)).alias("kept"),
    )


def near_groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    return near_nodes(docs, percent).drop("node")


def near_dedup(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs that stay: of each group one row of the least id, and every row that is alone."""
    at, number = fresh(docs.columns, "node"), fresh(docs.columns, "number")
    kept = written(near_nodes(docs, percent).filter("kept").select("doc_id", "node", "n_shingles").distinct())
    texts, blank = kept.filter("n_shingles > 0"), kept.filter("n_shingles = 0")
    ids = texts.select(F.col("doc_id").alias("id")).distinct()
    blank = blank.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_anti")
    keep = texts.unionByName(blank).select(F.col("node").alias(at))
    own = docs.withColumn(at, node_of(docs))
    rest = [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    first = F.row_number().over(Window.partitionBy(at).orderBy(F.xxhash64(*rest)))
    return own.join(keep, at).withColumn(number, first).filter(F.col(number) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY 1
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))
), reach(doc_id, to_id) AS (
  SELECT a, b FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.to_id = links.a
), least AS (
  SELECT doc_id, min(to_id) AS to_id FROM reach GROUP BY 1
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(to_id, doc_id)) AS component_id, doc_id <= coalesce(to_id, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
