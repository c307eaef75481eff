"""Exact deduplication by content-defined chunk recipes.

A text's bytes are cut where a rolling hash of the last 32 bytes is zero in its top bits, so equal
passages are cut alike wherever they stand. A chunk's digest is its SHA-256 with its length. Chunks are
deduplicated into a table where a chunk's bytes are compared with all others of its digest (each task
sends a chunk once), and a digest that holds gets a number; two contents under one digest stop the job.
A recipe is the ordered list of a text's chunk numbers, and rows are equal when their recipes are.
Texts never move for the comparison; exact_dedup moves each row once, to the decision on it.

Defined results: a null text counts as empty (a recipe without chunks); texts of any length are chunked
whole; rows with null ids take part, a null id being the smallest; repeated rows of one id and text are
one group, and filtering keeps one of them; an empty table gives an empty result; extra columns of any
name are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_bytes, unwritten, written

WINDOW, LEAST, MOST, BITS, STEP = 32, 512, 8192, 11, 4 << 20
#: Bytes of a digest: SHA-256 and the length.
DIGEST = 36
#: Chunks that a worker holds before it sends them on.
HELD = 1024


def _table() -> np.ndarray:
    """A random 32-bit number for each byte value, from a fixed rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


TABLE, BASE = _table(), 0x2C1B3C6D | 1


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions after which a cut may stand: the polynomial hash of the last WINDOW bytes, by doubling."""
    h, width, power = TABLE[data], 1, BASE
    while width < WINDOW and width < len(h):
        longer = h.copy()
        longer[width:] += h[:-width] * np.uint32(power)
        h, width, power = longer, 2 * width, power * power % (1 << 32)
    return np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1


def chunk_ends(start: int, end: int, cuts: list[int]) -> list[int]:
    """Ends of the chunks of data[start:end]: none under LEAST but the last, none over MOST."""
    ends, last = [], start
    for cut in cuts:
        if cut >= end:
            break
        while cut - last > MOST:
            last += MOST
            ends.append(last)
        if cut - last >= LEAST:
            ends.append(cut)
            last = cut
    while end - last > MOST:
        last += MOST
        ends.append(last)
    if end > last:
        ends.append(end)
    return ends


def chunked(column: pa.Array) -> Iterator[tuple[memoryview, list[memoryview]]]:
    """Each text's bytes and its chunks. A cut needs LEAST >= WINDOW bytes before it in its own text."""
    offsets, data = text_bytes(column)
    view, i, n = memoryview(data), 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP)) - 1)
        low = int(offsets[i])
        cuts = cut_points(data[low : int(offsets[j])]) + low
        bounds = np.searchsorted(cuts, offsets[i : j + 1])
        for k in range(i, j):
            a, b = int(offsets[k]), int(offsets[k + 1])
            ends = chunk_ends(a, b, cuts[bounds[k - i] : bounds[k - i + 1]].tolist())
            yield view[a:b], [view[x:y] for x, y in zip([a, *ends], ends, strict=False)]
        i = j


def recipe(chunks: list) -> bytes:
    return b"".join(hashlib.sha256(x).digest() + len(x).to_bytes(4, "little") for x in chunks)


def recipes(docs: DataFrame) -> DataFrame:
    """row, doc_id, digests (one after the other), text_sha256, n_chunks. docs: row, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(recipe(c), hashlib.sha256(t).hexdigest(), len(c)) for t, c in chunked(batch.column("text"))]
            a, b, c = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(a, pa.binary()), pa.array(b, pa.string()), pa.array(c, pa.int32())], ["row", "doc_id", "digests", "text_sha256", "n_chunks"])

    return docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "row long, doc_id long, digests binary, text_sha256 string, n_chunks int")


def chunk_store(docs: DataFrame) -> DataFrame:
    """One row per distinct chunk: digest, content, n_uses. The bytes of all chunks of a digest are compared."""

    def rows(uses: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([recipe([c]) for c in uses], pa.binary()), pa.array(uses.keys(), pa.binary()), pa.array(uses.values(), pa.int64())], ["digest", "content", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict[bytes, int] = {}
        for batch in batches:
            for _, chunks in chunked(batch.column("text")):
                for c in map(bytes, chunks):
                    uses[c] = uses.get(c, 0) + 1
                    if len(uses) >= HELD:  # small batches keep the worker small
                        yield rows(uses)
                        uses = {}
        yield rows(uses)

    found = docs.select("text").mapInArrow(run, "digest binary, content binary, n long")
    each = found.groupBy("digest").agg(F.min("content").alias("content"), F.max("content").alias("other"), F.sum("n").alias("n_uses"))
    held = F.when(F.col("content") == F.col("other"), F.col("content")).otherwise(F.raise_error(F.lit("two contents under one digest")).cast("binary"))
    return each.select("digest", held.alias("content"), "n_uses")


def listed(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_sha256, n_chunks, recipe (the list of verified chunk numbers). docs: row, doc_id, text."""
    made = written(recipes(docs))
    chunks = written(chunk_store(docs).select("digest", F.length("content").alias("n_bytes"), F.monotonically_increasing_id().alias("number")))
    parts = F.transform(F.sequence(F.lit(0), F.col("n_chunks") - 1), lambda i: F.substr("digests", i * DIGEST + 1, F.lit(DIGEST)))
    used = made.filter("n_chunks > 0").select("row", F.posexplode(parts).alias("at", "digest")).join(chunks.filter("n_bytes > 0"), "digest")
    lists = used.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("x")).select("row", F.col("x.number").alias("recipe"))
    none = F.array().cast("array<long>")
    out = written(made.drop("digests").join(lists, "row", "left").withColumn("recipe", F.coalesce("recipe", none)))
    unwritten(made), unwritten(chunks)
    return out


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    rows = listed(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    each = rows.groupBy("recipe", "doc_id").agg(F.count("*").alias("n"))
    kept = written(each.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")))  # a table, so that both sides are shuffled for the join alone and a hot recipe can be split
    return rows.join(kept, "recipe").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_chunks")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns: of equal texts the largest id's, and of several such rows the first."""
    names = docs.columns
    row = fresh(names, "row")
    placed = written(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = listed(placed.select(F.col(f"`{row}`").alias("row"), "doc_id", "text"))
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("row")))  # a null id is the smallest
    keep = rows.groupBy("recipe").agg(best.alias("best")).select((-F.col("best.row")).alias(row))
    return placed.join(keep, row, "left_semi").select(*(F.col(f"`{c}`") for c in names))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
