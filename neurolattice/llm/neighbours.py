"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms. A text's words (hashed), the shapes of its words (letters, capitals, digits and marks, runs
made one), the shapes of neighbouring words, and words that are the same as one of the four before.
A term's weight is the logarithm of its share of the text times its inverse document frequency, which is
counted over all documents.

Space. The leading right singular vectors of the weights of at most SAMPLE labelled texts, by block power
iteration: each round is a pass over the sampled rows that returns one TERMS x RANK matrix a task.

Vote. The labelled vectors (at most SAMPLE x RANK numbers) are broadcast; every document's cosines to all
of them are one product of matrices a block of documents, exact and without an index. The NEAREST labels, and
any tied with the last, vote with their cosine to the power POWER; a small weight goes to the mean label.

Bounds: SAMPLE labelled rows (one a document id), TERMS terms, RANK dimensions; so what comes to the
driver or is broadcast does not grow.

Defined results: null and empty texts, being near nothing, get the mean label of the sample; rows whose
label or id is null teach nothing, nor do ids that are labelled both ways; of several texts of a labelled
id, the one of the least hash teaches; repeated rows are scored each; without any label all scores are
0.5; texts of any length are read whole; an empty table gives an empty result; other columns stay
(keep_good) or are not looked at (score_documents).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, each_text, unwritten, written

#: Most labelled rows that teach, terms, dimensions, voters, their power, rounds of the iteration, block of documents.
SAMPLE, TERMS, RANK, NEAREST, POWER, ROUNDS, BLOCK = 8_000, 2_048, 64, 15, 16, 6, 256
#: Terms of words come first, then repeats by distance, then shapes, then pairs of shapes.
WORDS, LAGS, SHAPES = 1_024, 8, 400
PAIRS = TERMS - WORDS - LAGS - SHAPES
#: Weight of the mean label beside the votes, and the scale of shares.
MEAN_WEIGHT, SCALE = 0.01, 200.0
#: Bytes by class: letters, capitals, digits; others stand for themselves.
CLASSES = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
RUN = re.compile(rb"(.)\1+", re.S)


def of_word(word: bytes) -> int:
    """Word, its term and its shape in one number: 32, 12 and 16 bits."""
    shape = RUN.sub(rb"\1", word.translate(CLASSES))[:12]
    h = xxhash.xxh3_64_intdigest(word)
    return (h >> 33 << 28) | (xxhash.xxh3_64_intdigest(word.lower()) % WORDS << 16) | xxhash.xxh3_64_intdigest(shape) % 65_536


def terms_of(text: bytes, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(terms in order, logarithms of their shares)."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    found = np.fromiter(map(memo.__getitem__, words), np.int64, n)
    shape = found & 65_535
    terms = [(found >> 16) & 4_095, WORDS + LAGS + shape % SHAPES, WORDS + LAGS + SHAPES + (shape[:-1] * 31 + shape[1:] * 17) % PAIRS]
    counts = np.bincount(np.concatenate(terms), minlength=TERMS)
    for lag in range(1, 5):
        counts[WORDS + lag] = np.count_nonzero(found[lag:] == found[:-lag])
    at = np.flatnonzero(counts)
    return at, np.log1p(SCALE / n * counts[at])


def frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies of the terms, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counts, n = Memo(of_word), np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for text in each_text(batch.column("text")):
                counts[terms_of(text, memo)[0]] += 1
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(np.append(counts, n))], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(TERMS + 1)
    for r in found:
        counts[r["term"]] = r["n"]
    return np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 0.1


def sampled(docs: DataFrame, labels: DataFrame, label: str, learn, idf: np.ndarray, limit: int) -> DataFrame:
    """doc_id, label, terms, weights of at most limit labelled rows, one an id: a written table."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    own = own.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("high")).filter("label = high").drop("high").filter(learn)
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # at most limit rows of 12 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(of_word)
        for batch in batches:
            texts = list(each_text(batch.column("text")))
            made = [terms_of(t, memo) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in texts], pa.int64()), pa.array([a.astype(np.int16).tobytes() for a, _ in made], pa.binary()), pa.array([normed(w * idf[a]).astype(np.float32).tobytes() for a, w in made], pa.binary())],
                ["doc_id", "label", "h", "terms", "weights"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(own), "doc_id")
    rows = rows.mapInArrow(run, "doc_id long, label int, h long, terms binary, weights binary")
    return written(rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min(F.struct("h", "terms", "weights")).alias("x")).select("doc_id", "label", "x.terms", "x.weights"), 8)


def normed(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)


def dense(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Blocks of rows x TERMS."""
    terms, weights = batch.column("terms").to_pylist(), batch.column("weights").to_pylist()
    for at in range(0, len(terms), BLOCK):
        x = np.zeros((min(BLOCK, len(terms) - at), TERMS), np.float32)
        for k in range(len(x)):
            x[k, np.frombuffer(terms[at + k], np.int16)] = np.frombuffer(weights[at + k], np.float32)
        yield x


def space(sample: DataFrame, rank: int, rounds: int = ROUNDS) -> np.ndarray:
    """TERMS x rank: leading right singular vectors of the sample's weights."""
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((TERMS, rank + 16)))[0]
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], q=q.astype(np.float32)) -> Iterator[pa.RecordBatch]:
            out = np.zeros(q.shape)
            for batch in batches:
                for x in dense(batch):
                    out += x.T @ (x @ q)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["part"])

        parts = sample.mapInArrow(run, "part binary").collect()  # one matrix for each of at most 8 files
        whole = sum(sorted((np.frombuffer(r["part"]).reshape(q.shape) for r in parts), key=lambda x: x.tobytes()), np.zeros(q.shape))
        u, s, _ = np.linalg.svd(whole, full_matrices=False)
        q = u
    return q[:, :rank].astype(np.float32)


class Voters:
    """What scores texts: idf, the space, and labelled vectors."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, nearest: int, power: int):
        self.idf, self.axes, self.vectors, self.labels, self.nearest, self.power = idf, axes, vectors, labels, nearest, power
        self.mean = float(labels.mean()) if len(labels) else 0.5

    def place(self, texts: list[bytes], memo: Memo) -> np.ndarray:
        out = np.zeros((len(texts), self.axes.shape[1]), np.float32)
        for k, text in enumerate(texts):
            at, share = terms_of(text, memo)
            out[k] = (share * self.idf[at]).astype(np.float32) @ self.axes[at]
        return normed(out)

    def vote(self, z: np.ndarray) -> np.ndarray:
        """The scores of one block of placed texts."""
        votes, weight = np.full(len(z), MEAN_WEIGHT * self.mean), np.full(len(z), MEAN_WEIGHT)
        if len(self.labels):
            cosine = z @ self.vectors.T
            k = min(self.nearest, len(self.labels))
            last = np.partition(cosine, len(self.labels) - k, axis=1)[:, len(self.labels) - k]
            rows, cols = np.nonzero(cosine >= last[:, None] - 1e-6)
            w = np.clip(cosine[rows, cols], 0, 1).astype(np.float64) ** self.power
            votes += np.bincount(rows, w * self.labels[cols], len(z))
            weight += np.bincount(rows, w, len(z))
        return votes / weight

    def score(self, column: pa.Array, memo: Memo) -> np.ndarray:
        texts, out = list(each_text(column)), []
        for at in range(0, len(texts), BLOCK):
            out.append(self.vote(self.place(texts[at : at + BLOCK], memo)))
        return np.concatenate(out) if out else np.zeros(0)


def trained(docs: DataFrame, labels: DataFrame, learn="true", label: str = "quality", limit: int = SAMPLE, rank: int = RANK, nearest: int = NEAREST, power: int = POWER) -> Voters:
    """learn: the condition on doc_id under which a labelled row may teach."""
    idf = frequencies(docs)
    sample = sampled(docs, labels, label, F.expr(learn) if isinstance(learn, str) else learn, idf, limit)
    axes = space(sample, rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [v.tobytes() for x in dense(batch) for v in normed(x @ axes)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(z, pa.binary())], ["doc_id", "label", "z"])

    found = sorted(sample.mapInArrow(run, "doc_id long, label int, z binary").collect())  # at most limit rows of 4 x rank bytes
    unwritten(sample)
    vectors = np.frombuffer(b"".join(r["z"] for r in found), np.float32).reshape(len(found), rank)
    return Voters(idf, axes, vectors, np.array([r["label"] for r in found], np.float64), nearest, power)


def teaches():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def score_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. how: as trained has it."""
    voters = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, teaches(), **how))  # SAMPLE x RANK numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(of_word)
        for batch in batches:
            found = voters.value.score(batch.column("text"), memo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **how) -> DataFrame:
    """The rows of docs whose score is at least least, with their own columns; all labelled rows may teach."""
    voters = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(of_word)
        for batch in batches:
            yield batch.filter(pa.array(voters.value.score(batch.column("text"), memo) >= least))

    return docs.mapInArrow(run, docs.schema)
