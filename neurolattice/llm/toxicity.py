"""Toxicity by weak supervision.

Voters. Lexicon entries vote when a word begins with them: a short fixed English list, and stems that
are much more frequent in toxic than in other labelled training texts (mined from a bounded sample).
Pattern voters look at how dense such words are in the whole text, at several levels, and at words
that are set off by runs of marks or by capitals.

Label model. The votes of every document are one bit mask; masks are counted, and a generative model
(a share of toxic texts, and each voter's firing rate in either class) is fitted to the counted masks
by expectation maximisation, unlabelled. Correlations of voters within the classes are estimated in
the same passes; a voter that repeats what others say has its evidence divided accordingly.

Classifier. Logistic regression on entry densities and votes learns the model's posterior labels of
the sampled texts, then scores every whole text. Ids, labels, language and source are no inputs.

Bounds: SAMPLE labelled rows (one an id: the text of the least hash) and ENTRIES voters, so what comes to the driver does not grow.

Defined results: null and empty texts have no votes and get the score of such; rows whose label or id
is null teach nothing, nor do ids that are labelled both ways; repeated rows are scored each; without
any label the fixed entries alone vote; texts of any length are read whole; an empty table gives an empty
result; other columns stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, each_text, mod_of_id, written

#: Most labelled rows that are read, most voters, stem lengths, and least rows that a mined stem is in.
SAMPLE, ENTRIES, STEMS, LEAST_ROWS, LEAST_LIFT = 20_000, 56, range(4, 10), 5, 4.0
#: Abusive English words.
LEXICON = "asshole bastard bitch clown disgusting dumbass filthy freak garbage idiot imbecile loser moron pathetic pig retard scum scumbag slut stupid trash ugly vermin whore worthless".split()
#: Levels of the share of words that are entries; votes of patterns come after those of entries.
LEVELS = (0.004, 0.008, 0.012, 0.018)
PATTERNS = len(LEVELS) + 2
ROUNDS, PRIOR = 12, 0.1
MARKED = re.compile(rb"[#*$&!]{2,}$")


class Voters:
    """Entries: stems, as text. Gives each text's votes and features."""

    def __init__(self, entries: list[str]):
        self.entries, self.m = entries, len(entries) + PATTERNS
        self.of = {e: i for i, e in enumerate(entries)}
        self.lengths = sorted({len(e) for e in entries})
        self.memo = Memo(self.find, 500_000)

    def find(self, word: bytes) -> int:
        """1 + the entry's number, over 1000 if the word is set off; else 0. The longest entry counts."""
        text = word.decode("utf-8", "replace")
        plain, hit = text.lower().lstrip("\"'([{<*#_-.¡¿"), 0
        for n in self.lengths:
            hit = self.of.get(plain[:n], hit - 1) + 1 if len(plain) >= n else hit
        if hit and (MARKED.search(word) or (len(text) > 3 and text.isupper())):
            hit += 1000
        return hit

    def read(self, text: bytes) -> tuple[int, np.ndarray]:
        """(bit mask of votes, features)."""
        words = text.split()
        hits = Counter(filter(None, map(self.memo.__getitem__, words)))
        n, x, mask, total, off = len(words), np.zeros(len(self.entries) + PATTERNS + 1, np.float32), 0, 0, 0
        for hit, count in hits.items():
            off += count * (hit > 1000)
            i = hit % 1000 - 1
            mask |= 1 << i
            x[i] += min(3.0, 100 * count / n)
            total += count
        e = len(self.entries)
        for k, level in enumerate(LEVELS):
            if total and total >= level * n:
                mask |= 1 << (e + k)
                x[e + k] = 1
        if off:
            mask |= 1 << (e + len(LEVELS))
            x[e + len(LEVELS)] = 1
        if total >= 3:
            mask |= 1 << (e + len(LEVELS) + 1)
            x[e + len(LEVELS) + 1] = 1
        x[-1] = 1
        return mask, x


def sampled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """text, toxic of at most limit labelled training rows, one an id, in the order of a hash of the id."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    own = own.filter(mod_of_id() != 0).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("high")).filter("toxic = high").drop("high")
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), "doc_id")  # at most limit rows of 12 bytes
    # of several rows of one id, one teaches
    return rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"), F.first("toxic").alias("toxic")).select("x.text", "toxic")


def mined(sample: DataFrame, most: int) -> list[str]:
    """Stems that are in many toxic texts and in few others, best first; none continues a better one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(each_text(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                words = {w for w in text.decode("utf-8", "replace").lower().split() if len(w) >= 4}
                stems = {w[:n] for w in words for n in STEMS if len(w) >= n and w[:n].isalpha()}
                counts[toxic > 0].update(["", *stems])
        for toxic in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(list(counts[toxic]), pa.string()), pa.array([toxic] * len(counts[toxic]), pa.int32()), pa.array(list(counts[toxic].values()), pa.int64())], ["stem", "toxic", "n"])

    each = sample.mapInArrow(run, "stem string, toxic int, n long").groupBy("stem").agg(F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("n"))), F.lit(0)).alias("c"))
    each = written(each.filter(f"stem = '' OR t >= {LEAST_ROWS}"))
    all_ = each.filter("stem = ''").first()
    if not all_ or not all_["t"] or not all_["c"]:
        return []
    lift = F.log((F.col("t") + 0.5) / (all_["t"] + 1)) - F.log((F.col("c") + 0.5) / (all_["c"] + 1))
    best = each.filter("stem <> ''").withColumn("lift", lift).filter(F.col("lift") >= math.log(LEAST_LIFT)).orderBy(F.desc(F.col("t") * F.col("lift")), "stem").limit(40 * most).collect()
    out: list[str] = []
    for r in best:
        if len(out) < most and not any(r["stem"].startswith(s) or s.startswith(r["stem"]) for s in out):
            out.append(r["stem"])
    return out


def firing(masks: np.ndarray, m: int) -> np.ndarray:
    return ((masks[:, None] >> np.arange(m)) & 1).astype(np.float64)


class LabelModel:
    """share of toxic texts; rates[y, j]: how often voter j fires in class y; worth[j]: what its evidence counts."""

    def __init__(self, share: float, rates: np.ndarray, worth: np.ndarray):
        self.share, self.rates, self.worth = share, np.clip(rates, 1e-4, 1 - 1e-4), worth

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.rates[1]) - np.log(self.rates[0])
        off = np.log1p(-self.rates[1]) - np.log1p(-self.rates[0])
        z = math.log(self.share / (1 - self.share)) + votes @ (on * self.worth) + (1 - votes) @ (off * self.worth)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(counted: DataFrame, voters: Voters) -> LabelModel:
    """counted: mask, n. Each round is a pass that returns sums by class: votes, and votes together."""
    m, e = voters.m, len(voters.entries)
    rates = np.stack([np.full(m, 0.02), np.full(m, 0.15)])
    rates[:, e : e + len(LEVELS)] = [[0.05, 0.02, 0.01, 0.005], [0.95, 0.9, 0.8, 0.6]]
    model = LabelModel(PRIOR, rates, np.full(m, 0.5))
    for _ in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, m, m))
            for batch in batches:
                votes, n = firing(batch.column("mask").to_numpy(), m), batch.column("n").to_numpy()
                p = model.posterior(votes) * n
                for y, w in ((0, n - p), (1, p)):
                    sums[y] += (votes * w[:, None]).T @ votes
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))], ["k", "sums"])

        whole = counted.mapInArrow(run, "k long, sums array<double>").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
        sums = np.zeros(2 * m * m)
        for r in whole:
            sums[r["pos"]] = r["s"]
        sums = sums.reshape(2, m, m)
        size = class_sizes(counted, model, m)
        if size.min() < 1:
            break
        first = sums[:, np.arange(m), np.arange(m)] / size[:, None]
        both = sums / size[:, None, None]
        spread = np.sqrt(np.clip(first * (1 - first), 1e-9, None))
        related = np.clip((both - first[:, :, None] * first[:, None, :]) / (spread[:, :, None] * spread[:, None, :]), 0, 1)
        related[:, np.arange(m), np.arange(m)] = 1
        weight = size / size.sum()
        worth = 1 / np.tensordot(weight, np.where(related > 0.1, related, 0), 1).sum(1)
        floor = 0.5 / size
        new = LabelModel(float(np.clip(weight[1], 0.005, 0.5)), np.clip(first, floor[:, None], 1 - floor[:, None]), np.clip(worth, 0.1, 1))
        done = np.abs(new.rates - model.rates).max() < 1e-3
        model = new
        if done:
            break
    return model


def class_sizes(counted: DataFrame, model: LabelModel, m: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            p = float((model.posterior(firing(batch.column("mask").to_numpy(), m)) * n).sum())
            yield pa.RecordBatch.from_arrays([pa.array([float(n.sum()) - p]), pa.array([p])], ["a", "b"])

    r = counted.mapInArrow(run, "a double, b double").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    return np.array([r["a"] or 0.0, r["b"] or 0.0])


def regression(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last column is the constant. Row i stands n[i] times."""
    w = np.zeros(x.shape[1])
    w[-1] = -2.0
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (n * (p - y)) + keep * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def trained(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(entries, weights) of the classifier."""
    sample = written(sampled(docs, labels, limit))
    room = ENTRIES - len(LEXICON)
    found = [s for s in mined(sample, ENTRIES) if not any(s.startswith(x) or x.startswith(s) for x in LEXICON)][:room]
    entries = LEXICON + found
    voters = Voters(entries)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Voters(entries)
        for batch in batches:
            counts = Counter(own.read(t)[0] for t in each_text(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["mask", "n"])

    counted = written(docs.select("text").mapInArrow(vote, "mask long, n long").groupBy("mask").agg(F.sum("n").alias("n")))
    model = fit_label_model(counted, voters)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Voters(entries)
        for batch in batches:
            made = [own.read(t) for t in each_text(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in made], pa.int64()), pa.array([b.tobytes() for _, b in made], pa.binary())], ["mask", "x"])

    # equal features are one row, so the sample's many texts without a vote are few rows here
    rows = sample.mapInArrow(features, "mask long, x binary").groupBy("mask", "x").agg(F.count("*").alias("n")).collect()
    if not rows:
        x = np.eye(len(entries) + PATTERNS + 1)[-1:]
        return entries, regression(x, np.array([PRIOR]), np.ones(1))
    rows.sort(key=lambda r: (r["mask"], r["x"]))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(np.float64)
    n = np.array([r["n"] for r in rows], np.float64)
    y = model.posterior(firing(np.array([r["mask"] for r in rows]), voters.m))
    return entries, regression(x, y, n)


def scorer(entries: list[str], weights: np.ndarray):
    """A function of a column of texts: the scores."""
    voters = Voters(entries)

    def score(column: pa.Array) -> np.ndarray:
        x = [voters.read(t)[1] for t in each_text(column)]
        z = np.stack(x).astype(np.float64) @ weights if x else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    entries, weights = trained(docs, labels, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(entries, weights)
        for batch in batches:
            found = score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (mod_of_id() == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their own columns."""
    entries, weights = trained(docs, labels, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(entries, weights)
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column("text")) < 0.5))

    return docs.mapInArrow(run, docs.schema)
