"""Subword lattice likelihood of texts.

The vocabulary of an existing subword model gives the pieces and, by their order, the first scores.
A word with its word mark is a lattice of all its segmentations into pieces, and, as one arc more,
the word itself where the training texts have it; a log-space forward recursion sums over all paths.
Pieces do not cross words, so a text's marginal probability is the product of its words' sums and of
the end's. There is such a lattice for each class of texts (by training language); the document's
class is hidden too, and summed over, so a text is scored without its language.

Piece scores are fitted per class by expectation maximisation over the distinct training words:
expected piece counts, whose number the vocabulary bounds, are all that comes to the driver. A word's
own arc has its count less a discount (from the counts of counts); the mass that is taken off weighs
the lattice of pieces, so probabilities of all words sum to 1 at most.

Texts are coded once into blocks (a block's distinct words, and each text's word numbers), written
to the shared folder. Distinct words of blocks, not words of texts, are shuffled: to count them, and
to bring a count and word scores (one packed value of 16 bytes and 4 for each class) back to their
blocks. A word's scores travel as 32-bit floats and are summed as 64-bit ones.

score is that of the whole model; lattice_score is that of the pieces alone, without arcs of words:
each word's marginal under the classes' lattices, weighed by the classes' shares.

Defined results: a null or wordless text is the end token alone; texts of any length are scored whole,
a block holding at least one; a null id counts as the empty text in the split; repeated rows count and
are scored each; an empty table gives an empty result; without training texts the first scores stand; a
table without lang has one class; the 15 most frequent languages of the training texts have a class
each, all others share one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, mod_of_id, written

MARK, BLOCK_BYTES, ROUNDS, SMOOTH, LONG, CLASSES, TOGETHER = "▁", 8 << 20, 2, 0.1, 48, 16, 50_000
BASE, TABLE_BITS = np.uint64(0x9E3779B97F4A7C15), 18
CHOICES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
BLOCK = "block long, doc_ids array<long>, held binary, ends binary, tokens binary, words binary, counts binary"


class Ids(dict):
    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers with all their low bytes first, and so on: small ones leave only zeros in the rest."""
    return packed(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpacked(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def blocks(docs: DataFrame, classes: int) -> DataFrame:
    """Rows of BLOCK. docs: doc_id, text, held_out, class. counts has a row of classes for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, ids, doc_ids, held, kind, tokens = TaskContext.get().partitionId() << 24, 0, Ids(), [], [], [], []

        def flush() -> pa.RecordBatch:
            all_ = np.concatenate([*tokens, np.zeros(0, np.int32)]).astype(np.int32)
            ends = np.cumsum([len(t) for t in tokens], dtype=np.int64)
            train = np.concatenate([*(t.astype(np.int64) * classes + k for t, h, k in zip(tokens, held, kind, strict=True) if not h), np.zeros(0, np.int64)])
            order = np.argsort(-np.bincount(all_, minlength=len(ids)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(ids), np.int32)
            rank[order] = np.arange(len(ids), dtype=np.int32)
            counts, names = np.bincount(train, minlength=len(ids) * classes).astype(np.int32).reshape(-1, classes)[order], list(ids)
            words = packed(b"\n".join([names[i] for i in order.tolist()]))
            row = [number, doc_ids[:], np.array(held, np.uint8).tobytes(), ends.tobytes(), planes(rank[all_]), words, planes(counts)]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["block", "doc_ids", "held", "ends", "tokens", "words", "counts"])

        for batch in batches:
            for doc_id, h, k, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "class")), each_text(batch.column("text")), strict=True):
                words = text.lower().split()
                doc_ids.append(doc_id)
                held.append(bool(h))
                kind.append(k)
                tokens.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                size += len(text) + 64
                if size >= BLOCK_BYTES:
                    yield flush()
                    number, size, ids, doc_ids, held, kind, tokens = number + 1, 0, Ids(), [], [], [], []
        if doc_ids:
            yield flush()

    return docs.mapInArrow(run, BLOCK)


def block_words(coded: DataFrame, classes: int) -> DataFrame:
    """word, block, at (its number there), n0, n1 ... (training tokens there by class)."""
    names = [f"n{k}" for k in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "counts")), strict=True):
                n = from_planes(counts).reshape(-1, classes).astype(np.int64)
                held = unpacked(words).split(b"\n") if len(n) else []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(np.full(len(n), block)), pa.array(np.arange(len(n), dtype=np.int32)), *(pa.array(n[:, k]) for k in range(classes))], ["word", "block", "at", *names])

    return coded.select("block", "words", "counts").mapInArrow(run, ", ".join(["word binary, block long, at int", *(f"{x} long" for x in names)]))


class Pieces:
    """The vocabulary as plain data: a piece's number by its text, and the byte pieces' numbers."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        self.size, self.number, self.bytes = model.get_piece_size(), {}, {}
        first = np.zeros(self.size)
        for i in range(self.size):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(text[3:5], 16)] = i
            elif model.is_control(i) or model.is_unknown(i) or MARK in text[1:]:
                continue
            elif text == text.translate({c: c + 32 for c in range(65, 91)}):  # texts are lower-cased
                self.number[text] = i
            else:
                continue
            first[i] = 1 / (10 - model.get_score(i))  # scores are ranks: a piece's first weight falls with its rank
        self.known = np.flatnonzero(first)
        self.first = first / first.sum()
        self.longest = max(map(len, self.number))


class Lattice:
    """Sums over segmentations under one set of piece probabilities for each class.

    many() and expect_many() take words of one length together, as arrays; edges(), score() and
    _expect_long() do the same for one word of any length."""

    def __init__(self, number: dict, byte_numbers: dict, longest: int, weights: list[np.ndarray]):
        self.number, self.byte_numbers, self.longest = number, byte_numbers, longest
        self.log = [np.log(np.maximum(w, 1e-300)).tolist() for w in weights]
        self.size, self.logs = len(weights[0]), np.array(self.log).T
        scale = np.ones(self.size)
        for text, i in number.items():
            scale[i] = 8.0 ** len(text)  # keeps the sums of a word's lattice near 1
        self.scaled = np.array(weights).T * scale[:, None]
        self.tables()

    def tables(self) -> None:
        """Two-choice hash tables of the pieces' hashes, so a lookup is two array reads."""
        self.keys, own = np.zeros(self.size + 1, np.uint64), {}
        with np.errstate(over="ignore"):
            for text, i in self.number.items():
                h = np.uint64(0)
                for c in text:
                    h = h * BASE + np.uint64(ord(c))
                self.keys[i] = h
                own[i] = tuple(int((h * m) >> np.uint64(64 - TABLE_BITS)) for m in CHOICES)
        self.slots = np.full((2, 1 << TABLE_BITS), self.size, np.int64)
        for i in own:
            for turn in range(1000):
                side = turn % 2
                at = own[i][side]
                i, self.slots[side, at] = int(self.slots[side, at]), i
                if i == self.size:
                    break
            else:
                raise ValueError("the pieces' hashes do not fit the tables")

    def found(self, words: list[str]) -> tuple[list[tuple[int, int, np.ndarray]], list[str], int]:
        """(start, end, piece number by word) for words of one length; characters that are no piece
        have numbers from size on; where there is no piece stands the last number."""
        n, length = len(words), len(words[0]) + 1
        codes = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), np.uint32).reshape(n, length).astype(np.uint64)
        out, other = [], {}
        hashes = np.zeros((n, length), np.uint64)
        for k in range(1, min(self.longest, length) + 1):
            hashes = hashes[:, : length - k + 1] * BASE + codes[:, k - 1 :]
            numbers = np.full(hashes.shape, self.size, np.int64)
            for m, slots in zip(CHOICES, self.slots, strict=True):
                may = slots[(hashes * m) >> np.uint64(64 - TABLE_BITS)]
                numbers = np.where((self.keys[may] == hashes) & (may < self.size), may, numbers)
            if k == 1:
                strange = numbers == self.size
                kinds, which = np.unique(codes[strange], return_inverse=True)
                other = [chr(int(c)) for c in kinds]
                numbers[strange] = self.size + which
                none = self.size + len(other)
            else:
                numbers[numbers == self.size] = none
            out += [(i, i + k, np.ascontiguousarray(numbers[:, i])) for i in range(length - k + 1) if k == 1 or (numbers[:, i] != none).any()]
        return out, other, none

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_numbers[b] for b in char.encode("utf-8", "replace")]

    def many(self, words: list[str]) -> np.ndarray:
        """(words, classes): natural logs of the sums over all segmentations, forward in log space."""
        if len(words[0]) > LONG:
            return np.array([[self.score(e, k) for k in range(len(self.log))] for e in map(self.edges, words)])
        arcs, other, _ = self.found(words)
        extra = [self.logs[self.bytes_of(c)].sum(0) for c in other]
        weight = np.vstack([self.logs, *extra, np.full(len(self.log), -np.inf)])
        into: list[list] = [[] for _ in range(len(words[0]) + 2)]
        for i, j, numbers in arcs:
            into[j].append((i, numbers))
        ahead = [np.zeros((len(words), len(self.log)))]
        for own in into[1:]:
            terms = np.stack([ahead[i] + weight[numbers] for i, numbers in own])
            top = terms.max(0)
            ahead.append(top + np.log(np.exp(terms - top).sum(0)))
        return ahead[-1]

    def expect_many(self, words: list[str], counted: np.ndarray, into: np.ndarray) -> None:
        """Adds each piece's expected uses in the words that counted (words, classes) marks to into (classes, pieces)."""
        if len(words[0]) > LONG:
            for word, own in zip(words, counted, strict=True):
                for k in np.flatnonzero(own):
                    self._expect_long(self.edges(word), k, into[k])
            return
        arcs, other, none = self.found(words)
        extra = [8.0 * np.exp(self.logs[self.bytes_of(c)].sum(0)) for c in other]
        weight = np.vstack([self.scaled, *extra, np.zeros(len(self.log))])
        shape = (len(words), len(self.log))
        n = len(words[0]) + 1
        ahead, back = [np.ones(shape), *(np.zeros(shape) for _ in range(n))], [*(np.zeros(shape) for _ in range(n)), np.ones(shape)]
        arcs = [(i, j, numbers, weight[numbers]) for i, j, numbers in arcs]
        for i, j, _, w in sorted(arcs, key=lambda x: x[0]):
            ahead[j] += ahead[i] * w
        for i, j, _, w in sorted(arcs, key=lambda x: -x[0]):
            back[i] += w * back[j]
        share = np.where(counted > 0, 1 / np.maximum(ahead[n], 1e-290), 0)
        every = np.concatenate([numbers for _, _, numbers, _ in arcs])
        for k in range(shape[1]):
            uses = np.bincount(every, np.concatenate([ahead[i][:, k] * share[:, k] * w[:, k] * back[j][:, k] for i, j, _, w in arcs]), none + 1)
            into[k] += uses[: self.size]
            for c, u in zip(other, uses[self.size : none], strict=True):
                for b in self.bytes_of(c):
                    into[k][b] += u

    def edges(self, word: str) -> list[list[tuple]]:
        """For each start: (end, number); a character that is no piece has its bytes' numbers."""
        text, get, out = MARK + word, self.number.get, []
        n, longest = len(text), self.longest
        for i in range(n):
            own = [(j, x) for j in range(i + 1, min(n, i + longest) + 1) if (x := get(text[i:j])) is not None]
            if not own or own[0][0] > i + 1:
                own.append((i + 1, tuple(self.byte_numbers[b] for b in text[i].encode("utf-8", "replace"))))
            out.append(own)
        return out

    def score(self, edges: list, k: int) -> float:
        """The natural log of the sum over all segmentations, by a forward recursion in log space."""
        weight, exp, log = self.log[k], math.exp, math.log
        into: list[list[float]] = [[] for _ in range(len(edges) + 1)]
        into[0].append(0.0)
        for i, own in enumerate(edges):
            terms = into[i]
            if not terms:
                continue
            at = terms[0]
            if len(terms) > 1:
                top = max(terms)
                at = top + log(sum([exp(x - top) for x in terms]))
            for j, x in own:
                into[j].append(at + (weight[x] if x.__class__ is int else sum(weight[b] for b in x)))
        terms = into[-1]
        top = max(terms)
        return top + log(sum([exp(x - top) for x in terms]))

    @staticmethod
    def _give(x, share: float, into: list[float]) -> None:
        if x.__class__ is int:
            into[x] += share
        else:
            for b in x:
                into[b] += share

    def _expect_long(self, edges: list, k: int, into: list[float]) -> None:
        """The same in log space, for words whose sums could leave the range of floats."""
        n, weight = len(edges), self.log[k]
        whole = [[(j, x, weight[x] if x.__class__ is int else sum(weight[b] for b in x)) for j, x in own] for own in edges]
        ahead, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        ahead[0] = back[n] = 0.0
        add = lambda x, y: y if x == -math.inf else x if y == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
        for i in range(n):
            for j, _, w in whole[i]:
                ahead[j] = add(ahead[j], ahead[i] + w)
        for i in range(n - 1, -1, -1):
            for j, _, w in whole[i]:
                back[i] = add(back[i], w + back[j])
        for i in range(n):
            for j, x, w in whole[i]:
                self._give(x, math.exp(min(0.0, ahead[i] + w + back[j] - ahead[n])), into)


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[np.ndarray, list[str]]]]]:
    """Some batches as one table, and its words by length: (positions, words), TOGETHER words at most."""
    held: list[pa.RecordBatch] = []

    def group() -> tuple:
        whole = pa.Table.from_batches(held)
        words = [w.decode("utf-8", "replace") for w in whole.column("word").to_pylist()]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        parts = []
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            parts += [(x, [words[i] for i in x]) for x in np.array_split(at, min(len(at), -(-len(at) * (int(n) + 1) // TOGETHER)))]
        return whole, parts

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            yield group()
            held.clear()
    if held:
        yield group()


def fitted(words: DataFrame, pieces: Pieces, classes: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """For each class, a probability for each piece; they sum to 1. Each distinct word counts once,
    for the lattice has to weigh rare and new words."""
    spark, share, names = words.sparkSession, [pieces.first] * classes, [f"n{k}" for k in range(classes)]
    trained = words.filter(" OR ".join(f"{x} > 0" for x in names)).select("word", *names)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((pieces.number, pieces.bytes, pieces.longest, share))  # as large as the vocabulary

        def run(batches: Iterator[pa.RecordBatch], held=held, size=pieces.size) -> Iterator[pa.RecordBatch]:
            lattice, sums = Lattice(*held.value), np.zeros((classes, size))
            for whole, parts in by_length(batches):
                counts = np.stack([whole.column(x).to_numpy() for x in names], 1)
                for at, own in parts:
                    lattice.expect_many(own, counts[at], sums)
            k, used = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(used.astype(np.int32)), pa.array(sums[k, used])], ["class", "piece", "uses"])

        uses = np.zeros((classes, pieces.size))
        for r in trained.mapInArrow(run, "class int, piece int, uses double").groupBy("class", "piece").agg(F.sum("uses").alias("uses")).collect():
            uses[r["class"], r["piece"]] = r["uses"]
        uses[:, pieces.known] += SMOOTH
        share = [u / u.sum() for u in uses]
        held.unpersist()
    return share


def score_documents(docs: DataFrame, model_file: str, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score for every row."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (mod_of_id() == 1).alias("held_out"), lang.alias("lang"))
    per_lang = rows.filter("NOT held_out").groupBy("lang").agg(F.count("*").alias("n"))
    most = [(r["lang"], r["n"]) for r in per_lang.orderBy(F.desc("n"), "lang").limit(CLASSES - 1).collect()]  # the rest are one class
    train_docs = rows.filter("NOT held_out").count()
    sizes = [n for _, n in most] + ([train_docs - sum(n for _, n in most)] if train_docs > sum(n for _, n in most) or not most else [])
    classes, names = len(sizes), [f"n{k}" for k in range(len(sizes))]
    kind = F.lit(min(len(most), classes - 1))
    for k, (name, _) in enumerate(most):
        kind = F.when(F.col("lang") == name, k).otherwise(kind)
    coded = written(blocks(rows.select("doc_id", "text", "held_out", kind.cast("int").alias("class")), classes))
    spread = block_words(coded, classes)
    words = written(spread.groupBy("word").agg(*(F.sum(x).alias(x) for x in names)))
    every = " + ".join(names)
    sums = words.agg(F.count(F.when(F.expr(f"{every} > 0"), 1)).alias("kinds"), *(f(x) for x in names for f in (
        lambda x: F.coalesce(F.sum(x), F.lit(0)).alias(x), lambda x: F.count(F.when(F.col(x) > 0, 1)).alias(f"v{x}"), lambda x: F.count(F.when(F.col(x) == 1, 1)).alias(f"a{x}"), lambda x: F.count(F.when(F.col(x) == 2, 1)).alias(f"b{x}")))).first()
    total, kinds = sum(sums[x] for x in names) + train_docs, sums["kinds"] + (train_docs > 0)
    pieces = Pieces(model_file)
    held = spark.sparkContext.broadcast((pieces.number, pieces.bytes, pieces.longest, fitted(words, pieces, classes, rounds)))
    n_words = [sums[x] for x in names]
    off = [(sums[f"a{x}"] + 0.5) / (sums[f"a{x}"] + 2 * sums[f"b{x}"] + 1) for x in names]  # the discount
    rest = [math.log(max(d * sums[f"v{x}"] / n, 1e-9)) if n else 0.0 for d, n, x in zip(off, n_words, names, strict=True)]
    end = [(d + 0.5) / (n + d + 1) for d, n in zip(sizes, n_words, strict=True)]
    prior = [math.log((d + 0.5) / (train_docs + 0.5 * classes)) + math.log(e) for d, e in zip(sizes, end, strict=True)]
    go_on = [math.log1p(-e) for e in end]
    shares = np.log([(d + 0.5) / (train_docs + 0.5 * classes) for d in sizes])
    pure_end = np.logaddexp.reduce([s + math.log(e) for s, e in zip(shares, end, strict=True)])
    pure_on = math.log1p(-math.exp(pure_end))
    record = np.dtype([("c", "<i8"), ("pure", "<f4"), ("own", "<f4", (classes,))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*held.value)
        for whole, parts in by_length(batches):
            counts = np.stack([whole.column(x).to_numpy() for x in names], 1)
            found = np.zeros(counts.shape)
            for at, words_ in parts:
                found[at] = lattice.many(words_)
            with np.errstate(divide="ignore"):
                whole_word = np.log(np.maximum(counts - np.array(off), 0) / np.maximum(n_words, 1))  # the arc of the word itself
            pure = np.logaddexp.reduce(found + shares, 1)
            found = np.logaddexp(found + np.array(rest), whole_word) + np.array(go_on)
            rows = np.zeros(len(counts), record)
            rows["c"], rows["pure"], rows["own"] = counts.sum(1), pure, found
            words_ = whole.column("word").combine_chunks()
            for k in range(0, len(counts), 1 << 16):
                part = rows[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([words_[k : k + (1 << 16)], pa.array([x.tobytes() for x in part], pa.binary())], ["word", "scores"])

    scored = words.select("word", *names).mapInArrow(run, "word binary, scores binary")
    place = F.concat(F.unhex(F.lpad(F.hex("at"), 8, "0")), "scores")  # 4 bytes of the word's number, then the record
    back = spread.select("word", "block", "at").join(scored, "word").select("block", place.alias("scores"))
    placed = np.dtype([("at", ">u4"), *record.descr])
    low = total + 0.5 * (kinds + 1)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(left.column("scores").to_pylist()), placed)
        rows = rows[np.argsort(rows["at"])]
        c = rows["c"]
        base, known, pure = np.log10((c + 0.5) / low), (c > 0).astype(np.int64), rows["pure"].astype(np.float64)
        by_class = [rows["own"][:, k].astype(np.float64) for k in range(classes)]
        out = []
        for r in range(right.num_rows):
            doc_ids, held_, ends, tokens = (right.column(k)[r].as_py() for k in ("doc_ids", "held", "ends", "tokens"))
            at, stops = from_planes(tokens), np.frombuffer(ends, np.int64)
            starts = np.concatenate([[0], stops[:-1]])

            def add(x: np.ndarray) -> np.ndarray:  # sums by text
                s = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x[at])])  # noqa: B023
                return s[stops] - s[starts]  # noqa: B023

            score = np.logaddexp.reduce([add(x) + p for x, p in zip(by_class, prior, strict=True)], 0) / math.log(10)
            columns = [pa.array(doc_ids, pa.int64()), np.frombuffer(held_, np.uint8).astype(bool), stops - starts + 1, add(known) + int(train_docs > 0), np.full(len(stops), total, np.int64), add(base) + math.log10((train_docs + 0.5) / low), score, (add(pure) + (stops - starts) * pure_on + pure_end) / math.log(10)]
            out.append(pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"]))
        return pa.concat_tables(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"
    return back.groupBy("block").cogroup(coded.select("block", "doc_ids", "held", "ends", "tokens").groupBy("block")).applyInArrow(finish, schema)
