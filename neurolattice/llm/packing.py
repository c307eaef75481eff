"""Harmonic packing of token sequences.

Lengths fall into classes by the reciprocal of the capacity they fill: a piece of class i is one of i
pieces in a sequence. Class i up to 64 takes pieces of exactly floor(capacity / i) tokens; a document
is cut greedily into the largest such pieces (an Egyptian fraction of its length, so few cuts), and a
rest under capacity / 64 tokens goes to the class of its own length. A class's bin takes its fixed
count of pieces and is full, so a worker fills bins alone, keeping one open bin per class. What is left open when a partition ends is laid out end to end into further sequences, the
last of which is cut at powers of two, which need no padding. Padding is therefore under 64 of 4096
tokens in any sequence, whatever the number of workers.

No shuffle: a partition's sequences have ids of their own, partition * 2^33 + a counter.

Defined results: a null text is empty and yields the end token only; repeated rows are packed each;
an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import each_text

CAPACITY, CLASSES, END, TOGETHER = 4096, 64, 2, 4 << 20
assert sys.byteorder == "little" and array("I").itemsize == 4
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_class int"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_class"]


class Words:
    """Token ids of whole texts, as little-endian 32-bit bytes. The tokenizer splits at white space and
    its pieces never cross it, so a text's ids are those of its words. Words are kept in a bounded memo
    for as long as the worker process lives; a batch's new words are encoded together."""

    made: dict[str, Words] = {}

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.memo, self.limit = Tokenizer.from_file(path), {}, limit

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def learn(self, words: set[bytes]) -> None:
        new = [*(words - self.memo.keys())]
        if len(self.memo) + len(new) > self.limit:
            self.memo.clear()
            new = [*words]
        coded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)
        self.memo.update((w, array("I", x.ids).tobytes()) for w, x in zip(new, coded, strict=True))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        # with a special token's name in it, lower-casing could make one that was not there
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.memo.__getitem__, words)) for words in split]


def pieces(length: int, capacity: int = CAPACITY, classes: int = CLASSES) -> list[tuple[int, int]]:
    """(length, class) of the pieces that a document of so many tokens is cut into."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest >= capacity // classes and rest:
        i = capacity // (rest + 1) + 1  # the least class whose pieces are no longer than the rest
        out.append((capacity // i, i))
        rest -= capacity // i
    if rest:
        out.append((rest, capacity // rest))
    return out


class Bins:
    """The open bins of one worker."""

    def __init__(self, partition: int, capacity: int = CAPACITY, classes: int = CLASSES):
        self.capacity, self.classes, self.next, self.open = capacity, classes, partition << 33, {}

    def take(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, piece: tuple, n_class: int, length: int) -> Iterator[tuple]:
        """piece: (doc_id, start, crc, doc_tokens, ids). Yields the rows of a bin that becomes full."""
        if n_class == 1:
            yield (piece[0], piece[1], length, zlib.crc32(piece[4]), piece[3], self.take(), 0, 1)
            return
        held = self.open.setdefault((n_class, length), [])
        held.append(piece)
        if len(held) == n_class:
            at = self.take()
            for k, p in enumerate(held):
                yield (p[0], p[1], length, zlib.crc32(p[4]), p[3], at, k * length, n_class)
            del self.open[n_class, length]

    def close(self) -> Iterator[tuple]:
        """What is left, end to end; a last sequence that is not full becomes sequences of powers of two."""
        left = [(p, length, n) for (n, length), held in sorted(self.open.items()) for p in held]
        total = sum(x[1] for x in left)
        rooms = [self.capacity] * (total // self.capacity)
        rest, bit = total % self.capacity, 1
        tail = []
        while rest:
            if rest & 1:
                tail.append(bit)
            rest, bit = rest >> 1, bit << 1
        rooms += tail[::-1]
        room, at, offset = 0, 0, 0
        for p, length, n in left:
            done = 0
            while done < length:
                if not room:
                    room, at, offset = rooms.pop(0), self.take(), 0
                size = min(room, length - done)
                yield (p[0], p[1] + done, size, zlib.crc32(p[4][4 * done : 4 * (done + size)]), p[3], at, offset, n)
                done, room, offset = done + size, room - size, offset + size
        self.open = {}


def coded(tokens: Words, column: pa.Array) -> Iterator[bytes]:
    """The ids of each text, some texts at a time."""
    held, size = [], 0
    for text in each_text(column):
        held.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield from tokens(held)
            held, size = [], 0
    yield from tokens(held)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """One row per piece: SCHEMA. n_class is the piece's harmonic class. tokenizer: the path of a
    tokenizers file whose pre-tokenizer splits at white space, there on every machine."""
    assert capacity & (capacity - 1) == 0, "the capacity must be a power of two"
    end = END.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bins, rows = Words.of(tokenizer), Bins(TaskContext.get().partitionId(), capacity, classes), []

        def flush() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(NAMES)
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "n_class" else pa.int64()) for n, c in zip(NAMES, columns, strict=True)], NAMES)
            rows.clear()
            return out

        for batch in batches:
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), coded(tokens, batch.column("text")), strict=True):
                ids = own + end
                n, start = len(ids) // 4, 0
                for length, n_class in pieces(n, capacity, classes):
                    rows += bins.add((doc_id, start, None, n, ids[4 * start : 4 * (start + length)]), n_class, length)
                    start += length
            yield flush()
        rows += bins.close()
        yield flush()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
