"""FIF files: raw recordings, trials and averages as Python data sources, and a sink of raw recordings.

A file is a run of tags (kind, type, size, position of the next). Tasks walk over the tags' heads, by ranged
reads or by the file's own directory, up to the end of their byte range, and read the data whose tags begin in it;
so all channels of a buffer are read once, and a file is read by as many tasks as it has ranges.

    "fif"         rec, ch, ch_name, samp, value: samp counts from the file's first sample, as events do
    "fif_epochs"  rec, epoch, samp, code, ch, ch_name, t, value: samp and code of its event, t samples from it
    "fif_evoked"  rec, evoked, comment, kind, nave, ch, ch_name, t, value

rec is the file's name, of a split recording the first file's. A path to the first file of a split recording reads
all of them, and fails when one is missing; a folder reads every file in it. Buffers that the acquisition skipped
give no rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from . import files, sinks

# Fixed values of the format: kinds of tags and blocks, types of data.
FILE_ID, DIR_POINTER, DIR, BLOCK_START, BLOCK_END, FREE_LIST, NOP = 100, 101, 102, 104, 105, 106, 108
REF_ROLE, REF_FILE_NUM, REF_FILE_NAME = 115, 117, 118
NCHAN, SFREQ, CH_INFO, COMMENT, NAVE, FIRST_SAMPLE, LAST_SAMPLE, ASPECT_KIND, CH_DACQ_NAME = 200, 201, 203, 206, 207, 208, 209, 210, 258
DATA_BUFFER, DATA_SKIP, EPOCH, DATA_SKIP_SAMP, EVENT_LIST = 300, 301, 302, 303, 3561
B_MEAS, B_MEAS_INFO, B_RAW, B_EVOKED, B_ASPECT, B_CONTINUOUS, B_CH_INFO, B_REF, B_IAS, B_EVENTS, B_EPOCHS = 100, 101, 102, 104, 105, 112, 113, 118, 119, 361, 373
INT, FLOAT, DOUBLE, STRING, CH_STRUCT, ID_STRUCT = 3, 4, 5, 10, 30, 31
NUMBERS = {2: ">i2", 3: ">i4", 4: ">f4", 5: ">f8", 16: ">i2"}
PREVIOUS, NEXT = 1, 2

RANGE = 1 << 27
ROWS = 1 << 18


def walk(f: files.Ranged, until: int) -> Iterator[tuple[int, int, int, int]]:
    """(kind, type, size, position) of the tags that begin before until, in order."""
    place = 0
    while 0 <= place < until and place + 16 <= f.size:
        kind, form, size, after = struct.unpack(">4i", f.read(place, 16))
        yield kind, form, size, place
        if kind == DIR_POINTER and size == 4:
            listed = struct.unpack(">i", f.read(place + 16, 4))[0]
            if listed > 0:
                n = struct.unpack(">4i", f.read(listed, 16))[2] // 16
                entries = np.frombuffer(f.read(listed + 16, 16 * n), ">i4").reshape(-1, 4)
                for entry in entries[(entries[:, 0] >= 0) & (entries[:, 3] > place) & (entries[:, 3] < until)].tolist():
                    yield tuple(entry)
                return
        place = place + 16 + size if after == 0 else after


@dataclass
class Contents:
    names: list[str] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    sfreq: float = 0.0
    continues: bool = False  # another file goes before
    following: str | None = None
    buffers: list = field(default_factory=list)  # (first sample, samples, type, position of the tag)
    events: np.ndarray | None = None
    trials: list = field(default_factory=list)  # (type, size, position) of the trials' arrays
    first: int = 0  # of the trials' samples
    averages: list = field(default_factory=list)


def contents(f: files.Ranged, until: int) -> Contents:
    """What the tags that begin before until say."""
    c, inside, role, wide, samp, skip, in_samples = Contents(), [], 0, 0, 0, 0, 0
    get = lambda form: struct.unpack(form, f.read(place + 16, size))[0]
    text = lambda: f.read(place + 16, size).rstrip(b"\0").decode("latin-1")
    for kind, form, size, place in walk(f, until):
        block = inside[-1] if inside else 0
        if kind == BLOCK_START:
            inside.append(get(">i"))
            if inside[-1] == B_EVOKED:
                c.averages.append({"comment": "", "first": 0, "last": -1, "aspects": []})
            elif inside[-1] == B_ASPECT and B_EVOKED in inside:
                c.averages[-1]["aspects"].append({"kind": 0, "nave": 1, "data": []})
            elif inside[-1] == B_CH_INFO:
                wide += 1
        elif kind == BLOCK_END:
            inside.pop()
        elif block == B_REF and kind == REF_ROLE:
            role = get(">i")
            c.continues |= role == PREVIOUS
        elif block == B_REF and kind == REF_FILE_NAME and role == NEXT:
            c.following = text()
        elif kind == SFREQ:
            c.sfreq = get(">f")
        elif kind == CH_INFO:
            info = f.read(place + 16, size)
            c.gain.append(float(np.prod(struct.unpack(">2f", info[12:20]))))
            c.names.append(info[80:96].split(b"\0")[0].decode("latin-1"))
        elif block == B_CH_INFO and kind == CH_DACQ_NAME:
            c.names[wide - 1] = text()
        elif block in (B_RAW, B_CONTINUOUS, B_IAS):
            if kind == FIRST_SAMPLE:
                samp = get(">i")
            elif kind == DATA_SKIP:
                skip += get(">i")
            elif kind == DATA_SKIP_SAMP:
                in_samples += get(">i")
            elif kind == DATA_BUFFER:
                n = size // (number(form).itemsize * len(c.names))
                samp += skip * n + in_samples  # skipped buffers are as long as the one that follows them
                c.buffers.append((samp, n, form, place))
                samp, skip, in_samples = samp + n, 0, 0
        elif block == B_EVENTS and kind == EVENT_LIST or block == B_EPOCHS and kind == EVENT_LIST:
            c.events = np.frombuffer(f.read(place + 16, size), ">i4").reshape(-1, 3)
        elif block == B_EPOCHS and kind == FIRST_SAMPLE:
            c.first = get(">i")
        elif block == B_EPOCHS and kind == EPOCH:
            c.trials.append((form, size, place))
        elif block == B_EVOKED and kind in (COMMENT, FIRST_SAMPLE, LAST_SAMPLE):
            c.averages[-1][{COMMENT: "comment", FIRST_SAMPLE: "first", LAST_SAMPLE: "last"}[kind]] = text() if kind == COMMENT else get(">i")
        elif block == B_ASPECT and B_EVOKED in inside:
            aspect = c.averages[-1]["aspects"][-1]
            if kind == EPOCH:
                aspect["data"].append((form, size, place))
            elif kind in (ASPECT_KIND, NAVE):
                aspect["kind" if kind == ASPECT_KIND else "nave"] = get(">i")
    return c


def number(form: int) -> np.dtype:
    kind = NUMBERS.get(form & 0xFFFF)
    if kind is None:
        raise ValueError(f"samples of type {form & 0xFFFF} are not real numbers")
    return np.dtype(kind)


def shape(f: files.Ranged, size: int, place: int) -> list[int]:
    """Lengths of an array, outermost first, from behind its values."""
    end = place + 16 + size
    n = struct.unpack(">i", f.read(end - 4, 4))[0]
    return list(struct.unpack(f">{n}i", f.read(end - 4 - 4 * n, 4 * n)))[::-1]


def recording(path: str, c: Contents) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return re.sub(r"(-\d+)(?=\.fif$)|(?<=_split-)\d+", lambda m: "" if m[1] else "1".zfill(len(m[0])), name) if c.continues else name


def chain(path: str) -> dict[str, int]:
    """path and the files that go on from it, with their sizes."""
    found: dict[str, int] = {}
    while path not in found:
        found |= files.sizes(path)
        with files.Ranged(path) as f:
            following = contents(f, f.size).following
        if following is None:
            break
        path = files.beside(path, following)
    return found


@dataclass
class Range(InputPartition):
    path: str
    low: int
    high: int
    before: int = 0  # trials in the files before


class Reader(DataSourceReader):
    """Ranges of files. Equal ch chooses rows, bounds of samp choose buffers or trials; Spark checks the bounds again."""

    def __init__(self, path: str, whole: bool = False):
        named = files.sizes(path)
        self.files = chain(path) if path in named else {p: n for p, n in named.items() if p.endswith(".fif")}
        self.step = max(self.files.values(), default=1) if whole else RANGE
        self.ch, self.low, self.high = None, -(1 << 62), 1 << 62

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ch",) and self.ch is None:
                self.ch = f.value
                continue
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("samp",):
                self.low = max(self.low, f.value)
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("samp",):
                self.high = min(self.high, f.value)
            yield f

    def partitions(self):
        return [Range(p, a, min(a + self.step, n)) for p, n in self.files.items() for a in range(0, n, self.step)]

    def picks(self, c: Contents) -> list[int]:
        return [k for k in range(len(c.names)) if self.ch is None or k == self.ch]

    def table(self, c: Contents, picks: list[int], x: np.ndarray, axis: str, first: int, **same) -> pa.RecordBatch:
        """Rows of values x (channel, sample), with same columns before."""
        n = x.shape[1]
        m = len(picks) * n
        columns = {k: pa.repeat(pa.scalar(v, {int: pa.int32()}.get(type(v))), m) if not isinstance(v, pa.Scalar) else pa.repeat(v, m) for k, v in same.items()}
        columns["ch"] = pa.array(np.repeat(np.array(picks, np.int32), n))
        columns["ch_name"] = pa.array(np.repeat(np.array(c.names, object)[picks], n), pa.string())
        columns[axis] = pa.array(np.tile(np.arange(first, first + n, dtype=np.int64), len(picks)))
        columns["value"] = pa.array((x[picks] * np.array(c.gain)[picks, None]).ravel())
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


class RawReader(Reader):
    def read(self, part: Range):
        with files.Ranged(part.path) as f:
            c = contents(f, part.high)
            rec, picks, n_ch = recording(part.path, c), self.picks(c), len(c.names)
            step = max(1, ROWS // max(1, len(picks)))
            for samp, n, form, place in c.buffers:
                if place < part.low or samp > self.high or samp + n <= self.low:
                    continue
                width = number(form).itemsize * n_ch
                for a in range(0, n if picks else 0, step):
                    m = min(step, n - a)
                    x = np.frombuffer(f.read(place + 16 + a * width, m * width), number(form)).reshape(m, n_ch).T.astype(float)
                    yield self.table(c, picks, x, "samp", samp + a, rec=rec)


class EpochsReader(Reader):
    """A trial is read where its values begin; the event list goes before the values, the number of times behind them.
    Trials of split files are numbered on, so their lists are read first."""

    def __init__(self, path: str):
        super().__init__(path)
        self.before, following = dict.fromkeys(self.files, 0), {}
        for p, n in self.files.items():
            with files.Ranged(p) as f:
                c = contents(f, n)
            following[p] = (0 if c.events is None else len(c.events), c.following and files.beside(p, c.following))
        for p in self.files.keys() - {after for _, after in following.values()}:
            n = 0
            while p in following:
                self.before[p] = n
                more, p = following.pop(p)
                n += more

    def partitions(self):
        return [Range(p.path, p.low, p.high, self.before[p.path]) for p in super().partitions()]

    def read(self, part: Range):
        with files.Ranged(part.path) as f:
            c = contents(f, part.high)
            rec, picks, k = recording(part.path, c), self.picks(c), 0
            for form, size, place in c.trials:
                n_trials, n_ch, n = shape(f, size, place)
                width = number(form).itemsize * n_ch * n
                for i in range(n_trials):
                    samp, code = int(c.events[k + i][0]), int(c.events[k + i][2])
                    start = place + 16 + i * width
                    if part.low <= start < part.high and self.low <= samp <= self.high and picks:
                        x = np.frombuffer(f.read(start, width), number(form)).reshape(n_ch, n).astype(float)
                        yield self.table(c, picks, x, "t", c.first, rec=rec, epoch=part.before + k + i, samp=pa.scalar(samp, pa.int64()), code=code)
                k += n_trials


class EvokedReader(Reader):
    def read(self, part: Range):
        with files.Ranged(part.path) as f:
            c, k = contents(f, f.size), 0
            rec, picks = recording(part.path, c), self.picks(c)
            for average in c.averages:
                for aspect in average["aspects"]:
                    values = []
                    for form, size, place in aspect["data"]:
                        n = int(np.prod(shape(f, size, place))) if form & 0x40000000 else size // number(form).itemsize
                        values.append(np.frombuffer(f.read(place + 16, n * number(form).itemsize), number(form)))
                    x = np.concatenate(values).reshape(len(c.names), -1).astype(float)
                    yield self.table(c, picks, x, "t", average["first"], rec=rec, evoked=k, comment=average["comment"], kind=aspect["kind"], nave=aspect["nave"])
                    k += 1


class FifSource(DataSource):
    made = RawReader

    @classmethod
    def name(cls):
        return "fif"

    def schema(self):
        return "rec string, ch int, ch_name string, samp long, value double"

    def reader(self, schema):
        return self.made(self.options["path"])


class FifEpochsSource(FifSource):
    made = EpochsReader

    @classmethod
    def name(cls):
        return "fif_epochs"

    def schema(self):
        return "rec string, epoch int, samp long, code int, ch int, ch_name string, t long, value double"


class FifEvokedSource(FifSource):
    @classmethod
    def name(cls):
        return "fif_evoked"

    def schema(self):
        return "rec string, evoked int, comment string, kind int, nave int, ch int, ch_name string, t long, value double"

    def reader(self, schema):
        return EvokedReader(self.options["path"], whole=True)


def tag(kind: int, form: int, data: bytes, after: int = 0) -> bytes:
    return struct.pack(">4i", kind, form, len(data), after) + data


def block(kind: int, *tags: bytes) -> bytes:
    mark = struct.pack(">i", kind)
    return tag(BLOCK_START, INT, mark) + b"".join(tags) + tag(BLOCK_END, INT, mark)


def int_tag(kind: int, value: int) -> bytes:
    return tag(kind, INT, struct.pack(">i", value))


def measurement(names: list[str], sfreq: float) -> bytes:
    """The file's first tags and the description of its channels; the measurement's block stays open."""
    info = [int_tag(NCHAN, len(names)), tag(SFREQ, FLOAT, struct.pack(">f", sfreq))]
    for i, name in enumerate(names):
        # number, number in the acquisition, kind (EEG), range, calibration, coil, place, unit (V), power of ten, name
        info.append(tag(CH_INFO, CH_STRUCT, struct.pack(">3i2fi12f2i16s", i + 1, i + 1, 2, 1.0, 1.0, 1, *[0.0] * 12, 107, 0, name.encode("latin-1")[:15])))
    if any(len(name) > 15 for name in names):
        info += [block(B_CH_INFO, tag(CH_DACQ_NAME, STRING, name.encode("latin-1"))) for name in names]
    start = tag(FILE_ID, ID_STRUCT, struct.pack(">5i", 65540, 0, 0, 0, 0)) + int_tag(DIR_POINTER, -1) + int_tag(FREE_LIST, -1)
    return start + tag(BLOCK_START, INT, struct.pack(">i", B_MEAS)) + block(B_MEAS_INFO, *info)


def part_name(name: str, k: int) -> str:
    return name if k == 0 else f"{name.removesuffix('.fif')}-{k}.fif"


def export_fif(samples: DataFrame, path: str, sfreq: float, names: list[str], buffer: int | None = None, split_bytes: int = 1 << 29, double: bool = False) -> int:
    """samples (ch, samp, value), ch the place of its name, as a recording split into files of at most split_bytes;
    returns how many. Each file is written by one task, buffer by buffer from sorted rows, and appears complete; path.fif,
    path-1.fif and so on refer to each other. Missing samples are NaN, buffers without any are skipped. Two values of one
    sample, or a ch without a name, are an error; no samples give a file without buffers."""
    if not path.endswith(".fif"):
        raise ValueError("a name ending in .fif is expected")
    n_ch, form = len(names), DOUBLE if double else FLOAT
    buffer = buffer or max(1, int(sfreq))
    width = number(form).itemsize * n_ch
    per = max(1, (min(split_bytes, (1 << 31) - (1 << 24)) - (1 << 16)) // (width * buffer + 16)) * buffer
    path = files.qualified(samples.sparkSession, path)
    low, high, _ = sinks.extent(samples, n_ch)
    if low < -(1 << 31) or high >= 1 << 31:
        raise ValueError("the format counts samples in 32 bits")
    parts = max(1, -(-(high - low + 1) // per))
    folder, name = path.rsplit("/", 1) if "/" in path else (".", path)
    head = measurement(names, sfreq)

    def refer(role: int, k: int) -> bytes:
        return block(B_REF, int_tag(REF_ROLE, role), tag(REF_FILE_NAME, STRING, part_name(name, k).encode()), int_tag(REF_FILE_NUM, k))

    def write(batches):
        from itertools import groupby

        for k, group in groupby(sinks.buffers(batches, low, buffer, n_ch), key=lambda b: b[0]):
            with files.appearing(f"{folder}/{part_name(name, k)}") as out:
                out.write(head + tag(BLOCK_START, INT, struct.pack(">i", B_RAW)))
                began, place = False, low + k * per
                for _, start, x in group:
                    if x is None:
                        continue
                    data = tag(DATA_BUFFER, form, x[: high + 1 - start].astype(number(form)).tobytes())
                    if not began:
                        out.write(int_tag(FIRST_SAMPLE, start) + (refer(PREVIOUS, k - 1) if k else b""))
                        began, place = True, start
                    missing = (start - place) // buffer
                    if missing and len(data) == 16 + width * buffer:
                        out.write(int_tag(DATA_SKIP, missing))
                    elif missing:  # a skip would be counted in buffers of the short one that follows
                        out.write(tag(DATA_BUFFER, form, np.full(buffer * n_ch, np.nan).astype(number(form)).tobytes()) * missing)
                    out.write(data)
                    place = start + buffer
                if not began:
                    out.write(int_tag(FIRST_SAMPLE, place) + (refer(PREVIOUS, k - 1) if k else b""))
                out.write(refer(NEXT, k + 1) if k + 1 < parts else b"")
                out.write(tag(BLOCK_END, INT, struct.pack(">i", B_RAW)) + tag(BLOCK_END, INT, struct.pack(">i", B_MEAS)) + tag(NOP, 0, b"", -1))
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int64())})

    return sinks.dealt(samples, low, per, parts).mapInArrow(write, "part long").agg(F.count_distinct("part")).first()[0]
