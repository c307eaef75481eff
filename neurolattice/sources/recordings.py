"""Recordings from files, as Python data sources: "edf" (EDF and BDF) and "brainvision"; FIF is in fiff.py.

Both give rows (rec string, ch int, ch_name string, samp long, value double), rec the file's name. Tasks read a
file's header and then a range of samples of all its channels, by ranged reads of any file system that pyarrow
opens; the driver lists names and sizes only. A filter on ch or samp reads or gives only what it asks for. Values
are in the header's physical units.

    spark.dataSource.register(EdfSource); spark.read.format("edf").load(path)
"""

from __future__ import annotations

import configparser
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from . import fiff, files

SCHEMA = "rec string, ch int, ch_name string, samp long, value double"
NAMES = ["rec", "ch", "ch_name", "samp", "value"]
BLOCK = 1 << 16
SHARE = 1 << 26  # bytes of a file that a task reads, about


@dataclass
class Header:
    path: str
    names: list[str]
    sfreq: list[float]
    gain: list[float]
    offset: list[float]
    n: list[int]  # samples of each channel
    layout: dict


def edf_header(path: str) -> Header:
    with files.Ranged(path) as f:
        head = f.read(0, 256)
        wide = head[:1] == b"\xff"
        n_signals, size = int(head[252:256]), int(head[184:192])
        rest, length = f.read(256, 256 * n_signals), f.size
    records, seconds = int(head[236:244]), float(head[244:252])

    def field(at: int, width: int) -> list[str]:
        low = at * n_signals
        return [rest[low + i * width : low + (i + 1) * width].decode("latin-1").strip() for i in range(n_signals)]

    names, per = field(0, 16), [int(x) for x in field(216, 8)]
    low, high, dlow, dhigh = ([float(x) for x in field(at, 8)] for at in (104, 112, 120, 128))
    width = 3 if wide else 2
    if records < 0:
        records = (length - size) // (width * sum(per))
    gain = [(b - a) / (d - c) if d != c else 1.0 for a, b, c, d in zip(low, high, dlow, dhigh, strict=True)]
    offset = [a - c * g for a, c, g in zip(low, dlow, gain, strict=True)]
    layout = {"size": size, "records": records, "per": per, "width": width, "seconds": seconds, "texts": [i for i, n in enumerate(names) if n in ("EDF Annotations", "BDF Annotations")]}
    return Header(path, names, [p / seconds if seconds else 0.0 for p in per], gain, offset, [p * records for p in per], layout)


def edf_records(h: Header, f: files.Ranged, first: int, last: int) -> np.ndarray:
    """Bytes of records first to last, a row each."""
    row = sum(h.layout["per"]) * h.layout["width"]
    return np.frombuffer(f.read(h.layout["size"] + first * row, (last - first) * row), np.uint8).reshape(-1, row)


def edf_values(h: Header, records: np.ndarray, ch: int) -> np.ndarray:
    """Digital values of one signal in records."""
    per, width = h.layout["per"], h.layout["width"]
    before = sum(per[:ch]) * width
    raw = np.ascontiguousarray(records[:, before : before + per[ch] * width])
    if width == 2:
        return raw.view("<i2").ravel().astype(float)
    b = raw.reshape(-1, 3).astype(np.int32)
    v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
    return np.where(v >= 1 << 23, v - (1 << 24), v).astype(float)


def edf_annotations(path: str) -> list[tuple[float, float, str]]:
    """(onset, duration, description) of the annotation signals' lists."""
    h, out = edf_header(path), []
    per, width, records = h.layout["per"], h.layout["width"], h.layout["records"]
    step = max(1, SHARE // max(1, sum(per) * width))
    with files.Ranged(path) as f:
        for a in range(0, records if h.layout["texts"] else 0, step):
            data = edf_records(h, f, a, min(a + step, records))
            for ch in h.layout["texts"]:
                at = sum(per[:ch]) * width
                for record in data[:, at : at + per[ch] * width]:
                    for m in re.finditer(rb"([+-]\d+\.?\d*)(?:\x15(\d+\.?\d*))?\x14([^\x00]*)\x14\x00?", record.tobytes()):
                        out += [(float(m[1]), float(m[2] or 0), t) for t in m[3].decode("utf-8", "replace").split("\x14") if t]
    return sorted(out)


def brainvision_header(path: str) -> Header:
    text = files.whole(path).decode("utf-8", "replace").replace("\r\n", "\n")
    body = text[text.index("[Common Infos]") :].split("\n[Comment]")[0]
    ini = configparser.ConfigParser(interpolation=None, strict=False, comment_prefixes=(";",))
    ini.optionxform = str
    ini.read_string(body)
    common = ini["Common Infos"]
    n = int(common["NumberOfChannels"])
    parts = [ini["Channel Infos"][f"Ch{i + 1}"].split(",") for i in range(n)]
    kind = {"INT_16": "<i2", "IEEE_FLOAT_32": "<f4", "INT_32": "<i4"}[ini.get("Binary Infos", "BinaryFormat", fallback="INT_16")]
    data = files.beside(path, common["DataFile"].replace("$b", os.path.splitext(os.path.basename(path))[0]))
    samples = sum(files.sizes(data).values()) // (np.dtype(kind).itemsize * n)
    sfreq = 1e6 / float(common["SamplingInterval"])
    gain = [float(p[2]) if len(p) > 2 and p[2] else 1.0 for p in parts]
    layout = {"data": data, "kind": kind, "vectorised": common.get("DataOrientation", "MULTIPLEXED") == "VECTORIZED", "markers": common.get("MarkerFile")}
    return Header(path, [p[0].replace("\\1", ",") for p in parts], [sfreq] * n, gain, [0.0] * n, [samples] * n, layout)


def brainvision_markers(path: str) -> list[tuple[str, str, int, int, int]]:
    """(type, description, sample from 0, size, channel) of a marker file."""
    out = []
    for m in re.finditer(r"^Mk\d+=([^,\n]*),([^,\n]*),(\d+),(\d+),(\d+)", files.whole(path).decode("utf-8", "replace").replace("\r\n", "\n"), re.M):
        out.append((m[1], m[2].replace("\\1", ","), int(m[3]) - 1, int(m[4]), int(m[5])))
    return out


@dataclass
class Share(InputPartition):
    path: str
    k: int
    of: int  # shares of the file


class Reader(DataSourceReader):
    def __init__(self, path: str, ends: tuple[str, ...]):
        self.chs, self.low, self.high = None, 0, 1 << 62
        listed = files.sizes(path)
        if len(listed) == 1 and path in listed and path.endswith(".vhdr"):
            listed |= files.sizes(os.path.dirname(path) or ".")  # the data is beside
        stem = lambda p: os.path.splitext(os.path.basename(p))[0]
        named = [path] if path in listed else [p for p in listed if p.lower().endswith(ends)]
        total: dict[str, int] = {}
        for p, n in listed.items():
            total[stem(p)] = max(total.get(stem(p), 0), n)
        self.shares = [Share(p, k, of) for p in named for of in [max(1, -(-total[stem(p)] // SHARE))] for k in range(of)]

    def pushFilters(self, filters):  # noqa: N802
        """Equal ch and bounds of samp choose what is read; Spark still checks bounds of samp by row."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ch",) and self.chs is None:
                self.chs = {f.value}
                continue
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("samp",):
                self.low = max(self.low, f.value)
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("samp",):
                self.high = min(self.high, f.value)
            yield f

    def partitions(self):
        return self.shares

    def rows(self, h: Header, ch: int, first: int, x: np.ndarray):
        """Batches of values x from sample first on, between the bounds."""
        a, b = max(0, self.low - first), min(len(x), self.high + 1 - first)
        for at in range(a, b, BLOCK):
            part = x[at : min(at + BLOCK, b)]
            m = len(part)
            yield pa.RecordBatch.from_arrays([pa.repeat(os.path.basename(h.path), m), pa.array(np.full(m, ch, np.int32)), pa.repeat(h.names[ch], m), pa.array(np.arange(first + at, first + at + m)), pa.array(part * h.gain[ch] + h.offset[ch])], NAMES)


class EdfReader(Reader):
    def read(self, share: Share):
        h = edf_header(share.path)
        per, records = h.layout["per"], h.layout["records"]
        chs = [c for c in range(len(h.names)) if (self.chs is None or c in self.chs) and c not in h.layout["texts"] and per[c]]
        step = max(1, (1 << 22) // max(1, sum(per) * h.layout["width"]))
        with files.Ranged(share.path) as f:
            for a in range(records * share.k // share.of, records * (share.k + 1) // share.of, step):
                b = min(a + step, records * (share.k + 1) // share.of)
                wanted = [c for c in chs if a * per[c] <= self.high and b * per[c] > self.low]
                data = edf_records(h, f, a, b) if wanted else None
                for ch in wanted:
                    yield from self.rows(h, ch, a * per[ch], edf_values(h, data, ch))


class BrainVisionReader(Reader):
    def read(self, share: Share):
        h = brainvision_header(share.path)
        n_ch, n, kind = len(h.names), h.n[0], np.dtype(h.layout["kind"])
        chs = [c for c in range(n_ch) if self.chs is None or c in self.chs]
        low, high = max(self.low, n * share.k // share.of), min(self.high + 1, n * (share.k + 1) // share.of)
        with files.Ranged(h.layout["data"]) as f:
            for a in range(low, high if chs else low, BLOCK):
                m = min(BLOCK, high - a)
                get = lambda at, count: np.frombuffer(f.read(at * kind.itemsize, count * kind.itemsize), kind)
                whole = None if h.layout["vectorised"] else get(a * n_ch, m * n_ch).reshape(m, n_ch)
                for ch in chs:
                    yield from self.rows(h, ch, a, (get(ch * n + a, m) if whole is None else whole[:, ch]).astype(float))


class EdfSource(DataSource):
    @classmethod
    def name(cls):
        return "edf"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return EdfReader(self.options["path"], (".edf", ".bdf"))


class BrainVisionSource(DataSource):
    @classmethod
    def name(cls):
        return "brainvision"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BrainVisionReader(self.options["path"], (".vhdr",))


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (EdfSource, BrainVisionSource, fiff.FifSource, fiff.FifEpochsSource, fiff.FifEvokedSource):
        spark.dataSource.register(source)


def read_raw(spark, path: str):
    """A recording by its extension."""
    register(spark)
    kinds = {".edf": "edf", ".bdf": "edf", ".vhdr": "brainvision", ".fif": "fif"}
    kind = kinds.get(os.path.splitext(path)[1].lower())
    if kind:
        return spark.read.format(kind).load(files.qualified(spark, path))
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}")
