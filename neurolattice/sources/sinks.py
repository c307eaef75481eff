"""Sinks: Parquet tables partitioned by recording, and EDF or BrainVision files of a recording. FIF is in fiff.py.

A file is written in pieces: rows are dealt to pieces of consecutive samples, sorted, and tasks write a buffer at a
time, so no task holds more than a buffer of all channels. EDF and BrainVision are one file, so one task then copies
the finished pieces behind the header, a few megabytes at a time; nothing goes through the driver.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files

COPY = 1 << 23


def save_raw(samples: DataFrame, path: str, split_rows: int = 50_000_000) -> None:
    """samples (rec, ch, samp, value), sorted within files so that scans prune by channel and sample."""
    samples.repartition("rec", "ch").sortWithinPartitions("rec", "ch", "samp").write.mode("errorifexists").option("maxRecordsPerFile", split_rows).partitionBy("rec").parquet(path)


def extent(samples: DataFrame, n_ch: int) -> tuple[int, int, int]:
    """First and last sample and the number of values; rows that no channel or sample can take are an error."""
    odd = F.expr(f"ch IS NULL OR ch < 0 OR ch >= {n_ch} OR samp IS NULL")
    found = samples.agg(F.min("samp").alias("low"), F.max("samp").alias("high"), F.count("*").alias("n"), F.count_if(odd).alias("odd")).first()
    if found["odd"]:
        raise ValueError(f"{found['odd']} rows without one of the {n_ch} channels or without a sample number")
    return (found["low"], found["high"], found["n"]) if found["n"] else (0, -1, 0)


def dealt(samples: DataFrame, low: int, per: int, parts: int) -> DataFrame:
    """part, samp, ch, value, each part whole and in order in one task; every part begins with a row of ch -1."""
    rows = samples.select(F.floor((F.col("samp") - low) / per).alias("part"), F.col("samp").cast("long"), F.col("ch").cast("int"), F.col("value").cast("double"))
    starts = samples.sparkSession.range(parts).select(F.col("id").alias("part"), (F.col("id") * per + low).alias("samp"), F.lit(-1).alias("ch"), F.lit(None).cast("double").alias("value"))
    return rows.unionByName(starts).repartition(parts, "part").sortWithinPartitions("part", "samp", "ch")


def buffers(batches: Iterator[pa.RecordBatch], low: int, buffer: int, n_ch: int) -> Iterator[tuple[int, int, np.ndarray | None]]:
    """(part, first sample, values by sample and channel) of every buffer that has rows, also across batches; what is
    missing is NaN, None stands for a part's first row alone. Parts have to end where buffers end."""

    def made(rows: list[np.ndarray]) -> tuple[int, int, np.ndarray | None]:
        part, samp, ch, value = rows
        start, real = low + int(samp[0] - low) // buffer * buffer, ch >= 0
        if not real.any():
            return int(part[0]), start, None
        at = (samp[real] - start) * n_ch + ch[real]
        if len(np.unique(at)) < len(at):
            raise ValueError(f"two values of one channel and sample, from sample {start} on")
        x = np.full((buffer, n_ch), np.nan)
        x.ravel()[at] = value[real]
        return int(part[0]), start, x

    held = None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        held = now if held is None else [np.concatenate(pair) for pair in zip(held, now, strict=True)]
        cuts = np.flatnonzero(np.diff((held[1] - low) // buffer) | np.diff(held[0])) + 1
        for a, b in zip([0, *cuts], cuts, strict=False):
            yield made([c[a:b] for c in held])
        held = [c[cuts[-1] if len(cuts) else 0 :] for c in held]
    if held is not None and len(held[0]):
        yield made(held)


def write_pieces(samples: DataFrame, path: str, head: bytes, n_ch: int, low: int, high: int, buffer: int, encode: Callable[[np.ndarray], bytes], whole_buffers: bool) -> None:
    """head and then the encoded buffers from sample low to high, written in pieces beside path. The last buffer ends
    with the last sample, or is a whole one whose rest is NaN."""
    per = max(1, (1 << 23) // (buffer * n_ch)) * buffer
    parts = -(-(high - low + 1) // per)
    piece = lambda k: f"{path}.pieces/{k}"

    def write(batches):
        from itertools import groupby

        for k, group in groupby(buffers(batches, low, buffer, n_ch), key=lambda b: b[0]):
            with files.appearing(piece(k)) as out:
                for _, start, x in group:
                    if x is not None:
                        out.write(encode(x if whole_buffers else x[: high + 1 - start]))
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int64())})

    def join(batches):
        for batch in batches:
            with files.appearing(path) as out:
                out.write(head)
                for k in range(parts):
                    system, inner = files.at(piece(k))
                    with system.open_input_stream(inner) as f:
                        while data := f.read(COPY):
                            out.write(data)
            yield batch

    system, inner = files.at(f"{path}.pieces")
    system.create_dir(inner, recursive=True)
    try:
        if parts:
            dealt(samples, low, per, parts).mapInArrow(write, "part long").agg(F.count("*")).first()
        samples.sparkSession.range(0, 1, 1, 1).mapInArrow(join, "id long").agg(F.count("*")).first()
    finally:
        system.delete_dir(inner)


def complete(samples: DataFrame, n_ch: int) -> tuple[int, int]:
    """First and last sample of samples that have every value of every channel between them, as these formats ask."""
    low, high, n = extent(samples, n_ch)
    if n != (high - low + 1) * n_ch:
        raise ValueError(f"{n} values for {high - low + 1} samples of {n_ch} channels; fill in or crop what is missing")
    return low, high


def export_brainvision(samples: DataFrame, path: str, sfreq: float, names: list[str], unit: str = "V") -> None:
    """samples (ch, samp, value) as path.vhdr, path.vmrk and path.eeg with 32-bit floats; unit is the values' unit. No
    samples give an empty data file; missing or repeated ones are an error."""
    path = files.qualified(samples.sparkSession, path)
    low, high = complete(samples, len(names))
    base = posixpath.basename(path)
    write_pieces(samples, f"{path}.eeg", b"", len(names), low, high, max(1, int(sfreq)), lambda x: x.astype("<f4").tobytes(), whole_buffers=False)
    chans = "\n".join(f"Ch{i + 1}={n.replace(',', chr(92) + '1')},,1,{unit}" for i, n in enumerate(names))
    texts = {
        "vhdr": f"Brain Vision Data Exchange Header File Version 1.0\n\n[Common Infos]\nCodepage=UTF-8\nDataFile={base}.eeg\nMarkerFile={base}.vmrk\nDataFormat=BINARY\nDataOrientation=MULTIPLEXED\nNumberOfChannels={len(names)}\nSamplingInterval={1e6 / sfreq:g}\n\n[Binary Infos]\nBinaryFormat=IEEE_FLOAT_32\n\n[Channel Infos]\n{chans}\n",
        "vmrk": f"Brain Vision Data Exchange Marker File, Version 1.0\n\n[Common Infos]\nDataFile={base}.eeg\n\n[Marker Infos]\n",
    }
    for end, text in texts.items():
        with files.appearing(f"{path}.{end}") as out:
            out.write(text.encode())


def bound(v: float) -> str:
    """A number of at most seven characters, not below v and close to it."""
    return next(s for d in range(6, 0, -1) if len(s := f"{v * (1 + 10.0 ** (1 - d)):.{d}g}") <= 7)


def export_edf(samples: DataFrame, path: str, sfreq: int, names: list[str], unit: str = "uV") -> None:
    """samples (ch, samp, value) as a 16-bit EDF file of one-second records; the last one is filled up with zeros. No
    samples give a file without records; missing or repeated ones are an error."""
    path, n = files.qualified(samples.sparkSession, path), len(names)
    low, high = complete(samples, n)
    records = -(-(high - low + 1) // sfreq)
    most = {r["ch"]: r["most"] for r in samples.groupBy("ch").agg(F.max(F.abs("value")).alias("most")).collect()}  # a row a channel
    tops = [bound(max(most.get(ch) or 0.0, 1e-9)) for ch in range(n)]
    step = np.array([float(t) for t in tops]) / 32767
    pad = lambda s, k: str(s)[:k].ljust(k).encode("latin-1")
    head = pad("0", 8) + pad("X X X X", 80) + pad("Startdate X X X X", 80) + pad("01.01.00", 8) + pad("00.00.00", 8) + pad(256 * (n + 1), 8) + pad("EDF+C", 44) + pad(records, 8) + pad(1, 8) + pad(n, 4)
    fields = [(names, 16), ([""] * n, 80), ([unit] * n, 8), ([f"-{t}" for t in tops], 8), (tops, 8), ([-32767] * n, 8), ([32767] * n, 8), ([""] * n, 80), ([sfreq] * n, 8), ([""] * n, 32)]
    head += b"".join(pad(v, k) for values, k in fields for v in values)
    write_pieces(samples, path, head, n, low, high, sfreq, lambda x: np.rint(np.nan_to_num(x) / step).astype("<i2").T.tobytes(), whole_buffers=True)
