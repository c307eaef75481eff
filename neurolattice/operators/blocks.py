"""Recordings of any length as blocks of samples.

A channel is many rows: a block's samples, with as many of its neighbours' (the halo) as a kernel looks at.
Each sample is sent once to the block it is in, and again only where it is in a halo, so one shuffle by
block serves any kernel of bounded reach, and no row holds more than a block and its halos. What a kernel
has to know of the whole channel is its first and last sample.

Overlap-add cuts recordings into overlapping windows of all channels, whose weights add to one, and
processes each window as a matrix. A task takes a piece of many windows at a time and adds them up itself.

Operators that change in time are tables of matrices at control points; every block meets the intervals
between control points that reach into it, and samples blend the two matrices at their interval's ends.

Samples are numbered; those that a channel lacks between its first and last count as 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsp

SIZE = 1 << 16


def bounds(df: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(order).cast("long").alias("first"), F.max(order).cast("long").alias("last"))


def blocks(df: DataFrame, left: int, right: int, keys: tuple[str, ...] = ("ch",), order: str = "samp", size: int = SIZE) -> DataFrame:
    """keys, block, first, last (of the channel), at, value (arrays in order): the samples from left before a block
    to right after it. Blocks start at multiples of size."""
    at = F.col(order).cast("long")
    own = df.select(*keys, at.alias("at"), F.col("value").cast("double").alias("value"), F.explode(F.sequence(F.floor((at - right) / size), F.floor((at + left) / size))).alias("block"))
    rows = own.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("x"))
    ends = bounds(df, keys, order).select(*(F.col(k).alias(f"_of_{k}") for k in keys), "first", "last")
    rows = rows.join(ends, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    # halos beyond the ends make no block
    rows = rows.filter((F.col("block") >= F.floor(F.col("first") / size)) & (F.col("block") <= F.floor(F.col("last") / size)))
    return rows.select(*keys, "block", "first", "last", F.col("x.at").alias("at"), F.col("x.value").alias("value"))


class Part:
    """A block's core, samples low to high (not included), of a channel from first to last, and x, which holds the
    samples from low - left to high + right: beyond the channel's ends zeros, or the odd reflection."""

    def __init__(self, at: np.ndarray, value: np.ndarray, first: int, last: int, block: int, size: int, left: int, right: int, reflect: bool):
        self.first, self.last = first, last
        self.low, self.high = max(first, block * size), min(last + 1, (block + 1) * size)
        a = self.low - left
        self.x = np.zeros(self.high + right - a)
        self.x[at[(at >= a) & (at < self.high + right)] - a] = value[(at >= a) & (at < self.high + right)]
        if reflect:
            for edge, way in ((first, -1), (last, 1)):
                place = np.arange(a, first) if way < 0 else np.arange(last + 1, self.high + right)
                mirror = 2 * edge - place
                inside = (mirror >= max(first, a)) & (mirror <= min(last, self.high + right - 1))
                if inside.any():
                    self.x[place[inside] - a] = 2 * self.x[edge - a] - self.x[mirror[inside] - a]


def over_blocks(df: DataFrame, kernel: Callable[[Part], dict[str, np.ndarray]], columns: str, left: int, right: int, reflect: bool = False, keys: tuple[str, ...] = ("ch",), order: str = "samp", block: int = SIZE) -> DataFrame:
    """keys and the columns that the kernel makes of each block."""
    rows = blocks(df, left, right, keys, order, block)
    kinds = dict(rows.dtypes)
    names = [c.split()[0] for c in columns.split(", ")]

    def joined(batch: pa.RecordBatch, of: list[int], made: list[dict]) -> pa.RecordBatch:
        again = pa.array(np.repeat(of, [len(m[names[0]]) for m in made]))
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(again) for k in keys), *(pa.array(np.concatenate([m[c] for m in made])) for c in names)], [*keys, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column("at").offsets.to_numpy()
            at, value = (batch.column(c).values.to_numpy(zero_copy_only=False) for c in ("at", "value"))
            first, last, number = (batch.column(c).to_numpy() for c in ("first", "last", "block"))
            of, made, size = [], [], 0
            for i in range(batch.num_rows):
                own = slice(ends[i], ends[i + 1])
                made.append(kernel(Part(at[own], value[own], int(first[i]), int(last[i]), int(number[i]), block, left, right, reflect)))
                of.append(i)
                size += len(made[-1][names[0]])
                if size > SIZE:
                    yield joined(batch, of, made)
                    of, made, size = [], [], 0
            if made:
                yield joined(batch, of, made)

    return rows.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), columns]))


def same_length(df: DataFrame, kernel: Callable[[Part], np.ndarray], left: int, right: int, reflect: bool = False, order: str = "samp", **where) -> DataFrame:
    """keys, order, value: the kernel gives one value for each sample of a block's core."""
    return over_blocks(df, lambda p: {order: np.arange(p.low, p.high), "value": kernel(p)}, f"{order} long, value double", left, right, reflect, order=order, **where)


def convolved(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places of the convolution where h is whole within x."""
    if len(h) < 64:
        return np.convolve(x, h, "valid")
    n = dsp.fft_length(len(x))
    if np.iscomplexobj(h):
        return np.fft.ifft(np.fft.fft(x, n) * np.fft.fft(h, n))[len(h) - 1 : len(x)]
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[len(h) - 1 : len(x)]


def fir(df: DataFrame, h: np.ndarray, **where) -> DataFrame:
    """Zero-phase filtering by odd, symmetric taps, with reflected ends."""
    half = (len(h) - 1) // 2
    return same_length(df, lambda p: p.x[half : len(p.x) - half] * h.sum() if p.first == p.last else convolved(p.x, h), half, half, True, **where)


def filter_data(df: DataFrame, sfreq: float, low: float | None, high: float | None, **where) -> DataFrame:
    return fir(df, dsp.design_fir(sfreq, low, high), **where)


def notch(df: DataFrame, sfreq: float, freqs: list[float], width: float | None = None, trans: float = 1.0, **where) -> DataFrame:
    """Band-stops at freqs, one filter made of all, so the blocks are made once."""
    h = np.ones(1)
    for f in freqs:
        half = (width or f / 200) / 2 + trans / 2
        h = np.convolve(h, dsp.design_fir(sfreq, f + half, max(f - half, 0.1), width=trans / 2))
    return fir(df, h, **where)


def iir(df: DataFrame, sfreq: float, low: float | None, high: float | None, order: int = 4, zero_phase: bool = True, column: str = "samp", **where) -> DataFrame:
    """Butterworth filtering, forward and backward. A block's halo is as long as the filter rings; ends are
    reflected as far as the one-shot filter does, with zeros beyond."""
    z, p, k = dsp.butterworth(order, sfreq, low, high)
    ring, reach = dsp.ringing(p), 3 * (2 * order + 1) * 10

    def kernel(part: Part) -> np.ndarray:
        a, n = part.low - ring, part.last - part.first + 1
        place = np.arange(a, a + len(part.x))
        y = np.where((place < part.first - min(n - 1, reach)) | (place > part.last + min(n - 1, reach)), 0, part.x)
        m = dsp.fft_length(len(y) + 2 * ring)
        w = np.exp(2j * np.pi * np.fft.rfftfreq(m))
        h = k * np.prod(w[:, None] - z, 1) / np.prod(w[:, None] - p, 1)
        return np.fft.irfft(np.fft.rfft(y, m) * (np.abs(h) ** 2 if zero_phase else h), m)[ring : ring + part.high - part.low]

    return same_length(df, kernel, ring, ring, True, order=column, **where)


def savgol(df: DataFrame, size: int, degree: int = 5, **where) -> DataFrame:
    """Savitzky-Golay smoothing; the ends follow the polynomials of the first and the last window."""
    half = size // 2
    basis = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    solve = np.linalg.pinv(basis)

    def kernel(p: Part) -> np.ndarray:
        core = p.x[size - 1 : size - 1 + p.high - p.low]
        if p.last - p.first + 1 < size:
            return core
        out = np.convolve(p.x, solve[0][::-1], "valid")[size - 1 - half :][: len(core)]
        at, a = np.arange(p.low, p.high), p.low - size + 1
        for edge, near in ((p.first, at < p.first + half), (p.last - size + 1, at > p.last - half)):
            if near.any():
                out[near] = (basis @ (solve @ p.x[edge - a : edge - a + size]))[at[near] - edge]
        return out

    return same_length(df, kernel, size - 1, size - 1, **where)


def cwt(df: DataFrame, waves: dict[float, np.ndarray], order: str = "samp", **where) -> DataFrame:
    """keys, freq, i, re, im: each channel's convolution with each wavelet, its middle on the sample."""
    most = max(map(len, waves.values()))
    left, right = most // 2 + 1, most // 2 + 1

    def kernel(p: Part) -> dict[str, np.ndarray]:
        out = []
        for w in waves.values():
            start = (len(w) - 1) // 2
            # sample i needs x from i + start - len(w) + 1 to i + start
            out.append(convolved(p.x[left + start - len(w) + 1 : left + p.high - p.low + start], w))
        at = np.arange(p.low, p.high) - p.first
        z = np.concatenate(out)
        return {"freq": np.repeat(list(waves), len(at)), "i": np.tile(at, len(waves)), "re": z.real, "im": z.imag}

    return over_blocks(df, kernel, "freq double, i long, re double, im double", left, right, order=order, **where)


def tfr_morlet(df: DataFrame, sfreq: float, freqs: list[float], n_cycles: float = 7.0, **where) -> DataFrame:
    return cwt(df, {f: dsp.morlet(sfreq, f, n_cycles) for f in freqs}, **where)


def welch(df: DataFrame, sfreq: float, n_fft: int = 256, overlap: int = 0, average: str = "mean", keys: tuple[str, ...] = ("ch",), **where) -> DataFrame:
    """keys, freq, power: segments lie where they start; their densities are averaged by a grouped aggregate."""

    def kernel(p: Part) -> dict[str, np.ndarray]:
        n = min(n_fft, p.last - p.first + 1)
        step = n - overlap if n > overlap else n
        starts = np.arange(p.first + -(-(p.low - p.first) // step) * step, min(p.high, p.last - n + 2), step)
        freq = np.fft.rfftfreq(n, 1 / sfreq)
        if not len(starts):
            return {"freq": np.zeros(0), "power": np.zeros(0)}
        seg = p.x[starts[:, None] - p.low + np.arange(n)]
        w = dsp.window("hamming", n, sym=False)
        power = np.abs(np.fft.rfft((seg - seg.mean(1, keepdims=True)) * w, axis=1)) ** 2 / (sfreq * (w * w).sum())
        power[:, 1 : -1 if n % 2 == 0 else None] *= 2
        return {"freq": np.tile(freq, len(starts)), "power": power.ravel()}

    each = over_blocks(df, kernel, "freq double, power double", 0, n_fft - 1, keys=keys, **where)
    if average == "mean":
        return each.groupBy(*keys, "freq").agg(F.avg("power").alias("power"))
    # the bias of a median of that many exponential values
    odd = F.floor((F.count("*") - 1) / 2)
    bias = F.lit(1.0) + F.when(odd > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(odd, F.lit(1))), F.lit(0.0), lambda a, k: a + 1 / (2 * k + 1) - 1 / (2 * k))).otherwise(0.0)
    return each.groupBy(*keys, "freq").agg((F.median("power") / bias).alias("power"))


def stft(df: DataFrame, size: int, step: int, **where) -> DataFrame:
    """keys, bin, step, re, im: sine windows that make a tight frame up to both ends; frame k starts at
    k * step - (size - step) / 2 of the channel."""
    if size % step or size % 4:
        raise ValueError("the window must be a multiple of the step and of 4")
    before = (size - step) // 2

    def kernel(p: Part) -> dict[str, np.ndarray]:
        frames = -(-(p.last - p.first + 1) // step)
        low = 0 if p.low == p.first else -(-(p.low - p.first) // step)
        own = np.arange(low, min(frames, -(-(p.high - p.first) // step)))
        w = frame_weights(size, step, frames, own)
        seg = p.x[(own * step - before + p.first - p.low + size)[:, None] + np.arange(size)]
        s = np.fft.rfft(seg * w[0] / np.sqrt(size * w[1]), axis=1)
        return {"bin": np.tile(np.arange(size // 2 + 1), len(own)), "step": np.repeat(own, size // 2 + 1), "re": s.real.ravel(), "im": s.imag.ravel()}

    return over_blocks(df, kernel, "bin long, step long, re double, im double", size, size + step, **where)


def frame_weights(size: int, step: int, frames: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sine window, and for frames own of so many the energy of all windows at each of their places."""
    w = np.sin(np.arange(0.5, size + 0.5) / size * np.pi)
    energy = np.zeros((len(own), size))
    for shift in range(-(size // step) + 1, size // step):
        there = ((own + shift >= 0) & (own + shift < frames))[:, None]
        at = np.arange(size) - shift * step
        inside = (at >= 0) & (at < size)
        energy += there * np.where(inside, w[np.clip(at, 0, size - 1)] ** 2, 0)
    return w, energy


def istft(spec: DataFrame, lengths: DataFrame, size: int, step: int, keys: tuple[str, ...] = ("ch",), order: str = "samp") -> DataFrame:
    """keys, order, value from keys, bin, step, re, im; lengths: keys, first, last. A frame is a row; frames add up
    by sample."""
    before = (size - step) // 2
    rows = spec.groupBy(*keys, "step").agg(F.sort_array(F.collect_list(F.struct("bin", "re", "im"))).alias("x")).join(lengths, list(keys))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten()
            z = (x.field("re").to_numpy() + 1j * x.field("im").to_numpy()).reshape(batch.num_rows, -1)
            k, first, last = (batch.column(c).to_numpy() for c in ("step", "first", "last"))
            w = [frame_weights(size, step, -(-(b - a + 1) // step), np.array([i])) for i, a, b in zip(k, first, last, strict=True)]
            parts = np.fft.irfft(z, size, axis=1) * w[0][0] * np.sqrt(size / np.concatenate([e for _, e in w]))
            at = (first + k * step - before)[:, None] + np.arange(size)
            inside = (at >= first[:, None]) & (at <= last[:, None])
            again = pa.array(np.nonzero(inside)[0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(again) for c in keys), pa.array(at[inside]), pa.array(parts[inside])], [*keys, order, "value"])

    parts = rows.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{order} long, value double"]))
    return parts.groupBy(*keys, order).agg(F.sum("value").alias("value"))


# --- overlap-add


def cola(size: int, step: int, window: str) -> np.ndarray:
    """The window, divided by what its shifts by step add to, which has to be the same everywhere."""
    w = dsp.window(window, size, sym=bool(size % 2)) if window != "boxcar" else np.ones(size)
    sums = np.zeros(step)
    np.add.at(sums, np.arange(size) % step, w)
    if np.abs(sums - np.median(sums)).max() > 1e-10:
        raise ValueError(f"windows of {size} at steps of {step} do not add to a constant")
    return w / np.median(sums)


def weights(w: np.ndarray, step: int, length: int, first: bool, last: bool) -> np.ndarray:
    """A window's weights; the first and the last one take over what windows beyond the ends would have."""
    if first and last:
        return np.ones(length)
    out = np.zeros(length)
    out[: len(w)] = w
    if last:
        for shift in range(step, length, step):
            part = w[: length - shift]
            out[shift : shift + len(part)] += part
    if first:
        for n in range(len(w) - step, 0, -step):
            out[:n] += w[-n:]
    return out


def overlap_add(df: DataFrame, process: Callable[[np.ndarray, list, int], np.ndarray], size: int, overlap: int, window: str = "hann", rec: str = "rec") -> DataFrame:
    """df: rec, ch, samp, value. rec, ch, samp, value with process(channels x samples, channels, start) applied to
    windows of size samples at steps of size - overlap and added up by their weights. The last window is longer by
    what is left over; recordings shorter than a window are one."""
    step = size - overlap
    w = cola(size, step, window)
    ends = bounds(df, (rec,), "samp")
    kinds = dict(df.dtypes)
    # a piece is some thousand samples; it makes all windows that reach into it, so pieces need not be added to each other
    core, back = step * max(8, 8192 // step), -(-size // step) - 1
    rows = df.select(rec, "ch", F.col("samp").cast("long").alias("samp"), F.col("value").cast("double").alias("value")).join(ends, rec)
    place, most = F.col("samp") - F.col("first"), F.floor((F.col("last") - F.col("first")) / core)
    # windows that reach over a border start up to size before it; those before it end up to size and a step behind it
    low, high = F.greatest(F.floor((place - size - 2 * step) / core), F.lit(0)), F.least(F.floor((place + size + 2 * step) / core), most)
    rows = rows.select("*", F.explode(F.sequence(low, high)).alias("piece"))

    def run(table: pa.Table) -> pa.Table:
        piece, first, last = (table[c][0].as_py() for c in ("piece", "first", "last"))
        final = max((last - first + 1 - size) // step, 0)
        a, z = first + piece * core, min(first + (piece + 1) * core, last + 1)
        windows = range(max(min(piece * core // step - back, final), 0), min((z - 1 - first) // step, final) + 1)
        table = table.combine_chunks()
        of = table["ch"].chunk(0).dictionary_encode()
        ch, at = of.indices.to_numpy(zero_copy_only=False), table["samp"].to_numpy() - first
        names = of.dictionary.take(pc.array_sort_indices(of.dictionary))
        ch = pc.index_in(of.dictionary, names).to_numpy(zero_copy_only=False)[ch]
        low = windows[0] * step
        high = max(last + 1 - first if windows[-1] == final else windows[-1] * step + size, z - first)
        inside = (at >= low) & (at < high)
        x, there = np.zeros((len(names), high - low)), np.zeros((len(names), high - low + 1), np.int64)
        x[ch[inside], at[inside] - low] = table["value"].to_numpy()[inside]
        there[ch[inside], at[inside] - low + 1] = 1
        there, out, made = there.cumsum(1), np.zeros_like(x), np.zeros(x.shape, bool)
        listed = np.array(names.to_pylist(), object)
        for k in windows:
            b = k * step - low
            e = high - low if k == final else b + size
            have = there[:, e] > there[:, b]  # the channels with samples in the window
            if have.any():
                out[have, b:e] += process(x[have, b:e], listed[have].tolist(), first + k * step) * weights(w, step, e - b, k == 0, k == final)
                made[have, b:e] = True
        row, col = np.nonzero(made[:, a - first - low : z - first - low])
        recs = table[rec].chunk(0).take(pa.array(np.zeros(len(row), np.int64)))
        return pa.table([recs, names.take(pa.array(row)), pa.array(col + a), pa.array(out[row, col + a - first - low])], [rec, "ch", "samp", "value"])

    return rows.groupBy(rec, "piece").applyInArrow(run, f"{rec} {kinds[rec]}, ch {kinds['ch']}, samp long, value double")


def leave_one_out(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Each good channel's part that lies in the span of the other good ones, and each other channel's part in the span
    of all good ones; means stay. From the Gram matrix of the channels, so no basis of the samples is made."""
    mean = x.mean(1, keepdims=True)
    x = x - mean
    size = np.linalg.norm(x, axis=1)
    unit = x / np.where(size > 0, size, 1)[:, None]
    gram = unit @ unit[good].T
    mixing = np.zeros((len(x), int(good.sum())))
    own = np.flatnonzero(good)

    def inverse(g: np.ndarray) -> np.ndarray:
        s, u = np.linalg.eigh(g)
        keep = s > np.finfo(float).eps * s[-1] if len(s) else np.zeros(0, bool)
        return (u[:, keep] / s[keep]) @ u[:, keep].T

    for k, i in enumerate(own):
        rest = np.arange(len(own)) != k
        if rest.any():
            mixing[i, rest] = gram[i, rest] @ inverse(gram[np.ix_(own[rest], rest)])
    if len(own) < len(x) and len(own):
        mixing[~good] = gram[~good] @ inverse(gram[own])
    return (mixing @ unit[good]) * size[:, None] + mean


def oversampled_temporal_projection(df: DataFrame, size: int, bads: tuple = (), rec: str = "rec") -> DataFrame:
    """df: rec, ch, samp, value. Noise that a channel has alone is taken out, in Hann windows of size samples that
    half overlap. size has to be at least the number of good channels less one."""

    def process(x: np.ndarray, ch: list, start: int) -> np.ndarray:
        good = np.array([c not in bads for c in ch])
        if x.shape[1] < good.sum() - 1:
            raise ValueError(f"{x.shape[1]} samples are too few for {good.sum()} channels")
        return leave_one_out(x, good)

    return overlap_add(df, process, size, size // 2, "hann", rec)


# --- operators that change in time


def blend(x: np.ndarray, start: int, spans: list[tuple], interp: str) -> np.ndarray:
    """x: channels x samples from start on. spans: (low, high, left, right), matrices outputs x channels at both ends
    of the interval from low to high (not included); right None: left holds."""
    out = np.zeros((spans[0][2].shape[0], x.shape[1]))
    for low, high, left, right in spans:
        a, b = max(low - start, 0), min(high - start, x.shape[1])
        if a >= b:
            continue
        part = x[:, a:b]
        if right is None or interp == "zero":
            out[:, a:b] = left @ part
            continue
        w = 1 - (np.arange(a, b) + start - low) / (high - low)
        if interp in ("hann", "cos2"):
            w = np.sin(np.pi / 2 * w) ** 2
        out[:, a:b] = (left @ part) * w + (right @ part) * (1 - w)
    return out


def mix_over_time(df: DataFrame, controls: DataFrame, interp: str = "hann", rec: str = "rec", block: int = SIZE) -> DataFrame:
    """df: rec, ch, samp, value; controls: rec, at, row, ch, weight (absent: 0): the matrix at sample at. rec, row,
    samp, value: between two control points a sample gets the blend of both matrices ("zero": the left one; "linear";
    "hann"); before the first and after the last one it gets theirs."""
    if interp not in ("zero", "linear", "hann", "cos2"):
        raise ValueError(f"unknown interpolation {interp}")
    kinds, far = dict(df.dtypes), 1 << 62
    ends = bounds(df, (rec,), "samp")
    points = controls.groupBy(rec, F.col("at").cast("long").alias("low")).agg(F.collect_list(F.struct("row", "ch", "weight")).alias("left"))
    w = Window.partitionBy(rec).orderBy("low")  # one row a control point
    points = points.select(rec, "low", "left", F.lead("low").over(w).alias("high"), F.lead("left").over(w).alias("right"), (F.row_number().over(w) == 1).alias("opens")).join(ends, rec)
    before = points.filter("opens AND first < low").select(rec, F.col("first").alias("low"), F.col("low").alias("high"), "left", F.lit(None).cast(dict(points.dtypes)["left"]).alias("right"), "first", "last")
    spans = points.select(rec, "low", F.coalesce("high", F.lit(far)).alias("high"), "left", "right", "first", "last").union(before)
    reach = F.sequence(F.floor(F.greatest("low", "first") / block), F.floor(F.least(F.col("high") - 1, F.col("last")) / block))
    spans = spans.filter("low <= last AND high > first").select(rec, F.explode(reach).alias("block"), F.struct("low", "high", "left", "right").alias("s")).groupBy(rec, "block").agg(F.array_sort(F.collect_list("s"), lambda a, b: F.when(a["low"] < b["low"], -1).otherwise(1)).alias("spans"))
    rows = df.groupBy(rec, F.floor(F.col("samp") / block).alias("block"), "ch").agg(F.collect_list(F.struct(F.col("samp").cast("long").alias("samp"), F.col("value").cast("double").alias("value"))).alias("x"))
    rows = rows.groupBy(rec, "block").agg(F.sort_array(F.collect_list(F.struct("ch", "x"))).alias("chans")).join(spans, [rec, "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chans, pieces = batch.column("chans")[i].values, batch.column("spans")[i].as_py()
                names = chans.field("ch").to_pylist()
                of = {c: k for k, c in enumerate(names)}
                outs = sorted({m["row"] for s in pieces for side in (s["left"], s["right"]) for m in side or ()})
                at = {r: k for k, r in enumerate(outs)}

                def matrix(entries: list[dict] | None, of=of, at=at) -> np.ndarray | None:
                    if entries is None:
                        return None
                    m = np.zeros((len(at), len(of)))
                    for e in entries:
                        if e["ch"] in of:
                            m[at[e["row"]], of[e["ch"]]] = e["weight"]
                    return m

                lists = chans.field("x")
                row = np.repeat(np.arange(len(names)), np.diff(lists.offsets.to_numpy()))
                samp, value = (lists.flatten().field(c).to_numpy() for c in ("samp", "value"))
                start = int(samp.min())
                x = np.zeros((len(names), int(samp.max()) - start + 1))
                x[row, samp - start] = value
                y = blend(x, start, [(s["low"], s["high"], matrix(s["left"]), matrix(s["right"])) for s in pieces], interp)
                n = y.size
                yield pa.RecordBatch.from_arrays([batch.column(rec).take(pa.array(np.full(n, i))), pa.array(np.repeat(outs, y.shape[1])), pa.array(np.tile(np.arange(start, start + y.shape[1]), len(outs))), pa.array(y.ravel())], [rec, "row", "samp", "value"])

    return rows.mapInArrow(run, f"{rec} {kinds[rec]}, row long, samp long, value double")


# --- resampling and two clocks


def resample_taps(up: int, down: int, reach: int = 10) -> np.ndarray:
    """Odd, symmetric low-pass taps (Kaiser, beta 5) for resampling by up / down."""
    most = max(up, down)
    half = reach * most
    t = np.arange(-half, half + 1)
    h = np.sinc(t / most) / most * np.kaiser(2 * half + 1, 5.0)
    return h / h.sum() * up


def resample_poly(df: DataFrame, up: int, down: int, order: str = "samp", **where) -> DataFrame:
    """keys, order, value: a channel's samples, counted from its first one as 0, resampled by up / down. An output
    sample is a sum over the taps of its phase; the phases run on over blocks, as they come from its number."""
    ratio = Fraction(up, down)
    up, down = ratio.numerator, ratio.denominator
    h = resample_taps(up, down)
    half = (len(h) - 1) // 2
    reach = half // up + 2

    def kernel(p: Part) -> dict[str, np.ndarray]:
        n = p.last - p.first + 1
        low, high = p.low - p.first, p.high - p.first
        # output k lies at k * down / up; those within the core belong to it
        k = np.arange(-(-low * up // down), min(-(-high * up // down), -(-n * up // down)))
        base, phase = np.divmod(k * down + half, up)  # the newest sample that reaches output k, and its tap
        out = np.zeros(len(k))
        for j in range(0, len(h) // up + 1):
            tap, i = phase + j * up, base - j
            use = (tap < len(h)) & (i >= 0) & (i < n)
            out[use] += h[tap[use]] * p.x[i[use] - low + reach]
        return {order: k, "value": out}

    return over_blocks(df, kernel, f"{order} long, value double", reach, reach, order=order, **where)


def clock_fit(pairs: DataFrame) -> tuple[float, float]:
    """(intercept, slope) of the line from times of the other clock (x) to ours (y): one aggregate."""
    r = pairs.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("y", "x").alias("r"), F.count("*").alias("n")).first()
    if r["n"] < 2 or r["slope"] is None:
        raise ValueError("two clocks are compared at two times at least")
    return r["intercept"], r["slope"]


def realign(df: DataFrame, other: DataFrame, pairs: DataFrame, sfreq: float, most: int = 1_000, keys: tuple[str, ...] = ("ch",), order: str = "samp", **where) -> tuple[DataFrame, DataFrame]:
    """Two recordings at sfreq, each with samples from 0 on; pairs: y, x, the times in seconds of the same events in df
    and in other. The one that begins earlier is cropped, other is resampled by the slope (the nearest fraction with
    a denominator up to most), and both end together. (df, other), samples again from 0 on."""
    start, slope = clock_fit(pairs)
    cut = int(round(abs(start) * sfreq))
    if start > 0:
        df = shifted(df, cut, order)
    elif start < 0:
        other = shifted(other, int(round(-start / slope * sfreq)), order)
    ratio = Fraction(slope).limit_denominator(most)
    if ratio != 1:
        other = resample_poly(other, ratio.numerator, ratio.denominator, order=order, keys=keys, **where)
    ends = df.agg(F.max(order).alias("a")).crossJoin(other.agg(F.max(order).alias("b"))).select(F.least("a", "b").alias("end"))  # one row
    return tuple(x.crossJoin(F.broadcast(ends)).filter(F.col(order) <= F.col("end")).drop("end") for x in (df, other))


def shifted(df: DataFrame, by: int, order: str) -> DataFrame:
    return df.filter(F.col(order) >= by).withColumn(order, F.col(order) - by)
