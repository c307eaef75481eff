"""Heart beats: windows that open where a filtered channel crosses a threshold, and the threshold that suits best.

A window opens at the first crossing at or after the end of the window before, so where windows open depends on all
that goes before. Blocks are therefore read twice. First each block says, for every place in it where the window
before may end (fewer than a window's length), where its own last window ends in the next block; a channel's blocks
are then composed from such lists alone. In the second reading every block knows where it begins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from . import blocks as B
from .lineage import cut

#: Fractions of the first seconds' maxima that are tried, beats a minute that are plausible.
FRACTIONS = tuple(round(0.3 + 0.05 * k, 2) for k in range(16))
RATES, USUAL = (40.0, 160.0), 80.0


def crossings(over: np.ndarray) -> np.ndarray:
    """For each place the first crossing at or after it, or the length."""
    n = len(over)
    return np.minimum.accumulate(np.where(over, np.arange(n), n)[::-1])[::-1]


def ends(over: np.ndarray, window: int) -> np.ndarray:
    """For each first free place from 0 to window - 1 the first free place behind the last window, counted from the end."""
    n, following = len(over), crossings(over)
    go = np.zeros(n + 2 * window, np.int32)
    go[n:] = np.arange(2 * window)
    for a in range((n - 1) // window * window, -1, -window):  # what a place leads to is at least a window on
        nearest = following[a : min(a + window, n)]
        go[a : min(a + window, n)] = np.where(nearest < n, go[np.minimum(nearest, n - 1) + window], 0)
    return go[:window]


def opened(over: np.ndarray, window: int, entry: int) -> list[int]:
    following, out, place = crossings(over), [], entry
    while place < len(over) and following[place] < len(over):
        out.append(int(following[place]))
        place = out[-1] + window
    return out


def candidates(df: DataFrame, sfreq: float, fractions: tuple[float, ...] = FRACTIONS, tstart: float = 0.0, keys: tuple[str, ...] = ("ch",), size: int = B.SIZE) -> DataFrame:
    """keys, k, n, samp, rms: for the k-th threshold the largest deviation in each window of half a second, and the
    window's root mean square; n is the channel's length. Windows that would reach over the end do not open."""
    window, start, second = round(60 * sfreq / 120), int(sfreq * tstart), int(sfreq)
    if not 0 < window <= size:
        raise ValueError("a block has to hold a window")
    rows = cut(B.blocks(df.withColumn("value", F.abs("value")), 0, window, keys, "samp", size))
    kinds = dict(rows.dtypes)
    own = {k: kinds[k] for k in keys}
    # a block's samples without its halo, of the channel's first three seconds
    early = rows.filter(F.element_at("at", 1) < F.col("first") + start + 3 * second).select(*keys, "first", F.explode(F.arrays_zip("at", "value")).alias("s"))
    place = F.floor((F.col("s.at") - F.col("first") - start) / second)
    level = early.select(*keys, place.alias("place"), F.col("s.value").alias("value")).filter("place BETWEEN 0 AND 2").groupBy(*keys, "place").agg(F.max("value").alias("value")).groupBy(*keys).agg(F.avg("value").alias("level"))
    rows = rows.join(level.select(*(F.col(k).alias(f"_{k}") for k in keys), "level"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*(f"_{k}" for k in keys))

    def each(batch):
        """Row, samples, place of the first, and for each threshold where it is exceeded."""
        offsets, at, value = batch.column("at").offsets.to_numpy(), batch.column("at").values.to_numpy(), batch.column("value").values.to_numpy(zero_copy_only=False)
        first, last, block, level = (batch.column(c).to_numpy() for c in ("first", "last", "block", "level"))
        for i in range(batch.num_rows):
            rows = slice(offsets[i], offsets[i + 1])
            part = B.Part(at[rows], value[rows], int(first[i]), int(last[i]), int(block[i]), size, 0, window, False)
            places = np.arange(part.low, part.high)
            may = (places >= part.first + start) & (places < part.last + 1 - window)
            yield i, part, [(part.x[: len(places)] > f * level[i]) & may for f in fractions]

    def table(batch, of, columns):
        again = pa.array(of, pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(again) for k in [*keys, "block"]), *columns.values()], [*keys, "block", *columns])

    def transduce(batches):
        for batch in batches:
            for i, _, overs in each(batch):
                made = [ends(over, window) for over in overs]
                yield table(batch, [i] * len(made), {"k": pa.array(range(len(made)), pa.int32()), "ends": pa.array([m.tolist() for m in made], pa.list_(pa.int32()))})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, entries, free, before = pdf.sort_values("block"), [], 0, None
        for block, table in zip(pdf["block"], pdf["ends"], strict=True):
            free = free if before == block - 1 else 0  # a block without samples has no crossings
            entries.append(free)
            free, before = int(table[free]), block
        return pdf.assign(entry=np.array(entries, np.int32))[[*keys, "block", "k", "entry"]]

    key = ", ".join(f"{k} {t}" for k, t in own.items())
    told = rows.mapInArrow(transduce, f"{key}, block long, k int, ends array<int>")
    entries = told.groupBy(*keys, "k").applyInPandas(compose, f"{key}, block long, k int, entry int")
    entries = entries.groupBy(*(F.col(k).alias(f"_{k}") for k in keys), F.col("block").alias("_block")).agg(F.sort_array(F.collect_list(F.struct("k", "entry"))).alias("entries"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("block") == F.col("_block")]

    def emit(batches):
        for batch in batches:
            starts = batch.column("entries").to_pylist()
            for i, part, overs in each(batch):
                out = {"k": [], "n": [], "samp": [], "rms": []}
                for k, over in enumerate(overs):
                    for a in opened(over, window, starts[i][k]["entry"]):
                        x = part.x[a : a + window]
                        for name, v in zip(out, (k, part.last - part.first + 1, part.low + a + int(x.argmax()), float(np.sqrt(np.mean(x * x)))), strict=True):
                            out[name].append(v)
                kinds = {"k": pa.int32(), "n": pa.int64(), "samp": pa.int64(), "rms": pa.float64()}
                yield table(batch, [i] * len(out["k"]), {c: pa.array(v, kinds[c]) for c, v in out.items()})

    return rows.join(entries, on).select(*rows.columns, "entries").mapInArrow(emit, f"{key}, block long, k int, n long, samp long, rms double").drop("block")


def qrs_detector(df: DataFrame, sfreq: float, fractions: tuple[float, ...] = FRACTIONS, levels: float = 2.5, tstart: float = 0.0, keys: tuple[str, ...] = ("ch",), size: int = B.SIZE) -> DataFrame:
    """keys, samp: the beats of filtered channels (keys, samp, value). A window whose root mean square is not below the
    mean by levels deviations more is none. Of several thresholds the one counts whose rate is nearest to the median of
    the plausible rates, of equal ones (to a millionth) the lowest. Channels without any beat give no rows. Windows count from a crossing,
    so a limit to further crossings in them would never exclude any, and there is none."""
    found = candidates(df, sfreq, fractions, tstart, keys, size)
    kept = cut(found)
    stats = kept.groupBy(*keys, "k").agg((F.avg("rms") + levels * F.stddev_pop("rms")).alias("bound"))
    mine = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    beats = kept.alias("a").join(stats.alias("b"), [*mine, F.col("a.k") == F.col("b.k")]).filter("a.rms < b.bound").select("a.*")
    rates = beats.groupBy(*keys, "k").agg((60 * F.count("*") / (F.first("n") / sfreq)).alias("rate"))
    plausible = F.median(F.when(F.col("rate").between(*RATES), F.col("rate")))
    ideal = rates.groupBy(*keys).agg(F.coalesce(plausible, F.lit(USUAL)).alias("ideal"))
    # a median between two rates is as far from both but for the last digits, so a difference of so little is none
    far = F.abs(F.col("a.rate") - F.col("b.ideal")) * 1e6 + F.col("a.k")
    best = rates.alias("a").join(ideal.alias("b"), mine).groupBy(*(F.col(f"a.{k}") for k in keys)).agg(F.min_by("a.k", far).alias("k"))
    return beats.alias("a").join(best.alias("b"), [*mine, F.col("a.k") == F.col("b.k")]).select(*(F.col(f"a.{k}") for k in keys), "a.samp")


def find_ecg_events(df: DataFrame, sfreq: float, low: float = 5.0, high: float = 35.0, fractions: tuple[float, ...] = FRACTIONS, **where) -> DataFrame:
    """The beats of raw channels, filtered forward and backward."""
    h = dsp.design_fir(sfreq, low, high)
    return qrs_detector(B.fir(df, np.convolve(h, h)), sfreq, fractions, **where)
