"""Kernels that need whole channels (transforms over all samples, scans with a threshold of the maximum),
distributed by their keys: a channel's samples become one sorted array row, and workers run the kernel on the
rows of an Arrow batch. Kernels of bounded reach are in blocks.py, where no row holds a channel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp


def arrays(df: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """keys, at, value: each channel's samples in order, as two arrays."""
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("at"), F.col("value").cast("double").alias("value")))).alias("x"))
    return rows.select(*keys, F.col("x.at").alias("at"), F.col("x.value").alias("value"))


def table_of(df: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], columns: str, keys: tuple[str, ...] = ("ch",), order: str = "samp", with_order: bool = False) -> DataFrame:
    """keys and the columns of a table that the kernel makes of the values in order."""
    rows = arrays(df, keys, order)
    kinds = dict(rows.dtypes)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, counts = [], []
            for at, values in zip(batch.column("at"), batch.column("value"), strict=True):
                x = values.values.to_numpy(zero_copy_only=False)
                made.append(kernel(at.values.to_numpy(zero_copy_only=False), x) if with_order else kernel(x))
                counts.append(len(next(iter(made[-1].values()))))
            again = pa.array(np.repeat(np.arange(len(made)), counts))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(again) for k in keys), *(pa.array(np.concatenate([np.asarray(m[n]) for m in made]) if made else []) for n in names)], [*keys, *names])

    return rows.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), columns]))


def per_channel(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], keys: tuple[str, ...] = ("ch",), order: str = "samp") -> DataFrame:
    """keys, order, value with value = kernel(values in order); the kernel may change the length."""

    def run(at: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        out = np.asarray(kernel(x), float)
        return {order: at if len(out) == len(x) else np.arange(len(out)) + at[0], "value": out}

    return table_of(df, run, f"{order} long, value double", keys, order, with_order=True)


def hilbert(df: DataFrame, **where) -> DataFrame:
    def kernel(x: np.ndarray) -> dict:
        z = dsp.hilbert(x)
        return {"i": np.arange(len(x)), "re": z.real, "im": z.imag, "envelope": np.abs(z)}

    return table_of(df, kernel, "i long, re double, im double, envelope double", **where)


def multitaper(df: DataFrame, sfreq: float, **where) -> DataFrame:
    def kernel(x: np.ndarray) -> dict:
        f, p = dsp.multitaper(x, sfreq)
        return {"freq": f, "power": p}

    return table_of(df, kernel, "freq double, power double", **where)


def events_of(df: DataFrame, find: Callable[[np.ndarray], np.ndarray], **where) -> DataFrame:
    """at: the positions that find returns, for each channel."""
    return table_of(df, lambda x: {"at": find(x)}, "at long", **where)
