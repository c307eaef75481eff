"""Streams of samples: our extension. Fixed-length windows, sessions and onsets with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def fixed_windows(stream: DataFrame, late: str, length: str, slide: str | None = None) -> DataFrame:
    """window, ch, n, mean of (ts, ch, value); rows later than the watermark are dropped."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(window, "ch").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(stream: DataFrame, late: str, gap: str) -> DataFrame:
    """Activity of a channel with no pause of gap."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "ch").agg(F.count("*").alias("n"))


def onsets(stream: DataFrame) -> DataFrame:
    """ch, samp, prev_id, id at each rise of a trigger channel (ch, samp, code). The state of a channel
    is its last sample and code; a sample number at or before the last one is late and is dropped."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, code = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).sort_values("samp")
        out = []
        for samp, new in zip(rows["samp"], rows["code"], strict=True):
            if samp <= last:
                continue
            if last >= 0 and new > code:
                out.append((key[0], samp, code, new))
            last, code = samp, new
        state.update((int(last), int(code)))
        yield pd.DataFrame(out, columns=["ch", "samp", "prev_id", "id"])

    return stream.groupBy("ch").applyInPandasWithState(run, "ch long, samp long, prev_id long, id long", "last long, code long", "append", GroupStateTimeout.NoTimeout)
