"""Heart beats against a plain scan, across the borders of small blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurolattice.functions import dsp
from neurolattice.operators import beats, blocks


def scan(x, sfreq, fractions=beats.FRACTIONS, levels=2.5, tstart=0.0):
    """One sample after the other."""
    window, start, x = round(sfreq / 2), int(sfreq * tstart), np.abs(x)
    seconds = [x[start + int(sfreq) * i : start + int(sfreq) * (i + 1)] for i in range(3)]
    level = np.mean([s.max() for s in seconds if len(s)]) if len(x) > start else np.inf
    found = []
    for f in fractions:
        place, peaks, rms = start, [], []
        while place < len(x) - window:
            w = x[place : place + window]
            if w[0] > f * level:
                peaks.append(place + int(w.argmax()))
                rms.append(np.sqrt(np.mean(w * w)))
                place += window
            else:
                place += 1
        peaks = [p for p, r in zip(peaks, rms, strict=True) if r < np.mean(rms) + levels * np.std(rms)]
        if peaks:
            found.append(peaks)
    if not found:
        return []
    rates = np.array([60 * len(p) / (len(x) / sfreq) for p in found])
    fair = rates[(rates >= 40) & (rates <= 160)]
    return found[int(np.abs(rates - (np.median(fair) if len(fair) else 80)).argmin())]


def beat(rng, n, sfreq):
    x = rng.standard_normal(n) * 0.1
    for at in np.cumsum(rng.uniform(0.6, 1.1, int(n / sfreq)) * sfreq).astype(int):
        if at < n - 3:
            x[at : at + 3] += rng.uniform(0.8, 1.3) * np.array([0.4, 1.0, -0.5]) * rng.choice([1, 1, 1, 4])
    return x


def table(spark, channels, shift=0):
    return spark.createDataFrame([(k, shift + i, float(v)) for k, x in channels.items() for i, v in enumerate(x)], "ch int, samp long, value double")


@pytest.mark.parametrize("size,tstart", [(8, 0.0), (33, 2.5), (1 << 16, 0.0)])
def test_equals_plain_scan(spark, size, tstart):
    rng, sfreq = np.random.default_rng(size), 16.0
    channels = {0: beat(rng, 700, sfreq), 1: rng.standard_normal(500), 2: np.ones(300), 3: rng.standard_normal(30), 4: rng.uniform(0.9, 1.1, 400)}
    got = {}
    for r in beats.qrs_detector(table(spark, channels, 11), sfreq, tstart=tstart, size=size).collect():
        got.setdefault(r["ch"], []).append(r["samp"] - 11)
    want = {k: scan(x, sfreq, tstart=tstart) for k, x in channels.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_gaps_nulls_and_nothing(spark):
    rng, sfreq = np.random.default_rng(3), 16.0
    x = beat(rng, 600, sfreq)
    x[200:290] = 0
    df = table(spark, {0: x}).filter("samp < 200 OR samp >= 290")
    found = sorted(r["samp"] for r in beats.qrs_detector(df, sfreq, size=16).collect())
    assert found == scan(x, sfreq)
    named = df.withColumn("ch", F.lit(None).cast("int"))
    assert sorted(r["samp"] for r in beats.qrs_detector(named, sfreq, size=16).collect()) == found
    assert beats.qrs_detector(df.limit(0), sfreq).count() == 0
    assert beats.qrs_detector(table(spark, {0: np.zeros(200)}), sfreq).count() == 0
    with pytest.raises(ValueError):
        beats.qrs_detector(df, sfreq, size=4)


def test_finds_planted_beats(spark):
    rng, sfreq = np.random.default_rng(5), 100.0
    x, at = rng.standard_normal(6000) * 0.05 + np.sin(np.arange(6000) / 300), np.arange(60, 5900, 83)
    for a in at:
        x[a - 2 : a + 3] += [0.3, 0.8, 1.5, 0.8, 0.3]
    df = table(spark, {0: x})
    found = np.array(sorted(r["samp"] for r in beats.find_ecg_events(df, sfreq, size=1000).collect()))
    h = dsp.design_fir(sfreq, 5.0, 35.0)
    assert found.tolist() == scan(np.array([r["value"] for r in blocks.fir(df, np.convolve(h, h)).orderBy("samp").collect()]), sfreq)
    # all are beats; the strongest window of nearly equal ones may count as an outlier
    assert len(found) >= len(at) - 1 and np.abs(found[:, None] - at).min(1).max() <= 3


def test_ends_are_what_scans_reach():
    rng = np.random.default_rng(7)
    for n in (1, 5, 9, 40, 64):
        for window in (1, 4, 9):
            over = rng.random(n) < 0.2
            for entry, end in enumerate(beats.ends(over, window)):
                starts = beats.opened(over, window, entry)
                assert end == max(0, (starts[-1] + window if starts else entry) - n)
