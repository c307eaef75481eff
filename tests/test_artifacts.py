"""Gradient removal, muscle spans and event-matched filters, from their definitions."""

import numpy as np
import pytest

from neurolattice.functions import dsp
from neurolattice.operators import artifacts as A
from neurolattice.operators import blocks as B
from neurolattice.operators import kernels as K


def line_out(x):
    i = np.arange(x.shape[-1])
    return x - np.array([np.polyval(np.polyfit(i, r, 1), i) for r in x])


@pytest.mark.parametrize(("before", "after"), [(4, 4), (2, 0), (0, 3)])
def test_gradient(spark, before, after):
    rng = np.random.default_rng(1)
    n, length, starts = 200, 12, [7 + 13 * k for k in range(13)] + [180, 195]  # two that overlap, one cut short
    x = rng.standard_normal((3, n)).cumsum(1)
    want = x.copy()
    whole = [s for s in starts if s + length <= n]
    flat = [line_out(x[:, s : s + length]) for s in whole]
    for k, s in enumerate(whole):
        template = 0
        if k >= before and k + after < len(whole):
            template = (sum(flat[k - before : k]) + sum(flat[k + 1 : k + 1 + after])) / (before + after)
        want[:, s : s + length] = flat[k] - template
    df = spark.createDataFrame([(c, i, float(v)) for (c, i), v in np.ndenumerate(x)], "ch long, samp long, value double")
    triggers = spark.createDataFrame([(s,) for s in starts], "start long")
    got = np.zeros(x.shape)
    rows = A.remove_gradient(df, triggers, length, before, after).collect()
    for r in rows:
        got[r["ch"], r["samp"]] = r["value"]
    assert len(rows) == x.size and np.allclose(got, want)
    artifact = np.sin(np.arange(length))  # the same in all volumes: gone where there is a template
    y = np.zeros((1, n))
    for s in whole[:13]:
        y[0, s : s + length] += artifact
    out = A.remove_gradient(spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(y[0])], "ch long, samp long, value double"), triggers.filter("start < 180"), length).collect()
    assert max(abs(r["value"]) for r in out if whole[4] <= r["samp"] < whole[8]) < 1e-9


def spans(mask, least):
    """Good stretches shorter than least are bad, ends too; the bad stretches."""
    mask = mask.copy()
    edges = np.flatnonzero(np.diff(mask.astype(int))) + 1
    for part in np.split(np.arange(len(mask)), edges):
        if not mask[part[0]] and len(part) < least:
            mask[part] = True
    edges = np.flatnonzero(np.diff(mask.astype(int))) + 1
    return [(int(p[0]), int(p[-1]) + 1) for p in np.split(np.arange(len(mask)), edges) if mask[p[0]]]


def test_spans_by_hand(spark):
    """33 samples, bad ones at 3 and 30: stretches of 3 and 2 at the ends are short, the one of 26 is not."""
    rows = [(0, i, 9.0 if i in (3, 30) else 0.0) for i in range(33)]
    df = spark.createDataFrame(rows, "rec long, samp long, score double")
    assert sorted((r["start"], r["stop"]) for r in A.bad_spans(df, 1.0, 5).collect()) == [(0, 4), (30, 33)]
    assert sorted((r["start"], r["stop"]) for r in A.bad_spans(df, 1.0, 3).collect()) == [(3, 4), (30, 33)]  # strictly shorter
    assert sorted((r["start"], r["stop"]) for r in A.bad_spans(df, 1.0, 27).collect()) == [(0, 33)]


@pytest.mark.parametrize("least", [0, 1, 4, 9, 500])
def test_spans(spark, monkeypatch, least):
    monkeypatch.setattr(A, "RUN_BLOCK", 10)  # runs go on over blocks
    rng = np.random.default_rng(int(least))
    masks = {k: np.repeat(rng.random(40) < p, rng.integers(1, 9, 40)) for k, p in enumerate((0.5, 0.1, 0.9, 0.0))}
    df = spark.createDataFrame([(k, i, float(m)) for k, mask in masks.items() for i, m in enumerate(mask)], "rec long, samp long, score double")
    got = {}
    for r in A.bad_spans(df, 0.5, least).collect():
        got.setdefault(r["rec"], []).append((r["start"], r["stop"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: s for k, mask in masks.items() if (s := spans(mask, least))}
    assert A.bad_spans(df.limit(0), 0.5, least).count() == 0


def test_muscle(spark):
    """From the raw signal on: band, envelope, scores, smoothing, spans."""
    rng, sfreq, n = np.random.default_rng(3), 400.0, 2400
    t = np.arange(n) / sfreq
    x = rng.standard_normal((3, n))
    x[:, 1000:1300] += 6 * np.sin(2 * np.pi * 125 * t[1000:1300])
    df = spark.createDataFrame([(0, c, i, float(v)) for (c, i), v in np.ndenumerate(x)], "rec long, ch long, samp long, value double")
    band = B.filter_data(df, sfreq, 110.0, 140.0, keys=("rec", "ch"), block=500)
    envelope = K.hilbert(band, keys=("rec", "ch")).selectExpr("rec", "ch", "i AS samp", "envelope AS value")
    got = sorted((r["start"], r["stop"]) for r in A.annotate_muscle(envelope, sfreq, 3.0, 0.1, block=500).collect())
    env = np.stack([np.abs(dsp.hilbert(dsp.filter_data(r, sfreq, 110.0, 140.0))) for r in x])
    z = ((env - env.mean(1, keepdims=True)) / env.std(1, keepdims=True)).sum(0) / np.sqrt(3)
    assert got == spans(dsp.filter_data(z, sfreq, None, 4.0) > 3.0, 40)
    assert len(got) == 1 and abs(got[0][0] - 1000) < 60 and abs(got[0][1] - 1300) < 60


def test_ems(spark):
    """Two trials a condition, one channel pair, worked out by hand; then many, by leaving each trial out."""
    small = [(0, 1, [2.0, 0.0]), (1, 1, [4.0, 3.0]), (2, 2, [0.0, 0.0]), (3, 2, [0.0, 0.0])]
    df = spark.createDataFrame([(e, c, ch, 0, v) for e, c, vs in small for ch, v in enumerate(vs)], "epoch long, condition long, ch long, t long, value double")
    got = {r["epoch"]: r["value"] for r in A.ems(df, 1, 2, scale=False).collect()}
    # trial 0 sees (4, 3) / 5, trial 1 sees (2, 0) / 2
    assert np.allclose([got[0], got[1], got[2], got[3]], [2 * 0.8, 4.0, 0.0, 0.0])
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((14, 4, 3)), np.array([1] * 6 + [2] * 8)
    df = spark.createDataFrame([(e, int(y[e]), c, t, float(v)) for (e, c, t), v in np.ndenumerate(x)], "epoch long, condition long, ch long, t long, value double")
    got = {(r["epoch"], r["t"]): r["value"] for r in A.ems(df, 1, 2).collect()}
    filters = {(r["ch"], r["t"]): r["weight"] for r in A.ems_filters(df, 1, 2).collect()}
    z, found = x / x.std(), []
    for e in range(14):
        rest = np.arange(14) != e
        d = z[rest & (y == 1)].mean(0) - z[rest & (y == 2)].mean(0)
        d /= np.sqrt((d**2).sum(0))
        found.append(d)
        assert np.allclose([got[e, t] for t in range(3)], (z[e] * d).sum(0))
    assert all(abs(np.mean(found, 0)[k] - w) < 1e-9 for k, w in filters.items()) and len(filters) == 12
