"""Kernels over blocks with halos equal their one-shot forms, however the blocks fall."""

import math

import numpy as np
import pytest

from neurolattice.functions import dsp
from neurolattice.operators import blocks as B

LENGTHS = (1, 2, 5, 17, 40, 133)


@pytest.fixture(scope="module")
def channels():
    rng = np.random.default_rng(4)
    return {k: np.cumsum(rng.standard_normal(n)) for k, n in enumerate(LENGTHS)}


@pytest.fixture(scope="module")
def table(spark, channels):
    first = {k: 3 * k for k in channels}  # channels begin at different samples
    rows = [(k, first[k] + i, float(v)) for k, x in channels.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "ch long, samp long, value double").repartition(3).persist()


def values(df, of="value"):
    out = {}
    for r in df.orderBy("ch", "samp").collect():
        out.setdefault(r["ch"], []).append(r[of])
    return {k: np.array(v) for k, v in out.items()}


def check(got, channels, kernel):
    for k, x in channels.items():
        want = kernel(x)
        assert got[k].shape == want.shape and np.allclose(got[k], want, atol=1e-8 * max(1, np.abs(want).max())), (k, len(x))


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_fir(table, channels, size):
    for h in (np.array([0.25, 0.5, 0.25]), dsp.design_fir(100.0, 10.0, 30.0), np.ones(1)):
        check(values(B.fir(table, h, block=size)), channels, lambda x, h=h: dsp.fir(x, h))
    check(values(B.notch(table, 100.0, [25.0], 2.0, 8.0, block=size)), channels, lambda x: dsp.notch(x, 100.0, [25.0], 2.0, 8.0) if len(x) > 1 else x)


def test_notch_of_several(table, channels):
    """Several bands are one filter, so ends are reflected once, not once a band."""
    h = [dsp.design_fir(100.0, f + 5, f - 5, width=4.0) for f in (20.0, 40.0)]
    check(values(B.notch(table, 100.0, [20.0, 40.0], 2.0, 8.0, block=50)), channels, lambda x: dsp.fir(x, np.convolve(*h)))


@pytest.mark.parametrize("size", [7, 64])
def test_iir(table, channels, size):
    for low, high in ((1.0, 20.0), (None, 30.0), (5.0, None)):
        check(values(B.iir(table, 100.0, low, high, block=size)), {k: x for k, x in channels.items() if len(x) > 3}, lambda x, low=low, high=high: dsp.iir(x, 100.0, low, high))


@pytest.mark.parametrize("size", [5, 16, 1000])
def test_savgol(table, channels, size):
    check(values(B.savgol(table, 11, block=size)), channels, lambda x: dsp.savgol(x, 11))


@pytest.mark.parametrize("size", [6, 1000])
def test_cwt(table, channels, size):
    waves = {f: dsp.morlet(100.0, f, 3.0) for f in (10.0, 35.0)}
    got = {(r["ch"], r["freq"], r["i"]): complex(r["re"], r["im"]) for r in B.cwt(table, waves, block=size).collect()}
    assert len(got) == 2 * sum(LENGTHS)
    for k, x in channels.items():
        for f, w in waves.items():
            assert np.allclose([got[k, f, i] for i in range(len(x))], dsp.cwt(x, w), atol=1e-9)


@pytest.mark.parametrize("size", [5, 16, 1000])
def test_welch(table, channels, size):
    for overlap, average in ((0, "mean"), (8, "mean"), (12, "median")):
        got = {}
        for r in B.welch(table, 100.0, 16, overlap, average, block=size).orderBy("ch", "freq").collect():
            got.setdefault(r["ch"], []).append(r["power"])
        for k, x in channels.items():
            if len(x) > overlap:
                assert np.allclose(got[k], dsp.welch(x, 100.0, 16, overlap, average)[1], atol=1e-9), (k, overlap)


@pytest.mark.parametrize("size", [5, 16, 1000])
def test_stft_and_back(table, channels, size):
    spec = B.stft(table, 16, 8, block=size)
    got = {(r["ch"], r["bin"], r["step"]): complex(r["re"], r["im"]) for r in spec.collect()}
    for k, x in channels.items():
        want = dsp.stft(x, 16, 8)
        assert sum(c == k for c, *_ in got) == want.size and all(abs(got[k, b, s] - v) < 1e-9 for (b, s), v in np.ndenumerate(want))
    check(values(B.istft(spec, B.bounds(table, ("ch",), "samp"), 16, 8)), channels, lambda x: x)


def test_gaps_are_zeros_and_empty(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 4, 1.0)], "ch long, samp long, value double")
    assert np.allclose(values(B.fir(df, np.array([0.25, 0.5, 0.25]), block=2))[0], dsp.fir(np.array([1.0, 0, 0, 0, 1.0]), np.array([0.25, 0.5, 0.25])))
    assert B.fir(df.limit(0), np.ones(3) / 3).count() == 0 == B.stft(df.limit(0), 8, 4).count()


def test_no_row_holds_a_channel(spark):
    """Rows are bounded by a block and its halos, and each sample goes to its block and to halos only."""
    df = spark.range(10_000).selectExpr("0L AS ch", "id AS samp", "CAST(id AS double) AS value")
    rows = B.blocks(df, 10, 20, size=500).selectExpr("size(at) AS n").collect()
    assert len(rows) == 20 and max(r["n"] for r in rows) == 530 and sum(r["n"] for r in rows) == 10_000 + 19 * 30


# --- overlap-add


@pytest.fixture(scope="module")
def recordings():
    rng = np.random.default_rng(6)
    return {0: rng.standard_normal((3, 27)), 1: rng.standard_normal((4, 40)), 2: rng.standard_normal((2, 6))}


@pytest.fixture(scope="module")
def recorded(spark, recordings):
    return spark.createDataFrame([(r, c, 5 * r + i, float(v)) for r, x in recordings.items() for (c, i), v in np.ndenumerate(x)], "rec long, ch long, samp long, value double").repartition(4).persist()


def matrices(df, row="ch"):
    out = {}
    for r in df.orderBy("rec", row, "samp").collect():
        out.setdefault(r["rec"], {}).setdefault(r[row], []).append(r["value"])
    return {k: np.array(list(v.values())) for k, v in out.items()}


def one_shot(x, process, size, overlap, window):
    """Windows one after the other over a whole recording, their weights from all shifts of the window."""
    step, n = size - overlap, x.shape[1]
    if n < size:
        return process(x)
    w = dsp.window(window, size, sym=bool(size % 2)) if window != "boxcar" else np.ones(size)
    starts = list(range(0, n - size + 1, step))
    at = np.arange(-10 * size, n + 10 * size)
    total = sum(np.interp(at - s, np.arange(size), w, left=0, right=0) for s in range(-8 * size // step * step, n + 8 * size, step))
    share = {s: np.zeros(len(at)) for s in starts}
    for s in range(-8 * size // step * step, n + 8 * size, step):
        share[min(max(s, 0), starts[-1])] += np.interp(at - s, np.arange(size), w, left=0, right=0) / np.median(total)
    out = np.zeros(x.shape)
    for s in starts:
        stop = n if s == starts[-1] else s + size
        out[:, s:stop] += process(x[:, s:stop]) * share[s][10 * size :][s:stop]
    return out


@pytest.mark.parametrize(("size", "overlap", "window"), [(10, 5, "hann"), (10, 5, "boxcar"), (12, 9, "hann"), (10, 0, "boxcar"), (7, 0, "boxcar"), (40, 20, "hann")])
def test_overlap_add(recorded, recordings, size, overlap, window):
    def process(x, ch=None, start=0):
        return np.cumsum(x, 1) + x[::-1]

    got = matrices(B.overlap_add(recorded, process, size, overlap, window))
    for k, x in recordings.items():
        assert np.allclose(got[k], one_shot(x, process, size, overlap, window)), k
    same = matrices(B.overlap_add(recorded, lambda x, ch, start: x, size, overlap, window))
    assert all(np.allclose(same[k], x) for k, x in recordings.items())


def test_windows_have_to_add_up():
    with pytest.raises(ValueError, match="constant"):
        B.cola(10, 7, "hann")


def projected(x, bads):
    """The definition, with bases of the samples by singular values."""
    out = x.copy()
    mean = x.mean(1, keepdims=True)
    y = x - mean
    for i in range(len(x)):
        others = [k for k in range(len(x)) if k != i and k not in bads]
        rows = y[others]
        rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
        _, s, v = np.linalg.svd(rows, full_matrices=False)
        v = v[s**2 > np.finfo(float).eps * s[0] ** 2] if len(s) else v
        out[i] = y[i] @ v.T @ v + mean[i]
    return out


@pytest.mark.parametrize("bads", [(), (1,)])
def test_otp(spark, bads):
    rng = np.random.default_rng(9)
    t = np.arange(90) / 10
    fields = np.stack([np.sin(t), np.cos(0.7 * t)])
    x = rng.standard_normal((6, 2)) @ fields + 0.05 * rng.standard_normal((6, 90))
    df = spark.createDataFrame([(0, c, i, float(v)) for (c, i), v in np.ndenumerate(x)], "rec long, ch long, samp long, value double")
    got = matrices(B.oversampled_temporal_projection(df, 20, bads))[0]
    assert np.allclose(got, one_shot(x, lambda y: projected(y, bads), 20, 10, "hann"), atol=1e-9)
    clean = rng.standard_normal((6, 2)) @ fields
    lone = clean.copy()
    lone[2] += rng.standard_normal(90)  # noise of one channel alone goes
    df = spark.createDataFrame([(0, c, i, float(v)) for (c, i), v in np.ndenumerate(lone)], "rec long, ch long, samp long, value double")
    fixed = matrices(B.oversampled_temporal_projection(df, 30))[0]
    assert np.linalg.norm(fixed[2] - clean[2]) < 0.5 * np.linalg.norm(lone[2] - clean[2])


def test_leave_one_out_of_few():
    x = np.random.default_rng(1).standard_normal((1, 9))
    assert np.allclose(B.leave_one_out(x, np.array([True])), x.mean())
    assert np.allclose(B.leave_one_out(np.zeros((3, 5)), np.array([True] * 3)), 0)


@pytest.mark.parametrize("interp", ["zero", "linear", "hann"])
@pytest.mark.parametrize("size", [4, 1000])
def test_mix_over_time(spark, recorded, recordings, interp, size):
    rng = np.random.default_rng(3)
    points = {0: [2, 9, 10, 26], 1: [0, 60], 2: [100]}
    held = {r: {p: rng.standard_normal((2, len(recordings[r]))) for p in ps} for r, ps in points.items()}
    controls = spark.createDataFrame([(r, p, o, c, float(v)) for r, ps in held.items() for p, m in ps.items() for (o, c), v in np.ndenumerate(m)], "rec long, at long, row long, ch long, weight double")
    got = matrices(B.mix_over_time(recorded, controls, interp, block=size), "row")
    for r, x in recordings.items():
        ps, want = sorted(held[r]), np.zeros((2, x.shape[1]))
        for i in range(x.shape[1]):
            s = 5 * r + i
            a, b = max([p for p in ps if p <= s], default=ps[0]), min([p for p in ps if p > s], default=None)
            if b is None or s < ps[0]:
                m = held[r][a]
            else:
                far = (s - a) / (b - a)
                w = {"zero": 1, "linear": 1 - far, "hann": math.cos(math.pi / 2 * far) ** 2}[interp]
                m = w * held[r][a] + (1 - w) * held[r][b]
            want[:, i] = m @ x[:, i]
        assert np.allclose(got[r], want), r


# --- resampling and clocks


def polyphase(x, up, down):
    h = B.resample_taps(up, down)
    half = (len(h) - 1) // 2
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    full = np.convolve(wide, h)[half:]
    return full[: -(-len(x) * up // down) * down : down]


@pytest.mark.parametrize("size", [7, 1000])
@pytest.mark.parametrize(("up", "down"), [(1, 2), (3, 2), (2, 3), (1, 1), (999, 1000)])
def test_resample_poly(table, channels, up, down, size):
    check(values(B.resample_poly(table, up, down, block=size)), channels, lambda x: polyphase(x, up, down))


def test_realign(spark):
    sfreq, drift, offset = 100.0, 1.002, 0.4
    t = np.arange(3000) / sfreq
    wave = lambda s: np.sin(2 * np.pi * 1.3 * s) + np.cos(2 * np.pi * 0.31 * s)
    ours = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(wave(t))], "ch long, samp long, value double")
    theirs = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(wave(t * drift + offset))], "ch long, samp long, value double")
    pairs = spark.createDataFrame([(float(drift * x + offset), float(x)) for x in np.linspace(1, 28, 40)], "y double, x double")
    a, b = (values(x)[0] for x in B.realign(ours, theirs, pairs, sfreq, block=256))
    assert len(a) == len(b) > 2900 and np.abs(a - b)[50:-50].max() < 0.02
    b, a = (values(x)[0] for x in B.realign(theirs, ours, pairs.selectExpr("x AS y", "y AS x"), sfreq, block=256))
    assert len(a) == len(b) > 2900 and np.abs(a - b)[50:-50].max() < 0.02
    with pytest.raises(ValueError, match="two times"):
        B.clock_fit(pairs.limit(1))
