"""Kernels against closed forms and identities."""

import numpy as np
import pytest

from neurolattice.functions import dsp

RNG = np.random.default_rng(0)
T = np.arange(2000) / 500


def gain(h, f, sfreq):
    return abs(np.sum(h * np.exp(-2j * np.pi * f / sfreq * np.arange(len(h)))))


@pytest.mark.parametrize("low,high,passed,stopped", [(None, 40, [1, 20, 35], [60, 200]), (10, None, [20, 100], [0.5, 5]), (10, 40, [15, 30], [3, 70]), (40, 10, [2, 5, 80], [20, 27])])
def test_fir_gain(low, high, passed, stopped):
    h = dsp.design_fir(500.0, low, high)
    assert len(h) % 2 and np.allclose(h, h[::-1])
    assert all(abs(gain(h, f, 500) - 1) < 0.02 for f in passed) and all(gain(h, f, 500) < 0.02 for f in stopped)


def test_fir_is_convolution():
    x, h = RNG.standard_normal(300), np.hanning(21)
    assert np.allclose(dsp.fir(x, h)[20:-20], np.convolve(x, h, "same")[20:-20])


def test_iir_gain():
    x = np.sin(2 * np.pi * 5 * T) + np.sin(2 * np.pi * 100 * T)
    assert np.abs(dsp.iir(x, 500, None, 20) - np.sin(2 * np.pi * 5 * T))[200:-200].max() < 0.02
    z, p, k = dsp.butterworth(4, 500, None, 20)
    w = np.exp(2j * np.pi * 20 / 500)
    assert abs(abs(k * np.prod(w - z) / np.prod(w - p)) - np.sqrt(0.5)) < 1e-9


def test_hilbert_and_notch():
    x = np.cos(2 * np.pi * 10 * T)
    assert np.allclose(np.abs(dsp.hilbert(x)), 1, atol=1e-6)
    y = dsp.notch(x + np.cos(2 * np.pi * 50 * T), 500, [50])
    assert np.abs(y - x)[800:-800].max() < 0.15  # a transition of half a hertz is longer than the ends left out


def test_resample():
    x = np.sin(2 * np.pi * 3 * T)
    y = dsp.resample(x, 1, 2)
    assert len(y) == 1000 and np.abs(y - x[::2])[50:-50].max() < 0.01


def test_spectra_keep_power():
    x = RNG.standard_normal(4096)
    for f, p in (dsp.welch(x, 256, 256), dsp.multitaper(x, 256)):
        assert abs(p.sum() * (f[1] - f[0]) - x.var()) < 0.1
    f, p = dsp.multitaper(np.sin(2 * np.pi * 30 * np.arange(1024) / 256), 256)
    assert abs(f[p.argmax()] - 30) < 1.1


def test_dpss():
    v, r = dsp.dpss(128, 4.0, 7)
    assert np.allclose(v @ v.T, np.eye(len(v)), atol=1e-8) and (r > 0.9).all() and (np.diff(r) < 1e-9).all()


def test_wavelets():
    w = dsp.morlet(500, 20.0)
    assert abs(np.linalg.norm(w) - np.sqrt(2)) < 1e-9
    z = np.abs(dsp.cwt(np.sin(2 * np.pi * 20 * T), w)) ** 2
    assert z[800:1200].std() < 0.01 * z[800:1200].mean() and dsp.fwhm(10, 7) == pytest.approx(7 * np.sqrt(2 * np.log(2)) / (np.pi * 10))


def test_stft_is_a_tight_frame():
    for n in (1, 5, 8, 40, 103):
        x = RNG.standard_normal(n)
        for size, step in ((16, 8), (16, 4), (8, 2)):
            spec = dsp.stft(x, size, step)
            assert np.allclose(dsp.istft(spec, size, step, n), x, atol=1e-12)
            if n % step == 0:  # as much energy as the signal, the inner bins counting twice
                twice = np.r_[1, np.full(size // 2 - 1, 2), 1]
                assert np.isclose((twice[:, None] * abs(spec) ** 2).sum(), (x * x).sum())


def test_savgol_keeps_polynomials():
    t = np.arange(60.0)
    x = 1 + 2 * t - 0.1 * t**2 + 1e-3 * t**3
    assert np.allclose(dsp.savgol(x, 11), x)


def test_peaks_and_repair():
    x = np.zeros(100)
    x[[20, 60]] = [5, 8]
    assert dsp.peak_finder(x).tolist() == [20, 60]
    y = np.sin(np.arange(400) / 30) + np.where(np.arange(400) > 200, 5, 0)
    fixed = dsp.tddr(y, 10.0)
    assert abs(fixed[260:].mean() - fixed[:140].mean()) < 2 and dsp.peak_finder(np.zeros(5)).tolist() == []
    a = dsp.yule_walker(np.convolve(RNG.standard_normal(20000), 0.8 ** np.arange(60))[:20000], 1)
    assert abs(a[1] + 0.8) < 0.02


@pytest.mark.parametrize("n", [1, 2, 7, 97, 1000, 4097])
def test_fft_length(n):
    m = dsp.fft_length(n)
    assert n <= m < 2 * n + 1
