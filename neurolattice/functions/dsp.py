"""Signal kernels on one channel, in numpy: what a worker runs on a channel's samples."""

from __future__ import annotations

import math

import numpy as np

#: Seconds of filter per Hz of transition, by window.
LENGTHS = {"hann": 3.1, "hamming": 3.3, "blackman": 5.0}


def window(name: str, n: int, sym: bool = True) -> np.ndarray:
    m = n if sym else n + 1
    x = 2 * np.pi * np.arange(m) / max(1, m - 1)
    w = {"hann": 0.5 - 0.5 * np.cos(x), "hamming": 0.54 - 0.46 * np.cos(x), "blackman": 0.42 - 0.5 * np.cos(x) + 0.08 * np.cos(2 * x), "boxcar": np.ones(m)}[name]
    return w[:n]


def transition(low: float | None, high: float | None, sfreq: float) -> tuple[float | None, float | None]:
    """Automatic transition widths of the lower and the upper edge."""
    return (None if low is None else min(max(0.25 * low, 2.0), low), None if high is None else min(max(0.25 * high, 2.0), sfreq / 2 - high))


def design_fir(sfreq: float, low: float | None, high: float | None, name: str = "hamming", width: float | None = None) -> np.ndarray:
    """Odd, symmetric taps of a low-, high-, band-pass or (low > high) band-stop filter. width: of the transitions."""
    a, b = transition(low, high, sfreq) if width is None else (None if low is None else width, None if high is None else width)
    widths = [x for x in (a, b) if x is not None]
    if not widths:
        return np.ones(1)
    n = int(math.ceil(LENGTHS[name] / min(widths) * sfreq))
    n += (n + 1) % 2

    def low_pass(edge: float, width: float) -> np.ndarray:
        f = (edge + width / 2) if edge < sfreq / 2 else sfreq / 2
        t = np.arange(n) - (n - 1) / 2
        h = 2 * f / sfreq * np.sinc(2 * f / sfreq * t) * window(name, n)
        return h / h.sum()

    unit = np.zeros(n)
    unit[(n - 1) // 2] = 1
    if low is None:
        return low_pass(high, b)
    if high is None:
        return unit - low_pass(low - a, a)
    if low <= high:
        return low_pass(high, b) - low_pass(low - a, a)
    return low_pass(high, b) + unit - low_pass(low - a, a)


def reflect_pad(x: np.ndarray, n: int) -> np.ndarray:
    """Odd reflection at both ends, as far as there are samples; zeros beyond."""
    k = min(n, len(x) - 1)
    head, tail = 2 * x[0] - x[k:0:-1], 2 * x[-1] - x[-2 : -k - 2 : -1]
    return np.concatenate([np.zeros(n - k), head, x, tail, np.zeros(n - k)])


def fft_length(n: int) -> int:
    best = 1 << max(0, n - 1).bit_length()
    for a in range(12):
        for b in range(8):
            m = 3**a * 5**b
            if m < best:
                m <<= max(0, (-(-n // m) - 1).bit_length())
                if m >= n:
                    best = min(best, m)
    return best


def fir(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Zero-phase filtering by a symmetric FIR, with reflected ends."""
    if len(x) < 2:
        return x * h.sum()
    pad = len(h) - 1
    y = reflect_pad(x, pad)
    n = fft_length(len(y) + len(h) - 1)
    out = np.fft.irfft(np.fft.rfft(y, n) * np.fft.rfft(h, n), n)
    start = pad + (len(h) - 1) // 2
    return out[start : start + len(x)]


def filter_data(x: np.ndarray, sfreq: float, low: float | None, high: float | None, name: str = "hamming") -> np.ndarray:
    return fir(x, design_fir(sfreq, low, high, name))


def notch(x: np.ndarray, sfreq: float, freqs: list[float], width: float | None = None, trans: float = 1.0) -> np.ndarray:
    for f in freqs:
        half = (width or f / 200) / 2 + trans / 2
        x = fir(x, design_fir(sfreq, f + half, max(f - half, 0.1), width=trans / 2))
    return x


def butterworth(order: int, sfreq: float, low: float | None, high: float | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of a digital Butterworth filter, by the bilinear transform."""
    p = np.exp(1j * np.pi * (np.arange(1, 2 * order, 2) / (2 * order) + 0.5))
    warp = lambda f: 2 * sfreq * math.tan(math.pi * f / sfreq)
    z = np.zeros(0, complex)
    k = 1.0
    if low is None:
        w = warp(high)
        p, k = p * w, k * w**order
    elif high is None:
        w = warp(low)
        k = float(np.real(k / np.prod(-p)))
        p, z = w / p, np.zeros(order, complex)
    else:
        w0, bw = math.sqrt(warp(low) * warp(high)), warp(high) - warp(low)
        q = p * bw / 2
        root = np.sqrt(q * q - w0 * w0)
        p, z, k = np.concatenate([q + root, q - root]), np.zeros(order, complex), k * bw**order
    fs2 = 2 * sfreq
    k = float(np.real(k * np.prod(fs2 - z) / np.prod(fs2 - p)))
    zd = np.concatenate([(fs2 + z) / (fs2 - z), -np.ones(len(p) - len(z))])
    return zd, (fs2 + p) / (fs2 - p), k


def ringing(poles: np.ndarray, tol: float = 1e-14) -> int:
    """Samples until what poles leave of an impulse is under tol."""
    slow = float(np.abs(poles).max(initial=0.0))
    if slow >= 1:
        raise ValueError("the filter does not settle")
    return 1 if slow < tol else int(math.ceil(math.log(tol) / math.log(slow))) + 1


def iir(x: np.ndarray, sfreq: float, low: float | None, high: float | None, order: int = 4, zero_phase: bool = True) -> np.ndarray:
    """Forward and backward (or only forward) Butterworth filtering, in the frequency domain of a padded signal."""
    z, p, k = butterworth(order, sfreq, low, high)
    pad = min(len(x) - 1, 3 * (2 * order + 1) * 10)
    y = reflect_pad(x, pad)
    n = fft_length(len(y) + 2 * ringing(p))
    w = np.exp(2j * np.pi * np.fft.rfftfreq(n))
    h = k * np.prod(w[:, None] - z, 1) / np.prod(w[:, None] - p, 1)
    out = np.fft.irfft(np.fft.rfft(y, n) * (np.abs(h) ** 2 if zero_phase else h), n)
    return out[pad : pad + len(x)]


def hilbert(x: np.ndarray, n: int | None = None) -> np.ndarray:
    n = n or fft_length(len(x))
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, n) * gain)[: len(x)]


def resample(x: np.ndarray, up: float, down: float) -> np.ndarray:
    """FFT resampling with odd reflected ends; the length is round(up / down * n)."""
    n = len(x)
    final = int(round(up / down * n))
    pad = min(100, n - 1)
    y = reflect_pad(x, pad)
    m = int(round(up / down * len(y)))
    f = np.fft.rfft(y)
    g = np.zeros(m // 2 + 1, complex)
    keep = min(len(f), len(g))
    g[:keep] = f[:keep]
    out = np.fft.irfft(g, m) * (m / len(y))
    start = int(round(up / down * pad))
    return out[start : start + final]


def savgol(x: np.ndarray, size: int, order: int = 5) -> np.ndarray:
    """Savitzky-Golay smoothing; ends are fitted by the polynomial of the first and last windows."""
    half = size // 2
    if len(x) < size:
        return x.copy()
    basis = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    solve = np.linalg.pinv(basis)
    out = np.convolve(x, solve[0][::-1], "same")
    for part, at in ((x[:size], np.arange(half)), (x[-size:], np.arange(half + 1, size))):
        fit = basis @ (solve @ part)
        if at[0] == 0:
            out[:half] = fit[at]
        else:
            out[-half:] = fit[at]
    return out


def welch(x: np.ndarray, sfreq: float, n_fft: int, overlap: int = 0, average: str = "mean") -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, density): Hamming windows, the mean removed from each segment."""
    n_fft = min(n_fft, len(x))
    starts = np.arange(0, len(x) - n_fft + 1, n_fft - overlap)
    w = window("hamming", n_fft, sym=False)
    seg = np.stack([x[s : s + n_fft] for s in starts])
    p = np.abs(np.fft.rfft((seg - seg.mean(1, keepdims=True)) * w, axis=1)) ** 2 / (sfreq * (w * w).sum())
    p[:, 1 : -1 if n_fft % 2 == 0 else None] *= 2
    if average == "median":
        k = np.arange(1, (len(p) - 1) // 2 + 1)
        out = np.median(p, 0) / (1 + np.sum(1 / (2 * k + 1) - 1 / (2 * k)) if len(k) else 1)
    else:
        out = p.mean(0)
    return np.fft.rfftfreq(n_fft, 1 / sfreq), out


def dpss(n: int, half_nbw: float, k: int, low_bias: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Tapers and their concentrations, from the commuting tridiagonal matrix."""
    w, t = half_nbw / n, np.arange(n)
    diagonal = ((n - 1 - 2 * t) / 2) ** 2 * math.cos(2 * math.pi * w)
    off = t[1:] * (n - t[1:]) / 2
    _, v = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    tapers = v[:, ::-1][:, :k].T
    for i, taper in enumerate(tapers):
        if (taper.sum() if i % 2 == 0 else taper[: n // 2].sum() or taper[1]) < 0:
            tapers[i] = -taper
    lag = np.subtract.outer(t, t)
    kernel = np.where(lag == 0, 2 * w, np.sin(2 * np.pi * w * lag) / (np.pi * np.where(lag == 0, 1, lag)))
    ratios = np.einsum("ki,ij,kj->k", tapers, kernel, tapers)
    keep = ratios > 0.9 if low_bias else np.ones(k, bool)
    return tapers[keep], ratios[keep]


def multitaper(x: np.ndarray, sfreq: float, bandwidth: float | None = None, low_bias: bool = True) -> tuple[np.ndarray, np.ndarray]:
    n = len(x)
    half = 4.0 if bandwidth is None else bandwidth * n / (2 * sfreq)
    tapers, ratios = dpss(n, half, max(1, int(2 * half) - 1), low_bias)
    p = np.abs(np.fft.rfft((x - x.mean()) * tapers, axis=1)) ** 2
    out = 2 * (p * ratios[:, None]).sum(0) / ratios.sum() / sfreq
    out[0] /= 2
    if n % 2 == 0:
        out[-1] /= 2
    return np.fft.rfftfreq(n, 1 / sfreq), out


def morlet(sfreq: float, freq: float, n_cycles: float = 7.0, zero_mean: bool = True) -> np.ndarray:
    """A complex wavelet over five deviations each side, of norm sqrt(2)."""
    sigma = n_cycles / (2 * np.pi * freq)
    t = np.arange(0, 5 * sigma, 1 / sfreq)
    t = np.concatenate([-t[:0:-1], t])
    wave = np.exp(2j * np.pi * freq * t)
    if zero_mean:
        wave -= np.exp(-2 * (np.pi * freq * sigma) ** 2)
    wave *= np.exp(-(t**2) / (2 * sigma**2))
    return wave / (np.sqrt(0.5) * np.linalg.norm(wave))


def fwhm(freq: float, n_cycles: float) -> float:
    return n_cycles * math.sqrt(2 * math.log(2)) / (math.pi * freq)


def cwt(x: np.ndarray, wavelet: np.ndarray) -> np.ndarray:
    n = fft_length(len(x) + len(wavelet) - 1)
    full = np.fft.ifft(np.fft.fft(x, n) * np.fft.fft(wavelet, n))
    start = (len(wavelet) - 1) // 2
    return full[start : start + len(x)]


def frames(size: int, step: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, sine window, windows' energy at each position) of n frames, the ends counted as they are covered."""
    at = step * np.arange(n)[:, None] + np.arange(size)
    w = np.sin(np.arange(0.5, size + 0.5) / size * np.pi)
    return at, w, np.bincount(at.ravel(), np.tile(w * w, n))[at]


def stft(x: np.ndarray, size: int, step: int | None = None) -> np.ndarray:
    """(size / 2 + 1, steps) complex: sine windows that make a tight frame, up to both ends."""
    step = step or size // 2
    if size % step or size % 4:
        raise ValueError("the window must be a multiple of the step and of 4")
    at, w, energy = frames(size, step, -(-len(x) // step))
    y = np.concatenate([np.zeros((size - step) // 2), x, np.zeros(size)])
    return np.fft.rfft(y[at] * w / np.sqrt(size * energy), axis=1).T


def istft(spec: np.ndarray, size: int, step: int, n: int) -> np.ndarray:
    at, w, energy = frames(size, step, spec.shape[1])
    parts = np.fft.irfft(spec.T, size, axis=1) * w * np.sqrt(size / energy)
    start = (size - step) // 2
    return np.bincount(at.ravel(), parts.ravel())[start : start + n]


def peak_finder(x: np.ndarray, thresh: float | None = None, extrema: int = 1) -> np.ndarray:
    """Positions of peaks that stand out from the valleys beside them by more than thresh."""
    x = x * extrema
    thresh = (x.max() - x.min()) / 4 if thresh is None else thresh
    turn = np.flatnonzero(np.diff(np.sign(np.diff(x)[np.diff(x) != 0])) != 0)
    places = np.flatnonzero(np.diff(x) != 0)
    candidates = np.concatenate([[0], places[turn + 1] if len(turn) else [], [len(x) - 1]]).astype(int)
    peaks, low, top = [], x[candidates[0]], None
    for i in candidates:
        if top is None:
            if x[i] > low + thresh:
                top = i
            low = min(low, x[i])
        elif x[i] > x[top]:
            top = i
        elif x[i] < x[top] - thresh:
            peaks.append(top)
            top, low = None, x[i]
    if top is not None and x[top] > low + thresh:
        peaks.append(top)
    return np.array(sorted(set(peaks)), int)


def tddr(x: np.ndarray, sfreq: float) -> np.ndarray:
    """Temporal derivative distribution repair: robust weights on the derivative of the slow part."""
    mean = x.mean()
    y = x - mean
    slow = iir(y, sfreq, None, 0.5, 3) if sfreq > 1 and len(x) > 12 else y
    fast, d, mu = y - slow, np.diff(slow), np.inf
    w = np.ones(len(d))
    for _ in range(50):
        new = np.sum(w * d) / max(w.sum(), 1e-300)
        dev = np.abs(d - new)
        sigma = 1.4826 * np.median(dev)
        r = dev / (sigma * 4.685) if sigma else np.zeros(len(d))
        w = np.where(r < 1, (1 - r**2) ** 2, 0)
        if abs(new - mu) < 1e-10 * max(abs(new), abs(mu), 1e-12):
            break
        mu = new
    fixed = np.concatenate([[0.0], np.cumsum(w * (d - new))])
    return fixed - fixed.mean() + fast + mean


def yule_walker(x: np.ndarray, order: int = 2) -> np.ndarray:
    """Coefficients of the filter that whitens x: 1, -a1, -a2 ..."""
    y = x - x.mean()
    r = np.array([np.dot(y[: len(y) - k], y[k:]) for k in range(order + 1)]) / len(y)
    return np.concatenate([[1.0], -np.linalg.solve(r[np.abs(np.subtract.outer(np.arange(order), np.arange(order)))], r[1:])])
