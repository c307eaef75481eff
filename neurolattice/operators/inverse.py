"""Spatial operators: spline interpolation and current density, projectors from sensor geometry, linear
inverses and beamformers. Their matrices are channels x channels or sources x channels, made from
geometry or from a covariance that Spark has aggregated; channels.mix applies them to samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import channels as C


def unit(positions) -> np.ndarray:
    p = np.asarray(positions, float)
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def spline(cosines: np.ndarray, order: int, terms: int = 50) -> np.ndarray:
    """The sum over n of (2 n + 1) / (n (n + 1)) ** order P_n(cosine) / 4 pi, by the recurrence of P_n."""
    before, now, out = np.ones_like(cosines), cosines, np.zeros_like(cosines)
    for n in range(1, terms + 1):
        out = out + (2 * n + 1) / (n * (n + 1.0)) ** order * now
        before, now = now, ((2 * n + 1) * cosines * now - n * before) / (n + 1)
    return out / (4 * np.pi)


def interpolation(known, wanted, alpha: float = 1e-5) -> np.ndarray:
    """Weights (wanted x known) of spherical splines with a constant, smoothed by alpha."""
    a, b = unit(known), unit(wanted)
    n = len(a)
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = spline(a @ a.T, 4) + alpha * np.eye(n)
    system[n, n] = 0
    return np.hstack([spline(b @ a.T, 4), np.ones((len(b), 1))]) @ np.linalg.pinv(system)[:, :n]


def repair(positions, bads: Sequence[int]) -> np.ndarray:
    """The channels x channels matrix that puts interpolated values in place of bad channels."""
    out, good = np.eye(len(positions)), [i for i in range(len(positions)) if i not in set(bads)]
    at = np.asarray(positions, float)
    out[list(bads)] = 0
    out[np.ix_(list(bads), good)] = interpolation(at[good], at[list(bads)])
    return out


def current_density(positions, lambda2: float = 1e-5, radius: float = 1.0) -> np.ndarray:
    """The channels x channels matrix of the surface Laplacian of the spherical spline through average
    referenced values."""
    p = unit(positions)
    n, cosines = len(positions), p @ p.T
    inverse = np.linalg.inv(spline(cosines, 4) + lambda2 * np.eye(n))
    centred = inverse @ (np.eye(n) - 1 / n)
    coefficients = centred - np.outer(inverse.sum(0), centred.sum(0) / inverse.sum())
    return spline(cosines, 3) @ coefficients / radius**2


def homogeneous_field(orientations) -> np.ndarray:
    """The projector that removes a field which is the same at all sensors of these orientations."""
    n = np.asarray(orientations, float)
    return np.eye(len(n)) - n @ np.linalg.pinv(n)


def rank(cov: np.ndarray, tol: float = 1e-6) -> int:
    """How many eigenvalues are above tol of the largest."""
    values = np.linalg.eigvalsh(cov)
    return int((values > tol * values.max()).sum())


def depth_prior(gain: np.ndarray, exponent: float = 0.8, limit: float = 10.0, orient: int = 1) -> np.ndarray:
    """A weight for each source: its gain's power to -exponent, at most limit ** 2 times the least one's
    before the exponent is taken, and 1 at most. Of three orientations the power is that of the strongest direction."""
    w = 1 / np.linalg.norm(by_source(gain, orient), 2, axis=(1, 2)) ** 2
    return np.repeat(np.minimum(w / w.min(), limit**2) ** exponent / min(w.max() / w.min(), limit**2) ** exponent, orient)


def loose_prior(n_sources: int, loose: float) -> np.ndarray:
    """Weights of sources' orientations, two along the surface and one across: loose, loose, 1."""
    if not 0 <= loose <= 1:
        raise ValueError("loose is between 0 and 1")
    return np.tile([loose, loose, 1.0], n_sources)


def by_source(gain: np.ndarray, orient: int) -> np.ndarray:
    """Sources x channels x orientations."""
    if gain.shape[1] % orient:
        raise ValueError(f"{gain.shape[1]} columns are not sources of {orient} orientations")
    return gain.T.reshape(-1, orient, len(gain)).swapaxes(1, 2)


def whitener(noise: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """rank x channels: noise becomes uncorrelated, of variance 1; directions without noise are left out. They are
    found among channels scaled to the same variance, so that sensors of different units can be together."""
    deviation = np.sqrt(np.maximum(np.diag(noise), 0))
    own = np.where(deviation > 0, 1 / np.where(deviation > 0, deviation, 1), 0)
    values, vectors = np.linalg.eigh(noise * own[:, None] * own)
    kept = values > tol * values.max()
    return (vectors[:, kept] / np.sqrt(values[kept])).T * own


def power(matrices: np.ndarray, exponent: float) -> np.ndarray:
    """Powers of symmetric, positive matrices; directions of nothing stay nothing."""
    values, vectors = np.linalg.eigh(matrices)
    real = values > 1e-12 * np.maximum(values.max(-1, keepdims=True), 1e-300)
    scaled = np.where(real, np.where(real, values, 1) ** exponent, 0)
    return (vectors * scaled[..., None, :]) @ vectors.swapaxes(-1, -2)


def exact_weights(g: np.ndarray, lambda2: float, orient: int, prior: np.ndarray, eps: float = 1e-6, rounds: int = 20) -> np.ndarray:
    """Sources' covariances (sources x orientations x orientations) with which a single source is localised exactly:
    each is the inverse root of what its gain passes through the inverse of all, in turn until they stay. prior: weights
    of columns, put in again in each round."""
    own = by_source(g * np.sqrt(prior), orient)
    roots = np.sqrt(prior).reshape(-1, orient)
    outer = roots[:, :, None] * roots[:, None, :]

    def scaled(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.einsum("sci,sij,sdj->cd", own, r, own, optimize=True)
        size = np.trace(total) / len(total)
        return r / size, total / size

    r, total = scaled(np.broadcast_to(np.eye(orient), outer.shape) * outer)
    for _ in range(rounds):
        before = r
        inverse = np.linalg.inv(total + lambda2 * np.eye(len(total)))
        r, total = scaled(power(own.swapaxes(1, 2) @ inverse @ own, -0.5) * outer)
        if np.linalg.norm(r - before) < eps * np.linalg.norm(before):
            break
    plain = by_source(g, orient)
    return r * len(g) / np.einsum("sci,sij,scj->", plain, r, plain)


def inverse_kernel(gain: np.ndarray, noise: np.ndarray, lambda2: float = 1 / 9, method: str = "MNE", prior: np.ndarray | None = None, orient: int = 1) -> np.ndarray:
    """Columns of the gain x channels of the minimum-norm estimate, its sources' covariance scaled so that the
    whitened gain has a mean power of 1. dSPM: over the noise's deviation; sLORETA: over the root of the
    resolution matrix's diagonal; eLORETA: by exact_weights, where a prior should weigh orientations only. With three
    orientations a source is three columns on end, which share one scale: the root of the sum of their squares."""
    white = whitener(noise)
    g = white @ gain
    prior = np.ones(gain.shape[1]) if prior is None else np.asarray(prior, float)
    if method == "eLORETA":
        r = exact_weights(g, lambda2, orient, prior)
        lead = (by_source(g, orient) @ r).swapaxes(1, 2).reshape(-1, len(g))  # sources' covariance times the gain
        return lead @ np.linalg.inv(g @ lead + lambda2 * np.eye(len(g))) @ white
    r = prior * len(g) / np.trace((g * prior) @ g.T)
    kernel = (r[:, None] * g.T) @ np.linalg.inv((g * r) @ g.T + lambda2 * np.eye(len(g)))
    squares = {"MNE": np.ones(len(r)) / orient, "dSPM": (kernel**2).sum(1), "sLORETA": (kernel * g.T).sum(1)}[method]
    scale = np.repeat(np.sqrt(squares.reshape(-1, orient).sum(1)), orient)
    return kernel @ white / scale[:, None]


def lcmv(gain: np.ndarray, cov: np.ndarray, reg: float = 0.05, norm: str = "unit-gain", noise: np.ndarray | None = None, orient: int = 1, pick: str = "vector") -> np.ndarray:
    """Each source's filter passes its gain and has the least power otherwise; noise, if given, whitens both first, so
    sensors of different units can be together. Of three orientations pick "vector" gives a row each, "max-power" one
    row a source, of the orientation with the most power, for the norm "unit-noise-gain" the most over the noise."""
    white = np.eye(len(cov)) if noise is None else whitener(noise)
    g, c = by_source(white @ gain, orient), white @ cov @ white.T
    inverse = np.linalg.inv(c + reg * np.trace(c) / len(c) * np.eye(len(c)))
    if orient > 1 and pick == "max-power":
        first = g.swapaxes(1, 2) @ inverse @ g
        ratio = np.linalg.inv(first) if norm == "unit-gain" else np.linalg.solve(g.swapaxes(1, 2) @ inverse @ inverse @ g, first)
        values, vectors = np.linalg.eig(ratio)
        best = np.take_along_axis(vectors.real, values.real.argmax(1)[:, None, None], 2)[:, :, 0]
        best *= np.where(np.take_along_axis(best, np.abs(best).argmax(1)[:, None], 1) < 0, -1, 1)  # a defined sign
        g = (g @ best[:, :, None]) / np.linalg.norm(best, axis=1)[:, None, None]
    top = g.swapaxes(1, 2) @ inverse
    if norm == "unit-gain":
        top = np.linalg.solve(top @ g, top)
    else:
        top = top / np.sqrt((top**2).sum(2, keepdims=True))
    return top.reshape(-1, len(c)) @ white


def apply_inverse(df: DataFrame, kernel: np.ndarray, orient: int = 1, pick: str | None = None, keys: tuple[str, ...] = ("epoch", "t")) -> DataFrame:
    """ch (source), keys, value. Of three orientations pick None gives the vector's length, "normal" its third
    part, "vector" rows 3 s, 3 s + 1, 3 s + 2 of source s. The kernel is sent to the workers, whatever its size up to
    channels.MOST weights, and multiplies batches of samples."""
    if pick == "normal":
        kernel = kernel[orient - 1 :: orient]
    return C.multiplied(df, kernel, keys, orient if pick is None else 1)


def source_power(cov: DataFrame, filters: np.ndarray) -> DataFrame:
    """source, power of filters w as w' C w, from the covariance table: no sample is read."""
    w = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in filters))
    own = cov.select("ch_i", "ch_j", "value", F.posexplode(w).alias("source", "w"))
    at = F.element_at("w", F.col("ch_i").cast("int") + 1) * F.element_at("w", F.col("ch_j").cast("int") + 1)
    return own.groupBy(F.col("source").cast("long").alias("source")).agg(F.sum(at * F.col("value")).alias("power"))


def interpolate_bads(df: DataFrame, positions, bads: Sequence[int], keys: tuple[str, ...] = ("epoch", "t")) -> DataFrame:
    """ch, keys, value with the bad channels' values from the others'."""
    return C.mix(df, repair(positions, bads).tolist(), keys)
