"""Covariance estimators, and the choice between them by held-out likelihood.

One pass over the samples gives each fold's products of channels: samples are rows of a matrix in Arrow batches,
and a task sends on one row a fold and pair of channels. All estimates and all scores follow from these tables:
what a fold is held out of is the sum of the others. They are channels x channels, so they come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shrinkages that are tried, and rounds and tolerance of the factor model.
SHRINKAGES, ROUNDS, TOL = np.logspace(-4, 0, 30), 1000, 1e-8


def products(df: DataFrame, keys: tuple[str, ...] = ("epoch", "t"), fold: Column | None = None) -> DataFrame:
    """fold, ch_i, ch_j, n, a (sum of ch_i where ch_j has a value), ab (sum of products), quad (sum of the squares of
    samples' squared lengths, with ch_i = ch_j): over the samples (keys) that have both channels."""
    kind = dict(df.dtypes)["ch"]
    own = df.select(*keys, "ch", F.col("value").cast("double").alias("value"), (F.lit(0) if fold is None else fold).cast("long").alias("fold"))
    rows = own.filter("value IS NOT NULL").groupBy(*keys, "fold").agg(F.collect_list("ch").alias("ch"), F.collect_list("value").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            names = np.unique(batch.column("ch").flatten().to_numpy(zero_copy_only=False))
            at = np.searchsorted(names, batch.column("ch").flatten().to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("ch").offsets.to_numpy()))
            x, there = np.zeros((batch.num_rows, len(names))), np.zeros((batch.num_rows, len(names)))
            x[row, at], there[row, at] = batch.column("value").flatten().to_numpy(), 1.0
            folds = batch.column("fold").to_numpy()
            for f in np.unique(folds):
                y, m = x[folds == f], there[folds == f]
                quad = np.diag(((y * y).sum(1) ** 2) @ m)
                made = np.stack([m.T @ m, y.T @ m, y.T @ y, quad])
                key = (int(f), tuple(names.tolist()))
                sums[key] = sums[key] + made if key in sums else made
        for (f, names), made in sums.items():
            n = len(names)
            ids = pa.array(names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n * n, f)), ids.take(pa.array(np.repeat(np.arange(n), n))), ids.take(pa.array(np.tile(np.arange(n), n))), *(pa.array(m.ravel()) for m in made)], ["fold", "ch_i", "ch_j", "n", "a", "ab", "quad"])

    parts = rows.mapInArrow(run, f"fold long, ch_i {kind}, ch_j {kind}, n double, a double, ab double, quad double")
    return parts.groupBy("fold", "ch_i", "ch_j").agg(*(F.sum(c).alias(c) for c in ("n", "a", "ab", "quad")))


def covariance(df: DataFrame, keys: tuple[str, ...] = ("epoch", "t"), ddof: int = 1) -> DataFrame:
    """ch_i, ch_j, value, n over all samples that have both channels."""
    s = products(df, keys).filter("n > 0")
    other = s.select(F.col("ch_i").alias("ch_j"), F.col("ch_j").alias("ch_i"), F.col("a").alias("b"))
    s = s.join(other, ["ch_i", "ch_j"])
    return s.select("ch_i", "ch_j", ((F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / (F.col("n") - ddof)).alias("value"), F.col("n").cast("long").alias("n"))


class Moments:
    """Number of samples, products of channels (means are not taken out) and the sum of fourth powers of lengths."""

    def __init__(self, n: float, gram: np.ndarray, quad: float):
        self.n, self.gram, self.quad = n, gram, quad

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.gram + other.gram, self.quad + other.quad)

    @property
    def cov(self) -> np.ndarray:
        return self.gram / self.n


def moments(df: DataFrame, keys: tuple[str, ...], fold: Column) -> tuple[list, list[Moments]]:
    """Channels in order, and the moments of each fold. Samples have all channels."""
    rows = products(df, keys, fold).collect()  # folds x channels squared
    names = sorted({r["ch_i"] for r in rows})
    at, out = {c: i for i, c in enumerate(names)}, {}
    for r in rows:
        own = out.setdefault(r["fold"], Moments(r["n"], np.zeros((len(names),) * 2), 0.0))
        own.gram[at[r["ch_i"]], at[r["ch_j"]]] = r["ab"]
        own.n, own.quad = max(own.n, r["n"]), max(own.quad, r["quad"])
    return names, [out[k] for k in sorted(out)]


def shrunk(cov: np.ndarray, share: float) -> np.ndarray:
    return (1 - share) * cov + share * np.trace(cov) / len(cov) * np.eye(len(cov))


def ledoit_wolf(m: Moments) -> float:
    """The shrinkage that is best in expectation, from the spread of samples' products."""
    p = len(m.gram)
    mu = np.trace(m.cov) / p
    size = (m.cov**2).sum()
    far = (size - 2 * mu * np.trace(m.cov) + p * mu * mu) / p
    spread = min((m.quad / m.n - size) / (p * m.n), far)
    return float(spread / far) if far > 0 else 0.0


def oas(m: Moments) -> float:
    """The same for normal samples, from the covariance alone."""
    p = len(m.gram)
    alpha, mu = (m.cov**2).mean(), np.trace(m.cov) / p
    under = (m.n + 1) * (alpha - mu * mu / p)
    return 1.0 if under <= 0 else float(min((alpha + mu * mu) / under, 1.0))


def principal(cov: np.ndarray, k: int) -> np.ndarray:
    """k components and an even rest: the probabilistic principal components of most likelihood."""
    s, u = np.linalg.eigh(cov)
    s, u = s[::-1], u[:, ::-1]
    rest = max(s[k:].mean(), 1e-300) if k < len(s) else 0.0
    return (u[:, :k] * (s[:k] - rest)) @ u[:, :k].T + rest * np.eye(len(s))


def factors(cov: np.ndarray, k: int, rounds: int = ROUNDS, tol: float = TOL) -> np.ndarray:
    """k common factors and noise of each channel's own, by expectation maximisation."""
    s, u = np.linalg.eigh(cov)
    w = u[:, ::-1][:, :k] * np.sqrt(np.maximum(s[::-1][:k] * 0.5, 1e-12 * s[-1]))
    own, last = np.maximum(np.diag(cov) - (w * w).sum(1), 1e-3 * np.diag(cov)), -np.inf
    least = 1e-12 * np.diag(cov).max()
    for _ in range(rounds):
        made = w @ w.T + np.diag(own)
        now = likelihood(cov, made)
        if now - last < tol:
            break
        last = now
        beta = np.linalg.solve(made, w).T
        inner = np.eye(k) - beta @ w + beta @ cov @ beta.T
        w = np.linalg.solve(inner.T, (cov @ beta.T).T).T
        own = np.maximum(np.diag(cov) - np.einsum("ij,ji->i", w, beta @ cov), least)
    return w @ w.T + np.diag(own)


def likelihood(test: np.ndarray, cov: np.ndarray) -> float:
    """The mean log-likelihood of samples with products test under a normal law of covariance cov and mean 0."""
    sign, log = np.linalg.slogdet(cov)
    if sign <= 0:
        return -math.inf
    return float(-0.5 * (np.trace(np.linalg.solve(cov, test)) + log + len(cov) * math.log(2 * math.pi)))


def held_out(folds: list[Moments], estimate) -> float:
    """The mean over folds of the likelihood that what the others give assigns to the fold."""
    scores = []
    for k, test in enumerate(folds):
        rest = [m for i, m in enumerate(folds) if i != k]
        scores.append(likelihood(test.cov, estimate(sum(rest[1:], rest[0]))))
    return float(np.mean(scores))


def candidates(p: int, methods: tuple[str, ...], shrinkages, components) -> Iterator[tuple[str, float, object]]:
    """(method, parameter, estimate of moments)."""
    components = components or [k for k in range(1, p) if p < 10 or k % 5 == 0]
    for method in methods:
        if method == "empirical":
            yield method, 0.0, lambda m: m.cov
        elif method == "ledoit_wolf":
            yield method, 0.0, lambda m: shrunk(m.cov, ledoit_wolf(m))
        elif method == "oas":
            yield method, 0.0, lambda m: shrunk(m.cov, oas(m))
        elif method == "shrunk":
            yield from ((method, float(s), lambda m, s=s: shrunk(m.cov, s)) for s in shrinkages)
        elif method in ("pca", "factor_analysis"):
            made = principal if method == "pca" else factors
            yield from ((method, float(k), lambda m, k=k, made=made: made(m.cov, k)) for k in components)
        else:
            raise ValueError(f"unknown estimator {method}")


AUTO = ("shrunk", "ledoit_wolf", "oas", "pca", "factor_analysis", "empirical")


def scores(df: DataFrame, fold: Column, methods: tuple[str, ...] = AUTO, keys: tuple[str, ...] = ("epoch", "t"), shrinkages=SHRINKAGES, components=None) -> DataFrame:
    """method, parameter, score: the held-out log-likelihood of a sample, for each estimator and parameter."""
    names, folds = moments(df, keys, fold)
    if len(folds) < 2:
        raise ValueError("samples of two folds at least are compared")
    rows = [(m, p, held_out(folds, e)) for m, p, e in candidates(len(names), methods, shrinkages, components)]
    return df.sparkSession.createDataFrame(rows, "method string, parameter double, score double")


def chosen(df: DataFrame, fold: Column, methods: tuple[str, ...] = AUTO, keys: tuple[str, ...] = ("epoch", "t"), shrinkages=SHRINKAGES, components=None) -> tuple[DataFrame, tuple[str, float, float]]:
    """ch_i, ch_j, value of the estimator of the best score, made of all samples, and (method, parameter, score). Of equal
    scores the first in the order of methods. Samples (keys) have all channels, and are taken to be centred."""
    names, folds = moments(df, keys, fold)
    if len(folds) < 2:
        raise ValueError("samples of two folds at least are compared")
    method, parameter, estimate = max(candidates(len(names), methods, shrinkages, components), key=lambda c: held_out(folds, c[2]))
    cov = estimate(sum(folds[1:], folds[0]))
    rows = [(a, b, float(cov[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    kind = dict(df.dtypes)["ch"]
    return df.sparkSession.createDataFrame(rows, f"ch_i {kind}, ch_j {kind}, value double"), (method, parameter, held_out(folds, estimate))
