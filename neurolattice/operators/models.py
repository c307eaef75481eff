"""Decompositions and decoding. What is fitted depends on the data through small matrices (channels x
channels), which Spark aggregates; those are solved on the driver and applied with channels.mix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import channels as C


def matrix(df: DataFrame, n: int) -> np.ndarray:
    """A (ch_i, ch_j, value) table of at most n x n rows as an array."""
    out = np.zeros((n, n))
    for r in df.select("ch_i", "ch_j", "value").limit(n * n + 1).collect():
        out[r["ch_i"], r["ch_j"]] = r["value"]
    return out


def signed(v: np.ndarray) -> np.ndarray:
    """Each row with its largest entry positive, so results do not depend on the solver's signs."""
    at = np.abs(v).argmax(1)
    return v * np.sign(v[np.arange(len(v)), at])[:, None]


def pca(df: DataFrame, n_channels: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(components as rows, variances), the largest first."""
    values, vectors = np.linalg.eigh(matrix(C.covariance(df), n_channels))
    return signed(vectors.T[::-1][:k]), values[::-1][:k]


def projector(components: np.ndarray) -> np.ndarray:
    """What removes the given components (SSP)."""
    q = np.linalg.svd(components.T, full_matrices=False)[0]
    return np.eye(components.shape[1]) - q @ q.T


def whitener(cov: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    values, vectors = np.linalg.eigh(cov)
    keep = values > tol * values.max()
    return (vectors[:, keep] / np.sqrt(values[keep])).T


def shrunk(cov: np.ndarray, alpha: float) -> np.ndarray:
    return (1 - alpha) * cov + alpha * np.trace(cov) / len(cov) * np.eye(len(cov))


def ica(df: DataFrame, n_channels: int, k: int, keys: tuple[str, ...] = ("epoch", "t"), rounds: int = 30, seed: int = 0, tol: float = 1e-6) -> np.ndarray:
    """Unmixing rows by fixed-point iteration with tanh. Each round is one aggregate over the whitened
    samples: k x k sums come to the driver, never samples."""
    own = df.groupBy("ch").agg(F.avg("value").alias("m"))
    centred = df.join(F.broadcast(own), "ch").withColumn("value", F.col("value") - F.col("m"))  # one row a channel
    white = whitener(matrix(C.covariance(centred, keys), n_channels))[-k:]
    z = C.mix(centred, white.tolist(), keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ch", "value"))).alias("x")).select(F.col("x.value").alias("z")).persist()
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((k, k)))[0]
    for _ in range(rounds):

        def sums(batches, w=w):
            a, b, n = np.zeros((k, k)), np.zeros(k), 0
            for pdf in batches:
                x = np.stack(pdf["z"].to_numpy()) if len(pdf) else np.zeros((0, k))
                g = np.tanh(x @ w.T)
                a, b, n = a + g.T @ x, b + (1 - g * g).sum(0), n + len(x)
            yield pd.DataFrame({"a": [a.ravel().tolist()], "b": [b.tolist()], "n": [n]})

        parts = z.mapInPandas(sums, "a array<double>, b array<double>, n long").agg(*(F.array(*(F.sum(F.col(c)[i]) for i in range(m))).alias(c) for c, m in (("a", k * k), ("b", k))), F.sum("n").alias("n")).first()
        new = np.array(parts["a"]).reshape(k, k) / parts["n"] - (np.array(parts["b"]) / parts["n"])[:, None] * w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < tol
        w = new
        if done:
            break
    z.unpersist()
    return signed(w @ white)


def generalised(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filters as rows, eigenvalues) of a x = l b x, the largest first."""
    root = np.linalg.inv(np.linalg.cholesky(b))
    values, vectors = np.linalg.eigh(root @ a @ root.T)
    return signed((root.T @ vectors[:, ::-1]).T), values[::-1]


def csp(df: DataFrame, n_channels: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Common spatial patterns of two conditions."""
    ca, cb = (matrix(C.covariance(df.filter(F.col("condition") == k)), n_channels) for k in (a, b))
    return generalised(ca, ca + cb)


def xdawn(df: DataFrame, n_channels: int, condition: int) -> tuple[np.ndarray, np.ndarray]:
    """Filters that make the average of a condition stand out from all data."""
    average = df.filter(F.col("condition") == condition).groupBy("ch", "t").agg(F.avg("value").alias("value"))
    signal = matrix(C.covariance(average, ("t",), 0), n_channels)
    return generalised(signal, matrix(C.covariance(df), n_channels))


def band_power(df: DataFrame, filters: np.ndarray) -> DataFrame:
    """epoch, ch (the filter), the log of the mean square over time."""
    own = C.mix(df, filters.tolist())
    return own.groupBy("epoch", "ch").agg(F.log(F.avg(F.col("value") ** 2)).alias("value"))


def ridge_fit(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    m, c = x.mean(0), y.mean()
    w = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(x.shape[1]), (x - m).T @ (y - c))
    return w, c - m @ w


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the curve, ties counted as one half."""
    order = np.argsort(score, kind="stable")
    s = score[order]
    ranks = np.empty(len(s))
    first = np.searchsorted(s, s, "left")
    last = np.searchsorted(s, s, "right")
    ranks[order] = (first + last + 1) / 2
    n1 = y.sum()
    n0 = len(y) - n1
    return float("nan") if not n1 or not n0 else (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def folds(epoch: np.ndarray, k: int) -> np.ndarray:
    return epoch % k


def slices(df: DataFrame, a: int, b: int) -> DataFrame:
    """epoch, t, x (channels in order), y: condition b against a."""
    own = df.filter(F.col("condition").isin(a, b)).groupBy("epoch", "condition", "t").agg(F.sort_array(F.collect_list(F.struct("ch", "value"))).alias("x"))
    return own.select("epoch", "t", F.col("x.value").alias("x"), (F.col("condition") == b).cast("int").alias("y"))


def sliding_scores(df: DataFrame, a: int, b: int, k: int = 5) -> DataFrame:
    """t, score: one linear model per time, cross-validated by epoch number; times are independent tasks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("epoch")
        x, y, fold = np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(), folds(pdf["epoch"].to_numpy(), k)
        out = []
        for f in range(k):
            train, test = fold != f, fold == f
            if 0 < y[train].sum() < train.sum():
                w, c = ridge_fit(x[train], y[train].astype(float))
                out.append(auc(x[test] @ w + c, y[test]))
        return pd.DataFrame({"t": [pdf["t"].iloc[0]], "score": [float(np.nanmean(out)) if len(out) and not np.all(np.isnan(out)) else float("nan")]})

    return slices(df, a, b).groupBy("t").applyInPandas(run, "t long, score double")


def generalizing_scores(df: DataFrame, a: int, b: int, k: int = 5) -> DataFrame:
    """train_t, test_t, score: the models of each time applied to all times. Models are times x folds."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, fold = np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(), folds(pdf["epoch"].to_numpy(), k)
        made = [(f, *ridge_fit(x[fold != f], y[fold != f].astype(float))) for f in range(k)]
        return pd.DataFrame({"train_t": pdf["t"].iloc[0], "fold": [f for f, _, _ in made], "w": [w.tolist() for _, w, _ in made], "c": [c for _, _, c in made]})

    own = slices(df, a, b)
    models = own.groupBy("t").applyInPandas(fit, "train_t long, fold long, w array<double>, c double")
    scored = own.withColumn("fold", F.col("epoch") % k).join(F.broadcast(models), "fold")  # times x folds rows
    dot = F.aggregate(F.zip_with("x", "w", lambda p, q: p * q), F.col("c"), lambda s, v: s + v)

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [auc(g["s"].to_numpy(), g["y"].to_numpy()) for _, g in pdf.groupby("fold")]
        return pd.DataFrame({"train_t": [pdf["train_t"].iloc[0]], "test_t": [pdf["t"].iloc[0]], "score": [float(np.nanmean(parts)) if not np.all(np.isnan(parts)) else float("nan")]})

    return scored.select("train_t", "t", "fold", "y", dot.alias("s")).groupBy("train_t", "t").applyInPandas(area, "train_t long, test_t long, score double")


def time_delaying_ridge(df: DataFrame, inputs: list[int], output: int, lags: list[int], alpha: float = 1.0) -> dict:
    """Weights of a lagged linear model of one channel on others: normal equations by aggregation."""
    wide = C.wide(df, sorted({*inputs, output}))
    from pyspark.sql import Window

    w = Window.partitionBy("epoch").orderBy("t")
    cols = [F.coalesce(F.lag(f"ch{c}", lag).over(w) if lag >= 0 else F.lead(f"ch{c}", -lag).over(w), F.lit(0.0)) for c in inputs for lag in lags]
    x = wide.select(*(c.alias(f"x{i}") for i, c in enumerate(cols)), F.col(f"ch{output}").alias("y"))
    n = len(cols)
    names = [f"x{i}" for i in range(n)] + ["y"]
    s = x.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:])).first()
    g = np.array([[s[f"x{min(i, j)}_x{max(i, j)}"] for j in range(n)] for i in range(n)])
    h = np.array([s[f"x{i}_y"] for i in range(n)])
    beta = np.linalg.solve(g + alpha * np.eye(n), h)
    return {"coef": beta.reshape(len(inputs), len(lags)), "r2": float((2 * beta @ h - beta @ g @ beta) / s["y_y"])}


def lof(df: DataFrame, k: int = 5) -> DataFrame:
    """ch, score: local outlier factors of channels, from their pairwise distances over all samples."""
    gram = df.groupBy("epoch", "t").agg(F.sort_array(F.collect_list(F.struct("ch", "value"))).alias("x"))
    pairs = gram.select(F.explode("x").alias("a"), "x").select("a", F.explode("x").alias("b")).groupBy(F.col("a.ch").alias("i"), F.col("b.ch").alias("j")).agg(F.sqrt(F.sum((F.col("a.value") - F.col("b.value")) ** 2)).alias("d"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(pdf["i"].unique())
        d = pdf.pivot(index="i", columns="j", values="d").loc[names, names].to_numpy().copy()
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, 1)[:, :k]
        reach = np.take_along_axis(d, near, 1)[:, -1]
        density = 1 / np.maximum(np.take_along_axis(d, near, 1), reach[near]).mean(1)
        return pd.DataFrame({"ch": names, "score": density[near].mean(1) / density})

    return pairs.groupBy(F.lit(1).alias("k")).applyInPandas(lambda pdf: run(pdf), "ch long, score double")  # channels x channels rows
