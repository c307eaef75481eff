"""Infomax decomposition, plain and extended, by annealed natural-gradient steps.

Whitened samples are dealt to groups by a hash of their keys, so the dealing does not depend on partitions. In a round
each group starts from the same weights and goes through its own samples in blocks, in an order drawn from the
seed, the round and the group; the groups' weights are averaged by their sizes. What comes to the driver in a round is
one matrix a group. The step shrinks when rounds turn by more than a given angle; rounds end when weights hardly
change. Extended, the sign of a source's density follows its kurtosis, so flat sources are found beside peaked ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import channels as C
from .lineage import cut
from .models import matrix, whitener

#: Samples of a group at most (about), angle in degrees and shrinkage of steps, bias of signs, weights that are no weights.
GROUP, ANGLE, SHRINK, SIGN_BIAS, WILD = 200_000, 60.0, 0.9, 0.02, 1e8


def centred(df: DataFrame) -> DataFrame:
    own = df.groupBy("ch").agg(F.avg("value").alias("m"))
    return df.join(own, "ch").withColumn("value", F.col("value") - F.col("m")).drop("m")


def through_blocks(x: np.ndarray, w: np.ndarray, bias: np.ndarray, signs: np.ndarray | None, rate: float, block: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases after all whole blocks of x (samples x sources) in order. signs: of the densities, extended."""
    w, bias, eye = w.copy(), bias.copy(), block * np.eye(len(w))
    for at in range(0, len(x) - block + 1, block):
        u = x[order[at : at + block]] @ w.T + bias
        if signs is None:
            y = 1 - 2 / (1 + np.exp(-np.clip(u, -500, 500)))  # of the logistic density
            w += rate * (eye + y.T @ u) @ w
            bias += rate * y.sum(0)
        else:
            y = np.tanh(u)
            w += rate * (eye - signs[:, None] * (y.T @ u) - u.T @ u) @ w
            bias -= 2 * rate * y.sum(0)
        if not np.isfinite(w).all() or np.abs(w).max() > WILD:
            break
    return w, bias


def one_round(keys: tuple[str, ...], seed: int, round_: int, w: np.ndarray, bias: np.ndarray, signs: np.ndarray | None, rate: float, block: int):
    """A function of a group's rows: one row of its weights and biases (times its size), sums of squares and of fourth
    powers of its sources, and its size."""
    k = len(w)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), *((c, "ascending") for c in keys)])
        x = table["z"].combine_chunks().flatten().to_numpy().reshape(-1, k)
        order = np.random.default_rng([seed, round_, table["g"][0].as_py()]).permutation(len(x))
        new, b = through_blocks(x, w, bias, signs, rate, min(block, len(x)), order)
        u = x @ new.T
        made = np.concatenate([new.ravel() * len(x), b * len(x), (u**2).sum(0), (u**4).sum(0), [len(x)]])
        return pa.table([table["g"].slice(0, 1), pa.array([made.tolist()], pa.list_(pa.float64()))], ["g", "made"])

    return run


def infomax(df: DataFrame, n_channels: int, k: int, extended: bool = False, keys: tuple[str, ...] = ("epoch", "t"), rounds: int = 200, seed: int = 0, rate: float | None = None, block: int | None = None, tol: float = 1e-7) -> np.ndarray:
    """Unmixing rows (k x channels) of channels 0 to n_channels - 1, of mean 0 and without the least variances."""
    own = centred(df)
    white = whitener(matrix(C.covariance(own, keys), n_channels))[-k:]
    h = F.xxhash64(*keys, F.lit(seed))
    rows = C.mix(own, white.tolist(), keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ch", "value"))).alias("x"))
    z = cut(rows.select(h.alias("h"), *keys, F.col("x.value").alias("z")))
    n = z.count()
    groups = max(1, -(-n // GROUP))
    z = cut(z.withColumn("g", F.pmod("h", F.lit(groups))))
    rate = rate or 0.01 / math.log(max(k * k, 2))
    block = block or max(1, int(math.sqrt(n / groups / 3)))
    w, bias, signs, first, step = np.eye(k), np.zeros(k), np.ones(k) if extended else None, rate, None
    for round_ in range(rounds):
        parts = sorted(z.groupBy("g").applyInArrow(one_round(keys, seed, round_, w, bias, signs, rate, block), "g long, made array<double>").collect())  # a row a group
        made = np.sum([r["made"] for r in parts], axis=0)
        new, b = made[: k * k].reshape(k, k) / made[-1], made[k * k : k * k + k] / made[-1]
        if not np.isfinite(new).all() or np.abs(new).max() > WILD:
            # anew with shorter steps
            rate = first = first * SHRINK
            if first < 1e-10:
                raise ValueError("steps do not settle")
            w, bias, step, signs = np.eye(k), np.zeros(k), None, np.ones(k) if extended else None
            continue
        if extended:
            two, four = made[k * k + k : k * k + 2 * k], made[k * k + 2 * k : -1]
            signs = np.where(four * made[-1] / np.maximum(two * two, 1e-300) - 3 + SIGN_BIAS < 0, -1.0, 1.0)
        moved = new - w
        if step is not None:
            cosine = (moved * step).sum() / max(np.linalg.norm(moved) * np.linalg.norm(step), 1e-300)
            if math.degrees(math.acos(min(1.0, max(-1.0, cosine)))) > ANGLE:
                rate *= SHRINK
        w, bias, step = new, b, moved
        if (moved**2).sum() < tol * k:
            break
    return w @ white
