"""Infomax finds mixed sources again, of both kinds if extended, and reruns agree."""

import numpy as np
import pytest

from neurolattice.operators import infomax as I


def table(spark, x, parts):
    rows = [(i // 50, i % 50, c, float(v)) for (c, i), v in np.ndenumerate(x)]
    return spark.createDataFrame(rows, "epoch long, t long, ch long, value double").repartition(parts)


def recovered(unmix, mixing):
    """The largest share of another source in a row, over its own."""
    p = np.abs(unmix @ mixing)
    p = p / p.max(1, keepdims=True)
    assert len(set(p.argmax(1))) == len(p)
    return np.sort(p, 1)[:, -2].max()


@pytest.mark.parametrize("extended", [False, True])
def test_infomax(spark, monkeypatch, extended):
    rng = np.random.default_rng(3)
    n = 3_000
    sources = rng.laplace(size=(3, n))
    if extended:
        sources[1] = rng.uniform(-1, 1, n)
        sources[2] = np.sin(np.arange(n) * 0.37)
    mixing = rng.standard_normal((3, 3)) + np.eye(3)
    monkeypatch.setattr(I, "GROUP", 1_600)  # two groups
    one = I.infomax(table(spark, mixing @ sources, 2), 3, 3, extended, rounds=60, rate=0.01)
    assert recovered(one, mixing) < 0.12
    again = I.infomax(table(spark, mixing @ sources, 5), 3, 3, extended, rounds=60, rate=0.01)
    assert np.allclose(one, again, atol=1e-6)


def test_steps():
    """One block is one natural-gradient step; wild steps are given up."""
    rng = np.random.default_rng(1)
    x, w = rng.standard_normal((10, 2)), rng.standard_normal((2, 2))
    u = x @ w.T
    got, bias = I.through_blocks(x, w, np.zeros(2), None, 0.01, 10, np.arange(10))
    y = 1 / (1 + np.exp(-u))
    assert np.allclose(got, w + 0.01 * (10 * np.eye(2) + (1 - 2 * y).T @ u) @ w) and np.allclose(bias, 0.01 * (1 - 2 * y).sum(0))
    got, _ = I.through_blocks(x, w, np.zeros(2), np.array([1.0, -1.0]), 0.01, 10, np.arange(10))
    assert np.allclose(got, w + 0.01 * (10 * np.eye(2) - np.diag([1.0, -1.0]) @ np.tanh(u).T @ u - u.T @ u) @ w)
    assert np.abs(I.through_blocks(np.tile(x, (50, 1)) * 1e3, w, np.zeros(2), None, 1e3, 10, np.arange(500))[0]).max() > 1e8
