"""Covariance estimators against numpy, fold by fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurolattice.operators import covariance as C


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(6)
    return rng.standard_normal((90, 2)) @ rng.standard_normal((2, 5)) + rng.standard_normal((90, 5)) * [0.2, 0.4, 0.6, 0.3, 0.5]


@pytest.fixture(scope="module")
def table(spark, x):
    return spark.createDataFrame([(i // 3, i % 3, c, float(v)) for (i, c), v in np.ndenumerate(x)], "epoch long, t long, ch long, value double").repartition(4)


def fold():
    return F.col("epoch") % 3


def folds(x):
    k = np.arange(90) // 3 % 3
    return [(x[k != f], x[k == f]) for f in range(3)]


def logpdf(test, cov):
    return np.mean([-0.5 * (r @ np.linalg.inv(cov) @ r + np.log(np.linalg.det(2 * np.pi * cov))) for r in test])


def test_covariance_with_gaps(spark, table, x):
    got = {(r["ch_i"], r["ch_j"]): (r["value"], r["n"]) for r in C.covariance(table).collect()}
    want = np.cov(x.T)
    assert all(np.isclose(v, want[k]) and n == 90 for k, (v, n) in got.items()) and len(got) == 25
    few = table.filter("NOT (ch = 1 AND epoch < 10)")  # a channel that some samples lack
    got = {(r["ch_i"], r["ch_j"]): (r["value"], r["n"]) for r in C.covariance(few).collect()}
    assert got[1, 2][1] == 60 and np.isclose(got[1, 2][0], np.cov(x[30:].T)[1, 2]) and got[0, 2][1] == 90
    named = table.withColumn("ch", F.concat(F.lit("EEG"), "ch"))
    assert {(r["ch_i"], r["ch_j"]): r["n"] for r in C.covariance(named).collect()} == {(f"EEG{i}", f"EEG{j}"): 90 for i in range(5) for j in range(5)}
    assert C.covariance(table.limit(0)).count() == 0


def ledoit(x):
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum()
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / n**2, d2)
    return (1 - b2 / d2) * s + b2 / d2 * mu * np.eye(p)


def test_scores(table, x):
    got = {(r["method"], r["parameter"]): r["score"] for r in C.scores(table, fold(), shrinkages=(0.01, 0.3), components=[1, 2]).collect()}
    assert len(got) == 9
    for name, estimate in {
        ("empirical", 0.0): lambda y: y.T @ y / len(y), ("ledoit_wolf", 0.0): ledoit,
        ("shrunk", 0.3): lambda y: 0.7 * y.T @ y / len(y) + 0.3 * np.trace(y.T @ y / len(y)) / 5 * np.eye(5),
    }.items():
        assert np.isclose(got[name], np.mean([logpdf(b, estimate(a)) for a, b in folds(x)])), name


def test_low_rank(x):
    s = x.T @ x / 90
    for k in (1, 2, 3):
        w, u = np.linalg.eigh(s)
        made = C.principal(s, k)
        v = np.linalg.eigvalsh(made)
        assert np.allclose(v[::-1][:k], w[::-1][:k]) and np.allclose(v[: 5 - k], w[: 5 - k].mean())
    made = C.factors(s, 2)
    assert C.likelihood(s, made) > C.likelihood(s, C.principal(s, 2)) and np.allclose(np.diag(made), np.diag(s), rtol=1e-3)
    rng = np.random.default_rng(1)
    truth = rng.standard_normal((8, 2))
    truth = truth @ truth.T + np.diag(rng.uniform(0.5, 2, 8))
    assert np.allclose(C.factors(truth, 2, 20_000, 1e-13), truth, atol=0.02)  # a model of two factors is found again
    for _ in range(20):  # no small change of the noise is likelier
        other = made + np.diag(rng.standard_normal(5) * 0.01)
        assert C.likelihood(s, other) < C.likelihood(s, made) + 1e-6


def test_choice(spark, table, x):
    found, (method, parameter, score) = C.chosen(table, fold())
    rows = sorted(((r["score"], r["method"], r["parameter"]) for r in C.scores(table, fold()).collect()), reverse=True)
    assert np.isclose(rows[0][0], score) and (method, parameter) == rows[0][1:]
    assert method in ("factor_analysis", "pca", "shrunk", "ledoit_wolf", "oas")
    cov = np.zeros((5, 5))
    for r in found.collect():
        cov[r["ch_i"], r["ch_j"]] = r["value"]
    assert np.allclose(cov, cov.T) and np.linalg.eigvalsh(cov).min() > 0
    with pytest.raises(ValueError, match="two folds"):
        C.scores(table, F.lit(0))
    with pytest.raises(ValueError, match="unknown"):
        C.scores(table, fold(), ("other",))
