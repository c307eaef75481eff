"""Overlapping responses: products and solutions equal those of the dense design."""

import numpy as np
import pytest

from neurolattice.operators import regression as R


def design(n, events, windows, order):
    """events: (sample, condition, value); samples x predictors."""
    x = np.zeros((n, len(order)))
    for s, c, v in events:
        if c in windows:
            for k in range(*windows[c]):
                if 0 <= s + k < n:
                    x[s + k, order.index((c, k))] += v
    return x


@pytest.fixture(scope="module", params=["plain", "values", "sparse"])
def case(request, spark):
    rng = np.random.default_rng(len(request.param))
    windows = {1: (-2, 7), 2: (0, 5), 3: (3, 6)}
    lengths = {0: 150, 1: 90}
    gap = 30 if request.param == "sparse" else 3
    events = {}
    for r, n in lengths.items():
        at = np.unique(np.concatenate([[0, n - 2], rng.choice(n, n // gap, replace=False)]))
        events[r] = [(int(s), int(rng.integers(1, 5)), float(rng.uniform(0.5, 2)) if request.param == "values" else 1.0) for s in at]
    order = [(c, k) for c, (a, b) in windows.items() for k in range(a, b)]
    x = {r: design(n, events[r], windows, order) for r, n in lengths.items()}
    y = {r: rng.standard_normal((n, 2)) for r, n in lengths.items()}
    samples = spark.createDataFrame([(r, c, i, float(v)) for r, m in y.items() for (i, c), v in np.ndenumerate(m)], "rec long, ch long, samp long, value double")
    table = spark.createDataFrame([(r, *e) for r, es in events.items() for e in es], "rec long, samp long, condition long, value double")
    return windows, order, x, y, samples, table if request.param == "values" else table.drop("value")


@pytest.mark.parametrize("spans", [None, [(0, 20, 33), (1, -5, 4), (1, 80, 200), (0, 30, 40)]])
def test_regression(spark, case, spans):
    windows, order, x, y, samples, events = case
    keep = {r: np.ones(len(m), bool) for r, m in x.items()}
    for r, a, b in spans or ():
        keep[r][max(a, 0) : b] = False
    exclude = spark.createDataFrame(spans, "rec long, start long, stop long") if spans else None
    big, out = np.concatenate([x[r][keep[r]] for r in x]), np.concatenate([y[r][keep[r]] for r in x])
    square, right = R.normal_equations(samples, events, windows, exclude)
    got = np.zeros((len(order),) * 2)
    for r in square.collect():
        got[order.index((r["condition_i"], r["lag_i"])), order.index((r["condition_j"], r["lag_j"]))] = r["weight"]
    assert np.allclose(got, big.T @ big)
    sums = np.zeros((len(order), 2))
    for r in right.collect():
        sums[order.index((r["condition"], r["lag"])), r["ch"]] = r["weight"]
    assert np.allclose(sums, big.T @ out)
    found = np.zeros((len(order), 2))
    for r in R.linear_regression_raw(samples, events, windows, exclude).collect():
        found[order.index((r["condition"], r["lag"])), r["ch"]] = r["value"]
    if np.linalg.matrix_rank(big) == len(order):
        assert np.allclose(found, np.linalg.lstsq(big, out, rcond=None)[0], atol=1e-7)
    assert np.allclose(big.T @ (big @ found - out), 0, atol=1e-6)


def test_responses_are_taken_apart(spark):
    """Two conditions whose responses overlap are recovered without noise; plain averages are not."""
    rng = np.random.default_rng(8)
    shape = {1: np.sin(np.arange(8)), 2: np.cos(np.arange(8) / 2)}
    at = np.cumsum(rng.integers(2, 6, 120))
    kinds = rng.integers(1, 3, 120)
    y = np.zeros(at[-1] + 10)
    for s, c in zip(at, kinds, strict=True):
        y[s : s + 8] += shape[c]
    samples = spark.createDataFrame([(0, 0, i, float(v)) for i, v in enumerate(y)], "rec long, ch long, samp long, value double")
    events = spark.createDataFrame([(0, int(s), int(c)) for s, c in zip(at, kinds, strict=True)], "rec long, samp long, condition long")
    for r in R.linear_regression_raw(samples, events, {1: (0, 8), 2: (0, 8)}).collect():
        assert abs(r["value"] - shape[r["condition"]][r["lag"]]) < 1e-8


@pytest.mark.parametrize("width", [1, 3, 12])
def test_solve_band(width):
    rng = np.random.default_rng(width)
    n = 12
    low = np.tril(rng.standard_normal((n, n))) * (np.subtract.outer(np.arange(n), np.arange(n)) < width)
    a = low @ low.T + 0.1 * np.eye(n)
    band = np.array([np.append(np.diag(a, -k), np.zeros(k)) for k in range(width)])
    b = rng.standard_normal((n, 2))
    assert np.allclose(R.solve_band(band, b), np.linalg.solve(a, b))
    band[:, 4] = 0
    for k in range(1, width):
        if 4 - k >= 0:
            band[k, 4 - k] = 0
    rest = [i for i in range(n) if i != 4]
    want = np.zeros((n, 2))
    want[rest] = np.linalg.solve(a[np.ix_(rest, rest)], b[rest])
    assert np.allclose(R.solve_band(band, b), want)


def test_empty(spark, case):
    windows, *_, samples, events = case
    assert R.linear_regression_raw(samples, events.limit(0), windows).count() == 0
    with pytest.raises(ValueError, match="unknowns"):
        R.linear_regression_raw(samples, events, {1: (0, 10_000)})
