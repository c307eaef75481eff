"""Several predictors and two factors, against numpy."""

import numpy as np
from pyspark.sql import functions as F

from neurolattice.operators import stats as S


def test_many_predictors(spark):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((30, 3)), rng.standard_normal((30, 2, 2))
    rows = [(e, c, t, float(v), *map(float, x[e])) for (e, c, t), v in np.ndenumerate(y)]
    df = spark.createDataFrame(rows, "epoch long, ch long, t long, value double, p double, q double, r double")
    got = {(r["ch"], r["t"], r["name"]): (r["beta"], r["stderr"], r["t_value"]) for r in S.linear_regression_many(df, {n: F.col(n) for n in "pqr"}).collect()}
    inv = np.linalg.inv(x.T @ x)
    for (c, t), _ in np.ndenumerate(y[0]):
        b = inv @ x.T @ y[:, c, t]
        se = np.sqrt(((y[:, c, t] - x @ b) ** 2).sum() / 27 * np.diag(inv))
        for i, n in enumerate("pqr"):
            assert np.allclose(got[c, t, n], (b[i], se[i], b[i] / se[i]))
    assert len(got) == 12 and S.linear_regression_many(df.limit(0), {"p": F.col("p")}).count() == 0


def test_two_factors(spark):
    """Effects as tests of orthogonal contrasts of each subject's cells (two levels: squared paired t)."""
    rng = np.random.default_rng(2)
    v = rng.standard_normal((8, 2, 2))
    rows = [(s, a, b, 0, 0, float(x)) for (s, a, b), x in np.ndenumerate(v)]
    df = spark.createDataFrame(rows, "s long, a long, b long, ch long, t long, value double")
    got = {r["effect"]: r["f_value"] for r in S.anova_rm_two(df, "s", "a", "b").collect()}
    contrast = {"A": v[:, 0].sum(1) - v[:, 1].sum(1), "B": v[:, :, 0].sum(1) - v[:, :, 1].sum(1), "A:B": v[:, 0, 0] - v[:, 0, 1] - v[:, 1, 0] + v[:, 1, 1]}
    assert got.keys() == contrast.keys() and all(np.isclose(got[e], d.mean() ** 2 / (d.var(ddof=1) / 8)) for e, d in contrast.items())
    wide = rng.standard_normal((6, 3, 2))
    df = spark.createDataFrame([(s, a, b, 0, 0, float(x)) for (s, a, b), x in np.ndenumerate(wide)], "s long, a long, b long, ch long, t long, value double")
    two = {r["effect"]: r["f_value"] for r in S.anova_rm_two(df, "s", "a", "b").collect()}
    one = S.anova_rm(df, "s", "a").first()["f_value"]
    assert np.isclose(two["A"], one)
