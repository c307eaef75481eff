"""Queries of covariance estimators and their held-out likelihood."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import covariance as C
from . import views as V
from .registry import query, r6

GRID = (0.01, 0.1, 0.5, 1.0)
#: With two channels, determinants and inverses have closed forms. Trials are dealt to three folds.
SCORES = f"""WITH x AS (SELECT a.epoch % 3 AS fold, a.value AS a, b.value AS b FROM epochs a JOIN epochs b USING (epoch, t) WHERE a.ch = 0 AND b.ch = 1),
s AS (SELECT fold, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum((a * a + b * b) ** 2) AS q FROM x GROUP BY fold),
tr AS (SELECT s.fold, s.aa / s.n AS taa, s.ab / s.n AS tab, s.bb / s.n AS tbb, sum(o.n) AS n, sum(o.aa) / sum(o.n) AS aa, sum(o.ab) / sum(o.n) AS ab, sum(o.bb) / sum(o.n) AS bb, sum(o.q) / sum(o.n) AS q FROM s JOIN s o ON o.fold <> s.fold GROUP BY ALL),
f AS (SELECT *, (aa + bb) / 2 AS mu, aa * aa + 2 * ab * ab + bb * bb AS size FROM tr),
g AS (SELECT *, (size - 2 * mu * (aa + bb) + 2 * mu * mu) / 2 AS far FROM f),
m AS (SELECT 'empirical' AS method, 0.0::DOUBLE AS parameter, 0.0::DOUBLE AS share, * FROM g
  UNION ALL SELECT 'ledoit_wolf', 0.0, least((q - size) / (2 * n), far) / far, * FROM g
  UNION ALL SELECT 'oas', 0.0, CASE WHEN size / 4 - mu * mu / 2 <= 0 THEN 1 ELSE least((size / 4 + mu * mu) / ((n + 1) * (size / 4 - mu * mu / 2)), 1) END, * FROM g
  UNION ALL SELECT 'shrunk', s, s, g.* FROM g, (SELECT unnest([{', '.join(map(str, GRID))}])::DOUBLE AS s)),
c AS (SELECT *, (1 - share) * aa + share * mu AS caa, (1 - share) * ab AS cab, (1 - share) * bb + share * mu AS cbb FROM m)
SELECT method, parameter, round(avg(-0.5 * ((taa * cbb - 2 * tab * cab + tbb * caa) / (caa * cbb - cab * cab) + ln(caa * cbb - cab * cab) + 2 * ln(2 * pi()))), 6) AS score FROM c GROUP BY method, parameter"""


@query("covariance_scores", SCORES, "epochs")
def _(spark, d):
    own = V.epochs(spark, d).filter("ch < 2")
    return C.scores(own, F.col("epoch") % 3, ("empirical", "ledoit_wolf", "oas", "shrunk"), shrinkages=GRID).withColumn("score", r6(F.col("score")))


@query("compute_covariance_auto")
def _(spark, d):
    """The estimator of the best held-out likelihood, of all channels; held against numpy in the tests."""
    found, _ = C.chosen(V.epochs(spark, d), F.col("epoch") % 3)
    return found.withColumn("value", r6(F.col("value")))
