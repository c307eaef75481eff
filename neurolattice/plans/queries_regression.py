"""Queries of regression on events whose responses overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regression as R
from . import views as V
from .queries_blocks import RAW, raw
from .registry import query, r6

#: Lags of the two conditions. Trials begin every 8 samples, so responses overlap.
WINDOWS = {0: (-3, 9), 1: (0, 14)}
EVENTS = f"{RAW}, ev AS (SELECT DISTINCT r.rec, epoch * 8 + condition % 5 AS samp, condition % 2 AS condition, 1 + epoch % 3 AS value FROM epochs, (SELECT DISTINCT rec FROM raw) r)"
#: Every tenth trial does not count.
BAD = "raw.samp % 80 NOT BETWEEN 40 AND 47"


def design(windows: dict, where: str = "true") -> str:
    """SQL of x(rec, samp, condition, lag, x): the predictors that are not 0, at samples that count."""
    lags = " UNION ALL ".join(f"SELECT {c} AS condition, unnest(range({a}, {b})) AS lag" for c, (a, b) in windows.items())
    return f"x AS (SELECT raw.rec, raw.samp, ev.condition, lag, sum(ev.value) AS x FROM ev JOIN ({lags}) l ON l.condition = ev.condition JOIN (SELECT DISTINCT rec, samp FROM raw) raw ON raw.rec = ev.rec AND raw.samp = ev.samp + lag WHERE {where} GROUP BY ALL)"


def events(spark, d):
    own = V.epochs(spark, d)
    at = own.select((F.col("epoch") * 8 + F.col("condition") % 5).alias("samp"), (F.col("condition") % 2).alias("condition"), (1 + F.col("epoch") % 3).cast("double").alias("value")).distinct()
    return at.crossJoin(F.broadcast(raw(spark, d).select("rec").distinct()))  # the recordings, of which there are four


def bad(spark, d):
    return raw(spark, d).filter("samp % 80 = 40").select("rec", F.col("samp").alias("start"), (F.col("samp") + 8).alias("stop")).distinct()


@query("rerp_predictor_products", f"WITH {EVENTS}, {design(WINDOWS, BAD)} SELECT a.condition AS condition_i, a.lag AS lag_i, b.condition AS condition_j, b.lag AS lag_j, round(sum(a.x * b.x), 6) + 0.0::DOUBLE AS weight FROM x a JOIN x b ON a.rec = b.rec AND a.samp = b.samp GROUP BY ALL", "epochs")
def _(spark, d):
    """Products of lagged predictors, from pairs of events; in SQL from the design itself."""
    square, _ = R.normal_equations(raw(spark, d), events(spark, d), WINDOWS, bad(spark, d))
    return square.withColumn("weight", r6(F.col("weight")))


@query("rerp_channel_products", f"WITH {EVENTS}, {design(WINDOWS, BAD)} SELECT ch, condition, lag, round(sum(x * value), 6) + 0.0 AS weight FROM x JOIN raw ON raw.rec = x.rec AND raw.samp = x.samp GROUP BY ALL", "epochs")
def _(spark, d):
    _, right = R.normal_equations(raw(spark, d), events(spark, d), WINDOWS, bad(spark, d))
    return right.withColumn("weight", r6(F.col("weight")))


#: Two unknowns, solved by determinants.
TWO = {1: (1, 3)}


@query("linear_regression_raw_overlap", f"WITH {EVENTS}, {design(TWO)}, w AS (SELECT rec, samp, sum(x) FILTER (lag = 1) AS a, sum(x) FILTER (lag = 2) AS b FROM x GROUP BY ALL), s AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, coalesce(sum(a * b), 0) AS ab FROM w), y AS (SELECT ch, sum(a * value) AS ya, sum(b * value) AS yb FROM w JOIN raw ON raw.rec = w.rec AND raw.samp = w.samp GROUP BY ch) SELECT ch, 1::BIGINT AS condition, lag, round(CASE lag WHEN 1 THEN ya * bb - yb * ab ELSE yb * aa - ya * ab END / (aa * bb - ab * ab), 6) + 0.0 AS value FROM y, s, range(1, 3) r(lag)", "epochs")
def _(spark, d):
    return R.linear_regression_raw(raw(spark, d), events(spark, d), TWO).withColumn("value", r6(F.col("value")))


@query("linear_regression_raw_windows")
def _(spark, d):
    """Both conditions at all their lags; the solution is held against the dense one in the tests."""
    return R.linear_regression_raw(raw(spark, d), events(spark, d), WINDOWS, bad(spark, d)).withColumn("value", r6(F.col("value")))
