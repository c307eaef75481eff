"""Regression of a continuous recording on events whose responses overlap.

A predictor is a condition at a lag: at sample s it has the values of that condition's events at s - lag. The
design (samples x predictors) is never made. What least squares needs of it are products:
  - of two predictors, the number of event pairs whose distance is the difference of their lags (weighted by
    the events' values), from one join of events that are less than a window apart. Predictors at samples that
    do not count (beyond the recording's ends, or excluded) are taken off again: only those are made;
  - of a predictor and a channel, a sum over event windows, from one join of events by lag with the samples.
The normal equations are a small table, banded by lag as far as events overlap, and are solved as a band.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import bounds

#: Most unknowns (conditions x lags) that are solved on the driver, and a pivot's least share of the largest one.
MOST, LEAST_PIVOT = 8_000, 1e-10


def predictors(events: DataFrame, windows: dict[object, tuple[int, int]]) -> DataFrame:
    """events with a condition in windows: rec, samp, condition, value, lo, hi (lags from lo to hi, not included)."""
    kind = dict(events.dtypes)["condition"]
    named = events.sparkSession.createDataFrame([(c, int(a), int(b)) for c, (a, b) in windows.items()], f"condition {kind}, lo long, hi long")  # one row a condition
    own = events if "value" in events.columns else events.withColumn("value", F.lit(1.0))
    return own.select("rec", F.col("samp").cast("long").alias("samp"), "condition", F.col("value").cast("double").alias("value")).join(F.broadcast(named), "condition")


def pairs(events: DataFrame, width: int) -> DataFrame:
    """condition_i, condition_j, distance (sample of i less that of j), weight: sums over pairs of events of a recording
    less than width apart, an event with itself too."""
    own = events.select("rec", "samp", "condition", "value").withColumn("bucket", F.floor(F.col("samp") / width))
    i = own.select("rec", F.explode(F.array(F.col("bucket") - 1, "bucket", F.col("bucket") + 1)).alias("bucket"), F.col("samp").alias("samp_i"), F.col("condition").alias("condition_i"), F.col("value").alias("value_i"))
    met = i.join(own, ["rec", "bucket"]).withColumn("distance", F.col("samp_i") - F.col("samp")).filter(F.abs("distance") < width)
    return met.groupBy("condition_i", F.col("condition").alias("condition_j"), "distance").agg(F.sum(F.col("value_i") * F.col("value")).alias("weight"))


def spread(events: DataFrame) -> DataFrame:
    """rec, samp (where the predictor is), condition, lag, value: each event at each of its lags."""
    return events.select("rec", F.col("samp").alias("onset"), "condition", "value", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("lag")).select("rec", (F.col("onset") + F.col("lag")).alias("samp"), "condition", "lag", "value")


def normal_equations(samples: DataFrame, events: DataFrame, windows: dict[object, tuple[int, int]], exclude: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """samples: rec, ch, samp, value; events: rec, samp, condition[, value]; exclude: rec, start, stop (samples that do
    not count). (condition_i, lag_i, condition_j, lag_j, weight) and (ch, condition, lag, weight): the products of
    predictors, as far as they are not 0, and of predictors with channels. Lag windows of conditions may differ."""
    own = predictors(events, windows)
    width = max(b for _, b in windows.values()) - min(a for a, _ in windows.values())
    ends = bounds(samples, ("rec",), "samp")
    own = own.join(ends, "rec")
    lags = own.sparkSession.createDataFrame([(c, int(k)) for c, (a, b) in windows.items() for k in range(a, b)], f"condition {dict(events.dtypes)['condition']}, lag long")  # one row an unknown
    a, b = (lags.select(F.col("condition").alias(f"condition_{x}"), F.col("lag").alias(f"lag_{x}")) for x in "ij")
    # both are at one sample where onset_i + lag_i = onset_j + lag_j
    whole = pairs(own, width).join(F.broadcast(a), "condition_i").withColumn("lag_j", F.col("lag_i") + F.col("distance")).join(F.broadcast(b), ["condition_j", "lag_j"])
    whole = whole.select("condition_i", "lag_i", "condition_j", "lag_j", "weight")
    beyond = own.filter((F.col("samp") + F.col("lo") < F.col("first")) | (F.col("samp") + F.col("hi") - 1 > F.col("last")))
    beyond = spread(beyond).join(ends, "rec").filter((F.col("samp") < F.col("first")) | (F.col("samp") > F.col("last"))).drop("first", "last")
    gone = None
    if exclude is not None:
        gone = exclude.join(ends, "rec").select("rec", F.explode(F.filter(F.sequence(F.greatest("start", "first"), F.least(F.col("stop") - 1, F.col("last"))), lambda s: (s >= F.col("start")) & (s < F.col("stop")))).alias("samp")).distinct()
        beyond = beyond.union(spread(own).join(gone, ["rec", "samp"]).select(beyond.columns))
    j = beyond.select("rec", "samp", F.col("condition").alias("condition_j"), F.col("lag").alias("lag_j"), F.col("value").alias("value_j"))
    off = beyond.join(j, ["rec", "samp"]).select(F.col("condition").alias("condition_i"), F.col("lag").alias("lag_i"), "condition_j", "lag_j", (-F.col("value") * F.col("value_j")).alias("weight"))
    keys = ["condition_i", "lag_i", "condition_j", "lag_j"]
    square = whole.union(off).groupBy(*keys).agg(F.sum("weight").alias("weight")).filter("weight != 0")
    data = samples if gone is None else samples.join(gone, ["rec", "samp"], "left_anti")
    met = spread(own).withColumnRenamed("value", "x").join(data.select("rec", "samp", "ch", "value"), ["rec", "samp"])
    return square, met.groupBy("ch", "condition", "lag").agg(F.sum(F.col("x") * F.col("value")).alias("weight"))


def solve_band(band: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of a symmetric, positive semidefinite system. band[k, i]: element (i + k, i). Unknowns without a
    pivot of their own are 0."""
    width, n = band.shape
    low, least = band.astype(float).copy(), LEAST_PIVOT * max(float(band[0].max(initial=0.0)), 1e-300)
    y = right.astype(float).copy()
    for i in range(n):
        m = min(width, n - i)
        if low[0, i] <= least:
            low[:, i] = 0.0
            continue
        low[0, i] = np.sqrt(low[0, i])
        low[1:m, i] /= low[0, i]
        column = low[1:m, i]
        for k in np.flatnonzero(column):
            low[: m - 1 - k, i + 1 + k] -= column[k] * column[k:]
    for i in range(n):
        m = min(width, n - i)
        y[i] = y[i] / low[0, i] if low[0, i] else 0.0
        y[i + 1 : i + m] -= low[1:m, i, None] * y[i]
    for i in range(n - 1, -1, -1):
        m = min(width, n - i)
        y[i] = (y[i] - low[1:m, i] @ y[i + 1 : i + m]) / low[0, i] if low[0, i] else 0.0
    return y


def linear_regression_raw(samples: DataFrame, events: DataFrame, windows: dict[object, tuple[int, int]], exclude: DataFrame | None = None) -> DataFrame:
    """ch, condition, lag, value: the least-squares response of each channel to each condition, overlaps accounted for.
    The unknowns, in the order of lags, and the channels' right sides come to the driver (at most MOST unknowns)."""
    unknowns = sorted((k, c) for c, (a, b) in windows.items() for k in range(a, b))
    if len(unknowns) > MOST:
        raise ValueError(f"{len(unknowns)} unknowns; at most {MOST} are solved")
    at = {(c, k): i for i, (k, c) in enumerate(unknowns)}
    square, right = normal_equations(samples, events, windows, exclude)
    cells = [(at[r[0], r[1]], at[r[2], r[3]], r[4]) for r in square.collect()]  # at most unknowns squared
    width = max((i - j for i, j, _ in cells), default=0) + 1
    band = np.zeros((width, len(unknowns)))
    for i, j, w in cells:
        if i >= j:
            band[i - j, j] = w
    sums: dict = {}
    for r in right.collect():  # channels x unknowns
        sums.setdefault(r["ch"], np.zeros(len(unknowns)))[at[r["condition"], r["lag"]]] = r["weight"]
    names = sorted(sums)
    kinds = dict(right.dtypes)
    found = solve_band(band, np.stack([sums[c] for c in names], 1)) if names else np.zeros((0, 0))
    rows = [(ch, c, k, float(found[i, n])) for n, ch in enumerate(names) for i, (k, c) in enumerate(unknowns)]
    return samples.sparkSession.createDataFrame(rows, f"ch {kinds['ch']}, condition {kinds['condition']}, lag long, value double")
