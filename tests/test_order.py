"""Positions by buckets are those of one sorted list."""

import random

import pytest
from pyspark.sql import functions as F

from neurolattice.operators.order import numbered


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_numbered(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("ab"), rng.randrange(200), i, rng.choice([None, 1, 2])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at long, i long, v long").repartition(5)
    got = {r["i"]: (r["row"], r["prev"]) for r in numbered(df, ["at", "i"], F.floor(F.col("at") / width), lag="v").collect()}
    order = sorted(rows, key=lambda r: r[1:3])
    assert got == {r[2]: (n, order[n - 1][3] if n else None) for n, r in enumerate(order)}
    got = {r["i"]: r["place"] for r in numbered(df, ["at", "i"], F.floor(F.col("at") / width), "place", ["k"]).collect()}
    assert got == {r[2]: n for k in "ab" for n, r in enumerate(x for x in order if x[0] == k)}
    assert numbered(df.limit(0), ["at"], F.col("at")).count() == 0
