"""Positions in an ordered list, without sorting it as a whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: Sequence[str], bucket: Column, name: str = "row", keys: Sequence[str] = (), lag: str | None = None, lagged: str = "prev") -> DataFrame:
    """df with its position (from 0) in order among the rows of its keys, and with the value of lag in the row before.
    bucket: a number that does not fall as order goes on. Buckets are sorted by themselves; offsets, and the value that
    the bucket before ends with, go on from bucket to bucket in a table of one row a bucket."""
    keys = list(keys)
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    own = df.withColumn("_b", bucket)
    own = own.withColumn("_k", F.row_number().over(w) - 1)
    if lag:
        own = own.withColumn("_v", F.lag(lag).over(w))
    ends = own.groupBy(*keys, "_b").agg(F.count("*").alias("_n"), *([F.max_by(lag, F.struct(*order)).alias("_last")] if lag else []))
    at = Window.partitionBy(*keys).orderBy("_b") if keys else Window.orderBy("_b")
    ends = ends.select(*keys, F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), *([F.lag("_last").over(at).alias("_carry")] if lag else []))
    on = F.col("_b").eqNullSafe(F.col("_c"))
    for k in keys:
        ends = ends.withColumnRenamed(k, f"_of_{k}")
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    met = own.join(ends, on)
    out = met.withColumn(name, (F.col("_k") + F.col("_before")).cast("long"))
    if lag:
        out = out.withColumn(lagged, F.when(F.col("_k") == 0, F.col("_carry")).otherwise(F.col("_v")))
    return out.select(*df.columns, name, *([lagged] if lag else []))
