"""The driver's tables as the engine's canonical tables. See registry.VIEWS for the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epoch, condition, ch, t, value: a vector of 64 is 8 channels of 8 times."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    return df.select(F.col("vec_id").alias("epoch"), F.col("label").cast("long").alias("condition"), F.floor(F.col("i") / 8).alias("ch"), (F.col("i") % 8).cast("long").alias("t"), F.col("v").cast("double").alias("value"))


def codes(names: dict[str, int], other: int):
    out = None
    for name, code in names.items():
        out = F.when(F.col("event_type") == name, code) if out is None else out.when(F.col("event_type") == name, code)
    return out.otherwise(other).cast("long")


def seconds():
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ch, samp, value, code: each user's events in order are a channel's samples, those without a time or id last."""
    w = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("ch"), (F.row_number().over(w) - 1).cast("long").alias("samp"), "value", codes({"view": 0, "click": 1, "signup": 2, "purchase": 3}, 5).alias("code"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with samp: whole seconds since the first event."""
    df = table(spark, sf_dir, "events").withColumn("sec", seconds())
    first = df.agg(F.min("sec").alias("first"))
    return df.crossJoin(F.broadcast(first)).withColumn("samp", F.col("sec") - F.col("first")).drop("first", "sec")  # one row


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samp, prev_id, id, row: one event list, in order. Hours are sorted by themselves; numbers and codes go on."""
    df = timed(spark, sf_dir).withColumn("id", codes({"view": 1, "click": 2, "signup": 3, "purchase": 4}, 5)).select("ts", "event_id", "samp", "id")
    rows = numbered(df, ["ts", "event_id"], F.floor(F.col("samp") / 3600), lag="id", lagged="prev_id")
    return rows.select("samp", F.coalesce("prev_id", F.lit(0)).cast("long").alias("prev_id"), "id", "row")


def annots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, onset, duration, description, event_id; errors are bad segments."""
    df = timed(spark, sf_dir)
    return df.select(F.col("user_id").alias("rec"), F.col("samp").cast("double").alias("onset"), (F.floor("value") * 60).cast("double").alias("duration"), F.when(F.col("event_type") == "error", "BAD_error").otherwise(F.col("event_type")).alias("description"), "event_id")
