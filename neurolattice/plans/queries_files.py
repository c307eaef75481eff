"""Queries over files that Spark writes from the tables: what readers give of them is what went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage
from ..sources import fiff, files, recordings, sinks
from . import views as V
from .registry import query, r6


def folder(spark) -> str:
    path = lineage.fresh(spark)
    system, inner = files.at(path)
    system.create_dir(inner, recursive=True)
    return path


def numbered(spark, d):
    """ch from 0 on, samp, value, and how many channels there are."""
    own = V.signal(spark, d).withColumn("ch", F.col("ch").cast("int"))
    return own, own.agg(F.max("ch")).first()[0] + 1


@query("read_raw_fif", "SELECT 'a.fif' AS rec, ch, 'CH' || ch AS ch_name, samp, value FROM signal", "signal")
def _(spark, d):
    """Split files of doubles; channels of different lengths leave samples without a value."""
    own, n = numbered(spark, d)
    path = f"{folder(spark)}/a.fif"
    fiff.export_fif(own, path, 10.0, [f"CH{i}" for i in range(n)], split_bytes=1 << 20, double=True)
    return recordings.read_raw(spark, path).filter(~F.isnan("value"))


#: 64 channels, one for each place of a trial; every one has a sample of every trial.
TRIALS = "SELECT (ch * 8 + t)::BIGINT AS ch, dense_rank() OVER (ORDER BY epoch) - 1 AS samp, value FROM epochs"


def trials(spark, d):
    """64 channels, one for each place of a trial; its samples are the trials, in order."""
    from ..operators.order import numbered as in_order

    own = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("epoch"), "embedding")
    rows = in_order(own, ["epoch"], F.floor(F.col("epoch") / 10000))
    return rows.select(F.col("row").alias("samp"), F.posexplode("embedding").alias("ch", "value"))


@query("export_brainvision", f"SELECT 'b.vhdr' AS rec, ch, 'P' || ch AS ch_name, samp, round(value::FLOAT::DOUBLE, 6) + 0.0 AS value FROM ({TRIALS})", "epochs")
def _(spark, d):
    path = f"{folder(spark)}/b"
    sinks.export_brainvision(trials(spark, d), path, 100.0, [f"P{i}" for i in range(64)])
    return recordings.read_raw(spark, f"{path}.vhdr").withColumn("value", r6(F.col("value")))


@query("export_edf", f"SELECT ch, count(*) AS n, 0::BIGINT AS far FROM ({TRIALS}) GROUP BY ch", "epochs")
def _(spark, d):
    """Samples of each channel and how many are further from what went in than a step of 16 bits of the channel's
    greatest value; the last record is filled up."""
    path, own = f"{folder(spark)}/c.edf", trials(spark, d)
    sinks.export_edf(own, path, 100, [f"P{i}" for i in range(64)])
    top = own.groupBy("ch").agg((F.max(F.abs("value")) / 32767 * 1.01).alias("step"))
    back = recordings.read_raw(spark, path).select("ch", "samp", F.col("value").alias("found"))
    far = F.count_if(F.abs(F.col("value") - F.col("found")) > F.col("step"))
    return own.join(back, ["ch", "samp"], "left").join(top, "ch").groupBy("ch").agg(F.count("found").alias("n"), far.cast("long").alias("far"))
