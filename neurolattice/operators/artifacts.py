"""Artifacts that repeat or stand out: scanner gradients, muscle activity; and event-matched spatial filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

#: Samples of a block in which runs are found before they are joined.
RUN_BLOCK = 1 << 16


def remove_gradient(samples: DataFrame, triggers: DataFrame, length: int, before: int = 4, after: int = 4) -> DataFrame:
    """samples: ch, samp, value; triggers: start, of volumes of length samples. Each volume has its line (by least
    squares) taken out, and the mean of the volumes around it (before and after, detrended, not itself) if it has
    as many on both sides. Samples outside of volumes stay, as do volumes that the recording does not hold whole; a
    sample in two volumes is taken from the later one."""
    if before < 0 or after < 0 or before + after == 0:
        raise ValueError("a template needs volumes")
    numbered = triggers.select("start").distinct().select("start", (F.row_number().over(Window.orderBy("start")) - 1).alias("volume"))  # one row a volume
    places = numbered.select("volume", F.explode(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.struct(k.cast("long").alias("place"), (F.col("start") + k).cast("long").alias("samp")))).alias("x")).select("volume", "x.*")
    own = samples.join(places, "samp")
    line = own.groupBy("ch", "volume").agg(F.regr_slope("value", "place").alias("slope"), F.avg("value").alias("m"), F.avg("place").alias("p"), F.count("*").alias("n")).filter(F.col("n") == length)
    flat = own.join(line, ["ch", "volume"]).withColumn("value", F.col("value") - F.col("m") - F.coalesce("slope", F.lit(0.0)) * (F.col("place") - F.col("p")))
    w = Window.partitionBy("ch", "place").orderBy("volume")  # as many rows as volumes
    near, many = F.lit(0.0), []
    for k, rows in ((before, w.rowsBetween(-before, -1)), (after, w.rowsBetween(1, after))):
        if k:
            near = near + F.coalesce(F.sum("value").over(rows), F.lit(0.0))
            many.append(F.count("*").over(rows) == k)
    enough = many[0] if len(many) == 1 else many[0] & many[1]
    fixed = flat.select("ch", "samp", "volume", (F.col("value") - F.when(enough, near / (before + after)).otherwise(0.0)).alias("value"))
    fixed = fixed.groupBy("ch", "samp").agg(F.max_by("value", "volume").alias("fixed"))
    return samples.join(fixed, ["ch", "samp"], "left").select("ch", "samp", F.coalesce("fixed", "value").alias("value"))


def muscle_scores(envelopes: DataFrame, rec: str = "rec") -> DataFrame:
    """rec, samp, score: the channels' z-scores, added up over the root of their number."""
    own = envelopes.groupBy(rec, "ch").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).filter("s > 0")
    z = envelopes.join(own, [rec, "ch"]).withColumn("z", (F.col("value") - F.col("m")) / F.col("s"))
    return z.groupBy(rec, "samp").agg((F.sum("z") / F.sqrt(F.count("*"))).alias("score"))


def smoothed(scores: DataFrame, sfreq: float, high: float = 4.0, rec: str = "rec", **where) -> DataFrame:
    """scores low-passed, as a single high sample is no activity."""
    own = scores.select(rec, "samp", F.col("score").alias("value"))
    return blocks.filter_data(own, sfreq, None, high, keys=(rec,), **where).withColumnRenamed("value", "score")


def bad_spans(scores: DataFrame, threshold: float, least_good: float, rec: str = "rec") -> DataFrame:
    """rec, start, stop (not included) of the samples whose score is above threshold, with good stretches of less
    than least_good samples, those at the ends of a recording too. Runs are found by block, then joined: what is
    sorted for a recording is one row a run of a block."""
    block = F.floor(F.col("samp") / RUN_BLOCK)
    w = Window.partitionBy(rec, "block").orderBy("samp")
    over = scores.filter(F.col("score") > threshold).select(rec, "samp", block.alias("block"))
    runs = over.withColumn("island", F.col("samp") - F.row_number().over(w)).groupBy(rec, "block", "island").agg(F.min("samp").alias("start"), (F.max("samp") + 1).alias("stop"))
    ends = blocks.bounds(scores, (rec,), "samp")
    runs = ends.join(runs, rec, "left")
    # a recording without a bad sample is one good stretch
    runs = runs.filter(F.col("start").isNotNull() | (F.col("last") + 1 - F.col("first") < least_good))
    start = F.when(F.col("start") - F.col("first") < least_good, F.col("first")).otherwise(F.col("start"))
    stop = F.when(F.col("last") + 1 - F.col("stop") < least_good, F.col("last") + 1).otherwise(F.col("stop"))
    runs = runs.select(rec, F.coalesce(start, "first").alias("start"), F.coalesce(stop, F.col("last") + 1).alias("stop"))
    order = Window.partitionBy(rec).orderBy("start")
    gap = F.col("start") - F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when((gap <= 0) | (gap < least_good), 0).otherwise(1)
    joined = runs.withColumn("new", new).withColumn("span", F.sum("new").over(order))
    return joined.groupBy(rec, "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("span")


def annotate_muscle(envelopes: DataFrame, sfreq: float, threshold: float = 4.0, least_good: float = 0.1, high: float = 4.0, rec: str = "rec", **where) -> DataFrame:
    """rec, start, stop of muscle activity. envelopes: rec, ch, samp, value, the amplitudes of band-passed channels
    (blocks.filter_data, then kernels.hilbert); samples in bad spans should be left out. least_good in seconds."""
    return bad_spans(smoothed(muscle_scores(envelopes, rec), sfreq, high, rec, **where), threshold, least_good * sfreq, rec)


def left_out(epochs: DataFrame, a: int, b: int, scale: bool) -> DataFrame:
    """epoch, condition, ch, t, value (over the deviation of all values, if scale), d: the difference of both
    conditions' means without the trial itself, from the sums less its own value."""
    two = epochs.filter(F.col("condition").isin(a, b)).select("epoch", "condition", "ch", "t", "value")
    if scale:
        spread = two.agg(F.stddev_pop("value").alias("spread"))
        two = two.crossJoin(F.broadcast(spread)).withColumn("value", F.col("value") / F.col("spread")).drop("spread")  # one row
    sums = two.groupBy("ch", "t").agg(*(f(F.when(F.col("condition") == c, F.col("value"))).alias(n + s) for c, s in ((a, "a"), (b, "b")) for f, n in ((F.sum, "s"), (F.count, "n"))))

    def mean(side: str, c: int):
        own = F.col("condition") == c
        return (F.col(f"s{side}") - F.when(own, F.col("value")).otherwise(0.0)) / (F.col(f"n{side}") - F.when(own, 1).otherwise(0))

    return two.join(sums, ["ch", "t"]).select("epoch", "condition", "ch", "t", "value", (mean("a", a) - mean("b", b)).alias("d"))


def ems(epochs: DataFrame, a: int, b: int, scale: bool = True) -> DataFrame:
    """epoch, condition, t, value: each trial seen through the difference of the other trials' means (condition a less
    b), scaled to length 1 over the channels at each time."""
    own = left_out(epochs, a, b, scale)
    return own.groupBy("epoch", "condition", "t").agg((F.sum(F.col("d") * F.col("value")) / F.sqrt(F.sum(F.col("d") ** 2))).alias("value"))


def ems_filters(epochs: DataFrame, a: int, b: int, scale: bool = True) -> DataFrame:
    """ch, t, weight: the mean of the trials' filters."""
    own = left_out(epochs, a, b, scale)
    size = own.groupBy("epoch", "t").agg(F.sqrt(F.sum(F.col("d") ** 2)).alias("size"))
    return own.join(size, ["epoch", "t"]).groupBy("ch", "t").agg(F.avg(F.col("d") / F.col("size")).alias("weight"))
