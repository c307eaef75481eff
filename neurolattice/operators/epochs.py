"""Operators on trials: cutting, rejection, baseline, averages. Long form: epoch, condition, ch, t, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def from_events(samples: DataFrame, events: DataFrame, low: int, high: int) -> DataFrame:
    """ch, event, ..., t, value around each event. Windows are exploded into sample numbers and met by
    an equi-join; windows that leave the recording are dropped."""
    wanted = events.withColumn("t", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("samp", F.col("event") + F.col("t"))
    cut = wanted.join(samples, ["ch", "samp"])
    whole = F.count("*").over(Window.partitionBy("ch", "event"))
    return cut.withColumn("n", whole).filter(F.col("n") == high - low + 1).select(*events.columns, F.col("t").cast("long").alias("t"), "value")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row at or before it: a union and one window."""
    a = left.select(*keys, on, *(F.lit(None).alias(v) for v in values), F.lit(1).alias("side"), F.struct(*left.columns).alias("own"))
    b = right.select(*keys, on, *values, F.lit(0).alias("side")).withColumn("own", F.lit(None).cast(a.schema["own"].dataType))
    w = Window.partitionBy(*keys).orderBy(on, "side")
    filled = b.unionByName(a).withColumns({v: F.last(v, True).over(w) for v in values})
    return filled.filter("side = 1").select("own.*", *values)


def time_mask(time: Column, tmin: float | None, tmax: float | None, sfreq: float, include_tmax: bool = True) -> Column:
    """Whole samples from tmin to tmax, with half a sample's tolerance."""
    out = F.lit(True)
    if tmin is not None:
        out = out & (F.rint(time * sfreq) >= round(tmin * sfreq))
    if tmax is not None:
        last = round(tmax * sfreq)
        out = out & ((F.rint(time * sfreq) <= last) if include_tmax else (F.rint(time * sfreq) < last))
    return out


def decimate(df: DataFrame, by: int, zero: int = 0, offset: int = 0) -> DataFrame:
    """Every by-th sample, aligned to sample number zero."""
    return df.filter(F.pmod(F.col("t") - (zero % by + offset), by) == 0)


def peak_to_peak(epochs: DataFrame) -> DataFrame:
    return epochs.groupBy("epoch", "ch").agg((F.max("value") - F.min("value")).alias("p2p"))


def drop_log(epochs: DataFrame, reject: float | None, flat: float | None, bads: tuple[int, ...] = ()) -> DataFrame:
    """epoch, bad: the sorted channels whose range is over reject or under flat; bad channels never count."""
    p2p = peak_to_peak(epochs.filter(~F.col("ch").isin(list(bads))) if bads else epochs)
    test = F.lit(False)
    if reject is not None:
        test = test | (F.col("p2p") > reject)
    if flat is not None:
        test = test | (F.col("p2p") < flat)
    return p2p.groupBy("epoch").agg(F.sort_array(F.collect_list(F.when(test, F.col("ch")))).alias("bad"))  # at most the channels


def reject_epochs(epochs: DataFrame, reject: float | None, flat: float | None, bads: tuple[int, ...] = ()) -> DataFrame:
    bad = drop_log(epochs, reject, flat, bads).filter(F.size("bad") > 0)
    return epochs.join(bad.select("epoch"), "epoch", "left_anti")


def apply_baseline(df: DataFrame, keys: list[str], low: int, high: int, mode: str = "mean") -> DataFrame:
    """value rescaled by the mean of the times low to high of the same keys, ends included.

    The standard deviation of zscore and zlogratio is that of the rescaled values, with n in the
    denominator; a shift does not change it, a logarithm does, so each mode has its own formula."""
    inside = F.when((F.col("t") >= low) & (F.col("t") <= high), F.col("value"))
    w = Window.partitionBy(*keys)
    m = F.avg(inside).over(w)
    v = F.col("value")
    if mode == "zlogratio":
        logged = df.withColumn("value", F.log10(v / m))
        spread = F.stddev_pop(F.when((F.col("t") >= low) & (F.col("t") <= high), F.col("value"))).over(w)
        return logged.withColumn("value", F.col("value") / spread)
    out = {"mean": v - m, "ratio": v / m, "logratio": F.log10(v / m), "percent": (v - m) / m, "zscore": (v - m) / F.stddev_pop(inside).over(w)}[mode]
    return df.withColumn("value", out)


def average(epochs: DataFrame, by: tuple[str, ...] = ("condition",), method: str = "mean") -> DataFrame:
    value = F.avg("value") if method == "mean" else F.median("value")
    return epochs.groupBy(*by, "ch", "t").agg(value.alias("value"), F.count("*").alias("nave"))


def standard_error(epochs: DataFrame, by: tuple[str, ...] = ("condition",)) -> DataFrame:
    return epochs.groupBy(*by, "ch", "t").agg((F.stddev_pop("value") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("nave"))


def subtract_evoked(epochs: DataFrame) -> DataFrame:
    """value less its (ch, t) mean; the small means are joined, so no channel's trials meet in one task."""
    mean = epochs.groupBy("ch", "t").agg(F.avg("value").alias("m"))
    return epochs.join(mean, ["ch", "t"]).withColumn("value", F.col("value") - F.col("m")).drop("m")


def combine_evoked(evoked: DataFrame, weights: dict[int, float] | str) -> DataFrame:
    """Sum of weighted averages; nave is 1 over the sum of weight^2 / nave. weights: by condition, "nave" or "equal"."""
    sets = evoked.select("condition", "nave").distinct()
    if weights == "nave":
        weigh = sets.crossJoin(F.broadcast(sets.agg(F.sum("nave").alias("all")))).select("condition", (F.col("nave") / F.col("all")).alias("w"))  # one row
    elif weights == "equal":
        weigh = sets.crossJoin(F.broadcast(sets.agg(F.count("*").alias("all")))).select("condition", (1.0 / F.col("all")).alias("w"))  # one row
    else:
        pairs = [x for k, w in weights.items() for x in (F.lit(k).cast("long"), F.lit(float(w)))]
        weigh = sets.select("condition", F.element_at(F.create_map(*pairs), F.col("condition")).alias("w")).filter("w IS NOT NULL")
    return evoked.join(weigh, "condition").groupBy("ch", "t").agg(F.sum(F.col("w") * F.col("value")).alias("value"), (1 / F.sum(F.col("w") * F.col("w") / F.col("nave"))).alias("nave"))


def grand_average(evoked: DataFrame, bads: DataFrame | None = None) -> DataFrame:
    """Equal-weight mean over subjects (condition), on the channels that none has marked bad and all have."""
    if bads is not None:
        evoked = evoked.join(bads.select("ch").distinct(), "ch", "left_anti")
    n = evoked.select("condition").distinct().agg(F.count("*").alias("all"))
    out = evoked.groupBy("ch", "t").agg(F.avg("value").alias("value"), F.count("*").alias("nave"))
    return out.crossJoin(F.broadcast(n)).filter("nave = all").drop("all")  # one row


def get_peak(evoked: DataFrame, mode: str = "abs", by: tuple[str, ...] = ("condition",)) -> DataFrame:
    """The channel and time of the largest |value|, value or -value; of equal ones, the first."""
    score = {"abs": F.abs("value"), "pos": F.col("value"), "neg": -F.col("value")}[mode]
    best = F.max(F.struct(score.alias("score"), (-F.col("ch")).alias("c"), (-F.col("t")).alias("u"), F.col("value").alias("v"))).alias("b")
    return evoked.groupBy(*by).agg(best).select(*by, (-F.col("b.c")).alias("ch"), (-F.col("b.u")).alias("t"), F.col("b.v").alias("value"))


def standardized_measurement_error(epochs: DataFrame, low: int, high: int) -> DataFrame:
    inner = epochs.filter(F.col("t").between(low, high)).groupBy("epoch", "condition", "ch").agg(F.avg("value").alias("m"))
    return inner.groupBy("condition", "ch").agg((F.stddev_pop("m") / F.sqrt(F.count("*"))).alias("sme"))


def global_field_power(evoked: DataFrame) -> DataFrame:
    return evoked.groupBy("condition", "t").agg(F.stddev_pop("value").alias("gfp"), F.sqrt(F.avg(F.col("value") ** 2)).alias("rms"))


def evoked_average(epochs: DataFrame, reject: float, low: int, high: int) -> DataFrame:
    """The flagship: reject by range, correct the baseline, average with standard errors, in one grouping."""
    good = apply_baseline(reject_epochs(epochs, reject, None), ["epoch", "ch"], low, high)
    return good.groupBy("condition", "ch", "t").agg(F.avg("value").alias("value"), (F.stddev_pop("value") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("nave"))
