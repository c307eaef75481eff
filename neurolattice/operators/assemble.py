"""Operators that put recordings, trials, spectra and annotations together, and take parts of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import annotations as A


def concatenate_raws(samples: DataFrame, rec: str = "rec") -> DataFrame:
    """ch, samp, value of all recordings one after the other, in the order of rec. Each recording's
    length is one row, so only those are sorted as a whole; samples meet their offset by a join."""
    lengths = samples.groupBy(rec).agg((F.max("samp") + 1).alias("length"))
    before = Window.orderBy(rec).rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select(rec, F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return samples.join(offsets, rec).withColumn("samp", F.col("samp") + F.col("offset")).drop("offset")


def boundaries(samples: DataFrame, rec: str = "rec") -> DataFrame:
    """onset and description of the places where concatenate_raws joins two recordings."""
    lengths = samples.groupBy(rec).agg((F.max("samp") + 1).alias("length"))
    before = Window.orderBy(rec).rowsBetween(Window.unboundedPreceding, -1)
    return lengths.select(F.sum("length").over(before).alias("onset")).filter("onset IS NOT NULL").select("onset", F.explode(F.array(F.lit("BAD boundary"), F.lit("EDGE boundary"))).alias("description"))


def numbered(epochs: DataFrame, by: str) -> DataFrame:
    """epoch, item: the trials of each set counted from 0. Only the list of trials is sorted."""
    trials = epochs.select(by, "epoch").distinct()
    return trials.withColumn("item", (F.row_number().over(Window.partitionBy(by).orderBy("epoch")) - 1).cast("long"))


def concatenate_epochs(epochs: DataFrame, part: str) -> DataFrame:
    """Trials of the parts one after the other, numbered on from 0: epoch is the new number."""
    items = numbered(epochs, part)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = items.groupBy(part).agg(F.count("*").alias("n")).select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    new = items.join(F.broadcast(offsets), part).select(part, "epoch", (F.col("item") + F.col("offset")).alias("new"))  # one row a part
    return epochs.join(new, [part, "epoch"]).withColumn("epoch", F.col("new")).drop("new")


def epoch_items(epochs: DataFrame, start: int = 0, stop: int | None = None, step: int = 1, by: str = "condition") -> DataFrame:
    """The trials [start:stop:step] of each set; bounds count from the front."""
    items = numbered(epochs, by).filter(F.col("item") >= start).filter((F.col("item") - start) % step == 0)
    if stop is not None:
        items = items.filter(F.col("item") < stop)
    return epochs.join(items.select("epoch"), "epoch", "left_semi")


def drop_epochs(epochs: DataFrame, which: DataFrame, reason: str = "USER") -> tuple[DataFrame, DataFrame]:
    """(the trials that are not in which, the log: epoch and reason of the dropped ones)."""
    gone = epochs.select("epoch").distinct().join(which.select("epoch").distinct(), "epoch", "left_semi")
    return epochs.join(which.select("epoch").distinct(), "epoch", "left_anti"), gone.withColumn("reason", F.lit(reason))


def add_channels(own: DataFrame, other: DataFrame, keys: Sequence[str] = ("epoch", "t")) -> DataFrame:
    """own and the channels of other that lie at own's times; a channel of both is taken from own."""
    times, names = own.select(*keys).distinct(), own.select("ch").distinct()
    return own.unionByName(other.join(times, list(keys), "left_semi").join(names, "ch", "left_anti").select(*own.columns))


def match_channel_orders(channels: DataFrame, order: DataFrame, by: str) -> DataFrame:
    """channels (by, ch, place) with the places that order (ch, place) gives, for common channels."""
    common = channels.select(by, "ch").join(order.select("ch", F.col("place").alias("wanted")), "ch")
    return common.select(by, "ch", (F.row_number().over(Window.partitionBy(by).orderBy("wanted")) - 1).cast("long").alias("place"))


def raw_items(samples: DataFrame, channels: Sequence[int], start: int, stop: int, step: int = 1) -> DataFrame:
    """The given channels at the samples [start:stop:step]."""
    at = F.col("samp")
    return samples.filter(F.col("ch").isin(list(channels)) & (at >= start) & (at < stop) & ((at - start) % step == 0))


def combine_spectra(spectra: DataFrame, keys: Sequence[str], weights: str = "nave") -> DataFrame:
    """One spectrum (or time-frequency power) of several with nave: weighted by it, or all equal."""
    w = F.col("nave") if weights == "nave" else F.lit(1.0)
    return spectra.groupBy(*keys).agg((F.sum(w * F.col("power")) / F.sum(w)).alias("power"), F.sum("nave").alias("nave"))


def regularize(cov: DataFrame, amounts: dict[str, float], kind: Column) -> DataFrame:
    """ch_i, ch_j, value, n with the given share of a kind's mean variance added to its variances."""
    own = cov.withColumn("kind", kind)
    mean = own.filter("ch_i = ch_j").groupBy("kind").agg(F.avg("value").alias("level"))
    share = F.element_at(F.create_map(*(x for k, v in amounts.items() for x in (F.lit(k), F.lit(float(v))))), F.col("kind"))
    more = F.when(F.col("ch_i") == F.col("ch_j"), F.coalesce(share, F.lit(0.0)) * F.col("level")).otherwise(0.0)
    return own.join(F.broadcast(mean), "kind").select("ch_i", "ch_j", (F.col("value") + more).alias("value"), "n")  # one row a kind


def rename_annotations(annots: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return annots.replace(mapping, subset=["description"])


def set_durations(annots: DataFrame, durations: dict[str, float]) -> DataFrame:
    new = F.element_at(F.create_map(*(x for k, v in durations.items() for x in (F.lit(k), F.lit(float(v))))), F.col("description"))
    return annots.withColumn("duration", F.coalesce(new, F.col("duration")))


def annotations_frame(annots: DataFrame, start: Column) -> DataFrame:
    """onset as a time: microseconds after start (a timestamp)."""
    return annots.withColumn("onset", F.timestamp_micros(F.unix_micros(start) + F.round(F.col("onset") * 1_000_000).cast("long")))


def annotations_in_metadata(epochs: DataFrame, annots: DataFrame, width: float = 600.0) -> DataFrame:
    """rec, epoch and the sorted descriptions of the annotations that touch it, empty where none does.
    epochs: rec, epoch, zero, start, stop."""
    hit = A.annotations_per_epoch(epochs, annots, width)
    found = hit.groupBy("rec", "epoch").agg(F.array_join(F.array_sort(F.collect_set("description")), ",").alias("descriptions"))
    return epochs.select("rec", "epoch").join(found, ["rec", "epoch"], "left").fillna("", ["descriptions"])


def add_events(stim: DataFrame, events: DataFrame, replace: bool = False) -> DataFrame:
    """ch, samp, code with the events' ids added to, or in place of, the code at their sample."""
    ids = events.groupBy("ch", "samp").agg(F.sum("id").alias("id"))
    base = F.lit(0) if replace else F.col("code")
    return stim.join(ids, ["ch", "samp"], "left").withColumn("code", base + F.coalesce("id", F.lit(0))).drop("id")


def vectorize(epochs: DataFrame) -> DataFrame:
    """epoch and all its values in order of channel and time: one row of features."""
    rows = epochs.groupBy("epoch").agg(F.sort_array(F.collect_list(F.struct("ch", "t", "value"))).alias("x"))
    return rows.select("epoch", F.col("x.value").alias("features"))


def unvectorize(rows: DataFrame, n_times: int) -> DataFrame:
    """vectorize backwards."""
    own = rows.select("epoch", F.posexplode("features").alias("i", "value"))
    return own.select("epoch", F.floor(F.col("i") / n_times).alias("ch"), (F.col("i") % n_times).cast("long").alias("t"), "value")


def score_sources(sources: DataFrame, target: DataFrame, keys: Sequence[str] = ("epoch", "t")) -> DataFrame:
    """ch, score: the correlation of each source with the target (keys, target)."""
    return sources.join(target, list(keys)).groupBy("ch").agg(F.corr("value", "target").alias("score"))


def outliers(scores: DataFrame, threshold: float, rounds: int = 2) -> DataFrame:
    """ch, score, bad: z-scores beyond the threshold, found again without those found before. Masks are
    columns of one row a source, so a round is one window over that many rows."""
    out = scores.withColumn("bad", F.lit(False))
    whole = Window.partitionBy()
    for _ in range(rounds):
        kept = F.when(~F.col("bad"), F.col("score"))
        z = (F.col("score") - F.avg(kept).over(whole)) / F.stddev_pop(kept).over(whole)
        out = out.withColumn("bad", F.col("bad") | F.coalesce(F.abs(z) > threshold, F.lit(False)))
    return out


def kuiper(samples: DataFrame, keys: Sequence[str] = ("ch", "t")) -> DataFrame:
    """keys, statistic: Kuiper's, of phases (phase, in parts of a turn) against an even spread."""
    w = Window.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy("phase")), F.count("*").over(w)
    parts = samples.select(*keys, (i / n - F.col("phase")).alias("up"), (F.col("phase") - (i - 1) / n).alias("down"))
    return parts.groupBy(*keys).agg((F.max("up") + F.max("down")).alias("statistic"))


def simulate(events: DataFrame, waveform: Sequence[float]) -> DataFrame:
    """ch, samp, value: a waveform laid down at each event (ch, samp, amplitude), overlaps added."""
    wave = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(float(v)).alias("v")) for i, v in enumerate(waveform)))
    own = events.withColumn("w", F.explode(wave))
    return own.groupBy("ch", (F.col("samp") + F.col("w.i")).alias("samp")).agg(F.sum(F.col("amplitude") * F.col("w.v")).alias("value"))


def transform_points(points: DataFrame, trans: Sequence[Sequence[float]]) -> DataFrame:
    """id, x, y, z under a 4 x 4 matrix of a rotation and a shift."""
    new = {n: F.col("x") * r[0] + F.col("y") * r[1] + F.col("z") * r[2] + r[3] for n, r in zip("xyz", trans[:3], strict=True)}
    return points.withColumns(new)


def labels_to_stc(members: DataFrame, values: DataFrame) -> DataFrame:
    """vertex, t, value: each label's course (label, t, value) at its vertices (label, vertex), summed where labels share
    one. Courses are summed once for each set of labels that vertices have, so no aggregate holds vertices by times."""
    # dealt by vertex first: a task that reads many members does not gather all their vertices
    own = members.repartition("vertex").groupBy("vertex").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    sets = own.select("labels").distinct().select("labels", F.explode("labels").alias("label"))
    sums = sets.join(values, "label").groupBy("labels", "t").agg(F.sum("value").alias("value"))
    courses = sums.groupBy("labels").agg(F.collect_list(F.struct("t", "value")).alias("course"))
    return own.join(courses, "labels").select("vertex", F.explode("course").alias("c")).select("vertex", "c.t", "c.value")
