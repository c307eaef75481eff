"""Operators on annotated intervals: rec, onset, duration, description, and a row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import bucketed

PARTS = 64  # that recordings are dealt to


def is_bad(description: Column, kinds: tuple[str, ...] = ("bad", "edge")) -> Column:
    out = F.lit(False)
    for kind in kinds:
        out = out | F.lower(description).startswith(kind)
    return out


def overlap_join(left: DataFrame, right: DataFrame, width: float) -> DataFrame:
    """left: rec, start, stop...; right: rec, onset, duration...: pairs of one recording that overlap.
    Both sides are dealt into buckets of the width; a pair counts in the first bucket that both touch."""
    a = bucketed(left, F.col("start"), F.col("stop"), width)
    b = bucketed(right.withColumn("end", F.col("onset") + F.col("duration")), F.col("onset"), F.col("onset") + F.col("duration"), width)
    first = F.greatest(F.floor(F.col("start") / width), F.floor(F.col("onset") / width)) == F.col("bucket")
    return a.join(b, ["rec", "bucket"]).filter(first).drop("bucket")


def annotations_per_epoch(epochs: DataFrame, annots: DataFrame, width: float = 600.0) -> DataFrame:
    """epochs: rec, epoch, zero, start, stop. One row per overlap, with the onset relative to zero."""
    s, e, a, z = F.col("start"), F.col("stop"), F.col("onset"), F.col("end")
    cases = ((s >= a) & (s < z)) | ((e > a) & (e <= z)) | ((s <= a) & (e >= z))
    return overlap_join(epochs, annots, width).filter(cases).select("rec", "epoch", (a - F.col("zero")).alias("onset"), "duration", "description")


def reject_by_annotation(epochs: DataFrame, annots: DataFrame, width: float = 600.0) -> DataFrame:
    """Epochs that no bad interval overlaps; intervals are half-open."""
    bad = annots.filter(is_bad(F.col("description"), ("bad",)))
    hit = overlap_join(epochs, bad, width).filter((F.col("start") < F.col("end")) & (F.col("onset") < F.col("stop")))
    return epochs.join(hit.select("rec", "epoch").distinct(), ["rec", "epoch"], "left_anti")


def crop(annots: DataFrame, tmin: float, tmax: float) -> DataFrame:
    """Clipped to [tmin, tmax]; those that only touch stay; a NaN duration is 0."""
    d = F.when(F.isnan("duration"), 0.0).otherwise(F.col("duration"))
    own = annots.withColumn("stop", F.col("onset") + d).filter(f"onset <= {tmax!r} AND stop >= {tmin!r}")
    start, stop = F.greatest(F.col("onset"), F.lit(float(tmin))), F.least(F.col("stop"), F.lit(float(tmax)))
    return own.withColumns({"onset": start, "duration": stop - start}).drop("stop")


def merged(annots: DataFrame) -> DataFrame:
    """rec, start, stop of the unions of overlapping or touching intervals (one sort a recording)."""
    w = Window.partitionBy("rec").orderBy("onset", "event_id")
    # a given number of parts, since adaptive execution would put many narrow ones into one task, which then sorts all
    stop = annots.select("rec", "onset", "event_id", (F.col("onset") + F.col("duration")).alias("stop")).repartition(PARTS, "rec")
    so_far = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = stop.withColumn("new", F.when(so_far.isNull() | (F.col("onset") > so_far), 1).otherwise(0)).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("rec", "run").agg(F.min("onset").alias("start"), F.max("stop").alias("stop")).drop("run")


def annotate_break(annots: DataFrame, last: float, least: float = 15.0, after: float = 5.0, before: float = 5.0, ignore=("bad", "edge")) -> DataFrame:
    """Breaks of at least `least` seconds between annotated periods of 0 to last, less the margins."""
    periods = merged(annots.filter(~is_bad(F.col("description"), ignore)))
    w = Window.partitionBy("rec").orderBy("start")
    previous, following = F.lag("stop").over(w), F.lead("start").over(w)
    gaps = periods.withColumns({"previous": previous, "following": following})
    first = gaps.filter((F.col("previous").isNull()) & (F.col("start") > 0) & (F.col("start") >= least)).select("rec", F.lit(0.0).alias("onset"), (F.col("start") - before).alias("duration"))
    between = gaps.filter(F.col("start") - F.col("previous") >= least).select("rec", (F.col("previous") + after).alias("onset"), (F.col("start") - before - F.col("previous") - after).alias("duration"))
    end = gaps.filter(F.col("following").isNull() & (last - F.col("stop") >= least)).select("rec", (F.col("stop") + after).alias("onset"), (F.lit(float(last)) - F.col("stop") - after).alias("duration"))
    return first.unionByName(between).unionByName(end).withColumn("description", F.lit("BAD_break"))


def runs_of(df: DataFrame, mask: Column, keys: list[str], order: str = "samp") -> DataFrame:
    """keys, start, stop (exclusive): maximal runs of consecutive samples where mask holds."""
    w = Window.partitionBy(*keys).orderBy(order)
    on = df.filter(mask).withColumn("island", F.col(order) - F.row_number().over(w))
    return on.groupBy(*keys, "island").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("stop")).drop("island")


def annotate_amplitude(samples: DataFrame, peak: float, flat: float, sfreq: float, bad_percent: float = 5.0, min_duration: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """(annotations: ch, onset, duration, description; bad channels: ch, description). A step of at
    least peak, or of at most flat, marks its sample; runs shorter than min_duration do not count."""
    w = Window.partitionBy("ch").orderBy("samp")
    steps = samples.withColumn("step", F.abs(F.col("value") - F.lag("value").over(w)))
    n = samples.groupBy("ch").agg(F.count("*").alias("n"))
    out, bads = None, None
    for name, mask in (("BAD_flat", F.col("step") <= flat), ("BAD_peak", F.col("step") >= peak)):
        own = runs_of(steps, mask, ["ch"]).filter((F.col("stop") - F.col("start")) >= min_duration * sfreq)
        share = own.groupBy("ch").agg(F.sum(F.col("stop") - F.col("start")).alias("m")).join(n, "ch").filter(100.0 * F.col("m") / F.col("n") >= bad_percent).select("ch", F.lit(name).alias("description"))
        kept = own.join(share.select("ch"), "ch", "left_anti").select("ch", (F.col("start") / sfreq).alias("onset"), ((F.col("stop") - F.col("start")) / sfreq).alias("duration"), F.lit(name).alias("description"))
        out, bads = (kept, share) if out is None else (out.unionByName(kept), bads.unionByName(share))
    return out, bads


def annotate_nan(samples: DataFrame, sfreq: float) -> DataFrame:
    own = runs_of(samples, F.isnan("value") | F.col("value").isNull(), ["ch"])
    return own.select("ch", (F.col("start") / sfreq).alias("onset"), ((F.col("stop") - F.col("start")) / sfreq).alias("duration"), F.lit("BAD_NAN").alias("description"))


def events_from_annotations(annots: DataFrame, ids: dict[str, int], sfreq: float, skip=("bad", "edge")) -> DataFrame:
    """samp, prev_id, id of annotations with an id, but for bad and edge ones."""
    pairs = [x for name, i in ids.items() for x in (F.lit(name), F.lit(i).cast("long"))]
    code = F.element_at(F.create_map(*pairs), F.col("description"))
    own = annots.filter(~is_bad(F.col("description"), skip)).withColumn("id", code).filter("id IS NOT NULL")
    return own.select("rec", F.rint(F.col("onset") * sfreq).cast("long").alias("samp"), F.lit(0).cast("long").alias("prev_id"), "id")


def interpolate(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """Linear values inside spans (ch, start, stop), from the last sample before to the first after.
    Inner samples are nulled and refilled by one window each way, so there is no join by range of samples."""
    inner = spans.select("ch", F.explode(F.sequence("start", F.col("stop") - 1)).alias("samp"), F.lit(True).alias("gap"))
    df = samples.join(inner.distinct(), ["ch", "samp"], "left").withColumn("good", F.when(F.col("gap").isNull(), F.struct("samp", "value")))
    w = Window.partitionBy("ch").orderBy("samp")
    df = df.withColumns({"a": F.last("good", True).over(w), "b": F.first("good", True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    line = F.col("a.value") + (F.col("b.value") - F.col("a.value")) * (F.col("samp") - F.col("a.samp")) / (F.col("b.samp") - F.col("a.samp"))
    value = F.when(F.col("gap").isNull(), F.col("value")).otherwise(F.coalesce(line, F.col("a.value"), F.col("b.value")))
    return df.select("ch", "samp", value.alias("value"))
