"""Operators on event lists and trigger channels. Events: samp, prev_id, id. Triggers: ch, samp, code.

Ordered scans are windows partitioned by channel; pairings by time are bucketed equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered


def find_stim_steps(stim: DataFrame, pad_start: int | None = None, pad_stop: int | None = None, merge: int = 0) -> DataFrame:
    """ch, samp, before, after at each change of code. Padding adds a step from pad_start at sample 0
    and one to pad_stop after the last sample. merge > 0 joins steps at most so many samples apart and
    keeps the later; merge < 0 keeps the earlier."""
    w = Window.partitionBy("ch").orderBy("samp")
    both = stim.select("ch", "samp", "code", F.lag("code").over(w).alias("was"), F.lead("samp").over(w).alias("next"))
    steps = both.filter("was IS NOT NULL AND was <> code").select("ch", "samp", F.col("was").alias("before"), F.col("code").alias("after"))
    if pad_start is not None:
        # only channels with a step are padded, and only where the first value is another
        first = steps.groupBy("ch").agg(F.min_by("before", "samp").alias("v")).filter(F.col("v") != pad_start)
        steps = steps.unionByName(first.select("ch", F.lit(0).cast("long").alias("samp"), F.lit(pad_start).cast("long").alias("before"), F.col("v").alias("after")))
    if pad_stop is not None:
        end = both.filter("next IS NULL").select("ch", (F.col("samp") + 1).alias("end"))
        last = steps.groupBy("ch").agg(F.max_by("after", "samp").alias("v")).filter(F.col("v") != pad_stop)
        steps = steps.unionByName(last.join(end, "ch").select("ch", F.col("end").alias("samp"), F.col("v").alias("before"), F.lit(pad_stop).cast("long").alias("after")))
    if merge:
        close_after = (F.lead("samp").over(w) - F.col("samp")) <= abs(merge)
        close_before = (F.col("samp") - F.lag("samp").over(w)) <= abs(merge)
        if merge > 0:
            steps = steps.withColumns({"drop": F.coalesce(close_after, F.lit(False)), "before": F.when(close_before, F.lag("before").over(w)).otherwise(F.col("before"))})
        else:
            steps = steps.withColumns({"drop": F.coalesce(close_before, F.lit(False)), "after": F.when(close_after, F.lead("after").over(w)).otherwise(F.col("after"))})
        # the test that a step is one applies to all, as soon as any two were close in the channel
        touched = F.max("drop").over(Window.partitionBy("ch"))
        steps = steps.withColumn("touched", touched).filter("NOT drop AND (NOT touched OR before <> after)").drop("drop", "touched")
    return steps


def find_events(stim: DataFrame, output: str = "onset", consecutive: str | bool = "increasing", min_samples: float = 0, mask: int | None = None, mask_type: str = "and", initial_event: bool = False) -> DataFrame:
    """ch, samp, prev_id, id of trigger onsets, offsets or both ("step")."""
    whole = int(min_samples)
    merge = whole - (1 if whole == min_samples else 0) if min_samples > 0 else 0
    stim = stim.withColumn("code", F.abs("code"))
    steps = find_stim_steps(stim, pad_stop=0, merge=merge)
    if initial_event:
        first = stim.groupBy("ch").agg(F.min("samp").alias("samp"), F.min_by("code", "samp").alias("after")).filter("after <> 0")
        steps = steps.unionByName(first.withColumn("before", F.lit(0).cast("long")))
    if mask is not None:
        bits = mask if mask_type == "and" else ~mask
        steps = steps.withColumns({"before": F.col("before").bitwiseAND(F.lit(bits)), "after": F.col("after").bitwiseAND(F.lit(bits))})
    steps = steps.filter("before <> after")
    b, a = F.col("before"), F.col("after")
    on = a > b if consecutive == "increasing" else a > 0 if consecutive else b == 0
    off = (on | (a == 0)) & (b > 0) if consecutive == "increasing" else b > 0 if consecutive else a == 0
    steps = steps.withColumns({"on": on, "off": off})
    per = Window.partitionBy("ch")
    spans = {"on0": F.min(F.when(F.col("on"), F.col("samp"))).over(per), "off0": F.min(F.when(F.col("off"), F.col("samp"))).over(per), "on1": F.max(F.when(F.col("on"), F.col("samp"))).over(per), "off1": F.max(F.when(F.col("off"), F.col("samp"))).over(per)}
    # orphans: an offset before the first onset, an onset after the last offset
    steps = steps.withColumns(spans).filter("on0 IS NOT NULL AND off0 IS NOT NULL")
    steps = steps.withColumns({"off": F.expr("off AND NOT (on0 > off0 AND samp = off0)"), "on": F.expr("on AND NOT (on1 > off1 AND samp = on1)")})
    if output == "onset":
        return steps.filter("on").select("ch", "samp", b.alias("prev_id"), a.alias("id"))
    if output == "step":
        return steps.filter("on OR off").select("ch", "samp", b.alias("prev_id"), a.alias("id"))
    w = Window.partitionBy("ch").orderBy("samp")
    ons = steps.filter("on").select("ch", F.row_number().over(w).alias("k"), a.alias("id"))
    offs = steps.filter("off").select("ch", F.row_number().over(w).alias("k"), (F.col("samp") - 1).alias("samp"), a.alias("prev_id"))
    return offs.join(ons, ["ch", "k"]).select("ch", "samp", "prev_id", "id")


def pick_events(events: DataFrame, include: list[int] | None = None, exclude: list[int] | None = None, step: bool = False) -> DataFrame:
    def within(ids):
        return (F.col("id").isin(ids) | F.col("prev_id").isin(ids)) if step else F.col("id").isin(ids)

    if include is not None:
        return events.filter(within(include))
    return events.filter(~within(exclude)) if exclude is not None else events


def merge_events(events: DataFrame, ids: list[int], new_id: int, replace: bool = True) -> DataFrame:
    """ids become new_id in both value columns; without replace the originals stay beside them."""
    new = events.withColumns({c: F.when(F.col(c).isin(ids), new_id).otherwise(F.col(c)).cast("long") for c in ("prev_id", "id")})
    if replace:
        return new
    touched = events.filter(F.col("id").isin(ids) | F.col("prev_id").isin(ids))
    return new.unionByName(touched)


def shift_events(events: DataFrame, ids: list[int] | None, seconds: float, sfreq: float) -> DataFrame:
    moved = F.col("samp") + round(seconds * sfreq)
    return events.withColumn("samp", moved if ids is None else F.when(F.col("id").isin(ids), moved).otherwise(F.col("samp")))


def count_events(events: DataFrame, ids: list[int] | None = None) -> DataFrame:
    return (events if ids is None else events.filter(F.col("id").isin(ids))).groupBy("id").agg(F.count("*").alias("n"))


def bucketed(df: DataFrame, low: Column, high: Column, width: float, name: str = "bucket") -> DataFrame:
    """A row for each bucket of the width that [low, high] touches."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))


def define_target_events(events: DataFrame, reference: int, target: int, sfreq: float, tmin: float, tmax: float, new_id: int | None = None, fill_na: int | None = None) -> DataFrame:
    """Reference events with the lag in ms to the first target (in list order) strictly within the
    window. The window has a bounded length, so it meets targets in at most two buckets of that length."""
    low, high = int(tmin * sfreq), int(tmax * sfreq)
    width = max(1, high - low)
    refs = bucketed(events.filter(F.col("id") == reference), F.col("samp") + low, F.col("samp") + high, width)
    targets = events.filter(F.col("id") == target).select(F.col("samp").alias("t_samp"), F.col("row").alias("t_row"), F.floor(F.col("samp") / width).alias("bucket"))
    hit = refs.join(targets, "bucket").filter((F.col("t_samp") > F.col("samp") + low) & (F.col("t_samp") < F.col("samp") + high))
    first = hit.groupBy("row", "samp", "prev_id").agg(F.min_by("t_samp", "t_row").alias("t_samp"))
    out = first.select("samp", "prev_id", F.lit(reference if new_id is None else new_id).cast("long").alias("id"), (F.abs(F.col("samp") - F.col("t_samp")) * 1e3 / sfreq).alias("lag"), "row")
    if fill_na is not None:
        missed = events.filter(F.col("id") == reference).join(first.select("row"), "row", "left_anti")
        out = out.unionByName(missed.select("samp", "prev_id", F.lit(fill_na).cast("long").alias("id"), F.lit(None).cast("double").alias("lag"), "row"))
    return out


def make_fixed_length_events(spans: DataFrame, sfreq: float, duration: float, overlap: float = 0.0, id: int = 1) -> DataFrame:  # noqa: A002
    """spans: ch, first, last. Starts every (duration - overlap) seconds while a whole window fits."""
    step, size = sfreq * (duration - overlap), round(sfreq * duration)
    n = F.floor((F.col("last") + 1 - size - F.col("first")) / step)
    out = spans.filter(n >= 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n)))
    return out.select("ch", F.floor(F.col("first") + F.col("k") * step).alias("samp"), F.lit(0).cast("long").alias("prev_id"), F.lit(id).cast("long").alias("id"))


def concatenate_events(events: DataFrame, spans: DataFrame) -> DataFrame:
    """events: rec, samp, prev_id, id; spans: rec, first, last. Each recording follows the one before."""
    w = Window.orderBy("rec")  # one row a recording
    at = spans.withColumn("before", F.coalesce(F.sum(F.col("last") - F.col("first") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = at.withColumn("zero", F.first("first").over(w))
    return events.join(at, "rec").withColumn("samp", F.col("samp") - F.col("first") + F.col("before") + F.col("zero")).drop("first", "last", "before", "zero")


def handle_repeated(events: DataFrame, how: str) -> DataFrame:
    """Events of one sample: "drop" keeps the first; "merge" makes one whose tags are all of theirs."""
    if how == "drop":
        first = F.row_number().over(Window.partitionBy("samp").orderBy("row"))
        return events.withColumn("k", first).filter("k = 1").drop("k")
    return events.groupBy("samp").agg(F.min_by("prev_id", "row").alias("prev_id"), F.array_join(F.sort_array(F.collect_set(F.col("id").cast("string"))), "/").alias("tags"), F.min("row").alias("row"))


def make_metadata(events: DataFrame, row_ids: list[int], names: dict[str, int], low: int, high: int, sfreq: float) -> DataFrame:
    """For each row event: the time of the first event of each name in [samp + low, samp + high]. Time is dealt into
    buckets as long as a window, which so reaches into two at most: the first event from its start on is looked up
    among those that follow in the first bucket, or it is the least of the second. No row meets all events near it."""
    width = max(1, high - low + 1)
    rows = events.filter(F.col("id").isin(row_ids)).select("row", "samp", "id", (F.col("samp") + low).alias("at"))
    ids = {name: i for name, i in names.items()}
    marks = events.filter(F.col("id").isin(list(ids.values()))).groupBy(F.col("samp").alias("at")).agg(*(F.max(F.when(F.col("id") == i, F.col("samp"))).alias(f"_{n}") for n, i in enumerate(ids.values())))
    columns = [f"_{n}" for n in range(len(ids))]
    none = F.lit(None).cast("long")
    both = rows.select("*", *(none.alias(c) for c in columns)).unionByName(marks, allowMissingColumns=True).withColumn("bucket", F.floor(F.col("at") / width))
    ahead = Window.partitionBy("bucket").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    own = both.withColumns({f"{c}a": F.first(c, True).over(ahead) for c in columns}).filter(F.col("row").isNotNull())
    least = marks.groupBy((F.floor(F.col("at") / width) - 1).alias("bucket")).agg(*(F.min(c).alias(f"{c}b") for c in columns))
    met = own.join(least, "bucket", "left")
    found = {name: F.coalesce(f"_{n}a", f"_{n}b") for n, name in enumerate(ids)}
    return met.select("row", "samp", "id", *(F.when(c <= F.col("samp") + high, (c - F.col("samp")) / sfreq).alias(name) for name, c in found.items()))


def equalize_counts(events: DataFrame) -> DataFrame:
    """The first n of each id, n the count of the rarest ("truncate")."""
    least = events.groupBy("id").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    ranked = numbered(events, ["row"], F.floor(F.col("row") / (1 << 16)), "k", ["id"])
    return ranked.crossJoin(F.broadcast(least)).filter("k < least").drop("k", "least")  # one row
