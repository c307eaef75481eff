"""Operators on channels and on samples of channels: selection, references, fixed matrices, covariance."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .covariance import covariance  # noqa: F401

#: The kinds of data channels, in the order of default picks.
DATA_KINDS = ("mag", "grad", "eeg", "csd", "seeg", "ecog", "dbs", "hbo", "hbr", "fnirs_cw_amplitude", "fnirs_od")

LITERAL = 4096  # weights that go into a plan
MOST = 1 << 27  # weights that are sent to every worker


def pick_channels(df: DataFrame, include: Sequence = (), exclude: Sequence = (), name: str = "ch") -> DataFrame:
    if include:
        df = df.filter(F.col(name).isin(list(include)))
    return df.filter(~F.col(name).isin(list(exclude))) if exclude else df


def pick_types(channels: DataFrame, kinds: Sequence[str], exclude_bads: bool = True) -> DataFrame:
    out = channels.filter(F.col("kind").isin(list(kinds)))
    return out.filter("NOT bad") if exclude_bads else out


def rename(df: DataFrame, mapping: dict, name: str = "ch_name") -> DataFrame:
    if len(set(mapping.values())) < len(mapping):
        raise ValueError("new names must be distinct")
    return df.replace(mapping, subset=[name])


def reorder(df: DataFrame, order: Sequence, name: str = "ch") -> DataFrame:
    """df with place, for the channels of order alone."""
    place = F.array_position(F.lit(list(order)), F.col(name))
    return df.withColumn("place", place.cast("long") - 1).filter("place >= 0")


def combine_channels(df: DataFrame, groups: dict[str, Sequence[int]], method: str = "mean", keys: tuple[str, ...] = ("epoch", "t")) -> DataFrame:
    """A channel for each group: its mean, median or (population) deviation."""
    member = None
    for g, chs in groups.items():
        member = F.when(F.col("ch").isin(list(chs)), g) if member is None else member.when(F.col("ch").isin(list(chs)), g)
    value = {"mean": F.avg, "median": F.median, "std": F.stddev_pop}[method]("value")
    return df.withColumn("group", member).filter("group IS NOT NULL").groupBy("group", *keys).agg(value.alias("value"))


def equalize_channels(df: DataFrame, by: str = "condition") -> DataFrame:
    """Only channels that every instance has."""
    have = df.select(by, "ch").distinct()
    n = have.select(by).distinct().agg(F.count("*").alias("all"))
    common = have.groupBy("ch").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).filter("n = all").select("ch")  # one row
    return df.join(common, "ch", "left_semi")


def describe(df: DataFrame) -> DataFrame:
    q = F.percentile("value", F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75))))
    return df.groupBy("ch").agg(F.min("value").alias("low"), q.alias("q"), F.max("value").alias("high")).select("ch", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")


def reference(df: DataFrame, refs: Sequence[int] | None = None, keys: tuple[str, ...] = ("epoch", "t")) -> DataFrame:
    """value less the mean over the reference channels (all, if none is named) at the same time."""
    ref = F.col("value") if refs is None else F.when(F.col("ch").isin(list(refs)), F.col("value"))
    return df.withColumn("value", F.col("value") - F.avg(ref).over(Window.partitionBy(*keys)))


def bipolar(df: DataFrame, pairs: Sequence[tuple[int, int]], keys: tuple[str, ...] = ("epoch", "t")) -> DataFrame:
    """anode - cathode for each pair, by one grouping."""
    sides = F.array(*(F.struct(F.lit(f"{a}-{c}").alias("pair"), F.when(F.col("ch") == a, 1).when(F.col("ch") == c, -1).alias("sign")) for a, c in pairs))
    return df.withColumn("s", F.explode(sides)).filter("s.sign IS NOT NULL").groupBy(F.col("s.pair").alias("pair"), *keys).agg(F.sum(F.col("s.sign") * F.col("value")).alias("value"))


def mix(df: DataFrame, matrix: Sequence[Sequence[float]], keys: tuple[str, ...] = ("epoch", "t")) -> DataFrame:
    """Rows of the matrix times the channels: projectors, unmixing, inverse kernels, morphs. Each
    sample meets its column as an array literal, so the join with the matrix needs no shuffle; rows are
    summed in channel order within their keys. Chains of matrices are multiplied before this is called.
    Matrices of more than LITERAL weights, too long for a plan, are multiplied in batches to the same rows."""
    rows = len(matrix)
    if rows * len(matrix[0]) > LITERAL:
        return multiplied(df, np.asarray(matrix, float), keys)
    columns = F.array(*(F.array(*(F.struct(F.lit(r).alias("row"), F.lit(float(matrix[r][c])).alias("w")) for r in range(rows) if matrix[r][c])) for c in range(len(matrix[0]))))
    spread = df.withColumn("m", F.explode(F.element_at(columns, F.col("ch").cast("int") + 1)))
    return spread.groupBy(F.col("m.row").cast("long").alias("ch"), *keys).agg(F.sum(F.col("m.w") * F.col("value")).alias("value"))


def multiplied(df: DataFrame, matrix: np.ndarray, keys: tuple[str, ...] = ("epoch", "t"), combine: int = 1) -> DataFrame:
    """ch (row of the matrix), keys, value: channels gathered by their keys, then matrix products of whole Arrow batches.
    The matrix is broadcast, so it may have at most MOST weights. A row without a weight on a channel that is there
    gives nothing, as in mix; null values count as missing. combine: so many rows on end are one, the root of the sum of
    their squares."""
    if matrix.size > MOST:
        raise ValueError(f"a matrix of {matrix.size} weights; at most {MOST} are sent to every worker")
    if len(matrix) % combine:
        raise ValueError(f"{len(matrix)} rows are not groups of {combine}")
    sent = df.sparkSession.sparkContext.broadcast(matrix)
    gathered = df.filter("value IS NOT NULL").groupBy(*keys).agg(F.collect_list(F.col("ch").cast("int")).alias("_ch"), F.collect_list(F.col("value").cast("double")).alias("_value"))
    kinds = dict(gathered.dtypes)

    def run(batches):
        weights = sent.value
        used = weights != 0
        step = max(1, (1 << 20) // max(1, len(weights)))
        for whole in batches:
            for batch in (whole.slice(a, step) for a in range(0, whole.num_rows, step)):
                lists = batch.column("_ch")
                of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                ch, value = lists.flatten().to_numpy(), batch.column("_value").flatten().to_numpy()
                x = np.zeros((batch.num_rows, weights.shape[1]))
                there = np.zeros(x.shape, bool)
                np.add.at(x, (of, ch), value)
                there[of, ch] = True
                y = x @ weights.T
                given = np.broadcast_to(used.any(1), y.shape) if there.all() else there.astype(np.float32) @ used.T.astype(np.float32) > 0
                if combine > 1:
                    y = np.sqrt((y.reshape(len(y), -1, combine) ** 2).sum(2))
                    given = given.reshape(len(y), -1, combine).any(2)
                at, row = np.nonzero(given)
                again = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64)), *(batch.column(k).take(again) for k in keys), pa.array(y[at, row])], ["ch", *keys, "value"])

    return gathered.mapInArrow(run, ", ".join(["ch long", *(f"{k} {kinds[k]}" for k in keys), "value double"]))


def bridged(df: DataFrame, keys: tuple[str, ...] = ("epoch", "t")) -> DataFrame:
    """ch_i < ch_j and the variance over time of their difference, per epoch, then its median."""
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ch", "value"))).alias("x"))
    pairs = rows.select(*keys, F.explode("x").alias("a"), "x").select(*keys, "a", F.explode("x").alias("b")).filter("a.ch < b.ch")
    per = pairs.groupBy("epoch", F.col("a.ch").alias("ch_i"), F.col("b.ch").alias("ch_j")).agg(F.var_pop(F.col("a.value") - F.col("b.value")).alias("v"))
    return per.groupBy("ch_i", "ch_j").agg(F.median("v").alias("value"))


def regress_artifact(df: DataFrame, artifact: int, keys: tuple[str, ...] = ("epoch", "t")) -> DataFrame:
    """Each channel less its least-squares share of one artifact channel; means per epoch are removed first."""
    centred = df.withColumn("c", F.col("value") - F.avg("value").over(Window.partitionBy("epoch", "ch")))
    with_a = centred.withColumn("a", F.max(F.when(F.col("ch") == artifact, F.col("c"))).over(Window.partitionBy(*keys)))
    beta = with_a.groupBy("ch").agg((F.sum(F.col("a") * F.col("c")) / F.sum(F.col("a") * F.col("a"))).alias("beta"))
    return with_a.join(beta, "ch").filter(F.col("ch") != artifact).select(*keys, "ch", (F.col("value") - F.col("beta") * F.col("a")).alias("value"))


def scaled(df: DataFrame, how: str = "mean") -> DataFrame:
    """Channels to mean 0 and deviation 1, or to median 0 and quartile range 1."""
    q = F.percentile("value", F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75))))
    s = df.groupBy("ch").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")) if how == "mean" else df.groupBy("ch").agg(q.alias("q")).select("ch", F.col("q")[1].alias("m"), (F.col("q")[2] - F.col("q")[0]).alias("s"))
    return df.join(s, "ch").withColumn("value", (F.col("value") - F.col("m")) / F.col("s")).drop("m", "s")


def detrend(df: DataFrame, keys: tuple[str, ...], order: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys)
    mean = F.avg("value").over(w)
    if not order:
        return df.withColumn("value", F.col("value") - mean)
    t0 = F.avg("t").over(w)
    slope = F.covar_pop("t", "value").over(w) / F.var_pop("t").over(w)
    return df.withColumn("value", F.col("value") - mean - slope * (F.col("t") - t0))


def optical_density(df: DataFrame, keys: tuple[str, ...] = ("ch",), repair: bool = True) -> DataFrame:
    """-ln(x / mean |x|); a channel with values that are not positive takes absolute values, zeros the least positive one.
    Without repair -ln(x / mean) of the values as they are: infinite where x is 0, NaN where x / mean is negative."""
    size = F.abs("value")
    of = [F.col(k).alias(f"_of_{k}") for k in keys]
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]  # samples without a channel are one, too
    if not repair:
        own = df.join(df.groupBy(*of).agg(F.avg("value").alias("m")), on)
        ratio = F.when(F.col("m") != 0, F.try_divide("value", "m")).when(F.col("value") > 0, math.inf).when(F.col("value") <= 0, math.nan)
        density = F.when(ratio > 0, -F.log(ratio)).when(ratio == 0, math.inf).when(ratio < 0, math.nan)
        return own.withColumn("value", density).select(*df.columns)
    own = df.groupBy(*of).agg(F.min(F.when(size > 0, size)).alias("least"), F.avg(F.abs("value")).alias("m"), F.min("value").alias("low"))
    v = F.when(F.col("low") > 0, F.col("value")).otherwise(F.greatest(size, F.col("least")))
    return df.join(own, on).withColumn("value", -F.log(F.try_divide(v, F.col("m")))).select(*df.columns)


def beer_lambert(df: DataFrame, coefficients: tuple[tuple[float, float], tuple[float, float]], distance: Column, ppf: float = 6.0) -> DataFrame:
    """pair, t, hbo, hbr from the optical densities w0 and w1 of two wavelengths: a 2 x 2 solve."""
    (a, b), (c, e) = coefficients
    det = a * e - b * c
    scale = distance * ppf
    hbo, hbr = (e * F.col("w0") - b * F.col("w1")) / det / scale, (a * F.col("w1") - c * F.col("w0")) / det / scale
    return df.select("pair", "t", hbo.alias("hbo"), hbr.alias("hbr"))


def wide(df: DataFrame, channels: Sequence[int], keys: tuple[str, ...] = ("epoch", "t")) -> DataFrame:
    """One column per channel. The channels are given, so no job looks for them."""
    return df.groupBy(*keys).pivot("ch", list(channels)).agg(F.first("value")).select(*keys, *(F.col(f"`{c}`").alias(f"ch{c}") for c in channels))


def long(df: DataFrame, channels: Sequence[int], keys: tuple[str, ...] = ("epoch", "t")) -> DataFrame:
    return df.unpivot(list(keys), [f"ch{c}" for c in channels], "channel", "value")


def match_event_names(names: DataFrame, key: str) -> DataFrame:
    """Names whose tags, between slashes, contain all of the key's."""
    return names.filter(F.size(F.array_except(F.split(F.lit(key), "/"), F.split("name", "/"))) == 0)
