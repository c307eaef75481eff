"""Mass-univariate statistics. Tests are cells (ch, t); observations are epochs. Per-cell sums are
grouped aggregates; what couples the cells (hats, maximum statistics) is one more small aggregate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ("ch", "t")


def hat(cells: DataFrame, column: str, sigma: float, how=F.max) -> DataFrame:
    """column plus sigma times its maximum over all cells."""
    if not sigma:
        return cells
    return cells.crossJoin(F.broadcast(cells.agg(how(column).alias("__top")))).withColumn(column, F.col(column) + sigma * F.col("__top")).drop("__top")  # one row


def ttest_1samp(df: DataFrame, sigma: float = 0.0) -> DataFrame:
    cells = df.groupBy(*CELL).agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    return hat(cells, "v", sigma).select(*CELL, (F.col("m") / F.sqrt(F.col("v") / F.col("n"))).alias("t_value"))


def ttest_ind(df: DataFrame, a: int, b: int, equal_var: bool = True, sigma: float = 0.0) -> DataFrame:
    def of(f, k):
        return f(F.when(F.col("condition") == k, F.col("value")))

    cells = df.filter(F.col("condition").isin(a, b)).groupBy(*CELL).agg(*(of(f, k).alias(f"{n}{i}") for i, k in ((1, a), (2, b)) for n, f in (("m", F.avg), ("s", F.var_samp), ("n", F.count))))
    s1, s2, n1, n2 = (F.col(x) for x in ("s1", "s2", "n1", "n2"))
    var = ((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2) if equal_var else s1 / n1 + s2 / n2
    return hat(cells.withColumn("v", var), "v", sigma).select(*CELL, ((F.col("m1") - F.col("m2")) / F.sqrt("v")).alias("t_value"))


def f_oneway(df: DataFrame, sigma: float = 0.0) -> DataFrame:
    per = df.groupBy("condition", *CELL).agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q"), F.count("*").alias("n"))
    cells = per.groupBy(*CELL).agg(F.sum("q").alias("q"), F.sum("s").alias("s"), F.sum(F.col("s") ** 2 / F.col("n")).alias("b"), F.sum("n").alias("n"), F.count("*").alias("k"))
    between = F.col("b") - F.col("s") ** 2 / F.col("n")
    cells = cells.withColumns({"between": between, "within": F.col("q") - F.col("s") ** 2 / F.col("n") - between})
    cells = cells.withColumn("msw", F.col("within") / (F.col("n") - F.col("k")))
    if sigma:
        top = cells.agg(F.median("msw").alias("__top"))
        cells = cells.crossJoin(F.broadcast(top)).withColumn("msw", (F.col("within") + sigma * F.col("__top")) / (F.col("n") - F.col("k")))  # one row
    return cells.select(*CELL, (F.col("between") / (F.col("k") - 1) / F.col("msw")).alias("f_value"))


def linear_regression(df: DataFrame, x: str) -> DataFrame:
    """Slope, intercept, standard error of the slope and t of value on one predictor."""
    own = df.withColumn("__x", F.col(x).cast("double"))
    s = own.groupBy(*CELL).agg(F.regr_slope("value", "__x").alias("beta"), F.regr_intercept("value", "__x").alias("intercept"), F.regr_sxx("value", "__x").alias("sxx"), F.regr_syy("value", "__x").alias("syy"), F.regr_sxy("value", "__x").alias("sxy"), F.count("*").alias("n"))
    se = F.sqrt((F.col("syy") - F.col("sxy") ** 2 / F.col("sxx")) / (F.col("n") - 2) / F.col("sxx"))
    return s.select(*CELL, "beta", "intercept", se.alias("stderr"), (F.col("beta") / se).alias("t_value"))


def drawn(draw: Column, number: Column) -> Column:
    """A number below 2^31 - 1 for a draw and an observation: a product with a squaring, so that the draws
    do not repeat each other. Both are whole numbers that are not negative."""
    prime = (1 << 31) - 1
    x = (number.cast("long") % prime * 48271 + draw.cast("long") * 104729 + 1) % prime
    return (x * x + draw.cast("long") * 7919) % prime * 16807 % prime


def hashed(number: np.ndarray, n: int) -> np.ndarray:
    """drawn for observations x draws 0 to n - 1."""
    prime, draw = (1 << 31) - 1, np.arange(n, dtype=np.int64)
    x = (number.astype(np.int64)[:, None] % prime * 48271 + draw * 104729 + 1) % prime
    return (x * x + draw * 7919) % prime * 16807 % prime


def grouped_sums(df: DataFrame, n: int, number: str, weights: Callable[[np.ndarray], np.ndarray] | str, groups: int) -> DataFrame:
    """perm, k, ch, t, s: for each draw and group k, the sum of the values of a cell. weights: a function of
    observations' numbers that gives observations x (n * groups), or the name of a column with an observation's
    row of it (bytes, group numbers by draw). Observations are gathered by cell in Arrow batches and multiplied
    by the matrix of their weights; a task sends on one row a cell, draw and group, not one a value and draw."""
    given = isinstance(weights, str)
    columns = [*CELL, F.col(number).cast("long").alias("number"), F.col("value").cast("double").alias("value")]
    rows = df.select(*columns, *([weights] if given else []))
    kinds = dict(rows.dtypes)
    width, limit = n * groups, max(1, (1 << 22) // (n * groups))

    def flush(cells: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        own = list(cells)
        again = np.repeat(np.arange(len(own)), width)
        draw, group = np.divmod(np.tile(np.arange(width), len(own)), groups)
        names = [pa.array([c[i] for c in own]).take(pa.array(again)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(draw), pa.array(group), *names, pa.array(np.concatenate([cells[c] for c in own]))], ["perm", "k", *CELL, "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, limit):
                batch = whole.slice(at, limit)
                values = batch.column("value").to_numpy(zero_copy_only=False)
                if given:
                    picked = np.frombuffer(b"".join(batch.column(weights).to_pylist()), np.uint8).reshape(-1, n)
                    w = (picked[:, :, None] == np.arange(groups)).reshape(len(picked), width).astype(float)
                else:
                    w = weights(batch.column("number").to_numpy())
                who = pd.MultiIndex.from_arrays([batch.column(c).to_numpy(zero_copy_only=False) for c in CELL])
                code, names = who.factorize()
                order = np.argsort(code, kind="stable")
                edges = np.flatnonzero(np.diff(code[order], prepend=-1))
                sums = np.add.reduceat(w[order] * values[order, None], edges, axis=0)
                for name, s in zip(names, sums, strict=True):
                    name = tuple(x.item() if hasattr(x, "item") else x for x in name)
                    cells[name] = cells[name] + s if name in cells else s
            if len(cells) * width > 1 << 22:
                yield flush(cells)
                cells = {}
        if cells:
            yield flush(cells)

    parts = rows.mapInArrow(run, f"perm long, k long, ch {kinds['ch']}, t {kinds['t']}, s double")
    return parts.groupBy("perm", "k", *CELL).agg(F.sum("s").alias("s"))


def signs(n: int) -> Callable[[np.ndarray], np.ndarray]:
    """The sign of an observation in each of n draws, by the rule of stats.drawn; draw 0 has them all as they are."""
    return lambda number: np.where((np.arange(n) > 0) & (hashed(number, n) // 65536 % 2 == 1), -1.0, 1.0)


def flipped(df: DataFrame, n: int, number: str = "number") -> DataFrame:
    """perm, ch, t, t_value under n sign flips; the observed order is draw 0. An observation's sign comes from its
    own number, so observations of any number need no table of signs."""
    cells = df.groupBy(*CELL).agg(F.sum(F.col("value") ** 2).alias("q"), F.count("*").alias("n"))
    m = F.col("s") / F.col("n")
    t = m / F.sqrt((F.col("q") - F.col("n") * m * m) / (F.col("n") - 1) / F.col("n"))
    return grouped_sums(df, n, number, signs(n), 1).join(cells, list(CELL)).select("perm", *CELL, t.alias("t_value"))


def share_over(observed: DataFrame, all_: DataFrame, value: str, n: int) -> DataFrame:
    """observed with p_value: the share of n draws whose largest |value| in all_ (perm, value) reaches its own."""
    top = all_.groupBy("perm").agg(F.max(F.abs(value)).alias("top"))
    tops = top.agg(F.sort_array(F.collect_list("top")).alias("tops"))  # one number a permutation
    over = F.size(F.filter("tops", lambda x: x >= F.abs(F.col(value)) * (1 - 1e-12)))
    return observed.crossJoin(F.broadcast(tops)).withColumn("p_value", over / n).drop("tops")


def permutation_t(df: DataFrame, n: int, number: str = "number") -> DataFrame:
    """ch, t, t_value, p_value by sign flips and the maximum statistic (two tails); the observed order counts."""
    stats = flipped(df, n, number)
    return share_over(stats.filter("perm = 0"), stats, "t_value", n).select(*CELL, "t_value", "p_value")


def cluster_test(df: DataFrame, n: int, threshold: float, number: str = "number") -> DataFrame:
    """ch, sign, start, stop, mass, p_value of the observed clusters over t; p_value compares a cluster's
    mass with the largest one of each draw, none counting as 0."""
    found = clusters(flipped(df, n, number), threshold, ("perm", "ch"))
    return share_over(found.filter("perm = 0"), found, "mass", n).drop("perm")


def bonferroni(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    n = df.agg(F.count("*").alias("n"))
    p = F.least(F.col("p") * F.col("n"), F.lit(1.0))
    return df.crossJoin(F.broadcast(n)).select(*df.columns, p.alias("corrected"), (p < alpha).alias("reject"))  # one row


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n, from 1,000 on by its expansion, which is exact to the last digits there."""
    few = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(n, F.lit(1000).cast("long"))), F.lit(0.0), lambda a, x: a + 1 / x)
    return F.when(n <= 1000, few).otherwise(F.log(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n))


def fdr(df: DataFrame, key: list[str], alpha: float = 0.05, method: str = "indep") -> DataFrame:
    """Benjamini-Hochberg, or Benjamini-Yekutieli ("negcorr"), with corrected and reject.

    Equal p share a result, so they are counted first. Distinct ones are dealt into buckets of 1/256 of an
    octave; ranks and minima go on from bucket to bucket, whose number has a bound (under 300,000), so only
    those are sorted as a whole. Rows without p are no tests: corrected is null and reject false."""
    each = df.filter("p IS NOT NULL").groupBy("p").agg(F.count("*").alias("_c")).withColumn("_b", F.when(F.col("p") > 0, F.floor(F.log2("p") * 256)).otherwise(-300_000))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = each.groupBy("_b").agg(F.sum("_c").alias("_s"))
    sums = sums.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"), F.sum("_s").over(Window.partitionBy()).alias("_n"))
    own = Window.partitionBy("_b").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    share = (F.col("_before") + F.sum("_c").over(own)) / F.col("_n") / (harmonic(F.col("_n")) if method == "negcorr" else 1)
    ranked = each.join(sums, "_b").withColumn("_e", share).withColumn("_q", F.col("p") / F.col("_e"))
    later = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    after = ranked.groupBy("_b").agg(F.min("_q").alias("_m")).select("_b", F.min("_m").over(later).alias("_after"))
    down = Window.partitionBy("_b").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    last = ranked.agg(F.max(F.when(F.col("p") < F.col("_e") * alpha, F.col("p"))).alias("_last"))
    found = ranked.join(after, "_b").select("p", F.least(F.min("_q").over(down), F.col("_after"), F.lit(1.0)).alias("corrected"))
    found = found.crossJoin(F.broadcast(last)).select("p", "corrected", F.coalesce(F.col("p") <= F.col("_last"), F.lit(False)).alias("reject"))  # one row
    return df.join(found, "p", "left").select(*df.columns, "corrected", F.coalesce("reject", F.lit(False)).alias("reject"))


def clusters(cells: DataFrame, threshold: float, keys: tuple[str, ...] = ("ch",)) -> DataFrame:
    """keys, sign, start, stop, mass: runs over t of values beyond the threshold (strictly), per channel."""
    own = cells.withColumn("sign", F.when(F.col("t_value") > threshold, 1).when(F.col("t_value") < -threshold, -1)).filter("sign IS NOT NULL")
    w = Window.partitionBy(*keys, "sign").orderBy("t")
    runs = own.withColumn("island", F.col("t") - F.row_number().over(w))
    return runs.groupBy(*keys, "sign", "island").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("stop"), F.sum("t_value").alias("mass")).drop("island")


#: How many of 1,000 draws take an observation 0, 1, 2 ... times at most: the Poisson law of mean 1.
POISSON = (368, 736, 920, 981, 996, 999)


def taken(n: int) -> Callable[[np.ndarray], np.ndarray]:
    """How often each of n draws takes an observation."""
    return lambda number: (hashed(number, n) // 65536 % 1000 >= np.array(POISSON)[:, None, None]).sum(0).astype(float)


def bootstrap_ci(df: DataFrame, n: int, number: str = "number", ci: float = 0.95) -> DataFrame:
    """The percentile interval of n resampled means of each cell. How often a draw takes an observation
    comes from the observation's own number (Poisson resampling), so nothing is broadcast."""
    weights = taken(n)
    sums = grouped_sums(df, n, number, weights, 1)
    times = grouped_sums(df.withColumn("value", F.lit(1.0)), n, number, weights, 1).withColumnRenamed("s", "times")
    means = sums.join(times, ["perm", "k", *CELL]).select(*CELL, (F.col("s") / F.col("times")).alias("m"))
    q = F.percentile("m", F.array(F.lit((1 - ci) / 2), F.lit((1 + ci) / 2)))
    return means.groupBy(*CELL).agg(q.alias("q")).select(*CELL, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def anova_rm(df: DataFrame, subject: str, factor: str) -> DataFrame:
    """F of one within-subject factor per cell, from the sums of the subject x factor means."""
    means = df.groupBy(subject, factor, *CELL).agg(F.avg("value").alias("v"))
    w_s, w_f, w = (Window.partitionBy(*CELL, *k) for k in ([subject], [factor], []))
    parts = means.withColumns({"s": F.avg("v").over(w_s), "f": F.avg("v").over(w_f), "g": F.avg("v").over(w)})
    out = parts.groupBy(*CELL).agg(F.sum((F.col("f") - F.col("g")) ** 2).alias("ssf"), F.sum((F.col("v") - F.col("s") - F.col("f") + F.col("g")) ** 2).alias("sse"), F.count_distinct(subject).alias("ns"), F.count_distinct(factor).alias("nf"))
    return out.select(*CELL, ((F.col("ssf") / (F.col("nf") - 1)) / (F.col("sse") / ((F.col("nf") - 1) * (F.col("ns") - 1)))).alias("f_value"))


def linear_regression_many(df: DataFrame, design: dict[str, Column]) -> DataFrame:
    """ch, t, name, beta, stderr, t_value of value on the columns of a design (of each observation; a constant is given
    as one of them). All cells have all observations, so the products of the columns are one small matrix, from one
    cell, which is inverted on the driver; a cell's own sums are one grouped aggregate."""
    names, own = list(design), df.select(*CELL, "value", *(c.cast("double").alias(f"x{i}") for i, c in enumerate(design.values())))
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    per = own.groupBy(*CELL).agg(F.count("*").alias("n"), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs), *(F.sum(F.col(f"x{i}") * F.col("value")).alias(f"y{i}") for i in range(p)), F.sum(F.col("value") ** 2).alias("yy"))
    one = per.agg(*(F.min(f"s{i}_{j}").alias(f"s{i}_{j}") for i, j in pairs)).first()
    if one["s0_0"] is None:
        inverse = np.eye(p)
    else:
        square = np.array([[one[f"s{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        inverse = np.linalg.inv(square)
    beta = [sum((float(inverse[i, j]) * F.col(f"y{j}") for j in range(p)), F.lit(0.0)) for i in range(p)]
    rest = (F.col("yy") - sum((b * F.col(f"y{i}") for i, b in enumerate(beta)), F.lit(0.0))) / (F.col("n") - p)
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), b.alias("beta"), F.sqrt(rest * float(inverse[i, i])).alias("stderr")) for i, (name, b) in enumerate(zip(names, beta, strict=True))))).alias("r")
    return per.select(*CELL, each).select(*CELL, "r.*", (F.col("r.beta") / F.col("r.stderr")).alias("t_value"))


def anova_rm_two(df: DataFrame, subject: str, a: str, b: str) -> DataFrame:
    """ch, t, effect ("A", "B", "A:B"), f_value of two within-subject factors. Every subject has every pair of levels;
    an effect's error is its interaction with the subjects."""
    own = df.groupBy(*CELL, F.col(subject).alias("s"), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.avg("value").alias("v"))

    def mean(*by: str) -> Column:
        return F.avg("v").over(Window.partitionBy(*CELL, *by))

    m = own.withColumns({"m": mean(), "ma": mean("a"), "mb": mean("b"), "ms": mean("s"), "mab": mean("a", "b"), "msa": mean("s", "a"), "msb": mean("s", "b")})
    c = {n: F.col(n) for n in ("v", "m", "ma", "mb", "ms", "mab", "msa", "msb")}
    terms = {
        "A": (c["ma"] - c["m"], c["msa"] - c["ms"] - c["ma"] + c["m"]),
        "B": (c["mb"] - c["m"], c["msb"] - c["ms"] - c["mb"] + c["m"]),
        "A:B": (c["mab"] - c["ma"] - c["mb"] + c["m"], c["v"] - c["msa"] - c["msb"] - c["mab"] + c["ms"] + c["ma"] + c["mb"] - c["m"]),
    }
    # a term is repeated over what it does not depend on, in numerator and denominator alike
    sums = m.groupBy(*CELL).agg(F.count_distinct("s").alias("ns"), *(F.sum(x**2).alias(f"{k}{e}") for e, pair in terms.items() for k, x in zip(("t", "e"), pair, strict=True)))
    each = F.explode(F.array(*(F.struct(F.lit(e).alias("effect"), (F.col(f"`t{e}`") / (F.col(f"`e{e}`") / (F.col("ns") - 1))).alias("f_value")) for e in terms))).alias("r")
    return sums.select(*CELL, each).select(*CELL, "r.effect", "r.f_value")
