"""Queries of signal kernels. Where a kernel has a closed form in SQL, it has an oracle."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dsp
from ..operators import blocks as B
from ..operators import kernels as K
from . import views as V
from .registry import query, r6

TRIAL = {"keys": ("epoch", "ch"), "order": "t"}


def rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names or ("value",)})


def sig(spark, d):
    return V.signal(spark, d).select("ch", "samp", "value")


def listed(numbers) -> str:
    """Numbers as an SQL list."""
    return "[" + ", ".join(repr(float(v)) for v in numbers) + "]"


def fir_sql(h: np.ndarray, table: str = "signal") -> str:
    """Symmetric taps over ends that are reflected oddly, as far as there are samples."""
    half = (len(h) - 1) // 2
    return f"""WITH taps AS (SELECT unnest(range(0, {len(h)})) AS k, unnest({listed(h)}) AS w),
x AS (SELECT ch, samp, value, count(*) OVER (PARTITION BY ch) AS n, first_value(value) OVER (PARTITION BY ch ORDER BY samp) AS a, first_value(value) OVER (PARTITION BY ch ORDER BY samp DESC) AS b FROM {table}),
y AS (SELECT ch, samp AS p, value FROM x UNION ALL SELECT ch, -samp, 2 * a - value FROM x WHERE samp BETWEEN 1 AND {half} UNION ALL SELECT ch, 2 * (n - 1) - samp, 2 * b - value FROM x WHERE samp BETWEEN n - 1 - {half} AND n - 2)
SELECT x.ch, x.samp, round(CASE WHEN any_value(x.n) = 1 THEN any_value(x.value) * (SELECT sum(w) FROM taps) ELSE sum(w * y.value) END, 6) + 0.0 AS value FROM x, taps LEFT JOIN y ON y.ch = x.ch AND y.p = x.samp + {half} - k GROUP BY x.ch, x.samp"""


SMOOTH = np.array([0.25, 0.5, 0.25])


@query("fir_smooth", fir_sql(SMOOTH), "signal")
def _(spark, d):
    return rounded(B.fir(sig(spark, d), SMOOTH))


for name, low, high in (("lowpass", None, 20.0), ("highpass", 2.0, None), ("bandpass", 4.0, 20.0), ("bandstop", 20.0, 8.0)):

    @query(f"filter_{name}", fir_sql(dsp.design_fir(100.0, low, high)), "signal")
    def _(spark, d, low=low, high=high):
        return rounded(B.filter_data(sig(spark, d), 100.0, low, high))


@query("notch_filter", fir_sql(dsp.design_fir(100.0, 26.5, 23.5, width=0.5)), "signal")
def _(spark, d):
    return rounded(B.notch(sig(spark, d), 100.0, [25.0], 2.0))


@query("iir_filter")
def _(spark, d):
    return rounded(B.iir(sig(spark, d), 100.0, 1.0, 20.0))


#: The analytic signal of 8 samples: the discrete transform, one-sided, and back.
HILBERT = "WITH f AS (SELECT epoch, ch, k, sum(value * cos(2 * pi() * k * t / 8)) AS c, -sum(value * sin(2 * pi() * k * t / 8)) AS s FROM epochs, range(0, 5) r(k) GROUP BY ALL), g AS (SELECT *, CASE WHEN k IN (0, 4) THEN 1 ELSE 2 END / 8.0 AS w FROM f) SELECT epoch, ch, i, round(sum(w * (c * cos(2 * pi() * k * i / 8) - s * sin(2 * pi() * k * i / 8))), 6) + 0.0 AS re, round(sum(w * (c * sin(2 * pi() * k * i / 8) + s * cos(2 * pi() * k * i / 8))), 6) + 0.0 AS im FROM g, range(0, 8) t(i) GROUP BY ALL"


@query("apply_hilbert", HILBERT, "epochs")
def _(spark, d):
    return rounded(K.hilbert(V.epochs(spark, d), **TRIAL).drop("envelope"), "re", "im")


#: The same for channels of n samples, filled up to z, the next product of twos, threes and fives.
ENVELOPE = "WITH x AS (SELECT ch, samp, value, count(*) OVER (PARTITION BY ch) AS n FROM signal), v AS (SELECT (2 ** a * 3 ** b * 5 ** c)::BIGINT AS v FROM range(0, 20) r(a), range(0, 12) s(b), range(0, 8) t(c)), z AS (SELECT n, min(v) AS z FROM (SELECT DISTINCT n FROM x) JOIN v ON v >= n GROUP BY n), f AS (SELECT ch, n, z, k, sum(value * cos(2 * pi() * k * samp / z)) AS c, -sum(value * sin(2 * pi() * k * samp / z)) AS s FROM (SELECT *, unnest(range(0, z // 2 + 1)) AS k FROM x JOIN z USING (n)) GROUP BY ALL), g AS (SELECT *, CASE WHEN k = 0 OR 2 * k = z THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END / z AS w, unnest(range(0, n)) AS i FROM f) SELECT ch, i, round(sqrt(sum(w * (c * cos(2 * pi() * k * i / z) - s * sin(2 * pi() * k * i / z))) ** 2 + sum(w * (c * sin(2 * pi() * k * i / z) + s * cos(2 * pi() * k * i / z))) ** 2), 6) + 0.0 AS envelope FROM g GROUP BY ch, i"


@query("hilbert_envelope", ENVELOPE, "signal")
def _(spark, d):
    return rounded(K.hilbert(sig(spark, d)).select("ch", "i", "envelope"), "envelope")


W = "(0.54 - 0.46 * cos(2 * pi() * t / 8))"
WELCH = f"WITH m AS (SELECT epoch, ch, t, (value - avg(value) OVER (PARTITION BY epoch, ch)) * {W} AS v FROM epochs), p AS (SELECT epoch, ch, k, (sum(v * cos(2 * pi() * k * t / 8)) ** 2 + sum(v * sin(2 * pi() * k * t / 8)) ** 2) AS p FROM m, range(0, 5) r(k) GROUP BY ALL) SELECT epoch, ch, k * 12.5 AS freq, round(p / (100 * (SELECT sum({W} ** 2) FROM range(0, 8) r(t))) * CASE WHEN k IN (0, 4) THEN 1 ELSE 2 END, 6) + 0.0 AS power FROM p"


@query("psd_welch", WELCH, "epochs")
def _(spark, d):
    return rounded(B.welch(V.epochs(spark, d), 100.0, 8, **TRIAL), "power")


#: Segments of 16 (or a shorter channel) at steps of 8, each transformed; their median, over the bias of so many.
MEDIAN = """WITH x AS (SELECT ch, samp, value, least(16, count(*) OVER (PARTITION BY ch)) AS f, count(*) OVER (PARTITION BY ch) AS n FROM signal),
s AS (SELECT DISTINCT ch, n, f, unnest(range(0, n - f + 1, CASE WHEN f > 8 THEN f - 8 ELSE f END)) AS start FROM x),
v AS (SELECT s.ch, s.start, s.f, samp - start AS j, value - avg(value) OVER (PARTITION BY s.ch, s.start) AS v, 0.54 - 0.46 * cos(2 * pi() * (samp - start) / s.f) AS w FROM s JOIN x ON x.ch = s.ch AND samp >= start AND samp < start + s.f),
p AS (SELECT ch, start, f, k, (sum(v * w * cos(2 * pi() * k * j / f)) ** 2 + sum(v * w * sin(2 * pi() * k * j / f)) ** 2) / (100 * sum(w * w)) * CASE WHEN k = 0 OR 2 * k = f THEN 1 ELSE 2 END AS p FROM (SELECT *, unnest(range(0, f // 2 + 1)) AS k FROM v) GROUP BY ch, start, f, k),
m AS (SELECT ch, f, k, median(p) AS m, (count(*) - 1) // 2 AS c FROM p GROUP BY ch, f, k)
SELECT ch, round(k * 100.0::DOUBLE / f, 6) + 0.0 AS freq, round(m / (1 + coalesce(list_sum(list_transform(range(1, c + 1), lambda i: 1.0::DOUBLE / (2 * i + 1) - 1.0::DOUBLE / (2 * i))), 0)), 6) + 0.0 AS power FROM m"""


@query("psd_welch_median", MEDIAN, "signal")
def _(spark, d):
    return rounded(B.welch(sig(spark, d), 100.0, 16, 8, "median"), "freq", "power")


@query("psd_multitaper")
def _(spark, d):
    return rounded(K.multitaper(sig(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("ch"))).filter("n >= 16").drop("n"), 100.0), "freq", "power")


WAVES = {f: dsp.morlet(100.0, f, 2.0) for f in (20.0, 35.0)}
CWT = "w AS (" + " UNION ALL ".join(f"SELECT {f}::DOUBLE AS freq, unnest(range(0, {len(w)})) - {(len(w) - 1) // 2} AS k, unnest({listed(w.real)}) AS a, unnest({listed(w.imag)}) AS b" for f, w in WAVES.items()) + "), z AS (SELECT e.epoch, e.ch, freq, i, sum(value * a) AS re, sum(value * b) AS im FROM (SELECT *, unnest(range(0, 8)) AS i FROM epochs) e JOIN w ON k = i - t GROUP BY ALL)"


@query("tfr_morlet", f"WITH {CWT} SELECT epoch, ch, freq, i, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM z", "epochs")
def _(spark, d):
    return rounded(B.cwt(V.epochs(spark, d), WAVES, **TRIAL), "re", "im")


@query("tfr_power_itc", f"WITH {CWT} SELECT ch, freq, i, round(avg(re * re + im * im), 6) + 0.0 AS power, round(sqrt(avg(re / sqrt(re * re + im * im)) ** 2 + avg(im / sqrt(re * re + im * im)) ** 2), 6) + 0.0 AS itc FROM z GROUP BY ALL", "epochs")
def _(spark, d):
    """Average power and phase locking over trials: aggregates of the complex coefficients."""
    z = B.cwt(V.epochs(spark, d), WAVES, **TRIAL)
    size = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    out = z.groupBy("ch", "freq", "i").agg(F.avg(size**2).alias("power"), F.sqrt(F.avg(F.col("re") / size) ** 2 + F.avg(F.col("im") / size) ** 2).alias("itc"))
    return rounded(out, "power", "itc")


@query("fwhm", "SELECT p_partkey, round(7.0 * sqrt(2 * ln(2)) / (pi() * p_size), 9) AS fwhm FROM part")
def _(spark, d):
    return V.table(spark, d, "part").select("p_partkey", F.round(7.0 * math.sqrt(2 * math.log(2)) / (math.pi * F.col("p_size")), 9).alias("fwhm"))


#: Two frames of 8 at steps of 4; a window's energy counts the frames that cover the place.
STFT = "WITH s AS (SELECT t, sin((t + 0.5) / 8 * pi()) AS s FROM range(0, 8) r(t)), w AS (SELECT s.t, step, any_value(s.s) / sqrt(8 * sum(o.s ** 2)) AS w FROM s, range(0, 2) a(step), range(0, 2) b(other), s o WHERE o.t = s.t + 4 * (step - other) GROUP BY s.t, step) SELECT epoch, ch, bin, step, round(sum(value * w * cos(2 * pi() * bin * w.t / 8)), 6) + 0.0 AS re, round(-sum(value * w * sin(2 * pi() * bin * w.t / 8)), 6) + 0.0 AS im FROM epochs e JOIN w ON e.t = w.t + 4 * step - 2, range(0, 5) b(bin) GROUP BY ALL"


@query("stft", STFT, "epochs")
def _(spark, d):
    return rounded(B.stft(V.epochs(spark, d), 8, 4, **TRIAL), "re", "im")


@query("stft_istft", "SELECT ch, samp, round(value, 6) + 0.0 AS value FROM signal", "signal")
def _(spark, d):
    """Forth and back: the tight frame returns the signal."""
    own = sig(spark, d)
    return rounded(B.istft(B.stft(own, 16, 8), B.bounds(own, ("ch",), "samp"), 16, 8))


@query("resample")
def _(spark, d):
    return rounded(K.per_channel(sig(spark, d), lambda x: dsp.resample(x, 1.0, 2.0) if len(x) > 3 else x))


#: Row r of the smoother: the fitted polynomial of a window of 11 at its place r.
_basis = np.vander(np.arange(-5, 6), 6, increasing=True)
SAVGOL = f"WITH m AS (SELECT unnest(range(0, 121)) // 11 AS r, unnest(range(0, 121)) % 11 AS j, unnest({listed((_basis @ np.linalg.pinv(_basis)).ravel())}) AS w), x AS (SELECT ch, samp, value, count(*) OVER (PARTITION BY ch) AS n FROM signal), s AS (SELECT *, greatest(0, least(samp - 5, n - 11)) AS start FROM x WHERE n >= 11) SELECT ch, samp, round(value, 6) + 0.0 AS value FROM x WHERE n < 11 UNION ALL SELECT s.ch, s.samp, round(sum(w * x.value), 6) + 0.0 FROM s JOIN m ON r = s.samp - start JOIN x ON x.ch = s.ch AND x.samp = start + j GROUP BY s.ch, s.samp"


@query("savgol_filter", SAVGOL, "signal")
def _(spark, d):
    return rounded(B.savgol(sig(spark, d), 11))


@query("temporal_derivative_distribution_repair")
def _(spark, d):
    return rounded(K.per_channel(sig(spark, d), lambda x: dsp.tddr(x, 10.0) if len(x) > 3 else x))


@query("peak_finder")
def _(spark, d):
    return K.events_of(sig(spark, d), dsp.peak_finder)


#: Two coefficients from the autocorrelations at lags 0 to 2.
AR = "WITH c AS (SELECT ch, samp, value - avg(value) OVER (PARTITION BY ch) AS y, count(*) OVER (PARTITION BY ch) AS n FROM signal), l AS (SELECT ch, y, lag(y) OVER w AS y1, lag(y, 2) OVER w AS y2 FROM c WHERE n > 8 WINDOW w AS (PARTITION BY ch ORDER BY samp)), r AS (SELECT ch, sum(y * y) AS r0, sum(y * y1) AS r1, sum(y * y2) AS r2 FROM l GROUP BY 1) SELECT ch, k, round(CASE k WHEN 0 THEN 1.0 WHEN 1 THEN (r1 * r2 - r0 * r1) / (r0 * r0 - r1 * r1) ELSE (r1 * r1 - r0 * r2) / (r0 * r0 - r1 * r1) END, 6) + 0.0 AS coef FROM r, range(0, 3) t(k)"


@query("fit_iir_model", AR, "signal")
def _(spark, d):
    return rounded(K.table_of(sig(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("ch"))).filter("n > 8").drop("n"), lambda x: {"k": np.arange(3), "coef": dsp.yule_walker(x, 2)}, "k long, coef double"), "coef")


CSD = "WITH f AS (SELECT epoch, ch, k, sum(value * cos(2 * pi() * k * t / 8)) AS c, -sum(value * sin(2 * pi() * k * t / 8)) AS s FROM epochs, range(1, 4) r(k) GROUP BY ALL) SELECT a.k, a.ch AS ch_i, b.ch AS ch_j, round(avg(a.c * b.c + a.s * b.s), 6) + 0.0 AS re, round(avg(a.s * b.c - a.c * b.s), 6) + 0.0 AS im FROM f a JOIN f b ON a.epoch = b.epoch AND a.k = b.k AND a.ch <= b.ch GROUP BY ALL"


@query("csd_fourier", CSD, "epochs")
def _(spark, d):
    """Cross-spectra of trials: transform natively as sums, pair channels per trial and bin."""
    at = F.lit(2 * math.pi) * F.col("k") * F.col("t") / 8
    f = V.epochs(spark, d).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long")))).groupBy("epoch", "ch", "k").agg(F.sum(F.col("value") * F.cos(at)).alias("c"), (-F.sum(F.col("value") * F.sin(at))).alias("s"))
    rows = f.groupBy("epoch", "k").agg(F.sort_array(F.collect_list(F.struct("ch", "c", "s"))).alias("x"))
    pairs = rows.select("k", F.explode("x").alias("a"), "x").select("k", "a", F.explode("x").alias("b")).filter("a.ch <= b.ch")
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    return rounded(pairs.groupBy("k", a("ch").alias("ch_i"), b("ch").alias("ch_j")).agg(F.avg(a("c") * b("c") + a("s") * b("s")).alias("re"), F.avg(a("s") * b("c") - a("c") * b("s")).alias("im")), "re", "im")
