"""Queries of artifacts and of event-matched filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import dsp
from ..operators import artifacts as A
from ..operators import beats
from . import views as V
from .queries_blocks import RAW, raw
from .queries_kernels import fir_sql
from .registry import query, r6


def rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names or ("value",)})


LENGTH = 20
#: Volumes of 20 samples from sample 5 on; a line by least squares, then the mean of four volumes on either side.
GRADIENT = f"""WITH {RAW}, v AS (SELECT ch, samp, value, (samp - 5) // {LENGTH} AS vol, (samp - 5) % {LENGTH} AS place FROM raw WHERE samp >= 5),
l AS (SELECT ch, vol, regr_slope(value, place) AS slope, avg(value) AS m, avg(place) AS p FROM v GROUP BY ch, vol HAVING count(*) = {LENGTH}),
f AS (SELECT v.ch, samp, vol, place, value - m - slope * (place - p) AS value FROM v JOIN l USING (ch, vol)),
t AS (SELECT a.ch, a.vol, a.place, sum(b.value) / 8 AS template FROM f a JOIN f b ON a.ch = b.ch AND a.place = b.place AND b.vol BETWEEN a.vol - 4 AND a.vol + 4 AND a.vol <> b.vol GROUP BY ALL HAVING count(*) FILTER (b.vol < a.vol) = 4 AND count(*) FILTER (b.vol > a.vol) = 4)
SELECT raw.ch, raw.samp, round(coalesce(f.value - coalesce(template, 0), raw.value), 6) + 0.0 AS value FROM raw LEFT JOIN f ON f.ch = raw.ch AND f.samp = raw.samp LEFT JOIN t ON t.ch = f.ch AND t.vol = f.vol AND t.place = f.place"""


@query("remove_gradient_artifact", GRADIENT, "epochs")
def _(spark, d):
    own = raw(spark, d).select("ch", "samp", "value")
    return rounded(A.remove_gradient(own, own.filter(f"samp % {LENGTH} = 5").select(F.col("samp").alias("start")), LENGTH))


#: Amplitudes stand for envelopes; the scores are low-passed, and good stretches of under 0.3 s are bad.
SCORES = "c AS (SELECT rec, ch, avg(abs(value)) AS m, stddev_pop(abs(value)) AS s FROM raw GROUP BY ALL HAVING s > 0), z AS (SELECT rec AS ch, samp, sum((abs(value) - m) / s) / sqrt(count(*)) AS value FROM raw JOIN c USING (rec, ch) GROUP BY rec, samp)"
SMOOTH = fir_sql(dsp.design_fir(100.0, None, 4.0), "z").replace("round(", "(").replace(", 6) + 0.0 AS value", ") AS value").removeprefix("WITH ")


def envelopes(spark, d):
    return raw(spark, d).withColumn("value", F.abs("value"))


@query("muscle_zscore", f"WITH {RAW}, {SCORES} SELECT ch AS rec, samp, round(value, 6) + 0.0 AS score FROM z", "epochs")
def _(spark, d):
    return rounded(A.muscle_scores(envelopes(spark, d)), "score")


@query("annotate_muscle_zscore", f"WITH {RAW}, {SCORES}, s AS (WITH {SMOOTH}), b AS (SELECT ch, samp, value > 0.2 AS bad FROM s), i AS (SELECT *, samp - row_number() OVER (PARTITION BY ch, bad ORDER BY samp) AS island FROM b), n AS (SELECT *, bad OR count(*) OVER (PARTITION BY ch, bad, island) < 30 AS gone FROM i), j AS (SELECT *, samp - row_number() OVER (PARTITION BY ch, gone ORDER BY samp) AS span FROM n) SELECT ch AS rec, min(samp) AS start, max(samp) + 1 AS stop FROM j WHERE gone GROUP BY ch, span", "epochs")
def _(spark, d):
    return A.annotate_muscle(envelopes(spark, d), 100.0, 0.2, 0.3)


#: Each trial's filter from the other trials.
EMS = """WITH s AS (SELECT stddev_pop(value) AS s FROM epochs WHERE condition IN (1, 2)), x AS (SELECT epoch, condition, ch, t, value / s AS value FROM epochs, s WHERE condition IN (1, 2)),
d AS (SELECT e.epoch, e.condition, x.ch, x.t, avg(x.value) FILTER (x.condition = 1 AND x.epoch <> e.epoch) - avg(x.value) FILTER (x.condition = 2 AND x.epoch <> e.epoch) AS d FROM (SELECT DISTINCT epoch, condition FROM x) e, x GROUP BY ALL),
u AS (SELECT epoch, condition, ch, t, d / sqrt(sum(d * d) OVER (PARTITION BY epoch, t)) AS u FROM d)"""


@query("compute_ems", f"{EMS} SELECT epoch, condition, t, round(sum(u * value), 6) + 0.0 AS value FROM u JOIN x USING (epoch, condition, ch, t) GROUP BY ALL", "epochs")
def _(spark, d):
    return rounded(A.ems(V.epochs(spark, d), 1, 2))


@query("ems_filters", f"{EMS} SELECT ch, t, round(avg(u), 6) + 0.0 AS weight FROM u GROUP BY ch, t", "epochs")
def _(spark, d):
    return rounded(A.ems_filters(V.epochs(spark, d), 1, 2), "weight")


#: Windows of 50 samples from filtered z (ch, samp, value), for 16 thresholds; the table nx has each place's next crossing.
BEATS = """b AS (SELECT ch, min(samp) AS first, count(*) AS n FROM z GROUP BY 1),
v AS (SELECT ch, avg(m) AS level FROM (SELECT ch, max(abs(value)) AS m FROM z JOIN b USING (ch) WHERE samp < first + 300 GROUP BY ch, (samp - first) // 100) GROUP BY 1),
c AS (SELECT ch, k, samp, samp < first + n - 50 AND abs(value) > (30 + 5 * k) / 100 * level AS over FROM z JOIN b USING (ch) JOIN v USING (ch), range(0, 16) r(k)),
nx AS MATERIALIZED (SELECT ch, k, samp, min(CASE WHEN over THEN samp END) OVER (PARTITION BY ch, k ORDER BY samp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM c),
w AS (SELECT ch, k, s FROM nx JOIN b USING (ch) WHERE samp = first UNION ALL SELECT nx.ch, nx.k, nx.s FROM w JOIN nx ON nx.ch = w.ch AND nx.k = w.k AND nx.samp = w.s + 50),
e AS (SELECT ch, k, s, arg_max(samp, abs(value)) AS samp, sqrt(avg(value * value)) AS rms FROM w JOIN z USING (ch) WHERE z.samp >= s AND z.samp < s + 50 GROUP BY ALL),
g AS (SELECT ch, k, e.samp FROM (SELECT *, avg(rms) OVER (PARTITION BY ch, k) + 2.5 * stddev_pop(rms) OVER (PARTITION BY ch, k) AS bound FROM e) e WHERE rms < bound),
q AS (SELECT ch, k, 60 * count(*) / (any_value(n) / 100.0) AS rate FROM g JOIN b USING (ch) GROUP BY ch, k),
i AS (SELECT ch, coalesce(median(rate) FILTER (rate BETWEEN 40 AND 160), 80) AS ideal FROM q GROUP BY 1),
o AS (SELECT ch, arg_min(k, abs(rate - ideal) * 1e6 + k) AS k FROM q JOIN i USING (ch) GROUP BY 1)
SELECT ch, samp FROM g JOIN o USING (ch, k)"""
BAND = dsp.design_fir(100.0, 5.0, 35.0)
BEAT_BAND = fir_sql(np.convolve(BAND, BAND), "raw").replace("round(", "(").replace(", 6) + 0.0 AS value", ") AS value")


@query("find_ecg_events", f"WITH RECURSIVE {RAW}, z AS MATERIALIZED ({BEAT_BAND}), {BEATS}", "epochs")
def _(spark, d):
    return beats.find_ecg_events(raw(spark, d).select("ch", "samp", "value"), 100.0)


@query("qrs_detector", f"WITH RECURSIVE {RAW}, z AS (SELECT ch, samp, value FROM raw), {BEATS}", "epochs")
def _(spark, d):
    """Channels as they are, without the filter."""
    return beats.qrs_detector(raw(spark, d).select("ch", "samp", "value"), 100.0)
