"""Queries of overlap-add, temporal projection, operators that change in time, resampling and clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from . import views as V
from .queries_kernels import listed
from .registry import query, r6

#: Trials laid end to end; two channels are a recording.
RAW = "raw AS (SELECT ch // 2 AS rec, ch, epoch * 8 + t AS samp, value FROM epochs)"


def raw(spark, d):
    return V.epochs(spark, d).select(F.floor(F.col("ch") / 2).alias("rec"), "ch", (F.col("epoch") * 8 + F.col("t")).alias("samp"), "value")


def windows(size: int) -> str:
    """SQL of win(rec, ch, k, samp, value, w): Hann windows of size that half overlap, and their weights."""
    step = size // 2
    return f"""b AS (SELECT rec, min(samp) AS a, (max(samp) - min(samp) + 1 - {size}) // {step} AS final FROM raw GROUP BY 1),
win AS (SELECT raw.rec, ch, k, samp, value, CASE WHEN (k = 0 AND samp - a < {step}) OR (k = final AND samp - a - k * {step} >= {step}) THEN 1 ELSE 0.5 - 0.5 * cos(2 * pi() * (samp - a - k * {step}) / {size}) END AS w
  FROM raw JOIN b USING (rec), range(0, 2) r(back), (SELECT 0) z(zero), LATERAL (SELECT least((samp - a) // {step}, final) - back AS k) l WHERE k >= 0 AND samp - a >= k * {step} AND (samp - a < k * {step} + {size} OR k = final))"""


def rounded(df):
    return df.withColumn("value", r6(F.col("value")))


@query("overlap_add", f"WITH {RAW}, {windows(16)} SELECT rec, ch, samp, round(sum((value - m) * w), 6) + 0.0 AS value FROM (SELECT *, avg(value) OVER (PARTITION BY ch, k) AS m FROM win) GROUP BY rec, ch, samp", "epochs")
def _(spark, d):
    """The mean of each window taken out, windows added up."""
    return rounded(B.overlap_add(raw(spark, d), lambda x, ch, start: x - x.mean(1, keepdims=True), 16, 8))


@query("oversampled_temporal_projection", f"WITH {RAW}, {windows(40)}, m AS (SELECT a.rec, a.ch, a.k, regr_slope(a.value, b.value) AS slope, avg(a.value) AS m_a, avg(b.value) AS m_b FROM win a JOIN win b ON a.rec = b.rec AND a.k = b.k AND a.samp = b.samp AND a.ch <> b.ch GROUP BY ALL) SELECT a.rec, a.ch, a.samp, round(sum(a.w * (slope * (b.value - m_b) + m_a)), 6) + 0.0 AS value FROM win a JOIN win b ON a.rec = b.rec AND a.k = b.k AND a.samp = b.samp AND a.ch <> b.ch JOIN m ON m.rec = a.rec AND m.ch = a.ch AND m.k = a.k GROUP BY a.rec, a.ch, a.samp", "epochs")
def _(spark, d):
    """With two channels in a recording, a channel's span is the other one: a line in each window."""
    return rounded(B.oversampled_temporal_projection(raw(spark, d), 40))


WEIGHT = "((at * 7 + row * 3 + ch * 5) % 11 - 5) / 5.0"
SPANS = f"""p AS (SELECT DISTINCT rec, samp AS low FROM raw WHERE samp % 100 = 40), q AS (SELECT rec, low, lead(low) OVER (PARTITION BY rec ORDER BY low) AS upto, row_number() OVER (PARTITION BY rec ORDER BY low) AS i FROM p),
s AS (SELECT raw.*, low, upto, i, row FROM raw, range(0, 3) r(row), q WHERE q.rec = raw.rec AND ((samp >= low AND (samp < upto OR upto IS NULL)) OR (i = 1 AND samp < low))),
o AS (SELECT rec, row, samp, low, upto, sum(value * {WEIGHT.replace('at', 'low')}) AS a, sum(value * {WEIGHT.replace('at', 'upto')}) AS b FROM s GROUP BY ALL)"""


def controls(spark, d):
    own = raw(spark, d)
    points = own.filter("samp % 100 = 40").select("rec", F.col("samp").alias("at"), "ch")
    return points.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("row")).withColumn("weight", F.expr(WEIGHT).cast("double"))


for interp, share in (("zero", "1"), ("linear", "1 - (samp - low) / (upto - low)"), ("hann", "cos(pi() / 2 * (samp - low) / (upto - low)) ** 2")):

    @query(f"mix_over_time_{interp}", f"WITH {RAW}, {SPANS} SELECT rec, row, samp, round(CASE WHEN upto IS NULL OR samp < low THEN a ELSE a * ({share}) + b * (1 - ({share})) END, 6) + 0.0 AS value FROM o", "epochs")
    def _(spark, d, interp=interp):
        return rounded(B.mix_over_time(raw(spark, d), controls(spark, d), interp))


def resampled(table: str, up: int, down: int) -> str:
    """SQL of a table (ch, samp, value) with samples from 0 on, resampled."""
    h = B.resample_taps(up, down)
    half = (len(h) - 1) // 2
    return f"""SELECT ch, k AS samp, sum(value * h[k * {down} + {half} - samp * {up} + 1]) AS value FROM (SELECT ch, unnest(range(0, (count(*) * {up} + {down - 1}) // {down})) AS k FROM {table} GROUP BY ch) o JOIN {table} USING (ch), (SELECT {listed(h)} AS h) t WHERE k * {down} + {half} - samp * {up} BETWEEN 0 AND {len(h) - 1} GROUP BY ch, k"""


@query("resample_poly", f"SELECT ch, samp, round(value, 6) + 0.0 AS value FROM ({resampled('signal', 2, 3)})", "signal")
def _(spark, d):
    return rounded(B.resample_poly(V.signal(spark, d).select("ch", "samp", "value"), 2, 3))


#: Channel 0 is ours, channel 1 the other's, whose clock ticks two thirds as often and which begins 0.4 s later.
@query("realign_raw", f"WITH {RAW}, ours AS (SELECT ch, samp - 40 AS samp, value FROM raw WHERE ch = 0 AND samp >= 40), other AS (SELECT ch, samp, value FROM raw WHERE ch = 1), again AS ({resampled('other', 3, 2)}), e AS (SELECT least((SELECT max(samp) FROM ours), (SELECT max(samp) FROM again)) AS e) SELECT ch, samp, round(value, 6) + 0.0 AS value FROM (SELECT * FROM ours UNION ALL SELECT * FROM again), e WHERE samp <= e", "epochs")
def _(spark, d):
    own = raw(spark, d).select("ch", "samp", "value")
    pairs = own.filter("ch = 0 AND samp % 50 = 0").select((F.col("samp") / 100.0).alias("x"), (F.col("samp") / 100.0 * 1.5 + 0.4).alias("y"))
    a, b = B.realign(own.filter("ch = 0"), own.filter("ch = 1"), pairs, 100.0)
    return rounded(a.union(b))
