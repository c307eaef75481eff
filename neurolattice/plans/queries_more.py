"""Further queries: geometry and labels, bad segments, movement, spectra in bands, raw covariance."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import annotations as A
from ..operators import channels as C
from ..operators import epochs as P
from ..operators import geometry as G
from . import views as V
from .registry import query, r6


def rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names or ("value",)})


#: Points on a table of parts: positions within a cube of 10.
POINTS = "pts AS (SELECT p_partkey AS id, (p_partkey * 37 % 101) / 10.0 AS x, (p_partkey * 53 % 103) / 10.0 AS y, (p_partkey * 71 % 107) / 10.0 AS z FROM part)"
NEAR = f"{POINTS}, pairs AS (SELECT a.id AS \"left\", b.id AS \"right\", sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS dist FROM pts a JOIN pts b ON a.id <> b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 2.05)"


def points(spark, d):
    k = F.col("p_partkey")
    return V.table(spark, d, "part").select(k.alias("id"), (k * 37 % 101 / 10.0).alias("x"), (k * 53 % 103 / 10.0).alias("y"), (k * 71 % 107 / 10.0).alias("z"))


@query("spatial_dist_adjacency", f"WITH {NEAR} SELECT \"left\", \"right\", round(dist, 6) AS dist FROM pairs")
def _(spark, d):
    """Rounded as the SQL does, by a division: there are too many rows for decimals."""
    return G.pairs_within(points(spark, d), 2.05).withColumn("dist", F.floor(F.col("dist") * 1e6 + 0.5) / 1e6)


@query("nearest_sensors", f"WITH {NEAR} SELECT \"left\", \"right\", round(dist, 6) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY \"left\" ORDER BY dist, \"right\") AS rank FROM pairs) WHERE rank <= 3")
def _(spark, d):
    return rounded(G.nearest_within(points(spark, d), 3, 2.05), "dist")


@query("select_sources", f"WITH {POINTS} SELECT id, round(sqrt((x - 5) ** 2 + (y - 5) ** 2 + (z - 5) ** 2), 6) AS dist FROM pts WHERE sqrt((x - 5) ** 2 + (y - 5) ** 2 + (z - 5) ** 2) <= 3.3")
def _(spark, d):
    dist = F.sqrt((F.col("x") - 5) ** 2 + (F.col("y") - 5) ** 2 + (F.col("z") - 5) ** 2)
    return points(spark, d).select("id", dist.alias("dist")).filter("dist <= 3.3").withColumn("dist", r6(F.col("dist")))


@query("stc_near_sensors", f"WITH {NEAR}, e AS (SELECT ch, t, avg(value) AS value FROM epochs GROUP BY ALL) SELECT \"left\", t, round(sum((1 - dist / 2.05) * value), 6) + 0.0 AS value FROM pairs JOIN e ON ch + 1 = \"right\" GROUP BY ALL", "epochs")
def _(spark, d):
    """The average over all trials."""
    values = V.epochs(spark, d).groupBy((F.col("ch") + 1).alias("id"), "t").agg(F.avg("value").alias("value"))
    own = points(spark, d)
    sensors = own.join(values.select("id").distinct(), "id", "left_semi")  # other points have no values to give
    pairs = G.within(sensors, own, 2.05).filter("left <> right").select(F.col("right").alias("left"), F.col("left").alias("right"), "dist")
    return rounded(G.near_sensors(pairs, values, 2.05))


@query("short_channels", f"WITH {POINTS} SELECT a.id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS dist, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < 4.01 AS short FROM pts a JOIN pts b ON b.id = a.id + 1")
def _(spark, d):
    own = points(spark, d).select("id", F.struct("x", "y", "z").alias("p"))
    pair = own.withColumnRenamed("p", "a").join(own.select((F.col("id") - 1).alias("id"), F.col("p").alias("b")), "id")
    return pair.select("id", r6(G.distance("a", "b")).alias("dist"), (G.distance("a", "b") < 4.01).alias("short"))


LABELS = "a AS (SELECT p_partkey AS vertex, p_retailprice AS value FROM part WHERE p_size < 30), b AS (SELECT p_partkey AS vertex, p_retailprice + 1 AS value FROM part WHERE p_size > 20)"


def labels(spark, d):
    part = V.table(spark, d, "part")
    return part.filter("p_size < 30").select(F.col("p_partkey").alias("vertex"), F.col("p_retailprice").alias("value")), part.filter("p_size > 20").select(F.col("p_partkey").alias("vertex"), (F.col("p_retailprice") + 1).alias("value"))


@query("label_union", f"WITH {LABELS} SELECT vertex, max(value) AS value FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY vertex")
def _(spark, d):
    return G.label_union(*labels(spark, d))


@query("label_minus", f"WITH {LABELS} SELECT * FROM a WHERE vertex NOT IN (SELECT vertex FROM b)")
def _(spark, d):
    return G.label_minus(*labels(spark, d))


@query("annotate_movement", "SELECT ch, samp, round(speed, 6) AS speed FROM (SELECT ch, samp, abs(value - lag(value) OVER (PARTITION BY ch ORDER BY samp)) * 10 AS speed FROM signal) WHERE speed > 1500", "signal")
def _(spark, d):
    return rounded(G.stretch_speed(V.signal(spark, d), 10.0, 1500.0).select("ch", "samp", "speed"), "speed")


BAD = "runs AS (SELECT ch, min(samp) AS a, max(samp) AS z FROM (SELECT ch, samp, samp - row_number() OVER (PARTITION BY ch ORDER BY samp) AS island FROM signal WHERE code = 5) GROUP BY ch, island)"


@query("get_data_reject_omit", f"WITH {BAD} SELECT ch, samp, value FROM signal s WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.ch = s.ch AND s.samp BETWEEN r.a AND r.z + 1)", "signal")
def _(spark, d):
    """Samples outside bad segments, whose last sample is followed by one more. Segments are exploded
    into samples, so the anti-join is by equality."""
    sig = V.signal(spark, d)
    bad = A.runs_of(sig, F.col("code") == 5, ["ch"]).select("ch", F.explode(F.sequence("start", "stop")).alias("samp"))
    return sig.select("ch", "samp", "value").join(bad, ["ch", "samp"], "left_anti")


@query("crop_by_annotations", "WITH e AS (SELECT ch, samp AS start FROM signal WHERE code = 3) SELECT e.ch, start, samp - start AS t, value FROM e JOIN signal s ON s.ch = e.ch AND s.samp BETWEEN start AND start + 3", "signal")
def _(spark, d):
    sig = V.signal(spark, d)
    spans = sig.filter("code = 3").select("ch", F.col("samp").alias("start")).withColumn("samp", F.explode(F.sequence("start", F.col("start") + 3)))
    return spans.join(sig.select("ch", "samp", "value"), ["ch", "samp"]).select("ch", "start", (F.col("samp") - F.col("start")).alias("t"), "value")


@query("fix_stim_artifact", "WITH x AS (SELECT *, lag(code) OVER w AS c1, lag(value) OVER w AS v1, lead(value) OVER w AS n1 FROM signal WINDOW w AS (PARTITION BY ch ORDER BY samp)) SELECT ch, samp, round(CASE WHEN code = 3 THEN coalesce(v1 + (n1 - v1) / 2, v1, n1) ELSE value END, 6) + 0.0 AS value FROM x WHERE NOT coalesce(code = 3 AND c1 = 3, false)", "signal")
def _(spark, d):
    """One sample at each event is the mean of its neighbours; repeated events are one artifact."""
    w = Window.partitionBy("ch").orderBy("samp")
    x = V.signal(spark, d).withColumns({"c1": F.lag("code").over(w), "v1": F.lag("value").over(w), "n1": F.lead("value").over(w)})
    line = F.coalesce(F.col("v1") + (F.col("n1") - F.col("v1")) / 2, F.col("v1"), F.col("n1"))
    out = x.filter(~F.coalesce((F.col("code") == 3) & (F.col("c1") == 3), F.lit(False)))
    return rounded(out.select("ch", "samp", F.when(F.col("code") == 3, line).otherwise(F.col("value")).alias("value")))


RAW_COV = "WITH s AS (SELECT ch % 4 AS ch, samp, avg(value) AS value FROM signal GROUP BY ALL), seg AS (SELECT samp // 10 AS seg FROM s GROUP BY ALL HAVING max(value) - min(value) < 400), g AS (SELECT * FROM s WHERE samp // 10 IN (SELECT seg FROM seg)) SELECT a.ch AS ch_i, b.ch AS ch_j, round((sum(a.value * b.value) - sum(a.value) * sum(b.value) / count(*)) / (count(*) - 1), 6) + 0.0 AS value, count(*) AS n FROM g a JOIN g b USING (samp) GROUP BY ALL"


@query("compute_raw_covariance", RAW_COV, "signal")
def _(spark, d):
    """Over the whole recording."""
    return raw_covariance(V.signal(spark, d))


@query("compute_raw_covariance_all", RAW_COV, "signal")
def _(spark, d):
    return raw_covariance(V.signal(spark, d))


def raw_covariance(signal):
    """Over segments of ten samples whose range is under a threshold."""
    s = signal.groupBy((F.col("ch") % 4).alias("ch"), "samp").agg(F.avg("value").alias("value")).withColumn("seg", F.floor(F.col("samp") / 10))
    good = s.groupBy("seg").agg((F.max("value") - F.min("value")).alias("p")).filter("p < 400").select("seg")
    return rounded(C.covariance(s.join(good, "seg", "left_semi"), ("samp",)))


@query("csd_band_mean", "WITH f AS (SELECT epoch, ch, k, sum(value * cos(2 * pi() * k * t / 8)) AS c, -sum(value * sin(2 * pi() * k * t / 8)) AS s FROM epochs, range(1, 4) r(k) GROUP BY ALL) SELECT ch, CASE WHEN k <= 2 THEN 'low' ELSE 'high' END AS band, round(avg(c * c + s * s), 6) AS power FROM f GROUP BY ALL", "epochs")
def _(spark, d):
    at = F.lit(2 * math.pi) * F.col("k") * F.col("t") / 8
    f = V.epochs(spark, d).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long")))).groupBy("epoch", "ch", "k").agg(F.sum(F.col("value") * F.cos(at)).alias("c"), F.sum(F.col("value") * F.sin(at)).alias("s"))
    return rounded(f.groupBy("ch", F.when(F.col("k") <= 2, "low").otherwise("high").alias("band")).agg(F.avg(F.col("c") ** 2 + F.col("s") ** 2).alias("power")), "power")


@query("iter_evoked", "SELECT epoch, ch, t, value, 1.0::DOUBLE AS nave FROM epochs WHERE condition = 2", "epochs")
def _(spark, d):
    return V.epochs(spark, d).filter("condition = 2").select("epoch", "ch", "t", "value", F.lit(1.0).alias("nave"))


@query("apply_function", "SELECT epoch, ch, t, round(abs(value) ** 0.5, 6) AS value FROM epochs", "epochs")
def _(spark, d):
    return rounded(V.epochs(spark, d).select("epoch", "ch", "t", F.sqrt(F.abs("value")).alias("value")))


@query("convert_units", "SELECT ch, samp, round(atan2(value * 0.0005, 0.6), 9) AS radians FROM signal", "signal")
def _(spark, d):
    return V.signal(spark, d).select("ch", "samp", F.round(F.atan2(F.col("value") * 0.0005, F.lit(0.6)), 9).alias("radians"))


@query("scalp_coupling_index", "SELECT epoch, round(corr(a.value, b.value), 6) + 0.0 AS sci FROM epochs a JOIN epochs b USING (epoch, t) WHERE a.ch = 0 AND b.ch = 1 GROUP BY epoch", "epochs")
def _(spark, d):
    own = C.wide(V.epochs(spark, d), [0, 1])
    return rounded(own.groupBy("epoch").agg(F.corr("ch0", "ch1").alias("sci")), "sci")


@query("equalize_bads", "SELECT ch, count(*) AS n, count(*) >= 0.3 * (SELECT count(DISTINCT condition) FROM epochs) AS bad FROM (SELECT condition, ch FROM epochs GROUP BY ALL HAVING max(value) - min(value) > 0.8) GROUP BY ch", "epochs")
def _(spark, d):
    own = V.epochs(spark, d)
    bads = own.groupBy("condition", "ch").agg((F.max("value") - F.min("value")).alias("p")).filter("p > 0.8")
    n = own.agg(F.count_distinct("condition").alias("all"))
    return bads.groupBy("ch").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("ch", "n", (F.col("n") >= 0.3 * F.col("all")).alias("bad"))  # one row


@query("epochs_metadata_query", "SELECT e.epoch, e.ch, e.t, e.value FROM epochs e JOIN (SELECT epoch, avg(value) AS level FROM epochs GROUP BY epoch) m USING (epoch) WHERE m.level > 0.0 AND e.condition IN (1, 2)", "epochs")
def _(spark, d):
    own = V.epochs(spark, d)
    meta = own.groupBy("epoch").agg(F.avg("value").alias("level"))
    return own.join(meta, "epoch").filter("level > 0.0 AND condition IN (1, 2)").select("epoch", "ch", "t", "value")


@query("linear_regression_raw", "WITH x AS (SELECT ch, samp, value, CASE WHEN code = 3 THEN 1 ELSE 0 END AS e FROM signal), l AS (SELECT ch, samp, value, lag(e, 1, 0) OVER (PARTITION BY ch ORDER BY samp) AS e1 FROM x) SELECT ch, round(regr_slope(value, e1), 6) + 0.0 AS beta FROM l GROUP BY ch HAVING count(DISTINCT e1) = 2", "signal")
def _(spark, d):
    """The response one sample after an event, by channel: a lagged design of one column."""
    w = Window.partitionBy("ch").orderBy("samp")
    x = V.signal(spark, d).withColumn("e", F.when(F.col("code") == 3, 1.0).otherwise(0.0)).withColumn("e1", F.lag("e", 1, 0.0).over(w))
    out = x.groupBy("ch").agg(F.regr_slope("value", "e1").alias("beta"), F.count_distinct("e1").alias("k")).filter("k = 2").drop("k")
    return rounded(out, "beta")


@query("evoked_decimated_peak", "WITH v AS (SELECT condition, ch, t, avg(value) AS value FROM epochs WHERE t % 2 = 0 GROUP BY ALL) SELECT condition, ch, t, round(value, 6) + 0.0 AS value FROM v QUALIFY row_number() OVER (PARTITION BY condition ORDER BY abs(value) DESC, ch, t) = 1", "epochs")
def _(spark, d):
    return rounded(P.get_peak(P.average(P.decimate(V.epochs(spark, d), 2))))
