"""Queries that put recordings, trials, spectra and annotations together, and take parts of them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import assemble as S
from ..operators import channels as C
from ..operators import epochs as P
from . import views as V
from .queries_events import WINDOWS, windows
from .queries_more import POINTS, points
from .registry import query, r6


def rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names or ("value",)})


RECS = "recs AS (SELECT ch % 4 AS rec, ch // 4 AS ch, samp, value FROM signal), lens AS (SELECT rec, max(samp) + 1 AS length FROM recs GROUP BY rec), offs AS (SELECT rec, coalesce(sum(length) OVER (ORDER BY rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM lens)"


def recordings(spark, d):
    """Four recordings: channels by what is left of their number by four."""
    return V.signal(spark, d).select((F.col("ch") % 4).alias("rec"), F.floor(F.col("ch") / 4).alias("ch"), "samp", "value")


@query("concatenate_raws", f"WITH {RECS} SELECT rec, ch, samp + off AS samp, value FROM recs JOIN offs USING (rec)", "signal")
def _(spark, d):
    return S.concatenate_raws(recordings(spark, d))


@query("concatenate_raws_boundaries", f"WITH {RECS} SELECT off AS onset, unnest(['BAD boundary', 'EDGE boundary']) AS description FROM offs WHERE rec > (SELECT min(rec) FROM offs)", "signal")
def _(spark, d):
    return S.boundaries(recordings(spark, d))


@query("concatenate_epochs", "WITH n AS (SELECT condition, epoch, row_number() OVER (ORDER BY condition, epoch) - 1 AS new FROM (SELECT DISTINCT condition, epoch FROM epochs)) SELECT condition, new AS epoch, ch, t, value FROM epochs JOIN n USING (condition, epoch)", "epochs")
def _(spark, d):
    return S.concatenate_epochs(V.epochs(spark, d), "condition")


ITEMS = "i AS (SELECT epoch, row_number() OVER (PARTITION BY condition ORDER BY epoch) - 1 AS item FROM (SELECT DISTINCT condition, epoch FROM epochs))"


@query("epochs_getitem_slice", f"WITH {ITEMS} SELECT e.* FROM epochs e JOIN i USING (epoch) WHERE item >= 1 AND item < 14 AND (item - 1) % 3 = 0", "epochs")
def _(spark, d):
    return S.epoch_items(V.epochs(spark, d), 1, 14, 3)


@query("epochs_drop", "SELECT * FROM epochs WHERE epoch NOT IN (SELECT epoch FROM epochs WHERE ch = 0 AND t = 0 AND value > 0.1)", "epochs")
def _(spark, d):
    own = V.epochs(spark, d)
    return S.drop_epochs(own, own.filter("ch = 0 AND t = 0 AND value > 0.1"))[0]


@query("epochs_drop_log", "SELECT DISTINCT epoch, 'USER' AS reason FROM epochs WHERE ch = 0 AND t = 0 AND value > 0.1", "epochs")
def _(spark, d):
    own = V.epochs(spark, d)
    return S.drop_epochs(own, own.filter("ch = 0 AND t = 0 AND value > 0.1"))[1]


@query("add_channels", "SELECT epoch, condition, ch, t, value FROM epochs WHERE ch < 5 AND t < 6 UNION ALL SELECT epoch, condition, ch, t, -value FROM epochs WHERE ch >= 5 AND t < 6", "epochs")
def _(spark, d):
    own = V.epochs(spark, d)
    return S.add_channels(own.filter("ch < 5 AND t < 6"), own.filter("ch >= 3").withColumn("value", -F.col("value")))


@query("match_channel_orders", "WITH c AS (SELECT DISTINCT condition, ch FROM epochs WHERE (ch + condition) % 5 <> 0) SELECT condition, ch, row_number() OVER (PARTITION BY condition ORDER BY (ch * 3) % 8) - 1 AS place FROM c WHERE ch < 7", "epochs")
def _(spark, d):
    own = V.epochs(spark, d).filter("(ch + condition) % 5 <> 0").select("condition", "ch").distinct()
    order = spark.range(7).select(F.col("id").alias("ch"), (F.col("id") * 3 % 8).alias("place"))
    return S.match_channel_orders(own, order, "condition")


@query("raw_getitem", "SELECT ch, samp, value FROM signal WHERE ch IN (1, 2, 3, 5, 8) AND samp >= 3 AND samp < 60 AND (samp - 3) % 2 = 0", "signal")
def _(spark, d):
    return S.raw_items(V.signal(spark, d), [1, 2, 3, 5, 8], 3, 60, 2).select("ch", "samp", "value")


SPECTRA = "f AS (SELECT epoch, condition, ch, k, sum(value * cos(2 * pi() * k * t / 8)) AS c, sum(value * sin(2 * pi() * k * t / 8)) AS s FROM epochs, range(0, 5) r(k) GROUP BY ALL), p AS (SELECT condition, ch, k, avg(c * c + s * s) AS power, count(*)::DOUBLE AS nave FROM f GROUP BY ALL)"


def spectra(spark, d):
    """condition, ch, k, power, nave: mean power over a condition's trials."""
    at = F.lit(2 * math.pi) * F.col("k") * F.col("t") / 8
    ks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))
    f = V.epochs(spark, d).withColumn("k", ks).groupBy("epoch", "condition", "ch", "k").agg(F.sum(F.col("value") * F.cos(at)).alias("c"), F.sum(F.col("value") * F.sin(at)).alias("s"))
    return f.groupBy("condition", "ch", "k").agg(F.avg(F.col("c") ** 2 + F.col("s") ** 2).alias("power"), F.count("*").cast("double").alias("nave"))


for name, w in (("combine_spectrum", "nave"), ("combine_spectrum_equal", "1")):

    @query(name, f"WITH {SPECTRA} SELECT ch, k, round(sum({w} * power) / sum({w}), 6) AS power, sum(nave) AS nave FROM p GROUP BY ALL", "epochs")
    def _(spark, d, w=w):
        return rounded(S.combine_spectra(spectra(spark, d), ("ch", "k"), "nave" if w == "nave" else "equal"), "power")


@query("tfr_baseline_logratio", f"WITH {SPECTRA} SELECT condition, ch, k, round(log10(power / avg(power) FILTER (k BETWEEN 1 AND 2) OVER (PARTITION BY condition, ch)), 6) + 0.0 AS value FROM p", "epochs")
def _(spark, d):
    own = spectra(spark, d).select("condition", "ch", F.col("k").alias("t"), F.col("power").alias("value"))
    return rounded(P.apply_baseline(own, ["condition", "ch"], 1, 2, "logratio").withColumnRenamed("t", "k"))


COV = "m AS (SELECT ch, avg(value) AS m FROM epochs GROUP BY ch), cov AS (SELECT a.ch AS ch_i, b.ch AS ch_j, sum((a.value - x.m) * (b.value - y.m)) / (count(*) - 1) AS value, count(*) AS n FROM epochs a JOIN epochs b USING (epoch, t) JOIN m x ON x.ch = a.ch JOIN m y ON y.ch = b.ch GROUP BY ALL)"


@query("regularize", f"WITH {COV}, k AS (SELECT *, CASE WHEN ch_i < 5 THEN 'mag' ELSE 'eeg' END AS kind FROM cov), l AS (SELECT kind, avg(value) AS level FROM k WHERE ch_i = ch_j GROUP BY kind) SELECT ch_i, ch_j, round(value + CASE WHEN ch_i <> ch_j THEN 0 WHEN kind = 'mag' THEN 0.1 * level ELSE 0.05 * level END, 6) + 0.0 AS value, n FROM k JOIN l USING (kind)", "epochs")
def _(spark, d):
    kind = F.when(F.col("ch_i") < 5, "mag").otherwise("eeg")
    return rounded(S.regularize(C.covariance(V.epochs(spark, d)), {"mag": 0.1, "eeg": 0.05}, kind))


@query("annotations_append", "SELECT rec, onset, duration, description FROM annots UNION ALL SELECT rec, onset + 1, 0.5, 'after' FROM annots WHERE description = 'BAD_error'", "annots")
def _(spark, d):
    own = V.annots(spark, d).drop("event_id")
    more = own.filter("description = 'BAD_error'").select("rec", (F.col("onset") + 1).alias("onset"), F.lit(0.5).alias("duration"), F.lit("after").alias("description"))
    return own.unionByName(more)


@query("annotations_rename", "SELECT event_id, rec, CASE description WHEN 'view' THEN 'look' WHEN 'BAD_error' THEN 'bad' ELSE description END AS description FROM annots", "annots")
def _(spark, d):
    return S.rename_annotations(V.annots(spark, d), {"view": "look", "BAD_error": "bad"}).select("event_id", "rec", "description")


@query("annotations_set_durations", "SELECT event_id, description, CASE description WHEN 'view' THEN 2.5 WHEN 'click' THEN 0.0 ELSE duration END AS duration FROM annots", "annots")
def _(spark, d):
    return S.set_durations(V.annots(spark, d), {"view": 2.5, "click": 0.0}).select("event_id", "description", "duration")


@query("annotations_to_data_frame", "SELECT event_id, epoch_us(TIMESTAMP '2002-12-03 19:01:10') + (onset * 1000000)::BIGINT AS onset_us, duration, description FROM annots", "annots")
def _(spark, d):
    own = S.annotations_frame(V.annots(spark, d), F.lit("2002-12-03 19:01:10+00:00").cast("timestamp"))
    return own.select("event_id", F.unix_micros("onset").alias("onset_us"), "duration", "description")


@query("add_annotations_to_metadata", f"WITH {WINDOWS}, h AS (SELECT e.rec, epoch, string_agg(DISTINCT description, ',' ORDER BY description) AS descriptions FROM epo e JOIN ann a ON a.rec = e.rec AND ((start >= onset AND start < fin) OR (stop > onset AND stop <= fin) OR (start <= onset AND stop >= fin)) GROUP BY ALL) SELECT e.rec, e.epoch, coalesce(descriptions, '') AS descriptions FROM epo e LEFT JOIN h ON h.rec = e.rec AND h.epoch = e.epoch", "annots")
def _(spark, d):
    return S.annotations_in_metadata(*windows(spark, d))


@query("add_events", "SELECT ch, samp, code + CASE WHEN samp % 3 = 0 THEN 8 ELSE 0 END + CASE WHEN samp % 6 = 0 THEN 16 ELSE 0 END AS code FROM signal", "signal")
def _(spark, d):
    own = V.signal(spark, d).select("ch", "samp", "code")
    events = own.filter("samp % 3 = 0").select("ch", "samp", F.lit(8).alias("id")).unionByName(own.filter("samp % 6 = 0").select("ch", "samp", F.lit(16).alias("id")))
    return S.add_events(own, events)


@query("vectorizer", "SELECT epoch, ch * 8 + t AS feature, value FROM epochs", "epochs")
def _(spark, d):
    rows = S.vectorize(V.epochs(spark, d))
    return rows.select("epoch", F.posexplode("features").alias("feature", "value"))


@query("vectorizer_inverse", "SELECT epoch, ch, t, value FROM epochs", "epochs")
def _(spark, d):
    return S.unvectorize(S.vectorize(V.epochs(spark, d)), 8)


SCORES = "s AS (SELECT a.ch, corr(a.value, b.value) AS score FROM epochs a JOIN epochs b USING (epoch, t) WHERE a.ch < 7 AND b.ch = 7 GROUP BY a.ch)"


def scores(spark, d):
    own = V.epochs(spark, d)
    return S.score_sources(own.filter("ch < 7"), own.filter("ch = 7").select("epoch", "t", F.col("value").alias("target")))


@query("score_sources", f"WITH {SCORES} SELECT ch, round(score, 6) + 0.0 AS score FROM s", "epochs")
def _(spark, d):
    return rounded(scores(spark, d), "score")


@query("find_bads_by_score", f"WITH {SCORES}, o AS (SELECT *, abs(score - avg(score) OVER ()) / stddev_pop(score) OVER () > 1.5 AS b FROM s), m AS (SELECT avg(score) AS m, stddev_pop(score) AS s FROM o WHERE NOT b) SELECT ch, round(score, 6) + 0.0 AS score, b OR abs(score - m.m) / m.s > 1.5 AS bad FROM o, m", "epochs")
def _(spark, d):
    return rounded(S.outliers(scores(spark, d), 1.5), "score")


@query("kuiper", "WITH p AS (SELECT ch, t, row_number() OVER w AS i, count(*) OVER (PARTITION BY ch, t) AS n, value * 7 - floor(value * 7) AS x FROM epochs WINDOW w AS (PARTITION BY ch, t ORDER BY value * 7 - floor(value * 7))) SELECT ch, t, round(max(i / n - x) + max(x - (i - 1) / n), 6) AS statistic FROM p GROUP BY ALL", "epochs")
def _(spark, d):
    phase = F.col("value") * 7 - F.floor(F.col("value") * 7)
    return rounded(S.kuiper(V.epochs(spark, d).select("ch", "t", phase.alias("phase"))), "statistic")


WAVE = (0.0, 0.5, 1.0, 0.25, -0.5)


@query("simulate_raw_events", f"SELECT ch, samp + i AS samp, round(sum(value * v), 6) + 0.0 AS value FROM signal, (VALUES {', '.join(f'({i}, {v}::DOUBLE)' for i, v in enumerate(WAVE))}) w(i, v) WHERE code = 3 GROUP BY ALL", "signal")
def _(spark, d):
    return rounded(S.simulate(V.signal(spark, d).filter("code = 3").select("ch", "samp", F.col("value").alias("amplitude")), WAVE))


TRANS = ((0.8, -0.6, 0.0, 1.5), (0.6, 0.8, 0.0, -2.0), (0.0, 0.0, 1.0, 0.25), (0.0, 0.0, 0.0, 1.0))


@query("apply_trans", f"WITH {POINTS} SELECT id, round(0.8 * x - 0.6 * y + 1.5, 6) + 0.0 AS x, round(0.6 * x + 0.8 * y - 2.0, 6) + 0.0 AS y, round(z + 0.25, 6) + 0.0 AS z FROM pts")
def _(spark, d):
    return rounded(S.transform_points(points(spark, d), TRANS), "x", "y", "z")


@query("labels_to_stc", "SELECT p_partkey AS vertex, t, round(sum(v), 6) + 0.0 AS value FROM part JOIN (SELECT condition, t, avg(value) AS v FROM epochs GROUP BY ALL) e ON p_size % 10 = condition OR p_size // 10 = condition GROUP BY ALL", "epochs")
def _(spark, d):
    part = V.table(spark, d, "part")
    label = F.explode(F.array_distinct(F.array((F.col("p_size") % 10).cast("long"), F.floor(F.col("p_size") / 10))))
    courses = V.epochs(spark, d).groupBy(F.col("condition").alias("label"), "t").agg(F.avg("value").alias("value"))
    return rounded(S.labels_to_stc(part.select(F.col("p_partkey").alias("vertex"), label.alias("label")), courses))


@query("stc_mean", "SELECT epoch, t, round(avg(value), 6) + 0.0 AS mean, round(sum(value), 6) + 0.0 AS sum FROM epochs GROUP BY ALL", "epochs")
def _(spark, d):
    own = V.epochs(spark, d).groupBy("epoch", "t").agg(F.avg("value").alias("mean"), F.sum("value").alias("sum"))
    return rounded(own, "mean", "sum")
