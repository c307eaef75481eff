"""Queries on event lists, trigger channels and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotations as A
from ..operators import events as E
from . import views as V
from .registry import query, r6

STEPS = "SELECT ch, samp, was AS before, code AS after FROM (SELECT *, lag(code) OVER (PARTITION BY ch ORDER BY samp) AS was FROM signal) WHERE was <> code"
#: Steps with a closing step to 0 after each channel's last sample.
CLOSED = f"steps AS ({STEPS}), closed AS (SELECT * FROM steps UNION ALL SELECT ch, n AS samp, after AS before, 0 AS after FROM (SELECT ch, max_by(after, samp) AS after FROM steps GROUP BY ch) JOIN (SELECT ch, max(samp) + 1 AS n FROM signal GROUP BY ch) USING (ch) WHERE after <> 0)"


@query("find_stim_steps", STEPS, "signal")
def _(spark, d):
    return E.find_stim_steps(V.signal(spark, d))


@query("find_stim_steps_pad", f"WITH {CLOSED} SELECT * FROM closed UNION ALL SELECT ch, 0 AS samp, 7 AS before, before AS after FROM (SELECT ch, min_by(before, samp) AS before FROM closed GROUP BY ch) WHERE before <> 7", "signal")
def _(spark, d):
    return E.find_stim_steps(V.signal(spark, d), pad_start=7, pad_stop=0)


for sign in (1, -1):
    moved = "before <> after AND NOT coalesce(nxt - samp <= 1, false)" if sign > 0 else "NOT coalesce(samp - prv <= 1, false)"
    value = ("CASE WHEN samp - prv <= 1 THEN pb ELSE before END AS before, after" if sign > 0 else "before, CASE WHEN nxt - samp <= 1 THEN na ELSE after END AS after")
    drop = "coalesce(nxt - samp <= 1, false)" if sign > 0 else "coalesce(samp - prv <= 1, false)"

    @query(f"find_stim_steps_merge_{'later' if sign > 0 else 'earlier'}", f"WITH s AS ({STEPS}), w AS (SELECT *, lead(samp) OVER v AS nxt, lag(samp) OVER v AS prv, lag(before) OVER v AS pb, lead(after) OVER v AS na FROM s WINDOW v AS (PARTITION BY ch ORDER BY samp)), m AS (SELECT ch, samp, {value}, {drop} AS gone, max({drop}) OVER (PARTITION BY ch) AS touched FROM w) SELECT ch, samp, before, after FROM m WHERE NOT gone AND (NOT touched OR before <> after)", "signal")
    def _(spark, d, sign=sign):
        return E.find_stim_steps(V.signal(spark, d), merge=sign)


RULES = {"increasing": ("after > before", "(after > before OR after = 0) AND before > 0"), "true": ("after > 0", "before > 0"), "false": ("before = 0", "after = 0")}
for kind, (on, off) in RULES.items():
    marked = f"WITH {CLOSED}, m AS (SELECT *, {on} AS a, {off} AS z FROM closed), o AS (SELECT *, min(CASE WHEN a THEN samp END) OVER p AS a0, min(CASE WHEN z THEN samp END) OVER p AS z0, max(CASE WHEN a THEN samp END) OVER p AS a1, max(CASE WHEN z THEN samp END) OVER p AS z1 FROM m WINDOW p AS (PARTITION BY ch)), f AS (SELECT ch, samp, before, after, a AND NOT (a1 > z1 AND samp = a1) AS a, z AND NOT (a0 > z0 AND samp = z0) AS z FROM o WHERE a0 IS NOT NULL AND z0 IS NOT NULL) "
    outputs = {
        "onset": "SELECT ch, samp, before AS prev_id, after AS id FROM f WHERE a",
        "step": "SELECT ch, samp, before AS prev_id, after AS id FROM f WHERE a OR z",
        "offset": "SELECT ch, z.samp - 1 AS samp, z.after AS prev_id, a.after AS id FROM (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY samp) AS k FROM f WHERE a) a JOIN (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY samp) AS k FROM f WHERE z) z USING (ch, k)",
    }
    for output, select in outputs.items():

        @query(f"find_events_{kind}_{output}", marked + select, "signal")
        def _(spark, d, kind=kind, output=output):
            return E.find_events(V.signal(spark, d), output, {"true": True, "false": False}.get(kind, kind))


@query("find_events_mask", f"WITH {CLOSED}, m AS (SELECT ch, samp, before & 1 AS before, after & 1 AS after FROM closed WHERE (before & 1) <> (after & 1)), o AS (SELECT *, max(CASE WHEN after > before THEN samp END) OVER p AS a1, max(CASE WHEN after = 0 THEN samp END) OVER p AS z1, min(CASE WHEN after = 0 THEN samp END) OVER p AS z0 FROM m WINDOW p AS (PARTITION BY ch)) SELECT ch, samp, before AS prev_id, after AS id FROM o WHERE after > before AND z0 IS NOT NULL AND NOT (a1 > z1 AND samp = a1)", "signal")
def _(spark, d):
    return E.find_events(V.signal(spark, d), mask=1)


@query("pick_events_include", "SELECT * FROM markers WHERE id IN (1, 4)", "markers")
def _(spark, d):
    return E.pick_events(V.markers(spark, d), include=[1, 4])


@query("pick_events_exclude_step", "SELECT * FROM markers WHERE NOT (id IN (2, 5) OR prev_id IN (2, 5))", "markers")
def _(spark, d):
    return E.pick_events(V.markers(spark, d), exclude=[2, 5], step=True)


MERGED = "SELECT samp, CASE WHEN prev_id IN (1, 2) THEN 12 ELSE prev_id END AS prev_id, CASE WHEN id IN (1, 2) THEN 12 ELSE id END AS id, row FROM markers"


@query("merge_events_replace", MERGED, "markers")
def _(spark, d):
    return E.merge_events(V.markers(spark, d), [1, 2], 12)


@query("merge_events_keep", f"SELECT samp, prev_id, id FROM ({MERGED} UNION ALL SELECT * FROM markers WHERE id IN (1, 2) OR prev_id IN (1, 2))", "markers")
def _(spark, d):
    return E.merge_events(V.markers(spark, d), [1, 2], 12, replace=False).drop("row")


@query("shift_time_events", "SELECT CASE WHEN id IN (2, 3) THEN samp + 50 ELSE samp END AS samp, prev_id, id, row FROM markers", "markers")
def _(spark, d):
    return E.shift_events(V.markers(spark, d), [2, 3], 0.5, 100.0)


@query("count_events", "SELECT id, count(*) AS n FROM markers GROUP BY id", "markers")
def _(spark, d):
    return E.count_events(V.markers(spark, d))


TARGET = "h AS (SELECT r.row, r.samp, r.prev_id, min_by(t.samp, t.row) AS t_samp FROM markers r JOIN markers t ON t.id = 2 AND t.samp > r.samp + 60 AND t.samp < r.samp + 3600 WHERE r.id = 4 GROUP BY ALL)"


@query("define_target_events", f"WITH {TARGET} SELECT samp, prev_id, 44::BIGINT AS id, abs(samp - t_samp) * 1e3 AS lag, row FROM h", "markers")
def _(spark, d):
    return E.define_target_events(V.markers(spark, d), 4, 2, 1.0, 60.0, 3600.0, new_id=44)


@query("define_target_events_fill", f"WITH {TARGET} SELECT samp, prev_id, 44::BIGINT AS id, abs(samp - t_samp) * 1e3 AS lag, row FROM h UNION ALL SELECT samp, prev_id, 99, NULL, row FROM markers WHERE id = 4 AND row NOT IN (SELECT row FROM h)", "markers")
def _(spark, d):
    return E.define_target_events(V.markers(spark, d), 4, 2, 1.0, 60.0, 3600.0, new_id=44, fill_na=99)


@query("make_fixed_length_events", "SELECT ch, floor(unnest(range(0, floor((n - 10) / 7.5)::BIGINT + 1)) * 7.5)::BIGINT AS samp, 0::BIGINT AS prev_id, 1::BIGINT AS id FROM (SELECT ch, count(*) AS n FROM signal GROUP BY ch) WHERE n >= 10", "signal")
def _(spark, d):
    spans = V.signal(spark, d).groupBy("ch").agg(F.min("samp").alias("first"), F.max("samp").alias("last"))
    return E.make_fixed_length_events(spans, 10.0, 1.0, 0.25)


@query("concatenate_events", "WITH s AS (SELECT ch AS rec, min(samp) + ch % 7 AS first, max(samp) + ch % 7 AS last FROM signal GROUP BY ch), o AS (SELECT *, coalesce(sum(last - first + 1) OVER (ORDER BY rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, first_value(first) OVER (ORDER BY rec) AS zero FROM s) SELECT ch AS rec, samp + ch % 7 - first + before + zero AS samp, 0::BIGINT AS prev_id, code AS id FROM signal JOIN o ON rec = ch WHERE code > 0", "signal")
def _(spark, d):
    sig = V.signal(spark, d).withColumns({"rec": F.col("ch"), "samp": F.col("samp") + F.col("ch") % 7})
    spans = sig.groupBy("rec").agg(F.min("samp").alias("first"), F.max("samp").alias("last"))
    events = sig.filter("code > 0").select("rec", "samp", F.lit(0).cast("long").alias("prev_id"), F.col("code").alias("id"))
    return E.concatenate_events(events, spans)


COARSE = "coarse AS (SELECT samp // 600 AS samp, prev_id, id, row FROM markers)"


def coarse(spark, d):
    return V.markers(spark, d).withColumn("samp", F.floor(F.col("samp") / 600))


@query("event_repeated_drop", f"WITH {COARSE} SELECT samp, prev_id, id, row FROM coarse QUALIFY row_number() OVER (PARTITION BY samp ORDER BY row) = 1", "markers")
def _(spark, d):
    return E.handle_repeated(coarse(spark, d), "drop")


@query("event_repeated_merge", f"WITH {COARSE} SELECT samp, min_by(prev_id, row) AS prev_id, string_agg(DISTINCT id::VARCHAR, '/' ORDER BY id::VARCHAR) AS tags, min(row) AS row FROM coarse GROUP BY samp", "markers")
def _(spark, d):
    return E.handle_repeated(coarse(spark, d), "merge")


@query("combine_event_ids", "SELECT samp, prev_id, CASE WHEN id IN (1, 2, 3) THEN 100 ELSE id END AS id, row FROM markers", "markers")
def _(spark, d):
    return V.markers(spark, d).withColumn("id", F.when(F.col("id").isin(1, 2, 3), 100).otherwise(F.col("id")))


@query("equalize_event_counts", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row) AS k FROM markers) SELECT samp, prev_id, id, row FROM k WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM markers GROUP BY id))", "markers")
def _(spark, d):
    return E.equalize_counts(V.markers(spark, d))


@query("make_metadata", "SELECT r.row, r.samp, r.id, min(CASE WHEN o.id = 1 THEN (o.samp - r.samp) / 10.0 END) AS stimulus, min(CASE WHEN o.id = 2 THEN (o.samp - r.samp) / 10.0 END) AS response FROM markers r JOIN markers o ON o.samp BETWEEN r.samp - 300 AND r.samp + 1800 WHERE r.id IN (4, 5) GROUP BY ALL", "markers")
def _(spark, d):
    return E.make_metadata(V.markers(spark, d), [4, 5], {"stimulus": 1, "response": 2}, -300, 1800, 10.0)


@query("epochs_from_events", "SELECT m.ch, m.samp AS event, m.code, s.samp - m.samp AS t, s.value FROM signal m JOIN signal s ON s.ch = m.ch AND s.samp BETWEEN m.samp - 2 AND m.samp + 5 WHERE m.code = 3 AND m.samp >= 2 AND m.samp + 5 < (SELECT count(*) FROM signal x WHERE x.ch = m.ch)", "signal")
def _(spark, d):
    from ..operators import epochs as P

    sig = V.signal(spark, d)
    return P.from_events(sig.select("ch", "samp", "value"), sig.filter("code = 3").select("ch", F.col("samp").alias("event"), "code"), -2, 5)


WINDOWS = "epo AS (SELECT rec, event_id AS epoch, onset AS zero, onset - 120 AS start, onset + 300 AS stop FROM annots WHERE description = 'purchase'), ann AS (SELECT *, onset + duration AS fin FROM annots)"


def windows(spark, d):
    own = V.annots(spark, d)
    return own.filter("description = 'purchase'").select("rec", F.col("event_id").alias("epoch"), F.col("onset").alias("zero"), (F.col("onset") - 120).alias("start"), (F.col("onset") + 300).alias("stop")), own


@query("annotations_per_epoch", f"WITH {WINDOWS} SELECT e.rec, epoch, onset - zero AS onset, duration, description FROM epo e JOIN ann a ON a.rec = e.rec AND ((start >= onset AND start < fin) OR (stop > onset AND stop <= fin) OR (start <= onset AND stop >= fin))", "annots")
def _(spark, d):
    return A.annotations_per_epoch(*windows(spark, d))


@query("reject_by_annotation", f"WITH {WINDOWS} SELECT * FROM epo e WHERE NOT EXISTS (SELECT 1 FROM ann a WHERE a.rec = e.rec AND lower(description) LIKE 'bad%' AND start < fin AND onset < stop)", "annots")
def _(spark, d):
    return A.reject_by_annotation(*windows(spark, d))


@query("crop_annotations", "SELECT rec, greatest(onset, 86400.0) AS onset, least(onset + duration, 864000.0) - greatest(onset, 86400.0) AS duration, description, event_id FROM annots WHERE onset <= 864000 AND onset + duration >= 86400", "annots")
def _(spark, d):
    return A.crop(V.annots(spark, d), 86400.0, 864000.0)


PERIODS = "m AS (SELECT *, onset + duration AS fin FROM annots WHERE NOT (lower(description) LIKE 'bad%' OR lower(description) LIKE 'edge%')), g AS (SELECT *, max(fin) OVER (PARTITION BY rec ORDER BY onset, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM m), r AS (SELECT *, sum(CASE WHEN top IS NULL OR onset > top THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY onset, event_id) AS run FROM g), p AS (SELECT rec, min(onset) AS start, max(fin) AS stop FROM r GROUP BY rec, run)"


@query("merge_intervals", f"WITH {PERIODS} SELECT * FROM p", "annots")
def _(spark, d):
    return A.merged(V.annots(spark, d).filter(~A.is_bad(F.col("description"))))


@query("annotate_break", f"WITH {PERIODS}, w AS (SELECT *, lag(stop) OVER v AS prv, lead(start) OVER v AS nxt FROM p WINDOW v AS (PARTITION BY rec ORDER BY start)) SELECT rec, 0.0 AS onset, start - 300 AS duration, 'BAD_break' AS description FROM w WHERE prv IS NULL AND start > 0 AND start >= 1000 UNION ALL SELECT rec, prv + 300, start - 300 - prv - 300, 'BAD_break' FROM w WHERE start - prv >= 1000 UNION ALL SELECT rec, stop + 300, 2592000 - stop - 300, 'BAD_break' FROM w WHERE nxt IS NULL AND 2592000 - stop >= 1000", "annots")
def _(spark, d):
    return A.annotate_break(V.annots(spark, d), 2592000.0, 1000.0, 300.0, 300.0)


@query("count_annotations", "SELECT description, count(*) AS n FROM annots GROUP BY description", "annots")
def _(spark, d):
    return V.annots(spark, d).groupBy("description").agg(F.count("*").alias("n"))


@query("events_from_annotations", "SELECT rec, round_even(onset * 2.5, 0)::BIGINT AS samp, 0::BIGINT AS prev_id, CASE description WHEN 'view' THEN 1 WHEN 'click' THEN 2 END::BIGINT AS id FROM annots WHERE description IN ('view', 'click')", "annots")
def _(spark, d):
    return A.events_from_annotations(V.annots(spark, d), {"view": 1, "click": 2, "BAD_error": 9}, 2.5)


@query("annotations_from_events", "SELECT samp / 4.0 AS onset, 0.0 AS duration, CASE id WHEN 1 THEN 'view' ELSE 'other' END AS description, row FROM markers", "markers")
def _(spark, d):
    return V.markers(spark, d).select((F.col("samp") / 4.0).alias("onset"), F.lit(0.0).alias("duration"), F.when(F.col("id") == 1, "view").otherwise("other").alias("description"), "row")


@query("annotate_amplitude", "WITH s AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY ch ORDER BY samp)) AS step FROM signal), i AS (SELECT *, samp - row_number() OVER (PARTITION BY ch ORDER BY samp) AS island FROM s WHERE step >= 60), r AS (SELECT ch, min(samp) AS a, max(samp) + 1 AS z FROM i GROUP BY ch, island), bad AS (SELECT ch FROM r JOIN (SELECT ch, count(*) AS n FROM signal GROUP BY ch) USING (ch) WHERE z - a >= 2 GROUP BY ch, n HAVING 100.0 * sum(z - a) / n >= 40) SELECT ch, a / 10.0 AS onset, (z - a) / 10.0 AS duration, 'BAD_peak' AS description FROM r WHERE z - a >= 2 AND ch NOT IN (SELECT ch FROM bad)", "signal")
def _(spark, d):
    return A.annotate_amplitude(V.signal(spark, d), 60.0, -1.0, 10.0, 40.0, 0.2)[0]


@query("annotate_nan", "WITH i AS (SELECT ch, samp, samp - row_number() OVER (PARTITION BY ch ORDER BY samp) AS island FROM signal WHERE value < 20) SELECT ch, min(samp) / 10.0 AS onset, count(*) / 10.0 AS duration, 'BAD_NAN' AS description FROM i GROUP BY ch, island", "signal")
def _(spark, d):
    return A.annotate_nan(V.signal(spark, d).withColumn("value", F.when(F.col("value") < 20, float("nan")).otherwise(F.col("value"))), 10.0)


@query("interpolate_blinks", "WITH b AS (SELECT ch, samp, value, code <> 5 AS good FROM signal), w AS (SELECT *, last_value(CASE WHEN good THEN samp END IGNORE NULLS) OVER p AS s0, last_value(CASE WHEN good THEN value END IGNORE NULLS) OVER p AS v0, first_value(CASE WHEN good THEN samp END IGNORE NULLS) OVER q AS s1, first_value(CASE WHEN good THEN value END IGNORE NULLS) OVER q AS v1 FROM b WINDOW p AS (PARTITION BY ch ORDER BY samp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY ch ORDER BY samp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT ch, samp, round(CASE WHEN good THEN value ELSE coalesce(v0 + (v1 - v0) * (samp - s0) / (s1 - s0), v0, v1) END, 6) + 0.0 AS value FROM w", "signal")
def _(spark, d):
    sig = V.signal(spark, d)
    return A.interpolate(sig.select("ch", "samp", "value"), A.runs_of(sig, F.col("code") == 5, ["ch"])).withColumn("value", r6(F.col("value")))


@query("head_position_as_of", "WITH x AS (SELECT ch, samp, code, last_value(CASE WHEN code = 2 THEN value END IGNORE NULLS) OVER (PARTITION BY ch ORDER BY samp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS position FROM signal) SELECT ch, samp, position FROM x WHERE code = 3", "signal")
def _(spark, d):
    from ..operators import epochs as P

    sig = V.signal(spark, d)
    times, positions = sig.filter("code = 3").select("ch", "samp"), sig.filter("code = 2").select("ch", "samp", F.col("value").alias("position"))
    return P.as_of(times, positions, ["ch"], "samp", ["position"])
