"""Queries of cluster statistics with adjacency, and of threshold-free enhancement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as C
from ..operators import stats as S
from . import views as V
from .queries_stats import DRAWN
from .registry import query, r6

#: Draws; thresholds of the t map and of F; levels of the enhancement.
FLIPS, DEALS, FEW = 256, 64, 32
T, F_, STEP, COARSE = 1.5, 2.0, 0.05, 0.25

#: Channels on a grid of two rows of four; those side by side, or one over the other, are adjacent.
SPACE = "space AS (SELECT a.ch AS a, b.ch AS b FROM (SELECT DISTINCT ch FROM epochs) a JOIN (SELECT DISTINCT ch FROM epochs) b ON (a.ch // 4 = b.ch // 4 AND abs(a.ch - b.ch) = 1) OR abs(a.ch - b.ch) = 4)"


def space(spark, d):
    ch = V.epochs(spark, d).select("ch").distinct()
    right = ch.filter("ch % 4 < 3").select(F.col("ch").alias("a"), (F.col("ch") + 1).alias("b"))
    return right.union(ch.filter("ch < 4").select(F.col("ch").alias("a"), (F.col("ch") + 4).alias("b"))).join(ch.select(F.col("ch").alias("b")), "b").select("a", "b")


def reach(cells: str, keys: str) -> str:
    """SQL of linked(keys, a_ch, a_t, ch, t): cells of one key that are joined by steps in space or time."""
    on = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    own = ", ".join(f"x.{k}" for k in keys.split(", "))
    return f"""near AS (SELECT {own}, x.ch AS a_ch, x.t AS a_t, y.ch, y.t FROM {cells} x JOIN {cells} y ON {on} WHERE (x.ch = y.ch AND abs(x.t - y.t) = 1) OR (x.t = y.t AND EXISTS (SELECT 1 FROM space s WHERE s.a = x.ch AND s.b = y.ch))),
linked AS (SELECT {keys}, ch AS a_ch, t AS a_t, ch, t FROM {cells} UNION SELECT {own}, x.a_ch, x.a_t, y.ch, y.t FROM linked x JOIN near y ON {on} AND x.ch = y.a_ch AND x.t = y.a_t),
labels AS (SELECT {keys}, a_ch AS ch, a_t AS t, min(struct_pack(ch := ch, t := t)) AS label, count(*) AS size FROM linked GROUP BY {keys}, a_ch, a_t)"""


def flips(n: int) -> str:
    """SQL of x(k, ch, t, x): the t maps of n sign flips."""
    return f"""c AS (SELECT ch, t, sum(value * value) AS q, count(*) AS n FROM epochs GROUP BY ALL),
f AS (SELECT k, ch, t, sum(CASE WHEN k > 0 AND {DRAWN} % 2 = 1 THEN -value ELSE value END) AS s FROM epochs, range({n}) r(k) GROUP BY ALL),
x AS (SELECT k, ch, t, s / n / sqrt((q - s * s / n) / (n - 1) / n) AS x FROM f JOIN c USING (ch, t))"""


def clusters_sql(maps: str, threshold: float, n: int, tail: int) -> str:
    sign = f"CASE WHEN x > {threshold} THEN 1 {f'WHEN x < -{threshold} THEN -1' if tail == 0 else ''} END"
    return f"""WITH RECURSIVE {SPACE}, {maps}, act AS MATERIALIZED (SELECT * FROM (SELECT k, ch, t, x, {sign} AS sign FROM x) WHERE sign IS NOT NULL), {reach("act", "k, sign")},
cl AS (SELECT k, sign, label, count(*) AS size, sum(x) AS mass FROM act JOIN labels USING (k, sign, ch, t) GROUP BY ALL), top AS (SELECT max(abs(mass)) AS top FROM cl GROUP BY k)
SELECT sign::BIGINT AS sign, label.ch AS ch, label.t AS t, size, round(mass, 6) + 0.0 AS mass, (SELECT count(*) FROM top WHERE top >= abs(mass) * (1 - 1e-12)) / {n}.0::DOUBLE AS p_value FROM cl WHERE k = 0"""


def listed(judged):
    return judged.select("sign", F.col("label.ch").alias("ch"), F.col("label.t").alias("t"), "size", r6(F.col("mass")).alias("mass"), *(c for c in judged.columns if c == "p_value"))


@query("find_clusters_adjacency", f"WITH RECURSIVE {SPACE}, s AS (SELECT ch, t, avg(value) / sqrt(var_samp(value) / count(*)) AS x FROM epochs GROUP BY ALL), act AS (SELECT * FROM (SELECT ch, t, x, CASE WHEN x > 0.5 THEN 1 WHEN x < -0.5 THEN -1 END AS sign FROM s) WHERE sign IS NOT NULL), {reach('act', 'sign')} SELECT sign::BIGINT AS sign, label.ch AS ch, label.t AS t, count(*) AS size, round(sum(x), 6) + 0.0 AS mass FROM act JOIN labels USING (sign, ch, t) GROUP BY ALL", "epochs")
def _(spark, d):
    """Clusters of the observed map in space and time; a cluster's name is its least cell."""
    cells = C.as_nodes(S.ttest_1samp(V.epochs(spark, d))).withColumn("perm", F.lit(0).cast("long"))
    return listed(C.masses(C.members(cells, 0.5, C.in_time(space(spark, d)))))


@query("spatio_temporal_cluster_1samp_test", clusters_sql(flips(FLIPS), T, FLIPS, 0), "epochs")
def _(spark, d):
    maps = C.as_nodes(S.flipped(V.epochs(spark, d), FLIPS, "epoch"))
    return listed(C.cluster_test(maps, FLIPS, T, C.in_time(space(spark, d)))[0])


#: Epochs dealt to the conditions anew: the draw's order of epochs, cut at the conditions' sizes.
DEALT = f"""g AS (SELECT condition, count(*) AS c FROM (SELECT DISTINCT epoch, condition FROM epochs) GROUP BY 1), ends AS (SELECT condition, sum(c) OVER (ORDER BY condition) AS upto FROM g),
r AS (SELECT epoch, k, row_number() OVER (PARTITION BY k ORDER BY {DRAWN.removesuffix(' // 65536')}, epoch) - 1 AS rank FROM (SELECT DISTINCT epoch FROM epochs), range(1, {DEALS}) r(k)),
deal AS (SELECT epoch, k, (SELECT min(condition) FROM ends WHERE upto > rank) AS grp FROM r UNION ALL SELECT DISTINCT epoch, 0, condition FROM epochs),
per AS (SELECT k, grp, ch, t, sum(value) AS s, count(*) AS n FROM epochs JOIN deal USING (epoch) GROUP BY ALL),
w AS (SELECT ch, t, sum(value * value) AS q, sum(value) AS s, count(*) AS n FROM epochs GROUP BY ALL),
x AS (SELECT k, ch, t, (b - w.s * w.s / w.n) / (m - 1) / ((w.q - b) / (w.n - m)) AS x FROM (SELECT k, ch, t, sum(s * s / n) AS b, count(*) AS m FROM per GROUP BY ALL) JOIN w USING (ch, t))"""


@query("spatio_temporal_cluster_test", clusters_sql(DEALT, F_, DEALS, 1), "epochs")
def _(spark, d):
    """Clusters of the one-way F over conditions, judged by dealing the epochs to the conditions anew."""
    maps = C.as_nodes(C.permuted_f(V.epochs(spark, d), DEALS, "epoch", "condition"))
    return listed(C.cluster_test(maps, DEALS, F_, C.in_time(space(spark, d)), tail=1)[0])


def tfce_sql(step: float) -> str:
    """SQL of scores(k, ch, t, x, score) over a grid of thresholds, each with its components."""
    return f"""lv AS (SELECT k, i, ch, t, sign(x)::BIGINT AS sign FROM x, range(1, 1000) r(i) WHERE i * {step} < abs(x)), {reach("lv", "k, i, sign")},
scores AS (SELECT x.k, x.ch, x.t, x.x, coalesce(sum({step}::DOUBLE ** 2 * sqrt(l.size)), 0) AS score FROM x LEFT JOIN labels l ON l.k = x.k AND l.ch = x.ch AND l.t = x.t AND l.sign = sign(x.x) GROUP BY ALL)"""


@query("tfce", f"WITH RECURSIVE {SPACE}, x AS (SELECT 0 AS k, ch, t, avg(value) / sqrt(var_samp(value) / count(*)) AS x FROM epochs GROUP BY ALL), {tfce_sql(STEP)} SELECT ch, t, round(x, 6) + 0.0 AS t_value, round(score, 6) + 0.0 AS score FROM scores", "epochs")
def _(spark, d):
    """The enhanced observed map: components from a tree, the thresholds between its levels in closed form."""
    cells = S.ttest_1samp(V.epochs(spark, d)).withColumn("perm", F.lit(0).cast("long"))
    return C.tfce(cells, space(spark, d), step=STEP).select("ch", "t", r6(F.col("t_value")).alias("t_value"), r6(F.col("score")).alias("score"))


@query("tfce_permutation_test", f"WITH RECURSIVE {SPACE}, {flips(FEW)}, {tfce_sql(COARSE)}, top AS (SELECT max(score) AS top FROM scores GROUP BY k) SELECT ch, t, round(x, 6) + 0.0 AS t_value, round(score, 6) + 0.0 AS score, (SELECT count(*) FROM top WHERE top >= score * (1 - 1e-12)) / {FEW}.0::DOUBLE AS p_value FROM scores WHERE k = 0", "epochs")
def _(spark, d):
    found = C.tfce_test(S.flipped(V.epochs(spark, d), FEW, "epoch"), FEW, space=space(spark, d), step=COARSE)
    return found.withColumns({c: r6(F.col(c)) for c in ("t_value", "score")})
