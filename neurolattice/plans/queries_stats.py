"""Queries of statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from . import views as V
from .registry import query, r6


def rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


CELLS = "c AS (SELECT ch, t, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM epochs GROUP BY ALL)"


@query("ttest_1samp", f"WITH {CELLS} SELECT ch, t, round(m / sqrt(v / n), 6) + 0.0 AS t_value FROM c", "epochs")
def _(spark, d):
    return rounded(S.ttest_1samp(V.epochs(spark, d)), "t_value")


@query("ttest_1samp_hat", f"WITH {CELLS} SELECT ch, t, round(m / sqrt((v + 0.001 * max(v) OVER ()) / n), 6) + 0.0 AS t_value FROM c", "epochs")
def _(spark, d):
    return rounded(S.ttest_1samp(V.epochs(spark, d), 1e-3), "t_value")


TWO = "c AS (SELECT ch, t, avg(value) FILTER (condition = 1) AS m1, avg(value) FILTER (condition = 2) AS m2, var_samp(value) FILTER (condition = 1) AS s1, var_samp(value) FILTER (condition = 2) AS s2, count(*) FILTER (condition = 1) AS n1, count(*) FILTER (condition = 2) AS n2 FROM epochs WHERE condition IN (1, 2) GROUP BY ALL)"
POOLED, WELCH = "((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)", "s1 / n1 + s2 / n2"
for name, var, equal, sigma in (("ttest_ind", POOLED, True, 0.0), ("ttest_ind_welch", WELCH, False, 0.0), ("ttest_ind_hat", POOLED, True, 1e-2)):

    @query(name, f"WITH {TWO}, v AS (SELECT *, {var} AS v FROM c) SELECT ch, t, round((m1 - m2) / sqrt(v + {sigma} * max(v) OVER ()), 6) + 0.0 AS t_value FROM v", "epochs")
    def _(spark, d, equal=equal, sigma=sigma):
        return rounded(S.ttest_ind(V.epochs(spark, d), 1, 2, equal, sigma), "t_value")


ONEWAY = "p AS (SELECT condition, ch, t, sum(value) AS s, sum(value * value) AS q, count(*) AS n FROM epochs GROUP BY ALL), c AS (SELECT ch, t, sum(q) AS q, sum(s) AS s, sum(s * s / n) AS b, sum(n) AS n, count(*) AS k FROM p GROUP BY ALL), w AS (SELECT *, b - s * s / n AS between_, q - b AS within_ FROM c)"
for name, hat in (("f_oneway", "0"), ("f_oneway_hat", "0.01 * (SELECT median(within_ / (n - k)) FROM w)")):

    @query(name, f"WITH {ONEWAY} SELECT ch, t, round(between_ / (k - 1) / ((within_ + {hat}) / (n - k)), 6) + 0.0 AS f_value FROM w", "epochs")
    def _(spark, d, sigma=0.0 if hat == "0" else 0.01):
        return rounded(S.f_oneway(V.epochs(spark, d), sigma), "f_value")


@query("linear_regression", "WITH r AS (SELECT ch, t, regr_slope(value, condition) AS beta, regr_intercept(value, condition) AS intercept, regr_sxx(value, condition) AS sxx, regr_syy(value, condition) AS syy, regr_sxy(value, condition) AS sxy, count(*) AS n FROM epochs GROUP BY ALL), e AS (SELECT *, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS stderr FROM r) SELECT ch, t, round(beta, 6) + 0.0 AS beta, round(intercept, 6) + 0.0 AS intercept, round(stderr, 6) AS stderr, round(beta / stderr, 6) + 0.0 AS t_value FROM e", "epochs")
def _(spark, d):
    return rounded(S.linear_regression(V.epochs(spark, d), "condition"), "beta", "intercept", "stderr", "t_value")


P_VALUES = "p AS (SELECT event_id, (1 + event_id * 7919 % 9973) / 9974.0 * CASE WHEN event_id % 10 = 0 THEN 0.001 ELSE 1 END AS p FROM events)"


def p_values(spark, d):
    e = F.col("event_id")
    return V.table(spark, d, "events").select("event_id", ((1 + e * 7919 % 9973) / 9974.0 * F.when(e % 10 == 0, 0.001).otherwise(1.0)).alias("p"))


@query("bonferroni_correction", f"WITH {P_VALUES} SELECT event_id, p, least(p * count(*) OVER (), 1.0) AS corrected, least(p * count(*) OVER (), 1.0) < 0.05 AS reject FROM p")
def _(spark, d):
    return S.bonferroni(p_values(spark, d))


for method, cm in (("indep", "1"), ("negcorr", "(SELECT sum(1.0 / i) FROM range(1, (SELECT count(*) FROM p) + 1) r(i))")):

    @query(f"fdr_correction_{method}", f"WITH {P_VALUES}, r AS (SELECT *, row_number() OVER (ORDER BY p, event_id) AS rank, count(*) OVER () AS n FROM p), e AS (SELECT *, rank / n / {cm} AS e FROM r), l AS (SELECT max(rank) AS l FROM e WHERE p < e * 0.05) SELECT event_id, round(p, 9) AS p, round(least(min(p / e) OVER (ORDER BY rank DESC), 1.0), 9) AS corrected, coalesce(rank <= l, false) AS reject FROM e, l")
    def _(spark, d, method=method):
        return S.fdr(p_values(spark, d), ["event_id"], 0.05, method).withColumns({c: F.round(c, 9) for c in ("p", "corrected")})


@query("find_clusters", f"WITH {CELLS}, s AS (SELECT ch, t, m / sqrt(v / n) AS x FROM c), g AS (SELECT *, CASE WHEN x > 0.5 THEN 1 WHEN x < -0.5 THEN -1 END AS sign FROM s), i AS (SELECT *, t - row_number() OVER (PARTITION BY ch, sign ORDER BY t) AS island FROM g WHERE sign IS NOT NULL) SELECT ch, sign::BIGINT AS sign, min(t) AS start, max(t) + 1 AS stop, round(sum(x), 6) + 0.0 AS mass FROM i GROUP BY ch, sign, island", "epochs")
def _(spark, d):
    return rounded(S.clusters(S.ttest_1samp(V.epochs(spark, d)), 0.5), "mass")


SUBJECTS = "x AS (SELECT *, epoch % 20 AS subject FROM epochs)"


@query("f_mway_rm", f"WITH {SUBJECTS}, f AS (SELECT subject, epoch // 20 % 3 AS level, ch, t, avg(value) AS v FROM x GROUP BY ALL), w AS (SELECT *, avg(v) OVER (PARTITION BY ch, t, subject) AS s, avg(v) OVER (PARTITION BY ch, t, level) AS l, avg(v) OVER (PARTITION BY ch, t) AS g FROM f) SELECT ch, t, round((sum((l - g) ** 2) / 2) / (sum((v - s - l + g) ** 2) / (2 * 19)), 6) + 0.0 AS f_value FROM w GROUP BY ALL", "epochs")
def _(spark, d):
    own = V.epochs(spark, d).withColumns({"subject": F.col("epoch") % 20, "level": F.floor(F.col("epoch") / 20) % 3})
    return rounded(S.anova_rm(own, "subject", "level"), "f_value")


#: Signs and resampling by a rule that both engines can follow, of the draw k and the epoch.
X = "(epoch % 2147483647 * 48271 + k * 104729 + 1) % 2147483647"
DRAWN = f"(({X}) * ({X}) + k * 7919) % 2147483647 * 16807 % 2147483647 // 65536"
FLIPS, BOOTS = 256, 200


@query("permutation_t_test", f"WITH c AS (SELECT ch, t, sum(value * value) AS q, count(*) AS n FROM epochs GROUP BY ALL), s AS (SELECT k, ch, t, sum(CASE WHEN k > 0 AND {DRAWN} % 2 = 1 THEN -value ELSE value END) AS s FROM epochs, range({FLIPS}) r(k) GROUP BY ALL), x AS (SELECT k, ch, t, s / n / sqrt((q - s * s / n) / (n - 1) / n) AS x FROM s JOIN c USING (ch, t)), top AS (SELECT k, max(abs(x)) AS top FROM x GROUP BY k) SELECT ch, t, round(x, 6) + 0.0 AS t_value, (SELECT count(*) FROM top WHERE top >= abs(x) * (1 - 1e-12)) / {FLIPS}.0 AS p_value FROM x WHERE k = 0", "epochs")
def _(spark, d):
    return rounded(S.permutation_t(V.epochs(spark, d), FLIPS, "epoch"), "t_value")


TIMES = " + ".join(f"({DRAWN} % 1000 >= {limit})::INT" for limit in S.POISSON)


@query("bootstrap_confidence_interval", f"WITH o AS (SELECT k, ch, t, value, {TIMES} AS times FROM epochs, range({BOOTS}) r(k)), b AS (SELECT k, ch, t, sum(times * value) / sum(times) AS m FROM o GROUP BY ALL) SELECT ch, t, round(quantile_cont(m, 0.025), 6) + 0.0 AS low, round(quantile_cont(m, 0.975), 6) + 0.0 AS high FROM b GROUP BY ALL", "epochs")
def _(spark, d):
    return rounded(S.bootstrap_ci(V.epochs(spark, d), BOOTS, "epoch"), "low", "high")


#: Two predictors and a constant, by their central moments.
MANY = """WITH x AS (SELECT ch, t, value AS y, (epoch % 11)::DOUBLE AS a, (condition * condition)::DOUBLE AS b FROM epochs),
m AS (SELECT ch, t, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_, var_pop(y) * count(*) AS yy FROM x GROUP BY ch, t),
d AS (SELECT *, aa * bb - ab * ab AS det, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ba, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS b_b FROM m),
r AS (SELECT *, (yy - ba * ay - b_b * by_) / (n - 3) AS v FROM d),
o AS (SELECT ch, t, 'a' AS name, ba AS beta, sqrt(v * bb / det) AS stderr FROM r UNION ALL SELECT ch, t, 'b', b_b, sqrt(v * aa / det) FROM r UNION ALL SELECT ch, t, 'one', my - ba * ma - b_b * mb, sqrt(v * (1.0 / n + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / det)) FROM r)
SELECT ch, t, name, round(beta, 6) + 0.0 AS beta, round(stderr, 6) + 0.0 AS stderr, round(beta / stderr, 6) + 0.0 AS t_value FROM o"""


@query("linear_regression_many", MANY, "epochs")
def _(spark, d):
    design = {"one": F.lit(1.0), "a": F.col("epoch") % 11, "b": F.col("condition") * F.col("condition")}
    return rounded(S.linear_regression_many(V.epochs(spark, d), design), "beta", "stderr", "t_value")


#: Ten subjects, two factors of three and two levels.
CROSSED = """WITH f AS (SELECT epoch % 10 AS s, epoch // 10 % 3 AS a, epoch // 30 % 2 AS b, ch, t, avg(value) AS v FROM epochs GROUP BY ALL),
m AS (SELECT *, avg(v) OVER (PARTITION BY ch, t) AS m, avg(v) OVER (PARTITION BY ch, t, a) AS ma, avg(v) OVER (PARTITION BY ch, t, b) AS mb, avg(v) OVER (PARTITION BY ch, t, s) AS ms, avg(v) OVER (PARTITION BY ch, t, a, b) AS mab, avg(v) OVER (PARTITION BY ch, t, s, a) AS msa, avg(v) OVER (PARTITION BY ch, t, s, b) AS msb FROM f),
e AS (SELECT ch, t, 'A' AS effect, sum((ma - m) ** 2) / 2 / (sum((msa - ms - ma + m) ** 2) / (2 * 9)) AS f FROM m GROUP BY ch, t
  UNION ALL SELECT ch, t, 'B', sum((mb - m) ** 2) / 1 / (sum((msb - ms - mb + m) ** 2) / (1 * 9)) FROM m GROUP BY ch, t
  UNION ALL SELECT ch, t, 'A:B', sum((mab - ma - mb + m) ** 2) / 2 / (sum((v - msa - msb - mab + ms + ma + mb - m) ** 2) / (2 * 9)) FROM m GROUP BY ch, t)
SELECT ch, t, effect, round(f, 6) + 0.0 AS f_value FROM e"""


@query("f_mway_rm_two", CROSSED, "epochs")
def _(spark, d):
    own = V.epochs(spark, d).withColumns({"subject": F.col("epoch") % 10, "a": F.floor(F.col("epoch") / 10) % 3, "b": F.floor(F.col("epoch") / 30) % 2})
    return rounded(S.anova_rm_two(own, "subject", "a", "b"), "f_value")
