"""Queries of decompositions, decoding and simulation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import channels as C
from ..operators import infomax
from ..operators import models as M
from . import views as V
from .registry import query, r6


def rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names or ("value",)})


def as_rows(spark, matrix: np.ndarray, name: str = "weight"):
    """A small fitted matrix as a table: row, ch, weight."""
    return spark.createDataFrame([(int(r), int(c), float(matrix[r, c])) for r in range(matrix.shape[0]) for c in range(matrix.shape[1])], f"row long, ch long, {name} double").withColumn(name, r6(F.col(name)))


@query("compute_proj_epochs")
def _(spark, d):
    """The first two components of all trials, as projection vectors."""
    return as_rows(spark, M.pca(V.epochs(spark, d), 8, 2)[0])


@query("apply_ssp")
def _(spark, d):
    own = V.epochs(spark, d)
    return rounded(C.mix(own, M.projector(M.pca(own, 8, 2)[0]).tolist()))


@query("whiten_evoked")
def _(spark, d):
    own = V.epochs(spark, d)
    white = M.whitener(M.shrunk(M.matrix(C.covariance(own), 8), 0.1))
    # the mean of a condition's trials, scaled by the root of their number, as its noise is less by that
    average = own.groupBy("condition", "ch", "t").agg((F.avg("value") * F.sqrt(F.count("*"))).alias("value"))
    return rounded(C.mix(average, white.tolist(), ("condition", "t")))


@query("ica_fit")
def _(spark, d):
    return as_rows(spark, M.ica(V.epochs(spark, d), 8, 4))


@query("ica_apply")
def _(spark, d):
    """Trials without the first independent component."""
    own = V.epochs(spark, d)
    unmix = M.ica(own, 8, 4)
    out = np.eye(8) - np.linalg.pinv(unmix)[:, :1] @ unmix[:1]
    return rounded(C.mix(own, out.tolist()))


@query("csp")
def _(spark, d):
    return as_rows(spark, M.csp(V.epochs(spark, d), 8, 1, 2)[0][[0, 7]])


@query("csp_transform")
def _(spark, d):
    own = V.epochs(spark, d)
    return rounded(M.band_power(own, M.csp(own, 8, 1, 2)[0][[0, 7]]))


@query("xdawn")
def _(spark, d):
    return as_rows(spark, M.xdawn(V.epochs(spark, d), 8, 1)[0][:2])


@query("sliding_estimator")
def _(spark, d):
    return rounded(M.sliding_scores(V.epochs(spark, d), 1, 2), "score")


@query("generalizing_estimator")
def _(spark, d):
    return rounded(M.generalizing_scores(V.epochs(spark, d), 1, 2), "score")


@query("time_delaying_ridge")
def _(spark, d):
    return as_rows(spark, M.time_delaying_ridge(V.epochs(spark, d), [0, 1], 2, [0, 1, 2])["coef"])


@query("find_bad_channels_lof")
def _(spark, d):
    return rounded(M.lof(V.epochs(spark, d), 3), "score")


@query("apply_forward", "SELECT r.i AS ch, epoch, t, round(sum(cos(r.i * (ch + 1)) * value), 6) + 0.0 AS value FROM epochs, range(5) r(i) GROUP BY ALL", "epochs")
def _(spark, d):
    """Sensor values from sources: a gain matrix on long source estimates."""
    return rounded(C.mix(V.epochs(spark, d), np.cos(np.outer(np.arange(5), np.arange(8) + 1)).tolist()))


@query("cosine_score", "WITH a AS (SELECT condition, ch, t, avg(value) AS a FROM epochs GROUP BY ALL), b AS (SELECT ch, t, avg(value) AS b FROM epochs GROUP BY ALL) SELECT condition, t, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) + 0.0 AS score FROM a JOIN b USING (ch, t) GROUP BY ALL", "epochs")
def _(spark, d):
    """Each condition's average against that of all trials."""
    own = V.epochs(spark, d)
    each = own.groupBy("condition", "ch", "t").agg(F.avg("value").alias("a"))
    pair = each.join(own.groupBy("ch", "t").agg(F.avg("value").alias("b")), ["ch", "t"])
    return rounded(pair.groupBy("condition", "t").agg((F.sum(F.col("a") * F.col("b")) / F.sqrt(F.sum(F.col("a") ** 2) * F.sum(F.col("b") ** 2))).alias("score")), "score")


@query("infomax_fit")
def _(spark, d):
    """Unmixing rows; the tests hold them against known mixtures."""
    return as_rows(spark, infomax.infomax(V.epochs(spark, d), 8, 4, rounds=20))
