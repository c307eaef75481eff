"""Queries of spatial operators: matrices from geometry, applied to the trials, and cluster tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import channels as C
from ..operators import inverse as I
from ..operators import models as M
from ..operators import stats as S
from . import views as V
from .queries_stats import DRAWN, FLIPS
from .registry import query, r6

#: Eight places on a sphere, and their orientations.
PLACES = np.array([[np.cos(2.4 * i) * np.sqrt(1 - (i / 8) ** 2), np.sin(2.4 * i) * np.sqrt(1 - (i / 8) ** 2), i / 8] for i in range(8)])
#: A gain of 12 sources, and the variances of sensor noise.
GAIN = np.array([[np.cos(0.7 * c * (s + 1)) + 0.1 * s for s in range(12)] for c in range(8)])
NOISE = np.diag([1.0 + 0.1 * c for c in range(8)])


def rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names or ("value",)})


def times(matrix: np.ndarray) -> str:
    """SQL of a matrix times the channels of epochs."""
    cells = ", ".join(f"({i}, {c}, {float(w)!r}::DOUBLE)" for i, row in enumerate(matrix) for c, w in enumerate(row))
    return f"SELECT i::BIGINT AS ch, epoch, t, round(sum(w * value), 6) + 0.0 AS value FROM epochs JOIN (VALUES {cells}) m(i, c, w) ON c = ch GROUP BY ALL"


FIXED = {
    "interpolate_bads": I.repair(PLACES, [2, 5]),
    "compute_current_source_density": I.current_density(PLACES, 1e-5, 0.095),
    "compute_proj_hfc": I.homogeneous_field(PLACES),
    "apply_inverse_mne": I.inverse_kernel(GAIN, NOISE),
    "apply_inverse_dspm": I.inverse_kernel(GAIN, NOISE, method="dSPM"),
    "apply_inverse_sloreta": I.inverse_kernel(GAIN, NOISE, method="sLORETA"),
    "apply_inverse_depth": I.inverse_kernel(GAIN, NOISE, prior=I.depth_prior(GAIN)),
}
#: Six sources of three orientations, two of them along the surface.
FREE = np.array([[np.cos(0.7 * c * (s + 1)) + 0.1 * s + 0.3 * np.sin(1.3 * c * s) for s in range(18)] for c in range(8)])
FREE_KERNELS = {
    "apply_inverse_free": I.inverse_kernel(FREE, NOISE, method="dSPM", orient=3),
    "apply_inverse_loose": I.inverse_kernel(FREE, NOISE, method="sLORETA", orient=3, prior=I.loose_prior(6, 0.2) * I.depth_prior(FREE, orient=3)),
    "apply_inverse_eloreta": I.inverse_kernel(FREE, NOISE, method="eLORETA", orient=3),
}
for name, matrix in FREE_KERNELS.items():

    @query(name, f"SELECT ch // 3 AS ch, epoch, t, round(sqrt(sum(value * value)), 6) + 0.0 AS value FROM ({times(matrix).replace('round(sum(w * value), 6) + 0.0', 'sum(w * value)')}) GROUP BY ALL", "epochs")
    def _(spark, d, matrix=matrix):
        """The length of each source's vector."""
        return rounded(I.apply_inverse(V.epochs(spark, d), matrix, 3))


for name, matrix in FIXED.items():

    @query(name, times(matrix), "epochs")
    def _(spark, d, matrix=matrix):
        return rounded(C.mix(V.epochs(spark, d), matrix.tolist()))


@query("compute_rank", "SELECT 8::BIGINT AS rank_all, 7::BIGINT AS rank_referenced")
def _(spark, d):
    """Channels, and channels of which the mean is taken: one less."""
    own = V.epochs(spark, d)
    ranks = [I.rank(M.matrix(C.covariance(x), 8)) for x in (own, C.reference(own))]
    return spark.createDataFrame([tuple(ranks)], "rank_all long, rank_referenced long")


@query("apply_lcmv")
def _(spark, d):
    own = V.epochs(spark, d)
    return rounded(C.mix(own, I.lcmv(GAIN, M.matrix(C.covariance(own), 8)).tolist()))


@query("apply_lcmv_cov")
def _(spark, d):
    cov = C.covariance(V.epochs(spark, d))
    return rounded(I.source_power(cov, I.lcmv(GAIN, M.matrix(cov, 8))), "power")


THRESHOLD = 1.5


@query("permutation_cluster_1samp_test", f"WITH c AS (SELECT ch, t, sum(value * value) AS q, count(*) AS n FROM epochs GROUP BY ALL), s AS (SELECT k, ch, t, sum(CASE WHEN k > 0 AND {DRAWN} % 2 = 1 THEN -value ELSE value END) AS s FROM epochs, range({FLIPS}) r(k) GROUP BY ALL), x AS (SELECT k, ch, t, s / n / sqrt((q - s * s / n) / (n - 1) / n) AS x FROM s JOIN c USING (ch, t)), r AS (SELECT k, ch, t, x, sign(x)::BIGINT AS sign, t - row_number() OVER (PARTITION BY k, ch, sign(x) ORDER BY t) AS island FROM x WHERE abs(x) > {THRESHOLD}), cl AS (SELECT k, ch, sign, min(t) AS start, max(t) + 1 AS stop, sum(x) AS mass FROM r GROUP BY k, ch, sign, island), top AS (SELECT max(abs(mass)) AS top FROM cl GROUP BY k) SELECT ch, sign, start, stop, round(mass, 6) AS mass, (SELECT count(*) FROM top WHERE top >= abs(mass) * (1 - 1e-12)) / {FLIPS}.0::DOUBLE AS p_value FROM cl WHERE k = 0", "epochs")
def _(spark, d):
    return rounded(S.cluster_test(V.epochs(spark, d), FLIPS, THRESHOLD, "epoch"), "mass")
