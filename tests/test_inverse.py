"""Matrices of spatial operators against their definitions, and cluster tests against enumeration."""

import numpy as np
import pytest

from neurolattice.operators import assemble as A
from neurolattice.operators import channels as C
from neurolattice.operators import inverse as I
from neurolattice.operators import models as M
from neurolattice.operators import stats as S
from neurolattice.plans import registry
from neurolattice.plans import views as V

RNG = np.random.default_rng(3)
GAIN = RNG.standard_normal((6, 4))
NOISE = (lambda x: x @ x.T + np.eye(6))(RNG.standard_normal((6, 6)))


def sphere(n):
    return I.unit(RNG.standard_normal((n, 3)))


def test_spline_is_the_legendre_series():
    x = np.linspace(-1, 1, 11)
    want = np.polynomial.legendre.legval(x, [0, *((2 * n + 1) / (n * (n + 1)) ** 4 / (4 * np.pi) for n in range(1, 51))])
    assert np.allclose(I.spline(x, 4), want, atol=1e-12)


def test_interpolation():
    p = sphere(60)
    w = I.repair(p, [3, 7])
    assert np.allclose(w.sum(1), 1, atol=1e-6)  # a constant stays
    smooth = p @ np.array([1.0, -2.0, 0.5]) + 0.3
    assert np.abs(w @ smooth - smooth).max() < 0.05
    assert np.array_equal(w[[0, 1, 2]], np.eye(60)[[0, 1, 2]]) and not w[:, [3, 7]].any()


def test_current_density_of_a_constant_is_nothing_and_of_a_dipole_is_like_it():
    p = sphere(80)
    m = I.current_density(p)
    assert np.abs(m @ np.ones(80)).max() < 1e-6
    assert np.corrcoef(m @ p[:, 2], p[:, 2])[0, 1] > 0.95


def test_homogeneous_field_is_removed():
    n = sphere(20)
    p = I.homogeneous_field(n)
    assert np.allclose(p @ n @ [1, 2, 3], 0) and np.allclose(p @ p, p) and I.rank(p) == 17


@pytest.mark.parametrize("method", ["MNE", "dSPM", "sLORETA"])
def test_inverse(method):
    k = I.inverse_kernel(GAIN, NOISE, 1 / 9, method)
    inverse = np.linalg.inv(NOISE)
    r = 6 / np.trace(GAIN @ GAIN.T @ inverse)
    plain = r * GAIN.T @ np.linalg.inv(GAIN @ GAIN.T * r + NOISE / 9)
    scale = {"MNE": np.ones(4), "dSPM": np.sqrt(np.diag(plain @ NOISE @ plain.T)), "sLORETA": np.sqrt(np.diag(plain @ GAIN))}[method]
    assert np.allclose(k, plain / scale[:, None])


def test_sloreta_has_no_error_of_place():
    k = I.inverse_kernel(GAIN, NOISE, 1 / 9, "sLORETA") @ GAIN
    assert (np.abs(k).argmax(0) == np.arange(4)).all()


def test_depth_prior():
    g = np.array([[1.0, 0.1, 0.001]])
    assert np.allclose(I.depth_prior(g, 0.8, 10.0), np.array([1 / 100, 1, 1]) ** 0.8)


def test_lcmv():
    w = I.lcmv(GAIN, NOISE, 0.0)
    assert np.allclose((w * GAIN.T).sum(1), 1)
    for s in range(4):  # any other filter that passes the gain has more power
        other = w[s] + 0.1 * (lambda v: v - GAIN[:, s] * (v @ GAIN[:, s]) / (GAIN[:, s] @ GAIN[:, s]))(RNG.standard_normal(6))
        assert np.isclose(other @ GAIN[:, s], 1) and other @ NOISE @ other >= w[s] @ NOISE @ w[s]
    assert np.allclose((I.lcmv(GAIN, NOISE, 0.0, "unit-noise-gain") ** 2).sum(1), 1)


def test_lcmv_of_the_tables(spark, sf_dir):
    own = V.epochs(spark, sf_dir)
    cov = M.matrix(C.covariance(own), 8)
    from neurolattice.plans.queries_inverse import GAIN as gain

    w = I.lcmv(gain, cov)
    rows = own.toPandas().pivot_table(index=["epoch", "t"], columns="ch", values="value").to_numpy()
    got = registry.QUERIES["apply_lcmv_cov"](spark, sf_dir).toPandas().sort_values("source")["power"].to_numpy()
    assert np.allclose(got, np.var(rows @ w.T, axis=0, ddof=1), atol=2e-6)
    est = registry.QUERIES["apply_lcmv"](spark, sf_dir).toPandas().sort_values(["epoch", "t", "ch"])["value"].to_numpy()
    assert np.allclose(est, (rows @ w.T).ravel(), atol=1e-5)


def test_cluster_test(spark, sf_dir):
    """A strong effect at three times of one channel is a cluster, and the only one of small p."""
    rows = [(e, c, t, float(np.sin(e * 7 + c * 3 + t * 11)) + (3.0 if c == 1 and 2 <= t <= 4 else 0.0)) for e in range(40) for c in range(3) for t in range(8)]
    df = spark.createDataFrame(rows, "epoch long, ch long, t long, value double")
    out = S.cluster_test(df, 128, 2.0, "epoch").toPandas()
    sure = out[out["p_value"] < 0.05]
    assert sure[["ch", "sign", "start", "stop"]].to_numpy().tolist() == [[1, 1, 2, 5]] and sure["p_value"].iloc[0] == 1 / 128
    assert S.cluster_test(df.limit(0), 8, 2.0, "epoch").count() == 0


def test_empty(spark):
    df = spark.createDataFrame([(0, 0, 1.0)], "ch long, samp long, value double")
    assert A.concatenate_raws(df.withColumnRenamed("ch", "rec").limit(0)).count() == 0


@pytest.mark.parametrize("method", ["indep", "negcorr"])
def test_fdr(spark, method):
    """Against the definition, with ties, zeros, ones, a null, and more than 1,000 tests."""
    p = np.round(RNG.random(1500) ** 3, 3)
    p[:5], p[5:200] = 0.0, 1.0
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(9999, None)], "i long, p double")
    out = S.fdr(df, ["i"], 0.05, method).toPandas().set_index("i")
    order = np.argsort(p, kind="stable")
    e = np.arange(1, 1501) / 1500 / ((1 / np.arange(1, 1501)).sum() if method == "negcorr" else 1)
    want, reject = np.empty(1500), np.empty(1500, bool)
    want[order] = np.minimum(np.minimum.accumulate((p[order] / e)[::-1])[::-1], 1)
    good = np.flatnonzero(p[order] < e * 0.05)
    reject[order] = np.arange(1500) <= (good.max() if len(good) else -1)
    assert np.allclose(out.loc[range(1500), "corrected"], want) and (out.loc[range(1500), "reject"].to_numpy() == reject).all()
    assert np.isnan(out.loc[9999, "corrected"]) and not out.loc[9999, "reject"]
    assert S.fdr(df.limit(0), ["i"]).count() == 0


FREE = np.random.default_rng(11).standard_normal((6, 12))


@pytest.mark.parametrize("method", ["MNE", "dSPM", "sLORETA"])
def test_free_orientation(method):
    prior = I.loose_prior(4, 0.3) * I.depth_prior(FREE, orient=3)
    k = I.inverse_kernel(FREE, NOISE, 1 / 9, method, prior, 3)
    inverse, source = np.linalg.inv(NOISE), np.diag(prior)
    r = 6 / np.trace(FREE @ source @ FREE.T @ inverse)
    plain = r * source @ FREE.T @ np.linalg.inv(FREE @ source @ FREE.T * r + NOISE / 9)
    for s in range(4):
        own = slice(3 * s, 3 * s + 3)
        square = {"MNE": 1.0, "dSPM": np.trace((plain @ NOISE @ plain.T)[own, own]), "sLORETA": np.trace((plain @ FREE)[own, own])}[method]
        assert np.allclose(k[own], plain[own] / np.sqrt(square))
    # one factor a source: the greatest gain of any direction
    d = [1 / np.linalg.svd(FREE[:, 3 * s : 3 * s + 3], compute_uv=False)[0] ** 2 for s in range(4)]
    assert np.allclose(I.depth_prior(FREE, orient=3)[::3], (np.array(d) / max(d)) ** 0.8)
    with pytest.raises(ValueError):
        I.inverse_kernel(FREE[:, :11], NOISE, orient=3)


@pytest.mark.parametrize("orient", [1, 3])
def test_exact_weights_localise_exactly(orient):
    rng = np.random.default_rng(12)
    gain = rng.standard_normal((20, 30 * orient))
    k = I.inverse_kernel(gain, np.eye(20), 0.05, "eLORETA", orient=orient)
    for s in range(30):
        x = gain[:, s * orient : (s + 1) * orient] @ rng.standard_normal(orient)
        found = ((k @ x).reshape(-1, orient) ** 2).sum(1)
        assert found.argmax() == s
    r = I.exact_weights(gain, 0.05, orient, np.ones(gain.shape[1]))
    own = I.by_source(gain, orient)
    inverse = np.linalg.inv(np.einsum("sci,sij,sdj->cd", own, r, own) + 0.05 * np.eye(20))
    again = I.power(own.swapaxes(1, 2) @ inverse @ own, -0.5)
    assert np.allclose(again / np.linalg.norm(again), r / np.linalg.norm(r), atol=1e-4)
    assert np.isclose(np.einsum("sci,sij,scj->", own, r, own), 20)


def test_noise_of_lower_rank():
    p = np.eye(6) - 1 / 6
    k = I.inverse_kernel(p @ GAIN, p @ NOISE @ p, method="dSPM")
    basis = np.linalg.svd(p)[0][:, :5]  # the same in coordinates where nothing is missing
    assert np.allclose(k @ basis, I.inverse_kernel(basis.T @ GAIN, basis.T @ NOISE @ basis, method="dSPM"))
    assert I.whitener(p @ NOISE @ p).shape == (5, 6) and I.whitener(np.diag([1.0, 0, 4])).shape == (2, 3)


@pytest.mark.parametrize("norm", ["unit-gain", "unit-noise-gain"])
def test_lcmv_orientations(norm):
    rng = np.random.default_rng(13)
    gain, turn = rng.standard_normal((10, 12)), np.array([0.6, -0.7, np.sqrt(1 - 0.85)])
    cov = 50 * np.outer(gain[:, 3:6] @ turn, gain[:, 3:6] @ turn) + np.eye(10)
    w = I.lcmv(gain, cov, 0.01, norm, orient=3, pick="max-power")
    assert w.shape == (4, 10)
    passed = w[1] @ gain[:, 3:6]
    if norm == "unit-gain":
        assert np.isclose(np.linalg.norm(I.lcmv(gain, cov, 0.01, norm, orient=3).reshape(4, 3, 10) @ gain[:, 3:6], axis=(1, 2))[1], np.sqrt(3))
    assert abs(passed @ turn) / np.linalg.norm(passed) > 0.9
    units = np.diag(10.0 ** rng.integers(-3, 4, 10))  # whitened, other units of the sensors change nothing
    noise = np.eye(10) + 0.1
    a, b = (I.lcmv(u @ gain, u @ cov @ u, 0.05, norm, u @ noise @ u, 3, "max-power") @ u for u in (np.eye(10), units))
    assert np.allclose(np.abs(a), np.abs(b), rtol=1e-5, atol=1e-8)


def test_products_in_batches(spark, monkeypatch):
    rng = np.random.default_rng(14)
    rows = [(e, c, t, None if (e, c, t) == (1, 2, 0) else float(rng.standard_normal())) for e in range(3) for c in range(5) for t in range(4) if (e, c) not in ((0, 1), (2, 0))]
    df = spark.createDataFrame(rows, "epoch long, ch long, t long, value double")
    matrix = rng.standard_normal((6, 5))
    matrix[1], matrix[2, 1:], matrix[3, 0] = 0, 0, 0
    near = lambda a: {(r["ch"], r["epoch"], r["t"]): pytest.approx(r["value"]) for r in a.collect()}
    literal = near(C.mix(df.filter("value IS NOT NULL"), matrix.tolist()))
    monkeypatch.setattr(C, "LITERAL", 0)
    assert near(C.mix(df, matrix.tolist())) == literal and (2, 2, 0) not in literal and (1, 0, 0) not in literal
    assert C.mix(df.limit(0), matrix.tolist()).count() == 0
    vectors = near(I.apply_inverse(df, matrix, 3, "vector"))
    lengths = {(r["ch"], r["epoch"], r["t"]): r["value"] for r in I.apply_inverse(df, matrix, 3).collect()}
    assert lengths[1, 1, 1] == pytest.approx(np.sqrt(sum(vectors[k, 1, 1].expected ** 2 for k in (3, 4, 5))))
    assert near(I.apply_inverse(df, matrix, 3, "normal"))[1, 1, 1] == vectors[5, 1, 1].expected
    big = rng.standard_normal((3000, 5))
    assert C.mix(df, big.tolist()).count() == 3000 * 12
    monkeypatch.setattr(C, "MOST", 100)
    with pytest.raises(ValueError):
        C.mix(df, big.tolist())
