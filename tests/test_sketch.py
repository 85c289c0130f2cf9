import numpy as np
import pytest
from matrices import factor_frame, low_rank, to_cells

from factorloom import kth_singular_value, recon_error, residual_spectral_norm
from factorloom.cells import Shape
from factorloom.functions.small import whitener


def singular(dense):
    return np.linalg.svd(dense - dense.mean(axis=0))


@pytest.mark.parametrize("k", [1, 3])
def test_kth_singular_value(spark, k):
    dense = low_rank()
    found = kth_singular_value(to_cells(spark, dense), k, subsample=4, q=10, precision=4)
    assert found.value == pytest.approx(singular(dense)[1][k - 1], abs=2e-3)


def test_stops_when_the_value_repeats(spark):
    dense = low_rank(noise=0.01, density=1.0)
    found = kth_singular_value(to_cells(spark, dense), 1, subsample=3, q=20, precision=3)
    run = found.run_stats("sigma", Shape(60, 9, 0), 1)
    assert run.prepare_sec > 0
    assert run.n_rounds == len(run.errors) == len(found.history)
    assert found.converged and found.history[-1] == found.history[-2] and len(found.history) < 20


@pytest.mark.parametrize("limit, hot_over", [(None, None), ("1", None)])
def test_residual_norm(spark, limit, hot_over):
    dense = low_rank()
    vectors = np.linalg.qr(np.random.default_rng(1).normal(size=(9, 2)))[0]
    yc = dense - dense.mean(axis=0)
    expected = np.linalg.norm(yc - yc @ vectors @ vectors.T, 2)
    if limit:
        spark.conf.set("spark.factorloom.broadcastBytes", limit)
    try:
        found = residual_spectral_norm(
            to_cells(spark, dense), factor_frame(spark, vectors), subsample=4, q=12, precision=5
        )
    finally:
        spark.conf.unset("spark.factorloom.broadcastBytes")
    assert found.value == pytest.approx(expected, rel=1e-3)


def test_recon_error_of_the_best_basis_is_zero(spark):
    dense = low_rank()
    best = singular(dense)[2][:2].T
    found = recon_error(to_cells(spark, dense), factor_frame(spark, best), subsample=5, q=15, precision=6)
    assert found.error == pytest.approx(0.0, abs=1e-3)
    worse = np.linalg.qr(np.random.default_rng(1).normal(size=(9, 2)))[0]
    assert recon_error(to_cells(spark, dense), factor_frame(spark, worse), subsample=5, q=15).error > 0.01


def test_whitener_of_a_deficient_matrix():
    z = np.random.default_rng(0).normal(size=(30, 3))
    z = np.column_stack([z, z[:, 0] + z[:, 1]])
    t = whitener(z.T @ z)
    q = z @ t
    np.testing.assert_allclose(q.T @ q, np.diag([1, 1, 1, 0]), atol=1e-6)


def test_the_last_singular_value(spark):
    dense = low_rank()
    found = kth_singular_value(to_cells(spark, dense), 9, subsample=4, q=12, precision=5)
    assert found.value == pytest.approx(singular(dense)[1][8], abs=2e-3)
    with pytest.raises(ValueError):
        kth_singular_value(to_cells(spark, dense), 10)


def test_error_of_the_best_basis_next_to_full(spark):
    dense = low_rank()
    best = singular(dense)[2].T
    assert recon_error(to_cells(spark, dense), factor_frame(spark, best[:, :8]), q=12).error == pytest.approx(0, abs=1e-3)
    full = recon_error(to_cells(spark, dense), factor_frame(spark, best), q=12)
    assert full.error == 0 and full.sigma == 0
    run = full.run_stats(Shape(60, 9, 0), 9)
    assert run.prepare_sec > full.residual.prepare_sec and run.n_rounds == len(full.residual.history)
    flat = np.outer(np.arange(30), [1.0, 2, 0, 1])  # of rank one
    worse = np.eye(4)[:, :1]
    assert recon_error(to_cells(spark, flat), factor_frame(spark, worse), q=12).error == float("inf")
