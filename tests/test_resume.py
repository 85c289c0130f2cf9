"""Fits that are stopped and taken up again."""

import shutil

import numpy as np
import pytest
from matrices import factor_array, low_rank, to_cells

from factorloom import PPCA
from factorloom.operators.masks import mask_cells
from factorloom.plans.resume import last_round


@pytest.mark.parametrize("masked", [False, True])
@pytest.mark.parametrize("limit", [None, "1"])
def test_a_resumed_fit_equals_an_unbroken_one(spark, tmp_path, masked, limit):
    cells = to_cells(spark, low_rank(density=0.9))
    mask = mask_cells(cells, 10, 1) if masked else None
    path = str(tmp_path / "fit")
    fit = lambda rounds, at=None: PPCA(2, max_iter=rounds, partitions=3, state_path=at).fit(cells, mask=mask)
    if limit:
        spark.conf.set("spark.factorloom.broadcastBytes", limit)
    try:
        whole = fit(4)
        assert fit(2, path).history == last_round(spark, path).history
        model = fit(4, path)
        np.testing.assert_allclose(factor_array(model.factor), factor_array(whole.factor), rtol=1e-9, atol=1e-10)
        np.testing.assert_allclose([x[2] for x in model.history], [x[2] for x in whole.history], rtol=1e-8)
        assert [x[:2] for x in model.history] == [x[:2] for x in whole.history]
        assert len(model.stats.round_sec) == 2 and len(model.stats.errors) == 4
        if masked:
            got, expected = ({(r.row_id, r.col_id): r.value for r in m.missing.collect()} for m in (model, whole))
            assert got.keys() == expected.keys()
            assert all(got[k] == pytest.approx(expected[k], rel=1e-9) for k in got)
    finally:
        spark.conf.unset("spark.factorloom.broadcastBytes")


def test_an_incomplete_round_is_done_again(spark, tmp_path):
    cells = to_cells(spark, low_rank())
    path = tmp_path / "fit"
    PPCA(2, max_iter=3, state_path=str(path)).fit(cells)
    whole = PPCA(2, max_iter=3).fit(cells)
    # As if the third round had been stopped before its last row was written.
    rows = [r for r in spark.read.parquet(str(path / "small")).collect() if r["round"] < 2]
    schema = spark.read.parquet(str(path / "small")).schema
    shutil.move(path / "small", tmp_path / "old")
    spark.createDataFrame(rows, schema).write.parquet(str(path / "small"))
    model = PPCA(2, max_iter=3, state_path=str(path)).fit(cells)
    np.testing.assert_allclose(factor_array(model.factor), factor_array(whole.factor), rtol=1e-9, atol=1e-10)
    assert len(model.stats.round_sec) == 1
    ended = PPCA(2, max_iter=3, state_path=str(path)).fit(cells)
    assert not ended.stats.round_sec and ended.variance == model.variance


def test_a_different_fit_is_refused(spark, tmp_path):
    cells = to_cells(spark, low_rank())
    path = str(tmp_path / "fit")
    assert last_round(spark, path) is None
    PPCA(2, max_iter=1, state_path=path).fit(cells)
    with pytest.raises(ValueError, match="components"):
        PPCA(3, max_iter=2, state_path=path).fit(cells)
    with pytest.raises(ValueError, match="columns"):
        PPCA(2, max_iter=2, state_path=path).fit(cells, n_cols=20)
    with pytest.raises(ValueError, match="missing"):
        PPCA(2, max_iter=2, state_path=path).fit(cells, mask=mask_cells(cells, 10, 1))
