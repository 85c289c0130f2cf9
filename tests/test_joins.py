import numpy as np
import pytest
from matrices import factor_array, factor_frame, low_rank, to_cells
from pyspark.sql import functions as F

from factorloom.operators import joins, missing, products, stats
from factorloom.operators.joins import hot_keys, with_rows_of
from factorloom.session import settings


@pytest.fixture
def hot_matrix():
    """One row and one column hold most cells."""
    dense = low_rank(n=50, d=30, density=0.1)
    dense[4] = np.arange(1, 31)
    dense[:, 6] = np.arange(1, 51)
    return dense


def test_hot_keys(spark, hot_matrix):
    cells = to_cells(spark, hot_matrix)
    assert [tuple(r) for r in hot_keys(cells, "row_id", 10).collect()] == [(4, 3)]
    assert [tuple(r) for r in hot_keys(cells, "col_id", 25).collect()] == [(6, 2)]
    assert hot_keys(cells, "row_id", 100) is None


def test_hot_keys_among_more_keys_than_counters(spark, monkeypatch):
    """Keys with many cells are found though the counters can't hold all keys; counts err upwards only."""
    monkeypatch.setattr(joins, "COUNTERS", 256)
    monkeypatch.setattr(joins, "HOTTEST", 32)
    cells = spark.range(60_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7L WHEN id % 10 = 1 THEN 9L ELSE id + 100 END AS row_id")
    found = {r["row_id"]: r["spread"] for r in hot_keys(cells, "row_id", 3000).collect()}
    assert set(found) == {7, 9} and 7 <= found[7] <= 8 and 2 <= found[9] <= 3


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skewed_rows_are_split_in_one_scan(spark, how):
    """A row with a third of all cells: its partition is cut at run time, and the cells are scanned once."""
    cells = spark.range(200_000).selectExpr("if(id % 3 = 0, 7L, id) AS row_id", "cast(id % 50 AS int) AS col_id", "1D AS value")
    scores = cells.groupBy("row_id").agg(F.sum("value").alias("x_0"))
    small = {
        "spark__sql__autoBroadcastJoinThreshold": "-1",
        "spark__sql__adaptive__advisoryPartitionSizeInBytes": "64k",
        "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "64k",
        "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    }
    with settings(spark, **small):
        joined = with_rows_of(cells, scores, how)
        plan = joined._jdf.queryExecution()
        assert plan.toRdd().count() == 200_000
        text = plan.executedPlan().toString().split("== Initial Plan ==")[0]
    assert "skew=true" in text
    assert joined.agg(F.sum("x_0")).first()[0] == 66_668**2 + 133_332


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins_without_adaptive_execution_take_salts(spark, hot_matrix, how, monkeypatch):
    monkeypatch.setattr(joins, "HOT_CELLS", 5)
    cells = to_cells(spark, hot_matrix)
    side = spark.range(0, 40).selectExpr("id AS row_id", "id * 0.5D AS x_0")
    plain = sorted(map(str, cells.join(side, "row_id", how).select("row_id", "col_id", "value", "x_0").collect()))
    with settings(spark, spark__sql__adaptive__enabled="false"):
        salted = with_rows_of(cells, side, how).select("row_id", "col_id", "value", "x_0")
        assert "_salt" in salted._jdf.queryExecution().analyzed().toString()
        assert sorted(map(str, salted.collect())) == plain


def test_a_side_is_counted_before_it_is_broadcast(spark, hot_matrix):
    """The caller's number of columns is no proof: a longer table is joined by a shuffle."""
    cells = to_cells(spark, hot_matrix)
    long = spark.range(0, 40_000).selectExpr("cast(id AS int) AS col_id", "id * 1D AS m")
    with settings(spark, spark__factorloom__broadcastBytes="100000", spark__sql__autoBroadcastJoinThreshold="-1"):
        joined = joins.with_columns_of(cells, long, 30)
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == cells.count()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, hot_matrix, how):
    cells = to_cells(spark, hot_matrix)
    side = spark.range(0, 40).selectExpr("id AS row_id", "id * 0.5D AS x_0")
    plain = cells.join(side, "row_id", how).select("row_id", "col_id", "value", "x_0")
    salted = with_rows_of(cells, side, how, over=5).select("row_id", "col_id", "value", "x_0")
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_products_beyond_the_broadcast_limit(spark, hot_matrix, monkeypatch):
    monkeypatch.setattr(joins, "HOT_CELLS", 8)
    cells = to_cells(spark, hot_matrix)
    n, d = hot_matrix.shape
    matrix = np.random.default_rng(0).normal(size=(d, 2))
    factor = factor_frame(spark, matrix)
    mean = stats.col_mean(cells, n, d)
    spark.conf.set("spark.factorloom.broadcastBytes", "64")
    try:
        scores = products.rows_times_factor(cells, factor, d)
        shift = hot_matrix.mean(axis=0) @ matrix
        crossed = factor_array(products.cross_ytx(cells, scores, shift, mean, n, d), "y")
        guess = missing.reconstruct_cells(cells, scores, factor, mean, d, shift)
        got = {(r.row_id, r.col_id): r.value for r in guess.collect()}
    finally:
        spark.conf.unset("spark.factorloom.broadcastBytes")
    yc = hot_matrix - hot_matrix.mean(axis=0)
    np.testing.assert_allclose(crossed, yc.T @ yc @ matrix, rtol=1e-9, atol=1e-8)
    full = hot_matrix.mean(axis=0) + yc @ matrix @ matrix.T
    for (i, j), value in got.items():
        assert value == pytest.approx(full[i, j])


def test_cross_product_with_more_rows_than_present(spark, hot_matrix):
    """The correction for a mean over a larger N."""
    cells = to_cells(spark, hot_matrix)
    n, d = 80, hot_matrix.shape[1]
    tall = np.vstack([hot_matrix, np.zeros((30, d))])
    matrix = np.random.default_rng(0).normal(size=(d, 2))
    scores = products.rows_times_factor(cells, factor_frame(spark, matrix), d)
    mean = stats.col_mean(cells, n, d)
    shift = tall.mean(axis=0) @ matrix
    yc = tall - tall.mean(axis=0)
    crossed = factor_array(products.cross_ytx(cells, scores, shift, mean, n, d), "y")
    np.testing.assert_allclose(crossed, yc.T @ yc @ matrix, rtol=1e-9, atol=1e-8)
    np.testing.assert_allclose(products.gram_xtx(scores, shift, n), matrix.T @ yc.T @ yc @ matrix, rtol=1e-9)
    norm = stats.frobenius_centered(cells, n).first()[0]
    assert norm == pytest.approx(np.sum(yc**2))


def test_identity_of_the_variance_term(spark, hot_matrix):
    """The direct sum over rows equals the trace that a round uses."""
    cells = to_cells(spark, hot_matrix)
    n, d = hot_matrix.shape
    matrix = np.random.default_rng(0).normal(size=(d, 2))
    factor = factor_frame(spark, matrix)
    scores = products.rows_times_factor(cells, factor, d)
    shift = hot_matrix.mean(axis=0) @ matrix
    direct = products.xcty(cells, scores, factor, shift, shift, n, d).first()[0]
    mean = stats.col_mean(cells, n, d)
    crossed = products.cross_ytx(cells, scores, shift, mean, n, d)
    trace = np.trace(matrix.T @ factor_array(crossed, "y"))
    assert direct == pytest.approx(trace)


def test_sampled_rows_stay_whole(spark, hot_matrix):
    cells = to_cells(spark, hot_matrix)
    kept = missing.sample_rows(cells, 0.5, 3)
    full = {r.row_id: r.n for r in cells.groupBy("row_id").agg(F.count("*").alias("n")).collect()}
    part = {r.row_id: r.n for r in kept.groupBy("row_id").agg(F.count("*").alias("n")).collect()}
    assert 0 < len(part) < len(full)
    assert all(full[row] == n for row, n in part.items())
