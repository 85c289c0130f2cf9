import numpy as np
import pytest
from matrices import SAMPLE, factor_array, factor_frame, low_rank, to_array, to_cells
from pyspark.sql import functions as F

from factorloom import PPCA
from factorloom.operators.masks import apply_mask, mask_cells
from factorloom.operators.starts import random_factor
from factorloom.plans.em import Gaps
from factorloom.plans.layout import RowLayout
from factorloom.plans.sketch import profile_columns
from factorloom.session import cut_lineage, settings


def centred(dense):
    return dense - dense.mean(axis=0)


def reference_em(dense, start, variance, rounds):
    """EM written out with dense matrices."""
    n, d = dense.shape
    yc, c, ss = centred(dense), start.copy(), variance
    k = c.shape[1]
    for _ in range(rounds):
        sx = np.linalg.inv(c.T @ c + ss * np.eye(k))
        x = yc @ c @ sx
        xtx = x.T @ x + n * ss * sx
        c = yc.T @ x @ np.linalg.inv(xtx)
        ss = (np.sum(yc**2) + np.trace(xtx @ c.T @ c) - 2 * np.sum(x * (yc @ c))) / (n * d)
    return c, ss


@pytest.mark.parametrize("k", [1, 2, 4])
def test_rounds_equal_dense_em(spark, k):
    dense = low_rank()
    start = np.random.default_rng(1).normal(size=(dense.shape[1], k))
    model = PPCA(k, max_iter=3, variance=0.7).fit(to_cells(spark, dense), start=factor_frame(spark, start))
    c, ss = reference_em(dense, start, 0.7, 3)
    np.testing.assert_allclose(factor_array(model.factor), c, rtol=1e-8, atol=1e-9)
    assert model.variance == pytest.approx(ss, rel=1e-9)


def test_wide_factor_uses_the_same_formulas(spark):
    """More components than fit generated SQL: batches in tasks."""
    dense = low_rank(n=80, d=40, k=16, density=0.9)
    start = np.random.default_rng(2).normal(size=(40, 18))
    model = PPCA(18, max_iter=2, variance=0.5).fit(to_cells(spark, dense), start=factor_frame(spark, start))
    c, ss = reference_em(dense, start, 0.5, 2)
    np.testing.assert_allclose(factor_array(model.factor), c, rtol=1e-6, atol=1e-8)
    assert model.variance == pytest.approx(ss, rel=1e-8)
    basis = factor_array(model.basis())
    np.testing.assert_allclose(basis.T @ basis, np.eye(18), atol=1e-8)


def test_reaches_the_maximum_likelihood_solution(spark):
    dense = low_rank(n=200, d=6, k=2, noise=0.5, density=1.0)
    model = PPCA(2, max_iter=40).fit(to_cells(spark, dense))
    values, vectors = np.linalg.eigh(np.cov(dense.T, bias=True))
    assert model.variance == pytest.approx(values[:4].mean(), rel=1e-4)
    basis = factor_array(model.basis())
    np.testing.assert_allclose(basis @ basis.T, vectors[:, 4:] @ vectors[:, 4:].T, atol=1e-4)


def test_empty_rows_and_columns_count(spark):
    dense = np.vstack([low_rank(n=20), np.zeros((5, 9))])
    dense[:, 8] = 0.0
    start = np.random.default_rng(3).normal(size=(9, 2))
    model = PPCA(2, max_iter=2, variance=1.0).fit(
        to_cells(spark, dense), n_rows=25, n_cols=9, start=factor_frame(spark, start)
    )
    c, ss = reference_em(dense, start, 1.0, 2)
    np.testing.assert_allclose(factor_array(model.factor), c, rtol=1e-8, atol=1e-9)
    assert model.variance == pytest.approx(ss, rel=1e-9)


@pytest.mark.parametrize(
    "limit, hot_over",
    [(None, None), ("1", None), (None, 4), ("1", 4)],
    ids=["plain", "routed", "hot rows", "routed with hot rows"],
)
def test_layouts_agree(spark, limit, hot_over):
    """Factors beyond the broadcast limit and rows split over tiles change nothing."""
    dense = low_rank(n=40, d=12, density=0.4)
    dense[7] = np.arange(1, 13)  # a row far longer than the others
    start = np.random.default_rng(4).normal(size=(12, 3))
    if limit:
        spark.conf.set("spark.factorloom.broadcastBytes", limit)
    try:
        model = PPCA(3, max_iter=2, variance=0.6, hot_over=hot_over, partitions=3).fit(
            to_cells(spark, dense), start=factor_frame(spark, start)
        )
        got = factor_array(model.factor)
    finally:
        spark.conf.unset("spark.factorloom.broadcastBytes")
    c, ss = reference_em(dense, start, 0.6, 2)
    np.testing.assert_allclose(got, c, rtol=1e-8, atol=1e-9)
    assert model.variance == pytest.approx(ss, rel=1e-9)


def test_partitioning_and_order_do_not_matter(spark):
    cells = to_cells(spark, low_rank())
    one = PPCA(2, max_iter=2).fit(cells.coalesce(1), n_rows=60, n_cols=9)
    many = PPCA(2, max_iter=2, partitions=5).fit(cells.repartition(7).orderBy(F.rand(3)), n_rows=60, n_cols=9)
    np.testing.assert_allclose(factor_array(one.factor), factor_array(many.factor), rtol=1e-9)


def test_stops_on_tolerance_and_counts_rounds(spark):
    cells = to_cells(spark, low_rank())
    model = PPCA(2, max_iter=30, tol=-1.0).fit(cells)
    deltas = [v for _, metric, v in model.history if metric == "delta"]
    assert deltas[-1] < 0.05 and all(v >= 0.05 for v in deltas[:-1])
    assert model.stats.n_rounds == len(deltas) < 30


def test_components_are_capped(spark):
    assert PPCA(9, max_iter=1).fit(to_cells(spark, low_rank())).k == 8


def test_warm_start_is_close_at_once(spark):
    dense = low_rank(n=200, d=8, k=2, noise=0.2, density=1.0)
    model = PPCA(2, max_iter=1, sketch=True, subsample=4).fit(to_cells(spark, dense))
    vectors = np.linalg.svd(centred(dense))[2][:2].T
    basis = factor_array(model.basis())
    np.testing.assert_allclose(basis @ basis.T, vectors @ vectors.T, atol=1e-2)


def test_sample_matrix_norm_and_mean(spark):
    profile = profile_columns(to_cells(spark, SAMPLE), 7, 5)
    means = [r.m for r in profile.table.orderBy("col_id").collect()]
    np.testing.assert_allclose(means, SAMPLE.mean(axis=0))


def reference_missing(dense, mask, start, variance, rounds, mean_over="rows", ceil=False):
    n, d = dense.shape
    values = np.where(mask, 0.0, dense)
    over = n if mean_over == "rows" else n - mask.sum(axis=0)
    first = values.sum(axis=0) / over
    assert np.all(first[mask.any(axis=0)] != 0)
    values = np.where(mask, first, values)
    c, ss, k = start.copy(), variance, start.shape[1]
    for _ in range(rounds):
        m = values.mean(axis=0)
        yc = values - m
        sx = np.linalg.inv(c.T @ c + ss * np.eye(k))
        x = yc @ c @ sx
        xtx = x.T @ x + n * ss * sx
        c = yc.T @ x @ np.linalg.inv(xtx)
        ss = (np.sum(yc**2) + np.trace(xtx @ c.T @ c) - 2 * np.sum(x * (yc @ c))) / (n * d)
        guess = m + x @ c.T
        values = np.where(mask, np.ceil(guess) if ceil else guess, values)
    return c, ss, values


@pytest.mark.parametrize(
    "limit, hot_over, mean_over, rounding",
    [
        (None, None, "rows", "none"),
        (None, None, "observed", "ceil"),
        ("1", 5, "rows", "none"),
    ],
)
def test_missing_cells_equal_dense_em(spark, limit, hot_over, mean_over, rounding):
    dense = low_rank(n=40, d=7, density=0.8)
    dense[3] = np.arange(1, 8)
    mask = np.random.default_rng(8).random(dense.shape) < 0.15
    mask[5] = True  # a row with nothing observed
    where = spark.createDataFrame([(int(i), int(j)) for i, j in np.argwhere(mask)], "row_id long, col_id int")
    start = np.random.default_rng(9).normal(size=(7, 2))
    if limit:
        spark.conf.set("spark.factorloom.broadcastBytes", limit)
    try:
        model = PPCA(
            2, max_iter=3, variance=0.8, mean_over=mean_over, rounding=rounding, hot_over=hot_over, partitions=3
        ).fit(to_cells(spark, dense), mask=where, n_rows=40, n_cols=7, start=factor_frame(spark, start))
        imputed = to_array(model.missing, 40, 7)
        got = factor_array(model.factor)
    finally:
        spark.conf.unset("spark.factorloom.broadcastBytes")
    c, ss, values = reference_missing(dense, mask, start, 0.8, 3, mean_over, rounding == "ceil")
    np.testing.assert_allclose(got, c, rtol=1e-7, atol=1e-8)
    assert model.variance == pytest.approx(ss, rel=1e-8)
    np.testing.assert_allclose(imputed[mask], values[mask], rtol=1e-7, atol=1e-8)
    np.testing.assert_allclose(factor_array(model.mean.withColumnRenamed("m", "c_0"))[:, 0], values.mean(axis=0))


def test_empty_mask_changes_nothing(spark):
    cells = to_cells(spark, low_rank())
    nothing = spark.createDataFrame([], "row_id long, col_id int")
    plain = PPCA(2, max_iter=2).fit(cells)
    masked = PPCA(2, max_iter=2).fit(cells, mask=nothing)
    np.testing.assert_allclose(factor_array(plain.factor), factor_array(masked.factor), rtol=1e-10)


def test_unhandled_missing_cells_are_zeros(spark):
    dense = low_rank()
    cells = to_cells(spark, dense)
    mask = mask_cells(cells, 20, 1)
    hidden = dense.copy()
    for row in mask.collect():
        hidden[row.row_id, row.col_id] = 0.0
    start = np.random.default_rng(6).normal(size=(9, 2))
    model = PPCA(2, max_iter=2, variance=0.5, handle_missing=False).fit(
        cells, mask=mask, n_rows=60, n_cols=9, start=factor_frame(spark, start)
    )
    np.testing.assert_allclose(factor_array(model.factor), reference_em(hidden, start, 0.5, 2)[0], rtol=1e-8, atol=1e-9)


def test_projection_and_imputation_of_a_model(spark):
    dense = low_rank(density=1.0)
    cells = to_cells(spark, dense)
    model = PPCA(2, max_iter=3).fit(cells)
    c = factor_array(model.factor)
    scores = np.array([list(r)[1:] for r in sorted(model.transform(cells, center=True).collect())])
    np.testing.assert_allclose(scores, centred(dense) @ c, rtol=1e-8, atol=1e-8)
    first = model.transform(cells, n_components=1)
    assert first.columns == ["row_id", "x_0"]
    where = spark.createDataFrame([(0, 1), (4, 2)], "row_id long, col_id int")
    sx = np.linalg.inv(c.T @ c + model.variance * np.eye(2))
    guess = dense.mean(axis=0) + centred(dense) @ c @ sx @ c.T
    got = {(r.row_id, r.col_id): r.value for r in model.impute(cells, where).collect()}
    assert got[(0, 1)] == pytest.approx(guess[0, 1])
    assert got[(4, 2)] == pytest.approx(guess[4, 2])


@pytest.mark.parametrize(
    "wrong",
    [dict(max_iter=0), dict(sketch=True, subsample=0), dict(mean_over="x"), dict(rounding="x")],
)
def test_arguments_are_checked(wrong):
    with pytest.raises(ValueError):
        PPCA(2, **wrong)


def exchanges(df):
    """Keys of the shuffles that joins and groupings ask for, in the final plan above the layout's cells."""
    keys, skipped = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        node = line.lstrip(" :+-")
        depth = len(line) - len(node)
        if skipped is not None and depth >= skipped:
            continue
        inner = node.startswith("== Initial Plan") or ("InMemoryRelation" in node and "value#" in node)
        skipped = depth if inner else None
        if node.startswith("Exchange hashpartitioning") and "ENSURE_REQUIREMENTS" in node:
            keys.append([k.split("#")[0] for k in node[node.index("(") + 1 : node.index(")")].split(", ")[:-1]])
    return keys


@pytest.mark.parametrize(
    "limit, hot_over, allowed",
    [
        (None, None, {"col_id"}),  # per-column sums
        (None, 4, {"col_id", "row_id"}),  # and the few partial scores of hot rows
        ("1", None, {"col_id"}),  # and factor rows joined with the columns that tiles use
    ],
    ids=["plain", "hot rows", "routed"],
)
def test_a_pass_does_not_shuffle_cells(spark, limit, hot_over, allowed):
    dense = low_rank(n=40, d=12, density=0.4)
    dense[7] = np.arange(1, 13)
    cells = to_cells(spark, dense)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    if limit:
        spark.conf.set("spark.factorloom.broadcastBytes", limit)
    try:
        profile = profile_columns(cells)
        with RowLayout(cells, profile.shape, 2, hot_over=hot_over, partitions=3) as layout:
            factor = cut_lineage(random_factor(profile.table, 2, prefix="f"))
            with layout.planning():
                crossed = layout.cross(layout.cells, layout.scores(layout.cells, factor, 2, [0.1, 0.2]), 2)
                assert len(crossed.collect()) == 12
            found = exchanges(crossed)
            assert found and {"+".join(key) for key in found} <= allowed
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        spark.conf.unset("spark.factorloom.broadcastBytes")


@pytest.mark.parametrize(
    "limit, hot_over", [(None, None), ("1", None), (None, 4)], ids=["plain", "routed", "hot rows"]
)
def test_a_masked_round_does_not_shuffle_observed_cells(spark, limit, hot_over):
    """Observed cells are ten times the missing ones; no exchange of a masked pass carries that many rows."""
    dense = low_rank(n=200, d=12, density=1.0)
    cells = to_cells(spark, dense)
    mask = cells.filter("pmod(row_id * 12 + col_id, 11) = 0").select("row_id", "col_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    if limit:
        spark.conf.set("spark.factorloom.broadcastBytes", limit)
    try:
        n = mask.count()
        observed, missing = apply_mask(cells, mask, 200, 12)
        profile = profile_columns(observed, 200, 12)
        with RowLayout(observed, profile.shape, 2, extra=missing, extra_count=n, hot_over=hot_over, partitions=3) as layout:
            gaps = Gaps(layout, profile, missing, PPCA(2))
            factor = cut_lineage(random_factor(profile.table, 2, prefix="f"))
            with layout.planning():
                for hold in (True, False):
                    both = gaps.all_cells()
                    crossed = layout.cross(both, layout.scores(both, factor, 2, [0.1, 0.2], hold), 2)
                    assert len(crossed.collect()) == 12
                    assert max(exchanged_rows(crossed)) < dense.size // 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        spark.conf.unset("spark.factorloom.broadcastBytes")


@pytest.mark.parametrize("hot_over", [None, 30], ids=["plain", "hot rows"])
def test_a_round_over_two_dimensional_tiles(spark, hot_over):
    """Row blocks × column blocks: the pass equals the dense product, and no exchange has more rows than the blocks allow."""
    n, d = 60, 50
    dense = low_rank(n=n, d=d, density=1.0)
    cells = to_cells(spark, dense)
    with settings(spark, spark__factorloom__broadcastBytes="1", spark__sql__autoBroadcastJoinThreshold="-1"):
        profile = profile_columns(cells)
        matrix = np.random.default_rng(0).normal(size=(d, 2))
        factor = cut_lineage(factor_frame(spark, matrix).withColumnsRenamed({"c_0": "f_0", "c_1": "f_1"}))
        with RowLayout(cells, profile.shape, 2, partitions=2, blocks=4, hot_over=hot_over) as layout:
            rows = layout.tiles // layout.blocks
            assert (layout.tiles, rows) == (16, 4)
            used = layout.routes.groupBy("col_id").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
            assert used[0] <= rows and used[1] <= rows * d
            with layout.planning():
                scores = layout.scores(layout.cells, factor, 2, [0.1, 0.2], hold=True)
                crossed = layout.cross(layout.cells, scores, 2)
                got = np.array([list(r)[1:] for r in sorted(crossed.collect())])
                copies = scores.groupBy("row_id").agg(F.count("*").alias("n"), F.max("x_0").alias("x")).collect()
            moved = exchanged_rows(crossed)
            np.testing.assert_allclose(got, dense.T @ (dense @ matrix - [0.1, 0.2]), rtol=1e-9, atol=1e-8)
            assert len(copies) == n and (hot_over or max(r["n"] for r in copies) <= layout.blocks)
            assert max(moved) <= max(rows * d, (rows if hot_over else 1) * layout.blocks * n) < dense.size


@pytest.mark.parametrize("hot_over", [None, 4], ids=["plain", "hot rows"])
def test_projection_beyond_the_broadcast_limit_moves_cells_once(spark, hot_over, monkeypatch):
    """Cells are placed by row; then only lists of columns and factor rows travel."""
    from factorloom.operators import products
    from factorloom.plans import layout as layouts

    dense = low_rank(n=300, d=12, density=1.0)
    dense[:, 5] = 0
    cells = to_cells(spark, dense)
    matrix = np.random.default_rng(0).normal(size=(12, 2))
    if hot_over:
        monkeypatch.setattr(layouts, "HOT_CELLS", hot_over)
    plans, keep = [], layouts.cut_lineage
    monkeypatch.setattr(layouts, "cut_lineage", lambda df: plans.append(df) or keep(df))
    with settings(spark, spark__factorloom__broadcastBytes="1", spark__sql__autoBroadcastJoinThreshold="-1"):
        scores = products.project_rows(cells, factor_frame(spark, matrix), 12)
        got = {r["row_id"]: (r["x_0"], r["x_1"]) for r in scores.collect()}
        assert scores.count() == 300
    np.testing.assert_allclose([got[i] for i in range(300)], dense @ matrix, rtol=1e-9, atol=1e-9)
    assert len(plans) == 1


def test_mask_is_taken_out_where_cells_lie(spark):
    """One exchange of cells for layout and mask together; the mask travels to the cells."""
    dense = low_rank(n=200, d=12, density=1.0)
    cells = to_cells(spark, dense)
    mask = cells.filter("pmod(row_id * 12 + col_id, 11) = 0").select("row_id", "col_id")
    extra = spark.createDataFrame([(5, 3), (199, 0), (900, 1)], "row_id long, col_id int")
    mask = cut_lineage(mask.unionByName(extra).distinct())
    expected = sorted(map(tuple, cells.join(mask, ["row_id", "col_id"], "left_anti").collect()))
    for limit, hot_over in ((None, None), ("1", None), ("1", 4), (None, 4)):
        with settings(spark, spark__factorloom__broadcastBytes=limit or "268435456", spark__sql__autoBroadcastJoinThreshold="-1"):
            shape = profile_columns(cells).shape
            with RowLayout(cells, shape, 2, mask=mask, hot_over=hot_over, partitions=3) as layout:
                assert sorted(map(tuple, layout.cells.select("row_id", "col_id", "value").collect())) == expected
                text = layout.cells._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
                assert text.count("Exchange hashpartitioning") == 2  # of the cells, and of the mask


def test_column_blocks_move_least():
    from factorloom.cells import Shape
    from factorloom.plans.layout import column_blocks

    assert column_blocks(1024, Shape(10**6, 10**6, 10**9)) == 32  # the square root
    assert column_blocks(1024, Shape(10**9, 10**6, 10**11)) == 1  # rows are far more
    assert column_blocks(1024, Shape(10**9, 10**6, 10**13)) == 1
    assert column_blocks(65_536, Shape(10**8, 10**7, 10**13)) == 64
    assert column_blocks(1024, Shape(10**6, 10**6, 10**6)) == 1  # fewer cells than any copies


def exchanged_rows(df):
    """Rows written by each exchange of the plan that ran, outside of what was persisted before."""
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        if name == "AdaptiveSparkPlanExec":
            return walk(node.finalPhysicalPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_wrong_input_is_refused(spark):
    dense = low_rank()
    cells = to_cells(spark, dense)
    with pytest.raises(ValueError, match="n_rows"):
        PPCA(2).fit(cells, n_rows=20)
    with pytest.raises(ValueError, match="stored 2 times"):
        PPCA(2).fit(cells.unionByName(cells.filter("row_id = 3")))
    with pytest.raises(ValueError, match="start"):
        PPCA(2).fit(cells, start=factor_frame(spark, np.eye(9)[:, :3]))
    with pytest.raises(ValueError, match="more than"):
        PPCA(10).fit(cells)
    with pytest.warns(UserWarning, match="8 are fitted"):
        assert PPCA(9, max_iter=1).fit(cells).k == 8
    with pytest.raises(ValueError, match="n_components"):
        PPCA(2, max_iter=1).fit(cells).transform(cells, n_components=3)
