"""Matrix products as joins and aggregates.

``factor`` is ``(col_id, c_0 …)``, ``mean`` is ``(col_id, m)``, ``scores`` is ``(row_id, x_0 …)``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cells import col_spine
from ..functions.exprs import names, number, sums_of_products
from ..functions.gram import gram
from ..functions.rowmath import multiply
from ..functions.small import eigen_desc, inverse_sqrt
from ..session import fits_broadcast
from .joins import with_columns_of, with_rows_of


def width_of(df: DataFrame, prefix: str) -> int:
    return sum(1 for c in df.columns if c.startswith(prefix + "_"))


def rows_times_factor(cells: DataFrame, factor: DataFrame, n_cols: int) -> DataFrame:
    """``x = y·C`` for each row with cells. Partial sums are made before rows meet, so a row that holds
    very many cells costs no more than the others. A factor too large for a broadcast is routed to the cells."""
    k = width_of(factor, "c")
    if not fits_broadcast(cells.sparkSession, n_cols, k):
        from ..plans.layout import routed_scores

        moved = factor.select("col_id", *[F.col(f"c_{j}").alias(f"f_{j}") for j in range(k)])
        return routed_scores(cells, moved, k, n_cols)
    sums = sums_of_products("value", names("c", k), names("x", k))
    return with_columns_of(cells, factor, n_cols).groupBy("row_id").agg(*map(F.expr, sums))


def rows_times_factor_missing(
    observed: DataFrame, missing: DataFrame, factor: DataFrame, n_cols: int
) -> DataFrame:
    """The same over observed and filled-in cells."""
    return rows_times_factor(observed.unionByName(missing), factor, n_cols)


def mean_times_factor(mean: DataFrame, factor: DataFrame) -> DataFrame:
    """``m·C`` as one row ``(x_0 …)``."""
    k = width_of(factor, "c")
    sums = sums_of_products("m", names("c", k), names("x", k))
    return mean.join(factor, "col_id").agg(*map(F.expr, sums))


def gram_factor(factor: DataFrame) -> np.ndarray:
    """``CᵀC``."""
    return gram(factor, names("c", width_of(factor, "c")))


def small_frame(df: DataFrame, matrix: np.ndarray) -> DataFrame:
    """A k×k result as ``(i, j, value)``."""
    k = matrix.shape[0]
    rows = [(i, j, float(matrix[i, j])) for i in range(k) for j in range(matrix.shape[1])]
    return df.sparkSession.createDataFrame(rows, "i int, j int, value double")


def _center(scores: DataFrame, shift: Sequence[float]) -> DataFrame:
    k = width_of(scores, "x")
    return scores.select(
        "row_id", *[F.expr(f"x_{j} - {number(shift[j])} AS x_{j}") for j in range(k)]
    )


def gram_xtx(scores: DataFrame, shift: Sequence[float], n_rows: int) -> np.ndarray:
    """``Σ (x - x̄)ᵀ(x - x̄)`` over all ``n_rows`` rows.

    Rows without cells are not in ``scores``; each has ``x = 0`` and adds ``x̄ᵀx̄``.
    """
    k = width_of(scores, "x")
    centered = _center(scores, shift).withColumn("_one", F.lit(1.0))
    full = gram(centered, [*names("x", k), "_one"])
    shift = np.asarray(shift, dtype=float)
    return full[:k, :k] + (n_rows - full[k, k]) * np.outer(shift, shift)


def cross_ytx(
    cells: DataFrame,
    scores: DataFrame,
    shift: Sequence[float],
    mean: DataFrame,
    n_rows: int,
    n_cols: int,
) -> DataFrame:
    """``(y - m)ᵀ(x - x̄)`` as ``(col_id, y_0 …)`` for each column.

    Only stored cells are multiplied. What centring the data takes away is
    ``m · (Σx - N·x̄)``, a correction on every column.
    """
    k = width_of(scores, "x")
    xs, ys = names("x", k), names("y", k)
    centered = _center(scores, shift)
    # Rows without scores have x = 0. The subquery and the join read one exchange of the scores.
    rest = centered.selectExpr(
        "array("
        + ", ".join(
            f"coalesce(sum({x}), 0D) - ({int(n_rows)} - count(*)) * {number(shift[j])}"
            for j, x in enumerate(xs)
        )
        + ") AS r"
    )
    stored = (
        with_rows_of(cells, centered)
        .groupBy("col_id")
        .agg(*map(F.expr, sums_of_products("value", xs, ys)))
    )
    spine = col_spine(cells.sparkSession, n_cols)
    return (
        spine.join(stored, "col_id", "left")
        .join(mean, "col_id", "left")
        .withColumn("_r", rest.scalar())
        .selectExpr(
            "col_id",
            *[f"coalesce({y}, 0D) - coalesce(m, 0D) * _r[{j}] AS {y}" for j, y in enumerate(ys)],
        )
    )


def cross_ytx_missing(
    observed: DataFrame,
    missing: DataFrame,
    scores: DataFrame,
    shift: Sequence[float],
    mean: DataFrame,
    n_rows: int,
    n_cols: int,
) -> DataFrame:
    return cross_ytx(observed.unionByName(missing), scores, shift, mean, n_rows, n_cols)


def xcty(
    cells: DataFrame,
    scores: DataFrame,
    factor: DataFrame,
    shift: Sequence[float],
    mean_product: Sequence[float],
    n_rows: int,
    n_cols: int,
) -> DataFrame:
    """``Σ (x - x̄)·((y - m)·C)ᵀ`` over all rows as one row, in its direct form.

    ``mean_product`` is ``m·C``. Rows without cells have ``x = 0`` and ``y = 0``.
    """
    k = width_of(factor, "c")
    products = rows_times_factor(cells, factor, n_cols).select(
        "row_id", *[F.col(f"x_{j}").alias(f"p_{j}") for j in range(k)]
    )
    pair = " + ".join(
        f"(x_{j} - {number(shift[j])}) * (p_{j} - {number(mean_product[j])})" for j in range(k)
    )
    empty = float(np.dot(shift, mean_product))
    return (
        scores.join(products, "row_id")
        .selectExpr(f"{pair} AS _d")
        .agg(
            (
                F.coalesce(F.sum("_d"), F.lit(0.0))
                + (F.lit(n_rows) - F.count("*")) * F.lit(empty)
            ).alias("xcty")
        )
    )


def factor_times_small(factor: DataFrame, matrix: np.ndarray) -> DataFrame:
    """``C·W`` for a small ``W``: column arithmetic, no shuffle."""
    matrix = np.asarray(matrix, dtype=float)
    return multiply(
        factor, ["col_id"], names("c", matrix.shape[0]), matrix, names("c", matrix.shape[1])
    )


def residual_factor(factor: DataFrame, basis: DataFrame) -> DataFrame:
    """``Ω - V(VᵀΩ)``: ``factor`` without its part in the orthonormal ``basis``."""
    s, k = width_of(factor, "c"), width_of(basis, "c")
    vs, fs = names("v", k), names("c", s)
    renamed = basis.select("col_id", *[F.col(f"c_{j}").alias(v) for j, v in enumerate(vs)])
    both = factor.join(renamed, "col_id", "left").na.fill(0.0, vs)
    inner = gram(both, [*vs, *fs])[:k, k:]
    return multiply(both, ["col_id"], [*fs, *vs], np.vstack([np.eye(s), -inner]), fs)


def project_rows(
    cells: DataFrame,
    factor: DataFrame,
    n_cols: int,
    spine: DataFrame | None = None,
    shift: Sequence[float] | None = None,
) -> DataFrame:
    """Scores of each row; with a ``spine`` also of rows without cells."""
    scores = rows_times_factor(cells, factor, n_cols)
    xs = names("x", width_of(factor, "c"))
    if spine is not None:
        scores = spine.join(scores, "row_id", "left").na.fill(0.0, xs)
    return _center(scores, shift) if shift is not None else scores


def orient(factor: DataFrame) -> DataFrame:
    """Signs fixed: the entry of largest magnitude of each column becomes positive."""
    k = width_of(factor, "c")
    extremes = factor.agg(
        *[
            F.expr(f"max_by(c_{j}, struct(abs(c_{j}), -col_id)) AS c_{j}")
            for j in range(k)
        ]
    ).first()
    signs = [-1.0 if (extremes[j] or 0.0) < 0 else 1.0 for j in range(k)]
    return factor_times_small(factor, np.diag(signs))


def orthonormal_basis(factor: DataFrame, gram_matrix: np.ndarray | None = None) -> DataFrame:
    """Left singular vectors of ``C``, strongest first, from the eigenvectors of ``CᵀC``."""
    matrix = gram_factor(factor) if gram_matrix is None else gram_matrix
    values, vectors = eigen_desc(matrix)
    return orient(factor_times_small(factor, vectors * inverse_sqrt(values)))


def convergence_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """``max|C_old - C_new| / (ε + max|C_new|)`` as one row."""
    k = width_of(new, "c")
    joined = new.join(
        old.select("col_id", *[F.col(f"c_{j}").alias(f"o_{j}") for j in range(k)]), "col_id"
    )
    return joined.selectExpr(delta_sql([f"o_{j}" for j in range(k)], names("c", k)) + " AS delta")


def delta_sql(old: Sequence[str], new: Sequence[str]) -> str:
    change = ", ".join(f"max(abs({o} - {c}))" for o, c in zip(old, new))
    size = ", ".join(f"max(abs({c}))" for c in new)
    pick = "greatest({})" if len(new) > 1 else "({})"
    return f"{pick.format(change)} / (2.220446049250313e-16D + {pick.format(size)})"
