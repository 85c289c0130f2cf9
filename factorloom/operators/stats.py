"""Sums over rows, columns and whole matrices, without ever building the dense matrix.

``N`` is the number of rows, empty ones included: a coordinate that is not stored is a zero and
takes part in means and norms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cells import col_spine


def row_nnz(cells: DataFrame) -> DataFrame:
    """``(row_id, nnz)``."""
    return cells.groupBy("row_id").agg(F.count_if(F.col("value") != 0).alias("nnz"))


def total_nnz(cells: DataFrame) -> int:
    return cells.agg(F.count_if(F.col("value") != 0)).first()[0]


def column_profile(cells: DataFrame) -> DataFrame:
    """``(col_id, n, total, avg, m2, top_row)`` of the stored cells of each column.

    ``m2`` is ``Σ(v - avg)²``, merged pairwise by the engine, so nothing is lost by subtracting large
    sums. One pass; everything below about means and norms follows from this table of D rows.
    """
    return cells.groupBy("col_id").agg(
        F.count("*").alias("n"),
        F.sum("value").alias("total"),
        F.avg("value").alias("avg"),
        (F.var_pop("value") * F.count("*")).alias("m2"),
        F.max("row_id").alias("top_row"),
    )


def _on_spine(cells: DataFrame, per_column: DataFrame, n_cols: int, value: str) -> DataFrame:
    spine = col_spine(cells.sparkSession, n_cols)
    return spine.join(per_column, "col_id", "left").select(
        "col_id", F.coalesce(value, F.lit(0.0)).alias(value)
    )


def col_sum(cells: DataFrame, n_cols: int) -> DataFrame:
    """``(col_id, total)`` for each of the ``n_cols`` columns."""
    sums = cells.groupBy("col_id").agg(F.sum("value").alias("total"))
    return _on_spine(cells, sums, n_cols, "total")


def col_mean(cells: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """``(col_id, m)`` with the sum divided by the number of all rows."""
    means = cells.groupBy("col_id").agg((F.sum("value") / F.lit(n_rows)).alias("m"))
    return _on_spine(cells, means, n_cols, "m")


def mean_sq(mean: DataFrame) -> DataFrame:
    """``Σ m²`` as one row."""
    return mean.agg(F.coalesce(F.sum(F.col("m") * F.col("m")), F.lit(0.0)).alias("mean_sq"))


def centered_sq(n_rows: int, n: str = "n", avg: str = "avg", m2: str = "m2", m: str = "m") -> str:
    """SQL text: ``Σ(v - m)²`` over one whole column, unstored zeros included, from its profile."""
    return (
        f"({m2} + {n} * ({avg} - {m}) * ({avg} - {m}) + ({int(n_rows)}D - {n}) * {m} * {m})"
    )


def frobenius_centered(cells: DataFrame, n_rows: int) -> DataFrame:
    """``‖Y - m‖²_F`` as one row: one aggregate by column, no join with the mean."""
    profile = column_profile(cells).withColumn("m", F.col("total") / F.lit(n_rows))
    return profile.selectExpr(f"coalesce(sum({centered_sq(n_rows)}), 0D) AS norm2")


def vec_sum(df: DataFrame, column: str) -> DataFrame:
    """``(pos, total)``: element-wise sum of an array column."""
    return (
        df.select(F.posexplode(column).alias("pos", "v"))
        .groupBy("pos")
        .agg(F.sum(F.col("v").cast("double")).alias("total"))
    )


def mat_sum(df: DataFrame, column: str) -> DataFrame:
    """``(i, j, total)``: element-wise sum of a column of arrays of arrays."""
    return (
        df.select(F.posexplode(column).alias("i", "_r"))
        .select("i", F.posexplode("_r").alias("j", "v"))
        .groupBy("i", "j")
        .agg(F.sum(F.col("v").cast("double")).alias("total"))
    )


def vec_abs_sum(cells: DataFrame) -> DataFrame:
    """``(col_id, abs_total)``."""
    return cells.groupBy("col_id").agg(F.sum(F.abs("value")).alias("abs_total"))


def vec_max(df: DataFrame, column: str, out: str = "top") -> DataFrame:
    """Largest value of a column, not below 0, as one row."""
    return df.agg(F.greatest(F.coalesce(F.max(column), F.lit(0.0)), F.lit(0.0)).alias(out))
