"""Matrices, factors and masks kept as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cells import CELL_SCHEMA, clip_columns
from ..functions.exprs import names
from .text import parse_dense, read_lines


def scan_cells(
    spark: SparkSession, path: str, n_cols: int, partitions: int | None = None
) -> DataFrame:
    """Cells of a Parquet cell table inside ``n_cols`` columns, without stored zeros."""
    cells = clip_columns(spark.read.schema(CELL_SCHEMA).parquet(path), n_cols)
    return cells.repartition(partitions, "row_id") if partitions else cells


def factor_from_cells(cells: DataFrame, width: int, prefix: str = "c") -> DataFrame:
    """A D×k matrix given as cells (its row is our column) as ``(col_id, c_0 … c_{k-1})``."""
    picks = [
        F.coalesce(F.sum(F.when(F.col("col_id") == j, F.col("value"))), F.lit(0.0)).alias(name)
        for j, name in enumerate(names(prefix, width))
    ]
    return cells.groupBy(F.col("row_id").cast("int").alias("_c")).agg(*picks).withColumnRenamed(
        "_c", "col_id"
    )


def read_factor(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Read a D×k matrix from dense text; the line number is the column id."""
    return factor_from_cells(parse_dense(read_lines(spark, path)), width)


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("row_id", "col_id")
