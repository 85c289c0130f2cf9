"""The matrices that the registered queries work on, made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cells import Shape, as_cells, col_spine, dense_ids, row_spine
from ..operators.masks import mask_cells
from ..operators.starts import random_factor

MASK_PERCENT = 10
MASK_SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User × event type, sum of values."""
    events = table(spark, sf_dir, "events")
    sums = events.groupBy("user_id", "event_type").agg(F.sum("value").alias("value"))
    types = dense_ids(events, "event_type", "col_id")
    return as_cells(sums.join(types, "event_type"), "user_id", "col_id", "value")


def user_events_shape(spark: SparkSession, sf_dir: str) -> Shape:
    row = (
        table(spark, sf_dir, "events")
        .agg(F.countDistinct("user_id"), F.countDistinct("event_type"))
        .first()
    )
    return Shape(row[0], row[1], -1)


def customer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer × part, sum of quantities."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    sums = joined.groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("value"))
    return as_cells(sums, "o_custkey", "l_partkey", "value")


def customer_parts_shape(spark: SparkSession, sf_dir: str) -> Shape:
    return Shape(
        table(spark, sf_dir, "customer").count(), table(spark, sf_dir, "part").count(), -1
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector × position."""
    vectors = table(spark, sf_dir, "embeddings")
    long = vectors.select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return as_cells(long, "vec_id", "pos", "v")


def customers(spark: SparkSession, shape: Shape) -> DataFrame:
    return row_spine(spark, 0, shape.n_rows)


def fixed_factor(spark: SparkSession, shape: Shape, width: int = 2) -> DataFrame:
    return random_factor(col_spine(spark, shape.n_cols), width, dist="fixed")


def data_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor from the data: cells of each part and the sum of their values, whole numbers."""
    cells = customer_parts(spark, sf_dir)
    return cells.groupBy("col_id").agg(F.count("*").cast("double").alias("c_0"), F.sum("value").alias("c_1"))


def parts_mask(cells: DataFrame) -> DataFrame:
    return mask_cells(cells, MASK_PERCENT, MASK_SEED)
