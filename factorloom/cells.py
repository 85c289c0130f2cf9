"""The cell table: one row per stored entry of a sparse matrix.

``cells(row_id BIGINT, col_id INT, value DOUBLE)``. A coordinate that is not in the table is a zero;
a coordinate listed in a mask is missing (see ``operators.masks``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import cut_lineage, fits_broadcast

CELL_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("col_id", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)


class Shape(NamedTuple):
    n_rows: int
    n_cols: int
    nnz: int


def as_cells(df: DataFrame, row: str | Column, col: str | Column, value: str | Column) -> DataFrame:
    pick = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(
        pick(row).cast("bigint").alias("row_id"),
        pick(col).cast("int").alias("col_id"),
        pick(value).cast("double").alias("value"),
    )


def measure(cells: DataFrame, n_rows: int | None = None, n_cols: int | None = None) -> Shape:
    """Numbers of rows, columns and cells; ids count from 0, so the largest id fixes what is not given."""
    top = cells.agg(F.max("row_id"), F.max("col_id"), F.count("*")).first()
    return Shape(
        n_rows if n_rows is not None else (-1 if top[0] is None else top[0]) + 1,
        n_cols if n_cols is not None else (-1 if top[1] is None else top[1]) + 1,
        top[2],
    )


def clip_columns(cells: DataFrame, n_cols: int) -> DataFrame:
    """Drop cells outside ``0 … n_cols-1`` and stored zeros; both tests reach the Parquet scan."""
    return cells.filter((F.col("col_id") >= 0) & (F.col("col_id") < n_cols) & (F.col("value") != 0))


def dedupe_cells(cells: DataFrame, order: str) -> DataFrame:
    """One cell per coordinate; the one with the largest ``order`` wins."""
    return cells.groupBy("row_id", "col_id").agg(F.max_by("value", order).alias("value"))


def row_spine(spark: SparkSession, lo: int, hi: int) -> DataFrame:
    """Every row id of ``lo <= id < hi``, so that rows without cells are not lost."""
    return spark.range(lo, hi).withColumnRenamed("id", "row_id")


def col_spine(spark: SparkSession, n_cols: int) -> DataFrame:
    return spark.range(n_cols).select(F.col("id").cast("int").alias("col_id"))


def dense_ids(df: DataFrame, column: str, out: str = "dense_id") -> DataFrame:
    """``(column, out)``: the distinct values of ``column`` numbered 0, 1, 2 … in their order.

    The distinct values are range-partitioned and sorted; each partition then numbers its own
    values, starting after the counts of the partitions before it. The sorted values are
    checkpointed first, so both uses see the same partitions. A table that its count shows to be small is
    marked for broadcast, so that joining it back does not shuffle ``df``.
    """
    ordered = (
        df.select(column)
        .distinct()
        .repartitionByRange(F.col(column))
        .sortWithinPartitions(column)
        .select(column, F.monotonically_increasing_id().alias("_mid"))
        .withColumn("_part", F.shiftrightunsigned("_mid", 33))
        .withColumn("_pos", F.col("_mid").bitwiseAND((1 << 33) - 1))
    )
    ordered = cut_lineage(ordered)
    # One row per partition: the running count over them is a small window.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ordered.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    ids = ordered.join(F.broadcast(starts), "_part").select(
        column, (F.col("_start") + F.col("_pos")).alias(out)
    )
    size = ordered.agg(F.count("*"), F.max(F.length(F.col(column).cast("string")))).first()
    # Names may be long; four bytes a letter, on top of the number.
    fits = fits_broadcast(df.sparkSession, size[0], 2 + (size[1] or 0) // 2)
    return F.broadcast(ids) if fits else ids


def dense_ranks(df: DataFrame, column: str, out: str, order: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``out``: the place of ``column`` among its distinct values, 0, 1, 2 …; rows without a value are left out.

    Rows are range-partitioned by ``column`` and the columns of ``order``, so that a value with very many rows takes several partitions,
    and are sorted there. Each partition numbers its values from 0, which is stored; one row per partition then says where its
    numbers begin. A value that goes on from the partition before keeps its number. Nothing is joined by value.
    """
    schema = T.StructType([*df.schema, T.StructField("_part", T.IntegerType()), T.StructField("_pos", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, pos = TaskContext.get().partitionId(), None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(column)
            new = np.ones(batch.num_rows, bool)
            new[0] = pos < 0 or values[0].as_py() != last
            new[1:] = pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
            places = pos + np.cumsum(new)
            last, pos = values[-1].as_py(), int(places[-1])
            parts = pa.array(np.full(batch.num_rows, part, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(places)], [*batch.schema.names, "_part", "_pos"])

    keys = [column, *order]
    placed = df.filter(F.col(column).isNotNull()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = cut_lineage(placed.mapInArrow(number, schema))
    ends = numbered.groupBy("_part").agg(
        F.min(column).alias("_first"), F.max(column).alias("_last"), (F.max("_pos") + 1).alias("_n")
    )
    # One row per partition from here on.
    in_turn = Window.orderBy("_part")
    goes_on = F.coalesce((F.lag("_last").over(in_turn) == F.col("_first")).cast("int"), F.lit(0))
    adds = ends.withColumn("_joins", goes_on).withColumn("_adds", F.col("_n") - F.col("_joins"))
    before = in_turn.rowsBetween(Window.unboundedPreceding, -1)
    starts = adds.select("_part", (F.coalesce(F.sum("_adds").over(before), F.lit(0)) - F.col("_joins")).alias("_start"))
    found = numbered.join(F.broadcast(starts), "_part")
    return found.select(*df.columns, (F.col("_start") + F.col("_pos")).alias(out))


def pack(cells: DataFrame, chunk_cols: int = 65536) -> DataFrame:
    """``(row_id, chunk, idx, val)``: cells of a row as sorted arrays.

    A row is cut every ``chunk_cols`` columns, so no record grows with the length of a row.
    """
    chunk = F.floor(F.col("col_id") / F.lit(chunk_cols)).cast("int")
    entries = F.sort_array(F.collect_list(F.struct("col_id", "value")))
    return (
        cells.groupBy("row_id", chunk.alias("chunk"))
        .agg(entries.alias("_e"))
        .select(
            "row_id", "chunk", F.col("_e.col_id").alias("idx"), F.col("_e.value").alias("val")
        )
    )


def unpack(packed: DataFrame) -> DataFrame:
    pairs = F.explode(F.arrays_zip("idx", "val"))
    return packed.select("row_id", pairs.alias("_p")).select(
        "row_id", F.col("_p.idx").alias("col_id"), F.col("_p.val").alias("value")
    )
