"""Gram matrices of table columns: ``Σ_rows columnᵢ · columnⱼ``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Up to this many products one generated aggregate is faster than shipping rows to Python.
SQL_PRODUCTS = 160


def gram_entries(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(i, j, value)`` for ``i <= j``, as partial sums per task and then one sum per entry."""
    columns = list(columns)
    upper = np.triu_indices(len(columns))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(columns), len(columns)))
        for batch in batches:
            block = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            total += block.T @ block
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(upper[0].astype(np.int32)),
                pa.array(upper[1].astype(np.int32)),
                pa.array(total[upper]),
            ],
            names=["i", "j", "value"],
        )

    parts = df.select(*columns).mapInArrow(partial, "i int, j int, value double")
    return parts.groupBy("i", "j").agg({"value": "sum"}).withColumnRenamed("sum(value)", "value")


def gram(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The symmetric matrix itself; only ``len(columns)²`` numbers reach the driver."""
    columns = list(columns)
    width = len(columns)
    result = np.zeros((width, width))
    if width * (width + 1) // 2 <= SQL_PRODUCTS:
        pairs = [(i, j) for i in range(width) for j in range(i, width)]
        row = df.selectExpr(
            *[f"coalesce(sum({columns[i]} * {columns[j]}), 0D) AS g_{i}_{j}" for i, j in pairs]
        ).first()
        for (i, j), value in zip(pairs, row):
            result[i, j] = result[j, i] = value
        return result
    for i, j, value in gram_entries(df, columns).collect():
        result[i, j] = result[j, i] = value
    return result
