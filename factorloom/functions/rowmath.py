"""Rows of component columns times a small matrix.

Up to a few dozen products the result is a generated SQL projection. Beyond that the generated code becomes
too long for the JVM's compiler, and whole Arrow batches are multiplied in the tasks instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exprs import times_array, with_numbers

SQL_TERMS = 150


def _block(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])


def multiply(
    df: DataFrame,
    keep: Sequence[str],
    sources: Sequence[str],
    matrix: np.ndarray,
    outputs: Sequence[str],
) -> DataFrame:
    """``keep`` columns and ``outputs = sources × matrix``."""
    matrix = np.asarray(matrix, dtype=float)
    keep, sources, outputs = list(keep), list(sources), list(outputs)
    if matrix.size <= SQL_TERMS:
        loaded = with_numbers(df, "_w", matrix.ravel())
        return loaded.selectExpr(*keep, *times_array(sources, "_w", outputs))
    if not np.isfinite(matrix).all():
        raise ArithmeticError("the small matrix is not finite")
    kinds = dict(df.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + [f"{c} double" for c in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            product = _block(batch, sources) @ matrix
            arrays = [batch.column(c) for c in keep] + [
                pa.array(np.ascontiguousarray(product[:, j])) for j in range(len(outputs))
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *outputs])

    needed = keep + [s for s in sources if s not in keep]
    return df.select(*needed).mapInArrow(run, schema)


def change(
    df: DataFrame,
    old: Sequence[str],
    old_matrix: np.ndarray,
    new: Sequence[str],
    new_matrix: np.ndarray,
) -> tuple[float, float]:
    """``max|old·A - new·B|`` and ``max|new·B|`` over all rows."""
    old, new = list(old), list(new)
    width = new_matrix.shape[1]
    if old_matrix.size + new_matrix.size <= SQL_TERMS:
        a, b = ([f"{p}_{j}" for j in range(width)] for p in ("_a", "_b"))
        loaded = with_numbers(with_numbers(df, "_p", old_matrix.ravel()), "_q", new_matrix.ravel())
        both = loaded.selectExpr(*times_array(old, "_p", a), *times_array(new, "_q", b))
        tops = both.selectExpr(
            *[f"max(abs({x} - {y}))" for x, y in zip(a, b)], *[f"max(abs({y}))" for y in b]
        ).first()
        return max(t or 0.0 for t in tops[:width]), max(t or 0.0 for t in tops[width:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = size = 0.0
        for batch in batches:
            if batch.num_rows:
                later = _block(batch, new) @ new_matrix
                moved = max(moved, float(np.abs(_block(batch, old) @ old_matrix - later).max()))
                size = max(size, float(np.abs(later).max()))
        yield pa.RecordBatch.from_arrays([pa.array([moved]), pa.array([size])], names=["moved", "size"])

    tops = df.select(*old, *new).mapInArrow(run, "moved double, size double")
    moved, size = tops.agg({"moved": "max", "size": "max"}).select("max(moved)", "max(size)").first()
    return moved or 0.0, size or 0.0
