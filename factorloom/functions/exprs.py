"""SQL text for component columns ``c_0 … c_{k-1}``.

Column arithmetic is written as SQL text: one parsed expression per output column instead of k² calls
into the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame


def names(prefix: str, width: int) -> list[str]:
    return [f"{prefix}_{j}" for j in range(width)]


def number(value: float) -> str:
    """A double literal with all its digits."""
    if not math.isfinite(value):
        raise ArithmeticError(f"not a finite number: {value}")
    return f"({float(value)!r}D)"


def with_numbers(df: DataFrame, column: str, values: Sequence[float]) -> DataFrame:
    """``df`` with an array of numbers in ``column``.

    The array comes from a one-row subquery, so the generated code holds no numbers: rounds that differ only in
    them share one compiled plan instead of compiling, and warming up, a new one each.
    """
    texts = ", ".join(number(v) for v in values)
    one = df.sparkSession.sql(f"SELECT s FROM VALUES (array({texts})) AS t(s)")
    return df.withColumn(column, one.scalar())


def times_array(sources: Sequence[str], array: str, outputs: Sequence[str]) -> list[str]:
    """Select list for (row of ``sources``) × (matrix kept by rows in the column ``array``)."""
    width = len(outputs)
    return [
        "("
        + " + ".join(f"{s} * {array}[{i * width + j}]" for i, s in enumerate(sources))
        + f") AS {out}"
        for j, out in enumerate(outputs)
    ]


def sums_of_products(weight: str, sources: Sequence[str], outputs: Sequence[str]) -> list[str]:
    """Aggregate list ``sum(weight · source)``."""
    return [f"sum({weight} * {s}) AS {out}" for s, out in zip(sources, outputs)]
