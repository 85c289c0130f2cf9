"""Start matrices D×k, made column by column from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import names
from ..functions.hashing import digest, gaussian, uniform

# Fixed values of the reproducible start: entry (i, j) is (i + j) % 10 + 1, and this variance.
FIXED_MODULUS = 10
FIXED_OFFSET = 1
FIXED_VARIANCE = 0.9644868606768501


def start_array(width: int, seed: int | str, dist: str) -> Column:
    """The start values of one column id as an array: one short expression for any width."""

    def entry(j: Column) -> Column:
        if dist == "fixed":
            return ((F.col("col_id") + j) % FIXED_MODULUS + FIXED_OFFSET).cast("double")
        key = digest(seed, "col_id", j)
        return gaussian(key) if dist == "normal" else uniform(key)

    if dist not in ("normal", "uniform", "fixed"):
        raise ValueError(f"dist must be 'normal', 'uniform' or 'fixed', not {dist!r}")
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), entry)


def random_factor(
    columns: DataFrame,
    width: int,
    seed: int | str = 0,
    dist: str = "normal",
    prefix: str = "c",
    keep: tuple[str, ...] = ("col_id",),
) -> DataFrame:
    """A start matrix over the ids in ``columns(col_id)``."""
    filled = columns.select(*keep, start_array(width, seed, dist).alias("_a"))
    return filled.select(
        *keep, *[F.col("_a")[j].alias(n) for j, n in enumerate(names(prefix, width))]
    )


def uniform_scalar(seed: int | str = 0) -> float:
    """A start variance in (0, 1)."""
    import hashlib

    return (int(hashlib.md5(f"{seed}:variance".encode()).hexdigest()[:8], 16) + 0.5) / 2.0**32
