"""Seeded numbers made from MD5 digests.

They depend only on the seed and the key, so a run gives the same numbers on any
partitioning, and any engine with MD5 can recompute them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits 1-8 and 9-16 of the digest are read as two 32-bit numbers.
_WORD = 8
_SPAN = float(2**32)


def digest(seed: int | str, *keys: str | Column) -> Column:
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def word(hexdigest: Column, index: int) -> Column:
    """The ``index``-th 32-bit word of a digest as a BIGINT."""
    return F.conv(F.substring(hexdigest, index * _WORD + 1, _WORD), 16, 10).cast("bigint")


def uniform(hexdigest: Column, index: int = 0) -> Column:
    """A number in (0, 1)."""
    return (word(hexdigest, index).cast("double") + 0.5) / _SPAN


def gaussian(hexdigest: Column) -> Column:
    """A standard normal number (Box and Muller's transform of two words)."""
    radius = F.sqrt(-2.0 * F.log(uniform(hexdigest, 0)))
    return radius * F.cos(uniform(hexdigest, 1) * (2.0 * 3.141592653589793))
