"""What several operators share: words, splits by id, bounded sums over a table."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, fresh_path, settings

Batches = Iterator[pa.RecordBatch]


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text: what stands between spaces, tabs and line ends (bytes 9-13 and 32)."""
    return text.split() if text else []


def utf8(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def give_back() -> None:
    """Give memory that is free in this worker back to the system: it lives on through stages that need little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Batches, rows: int = 1000) -> Batches:
    """Batches of at most ``rows`` rows, so that what is made of them stays small; free memory goes back before and after."""
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def groups(batches: Batches, column: str, rows: int = 1000, size: int = 4_000_000) -> Batches:
    """Slices of at most ``rows`` rows whose strings in ``column`` take about ``size`` bytes; a longer string goes alone."""
    for batch in slices(batches, rows):
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), size, "right")))
            yield batch.slice(at, n)
            at += n


def crc_mod(doc_id: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def held_out(doc_id: str, mod: int, rest: int) -> Column:
    """Whether a row is kept from learning; a row without id is not."""
    return F.coalesce(crc_mod(doc_id, mod) == rest, F.lit(False))


_WRITTEN: list[list[str]] = []


@contextmanager
def helpers(spark: SparkSession) -> Iterator[list[str]]:
    """The paths of tables that are stored inside the block, in order; what is left in the list is deleted at the end."""
    _WRITTEN.append(paths := [])
    try:
        yield paths
    finally:
        _WRITTEN.remove(paths)
        for path in paths:
            discard(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files."""
    return stored_at(df, fresh_path(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(stage: Callable[[], DataFrame], spark: SparkSession, name: str, rows: int = 1000) -> DataFrame:
    """What ``stage`` returns, written now; what it has stored on its way is deleted.

    Texts go to Python workers ``rows`` at a time, so that neither they nor the JVM hold much of them; as the session's setting for that
    counts when a plan is run, the result is written while it holds.
    """
    with helpers(spark) as written, settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows)):
        out = stored(stage(), name)
        path = written.pop()
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return out


def summed(df: DataFrame, size: int, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of a vector of ``size`` numbers, which comes from the model, not from the data.

    Each task sends one vector, split in rows of (position, value), which Spark adds up.
    """

    def partial(batches: Batches) -> Batches:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["i", "v"])

    out = np.zeros(size)
    for row in df.mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[row["i"]] = row["v"]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))
