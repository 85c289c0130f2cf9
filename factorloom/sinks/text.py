"""Matrices as text lines: dense, list of lists, coordinates.

A line of dense or list text holds a whole row. ``dense_lines`` and ``lil_lines`` make such lines as values; ``write_matrix``
streams them to files cell by cell (see ``sinks.stream``), so a row may be longer than any memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stream import write_rows

#: What Parquet's writer needs for long lines, where nothing else is set. It looks at its sizes after a hundred rows first: of a wide matrix that
#: is more text than a task has memory. And snappy, the codec unless set, makes text a 21st at the most, zstd a few thousandths of lines of zeros.
FIRST_CHECK, CODEC = "parquet.page.size.row.check.min", "spark.sql.parquet.compression.codec"
LONG_LINES = {FIRST_CHECK: "1", CODEC: "zstd"}


def _rows(cells: DataFrame, spine: DataFrame) -> DataFrame:
    """``(row_id, _e)`` with the sorted non-zero entries of each row, empty rows included."""
    entries = F.sort_array(F.collect_list(F.struct("col_id", "value")))
    kept = cells.filter(F.col("value") != 0).groupBy("row_id").agg(entries.alias("_e"))
    return spine.join(kept, "row_id", "left").withColumn(
        "_e", F.coalesce("_e", F.expr("cast(array() AS array<struct<col_id:int,value:double>>)"))
    )


def dense_lines(cells: DataFrame, spine: DataFrame, n_cols: int) -> DataFrame:
    """``(row_id, line)``: all ``n_cols`` values of a row, each followed by a blank.

    The zeros between two stored entries are written as one repeated text, so the work of
    a line is its stored entries plus its length. As lines may be long, Parquet's writer looks at its sizes
    from the first row on and writes zstd from now on in this session, unless ``FIRST_CHECK`` or ``CODEC`` is set in it.
    """
    for key, value in LONG_LINES.items():
        if cells.sparkSession.conf.get(key, None) is None:
            cells.sparkSession.conf.set(key, value)
    gap = "e.col_id - if(i = 0, 0, _e[i - 1].col_id + 1)"
    last = f"repeat('0.0 ', {int(n_cols)} - if(size(_e) = 0, 0, element_at(_e, -1).col_id + 1))"
    # The pieces of a line are put together once.
    pieces = f"""
        flatten(transform(_e, (e, i) -> if({gap} IS NULL, array(), array(repeat('0.0 ', {gap}), cast(e.value AS string), ' '))))
    """
    line = F.expr(f"CASE WHEN size(_e) > 0 AND element_at(_e, -1).col_id IS NULL THEN NULL ELSE concat_ws('', {pieces}, {last}) END")
    return _rows(cells, spine).select("row_id", line.alias("line"))


def lil_lines(cells: DataFrame, spine: DataFrame) -> DataFrame:
    """``(row_id, line)``: ``{col:val,col:val}`` without zeros; ``{}`` for an empty row."""
    body = F.expr(
        "array_join(transform(_e, e -> concat(cast(e.col_id AS string), ':', cast(e.value AS string))), ',')"
    )
    return _rows(cells, spine).select(
        "row_id", F.concat(F.lit("{"), body, F.lit("}")).alias("line")
    )


def coo_lines(cells: DataFrame) -> DataFrame:
    """``(row_id, col_id, line)``: ``row,col,val`` for each non-zero cell."""
    return cells.filter(F.col("value") != 0).select(
        "row_id", "col_id", F.concat_ws(",", "row_id", "col_id", "value").alias("line")
    )


def write_matrix(
    cells: DataFrame,
    path: str,
    fmt: str,
    spine: DataFrame | None = None,
    n_cols: int | None = None,
    compression: str | None = None,
) -> None:
    """Write ``dense``, ``lil`` or ``coo`` text, rows in order over the part files.

    With ``compression='gzip'`` the files take a small part of their text, as zeros fill most of a dense one; Spark reads them alike.
    """
    if fmt == "coo":
        coo_lines(cells).repartitionByRange("row_id", "col_id").sortWithinPartitions(
            "row_id", "col_id"
        ).select("line").write.text(path, compression=compression)
        return
    if fmt not in ("dense", "lil"):
        raise ValueError(f"unknown format {fmt!r}: use dense, lil or coo")
    if spine is None:
        raise ValueError("dense and list text need the row spine")
    if fmt == "dense" and n_cols is None:
        raise ValueError("dense text needs n_cols")
    write_rows(cells, path, fmt, spine, n_cols, compression)
