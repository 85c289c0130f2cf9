"""Filling in missing cells and carrying the mean along."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import number
from ..functions.hashing import digest, uniform, word
from ..session import cut_lineage, fits_broadcast
from .joins import with_columns_of, with_rows_of
from .products import width_of


# Columns that are made at once: no array is longer, however many columns a matrix has.
COLUMN_BLOCK = 65_536
# Listed rows that stand under a column one behind the other, columns of them that are made in one go, and listed rows that a task numbers.
ROW_BLOCK, COLUMN_RUN, LISTED_ROWS = 1024, 64, 131_072


def fill_missing_init(missing: DataFrame, mean: DataFrame, n_cols: int, seed: int | str) -> DataFrame:
    """First values: the column mean, or a number 0 … 4 from the digest where the mean is 0."""
    small = F.pmod(word(digest(seed, "row_id", "col_id"), 0), F.lit(5)).cast("double")
    filled = with_columns_of(missing.drop("value"), mean, n_cols)
    return filled.select(
        "row_id", "col_id", F.when(F.col("m") != 0, F.col("m")).otherwise(small).alias("value")
    )


def reconstruct_cells(
    coords: DataFrame,
    scores: DataFrame,
    factor: DataFrame,
    mean: DataFrame,
    n_cols: int,
    shift: Sequence[float] | None = None,
    rounding: str = "none",
) -> DataFrame:
    """``m_j + Σ (x_i - x̄)·C_j`` at the given coordinates. A row without scores has ``x = 0``."""
    k = width_of(factor, "c")
    shift = [0.0] * k if shift is None else shift
    side = factor.join(mean, "col_id")
    terms = " + ".join(
        f"(coalesce(x_{j}, 0D) - {number(shift[j])}) * c_{j}" for j in range(k)
    )
    joined = with_rows_of(with_columns_of(coords.select("row_id", "col_id"), side, n_cols), scores, "left")
    return joined.select("row_id", "col_id", rounded(F.expr(f"m + {terms}"), rounding).alias("value"))


def rounded(value, rounding: str):
    if rounding == "none":
        return value
    if rounding == "ceil":
        return F.ceil(value).cast("double")
    raise ValueError(f"rounding must be 'none' or 'ceil', not {rounding!r}")


# Imputing a missing cell is reconstructing it.
impute_missing = reconstruct_cells


def update_mean_missing(
    missing: DataFrame, observed_mean: DataFrame, n_rows: int
) -> DataFrame:
    """``m = (Σ imputed)/N + observed mean``."""
    extra = missing.groupBy("col_id").agg((F.sum("value") / F.lit(n_rows)).alias("_extra"))
    return observed_mean.join(extra, "col_id", "left").select(
        "col_id", (F.col("m") + F.coalesce("_extra", F.lit(0.0))).alias("m")
    )


def center_cells(cells: DataFrame, mean: DataFrame, n_cols: int) -> DataFrame:
    """``y - m`` at the stored cells."""
    return with_columns_of(cells, mean, n_cols).select(
        "row_id", "col_id", (F.col("value") - F.col("m")).alias("value")
    )


def center_rows(
    cells: DataFrame, rows: DataFrame, mean: DataFrame, n_cols: int, finish: Callable[[Column], Column] = lambda value: value
) -> DataFrame:
    """``y - m`` at all columns of the given ``rows(row_id)``; meant for a sample of rows.

    The result has ``n_cols`` cells a row. They are made where they are used: only stored cells and one row for each block of them are
    dealt out. Cells of a column stand together, a block of rows at a time, as most of them have the same value: written
    as Parquet they are runs, which take a small part of the room that rows one behind the other do. ``finish`` is applied to the
    values, once for each run. Rows too many to be sent to all executors come one behind the other.
    """
    n_rows = rows.count()
    if fits_broadcast(cells.sparkSession, n_rows, 1):
        listed = numbered_rows(rows, n_rows)
        # A hot column would be dealt out by row_id.
        runs = with_columns_of(row_runs(cells, listed, n_cols).withColumnRenamed("_b", "row_id"), mean, n_cols)
        value = finish(F.coalesce("_v", F.lit(0.0)) - F.col("m")).alias("value")
        some = F.slice("_ids", F.col("_lo") + 1, F.col("_hi") - F.col("_lo") + 1)
        placed = runs.select(F.col("row_id").alias("_b"), "col_id", value, "_lo", "_hi").join(F.broadcast(row_blocks(listed)), "_b")
        return placed.select(F.explode(some).alias("row_id"), "col_id", "value")
    spread = column_spans(cells, rows, n_cols).select("row_id", F.explode(F.sequence("_from", "_to")).alias("col_id"), "_v")
    return with_columns_of(spread, mean, n_cols).select(
        "row_id", "col_id", finish(F.coalesce("_v", F.lit(0.0)) - F.col("m")).alias("value")
    )


def numbered_rows(rows: DataFrame, n_rows: int) -> DataFrame:
    """``(row_id, _b, _p)``: each listed row, repeats too, with its block of at most ``ROW_BLOCK`` rows and its place there."""
    dealt = rows.select("row_id").repartition(-(-n_rows // LISTED_ROWS) or 1).sortWithinPartitions("row_id")
    listed = cut_lineage(dealt.select("row_id", F.monotonically_increasing_id().alias("_mid")))
    shift = ROW_BLOCK.bit_length() - 1
    return listed.select("row_id", F.shiftright("_mid", shift).alias("_b"), F.col("_mid").bitwiseAND(ROW_BLOCK - 1).cast("int").alias("_p"))


def row_blocks(listed: DataFrame) -> DataFrame:
    """``(_b, _ids)``: the rows of each block in their places."""
    return listed.groupBy("_b").agg(F.sort_array(F.collect_list(F.struct("_p", "row_id"))).alias("_e")).select("_b", F.col("_e.row_id").alias("_ids"))


def row_runs(cells: DataFrame, listed: DataFrame, n_cols: int) -> DataFrame:
    """``(_b, col_id, _lo, _hi, _v)``: all cells of the listed rows, column by column in each block of rows, as stored cells, with
    value, and the gaps between them, without; ``_lo`` to ``_hi`` are places in the block, which may end before.

    A repeated cell has its run twice, as has a cell of a row that is listed twice.
    """
    run = F.floor(F.col("col_id") / COLUMN_RUN).cast("int")
    known = cells.filter(F.col("col_id").between(0, n_cols - 1)).join(F.broadcast(listed), "row_id")
    known = known.select(
        "_b", run.alias("_run"), ((F.col("col_id") - run * COLUMN_RUN) * ROW_BLOCK + F.col("_p")).alias("_c"), F.col("value").alias("_v"), F.lit(False).alias("_head")
    )
    # The first row of each block and run of columns stands before its cells.
    runs = all_columns(listed.select(F.col("_b").alias("row_id")).distinct(), -(-n_cols // COLUMN_RUN))
    heads = runs.select(
        F.col("row_id").alias("_b"), F.col("col_id").alias("_run"), F.lit(-1).alias("_c"), F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_head")
    )
    # So many partitions whatever the bytes: what is made of them is far larger.
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_turn = Window.partitionBy("_b", "_run").orderBy("_c")
    end = F.least(F.lit(COLUMN_RUN), F.lit(n_cols) - F.col("_run") * COLUMN_RUN) * ROW_BLOCK
    spans = known.unionByName(heads).repartition(parts, "_b", "_run").withColumn("_next", F.coalesce(F.lead("_c").over(in_turn), end))
    gap = F.struct((F.col("_c") + 1).alias("_from"), (F.col("_next") - 1).alias("_to"), F.lit(None).cast("double").alias("_v"))
    own = F.struct(F.col("_c").alias("_from"), F.col("_c").alias("_to"), F.col("_v"))
    both = F.when(F.col("_head"), F.array(gap)).otherwise(F.array(own, gap))
    each = spans.select("_b", "_run", F.explode(both).alias("_s")).select("_b", "_run", "_s.*").filter("_from <= _to")
    first, last = F.expr(f"_from div {ROW_BLOCK}").cast("int"), F.expr(f"_to div {ROW_BLOCK}").cast("int")
    columns = each.select("*", F.explode(F.sequence(first, last)).alias("_k"))
    return columns.select(
        "_b",
        (F.col("_run") * COLUMN_RUN + F.col("_k")).alias("col_id"),
        F.greatest(F.col("_from") - F.col("_k") * ROW_BLOCK, F.lit(0)).alias("_lo"),
        F.least(F.col("_to") - F.col("_k") * ROW_BLOCK, F.lit(ROW_BLOCK - 1)).alias("_hi"),
        "_v",
    )


def column_spans(cells: DataFrame, rows: DataFrame, n_cols: int, block: int = COLUMN_BLOCK) -> DataFrame:
    """``(row_id, _from, _to, _v)``: all columns of each row as stored cells, with value, and the gaps between them, without.

    No span is longer than ``block``. A row that is listed twice has its spans twice, a repeated cell too.
    """
    listed = rows.groupBy("row_id").agg(F.count("*").alias("_times"))
    known = cells.filter(F.col("col_id").between(0, n_cols - 1)).join(rows, "row_id", "left_semi")
    known = known.select(
        "row_id", F.floor(F.col("col_id") / block).cast("int").alias("_b"), "col_id", F.col("value").alias("_v"), F.lit(None).cast("long").alias("_times")
    )
    # The first row of each row and block stands before its columns, and says how often the row is listed.
    heads = listed.select("row_id", F.explode(blocks_of(n_cols, block)).alias("_b"), "_times").select(
        "row_id", "_b", (F.col("_b") * block - 1).alias("col_id"), F.lit(None).cast("double").alias("_v"), "_times"
    )
    heads = heads if n_cols > 0 else heads.limit(0)
    # So many partitions whatever the bytes: what is made of them is far larger.
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = known.unionByName(heads).repartition(parts, "row_id", "_b")
    in_turn = Window.partitionBy("row_id", "_b").orderBy("col_id", F.col("_times").isNull())
    end = F.least((F.col("_b") + 1) * block, F.lit(n_cols))
    spans = placed.select(
        "row_id",
        F.col("col_id").alias("_c"),
        "_v",
        F.col("_times").isNotNull().alias("_head"),
        F.first("_times").over(in_turn).alias("_times"),
        F.coalesce(F.lead("col_id").over(in_turn), end).alias("_next"),
    )
    gap = F.struct((F.col("_c") + 1).alias("_from"), (F.col("_next") - 1).alias("_to"), F.lit(None).cast("double").alias("_v"))
    own = F.struct(F.col("_c").alias("_from"), F.col("_c").alias("_to"), F.col("_v"))
    both = F.when(F.col("_head"), F.array(gap)).otherwise(F.array(own, gap))
    each = spans.select("row_id", F.explode(both).alias("_s"), "_times").select("row_id", "_s.*", "_times").filter("_from <= _to")
    return each.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).drop("_copy", "_times")


def blocks_of(n_cols: int, block: int):
    return F.sequence(F.lit(0), F.lit(max(n_cols - 1, 0) // block))


def all_columns(rows: DataFrame, n_cols: int, block: int = COLUMN_BLOCK) -> DataFrame:
    """``(row_id, col_id)`` for every column of each row: first its blocks of columns, then the columns of a block."""
    first = F.col("_b") * block
    inside = F.sequence(first, F.least(first + block, F.lit(n_cols)) - 1)
    spread = rows.select("row_id", F.explode(blocks_of(n_cols, block)).alias("_b")).select("row_id", F.explode(inside).alias("col_id"))
    return spread if n_cols > 0 else spread.limit(0)


def sample_rows(cells: DataFrame, rate: float, seed: int | str) -> DataFrame:
    """Keep whole rows, each with probability ``1 - rate``."""
    return cells.filter(uniform(digest(seed, "row_id")) > F.lit(float(rate)))


def recon_residual(
    cells: DataFrame,
    coords: DataFrame,
    scores: DataFrame,
    factor: DataFrame,
    mean: DataFrame,
    n_cols: int,
    shift: Sequence[float] | None = None,
) -> DataFrame:
    """Reconstruction minus data at ``coords`` and at all stored cells; absent data is 0."""
    both = coords.select("row_id", "col_id").union(cells.select("row_id", "col_id")).distinct()
    guess = reconstruct_cells(both, scores, factor, mean, n_cols, shift)
    data = cells.select("row_id", "col_id", F.col("value").alias("_v"))
    return guess.join(data, ["row_id", "col_id"], "left").select(
        "row_id", "col_id", (F.col("value") - F.coalesce("_v", F.lit(0.0))).alias("value")
    )


__all__ = [
    "center_cells",
    "center_rows",
    "fill_missing_init",
    "impute_missing",
    "recon_residual",
    "reconstruct_cells",
    "rounded",
    "sample_rows",
    "update_mean_missing",
]
