"""Look-ups from cells into per-column and per-row tables.

A per-column table is sent to all executors only if a count proves that it is small. Otherwise both sides are shuffled in one scan
of the cells. Where adaptive execution splits skewed joins (the default), each side gets an exchange of its own, and a
partition that a key with very many cells fills is cut at run time by the sizes that its tasks wrote. Elsewhere a summary of heavy
hitters finds such keys first: their cells take ``spread`` salts by their other coordinate, and their one row of the table is
copied once for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fits_broadcast

# A key with more cells than this is split.
HOT_CELLS = 1_000_000
# Counters of a summary, in each task and in all, and the most keys it gives: with this many counters every key is found that has
# more than ``over`` cells and more than one in 3000 of all.
COUNTERS, HOTTEST = 16_384, 8_192


def hot_keys(cells: DataFrame, key: str, over: int) -> DataFrame | None:
    """``(key, spread)`` of the keys with more than ``over`` cells; None where there is none.

    Each task sums up its keys in a fixed number of counters (frequent items; Misra and Gries), and the counters are merged into one
    row: no key is shuffled, and nothing is written. Counts are exact where there are fewer keys than counters, else a little
    too large, which only makes the spread larger.
    """
    summary = cells.select(F.expr(f"approx_top_k({key}, {HOTTEST}, {COUNTERS}) AS top")).first()["top"]
    found = [(item["item"], -(-item["count"] // over)) for item in summary or [] if item["count"] > over]
    if not found:
        return None
    kind = cells.schema[key].dataType.simpleString()
    return cells.sparkSession.createDataFrame(found, f"{key} {kind}, spread bigint")


def splits_at_run_time(spark) -> bool:
    """Whether adaptive execution cuts skewed partitions of joins."""
    return all(
        spark.conf.get(f"spark.sql.adaptive.{name}", "true").lower() == "true" for name in ("enabled", "skewJoin.enabled")
    )


def split_join(cells: DataFrame, side: DataFrame, key: str, how: str) -> DataFrame:
    """A join in which both sides are dealt out anew, as cutting a skewed partition asks for.

    An aggregate by ``key`` already lies as the join wants it, without an exchange that adaptive execution could read; a second
    key that is always zero makes it deal the (small) side out once more.
    """
    lane = F.pmod(F.hash(key), F.lit(1)).alias("_lane")
    return cells.select("*", lane).join(side.select("*", lane), [key, "_lane"], how).drop("_lane")


def salted_join(
    cells: DataFrame, side: DataFrame, key: str, other: str, how: str, over: int | None = None
) -> DataFrame:
    """``cells`` joined with ``side`` (one row per ``key``) without a task per hot key."""
    if over is None and splits_at_run_time(cells.sparkSession):
        return split_join(cells, side, key, how)
    hot = hot_keys(cells, key, over or HOT_CELLS)
    if hot is None:
        return cells.join(side, key, how)
    salts = F.broadcast(hot)  # at most HOTTEST rows
    salted = cells.join(salts, key, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("spread")), F.lit(0))
    )
    copies = side.join(salts, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("spread", F.lit(1)) - 1))
    )
    return (
        salted.drop("spread").join(copies.drop("spread"), [key, "_salt"], how).drop("_salt")
    )


def with_columns_of(
    cells: DataFrame, side: DataFrame, n_cols: int, how: str = "inner", over: int | None = None
) -> DataFrame:
    """``cells`` joined with ``side`` (one row per column) on ``col_id``; it is sent to all executors if ``n_cols`` says that it may
    be small and a count of its rows says that it is."""
    spark, width = cells.sparkSession, len(side.columns) - 1
    if fits_broadcast(spark, n_cols, width) and fits_broadcast(spark, side.select("col_id").count(), width):
        return cells.join(F.broadcast(side), "col_id", how)
    return salted_join(cells, side, "col_id", "row_id", how, over)


def with_rows_of(
    cells: DataFrame, side: DataFrame, how: str = "inner", over: int | None = None
) -> DataFrame:
    """``cells`` joined with a per-row table."""
    return salted_join(cells, side, "row_id", "col_id", how, over)
