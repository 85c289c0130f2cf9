"""Choosing cells to hide, and splitting a matrix into observed and missing cells."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest
from ..session import cut_lineage, fits_broadcast

# Digits of the digest that make a bin: 16^4 bins for each stratum, and as many inside of one where it is large.
_DIGITS = 4
# Bins on either side of the expected last one whose digests are kept aside while the cells are counted: they hold a 64th of the
# cells, and the last digest of 90,000 cells or more lies in them but for one case in 10^8.
_ASIDE = 512
# Digests of a bin that may be put in order at once.
_SORT_AT_ONCE = 100_000


def mask_cells(
    cells: DataFrame, percent: float | str, seed: int | str, strata: str | None = None
) -> DataFrame:
    """``(row_id, col_id)`` of ``floor(nnz·percent/100)`` stored cells, in each stratum if given; a fraction of a
    percent counts as it is written in decimals.

    The cells with the smallest digests are taken. Nothing is sorted as a whole. One reading counts cells by digest prefix, and the
    digests near the place where the quota must end, by the law of large numbers, are counted by themselves: they are kept aside
    in the same aggregate. The counts give the prefix in which the quota is reached, and what was kept aside the last digest. The
    choice itself is one filter, the second reading. Only a stratum too small for that law is read once more.
    """
    share = Fraction(str(percent)) / 100
    if not 0 <= share <= 1:
        raise ValueError("percent must be between 0 and 100")
    if share.denominator > 10**12:
        raise ValueError("percent has too many decimals")
    keyed = cells.filter(F.col("value") != 0).select(
        (F.col(strata) if strata else F.lit(0)).alias("_s"),
        "row_id",
        "col_id",
        digest(seed, "row_id", "col_id").alias("_h"),
    )
    bins = 16**_DIGITS
    first, last = (f"{min(max(int(share * bins) + d, 0), bins - 1):0{_DIGITS}x}" for d in (-_ASIDE, _ASIDE))
    near = _prefix("_h", 1).between(first, last)
    counts = cut_lineage(
        keyed.groupBy("_s", F.when(near, F.col("_h")).otherwise(_prefix("_h", 1)).alias("_k")).agg(F.count("*").alias("_n"))
    )
    # At most 16^4 rows per stratum from here on.
    by_bin = counts.groupBy("_s", _prefix("_k", 1).alias("_p")).agg(F.sum("_n").alias("_n"))
    totals = by_bin.groupBy("_s").agg(F.sum("_n").alias("_all"))
    exact = f"div(cast(_all AS DECIMAL(19, 0)) * {share.numerator}BD, {share.denominator}BD)"
    need = totals.select("_s", F.expr(f"cast({exact} AS BIGINT)").alias("_need")).filter(
        "_need > 0"
    )
    cut = _small(_boundary(by_bin.join(need, "_s")), strata)
    ends = _inside(counts.filter(F.length("_k") > _DIGITS).select("_s", F.col("_k").alias("_h"), "_n"), cut, 1)
    beside = cut.filter(~F.col("_p").between(first, last))
    if not beside.isEmpty():
        more = _inside(keyed, beside, 1).groupBy("_s", "_h").agg(F.count("*").alias("_n"))
        ends = ends.unionByName(cut_lineage(more))
    if (cut.agg(F.max("_n")).first()[0] or 0) > _SORT_AT_ONCE:
        finer = ends.groupBy("_s", _prefix("_h", 2).alias("_p")).agg(F.sum("_n").alias("_n"))
        cut = _small(_boundary(finer.join(cut.select("_s", "_need"), "_s")), strata)
        ends = _inside(ends, cut, 2)
    limits = _boundary(ends.withColumnRenamed("_h", "_p").join(cut.select("_s", "_need"), "_s")).select("_s", F.col("_p").alias("_limit"))
    if strata is None:
        last = limits.first()
        chosen = keyed.filter(F.col("_h") <= last["_limit"]) if last else keyed.limit(0)
    else:
        chosen = keyed.join(_small(limits, strata), "_s").filter("_h <= _limit")
    return chosen.select("row_id", "col_id")


def _prefix(digits: str, level: int):
    return F.substring(digits, 1, _DIGITS * level)


def _small(per_stratum: DataFrame, strata: str | None) -> DataFrame:
    """One row per stratum, computed now; sent to all executors where its count shows it is small."""
    fixed = cut_lineage(per_stratum)
    n_strata = 1 if strata is None else fixed.count()
    if fits_broadcast(fixed.sparkSession, n_strata, 16):
        return F.broadcast(fixed)
    return fixed


def _boundary(counts: DataFrame) -> DataFrame:
    """The prefix in which each stratum reaches its quota, and what is left of the quota there."""
    order = Window.partitionBy("_s").orderBy("_p")
    return (
        counts.withColumn("_upto", F.sum("_n").over(order))
        .filter("_upto - _n < _need AND _need <= _upto")
        .selectExpr("_s", "_p", "_n", "_need - (_upto - _n) AS _need")
    )


def _inside(keyed: DataFrame, cut: DataFrame, level: int) -> DataFrame:
    """The rows whose digest starts with the boundary prefix."""
    marked = keyed.withColumn("_p", _prefix("_h", level))
    return marked.join(cut.select("_s", "_p"), ["_s", "_p"], "left_semi").drop("_p")


def apply_mask(
    cells: DataFrame, mask: DataFrame, n_rows: int, n_cols: int
) -> tuple[DataFrame, DataFrame]:
    """``(observed, missing)``: stored values of masked coordinates are hidden.

    A masked coordinate inside the matrix is missing whether or not a cell was stored there; it
    starts with value 0.
    """
    known = mask.select("row_id", "col_id").distinct()
    observed = cells.join(known, ["row_id", "col_id"], "left_anti")
    return observed, masked_cells(known, n_rows, n_cols)


def masked_cells(known: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """The masked coordinates that lie inside the matrix, with value 0."""
    return known.filter(
        F.col("row_id").between(0, n_rows - 1) & F.col("col_id").between(0, n_cols - 1)
    ).select("row_id", F.col("col_id").cast("int").alias("col_id"), F.lit(0.0).alias("value"))


def count_missing(missing: DataFrame) -> DataFrame:
    return missing.agg(F.count("*").alias("n_missing"))
