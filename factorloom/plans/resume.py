"""The state of a fit after each of its rounds, so that a fit that was stopped goes on where it ended.

Below one path: ``state/round=…`` with the column table, ``missing/round=…`` with the values of missing cells, and ``small`` with one
row per round (k×k numbers, variance, history). The row is written last: a round without it is not complete and is done again.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

SMALL = (
    "round int, width int, weights array<double>, gram array<double>, shift array<double>, variance double, norm2 double, "
    "delta double, round_variance double"
)


class SavedRound(NamedTuple):
    round_no: int
    state: DataFrame  # (col_id, m, f_*)
    missing: DataFrame | None  # (row_id, col_id, value)
    width: int
    weights: np.ndarray
    gram: np.ndarray
    shift: np.ndarray
    variance: float
    norm2: float
    history: list[tuple[int, str, float]]


def _at(path: str, what: str, round_no: int) -> str:
    return f"{path.rstrip('/')}/{what}/round={round_no}"


def save_round(path: str, round_no: int, state: DataFrame, missing: DataFrame | None, small, history: list[tuple[int, str, float]]) -> None:
    """Write what a round ends with; the row that makes it complete comes last."""
    state.write.mode("overwrite").parquet(_at(path, "state", round_no))
    if missing is not None:
        missing.write.mode("overwrite").parquet(_at(path, "missing", round_no))
    own = {metric: value for r, metric, value in history if r == round_no}
    flat = [[float(x) for x in np.ravel(a)] for a in (small.weights, small.gram, small.shift)]
    row = (round_no, int(small.gram.shape[0]), *flat, float(small.variance), float(small.norm2), float(own["delta"]), float(own["variance"]))
    frame = state.sparkSession.createDataFrame([row], SMALL)
    frame.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/small")


def last_round(spark: SparkSession, path: str) -> SavedRound | None:
    """The last complete round below ``path``; None where there is none."""
    try:
        rows = spark.read.schema(SMALL).parquet(f"{path.rstrip('/')}/small").orderBy("round").collect()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    if not rows:
        return None
    end = rows[-1]
    width = end["width"]
    try:
        missing = spark.read.parquet(_at(path, "missing", end["round"])).select("row_id", "col_id", "value")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        missing = None
    history = [x for r in rows for x in ((r["round"], "variance", r["round_variance"]), (r["round"], "delta", r["delta"]))]
    return SavedRound(
        end["round"],
        spark.read.parquet(_at(path, "state", end["round"])),
        missing,
        width,
        np.reshape(end["weights"], (width, width)),
        np.reshape(end["gram"], (width, width)),
        np.array(end["shift"]),
        end["variance"],
        end["norm2"],
        history,
    )
