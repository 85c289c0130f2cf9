"""Results kept as Parquet: projections, factors per round, masks, seeds and run records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_SCHEMA = T.StructType(
    [
        T.StructField("app", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_cols", T.LongType()),
        T.StructField("n_components", T.IntegerType()),
        T.StructField("n_rounds", T.IntegerType()),
        T.StructField("prepare_sec", T.DoubleType()),
        T.StructField("sketch_sec", T.DoubleType()),
        T.StructField("round_sec", T.ArrayType(T.DoubleType())),
        T.StructField("avg_round_sec", T.DoubleType()),
        T.StructField("total_sec", T.DoubleType()),
        T.StructField("errors", T.ArrayType(T.DoubleType())),
    ]
)


@dataclass
class RunStats:
    """What one run did: sizes, seconds and the error of each round."""

    app: str
    dataset: str = ""
    n_rows: int = 0
    n_cols: int = 0
    n_components: int = 0
    prepare_sec: float = 0.0
    sketch_sec: float = 0.0
    round_sec: list[float] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)

    @property
    def n_rounds(self) -> int:
        return len(self.round_sec)

    def row(self) -> tuple:
        spent = sum(self.round_sec)
        average = spent / len(self.round_sec) if self.round_sec else None
        return (
            self.app,
            self.dataset,
            datetime.now(timezone.utc),
            int(self.n_rows),
            int(self.n_cols),
            int(self.n_components),
            self.n_rounds,
            self.prepare_sec,
            self.sketch_sec,
            [float(s) for s in self.round_sec],
            average,
            self.prepare_sec + self.sketch_sec + spent,
            [float(e) for e in self.errors],
        )


def runs_frame(spark: SparkSession, runs: Sequence[RunStats]) -> DataFrame:
    return spark.createDataFrame([r.row() for r in runs], RUN_SCHEMA)


def append_runs(spark: SparkSession, runs: Sequence[RunStats], path: str) -> None:
    runs_frame(spark, runs).coalesce(1).write.mode("append").parquet(path)


def write_projection(scores: DataFrame, path: str, text: bool = False) -> None:
    """Scores by ``row_id`` as Parquet, or as ``row_id,x_0,…`` text."""
    if text:
        scores.select(F.concat_ws(",", *scores.columns).alias("line")).write.text(path)
    else:
        scores.write.parquet(path)


def write_factor_round(factor: DataFrame, path: str, round_no: int) -> None:
    """One ``round=…`` partition; a repeated round replaces its own files only."""
    factor.write.mode("overwrite").parquet(f"{path.rstrip('/')}/round={round_no}")


def write_mask(mask: DataFrame, path: str) -> None:
    mask.select("row_id", "col_id").write.parquet(path)


def write_seed(factor: DataFrame, path: str) -> None:
    factor.write.parquet(path)
