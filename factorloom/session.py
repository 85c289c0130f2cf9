"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BROADCAST_KEY = "spark.factorloom.broadcastBytes"
BROADCAST_DEFAULT = 256 * 1024 * 1024


def local_session(cpus: int = 8, app: str = "factorloom", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster pass your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    ``spark.checkpoint.dir`` names it. Where it is unset a local session gets a fresh temporary
    folder; a cluster session is refused, because a machine-local folder would be lost with
    its machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="factorloom-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Run ``df`` once and go on from its reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """Session settings (dots written as ``__``) for the plans made inside the block."""
    changed = {key.replace("__", "."): value for key, value in wanted.items()}
    before = {key: spark.conf.get(key, None) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder as Parquet and go on from the files, for what a job reads more than once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table below the shared folder that nothing will read again."""
    if not path.startswith(shared_dir(spark).rstrip("/") + "/"):
        raise ValueError(f"{path} is not in the shared folder")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_KEY, str(BROADCAST_DEFAULT)))


def fits_broadcast(spark: SparkSession, n_rows: int, width: int) -> bool:
    """Whether ``n_rows`` rows of ``width`` doubles and a key stay below the broadcast limit.

    A row of the hash table built from a broadcast takes about twice its raw size.
    """
    return 2 * 8 * n_rows * (width + 2) <= broadcast_limit(spark)
