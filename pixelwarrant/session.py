"""Session settings for local runs, and the durable lineage cut used on clusters."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 10_000
ROWS_PER_TASK = 200_000


def local_session(cpus: int = 8, app: str = "pixelwarrant") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.checkpoint.dir", f"{scratch}/checkpoint")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint.

    The folder is the one the cluster names in `spark.checkpoint.dir`.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, which all executors see. A machine's own folder would not do, so none is made up."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return named.rstrip("/")


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it is seen to hold at most `rows` rows; unhinted beyond that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, key: str, rows: int, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """`df` hash-partitioned by `key` into partitions that grow in number with `rows`, not in size.

    Adaptive planning merges partitions by the bytes that were shuffled, which says little where narrow rows are widened after that.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-rows // per_task)), key)
