"""Tabular sources and sinks: payload scans, feature tables, manifests, predictions, reports, logs."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelwarrant.session import shared_folder

LOG_SCHEMA = "run string, epoch int, val_auc double, val_pred_std double, val_accuracy double, train_loss double"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder the cluster names."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- parquet payloads ---------------------------------------------------------------------


def payload_column(df: DataFrame, column: str) -> Column:
    """The bytes of a payload column that is either raw or a struct with a `bytes` field."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StructType) and "bytes" in kind.fieldNames():
        return F.col(f"{column}.bytes")
    return F.col(column)


def read_payloads(spark: SparkSession, paths: str | Sequence[str], column: str) -> DataFrame:
    """Only the payload column reaches the scan; empty payloads are dropped."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else list(paths)))
    return df.select(payload_column(df, column).alias("payload")).where(F.col("payload").isNotNull())


def shard_slice(files: Sequence[str], offset: int) -> list[str]:
    """Sorted shard files from `offset` on."""
    ordered = sorted(files)
    if offset >= len(ordered):
        raise ValueError(f"shard offset {offset} exceeds {len(ordered)} shards")
    return ordered[offset:]


def shared_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files that both sides read; must be empty."""
    name = lambda df: df.select(F.input_file_name().alias("file")).distinct()
    return name(left).intersect(name(right))


# --- feature tables -----------------------------------------------------------------------


def write_features(features: DataFrame, path: str, blocks: Sequence[tuple[str, int]], signature: str) -> None:
    """Feature rows partitioned by family, with a side table of block layout and signature."""
    features.write.mode("errorifexists").partitionBy("family").parquet(f"{path}/rows")
    start, spec = 0, []
    for name, dim in blocks:
        spec.append((name, dim, start, start + dim, signature))
        start += dim
    features.sparkSession.createDataFrame(
        spec, "name string, dim int, start int, stop int, signature string"
    ).coalesce(1).write.mode("errorifexists").parquet(f"{path}/blocks")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{path}/rows")
    except Exception as exc:
        raise FileNotFoundError(f"{path} holds no feature rows; write them with write_features") from exc


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/blocks")


def require_same_signature(*blocks: DataFrame) -> None:
    """Refuse to mix feature tables built with different extractors."""
    seen = {tuple(sorted(map(tuple, b.collect()))) for b in blocks}  # a few layout rows per table
    if len(seen) > 1:
        raise ValueError(f"{len(seen)} different block layouts or signatures; feature tables are stacked only if those are alike")


# --- reports and predictions --------------------------------------------------------------


def predictions(df: DataFrame, path: Column, pred: Column, threshold: Column | None = None) -> DataFrame:
    """Rows of the predictions file."""
    out = [path.alias("image_path"), pred.alias("pred")]
    if threshold is not None:
        out.append((pred >= threshold).cast("int").alias("label"))
    return df.select(*out)


def write_json(df: DataFrame, path: str) -> None:
    """Reports say the same words for every image, so they are written packed; readers unpack them by their names."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def write_csv_matrix(df: DataFrame, path: str) -> None:
    """A small result matrix (one row per severity or block set) as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_once(rows: DataFrame, path: str, run: str, key: str = "stem") -> None:
    """Append the rows of one run to a manifest so that doing it again adds nothing.

    A run is a folder that Spark's committer fills whole or not at all; a repeated run takes the place of what it wrote before. Rows whose
    `key` another run has already are left out, and of rows with one key in the same run one stays, the least of all columns.
    """
    spark = rows.sparkSession
    first = rows.groupBy(key).agg(F.min(F.struct(*[F.col(c) for c in rows.columns])).alias("_row")).select("_row.*")
    try:
        known = read_manifest(spark, path).where(F.col("run") != run).select(key)
        first = first.join(known, key, "left_anti").select(*rows.columns)
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    first.write.mode("overwrite").parquet(f"{path}/run={run}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All runs of a manifest, with the run as a column."""
    df = spark.read.option("basePath", path).parquet(path)
    return df.withColumn("run", F.col("run").cast("string"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)
