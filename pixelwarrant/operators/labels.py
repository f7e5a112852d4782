"""Which class of a classifier means "AI-generated": resolved by exact name, never guessed."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelwarrant.functions.scalar import normalise_label
from pixelwarrant.session import small

# Normalised class names of either side.
AI_TOKENS = (
    "ai", "aigenerated", "aiart", "aiimage", "artificial", "computergenerated", "deepfake", "diffusion", "fake", "gan",
    "generated", "machine", "midjourney", "sdxl", "stablediffusion", "synthetic", "spoof",
)
REAL_TOKENS = (
    "authentic", "camera", "genuine", "hum", "human", "humanmade", "live", "natural", "nonai", "notai", "photo",
    "photograph", "photographic", "pristine", "real", "realimage", "realphoto",
)


def token_table(spark: SparkSession) -> DataFrame:
    rows = [(t, "ai") for t in AI_TOKENS] + [(t, "real") for t in REAL_TOKENS]
    return spark.createDataFrame(rows, "token string, side string")


def label_side(label: Column) -> Column:
    """ai / real, or NULL for a name that is in neither list."""
    token = normalise_label(label)
    return F.when(token.isin(*AI_TOKENS), "ai").when(token.isin(*REAL_TOKENS), "real")


def resolve_positive(models: DataFrame, model: str, id2label: str, index: str | None = None, name: str | None = None) -> DataFrame:
    """Positive class indices per model, how they were found, and an error where they were not.

    An explicit index wins over an explicit name, which wins over the token lists; all are
    checked against the model's own classes.
    """
    classes = models.select(
        model,
        (F.col(index) if index else F.lit(None).cast("int")).alias("_index"),
        (normalise_label(F.col(name)) if name else F.lit(None).cast("string")).alias("_name"),
        F.explode(id2label).alias("id", "label"),
    ).withColumn("side", label_side(F.col("label")))
    ids = lambda cond: F.sort_array(F.collect_set(F.when(cond, F.col("id"))))
    grouped = classes.groupBy(model, "_index", "_name").agg(
        ids(F.col("id") == F.col("_index")).alias("by_index"),
        ids(normalise_label(F.col("label")) == F.col("_name")).alias("by_name"),
        ids(F.col("side") == "ai").alias("ai"),
        ids(F.col("side") == "real").alias("real"),
        ids(F.col("side").isNull()).alias("unknown"),
    )
    none = lambda c: F.size(c) == 0
    error = (
        F.when(F.col("_index").isNotNull(), F.when(none("by_index"), "index is not one of the outputs"))
        .when(F.col("_name").isNotNull(), F.when(none("by_name"), "name matches no label"))
        .when(~none("unknown"), "unrecognised label")
        .when(none("ai"), "no AI class")
        .when(none("real"), "no real class")
    )
    found = (
        F.when(F.col("_index").isNotNull(), F.col("by_index")).when(F.col("_name").isNotNull(), F.col("by_name")).otherwise(F.col("ai"))
    )
    how = F.when(F.col("_index").isNotNull(), "explicit index").when(F.col("_name").isNotNull(), "explicit name").otherwise("token lists")
    return grouped.select(model, error.alias("error"), F.when(error.isNull(), found).alias("positive"), F.when(error.isNull(), how).alias("resolved_by"))


def positive_probability(probs: DataFrame, resolved: DataFrame, model: str, keys: list[str]) -> DataFrame:
    """P(AI): the summed probability of a model's positive classes, from `(model, keys, id, p)` rows.

    There is one resolved row per model. A few are broadcast, so that the windows of a model don't meet in one task.
    """
    joined = probs.join(small(resolved.where(F.col("error").isNull()).select(model, "positive")), model)
    return joined.groupBy(model, *keys).agg(F.sum(F.when(F.array_contains("positive", F.col("id")), F.col("p")).otherwise(0.0)).alias("score"))
