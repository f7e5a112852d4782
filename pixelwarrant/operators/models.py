"""Classifiers on feature arrays with Spark ML, folds, ablation, bundles."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelwarrant.operators import boosting, dataset, features, metrics, ranks


def prepare(rows: DataFrame, scaler: DataFrame | None, blocks: features.Blocks | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Block selection, scaling, vector column `x`."""
    if blocks is not None:
        rows = rows.withColumn("features", features.select_blocks(F.col("features"), blocks, names)[0])
    if scaler is not None:
        rows = features.apply_scaler(rows, scaler)
    return rows.withColumn("x", array_to_vector(F.transform("features", lambda v: v.cast("double"))))


def fit_boosted_trees(train: DataFrame, rounds: int = 20, depth: int = 6, seed: int = 42, validation: str | None = None) -> PipelineModel:
    """Boosted trees: depth 6, step 0.05, subsample 0.8, class-balanced; early stop on `validation` rows."""
    tree = GBTClassifier(
        featuresCol="x", labelCol="y", weightCol="weight", maxDepth=depth, maxIter=rounds, stepSize=0.05, subsamplingRate=0.8, seed=seed
    )
    if validation:
        tree = tree.setValidationIndicatorCol(validation)
    return Pipeline(stages=[tree]).fit(features.class_weight(train))


def fit_mlp(
    train: DataFrame, width: int, hidden: Sequence[int] = (512, 128), iterations: int = 60, seed: int = 42, validation: DataFrame | None = None, stage: int = 20, patience: int = 3
) -> PipelineModel:
    """Multilayer perceptron; classes are balanced by repeating rows of the rarer one, as this learner takes no weights.

    With `validation` rows it is trained in stages of `stage` iterations, each going on from the weights before. The stage of the
    best validation AUC is kept, and training ends after `patience` stages without a better one.
    """
    counts = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    rare, times = (1, n0 / max(n1, 1)) if n1 < n0 else (0, n1 / max(n0, 1))
    draw = F.pmod(F.xxhash64("sample_id", F.lit(seed)), F.lit(1000)) / 1000.0
    copies = F.when(F.col("y") == rare, F.floor(F.lit(times) + draw)).otherwise(1).cast("int")
    balanced = train.withColumn("_k", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), copies)))).drop("_k")
    net = MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[width, *hidden, 2], maxIter=iterations, seed=seed)
    if validation is None:
        return Pipeline(stages=[net]).fit(balanced)
    balanced, validation = balanced.cache(), validation.cache()
    best, since, done = None, 0, 0
    try:
        while done < iterations and since < patience:
            model = Pipeline(stages=[net.copy({net.maxIter: min(stage, iterations - done)})]).fit(balanced)
            done += stage
            auc = ranks.auc(score(model, validation), [], "pred", "y").first()["auc"] or 0.0
            best, since = ((auc, model), 0) if best is None or auc > best[0] else (best, since + 1)
            net = net.copy({net.initialWeights: model.stages[-1].weights})
    finally:
        balanced.unpersist()
        validation.unpersist()
    return best[1]


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """P(AI) as `pred`, by any fitted classifier."""
    return model.transform(rows).withColumn("pred", vector_to_array("probability")[1])


def evaluate(scored: DataFrame, keys: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    return metrics.metric_matrix(scored, list(keys), "pred", "y", threshold)


def leave_one_family_out(rows: DataFrame, families: Sequence, settings: boosting.Settings, is_val: Column, subset: str = "clean") -> DataFrame:
    """One model for each held family, all grown together; each is judged on the family that it never saw.

    `is_val` marks the rows that choose a model's number of rounds, among the families it may see.
    """
    names = {str(f): f for f in families}
    seen = {n: F.col("family") != F.lit(f) for n, f in names.items()}
    fitted = boosting.fit(rows, {n: boosting.Model(s & ~is_val, s & is_val) for n, s in seen.items()}, settings)
    held = dataset.clean_rows(rows, subset).select("sample_id", "family", "y", "features")
    scored = boosting.score(fitted, held).where(F.col("model") == F.col("family").cast("string"))
    return evaluate(scored, ["family"]).withColumnRenamed("family", "held_family")


def block_ablation(rows: DataFrame, blocks: features.Blocks, combos: Sequence[Sequence[str]], settings: boosting.Settings, is_val: Column) -> DataFrame:
    """One model per block subset, all grown together, ranked by validation AUC."""
    columns = {n: range(a, b) for n, _, a, b in features.layout(blocks)}
    models = {"+".join(names): boosting.Model(~is_val, is_val, [c for n in names for c in columns[n]]) for names in combos}
    fitted = boosting.fit(rows, models, settings)
    scored = boosting.score(fitted, rows.where(is_val).select("sample_id", "y", "features"))
    width = F.create_map(*[F.lit(e) for n, m in models.items() for e in (n, len(m.columns))])
    return evaluate(scored, ["model"]).withColumn("n_features", width[F.col("model")]).withColumnRenamed("model", "blocks").orderBy(F.col("auc").desc(), "blocks")


def learnability(train: DataFrame, val: DataFrame) -> DataFrame:
    """Can a plain linear model separate the classes at all? Verdict by accuracy."""
    model = Pipeline(stages=[LogisticRegression(featuresCol="x", labelCol="y", maxIter=30)]).fit(train)
    scored = score(model, val)
    accuracy = F.col("accuracy")
    verdict = F.when(accuracy > 0.85, "learnable").when(accuracy > 0.65, "some signal").otherwise("broken data or labels")
    return evaluate(scored).withColumn("verdict", verdict)


def save_bundle(model: PipelineModel, scaler: DataFrame, meta: dict[str, str], path: str) -> None:
    """Model, scaler and settings in one folder."""
    spark = scaler.sparkSession
    model.write().overwrite().save(f"{path}/model")
    scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    spark.createDataFrame(list(meta.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame, dict[str, str]]:
    meta = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/meta").collect()}
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/scaler"), meta
