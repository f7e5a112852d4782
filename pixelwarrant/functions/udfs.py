"""Extension points: pluggable scorers and extractors as Arrow jobs, and a window-plan table function."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="scale int, x0 int, y0 int, x1 int, y1 int")
class PlanWindows:
    """SQL form of the window plan; the DataFrame form in `operators.windows` stays on the JVM."""

    def eval(self, w: int, h: int, scales: list, overlap: float, floor: int):
        short = min(w, h)
        for scale in dict.fromkeys(max(floor, min(int(s), short)) for s in scales):
            patch = min(scale, w, h)
            stride = max(1, round(patch * (1.0 - overlap)))
            axis = lambda n: [0] if patch >= n else sorted({*range(0, n - patch + 1, stride), n - patch})
            for y0 in axis(h):
                for x0 in axis(w):
                    yield scale, x0, y0, x0 + patch, y0 + patch


def register(spark: SparkSession) -> None:
    spark.udtf.register("plan_windows", PlanWindows)


def score_patches(
    patches: DataFrame, make_scorer: Callable[[], Callable[[pd.DataFrame], np.ndarray]], keep: list[str]
) -> DataFrame:
    """Score rows with a model built once per Python worker.

    `make_scorer()` returns a function from a batch of rows to P(AI) per row; a result of
    another length is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            scores = np.asarray(scorer(batch), dtype=np.float64)
            if len(scores) != len(batch):
                raise ValueError(f"scorer returned {len(scores)} scores for {len(batch)} patches")
            yield batch[keep].assign(score=scores)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in patches.select(*keep).schema)
    return patches.mapInPandas(run, f"{fields}, score double")


def extract_features(
    images: DataFrame, make_extractor: Callable[[], Callable[[pd.DataFrame], np.ndarray]], keep: list[str]
) -> DataFrame:
    """One feature vector per row, from an extractor built once per Python worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = make_extractor()
        for batch in batches:
            matrix = np.asarray(extractor(batch), dtype=np.float32)
            if len(matrix) != len(batch):
                raise ValueError(f"extractor returned {len(matrix)} rows for {len(batch)} images")
            yield batch[keep].assign(features=list(matrix))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in images.select(*keep).schema)
    return images.mapInPandas(run, f"{fields}, features array<float>")
