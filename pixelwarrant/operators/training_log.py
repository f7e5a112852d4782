"""Reading an epoch log: best epoch so far, patience, collapse streaks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelwarrant.operators import ranks


def best_so_far(log: DataFrame, run: str, order: Sequence[str], metric: str) -> DataFrame:
    """Running best of a metric, and epochs since it last improved (a strict rise).

    Before the first metric that isn't null the best is null, and the first epoch counts as the best one.
    """
    staged = ranks.running(log, [run], order, {"epoch": ("sum", F.lit(1)), "best": ("max", F.col(metric))})
    firsts = staged.groupBy(run, "best").agg(F.min("epoch").alias("best_epoch"))
    return ranks.join_null_safe(staged, firsts, [run, "best"]).withColumn("stale", F.col("epoch") - F.col("best_epoch"))


def stop_epochs(log: DataFrame, run: str, order: Sequence[str], metric: str, patience: int) -> DataFrame:
    """First epoch at which a run has gone `patience` epochs without improving."""
    staged = best_so_far(log, run, order, metric)
    return staged.where(F.col("stale") >= patience).groupBy(run).agg(F.min("epoch").alias("stop_epoch"))


def collapse_streaks(log: DataFrame, run: str, order: Sequence[str], bad: Column) -> DataFrame:
    """Length of the current run of consecutive bad epochs at every epoch."""
    staged = ranks.positions(log.withColumn("_bad", bad), [run], order, "epoch")
    last_good = ranks.running(
        staged, [run], order, {"_good": ("max", F.when(~F.col("_bad"), F.col("epoch")).otherwise(F.lit(0)))}
    )
    return last_good.withColumn("streak", F.col("epoch") - F.col("_good")).drop("_good", "_bad")


def collapse_alarms(log: DataFrame, run: str, order: Sequence[str], bad: Column, patience: int, grace: int) -> DataFrame:
    """First epoch of each run where the streak reaches `patience` after the grace period."""
    streaks = collapse_streaks(log, run, order, bad)
    return (
        streaks.where((F.col("streak") >= patience) & (F.col("epoch") - 1 >= grace))
        .groupBy(run)
        .agg(F.min("epoch").alias("alarm_epoch"))
    )
