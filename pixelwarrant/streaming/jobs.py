"""Streams: scoring images as they arrive, running evaluation numbers, collapse alarms."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pixelwarrant.sources.images import is_image
from pixelwarrant.sources.tables import LOG_SCHEMA

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def score_arriving(rows: DataFrame, scorer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Score every arriving row once into an append sink; stops when nothing is left."""
    return (
        scorer(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def score_arriving_images(spark: SparkSession, folder: str, scorer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Score every image file that appears below `folder`, each once."""
    files = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true").load(folder)
    return score_arriving(files.where(is_image(F.col("path"))).select("path", "content"), scorer, out, checkpoint)


NUMBERS = ("real", "ai", "tampered", "flagged", "n", "wins_ai", "wins_tampered")
SEGMENT_SCHEMA = "segment int, " + ", ".join(f"{c} double" for c in NUMBERS)
SEGMENT_STATE = "scores binary, counts binary, flagged double"


def _segment(score: Column, segments: int) -> Column:
    """A number that never falls as the score rises; all scores outside 0 to 1 are in the first and the last segment."""
    return F.greatest(F.lit(0), F.least(F.lit(segments - 1), F.floor(score * segments))).cast("int")


def segment_numbers(scores: DataFrame, segments: int) -> DataFrame:
    """For each segment of scores that a micro-batch touches: its counts, and its AUC wins among itself, exactly.

    The state of a segment is its distinct scores in order with the rows of each class at each of them, so that arriving rows are
    placed by binary search and ties stay ties. Rows without a score or class count for nothing.
    """

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, counts, flagged = state.get if state.exists else (b"", b"", 0.0)
        held, counts = np.frombuffer(held, np.float64), np.frombuffer(counts, np.float64).reshape(-1, 3)
        for frame in frames:
            own, place = np.unique(frame["score"].to_numpy(np.float64), return_inverse=True)
            fresh = own[~np.isin(own, held, assume_unique=True)]
            at = np.searchsorted(held, fresh)
            held, counts = np.insert(held, at, fresh), np.insert(counts, at, 0.0, axis=0)
            counts = counts.copy()
            np.add.at(counts, np.searchsorted(held, own)[place], frame[["real", "ai", "tampered"]].to_numpy(np.float64))
            flagged += float(frame["flagged"].sum())
        state.update((held.tobytes(), np.ascontiguousarray(counts).tobytes(), flagged))
        real = counts[:, 0]
        under = np.cumsum(real) - real / 2
        totals = counts.sum(0)
        rest = [flagged, totals[0] + totals[1], float(counts[:, 1] @ under), float(counts[:, 2] @ under)]
        yield pd.DataFrame([[key[0], *totals, *rest]], columns=["segment", *NUMBERS])

    known = scores.where(F.col("score").isNotNull() & F.col("class").isNotNull())
    one = lambda c: c.cast("double")
    kind = F.col("class")
    rows = known.select(
        _segment(F.col("score"), segments).alias("segment"),
        F.col("score").cast("double").alias("score"),
        one(kind == "real").alias("real"),
        one(kind != "real").alias("ai"),
        one(kind == "tampered").alias("tampered"),
        one((kind == "real") & F.coalesce(F.col("n_regions") > 0, F.lit(False))).alias("flagged"),
    )
    return rows.groupBy("segment").applyInPandasWithState(watch, SEGMENT_SCHEMA, SEGMENT_STATE, "update", GroupStateTimeout.NoTimeout)


def numbers_of(segments: DataFrame) -> DataFrame:
    """AUC over all AI classes, AUC over tampered, false-positive share and n, from one row per segment (at most `segments` rows)."""
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    below = segments.withColumn("below", F.coalesce(F.sum("real").over(before), F.lit(0.0)))
    auc = lambda c: F.try_divide(F.sum(F.col(f"wins_{c}") + F.col(c) * F.col("below")), F.sum(c) * F.sum("real"))
    return below.agg(
        auc("ai").alias("auc"),
        auc("tampered").alias("auc_tampered"),
        F.try_divide(F.sum("flagged"), F.sum("real")).alias("fp_rate"),
        F.sum("n").cast("long").alias("n"),
    )


def _kept_up(changes: DataFrame, keys: list[str], folder: str, batch: int) -> DataFrame:
    """The newest row of every key so far: those of the batch before, overlaid with `changes`. A repeated batch writes the same again."""
    spark = changes.sparkSession
    now = changes
    if batch:
        old = spark.read.schema(changes.schema).parquet(f"{folder}/batch={batch - 1}")
        now = changes.unionByName(old.join(changes.select(*keys), keys, "left_anti"))
    now.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    return spark.read.schema(changes.schema).parquet(f"{folder}/batch={batch}")


def running_evaluation(scores: DataFrame, show: Callable[[DataFrame, int], None], checkpoint: str, segments: int = 1024):
    """Hand the exact evaluation numbers of all rows so far to `show` after every micro-batch.

    Only segments that a batch touches are worked on; the numbers then come from one row per segment.
    """

    def hand_on(changes: DataFrame, batch: int) -> None:
        show(numbers_of(_kept_up(changes, ["segment"], f"{checkpoint}-segments", batch)), batch)

    return (
        segment_numbers(scores, segments)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(hand_on)
        .trigger(availableNow=True)
        .start()
    )


def read_log_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA).json(folder)


ALARM_SCHEMA = "run string, alarm_epoch long, streak int"
BLOCK_SCHEMA = "run string, block long, n long, whole boolean, lead array<long>, tail long, inner_epoch long"
BLOCK_STATE = "names array<string>, own binary, epochs binary, bad binary"


def collapse_blocks(log: DataFrame, patience: int, grace: int, std_below: float, auc_below: float, block: int, shards: int = 64) -> DataFrame:
    """Summaries of blocks of epochs of a run, for the blocks that a micro-batch touches; epochs may come in any order.

    A summary has what a merge with its neighbours needs: the number of epochs, whether all are bad, the bad ones it begins with
    (`lead`), how many it ends with (`tail`), and the first epoch that is an alarm by this block alone. The runs of a shard share
    the state of a block, so that runs with few epochs in it don't each cost a call: their epochs in order, run by run, `block`
    epoch numbers of a run at most. An epoch that comes again replaces what was known of it.
    """

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, own, epochs, bad = state.get if state.exists else ([], b"", b"", b"")
        names, own = list(names), np.frombuffer(own, np.int64)
        epochs, bad = np.frombuffer(epochs, np.int64), np.frombuffer(bad, np.bool_)
        fresh = pd.concat(frames)
        number = {n: i for i, n in enumerate(names)}
        for name in pd.unique(fresh["run"]):
            number.setdefault(name, len(number))
        runs = fresh["run"].map(number).to_numpy(np.int64)
        touched = np.unique(runs)
        # What is known first, so that of equal epochs the last one is the newest.
        own, epochs = np.concatenate([own, runs]), np.concatenate([epochs, fresh["epoch"].to_numpy(np.int64)])
        bad = np.concatenate([bad, fresh["bad"].to_numpy(np.bool_)])
        order = np.lexsort((epochs, own))
        own, epochs, bad = own[order], epochs[order], bad[order]
        last = np.append((own[1:] != own[:-1]) | (epochs[1:] != epochs[:-1]), True)
        own, epochs, bad = own[last], epochs[last], bad[last]
        names = list(number)
        state.update((names, own.tobytes(), epochs.tobytes(), bad.tobytes()))
        rows = []
        for run, start, stop in zip(touched, np.searchsorted(own, touched), np.searchsorted(own, touched, "right")):
            rows.append((names[run], key[1], *summary(epochs[start:stop], bad[start:stop])))
        yield pd.DataFrame(rows, columns=["run", "block", "n", "whole", "lead", "tail", "inner_epoch"]).astype({"inner_epoch": "Int64"})

    def summary(epochs: np.ndarray, bad: np.ndarray) -> tuple:
        place = np.arange(len(bad))
        good = np.maximum.accumulate(np.where(bad, -1, place))  # the last good epoch so far
        alone = (good >= 0) & (place - good >= patience) & (epochs >= grace)
        first_good = int(np.argmin(bad)) if not bad.all() else len(bad)
        inner = int(epochs[np.argmax(alone)]) if alone.any() else None
        return len(bad), bool(bad.all()), epochs[:first_good].tolist(), len(bad) - 1 - int(good[-1]), inner

    bad = (F.col("val_pred_std") < std_below) & (F.col("val_auc") < auc_below)
    rows = log.where("run is not null and epoch is not null").select(
        F.pmod(F.crc32("run"), F.lit(shards)).alias("shard"), F.floor(F.col("epoch") / block).alias("block"), "run", "epoch", F.coalesce(bad, F.lit(False)).alias("bad")
    )
    return rows.groupBy("shard", "block").applyInPandasWithState(watch, BLOCK_SCHEMA, BLOCK_STATE, "update", GroupStateTimeout.NoTimeout)


def alarms_of(blocks: DataFrame, patience: int, grace: int) -> DataFrame:
    """The first alarm of each run, from the summaries of its blocks."""
    order = Window.partitionBy("run").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # Bad epochs in a row just before a block: the tail of the last block with a good epoch, and all blocks since.
    span = blocks.withColumn("span", F.coalesce(F.sum(F.when(F.col("whole"), 0).otherwise(1)).over(before), F.lit(0)))
    since = Window.partitionBy("run", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last_tail = F.last(F.when(~F.col("whole"), F.col("tail")), True).over(before)
    carried = span.withColumn("carry", F.coalesce(F.sum(F.when(F.col("whole"), F.col("n"))).over(since), F.lit(0)) + F.coalesce(last_tail, F.lit(0)))
    led = F.filter("lead", lambda epoch, i: (F.col("carry") + i + 1 >= patience) & (epoch >= grace))
    found = carried.withColumn("at", F.least(F.array_min(led), "inner_epoch")).where("at is not null")
    return found.groupBy("run").agg(F.min("at").alias("alarm_epoch"))


def collapse_alarms(
    log: DataFrame, show: Callable[[DataFrame, int], None], checkpoint: str, patience: int = 2, grace: int = 2, std_below: float = 0.02, auc_below: float = 0.55, block: int = 4096, shards: int = 64
):
    """After every micro-batch hand `show` the alarms so far: the first epoch of each run that ends `patience` collapsed epochs in a row, after the grace period.

    Epochs may be late or shuffled; the alarms are always those of all epochs so far in their order. A late good epoch can
    so take an alarm back, and a late bad one can make it earlier.
    """

    def hand_on(changes: DataFrame, batch: int) -> None:
        blocks = _kept_up(changes, ["run", "block"], f"{checkpoint}-blocks", batch)
        show(alarms_of(blocks, patience, grace).withColumn("streak", F.lit(patience)), batch)

    return (
        collapse_blocks(log, patience, grace, std_below, auc_below, block, shards)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(hand_on)
        .trigger(availableNow=True)
        .start()
    )
