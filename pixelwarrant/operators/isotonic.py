"""Weighted isotonic fits of many keys at once, by pool-adjacent-violators on mergeable blocks.

A block is a level of the staircase: its ends in x, its sum and its weight. Pooling may start anywhere and go on in any order, so
each bucket of neighbouring x values is pooled apart, and then neighbouring buckets are merged, `FAN` at a time, up a tree. A merge
moves only what can still change: a block that lies above all that comes before and below all that comes after is settled, and
parts the rest into zones that have nothing to do with each other. Zones are pooled side by side; settled blocks stay where
they are. No row, driver pass or task holds a whole staircase unless it can't be parted.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelwarrant.operators import ranks
from pixelwarrant.session import durable

FAN = 16
BLOCK = ["lo", "hi", "s", "w"]


def pool(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Index of the first point of each level, for sums `s` and weights `w` of points in order; equal neighbours share a level."""
    first = np.arange(len(s))
    while len(s) > 1:
        rises = np.concatenate([[True], s[1:] / w[1:] > s[:-1] / w[:-1]])
        if rises.all():
            break
        if rises.sum() > 0.9 * len(s):
            return first[_one_by_one(s.tolist(), w.tolist())]
        at = np.flatnonzero(rises)
        s, w, first = np.add.reduceat(s, at), np.add.reduceat(w, at), first[at]
    return first


def _one_by_one(s: list[float], w: list[float]) -> list[int]:
    """`pool` with a stack, for the rest that whole runs of violators no longer shorten much."""
    levels: list[tuple[float, float, int]] = []
    for i, (a, b) in enumerate(zip(s, w)):
        first = i
        while levels and levels[-1][0] / levels[-1][1] >= a / b:
            x, y, first = levels.pop()
            a, b = a + x, b + y
        levels.append((a, b, first))
    return [first for _, _, first in levels]


def _pooled(blocks: DataFrame, by: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """The blocks of each group of `by`, pooled."""
    schema = T.StructType([blocks.schema[c] for c in [*kept, *BLOCK]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("lo")
        s, w = table["s"].to_numpy(), table["w"].to_numpy()
        at = pool(s, w)
        last = np.append(at[1:], len(s)) - 1
        out = {c: table[c].take(pa.array(at)) for c in [*kept, "lo"]}
        out |= {"hi": table["hi"].take(pa.array(last)), "s": pa.array(np.add.reduceat(s, at)), "w": pa.array(np.add.reduceat(w, at))}
        return pa.table(out)

    return blocks.select(*dict.fromkeys([*by, *kept, *BLOCK])).groupBy(*by).applyInArrow(run, schema)


def _merged(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """One step up the tree: `FAN` neighbouring buckets become one."""
    blocks = blocks.withColumn("v", F.col("s") / F.col("w"))
    ends = blocks.groupBy(*keys, "seg").agg(F.min("v").alias("low"), F.max("v").alias("high")).withColumn("up", F.floor(F.col("seg") / FAN))
    order = Window.partitionBy(*keys, "up").orderBy("seg")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.withColumns({"below": F.max("high").over(before), "above": F.min("low").over(after)})
    ends = ends.withColumn("parts", F.coalesce(F.col("below") < F.col("above"), F.lit(True)))
    ends = ends.withColumn("zone", F.coalesce(F.sum(F.col("parts").cast("long")).over(before), F.lit(0)))
    known = ranks.join_null_safe(blocks, ends.select(*keys, "seg", "up", "below", "above", "parts", "zone"), [*keys, "seg"])
    under, over = F.coalesce(F.col("v") <= F.col("below"), F.lit(False)), F.coalesce(F.col("v") >= F.col("above"), F.lit(False))
    known = known.withColumns({"seg": F.col("up"), "loose": under | over, "zone": F.col("zone") + (F.col("parts") & over).cast("long")})
    settled = known.where(~F.col("loose")).select(*keys, "seg", *BLOCK)
    return settled.unionByName(_pooled(known.where("loose"), [*keys, "seg", "zone"], [*keys, "seg"]))


def levels(points: DataFrame, keys: Sequence[str], x: str, s: str, w: str, buckets: int | None = None) -> DataFrame:
    """The staircase of each key: `lo`, `hi` (ends in x), `y` (level) and `w` (weight), a row for each level.

    `points` has one row per (keys, x) with the sum `s` and the weight `w > 0` of what lies there. Keys may be null.
    """
    keys = list(keys)
    buckets = buckets or ranks.bucket_count(points)
    cut = ranks.with_bucket(points.select(*keys, x, F.col(s).alias("s"), F.col(w).alias("w")), [*keys, x], buckets)
    start = cut.select(*keys, F.col("_bucket").alias("seg"), F.col(x).alias("lo"), F.col(x).alias("hi"), F.col("s").cast("double").alias("s"), F.col("w").cast("double").alias("w"))
    blocks = durable(_pooled(start, [*keys, "seg"], [*keys, "seg"]))
    while buckets > 1:
        blocks = durable(_merged(blocks, keys))
        buckets = -(-buckets // FAN)
    return blocks.select(*keys, "lo", "hi", (F.col("s") / F.col("w")).alias("y"), "w")
