"""Exact rank statistics that never sort one whole table in one task.

Rows are first reduced to one row per (keys, score), so ties, however heavy, collapse on
the map side. The rows are then cut into buckets by keys and order columns together, several
for every shuffle partition, so a window inside a bucket stays small, and only the bucket
totals (one row per bucket, and per key in it) are scanned in order. Keys and ordering
columns may be null: null is a key like any other, and comes first in order.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "_bucket"
MOST_BUCKETS = 8192
PER_BUCKET = 8  # rows of the sample that places the cuts


def score_counts(
    df: DataFrame, keys: Sequence[str], score: str | Column, label: str | Column, weight: Column | None = None
) -> DataFrame:
    """One row per (keys, score) with the number of positives and negatives."""
    score = F.col(score) if isinstance(score, str) else score
    label = F.col(label) if isinstance(label, str) else label
    one = F.lit(1.0) if weight is None else weight
    return (
        df.select(*keys, score.cast("double").alias("score"), label.alias("_y"), one.alias("_w"))
        .where(F.col("score").isNotNull() & F.col("_y").isNotNull())
        .groupBy(*keys, "score")
        .agg(
            F.sum(F.when(F.col("_y") == 1, F.col("_w")).otherwise(0.0)).alias("pos"),
            F.sum(F.when(F.col("_y") == 0, F.col("_w")).otherwise(0.0)).alias("neg"),
        )
    )


def bucket_count(df: DataFrame) -> int:
    """Four buckets per shuffle partition, so that they shrink as a cluster's parallelism is raised."""
    return min(MOST_BUCKETS, max(32, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def cut_points(df: DataFrame, columns: Sequence[str], buckets: int) -> Column:
    """`buckets - 1` rows of `columns` that cut the table into about equal ranges, as a scalar subquery.

    They are quantiles of the `PER_BUCKET * buckets` rows of least hash: a bounded sample that does not depend on partitioning.
    Which rows serve as cuts decides how even the buckets are, and no result.
    """
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    row = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])
    sample = df.select(row.alias("_row"), F.xxhash64(*hashed).alias("_h")).orderBy("_h", "_row").limit(PER_BUCKET * buckets)
    ordered = sample.agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    at = lambda i: F.get("_rows", F.floor(i * F.size("_rows") / buckets).cast("int"))
    return ordered.select(F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), at).alias("cuts")).scalar()


def with_bucket(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Add a bucket number that never falls as the row of `columns` rises (nulls first); any type that can be ordered will do.

    The bucket is the number of cuts not above the row, found by halving: a logarithmic number of comparisons a row. With
    every key and order column among `columns`, a key, value or common prefix that many rows share is cut like any other.
    """
    buckets = buckets or bucket_count(df)
    row = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((buckets - 1).bit_length()))])
    step = lambda at, n: F.when(F.get("_cuts", at + n - 1) <= F.col("_here"), at + n).otherwise(at)
    staged = df.withColumn("_cuts", cut_points(df, columns, buckets)).withColumn("_here", row)
    return staged.withColumn(_B, F.aggregate(steps, F.lit(0), step).cast("long")).drop("_cuts", "_here")


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, where null equals null; the right side's copies of the keys are dropped."""
    other = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on])
    return left.join(other, same).drop(*[f"_right_{c}" for c in on])


def _before(keys: Sequence[str], order: str):
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _whole(keys: Sequence[str]):
    return Window.partitionBy(*(keys or [F.lit(0)]))


def prefix_totals(counts: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """For each (keys, value) row add `<s>_below` (strictly smaller values) and `<s>_all`."""
    keys = list(keys)
    cut = with_bucket(counts, [*keys, value])
    inside = cut
    for s in sums:
        inside = inside.withColumn(
            f"{s}_below", F.coalesce(F.sum(s).over(_before([*keys, _B], value)), F.lit(0.0))
        )
    totals = cut.groupBy(*keys, _B).agg(*[F.sum(s).alias(s) for s in sums])
    offsets = totals.select(
        *keys,
        _B,
        *[F.coalesce(F.sum(s).over(_before(keys, _B)), F.lit(0.0)).alias(f"_{s}_offset") for s in sums],
        *[F.sum(s).over(_whole(keys)).alias(f"{s}_all") for s in sums],
    )
    joined = join_null_safe(inside, offsets, [*keys, _B])
    for s in sums:
        joined = joined.withColumn(f"{s}_below", F.col(f"{s}_below") + F.col(f"_{s}_offset"))
    return joined.drop(_B, *[f"_{s}_offset" for s in sums])


def rank_summary(
    counts: DataFrame, keys: Sequence[str], threshold: float | None = None, bounded: bool = False
) -> DataFrame:
    """Per key: class totals, confusion counts at `score >= threshold`, and the AUC numerator.

    With `bounded=True` every key is known to hold few rows (an image's own cells), so the
    key itself is the unit of work and no buckets are cut.
    """
    keys = list(keys)
    hit = F.lit(False) if threshold is None else F.col("score") >= F.lit(threshold)
    marked = counts.withColumn("tp", F.when(hit, F.col("pos")).otherwise(0.0)).withColumn(
        "fp", F.when(hit, F.col("neg")).otherwise(0.0)
    )
    group = keys if bounded else [*keys, _B]
    cut = marked if bounded else with_bucket(marked, [*keys, "score"])
    local = cut.withColumn("_nb", F.coalesce(F.sum("neg").over(_before(group, "score")), F.lit(0.0)))
    part = local.groupBy(*group).agg(
        F.sum(F.col("pos") * (F.col("_nb") + F.col("neg") / 2)).alias("wins"),
        *[F.sum(c).alias(c) for c in ("pos", "neg", "tp", "fp")],
    )
    if bounded:
        return part
    part = part.withColumn("_nb", F.coalesce(F.sum("neg").over(_before(keys, _B)), F.lit(0.0)))
    return part.groupBy(*keys).agg(
        F.sum(F.col("wins") + F.col("pos") * F.col("_nb")).alias("wins"),
        *[F.sum(c).alias(c) for c in ("pos", "neg", "tp", "fp")],
    )


def auc_column() -> Column:
    """AUC from `rank_summary`; NULL when a class is absent."""
    return F.try_divide(F.col("wins"), F.col("pos") * F.col("neg"))


def auc(
    df: DataFrame,
    keys: Sequence[str],
    score: str | Column,
    label: str | Column,
    bounded: bool = False,
) -> DataFrame:
    """Exact AUC per key, ties counted half."""
    counts = score_counts(df, keys, score, label)
    return rank_summary(counts, keys, bounded=bounded).select(*keys, auc_column().alias("auc"), "pos", "neg")


def average_ranks(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Average (tie-shared) rank of every distinct score."""
    counts = df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    ranked = prefix_totals(counts, keys, "score", ["n"])
    return ranked.select(*keys, "score", "n", (F.col("n_below") + (F.col("n") + 1) / 2).alias("avg_rank"))


def roc_points(df: DataFrame, keys: Sequence[str], score: str | Column, label: str | Column) -> DataFrame:
    """TP and FP at every distinct threshold (`score >= threshold`)."""
    counts = score_counts(df, keys, score, label)
    ranked = prefix_totals(counts, keys, "score", ["pos", "neg"])
    return ranked.select(
        *keys,
        F.col("score").alias("threshold"),
        (F.col("pos_all") - F.col("pos_below")).alias("tp"),
        (F.col("neg_all") - F.col("neg_below")).alias("fp"),
        F.col("pos_all").alias("pos"),
        F.col("neg_all").alias("neg"),
    ).withColumns({"tpr": F.try_divide("tp", "pos"), "fpr": F.try_divide("fp", "neg")})


def threshold_at_fpr(
    df: DataFrame, keys: Sequence[str], score: str | Column, label: str | Column, budget: float = 0.05
) -> DataFrame:
    """Threshold with the highest TPR among those whose FPR is within `budget`.

    NULL means that only the threshold above every score keeps the budget.
    """
    points = roc_points(df, keys, score, label)
    inside = (F.col("fpr") <= F.lit(budget)) & (F.col("tp") > 0)
    best = F.max(F.when(inside, F.struct("tp", "threshold", "tpr", "fpr")))
    picked = points.groupBy(*keys).agg(best.alias("_best")) if keys else points.agg(best.alias("_best"))
    return picked.select(
        *keys,
        F.col("_best.threshold").alias("threshold"),
        F.coalesce("_best.tpr", F.lit(0.0)).alias("tpr"),
        F.coalesce("_best.fpr", F.lit(0.0)).alias("fpr"),
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str | Column, probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles per key: one row per (keys, q)."""
    value = F.col(value) if isinstance(value, str) else value
    counts = (
        df.select(*keys, value.cast("double").alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    ranked = prefix_totals(counts, keys, "value", ["n"])
    spread = ranked.select(
        "*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("q")
    ).withColumn("_at", (F.col("n_all") - 1) * F.col("q"))
    holds = lambda r: (F.col("n_below") <= r) & (r < F.col("n_below") + F.col("n"))
    low, high = F.floor("_at"), F.ceil("_at")
    return (
        spread.where(holds(low) | holds(high))
        .groupBy(*keys, "q")
        .agg(
            F.max(F.when(holds(low), F.col("value"))).alias("_lo"),
            F.max(F.when(holds(high), F.col("value"))).alias("_hi"),
            F.max(F.col("_at") - low).alias("_f"),
        )
        .select(*keys, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("value"))
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First `k` rows of every key.

    A ranked window with a `<= k` filter: Spark keeps only `k` rows per key and map task
    before the shuffle (window group limit), so a key that holds a third of the table still
    sends few rows.
    """
    spec = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    return df.withColumn(name, F.row_number().over(spec)).where(F.col(name) <= k)


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, tuple[str, Column]], buckets: int | None = None
) -> DataFrame:
    """Running totals (inclusive) in the order of `order`, for keys that may hold most of the table.

    `totals` maps a new column to ("sum" | "max", expression). The ordering columns may be of
    any type and null (nulls first), and so may the keys. Each key is cut into order buckets;
    only bucket totals are chained.
    """
    keys = list(keys)
    agg = {"sum": F.sum, "max": F.max}
    staged = with_bucket(df, [*keys, *order], buckets).withColumns({f"_x_{n}": e for n, (_, e) in totals.items()})
    upto = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = staged.withColumns({n: agg[how](f"_x_{n}").over(upto) for n, (how, _) in totals.items()})
    sizes = staged.groupBy(*keys, _B).agg(*[agg[how](f"_x_{n}").alias(f"_x_{n}") for n, (how, _) in totals.items()])
    offsets = sizes.select(
        *keys, _B, *[agg[how](f"_x_{n}").over(_before(keys, _B)).alias(f"_o_{n}") for n, (how, _) in totals.items()]
    )
    joined = join_null_safe(inside, offsets, [*keys, _B])
    for n, (how, _) in totals.items():
        if how == "sum":
            joined = joined.withColumn(n, F.col(n) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)))
        else:
            joined = joined.withColumn(n, F.greatest(F.col(n), F.col(f"_o_{n}")))
    return joined.drop(_B, *[f"_x_{n}" for n in totals], *[f"_o_{n}" for n in totals])


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """1-based position of every row within its key, in the (unique) order given."""
    return running(df, keys, order, {name: ("sum", F.lit(1))})


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, name: str = "position") -> DataFrame:
    """First `n` rows per key, for any `n`."""
    return positions(df, keys, order, name).where(F.col(name) <= n)
