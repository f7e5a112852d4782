"""Assembling labelled image sets: gates, crops, splits, caps, stacking, leakage guards."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelwarrant.operators import ranks

# The columns of a provenance manifest.
MANIFEST_COLUMNS = (
    "dest",
    "label",
    "source_repo",
    "source_file",
    "row_index",
    "orig_width",
    "orig_height",
    "orig_format",
    "crop_size",
    "stored_format",
    "jpeg_quality",
)


def draw_key(*parts: str | Column, seed: int = 0) -> Column:
    """A reproducible random order key for a row."""
    return F.xxhash64(*[F.col(p) if isinstance(p, str) else p for p in parts], F.lit(seed))


# --- class counts and gates ---------------------------------------------------------------


def class_counts(samples: DataFrame, dataset: str = "dataset", label: str = "label") -> DataFrame:
    """Real and fake counts per dataset plus a TOTAL row with the fake share."""
    fake = F.sum(F.col(label)).cast("long")
    n = F.count(F.lit(1))
    return samples.rollup(dataset).agg(
        F.when(F.grouping(dataset) == 1, "TOTAL").otherwise(F.first(dataset)).alias("name"),
        (n - fake).alias("real"),
        fake.alias("fake"),
        n.alias("n"),
        (fake / n).alias("fake_fraction"),
    ).drop(dataset)


def root_problems(roots: DataFrame, samples: DataFrame, known: DataFrame, dataset: str = "dataset", label: str = "label") -> DataFrame:
    """What is wrong with each requested root; NULL when it can be trained on.

    `known` lists the roots that exist, `samples` holds their labelled rows.
    """
    counts = samples.groupBy(dataset).agg(
        F.count_if(F.col(label) == 0).alias("real"), F.count_if(F.col(label) == 1).alias("fake")
    )
    present = known.select(dataset).distinct().withColumn("_exists", F.lit(True))
    joined = roots.join(present, dataset, "left").join(counts, dataset, "left").fillna(0, ["real", "fake"])
    problem = (
        F.when(F.col("_exists").isNull(), "missing")
        .when((F.col("real") == 0) & (F.col("fake") == 0), "empty")
        .when((F.col("real") == 0) | (F.col("fake") == 0), "one-sided")
    )
    return joined.select(dataset, "real", "fake", problem.alias("problem"))


def require_sound_roots(problems: DataFrame, strict: bool = True) -> DataFrame:
    """Raise when any root has a problem, unless `strict` is off."""
    if strict:
        bad = problems.where(F.col("problem").isNotNull()).limit(20).collect()
        if bad:
            raise ValueError("dataset roots cannot be trained on: " + "; ".join(f"{r[0]}: {r['problem']}" for r in bad))
    return problems


def format_census(rows: DataFrame, group: Sequence[str], label: str, fmt: str) -> DataFrame:
    """Source formats of each class and whether the two sets differ."""
    counted = rows.groupBy(*group, label, fmt).agg(F.count(F.lit(1)).alias("n"))
    pick = lambda v: F.sort_array(F.collect_set(F.when(F.col(label) == v, F.col(fmt))))
    return counted.groupBy(*group).agg(pick(0).alias("real_formats"), pick(1).alias("fake_formats")).withColumn(
        "differ",
        (F.size("real_formats") > 0) & (F.size("fake_formats") > 0) & (F.col("real_formats") != F.col("fake_formats")),
    )


def shortfall(rows: DataFrame, family: str, label: str, target: int) -> DataFrame:
    """Families that hold fewer than `target` rows of either class."""
    counts = rows.groupBy(family).agg(
        F.count_if(F.col(label) == 0).alias("real"), F.count_if(F.col(label) == 1).alias("fake")
    )
    return counts.where((F.col("real") < target) | (F.col("fake") < target)).withColumns(
        {"missing_real": F.greatest(F.lit(0), target - F.col("real")), "missing_fake": F.greatest(F.lit(0), target - F.col("fake"))}
    )


# --- crops --------------------------------------------------------------------------------


def snapped_offset(length: Column, size: int) -> Column:
    """Centre-crop offset, moved down to a multiple of 8 so that the block grid keeps its phase."""
    return F.shiftright((length - size).cast("int"), 1).bitwiseAND(F.lit(~7))


def native_crop(df: DataFrame, size: int, w: str = "w", h: str = "h") -> DataFrame:
    """Crop boxes at native resolution; images that are too small are left out."""
    return df.where(F.least(w, h) >= size).withColumns(
        {"left": snapped_offset(F.col(w), size), "top": snapped_offset(F.col(h), size)}
    )


def canonical_crop(df: DataFrame, size: int, w: str = "w", h: str = "h") -> DataFrame:
    """Crop boxes for every image; a too small one is first enlarged on its short side."""
    short = F.least(w, h)
    grown = lambda c: F.greatest(F.lit(size), F.bround(F.col(c) * (F.lit(float(size)) / short)).cast("int"))
    resized = df.withColumns(
        {
            "resized_w": F.when(short < size, grown(w)).otherwise(F.col(w).cast("int")),
            "resized_h": F.when(short < size, grown(h)).otherwise(F.col(h).cast("int")),
        }
    )
    return resized.withColumns(
        {"left": snapped_offset(F.col("resized_w"), size), "top": snapped_offset(F.col("resized_h"), size)}
    )


def skip_accounting(df: DataFrame, size: int, label: str, decoded: Column, w: str = "w", h: str = "h") -> DataFrame:
    """Rows written, too small, or undecodable, per class."""
    status = F.when(~decoded, "error").when(F.least(w, h) < size, "small").otherwise("written")
    return df.withColumn("_s", status).groupBy(label).agg(
        *[F.count_if(F.col("_s") == s).alias(s) for s in ("written", "small", "error")]
    )


def working_size(df: DataFrame, max_side: int, w: str = "w", h: str = "h") -> DataFrame:
    """Bound the long side; sizes within the bound are kept."""
    long_side = F.greatest(w, h)
    scaled = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) * (F.lit(float(max_side)) / long_side)).cast("int"))
    return df.withColumns(
        {
            "work_w": F.when(long_side > max_side, scaled(w)).otherwise(F.col(w).cast("int")),
            "work_h": F.when(long_side > max_side, scaled(h)).otherwise(F.col(h).cast("int")),
        }
    )


# --- subsets and splits -------------------------------------------------------------------


def split_by_group(df: DataFrame, group: str, fraction: float, key: Column | None = None) -> DataFrame:
    """Mark `is_val`: the first floor(n * fraction) distinct groups in random order.

    The boundary group is found once and handed back as a scalar, so the large side is only
    filtered, never joined.
    """
    key = draw_key(group) if key is None else key
    marked = df.withColumn("_k", key)
    groups = marked.select("_k", F.col(group).alias("_g")).distinct()
    wanted = groups.agg(F.floor(F.count(F.lit(1)) * F.lit(fraction)).alias("n")).scalar()
    last = (
        ranks.positions(groups, [], ["_k", "_g"])
        .where(F.col("position") == wanted)
        .select(F.struct("_k", "_g").alias("_last"))
        .scalar()
    )
    here = F.struct(F.col("_k"), F.col(group).alias("_g"))
    return marked.withColumn("is_val", F.coalesce(here <= last, F.lit(False))).drop("_k")


def random_subset(df: DataFrame, n: int, key: Column, tie: str) -> DataFrame:
    """`n` rows in random order; never a contiguous slice."""
    return ranks.first_n(df.withColumn("_k", key), [], ["_k", tie], n, "_at").drop("_k", "_at")


def per_class_cap(df: DataFrame, cls: str, order: Sequence[str], n: int) -> DataFrame:
    return ranks.first_n(df, [cls], order, n)


def interleave(df: DataFrame, cls: str, order: Sequence[str], target: int) -> DataFrame:
    """Round-robin over classes, up to `target` rows in all."""
    capped = ranks.first_n(df, [cls], order, target, "turn")
    return ranks.first_n(capped, [], ["turn", cls], target, "_at").drop("_at")


def scale_sample(windows: DataFrame, per_image: int, key: Column, image: str = "image_id", scale: str = "scale", tie: str = "patch_no") -> DataFrame:
    """`per_image // number of scales` random windows of every scale of an image."""
    by_scale = Window.partitionBy(image, scale).orderBy(key, tie)
    ranked = windows.withColumn("_r", F.row_number().over(by_scale)).withColumn(
        "_n", F.size(F.collect_set(scale).over(Window.partitionBy(image)))
    )
    quota = F.greatest(F.lit(1), F.floor(F.lit(per_image) / F.col("_n")).cast("int"))
    return ranked.where(F.col("_r") <= quota).drop("_r", "_n")


def balanced_windows(windows: DataFrame, per_image: int, label: str, cls: str, key: Column, image: str = "image_id", tie: str = "patch_no") -> DataFrame:
    """Random windows of an image; in a tampered image both labels keep the same number."""
    by_label = Window.partitionBy(image, label).orderBy(key, tie)
    capped = windows.withColumn("_r", F.row_number().over(by_label)).where(F.col("_r") <= per_image)
    whole = Window.partitionBy(image)
    counted = capped.withColumn(
        "_keep",
        F.when(
            F.col(cls) == "tampered",
            F.least(F.count_if(F.col(label) == 1).over(whole), F.count_if(F.col(label) == 0).over(whole)),
        ).otherwise(F.lit(per_image)),
    )
    return counted.where(F.col("_r") <= F.col("_keep")).drop("_r", "_keep")


# --- copies, stacking, guards -------------------------------------------------------------


def expand_copies(samples: DataFrame, sample: str, copies: int) -> DataFrame:
    """One clean row and `copies` augmented rows per sample, sharing a group id."""
    return samples.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies))).alias("copy")).withColumns(
        {"group_id": F.col(sample), "is_aug": F.col("copy") > 0}
    )


def check_copy_plan(copies: int, severity: str | None) -> None:
    """A fixed severity and random copies exclude each other."""
    if copies > 0 and severity is not None:
        raise ValueError("a fixed severity cannot be combined with random copies")


def paired_views(features: DataFrame) -> DataFrame:
    """Clean and augmented row of the same image side by side."""
    keep = ["sample_id", "group_id", "y"]
    clean = features.where(~F.col("is_aug")).select(*keep)
    copy = features.where("is_aug").select(F.col("sample_id").alias("aug_sample_id"), "group_id")
    return clean.join(copy, "group_id")


def clean_rows(features: DataFrame, subset: str = "clean") -> DataFrame:
    """Clean, augmented or all rows of a feature table."""
    if subset == "clean":
        return features.where(~F.col("is_aug"))
    if subset == "augmented":
        return features.where("is_aug")
    if subset == "all":
        return features
    raise ValueError(f"unknown subset {subset!r}")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows left: {what}")
    return df


def stack_caches(caches: DataFrame, cache: str = "cache", group: str = "group_id") -> DataFrame:
    """Give every cache its own range of group ids: earlier caches' max + 1 is added."""
    tops = caches.groupBy(cache).agg((F.max(group) + 1).alias("_top"))
    before = Window.partitionBy(F.lit(0)).orderBy(cache).rowsBetween(Window.unboundedPreceding, -1)
    offsets = tops.select(cache, F.coalesce(F.sum("_top").over(before), F.lit(0)).alias("_offset"))
    return caches.join(offsets, cache).withColumn(group, F.col(group) + F.col("_offset")).drop("_offset")


def union_caches(frames: Sequence[DataFrame], blocks: Sequence[list[tuple[str, int]]]) -> DataFrame:
    """Stack feature tables whose block layouts are equal."""
    if len({tuple(map(tuple, b)) for b in blocks}) > 1:
        raise ValueError(f"feature tables with unlike block layouts can't be stacked: {blocks}")
    out = None
    for i, frame in enumerate(frames):
        tagged = frame.withColumn("cache", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged)
    return stack_caches(out)


def not_recorded(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not yet written."""
    return new.join(existing.select(key), key, "left_anti")


def leaked(evaluation: DataFrame, training: DataFrame, key: str) -> DataFrame:
    """Evaluation rows that also occur in training; must be empty."""
    return evaluation.join(training.select(key), key, "left_semi")


def accumulate_manifest(existing: DataFrame, new: DataFrame, key: str = "stem") -> DataFrame:
    """Append the rows whose key is new."""
    return existing.unionByName(not_recorded(new, existing, key))


def top_up(candidates: DataFrame, existing: DataFrame, key: str, target: int) -> DataFrame:
    """Fill up to `target` rows, counting what is already written."""
    missing = max(0, target - existing.select(key).distinct().count())
    return ranks.first_n(not_recorded(candidates, existing, key), [], [key], missing, "_at").drop("_at")


def fold_totals(df: DataFrame, family: str, label: str) -> DataFrame:
    """Size and class counts of every leave-one-family-out fold.

    A fold's training side is the whole minus the held family, so per-family totals
    suffice; rows are never copied once per fold.
    """
    per = df.groupBy(family).agg(F.count(F.lit(1)).alias("held_n"), F.sum(F.col(label)).cast("long").alias("held_fake"))
    every = Window.partitionBy(F.lit(0))
    return per.select(
        F.col(family).alias("held_family"),
        "held_n",
        "held_fake",
        (F.sum("held_n").over(every) - F.col("held_n")).alias("train_n"),
        (F.sum("held_fake").over(every) - F.col("held_fake")).alias("train_fake"),
    )


def fold_training_rows(df: DataFrame, family: str, held: str) -> DataFrame:
    """Training side of one fold."""
    return df.where(F.col(family) != F.lit(held))


def block_subsets(blocks: Column) -> Column:
    """Every non-empty subset of an array of block names, in bit order."""
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(blocks)) - 1)
    has = lambda m, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1
    return F.transform(masks, lambda m: F.filter(blocks, lambda b, i: has(m, i)))


def traceable_stem(repo: Column, shard: Column, row: Column) -> Column:
    return F.format_string("%s_%s_%06d", F.element_at(F.split(repo, "/"), -1), shard, row)
