"""Image files: listing, labelling by folder, decoding, archives, pixels."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelwarrant.sources import files

# Accepted file suffixes.
SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")
TIFF_SUFFIXES = ("tif", "tiff")
BATCH_CELLS = 100_000  # that a task hands on together


def is_image(path: Column, tiff: bool = False) -> Column:
    names = SUFFIXES + (TIFF_SUFFIXES if tiff else ())
    return F.lower(path).rlike(r"\.(" + "|".join(names) + r")$")


def list_images(spark: SparkSession, folder: str, tiff: bool = False) -> DataFrame:
    """Paths and sizes of the image files below a folder; file contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "length").where(is_image(F.col("path"), tiff))


def label_by_folder(paths: DataFrame, real: str = "real", fake: str = "fake") -> DataFrame:
    """`samples(path, dataset, label)` from `<dataset>/<real|fake>/...`; other paths are dropped."""
    pattern = rf"/([^/]+)/({real}|{fake})/"
    return (
        paths.withColumn("dataset", F.regexp_extract("path", pattern, 1))
        .withColumn("_side", F.regexp_extract("path", pattern, 2))
        .where(F.col("_side") != "")
        .withColumn("label", (F.col("_side") == fake).cast("int"))
        .drop("_side")
    )


def label_two_folders(real: DataFrame, fake: DataFrame) -> DataFrame:
    """Two flat folders, the label given by the folder."""
    return real.withColumn("label", F.lit(0)).unionByName(fake.withColumn("label", F.lit(1)))


def relabel_layout(paths: DataFrame, split: str) -> DataFrame:
    """REAL/FAKE directories in any case -> destination `<real|fake>/<split>_<file>`."""
    parts = F.split("path", "/")
    side = F.lower(F.element_at(parts, -2))
    return (
        paths.withColumn("side", side)
        .where(F.col("side").isin("real", "fake"))
        .withColumn("dest", F.concat(F.col("side"), F.lit("/"), F.concat_ws("_", F.lit(split), F.element_at(parts, -1))))
    )


def require_images(paths: DataFrame, where: str) -> DataFrame:
    if paths.isEmpty():
        raise ValueError(f"no images found in {where}")
    return paths


def unlabelled_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A flat folder to be scored; an empty one is an error."""
    return require_images(list_images(spark, folder, tiff=True), folder)


def read_images(spark: SparkSession, folder: str, invalid: bool = False) -> DataFrame:
    """Decoded images with the undecodable files left out; with `invalid` those are rows of a height below 1."""
    images = (
        spark.read.format("image").option("dropInvalid", str(not invalid).lower()).option("recursiveFileLookup", "true").load(folder)
    )
    return images.select(
        F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data"
    )


def decode_errors(listed: DataFrame, decoded: DataFrame) -> DataFrame:
    """Listed files that did not decode."""
    clean = lambda c: F.regexp_replace(c, "^file:/*", "/")
    return listed.withColumn("_p", clean("path")).join(
        decoded.select(clean("path").alias("_p")), "_p", "left_anti"
    ).drop("_p")


def complete(df: DataFrame) -> Column:
    """Whether an image row holds as many bytes as its size says."""
    return F.octet_length("data") == F.col("height") * F.col("width") * F.col("nChannels")


def _block_means(frame: pd.DataFrame, cell_px: int) -> pd.DataFrame:
    """Mean R, G, B of every `cell_px` block of one image; bytes arrive in B, G, R order."""
    row = frame.iloc[0]
    h, w, c = int(row["height"]), int(row["width"]), int(row["nChannels"])
    px = np.frombuffer(row["data"], dtype=np.uint8).reshape(h, w, c).astype(np.float64)
    bgr = px[:, :, :3] if c >= 3 else np.repeat(px[:, :, :1], 3, axis=2)
    ys, xs = np.arange(0, h, cell_px), np.arange(0, w, cell_px)
    sums = np.add.reduceat(np.add.reduceat(bgr, ys, axis=0), xs, axis=1)
    area = np.minimum(cell_px, h - ys)[:, None] * np.minimum(cell_px, w - xs)[None, :]
    mean = sums / area[:, :, None]
    gy, gx = np.meshgrid(np.arange(len(ys)), np.arange(len(xs)), indexing="ij")
    return pd.DataFrame(
        {
            "image_id": row["image_id"],
            "y": gy.ravel().astype(np.int32),
            "x": gx.ravel().astype(np.int32),
            "r": mean[:, :, 2].ravel(),
            "g": mean[:, :, 1].ravel(),
            "b": mean[:, :, 0].ravel(),
        }
    )


def image_cells(images: DataFrame, cell_px: int = 1, id_type: str = "bigint") -> DataFrame:
    """Tall `(image_id, y, x, r, g, b)` on a grid of `cell_px` blocks.

    One row in, one image's cells out; `cell_px = 1` gives the pixels themselves. An image that didn't decode (height below 1)
    gives one row without a place or colours, so that one reading of the files tells both.
    """

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            broken = batch.loc[batch["height"] < 1, ["image_id"]]
            if len(broken):
                yield broken.assign(y=None, x=None, r=np.nan, g=np.nan, b=np.nan).astype({"y": "Int32", "x": "Int32"}).replace({np.nan: None})
            whole, held, cells = batch[batch["height"] >= 1], [], 0
            for i in range(len(whole)):
                held.append(_block_means(whole.iloc[i : i + 1], cell_px))
                cells += len(held[-1])
                if cells > BATCH_CELLS:
                    yield pd.concat(held)
                    held, cells = [], 0
            if held:
                yield pd.concat(held)

    rows = images.select("image_id", "height", "width", "nChannels", "data")
    return rows.mapInPandas(expand, f"image_id {id_type}, y int, x int, r double, g double, b double")


def luma(r: str = "r", g: str = "g", b: str = "b") -> Column:
    """Luminance in [0, 1] of 0..255 channels."""
    return (F.col(r) * 0.299 + F.col(g) * 0.587 + F.col(b) * 0.114) / 255.0


# The folders of an archive that hold the two classes.
ARCHIVE_REAL, ARCHIVE_FAKE = "0_real", "1_fake"


def labelled_members(members: DataFrame) -> DataFrame:
    """Image members below a folder `0_real` or `1_fake`, with that label and their first folder as `category`."""
    parts = F.split("member", "/")
    label = F.when(F.array_contains(parts, ARCHIVE_REAL), 0).when(F.array_contains(parts, ARCHIVE_FAKE), 1)
    kept = members.withColumn("label", label).where(F.col("label").isNotNull() & is_image(F.col("member")))
    return kept.withColumn("category", parts[0])


def archive_members(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Labelled image members of all zip archives below a folder, each archive read in byte ranges."""
    members = files.archive_members(spark, folder, suffixes=",".join(SUFFIXES), **options)
    return labelled_members(members).select("archive", "category", "member", "label", "content")


def require_both_sides(members: DataFrame) -> None:
    """An archive without members of both classes has another layout than this reads: an error that names it."""
    sides = members.groupBy("archive").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    odd = sides.where("low = high").select("archive").limit(3).collect()
    if odd:
        raise ValueError(f"archives without both {ARCHIVE_REAL} and {ARCHIVE_FAKE}: {', '.join(r[0] for r in odd)}")
