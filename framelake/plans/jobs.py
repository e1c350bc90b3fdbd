"""Whole jobs over a folder of images or over prepared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import orientation as o
from ..functions.exprs import col
from ..operators import audit, blocks, catalog, headers, metadata, palette, samples, symbols
from ..sources.ranges import scan_headers


def rotation_plan(images: DataFrame, trim: bool = True) -> DataFrame:
    """Plan of every rotatable image straight from file bytes: one scan, no shuffle.

    ``images``: ``image_id, content`` and, if known, ``read_only``. Files without a usable frame give no plan row; the
    audit reports them.
    """
    if "read_only" not in images.columns:
        images = images.withColumn("read_only", F.lit(False))
    known = headers.image_headers(images).filter("width IS NOT NULL AND max_h IS NOT NULL")
    return catalog.rotation_plan(known.withColumn("trim", F.lit(trim)))


def plan_folder(spark: SparkSession, folder: str, trim: bool = True, recursive: bool = False) -> DataFrame:
    """Plan of every rotatable image of a folder. Of each file only the headers are read."""
    return rotation_plan(scan_headers(spark, folder, recursive), trim)


def audit_folder(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Findings over the files of a folder. Of each file only the headers are read."""
    return corpus_audit(scan_headers(spark, folder, recursive))


TAG_COLUMNS = ["image_id", "seq", "ifd", "tag", "type", "count", "value_offset", "values"]


def _planned(images: DataFrame, trim: bool) -> DataFrame:
    """Headers, tags and plan of every image that rotates and is not refused, one row each."""
    if "read_only" not in images.columns:
        images = images.withColumn("read_only", F.lit(False))
    known = headers.image_headers(images, tags=True).filter("width IS NOT NULL AND max_h IS NOT NULL")
    return catalog.rotation_plan(known.withColumn("trim", F.lit(trim))).filter("refusal IS NULL")


def metadata_repair(images: DataFrame, trim: bool = True) -> DataFrame:
    """Corrected tags of every image that rotates: one scan, one walk of each file's headers, no shuffle."""
    plan = _planned(images, trim).select("image_id", "orientation", *metadata.PLAN, F.inline_outer("exif_tags")).filter("tag IS NOT NULL")
    return metadata.repaired(plan).select(*TAG_COLUMNS)


def upright_files(images: DataFrame) -> DataFrame:
    """File bytes with the recorded orientation, EXIF and XMP, set to upright in place."""
    kept = images.withColumn("_raw", F.col("content"))
    found = headers.image_headers(kept)
    reset = F.when(col("exif_orientation") != 0, o.patch_orientation("_raw", "orientation_offset", "big_endian"))
    whole = F.coalesce(reset, F.col("_raw"))
    xmp = F.when(col("xmp_orientation") != 0, o.patch_xmp_orientation("_whole", "xmp_offset", "xmp_length"))
    return found.withColumn("_whole", whole).select("image_id", F.coalesce(xmp, F.col("_whole")).alias("content"))


def corpus_audit(images: DataFrame) -> DataFrame:
    """All findings over a folder of files: one scan, one walk of each file's headers, no shuffle."""
    return audit.file_audit(images.select("image_id", "content"))


rotate_blocks = blocks.rotate_blocks
encoding_report = symbols.encoding_report
pixels_to_blocks = samples.pixels_to_blocks
blocks_to_pixels = samples.blocks_to_pixels
corpus_palette = palette.corpus_palette
