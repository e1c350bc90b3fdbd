"""The image catalogue: which files rotate, which are refused, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import geometry as g
from ..functions import orientation as o
from ..functions.exprs import col, starts_with


def split_jpeg(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that start with the image marker, and the rejected others."""
    good = F.coalesce(starts_with("content", b"\xff\xd8"), F.lit(False))
    return images.filter(good), images.filter(~good)


def with_orientation(images: DataFrame) -> DataFrame:
    return images.withColumn("orientation", o.coalesce_orientation("exif_orientation", "xmp_orientation"))


def rotatable(images: DataFrame) -> DataFrame:
    """Images whose effective orientation is not upright."""
    return images.filter(o.is_rotatable(o.coalesce_orientation("exif_orientation", "xmp_orientation")))


def flag_readonly(images: DataFrame) -> DataFrame:
    return images.withColumn("error", F.when(F.col("read_only"), F.lit("imageReadOnly")))


def clean_images(images: DataFrame, issues: DataFrame) -> DataFrame:
    return images.join(issues.select("image_id").distinct(), "image_id", "left_anti")


def affected_images(images: DataFrame, issues: DataFrame) -> DataFrame:
    return images.join(issues.select("image_id").distinct(), "image_id", "left_semi")


def admission(width, height, ncomp, max_h, max_v, transform, trim) -> Column:
    """NULL if the transform may run; the refusal otherwise. Without trimming the transform must be perfect."""
    single = col(ncomp) == 1
    unit_w = F.when(single, F.lit(fixed.DCT_SIZE)).otherwise(col(max_h) * fixed.DCT_SIZE)
    unit_h = F.when(single, F.lit(fixed.DCT_SIZE)).otherwise(col(max_v) * fixed.DCT_SIZE)
    perfect = g.is_perfect(width, height, unit_w, unit_h, transform)
    return F.when(~col(trim) & ~perfect, F.lit("cropOptionRequired"))


def admit(requests: DataFrame) -> DataFrame:
    return requests.withColumn(
        "refusal", admission("width", "height", "ncomp", "max_h", "max_v", "transform", "trim")
    )


def output_geometry(frames: DataFrame) -> DataFrame:
    """Output and unit size of ``transform`` on every image."""
    out_w, out_h = g.output_size("width", "height", "transform")
    unit_w, unit_h = g.imcu_size("ncomp", "max_h", "max_v", "transform")
    return frames.withColumns({"full_w": out_w, "full_h": out_h, "unit_w": unit_w, "unit_h": unit_h})


def trimmed_geometry(geometry: DataFrame) -> DataFrame:
    """Output size after cutting partial units off the mirrored edges, where ``trim`` is set."""
    tw, th = g.trim_edges(
        "full_w", "full_h", "full_w", "full_h", "unit_w", "unit_h", F.lit(0), F.lit(0), "transform"
    )
    return geometry.withColumns(
        {
            "out_w": F.when(F.col("trim"), tw).otherwise(F.col("full_w")),
            "out_h": F.when(F.col("trim"), th).otherwise(F.col("full_h")),
        }
    )


def rotation_plan(images: DataFrame) -> DataFrame:
    """One row per rotatable image: transform, output size, pixels lost to trimming, and any refusal.

    Needs ``image_id, width, height, ncomp, max_h, max_v, exif_orientation, xmp_orientation, read_only, trim``.
    Projection, filter and one nine-row broadcast: no shuffle at any size.
    """
    turned = with_orientation(images).filter(o.is_rotatable("orientation"))
    planned = trimmed_geometry(output_geometry(o.with_transform(turned)))
    refusal = F.when(F.col("read_only"), F.lit("imageReadOnly")).otherwise(
        admission("width", "height", "ncomp", "max_h", "max_v", "transform", "trim")
    )
    lost = F.col("width").cast("bigint") * F.col("height") - F.col("out_w").cast("bigint") * F.col("out_h")
    planned = planned.withColumn("refusal", refusal)
    return planned.withColumn("trimmed_pixels", F.when(F.col("refusal").isNull(), lost))
