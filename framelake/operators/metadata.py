"""Corrections to the tag table that a rotation calls for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import orientation as o


PLAN = ["width", "height", "out_w", "out_h"]


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of tags with the plan beside them: the two sizes as one 4-byte number (low 16 bits) where the output size differs."""
    is_w = F.col("tag") == fixed.TAG_EXIF_WIDTH
    is_h = F.col("tag") == fixed.TAG_EXIF_HEIGHT
    differs = (F.col("out_w") != F.col("width")) | (F.col("out_h") != F.col("height"))
    hit = (is_w | is_h) & (F.col("ifd") == "exif") & differs & F.col("leads")
    size = F.when(is_w, F.col("out_w")).otherwise(F.col("out_h")).cast("bigint").bitwiseAND(65535)
    return rows.withColumns(
        {
            "type": F.when(hit, F.lit(4)).otherwise(F.col("type")),
            "count": F.when(hit, F.lit(1).cast("bigint")).otherwise(F.col("count")),
            "values": F.when(hit, F.array(size)).otherwise(F.col("values")),
        }
    )


def _leads(plan: DataFrame):
    return (F.col("has_exif_first") if "has_exif_first" in plan.columns else F.lit(True)).alias("leads")


def fix_exif_dims(tags: DataFrame, plan: DataFrame) -> DataFrame:
    """Rewrite the two size tags where the output size differs, if the first saved segment of the image is the EXIF one.

    ``plan`` has one row per image: ``image_id, width, height, out_w, out_h`` and ``has_exif_first``; without that
    column all images count as such.
    """
    sized = tags.join(plan.select("image_id", *PLAN, _leads(plan)), "image_id", "left")
    return _sized(sized).select(*tags.columns)


def repaired(rows: DataFrame) -> DataFrame:
    """Tag rows with ``orientation, width, height, out_w, out_h, leads`` beside them, corrected; a projection.

    The two focal-plane resolutions trade places by trading tag numbers, which needs no pairing of rows and leaves an
    absent one absent. Each tag counts only in its own directory.
    """
    tag, values, ori = F.col("tag"), F.col("values"), F.col("orientation")
    sub = F.col("ifd") == "exif"
    focal = sub & tag.isin(fixed.TAG_FOCAL_X, fixed.TAG_FOCAL_Y) & o.xy_flips(ori)
    new_tag = F.when(focal, F.lit(fixed.TAG_FOCAL_X + fixed.TAG_FOCAL_Y) - tag).otherwise(tag)
    new_values = (
        F.when((tag == fixed.TAG_ORIENTATION) & ~sub, F.transform(values, o.reset_orientation))
        .when(sub & (tag == fixed.TAG_SUBJECT_AREA), o.fix_subject_area(values, "out_w", "out_h", ori))
        .when(sub & (tag == fixed.TAG_SUBJECT_LOCATION), o.fix_subject_location(values, "out_w", "out_h", ori))
        .otherwise(values)
    )
    return _sized(rows.withColumns({"tag": new_tag, "values": new_values}))


def metadata_repair(plan: DataFrame, tags: DataFrame) -> DataFrame:
    """Corrected tag rows of every image that rotates.

    ``plan``: ``image_id, orientation, width, height, out_w, out_h``, and ``has_exif_first`` as in ``fix_exif_dims``.
    """
    turned = tags.join(plan.select("image_id", "orientation", *PLAN, _leads(plan)), "image_id")
    return repaired(turned).select(*tags.columns)
