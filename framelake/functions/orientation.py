"""Orientation rules as columns: which value applies, what it does to points and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed
from .exprs import col


def coalesce_orientation(exif, xmp) -> Column:
    """EXIF value if it turns the image, else the XMP value if that does, else EXIF as it is (0 = absent)."""
    exif = F.coalesce(col(exif), F.lit(0)).bitwiseAND(255)
    xmp = F.coalesce(col(xmp), F.lit(0)).bitwiseAND(255)
    return F.when(exif.between(2, 8), exif).when(xmp.between(2, 8), xmp).otherwise(exif).cast("int")


def is_rotatable(orientation) -> Column:
    return col(orientation).between(2, 8)


def xy_flips(orientation) -> Column:
    return col(orientation).between(5, 8)


def orientation_dim(spark: SparkSession) -> DataFrame:
    """The nine fixed orientation rows."""
    return spark.createDataFrame(list(fixed.ORIENTATION_ROWS), fixed.ORIENTATION_SCHEMA)


def with_transform(images: DataFrame, orientation: str = "orientation") -> DataFrame:
    """Attach transform, matrices and thumbnail rule. The dimension has nine fixed rows, so it is broadcast."""
    dim = orientation_dim(images.sparkSession)
    known = F.when(F.col(orientation).between(0, 8), F.col(orientation)).otherwise(F.lit(0))
    return (
        images.withColumn("_o", known.cast("int"))
        .join(F.broadcast(dim.withColumnRenamed("orientation", "_o")), "_o", "left")
        .drop("_o")
    )


def _matrix(orientation) -> tuple[Column, Column, Column, Column]:
    o = col(orientation)

    def pick(position: int) -> Column:
        values = [row[position] for row in fixed.ORIENTATION_ROWS]
        identity = values[0]
        out = None
        for code, v in enumerate(values):
            if v != identity:
                out = F.when(o == code, F.lit(v)) if out is None else out.when(o == code, F.lit(v))
        return out.otherwise(F.lit(identity))

    return pick(2), pick(3), pick(4), pick(5)


def reorient_point(x, y, width, height, orientation) -> Column:
    """Move a point of the source image into the rotated image of size ``width`` x ``height``.

    The point is taken relative to the centre of the source (sizes swapped when the axes swap), turned by
    the orientation matrix, moved to the centre of the result and truncated.
    """
    m11, m12, m21, m22 = _matrix(orientation)
    flips = xy_flips(orientation)
    half_w, half_h = col(width).cast("float") / F.lit(2.0).cast("float"), col(height).cast("float") / F.lit(2.0).cast("float")
    dx = col(x).cast("float") - F.when(flips, half_h).otherwise(half_w)
    dy = col(y).cast("float") - F.when(flips, half_w).otherwise(half_h)
    return F.struct(
        (dx * m11 + dy * m21 + half_w).cast("int").alias("x"),
        (dx * m12 + dy * m22 + half_h).cast("int").alias("y"),
    )


def fix_subject_area(area, width, height, orientation) -> Column:
    """First two values are a point; values three and four swap only when there are four and the axes swap."""
    a = col(area)
    p = reorient_point(a[0], a[1], width, height, orientation)
    head = F.array(p["x"].cast("bigint"), p["y"].cast("bigint"))
    tail = F.slice(a.cast("array<bigint>"), F.lit(3), F.size(a))
    swapped = (F.size(a) == 4) & xy_flips(orientation)
    return F.when(a.isNull(), F.lit(None)).when(swapped, F.concat(head, F.reverse(tail))).otherwise(F.concat(head, tail))


def fix_subject_location(location, width, height, orientation) -> Column:
    a = col(location)
    p = reorient_point(a[0], a[1], width, height, orientation)
    return F.when(a.isNotNull(), F.array(p["x"].cast("bigint"), p["y"].cast("bigint")))


def fix_focal_plane(x_res, y_res, orientation) -> Column:
    """Horizontal and vertical resolution trade places when the axes swap; an absent one stays empty."""
    x, y, flips = col(x_res), col(y_res), xy_flips(orientation)
    return F.struct(F.when(flips, y).otherwise(x).alias("x_res"), F.when(flips, x).otherwise(y).alias("y_res"))


def reset_orientation(value) -> Column:
    """A recorded orientation becomes 1; an absent one (0 or NULL) stays as it is."""
    v = col(value)
    return F.when(v != 0, F.lit(1)).otherwise(v)


def patch_orientation(content, value_offset, big_endian) -> Column:
    """Overwrite the two value bytes of the orientation tag in the file bytes (0-based offset)."""
    one = F.when(col(big_endian), F.unhex(F.lit("0001"))).otherwise(F.unhex(F.lit("0100")))
    at = col(value_offset).cast("int")
    c = col(content)
    inside = (at >= 0) & (at + 2 <= F.length(c))
    return F.when(inside, F.overlay(c, one, at + 1, F.lit(2))).otherwise(c)


def patch_xmp_orientation(content, offset, length) -> Column:
    """Overwrite the digits of the XMP orientation in the file bytes (0-based offset) by a 1, with zeros before it if there are more."""
    c, at, n = col(content), col(offset).cast("int"), col(length).cast("int")
    digits = F.encode(F.lpad(F.lit("1"), n, "0"), "ISO-8859-1")
    inside = (at >= 0) & (at + n <= F.length(c))
    return F.when(inside, F.overlay(c, digits, at + 1, n)).otherwise(c)


def needs_repair(subject_area, subject_location, focal_x, focal_y, has_thumbnail, orientation) -> Column:
    focal = col(focal_x).isNotNull() | col(focal_y).isNotNull()
    return (
        col(subject_area).isNotNull()
        | col(subject_location).isNotNull()
        | (focal & xy_flips(orientation))
        | F.coalesce(col(has_thumbnail), F.lit(False))
    )
