"""Lossless transforms of coefficient blocks.

Blocks meet their image's plan on (image, component, band of 64 block rows). The bands of the plan follow from
the image size, so a join key holds at most 64 rows of blocks however large an image is, and nothing is broadcast
unless the optimizer knows its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as fb
from ..functions import fixed
from ..functions import geometry as g
from ..functions.exprs import ceil_div, idiv

BAND = 64
PLAN_COLUMNS = ["transform", "width", "height", "ncomp", "max_h", "max_v", "h", "v"]


def component_plan(plan: DataFrame, comps: DataFrame) -> DataFrame:
    """One row per component of each planned image; images whose ``refusal`` says why they are not transformed have none."""
    if "refusal" in plan.columns:
        plan = plan.filter("refusal IS NULL")
    return plan.join(comps.select("image_id", "ci", "h", "v"), "image_id")


def with_plan(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """Attach the component plan to every block of the planned images, band by band."""
    rows = ceil_div("height", F.col("max_v") * fixed.DCT_SIZE) * F.col("v")
    bands = plan.withColumn("_band", F.explode(F.sequence(F.lit(0).cast("bigint"), idiv(rows - 1, BAND))))
    return blocks.withColumn("_band", idiv("by", BAND)).join(bands, ["image_id", "ci", "_band"]).drop("_band")


def transformed(rows: DataFrame, transform: str | Column) -> DataFrame:
    """Blocks at their places in the transformed image. Needs ``PLAN_COLUMNS`` but ``transform``."""
    t = F.lit(transform) if isinstance(transform, str) else transform
    struct = fb.place_block(t, "by", "bx", "coef", "width", "height", "ncomp", "max_h", "max_v", "h", "v")
    return rows.withColumn("_p", struct).withColumns(
        {"by": F.col("_p.by"), "bx": F.col("_p.bx"), "coef": F.col("_p.coef")}
    ).drop("_p")


def flip_h(rows: DataFrame) -> DataFrame:
    return transformed(rows, fixed.FLIP_H)


def flip_v(rows: DataFrame) -> DataFrame:
    return transformed(rows, fixed.FLIP_V)


def transpose(rows: DataFrame) -> DataFrame:
    return transformed(rows, fixed.TRANSPOSE)


def transverse(rows: DataFrame) -> DataFrame:
    return transformed(rows, fixed.TRANSVERSE)


def rot_90(rows: DataFrame) -> DataFrame:
    return transformed(rows, fixed.ROT_90)


def rot_180(rows: DataFrame) -> DataFrame:
    return transformed(rows, fixed.ROT_180)


def rot_270(rows: DataFrame) -> DataFrame:
    return transformed(rows, fixed.ROT_270)


def wipe(rows: DataFrame, where: Column | None = None) -> DataFrame:
    """Blank the blocks of the rectangle ``x_off, y_off, wipe_w, wipe_h`` (whole units); only of the rows ``where``, if given."""
    dh, dv = fb.sampling(F.lit(fixed.WIPE), "ncomp", "h", "v")
    inside = (
        (F.col("bx") >= F.col("x_off") * dh) & (F.col("bx") < (F.col("x_off") + F.col("wipe_w")) * dh)
        & (F.col("by") >= F.col("y_off") * dv) & (F.col("by") < (F.col("y_off") + F.col("wipe_h")) * dv)
    )
    if where is not None:
        inside = where & inside
    blank = F.transform("coef", lambda c: c - c)
    return rows.withColumn("coef", F.when(F.coalesce(inside, F.lit(False)), blank).otherwise(F.col("coef")))


def extent(transform: Column) -> tuple[Column, Column, Column, Column]:
    """Sampling of a component in the result, and the result's blocks across and down."""
    dh, dv = fb.sampling(transform, "ncomp", "h", "v")
    uw, uh = g.imcu_size("ncomp", "max_h", "max_v", transform)
    return dh, dv, fb.blocks_across("out_w", dh, uw), fb.blocks_across("out_h", dv, uh)


def crop(rows: DataFrame, transform: str | Column = fixed.NONE) -> DataFrame:
    """Keep the blocks of the result area and shift them by the crop offset (whole units)."""
    t = F.lit(transform) if isinstance(transform, str) else transform
    dh, dv, wide, high = extent(t)
    x, y = F.col("bx") - F.col("x_off") * dh, F.col("by") - F.col("y_off") * dv
    inside = (x >= 0) & (y >= 0) & (x < wide) & (y < high)
    return rows.filter(inside).withColumns({"bx": x.cast("int"), "by": y.cast("int")})


def crop_extend(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Crop to a result larger than the source along at least one axis.

    Along a growing axis the source moves in by the offset, its partial units are blanked, and the rest is filled
    with blank blocks. The filling is generated from the plan, so it needs no join; it is spread by block row.
    """
    t = F.lit(fixed.NONE)
    dh, dv, wide, high = extent(t)
    whole_w, whole_h = fb.whole_blocks(t, "width", "height", "ncomp", "max_h", "max_v", "h", "v")
    gx, gy = F.col("out_w") > F.col("width"), F.col("out_h") > F.col("height")
    shift_x = F.when(gx, -F.col("x_off") * dh).otherwise(F.col("x_off") * dh)
    shift_y = F.when(gy, -F.col("y_off") * dv).otherwise(F.col("y_off") * dv)
    # Area of the result that source blocks cover: a whole axis, or the whole units at the offset.
    from_x, to_x = F.when(gx, F.col("x_off") * dh).otherwise(0), F.when(gx, F.col("x_off") * dh + whole_w).otherwise(wide)
    from_y, to_y = F.when(gy, F.col("y_off") * dv).otherwise(0), F.when(gy, F.col("y_off") * dv + whole_h).otherwise(high)

    def covered(x: Column, y: Column) -> Column:
        return (x >= from_x) & (x < to_x) & (y >= from_y) & (y < to_y)

    x, y = F.col("bx") - shift_x, F.col("by") - shift_y
    kept = rows.filter(covered(x, y)).withColumns({"bx": x.cast("int"), "by": y.cast("int")})
    lines = plan.withColumn("by", F.explode(F.sequence(F.lit(0), high.cast("int") - 1))).repartition("image_id", "ci", "by")
    grid = lines.withColumn("bx", F.explode(F.sequence(F.lit(0), wide.cast("int") - 1)))
    filled = grid.filter(~covered(F.col("bx"), F.col("by"))).withColumn("coef", fb.zero_block())
    out = ["image_id", "ci", "by", "bx", "coef"]
    return kept.select(*out).unionByName(filled.select(*out))


def rotate_blocks(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """Run each image's planned transform on its blocks, the crop last.

    ``plan``: one row per component, ``image_id, ci, h, v, transform, width, height, ncomp, max_h, max_v, out_w,
    out_h, x_off, y_off``, and ``refusal`` if known: refused images give no blocks. After the band join this is one
    projection and one filter.
    """
    if "refusal" in plan.columns:
        plan = plan.filter("refusal IS NULL").drop("refusal")
    joined = with_plan(blocks, plan)
    return crop(transformed(joined, F.col("transform")), F.col("transform")).select(*blocks.columns)


def low_frequency(blocks: DataFrame, k: int) -> DataFrame:
    """Lossless shrink: keep the k x k lowest coefficients of each block."""
    return blocks.withColumn("coef", fb.low_frequency("coef", k))


def grayscale_status(frames: DataFrame, comps: DataFrame) -> DataFrame:
    """Which images can become gray by keeping component 0: luma/chroma or gray, luma at full resolution."""
    luma = comps.filter("ci = 0").select("image_id", F.col("h").alias("_h"), F.col("v").alias("_v"))
    j = frames.join(luma, "image_id", "left")
    kind = ((F.col("ncomp") == 3) & F.col("color_space").isin("ycc", "bg_ycc")) | (
        (F.col("ncomp") == 1) & (F.col("color_space") == "gray")
    )
    ok = kind & (F.col("_h") == F.col("max_h")) & (F.col("_v") == F.col("max_v"))
    return j.select(
        "image_id", F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("conversion_not_supported").alias("status")
    )


def force_grayscale(comps: DataFrame, status: DataFrame) -> DataFrame:
    """Components of the gray result: component 0 alone, 1 x 1, same quantiser slot. Filter blocks by ``ci = 0``."""
    ready = status.filter("status = 'ok'").select("image_id")
    return comps.filter("ci = 0").join(ready, "image_id", "left_semi").withColumns({"h": F.lit(1), "v": F.lit(1)})


def transpose_components(comps: DataFrame, transform: str | Column = "transform") -> DataFrame:
    """Swap sampling factors where the transform swaps the axes."""
    s = g.swaps_axes(transform)
    return comps.withColumns(
        {"h": F.when(s, F.col("v")).otherwise(F.col("h")), "v": F.when(s, F.col("h")).otherwise(F.col("v"))}
    )


def transpose_qtables(qtables: DataFrame, transform: str | Column = "transform") -> DataFrame:
    """Swap the axes of the quantiser tables where the transform swaps the axes."""
    return qtables.withColumn("q", F.when(g.swaps_axes(transform), fb.swap_axes("q")).otherwise(F.col("q")))


def rotate_pixels(pixels: DataFrame) -> DataFrame:
    """Re-address pixels by the thumbnail rule: flip, then turn clockwise.

    Needs ``x, y, width, height, thumb_flip, thumb_turn`` on the rows.
    """
    w, h, turn = F.col("width"), F.col("height"), F.col("thumb_turn")
    x = F.when(F.col("thumb_flip") == "h", w - 1 - F.col("x")).otherwise(F.col("x"))
    y = F.when(F.col("thumb_flip") == "v", h - 1 - F.col("y")).otherwise(F.col("y"))
    new_x = F.when(turn == 90, h - 1 - y).when(turn == 180, w - 1 - x).when(turn == 270, y).otherwise(x)
    new_y = F.when(turn == 90, x).when(turn == 180, h - 1 - y).when(turn == 270, w - 1 - x).otherwise(y)
    return pixels.withColumns({"x": new_x, "y": new_y})
