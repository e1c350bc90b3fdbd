"""Coefficient block transforms."""

from pyspark.sql import functions as F

from framelake.functions import blocks as fb
from framelake.functions import orders
from framelake.functions import orientation as o
from framelake.operators import blocks as bl

from .base import SPLIT, register, spark_fx

# Two kinds of images: one component of 5 x 4 blocks (37 x 29 samples), and three components with 2 x 2 luma
# (29 x 27 samples, so one of two whole units along each axis).
_ALL = """SELECT image_id, ci, by_, bx, coef, 1 AS h, 1 AS v, 37 AS width, 29 AS height, 1 AS ncomp, 1 AS max_h, 1 AS max_v FROM fx_blocks
UNION ALL SELECT image_id + 1000000, ci, by_, bx, coef, h, v, 29, 27, 3, 2, 2 FROM fx_mblocks"""
SPLIT["fx_planned"] = (_ALL, _ALL)


def planned(s, d):
    return spark_fx(s, d, "fx_planned")


# transform: axes swap, mirrored in x, mirrored in y
RULES = {"flip_h": (0, 1, 0), "flip_v": (0, 0, 1), "transpose": (1, 0, 0), "transverse": (1, 1, 1),
         "rot_90": (1, 1, 0), "rot_180": (0, 1, 1), "rot_270": (1, 0, 1)}


def turned(name: str, source: str) -> str:
    swap, mx, my = RULES[name]
    tx, ty = ("by_", "bx") if swap else ("bx", "by_")
    size_x, size_y = ("height", "width") if swap else ("width", "height")
    at = "i % 8 * 8 + i // 8 + 1" if swap else "i + 1"
    sign_x = "CASE WHEN inx AND i % 2 = 1 THEN -1 ELSE 1 END" if mx else "1"
    sign_y = "CASE WHEN iny AND i // 8 % 2 = 1 THEN -1 ELSE 1 END" if my else "1"
    x = "CASE WHEN inx THEN mc - 1 - tx ELSE tx END" if mx else "tx"
    y = "CASE WHEN iny THEN mr - 1 - ty ELSE ty END" if my else "ty"
    return f"""SELECT image_id, ci, {y} AS by_, {x} AS bx, list_transform(range(64), lambda i: coef[{at}] * {sign_x} * {sign_y}) AS coef,
 h, v, mc, mr FROM (SELECT *, tx < mc AS inx, ty < mr AS iny FROM (SELECT *, {tx} AS tx, {ty} AS ty,
 {size_x} // (8*max_h) * h AS mc, {size_y} // (8*max_v) * v AS mr FROM {source}))"""


for _name in RULES:
    @register(f"block_{_name}", "image_id ci by_ bx coef:a", turned(_name, "fx_planned"))
    def _(s, d, name=_name):
        return getattr(bl, name)(planned(s, d)).withColumnRenamed("by", "by_")


@register("block_wipe", "image_id ci by_ bx coef:a", """
SELECT image_id, ci, by_, bx, CASE WHEN CASE WHEN ncomp = 1 THEN bx IN (1, 2) AND by_ IN (2, 3) ELSE bx >= h AND by_ >= 0 AND by_ < v END
 THEN list_transform(coef, lambda c: 0) ELSE coef END AS coef FROM fx_planned""")
def _(s, d):
    single = F.col("ncomp") == 1
    t = planned(s, d).withColumns({"x_off": F.lit(1), "y_off": F.when(single, 2).otherwise(0), "wipe_w": F.when(single, 2).otherwise(1), "wipe_h": F.when(single, 2).otherwise(1)})
    return bl.wipe(t).withColumnRenamed("by", "by_")


@register("block_crop", "image_id ci by_ bx coef:a", """
SELECT image_id, ci, CASE WHEN ncomp = 1 THEN by_ - 1 ELSE by_ END AS by_, CASE WHEN ncomp = 1 THEN bx - 2 ELSE bx - h END AS bx, coef FROM fx_planned
WHERE CASE WHEN ncomp = 1 THEN bx IN (2, 3) AND by_ IN (1, 2) WHEN ci = 0 THEN bx = 2 AND by_ < 4 ELSE bx = 1 END""")
def _(s, d):
    single = F.col("ncomp") == 1
    t = planned(s, d).withColumns({"x_off": F.when(single, 2).otherwise(1), "y_off": F.when(single, 1).otherwise(0),
                                   "out_w": F.when(single, 15).otherwise(8), "out_h": F.when(single, 16).otherwise(27)})
    return bl.crop(t).withColumnRenamed("by", "by_")


# Larger in x only: 37 -> 70 samples at offset 2, rows 1 and 2 kept.
@register("block_crop_extend", "image_id ci by_ bx coef:a", """
WITH ids AS (SELECT DISTINCT image_id FROM fx_blocks),
grid AS (SELECT image_id, y AS by_, x AS bx FROM ids, (SELECT unnest(range(2)) AS y), (SELECT unnest(range(9)) AS x)),
src AS (SELECT image_id, by_ - 1 AS by_, bx + 2 AS bx, coef FROM fx_blocks WHERE by_ IN (1, 2) AND bx < 4)
SELECT g.image_id, 0 AS ci, g.by_, g.bx, coalesce(s.coef, list_transform(range(64), lambda i: CAST(0 AS INT))) AS coef
FROM grid g LEFT JOIN src s ON s.image_id = g.image_id AND s.by_ = g.by_ AND s.bx = g.bx
WHERE s.coef IS NOT NULL OR NOT (g.bx BETWEEN 2 AND 5)""")
def _(s, d):
    extra = {"x_off": F.lit(2), "y_off": F.lit(1), "out_w": F.lit(70), "out_h": F.lit(16)}
    rows = planned(s, d).filter("ncomp = 1")
    plan = rows.drop("by", "bx", "coef").distinct().withColumns(extra)
    return bl.crop_extend(rows.withColumns(extra), plan).withColumnRenamed("by", "by_")


# All images of both kinds, a third of each larger in x, in y and in both; an axis that doesn't grow is cut at the offset (whole units).
# Sizes in blocks: 8 x 8 units for one component; 16 x 16 units with h x v blocks of a component for three.
_GROW = {"gx": "key % 3 <> 1", "gy": "key % 3 <> 0", "off_x": "CASE WHEN ncomp = 1 THEN 1 + key % 3 ELSE key % 2 END", "off_y": "CASE WHEN ncomp = 1 THEN key % 3 ELSE (key + 1) % 2 END"}
_GROW_W = "CASE WHEN gx THEN 50 + key % 40 WHEN ncomp = 1 THEN 12 ELSE 13 END"
_GROW_H = "CASE WHEN gy THEN 45 + key % 30 WHEN ncomp = 1 THEN 9 ELSE 11 END"


@register("block_crop_extend_all", "image_id ci by_ bx coef:a", f"""
WITH comps AS (SELECT DISTINCT image_id, ci, h, v, ncomp, 8 * max_h AS uw, 8 * max_v AS uh, image_id % 1000000 AS key, width // (8 * max_h) * h AS mc, height // (8 * max_v) * v AS mr FROM fx_planned),
asked AS (SELECT *, {_GROW['gx']} AS gx, {_GROW['gy']} AS gy, ({_GROW['off_x']}) * h AS ox, ({_GROW['off_y']}) * v AS oy FROM comps),
sized AS (SELECT *, (({_GROW_W}) * h + uw - 1) // uw AS wide, (({_GROW_H}) * v + uh - 1) // uh AS high FROM asked),
col AS (SELECT *, unnest(range(wide)) AS bx FROM sized),
grid AS (SELECT *, unnest(range(high)) AS by_ FROM col),
moved AS (SELECT *, CASE WHEN gx THEN bx - ox ELSE bx + ox END AS sx, CASE WHEN gy THEN by_ - oy ELSE by_ + oy END AS sy FROM grid),
kept AS (SELECT *, (NOT gx OR (sx >= 0 AND sx < mc)) AND (NOT gy OR (sy >= 0 AND sy < mr)) AS source FROM moved)
SELECT g.image_id, g.ci, g.by_, g.bx, CASE WHEN source THEN s.coef ELSE list_transform(range(64), lambda i: CAST(0 AS INT)) END AS coef
FROM kept g LEFT JOIN fx_planned s ON s.image_id = g.image_id AND s.ci = g.ci AND s.by_ = g.sy AND s.bx = g.sx WHERE NOT source OR s.coef IS NOT NULL""")
def _(s, d):
    def asked(t):
        t = t.withColumn("key", F.col("image_id") % 1000000)
        t = t.withColumns({n: F.expr(e) for n, e in _GROW.items()})
        return t.withColumns({"x_off": F.col("off_x"), "y_off": F.col("off_y"), "out_w": F.expr(_GROW_W), "out_h": F.expr(_GROW_H)})

    rows = planned(s, d)
    return bl.crop_extend(asked(rows), asked(rows.drop("by", "bx", "coef").distinct())).withColumnRenamed("by", "by_")


_CASES = list(RULES)
PLANNED_AS = "CASE image_id % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_CASES)) + " END"
ROTATED = "WITH " + ", ".join(f"src_{t} AS (SELECT * FROM fx_planned WHERE image_id % 7 = {i})" for i, t in enumerate(_CASES)) + ", rot AS (" + \
    " UNION ALL ".join(turned(t, f"src_{t}") for t in _CASES) + ")"


@register("rotate_blocks", "image_id ci by_ bx coef:a", ROTATED + " SELECT * FROM rot WHERE bx < mc AND by_ < mr")
def _(s, d):
    rows = planned(s, d).drop("height", "width", "ncomp", "max_h", "max_v", "h", "v")
    plan = planned(s, d).drop("by", "bx", "coef").distinct().withColumn("transform", F.expr(PLANNED_AS))
    swap = F.col("transform").isin("transpose", "transverse", "rot_90", "rot_270")
    unit = F.col("max_h") * 8
    plan = plan.withColumns({"x_off": F.lit(0), "y_off": F.lit(0), "out_w": F.when(swap, F.col("height")).otherwise(F.col("width")),
                             "out_h": F.when(swap, F.col("width")).otherwise(F.col("height"))})
    whole = lambda c: F.col(c) - F.col(c) % unit
    return bl.rotate_blocks(rows, plan.withColumns({"out_w": whole("out_w"), "out_h": whole("out_h")})).withColumnRenamed("by", "by_")


@register("low_frequency", "image_id by_ bx coef:a", """
SELECT image_id, by_, bx, list_transform(range(64), lambda i: CASE WHEN i % 8 < 3 AND i < 24 THEN coef[i + 1] ELSE 0 END) AS coef FROM fx_blocks""")
def _(s, d):
    return bl.low_frequency(spark_fx(s, d, "fx_blocks"), 3).withColumnRenamed("by", "by_")


@register("grayscale_status", "image_id status:s", """
SELECT image_id, CASE WHEN image_id % 3 <> 0 AND (ncomp = 1 OR image_id % 4 <> 0) THEN 'ok' ELSE 'conversion_not_supported' END AS status FROM fx_images""")
def _(s, d):
    f = spark_fx(s, d, "fx_images").withColumns({"color_space": F.expr("CASE WHEN ncomp = 1 THEN 'gray' WHEN image_id % 4 = 0 THEN 'rgb' ELSE 'bg_ycc' END"),
                                                 "max_h": F.when(F.col("image_id") % 3 == 0, 4).otherwise(F.col("h0")), "max_v": F.col("v0")})
    return bl.grayscale_status(f, spark_fx(s, d, "fx_components"))


@register("force_grayscale", "image_id ci h v tq", "SELECT image_id, 0 AS ci, 1 AS h, 1 AS v, 0 AS tq FROM fx_images WHERE image_id % 5 <> 1")
def _(s, d):
    status = spark_fx(s, d, "fx_images").select("image_id", F.expr("CASE WHEN image_id % 5 = 1 THEN 'no' ELSE 'ok' END AS status"))
    return bl.force_grayscale(spark_fx(s, d, "fx_components"), status)


@register("transpose_components", "image_id ci h v", """
SELECT image_id, ci, CASE WHEN image_id % 2 = 0 THEN v ELSE h END AS h, CASE WHEN image_id % 2 = 0 THEN h ELSE v END AS v FROM fx_components""")
def _(s, d):
    return bl.transpose_components(spark_fx(s, d, "fx_components").withColumn("transform", F.expr("CASE WHEN image_id % 2 = 0 THEN 'rot_90' ELSE 'flip_h' END")))


@register("transpose_qtables", "image_id by_ bx q:a", """
SELECT image_id, by_, bx, list_transform(range(64), lambda i: coef[CASE WHEN image_id % 2 = 0 THEN i % 8 * 8 + i // 8 ELSE i END + 1]) AS q FROM fx_blocks""")
def _(s, d):
    t = spark_fx(s, d, "fx_blocks").withColumnRenamed("coef", "q").withColumn("transform", F.expr("CASE WHEN image_id % 2 = 0 THEN 'transpose' ELSE 'rot_180' END"))
    return bl.transpose_qtables(t).withColumnRenamed("by", "by_")


@register("rotate_pixels", "image_id x y v", """
WITH a AS (SELECT *, 2 + image_id % 7 AS o, 40 AS w, 32 AS h FROM fx_samples)
SELECT image_id, v, CASE o WHEN 2 THEN w-1-x WHEN 3 THEN w-1-x WHEN 5 THEN y WHEN 6 THEN h-1-y WHEN 7 THEN h-1-y WHEN 8 THEN y ELSE x END AS x,
 CASE o WHEN 3 THEN h-1-y WHEN 4 THEN h-1-y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN w-1-x WHEN 8 THEN w-1-x ELSE y END AS y FROM a""")
def _(s, d):
    t = spark_fx(s, d, "fx_samples").withColumns({"orientation": (2 + F.col("image_id") % 7).cast("int"), "width": F.lit(40), "height": F.lit(32)})
    return bl.rotate_pixels(o.with_transform(t))


# The scan order of a block.
ZZ = "[1,2,9,17,10,3,4,11,18,25,33,26,19,12,5,6,13,20,27,34,41,49,42,35,28,21,14,7,8,15,22,29,36,43,50,57,58,51,44,37,30,23,16,24,31,38,45,52,59,60,53,46,39,32,40,47,54,61,62,55,48,56,63,64]"


@register("to_zigzag", "image_id by_ bx coef:a", f"SELECT image_id, by_, bx, list_transform({ZZ}, lambda p: coef[p]) AS coef FROM fx_blocks")
def _(s, d):
    return spark_fx(s, d, "fx_blocks").withColumn("coef", orders.to_zigzag("coef")).withColumnRenamed("by", "by_")


@register("to_natural", "image_id by_ bx coef:a small:a", f"""
SELECT image_id, by_, bx, list_transform(range(1, 65), lambda p: coef[list_position({ZZ}, p)]) AS coef,
 list_transform(range(1, 65), lambda p: coalesce(coef[list_position([1,2,9,17,10,3,11,18,19], p)], 0)) AS small FROM fx_blocks""")
def _(s, d):
    return spark_fx(s, d, "fx_blocks").withColumns({"small": orders.to_natural("coef", 3), "coef": orders.to_natural("coef")}).withColumnRenamed("by", "by_")


@register("point_transform", "image_id by_ bx coef:a bit", f"""
SELECT image_id, by_, bx, list_transform({ZZ}, lambda p: CASE WHEN p = 1 THEN CAST(floor(coef[1] / 4.0) AS INT) ELSE CAST(trunc(coef[p] / 4.0) AS INT) END) AS coef,
 CAST(floor(coef[1] / 2.0) AS BIGINT) & 1 AS bit FROM fx_blocks""")
def _(s, d):
    return spark_fx(s, d, "fx_blocks").withColumns({"bit": fb.dc_refinement("coef", 1), "coef": fb.point_transform("coef", 0, 63, 2)}).withColumnRenamed("by", "by_")
