"""Catalogue, planning and metadata."""

from pyspark.sql import functions as F

from framelake.functions import geometry as g
from framelake.functions import orientation as o
from framelake.operators import catalog as c
from framelake.operators import metadata as m

from .base import SPLIT, both, register, spark_fx, table

_TAGS = """SELECT i.image_id, CASE WHEN i.tag = 274 THEN 'ifd0' ELSE 'exif' END AS ifd, i.tag AS tag,
 CASE WHEN i.tag IN (41486, 41487) THEN 5 ELSE 3 END AS type, CAST(1 AS BIGINT) AS count,
 CASE i.tag WHEN 274 THEN ARR(CAST(i.exif_orientation AS BIGINT))
  WHEN 37396 THEN CASE WHEN i.image_id % 3 = 0 THEN ARR(i.image_id % 50, i.image_id % 40)
    WHEN i.image_id % 3 = 1 THEN ARR(i.image_id % 50, i.image_id % 40, CAST(9 AS BIGINT))
    ELSE ARR(i.image_id % 50, i.image_id % 40, CAST(7 AS BIGINT), CAST(3 AS BIGINT)) END
  WHEN 41492 THEN ARR(i.image_id % 60, i.image_id % 45)
  WHEN 41486 THEN ARR(CAST(i.p_size AS BIGINT), CAST(1 AS BIGINT))
  WHEN 41487 THEN ARR(CAST(i.p_size + 100 AS BIGINT), CAST(3 AS BIGINT))
  WHEN 40962 THEN ARR(CAST(i.width AS BIGINT)) ELSE ARR(CAST(i.height AS BIGINT)) END AS vals
FROM (SELECT *, EXPL[274, 37396, 41492, 41486, 41487, 40962, 40963] AS tag FROM fx_images) i
 WHERE (tag IN (274, 40962, 40963) OR image_id % 2 = 0) AND (tag <> 41487 OR image_id % 4 = 0)"""
SPLIT["fx_tags"] = both(_TAGS)


def images(spark, d):
    return spark_fx(spark, d, "fx_images")


def tags(spark, d):
    return spark_fx(spark, d, "fx_tags").withColumnRenamed("vals", "values")


EFF = """CASE WHEN exif_orientation BETWEEN 2 AND 8 THEN exif_orientation
 WHEN xmp_orientation BETWEEN 2 AND 8 THEN xmp_orientation ELSE exif_orientation END"""
TRANSFORM = """CASE o WHEN 2 THEN 'flip_h' WHEN 3 THEN 'rot_180' WHEN 4 THEN 'flip_v' WHEN 5 THEN 'transpose'
 WHEN 6 THEN 'rot_90' WHEN 7 THEN 'transverse' WHEN 8 THEN 'rot_270' ELSE 'none' END"""
PLAN = f"""
WITH a AS (SELECT *, {EFF} AS o, CASE WHEN ncomp = 1 THEN 8 ELSE h0*8 END AS mw,
  CASE WHEN ncomp = 1 THEN 8 ELSE v0*8 END AS mh FROM fx_images),
b AS (SELECT *, {TRANSFORM} AS transform, CASE WHEN o BETWEEN 5 AND 8 THEN height ELSE width END AS full_w,
  CASE WHEN o BETWEEN 5 AND 8 THEN width ELSE height END AS full_h,
  CASE WHEN o BETWEEN 5 AND 8 THEN mh ELSE mw END AS unit_w,
  CASE WHEN o BETWEEN 5 AND 8 THEN mw ELSE mh END AS unit_h FROM a),
p AS (SELECT *,
  CASE WHEN trim_ok AND o IN (2, 3, 6, 7) AND full_w >= unit_w THEN full_w - full_w % unit_w ELSE full_w END AS out_w,
  CASE WHEN trim_ok AND o IN (3, 4, 7, 8) AND full_h >= unit_h THEN full_h - full_h % unit_h ELSE full_h END AS out_h,
  CASE WHEN NOT trim_ok AND ((o IN (2, 8) AND width % mw <> 0) OR (o IN (4, 6) AND height % mh <> 0)
    OR (o IN (3, 7) AND (width % mw <> 0 OR height % mh <> 0))) THEN 'cropOptionRequired' END AS perfect_refusal FROM b)
"""


@register("coalesce_orientation", "image_id o:i flips:b", f"""
WITH a AS (SELECT image_id, {EFF} AS o FROM fx_images) SELECT image_id, o, o BETWEEN 5 AND 8 AS flips FROM a""")
def _(s, d):
    return c.with_orientation(images(s, d)).select("image_id", F.col("orientation").alias("o"), o.xy_flips("orientation").alias("flips"))


@register("rotatable", "image_id width height", f"SELECT image_id, width, height FROM fx_images WHERE {EFF} BETWEEN 2 AND 8")
def _(s, d):
    return c.rotatable(images(s, d))


@register("is_perfect", "image_id perfect:b", PLAN + """SELECT image_id, NOT ((o IN (2, 8) AND width % (h0*8) <> 0)
  OR (o IN (4, 6) AND height % (v0*8) <> 0) OR (o IN (3, 7) AND (width % (h0*8) <> 0 OR height % (v0*8) <> 0))) AS perfect FROM p""")
def _(s, d):
    t = o.with_transform(c.with_orientation(images(s, d)))
    return t.withColumn("perfect", g.is_perfect("width", "height", F.col("max_h") * 8, F.col("max_v") * 8, "transform"))


@register("admit_requests", "image_id refusal:s", PLAN + "SELECT image_id, perfect_refusal AS refusal FROM p")
def _(s, d):
    return c.admit(o.with_transform(c.with_orientation(images(s, d))))


@register("with_transform", "image_id transform:s m11 m12 m21 m22 i12 i21 axes_swap:b thumb_flip:s thumb_turn", f"""
WITH a AS (SELECT image_id, {EFF} AS o FROM fx_images)
SELECT image_id, {TRANSFORM} AS transform,
 CASE WHEN o IN (2, 3) THEN -1 WHEN o BETWEEN 5 AND 8 THEN 0 ELSE 1 END AS m11,
 CASE WHEN o IN (5, 6) THEN 1 WHEN o IN (7, 8) THEN -1 ELSE 0 END AS m12,
 CASE WHEN o IN (5, 8) THEN 1 WHEN o IN (6, 7) THEN -1 ELSE 0 END AS m21,
 CASE WHEN o IN (3, 4) THEN -1 WHEN o BETWEEN 5 AND 8 THEN 0 ELSE 1 END AS m22,
 CASE WHEN o IN (5, 8) THEN 1 WHEN o IN (6, 7) THEN -1 ELSE 0 END AS i12,
 CASE WHEN o IN (5, 6) THEN 1 WHEN o IN (7, 8) THEN -1 ELSE 0 END AS i21,
 o BETWEEN 5 AND 8 AS axes_swap,
 CASE WHEN o IN (2, 5) THEN 'h' WHEN o IN (4, 7) THEN 'v' ELSE 'none' END AS thumb_flip,
 CASE WHEN o = 3 THEN 180 WHEN o = 6 THEN 90 WHEN o IN (5, 7, 8) THEN 270 ELSE 0 END AS thumb_turn FROM a""")
def _(s, d):
    return o.with_transform(c.with_orientation(images(s, d)))


@register("flag_readonly", "image_id error:s", "SELECT image_id, CASE WHEN image_id % 17 = 0 THEN 'imageReadOnly' END AS error FROM fx_images")
def _(s, d):
    return c.flag_readonly(images(s, d))


@register("output_geometry", "image_id full_w full_h unit_w unit_h out_w out_h",
          PLAN + "SELECT image_id, full_w, full_h, unit_w, unit_h, out_w, out_h FROM p")
def _(s, d):
    return c.trimmed_geometry(c.output_geometry(o.with_transform(c.with_orientation(images(s, d)))))


@register("rotation_plan", "image_id orientation transform:s out_w out_h trimmed_pixels refusal:s", PLAN + """
SELECT image_id, o AS orientation, transform, out_w, out_h,
 CASE WHEN NOT read_only AND perfect_refusal IS NULL THEN width*height - out_w*out_h END AS trimmed_pixels,
 CASE WHEN read_only THEN 'imageReadOnly' ELSE perfect_refusal END AS refusal FROM p WHERE o BETWEEN 2 AND 8""")
def _(s, d):
    return c.rotation_plan(images(s, d))


@register("rotation_outcomes", "transform:s refusal:s images pixels", PLAN + """
SELECT transform, coalesce(CASE WHEN read_only THEN 'imageReadOnly' ELSE perfect_refusal END, 'none') AS refusal,
 count(*) AS images, sum(width*height) AS pixels FROM p WHERE o BETWEEN 2 AND 8 GROUP BY 1, 2""")
def _(s, d):
    plan = c.rotation_plan(images(s, d)).withColumn("refusal", F.coalesce("refusal", F.lit("none")))
    return plan.groupBy("transform", "refusal").agg(
        F.count("*").alias("images"), F.sum(F.col("width").cast("bigint") * F.col("height")).alias("pixels"))


@register("clean_images", "image_id", PLAN + "SELECT image_id FROM p WHERE NOT read_only AND perfect_refusal IS NULL")
def _(s, d):
    t = c.admit(c.flag_readonly(o.with_transform(c.with_orientation(images(s, d)))))
    return c.clean_images(t, t.filter("refusal IS NOT NULL OR error IS NOT NULL"))


@register("affected_images", "image_id", PLAN + "SELECT image_id FROM p WHERE read_only OR perfect_refusal IS NOT NULL")
def _(s, d):
    t = c.admit(c.flag_readonly(o.with_transform(c.with_orientation(images(s, d)))))
    return c.affected_images(t, t.filter("refusal IS NOT NULL OR error IS NOT NULL"))


# --- metadata ---------------------------------------------------------------------------------------

META = """SELECT image_id, width, height, h0, exif_orientation, xmp_orientation,
 CASE WHEN image_id % 3 = 0 THEN ARR(image_id % 50, image_id % 40) WHEN image_id % 3 = 1 THEN ARR(image_id % 50, image_id % 40, 9)
  ELSE ARR(image_id % 50, image_id % 40, 7, 3) END AS area,
 CASE WHEN image_id % 4 = 0 THEN ARR(image_id % 60, image_id % 45) END AS loc,
 CASE WHEN image_id % 6 < 2 THEN ARR(image_id % 70, 1) END AS fx, CASE WHEN image_id % 6 = 1 THEN ARR(image_id % 80, 2) END AS fy,
 image_id % 7 = 0 AS thumb FROM fx_images"""
SPLIT["fx_meta"] = both(META)
# Where a point goes, by orientation, written out (w, h: rotated size).
POINT_X = "CASE o WHEN 2 THEN w-x WHEN 3 THEN w-x WHEN 5 THEN y WHEN 6 THEN w-y WHEN 7 THEN w-y WHEN 8 THEN y ELSE x END"
POINT_Y = "CASE o WHEN 3 THEN h-y WHEN 4 THEN h-y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN h-x WHEN 8 THEN h-x ELSE y END"
META_SQL = f"""WITH m AS (SELECT *, {EFF} AS o FROM fx_meta),
n AS (SELECT *, CASE WHEN o BETWEEN 5 AND 8 THEN height ELSE width END AS w,
 CASE WHEN o BETWEEN 5 AND 8 THEN width ELSE height END AS h FROM m) """


def meta(s, d):
    t = c.with_orientation(spark_fx(s, d, "fx_meta"))
    w, h = g.output_size("width", "height", F.when(o.xy_flips("orientation"), "transpose").otherwise("none"))
    return t.withColumns({"w": w, "h": h})


@register("needs_repair", "image_id needed:b", META_SQL + """SELECT image_id,
 loc IS NOT NULL OR ((fx IS NOT NULL OR fy IS NOT NULL) AND o BETWEEN 5 AND 8) OR thumb AS needed FROM n""")
def _(s, d):
    return meta(s, d).withColumn("needed", o.needs_repair(F.lit(None), "loc", "fx", "fy", "thumb", "orientation"))


@register("reorient_point", "image_id px py", META_SQL + f"""SELECT image_id, {POINT_X} AS px, {POINT_Y} AS py
 FROM (SELECT *, area[1] AS x, area[2] AS y FROM n)""")
def _(s, d):
    p = meta(s, d).withColumn("p", o.reorient_point(F.col("area")[0], F.col("area")[1], "w", "h", "orientation"))
    return p.select("image_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@register("fix_subject_area", "image_id area:a", META_SQL + f"""SELECT image_id, CASE WHEN len(area) = 4 AND o BETWEEN 5 AND 8
 THEN [{POINT_X}, {POINT_Y}, area[4], area[3]] WHEN len(area) = 4 THEN [{POINT_X}, {POINT_Y}, area[3], area[4]]
 WHEN len(area) = 3 THEN [{POINT_X}, {POINT_Y}, area[3]] ELSE [{POINT_X}, {POINT_Y}] END AS area
 FROM (SELECT *, area[1] AS x, area[2] AS y FROM n)""")
def _(s, d):
    return meta(s, d).withColumn("area", o.fix_subject_area("area", "w", "h", "orientation"))


@register("fix_subject_location", "image_id loc:a", META_SQL + f"""SELECT image_id,
 CASE WHEN x IS NOT NULL THEN [{POINT_X}, {POINT_Y}] END AS loc FROM (SELECT *, loc[1] AS x, loc[2] AS y FROM n)""")
def _(s, d):
    return meta(s, d).withColumn("loc", o.fix_subject_location("loc", "w", "h", "orientation"))


@register("fix_focal_plane", "image_id nx:a ny:a", META_SQL + """SELECT image_id,
 CASE WHEN o BETWEEN 5 AND 8 THEN fy ELSE fx END AS nx, CASE WHEN o BETWEEN 5 AND 8 THEN fx ELSE fy END AS ny FROM n""")
def _(s, d):
    t = meta(s, d).withColumn("p", o.fix_focal_plane("fx", "fy", "orientation"))
    return t.select("image_id", F.col("p.x_res").alias("nx"), F.col("p.y_res").alias("ny"))


@register("reset_orientation", "image_id e x", """SELECT image_id, CASE WHEN exif_orientation > 0 THEN 1 ELSE 0 END AS e,
 CASE WHEN xmp_orientation > 0 THEN 1 ELSE 0 END AS x FROM fx_images""")
def _(s, d):
    return images(s, d).select("image_id", o.reset_orientation("exif_orientation").alias("e"), o.reset_orientation("xmp_orientation").alias("x"))


@register("fix_exif_dims", "image_id tag type vals:a", PLAN + """SELECT t.image_id, t.tag,
 CASE WHEN t.tag IN (40962, 40963) AND (p.out_w <> p.width OR p.out_h <> p.height) THEN 4 ELSE t.type END AS type,
 CASE WHEN t.tag = 40962 THEN [p.out_w] WHEN t.tag = 40963 THEN [p.out_h] ELSE t.vals END AS vals
 FROM fx_tags t JOIN p ON p.image_id = t.image_id""")
def _(s, d):
    plan = c.trimmed_geometry(c.output_geometry(o.with_transform(c.with_orientation(images(s, d)))))
    return m.fix_exif_dims(tags(s, d), plan).withColumnRenamed("values", "vals")


@register("metadata_repair", "image_id tag vals:a", PLAN + f""", q AS (SELECT t.image_id, t.tag, t.vals, p.o, p.out_w AS w,
 p.out_h AS h, vals[1] AS x, vals[2] AS y FROM fx_tags t JOIN p ON p.image_id = t.image_id WHERE p.o BETWEEN 2 AND 8)
SELECT image_id, CASE WHEN o >= 5 AND tag = 41486 THEN 41487 WHEN o >= 5 AND tag = 41487 THEN 41486 ELSE tag END AS tag,
 CASE tag WHEN 274 THEN [CASE WHEN vals[1] = 0 THEN 0 ELSE 1 END] WHEN 40962 THEN [w] WHEN 40963 THEN [h]
  WHEN 41492 THEN [{POINT_X}, {POINT_Y}]
  WHEN 37396 THEN [{POINT_X}, {POINT_Y}] || CASE WHEN len(vals) = 4 AND o >= 5 THEN [vals[4], vals[3]] ELSE vals[3:] END
  ELSE vals END AS vals FROM q""")
def _(s, d):
    return m.metadata_repair(c.rotation_plan(images(s, d)), tags(s, d)).withColumnRenamed("values", "vals")
