"""Header bytes. The input is assembled from `part`; the SQL twins compute the expected fields from `part` directly."""

import uuid

from pyspark.sql import functions as F

from framelake.functions import headers as hf
from framelake.functions import orientation as o
from framelake.operators import audit as au
from framelake.operators import catalog as c
from framelake.operators import headers as hd
from framelake.plans import jobs

from framelake.session import checkpoint_dir
from framelake.sources import ranges

from .base import register, spark_fx, spread, table

_ZEROS = "".join("%02X" % v for v in (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0))
_DC = "".join("%02X" % v for v in range(12))
HEX4 = "lpad(hex(CAST({0} AS BIGINT)), 4, '0')"
HEX2 = "lpad(hex(CAST({0} AS BIGINT)), 2, '0')"


def _h4(e):
    return HEX4.format(e)


def _h2(e):
    return HEX2.format(e)


def _le2(e):
    return f"concat({_h2(f'({e}) % 256')}, {_h2(f'CAST(floor(({e}) / 256.0) AS BIGINT)')})"


# TIFF part: byte order, mark, first directory with orientation and sub-directory pointer, sub-directory with
# width and a four-value subject area kept behind it.
_TIFF_BE = f"""concat('4D4D002A00000008', '0002', '0112', '0003', '00000001', {_h4('exif_orientation')}, '0000',
 '8769', '0004', '00000001', '00000026', '00000000',
 '0002', 'A002', '0004', '00000001', '0000', {_h4('width')}, '9214', '0003', '00000004', '00000044', '00000000',
 {_h4('image_id % 50')}, {_h4('image_id % 40')}, '0007', '0003')"""
_TIFF_LE = f"""concat('49492A0008000000', '0200', '1201', '0300', '01000000', {_le2('exif_orientation')}, '0000',
 '6987', '0400', '01000000', '26000000', '00000000',
 '0200', '02A0', '0400', '01000000', {_le2('width')}, '0000', '1492', '0300', '04000000', '44000000', '00000000',
 {_le2('image_id % 50')}, {_le2('image_id % 40')}, '0700', '0300')"""
# 8 + 2 + 24 + 4 + 2 + 24 + 4 + 8 = 76 bytes; with prefix 6 and length 2: 84.
_PARTS = f"""'FFD8',
 CASE WHEN image_id % 3 = 0 THEN concat('FFE00010', '4A46494600', {_h2('image_id % 4')}, '01', '01', {_h4('72 + image_id % 9')}, '0048', '00', {_h2('CASE WHEN image_id % 6 = 0 THEN 1 ELSE 0 END')}) ELSE '' END,
 CASE WHEN image_id % 2 = 0 THEN concat('FFE1', '0054', '457869660000', CASE WHEN image_id % 4 = 0 THEN {_TIFF_LE} ELSE {_TIFF_BE} END) ELSE '' END,
 CASE WHEN image_id % 11 = 0 THEN concat('FFE1003D', hex('http://ns.adobe.com/xap/1.0/'), '00', hex(concat('<x tiff:Orientation="', CAST(xmp_orientation AS STRING), '" a=""/>'))) ELSE '' END,
 CASE WHEN image_id % 7 = 0 THEN '00ABFF00FFFF' ELSE '' END,
 'FFDB0043', {_h2('CASE WHEN image_id % 23 = 0 THEN 5 ELSE 0 END')}, repeat_hex,
 CASE WHEN image_id % 13 = 0 THEN 'FFDB000B0101020304050607FF' ELSE '' END,
 CASE WHEN image_id % 29 = 0 THEN '' ELSE concat(CASE WHEN image_id % 6 = 0 THEN 'FFC2' ELSE 'FFC0' END,
  CASE WHEN ncomp = 1 THEN '000B' ELSE '0011' END, {_h2('CASE WHEN image_id % 31 = 0 THEN 7 ELSE 8 END')}, {_h4('height')}, {_h4('width')}, {_h2('ncomp')}, '01', {_h2('h0*16 + v0')}, '00',
  CASE WHEN ncomp = 1 THEN '' ELSE CASE WHEN image_id % 37 = 0 THEN '221101231101' ELSE '021101031101' END END) END,
 'FFC4001F00', '{_ZEROS}', '{_DC}',
 CASE WHEN image_id % 8 = 0 THEN concat('FFDD0004', {_h4('image_id % 100')}) ELSE '' END,
 CASE WHEN image_id % 9 = 0 THEN concat('FFEE000E', '41646F6265', '0064', '0001', '0002', {_h2('image_id % 4')}) ELSE '' END,
 CASE WHEN image_id % 10 = 0 THEN 'FFFE0005616263' ELSE '' END,
 CASE WHEN image_id % 41 = 0 THEN concat('FFF80018', '0D00FF03', '02', '01', CASE WHEN image_id % 2 = 0 THEN '03' ELSE '07' END, '800000000000000100000000010000') ELSE '' END,
 'FFDA', CASE WHEN ncomp = 1 THEN '000801010000' ELSE '000C03010002110311000000' END, CASE WHEN ncomp = 1 THEN '3F00' ELSE '' END,
 'FF0012FFD034FFD9'"""
# The three-component scan header carries Ss=0, Se=0, Ah=Al=0 (fits progressive DC only); the other Ss=0, Se=63.


def files(s, d):
    """fx_headers: one small image file per part, plus one that is not an image."""
    base = spread(spark_fx(s, d, "fx_images"))
    values = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex((F.col("image_id") + i) % 255 + 1), 2, "0")), "")
    text = F.expr(f"concat({_PARTS})")
    made = base.withColumn("repeat_hex", values).withColumn("content", F.unhex(text))
    broken = F.when(F.col("image_id") % 97 == 0, F.lit(b"GIF89a")).otherwise(F.col("content"))
    # Files of a real folder are spread over the tasks, too; the source table may be a single Parquet row group, so its rows are dealt
    # out before the files are made. The outer generator keeps later filters from making the content again in front of it.
    return made.select(*base.columns, F.explode_outer(F.array(broken)).alias("content"))


def segs(s, d):
    return hd.segments(files(s, d).select("image_id", "content"))


OK = "image_id % 97 <> 0"
HAS_SOF = f"{OK} AND image_id % 29 <> 0"
# Expected segments in file order: (order, marker, payload bytes, present, bytes in front that are skipped)
EXPECT = f"""
seg AS (
 SELECT image_id, 0 AS ord, 216 AS marker, -2 AS len, 0 AS junk, 0 AS lost FROM fx_images
 UNION ALL SELECT image_id, 1, 224, 16, 0, 0 FROM fx_images WHERE image_id % 3 = 0
 UNION ALL SELECT image_id, 2, 225, 84, 0, 0 FROM fx_images WHERE image_id % 2 = 0
 UNION ALL SELECT image_id, 3, 225, 61, 0, 0 FROM fx_images WHERE image_id % 11 = 0
 UNION ALL SELECT image_id, 4, 219, 67, CASE WHEN image_id % 7 = 0 THEN 6 ELSE 0 END, CASE WHEN image_id % 7 = 0 THEN 4 ELSE 0 END FROM fx_images
 UNION ALL SELECT image_id, 5, 219, 11, 0, 0 FROM fx_images WHERE image_id % 13 = 0
 UNION ALL SELECT image_id, 6, CASE WHEN image_id % 6 = 0 THEN 194 ELSE 192 END, CASE WHEN ncomp = 1 THEN 11 ELSE 17 END, 0, 0 FROM fx_images WHERE image_id % 29 <> 0
 UNION ALL SELECT image_id, 7, 196, 31, 0, 0 FROM fx_images
 UNION ALL SELECT image_id, 8, 221, 4, 0, 0 FROM fx_images WHERE image_id % 8 = 0
 UNION ALL SELECT image_id, 9, 238, 14, 0, 0 FROM fx_images WHERE image_id % 9 = 0
 UNION ALL SELECT image_id, 10, 254, 5, 0, 0 FROM fx_images WHERE image_id % 10 = 0
 UNION ALL SELECT image_id, 11, 248, 24, 0, 0 FROM fx_images WHERE image_id % 41 = 0
 UNION ALL SELECT image_id, 12, 218, CASE WHEN ncomp = 1 THEN 8 ELSE 12 END, 0, 0 FROM fx_images),
segx AS (SELECT image_id, ord, row_number() OVER w - 1 AS seq, marker, CASE WHEN len > 0 THEN len END AS length, lost AS discarded,
 CASE WHEN ord = 0 THEN 0 ELSE sum(len + 2 + junk) OVER w - len - 2 + 2 END AS offset_ FROM seg WHERE {OK}
 WINDOW w AS (PARTITION BY image_id ORDER BY ord))"""


@register("split_jpeg", "image_id ok:b", "SELECT image_id, image_id % 97 <> 0 AS ok FROM fx_images")
def _(s, d):
    good, bad = c.split_jpeg(files(s, d))
    return good.select("image_id", F.lit(True).alias("ok")).unionByName(bad.select("image_id", F.lit(False).alias("ok")))


@register("segments", "image_id seq marker offset_ length discarded", f"""WITH {EXPECT}
SELECT image_id, seq, marker, offset_, length, discarded FROM segx""")
def _(s, d):
    return segs(s, d).withColumnRenamed("offset", "offset_")


# Files on disk: every fiftieth image has two application segments of the greatest length behind its start, so that its headers are over
# 128 KB; every twentieth has 100 KB of coded data behind them.
_PAD = "X'FFE2FFFF', encode(repeat('p', 65533), 'ISO-8859-1')"
_BIG = f"if(image_id % 50 = 0 AND image_id % 97 <> 0, concat(X'FFD8', {_PAD}, {_PAD}, substring(content, 3)), content)"


def written(s, d):
    """The files of fx_headers in a new folder that executors share, four subfolders deep at most."""
    folder = f"{checkpoint_dir(s)}/headers-{uuid.uuid4().hex}"
    rows = files(s, d).select("image_id", F.expr(_BIG).alias("content"))

    def write(batches):
        where, inner, _ = ranges.store(folder)
        for batch in batches:
            for i, content in zip(batch["image_id"].to_pylist(), batch["content"].to_pylist()):
                at = f"{inner}/{i % 3}/{i % 7}"
                where.create_dir(at, recursive=True)
                with where.open_output_stream(f"{at}/{i}.{'JPG' if i % 2 else 'jpeg'}") as out:
                    out.write(content + (bytes(range(256)) * 400 if i % 20 == 0 else b""))
            yield batch.select(["image_id"])

    rows.mapInArrow(write, "image_id long").count()
    return folder


@register("headers_from_ranges", "image_id seq marker offset_ length discarded", f"""WITH {EXPECT},
big AS (SELECT image_id FROM fx_images WHERE image_id % 50 = 0 AND {OK})
SELECT image_id, CASE WHEN seq > 0 AND image_id % 50 = 0 THEN seq + 2 ELSE seq END AS seq, marker,
 CASE WHEN seq > 0 AND image_id % 50 = 0 THEN offset_ + 131074 ELSE offset_ END AS offset_, length, discarded FROM segx
UNION ALL SELECT image_id, 1, 226, 2, 65535, 0 FROM big UNION ALL SELECT image_id, 2, 226, 65539, 65535, 0 FROM big""")
def _(s, d):
    found = ranges.scan_headers(s, written(s, d), recursive=True)
    name = F.regexp_extract("image_id", r"(\d+)\.\w+$", 1).cast("long")
    return hd.segments(found.withColumn("image_id", name)).withColumnRenamed("offset", "offset_")


@register("frames", "image_id width height ncomp precision baseline:b progressive:b", f"""
SELECT image_id, width, height, ncomp, CASE WHEN image_id % 31 = 0 THEN 7 ELSE 8 END AS precision, image_id % 6 <> 0 AS baseline,
 image_id % 6 = 0 AS progressive FROM fx_images WHERE {HAS_SOF}""")
def _(s, d):
    return hd.frames(segs(s, d))


@register("components", "image_id ci component_id h v tq", f"""
SELECT c.image_id, c.ci, CASE WHEN c.ci > 0 AND c.image_id % 37 = 0 THEN 33 + c.ci ELSE c.ci + 1 END AS component_id, c.h, c.v, c.tq
FROM fx_components c WHERE c.{HAS_SOF.replace('AND ', 'AND c.')}""")
def _(s, d):
    return hd.components(hd.frames(segs(s, d)))


@register("scan_headers", "image_id ncomp ss se ah al ids:a", f"""
SELECT image_id, ncomp, 0 AS ss, CASE WHEN ncomp = 1 THEN 63 ELSE 0 END AS se, 0 AS ah, 0 AS al,
 CASE WHEN ncomp = 1 THEN [1] ELSE [1, 2, 3] END AS ids FROM fx_images WHERE {OK}""")
def _(s, d):
    return hd.scans(segs(s, d)).withColumn("ids", F.transform("comps", lambda x: x["component_id"]))


# The scan order of a block.
ZZ = "[0,1,5,6,14,15,27,28,2,4,7,13,16,26,29,42,3,8,12,17,25,30,41,43,9,11,18,24,31,40,44,53,10,19,23,32,39,45,52,54,20,22,33,38,46,51,55,60,21,34,37,47,50,56,59,61,35,36,48,49,57,58,62,63]"


@register("qtables", "image_id slot precision q:a", f"""
SELECT image_id, CASE WHEN image_id % 23 = 0 THEN 5 ELSE 0 END AS slot, 8 AS precision,
 list_transform({ZZ}, lambda z: (image_id + z) % 255 + 1) AS q FROM fx_images WHERE {OK}
UNION ALL
SELECT image_id, 1 AS slot, 8 AS precision, [1,2,6,7,1,1,1,1,3,5,255,1,1,1,1,1,4,1,1,1,1,1,1,1] || list_transform(range(40), lambda z: 1) AS q
FROM fx_images WHERE {OK} AND image_id % 13 = 0""".replace("[1,2,6,7,1,1,1,1,3,5,255,1,1,1,1,1,4,1,1,1,1,1,1,1]", "[1,2,6,7,1,1,1,1,3,5,255,1,1,1,1,1,4,1,1,1,1,1,1,1]"))
def _(s, d):
    return hd.qtables(segs(s, d))


@register("htables", "image_id cls slot bits:a vals:a", f"""
SELECT image_id, 0 AS cls, 0 AS slot, [0,1,5,1,1,1,1,1,1,0,0,0,0,0,0,0] AS bits, range(12) AS vals FROM fx_images WHERE {OK}""")
def _(s, d):
    return hd.htables(segs(s, d)).withColumnRenamed("class", "cls")


@register("restart_intervals", "image_id restart", f"SELECT image_id, image_id % 100 AS restart FROM fx_images WHERE {OK} AND image_id % 8 = 0")
def _(s, d):
    return hd.restart_intervals(segs(s, d))


@register("jfif_fields", "image_id kind:s major minor unit x_density y_density bad_version:b bad_thumbnail:b", f"""
SELECT image_id, 'jfif' AS kind, image_id % 4 AS major, 1 AS minor, 1 AS unit, 72 + image_id % 9 AS x_density, 72 AS y_density,
 image_id % 4 IN (0, 3) AS bad_version, FALSE AS bad_thumbnail FROM fx_images WHERE {OK} AND image_id % 3 = 0""")
def _(s, d):
    return hd.jfif(segs(s, d))


@register("adobe_fields", "image_id version flags0 flags1 transform", f"""
SELECT image_id, 100 AS version, 1 AS flags0, 2 AS flags1, image_id % 4 AS transform FROM fx_images WHERE {OK} AND image_id % 9 = 0""")
def _(s, d):
    return hd.adobe(segs(s, d))


@register("colour_transforms", "image_id subtract_green:b", f"""
SELECT image_id, ncomp = 3 AND image_id % 2 = 0 AND image_id % 37 <> 0 AND image_id % 29 <> 0 AS subtract_green
FROM fx_images WHERE {OK} AND image_id % 41 = 0""")
def _(s, d):
    t = segs(s, d)
    return hd.colour_transforms(t, hd.frames(t))


TIFF_AT = "(2 + CASE WHEN image_id % 3 = 0 THEN 18 ELSE 0 END + 10)"


@register("exif_tags", "image_id ifd:s tag type count value_offset vals:a", f"""
SELECT image_id, 'ifd0' AS ifd, 274 AS tag, 3 AS type, 1 AS count, {TIFF_AT} + 18 AS value_offset, [CAST(exif_orientation AS BIGINT)] AS vals FROM fx_images WHERE {OK} AND image_id % 2 = 0
UNION ALL SELECT image_id, 'ifd0', 34665, 4, 1, {TIFF_AT} + 30, [38] FROM fx_images WHERE {OK} AND image_id % 2 = 0
UNION ALL SELECT image_id, 'exif', 40962, 4, 1, {TIFF_AT} + 48, [width] FROM fx_images WHERE {OK} AND image_id % 2 = 0
UNION ALL SELECT image_id, 'exif', 37396, 3, 4, {TIFF_AT} + 68, [image_id % 50, image_id % 40, 7, 3] FROM fx_images WHERE {OK} AND image_id % 2 = 0""")
def _(s, d):
    return hd.exif_tags(segs(s, d)).withColumnRenamed("values", "vals")


@register("xmp_orientation", "image_id xmp_orientation", f"SELECT image_id, xmp_orientation FROM fx_images WHERE {OK} AND image_id % 11 = 0")
def _(s, d):
    return hd.xmp_orientations(segs(s, d))


@register("exif_first", "image_id exif_first:b", f"""
SELECT image_id, image_id % 3 <> 0 AND image_id % 2 = 0 AS exif_first FROM fx_images
WHERE {OK} AND (image_id % 3 = 0 OR image_id % 2 = 0 OR image_id % 11 = 0 OR image_id % 9 = 0 OR image_id % 10 = 0)""")
def _(s, d):
    return hd.exif_first(segs(s, d))


@register("keep_markers", "option:s marker n", f"""WITH {EXPECT}
SELECT 'all' AS option, marker, count(*) AS n FROM segx WHERE marker BETWEEN 224 AND 239 OR marker = 254 GROUP BY marker
UNION ALL SELECT 'comments', marker, count(*) FROM segx WHERE marker = 254 GROUP BY marker""")
def _(s, d):
    t = segs(s, d)
    parts = [hd.keep_markers(t, k).groupBy("marker").agg(F.count("*").alias("n")).withColumn("option", F.lit(k)) for k in ("all", "comments", "none")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("drop_rewritten", "image_id seq marker", f"""WITH {EXPECT}
SELECT x.image_id, seq, marker FROM segx x JOIN fx_images i ON i.image_id = x.image_id
WHERE NOT (marker = 224 AND i.ncomp = 3) AND NOT (marker = 238 AND i.ncomp = 1)""")
def _(s, d):
    flags = spark_fx(s, d, "fx_images").select("image_id", (F.col("ncomp") == 3).alias("write_jfif"), (F.col("ncomp") == 1).alias("write_adobe"))
    return hd.drop_rewritten(segs(s, d), flags)


@register("infer_colorspace", "image_id space:s warning:b", """
SELECT image_id, CASE n WHEN 1 THEN 'gray' WHEN 4 THEN CASE WHEN t IS NULL OR t = 0 THEN 'cmyk' ELSE 'ycck' END
 WHEN 3 THEN CASE a WHEN 0 THEN 'ycc' WHEN 1 THEN 'bg_ycc' WHEN 2 THEN 'rgb' WHEN 3 THEN 'bg_rgb'
  ELSE CASE WHEN j THEN 'ycc' WHEN t = 0 THEN 'rgb' ELSE 'ycc' END END ELSE 'unknown' END AS space,
 (n = 4 AND t IS NOT NULL AND t NOT IN (0, 2)) IS TRUE OR (n = 3 AND a = 4 AND NOT j AND t IS NOT NULL AND t NOT IN (0, 1)) IS TRUE AS warning
FROM (SELECT image_id, 1 + image_id % 5 AS n, image_id % 7 % 5 AS a, image_id % 3 = 0 AS j, CASE WHEN image_id % 4 > 0 THEN image_id % 11 % 4 END AS t FROM fx_images)""")
def _(s, d):
    i = F.col("image_id")
    a = i % 7 % 5
    ids = F.when(a == 0, F.expr("array(1,2,3)")).when(a == 1, F.expr("array(1,34,35)")).when(a == 2, F.expr("array(82,71,66)")).when(a == 3, F.expr("array(114,103,98)")).otherwise(F.expr("array(9,9,9)"))
    t = spark_fx(s, d, "fx_images").select("image_id", (1 + i % 5).alias("n"), ids.alias("ids"), (i % 3 == 0).alias("j"), F.when(i % 4 > 0, i % 11 % 4).alias("t"))
    return t.withColumn("g", hd.infer_colorspace("n", "ids", "j", "t")).select("image_id", "g.*")


@register("patch_orientation", "image_id patched:x", """
SELECT image_id, CASE WHEN image_id % 2 = 0 THEN 'AA' || CASE WHEN image_id % 4 = 0 THEN '0100' ELSE '0001' END || 'BBCC' ELSE 'AA0006BBCC' END AS patched FROM fx_images""")
def _(s, d):
    t = spark_fx(s, d, "fx_images").withColumn("content", F.unhex(F.lit("AA0006BBCC")))
    at = F.when(F.col("image_id") % 2 == 0, F.lit(1)).otherwise(F.lit(9))
    return t.withColumn("patched", o.patch_orientation("content", at, F.col("image_id") % 4 != 0))


@register("patched_files", "image_id orientation", f"SELECT image_id, CASE WHEN image_id % 2 = 1 OR exif_orientation = 0 THEN 0 ELSE 1 END AS orientation FROM fx_images WHERE {OK}")
def _(s, d):
    """Reset the tag in the bytes, then read the new bytes."""
    turned = jobs.upright_files(files(s, d).select("image_id", "content"))
    return hd.image_headers(turned).withColumnRenamed("exif_orientation", "orientation")


@register("image_headers", "image_id width height ncomp max_h max_v exif_orientation xmp_orientation color_space:s has_exif_first:b", f"""
SELECT image_id, CASE WHEN image_id % 29 <> 0 THEN width END AS width, CASE WHEN image_id % 29 <> 0 THEN height END AS height,
 CASE WHEN image_id % 29 <> 0 THEN ncomp END AS ncomp, CASE WHEN image_id % 29 <> 0 THEN h0 END AS max_h, CASE WHEN image_id % 29 <> 0 THEN v0 END AS max_v,
 CASE WHEN image_id % 2 = 0 THEN exif_orientation ELSE 0 END AS exif_orientation,
 CASE WHEN image_id % 11 = 0 THEN xmp_orientation ELSE 0 END AS xmp_orientation,
 CASE WHEN image_id % 29 = 0 THEN 'unknown' WHEN ncomp = 1 THEN 'gray' WHEN image_id % 37 = 0 THEN 'bg_ycc' ELSE 'ycc' END AS color_space,
 image_id % 3 <> 0 AND image_id % 2 = 0 AS has_exif_first FROM fx_images WHERE {OK}""")
def _(s, d):
    return hd.image_headers(files(s, d).select("image_id", "content"))


# --- audit ------------------------------------------------------------------------------------------


@register("frame_issues", "image_id issue:s", f"SELECT image_id, 'bad_precision' AS issue FROM fx_images WHERE {HAS_SOF} AND image_id % 31 = 0")
def _(s, d):
    return au.frame_issues(hd.frames(segs(s, d)))


@register("frame_checks", "image_id issue:s", """
WITH a AS (SELECT image_id, image_id % 19 * 4000 AS w, image_id % 13 * 6000 AS h, image_id % 12 AS n, 6 + image_id % 9 AS p, image_id % 7 AS hs, 8 + 3 * (image_id % 12) + image_id % 2 AS len FROM fx_images)
SELECT image_id, 'empty_image' AS issue FROM a WHERE w = 0 OR h = 0 OR n = 0 UNION ALL SELECT image_id, 'too_big' FROM a WHERE w > 65500 OR h > 65500
UNION ALL SELECT image_id, 'bad_precision' FROM a WHERE p < 8 OR p > 12 UNION ALL SELECT image_id, 'component_count' FROM a WHERE n > 10
UNION ALL SELECT image_id, 'bad_sampling' FROM a WHERE hs NOT IN (1, 2, 3, 4) UNION ALL SELECT image_id, 'bad_frame_length' FROM a WHERE image_id % 2 = 1""")
def _(s, d):
    t = spark_fx(s, d, "fx_images").selectExpr("image_id", "image_id % 19 * 4000 AS width", "image_id % 13 * 6000 AS height", "image_id % 12 AS ncomp", "6 + image_id % 9 AS precision",
                                               "array(named_struct('h', image_id % 7, 'v', 1)) AS components", "8 + 3 * (image_id % 12) + image_id % 2 AS length")
    return au.frame_issues(t)


@register("structure_issues", "image_id issue:s", f"""
SELECT image_id, 'sos_before_sof' AS issue FROM fx_images WHERE {OK} AND image_id % 29 = 0
UNION ALL SELECT image_id, 'dqt_slot' FROM fx_images WHERE {OK} AND image_id % 23 = 0""")
def _(s, d):
    return au.structure_issues(segs(s, d))


@register("structure_checks", "image_id issue:s", """
WITH a AS (SELECT o_custkey AS image_id, o_orderkey AS seq, CASE o_orderkey % 11 WHEN 0 THEN 192 WHEN 1 THEN 218 WHEN 2 THEN 216 WHEN 3 THEN 221 WHEN 4 THEN 195 WHEN 5 THEN 5 ELSE 254 END AS m FROM orders),
g AS (SELECT image_id, count(*) FILTER (m = 192) AS f, count(*) FILTER (m = 218) AS c, count(*) FILTER (m = 216) AS i, min(seq) FILTER (m = 192) AS af, min(seq) FILTER (m = 218) AS ac,
 bool_or(m = 221 AND seq % 2 = 0) AS dri, bool_or(m = 195) AS u, bool_or(m = 5) AS r, bool_or(seq % 17 = 0 AND m <> 216) AS l, bool_or(m = 218) AS s FROM a GROUP BY 1)
SELECT image_id, 'sof_duplicate' AS issue FROM g WHERE f > 1 UNION ALL SELECT image_id, 'soi_duplicate' FROM g WHERE i > 1
UNION ALL SELECT image_id, 'sos_before_sof' FROM g WHERE c > 0 AND (af IS NULL OR af > ac) UNION ALL SELECT image_id, 'sof_without_sos' FROM g WHERE c = 0 AND f > 0
UNION ALL SELECT image_id, 'no_image' FROM g WHERE c = 0 AND f = 0 UNION ALL SELECT image_id, 'dri_length' FROM g WHERE dri
UNION ALL SELECT image_id, 'unsupported_frame' FROM g WHERE u UNION ALL SELECT image_id, 'reserved_marker' FROM g WHERE r
UNION ALL SELECT image_id, 'bad_length' FROM g WHERE l UNION ALL SELECT image_id, 'sos_length' FROM g WHERE s""")
def _(s, d):
    t = table(s, d, "orders").selectExpr("o_custkey AS image_id", "o_orderkey AS seq", "CASE o_orderkey % 11 WHEN 0 THEN 192 WHEN 1 THEN 218 WHEN 2 THEN 216 WHEN 3 THEN 221 WHEN 4 THEN 195 WHEN 5 THEN 5 ELSE 254 END AS marker",
                                         "CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 5 END AS length", "CASE WHEN o_orderkey % 2 = 0 THEN X'010203' ELSE X'0102' END AS payload")
    return au.structure_issues(t)


@register("scan_issues", "image_id issue:s severity:s", f"""
SELECT image_id, CASE WHEN image_id % 6 = 0 THEN 'bad_progression' ELSE 'not_sequential' END AS issue,
 CASE WHEN image_id % 6 = 0 THEN 'error' ELSE 'warning' END AS severity FROM fx_images
WHERE {HAS_SOF} AND ((image_id % 6 = 0 AND ncomp = 1) OR (image_id % 6 <> 0 AND ncomp = 3))""")
def _(s, d):
    t = segs(s, d)
    return au.scan_issues(hd.scans(t), hd.frames(t))


@register("missing_tables", "image_id ci", f"""
SELECT image_id, ci FROM fx_components WHERE {HAS_SOF} AND ((ci = 0 AND image_id % 23 = 0) OR (ci > 0 AND image_id % 13 <> 0))""")
def _(s, d):
    t = segs(s, d)
    return au.missing_tables(hd.components(hd.frames(t)), hd.qtables(t))


_AUDIT = f"""
SELECT image_id, 'bad_precision' AS issue, 'error' AS severity FROM fx_images WHERE {HAS_SOF} AND image_id % 31 = 0
UNION ALL SELECT image_id, 'sos_before_sof', 'error' FROM fx_images WHERE {OK} AND image_id % 29 = 0
UNION ALL SELECT image_id, 'dqt_slot', 'error' FROM fx_images WHERE {OK} AND image_id % 23 = 0
UNION ALL SELECT image_id, 'bad_progression', 'error' FROM fx_images WHERE {HAS_SOF} AND image_id % 6 = 0 AND ncomp = 1
UNION ALL SELECT image_id, 'not_sequential', 'warning' FROM fx_images WHERE {HAS_SOF} AND image_id % 6 <> 0 AND ncomp = 3
UNION ALL SELECT DISTINCT image_id, 'missing_table', 'error' FROM fx_components WHERE {HAS_SOF} AND ((ci = 0 AND image_id % 23 = 0) OR (ci > 0 AND image_id % 13 <> 0))
UNION ALL SELECT image_id, 'jfif_version', 'warning' FROM fx_images WHERE {OK} AND image_id % 3 = 0 AND image_id % 4 IN (0, 3)"""


@register("corpus_audit", "image_id issue:s severity:s", _AUDIT)
def _(s, d):
    return au.corpus_audit(segs(s, d))


@register("resync_action", "found expected action n", """
WITH a AS (SELECT o_orderkey % 256 AS found, o_custkey % 8 AS expected FROM orders)
SELECT found, expected, CASE WHEN found < 192 THEN 2 WHEN found < 208 OR found > 215 THEN 3
 WHEN found - 208 IN ((expected + 1) % 8, (expected + 2) % 8) THEN 3 WHEN found - 208 IN ((expected + 7) % 8, (expected + 6) % 8) THEN 2 ELSE 1 END AS action, count(*) AS n
FROM a GROUP BY 1, 2, 3""")
def _(s, d):
    t = table(s, d, "orders").selectExpr("o_orderkey % 256 AS found", "o_custkey % 8 AS expected")
    return t.withColumn("action", au.resync_action("found", "expected")).groupBy("found", "expected", "action").agg(F.count("*").alias("n"))


@register("restart_gaps", "image_id seq number expected", """
WITH a AS (SELECT o_custkey AS image_id, o_orderkey AS seq, o_orderkey % 8 AS number FROM orders),
b AS (SELECT *, coalesce((lag(number) OVER (PARTITION BY image_id ORDER BY seq) + 1) % 8, 0) AS expected FROM a)
SELECT * FROM b WHERE number <> expected""")
def _(s, d):
    return au.restart_gaps(table(s, d, "orders").selectExpr("o_custkey AS image_id", "o_orderkey AS seq", "o_orderkey % 8 AS number"), 1000)


@register("fix_component_ids", "image_id ci component_id", """
WITH a AS (SELECT image_id, CASE image_id % 4 WHEN 0 THEN [1, 2, 3] WHEN 1 THEN [5, 6, 6] WHEN 2 THEN [4, 4, 5] ELSE [1, 1, 1] END AS ids FROM fx_images)
SELECT image_id, unnest([0, 1, 2]) AS ci, unnest(ids) AS component_id FROM a""".replace("[5, 6, 6]", "[5, 6, 7]").replace("[4, 4, 5]", "[4, 5, 6]").replace("[1, 1, 1]", "[1, 2, 3]"))
def _(s, d):
    t = spark_fx(s, d, "fx_images").selectExpr("image_id", """transform(CASE image_id % 4 WHEN 0 THEN array(1, 2, 3) WHEN 1 THEN array(5, 6, 6)
      WHEN 2 THEN array(4, 4, 5) ELSE array(1, 1, 1) END, x -> named_struct('component_id', x)) AS components""")
    return au.fix_component_ids(t)


@register("scan_components", "image_id seq place component_id ci dc ac", f"""
WITH {EXPECT}, scan_at AS (SELECT image_id, seq FROM segx WHERE marker = 218),
named AS (SELECT i.image_id, i.ncomp, unnest(range(CASE WHEN i.ncomp = 1 THEN 1 ELSE 3 END)) AS place FROM fx_images i WHERE i.{OK})
SELECT n.image_id, a.seq, n.place, n.place + 1 AS component_id,
 CASE WHEN n.image_id % 29 <> 0 AND (n.place = 0 OR n.image_id % 37 <> 0) THEN n.place END AS ci,
 CASE WHEN n.place > 0 THEN 1 ELSE 0 END AS dc, CASE WHEN n.place > 0 THEN 1 ELSE 0 END AS ac FROM named n JOIN scan_at a USING (image_id)""")
def _(s, d):
    t = segs(s, d)
    return au.scan_components(hd.scans(t), hd.frames(t))


# The files define the table of class 0, slot 0 only; scans of three components stop at the first coefficient.
@register("missing_huffman", "image_id scan_no class slot", f"""
SELECT image_id, 0 AS scan_no, CASE WHEN ncomp = 1 THEN 1 ELSE 0 END AS class, CASE WHEN ncomp = 1 THEN 0 ELSE 1 END AS slot FROM fx_images WHERE {OK}""")
def _(s, d):
    t = segs(s, d)
    return au.missing_huffman(hd.scans(t).withColumn("scan_no", F.lit(0)), hd.htables(t), hd.frames(t))


@register("issue_log", "image_id issue:s severity:s", f"""SELECT * FROM ({_AUDIT}) a
UNION ALL SELECT image_id, 'missing_huffman', 'error' FROM fx_images WHERE {OK}
UNION ALL SELECT image_id, 'bad_component_id', 'error' FROM fx_images WHERE {HAS_SOF} AND image_id % 37 = 0 AND ncomp = 3
UNION ALL SELECT image_id, 'discarded_bytes', 'warning' FROM fx_images WHERE {OK} AND image_id % 7 = 0""")
def _(s, d):
    return au.issue_log(segs(s, d))
