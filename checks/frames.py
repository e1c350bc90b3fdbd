"""Geometry, table lookups, scripts and output parameters."""

from pyspark.sql import functions as F

from framelake.functions import geometry as g
from framelake.operators import audit as au
from framelake.operators import frames as fr
from framelake.operators import requests as rq
from framelake.operators import scans as sc

from .base import SPLIT, both, register, spark_fx, spread, table

_PSCANS = """SELECT CAST(o_custkey AS BIGINT) AS image_id, CAST(o_orderkey AS BIGINT) AS seq,
 CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS scan_no,
 CASE WHEN o_orderkey % 5 = 0 THEN ARR(0, 1, 2) WHEN o_orderkey % 41 = 0 THEN ARR(1, 0) ELSE ARR(CAST(o_orderkey % 3 AS INT)) END AS comps,
 CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 6 END AS ss,
 CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN 5 ELSE 63 END AS se,
 CAST(o_orderkey % 3 AS INT) AS ah,
 CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE CAST(o_orderkey % 3 AS INT) - 1 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END END AS al FROM {orders}"""
SPLIT["fx_pscans"] = both(_PSCANS)
_COMPS3 = "SELECT DISTINCT image_id, ci, ci AS tq, ci % 2 + 1 AS h, ci % 3 + 1 AS v FROM fx_scans"
SPLIT["fx_comps3"] = (_COMPS3, _COMPS3)
SPLIT["fx_comps9"] = both("SELECT image_id, ci, ci AS tq FROM (SELECT image_id, EXPL[0, 1, 2, 3] AS ci FROM (SELECT DISTINCT image_id FROM fx_pscans) i) c")


def frames(s, d):
    return spark_fx(s, d, "fx_images").withColumns({"progressive": F.col("image_id") % 3 == 0, "scan_comps": F.when(F.col("image_id") % 4 == 0, 1).otherwise(F.col("ncomp"))})


def comps(s, d):
    return spark_fx(s, d, "fx_components")


def pscans(s, d):
    return spark_fx(s, d, "fx_pscans")


def qtabs(s, d):
    return spark_fx(s, d, "fx_tables").withColumn("q", F.array_repeat("qv", 64))


MAXS = "m AS (SELECT image_id, max(h) AS max_h, max(v) AS max_v FROM fx_components GROUP BY 1)"
GEO = f"""WITH {MAXS}, geo AS (SELECT c.*, i.width, i.height, i.ncomp, max_h, max_v,
 (width*h + max_h*8 - 1) // (max_h*8) AS blocks_w, (height*v + max_v*8 - 1) // (max_v*8) AS blocks_h,
 (width*h + max_h - 1) // max_h AS samples_w, (height*v + max_v - 1) // max_v AS samples_h,
 (height + max_v*8 - 1) // (max_v*8) AS imcu_rows,
 CASE WHEN i.image_id % 4 = 0 THEN ncomp > 1 ELSE FALSE END OR i.image_id % 3 = 0 AS multi_scan
 FROM fx_components c JOIN fx_images i ON i.image_id = c.image_id JOIN m ON m.image_id = c.image_id)"""


@register("max_sampling", "image_id max_h max_v", f"WITH {MAXS} SELECT * FROM m")
def _(s, d):
    return fr.max_sampling(comps(s, d))


@register("component_geometry", "image_id ci blocks_w blocks_h samples_w samples_h imcu_rows multi_scan:b", GEO + "SELECT * FROM geo")
def _(s, d):
    return fr.component_geometry(frames(s, d), comps(s, d))


def two_scans(s, d):
    t = spark_fx(s, d, "fx_images")
    full = F.when(F.col("ncomp") == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return t.select("image_id", F.explode(F.array(F.struct(F.lit(0).alias("scan_no"), full.alias("comps")), F.struct(F.lit(1).alias("scan_no"), F.array(F.lit(0)).alias("comps")))).alias("s")).select("image_id", "s.*")


@register("mcu_geometry", "image_id scan_no ci mcus_per_row mcu_rows mcu_w mcu_h mcu_blocks mcu_sample_w last_col_w last_row_h", GEO + """
, one AS (SELECT *, 0 AS scan_no FROM geo WHERE ncomp = 1 UNION ALL SELECT *, 1 AS scan_no FROM geo WHERE ci = 0)
SELECT image_id, scan_no, ci, blocks_w AS mcus_per_row, blocks_h AS mcu_rows, 1 AS mcu_w, 1 AS mcu_h, 1 AS mcu_blocks, 8 AS mcu_sample_w, 1 AS last_col_w,
 (blocks_h - 1) % v + 1 AS last_row_h FROM one
UNION ALL SELECT image_id, 0, ci, (width + max_h*8 - 1) // (max_h*8), imcu_rows, h, v, h*v, h*8, (blocks_w - 1) % h + 1, (blocks_h - 1) % v + 1 FROM geo WHERE ncomp > 1""")
def _(s, d):
    return fr.mcu_geometry(two_scans(s, d), fr.component_geometry(frames(s, d), comps(s, d)))


@register("mcu_blocks", "image_id scan_no blocks too_many:b", """
SELECT image_id, 0 AS scan_no, CASE WHEN count(*) = 1 THEN 1 ELSE sum(h*v) END AS blocks, count(*) > 1 AND sum(h*v) > 10 AS too_many FROM fx_components GROUP BY 1
UNION ALL SELECT image_id, 1, 1, FALSE FROM fx_images""")
def _(s, d):
    return fr.mcu_blocks(two_scans(s, d), comps(s, d))


@register("needed_components", "image_id ci", "SELECT image_id, ci FROM fx_components WHERE ci = 0")
def _(s, d):
    return fr.needed_components(comps(s, d), "gray")


LATCH = """WITH f AS (SELECT image_id, ci, min(seq) AS at FROM fx_scans GROUP BY 1, 2),
lat AS (SELECT f.image_id, f.ci, f.ci AS tq, (SELECT t.qv FROM fx_tables t WHERE t.image_id = f.image_id AND t.slot = f.ci AND t.seq < f.at ORDER BY t.seq DESC LIMIT 1) AS qv FROM f)"""


@register("latch_qtables", "image_id ci tq qv", LATCH + "SELECT * FROM lat")
def _(s, d):
    t = fr.latch_qtables(spark_fx(s, d, "fx_comps3"), spark_fx(s, d, "fx_scans"), qtabs(s, d), 1000)
    return t.withColumn("qv", F.col("q")[0])


@register("latch_htables", "image_id scan_no cls slot v0", """
WITH s AS (SELECT *, seq AS scan_no FROM fx_scans), w AS (SELECT image_id, scan_no, seq, 0 AS cls, ci AS slot FROM s WHERE ss = 0 AND ah = 0 UNION ALL
 SELECT image_id, scan_no, seq, 1, ci FROM s WHERE se > 0),
t AS (SELECT image_id, seq, CASE WHEN seq % 8 < 4 THEN 0 ELSE 1 END AS cls, slot, qv FROM fx_tables)
SELECT image_id, scan_no, cls, slot, (SELECT t.qv FROM t WHERE t.image_id = w.image_id AND t.cls = w.cls AND t.slot = w.slot AND t.seq < w.seq ORDER BY t.seq DESC LIMIT 1) AS v0 FROM w""")
def _(s, d):
    scans = spark_fx(s, d, "fx_scans").withColumns({"scan_no": F.col("seq"), "comps": F.array(F.struct(F.col("ci").alias("dc"), F.col("ci").alias("ac")))})
    tabs = spark_fx(s, d, "fx_tables").withColumns({"class": F.when(F.col("seq") % 8 < 4, 0).otherwise(1), "bits": F.array("qv"), "vals": F.array("qv")})
    return fr.latch_htables(scans, tabs, 1000).withColumns({"cls": F.col("class"), "v0": F.col("vals")[0]})


@register("slot_mismatch", "image_id ci tq", LATCH + """
SELECT l.image_id, l.ci, l.tq FROM lat l JOIN (SELECT image_id, slot, arg_max(qv, seq) AS fin FROM fx_tables GROUP BY 1, 2) t
 ON t.image_id = l.image_id AND t.slot = l.tq WHERE l.qv <> t.fin""")
def _(s, d):
    c3, q = spark_fx(s, d, "fx_comps3"), qtabs(s, d)
    return au.slot_mismatch(c3, fr.latch_qtables(c3, spark_fx(s, d, "fx_scans"), q), q)


# --- scripts ------------------------------------------------------------------------------------------

SCRIPT = """WITH f AS (SELECT image_id, CASE WHEN image_id % 4 = 0 THEN 3 ELSE 1 + image_id % 6 END AS n, CASE WHEN image_id % 4 = 0 THEN 'ycc' ELSE 'other' END AS cs FROM fx_images),
ycc AS (SELECT * FROM (VALUES (0, [0,1,2], 0, 0, 0, 1), (1, [0], 1, 5, 0, 2), (2, [2], 1, 63, 0, 1), (3, [1], 1, 63, 0, 1), (4, [0], 6, 63, 0, 2),
 (5, [0], 1, 63, 2, 1), (6, [0,1,2], 0, 0, 1, 0), (7, [2], 1, 63, 1, 0), (8, [1], 1, 63, 1, 0), (9, [0], 1, 63, 1, 0)) v(scan_no, comps, ss, se, ah, al)),
pass AS (SELECT * FROM (VALUES (0, 0, 0, 0, 1), (1, 1, 5, 0, 2), (2, 6, 63, 0, 2), (3, 1, 63, 2, 1), (4, 0, 0, 1, 0), (5, 1, 63, 1, 0)) v(p, ss, se, ah, al)),
gen AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY p, c) - 1 AS scan_no, CASE WHEN ss = 0 AND n <= 4 THEN range(n) ELSE [c] END AS comps, ss, se, ah, al
 FROM f JOIN pass ON cs = 'other' JOIN (SELECT unnest(range(6)) AS c) k ON k.c < CASE WHEN ss = 0 AND n <= 4 THEN 1 ELSE n END),
script AS (SELECT image_id, scan_no, comps, ss, se, ah, al FROM f JOIN ycc ON cs = 'ycc' UNION ALL SELECT image_id, scan_no, comps, ss, se, ah, al FROM gen)"""


def script(s, d):
    i = F.col("image_id")
    t = spread(spark_fx(s, d, "fx_images").select("image_id")).select("image_id", F.when(i % 4 == 0, 3).otherwise((1 + i % 6).cast("int")).alias("ncomp"), F.when(i % 4 == 0, "ycc").otherwise("other").alias("color_space"))
    return sc.progressive_script(t)


@register("progressive_script", "image_id scan_no comps:a ss se ah al", SCRIPT + "SELECT * FROM script")
def _(s, d):
    return script(s, d)


@register("reduce_script", "image_id scan_no comps:a ss se ah al", SCRIPT + """
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY scan_no) - 1 AS scan_no, comps, ss, least(se, 3) AS se, ah, al FROM script WHERE ss <= 3""")
def _(s, d):
    return sc.reduce_script(script(s, d), 3, 4)


@register("script_violations", "image_id scan_no issue:s", """
WITH e AS (SELECT image_id, scan_no, ss, ah, al, unnest(comps) AS ci, se FROM fx_pscans),
k AS (SELECT *, unnest(range(ss, se + 1)) AS coef FROM e),
l AS (SELECT *, lag(al) OVER (PARTITION BY image_id, ci, coef ORDER BY scan_no) AS pal FROM k)
SELECT DISTINCT image_id, scan_no, 'bad_bits' AS issue FROM l WHERE (pal IS NULL AND ah <> 0) OR (pal IS NOT NULL AND (ah <> pal OR al <> ah - 1))
UNION ALL SELECT DISTINCT image_id, scan_no, 'ac_before_dc' FROM e WHERE ss > 0 AND NOT EXISTS (SELECT 1 FROM e x WHERE x.image_id = e.image_id AND x.ci = e.ci AND x.ss = 0 AND x.scan_no < e.scan_no)
UNION ALL SELECT image_id, scan_no, 'bad_order' FROM fx_pscans WHERE len(comps) = 2
UNION ALL SELECT image_id, scan_no, 'bad_range' FROM fx_pscans WHERE len(comps) = 2""")
def _(s, d):
    return sc.script_violations(pscans(s, d), 5)


@register("table_issues", "image_id issue:s severity:s", """
WITH e AS (SELECT image_id, scan_no, ss, ah, al, unnest(comps) AS ci, se FROM fx_pscans),
k AS (SELECT *, unnest(range(ss, se + 1)) AS coef FROM e),
l AS (SELECT *, lag(al) OVER (PARTITION BY image_id, ci, coef ORDER BY scan_no) AS pal FROM k),
m AS (SELECT o_custkey AS image_id, o_orderkey % 8 AS number, lag(o_orderkey % 8) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pn FROM orders)
SELECT DISTINCT image_id, 'bad_bits' AS issue, 'error' AS severity FROM l WHERE (pal IS NULL AND ah <> 0) OR (pal IS NOT NULL AND (ah <> pal OR al <> ah - 1))
UNION ALL SELECT DISTINCT image_id, 'ac_before_dc', 'error' FROM e WHERE ss > 0 AND NOT EXISTS (SELECT 1 FROM e x WHERE x.image_id = e.image_id AND x.ci = e.ci AND x.ss = 0 AND x.scan_no < e.scan_no)
UNION ALL SELECT DISTINCT image_id, 'bad_order', 'error' FROM fx_pscans WHERE len(comps) = 2
UNION ALL SELECT DISTINCT image_id, 'bad_range', 'error' FROM fx_pscans WHERE len(comps) = 2
UNION ALL SELECT DISTINCT image_id, 'restart_gap', 'warning' FROM m WHERE number <> coalesce((pn + 1) % 8, 0)""")
def _(s, d):
    markers = table(s, d, "orders").selectExpr("o_custkey AS image_id", "o_orderkey AS seq", "o_orderkey % 8 AS number")
    return au.table_issues(pscans(s, d), markers)


for progressive, rule in ((True, "count(*) FILTER (ss = 0) > 0"), (False, "count(ss) = 1")):
    @register(f"script_coverage_{'progressive' if progressive else 'sequential'}", "image_id ci ok:b", f"""
WITH e AS (SELECT image_id, ss, unnest(comps) AS ci FROM fx_pscans)
SELECT c.image_id, c.ci, {rule} AS ok FROM fx_comps9 c LEFT JOIN e ON e.image_id = c.image_id AND e.ci = c.ci GROUP BY 1, 2""")
    def _(s, d, progressive=progressive):
        return sc.script_coverage(pscans(s, d), spark_fx(s, d, "fx_comps9"), progressive)


ACC = """WITH k AS (SELECT image_id, scan_no, al, ci, unnest(range(ss, se + 1)) AS coef FROM (SELECT *, unnest(comps) AS ci FROM fx_pscans)),
a AS (SELECT image_id, ci, coef, arg_max(al, scan_no) AS al FROM k GROUP BY 1, 2, 3),
acc AS (SELECT c.image_id, c.ci, g.coef, coalesce(a.al, -1) AS al FROM fx_comps9 c JOIN (SELECT unnest(range(64)) AS coef) g ON TRUE LEFT JOIN a ON a.image_id = c.image_id AND a.ci = c.ci AND a.coef = g.coef)"""


@register("coef_accuracy", "image_id ci coef al", ACC + "SELECT * FROM acc")
def _(s, d):
    return sc.coef_accuracy(pscans(s, d), spark_fx(s, d, "fx_comps9"))


@register("smoothing_ok", "image_id smoothing_ok:b", ACC + """
SELECT image_id, bool_and(ok) AND bool_or(inexact) AS smoothing_ok FROM (
 SELECT image_id, ci, min(al) FILTER (coef = 0) >= 0 AND (image_id % 7 <> 0 OR ci <> 1) AS ok, bool_or(coef > 0 AND al <> 0) AS inexact FROM acc WHERE coef <= 5 GROUP BY 1, 2) GROUP BY 1""")
def _(s, d):
    c9 = spark_fx(s, d, "fx_comps9")
    q = F.when((F.col("image_id") % 7 == 0) & (F.col("ci") == 1), F.array_repeat(F.lit(0), 64)).otherwise(F.array_repeat(F.lit(3), 64))
    return sc.smoothing_ok(sc.coef_accuracy(pscans(s, d), c9), c9.withColumn("q", q))


@register("preview_levels", "image_id level label:s", """
SELECT image_id, scan_no AS level, scan_no || '/' || (n - 1) AS label FROM (SELECT *, count(*) OVER (PARTITION BY image_id) AS n FROM fx_pscans) WHERE scan_no % 3 = 0""")
def _(s, d):
    return sc.preview_levels(pscans(s, d))


@register("scan_parameter_issue", "image_id scan_no issue:s", """
SELECT image_id, scan_no, CASE WHEN image_id % 2 = 0 THEN CASE WHEN (ss > 0 AND len(comps) > 1) OR (ah <> 0 AND al <> ah - 1) THEN 'bad_progression' END
 ELSE CASE WHEN ss <> 0 OR ah <> 0 OR al <> 0 OR se <> 63 THEN 'not_sequential' END END AS issue FROM fx_pscans""")
def _(s, d):
    p = F.col("image_id") % 2 == 0
    return pscans(s, d).withColumn("issue", au.scan_parameter_issue(p, ~p, F.size("comps"), "ss", "se", "ah", "al"))


# --- sizes --------------------------------------------------------------------------------------------

ARGS = "SELECT image_id, width, height, 1 + image_id % 20 AS num, 1 + image_id % 9 AS den, 1 + image_id % 16 AS bs FROM fx_images"


@register("scaled_size", "image_id k out_w out_h", f"""
SELECT image_id, k, -((-width * k) // bs) AS out_w, -((-height * k) // bs) AS out_h FROM (
 SELECT a.*, coalesce((SELECT min(n) FROM (SELECT unnest(range(1, 17)) AS n) WHERE a.num * a.bs <= a.den * n), 16) AS k FROM ({ARGS}) a)""".replace("-((-width * k) // bs)", "(width * k + bs - 1) // bs").replace("-((-height * k) // bs)", "(height * k + bs - 1) // bs"))
def _(s, d):
    t = spark_fx(s, d, "fx_images")
    i = F.col("image_id")
    return t.withColumn("r", g.scaled_size("width", "height", 1 + i % 20, 1 + i % 9, 1 + i % 16)).select("image_id", "r.*")


@register("jpeg_size", "image_id ok:b k jpeg_w jpeg_h", f"""
SELECT image_id, w < 16777216 AS ok, k, CASE WHEN w < 16777216 THEN (w * bs + k - 1) // k END AS jpeg_w, CASE WHEN w < 16777216 THEN (height * bs + k - 1) // k END AS jpeg_h FROM (
 SELECT a.*, CASE WHEN image_id % 50 = 0 THEN 16777216 ELSE width END AS w, coalesce((SELECT min(n) FROM (SELECT unnest(range(1, 17)) AS n) WHERE a.num * n >= a.den * a.bs), 16) AS k FROM ({ARGS}) a)""")
def _(s, d):
    i = F.col("image_id")
    t = spark_fx(s, d, "fx_images").withColumn("width", F.when(i % 50 == 0, 2**24).otherwise(F.col("width")))
    return t.withColumn("r", g.jpeg_size("width", "height", 1 + i % 20, 1 + i % 9, 1 + i % 16)).select("image_id", "r.*")


@register("component_scale", "image_id scale_h scale_v", """
WITH a AS (SELECT image_id, 1 + image_id % 4 AS mh, 1 + image_id // 4 % 4 AS mv, 1 + image_id // 16 % 2 AS h, 1 + image_id // 32 % 2 AS v, 1 + image_id // 64 % 9 AS k, CASE WHEN image_id % 5 < 3 THEN 8 ELSE 4 END AS lim FROM fx_images),
b AS (SELECT *, CASE WHEN k <= lim AND mh % (h*2) = 0 THEN CASE WHEN k*2 <= lim AND mh % (h*4) = 0 THEN 4*k ELSE 2*k END ELSE k END AS sh,
 CASE WHEN k <= lim AND mv % (v*2) = 0 THEN CASE WHEN k*2 <= lim AND mv % (v*4) = 0 THEN 4*k ELSE 2*k END ELSE k END AS sv FROM a)
SELECT image_id, CASE WHEN sh > 2*sv THEN 2*sv ELSE sh END AS scale_h, CASE WHEN sv > 2*sh THEN 2*sh ELSE sv END AS scale_v FROM b""")
def _(s, d):
    i = F.col("image_id")
    f = lambda x, m: (1 + F.floor(i / x) % m).cast("int")
    t = spark_fx(s, d, "fx_images").withColumn("r", g.component_scale(f(16, 2), f(32, 2), f(1, 4), f(4, 4), f(64, 9), i % 5 < 3))
    return t.select("image_id", "r.*")


@register("block_size", "image_id n", """
SELECT image_id, CASE WHEN round(sqrt(e + 1)) * round(sqrt(e + 1)) = e + 1 AND e < 256 THEN round(sqrt(e + 1)) END AS n FROM (SELECT image_id, image_id % 300 AS e FROM fx_images)""")
def _(s, d):
    return spark_fx(s, d, "fx_images").withColumn("n", g.block_size_from_limit(F.col("image_id") % 300))


@register("parse_crop", "image_id line w w_state:s h h_state:s x x_state:s y y_state:s", """
SELECT image_id, line, CASE WHEN NOT broken THEN sw END AS w, CASE WHEN broken THEN NULL WHEN w_force THEN 'force' ELSE 'pos' END AS w_state,
 CASE WHEN NOT broken THEN sh END AS h, CASE WHEN broken THEN NULL WHEN h_force THEN 'force' ELSE 'pos' END AS h_state,
 CASE WHEN NOT broken THEN sx END AS x, CASE WHEN NOT broken THEN 'pos' END AS x_state,
 CASE WHEN NOT broken THEN sy END AS y, CASE WHEN broken THEN NULL WHEN y_neg THEN 'neg' ELSE 'pos' END AS y_state FROM fx_crops""")
def _(s, d):
    return spark_fx(s, d, "fx_crops").withColumn("c", g.parse_crop("spec")).select("image_id", "line", "c.*")


_AX = """ CASE WHEN {e} > {n} THEN transform = 'none' AND {o} < {e} AND {o} <= {e} - {n} ELSE {o} < {n} AND {e} > 0 AND {o} <= {n} - {e} END"""
CROP = f"""WITH a AS (SELECT *, CASE WHEN transform = 'rot_90' THEN height ELSE width END AS ow, CASE WHEN transform = 'rot_90' THEN width ELSE height END AS oh FROM fx_crops WHERE NOT broken),
b AS (SELECT *, {_AX.format(e='sw', n='ow', o='sx')} AS okx, {_AX.format(e='sh', n='oh', o='sy')} AS oky,
 CASE WHEN y_neg THEN CASE WHEN sh > oh THEN sh - oh - sy ELSE oh - sh - sy END ELSE sy END AS ry FROM a),
crop AS (SELECT image_id, line, transform, unit, okx AS ok_x, oky AS ok_y,
 CASE WHEN okx THEN CASE WHEN transform = 'wipe' THEN ow WHEN w_force OR sw > ow THEN sw ELSE sw + sx % unit END END AS out_w,
 CASE WHEN oky THEN CASE WHEN transform = 'wipe' THEN oh WHEN h_force OR sh > oh THEN sh ELSE sh + ry % unit END END AS out_h,
 CASE WHEN okx THEN sx // unit END AS ux, CASE WHEN oky THEN ry // unit END AS uy,
 CASE WHEN okx AND transform = 'wipe' THEN (sw + sx % unit + unit - 1) // unit END AS wipe_w,
 CASE WHEN oky AND transform = 'wipe' THEN (sh + ry % unit + unit - 1) // unit END AS wipe_h FROM b)"""


@register("resolve_crop", "image_id line status:s ok_x:b ok_y:b out_w out_h ux uy wipe_w wipe_h", CROP + """SELECT image_id, line, CASE WHEN ok_x AND ok_y THEN 'ok' ELSE 'refused' END AS status, ok_x, ok_y, out_w, out_h, ux, uy, wipe_w, wipe_h FROM crop
UNION ALL SELECT image_id, line, 'bad_request', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM fx_crops WHERE broken""")
def _(s, d):
    ow, oh = g.output_size("width", "height", "transform")
    t = spark_fx(s, d, "fx_crops").withColumns({"full_w": ow, "full_h": oh, "unit_w": F.col("unit"), "unit_h": F.col("unit")})
    t = rq.resolve_crop(t).withColumn("status", rq.crop_status())
    return t.withColumnsRenamed({"x_off": "ux", "y_off": "uy"})


# --- output parameters ----------------------------------------------------------------------------------


@register("default_components", "image_id target_space:s ci component_id h v tq entropy write_jfif:b write_adobe:b", """
WITH f AS (SELECT image_id, CASE image_id % 5 WHEN 0 THEN 'gray' WHEN 1 THEN 'ycc' WHEN 2 THEN 'ycc' WHEN 3 THEN 'cmyk' ELSE 'ycck' END AS sp FROM fx_images),
t AS (SELECT * FROM (VALUES ('gray', 0, 1), ('ycc', 0, 1), ('ycc', 1, 2), ('ycc', 2, 3), ('cmyk', 0, 67), ('cmyk', 1, 77), ('cmyk', 2, 89), ('cmyk', 3, 75), ('ycck', 0, 1), ('ycck', 1, 2), ('ycck', 2, 3), ('ycck', 3, 4)) v(sp, ci, id))
SELECT image_id, sp AS target_space, ci, id AS component_id, CASE WHEN sp LIKE 'ycc%' AND ci IN (0, 3) THEN 2 ELSE 1 END AS h, CASE WHEN sp LIKE 'ycc%' AND ci IN (0, 3) THEN 2 ELSE 1 END AS v,
 CASE WHEN sp LIKE 'ycc%' AND ci IN (1, 2) THEN 1 ELSE 0 END AS tq, CASE WHEN sp LIKE 'ycc%' AND ci IN (1, 2) THEN 1 ELSE 0 END AS entropy,
 sp IN ('gray', 'ycc') AS write_jfif, sp IN ('cmyk', 'ycck') AS write_adobe FROM f JOIN t USING (sp)""")
def _(s, d):
    t = spark_fx(s, d, "fx_images").select("image_id", F.expr("CASE image_id % 5 WHEN 0 THEN 'gray' WHEN 1 THEN 'ycc' WHEN 2 THEN 'rgb' WHEN 3 THEN 'cmyk' ELSE 'ycck' END AS color_space"))
    return fr.with_default_components(t, from_rgb=True)


@register("sof_type", "image_id sof", """
SELECT image_id, CASE WHEN image_id % 5 = 0 THEN CASE WHEN image_id % 2 = 0 THEN 202 ELSE 201 END WHEN image_id % 2 = 0 THEN 194
 WHEN image_id % 7 = 0 OR image_id % 11 = 0 OR image_id % 3 = 2 OR width > 255 THEN 193 ELSE 192 END AS sof FROM fx_images""")
def _(s, d):
    i = F.col("image_id")
    return spark_fx(s, d, "fx_images").withColumn("sof", fr.sof_type(i % 5 == 0, i % 2 == 0, F.when(i % 7 == 0, 12).otherwise(8), F.when(i % 11 == 0, 4).otherwise(8), i % 3, "width"))


@register("carry_parameters", "image_id ci component_id h v tq entropy out_major out_minor out_unit out_x out_y", """
SELECT c.image_id, ci, ci + 1 AS component_id, h, v, tq, CASE WHEN ci > 0 AND c.image_id % 2 = 0 THEN 1 ELSE 0 END AS entropy,
 CASE WHEN c.image_id % 3 = 0 AND c.image_id % 4 IN (1, 2) THEN c.image_id % 4 ELSE 1 END AS out_major, CASE WHEN c.image_id % 3 = 0 AND c.image_id % 4 IN (1, 2) THEN 2 ELSE 1 END AS out_minor,
 CASE WHEN c.image_id % 3 = 0 THEN 2 ELSE 0 END AS out_unit, CASE WHEN c.image_id % 3 = 0 THEN width ELSE 1 END AS out_x, CASE WHEN c.image_id % 3 = 0 THEN height ELSE 1 END AS out_y
FROM fx_components c JOIN fx_images i ON i.image_id = c.image_id""")
def _(s, d):
    f = spark_fx(s, d, "fx_images").selectExpr("image_id", "CASE WHEN image_id % 2 = 0 THEN 'ycc' ELSE 'unknown' END AS color_space", "image_id % 3 = 0 AS saw_jfif", "image_id % 4 AS major",
                                               "2 AS minor", "2 AS unit", "width AS x_density", "height AS y_density")
    return fr.carry_parameters(f, comps(s, d).withColumn("component_id", F.col("ci") + 1))


@register("dqt_precision", "image_id slot bits", "SELECT o_custkey AS image_id, o_orderkey % 4 AS slot, CASE WHEN max(1 + o_orderkey % 60) * 5 > 255 THEN 16 ELSE 8 END AS bits FROM orders GROUP BY 1, 2")
def _(s, d):
    rows = table(s, d, "orders").selectExpr("o_custkey AS image_id", "o_orderkey % 4 AS slot", "1 + o_orderkey % 60 AS qv")
    return fr.dqt_precision(rows.withColumn("q", F.array_repeat(F.col("qv") * 5, 64)))
