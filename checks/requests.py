"""Composed requests: crop, transform, trim and gray together."""

from pyspark.sql import functions as F

from framelake.operators import requests as rq

from .base import SHARED, register, spark_fx
from .blocks import planned

TRANSFORMS = ["none", "flip_h", "flip_v", "transpose", "transverse", "rot_90", "rot_180", "rot_270", "wipe"]
_CASE = "CASE {0} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TRANSFORMS)) + " END"
# Requests of five kinds: none, offsets only, sizes only, and twice all parts; some cannot be read.
SHARED["fx_requests"] = f"""
SELECT image_id, line, width, height, sw, sh, sx, sy, y_neg, broken, line % 5 AS kind,
 w_force, h_force, CASE WHEN sx % 4 = 0 THEN 1 ELSE 3 END AS ncomp, CAST(1 + sw % 2 AS INT) AS max_h, CAST(1 + sh % 2 AS INT) AS max_v,
 CAST(CASE WHEN sx % 17 = 3 THEN 1 ELSE 1 + sw % 2 END AS INT) AS luma_h, CAST(1 + sh % 2 AS INT) AS luma_v,
 CASE WHEN sx % 4 = 0 THEN 'gray' WHEN sx % 13 = 1 THEN 'rgb' WHEN sx % 3 = 0 THEN 'bg_ycc' ELSE 'ycc' END AS color_space,
 {_CASE.format('(sx + sy + line) % 9')} AS transform, (sw + line) % 3 <> 0 AS trim, (sh + line) % 11 = 0 AS perfect, sw % 5 = 0 AS gray,
 CASE WHEN line % 5 = 0 AND NOT broken THEN NULL WHEN line % 5 = 1 AND NOT broken THEN concat('+', CAST(sx AS STRING), CASE WHEN y_neg THEN '-' ELSE '+' END, CAST(sy AS STRING))
  WHEN line % 5 = 2 AND NOT broken THEN concat(CAST(sw AS STRING), CASE WHEN w_force THEN 'f' ELSE '' END, 'x', CAST(sh AS STRING), CASE WHEN h_force THEN 'F' ELSE '' END)
  ELSE spec END AS spec FROM fx_crops"""


def resolved(source: str) -> str:
    """The plan of requests: each step of the rules as one query. Sizes that ``kind`` leaves out are unset."""
    return f"""
q1 AS (SELECT *, CASE WHEN gray AND ncomp = 3 AND color_space IN ('ycc', 'bg_ycc') THEN 1 ELSE ncomp END AS oc,
 kind IN (2, 3, 4) AS has_size, kind IN (1, 3, 4) AS has_off, transform IN ('transpose', 'transverse', 'rot_90', 'rot_270') AS swap,
 transform IN ('flip_h', 'rot_90', 'rot_180', 'transverse') AS mx, transform IN ('flip_v', 'rot_180', 'rot_270', 'transverse') AS my FROM {source}),
q2 AS (SELECT *, CASE WHEN oc = 1 THEN 8 ELSE 8 * max_h END AS su, CASE WHEN oc = 1 THEN 8 ELSE 8 * max_v END AS sv,
 CASE WHEN has_off THEN sx ELSE 0 END AS ax, CASE WHEN has_off THEN sy ELSE 0 END AS ay, has_off AND y_neg AS neg FROM q1),
q3 AS (SELECT *, CASE WHEN swap THEN height ELSE width END AS fw, CASE WHEN swap THEN width ELSE height END AS fh,
 CASE WHEN swap THEN sv ELSE su END AS uw, CASE WHEN swap THEN su ELSE sv END AS uh,
 (transform NOT IN ('flip_h', 'rot_270', 'transverse', 'rot_180') OR width % su = 0) AND (transform NOT IN ('flip_v', 'rot_90', 'transverse', 'rot_180') OR height % sv = 0) AS whole FROM q2),
q4 AS (SELECT *, CASE WHEN has_size THEN sw ELSE fw - ax END AS ew, CASE WHEN has_size THEN sh ELSE fh - ay END AS eh, has_size AND sw > fw AS gx, has_size AND sh > fh AS gy FROM q3),
q5 AS (SELECT *, CASE WHEN gx THEN transform = 'none' AND ax <= ew - fw ELSE ax < fw AND ew > 0 AND ax + ew <= fw END AS okx,
 CASE WHEN gy THEN transform = 'none' AND ay <= eh - fh ELSE ay < fh AND eh > 0 AND ay + eh <= fh END AS oky,
 CASE WHEN NOT neg THEN ay WHEN gy THEN eh - fh - ay ELSE fh - eh - ay END AS ry FROM q4),
q6 AS (SELECT *, CASE WHEN transform = 'wipe' THEN fw WHEN gx OR (has_size AND w_force) THEN ew ELSE ew + ax % uw END AS cw,
 CASE WHEN transform = 'wipe' THEN fh WHEN gy OR (has_size AND h_force) THEN eh ELSE eh + ry % uh END AS ch,
 CASE WHEN broken THEN 'bad_request' WHEN perfect AND NOT whole THEN 'cropOptionRequired' WHEN NOT (okx AND oky) THEN 'refused'
  WHEN gray AND NOT ((ncomp = 1 AND color_space = 'gray' OR oc < ncomp) AND luma_h = max_h AND luma_v = max_v) THEN 'conversion_not_supported' ELSE 'ok' END AS status FROM q5),
plan AS (SELECT *, CASE WHEN status = 'ok' THEN oc END AS out_ncomp,
 CASE WHEN status = 'ok' THEN CASE WHEN trim AND mx AND cw >= uw AND ax // uw + cw // uw = fw // uw THEN cw - cw % uw ELSE cw END END AS out_w,
 CASE WHEN status = 'ok' THEN CASE WHEN trim AND my AND ch >= uh AND ry // uh + ch // uh = fh // uh THEN ch - ch % uh ELSE ch END END AS out_h,
 CASE WHEN status = 'ok' THEN ax // uw END AS x_off, CASE WHEN status = 'ok' THEN ry // uh END AS y_off,
 CASE WHEN status = 'ok' AND transform = 'wipe' THEN (ew + ax % uw + uw - 1) // uw END AS wipe_w,
 CASE WHEN status = 'ok' AND transform = 'wipe' THEN (eh + ry % uh + uh - 1) // uh END AS wipe_h FROM q6)"""


@register("plan_requests", "image_id line transform:s status:s out_ncomp out_w out_h x_off y_off wipe_w wipe_h", f"""WITH {resolved('fx_requests')}
SELECT image_id, line, transform, status, out_ncomp, out_w, out_h, x_off, y_off, wipe_w, wipe_h FROM plan""")
def _(s, d):
    return rq.plan_requests(spark_fx(s, d, "fx_requests"))


# Three requests for each image: without a crop; cut, turned and gray; and larger than the image.
_KEY = "image_id % 1000000"
_REQ = f"""SELECT image_id, width, height, ncomp, max_h, max_v, request, max_h AS luma_h, max_v AS luma_v,
 CASE WHEN ncomp = 1 THEN 'gray' ELSE 'ycc' END AS color_space, CASE WHEN request = 0 THEN 0 ELSE 3 END AS kind, FALSE AS broken,
 CASE WHEN request = 2 THEN 'none' ELSE {_CASE.format(f'({_KEY} + 4 * request) % 9')} END AS transform, request = 0 OR {_KEY} % 2 = 0 AS trim, FALSE AS perfect, request = 1 AND {_KEY} % 3 = 0 AS gray,
 request = 1 AND {_KEY} % 4 = 0 AS w_force, FALSE AS h_force, {_KEY} % 2 = 1 AS y_neg,
 CASE WHEN request = 1 THEN 10 + {_KEY} % 9 ELSE 50 + {_KEY} % 30 END AS sw, CASE WHEN request = 1 THEN 9 + {_KEY} % 7 WHEN {_KEY} % 3 = 0 THEN 20 ELSE 60 + {_KEY} % 20 END AS sh,
 {_KEY} % 12 AS sx, {_KEY} % 8 AS sy FROM (SELECT DISTINCT image_id, width, height, ncomp, max_h, max_v FROM fx_planned) i CROSS JOIN (SELECT 0 AS request UNION ALL SELECT 1 UNION ALL SELECT 2) r"""


@register("rotate_requests", "image_id request ci by_ bx coef:a", f"""WITH req AS ({_REQ}), {resolved('req')},
comps AS (SELECT DISTINCT image_id, ci, h, v FROM fx_planned),
per AS (SELECT p.*, c.ci, CASE WHEN oc = 1 THEN 1 WHEN swap THEN c.v ELSE c.h END AS dh, CASE WHEN oc = 1 THEN 1 WHEN swap THEN c.h ELSE c.v END AS dv
 FROM plan p JOIN comps c ON c.image_id = p.image_id WHERE p.status = 'ok' AND (oc > 1 OR c.ci = 0)),
wide AS (SELECT *, unnest(range((out_w * dh + uw - 1) // uw)) AS bx FROM per),
grid AS (SELECT *, unnest(range((out_h * dv + uh - 1) // uh)) AS by_ FROM wide),
moved AS (SELECT *, fw // uw * dh AS mc, fh // uh * dv AS mr, transform = 'wipe' AS wiped,
 CASE WHEN transform = 'wipe' THEN bx WHEN out_w > fw THEN bx - x_off * dh ELSE bx + x_off * dh END AS tx,
 CASE WHEN transform = 'wipe' THEN by_ WHEN out_h > fh THEN by_ - y_off * dv ELSE by_ + y_off * dv END AS ty FROM grid),
from_ AS (SELECT *, (out_w > fw AND NOT (tx >= 0 AND tx < mc)) OR (out_h > fh AND NOT (ty >= 0 AND ty < mr)) AS empty_, mx AND tx < mc AS fx_, my AND ty < mr AS fy_,
 wiped AND bx >= x_off * dh AND bx < (x_off + wipe_w) * dh AND by_ >= y_off * dv AND by_ < (y_off + wipe_h) * dv AS blank FROM moved),
src AS (SELECT *, CASE WHEN fx_ THEN mc - 1 - tx ELSE tx END AS px, CASE WHEN fy_ THEN mr - 1 - ty ELSE ty END AS py FROM from_)
SELECT g.image_id, g.request, g.ci, g.by_, g.bx, list_transform(range(64), lambda i: CASE WHEN empty_ OR blank THEN 0 ELSE
 s.coef[CASE WHEN swap THEN i % 8 * 8 + i // 8 + 1 ELSE i + 1 END] * CASE WHEN fx_ AND i % 2 = 1 THEN -1 ELSE 1 END * CASE WHEN fy_ AND i // 8 % 2 = 1 THEN -1 ELSE 1 END END) AS coef
FROM src g LEFT JOIN fx_planned s ON s.image_id = g.image_id AND s.ci = g.ci AND s.bx = CASE WHEN swap THEN py ELSE px END AND s.by_ = CASE WHEN swap THEN px ELSE py END
WHERE empty_ OR s.coef IS NOT NULL""")
def _(s, d):
    rows = planned(s, d)
    images = rows.select("image_id", "width", "height", "ncomp", "max_h", "max_v").distinct()
    images.createOrReplaceTempView("fl_requested")
    made = s.sql(_REQ.replace("(SELECT DISTINCT image_id, width, height, ncomp, max_h, max_v FROM fx_planned)", "fl_requested"))
    spec = F.expr("""concat(sw, if(w_force, 'f', ''), 'x', sh, '+', sx, if(y_neg, '-', '+'), sy)""")
    plan = rq.plan_requests(made.withColumn("spec", F.when(F.col("kind") > 0, spec)))
    comps = rows.select("image_id", "ci", "h", "v").distinct()
    return rq.rotate_requests(rows.select("image_id", "ci", "by", "bx", "coef"), plan, comps).withColumnRenamed("by", "by_")
