"""Colour, cosine transforms, resampling, smoothing."""

from pyspark.sql import functions as F

from framelake.functions import color as cl
from framelake.functions import dct
from framelake.functions import quant as qz
from framelake.operators import samples as sa

from .base import SPLIT, register, spark_fx


def px(s, d):
    return spark_fx(s, d, "fx_pixels")


def fixp(x):
    return int(x * 65536 + 0.5)


Y = f"(({fixp(.299)}*r + {fixp(.587)}*g + {fixp(.114)}*b + 32768) >> 16)"
CB = f"((32768*b - {fixp(.168735892)}*r - {fixp(.331264108)}*g + 8388608 + 32767) >> 16)"
CR = f"((32768*r - {fixp(.418687589)}*g - {fixp(.081312411)}*b + 8388608 + 32767) >> 16)"


def rgb(k, y="r", cb="g", cr="b"):
    """Inverse conversion of columns y, cb, cr as floor of real products (fixed point written as a quotient)."""
    r = f"{y} + CAST(floor(({fixp(1.402*k)}*({cr}-128) + 32768) / 65536.0) AS BIGINT)"
    g = f"{y} + CAST(floor((-{fixp(.344136286*k)}*({cb}-128) - {fixp(.714136286*k)}*({cr}-128) + 32768) / 65536.0) AS BIGINT)"
    b = f"{y} + CAST(floor(({fixp(1.772*k)}*({cb}-128) + 32768) / 65536.0) AS BIGINT)"
    return tuple(f"least(255, greatest(0, {e}))" for e in (r, g, b))


def color_check(name, fn, sql_cols, extra=""):
    outs = list(sql_cols)
    spec = "image_id x r0 g0 b0 " + " ".join(outs)
    body = ", ".join(f"{e} AS {n}" for n, e in sql_cols.items())

    @register(name, spec, f"SELECT image_id, x, r AS r0, g AS g0, b AS b0, {body} FROM fx_pixels")
    def _(s, d):
        t = px(s, d).withColumns({"r0": F.col("r"), "g0": F.col("g"), "b0": F.col("b")}).withColumn("o", fn())
        base = ["image_id", "x", "r0", "g0", "b0"]
        if len(outs) == 1:
            return t.select(*base, F.col("o").alias(outs[0]))
        return t.select(*base, *[F.col(f"o.{n[2:]}").alias(n) for n in outs])


color_check("rgb_to_ycc", lambda: cl.rgb_to_ycc("r", "g", "b"), {"o_y": Y, "o_cb": CB, "o_cr": CR})
color_check("rgb_to_gray", lambda: cl.rgb_to_gray("r", "g", "b"), {"o_y": Y})
_inv = lambda e: e.replace("*r", "*(255-r)").replace("*g", "*(255-g)").replace("*b", "*(255-b)")
color_check("cmyk_to_ycck", lambda: cl.cmyk_to_ycck("r", "g", "b", "k"), {"o_y": _inv(Y), "o_cb": _inv(CB), "o_cr": _inv(CR), "o_k": "k"})
color_check("rgb_to_subtract_green", lambda: cl.rgb_to_subtract_green("r", "g", "b"), {"o_r": "(r - g + 384) % 256", "o_g": "g", "o_b": "(b - g + 384) % 256"})
for _n, _k, _f in (("ycc_to_rgb", 1, cl.ycc_to_rgb), ("bgycc_to_rgb", 2, cl.bgycc_to_rgb)):
    _r, _g, _b = rgb(_k)
    color_check(_n, lambda f=_f: f("r", "g", "b"), {"o_r": _r, "o_g": _g, "o_b": _b})
_raw = [e[len("least(255, greatest(0, "):-2] for e in rgb(1)]
color_check("ycck_to_cmyk", lambda: cl.ycck_to_cmyk("r", "g", "b", "k"), {n: f"least(255, greatest(0, 255 - ({e})))" for n, e in zip(("o_c", "o_m", "o_y"), _raw)} | {"o_k": "k"})
color_check("subtract_green_to_rgb", lambda: cl.subtract_green_to_rgb("r", "g", "b"), {"o_r": "(r + g + 128) % 256", "o_g": "g", "o_b": "(b + g + 128) % 256"})
color_check("subtract_green_to_gray", lambda: cl.subtract_green_to_gray("r", "g", "b"),
            {"o_y": Y.replace("*r", "*((r + g + 128) % 256)").replace("*b", "*((b + g + 128) % 256)")})
color_check("gray_to_rgb", lambda: cl.gray_to_rgb("r"), {"o_r": "r", "o_g": "r", "o_b": "r"})
color_check("ycc_to_gray", lambda: cl.ycc_to_gray("r", "g", "b"), {"o_y": "r"})


# --- quantisation ---------------------------------------------------------------------------------------

LUMA = "[" + ",".join(str(v) for v in __import__("framelake.functions.fixed", fromlist=["x"]).LUMA_QUANT) + "]"


@register("quality_scale", "image_id scale", "SELECT image_id, CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2*q END AS scale FROM (SELECT image_id, least(100, greatest(1, image_id % 110)) AS q FROM fx_images)")
def _(s, d):
    return spark_fx(s, d, "fx_images").withColumn("scale", qz.quality_scale(F.col("image_id") % 110))


@register("quant_table", "image_id q:a wide:a", f"""
WITH a AS (SELECT image_id, CASE WHEN k < 50 THEN 5000 // k ELSE 200 - 2*k END AS s FROM (SELECT image_id, 1 + image_id % 100 AS k FROM fx_images))
SELECT image_id, list_transform({LUMA}, lambda b: least(255, greatest(1, (b*s + 50) // 100))) AS q, list_transform({LUMA}, lambda b: least(32767, greatest(1, (b*s + 50) // 100))) AS wide FROM a""")
def _(s, d):
    sc = qz.quality_scale(1 + F.col("image_id") % 100)
    return spark_fx(s, d, "fx_images").withColumns({"q": qz.quant_table(sc), "wide": qz.quant_table(sc, baseline=False)})


@register("quantize", "image_id by_ bx coef:a dbl:a", f"""
SELECT image_id, by_, bx, list_transform(range(64), lambda i: CAST(sign(coef[i+1]) * ((abs(coef[i+1])*8 + {LUMA}[i+1] // 2) // {LUMA}[i+1]) AS BIGINT)) AS coef,
 list_transform(range(64), lambda i: CAST(sign(coef[i+1]) * ((abs(coef[i+1])*8 + {LUMA}[i+1]) // (2*{LUMA}[i+1])) AS BIGINT)) AS dbl FROM fx_blocks""")
def _(s, d):
    t = spark_fx(s, d, "fx_blocks").withColumn("c8", F.transform("coef", lambda c: c * 8))
    q = qz.quant_table(F.lit(100))
    return t.withColumns({"coef": qz.quantize("c8", q), "dbl": qz.quantize("c8", q, doubled=True)}).withColumnRenamed("by", "by_")


@register("dequantize", "image_id by_ bx coef:a", "SELECT image_id, by_, bx, list_transform(range(64), lambda i: coef[i+1] * (1 + (i + image_id) % 9)) AS coef FROM fx_blocks")
def _(s, d):
    t = spark_fx(s, d, "fx_blocks")
    q = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (1 + (i + F.col("image_id")) % 9).cast("int"))
    return sa.dequantize(t, t.select("image_id", "ci").distinct().withColumn("q", q)).withColumnRenamed("by", "by_")


# --- cosine transforms ------------------------------------------------------------------------------------


def fdct_sql(nx, ny, src):
    return f"""SELECT image_id, by_, bx, v*8 + u AS i, CASE WHEN u < {nx} AND v < {ny} THEN sum((val - 128) * CASE WHEN u = 0 THEN sqrt(0.5) ELSE 1 END * CASE WHEN v = 0 THEN sqrt(0.5) ELSE 1 END
 * cos((2*x + 1)*u*pi()/{2*nx}) * cos((2*y + 1)*v*pi()/{2*ny})) * 16.0/({nx}*{ny}) ELSE 0 END AS f FROM {src} CROSS JOIN (SELECT unnest(range(8)) AS u) CROSS JOIN (SELECT unnest(range(8)) AS v) GROUP BY image_id, by_, bx, u, v"""


CELLS = "(SELECT image_id, by_, bx, i % 8 AS x, i // 8 AS y, val FROM (SELECT image_id, by_, bx, unnest(range(64)) AS i, unnest(s) AS val FROM fx_sblocks))"


@register("fdct", "image_id by_ bx i f:f", fdct_sql(8, 8, CELLS))
def _(s, d):
    t = sa.fdct(spark_fx(s, d, "fx_sblocks"))
    return t.select("image_id", F.col("by").alias("by_"), "bx", F.posexplode_outer("dct").alias("i", "f"))


# 16 x 4 points: the same 64 samples read as 4 rows of 16.
@register("fdct_16x4", "image_id by_ bx i f:f", fdct_sql(16, 4, CELLS.replace("i % 8", "i % 16").replace("i // 8", "i // 16")))
def _(s, d):
    t = sa.fdct(spark_fx(s, d, "fx_sblocks"), 16, 4)
    return t.select("image_id", F.col("by").alias("by_"), "bx", F.posexplode_outer("dct").alias("i", "f"))


def idct_sql(nx, ny):
    return f"""SELECT image_id, by_, bx, y*{nx} + x AS i, 128 + sum(c * CASE WHEN u = 0 THEN sqrt(0.5) ELSE 1 END * CASE WHEN v = 0 THEN sqrt(0.5) ELSE 1 END
 * cos((2*x + 1)*u*pi()/{2*nx}) * cos((2*y + 1)*v*pi()/{2*ny})) / 4 AS f FROM (SELECT image_id, by_, bx, i % 8 AS u, i // 8 AS v, c FROM (SELECT image_id, by_, bx, unnest(range(64)) AS i, unnest(coef) AS c FROM fx_blocks))
 CROSS JOIN (SELECT unnest(range({nx})) AS x) CROSS JOIN (SELECT unnest(range({ny})) AS y) WHERE u < {nx} AND v < {ny} GROUP BY image_id, by_, bx, x, y"""


for _nx, _ny in ((8, 8), (4, 4), (16, 8), (3, 5)):
    @register("idct" if (_nx, _ny) == (8, 8) else f"idct_{_nx}x{_ny}", "image_id by_ bx i f:f", idct_sql(_nx, _ny))
    def _(s, d, nx=_nx, ny=_ny):
        t = sa.idct(spark_fx(s, d, "fx_blocks"), nx, ny)
        return t.select("image_id", F.col("by").alias("by_"), "bx", F.posexplode_outer("values").alias("i", "f"))


@register("idct_samples", "image_id off", "SELECT DISTINCT image_id, 0 AS off FROM fx_sblocks")
def _(s, d):
    """Forward, inverse, limited: largest difference from the input per image, which must be 0."""
    t = sa.idct(sa.fdct(spark_fx(s, d, "fx_sblocks")), source="dct").withColumn("back", dct.to_samples("values"))
    diff = F.array_max(F.zip_with("back", "s", lambda a, b: F.abs(a - b)))
    return t.groupBy("image_id").agg(F.max(diff).alias("off"))


# --- resampling -------------------------------------------------------------------------------------------


def samp(s, d):
    return spark_fx(s, d, "fx_samples")


@register("samples_to_blocks", "image_id by_ bx s:a", "SELECT image_id, by_, bx, s FROM fx_sblocks")
def _(s, d):
    return sa.samples_to_blocks(samp(s, d)).withColumnRenamed("by", "by_")


@register("blocks_to_samples", "image_id y x v", "SELECT image_id, y, x, v FROM fx_samples")
def _(s, d):
    return sa.blocks_to_samples(spark_fx(s, d, "fx_sblocks"))


@register("pad_edges", "image_id y x v", """
WITH g AS (SELECT y, x FROM (SELECT unnest(range(32)) AS y), (SELECT unnest(range(48)) AS x))
SELECT s.image_id, g.y, g.x, s.v FROM g JOIN fx_samples s ON s.y = least(g.y, 28) AND s.x = least(g.x, 36)""")
def _(s, d):
    return sa.pad_edges(samp(s, d), 37, 29, 48, 32)


@register("downsample", "image_id y x v", "SELECT image_id, y // 4 AS y, x // 4 AS x, (sum(v) + 8) // 16 AS v FROM fx_samples GROUP BY 1, 2, 3")
def _(s, d):
    return sa.downsample(samp(s, d), 4, 4)


@register("downsample_h2v1", "image_id y x v", "SELECT image_id, y, x // 2 AS x, (sum(v) + (x // 2) % 2) // 2 AS v FROM fx_samples GROUP BY image_id, y, x // 2")
def _(s, d):
    return sa.downsample_h2v1(samp(s, d))


@register("downsample_h2v2", "image_id y x v", "SELECT image_id, y // 2 AS y, x // 2 AS x, (sum(v) + 1 + (x // 2) % 2) // 4 AS v FROM fx_samples GROUP BY image_id, y // 2, x // 2")
def _(s, d):
    return sa.downsample_h2v2(samp(s, d))


@register("smooth_full", "image_id y x v", """
WITH w AS (SELECT * FROM (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx)), o AS (SELECT DISTINCT y, x FROM fx_samples)
SELECT image_id, o.y, o.x, (sum(v * CASE WHEN dx = 0 AND dy = 0 THEN 65536 - 512*30 ELSE 64*30 END) + 32768) // 65536 AS v
FROM o CROSS JOIN w JOIN fx_samples s ON s.y = least(31, greatest(0, o.y + dy)) AND s.x = least(39, greatest(0, o.x + dx)) GROUP BY 1, 2, 3""")
def _(s, d):
    return sa.smooth_downsample(spark_fx(s, d, "fx_samples"), 30, False, 40, 32)


@register("smooth_halve", "image_id y x v", """
WITH w AS (SELECT * FROM (SELECT unnest(range(-1, 3)) AS dy), (SELECT unnest(range(-1, 3)) AS dx)), o AS (SELECT DISTINCT y // 2 AS y, x // 2 AS x FROM fx_samples)
SELECT image_id, o.y, o.x, (sum(v * CASE WHEN dx IN (0, 1) AND dy IN (0, 1) THEN 16384 - 80*50 WHEN dx IN (0, 1) OR dy IN (0, 1) THEN 2*16*50 ELSE 16*50 END) + 32768) // 65536 AS v
FROM o CROSS JOIN w JOIN fx_samples s ON s.y = least(31, greatest(0, 2*o.y + dy)) AND s.x = least(39, greatest(0, 2*o.x + dx)) GROUP BY 1, 2, 3""")
def _(s, d):
    return sa.smooth_downsample(spark_fx(s, d, "fx_samples"), 50, True, 40, 32)


@register("upsample", "image_id y x v", "SELECT image_id, y*2 + a AS y, x*3 + b AS x, v FROM fx_samples, (SELECT unnest(range(2)) AS a), (SELECT unnest(range(3)) AS b)")
def _(s, d):
    return sa.upsample(samp(s, d), 3, 2)


# Luma and two half-size chroma planes out of the same samples.
def subsampled(s, d):
    t = samp(s, d)
    small = sa.downsample(t, 2, 2)
    return t.unionByName(small.withColumn("ci", F.lit(1))).unionByName(small.withColumns({"ci": F.lit(2), "v": 255 - F.col("v")}))


_UR, _UG, _UB = rgb(1, "y_", "cb_", "cr_")


@register("upsample_to_rgb", "image_id y x r g b", f"""
WITH half AS (SELECT image_id, y // 2 AS y, x // 2 AS x, (sum(v) + 2) // 4 AS v FROM fx_samples GROUP BY 1, 2, 3),
j AS (SELECT a.image_id, a.y, a.x, a.v AS y_, c.v AS cb_, 255 - c.v AS cr_ FROM fx_samples a JOIN half c ON c.image_id = a.image_id AND c.y = a.y // 2 AND c.x = a.x // 2)
SELECT image_id, y, x, {_UR} AS r, {_UG} AS g, {_UB} AS b FROM j""")
def _(s, d):
    return sa.upsample_to_rgb(subsampled(s, d))


@register("planes_to_pixels", "image_id y x c0 c1 c2", "SELECT image_id, y, x, v AS c0, 255 - v AS c1, v // 2 AS c2 FROM fx_samples")
def _(s, d):
    t = samp(s, d).withColumns({"c1": 255 - F.col("v"), "c2": F.floor(F.col("v") / 2)})
    return sa.planes_to_pixels(sa.pixels_to_planes(t, ["v", "c1", "c2"]))


# --- smoothing ----------------------------------------------------------------------------------------------

NB = """n AS (SELECT b.image_id, b.by_, b.bx, b.coef, list(c.coef[1] ORDER BY o.dy, o.dx) AS dcs FROM fx_blocks b CROSS JOIN (SELECT * FROM (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx)) o
 JOIN (SELECT image_id, max(by_) AS my, max(bx) AS mx FROM fx_blocks GROUP BY 1) m ON m.image_id = b.image_id
 JOIN fx_blocks c ON c.image_id = b.image_id AND c.by_ = least(my, greatest(0, b.by_ + dy)) AND c.bx = least(mx, greatest(0, b.bx + dx)) GROUP BY 1, 2, 3, 4)"""


@register("dc_neighbours", "image_id by_ bx dcs:a", f"WITH {NB} SELECT image_id, by_, bx, dcs FROM n")
def _(s, d):
    return sa.dc_neighbours(spark_fx(s, d, "fx_blocks")).withColumnRenamed("by", "by_")


def _pred(num, q, al, old):
    return f"""CASE WHEN {al} <> 0 AND {old} = 0 THEN CAST(sign({num}) * CASE WHEN {al} > 0 THEN least((1 << greatest({al}, 0)) - 1, (128*{q} + abs({num})) // (256*{q})) ELSE (128*{q} + abs({num})) // (256*{q}) END AS BIGINT) ELSE {old} END"""


@register("smooth_blocks", "image_id by_ bx p01 p10 p20 p11 p02", f"""WITH {NB.replace('fx_blocks', 'fx_sparse')},
k AS (SELECT *, image_id % 4 AS a1, image_id % 3 AS a2, CASE WHEN image_id % 2 = 0 THEN -1 ELSE 2 END AS a3, 1 + image_id % 7 AS q0 FROM n)
SELECT image_id, by_, bx, {_pred('(36*q0*(dcs[4] - dcs[6]))', 2, 'a1', 'coef[2]')} AS p01, {_pred('(36*q0*(dcs[2] - dcs[8]))', 9, 'a2', 'coef[9]')} AS p10,
 {_pred('(9*q0*(dcs[2] + dcs[8] - 2*dcs[5]))', 17, 'a3', 'coef[17]')} AS p20, {_pred('(5*q0*(dcs[1] - dcs[3] - dcs[7] + dcs[9]))', 10, 'a1', 'coef[10]')} AS p11,
 {_pred('(9*q0*(dcs[4] + dcs[6] - 2*dcs[5]))', 3, 'a3', 'coef[3]')} AS p02 FROM k""")
def _(s, d):
    t = spark_fx(s, d, "fx_sparse")
    i = F.col("image_id")
    q = F.concat(F.array((1 + i % 7).cast("int")), F.sequence(F.lit(2), F.lit(64)))
    a1, a2, a3 = (i % 4).cast("int"), (i % 3).cast("int"), F.when(i % 2 == 0, -1).otherwise(2)
    known = t.select("image_id", "ci").distinct().withColumns({"q": q, "bits": F.array(F.lit(0), a1, a2, a3, a1, a3)})
    r = sa.smooth_blocks(t, known)
    c = F.col("coef")
    return r.select("image_id", F.col("by").alias("by_"), "bx", c[1].alias("p01"), c[8].alias("p10"), c[16].alias("p20"), c[9].alias("p11"), c[2].alias("p02"))


# --- pipeline ------------------------------------------------------------------------------------------------


def rgb_image(s, d):
    return samp(s, d).selectExpr("image_id", "y", "x", "v AS r", "(v + x) % 256 AS g", "(v * 2 + y) % 256 AS b")


CHROMA = "[" + ",".join(str(v) for v in __import__("framelake.functions.fixed", fromlist=["x"]).CHROMA_QUANT) + "]"


def encoded(quality):
    scale = 200 - 2 * quality
    return f"""WITH img AS (SELECT image_id, y, x, v AS r, (v + x) % 256 AS g, (v*2 + y) % 256 AS b FROM fx_samples),
ycc AS (SELECT image_id, y, x, {Y} AS c0, {CB} AS c1, {CR} AS c2 FROM img),
pad AS (SELECT i.image_id, g.y, g.x, c0, c1, c2 FROM (SELECT y, x FROM (SELECT unnest(range(32)) AS y), (SELECT unnest(range(48)) AS x)) g JOIN ycc i ON i.y = least(g.y, 28) AND i.x = least(g.x, 36)),
pl AS (SELECT image_id, 0 AS ci, y, x, c0 AS val FROM pad
 UNION ALL SELECT image_id, 1, y // 2, x // 2, (sum(c1) + 1 + (x // 2) % 2) // 4 FROM pad GROUP BY image_id, y // 2, x // 2
 UNION ALL SELECT image_id, 2, y // 2, x // 2, (sum(c2) + 1 + (x // 2) % 2) // 4 FROM pad GROUP BY image_id, y // 2, x // 2),
f AS (SELECT image_id, ci, y // 8 AS by_, x // 8 AS bx, v*8 + u AS i, round(2 * sum((val - 128) * CASE WHEN u = 0 THEN sqrt(0.5) ELSE 1 END * CASE WHEN v = 0 THEN sqrt(0.5) ELSE 1 END
 * cos((2*(x % 8) + 1)*u*pi()/16) * cos((2*(y % 8) + 1)*v*pi()/16))) AS c FROM pl CROSS JOIN (SELECT unnest(range(8)) AS u) CROSS JOIN (SELECT unnest(range(8)) AS v) GROUP BY image_id, ci, y // 8, x // 8, u, v),
q AS (SELECT *, 8 * least(255, greatest(1, (CASE WHEN ci = 0 THEN {LUMA} ELSE {CHROMA} END[i+1] * {scale} + 50) // 100)) AS t FROM f),
enc AS (SELECT image_id, ci, by_, bx, i, CAST(sign(c) * floor((abs(c) + t // 2) / t) AS BIGINT) AS c FROM q) """


def encode(s, d, quality):
    p = rgb_image(s, d)
    sizes = p.select("image_id").distinct().withColumns({"width": F.lit(37), "height": F.lit(29)})
    return sa.pixels_to_blocks(p, quality, sizes)


@register("pixels_to_blocks", "image_id ci by_ bx coef:a", encoded(90) + "SELECT image_id, ci, by_, bx, list(c ORDER BY i) AS coef FROM enc GROUP BY 1, 2, 3, 4")
def _(s, d):
    return encode(s, d, 90).withColumnRenamed("by", "by_")


@register("block_zero_share", "image_id ci share:f", encoded(75) + "SELECT image_id, ci, avg(CASE WHEN c = 0 THEN 1.0 ELSE 0.0 END) AS share FROM enc GROUP BY 1, 2")
def _(s, d):
    """Share of zero coefficients after quantisation at quality 75."""
    zeros = F.size(F.filter("coef", lambda c: c == 0)) / 64.0
    return encode(s, d, 75).groupBy("image_id", "ci").agg(F.avg(zeros).alias("share"))


@register("blocks_to_pixels", "image_id y x r g b")
def _(s, d):
    return sa.blocks_to_pixels(encode(s, d, 90), 90)
