"""Palettes."""

from pyspark.sql import functions as F

from framelake.operators import palette as pa

from .base import register, spark_fx, table

# Pixels of a corpus, and palettes and boxes that come from its own colours.
HIST = "hist AS (SELECT 0 AS image_id, r // 8 AS c0, g // 4 AS c1, b // 8 AS c2, count(*) AS n FROM fx_pixels GROUP BY 2, 3, 4)"


def corpus(s, d):
    return spark_fx(s, d, "fx_pixels").withColumn("image_id", F.pmod(F.xxhash64("image_id"), F.lit(1)))


@register("color_histogram", "image_id c0 c1 c2 n", "SELECT image_id, r // 8 AS c0, g // 4 AS c1, b // 8 AS c2, count(*) AS n FROM fx_pixels GROUP BY 1, 2, 3, 4")
def _(s, d):
    return pa.color_histogram(spark_fx(s, d, "fx_pixels"))


@register("corpus_histogram", "image_id c0 c1 c2 n", f"WITH {HIST} SELECT * FROM hist")
def _(s, d):
    return pa.color_histogram(corpus(s, d))


# Boxes cut the green axis of each image at a value derived from its key.
BOXES = """boxes AS (SELECT image_id, 0 AS box, 0 AS lo, CAST(image_id % 40 + 10 AS INT) AS hi FROM (SELECT DISTINCT image_id FROM fx_pixels)
 UNION ALL SELECT image_id, 1, CAST(image_id % 40 + 11 AS INT), 63 FROM (SELECT DISTINCT image_id FROM fx_pixels))"""
PHIST = "ph AS (SELECT image_id, r // 8 AS c0, g // 4 AS c1, b // 8 AS c2, count(*) AS n FROM fx_pixels GROUP BY 1, 2, 3, 4)"


def boxes(s, d):
    ids = spark_fx(s, d, "fx_pixels").select("image_id").distinct()
    cut = (F.col("image_id") % 40 + 10).cast("int")
    two = F.array(F.struct(F.lit(0).alias("box"), F.lit(0).alias("c1min"), cut.alias("c1max")), F.struct(F.lit(1).alias("box"), (cut + 1).alias("c1min"), F.lit(63).alias("c1max")))
    t = ids.select("image_id", F.inline(two))
    return t.withColumns({"c0min": F.lit(0), "c0max": F.lit(31), "c2min": F.lit(0), "c2max": F.lit(31)})


@register("box_stats", "image_id box c0min c0max c1min c1max c2min c2max cells volume", f"""WITH {PHIST}, {BOXES},
g AS (SELECT b.image_id, b.box, min(c0) AS c0min, max(c0) AS c0max, min(c1) AS c1min, max(c1) AS c1max, min(c2) AS c2min, max(c2) AS c2max, count(*) AS cells
 FROM boxes b JOIN ph ON ph.image_id = b.image_id AND c1 BETWEEN lo AND hi GROUP BY 1, 2)
SELECT *, (c0max-c0min)*(c0max-c0min)*256 + (c1max-c1min)*(c1max-c1min)*144 + (c2max-c2min)*(c2max-c2min)*64 AS volume FROM g""")
def _(s, d):
    return pa.box_stats(pa.color_histogram(spark_fx(s, d, "fx_pixels")), boxes(s, d))


@register("palette_colors", "image_id idx r g b", f"""WITH {PHIST}, {BOXES}
SELECT b.image_id, b.box AS idx, (sum((c0*8+4)*n) + sum(n)//2) // sum(n) AS r, (sum((c1*4+2)*n) + sum(n)//2) // sum(n) AS g, (sum((c2*8+4)*n) + sum(n)//2) // sum(n) AS b
FROM boxes b JOIN ph ON ph.image_id = b.image_id AND c1 BETWEEN lo AND hi GROUP BY 1, 2""")
def _(s, d):
    return pa.palette_colors(pa.color_histogram(spark_fx(s, d, "fx_pixels")), boxes(s, d))


# A supplied palette of 25 colours from `nation`, repeated colours included.
PAL = "pal AS (SELECT n_nationkey AS idx, n_nationkey * 53 % 256 AS r, n_nationkey % 20 * 31 % 256 AS g, n_regionkey * 60 AS b FROM nation)"


def supplied(s, d):
    return table(s, d, "nation").selectExpr("pmod(CAST(n_nationkey AS BIGINT), 1L) AS image_id", "n_nationkey AS idx", "n_nationkey * 53 % 256 AS r", "n_nationkey % 20 * 31 % 256 AS g", "n_regionkey * 60 AS b")


@register("map_to_palette", "x r g b idx", f"""WITH {PAL}, {HIST},
best AS (SELECT c0, c1, c2, arg_min(idx, d) AS idx FROM (SELECT c0, c1, c2, idx, (4*(c0*8+4-r)*(c0*8+4-r) + 9*(c1*4+2-g)*(c1*4+2-g) + (c2*8+4-b)*(c2*8+4-b)) * 1000 + idx AS d FROM hist, pal) GROUP BY 1, 2, 3)
SELECT x, r, g, b, idx FROM fx_pixels p JOIN best ON c0 = r // 8 AND c1 = g // 4 AND c2 = b // 8""")
def _(s, d):
    return pa.map_to_palette(corpus(s, d), supplied(s, d))


@register("median_cut", "image_id box c0min c0max c1min c1max c2min c2max")
def _(s, d):
    return pa.median_cut(pa.color_histogram(corpus(s, d)), 64)


@register("corpus_palette", "idx r g b")
def _(s, d):
    return pa.corpus_palette(spark_fx(s, d, "fx_pixels"), 32)[0]


@register("corpus_palette_pixels", "image_id idx n")
def _(s, d):
    return pa.corpus_palette(spark_fx(s, d, "fx_pixels"), 32)[1].groupBy("image_id", "idx").agg(F.count("*").alias("n"))


# 100 colours: 5 x 5 x 4 in the order R G B after growing 4 x 4 x 4.

def step(v, n):
    cases = " ".join(f"WHEN {v} <= {((2*j + 1)*255 + n - 1) / (2*(n - 1))} THEN {j}" for j in range(n - 1))
    return f"CASE {cases} ELSE {n - 1} END"


def out(j, n):
    return f"(({j})*255 + {(n - 1) // 2}) // {n - 1}"


@register("uniform_quantize", "image_id x r g b idx qr qg qb", f"""
WITH a AS (SELECT *, {step('r', 5)} AS jr, {step('g', 5)} AS jg, {step('b', 4)} AS jb FROM fx_pixels)
SELECT image_id, x, r, g, b, jr*20 + jg*4 + jb AS idx, {out('jr', 5)} AS qr, {out('jg', 5)} AS qg, {out('jb', 4)} AS qb FROM a""")
def _(s, d):
    return pa.uniform_quantize(spark_fx(s, d, "fx_pixels"), 100)


@register("uniform_palette_use", "idx v0 v1 v2 n", f"""
WITH a AS (SELECT {step('r', 5)} AS jr, {step('g', 5)} AS jg, {step('b', 4)} AS jb FROM fx_pixels)
SELECT jr*20 + jg*4 + jb AS idx, {out('jr', 5)} AS v0, {out('jg', 5)} AS v1, {out('jb', 4)} AS v2, count(*) AS n FROM a GROUP BY 1, 2, 3, 4""")
def _(s, d):
    use = pa.uniform_quantize(spark_fx(s, d, "fx_pixels"), 100).groupBy("idx").agg(F.count("*").alias("n"))
    return use.join(F.broadcast(pa.uniform_palette(s, 100)), "idx")


@register("ordered_dither", "image_id y x v idx qv", f"""
WITH RECURSIVE m(k, y, x, f) AS (SELECT 0, 0, 0, 0 UNION ALL SELECT k + 1, y*2 + a, x*2 + b, f + (CASE WHEN a = 0 AND b = 0 THEN 0 WHEN a = 0 THEN 3 WHEN b = 0 THEN 2 ELSE 1 END) * (1 << (2*k))
 FROM m, (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b) WHERE k < 4),
w AS (SELECT s.*, least(255, greatest(0, v + CAST(trunc((255 - 2*f) * 255 / (512.0*3)) AS INT))) AS t FROM fx_samples s JOIN m ON m.k = 4 AND m.y = s.y % 16 AND m.x = s.x % 16),
q AS (SELECT *, {step('t', 4)} AS j FROM w)
SELECT image_id, y, x, v, j AS idx, {out('j', 4)} AS qv FROM q""")
def _(s, d):
    return pa.ordered_dither(spark_fx(s, d, "fx_samples"), 4, ("v",))
