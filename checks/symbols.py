"""Entropy-coding statistics."""

from pyspark.sql import functions as F

from framelake.functions import blocks as fb
from framelake.functions import fixed
from framelake.operators import symbols as sy

from .base import SPLIT, register, spark_fx, spread, table
from .blocks import ZZ

# Three-component images of 29 x 27 samples seen as 2 units a row; a gray twin with 5 blocks a row.
_POS = "SELECT *, 2 AS mcus_per_row FROM fx_mblocks"
SPLIT["fx_pos"] = (_POS, _POS)
POS = "(by_ // v * 2 + bx // h) * h * v + by_ % v * h + bx % h"


def positioned(s, d):
    return sy.scan_position(spark_fx(s, d, "fx_pos"))


def raster(s, d):
    return sy.scan_position(spark_fx(s, d, "fx_sparse").withColumn("mcus_per_row", F.lit(5)), interleaved=False)


def tables(s, d):
    return positioned(s, d).select("image_id", "ci").distinct().withColumns({"dc_table": F.when(F.col("ci") == 0, 0).otherwise(1), "ac_table": F.when(F.col("ci") == 0, 0).otherwise(1)})


@register("scan_position", "image_id ci by_ bx mcu_row mcu_col mcu_y mcu_x pos", f"""
SELECT image_id, ci, by_, bx, by_ // v AS mcu_row, bx // h AS mcu_col, by_ % v AS mcu_y, bx % h AS mcu_x, {POS} AS pos FROM fx_mblocks""")
def _(s, d):
    return positioned(s, d).withColumnRenamed("by", "by_")


@register("pad_mcu", "image_id by_ bx dc dummy:b", """
WITH ids AS (SELECT DISTINCT image_id FROM fx_blocks), b AS (SELECT image_id, by_, bx, coef[1] AS dc FROM fx_blocks),
grid AS (SELECT image_id, y, x, least(y, 3) AS sy, CASE WHEN y <= 3 THEN least(x, 4) WHEN x >= 3 THEN 4 ELSE 2 END AS sx FROM ids, (SELECT unnest(range(6)) AS y), (SELECT unnest(range(6)) AS x))
SELECT g.image_id, y AS by_, x AS bx, dc, y > 3 OR x > 4 AS dummy FROM grid g JOIN b ON b.image_id = g.image_id AND b.by_ = g.sy AND b.bx = g.sx""")
def _(s, d):
    t = spark_fx(s, d, "fx_blocks").withColumns({"h": F.lit(3), "v": F.lit(3), "blocks_w": F.lit(5), "blocks_h": F.lit(4)})
    return sy.pad_mcu(t).withColumns({"dc": F.col("coef")[0], "by_": F.col("by")})


DIFF = f"""p AS (SELECT image_id, ci, h, v, coef, {POS} AS pos FROM fx_mblocks),
d AS (SELECT image_id, ci, pos, coef[1] - coalesce(lag(coef[1]) OVER (PARTITION BY image_id, ci ORDER BY pos), 0) AS diff,
 coef[1] - CASE WHEN pos % (2*h*v) = 0 THEN 0 ELSE lag(coef[1]) OVER (PARTITION BY image_id, ci ORDER BY pos) END AS rdiff FROM p)"""


@register("dc_diff", "image_id ci pos diff", f"WITH {DIFF} SELECT image_id, ci, pos, diff FROM d")
def _(s, d):
    return sy.dc_diff(positioned(s, d), chunk=5)


@register("dc_diff_restart", "image_id ci pos diff", f"WITH {DIFF} SELECT image_id, ci, pos, rdiff AS diff FROM d")
def _(s, d):
    return sy.dc_diff(positioned(s, d), restart=2, chunk=5)


NZ = f"""nz AS (SELECT *, pos - coalesce(lag(pos) OVER (PARTITION BY SRCKEY ORDER BY pos), 0) - 1 AS run FROM (
 SELECT image_id, ci, by_, bx, unnest(range(1, 64)) AS pos, unnest(list_transform({ZZ}, lambda p: coef[p])[2:]) AS value FROM SRC) WHERE value <> 0)"""
CAT = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin(abs({0}))) END"


def nz(src):
    return NZ.replace("SRCKEY", "image_id, ci, by_, bx").replace("SRC", src)


@register("zero_runs", "image_id by_ bx pos value run", f"WITH {nz('fx_sparse')} SELECT * FROM nz")
def _(s, d):
    return sy.zero_runs(spark_fx(s, d, "fx_sparse")).withColumnRenamed("by", "by_")


@register("category", "image_id pos diff cat big:b", f"WITH {DIFF} SELECT image_id, pos, diff, {CAT.format('diff')} AS cat, abs(diff) >= 2048 AS big FROM d")
def _(s, d):
    return sy.dc_diff(positioned(s, d)).withColumns({"cat": fb.category("diff"), "big": fb.out_of_range(dc_diff="diff")})


DC_COUNTS = f"dc AS (SELECT image_id, 0 AS cls, CASE WHEN ci = 0 THEN 0 ELSE 1 END AS slot, {CAT.format('diff')} AS symbol, count(*) AS n FROM d GROUP BY 1, 2, 3, 4)"


def ac_counts(src, slot):
    return f"""{nz(src)}, syms AS (
 SELECT image_id, ci, run % 16 * 16 + length(bin(abs(value))) AS symbol, 1 AS n FROM nz UNION ALL SELECT image_id, ci, 240, run // 16 FROM nz WHERE run >= 16
 UNION ALL SELECT image_id, ci, 0, 1 FROM {src} WHERE coef[64] = 0), ac AS (SELECT image_id, 1 AS cls, {slot} AS slot, symbol, sum(n) AS n FROM syms GROUP BY 1, 2, 3, 4)"""


@register("dc_symbol_counts", "image_id slot symbol n", f"WITH {DIFF}, {DC_COUNTS} SELECT image_id, slot, symbol, n FROM dc")
def _(s, d):
    return sy.dc_symbol_counts(sy.dc_diff(positioned(s, d)), tables(s, d))


@register("ac_symbol_counts", "image_id slot symbol n", f"WITH {ac_counts('fx_sparse', '0')} SELECT image_id, slot, symbol, n FROM ac")
def _(s, d):
    t = spark_fx(s, d, "fx_sparse")
    return sy.ac_symbol_counts(t, t.select("image_id", "ci", F.lit(0).alias("ac_table")).distinct())


_LEN = []
for _c, _s, _n, _v in ((0, 0, fixed.DC_LUMA_COUNTS, fixed.DC_SYMBOLS), (0, 1, fixed.DC_CHROMA_COUNTS, fixed.DC_SYMBOLS), (1, 0, fixed.AC_LUMA_COUNTS, fixed.AC_LUMA_SYMBOLS), (1, 1, fixed.AC_CHROMA_COUNTS, fixed.AC_CHROMA_SYMBOLS)):
    _l = [i + 1 for i, k in enumerate(_n) for _ in range(k)]
    _LEN += [f"({_c},{_s},{sym},{ln})" for sym, ln in zip(_v, _l)]
STD = "std AS (SELECT * FROM (VALUES " + ", ".join(_LEN) + ") t(cls, slot, symbol, len))"


@register("coded_size", "image_id bits uncodable", f"""WITH {DIFF}, {DC_COUNTS}, {ac_counts('fx_mblocks', 'CASE WHEN ci = 0 THEN 0 ELSE 1 END')}, {STD},
al AS (SELECT * FROM dc UNION ALL SELECT * FROM ac)
SELECT image_id, coalesce(sum(n * (len + symbol % 16)), 0) AS bits, coalesce(sum(n) FILTER (len IS NULL), 0) AS uncodable FROM al LEFT JOIN std USING (cls, slot, symbol) GROUP BY 1""")
def _(s, d):
    p, t = positioned(s, d), tables(s, d)
    counts = sy.dc_symbol_counts(sy.dc_diff(p), t).unionByName(sy.ac_symbol_counts(p, t))
    return sy.coded_size(counts, sy.standard_lengths(s))


_EOB = f"""z AS (SELECT image_id, ci, by_*5 + bx AS pos, list_transform({ZZ}[2:], lambda p: CAST(trunc(coef[p] / 4.0) AS INT)) AS c FROM fx_sparse),
m AS (SELECT *, list_bool_or(list_transform(c, lambda x: x <> 0)) AS hit, c[63] = 0 AS tail FROM z),
i AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, ci ORDER BY pos) AS island FROM m),
e AS (SELECT image_id, ci, island, sum(CASE WHEN tail THEN 1 ELSE 0 END) AS run FROM i GROUP BY 1, 2, 3),
runs AS (SELECT image_id, ci, run, CAST(floor(log2(run)) AS BIGINT) * 16 AS symbol FROM e WHERE run > 0)"""


@register("eob_runs", "image_id run symbol", f"WITH {_EOB} SELECT * FROM runs")
def _(s, d):
    return sy.eob_runs(raster(s, d), 1, 63, 2, chunk=3)


@register("progressive_ac_counts", "image_id symbol n", f"""WITH {_EOB}, n AS (SELECT *, p - coalesce(lag(p) OVER (PARTITION BY image_id, pos ORDER BY p), 0) - 1 AS run FROM (
 SELECT image_id, pos, unnest(range(1, 64)) AS p, unnest(c) AS x FROM z) WHERE x <> 0),
a AS (SELECT image_id, run % 16 * 16 + length(bin(abs(x))) AS symbol, 1 AS k FROM n UNION ALL SELECT image_id, 240, run // 16 FROM n WHERE run > 15 UNION ALL SELECT image_id, symbol, 1 FROM runs)
SELECT image_id, symbol, sum(k) AS n FROM a GROUP BY 1, 2""")
def _(s, d):
    return sy.progressive_ac_counts(raster(s, d), 1, 63, 2, chunk=3)


def htab(s, d):
    t = spread(spark_fx(s, d, "fx_images").select("image_id"))
    arr = lambda v: F.array(*[F.lit(int(x)) for x in v])
    odd = F.col("image_id") % 2 == 1
    broken = F.col("image_id") % 10 == 0
    return t.select("image_id", F.when(odd, 1).otherwise(0).alias("class"), F.lit(0).alias("slot"),
                    F.when(odd, arr(fixed.AC_LUMA_COUNTS)).when(broken, arr([2, 0, 10] + [0] * 13)).otherwise(arr(fixed.DC_LUMA_COUNTS)).alias("bits"),
                    F.when(odd, arr(fixed.AC_LUMA_SYMBOLS)).otherwise(arr(fixed.DC_SYMBOLS)).alias("vals"))


@register("canonical_codes", "image_id symbol length code ok:b", f"""
WITH {STD}, o AS (SELECT cls, symbol, len, pos FROM (SELECT *, row_number() OVER () AS pos FROM std) WHERE slot = 0
 UNION ALL SELECT 2, symbol, CASE WHEN symbol < 2 THEN 1 ELSE 3 END, symbol FROM range(12) t(symbol)),
c AS (SELECT cls, symbol, len, CAST(coalesce(sum(pow(2.0, 16 - len)) OVER (PARTITION BY cls ORDER BY len, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / pow(2.0, 16 - len) AS BIGINT) AS code FROM o)
SELECT image_id, symbol, len AS length, code, cls <> 2 AS ok FROM fx_images JOIN c ON c.cls = CASE WHEN image_id % 2 = 1 THEN 1 WHEN image_id % 10 = 0 THEN 2 ELSE 0 END""")
def _(s, d):
    return sy.canonical_codes(htab(s, d))


# Lengths from the counts of each table: the two smallest of a sorted list merge until one is left, and a symbol is as deep as the
# merges it took part in. Depths over 16 are shortened pair by pair. The deepest place is that of the reserved symbol 256.
BEST = f"""{DIFF}, {DC_COUNTS}, {ac_counts('fx_mblocks', 'CASE WHEN ci = 0 THEN 0 ELSE 1 END')},
al AS (SELECT image_id, cls, slot, CAST(symbol AS INT) AS symbol, CAST(n AS BIGINT) AS n FROM (SELECT * FROM dc UNION ALL SELECT * FROM ac) WHERE n > 0),
leaf AS (SELECT * FROM al UNION ALL SELECT DISTINCT image_id, cls, slot, 256, 1 FROM al),
m AS (SELECT image_id, cls, slot, list_sort(list(struct_pack(n := n, k := -symbol, mem := [symbol]))) AS q, CAST([] AS INT[]) AS hit FROM leaf GROUP BY 1, 2, 3
 UNION ALL SELECT image_id, cls, slot, list_sort(list_append(q[3:], struct_pack(n := q[1].n + q[2].n, k := q[1].k, mem := list_concat(q[1].mem, q[2].mem)))),
  list_concat(q[1].mem, q[2].mem) FROM m WHERE len(q) > 1),
depth AS (SELECT image_id, cls, slot, symbol, CAST(count(*) AS INT) AS depth FROM (SELECT image_id, cls, slot, unnest(hit) AS symbol FROM m) GROUP BY 1, 2, 3, 4),
cutd AS (SELECT image_id, cls, slot, list_sort(list(depth)) AS l FROM depth GROUP BY 1, 2, 3
 UNION ALL SELECT image_id, cls, slot, list_sort(list_concat(list_concat(r[:p - 1], r[p + 1:]), [top - 1, j + 1, j + 1]))
 FROM (SELECT *, list_position(r, j) AS p FROM (SELECT image_id, cls, slot, l[:len(l) - 2] AS r, l[len(l)] AS top, list_max(list_filter(l, lambda x: x <= l[len(l)] - 2)) AS j FROM cutd WHERE l[len(l)] > 16))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls, slot ORDER BY depth, symbol) AS rank FROM depth WHERE symbol < 256),
best AS (SELECT image_id, cls, slot, symbol, l[rank] AS length FROM ranked JOIN cutd USING (image_id, cls, slot) WHERE l[len(l)] <= 16)"""


@register("optimal_lengths", "image_id cls slot symbol length", f"WITH RECURSIVE {BEST} SELECT * FROM best")
def _(s, d):
    p, t = positioned(s, d), tables(s, d)
    return sy.optimal_lengths(sy.dc_symbol_counts(sy.dc_diff(p), t).unionByName(sy.ac_symbol_counts(p, t))).withColumnRenamed("class", "cls")


@register("table_symbols", "image_id symbol len rank", f"""
WITH o AS (SELECT o_custkey AS image_id, o_orderkey % 256 AS symbol, 1 + min(o_orderkey) % 16 AS len FROM orders GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY len, symbol) - 1 AS rank FROM o""")
def _(s, d):
    t = table(s, d, "orders").groupBy(F.col("o_custkey").alias("image_id"), (F.col("o_orderkey") % 256).alias("symbol")).agg((1 + F.min("o_orderkey") % 16).alias("length"))
    return sy.table_symbols(t.withColumns({"class": F.lit(0), "slot": F.lit(0)})).withColumnRenamed("length", "len")


@register("encoding_report", "image_id standard_bits optimal_bits saved_bits uncodable", f"""WITH RECURSIVE {BEST}, {STD},
r AS (SELECT image_id, coalesce(sum(n * (len + symbol % 16)), 0) AS standard_bits, sum(n * (length + symbol % 16)) AS optimal_bits, coalesce(sum(n) FILTER (len IS NULL), 0) AS uncodable
 FROM al JOIN best USING (image_id, cls, slot, symbol) LEFT JOIN std USING (cls, slot, symbol) GROUP BY 1)
SELECT *, standard_bits - optimal_bits AS saved_bits FROM r""")
def _(s, d):
    return sy.encoding_report(positioned(s, d), tables(s, d))


def first_pass(i, ss, se, al, cis):
    """Number of symbols of one first AC pass per component, as a chain of CTEs."""
    return f"""z{i} AS (SELECT image_id, ci, by_ * CASE WHEN ci = 0 THEN 4 ELSE 2 END + bx AS pos, list_transform({ZZ}[{ss + 1}:{se + 1}], lambda p: CAST(trunc(coef[p] / {2 ** al}.0) AS INT)) AS c FROM fx_mblocks WHERE ci IN ({cis})),
m{i} AS (SELECT *, list_bool_or(list_transform(c, lambda x: x <> 0)) AS hit, c[len(c)] = 0 AS tail FROM z{i}),
k{i} AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, ci ORDER BY pos) AS island FROM m{i}),
x{i} AS (SELECT image_id, ci, pos, p, p - coalesce(lag(p) OVER (PARTITION BY image_id, ci, pos ORDER BY p), 0) - 1 AS run FROM (SELECT image_id, ci, pos, unnest(range(1, {se - ss + 2})) AS p, unnest(c) AS v FROM z{i}) WHERE v <> 0),
s{i} AS (SELECT image_id, ci, sum(n) AS n FROM (SELECT image_id, ci, count(*) + sum(run // 16) AS n FROM x{i} GROUP BY 1, 2
 UNION ALL SELECT image_id, ci, count(*) FROM (SELECT image_id, ci, island FROM k{i} WHERE tail GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1, 2)"""


@register("pass_counts", "image_id ci sequential progressive", f"""WITH {ac_counts('fx_mblocks', 'ci')}, {first_pass(1, 1, 5, 2, '0')}, {first_pass(2, 1, 63, 1, '1, 2')}, {first_pass(3, 6, 63, 2, '0')},
st AS (SELECT image_id, ci, sum(n) AS progressive FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) GROUP BY 1, 2)
SELECT a.image_id, a.slot AS ci, sum(a.n) AS sequential, any_value(progressive) AS progressive FROM ac a LEFT JOIN st ON st.image_id = a.image_id AND st.ci = a.slot GROUP BY 1, 2""")
def _(s, d):
    t = spark_fx(s, d, "fx_mblocks").withColumn("mcus_per_row", F.when(F.col("ci") == 0, 4).otherwise(2))
    return sy.pass_counts(sy.scan_position(t, interleaved=False), chunk=3)
