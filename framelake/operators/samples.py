"""Samples and pixels: block packing, transforms, resampling, smoothing.

``samples`` is the long form ``image_id, ci, y, x, v``; a block form holds 64 samples per row. Operators that only
replicate or re-address samples emit rows from each sample and need no shuffle; sums combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..functions import dct
from ..functions import quant as qz
from ..functions.exprs import idiv, int_array, shr

PLANE = ["image_id", "ci"]
BAND = 64


def attach(rows: DataFrame, side: DataFrame, band: Column, keys: list[str] | None = None) -> DataFrame:
    """Join a table of one row per key to many rows per key without piling a large image onto one task.

    The side is repeated once per band that occurs in the rows (a distinct over two narrow columns), and the join key
    includes the band. Rows without a match are kept, with NULLs.
    """
    keys = keys or PLANE
    banded = rows.withColumn("_band", band)
    bands = banded.select(*keys, "_band").distinct()
    return banded.join(side.join(bands, keys), [*keys, "_band"], "left").drop("_band")


# --- blocks <-> samples ----------------------------------------------------------------------------------


def samples_to_blocks(samples: DataFrame) -> DataFrame:
    """Pack 8 x 8 blocks (pad edges first). A sample that is missing is NULL in its place; of repeated ones the largest counts.

    Each place is a maximum of its own, so samples of one block combine before the shuffle.
    """
    keyed = samples.select(
        *PLANE, idiv("y", 8).cast("int").alias("by"), idiv("x", 8).cast("int").alias("bx"),
        (F.col("y") % 8 * 8 + F.col("x") % 8).cast("int").alias("_i"), "v",
    )
    packed = keyed.groupBy(*PLANE, "by", "bx").agg(*[F.max(F.when(F.col("_i") == i, F.col("v"))).alias(f"_{i}") for i in range(64)])
    return packed.select(*PLANE, "by", "bx", F.array(*[f"_{i}" for i in range(64)]).alias("s"))


def blocks_to_samples(blocks: DataFrame, values: str = "s", nx: int = 8, ny: int = 8) -> DataFrame:
    # The outer form keeps the optimizer from evaluating the array a second time in a filter in front.
    flat = blocks.select(*PLANE, "by", "bx", F.posexplode_outer(values).alias("_i", "v")).filter("_i IS NOT NULL")
    return flat.select(
        *PLANE, (F.col("by") * ny + idiv("_i", nx)).cast("int").alias("y"),
        (F.col("bx") * nx + F.col("_i") % nx).cast("int").alias("x"), "v",
    )


def fdct(blocks: DataFrame, nx: int = 8, ny: int = 8, source: str = "s", target: str = "dct") -> DataFrame:
    """Cosine transform of level-shifted samples, nx x ny points, to 64 coefficients (doubles)."""
    return blocks.withColumn(target, dct.fdct(source, nx, ny))


def idct(blocks: DataFrame, nx: int = 8, ny: int = 8, source: str = "coef", target: str = "values") -> DataFrame:
    """Inverse transform of dequantised coefficients to nx*ny values around 128; ``dct.to_samples`` limits them."""
    return blocks.withColumn(target, dct.idct(source, nx, ny))


def dequantize(blocks: DataFrame, latched: DataFrame) -> DataFrame:
    """Multiply every coefficient by the quantiser of its component. ``latched``: ``image_id, ci, q``."""
    joined = attach(blocks, latched.select("image_id", "ci", "q"), idiv("by", BAND))
    return joined.withColumn("coef", qz.dequantize("coef", "q")).drop("q")


# --- resampling --------------------------------------------------------------------------------------------


def pad_edges(samples: DataFrame, width, height, to_width, to_height) -> DataFrame:
    """Extend each plane to a full size by repeating its last column and row. Sizes may be columns of the rows."""
    w, h, tw, th = (F.col(c) if isinstance(c, str) else F.lit(c) for c in (width, height, to_width, to_height))
    inside = samples.filter((F.col("x") < w) & (F.col("y") < h))

    def spread(at: str, last: Column, full: Column) -> Column:
        here = F.array(F.col(at).cast("int"))
        return F.when(F.col(at) == last - 1, F.sequence(F.col(at).cast("int"), F.greatest(full, last).cast("int") - 1)).otherwise(here)

    wide = inside.withColumn("x", F.explode(spread("x", w, tw)))
    return wide.withColumn("y", F.explode(spread("y", h, th)))


def _cells(samples: DataFrame, h: int, v: int) -> DataFrame:
    return samples.groupBy(*PLANE, idiv("y", v).cast("int").alias("y"), idiv("x", h).cast("int").alias("x")).agg(
        F.sum("v").alias("_sum")
    )


def downsample(samples: DataFrame, h: int, v: int) -> DataFrame:
    """Mean of h x v cells, rounded half up."""
    n = h * v
    return _cells(samples, h, v).select(*PLANE, "y", "x", idiv(F.col("_sum") + n // 2, n).cast("int").alias("v"))


def downsample_h2v1(samples: DataFrame) -> DataFrame:
    """Halve the width; the rounding bias alternates 0, 1 along a row."""
    return _cells(samples, 2, 1).select(*PLANE, "y", "x", shr(F.col("_sum") + F.col("x") % 2, 1).cast("int").alias("v"))


def downsample_h2v2(samples: DataFrame) -> DataFrame:
    """Halve both sizes; the rounding bias alternates 1, 2 along a row."""
    return _cells(samples, 2, 2).select(*PLANE, "y", "x", shr(F.col("_sum") + F.col("x") % 2 + 1, 2).cast("int").alias("v"))


def smooth_downsample(samples: DataFrame, factor: int, halve: bool, width, height) -> DataFrame:
    """Downsample with smoothing (``factor`` 0..100). ``halve``: 2:1 on both axes, else full size.

    Every sample adds its weighted value to the results it touches, and the sums combine before the shuffle. A missing
    neighbour outside the plane counts as the edge sample next to it, which is folded into the weight.
    """
    w, h = (F.col(c) if isinstance(c, str) else F.lit(c) for c in (width, height))
    member, near = (16384 - factor * 80, factor * 16) if halve else (65536 - factor * 512, factor * 64)

    def reach(at: str, size: Column) -> Column:
        """Result positions a sample touches along an axis: ``struct<o, inner, outer>``, how often it is an inner and
        how often an outer position of the result's window (edge samples stand in for the missing ones)."""
        p = F.col(at).cast("int")
        if halve:
            out, last = idiv(p, 2).cast("int"), (size / 2).cast("int") - 1
            side = F.when(p % 2 == 0, out - 1).otherwise(out + 1)
            edge = (p == 0) | (p == size - 1)
            own = F.struct(out.alias("o"), F.lit(1).alias("inner"), edge.cast("int").alias("outer"))
            other = F.struct(side.alias("o"), F.lit(0).alias("inner"), F.lit(1).alias("outer"))
            return F.filter(F.array(own, other), lambda r: (r["o"] >= 0) & (r["o"] <= last))
        edge = (p == 0).cast("int") + (p == size - 1).cast("int")
        own = F.struct(p.alias("o"), F.lit(1).alias("inner"), edge.alias("outer"))
        left = F.struct((p - 1).alias("o"), F.lit(0).alias("inner"), F.lit(1).alias("outer"))
        right = F.struct((p + 1).alias("o"), F.lit(0).alias("inner"), F.lit(1).alias("outer"))
        return F.filter(F.array(own, left, right), lambda r: (r["o"] >= 0) & (r["o"] < size))

    rows = samples.select(*PLANE, "v", "y", "x", w.alias("_w"), h.alias("_h"))
    rows = rows.withColumn("_rx", F.explode(reach("x", F.col("_w"))))
    rows = rows.withColumn("_ry", F.explode(reach("y", F.col("_h"))))
    ix, ox, iy, oy = F.col("_rx.inner"), F.col("_rx.outer"), F.col("_ry.inner"), F.col("_ry.outer")
    # Halving: a position that is inner on one axis and outer on the other counts twice, a corner once.
    side_weight = 2 * near if halve else near
    weight = ix * iy * member + (ix * oy + ox * iy) * side_weight + ox * oy * near
    total = rows.groupBy(*PLANE, F.col("_ry.o").alias("y"), F.col("_rx.o").alias("x")).agg(
        F.sum(F.col("v").cast("bigint") * weight).alias("_t")
    )
    return total.select(*PLANE, "y", "x", shr(F.col("_t") + 32768, 16).cast("int").alias("v"))


def upsample(samples: DataFrame, h: int, v: int) -> DataFrame:
    """Repeat every sample h x v times."""
    wide = samples.withColumn("_dx", F.explode(F.sequence(F.lit(0), F.lit(h - 1))))
    full = wide.withColumn("_dy", F.explode(F.sequence(F.lit(0), F.lit(v - 1))))
    return full.select(
        *PLANE, (F.col("y") * v + F.col("_dy")).cast("int").alias("y"), (F.col("x") * h + F.col("_dx")).cast("int").alias("x"), "v"
    )


def planes_to_pixels(samples: DataFrame) -> DataFrame:
    """Three full-size planes to one row per pixel: ``image_id, y, x, c0, c1, c2``."""
    pick = lambda i: F.max(F.when(F.col("ci") == i, F.col("v"))).alias(f"c{i}")
    return samples.groupBy("image_id", "y", "x").agg(pick(0), pick(1), pick(2))


def pixels_to_planes(pixels: DataFrame, columns: list[str]) -> DataFrame:
    planes = F.array(*[F.struct(F.lit(i).alias("ci"), F.col(c).alias("v")) for i, c in enumerate(columns)])
    return pixels.select("image_id", "y", "x", F.inline(planes)).select(*PLANE, "y", "x", "v")


def upsample_to_rgb(samples: DataFrame, h: int = 2, v: int = 2) -> DataFrame:
    """Fused chroma upsampling and colour conversion: luma meets its chroma on the reduced position.

    Chroma is paired at its own small size first, so only luma moves at full size.
    """
    luma = samples.filter("ci = 0").select(
        "image_id", "y", "x", F.col("v").alias("_y"), idiv("y", v).cast("int").alias("_cy"), idiv("x", h).cast("int").alias("_cx")
    )
    pick = lambda i, n: F.max(F.when(F.col("ci") == i, F.col("v"))).alias(n)
    chroma = (
        samples.filter("ci IN (1, 2)")
        .groupBy("image_id", F.col("y").cast("int").alias("_cy"), F.col("x").cast("int").alias("_cx"))
        .agg(pick(1, "_cb"), pick(2, "_cr"))
    )
    j = luma.join(chroma, ["image_id", "_cy", "_cx"], "left").fillna(128, ["_cb", "_cr"])  # images without chroma are gray
    return j.select("image_id", "y", "x", color.ycc_to_rgb("_y", "_cb", "_cr").alias("_c")).select("image_id", "y", "x", "_c.*")


# --- block smoothing -----------------------------------------------------------------------------------------


def dc_neighbours(blocks: DataFrame) -> DataFrame:
    """DC values of the 3 x 3 neighbourhood as an array, row by row, edges repeated.

    The two windows run along one row and one column of blocks. A side is at most 65500 samples, so a window holds at
    most 8188 rows, whatever the corpus looks like.
    """
    along = Window.partitionBy(*PLANE, "by").orderBy("bx")
    across = Window.partitionBy(*PLANE, "bx").orderBy("by")
    dc = F.col("coef")[0]
    rows = blocks.withColumn(
        "_row", F.array(F.coalesce(F.lag(dc).over(along), dc), dc, F.coalesce(F.lead(dc).over(along), dc))
    )
    near = F.concat(
        F.coalesce(F.lag("_row").over(across), F.col("_row")), F.col("_row"), F.coalesce(F.lead("_row").over(across), F.col("_row"))
    )
    return rows.withColumn("dcs", near).drop("_row")


def smooth_blocks(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """Predict the five lowest AC coefficients from neighbouring DC values where they are 0 and not exact.

    ``known``: ``image_id, ci, q ARRAY<INT>, bits ARRAY<INT>`` (bit positions of coefficients 0..5, zigzag order).
    """
    j = attach(dc_neighbours(blocks), known.select("image_id", "ci", "q", "bits"), idiv("by", BAND))
    d = [F.col("dcs")[i].cast("bigint") for i in range(9)]
    q, bits, coef = F.col("q"), F.col("bits"), F.col("coef")
    # natural position, zigzag index, weighted sum of DC values
    rules = (
        (1, 1, (d[3] - d[5]) * 36),
        (8, 2, (d[1] - d[7]) * 36),
        (16, 3, (d[1] + d[7] - d[4] * 2) * 9),
        (9, 4, (d[0] - d[2] - d[6] + d[8]) * 5),
        (2, 5, (d[3] + d[5] - d[4] * 2) * 9),
    )
    predicted = {}
    for pos, k, total in rules:
        num = total * q[0]
        step = q[pos].cast("bigint")
        size = idiv(step * 128 + F.abs(num), step * 256)
        top = F.pow(F.lit(2), bits[k]).cast("bigint") - 1
        size = F.when(bits[k] > 0, F.least(size, top)).otherwise(size)
        signed = F.when(num < 0, -size).otherwise(size)
        predicted[pos] = F.when((bits[k] != 0) & (coef[pos] == 0), signed).otherwise(coef[pos]).cast("int")
    values = F.array(*[predicted.get(i, coef[i].cast("int")) for i in range(64)])
    return j.withColumn("coef", values).drop("q", "bits", "dcs")


# --- whole pipeline -------------------------------------------------------------------------------------------


def pixels_to_blocks(pixels: DataFrame, quality: int, sizes: DataFrame) -> DataFrame:
    """RGB pixels to quantised coefficient blocks with chroma halved on both axes.

    ``pixels``: ``image_id, y, x, r, g, b``; ``sizes``: one row per image, ``image_id, width, height``. Planes are padded
    to whole 16 x 16 units before chroma is reduced.
    """
    c = color.rgb_to_ycc("r", "g", "b")
    planes = F.array(*[F.struct(F.lit(i).alias("ci"), c[n].alias("v")) for i, n in enumerate(("y", "cb", "cr"))])
    sized = attach(pixels, sizes.select("image_id", "width", "height"), idiv("y", 512), ["image_id"])
    long = sized.select("image_id", "y", "x", "width", "height", F.inline(planes))
    whole = {n: (idiv(F.col(n) + 15, 16) * 16).cast("int") for n in ("width", "height")}
    padded = pad_edges(long.withColumns({"_tw": whole["width"], "_th": whole["height"]}), "width", "height", "_tw", "_th")
    plane = padded.select(*PLANE, "y", "x", "v")
    reduced = plane.filter("ci = 0").unionByName(downsample_h2v2(plane.filter("ci > 0")))
    coefs = fdct(samples_to_blocks(reduced))
    # The integer transform carries three extra bits; so do the steps.
    scaled = F.transform("dct", lambda x: F.round(x * 8).cast("int"))
    steps = lambda chroma: F.transform(qz.quant_table(qz.quality_scale(F.lit(quality)), chroma), lambda t: t * 8)
    q = F.when(F.col("ci") == 0, steps(False)).otherwise(steps(True))
    return coefs.select(*PLANE, "by", "bx", qz.quantize(scaled, q).alias("coef"))


def blocks_to_pixels(blocks: DataFrame, quality: int) -> DataFrame:
    """The way back: dequantise, transform, upsample chroma, convert. Gives the padded size."""
    table = lambda chroma: qz.quant_table(qz.quality_scale(F.lit(quality)), chroma)
    q = F.when(F.col("ci") == 0, table(False)).otherwise(table(True))
    values = idct(blocks.withColumn("coef", qz.dequantize("coef", q)))
    samples = blocks_to_samples(values.select(*PLANE, "by", "bx", dct.to_samples("values").alias("s")))
    return upsample_to_rgb(samples)
