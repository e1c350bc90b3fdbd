"""Sizes: output dimensions, whole-unit sizes, trimming, crop requests, scaling choices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .exprs import ceil_div, col, idiv, let


def swaps_axes(transform) -> Column:
    return col(transform).isin(*fixed.SWAPS_AXES)


def mirrors_x(transform) -> Column:
    return col(transform).isin(*fixed.MIRRORS_X)


def mirrors_y(transform) -> Column:
    return col(transform).isin(*fixed.MIRRORS_Y)


def output_size(width, height, transform) -> tuple[Column, Column]:
    s, w, h = swaps_axes(transform), col(width), col(height)
    return F.when(s, h).otherwise(w), F.when(s, w).otherwise(h)


def imcu_size(ncomp, max_h, max_v, transform, dct: int = fixed.DCT_SIZE) -> tuple[Column, Column]:
    """Interleaved unit size of the destination. One component uses the bare block size."""
    single, s = col(ncomp) == 1, swaps_axes(transform)
    uw = F.when(single, F.lit(dct)).otherwise(col(max_h) * dct)
    uh = F.when(single, F.lit(dct)).otherwise(col(max_v) * dct)
    return F.when(s, uh).otherwise(uw), F.when(s, uw).otherwise(uh)


def is_perfect(width, height, unit_w, unit_h, transform) -> Column:
    """True if no partial unit is in the way. Units are those of the source image."""
    t = col(transform)
    w_ok, h_ok = col(width) % col(unit_w) == 0, col(height) % col(unit_h) == 0
    return (
        F.when(t.isin(fixed.FLIP_H, fixed.ROT_270), w_ok)
        .when(t.isin(fixed.FLIP_V, fixed.ROT_90), h_ok)
        .when(t.isin(fixed.TRANSVERSE, fixed.ROT_180), w_ok & h_ok)
        .otherwise(F.lit(True))
    )


def trim_edges(out_w, out_h, full_w, full_h, unit_w, unit_h, x_off, y_off, transform) -> tuple[Column, Column]:
    """Cut the mirrored edges to whole units, if the crop reaches the last whole unit of the full result.

    ``full_*`` and ``unit_*`` are those of the destination, so one rule covers every transform: an axis is
    trimmed exactly when the transform mirrors it.
    """

    def cut(size, full, unit, off, applies):
        whole = idiv(size, unit)
        hit = applies & (whole > 0) & (col(off) + whole == idiv(full, unit))
        return F.when(hit, whole * col(unit)).otherwise(col(size))

    return (
        cut(col(out_w), full_w, unit_w, x_off, mirrors_x(transform)),
        cut(col(out_h), full_h, unit_h, y_off, mirrors_y(transform)),
    )


# --- crop requests ---------------------------------------------------------------------------------

# Fixed value: the crop request format.
CROP_FORMAT = r"\A(?:(\d+)([fF])?)?(?:[xX](\d+)([fF])?)?(?:([+-])(\d+))?(?:([+-])(\d+))?\z"


# Fixed value: the parts of a request, set apart by a character that no valid request contains.
CROP_PARTS = "|".join(f"${i}" for i in range(1, 9))


def crop_parts(spec) -> Column:
    """The parts of a crop request as an array of texts; NULL if it can't be read.

    One match splits the request into its parts; reading group by group would match the pattern a dozen times.
    """
    s = col(spec)
    return F.when(s.rlike(CROP_FORMAT), F.split(F.regexp_replace(s, CROP_FORMAT, CROP_PARTS), "[|]"))


def crop_fields(part: Column) -> dict[str, Column]:
    """Numbers and states (unset, pos, neg, force) of the parts of a request."""

    def number(i: int) -> Column:
        # 32-bit wrap-around: a value modulo 2^32 depends on its last 32 decimal digits only.
        digits = F.right(part[i], F.lit(32))
        wrapped = (digits.cast("decimal(38,0)") % F.lit(2**32).cast("decimal(38,0)")).cast("bigint")
        small = digits.cast("bigint")
        return F.when(F.length(digits).between(1, 9), small).when(digits != "", wrapped)

    def extent_state(i: int) -> Column:
        return F.when(part[i] == "", "unset").when(part[i + 1] != "", "force").when(part.isNotNull(), "pos")

    def offset_state(i: int) -> Column:
        return F.when(part[i + 1] == "", "unset").when(part[i] == "-", "neg").when(part.isNotNull(), "pos")

    return {
        "w": number(0), "w_state": extent_state(0), "h": number(2), "h_state": extent_state(2),
        "x": number(5), "x_state": offset_state(4), "y": number(7), "y_state": offset_state(6),
    }


def parse_crop(spec) -> Column:
    """``<w>[f]x<h>[f]{+-}<x>{+-}<y>`` with every part optional. States: unset, pos, neg, force. NULL if invalid."""
    parts = crop_parts(spec)
    return F.when(parts.isNotNull(), let(parts, lambda part: F.struct(*(v.alias(k) for k, v in crop_fields(part).items()))))


# --- scaling ---------------------------------------------------------------------------------------


def scaled_size(width, height, num, den, block: Column | int = 8) -> Column:
    """Smallest k in 1..16 with num*block <= den*k (16 if none); sizes scale by k/block, rounded up."""
    b = col(block)
    k = F.least(F.greatest(ceil_div(col(num) * b, den), F.lit(1)), F.lit(16))
    return F.struct(
        k.cast("int").alias("k"),
        ceil_div(col(width) * k, b).alias("out_w"),
        ceil_div(col(height) * k, b).alias("out_h"),
    )


def jpeg_size(width, height, num, den, block: Column | int = 8) -> Column:
    """Encoder side: smallest k in 1..16 with num*k >= den*block (16 if none); stored size = size*block/k."""
    b = col(block)
    k = F.least(F.greatest(ceil_div(col(den) * b, num), F.lit(1)), F.lit(16))
    fits = (col(width) < 2**24) & (col(height) < 2**24)
    return F.struct(
        fits.alias("ok"),
        k.cast("int").alias("k"),
        F.when(fits, ceil_div(col(width) * b, k)).alias("jpeg_w"),
        F.when(fits, ceil_div(col(height) * b, k)).alias("jpeg_h"),
    )


def dct_doubling(max_samp, samp, min_size, limit) -> Column:
    """How far one axis of a component may be scaled in the transform: 1, 2 or 4."""
    m, s, k, lim = col(max_samp), col(samp), col(min_size), col(limit)
    two = (k <= lim) & (m % (s * 2) == 0)
    four = two & (k * 2 <= lim) & (m % (s * 4) == 0)
    return F.when(four, F.lit(4)).when(two, F.lit(2)).otherwise(F.lit(1))


def component_scale(h, v, max_h, max_v, min_size, fancy) -> Column:
    """Transform size of a component per axis; the two axes may differ by a factor of two at most."""
    limit = F.when(col(fancy), F.lit(8)).otherwise(F.lit(4))
    sh = dct_doubling(max_h, h, min_size, limit) * col(min_size)
    sv = dct_doubling(max_v, v, min_size, limit) * col(min_size)
    return F.struct(F.least(sh, sv * 2).cast("int").alias("scale_h"), F.least(sv, sh * 2).cast("int").alias("scale_v"))


def block_size_from_limit(last_coef) -> Column:
    """Block size n when the last coefficient index is n*n-1 with n in 1..16; NULL otherwise."""
    e = col(last_coef)
    cases = [F.when(e == n * n - 1, F.lit(n)) for n in range(1, 17)]
    return F.coalesce(*cases)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
