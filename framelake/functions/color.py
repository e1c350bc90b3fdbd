"""Colour conversions in 16-bit fixed point, as integer column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import clamp, col, shr

HALF = 1 << 15
CENTER = 128 << 16


def fix(x: float) -> int:
    """A constant with 16 fractional bits."""
    return int(x * 65536 + 0.5)


def _named(**values: Column) -> Column:
    return F.struct(*[v.cast("int").alias(k) for k, v in values.items()])


def luma(r, g, b) -> Column:
    """Gray value of a colour."""
    return shr(col(r) * fix(0.29900) + col(g) * fix(0.58700) + col(b) * fix(0.11400) + HALF, 16)


def rgb_to_ycc(r, g, b) -> Column:
    r, g, b = col(r), col(g), col(b)
    chroma_round = CENTER + HALF - 1
    cb = shr(b * fix(0.5) - r * fix(0.168735892) - g * fix(0.331264108) + chroma_round, 16)
    cr = shr(r * fix(0.5) - g * fix(0.418687589) - b * fix(0.081312411) + chroma_round, 16)
    return _named(y=luma(r, g, b), cb=cb, cr=cr)


def rgb_to_gray(r, g, b) -> Column:
    return luma(r, g, b).cast("int")


def cmyk_to_ycck(c, m, y, k) -> Column:
    t = rgb_to_ycc(F.lit(255) - col(c), F.lit(255) - col(m), F.lit(255) - col(y))
    return _named(y=t["y"], cb=t["cb"], cr=t["cr"], k=col(k))


def rgb_to_subtract_green(r, g, b) -> Column:
    r, g, b = col(r), col(g), col(b)
    return _named(r=(r - g + 128).bitwiseAND(255), g=g, b=(b - g + 128).bitwiseAND(255))


def _to_rgb(y, cb, cr, scale: int) -> tuple[Column, Column, Column]:
    y, cb, cr = col(y), col(cb) - 128, col(cr) - 128
    r = y + shr(cr * fix(1.402 * scale) + HALF, 16)
    g = y + shr(HALF - cb * fix(0.344136286 * scale) - cr * fix(0.714136286 * scale), 16)
    b = y + shr(cb * fix(1.772 * scale) + HALF, 16)
    return r, g, b


def ycc_to_rgb(y, cb, cr) -> Column:
    r, g, b = _to_rgb(y, cb, cr, 1)
    return _named(r=clamp(r, 0, 255), g=clamp(g, 0, 255), b=clamp(b, 0, 255))


def bgycc_to_rgb(y, cb, cr) -> Column:
    """Big-gamut variant: chroma counts double."""
    r, g, b = _to_rgb(y, cb, cr, 2)
    return _named(r=clamp(r, 0, 255), g=clamp(g, 0, 255), b=clamp(b, 0, 255))


def ycck_to_cmyk(y, cb, cr, k) -> Column:
    r, g, b = _to_rgb(y, cb, cr, 1)
    return _named(
        c=clamp(F.lit(255) - r, 0, 255), m=clamp(F.lit(255) - g, 0, 255), y=clamp(F.lit(255) - b, 0, 255), k=col(k)
    )


def subtract_green_to_rgb(r, g, b) -> Column:
    r, g, b = col(r), col(g), col(b)
    return _named(r=(r + g - 128).bitwiseAND(255), g=g, b=(b + g - 128).bitwiseAND(255))


def subtract_green_to_gray(r, g, b) -> Column:
    t = subtract_green_to_rgb(r, g, b)
    return luma(t["r"], t["g"], t["b"]).cast("int")


def gray_to_rgb(y) -> Column:
    return _named(r=col(y), g=col(y), b=col(y))


def ycc_to_gray(y, cb=None, cr=None) -> Column:
    return col(y)
