"""Quantiser tables and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .exprs import clamp, col, idiv, int_array


def quality_scale(quality) -> Column:
    """Percentage scale of a quality rating 1..100."""
    q = clamp(quality, 1, 100)
    return F.when(q < 50, idiv(F.lit(5000), q)).otherwise(F.lit(200) - q * 2)


def quant_table(scale, chroma: bool = False, baseline: bool = True) -> Column:
    """Standard table scaled by a percentage, each value limited to 1..255 (baseline) or 1..32767."""
    base = int_array(fixed.CHROMA_QUANT if chroma else fixed.LUMA_QUANT)
    s, top = col(scale), 255 if baseline else 32767
    return F.transform(base, lambda b: clamp(idiv(b * s + 50, 100), 1, top).cast("int"))


def quantize(coefs, q, doubled: bool = False) -> Column:
    """Divide with symmetric rounding. ``doubled``: big-gamut chroma made from ordinary colours uses twice the step."""

    def step(c: Column, t: Column) -> Column:
        t = t * 2 if doubled else t
        size = idiv(F.abs(c) + idiv(t, 2), t)
        return F.when(c < 0, -size).otherwise(size).cast("int")

    return F.zip_with(col(coefs), col(q), step)


def dequantize(coefs, q) -> Column:
    return F.zip_with(col(coefs), col(q), lambda c, t: c.cast("int") * t)
