"""Expressions on one 64-entry coefficient block and its position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from . import geometry as g
from .exprs import ceil_div, col, idiv, int_array

AXES_SWAPPED = [(i % 8) * 8 + i // 8 for i in range(64)]
ODD_COLUMNS = [-1 if i % 8 % 2 else 1 for i in range(64)]
ODD_ROWS = [-1 if i // 8 % 2 else 1 for i in range(64)]
ODD_BOTH = [a * b for a, b in zip(ODD_COLUMNS, ODD_ROWS)]


def swap_axes(block) -> Column:
    b = col(block)
    return F.transform(int_array(AXES_SWAPPED), lambda i: b[i])


def turn_block(block, swap, mirror_x, mirror_y) -> Column:
    """Swap the axes of a block, then mirror it. Mirroring negates the odd columns and / or rows."""
    b, mx, my = col(block), col(mirror_x), col(mirror_y)
    base = F.when(col(swap), swap_axes(b)).otherwise(b)
    signs = F.when(mx & my, int_array(ODD_BOTH)).when(mx, int_array(ODD_COLUMNS)).otherwise(int_array(ODD_ROWS))
    return F.when(mx | my, F.zip_with(base, signs, lambda c, s: c * s)).otherwise(base)


def zero_block() -> Column:
    return F.array_repeat(F.lit(0), fixed.BLOCK_LEN)


def low_frequency(block, k: int) -> Column:
    """Keep the k x k lowest coefficients."""
    keep = [1 if i // 8 < k and i % 8 < k else 0 for i in range(64)]
    return F.zip_with(col(block), int_array(keep), lambda c, m: c * m)


def sampling(transform, ncomp, h, v) -> tuple[Column, Column]:
    """Sampling of a component in the result; a lone component counts as 1 x 1."""
    single, s = col(ncomp) == 1, g.swaps_axes(transform)
    ch, cv = F.when(single, F.lit(1)).otherwise(col(h)), F.when(single, F.lit(1)).otherwise(col(v))
    return F.when(s, cv).otherwise(ch), F.when(s, ch).otherwise(cv)


def whole_blocks(transform, width, height, ncomp, max_h, max_v, h, v) -> tuple[Column, Column]:
    """Blocks of a component that lie in whole units of the result; only these are mirrored."""
    dh, dv = sampling(transform, ncomp, h, v)
    fw, fh = g.output_size(width, height, transform)
    uw, uh = g.imcu_size(ncomp, max_h, max_v, transform)
    return idiv(fw, uw) * dh, idiv(fh, uh) * dv


def place_block(transform, by, bx, coef, width, height, ncomp, max_h, max_v, h, v) -> Column:
    """Where a block goes and what becomes of it: ``struct<by, bx, coef>``.

    One rule serves all transforms: swap axes, then mirror each destination axis inside the whole-unit area.
    """
    s = g.swaps_axes(transform)
    wide, high = whole_blocks(transform, width, height, ncomp, max_h, max_v, h, v)
    tx, ty = F.when(s, col(by)).otherwise(col(bx)), F.when(s, col(bx)).otherwise(col(by))
    mx, my = g.mirrors_x(transform) & (tx < wide), g.mirrors_y(transform) & (ty < high)
    return F.struct(
        F.when(my, high - 1 - ty).otherwise(ty).cast("int").alias("by"),
        F.when(mx, wide - 1 - tx).otherwise(tx).cast("int").alias("bx"),
        turn_block(coef, s, mx, my).alias("coef"),
    )


def blocks_across(size, samp, unit) -> Column:
    """Blocks of a component along an axis of ``size`` samples."""
    return ceil_div(col(size) * col(samp), unit)


def point_transform(block, ss: int, se: int, al: int) -> Column:
    """First-pass values of coefficients ss..se (zigzag order): DC shifts arithmetically, AC by magnitude."""
    from .orders import zigzag_positions

    b = col(block)
    positions = zigzag_positions()[ss : se + 1]

    def shifted(p: Column) -> Column:
        c = b[p].cast("int")
        ac = (F.signum(c).cast("int")) * F.shiftright(F.abs(c), al)
        return F.when(p == 0, F.shiftright(c, al)).otherwise(ac)

    return F.transform(int_array(positions), shifted)


def dc_refinement(block, al: int) -> Column:
    """The next bit of the DC value."""
    return F.shiftright(col(block)[0].cast("int"), al).bitwiseAND(1)


def category(value) -> Column:
    """Magnitude category: 0 for 0, otherwise the number of bits of the absolute value."""
    v = F.abs(col(value).cast("bigint"))
    return F.when(v == 0, F.lit(0)).otherwise(F.length(F.bin(v)))


def out_of_range(dc_diff=None, ac=None) -> Column:
    """Category too large for 8-bit data: above 11 for a DC difference, above 10 for AC."""
    return category(dc_diff) > 11 if dc_diff is not None else category(ac) > 10
