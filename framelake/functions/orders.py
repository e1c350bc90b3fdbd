"""Zigzag and natural order of block coefficients, built by rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import col, int_array

STRIDE = 8


def zigzag_positions(n: int = 8) -> list[int]:
    """Natural-order position (stride 8) of each zigzag index of an n x n block."""
    out = []
    for diagonal in range(2 * n - 1):
        cells = [(r, diagonal - r) for r in range(n) if 0 <= diagonal - r < n]
        if diagonal % 2 == 0:
            cells.reverse()
        out += [r * STRIDE + c for r, c in cells]
    return out


def zigzag_ranks(n: int = 8) -> list[int]:
    """Zigzag index of each of the 64 natural positions; 64 where the n x n block has none."""
    ranks = [64] * 64
    for i, pos in enumerate(zigzag_positions(n)):
        ranks[pos] = i
    return ranks


def to_zigzag(block, n: int = 8) -> Column:
    """The n*n low coefficients of a 64-entry natural-order block, in zigzag order."""
    b = col(block)
    return F.transform(int_array(zigzag_positions(n)), lambda p: b[p])


def to_natural(coefs, n: int = 8) -> Column:
    """A 64-entry natural-order block from n*n zigzag coefficients; the other entries are 0."""
    c = col(coefs)
    return F.transform(int_array(zigzag_ranks(n)), lambda z: F.when(z < n * n, c[z]).otherwise(F.lit(0)))
