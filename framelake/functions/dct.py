"""Forward and inverse cosine transforms of any size from 1 to 16 per axis.

One basis table per size replaces a kernel per size. A transform of a block is one product with a fixed matrix of at
most 64 x 256 numbers; Spark hands the blocks over in Arrow batches and numpy multiplies a whole batch at once. Written
as built-in expressions the same sums are either a thousand plan nodes or a thousand interpreted steps per block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import col


def basis(n: int, forward: bool) -> np.ndarray:
    """``basis[u, x]`` of an n-point transform with 8 rows; frequencies from n on are zero."""
    out = np.zeros((8, n))
    for u in range(min(n, 8)):
        c = math.sqrt(0.5) if u == 0 else 1.0
        scale = (4.0 / n if forward else 0.5) * c
        out[u] = [scale * math.cos((2 * x + 1) * u * math.pi / (2 * n)) for x in range(n)]
    return out


def _times(matrix: np.ndarray, before: float, after: float, missing: float | None = None):
    """Arrow function on lists of equal length: (list + before) times the matrix, plus after. NULL stays NULL.

    ``missing`` stands in for NULL values of a list, which without it make the whole list NaN.
    """

    def apply(lists: pa.Array) -> pa.Array:
        valid = lists.is_valid().to_numpy(zero_copy_only=False)
        flat = lists.drop_null().flatten()
        if missing is not None:
            flat = flat.fill_null(missing)
        flat = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        result = (flat.reshape(-1, matrix.shape[0]) + before) @ matrix + after
        width = matrix.shape[1]
        ends = np.concatenate(([0], np.cumsum(valid * width))).astype(np.int32)
        mask = None if valid.all() else pa.array(~valid)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(result.ravel()), mask=mask)

    return F.arrow_udf(apply, "array<double>")


def fdct(samples, nx: int = 8, ny: int = 8) -> Column:
    """64 coefficients of nx*ny samples (row by row), after subtracting 128. A NULL sample adds nothing to any of them."""
    matrix = np.kron(basis(ny, True), basis(nx, True)).T
    return _times(matrix, -128.0, 0.0, missing=128.0)(col(samples).cast("array<double>"))


def idct(coefs, nx: int = 8, ny: int = 8) -> Column:
    """nx*ny values around 128 from 64 dequantised coefficients; not yet rounded."""
    matrix = np.kron(basis(ny, False), basis(nx, False))
    return _times(matrix, 0.0, 128.0)(col(coefs).cast("array<double>"))


def to_samples(values) -> Column:
    """Round and limit to 0..255. Six places are kept first, so that halves don't depend on the order of a sum."""
    return F.transform(col(values), lambda v: F.least(F.greatest(F.floor(F.round(v, 6) + 0.5), F.lit(0)), F.lit(255)).cast("int"))
