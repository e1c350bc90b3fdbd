"""Small column helpers shared by all operators. Everything here stays a Catalyst expression."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def idiv(a, b) -> Column:
    """Integer division that truncates toward zero and stays integral (BIGINT)."""
    return F.call_function("div", col(a).cast("bigint"), col(b).cast("bigint"))


def ceil_div(a, b) -> Column:
    """Round-up division for non-negative operands."""
    b = col(b)
    return idiv(col(a) + b - F.lit(1), b)


def clamp(c, lo: int, hi: int) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def shr(c, bits: int) -> Column:
    """Arithmetic right shift."""
    return F.shiftright(col(c), bits)


def int_array(values: Iterable[int], kind: str = "int") -> Column:
    return F.array(*[F.lit(int(v)) for v in values]).cast(f"array<{kind}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside a lambda."""
    return F.transform(F.array(value), body)[0]


def u8(data, at) -> Column:
    """Byte at a 0-based position of a binary column; NULL outside."""
    return be(data, at, 1)


def be(data, at, size: int) -> Column:
    """Big-endian unsigned integer of ``size`` bytes at a 0-based position; NULL if it does not fit."""
    raw = col(data).substr(col(at).cast("int") + 1, F.lit(size))
    return F.when(F.length(raw) == size, F.conv(F.hex(raw), 16, 10).cast("bigint"))


def u16(data, at) -> Column:
    return be(data, at, 2)


def starts_with(data, prefix: bytes) -> Column:
    return col(data).substr(F.lit(1), F.lit(len(prefix))) == F.unhex(F.lit(prefix.hex()))

