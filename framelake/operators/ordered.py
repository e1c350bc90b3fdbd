"""Ordered operators that survive hot keys.

A plain window puts every row of a key into one task. Here the order is cut into chunks of fixed width first:
the window runs per (key, chunk), one summary row per chunk is carried forward over the much shorter chunk
list, and joined back. The join reuses the partitioning of the window, so the rows move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65536


def row_cuts(df: DataFrame, order: str, rows: int = 1 << 20, most: int = 256) -> list[float]:
    """Values of a numeric column that cut the table into parts of about ``rows`` rows, at most ``most`` parts. Two scans of it."""
    parts = min(most, -(-df.count() // rows))
    return sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.001))) if parts > 1 else []


def _chunk(order: Column, width: float | Column) -> Column:
    """The chunk of a row: by a width of the order, or as given."""
    if isinstance(width, Column):
        return width
    return F.floor(order.cast("double") / F.lit(float(width))).cast("bigint")


def previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, str],
    chunk: float | Column = CHUNK,
) -> DataFrame:
    """Add, per key in the given order, the value of each column on the row before (NULL on the first).

    ``columns`` maps a source column to the new name. The first order column must be numeric; it makes the
    chunks. Keys must not be NULL.
    """
    cut = df.withColumn("_chunk", _chunk(F.col(order[0]), chunk))
    # A single order column keeps the carried values flat, so that numbers aggregate by hash and not by sort.
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    tails = cut.groupBy(*keys, "_chunk").agg(*[F.max_by(F.col(c), at).alias(f"_t_{n}") for c, n in columns.items()])
    carried = tails.select(*keys, "_chunk", *[F.lag(f"_t_{n}").over(across).alias(f"_c_{n}") for n in columns.values()])
    rows = cut.withColumns({f"_p_{n}": F.lag(c).over(inside) for c, n in columns.items()})
    rows = rows.withColumn("_first", F.row_number().over(inside) == 1)
    out = rows.join(carried, [*keys, "_chunk"], "left")
    before = {n: F.when(F.col("_first"), F.col(f"_c_{n}")).otherwise(F.col(f"_p_{n}")) for n in columns.values()}
    return out.withColumns(before).select(*df.columns, *columns.values())


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, str],
    chunk: float | Column = CHUNK,
) -> DataFrame:
    """Add, per key, the running total of each column up to and including the row. The order must be unique."""
    cut = df.withColumn("_chunk", _chunk(F.col(order[0]), chunk))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_t_{n}") for c, n in columns.items()])
    before = totals.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_b_{n}") for n in columns.values()],
    )
    rows = cut
    for c, n in columns.items():
        rows = rows.withColumn(n, F.sum(c).over(inside))
    out = rows.join(before, [*keys, "_chunk"], "left")
    for n in columns.values():
        out = out.withColumn(n, F.col(n) + F.col(f"_b_{n}"))
    return out.select(*df.columns, *columns.values())


def last_known(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, str],
    chunk: float | Column = CHUNK,
) -> DataFrame:
    """Add, per key, the last non-NULL value of each column up to and including the row (an as-of lookup)."""
    cut = df.withColumn("_chunk", _chunk(F.col(order[0]), chunk))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    tails = cut.groupBy(*keys, "_chunk").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"_t_{n}") for c, n in columns.items()]
    )
    before = tails.select(
        *keys, "_chunk", *[F.last(f"_t_{n}", ignorenulls=True).over(across).alias(f"_b_{n}") for n in columns.values()]
    )
    rows = cut
    for c, n in columns.items():
        rows = rows.withColumn(n, F.last(c, ignorenulls=True).over(inside))
    out = rows.join(before, [*keys, "_chunk"], "left")
    for n in columns.values():
        out = out.withColumn(n, F.coalesce(F.col(n), F.col(f"_b_{n}")))
    return out.select(*df.columns, *columns.values())
