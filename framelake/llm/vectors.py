"""What the two vector searches share: usable rows, copies, and merging of the best found per block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(table: DataFrame, vector: str = "embedding", zero: bool = False) -> DataFrame:
    """``vec_id, v`` (doubles) of rows whose id is given and whose vector has only finite components, ``zero`` ones if wanted.

    All that take part have one length, the commonest among these rows (of equally common ones the shortest): no distance or
    product is defined between others. Of several rows with one id, the smallest vector stands for it.
    """
    v = F.col("v")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    if not zero:
        good &= F.exists(v, lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & good)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common:
        rows = rows.filter(F.size("v") == common["n"])
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array, dtype="f8") -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def best(found: DataFrame, k: int, order: Column) -> DataFrame:
    """The first k rows of each query by ``order`` and then the smaller id: ``query_id, rank, vec_id, score``."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
