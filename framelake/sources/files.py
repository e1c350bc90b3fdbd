"""Image files and stored tables in and out."""

from __future__ import annotations

import posixpath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import idiv


def _glob() -> str:
    """File-name pattern of the known extensions in any case, so that other files are not even opened."""
    any_case = ["".join(f"[{c}{c.upper()}]" for c in ext) for ext in fixed.EXTENSIONS]
    return "*.{" + ",".join(any_case) + "}"


def scan_images(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Image files of a folder by extension: ``image_id`` (the path), ``modified``, ``length``, ``content``.

    The bytes are only read by queries that use ``content``.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", _glob())
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
    )
    return files.select(
        F.col("path").alias("image_id"), F.col("modificationTime").alias("modified"), "length", "content"
    )


PIXEL_SCHEMA = "image_id string, y int, x int, r int, g int, b int"
ROWS_PER_BATCH = 1 << 16


def _decoded(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("image").option("pathGlobFilter", _glob()).option("dropInvalid", False).load(folder)


def undecodable(spark: SparkSession, folder: str) -> DataFrame:
    """Findings for the images of a folder that can't be decoded: ``image_id, issue, severity``."""
    bad = _decoded(spark, folder).filter("image.height IS NULL OR image.height <= 0")
    return bad.select(F.col("image.origin").alias("image_id"), F.lit("undecodable").alias("issue"), F.lit("error").alias("severity"))


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded pixels of the images of a folder, one row each. Spark decodes; the bytes (blue, green, red) are cut into
    batches of bounded size on the way out. Images that can't be decoded are listed by ``undecodable``."""
    images = _decoded(spark, folder).filter("image.height > 0")
    slim = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h, w, n = row["height"], row["width"], row["nChannels"]
                data = np.frombuffer(row["data"], dtype=np.uint8).reshape(h * w, n).astype(np.int32)
                for at in range(0, h * w, ROWS_PER_BATCH):
                    part = data[at : at + ROWS_PER_BATCH]
                    where = np.arange(at, at + len(part), dtype=np.int32)
                    red, green, blue = (part[:, 2], part[:, 1], part[:, 0]) if n >= 3 else (part[:, 0],) * 3
                    yield pa.RecordBatch.from_pydict(
                        {
                            "image_id": pa.array([row["origin"]] * len(part), pa.string()),
                            "y": pa.array(where // w), "x": pa.array(where % w),
                            "r": pa.array(red), "g": pa.array(green), "b": pa.array(blue),
                        }
                    )

    return slim.mapInArrow(unpack, PIXEL_SCHEMA)


def write_blocks(blocks: DataFrame, path: str, buckets: int = 64, mode: str = "errorifexists") -> None:
    """Store coefficient blocks, partitioned by image bucket and sorted inside; the rows carry the number of buckets.

    The rows are dealt by ranges of bucket, image, component and band of block rows: a task writes neighbouring buckets
    only, so there are few files, and a huge image is written by many tasks.
    """
    bucket = F.pmod(F.xxhash64("image_id"), F.lit(buckets)).cast("int")
    rows = blocks.withColumns({"bucket": bucket, "buckets": F.lit(buckets), "coef": F.col("coef").cast("array<smallint>"), "_band": idiv("by", 64)})
    spread = rows.repartitionByRange("bucket", "image_id", "ci", "_band").drop("_band")
    ordered = spread.sortWithinPartitions("bucket", "image_id", "ci", "by", "bx")
    ordered.write.mode(mode).partitionBy("bucket").parquet(path)


def read_blocks(spark: SparkSession, path: str, image_id=None) -> DataFrame:
    """Stored blocks; for one image only its bucket is read, found by the number of buckets that the table itself names."""
    rows = spark.read.parquet(path)
    if image_id is not None:
        wanted = F.lit(image_id).cast(rows.schema["image_id"].dataType)
        first = rows.select("buckets").first()
        bucket = F.pmod(F.xxhash64(wanted), F.lit(first["buckets"] if first else 1))
        rows = rows.filter((F.col("image_id") == wanted) & (F.col("bucket") == bucket))
    return rows.drop("bucket", "buckets").withColumn("coef", F.col("coef").cast("array<int>"))


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder as the file system names it: with scheme and authority, without ``..`` and double slashes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{posixpath.normpath(uri.getPath())}".rstrip("/") + "/"


def write_results(rows: DataFrame, folder: str, source: str | None = None) -> None:
    """Write results as Parquet to a new folder; never into the folder that the images came from."""
    if source is not None:
        out, src = (_qualified(rows.sparkSession, f) for f in (folder, source))
        if out.startswith(src) or src.startswith(out):
            raise ValueError("results must not be written into the source folder")
    rows.write.mode("errorifexists").parquet(folder)
