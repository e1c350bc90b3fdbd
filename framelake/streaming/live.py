"""Live views: counters, ticks and plans over streams. The batch operators are reused as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import rotation_plan
from ..operators.status import EVENTS, batch_state, batch_status


def read_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the Parquet files of a folder whose names match a pattern."""
    reader = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def stream_status(run_log: DataFrame) -> DataFrame:
    """Counters and state per run, for update or complete mode. Once drained it equals the batch result."""
    return batch_state(batch_status(run_log))


def stream_ticks(run_log: DataFrame, period: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event counts per run and fixed period; in append mode a period comes out once the watermark has passed it."""
    ticks = run_log.withWatermark("ts", late).groupBy(F.window("ts", period), "run_id")
    counted = ticks.agg(*[F.count_if(F.col("event") == e).alias(e) for e in EVENTS])
    return counted.select(F.col("window.start").alias("tick"), "run_id", *EVENTS)


def stream_plans(catalog: DataFrame) -> DataFrame:
    """Rotation plan of every catalogue row as it arrives. Stateless, so it scales with the input."""
    return rotation_plan(catalog)


def drain(stream: DataFrame, folder: str, checkpoint: str, complete: bool) -> DataFrame:
    """Process what is available into a Parquet folder and return it. Complete results replace the folder each time."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if complete:
        writer = writer.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(folder))
    else:
        writer = writer.outputMode("append").format("parquet").option("path", folder)
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)
