"""Batch progress: counters, state, texts and telemetry of runs, from an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from .ordered import row_cuts, running_sum

# Event names of the log, in counter order.
EVENTS = ("selected", "analysed", "to_be_rotated", "rotated", "errored")


def batch_status(run_log: DataFrame) -> DataFrame:
    """Counters per run. Partial counts are made before the shuffle, so a dominant run costs one row per task."""
    return run_log.groupBy("run_id").agg(*[F.count_if(F.col("event") == e).alias(e) for e in EVENTS])


def batch_state(status: DataFrame) -> DataFrame:
    """State of a run, the key of its message and the message arguments."""
    sel, ana, todo, rot, err = (F.col(e) for e in EVENTS)
    several = (todo > 1) | ((err == 1) & (todo == 1))
    state = (
        F.when(sel == 0, "no_jpegs")
        .when(ana < sel, "analysing")
        .when(rot + err < todo, "processing")
        .when(todo == 0, "nothing_to_rotate")
        .when(rot == todo, "done_all")
        .otherwise("done_with_errors")
    )
    s = F.col("state")
    key = (
        F.when(s == "no_jpegs", "noJPEGsInDirectory")
        .when(s == "analysing", F.when(ana > 1, "analysedMany").otherwise("analysedOne"))
        .when(s == "nothing_to_rotate", "noImagesToBeRotated")
        .when(s == "done_all", F.when(rot > 1, "processedAllMany").otherwise("processedAllOne"))
        .otherwise(F.when(several, "processedMany").otherwise("processedOne"))
    )
    return status.withColumn("state", state).withColumn("message", key).withColumns(
        {"arg1": F.when(s == "analysing", ana).otherwise(rot), "arg2": todo}
    )


def messages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.MESSAGES), "lang string, message string, text string")


def status_text(state: DataFrame, lang: str, texts: DataFrame | None = None) -> DataFrame:
    """Attach the text of a message in a language, falling back to en-US. The built-in texts are a fixed
    table of under 30 rows and are broadcast; a given table is left to the optimizer."""
    own = messages(state.sparkSession) if texts is None else texts
    wanted = own.filter(F.col("lang") == lang).select("message", F.col("text").alias("_t"))
    default = own.filter(F.col("lang") == "en-US").select("message", F.col("text").alias("_d"))
    if texts is None:
        wanted, default = F.broadcast(wanted), F.broadcast(default)
    out = state.join(wanted, "message", "left").join(default, "message", "left")
    pattern = F.replace(F.coalesce("_t", "_d"), F.lit("%lu"), F.lit("%d"))
    return out.withColumn("text", F.call_function("format_string", pattern, "arg1", "arg2")).drop("_t", "_d")


def hresult_text(code) -> Column:
    """Error code as text: 0x and the upper-case hexadecimal digits of its 32 bits."""
    return F.concat(F.lit("0x"), F.hex(F.col(code).cast("bigint").bitwiseAND(0xFFFFFFFF)))


def telemetry(run_log: DataFrame) -> DataFrame:
    """Per event name: how often it happened, in how many runs, and the largest count in one run."""
    per_run = run_log.groupBy("event", "run_id").agg(F.count("*").alias("n"))
    return per_run.groupBy("event").agg(
        F.sum("n").alias("events"), F.count("*").alias("runs"), F.max("n").alias("largest")
    )


def progress(run_log: DataFrame, chunk_seconds: float = 86400.0) -> DataFrame:
    """Counters after each event of each run, in time order (ties by image).

    A window runs over a run's events of one stretch of ``chunk_seconds``, cut further where the log is dense, so that a run
    with one busy day is spread as well.
    """
    log = run_log.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    for e in EVENTS:
        log = log.withColumn(f"_is_{e}", (F.col("event") == e).cast("bigint"))
    cuts = F.array(*map(F.lit, row_cuts(log, "_at"))).cast("array<double>")
    dense = F.size(F.filter(cuts, lambda cut: cut <= F.col("_at")))
    chunk = F.struct(F.floor(F.col("_at") / chunk_seconds).alias("at"), dense.alias("part"))
    out = running_sum(log, ["run_id"], ["_at", "image_id"], {f"_is_{e}": e for e in EVENTS}, chunk)
    return out.select(*run_log.columns, *EVENTS)
