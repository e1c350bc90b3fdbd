"""Streams, stored tables, jobs."""

import uuid

from pyspark.sql import functions as F

from framelake.operators import catalog as c
from framelake.operators import status as st
from framelake.plans import jobs
from framelake.session import checkpoint_dir
from framelake.sources import files as fl
from framelake.streaming import live

from .base import register, spark_fx, table
from .catalog import EFF, PLAN, TRANSFORM, images
from .headers import HAS_SOF, OK, files
from .status import COUNTS, MESSAGE, STATE


def place(s, name):
    return f"{checkpoint_dir(s)}/framelake-{name}-{uuid.uuid4().hex}"


def log_stream(s, d):
    events = live.read_stream(s, d, "events.parquet", table(s, d, "events").schema)
    kinds = F.expr("CASE event_type WHEN 'view' THEN 'selected' WHEN 'click' THEN 'analysed' WHEN 'signup' THEN 'to_be_rotated' WHEN 'purchase' THEN 'rotated' ELSE 'errored' END")
    return events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("image_id"), F.col("ts").cast("timestamp").alias("ts"), kinds.alias("event"))


def run(s, stream, name, complete):
    return live.drain(stream, place(s, name), place(s, name + "-state"), complete)


@register("stream_status", "run_id selected analysed to_be_rotated rotated errored state:s message:s", f"""
SELECT *, {MESSAGE} AS message FROM (SELECT *, {STATE} AS state FROM ({COUNTS}))""")
def _(s, d):
    return run(s, live.stream_status(log_stream(s, d)), "status", True)


@register("stream_ticks", "hour:s run_id selected analysed to_be_rotated rotated errored", COUNTS.replace("SELECT run_id,", "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, run_id,").replace("GROUP BY run_id", "GROUP BY 1, 2"))
def _(s, d):
    t = run(s, live.stream_ticks(log_stream(s, d)), "ticks", True)
    return t.withColumn("hour", F.date_format("tick", "yyyy-MM-dd HH"))


@register("stream_plans", "image_id orientation transform:s out_w out_h refusal:s", PLAN + """
SELECT image_id, o AS orientation, transform, out_w, out_h, CASE WHEN read_only THEN 'imageReadOnly' ELSE perfect_refusal END AS refusal FROM p WHERE o BETWEEN 2 AND 8""")
def _(s, d):
    part = live.read_stream(s, d, "part.parquet", table(s, d, "part").schema)
    catalog = part.selectExpr(
        "CAST(p_partkey AS BIGINT) AS image_id", "CAST(64 + (p_partkey*37) % 200 AS INT) AS width", "CAST(48 + (p_partkey*53) % 150 AS INT) AS height",
        "CAST(p_partkey % 10 AS INT) AS exif_orientation", "CAST((p_partkey*3 + p_size) % 10 AS INT) AS xmp_orientation", "CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 3 END AS ncomp",
        "CAST(1 + p_partkey % 2 AS INT) AS max_h", "CAST(1 + CAST(floor(p_partkey / 2.0) AS BIGINT) % 2 AS INT) AS max_v", "p_partkey % 17 = 0 AS read_only", "p_size % 2 = 0 AS trim")
    return run(s, live.stream_plans(catalog), "plans", False)


@register("hresult_text", "image_id code text:s", """
SELECT image_id, code, '0x' || upper(hex(CASE WHEN code < 0 THEN code + 4294967296 ELSE code END)) AS text FROM (SELECT image_id, -2147467259 + image_id * 1000003 AS code FROM fx_images)""")
def _(s, d):
    t = spark_fx(s, d, "fx_images").withColumn("code", -2147467259 + F.col("image_id") * 1000003)
    return t.withColumn("text", st.hresult_text("code"))


@register("stored_blocks", "image_id ci by_ bx coef:a", "SELECT image_id, ci, by_, bx, coef FROM fx_blocks")
def _(s, d):
    path = place(s, "blocks")
    fl.write_blocks(spark_fx(s, d, "fx_blocks"), path, 4)
    return fl.read_blocks(s, path).withColumnRenamed("by", "by_")


@register("stored_results", "image_id orientation transform:s out_w out_h", PLAN + """
SELECT image_id, o AS orientation, transform, out_w, out_h FROM p WHERE o BETWEEN 2 AND 8""")
def _(s, d):
    path = place(s, "results")
    plan = c.rotation_plan(images(s, d))
    fl.write_results(plan.select("image_id", "orientation", "transform", "out_w", "out_h"), path, d)
    return s.read.parquet(path)


# --- jobs from file bytes ----------------------------------------------------------------------------------

FILE_PLAN = PLAN.replace("FROM fx_images", f"""FROM (SELECT image_id, width, height, h0, v0, ncomp, read_only, TRUE AS trim_ok,
 CASE WHEN image_id % 2 = 0 THEN exif_orientation ELSE 0 END AS exif_orientation, CASE WHEN image_id % 11 = 0 THEN xmp_orientation ELSE 0 END AS xmp_orientation
 FROM fx_images WHERE {HAS_SOF})""", 1)


@register("plan_from_files", "image_id orientation transform:s width height out_w out_h refusal:s", FILE_PLAN + """
SELECT image_id, o AS orientation, transform, width, height, out_w, out_h, CASE WHEN read_only THEN 'imageReadOnly' END AS refusal FROM p WHERE o BETWEEN 2 AND 8""")
def _(s, d):
    return jobs.rotation_plan(files(s, d).select("image_id", "content", "read_only"))


@register("repair_from_files", "image_id tag vals:a", FILE_PLAN + """, q AS (SELECT image_id, o, out_w AS w, out_h AS h, width, image_id % 50 AS x, image_id % 40 AS y, exif_orientation AS e FROM p
 WHERE o BETWEEN 2 AND 8 AND NOT read_only AND image_id % 2 = 0)
SELECT image_id, 274 AS tag, [CASE WHEN e = 0 THEN 0 ELSE 1 END] AS vals FROM q UNION ALL SELECT image_id, 34665, [38] FROM q UNION ALL SELECT image_id, 40962, [CASE WHEN image_id % 3 = 0 THEN width ELSE w END] FROM q
UNION ALL SELECT image_id, 37396, [CASE o WHEN 2 THEN w-x WHEN 3 THEN w-x WHEN 5 THEN y WHEN 6 THEN w-y WHEN 7 THEN w-y WHEN 8 THEN y ELSE x END,
 CASE o WHEN 3 THEN h-y WHEN 4 THEN h-y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN h-x WHEN 8 THEN h-x ELSE y END, CASE WHEN o >= 5 THEN 3 ELSE 7 END, CASE WHEN o >= 5 THEN 7 ELSE 3 END] FROM q""")
def _(s, d):
    return jobs.metadata_repair(files(s, d).select("image_id", "content", "read_only")).withColumnRenamed("values", "vals")


@register("audit_from_files", "issue:s severity:s images", f"""
SELECT 'not_jpeg' AS issue, 'error' AS severity, count(*) AS images FROM fx_images WHERE NOT ({OK})
UNION ALL SELECT 'bad_precision', 'error', count(*) FROM fx_images WHERE {HAS_SOF} AND image_id % 31 = 0
UNION ALL SELECT 'sos_before_sof', 'error', count(*) FROM fx_images WHERE {OK} AND image_id % 29 = 0
UNION ALL SELECT 'dqt_slot', 'error', count(*) FROM fx_images WHERE {OK} AND image_id % 23 = 0
UNION ALL SELECT 'bad_progression', 'error', count(*) FROM fx_images WHERE {HAS_SOF} AND image_id % 6 = 0 AND ncomp = 1
UNION ALL SELECT 'not_sequential', 'warning', count(*) FROM fx_images WHERE {HAS_SOF} AND image_id % 6 <> 0 AND ncomp = 3
UNION ALL SELECT 'missing_table', 'error', count(DISTINCT image_id) FROM fx_components WHERE {HAS_SOF} AND ((ci = 0 AND image_id % 23 = 0) OR (ci > 0 AND image_id % 13 <> 0))
UNION ALL SELECT 'discarded_bytes', 'warning', count(*) FROM fx_images WHERE {OK} AND image_id % 7 = 0
UNION ALL SELECT 'jfif_version', 'warning', count(*) FROM fx_images WHERE {OK} AND image_id % 3 = 0 AND image_id % 4 IN (0, 3)""")
def _(s, d):
    return jobs.corpus_audit(files(s, d).select("image_id", "content")).groupBy("issue", "severity").agg(F.count("*").alias("images"))
