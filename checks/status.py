"""Batch progress."""

from framelake.operators import status as st

from .base import register, spark_fx

COUNTS = """SELECT run_id, sum(CASE WHEN event = 'selected' THEN 1 ELSE 0 END) AS selected,
 sum(CASE WHEN event = 'analysed' THEN 1 ELSE 0 END) AS analysed,
 sum(CASE WHEN event = 'to_be_rotated' THEN 1 ELSE 0 END) AS to_be_rotated,
 sum(CASE WHEN event = 'rotated' THEN 1 ELSE 0 END) AS rotated,
 sum(CASE WHEN event = 'errored' THEN 1 ELSE 0 END) AS errored FROM fx_run_log GROUP BY run_id"""
STATE = """CASE WHEN selected = 0 THEN 'no_jpegs' WHEN analysed < selected THEN 'analysing'
 WHEN rotated + errored < to_be_rotated THEN 'processing' WHEN to_be_rotated = 0 THEN 'nothing_to_rotate'
 WHEN rotated = to_be_rotated THEN 'done_all' ELSE 'done_with_errors' END"""
MESSAGE = """CASE state WHEN 'no_jpegs' THEN 'noJPEGsInDirectory'
 WHEN 'analysing' THEN CASE WHEN analysed >= 2 THEN 'analysedMany' ELSE 'analysedOne' END
 WHEN 'nothing_to_rotate' THEN 'noImagesToBeRotated'
 WHEN 'done_all' THEN CASE WHEN rotated >= 2 THEN 'processedAllMany' ELSE 'processedAllOne' END
 ELSE CASE WHEN to_be_rotated >= 2 OR (to_be_rotated = 1 AND errored = 1) THEN 'processedMany' ELSE 'processedOne' END END"""


def log(s, d):
    return spark_fx(s, d, "fx_run_log")


@register("batch_status", "run_id selected analysed to_be_rotated rotated errored", COUNTS)
def _(s, d):
    return st.batch_status(log(s, d))


@register("batch_state_of_log", "run_id state:s message:s", f"""
SELECT run_id, state, {MESSAGE} AS message FROM (SELECT *, {STATE} AS state FROM ({COUNTS}))""")
def _(s, d):
    return st.batch_state(st.batch_status(log(s, d)))


@register("batch_state", "run_id state:s message:s", f"""
SELECT run_id, state, {MESSAGE} AS message FROM (SELECT *, {STATE} AS state FROM fx_status)""")
def _(s, d):
    return st.batch_state(spark_fx(s, d, "fx_status"))


@register("status_text", "run_id text:s", f"""
SELECT run_id, CASE {MESSAGE} WHEN 'noJPEGsInDirectory' THEN 'There were no JPG files in your selection'
 WHEN 'analysedMany' THEN 'Analysed ' || analysed || ' images' WHEN 'analysedOne' THEN 'Analysed 1 image'
 WHEN 'noImagesToBeRotated' THEN 'There were no rotatable images in your selection'
 WHEN 'processedAllMany' THEN 'Rotated all ' || rotated || ' images' WHEN 'processedAllOne' THEN 'Rotated image'
 WHEN 'processedMany' THEN 'Rotated ' || rotated || '/' || to_be_rotated || ' images' ELSE 'Rotating image' END AS text
FROM (SELECT *, {STATE} AS state FROM fx_status)""")
def _(s, d):
    return st.status_text(st.batch_state(spark_fx(s, d, "fx_status")), "en-GB")


@register("telemetry", "event:s events runs largest", """
SELECT event, sum(n) AS events, count(*) AS runs, max(n) AS largest
FROM (SELECT event, run_id, count(*) AS n FROM fx_run_log GROUP BY 1, 2) GROUP BY event""")
def _(s, d):
    return st.telemetry(log(s, d))


@register("progress", "run_id image_id selected analysed to_be_rotated rotated errored", """
SELECT run_id, image_id, count(*) FILTER (event = 'selected') OVER w AS selected, count(*) FILTER (event = 'analysed') OVER w AS analysed,
 count(*) FILTER (event = 'to_be_rotated') OVER w AS to_be_rotated, count(*) FILTER (event = 'rotated') OVER w AS rotated,
 count(*) FILTER (event = 'errored') OVER w AS errored FROM fx_run_log
WINDOW w AS (PARTITION BY run_id ORDER BY ts, image_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(s, d):
    return st.progress(log(s, d))
