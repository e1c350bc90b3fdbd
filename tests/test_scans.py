"""Scripts and what they leave known: odd rows against plain Python, and what the plans move."""

import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from framelake.operators import scans as sc
from tests.conftest import SF

SCANS = "image_id long, scan_no int, comps array<int>, ss int, se int, ah int, al int"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def odd_scans(spark):
    rnd = random.Random(3)
    rows = [
        (i if i % 10 else None, n, rnd.choice([[0], [0, 1, 2], [1, None], None]), rnd.choice([0, 0, 1, 6, 60, 70, -3, None]), rnd.choice([0, 5, 63, 64, -1, None]), 0, rnd.choice([0, 1, None]))
        for i in range(60) for n in range(rnd.randrange(7))
    ]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    comps = [(i if i % 8 else None, c) for i in range(70) for c in ([0, 1, 3] if i % 5 else [0, 0, None])]
    return rows, comps, spark.createDataFrame(rows, SCANS), spark.createDataFrame(comps, "image_id long, ci int")


def test_accuracy_of_odd_scans(spark):
    rows, comps, scans, listed = odd_scans(spark)
    expected = {(i, c, k): -1 for i, c in comps for k in range(64)}
    for i, _, named, ss, se, _, al in sorted(rows, key=lambda r: r[1]):
        for c in named or ():
            if None not in (i, c, ss, se):
                expected.update({(i, c, k): al for k in range(ss, se + 1)})
    got = sc.coef_accuracy(scans, listed).collect()
    assert len(got) == len(expected) and {(r.image_id, r.ci, r.coef): r.al for r in got} == expected


def test_accuracy_groups_no_coefficients(spark):
    """Coefficients, 64 of each component, are told last: no aggregate holds one group for each."""
    _, _, scans, listed = odd_scans(spark)
    plan = optimized(sc.coef_accuracy(scans, listed))
    assert "Aggregate" in plan and not re.search(r"Aggregate \[[^]]*coef#", plan)


def test_smoothing_moves_no_tables(spark):
    _, _, scans, listed = odd_scans(spark)
    scans, listed = scans.union(spark.createDataFrame([(100, 0, [0], 0, 0, 0, 1)], SCANS)), listed.union(spark.createDataFrame([(100, 0)], listed.schema))
    rows = [(100, 0, 0, [3] * 64)] + [(i, c, c, None if i % 9 == 0 else [0 if i % 6 == 0 and k == 8 else 3 for k in range(64)]) for i in range(50) for c in range(4)]
    latched = spark.createDataFrame(rows, "image_id long, ci int, tq int, q array<int>")
    df = sc.smoothing_ok(sc.coef_accuracy(scans, listed), latched)
    assert not re.search(r"Project \[[^\n]*\bq#\d+\]", optimized(df))
    assert {r.smoothing_ok for r in df.collect()} == {True, False}


def test_reduced_script_is_made_by_many_tasks(spark):
    """A part is one narrow row of a small file and several scans, so its rows are dealt out before they grow."""
    plan = entry.queries()["reduce_script"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    scans = spark.range(3000).select((F.col("id") % 3).alias("image_id"), (F.col("id") / 3).cast("int").alias("scan_no"), F.array(F.lit(0)).alias("comps"), (F.col("id") % 5).cast("int").alias("ss"), F.lit(63).alias("se"), F.lit(0).alias("ah"), F.lit(0).alias("al"))
    got = sc.reduce_script(scans, 2, 4).collect()
    assert sorted((r.image_id, r.scan_no) for r in got) == [(i, n) for i in range(3) for n in range(600)]
