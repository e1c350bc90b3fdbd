import pytest
from pyspark.sql import functions as F

from framelake.operators import audit as au

SEGS = "image_id long, seq int, offset long, marker int, length int, payload binary, discarded int"
SCRIPTS = "image_id long, scan_no int, comps array<int>, ss int, se int, ah int, al int"
MARKERS = "image_id long, seq long, number int"


def test_log_takes_scripts_and_markers(spark):
    segs = spark.createDataFrame([(1, 0, 0, 0xD8, None, None, 0)], SEGS)
    scripts = spark.createDataFrame([(1, 0, [0], 1, 5, 0, 0), (1, 1, [0], 1, 5, 0, 0), (2, 0, [0], 0, 0, 0, 0)], SCRIPTS)
    markers = spark.createDataFrame([(2, 10, 0), (2, 20, 2), (2, 30, 5), (3, 1, 0), (3, 2, 1)], MARKERS)
    own = {tuple(r) for r in au.issue_log(segs).collect()}
    more = [tuple(r) for r in au.issue_log(segs, scripts, markers).collect()]
    assert own == {(1, "no_image", "error")}
    assert sorted(set(more) - own) == [(1, "ac_before_dc", "error"), (1, "bad_bits", "error"), (2, "restart_gap", "warning")]
    assert len(more) == len(set(more))
    assert au.table_issues(scripts.limit(0), markers.filter(F.lit(False))).count() == 0
    with pytest.raises(ValueError):
        au.table_issues()


@pytest.mark.parametrize("audit", [au.issue_log, au.corpus_audit])
def test_segments_are_computed_once(spark, audit):
    """Each finding reads the segments; what makes them, a walk of the files, runs once."""
    walked = spark.sparkContext.accumulator(0)

    def walk(batches):
        for batch in batches:
            walked.add(batch.num_rows)
            yield batch

    rows = [(i, n, n * 4, m, 4, bytes([n]), n) for i in range(5) for n, m in enumerate((0xD8, 0xDB, 0xC0, 0xC4, 0xE0, 0xE1, 0xDA))]
    segs = spark.createDataFrame(rows, SEGS).mapInArrow(walk, SEGS)
    assert audit(segs).count() > 0
    assert walked.value == len(rows)
