"""Chunked ordered operators against a plain loop, for random data and any chunk width."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from framelake.operators.ordered import last_known, previous, row_cuts, running_sum
from framelake.operators.status import progress

rows = st.lists(
    st.tuples(st.integers(0, 2), st.integers(0, 40), st.one_of(st.none(), st.integers(-9, 9))),
    min_size=1, max_size=40, unique_by=lambda r: (r[0], r[1]),
)
common = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def by_key(data):
    out = {}
    for k, at, v in sorted(data, key=lambda r: (r[0], r[1])):
        out.setdefault(k, []).append((at, v))
    return out


@common
@given(data=rows, chunk=st.sampled_from([1, 3, 7, 1000]))
def test_chunked(spark, data, chunk):
    df = spark.createDataFrame(data, "k int, at int, v int").fillna(0)
    got = {(r.k, r.at): (r.p, r.s) for r in running_sum(previous(df, ["k"], ["at"], {"v": "p"}, chunk), ["k"], ["at"], {"v": "s"}, chunk).collect()}
    for k, items in by_key(data).items():
        before, total = None, 0
        for at, v in items:
            total += v or 0
            assert got[k, at] == (before, total)
            before = v or 0


@common
@given(data=rows, chunk=st.sampled_from([1, 5, 1000]))
def test_last_known(spark, data, chunk):
    df = spark.createDataFrame(data, "k int, at int, v int")
    got = {(r.k, r.at): r.l for r in last_known(df, ["k"], ["at"], {"v": "l"}, chunk).collect()}
    for k, items in by_key(data).items():
        last = None
        for at, v in items:
            last = v if v is not None else last
            assert got[k, at] == last


def test_one_run_in_one_day_is_many_chunks(spark):
    log = spark.range(4000).selectExpr("1L AS run_id", "id AS image_id", "timestamp_seconds(1700000000 + id div 100) AS ts", "IF(id % 3 = 0, 'selected', 'analysed') AS event")
    timed = log.selectExpr("unix_micros(ts) / 1e6 AS at")
    cuts = row_cuts(timed, "at", rows=500)
    assert 6 <= len(cuts) <= 8
    parts = timed.selectExpr(f"size(filter(array({', '.join(map(str, cuts))}), c -> c <= at)) AS part").groupBy("part").count().collect()
    assert max(r["count"] for r in parts) < 800
    last = progress(log).orderBy("image_id").tail(1)[0]
    assert (last.selected, last.analysed) == (1334, 2666)
