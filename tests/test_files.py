"""Real files, stored tables, streams."""

import pytest
from pyspark.sql import functions as F

from framelake.functions import fixed
from framelake.operators import audit, headers
from framelake.operators import status as st
from framelake.operators.catalog import split_jpeg
from framelake.plans import jobs
from framelake.sources import files as fl
from framelake.streaming import live
from tests.conftest import SF


def test_scan_by_extension(spark, jpegs):
    folder, made = jpegs
    names = {r.image_id.rsplit("/", 1)[1] for r in fl.scan_images(spark, folder).select("image_id").collect()}
    assert names == {*made, "fake.jpg"}
    good, bad = split_jpeg(fl.scan_images(spark, folder))
    assert (good.count(), bad.count()) == (3, 1)


def test_headers_of_real_files(spark, jpegs):
    folder, made = jpegs
    segs = headers.segments(fl.scan_images(spark, folder).select("image_id", "content")).cache()
    name = F.element_at(F.split("image_id", "/"), -1)
    sizes = {r.n: (r.width, r.height, r.ncomp) for r in headers.frames(segs).withColumn("n", name).collect()}
    assert sizes == {n: (*wh, 3) for n, wh in made.items()}
    markers = [r.marker for r in segs.withColumn("n", name).filter("n = 'a.jpg'").orderBy("seq").collect()]
    assert markers[0] == fixed.SOI and markers[-1] == fixed.SOS and fixed.APP0 in markers
    tables = headers.htables(segs).withColumn("n", name).filter("n = 'a.jpg'").collect()
    std = {(0, 0): fixed.DC_LUMA_COUNTS, (0, 1): fixed.DC_CHROMA_COUNTS, (1, 0): fixed.AC_LUMA_COUNTS, (1, 1): fixed.AC_CHROMA_COUNTS}
    assert {(t["class"], t.slot): tuple(t.bits) for t in tables} == std
    vals = {(t["class"], t.slot): tuple(t.vals) for t in tables}
    assert vals[1, 0] == tuple(fixed.AC_LUMA_SYMBOLS) and vals[1, 1] == tuple(fixed.AC_CHROMA_SYMBOLS)
    q = {r.slot: r.q for r in headers.qtables(segs).withColumn("n", name).filter("n = 'a.jpg'").collect()}
    # The Java library writes the standard tables at quality 75.
    assert q[0][:4] == [(v * 50 + 50) // 100 for v in fixed.LUMA_QUANT[:4]]
    assert not headers.scans(segs).filter("NOT ok OR ss <> 0 OR se <> 63").count()
    issues = jobs.corpus_audit(fl.scan_images(spark, folder)).collect()
    assert [(r.image_id.rsplit("/", 1)[1], r.issue) for r in issues] == [("fake.jpg", "not_jpeg")]


def test_plan_of_real_files(spark, jpegs):
    folder, _ = jpegs
    assert jobs.plan_folder(spark, folder).count() == 0  # nothing is turned


def test_pixels(spark, jpegs):
    folder, made = jpegs
    px = fl.pixels(spark, folder).withColumn("n", F.element_at(F.split("image_id", "/"), -1))
    counts = {r.n: r["count"] for r in px.groupBy("n").count().collect()}
    assert counts == {n: w * h for n, (w, h) in made.items()}
    assert [r.image_id.split("/")[-1] for r in fl.undecodable(spark, folder).collect()] == ["fake.jpg"]
    red = px.filter("n = 'a.jpg' AND x = 30 AND y = 2").first()
    assert abs(red.r - 150) < 40 and red.y == 2


def test_structure_rules(spark):
    def issues(markers):
        rows = [(1, i, m, 4, bytearray(b"\0\0")) for i, m in enumerate(markers)]
        df = spark.createDataFrame(rows, "image_id int, seq int, marker int, length int, payload binary")
        return {r.issue for r in audit.structure_issues(df).collect()} - {"sos_length"}

    soi, sof, sos = fixed.SOI, fixed.SOF0, fixed.SOS
    assert issues([soi, sof, sos]) == set()
    assert issues([soi, sof, sof, sos]) == {"sof_duplicate"}
    assert issues([soi, soi, sof, sos]) == {"soi_duplicate"}
    assert issues([soi, sos, sof]) == {"sos_before_sof"}
    assert issues([soi, sof]) == {"sof_without_sos"}
    assert issues([soi]) == {"no_image"}
    assert issues([soi, 0x02, sof, sos]) == {"reserved_marker"}
    assert issues([soi, 0xC3, sof, sos]) == {"unsupported_frame"}


def test_truncated_and_odd_bytes(spark):
    rows = [(1, bytearray(b"\xff\xd8")), (2, bytearray(b"\xff\xd8\xff\xe0\x00")), (3, bytearray(b"\xff\xd8\xff\xe0\x00\x01\xff\xda")),
            (4, bytearray(b"\xff\xd8\x00\xff\x00\xff\xff\xff\xfe\x00\x03a\xff\xd9")), (5, bytearray(b"")), (6, None)]
    segs = headers.segments(spark.createDataFrame(rows, "image_id int, content binary"))
    got = {}
    for r in segs.orderBy("image_id", "seq").collect():
        got.setdefault(r.image_id, []).append((r.marker, r.length, r.discarded))
    assert got == {
        1: [(0xD8, None, 0)], 2: [(0xD8, None, 0), (0xE0, None, 0)], 3: [(0xD8, None, 0), (0xE0, 1, 0)],
        4: [(0xD8, None, 0), (0xFE, 3, 3), (0xD9, None, 0)],
    }


def test_long_gaps_and_big_files(spark):
    """A gap longer than the search window, and bytes behind the scan header, which the walk never reads."""
    junk = b"\x00\xab" * 5000
    tail = b"\xff\xc4\x00\x02" * 200_000
    rows = [(1, bytearray(b"\xff\xd8" + junk + b"\xff\xfe\x00\x03a\xff\xda\x00\x02" + tail)), (2, bytearray(b"\xff\xd8" + junk))]
    segs = headers.segments(spark.createDataFrame(rows, "image_id int, content binary"))
    got = [(r.image_id, r.marker, r.discarded) for r in segs.orderBy("image_id", "seq").collect()]
    assert got == [(1, 0xD8, 0), (1, 0xFE, len(junk)), (1, 0xDA, 0), (2, 0xD8, 0)]


def test_many_segments(spark):
    """More segments than the inner fold has steps."""
    content = b"\xff\xd8" + b"\xff\xfe\x00\x02" * 3000 + b"\xff\xd9"
    segs = headers.segments(spark.createDataFrame([(1, bytearray(content))], "image_id int, content binary"))
    assert segs.count() == 3002


def test_upright_files_reset_both_records(spark):
    def app1(body):
        return b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body

    xmp = b"http://ns.adobe.com/xap/1.0/\0<x tiff:Orientation=\"06\"/>"
    tiff = b"Exif\0\0MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0\0\0\0\0"
    sof = b"\xff\xc0\0\x0b\x08\0\x10\0\x10\x01\x01\x11\0\xff\xda\0\x08\x01\x01\0\0\x3f\0"
    rows = [(1, bytearray(b"\xff\xd8" + app1(xmp) + sof)), (2, bytearray(b"\xff\xd8" + app1(tiff) + app1(xmp) + sof)), (3, bytearray(b"\xff\xd8" + sof))]
    images = spark.createDataFrame(rows, "image_id int, content binary")
    got = {r.image_id: bytes(r.content) for r in jobs.upright_files(images).collect()}
    want = {i: bytes(c).replace(b'"06"', b'"01"').replace(b"\0\x01\0\x06", b"\0\x01\0\x01") for i, c in rows}
    assert got == want
    heads = headers.image_headers(images.sparkSession.createDataFrame([(i, bytearray(c)) for i, c in got.items()], images.schema))
    assert {(r.exif_orientation, r.xmp_orientation) for r in heads.collect()} == {(0, 1), (1, 1), (0, 0)}


def test_file_audit_equals_the_table_audit(spark):
    from checks.headers import files

    images = files(spark, SF).select("image_id", "content")
    by_file = jobs.corpus_audit(images)
    plan = by_file._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the fixture's own repartition
    by_table = audit.corpus_audit(headers.segments(images)).distinct()
    other = by_file.filter("issue NOT IN ('not_jpeg', 'discarded_bytes', 'jfif_thumbnail')")
    assert by_table.exceptAll(other).count() == 0 == other.exceptAll(by_table).count()
    assert {r.issue for r in by_file.select("issue").distinct().collect()} >= {"not_jpeg", "discarded_bytes"}


def test_blocks_table(spark, tmp_path):
    from checks.base import spark_fx

    blocks = spark_fx(spark, SF, "fx_blocks").select("image_id", "ci", "by", "bx", "coef")
    fl.write_blocks(blocks, str(tmp_path / "b"), 4)
    assert fl.read_blocks(spark, str(tmp_path / "b")).exceptAll(blocks).count() == 0
    one = fl.read_blocks(spark, str(tmp_path / "b"), 7)
    assert one.count() == 20 and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()


def test_results_never_go_to_the_source(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(ValueError):
        fl.write_results(df, str(tmp_path / "in" / "out"), str(tmp_path / "in"))
    for other in (f"file:{tmp_path}/in/out", f"file://{tmp_path}/x/../in/out", str(tmp_path)):
        with pytest.raises(ValueError):
            fl.write_results(df, other, str(tmp_path / "in"))
    fl.write_results(df, str(tmp_path / "out"), str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_stream_equals_batch(spark):
    from checks.status import log
    from checks.streams import log_stream, run

    live_rows = run(spark, live.stream_status(log_stream(spark, SF)), "t", True)
    batch = st.batch_state(st.batch_status(log(spark, SF)))
    assert live_rows.exceptAll(batch.select(*live_rows.columns)).count() == 0 and live_rows.count() == batch.count()


def test_ticks_wait_for_the_watermark(spark):
    """In append mode only periods that the watermark has passed come out."""
    from checks.streams import log_stream, run

    events = log_stream(spark, SF)
    closed = run(spark, live.stream_ticks(events, "1 hour", "10 minutes"), "t2", False)
    everything = run(spark, live.stream_ticks(events, "1 hour", "10 minutes"), "t3", True)
    assert 0 < closed.count() < everything.count()
    assert closed.exceptAll(everything).count() == 0
