"""Composed requests and scan selectors on hand-made rows."""

from framelake.operators import audit
from framelake.operators import requests as rq

IMAGE = dict(image_id=1, width=100, height=60, ncomp=3, max_h=2, max_v=2, luma_h=2, luma_v=2, color_space="ycc", spec=None, transform="none", trim=False, perfect=False, gray=False)
DDL = "image_id long, width int, height int, ncomp int, max_h int, max_v int, luma_h int, luma_v int, color_space string, spec string, transform string, trim boolean, perfect boolean, gray boolean, status string, full_w string, unit_w string"


def plan(spark, *changes):
    rows = [tuple({**IMAGE, **c}.values()) + ("old", "f", "u") for c in changes]
    got = rq.plan_requests(spark.createDataFrame(rows, DDL).coalesce(1)).collect()
    return [tuple(r[c] for c in ("status", "out_ncomp", "out_w", "out_h", "x_off", "y_off", "wipe_w", "wipe_h")) for r in got]


def test_steps_build_on_each_other(spark):
    got = plan(
        spark,
        {}, {"spec": "40x30+20+10"}, {"spec": "40fx30+20+10"}, {"spec": "+20-10", "transform": "rot_90"}, {"spec": "200x30+16+0"}, {"spec": "200x30+16+0", "transform": "flip_h"},
        {"transform": "flip_h", "trim": True}, {"transform": "flip_h", "trim": True, "spec": "80x60+0+0"}, {"transform": "flip_h", "trim": True, "spec": "+16+0"}, {"transform": "flip_h", "perfect": True},
        {"transform": "flip_h", "perfect": True, "width": 96}, {"gray": True, "spec": "40x30+20+10"}, {"gray": True, "luma_h": 1}, {"gray": True, "color_space": "rgb"},
        {"transform": "wipe", "spec": "40x30+20+10"}, {"spec": "nonsense"}, {"spec": ""}, {"trim": None, "perfect": None, "gray": None}, {"spec": "40x30+90+0"},
    )
    none = (None,) * 7
    assert got == [
        ("ok", 3, 100, 60, 0, 0, None, None), ("ok", 3, 44, 40, 1, 0, None, None), ("ok", 3, 40, 40, 1, 0, None, None), ("ok", 3, 44, 90, 1, 0, None, None),
        ("ok", 3, 200, 30, 1, 0, None, None), ("refused", *none),
        ("ok", 3, 96, 60, 0, 0, None, None), ("ok", 3, 80, 60, 0, 0, None, None), ("ok", 3, 80, 60, 1, 0, None, None), ("cropOptionRequired", *none),
        ("ok", 3, 96, 60, 0, 0, None, None), ("ok", 1, 44, 32, 2, 1, None, None), ("conversion_not_supported", *none), ("conversion_not_supported", *none),
        ("ok", 3, 100, 60, 1, 0, 3, 3), ("bad_request", *none), ("ok", 3, 100, 60, 0, 0, None, None), ("ok", 3, 100, 60, 0, 0, None, None), ("refused", *none),
    ]


def test_filters_over_plans_stay_small(spark):
    rows = rq.plan_requests(spark.createDataFrame([tuple(IMAGE.values()) + ("", "", "")], DDL))
    text = rows.filter("status = 'ok' AND out_w > width AND x_off >= 0")._jdf.queryExecution().optimizedPlan().toString()
    assert len(text) < 60_000


def test_selectors_are_told_apart_like_frame_ids(spark):
    frame = "image_id int, seq int, arithmetic boolean, components array<struct<component_id: int>>"
    scan = "image_id int, seq int, scan_no int, ss int, se int, ah int, comps array<struct<component_id: int, dc: int, ac: int>>"
    frames = spark.createDataFrame([(1, 1, False, [(1,), (2,), (3,)]), (1, 9, False, [(7,)]), (2, 1, False, [(5,), (5,), (5,)]), (3, 1, True, [(1,)])], frame)
    scans = spark.createDataFrame(
        [(1, 5, 0, 0, 63, 0, [(2, 0, 1), (2, 1, 0), (9, 0, 0)]), (2, 5, 0, 0, 0, 0, [(5, 0, 0), (5, 0, 0), (7, 2, 0)]), (3, 5, 0, 0, 63, 0, [(1, 0, 0)]), (4, 5, 0, 0, 63, 0, [(1, 5, 0)]), (5, 5, 0, 0, 0, 0, [])], scan)
    got = {(r.image_id, r.place): (r.component_id, r.ci) for r in audit.scan_components(scans, frames).collect()}
    assert got == {(1, 0): (2, 1), (1, 1): (3, 2), (1, 2): (9, None), (2, 0): (5, 0), (2, 1): (6, 1), (2, 2): (7, 2), (3, 0): (1, 0), (4, 0): (1, None)}
    tables = "image_id int, class int, slot int, seq int, bits array<int>, vals array<int>"
    defined = spark.createDataFrame([(1, 0, 0, 2, [1], [1]), (1, 0, 1, 7, [1], [1]), (1, 1, 1, 3, [1], [1]), (2, 0, 0, 1, [1], [1]), (4, 0, 5, 1, [1], [1]), (4, 1, 0, 1, [1], [1])], tables)
    missing = {(r.image_id, r["class"], r.slot) for r in audit.missing_huffman(scans, defined, frames).collect()}
    # Of image 1 the table of class 0, slot 1 comes after the scan; image 3 is arithmetic-coded; slot 5 of image 4 is no slot.
    assert missing == {(1, 0, 1), (1, 1, 0), (2, 0, 2), (4, 0, 5)}
