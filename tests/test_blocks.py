"""Algebra of the block transforms, their meaning on pixels, and partial units."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import dct
from framelake.functions import orders
from framelake.functions.orientation import with_transform
from framelake.operators import blocks as bl

TURNS = {
    "flip_h": lambda a: a[:, ::-1], "flip_v": lambda a: a[::-1], "transpose": lambda a: a.T,
    "transverse": lambda a: a[::-1, ::-1].T, "rot_90": lambda a: np.rot90(a, -1),
    "rot_180": lambda a: a[::-1, ::-1], "rot_270": lambda a: np.rot90(a),
}


def blocks_of(image):
    """Exact coefficient blocks (doubles) of an array of whole blocks."""
    basis = dct.basis(8, True)
    h, w = image.shape
    return [
        (1, 0, y, x, (basis @ (image[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] - 128.0) @ basis.T).ravel().tolist())
        for y in range(h // 8) for x in range(w // 8)
    ]


def image_of(rows):
    basis = dct.basis(8, False)
    h, w = max(r.by for r in rows) + 1, max(r.bx for r in rows) + 1
    out = np.zeros((h * 8, w * 8))
    for r in rows:
        out[r.by * 8 : r.by * 8 + 8, r.bx * 8 : r.bx * 8 + 8] = basis.T @ np.array(r.coef).reshape(8, 8) @ basis + 128
    return out


def frame(spark, image, width=None, height=None):
    h, w = image.shape
    df = spark.createDataFrame(blocks_of(image), "image_id long, ci int, by int, bx int, coef array<double>")
    size = {"width": F.lit(width or w), "height": F.lit(height or h), "ncomp": F.lit(1), "max_h": F.lit(1), "max_v": F.lit(1), "h": F.lit(1), "v": F.lit(1)}
    return df.withColumns(size)


@pytest.mark.parametrize("name", TURNS)
def test_same_as_turning_pixels(spark, name):
    image = np.random.default_rng(3).integers(0, 256, (16, 24)).astype(float)
    rows = getattr(bl, name)(frame(spark, image)).collect()
    assert np.allclose(image_of(rows), TURNS[name](image))


def test_algebra(spark):
    image = np.random.default_rng(5).integers(0, 256, (16, 24)).astype(float)
    start = frame(spark, image)
    state = lambda df: sorted((r.by, r.bx, tuple(round(c, 6) + 0.0 for c in r.coef)) for r in df.collect())
    swap = lambda df: df.withColumns({"width": F.col("height"), "height": F.col("width")})
    four = start
    for _ in range(4):
        four = swap(bl.rot_90(four))
    assert state(four) == state(start)
    assert state(bl.flip_h(bl.flip_h(start))) == state(start)
    assert state(bl.rot_90(start)) == state(bl.flip_h(swap(bl.transpose(start))))
    assert state(bl.rot_180(start)) == state(bl.flip_h(bl.flip_v(start)))
    assert state(bl.transverse(start)) == state(bl.transpose(bl.rot_180(start)))


def test_partial_units_stay(spark):
    """37 samples wide: four whole blocks are mirrored, the fifth column stays where it is."""
    image = np.random.default_rng(7).integers(0, 256, (8, 40)).astype(float)
    rows = {r.bx: r for r in bl.flip_h(frame(spark, image, width=37)).collect()}
    source = {b[3]: b[4] for b in blocks_of(image)}
    assert np.allclose(rows[4].coef, source[4])
    assert [round(abs(c)) for c in rows[0].coef] == [round(abs(c)) for c in source[3]]


def test_single_component_ignores_sampling(spark):
    image = np.random.default_rng(9).integers(0, 256, (8, 24)).astype(float)
    odd = frame(spark, image).withColumns({"h": F.lit(2), "v": F.lit(2), "max_h": F.lit(2), "max_v": F.lit(2)})
    assert {r.bx for r in bl.flip_h(odd).collect()} == {0, 1, 2}
    assert np.allclose(image_of(bl.flip_h(odd).collect()), image[:, ::-1])


def test_plan_join_is_banded_and_whole(spark):
    """A tall image spans several bands; every block finds its plan exactly once."""
    rows = spark.range(200).select(F.lit(1).alias("image_id"), F.lit(0).alias("ci"), F.col("id").cast("int").alias("by"), F.lit(0).alias("bx"), F.array_repeat(F.lit(1), 64).alias("coef"))
    plan = spark.createDataFrame([(1, 0, 1, 1, "flip_v", 8, 1600, 1, 1, 1, 8, 1600, 0, 0)],
                                 "image_id int, ci int, h int, v int, transform string, width int, height int, ncomp int, max_h int, max_v int, out_w int, out_h int, x_off int, y_off int")
    out = bl.rotate_blocks(rows, plan)
    assert sorted(r.by for r in out.collect()) == list(range(200))


def test_thumbnail_rule_matches_orientation(spark):
    image = np.arange(12).reshape(3, 4)
    pixels = [(y, x, int(image[y, x])) for y in range(3) for x in range(4)]
    names = {2: "flip_h", 3: "rot_180", 4: "flip_v", 5: "transpose", 6: "rot_90", 7: "transverse", 8: "rot_270"}
    df = spark.createDataFrame([(o, y, x, v, 4, 3) for o in names for y, x, v in pixels], "orientation int, y int, x int, v int, width int, height int")
    got = bl.rotate_pixels(with_transform(df)).collect()
    for o, name in names.items():
        want = TURNS[name](image)
        assert all(want[r.y, r.x] == r.v for r in got if r.orientation == o)


def test_zigzag_round_trip(spark):
    assert orders.zigzag_positions()[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    df = spark.range(1).select(F.sequence(F.lit(0), F.lit(63)).alias("b"))
    back = df.select(orders.to_natural(orders.to_zigzag("b")).alias("b")).first().b
    assert back == list(range(64))
    small = df.select(orders.to_natural(orders.to_zigzag("b", 3), 3).alias("b")).first().b
    assert [v for v in small if v] == [1, 2, 8, 9, 10, 16, 17, 18]


def test_plan_to_blocks(spark):
    """From a catalogue row to turned blocks: orientation 6 of a 24 x 16 image is a quarter turn clockwise."""
    from framelake.operators.catalog import rotation_plan

    image = np.random.default_rng(11).integers(0, 256, (16, 24)).astype(float)
    catalog = spark.createDataFrame(
        [(1, 24, 16, 1, 1, 1, 6, 0, False, False), (2, 24, 16, 1, 1, 1, 1, 0, False, False)],
        "image_id int, width int, height int, ncomp int, max_h int, max_v int, exif_orientation int, xmp_orientation int, read_only boolean, trim boolean",
    )
    plan = rotation_plan(catalog).filter("refusal IS NULL").withColumns({"x_off": F.lit(0), "y_off": F.lit(0)})
    comps = spark.createDataFrame([(1, 0, 1, 1), (2, 0, 1, 1)], "image_id int, ci int, h int, v int")
    blocks = spark.createDataFrame(blocks_of(image), "image_id int, ci int, by int, bx int, coef array<double>")
    rows = bl.rotate_blocks(blocks, bl.component_plan(plan, comps)).collect()
    assert np.allclose(image_of(rows), np.rot90(image, -1))
