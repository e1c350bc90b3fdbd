import numpy as np
from pyspark.sql import functions as F

from framelake.functions import color, dct
from framelake.operators import samples as sa
from tests.conftest import SF


def test_transform_round_trip(spark):
    from checks.base import REGISTRY, spark_fx
    import checks

    checks.all_checks()
    rows = REGISTRY["idct_samples"][0](spark, SF).collect()
    assert rows and all(r.off == 0 for r in rows)


def test_small_sizes_keep_the_mean():
    for n in range(1, 17):
        forward, inverse = dct.basis(n, True), dct.basis(n, False)
        k = min(n, 8)
        flat = forward @ np.full(n, 3.0)
        assert np.isclose(flat[0], 3.0 * 2 * np.sqrt(2)) and np.allclose(flat[1:], 0)
        assert np.allclose(inverse.T @ flat, 3.0)
        if n <= 8:
            assert np.allclose(inverse[:k].T @ forward[:k], np.eye(n))


def test_null_blocks_stay_null(spark):
    df = spark.createDataFrame([(1, [128] * 64), (2, None), (3, [136] * 64)], "i int, s array<int>")
    got = {r.i: r.f for r in df.select("i", dct.fdct("s").alias("f")).collect()}
    assert got[2] is None and abs(got[1][0]) < 1e-9 and abs(got[3][0] - 64) < 1e-9


def test_colour_round_trip(spark):
    df = spark.range(4096).selectExpr("id % 16 * 17 AS r", "floor(id / 16) % 16 * 17 AS g", "floor(id / 256) * 17 AS b")
    ycc = df.select("r", "g", "b", color.rgb_to_ycc("r", "g", "b").alias("c"))
    back = ycc.select("r", "g", "b", color.ycc_to_rgb("c.y", "c.cb", "c.cr").alias("o"))
    worst = back.selectExpr("greatest(abs(r - o.r), abs(g - o.g), abs(b - o.b)) AS e").agg(F.max("e")).first()[0]
    assert worst <= 2


def test_fused_equals_separate(spark):
    from checks.samples import subsampled

    s = subsampled(spark, SF)
    full = s.filter("ci = 0").unionByName(sa.upsample(s.filter("ci > 0"), 2, 2))
    separate = sa.planes_to_pixels(full).filter("c1 IS NOT NULL AND c0 IS NOT NULL").select("image_id", "y", "x", color.ycc_to_rgb("c0", "c1", "c2").alias("c")).select("image_id", "y", "x", "c.*")
    fused = sa.upsample_to_rgb(s)
    assert fused.count() == separate.count() and fused.exceptAll(separate).count() == 0


def test_pipeline_is_close(spark):
    """Pixels of a smooth image survive blocks at high quality."""
    df = spark.range(37 * 29).selectExpr("1L AS image_id", "CAST(floor(id / 37) AS INT) AS y", "CAST(id % 37 AS INT) AS x")
    df = df.selectExpr("*", "x * 3 + y AS r", "100 + y * 2 AS g", "200 - x * 2 AS b")
    sizes = spark.createDataFrame([(1, 37, 29)], "image_id long, width int, height int")
    back = sa.blocks_to_pixels(sa.pixels_to_blocks(df, 98, sizes), 98)
    j = df.alias("a").join(back.alias("b"), ["image_id", "y", "x"])
    assert j.count() == 37 * 29
    assert j.selectExpr("greatest(abs(a.r - b.r), abs(a.g - b.g), abs(a.b - b.b)) AS e").agg(F.avg("e")).first()[0] < 4


def test_repeated_and_missing_samples(spark):
    rows = [(1, 0, 0, 0, 5), (1, 0, 0, 0, 9), (1, 0, 0, 0, 5), (1, 0, 9, 8, 3), (1, 0, 0, 1, None)]
    got = {(r.by, r.bx): r.s for r in sa.samples_to_blocks(spark.createDataFrame(rows, "image_id long, ci int, y int, x int, v int")).collect()}
    assert got == {(0, 0): [9] + [None] * 63, (1, 1): [None] * 8 + [3] + [None] * 55}


def test_missing_samples_add_nothing(spark):
    df = spark.createDataFrame([(1, [None] * 63 + [200]), (2, [128] * 63 + [200]), (3, [None] * 64)], "i int, s array<int>")
    got = {r.i: r.f for r in df.select("i", dct.fdct("s").alias("f")).collect()}
    assert got[1] == got[2] and got[3] == [0.0] * 64


def test_image_cut_off_inside_a_unit(spark, tmp_path):
    """An image that ends inside a unit goes through, and its blocks equal the SQL twin."""
    import duckdb

    import __spark_entry__ as e

    vectors = spark.range(29).selectExpr("id AS vec_id", "transform(sequence(0, 63), i -> CAST((id * 37 + i * i * 11) % 200 / 400.0 - 0.25 AS FLOAT)) AS embedding")
    vectors.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    queries, sql = e.queries(), e.oracle_sql()
    for name in ("pixels_to_blocks", "block_zero_share"):
        got = sorted(tuple(r) for r in queries[name](spark, str(tmp_path)).collect())
        assert got == sorted(con.execute(sql[name]).fetchall())
    pixels = queries["blocks_to_pixels"](spark, str(tmp_path))
    assert pixels.count() == pixels.dropDuplicates(["image_id", "y", "x"]).count() == 48 * 32 + 48 * 8 + 32 * 8
