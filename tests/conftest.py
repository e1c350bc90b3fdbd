import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def jpegs(spark, tmp_path_factory):
    """Real image files written by the Java image library: name -> (width, height)."""
    folder = tmp_path_factory.mktemp("images")
    jvm = spark._jvm
    made = {"a.jpg": (37, 29), "b.JPEG": (16, 16), "c.Jfif": (64, 8)}
    for name, (w, h) in made.items():
        image = jvm.java.awt.image.BufferedImage(w, h, 1)
        for y in range(h):
            for x in range(w):
                image.setRGB(x, y, (x * 5 % 256) << 16 | (y * 7 % 256) << 8 | (x * y % 256))
        jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(folder / name)))
    (folder / "notes.txt").write_text("not an image")
    (folder / "fake.jpg").write_bytes(b"GIF89a")
    return str(folder), made
