"""Headers by ranged reads equal those of whole files, and cost few bytes."""

import random

from framelake.operators import headers
from framelake.plans import jobs
from framelake.sources import files as fl
from framelake.sources import ranges


def image(app=0, body=0):
    """A file with ``app`` bytes of application segments and ``body`` bytes behind the scan header."""
    out = b"\xff\xd8"
    while app > 0:
        n = min(app, 65533)
        out += b"\xff\xe2" + (n + 2).to_bytes(2, "big") + b"\x11" * n
        app -= n
    out += bytes.fromhex("ffc0000b080010002001011100") + bytes.fromhex("ffda0008010100003f00")
    return out + bytes(range(256)) * (body // 256)


def odd_bytes():
    rnd = random.Random(11)
    good = image(300, 600)
    out = [b"", b"\xff", b"\xff\xd8", b"\xff\xd8\xff", b"GIF89a" * 900, b"\xff\xd8\x00\xff\x00\xff\xff\xff\xfe\x00\x03a\xff\xd9", b"\xff\xd8\xff\xe0\x00", b"\xff\xd8\xff\xe0\x00\x01\xff\xda",
           b"\xff\xd8" + b"\x00" * 9000 + good[2:], b"\xff\xd8" + b"\xff" * 9000 + good[2:], b"\xff\xd8" + b"\x07" * 20_000, good[:310], b"\xff\xd8\xff\xe1\xff\xff" + b"z" * 70_000, good.replace(b"\xff\xda", b"\xff\xd9")]
    for _ in range(40):
        broken = bytearray(good)
        for _ in range(rnd.randint(1, 6)):
            broken[rnd.randrange(len(broken))] = rnd.choice([0, 1, 0xFF, 0xD8, 0xDA, 0xC0, 0xC3, rnd.randrange(256)])
        out.append(bytes(broken))
    return out


def test_headers_of_odd_files_equal_those_of_whole_ones(spark, tmp_path):
    for i, data in enumerate(odd_bytes()):
        (tmp_path / f"{i}.jpg").write_bytes(data)
    key = ["image_id", "seq", "offset", "marker", "length", "discarded", "payload"]
    whole = headers.segments(fl.scan_images(spark, str(tmp_path)).select("image_id", "content")).select(key).collect()
    by_name = lambda r: (r["image_id"].rsplit("/", 1)[1], *r[1:])
    spark.dataSource.register(ranges.HeaderSource)
    for first in (1, 7, ranges.FIRST):
        rows = spark.read.format("image_headers").option("first", first).load(str(tmp_path))
        got = headers.segments(rows.select("image_id", "content")).select(key).collect()
        assert sorted(map(by_name, got), key=str) == sorted(map(by_name, whole), key=str)


def test_few_bytes_are_read_and_folders_are_walked(spark, tmp_path):
    body = 3 << 20
    made = {"a.jpg": image(0, body), "x/b.JPEG": image(100, body), "x/y/c.jfif": image(150_000, body), "x/y/z/d.jpg": image(70_000, 0), "x/notes.txt": b"no", "_hidden/e.jpg": image(), "x/_h/e.jpg": image()}
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    want = {n: len(d) for n, d in made.items() if "_h" not in n and "txt" not in n}
    for folders in (1000, 2):
        rows = ranges.HeaderReader({"path": str(tmp_path), "recursive": "true"})
        ranges.FOLDERS, kept = folders, ranges.FOLDERS
        parts = rows.partitions()
        ranges.FOLDERS = kept
        batches = [b for p in parts for b in rows.read(p)]
        got = {r["image_id"].removeprefix(f"file:{tmp_path}/"): r for b in batches for r in b.to_pylist()}
        assert {n: r["length"] for n, r in got.items()} == want
    assert got["a.jpg"]["bytes_read"] == got["x/b.JPEG"]["bytes_read"] == ranges.FIRST
    assert 150_000 < got["x/y/c.jfif"]["bytes_read"] < 4 * 150_000
    assert sum(r["bytes_read"] for r in got.values()) < 0.1 * sum(want.values())
    flat = ranges.scan_headers(spark, str(tmp_path))
    assert [r["image_id"] for r in flat.select("image_id").collect()] == [r["image_id"] for r in fl.scan_images(spark, str(tmp_path)).select("image_id").collect()]
    frames = headers.frames(headers.segments(ranges.scan_headers(spark, f"file://{tmp_path}", recursive=True)))
    assert [(r["width"], r["height"]) for r in frames.collect()] == [(32, 16)] * 4
    assert ranges.scan_headers(spark, f"file://{tmp_path}/x/y/z").first()["image_id"] == f"file:{tmp_path}/x/y/z/d.jpg"


def test_jobs_over_folders(spark, jpegs, tmp_path):
    folder, made = jpegs
    assert sorted(r["issue"] for r in jobs.audit_folder(spark, folder).collect()) == ["not_jpeg"]
    assert jobs.plan_folder(spark, folder).count() == 0
    (tmp_path / "empty").mkdir()
    assert ranges.scan_headers(spark, str(tmp_path), recursive=True).count() == 0


def test_a_store_that_only_spark_reads(spark, monkeypatch, jpegs):
    folder, made = jpegs

    def unknown(path):
        raise ValueError("no such scheme")

    monkeypatch.setattr(ranges, "store", unknown)
    rows = ranges.scan_headers(spark, folder)
    assert rows.filter("bytes_read = length").count() == len(made) + 1
