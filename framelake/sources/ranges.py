"""Headers of image files by ranged reads: only the bytes up to the first scan header leave the store.

The source is a Python data source with one partition for some files or for a folder, which the task lists itself. A file is
read from its start, each range as long as all before it, until the header walk meets the first scan header. Files are opened with
Arrow's file systems (local, HDFS, S3, GCS, ABFS); of a store that these don't know, Spark reads whole files instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import fixed
from .files import scan_images

FIRST = 4096  # bytes of the first range
FILES = 1000  # files of a partition
FOLDERS = 1000  # subfolders are looked into for more of them until there are so many
BATCH = 1 << 24  # header bytes that are held at once
MARKER = re.compile(rb"\xff[^\xff\x00]")
NAMES = re.compile("[.](?:" + "|".join(fixed.EXTENSIONS) + ")$", re.IGNORECASE)
HEADERS = pa.schema([("image_id", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary()), ("bytes_read", pa.int64())])
STOPS = {fixed.SOS, fixed.EOI, *fixed.UNSUPPORTED_SOF}


def _reserved(marker: int) -> bool:
    return (marker < fixed.SOF0 and marker != fixed.TEM) or (0xF0 <= marker <= 0xFD and marker != fixed.LSE)


class Ranges:
    """The start of a file, as far as it has been asked for."""

    def __init__(self, read: Callable[[int, int], bytes], size: int, first: int = FIRST):
        self.read, self.size, self.first, self.data = read, size, first, b""

    def upto(self, n: int) -> bytes:
        """At least the first ``n`` bytes, if the file has as many."""
        n = min(n, self.size)
        if len(self.data) < n:
            more = max(n - len(self.data), len(self.data), self.first)
            self.data += self.read(len(self.data), min(more, self.size - len(self.data)))
            if len(self.data) < n:
                self.size = len(self.data)  # the file has become shorter
        return self.data


def header_end(ranges: Ranges) -> int:
    """Where the header walk of a file ends: behind the first scan header, or where no marker can follow."""
    if ranges.upto(2)[:2] != b"\xff\xd8":
        return min(2, ranges.size)
    at = 2
    while at < ranges.size:
        hit, looked = None, at
        while hit is None and looked < ranges.size:
            data = ranges.upto(max(at + 4, looked + 1))
            hit = MARKER.search(data, max(at, looked - 1))
            looked = len(data)
        if hit is None:
            return ranges.size
        marker, at = data[hit.end() - 1], hit.end()
        if not (fixed.RST0 <= marker <= fixed.EOI or marker == fixed.TEM):
            length = int.from_bytes(ranges.upto(at + 2)[at : at + 2], "big")
            if length < 2:  # also where the file ends before the length does
                return min(at + 2, ranges.size)
            at += length
            ranges.upto(at)
        if marker in STOPS or _reserved(marker):
            break
    return min(at, ranges.size)


def store(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path, the path within it, and what Spark puts before such paths."""
    if re.match("file:", path):
        path = re.sub("^file:/*", "/", path)
    where, inner = pafs.FileSystem.from_uri(path)
    if isinstance(where, pafs.LocalFileSystem):
        return where, inner, "file:"
    scheme, _, rest = path.partition("://")
    host = "" if not inner.startswith("/") else rest.partition("/")[0]
    return where, inner, f"{scheme}://{host}"


class Part(InputPartition):
    """Some files, or a folder with all below it."""

    def __init__(self, files: list[str], folder: str | None = None):
        self.files, self.folder = files, folder
        super().__init__(None)


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.recursive = options["path"], str(options.get("recursive", "false")).lower() == "true"
        self.first = int(options.get("first", FIRST))

    def partitions(self) -> list[Part]:
        """The first levels are listed here, until there are enough folders to share out; tasks list what is below."""
        where, inner, _ = store(self.path)
        files, folders = [], [inner]
        while folders and len(folders) < FOLDERS:
            found = [x for f in folders for x in where.get_file_info(pafs.FileSelector(f))]
            files += [x.path for x in found if x.type == pafs.FileType.File and NAMES.search(x.path)]
            folders = [x.path for x in found if x.type == pafs.FileType.Directory and not x.base_name.startswith(("_", "."))] if self.recursive else []
        parts = [Part(files[i : i + FILES]) for i in range(0, len(files), FILES)]
        return parts + [Part([], f) for f in folders] or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        where, _, prefix = store(self.path)
        if partition.folder:
            infos = where.get_file_info(pafs.FileSelector(partition.folder, recursive=True))
        else:
            infos = where.get_file_info(partition.files) if partition.files else []
        rows, held = [], 0
        for info in infos:
            if info.type != pafs.FileType.File or not NAMES.search(info.path) or re.search("/[_.][^/]*/", info.path.removeprefix(partition.folder or info.path)):
                continue
            with where.open_input_file(info.path) as file:
                ranges = Ranges(lambda start, n, file=file: file.read_at(n, start), info.size, self.first)
                end = header_end(ranges)
            rows.append((prefix + info.path, info.mtime, info.size, ranges.data[:end], len(ranges.data)))
            held += end
            if held > BATCH:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), HEADERS)], schema=HEADERS)


class HeaderSource(DataSource):
    """``spark.read.format("image_headers")``; options: path, recursive, first (bytes of the first range)."""

    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return "image_id string, modified timestamp, length long, content binary, bytes_read long"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(dict(self.options))


def scan_headers(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Image files of a folder by extension, with ``content`` up to the end of the first scan header and the ``bytes_read`` for it.

    All header operators give the same results as over whole files. A file that is no image has its first two bytes as content.
    """
    try:
        store(folder)
    except (pa.ArrowException, OSError, ValueError):
        whole = scan_images(spark, folder, recursive)
        return whole.withColumn("bytes_read", F.col("length"))
    spark.dataSource.register(HeaderSource)
    return spark.read.format("image_headers").option("recursive", str(recursive).lower()).load(folder)
