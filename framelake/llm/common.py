"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. A temporary one is set only in one-process sessions."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="framelake-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several steps read, and read it back. The work before it runs once and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that one slice of texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def one_thread() -> None:
    """Spark runs one task per core; the tokenizer must not start threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


MEMOS: weakref.WeakSet = weakref.WeakSet()


def forget() -> None:
    """Drop what earlier tasks left in this worker process, which Spark uses again: remembered words, and freed memory not given back."""
    for memo in list(MEMOS):
        memo.known = {}
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Memo:
    """Values of words, for a bounded number of them. ``make`` computes the values of a list of unknown words.

    Beyond ``limit`` words, only those of the slice in hand stay.
    """

    def __init__(self, make: Callable[[list[str]], list], limit: int = 600_000):
        self.make, self.limit, self.known = make, limit, {}
        MEMOS.add(self)

    def fill(self, lists: list[list[str]]) -> dict:
        """The values of at least all words of the lists."""
        known = self.known
        new = [w for w in set().union(*lists) if w not in known]
        if len(known) + len(new) > self.limit:
            known = self.known = {w: known[w] for w in set().union(*lists) if w in known}
        if new:
            known.update(zip(new, self.make(new), strict=True))
        return known
