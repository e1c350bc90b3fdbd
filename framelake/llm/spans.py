"""Repeated windows of texts: what the two substring operators share.

A window is ``size`` consecutive symbols of one text. The way: every text gives its units (see ``anchors``). Sorted by name, equal
units stand side by side, which settles all copies of a unit at once; one row before and after is all that this needs, so a name that
a third of all rows share needs no memory. A unit alone with its anchor is settled too. What is left are different units of
one anchor. Each of them fetches its symbols from its text once, and the operator's own method compares them.

An anchor with very many different units (a line that very many documents quote) is not gathered in one task: its windows are
named one by one, counted by name and joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, by_rows, forget, stored

NO_ID = -(2**63)
UNITS = pa.schema([("anchor", pa.int64()), ("name", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("at", pa.int32()), ("n", pa.int16()), ("again", pa.bool_())])
UNITS_DDL = "anchor long, name long, doc long, tag long, at int, n short, again boolean"
def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc, tag, text`` and further columns: the id (a fixed number for none) and a hash that tells rows of one id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"), *more)


def own_id() -> F.Column:
    return F.when(F.col("doc") != NO_ID, F.col("doc"))


def unit_rows(rows: DataFrame, units_of: Callable[[str], Iterator[tuple]], by_doc: bool) -> DataFrame:
    """Units of all texts. Copies of a unit within a slice of rows are settled on the spot (``again``): all but those of the smallest
    ``doc``, or without ``by_doc`` all. Of these, only those of the smallest document (one of them without ``by_doc``) compete under
    their name, so a hot name has few rows for each slice; the others are dealt by their text instead. Rows with one id and text get
    the same results, so in a slice only the first of them gives rows.
    """

    def run(batches):
        forget()
        for batch in by_rows(batches, 2048):
            docs, tags, cols = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            for row, text in enumerate(batch.column(2).to_pylist()):
                for at, n, anchor, name in units_of(text or ""):
                    cols.append((anchor.view("i8"), name.view("i8"), np.full(len(at), row), at, n))
            if not cols:
                continue
            anchor, name, row, at, n = map(np.concatenate, zip(*cols))
            doc = docs[row]
            order = np.lexsort((doc, name, anchor))
            fresh = np.concatenate([[True], (anchor[order][1:] != anchor[order][:-1]) | (name[order][1:] != name[order][:-1])])
            group = np.cumsum(fresh) - 1
            again, spread = np.zeros(len(at), bool), np.zeros(len(at), bool)
            if by_doc:
                again[order] = spread[order] = doc[order] > doc[order][fresh][group]
            else:
                again[order], spread[order] = np.bincount(group)[group] > 1, ~fresh
            anchor = np.where(spread, doc * 31 + at, anchor)
            name = np.where(spread, 0, name)
            # Of the copies of a text under one id the first is at hand: where one of them competes, it does.
            sole = np.zeros(len(docs), bool)
            sole[np.unique(np.stack([docs, tags], axis=1), axis=0, return_index=True)[1]] = True
            anchor, name, doc, row, at, n, again = (x[sole[row]] for x in (anchor, name, doc, row, at, n, again))
            for lo in range(0, len(at), 1 << 16):
                s = slice(lo, lo + (1 << 16))
                yield batch_of(UNITS, anchor[s], name[s], doc[s], tags[row[s]], at[s].astype("i4"), n[s].astype("i2"), again[s])

    return rows.mapInArrow(run, UNITS_DDL)


def mark(units: DataFrame, by_doc: bool) -> DataFrame:
    """Units that need a word: ``doc, tag, at, n, anchor``. Without an anchor, the unit is a repeat as a whole; with one, it is to be
    compared with the anchor's other units.

    ``by_doc``: only repeats of what stands in a smaller ``doc`` count.
    """
    group, name = Window.partitionBy("anchor"), Window.partitionBy("anchor", "name").orderBy("doc" if by_doc else "name")
    seen = units.withColumn("_first", F.row_number().over(name) == 1).withColumn("_differ", F.min("name").over(group) != F.max("name").over(group))
    if by_doc:
        seen = seen.withColumn("_whole", F.col("again") | (F.col("doc") > F.first("doc").over(name)))
        seen = seen.withColumn("_compare", F.col("_differ") & ~F.col("_whole"))
    else:
        seen = seen.withColumn("_whole", F.col("again") | ~F.col("_first") | F.lead(F.lit(True), 1, False).over(name))
        seen = seen.withColumn("_compare", F.col("_differ") & F.col("_first") & (F.col("name") != 0))
    # A unit may be both: repeated as a whole, and one that others repeat in part.
    kinds = F.array_compact(F.array(F.when(F.col("_whole"), F.lit(False)), F.when(F.col("_compare"), F.lit(True))))
    told = seen.filter("_whole OR _compare").select("doc", "tag", "at", "n", "anchor", F.explode(kinds).alias("_c"))
    return told.select("doc", "tag", "at", "n", F.when(F.col("_c"), F.col("anchor")).alias("anchor"))


def find(rows: DataFrame, units_of: Callable, piece_of: Callable, compare: Callable, names_of: Callable, finish: Callable, out: str, by_doc: bool, most: int) -> DataFrame:
    """The whole way from texts to results.

    ``units_of(text)``: units of a text. ``piece_of(text, marks)``: the symbols of units, as text or bytes. ``compare(rows)``: repeated
    windows among the units of one or more anchors. ``names_of(piece, n)``: 64-bit names of a unit's windows. ``finish``: from
    batches of (doc_id, text, first windows, numbers of windows, further columns of ``rows``) to the result rows. ``most``: units of one anchor that one task compares.
    """
    marks = stored(mark(unit_rows(rows.select("doc", "tag", "text"), units_of, by_doc), by_doc), "marks")
    busy = stored(marks.filter("anchor IS NOT NULL").groupBy("anchor").count().filter(F.col("count") > most).select("anchor", F.lit(True).alias("busy")), "busy")
    # Lists hold each unit of a text once, however many rows have the text; and one of these rows sends the units' symbols.
    asked = marks.filter("anchor IS NOT NULL").distinct().groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "n", "anchor")).alias("marks"))

    def fetch(batches):
        forget()
        for batch in by_rows(batches, 64):
            cols = ([], [], [], [], [], [])
            for doc, tag, text, todo in zip(*(c.to_pylist() for c in batch.columns)):
                for m, piece in zip(todo, piece_of(text or "", todo)):
                    for c, x in zip(cols, (doc, tag, m["at"], m["n"], m["anchor"], piece)):
                        c.append(x)
            yield batch_of(PIECES, *cols)

    texts, more = rows, rows.columns[3:]
    pieces = texts.groupBy("doc", "tag").agg(F.first("text").alias("text")).join(asked, ["doc", "tag"]).select("doc", "tag", "text", "marks").mapInArrow(fetch, PIECES_DDL)
    some_busy = not busy.isEmpty()
    plain = pieces.join(busy, "anchor", "left_anti").select(*PIECES.names) if some_busy else pieces
    found = plain.repartition("anchor").sortWithinPartitions("anchor", "doc").mapInArrow(compare, SPANS_DDL)

    def named(batches):
        for batch in by_rows(batches, 64):
            cols = ([], [], [], [], [])
            for doc, tag, at, n, anchor, piece in zip(*(c.to_pylist() for c in batch.columns)):
                for i, w in enumerate(names_of(piece, n).view("i8").tolist()):
                    for c, x in zip(cols, (doc, tag, at + i, anchor, w)):
                        c.append(x)
            yield batch_of(WINDOWS, *cols)

    if some_busy:
        windows = pieces.join(busy, "anchor", "left_semi").select(*PIECES.names).mapInArrow(named, "doc long, tag long, at int, anchor long, name long")
        told = windows.groupBy("anchor", "name").agg(F.count("*").alias("times"), F.min("doc").alias("least"))
        hit = (F.col("doc") > F.col("least")) if by_doc else F.col("times") > 1
        hits = windows.join(stored(told.filter("times > 1"), "windows"), ["anchor", "name"]).filter(hit)
        found = found.unionByName(hits.select("doc", "tag", "at", F.lit(1).cast("short").alias("n")))
    whole = marks.filter("anchor IS NULL").select("doc", "tag", "at", "n")
    span = F.collect_set(F.shiftleft(F.col("at").cast("long"), 16) + F.col("n"))
    spans = whole.unionByName(found).groupBy("doc", "tag").agg(span.alias("_s")).select(
        "doc", "tag", F.transform("_s", lambda s: F.shiftright(s, 16).cast("int")).alias("at"), F.transform("_s", lambda s: s.bitwiseAND(0xFFFF).cast("short")).alias("n")
    )
    return texts.join(spans, ["doc", "tag"], "left").select(own_id().alias("doc_id"), "text", "at", "n", *more).mapInArrow(finish, out)


PIECES = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("at", pa.int32()), ("n", pa.int16()), ("anchor", pa.int64()), ("piece", pa.binary())])
PIECES_DDL = "doc long, tag long, at int, n short, anchor long, piece binary"
SPANS = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("at", pa.int32()), ("n", pa.int16())])
SPANS_DDL = "doc long, tag long, at int, n short"
WINDOWS = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("at", pa.int32()), ("anchor", pa.int64()), ("name", pa.int64())])


def covered(size: int, at: list[int] | None, n: list[int] | None, window: int) -> np.ndarray:
    """Which of ``size`` symbols the windows cover."""
    edge = np.zeros(size + 1, "i8")
    if at:
        start, many = np.array(at), np.array(n)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + many - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of true flags."""
    edge = np.diff(np.concatenate([[0], flags.view("i1"), [0]]))
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


def groups(batches: Iterator[pa.RecordBatch], volume: int) -> Iterator[list[tuple]]:
    """Pieces of whole anchors together, up to about ``volume`` bytes; the rows come sorted by anchor."""
    held, size, last = [], 0, None
    for batch in by_rows(batches, 1024):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[4] != last and size > volume:
                yield held
                held, size = [], 0
            held.append(row)
            size, last = size + len(row[5]), row[4]
    if held:
        yield held
