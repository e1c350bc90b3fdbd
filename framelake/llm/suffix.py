"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Every byte is removed that a string of ``size`` bytes covers which also starts anywhere else. Units of text (see ``spans``)
that may hold such strings come to a task a few megabytes at a time. There:

1. Positions whose remainder by V lies in a difference cover are the cover sample. Their suffixes are ranked first, up to
   4 * V bytes deep, by doubling: position + V is in the sample too.
2. The suffixes at window starts are cut into buckets by their first bytes, and one bucket is sorted at a time: up to V bytes by
   their text; suffixes that still tie, by cover ranks. Any two positions reach the sample at a common distance below V,
   so two tied suffixes compare by the ranks there. All ties of a bucket are split around pivots together.
3. Neighbours in the sorted order with ``size`` bytes in common are repeats.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .anchors import SIGNS, names, units
from .common import batch_of, by_rows

V = 64
STEP = math.isqrt(V)
COVER = np.isin(np.arange(V), [*range(STEP), *range(0, V, STEP)])  # every difference mod V is that of two of these
DISTANCE = np.array([[next(d for d in range(V) if COVER[(a + d) % V] and COVER[(b + d) % V]) for b in range(V)] for a in range(V)])
BUCKET = 200_000  # suffixes sorted at once
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    return np.unique(keys, return_inverse=True)[1]


def cover_ranks(eights: np.ndarray, size: int) -> np.ndarray:
    """Ranks of the sample's suffixes by their first 4 * V bytes, at their positions (0 elsewhere).

    ``eights``: for each position, the rank of its eight bytes among all.
    """
    at = np.flatnonzero(COVER[np.arange(size) % V])
    wide = int(eights.max(initial=0)) + 1
    rank = dense(eights[at])
    for j in range(8, V, 8):
        rank = dense(rank * wide + eights[at + j])
    out = np.zeros(size + 4 * V, "i8")
    for deep in (V, 2 * V):
        out[at] = rank + 1
        rank = dense((rank + 1) * (len(at) + 2) + out[at + deep])
    out[at] = rank + 1
    return out


def sort_bucket(at: np.ndarray, eights: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a bucket that tie with another one on V bytes, in order, and the tie group of each."""
    wide = int(eights.max(initial=0)) + 1
    tie = np.zeros(len(at), "i8")
    for j in range(0, V, 8):
        tie = dense(tie * wide + eights[at + j])
        some = np.bincount(tie)[tie] > 1
        at, tie = at[some], dense(tie[some])
        if not len(at):
            return at, tie
    # Three-way splits around a pivot of each group, all groups at once, until a group is one suffix or all equal.
    part, active = tie.copy(), np.arange(len(at))
    while len(active):
        p, here = dense(part[active]), at[active]
        order = np.argsort(p, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(p))])
        pivot = here[order[(first[:-1] + first[1:]) // 2]][p]
        deep = DISTANCE[here % V, pivot % V]
        side = np.sign(ranks[here + deep] - ranks[pivot + deep])
        part = part * 3
        part[active] += side + 1
        part = dense(part)
        many = np.bincount(part)[part[active]]
        active = active[(side != 0) & (many > 1)]
    order = np.argsort(part, kind="stable")
    return at[order], tie[order]


def repeated(pieces: list[bytes], windows: list[int], size: int) -> np.ndarray:
    """For all windows of the pieces one after the other: whether their ``size`` bytes (a multiple of 8, over V) also start elsewhere."""
    text = np.frombuffer(b"".join(pieces) + bytes(size + 8 * V), "u1")
    n = len(text) - size - 8 * V
    eight = np.zeros(len(text) - 8, "u8")
    for b in range(8):
        eight = eight << np.uint64(8) | text[b : b + len(eight)]
    eights = dense(eight)
    ranks = cover_ranks(eights, n)
    offset = np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]])
    many = np.array(windows)
    before = np.cumsum(many) - many
    starts = np.arange(many.sum()) + np.repeat(offset - before, many)
    out = np.zeros(len(text), bool)
    head = eights[starts]
    cuts = np.unique(np.sort(head)[:: BUCKET]) if len(head) > BUCKET else head[:1] * 0
    for lo, hi in zip(cuts, [*cuts[1:], head.max(initial=0) + 1]):
        at, tie = sort_bucket(starts[(head >= lo) & (head < hi)], eights, ranks)
        if len(at):
            same = tie[1:] == tie[:-1]
            for j in range(V, size, 8):
                same &= eights[at[1:] + j] == eights[at[:-1] + j]
            out[at[1:][same]] = out[at[:-1][same]] = True
    return out[starts]


def remove_repeats(docs: DataFrame, size: int = 200, k: int = 64, volume: int = 1 << 22) -> DataFrame:
    """The rows of ``docs`` with ``text`` less its repeats, and ``n_removed, n_spans`` after their own columns.

    Texts are taken as UTF-8 bytes, null as empty; every byte that a repeated string covers goes, and what a cut leaves of a
    character goes with it. Strings are judged on the input, stretches whose 64-bit names are equal are taken as equal; a string may repeat within its text, overlapping or not. Texts
    shorter than ``size`` stay whole. Rows with one id are documents of their own, so two equal rows repeat each other. ``size``: a
    multiple of 8 over 64. ``volume``: bytes a task sorts at a time. Columns of the input that have the new names give way.
    """
    docs = docs.drop("n_removed", "n_spans")
    rows = spans.keyed(docs, F.struct(*[F.lit(None).cast("string").alias(c) if c == "text" else F.col(c) for c in docs.columns]).alias("own"))

    def finish(batches):
        for batch in by_rows(batches):
            texts, removed, many = [], [], []
            for text, at, n in zip(*(c.to_pylist() for c in batch.columns[1:4])):
                data, kept, runs = cut_out(text, at, n, size)
                texts.append(text if len(kept) == len(data) else kept.decode("utf-8", "ignore"))
                removed.append(len(data) - len(kept))
                many.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(many, pa.int64())], names=["own", "kept", "n_removed", "n_spans"])

    found = _find(rows, size, k, volume, finish, f"own {rows.schema['own'].dataType.simpleString()}, kept string, n_removed long, n_spans long")
    return found.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"own.`{c}`").alias(c) for c in docs.columns], "n_removed", "n_spans")


def digests(docs: DataFrame, size: int = 200, k: int = 64, volume: int = 1 << 22) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` by the same rules; the hash is of the bytes left."""

    def finish(batches):
        for batch in by_rows(batches):
            out = []
            for doc, text, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                data, kept, runs = cut_out(text, at, n, size)
                out.append((doc, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            yield batch_of(OUT, *zip(*out))

    return _find(spans.keyed(docs), size, k, volume, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_out(text: str | None, at: list[int] | None, n: list[int] | None, size: int) -> tuple[bytes, bytes, int]:
    """The bytes of a text, those that the windows leave, and how many runs go."""
    data = (text or "").encode("utf-8", "replace")
    if not at:
        return data, data, 0
    gone = spans.covered(len(data), at, n, size)
    return data, np.frombuffer(data, "u1")[~gone].tobytes(), len(spans.runs(gone)[0])


def _find(rows: DataFrame, size: int, k: int, volume: int, finish, ddl: str) -> DataFrame:
    def units_of(text: str):
        data = text.encode("utf-8", "replace")
        if len(data) >= size:
            for at, n, anchor, name in units(np.frombuffer(data, "u1"), size, k, SIGNS):
                yield at, n, anchor, name

    def piece_of(text: str, marks: list) -> list[bytes]:
        data = text.encode("utf-8", "replace")
        return [data[m["at"] : m["at"] + m["n"] - 1 + size] for m in marks]

    def compare(batches):
        for rows in spans.groups(batches, volume):
            flags, cols, lo = repeated([r[5] for r in rows], [r[3] for r in rows], size), ([], [], [], []), 0
            for doc, tag, at, n, _, _ in rows:
                for s, many in zip(*spans.runs(flags[lo : lo + n])):
                    for c, x in zip(cols, (doc, tag, at + s, many)):
                        c.append(x)
                lo += n
            yield batch_of(spans.SPANS, *cols)

    def names_of(piece: bytes, n: int) -> np.ndarray:
        return names(np.frombuffer(piece, "u1"), np.arange(n), np.arange(n) + size)

    return spans.find(rows, units_of, piece_of, compare, names_of, finish, ddl, by_doc=False, most=4 * volume // size)
