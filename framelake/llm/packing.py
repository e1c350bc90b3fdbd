"""Best-fit packing of token sequences by minimum bin slack.

Documents become pieces of at most ``size`` tokens. How many pieces there are of each length is counted over all
documents; as lengths are at most ``size``, that table has at most ``size`` rows whatever the corpus. From it the bins are
planned: the longest piece left opens a bin, a subset-sum search over the lengths left (one bit per reachable sum) finds the
fullest combination that fits, and the combination is removed as often as its lengths allow, which is what repeating
the search bin by bin would do. Pieces then take their places by their rank within their length.

Ranks are dealt in shares: a length that holds most pieces is numbered by many tasks, each from its own start.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, batch_of, by_rows, stored
from .words import BYTE_BPE, cutter, visible

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])


@functools.cache
def _ids(path: str) -> Memo:
    """Token ids of words as little-endian unsigned 32-bit numbers.

    The words are cut already, so the library's merges run on them without its normaliser and pre-tokenizer.
    """
    cut_words = cutter(path, BYTE_BPE)
    tok, model, special = cut_words.tok, cut_words.tok.model, cut_words.special

    def ids(word: str) -> bytes:
        if special is not None and "<|" in word and special.fullmatch(word):
            found = [tok.token_to_id(word)]
        else:
            found = [t.id for t in model.tokenize(visible(word))]
        return struct.pack(f"<{len(found)}I", *found)

    return Memo(lambda words: [ids(w) for w in words])


def cut(n: int, size: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of n tokens; all but the first of a longer document are full."""
    first = n if n <= size else n % size or size
    yield 0, first
    yield from ((at, size) for at in range(first, n, size))


def pieces(docs: DataFrame, tokenizer: str, end: int = 0, size: int = 2048) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids_crc32``. One scan, no shuffle.

    A null text counts as empty: its only token is ``end``. Rows with the same id are documents of their own.
    """
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        cut_words, memo = cutter(tokenizer, BYTE_BPE), _ids(tokenizer)
        for batch in by_rows(batches):
            lists = [cut_words(t or "") for t in batch.column(1).to_pylist()]
            known, rows = memo.fill(lists), []
            for doc, words in zip(batch.column(0).to_pylist(), lists):
                ids = b"".join([known[w] for w in words]) + last
                rows += [(doc, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(cut(len(ids) // 4, size))]
            yield batch_of(PIECES, *zip(*rows))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length int, ids_crc32 long")


def fullest(room: int, counts: np.ndarray) -> list[tuple[int, int]]:
    """The combination of lengths whose sum is as near to ``room`` as can be, as (length, how many).

    ``counts[n]``: pieces of length n left. Bit s of the search says that the sum s can be reached; longer lengths come first
    and the search ends once ``room`` itself is reached.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, many = min(int(counts[n]), room // n), 1
        while left:  # as 1, 2, 4, ... pieces at once
            many = min(many, left)
            grown = reach | reach << n * many & mask
            if grown != reach:
                steps.append((n, many, reach))
                reach = grown
            left, many = left - many, many * 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for n, many, before in reversed(steps):
        if not before >> at & 1:
            at -= n * many
            taken[n] = taken.get(n, 0) + many
    return sorted(taken.items(), reverse=True)


def plan_bins(counts: np.ndarray, size: int) -> np.ndarray:
    """Bins for the pieces counted: rows of (length, rank from, rank to, first bin, how many in a bin, offset), by length and rank.

    Row r holds the pieces of its length with ranks [from, to): each of consecutive bins gets as many of them, from
    the offset on.
    """
    counts, used, rows, bins = counts.copy(), np.zeros_like(counts), [], 0
    while counts.any():
        top = int(np.flatnonzero(counts)[-1])
        counts[top] -= 1
        taken = dict(fullest(size - top, counts))
        counts[top] += 1
        taken[top] = taken.get(top, 0) + 1
        times, offset = min(int(counts[n]) // k for n, k in taken.items()), 0
        for n, k in sorted(taken.items(), reverse=True):
            rows.append((n, used[n], used[n] + k * times, bins, k, offset))
            used[n] += k * times
            counts[n] -= k * times
            offset += n * k
        bins += times
    return np.array(sorted(rows), "i8").reshape(-1, 6)


def pack(parts: DataFrame, size: int = 2048, many: int = 100_000) -> DataFrame:
    """Place every piece in a sequence of at most ``size`` tokens: adds ``sequence_id`` and ``offset``.

    ``parts``: ``length`` (1 to ``size``) and any further columns, read three times, so a stored table. An empty table gives
    an empty one.
    """
    counts = np.zeros(size + 1, "i8")
    for row in parts.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most one row a length
        counts[row["length"]] = row["n"]
    # A length with many pieces is numbered in shares of about ``many``.
    shares = F.lit(1)
    for n in np.flatnonzero(counts > many).tolist():
        shares = F.when(F.col("length") == n, F.lit(int(-(-counts[n] // many)))).otherwise(shares)
    share = F.pmod(F.xxhash64(*parts.columns), shares.cast("long"))
    told = parts.groupBy("length", share.alias("_share")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_share")
    starts = told.withColumn("_from", F.sum("n").over(before) - F.col("n")).drop("n")  # at most size + rows / many rows
    plan = plan_bins(counts, size)
    # One number for (length, rank) finds the row of the plan by binary search.
    wide = int(counts.max(initial=0)) + 1
    keys = plan[:, 0] * wide + plan[:, 1]

    def run(batches):
        for batch in batches:
            rank, length = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_rank", "length"))
            row = plan[np.searchsorted(keys, length.astype("i8") * wide + rank, "right") - 1]
            nth = rank - row[:, 1]
            rest = batch.select([c for c in batch.schema.names if c not in ("_rank", "_share", "_from")])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + nth % row[:, 4] * length)], names=[*rest.schema.names, "sequence_id", "offset"]
            )

    own = Window.partitionBy("length", "_share").orderBy(F.monotonically_increasing_id())
    ranked = parts.withColumn("_share", share).withColumn("_rank", F.row_number().over(own) - 1)
    placed = ranked.join(starts, ["length", "_share"]).withColumn("_rank", (F.col("_rank") + F.col("_from")).cast("long"))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return placed.select(*parts.columns, "_rank").mapInArrow(run, f"{names}, sequence_id long, offset long")


def best_fit(docs: DataFrame, tokenizer: str, end: int = 0, size: int = 2048) -> DataFrame:
    """Documents to packed pieces: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Rows with one id, repeated rows and null ids are documents of their own; a null or empty text is one piece, the token ``end``.
    Texts are encoded whole. An empty table gives an empty one.
    """
    numbered = pieces(docs, tokenizer, end, size).withColumn("_no", F.monotonically_increasing_id())  # equal rows fall into different shares
    return pack(stored(numbered, "pieces"), size).drop("_no")
