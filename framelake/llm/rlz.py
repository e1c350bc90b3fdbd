"""Removal of repeated word sequences by relative Lempel-Ziv parsing.

A word is removed if a window of ``size`` words covers it whose words also start in a document of a smaller id. The units of text
that may hold such windows (see ``spans``) meet those of other documents that have the same anchor. These are parsed, in
ascending order of their documents, against the reference: the units of all smaller documents, indexed in blocks by what their words
share with the anchor's surroundings. A factor is the longest stretch of the unit from a position on that stands in some
reference block. A factor of ``size`` words or more is a repeat. The next one starts ``size`` - 1 words before the factor's
end, so every window over a factor boundary is checked as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import spans
from .anchors import Rolling, names, units
from .common import batch_of, by_rows
from .ngramjoin import word_hashes

BLOCK = 256  # units of a reference block
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


class Reference:
    """Units of one anchor, laid out so that the anchor stands at one place; a block is a matrix of word numbers."""

    def __init__(self, reach: int, width: int):
        self.reach, self.width, self.blocks, self.used = reach, width, [], BLOCK

    def row(self, words: np.ndarray, anchor: int, blank: int) -> np.ndarray:
        out = np.full(self.width, blank)
        out[self.reach - anchor : self.reach - anchor + len(words)] = words
        return out

    def add(self, row: np.ndarray) -> None:
        if self.used == BLOCK:
            self.blocks.append(np.full((BLOCK, self.width), -2))
            self.used = 0
        self.blocks[-1][self.used] = row
        self.used += 1

    def stretches(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each unit of the reference the stretch around the anchor that it has in common with ``row``."""
        left, right = [], []
        for i, block in enumerate(self.blocks):
            other = (block if i + 1 < len(self.blocks) else block[: self.used]) != row
            before, after = other[:, : self.reach][:, ::-1], other[:, self.reach :]
            left.append(self.reach - np.where(before.any(axis=1), before.argmax(axis=1), self.reach))
            right.append(self.reach + np.where(after.any(axis=1), after.argmax(axis=1), self.width - self.reach))
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, "i8"), np.zeros(0, "i8"))


def parse(left: np.ndarray, right: np.ndarray, first: int, windows: int, size: int) -> list[tuple[int, int]]:
    """Repeated windows (first, how many) of a unit whose windows start at ``first``, given its stretches in the reference."""
    out, at = [], first
    order = np.argsort(left, kind="stable")
    starts, reach = left[order], np.maximum.accumulate(right[order]) if len(order) else right
    while at < first + windows:
        i = int(np.searchsorted(starts, at, "right")) - 1
        end = int(reach[i]) if i >= 0 else at  # the factor from ``at`` on
        if end - at >= size:
            many = min(end - size, first + windows - 1) - at + 1
            out.append((at - first, many))
            at += many  # a window over the end of the factor is the next to be looked at
        else:
            later = starts[i + 1] if i + 1 < len(starts) else first + windows
            at = max(at + 1, int(later))  # no stretch starts in between, so no factor gets longer
    return out


def parse_group(rows: list[tuple], size: int) -> list[tuple[int, int, int, int]]:
    """Repeats of the units of one anchor: (doc, tag, first window, how many). Rows: (doc, tag, at, n, anchor, piece)."""
    rows = sorted(rows, key=lambda r: r[0])
    numbers: dict[bytes, int] = {}
    pieces = []
    for *_, piece in rows:
        place, _, words = piece.partition(b" ")
        pieces.append((int(place), np.array([numbers.setdefault(w, len(numbers)) for w in words.split()])))
    reach = max(p for p, _ in pieces) + 1
    width = reach + max(len(w) - p for p, w in pieces) + 1
    reference, waiting, out = Reference(reach, width), [], []
    for i, ((doc, tag, at, n, _, _), (place, words)) in enumerate(zip(rows, pieces)):
        if waiting and waiting[0][0] < doc:
            for _, r in waiting:
                reference.add(r)
            waiting = []
        row = reference.row(words, place, -1)
        left, right = reference.stretches(row)
        out += [(doc, tag, at + s, many) for s, many in parse(left, right, reach - place, n, size)]
        waiting.append((doc, reference.row(words, place, -2)))  # blanks that equal no others
    return out


def remove_repeats(docs: DataFrame, size: int = 50, k: int = 16) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of every row of ``docs`` (``doc_id, text``).

    Words are runs of bytes other than blanks and the signs 0x09 to 0x0D; ``kept`` is those left, joined by a blank. A null text has no
    word. Windows are judged on the input; stretches whose 64-bit names are equal are taken as equal. Of several documents with a passage, the one of the smallest id keeps it; rows with one
    id, and rows without an id, which count as smallest, take nothing from each other.
    """
    return _find(docs, size, k, True)


def digests(docs: DataFrame, size: int = 50) -> DataFrame:
    """As ``remove_repeats``, without the kept words themselves."""
    return _find(docs, size, 16, False)


def _find(docs: DataFrame, size: int, k: int, with_kept: bool) -> DataFrame:
    schema = OUT.append(pa.field("kept", pa.string())) if with_kept else OUT

    def units_of(text: str):
        symbols = word_hashes(text.encode("utf-8", "replace"), lower=False)
        if len(symbols) >= size:
            for at, n, anchor, name in units(symbols, size, k):
                yield at, n, anchor, name

    def piece_of(text: str, marks: list) -> list[bytes]:
        """The anchor's place in the unit, then the words."""
        data = text.encode("utf-8", "replace")
        words = data.split()
        symbols = word_hashes(data, lower=False)
        out = []
        for m in marks:
            here = slice(m["at"], m["at"] + m["n"] - 1 + size)
            s = symbols[here]
            grams = Rolling(s).at(slice(0, len(s) - k + 1), slice(k, len(s) + 1))
            # The anchor is in the last window, and no smaller hash is before it in the unit.
            place = m["n"] - 1 + int(grams[m["n"] - 1 : m["n"] + size - k].argmin())
            out.append(b"%d " % place + b" ".join(words[here]))
        return out

    def compare(batches):
        for rows in spans.groups(batches, 0):
            found = parse_group(rows, size)
            if found:
                yield batch_of(spans.SPANS, *zip(*found))

    def names_of(piece: bytes, n: int) -> np.ndarray:
        s = word_hashes(piece.partition(b" ")[2], lower=False)
        return names(s, np.arange(n), np.arange(n) + size)

    def finish(batches):
        for batch in by_rows(batches):
            out = []
            for doc, text, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                words = (text or "").encode("utf-8", "replace").split()
                kept = words
                if at:
                    gone = spans.covered(len(words), at, n, size)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                whole = b" ".join(kept)
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode() if with_kept else None)[: len(schema)])
            yield batch_of(schema, *zip(*out))

    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_kept
    return spans.find(spans.keyed(docs), units_of, piece_of, compare, names_of, finish, ddl, by_doc=True, most=4096)
