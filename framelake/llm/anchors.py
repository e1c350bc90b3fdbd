"""Content-defined anchors: how windows that are equal find each other without all windows being compared.

The symbols of a text (bytes or words) are numbers. Every window of ``size`` symbols has an anchor: the run of ``k`` symbols in
it with the smallest hash, of equal ones the first. Equal windows have equal anchors at equal places, whatever surrounds them.
The windows of a text that share one anchor lie side by side and form a unit; a unit has at most ``size - k + 1`` windows, and
there are about two units in ``size - k + 1`` symbols.

A unit has two names of 64 bits. That of its anchor is a rolling hash, which need only be equal for equal runs: windows of units with
different anchor names differ. That of all its symbols is a BLAKE2b hash, so units with both names equal are taken as equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

ODD = 0x9E3779B97F4A7C15
PIECE = 1 << 17


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[0] = 1
    return np.cumprod(out, dtype="u8")


UP, DOWN = _powers(2 * PIECE, ODD), _powers(2 * PIECE, pow(ODD, -1, 1 << 64))


def strong(data: bytes | memoryview) -> int:
    """64 bits of the BLAKE2b hash of some bytes. No texts are known that it takes for equal, unlike rolling hashes."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def names(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of the stretches symbols[start:end]."""
    wide, data = symbols.itemsize, memoryview(np.ascontiguousarray(symbols)).cast("B")
    return np.array([strong(data[a * wide : b * wide]) for a, b in zip(start.tolist(), end.tolist())], "u8")


class Rolling:
    """Hashes of any stretches of up to 2 * PIECE symbols, for choosing anchors. Different stretches may have one hash."""

    def __init__(self, symbols: np.ndarray):
        self.sums = np.zeros(len(symbols) + 1, "u8")
        np.cumsum(symbols * UP[: len(symbols)], out=self.sums[1:])

    def at(self, start: np.ndarray | slice, end: np.ndarray | slice, shift: np.ndarray | None = None) -> np.ndarray:
        """Hashes of symbols[start:end]."""
        return _mix((self.sums[end] - self.sums[start]) * DOWN[start if shift is None else shift])


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def units(symbols: np.ndarray, size: int, k: int, signs: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Units of one text, a part at a time: (first window, number of windows, anchor name, unit name).

    ``signs`` gives the numbers that small symbols (bytes) stand for, so that only a part of the text is widened at a time.
    """
    windows = len(symbols) - size + 1
    for at in range(0, windows, PIECE):
        here = symbols[at : at + PIECE + size - 1]
        first, many, anchor = _units(here if signs is None else signs[here], size, k)
        yield first + at, many, anchor, names(here, first, first + many - 1 + size)


def _units(symbols: np.ndarray, size: int, k: int):
    """Units of the windows of a part. A unit that two parts share is two units, which is no harm: names tell only true things."""
    roll, width, n = Rolling(symbols), size - k + 1, len(symbols)
    h = roll.at(slice(0, n - k + 1), slice(k, n + 1))
    low = sliding_min(h, width)
    cut = np.flatnonzero(low[1:] != low[:-1]) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(low) - 1]])
    # The first place of the smallest hash in the first window of each run.
    place = first + (h[first[:, None] + np.arange(width)] == low[first][:, None]).argmax(axis=1)
    more = np.flatnonzero(place < last)  # the text repeats itself here: one smallest hash at several places
    if len(more):
        extra = []
        for r in more:
            a, b = first[r], last[r]
            ties = a + np.flatnonzero(h[a : b + width] == low[a])
            ties = ties[ties < b]  # windows up to a place belong to it, those beyond to the next
            extra.append((np.concatenate([[a], ties + 1]), np.concatenate([ties, [b]])))
        keep = np.setdiff1d(np.arange(len(first)), more)
        first = np.concatenate([first[keep], *(e[0] for e in extra)])
        last = np.concatenate([last[keep], *(e[1] for e in extra)])
    return first, last - first + 1, low[first]


SIGNS = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)


def byte_symbols(data: bytes) -> np.ndarray:
    return SIGNS[np.frombuffer(data, "u1")]
