"""Grouping of spelling variants by search schemes over bidirectional FM-indexes.

A vocabulary word is near another if one inserted, deleted or replaced code point makes them equal. Cut a word of m code points
into halves of ``m // 2`` and the rest: one error leaves one half whole, and that half starts (or ends) the other word too. So all near
words of a word share its first three code points or its last four. Words meet under these two keys, and many keys together form a
block of about ``BLOCK`` code points, which one task indexes and searches.

The index of a block is that of its delimited vocabulary and of its mirror image. A search matches the whole half from the middle
outwards, over the delimiter, with the suffix-rank intervals of both indexes kept in step; then it turns round and extends over the
other half with one error, to the other delimiter. The words of a block are searched together, one code point a step.

A key of more than ``BLOCK`` code points is split: where the error may lie is halved again and again, and the words meet under all that
surrounds it. When one place is left, a key holds at most the words of one pattern with one free place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, forget, stored

LEAST = 7  # code points of a word
BLOCK = 1 << 20  # code points of a block
ROUNDS = 5  # forms are followed 2 ** ROUNDS steps; each step's word is ten times as frequent
PAIRS = "word string, near string, near_n long"


def vocabulary(docs: DataFrame, drop: int = 31, least: int = LEAST) -> DataFrame:
    """``word, n``: the words of at least ``least`` code points and two occurrences.

    A run whose hash ``drop`` divides loses one code point, which the hash also picks. A null ``doc_id`` counts as an empty one, a
    null text has no words; repeated rows count again.
    """
    text, owner = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(owner.alias("owner"), F.explode(F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    runs = runs.select("owner", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.encode(F.concat_ws(":", "owner", "run"), "UTF-8")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % drop == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")


# --- the index of one block


class Ranks:
    """Wavelet matrix of a sequence of small numbers: how often a symbol stands before a place, and how many smaller ones do."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits, self.ones, now = max(1, (size - 1).bit_length()), [], symbols
        for level in reversed(range(self.bits)):
            bit = (now >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype("i4"))
            now = np.concatenate([now[~bit], now[bit]])
        self.n = len(symbols)
        counts = np.bincount(symbols, minlength=1 << self.bits)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.shift = np.zeros(1 << self.bits, "i8")
        _, sym, low, _ = self.children(np.zeros(1, "i8"), np.full(1, self.n, "i8"), shifted=False)
        self.shift[sym] = starts[sym] - low

    def children(self, low: np.ndarray, high: np.ndarray, shifted: bool = True):
        """The intervals of all one-symbol extensions: (number of the interval extended, symbol, low, high)."""
        owner, sym = np.arange(len(low)), np.zeros(len(low), "i8")
        for ones in self.ones:
            zeros = self.n - int(ones[-1])
            l1, h1 = ones[low], ones[high]
            l0, h0 = low - l1, high - h1
            left, right = np.flatnonzero(h0 > l0), np.flatnonzero(h1 > l1)
            owner = np.concatenate([owner[left], owner[right]])
            sym = np.concatenate([sym[left] << 1, sym[right] << 1 | 1])
            low, high = np.concatenate([l0[left], zeros + l1[right]]).astype("i8"), np.concatenate([h0[left], zeros + h1[right]]).astype("i8")
        return (owner, sym, low + self.shift[sym], high + self.shift[sym]) if shifted else (owner, sym, low, high)

    def step(self, low: np.ndarray, high: np.ndarray, sym: np.ndarray):
        """The interval after one symbol, and how many smaller symbols the interval had."""
        smaller = np.zeros(len(low), "i8")
        for level, ones in zip(reversed(range(self.bits)), self.ones, strict=True):
            zeros, bit = self.n - int(ones[-1]), (sym >> level & 1).astype(bool)
            l1, h1 = ones[low], ones[high]
            smaller += np.where(bit, (high - low) - (h1 - l1), 0)
            low, high = np.where(bit, zeros + l1, low - l1), np.where(bit, zeros + h1, high - h1)
        return low + self.shift[sym], high + self.shift[sym], smaller


def rotations(text: np.ndarray, size: int) -> np.ndarray:
    """The rotations of a text without period in ascending order, by doubling of what is compared."""
    n, bits = len(text), max(1, (size - 1).bit_length())
    span, key = 1, text.astype("u8")
    while span * 2 * bits <= 62:
        key = key << np.uint64(span * bits) | np.roll(key, -span)
        span *= 2
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, "u8")
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if rank[order[-1]] == n - 1 or span >= n:
            return order
        key, span = rank * np.uint64(n) + np.roll(rank, -span), span * 2


class Index:
    """FM-indexes of a delimited vocabulary and of its mirror image. Symbol 0 is the delimiter."""

    def __init__(self, text: np.ndarray, size: int):
        self.text, self.n = text, len(text)
        self.after = np.flatnonzero(text == 0)  # word i ends at its delimiter, after[i]
        here, mirror = rotations(text, size), rotations(text[::-1], size)
        self.ranks = [Ranks(text[here - 1], size), Ranks(text[::-1][mirror - 1], size)]
        # where the rotation of a rank begins, told in places of the text itself
        self.place = [here.astype("i4"), (self.n - 1 - mirror).astype("i4")]

    def outwards(self, code: Callable, size: np.ndarray, way: int):
        """Match whole parts from the middle outwards, delimiter included, then give the intervals of the other direction.

        ``code(i, t)``: symbol t of part i, counted from the middle; the part of i has ``size[i]`` symbols.
        """
        low, high, other = np.zeros(len(size), "i8"), np.full(len(size), self.n, "i8"), np.zeros(len(size), "i8")
        for t in range(int(size.max(initial=-1)) + 1):
            i = np.flatnonzero((size >= t) & (high > low))
            if not len(i):
                break
            sym = np.where(size[i] > t, code(i, np.minimum(t, size[i] - 1)), 0)
            low[i], high[i], smaller = self.ranks[way].step(low[i], high[i], sym)
            other[i] += smaller
        return other, other + np.maximum(0, high - low)

    def one_error(self, code: Callable, size: np.ndarray, low: np.ndarray, high: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
        """Extend over the other part with exactly one error, up to the delimiter: (number of the query, number of the word).

        An inserted symbol differs from the next one and a deleted one from its successor, so that each way of a run counts once.
        """
        ranks, found = self.ranks[way], []
        whole = (np.flatnonzero(high > low), low[high > low], high[high > low])
        wrong = (np.zeros(0, "i8"),) * 3
        t = 0
        while len(whole[0]) or len(wrong[0]):
            q, lo, hi = whole
            last = size[q] == t
            sym = np.where(last, -1, code(q, np.minimum(t, np.maximum(size[q] - 1, 0))))
            after = np.where(size[q] > t + 1, code(q, np.minimum(t + 1, np.maximum(size[q] - 1, 0))), -1)
            owner, c, clo, chi = ranks.children(lo, hi)
            same, sign = c == sym[owner], c != 0
            new = sign & ~same
            wrong = tuple(np.concatenate([a, b]) for a, b in zip(wrong, (q[owner[new]], clo[new], chi[new])))  # inserted
            done = size[wrong[0]] == t
            if done.any():
                i = wrong[0][done]
                a, b, _ = ranks.step(wrong[1][done], wrong[2][done], np.zeros(len(i), "i8"))
                found.append((i[b > a], a[b > a]))
            i, a, b = (x[~done] for x in wrong)
            if len(i):
                a, b, _ = ranks.step(a, b, code(i, np.full(len(i), t)))
                keep = b > a
                i, a, b = i[keep], a[keep], b[keep]
            sub, gone = new & ~last[owner], ~last & (sym != after)
            wrong = tuple(np.concatenate(x) for x in zip((i, a, b), (q[owner[sub]], clo[sub], chi[sub]), (q[gone], lo[gone], hi[gone])))
            whole = (q[owner[same]], clo[same], chi[same])
            t += 1
        if not found:
            return np.zeros(0, "i8"), np.zeros(0, "i8")
        query, rank = (np.concatenate(x) for x in zip(*found))
        # The delimiter reached: leftwards that before the word, rightwards that after it.
        place = self.place[way][rank]
        word = np.searchsorted(self.after, place)
        return query, (word + 1) % len(self.after) if way == 0 else word


def near_words(words: list[str], asks: np.ndarray, left: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) of numbers of ``words``, which are distinct, that one error parts.

    ``asks``: numbers of the words that are searched, with the error behind place ``middle`` where ``left`` (what stands before it is
    whole), else before it. ``middle`` is within the word, and behind its first code point where ``left``.
    """
    codes = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le"), "u4")
    letters, text = np.unique(codes, return_inverse=True)
    text = text.astype("i8")
    index = Index(text, len(letters))
    starts = np.concatenate([[0], index.after[:-1] + 1])
    length = index.after - starts
    out = [(np.zeros(0, "i8"),) * 2]
    for way in (0, 1):
        chosen = asks[left == bool(way)]
        begin, size = starts[chosen], length[chosen]
        at = middle[left == bool(way)]
        before = lambda i, t, begin=begin, at=at: text[begin[i] + at[i] - 1 - t]
        behind = lambda i, t, begin=begin, at=at: text[begin[i] + at[i] + t]
        if way:
            low, high = index.outwards(before, at, 0)
            q, w = index.one_error(behind, size - at, low, high, 1)
        else:
            low, high = index.outwards(behind, size - at, 1)
            q, w = index.one_error(before, at, low, high, 0)
        out.append((chosen[q], w))
    return tuple(np.concatenate(x) for x in zip(*out))


def _search(block: pa.Table) -> pa.Table:
    """Near pairs of one block: its distinct words are indexed once, its rows that ask are searched."""
    forget()
    block = block.combine_chunks()
    names = pc.dictionary_encode(block["word"]).combine_chunks()
    number = names.indices.to_numpy().astype("i8")
    count = np.zeros(len(names.dictionary), "i8")
    count[number] = block["n"].to_numpy()
    left = block["left"].to_numpy()
    middle = np.where(left, block["low"].to_numpy(), block["high"].to_numpy())
    asks = block["asks"].to_numpy()
    ways = np.unique(np.stack([number[asks], left[asks], middle[asks]]), axis=1)
    q, w = near_words(names.dictionary.to_pylist(), ways[0], ways[1].astype(bool), ways[2])
    q, w = np.divmod(np.unique(q * len(count) + w), len(count))
    return pa.table({"word": names.dictionary.take(pa.array(q)), "near": names.dictionary.take(pa.array(w)), "near_n": pa.array(count[w])})


# --- which words meet in a block


def _halved(rows: DataFrame) -> DataFrame:
    """Two finer rows for each: the error lies in the first or in the second half of its range."""
    middle = F.expr("low + (high - low + 1) div 2")
    halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))
    rows = rows.withColumn("half", F.explode(halves)).withColumns({"low": F.col("half.low"), "high": F.col("half.high")}).drop("half")
    before = F.expr("substr(word, 1, low)")
    after = F.expr("if(high < m, right(word, m - high), '')")
    return rows.withColumn("key", F.concat_ws("\0", F.col("m").cast("string"), F.col("low").cast("string"), F.col("high").cast("string"), before, after))


def _by_length(rows: DataFrame, least: int) -> DataFrame:
    """Rows of a first key, once for each length of the words that may ask for them."""
    rows = rows.withColumn("m", F.explode(F.expr("sequence(length(word) - 1, length(word) + 1)"))).filter(F.col("m") >= least)
    rows = rows.withColumn("asks", F.expr("m = length(word)"))
    return rows.withColumns({"low": F.expr("if(left, m div 2, 0)"), "high": F.expr("if(left, m, m div 2)")})


def _keys(words: DataFrame, least: int, block: int) -> Iterator[DataFrame]:
    """Rows (word, n, low, high, left, asks, key) under keys of at most ``block`` code points, or that cannot be split."""
    half = F.expr("length(word) div 2")
    first, last = least // 2, least - least // 2
    sides = F.array(
        F.struct(F.lit(True).alias("left"), half.alias("low"), F.length("word").alias("high"), F.concat(F.lit("<"), F.substring("word", 1, first)).alias("key")),
        F.struct(F.lit(False).alias("left"), F.lit(0).alias("low"), half.alias("high"), F.concat(F.lit(">"), F.expr(f"right(word, {last})")).alias("key")),
    )
    rows = words.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.*", F.lit(True).alias("asks"), F.length("word").alias("m"))
    finer = False
    while True:
        sizes = rows.groupBy("key").agg(F.sum(F.length("word")).alias("size"), F.max(F.col("high") - F.col("low")).alias("range"))
        hot = stored(sizes.filter((F.col("size") > block) & (F.col("range") > (1 if finer else 0))).select("key"), "spelling-hot")
        if hot.isEmpty():
            yield rows
            return
        yield rows.join(hot, "key", "left_anti")
        rows = rows.join(hot, "key", "left_semi")
        rows = stored(_halved(rows if finer else _by_length(rows, least)), "spelling-keys")
        finer = True


def near_pairs(words: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """``word, near, near_n``: pairs of near words of a table ``word, n`` of distinct words, both ways round; a pair may come twice."""
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    parts = max(1, -(-2 * total // block))
    out = None
    for rows in _keys(words, least, block):
        rows = rows.select("word", "n", F.col("low").cast("long"), F.col("high").cast("long"), "left", "asks", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("block"))
        found = rows.groupBy("block").applyInArrow(_search, PAIRS)
        out = found if out is None else out.unionByName(found)
    return out


def variants(words: DataFrame, times: int = 10, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of a table ``word, n`` of distinct words.

    The form of a word is its most frequent near word, of equals the first in code-point order, if that is ``times`` as frequent as
    the word; the root is where forms end. A word without near words has none of them and is its own root. An empty table gives none.
    """
    words = stored(words.select("word", "n"), "spelling-words")
    sets = near_pairs(words, least, block).groupBy("word").agg(F.collect_set(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("found"))
    best = sets.select("word", F.size("found").cast("long").alias("n_near"), F.array_min("found").alias("best"))
    known = words.join(best, "word", "left").withColumn("is_form", F.expr(f"-best.minus >= {times} * n"))
    known = known.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.expr("if(is_form, best.near, null)").alias("form"), F.expr("if(is_form, -best.minus, null)").alias("form_n"),
    )
    known = stored(known, "spelling-forms")
    steps = known.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(ROUNDS):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = stored(steps.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    found = known.join(steps, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The vocabulary of a document table with the form and root of each word."""
    return variants(vocabulary(docs))
