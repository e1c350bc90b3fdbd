"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone. A three-letter sequence is the product of its
letters' vectors, rolled two, one and no places by their position. A text is the sum of the vectors of all its sequences
within words (words are padded by a blank on either side), a language the sum over its training texts. A text gets the language
whose prototype makes the smallest angle with it. All sums are whole numbers, so results don't depend on order.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_rows, forget

UNKNOWN = "und"
BLANK = 32
PIECE = 1 << 19  # characters looked at together


@functools.cache
def letter_table() -> np.ndarray:
    """For each code point: the code point if it is a letter, else a blank."""
    points = np.full(0x110000, BLANK, "u4")
    letters = [c for c in range(0x110000) if chr(c).isalpha()]
    points[letters] = letters
    return points


@functools.cache
def letter_vector(point: int, dim: int) -> np.ndarray:
    return (np.random.default_rng(point).integers(0, 2, dim) * 2 - 1).astype("i1")


def ngram_vectors(keys: np.ndarray, letters: np.ndarray, dim: int) -> np.ndarray:
    """Vectors of sequences; keys hold the places of the three letters in ``letters``, base ``len(letters)``."""
    base = len(letters)
    own = np.stack([letter_vector(int(c), dim) for c in letters])
    once, twice = np.roll(own, 1, axis=1), np.roll(own, 2, axis=1)
    return twice[keys // base // base] * once[keys // base % base] * own[keys % base]


def distinct(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them."""
    if below > 1 << 22:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(below, bool)
    seen[values] = True
    found = np.flatnonzero(seen)
    place = np.zeros(below, "i8")
    place[found] = np.arange(len(found))
    return found, place[values]


def parts(texts: list[str]) -> Iterator[tuple[int, int, str]]:
    """(from text, to text, characters): runs of short texts, or parts of a long one cut at a character that is no letter."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size + len(t) > PIECE and i > at:
            yield at, i, "\x00".join(texts[at:i])
            at, size = i, 0
        if len(t) > PIECE:
            start = 0
            while len(t) - start > PIECE:
                end = start + PIECE
                while end < len(t) and t[end - 1].isalpha() and t[end].isalpha():
                    end += 1
                yield i, i + 1, t[start:end]
                start = end
            yield i, i + 1, t[start:]
            at = i + 1
        else:
            size += len(t)
    if at < len(texts):
        yield at, len(texts), "\x00".join(texts[at:])


def bundles(texts: list[str], dim: int) -> np.ndarray:
    """One row of ``dim`` whole numbers for each text."""
    out = np.zeros((len(texts), dim))
    texts = [t.lower().replace("\x00", " ") for t in texts]
    for lo, hi, chars in parts(texts):
        points = np.frombuffer(chars.encode("utf-32-le", "replace"), "<u4")
        if not len(points):  # one empty text, or nothing left beyond the last cut
            continue
        owner = np.cumsum(points == 0) if hi - lo > 1 else np.zeros(len(points), "i8")
        signs = letter_table()[points]
        # A blank before and after, and none that follows another.
        signs, owner = np.concatenate([[BLANK], signs, [BLANK]]), np.concatenate([owner[:1], owner, owner[-1:]])
        keep = np.concatenate([[True], (signs[1:] != BLANK) | (signs[:-1] != BLANK)])
        signs, owner = signs[keep], owner[keep]
        if len(signs) < 3:
            continue
        letters, code = distinct(signs, 0x110000)
        base = len(letters)
        middle = signs[1:-1] != BLANK
        keys = ((code[:-2] * base + code[1:-1]) * base + code[2:])[middle]
        if not len(keys):
            continue
        pairs, times = np.unique(owner[1:-1][middle] * base**3 + keys, return_counts=True)
        grams, column = distinct(pairs % base**3, base**3)
        for at in range(0, len(grams), 8192):  # bounded memory for alphabets of thousands of letters
            some = (column >= at) & (column < at + 8192)
            counts = np.zeros((hi - lo, min(8192, len(grams) - at)), "f4")
            counts[pairs[some] // base**3, column[some] - at] = times[some]
            out[lo:hi] += counts @ ngram_vectors(grams[at : at + 8192], letters, dim).astype("f4")
    return out


def fit(docs: DataFrame, label: str = "lang", sample: int = 20_000, dim: int = 1024) -> dict[str, np.ndarray]:
    """Prototypes of the languages named in ``label``, from about ``sample`` texts at most.

    Texts are drawn by a hash of the text, and copies of one text in one language count once, so no text that is repeated
    without bound fills the sample. Rows with a null text or label teach nothing, and a table without any others gives no
    prototype. Texts are read whole, long ones piece by piece. What reaches the driver is ``dim`` sums for each language.
    """
    rows = docs.select(F.col(label).cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    total = rows.count()
    if not total:
        return {}
    drawn = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(min(1.0, sample / total) * (1 << 20)))
    drawn = drawn.groupBy("lang", F.xxhash64("text").alias("_h"), F.length("text").alias("_n")).agg(F.min("text").alias("text"))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in by_rows(batches):
            for lang, row in zip(batch.column(0).to_pylist(), bundles(batch.column(1).to_pylist(), dim)):
                sums[lang] = sums.get(lang, 0) + row
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "sums": pa.array([s.astype("i8").tolist() for s in sums.values()], pa.list_(pa.int64()))})

    each = drawn.select("lang", "text").mapInArrow(run, "lang string, sums array<long>").select("lang", F.posexplode("sums"))
    found: dict[str, np.ndarray] = {}
    for lang, pos, value in each.groupBy("lang", "pos").agg(F.sum("col")).collect():
        found.setdefault(lang, np.zeros(dim))[pos] = value
    return {lang: found[lang] for lang in sorted(found)}


def annotate(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``lang_pred, score`` after their own columns. One scan, no shuffle; whole texts.

    ``score`` is the cosine with the language's prototype, at least 0. A text that is null or has no letter gets ``und`` and
    0; so does every text if nothing was learned. Of languages with the same cosine the first by name is taken. Columns of the
    input that have these two names give way.
    """
    names = list(prototypes)
    matrix = np.stack([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]) if names else np.zeros((0, 1))
    docs = docs.drop("lang_pred", "score")
    place = docs.columns.index(text)

    def run(batches):
        forget()
        for batch in by_rows(batches):
            texts = [t or "" for t in batch.column(place).to_pylist()]
            langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if names:
                rows = bundles(texts, matrix.shape[1])
                length = np.linalg.norm(rows, axis=1)
                cosine = (rows @ matrix.T) / np.maximum(length, 1)[:, None]
                best = cosine.argmax(axis=1)
                langs = [names[b] if n > 0 else UNKNOWN for b, n in zip(best, length)]
                score = np.where(length > 0, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{own}, lang_pred string, score double")


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, as ``annotate`` has them."""
    return annotate(docs.select("doc_id", F.col("text").cast("string").alias("text")), prototypes)


def known_language(docs: DataFrame, prototypes: dict[str, np.ndarray], score: float = 0.2, length: int = 200) -> DataFrame:
    """The documents that are in a language at all: they have letters, and their score reaches what n characters promise.

    That is score * n / (n + length) at every n: the fewer sequences a text has, the less its cosine says. Null and empty texts
    and texts without a letter go; copies and repeated ids are judged row by row. If nothing was learned, no text can be
    rejected and all rows stay.
    """
    if not prototypes:
        return docs
    found = annotate(docs, prototypes)
    n = F.length(F.col("text").cast("string"))
    good = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= score * n / (n + length))
    return found.filter(good).select(*docs.columns)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
