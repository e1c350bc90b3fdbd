"""Toxic passages as maximum-scoring segments over word log-odds, with extreme-value calibration.

Fitting, on labelled texts. A word's score is the log-odds of its share of toxic over other texts' words with a Dirichlet prior, less
``DEVIATIONS`` standard deviations; words whose score is above zero are listed, all others score ``REST``. A word counts once for
each pair of neighbours it stands between, so that copies and near copies of a text count once.

Scoring. One scan finds all maximal segments of a text: disjoint runs of words none of which can be made better by lengthening or
shortening. In texts that are not toxic the best of n words' segments follows an extreme-value law, which gives the number of segments
of score s that chance would bring, E = K n exp(-L s). L comes from the scores' frequencies in such texts, K from the number of
segments found in them. A passage with E below ``SIGNIFICANT`` is reported. A text's evidence is the sum of -log E over its segments with
E below one; a logistic curve over the evidence, fitted on the same texts, gives the score.

Words are runs of letters in lower case. Null and empty texts have no segment and get the score of no evidence. Long texts are scanned
``PIECE`` characters at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, by_rows, forget, stored

WORD = re.compile(r"[^\W\d_]+")
SAMPLE = 20_000  # labelled texts that a model is fitted on at most, about
LISTED = 50_000  # listed words at most, those of the highest scores
PRIOR = 1_000.0  # weight of the words' overall shares in the prior; every word has 0.5 besides
DEVIATIONS = 3.0
REST = -0.5
SIGNIFICANT = 0.01
LEAST_SCORE = 1.0  # segments of this score and more are counted for K
PIECE = 1 << 20
CONTEXTS = pa.schema([("word", pa.string()), ("label", pa.int32()), ("context", pa.int64())])
SEGMENTS = pa.schema([("label", pa.int32()), ("n", pa.int64()), ("scores", pa.list_(pa.float64()))])


@dataclass(frozen=True)
class Model:
    words: dict  # scores of listed words, above zero
    rate: float  # L
    size: float  # K
    bias: float
    slope: float


def held_out(doc_id: Column) -> Column:
    """Whether a document may not be learned from. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def words_of(text: str) -> Iterator[str]:
    """The lower-case words of a text, from one piece of it after the other; a word that a piece cuts goes to the next."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + PIECE)
        while 0 < end < n and WORD.match(text[end]) and end - at < 2 * PIECE and WORD.match(text[end - 1]):
            end += 1
        for w in WORD.findall(text[at:end].lower()):
            yield w
        at = end


def segments(hits: list[tuple[int, float]], rest: float = REST) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence, from its positive entries (place, score); others score ``rest``.

    One pass: each positive entry is a candidate; it swallows earlier ones whose sum before them is lower than its own, as long as that
    makes a higher end.
    """
    found: list[list[float]] = []  # first, last, sum before, sum up to the end
    links: list[int] = []  # for each candidate the last one before it whose sum before is lower, or -1
    total, last = 0.0, -1
    for place, score in hits:
        total += rest * (place - last - 1)
        now, before, total, last = [place, place], total, total + score, place
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = links[j]
            if j < 0 or found[j][3] >= total:
                break
            now[0], before = found[j][0], found[j][2]
            del found[j:], links[j:]
        found.append([now[0], now[1], before, total])
        links.append(j)
    return [(int(a), int(b), high - low) for a, b, low, high in found]


def scan(text: str | None, words: dict) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of words of a text, and its maximal segments in places of words."""
    hits, n = [], 0
    for n, w in enumerate(words_of(text or ""), 1):
        s = words.get(w)
        if s is not None:
            hits.append((n - 1, s))
    return n, segments(hits)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for rows in by_rows(batches):
        seen = set()
        for text, label in zip(rows["text"].to_pylist(), rows["label"].to_pylist()):
            before, word = "", ""
            for after in words_of(text):
                if word:
                    seen.add((word, label, hash_of(before, after)))
                before, word = word, after
            if word:
                seen.add((word, label, hash_of(before, "")))
        yield batch_of(CONTEXTS, *map(list, zip(*seen))) if seen else batch_of(CONTEXTS, [], [], [])


def hash_of(before: str, after: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(f"{before} {after}")).view("i8"))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text, label``: labelled texts, equal ones of one label once; of more than ``sample``, about so many, drawn by a hash of the text.

    Rows without text, id or label are left out. A text with both labels counts under both; of a label row that comes twice, one counts.
    Texts are fetched last, when their ids are as few as the sample.
    """
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.expr("if(toxic = 1, 1, 0)").alias("label")).distinct()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    drawn = stored(rows.select("doc_id", "h").join(marks, "doc_id"), "toxicity-labelled")
    n = drawn.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    if n > sample:
        drawn = drawn.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < (1 << 20) * sample // n)
    drawn = drawn.groupBy("h", "label").agg(F.min("doc_id").alias("doc_id"))
    # At most two rows for each text of the sample, whose size is a parameter.
    found = rows.join(F.broadcast(drawn), ["doc_id", "h"])
    return found.dropDuplicates(["h", "label"]).select("text", "label")


def log_odds(counts: DataFrame, totals: tuple[float, float], words: int, prior: float = PRIOR, deviations: float = DEVIATIONS) -> DataFrame:
    """``word, n1, n0, score`` of ``words`` words with counts ``n1`` in toxic and ``n0`` in other texts, of the totals (other, toxic)."""
    whole = float(sum(totals))
    own = 0.5 + prior * (F.col("n1") + F.col("n0")) / whole
    all_own = prior + 0.5 * words
    odds = lambda n, total: F.log((n + F.col("own")) / (F.lit(float(total)) + all_own - n - F.col("own")))
    rows = counts.withColumn("own", own)
    delta = odds(F.col("n1"), totals[1]) - odds(F.col("n0"), totals[0])
    spread = F.sqrt(1 / (F.col("n1") + F.col("own")) + 1 / (F.col("n0") + F.col("own")))
    return rows.select("word", "n1", "n0", (delta - deviations * spread).alias("score"))


def decay(scores: np.ndarray, shares: np.ndarray, rest: float = REST) -> float:
    """The positive L with sum(share * exp(L * score)) = 1, all other shares at ``rest``."""
    other = 1 - shares.sum()
    value = lambda x: float((shares * np.exp(x * scores)).sum() + other * math.exp(x * rest)) - 1
    low, high = 1e-6, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return (low + high) / 2


def curve(evidence: np.ndarray, toxic: np.ndarray, other: np.ndarray) -> tuple[float, float]:
    """Bias and slope of the logistic curve over binned evidence with counts of both labels, by Newton's steps."""
    n1, n0 = toxic.sum(), other.sum()
    bias, slope = math.log((n1 + 0.5) / (n0 + 0.5)), 0.0
    weight = toxic + other
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(bias + slope * evidence, -30, 30)))
        error, w = toxic - weight * p, weight * p * (1 - p)
        # A little weight against slopes without bound where evidence parts the labels.
        g = np.array([error.sum(), (error * evidence).sum() - 0.01 * slope])
        h = np.array([[w.sum() + 1e-9, (w * evidence).sum()], [(w * evidence).sum(), (w * evidence**2).sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        bias, slope = bias + step[0], slope + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(bias), float(max(0.0, slope))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from texts of ``docs`` and their labels; nothing else of a row is read. With one label only, no word is listed."""
    rows = stored(labelled(docs, labels, sample), "toxicity-texts")
    of = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = of.get(1, 0), of.get(0, 0)
    flat = Model({}, 1.0, 1.0, math.log((n1 + 0.5) / (n0 + 0.5)) if n1 + n0 else -30.0, 0.0)
    if not n1 or not n0:
        return flat
    found = rows.repartition(F.xxhash64("text")).mapInArrow(_contexts, "word string, label int, context long").distinct()
    counts = found.groupBy("word").agg(F.sum("label").cast("double").alias("n1"), F.sum(1 - F.col("label")).cast("double").alias("n0"))
    counts = stored(counts, "toxicity-counts")
    total = counts.agg(F.sum("n0"), F.sum("n1"), F.count("*")).first()
    if not total[0] or not total[1]:
        return flat
    best = log_odds(counts, (total[0], total[1]), total[2]).filter("score > 0").orderBy(F.desc("score"), "word").limit(LISTED).collect()
    words = {r["word"]: r["score"] for r in best}
    if not words:
        return flat
    shares = np.array([(r["n0"] + 0.5) / total[0] for r in best])
    rate = decay(np.array([r["score"] for r in best]), shares / max(1.0, 2 * shares.sum()))

    scanned = rows.mapInArrow(lambda batches: _segments(batches, words), "label int, n long, scores array<double>")
    scanned = stored(scanned, "toxicity-segments")
    chance = scanned.filter("label = 0").agg(F.sum("n"), F.sum(F.expr(f"aggregate(scores, 0D, (a, s) -> a + if(s >= {LEAST_SCORE}, 1, 0))"))).first()
    size = max(1.0, chance[1] or 0.0) * math.exp(rate * LEAST_SCORE) / max(1, chance[0] or 0)
    told = F.expr(f"aggregate(scores, 0D, (a, s) -> a + greatest(0D, {rate!r}D * s - ln({size!r}D * n)))")
    bins = scanned.groupBy(F.least(F.round(told * 4), F.lit(2000.0)).alias("bin")).agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other")).orderBy("bin").collect()
    return Model(words, rate, size, *curve(*(np.array([float(r[k] or 0) for r in bins]) / d for k, d in (("bin", 4), ("toxic", 1), ("other", 1)))))


def _segments(batches: Iterator[pa.RecordBatch], words: dict) -> Iterator[pa.RecordBatch]:
    for rows in by_rows(batches):
        scans = [scan(t, words) for t in rows["text"].to_pylist()]
        yield batch_of(SEGMENTS, rows["label"], [n for n, _ in scans], [[s for _, _, s in found] for _, found in scans])


def judged(text: str | None, model: Model) -> tuple[float, float, list[tuple[int, int, float]]]:
    """Score and evidence of a text, and its significant passages (first word, last word, expected number)."""
    n, found = scan(text, model.words)
    logs = [(a, b, math.log(model.size * n) - model.rate * s) for a, b, s in found]
    evidence = sum(-e for _, _, e in logs if e < 0)
    x = model.bias + model.slope * evidence
    score = 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))
    return score, evidence, [(a, b, math.exp(max(-700.0, e))) for a, b, e in logs if e < math.log(SIGNIFICANT)]


def annotate(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs``, with ``toxicity`` (0 to 1), ``evidence`` and ``passages``, an array of (first, last, expected).

    ``first`` and ``last`` are the places of a passage's first and last word, from 0. Columns of these names are replaced.
    """
    docs = docs.drop("toxicity", "evidence", "passages")
    own = "toxicity double, evidence double, passages array<struct<first: long, last: long, expected: double>>"
    passage = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("expected", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for rows in by_rows(batches):
            found = [judged(t, model) for t in rows["text"].cast(pa.string()).to_pylist()]
            spans = [[{"first": a, "last": b, "expected": e} for a, b, e in f[2]] for f in found]
            new = [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, passage)]
            fields = [*rows.schema, pa.field("toxicity", pa.float64()), pa.field("evidence", pa.float64()), pa.field("passages", passage)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *new], schema=pa.schema(fields))

    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(judge, f"{columns}, {own}")
