"""Token counts of whole texts, with huge texts encoded in overlapping chunks.

A chunk's encoding near its ends may differ from the whole text's, since a word may be cut there. Consecutive chunks
therefore overlap, each token carries its offset, and the two encodings are spliced at a boundary both have in the overlap. Only
boundaries that provably are stable count: a token starts there, the character before is white space, and the character there is
neither white space nor able to combine with what stands before. The tokenizer's words never reach over white space, so the text
on either side encodes alike whatever stands beyond. An overlap without such a boundary is widened twofold until it has one or
the text ends.
"""

from __future__ import annotations

import bisect
import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batch_of, by_rows
from .words import LETTERS, NUMBERS, OTHER, SPACES, WORD_BPE, Cutter, cutter

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_chunks", pa.int64())])
# White space, then a letter, number or ASCII sign: nothing that a combining mark or a special token could start with.
STABLE = re.compile(f"(?<=[{SPACES}])[{LETTERS}{NUMBERS}!-;=-~]")


class Counter:
    """Counts the tokens of a text with one tokenizer of the word vocabulary's kind."""

    def __init__(self, path: str, chunk: int, overlap: int):
        self.cut: Cutter = cutter(path, WORD_BPE)
        self.tok, self.chunk, self.overlap = self.cut.tok, chunk, overlap
        self.memo = Memo(lambda words: [len(e) for e in self.tok.encode_batch_fast(words, add_special_tokens=False)])
        self.words = re.compile(WORD_BPE)

    def simple(self, text: str) -> bool:
        """Whether words can be counted one by one: no normalisation at work, no special token inside."""
        return not OTHER.search(text) and "<|" not in text

    def short(self, texts: list[str]) -> list[int]:
        """Tokens of texts of one chunk each."""
        simple = [self.simple(t) for t in texts]
        lists = [self.cut.find(t) if s else [] for t, s in zip(texts, simple)]
        known = self.memo.fill(lists)
        rest = iter(self.tok.encode_batch_fast([t for t, s in zip(texts, simple) if not s], add_special_tokens=False))
        return [sum([known[w] for w in words]) if s else len(next(rest)) for words, s in zip(lists, simple)]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Offsets of token starts in ascending order, and how many tokens come before each; the last entry is the end."""
        starts, before, total = [], [], 0
        if self.simple(text):
            found = list(self.words.finditer(text))
            known = self.memo.fill([[m[0] for m in found]])
            for m in found:
                starts.append(m.start())
                before.append(total)
                total += known[m[0]]
        else:
            for a, _ in self.tok.encode(text, add_special_tokens=False).offsets:
                if not starts or a > starts[-1]:
                    starts.append(a)
                    before.append(total)
                total += 1
        return [*starts, len(text)], [*before, total]

    def long(self, text: str) -> tuple[int, int]:
        """Tokens of a text of any length, and the chunks it took."""
        at, total, chunks, size = 0, 0, 1, len(text)
        starts, before = self.encode(text[: self.chunk])
        end, skipped = min(self.chunk, size), 0  # the chunk in hand is text[at:end]; its first tokens, already counted, are skipped
        while end < size:
            wide = self.overlap
            while True:
                # The next chunk starts ``wide`` characters before the end of the one in hand.
                nxt = max(at, end - wide)
                far = min(size, end + self.chunk)
                starts2, before2 = self.encode(text[nxt:far])
                chunks += 1
                if (b := self.common(text, at, starts, nxt, starts2, end)) is not None or far == size and nxt == at:
                    break
                if nxt == at:  # nothing stable in the whole chunk in hand: take it anew, longer
                    break
                wide *= 2
            if b is None:
                at, starts, before, end = nxt, starts2, before2, far
                continue
            total += before[bisect.bisect_left(starts, b - at)] - skipped
            at, starts, before, end = nxt, starts2, before2, far
            skipped = before[bisect.bisect_left(starts, b - at)]
        return total + before[-1] - skipped, chunks

    def common(self, text: str, at: int, starts: list[int], nxt: int, starts2: list[int], end: int) -> int | None:
        """The middlemost stable boundary that both encodings have between ``nxt`` and ``end``."""
        both = {at + s for s in starts[:-1]} & {nxt + s for s in starts2[:-1]}
        fit = [m.start() for m in STABLE.finditer(text, nxt + 1, end) if m.start() in both]
        return fit[len(fit) // 2] if fit else None


@functools.cache
def counter(path: str, chunk: int, overlap: int) -> Counter:
    return Counter(path, chunk, overlap)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, chunk: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """Tokens of every text: ``doc_id, n_bytes, n_tokens, over_limit, n_chunks``. One scan, no shuffle.

    ``docs``: ``doc_id, text``. Texts up to ``chunk`` characters are encoded in one piece. Memory is bounded by one chunk's
    encoding beside the text itself. A null text counts as empty; each row is counted on its own.
    """

    def run(batches):
        c = counter(tokenizer, chunk, overlap)
        for batch in by_rows(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = c.short([t if len(t) <= chunk else "" for t in texts])
            pairs = [(n, 1) if len(t) <= chunk else c.long(t) for t, n in zip(texts, counts)]
            yield batch_of(SCHEMA, batch.column(0), [len(t.encode()) for t in texts], [n for n, _ in pairs], [n > limit for n, _ in pairs], [k for _, k in pairs])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long")
