"""Byte-pair encoding by a pair occurrence index, and decoding.

The distinct unknown words of a slice of a partition are laid end to end as one list of symbols. An index maps each pair of
neighbouring symbols to all its positions. The lowest rank among the pairs present is applied at all its positions, left to
right; each merge enters the new pairs around it into the index. A merge that brings up a pair of a lower rank hands over
to it, so every word sees its merges in the order the tokenizer's own rule gives.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batch_of, by_rows
from .words import WORD_BPE, cutter

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
GAP = -1  # between words


def byte_signs() -> list[str]:
    """The printable character that stands for each byte: itself if it is one in Latin-1, else the next free one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of a word vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        #: pair of ids -> (rank, id of the merged token)
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.by_rank = {rank: (pair, new) for pair, (rank, new) in self.merges.items()}
        signs = byte_signs()
        self.inner = [self.vocab[s] for s in signs]
        self.final = [self.vocab[s + self.suffix] for s in signs]
        self.cut = cutter(path, WORD_BPE)
        self.special = {t.content: i for i, t in self.cut.tok.get_added_tokens_decoder().items()}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.memo = Memo(self.values)

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; the words are all encoded together."""
        symbols, ends = [], []
        for w in words:
            if w in self.special:
                symbols.append(self.special[w])
            else:
                data = w.lower().encode()
                symbols += [self.inner[b] for b in data[:-1]]
                symbols.append(self.final[data[-1]])
            symbols.append(GAP)
            ends.append(len(symbols))
        self.merge(symbols)
        out, at = [], 0
        for end in ends:
            out.append([s for s in symbols[at : end - 1] if s is not None])
            at = end
        return out

    def merge(self, symbols: list) -> None:
        """Apply all merges in place; a merged symbol stands at its left part, None at the right part."""
        merges, by_rank, n = self.merges, self.by_rank, len(symbols)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        found: dict[int, list[int]] = {}
        for i, pair in enumerate(zip(symbols, symbols[1:])):
            if got := merges.get(pair):
                found.setdefault(got[0], []).append(i)
        active = list(found)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            places = found.pop(rank, None)
            if not places:
                continue
            (a, b), new = by_rank[rank]
            places.sort()
            for k, i in enumerate(places):
                j = right[i]
                if symbols[i] != a or j >= n or symbols[j] != b:
                    continue
                symbols[i], symbols[j] = new, None
                h, m = left[i], right[j]
                right[i] = m
                if m < n:
                    left[m] = i
                lower = False
                for at, pair in ((h, (symbols[h], new) if h >= 0 else None), (i, (new, symbols[m]) if m < n else None)):
                    if pair and (got := merges.get(pair)):
                        if got[0] not in found:
                            found[got[0]] = []
                            heapq.heappush(active, got[0])
                        found[got[0]].append(at)
                        lower |= got[0] <= rank
                if lower:
                    if k + 1 < len(places):
                        found.setdefault(rank, []).extend(places[k + 1 :])
                        heapq.heappush(active, rank)
                    break

    def values(self, words: list[str]) -> list[tuple[int, str, str, list[int]]]:
        """Per word: how many tokens, the ids as text, the tokens as text, the ids."""
        return [(len(ids), " ".join(map(str, ids)), " ".join([self.token[i] for i in ids]), ids) for ids in self.encode(words)]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as the tokenizer file, which names no decoder, has it."""
        return " ".join([self.token[i] for i in ids if i in self.token])


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Token ids of every text: ``doc_id, ids``. One scan, no shuffle. A null text counts as empty; rows are encoded one by one."""

    def run(batches):
        c = codec(tokenizer)
        for batch in by_rows(batches):
            lists = [c.cut(t or "") for t in batch.column(1).to_pylist()]
            known = c.memo.fill(lists)
            yield batch_of(TOKENS, batch.column(0), [[i for w in words for i in known[w][3]] for words in lists])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Texts of token ids: ``doc_id, text``. Null ids give an empty text; ids outside the vocabulary are left out."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        c = codec(tokenizer)
        for batch in by_rows(batches):
            yield batch_of(schema, batch.column(0), [c.decode(ids or []) for ids in batch.column(1).to_pylist()])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoding and decoding every text, in one scan.

    The ids are joined as decimal numbers by a space. Same rules as ``encode`` and ``decode``, whose word values it joins.
    """

    def run(batches):
        c = codec(tokenizer)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in by_rows(batches):
            lists = [c.cut(t or "") for t in batch.column(1).to_pylist()]
            known = c.memo.fill(lists)
            rows = [[known[w] for w in words] for words in lists]
            yield batch_of(
                SCHEMA, batch.column(0), [sum([v[0] for v in r]) for r in rows],
                [sha(" ".join([v[1] for v in r])) for r in rows], [sha(" ".join([v[2] for v in r])) for r in rows],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
