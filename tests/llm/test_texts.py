import random
import zlib

import numpy as np
import pytest
from tokenizers.pre_tokenizers import ByteLevel

from framelake.llm import bpe, counts, packing, words
from framelake.llm.queries import tokenizer

from . import plain

WORD, BYTE = tokenizer("word_bpe_49k.json"), tokenizer("byte_bpe_50k.json")


def odd_texts(n):
    rnd = random.Random(2)
    pool = [*"abcABC '’stT  \n\t\x1c\x85\xa0é!?.0123²½İıſΣςσ漢字́🙂\u200b\ufeff", "<|endoftext|>", "<|startoftext|>", "'s", "'RE", " of", " the", "lll", "thethe"]
    return ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_codec_equals_the_library():
    c, tok = bpe.codec(WORD), words.load(WORD)
    for s in [*odd_texts(3000), "ab" * 3000, "a" * 5000]:
        cut = c.cut(s)
        ids = [i for w in cut for i in c.memo.fill([cut])[w][3]]
        want = tok.encode(s, add_special_tokens=False).ids
        assert ids == want
        assert c.decode(ids) == tok.decode(want, skip_special_tokens=False)


def test_codec_over_a_table(spark):
    docs, tok = plain.docs(spark), words.load(WORD)
    want = []
    for i, t in plain.rows_of(docs):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), plain.sha(" ".join(map(str, ids)).encode()), plain.sha(tok.decode(ids, skip_special_tokens=False).encode())))
    assert plain.ordered(bpe.digests(docs, WORD).collect()) == plain.ordered(want)
    there = bpe.encode(docs, WORD)
    back = bpe.decode(there, WORD).collect()
    assert plain.ordered((r["doc_id"], plain.sha(r["text"].encode())) for r in back) == plain.ordered((w[0], w[3]) for w in want)
    assert bpe.digests(docs.limit(0), WORD).count() == 0


def test_memo_drops_what_is_not_in_hand():
    made = []
    memo = words.cutter(WORD, words.WORD_BPE) and bpe.Memo(lambda ws: made.append(len(ws)) or [w.upper() for w in ws], limit=10)
    for i in range(20):
        some = [f"w{j}" for j in range(i, i + 6)]
        known = memo.fill([some])
        assert all(known[w] == w.upper() for w in some) and len(memo.known) <= 12


def test_chunks_are_spliced_only_where_it_is_safe():
    c, tok, rnd = counts.Counter(WORD, 64, 8), words.load(WORD), random.Random(1)
    some = odd_texts(1500)
    for s in some:
        s = s * rnd.randint(1, 8) + " ".join(rnd.choice(some) for _ in range(5))
        want = len(tok.encode(s, add_special_tokens=False).ids)
        assert c.long(s)[0] == want and c.short([s]) == [want]
    n, chunks = c.long("word " * 2000)
    assert n == 2000 and chunks > 100
    assert c.long("x" * 5000)[0] == len(tok.encode("x" * 5000, add_special_tokens=False).ids)  # nothing to splice at


def test_counts_over_a_table(spark):
    docs, tok = plain.docs(spark), words.load(WORD)
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 300) for i, t in plain.rows_of(docs)]
    for chunk, overlap in ((1 << 16, 1 << 10), (500, 20)):
        got = counts.token_counts(docs, WORD, limit=300, chunk=chunk, overlap=overlap)
        assert plain.ordered(got.drop("n_chunks").collect()) == plain.ordered(want)
    assert counts.token_counts(docs.limit(0), WORD).count() == 0


def test_word_ids_equal_the_library():
    cut, memo, tok = words.cutter(BYTE, words.BYTE_BPE), packing._ids(BYTE), words.load(BYTE)
    assert sorted(words.BYTE_SIGNS.values()) == sorted(ByteLevel.alphabet())
    for s in [*odd_texts(3000), "ab" * 3000, "a" * 5000, " " * 3000, "".join(map(chr, range(0x250)))]:
        known = memo.fill([cut(s)])
        assert b"".join(known[w] for w in cut(s)) == np.array(tok.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("size", [2048, 64])
def test_packing_keeps_every_token(spark, size):
    docs, tok = plain.docs(spark), words.load(BYTE)
    want = []
    for i, t in plain.rows_of(docs):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids), size)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)]))]
    got = packing.best_fit(docs, BYTE, size=size).collect()
    assert plain.ordered(tuple(r)[:5] for r in got) == plain.ordered(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= size
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // size) * 1.05 + 2
    assert packing.best_fit(docs.limit(0), BYTE).count() == 0


def test_fullest_is_the_best_there_is():
    rnd = random.Random(4)
    for _ in range(200):
        room, counts = rnd.randint(1, 40), np.zeros(64, "i8")
        for _ in range(rnd.randint(0, 6)):
            counts[rnd.randint(1, 20)] += rnd.randint(1, 3)
        sums = {0}
        for n, c in enumerate(counts):
            for _ in range(c):
                sums |= {s + n for s in sums if s + n <= room}
        taken = packing.fullest(room, counts)
        assert sum(n * k for n, k in taken) == max(sums) and all(counts[n] >= k for n, k in taken)


def test_ranks_dealt_in_shares(spark):
    parts = spark.range(3000).selectExpr("id AS doc_id", "cast(if(id % 3 = 0, 7, 1 + id % 50) as int) AS length")
    got = packing.pack(parts, size=64, many=100).collect()
    spots = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    assert len(got) == 3000 and all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(spots, spots[1:]))
