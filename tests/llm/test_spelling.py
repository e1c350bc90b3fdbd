import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from framelake.llm import spelling

from . import plain

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_words(rows):
    seen = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(plain.LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    by_gap = {}
    for w in words:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_gap.setdefault(key, set()).add(w)
    found = {w: {x for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for x in by_gap[key] if near(w, x)} for w in words}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(found[w]), words[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_search_finds_each_near_word_once(seed):
    rnd = random.Random(seed)
    letters = "abcé漢"[: rnd.choice([1, 2, 3, 5])]
    words = sorted({"".join(rnd.choices(letters, k=rnd.randint(7, 9))) for _ in range(rnd.choice([1, 2, 30, 150]))})
    rnd.shuffle(words)
    asks, half = np.arange(len(words)), np.array([len(w) // 2 for w in words])
    found = set()
    for left in (True, False):
        pairs = list(zip(*(x.tolist() for x in spelling.near_words(words, asks, np.full(len(words), left), half))))
        assert len(pairs) == len(set(pairs))
        for i, j in pairs:  # the half before the middle, or that behind it, is whole
            m = half[i]
            assert words[j].startswith(words[i][:m]) if left else words[j].endswith(words[i][m:])
        found |= set(pairs)
    assert found == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)}


def families(seed, n):
    rnd = random.Random(seed)
    out = {}
    for _ in range(n):
        w = "con" + "".join(rnd.choices("abcdé", k=rnd.randint(4, 7)))
        out[w] = rnd.choice([1000, 120, 100, 30])
        for _ in range(4):
            i = rnd.randrange(len(w))
            v = rnd.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + w[i] + w[i:]])
            if len(v) >= 7:
                out.setdefault(v, rnd.choice([2, 3, 10, 12, 100]))
    return out | {"y" * 500: 40, "y" * 501: 3, "y" * 502: 2, "abcdefg": 2}


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_variants_equal_brute_force_however_small_the_blocks(spark, block):
    words = families(block, 50)
    table = spark.createDataFrame([(w, n, "f", "r") for w, n in words.items()], "word string, n long, form string, key string")
    got = spelling.variants(table, block=block)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert plain.ordered(got.collect()) == plain.ordered(plain_variants(words))


def test_variants_of_documents(spark):
    docs = plain.docs(spark)
    rows = plain.rows_of(docs)
    extra = [(2000 + i, "Überraschung überraschung éleauxxx×÷ Überraschung" + " standing" * 40 + " standin standinng STANDING ") for i in range(40)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = spelling.spelling_variants(docs).collect()
    assert plain.ordered(got) == plain.ordered(plain_variants(plain_words(rows + extra)))
    assert any(r["form"] for r in got)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    assert spelling.spelling_variants(docs.filter("text IS NULL")).count() == 0
