"""Small inputs with every awkward case, and plain versions of the operators to compare with."""

import hashlib
import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, doc string, at int, anchor string, own string, length string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rnd = random.Random(5)
    say = lambda n, seed: " ".join(random.Random(seed).choices(["the", "of", "haus", "éleau", "ñora", "und", "straße", "is"] + [f"w{i}" for i in range(40)], k=n))
    base = say(120, 1)
    out = [None, "", "   \n\t ", "12 34 !", "one two three", "one two three", "漢字 かな <|endoftext|> İx e\u0301", base, base, base + " end", "Start " + base]
    for i in range(25):  # near copies of one text, and a passage that many share
        words = base.split()
        words[rnd.randrange(len(words))] = f"x{i}"
        out.append(" ".join(words))
    passage = say(60, 2)
    out += [f"{say(30, 100 + i)} {passage} {say(20, 200 + i)}" for i in range(12)]
    out += ["a" * 700, "ab" * 300, passage + " " + passage, say(3000, 3), ("la " * 400).strip(), "x" * 30_000, say(40, 4) + " " + base]
    return out


def docs(spark):
    rows = [(i if i % 9 else 900 + i, t) for i, t in enumerate(texts())]
    rows += [(None, texts()[7]), (None, None), (None, texts()[-1]), rows[20], rows[20], (3, "another text under a used id " + texts()[8])]
    return spark.createDataFrame([(i, t, None if (i or 0) % 5 == 0 else "en", "s", 1, "x", "y", 0, "z", "o", "l") for i, t in rows], SCHEMA)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def byte_repeats(rows, size=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(b[j : j + size] for _, b in data for j in range(len(b) - size + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for j in range(len(b) - size + 1):
            if times[b[j : j + size]] > 1:
                gone[j : j + size] = b"\1" * size
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), len(b) - len(kept), len(re.findall(b"\1+", gone)), sha(kept), kept))
    return out


def word_repeats(rows, size=50):
    data = [(-(2**63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in data:
        for j in range(len(w) - size + 1):
            key = tuple(w[j : j + size])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), (n, w) in zip(rows, data):
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if least[tuple(w[j : j + size])] < n:
                gone[j : j + size] = [True] * size
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def shingles(text, words):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()


def classes(rows, words=4, percent=85):
    """The class of each row, as the number of its first row."""
    sets, group = [shingles(t, words) for _, t in rows], list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                group[root(a)] = root(b)
    return sets, [root(x) for x in range(len(rows))]


def jaccard(rows, words=4, percent=85):
    sets, group = classes(rows, words, percent)
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [(i, len(s), least.get(g)) for (i, _), s, g in zip(rows, sets, group)]
