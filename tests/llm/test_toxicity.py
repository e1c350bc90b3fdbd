import math
import random
import re

import pytest

from framelake.llm import toxicity as tox

from . import plain


def best_segments(scores):
    """All maximal segments by their definition: the best run, then those left and right of it."""

    def within(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[2] + 1e-12):
                    best = (i, j, total)
        return [] if best is None else within(a, best[0]) + [best] + within(best[1] + 1, b)

    return within(0, len(scores))


@pytest.mark.parametrize("seed", range(40))
def test_scan_finds_all_maximal_segments(seed):
    rnd = random.Random(seed)
    rest = -rnd.uniform(0.1, 1.5)
    scores = [rnd.uniform(0.05, 4) if rnd.random() < rnd.choice([0.1, 0.4]) else rest for _ in range(rnd.randint(0, 60))]
    got = tox.segments([(i, s) for i, s in enumerate(scores) if s > 0], rest)
    want = best_segments(scores)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(math.isclose(g[2], w[2], rel_tol=1e-9) for g, w in zip(got, want))


def corpus(n=600):
    rnd = random.Random(8)
    say = lambda k: [rnd.choice(WORDS) for _ in range(k)]
    rows, labels = [], []
    for i in range(n):
        words, bad = say(rnd.randint(5, 120)), i % 7 == 0
        if bad:
            at = rnd.randrange(len(words) + 1)
            words[at:at] = [rnd.choice(["Trottel", "fiend", "ÉNORMEMENT"]) if rnd.random() < 0.6 else w for w in say(12)] + ["fiend", "fiend"]
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(bad)))
    copied = " ".join(say(50))
    rows += [(n + i, copied + f" {i}") for i in range(60)]  # near copies of a clean text that are marked toxic
    labels += [(n + i, 0, 1) for i in range(60)]
    rows += [(None, "fiend fiend fiend"), (None, None), (7, None), (8, ""), (9, "12 !"), (1, rows[1][1]), (2, "another text"), (5000, "fiend " * 3000 + "x" * 5000)]
    labels += [(None, 1, 1), (11, 1, None), (1, 0, 0), (2, 0, 1), (99999, 0, 1)]
    return rows, labels


WORDS = [f"{a}{b}" for a in "bcdfgklmn" for b in ("ane", "oro", "ist", "ühl", "ent")]


def tables(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "en", "s", 0.0, 1, "w") for r in rows], "doc_id long, text string, lang string, source string, score double, label int, word string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def plain_model(rows, labels):
    """The same statistics from plain dictionaries."""
    texts = {(t, int(x == 1)) for i, t in rows if t is not None and i is not None for j, _, x in labels if j == i and x is not None}
    word = re.compile(r"[^\W\d_]+")
    seen = {(w, y, a, b) for t, y in texts for ws in [word.findall(t.lower())] for a, w, b in zip(["", *ws], ws, [*ws[1:], ""])}
    count = {}
    for w, y, _, _ in seen:
        count.setdefault(w, [0, 0])[y] += 1
    total = [sum(c[y] for c in count.values()) for y in (0, 1)]
    words = {}
    for w, (n0, n1) in count.items():
        own = 0.5 + tox.PRIOR * (n0 + n1) / sum(total)
        all_own = tox.PRIOR + 0.5 * len(count)
        odds = lambda n, t: math.log((n + own) / (t + all_own - n - own))
        s = odds(n1, total[1]) - odds(n0, total[0]) - tox.DEVIATIONS * math.sqrt(1 / (n1 + own) + 1 / (n0 + own))
        if s > 0:
            words[w] = s
    shares = {w: (count[w][0] + 0.5) / total[0] for w in words}
    scale = max(1.0, 2 * sum(shares.values()))
    rate = next(x / 1e5 for x in range(1, 6_400_000) if sum(p / scale * math.exp(x / 1e5 * words[w]) for w, p in shares.items()) + (1 - sum(shares.values()) / scale) * math.exp(x / 1e5 * tox.REST) > 1)
    clean = [word.findall(t.lower()) for t, y in texts if y == 0]
    scored = [best_segments([words.get(w, tox.REST) for w in ws]) for ws in clean if set(ws) & words.keys()]
    size = max(1, sum(s >= tox.LEAST_SCORE for found in scored for _, _, s in found)) * math.exp(rate * tox.LEAST_SCORE) / sum(map(len, clean))
    return words, rate, size


def test_model_equals_plain_statistics_and_catches_passages(spark):
    docs, marks, rows, labels = tables(spark)
    out = tox.held_out(docs["doc_id"])
    model = tox.fit(docs.filter(~out), marks)
    kept = {r["doc_id"] for r in docs.filter(~out).select("doc_id").collect()}
    words, rate, size = plain_model([r for r in rows if r[0] in kept], labels)
    assert model.words.keys() == words.keys() == {"trottel", "fiend", "énormement"}
    assert all(math.isclose(model.words[w], s, rel_tol=1e-9) for w, s in words.items())
    assert math.isclose(model.rate, rate, rel_tol=1e-3) and math.isclose(model.size, size, rel_tol=0.01)

    got = tox.annotate(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        ws = re.findall(r"[^\W\d_]+", (r["text"] or "").lower())
        if len(ws) < 200:
            found = best_segments([model.words.get(w, tox.REST) for w in ws])
            logs = [math.log(model.size * len(ws)) - model.rate * s for _, _, s in found]
            assert math.isclose(r["evidence"], -sum(e for e in logs if e < 0), abs_tol=1e-6)
            assert [(p["first"], p["last"]) for p in r["passages"]] == [(a, b) for (a, b, _), e in zip(found, logs) if e < math.log(tox.SIGNIFICANT)]
        assert 0 <= r["toxicity"] <= 1 and math.isclose(r["toxicity"], 1 / (1 + math.exp(-model.bias - model.slope * r["evidence"])), rel_tol=1e-9)
        if r["doc_id"] is not None and r["doc_id"] < 600:
            assert (r["toxicity"] >= 0.5) == (r["doc_id"] % 7 == 0 and bool(r["text"])), r
    long = next(r for r in got if r["doc_id"] == 5000)
    assert [(p["first"], p["last"]) for p in long["passages"]] == [(0, 2999)] and long["toxicity"] > 0.9


def test_pieces_of_long_texts(monkeypatch):
    text = " ".join(f"wort{'x' * (i % 9)} ÄB{i}c" for i in range(300)) + "z" * 90
    whole = re.findall(r"[^\W\d_]+", text.lower())
    for piece in (1, 2, 7, 100, 10**6):
        monkeypatch.setattr(tox, "PIECE", piece)
        got = list(tox.words_of(text))
        assert "".join(got) == "".join(whole)
        if piece >= 100:
            assert got == whole
    assert list(tox.words_of("")) == []


def test_little_to_learn_from(spark):
    docs, marks, _, _ = tables(spark)
    for some in (marks.limit(0), marks.filter("toxic = 0"), marks.filter("toxic = 1"), marks.filter("toxic IS NULL")):
        model = tox.fit(docs, some)
        assert not model.words and {r["evidence"] for r in tox.annotate(docs, model).collect()} == {0.0}
    empty = tox.fit(docs.limit(0), marks)
    assert tox.annotate(docs.limit(0), empty).count() == 0
    assert plain.ordered(tox.labelled(docs, marks, 50).collect()) == plain.ordered(set(map(tuple, tox.labelled(docs, marks, 50).collect())))
