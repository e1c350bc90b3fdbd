import math

import numpy as np

from framelake.llm import forest, langid, queries, topk, urlfilter

from . import plain

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")
AWKWARD = [(None, [1.0, 2.0]), (5000, None), (5050, [NAN, 1.0]), (5100, [INF, 1.0]), (5150, [None, 1.0]), (5200, [0.0, 0.0])]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string, v string")


def some_rows(n=400, seed=0):
    rng = np.random.default_rng(seed)
    out = [(i, rng.normal(size=2).round(1).tolist()) for i in range(n)]  # many ties and copies
    return out + [(1000 + i, [0.5, 0.5]) for i in range(60)] + AWKWARD


def test_products_equal_brute_force(spark):
    rows = some_rows()
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 50 == 0:
            best = sorted((-(a[0] * b[0] + a[1] * b[1]), i) for i, b in good if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for limits in ({}, {"probe": 20, "block": 16}):
        assert plain.ordered(topk.top_products(vectors(spark, rows), **limits).collect()) == plain.ordered(want)
    assert topk.top_products(vectors(spark, []).limit(0)).count() == 0


def test_buckets_prune_and_lose_nothing():
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(3000, 8)) * rng.lognormal(3, 1, (3000, 1))).astype("i8")
    n = np.sqrt((v * v).sum(axis=1))
    v, n = v[n > 0], n[n > 0]
    order = np.argsort(-n)
    v, n = v[order], n[order]
    kept = 0
    for q in v[:40]:
        score = v @ q
        floor = np.sort(score)[-6]
        spots = topk.candidates(q, float(np.sqrt((q * q).sum())), float(floor), v, n, v / n[:, None])
        assert set(np.flatnonzero(score >= floor)) <= set(spots.tolist())
        kept += len(spots)
    assert kept < 0.8 * 40 * len(v)


def test_neighbours_with_all_leaves_equal_brute_force(spark):
    rows = some_rows()
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    want = []
    for q, a in good:
        if q % 100 == 0:
            best = sorted((math.dist(a, b), i) for i, b in good if i != q)[:10]
            want += [(q, k + 1, i) for k, (_, i) in enumerate(best)]
    for limits in ({}, {"leaf": 16, "block": 8, "share": 99.0}):
        got = forest.search(vectors(spark, rows), **limits).collect()
        assert plain.ordered(tuple(r)[:3] for r in got) == plain.ordered(want)
    assert forest.search(vectors(spark, []).limit(0)).count() == 0


def test_recall_on_vectors_without_structure(spark):
    """The test tables' vectors are spread evenly over the sphere, the hardest case."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = forest.search(vectors(spark, list(enumerate(x.tolist()))), least=1000).collect()
    hit = 0
    for q in range(0, 6000, 100):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = 9
        hit += len(set(np.argsort(d)[:10]) & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hit / 600 >= 0.9


def test_vectors_of_several_lengths(spark):
    """Only the commonest length takes part; of equally common ones the shortest."""
    odd = [(0, [1.0, 2.0, 3.0]), (50, [9.0]), (6000, [1.0, 1.0, 1.0, 1.0]), (6050, [])]
    for search, unusable in ((topk.top_products, AWKWARD[:5]), (forest.search, AWKWARD)):
        rows = [(i, v) for i, v in some_rows() if i] + unusable
        with_odd, without = (plain.ordered(search(vectors(spark, r)).collect()) for r in (rows + odd, rows))
        assert with_odd == without and with_odd
        two = [(0, [1.0, 2.0]), (100, [2.0, 1.0]), (200, [1.0, 2.0, 3.0]), (300, [3.0, 2.0, 1.0])]
        assert {r["vec_id"] for r in search(vectors(spark, two)).collect()} == {0, 100}


def plain_bundle(text, dim):
    """The sum of all sequences' vectors, one after the other."""
    out = np.zeros(dim)
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        a, b, c = f" {word}"[:-1], word, f"{word} "[1:]
        for x, y, z in zip(a, b, c):
            out += np.roll(langid.letter_vector(ord(x), dim), 2) * np.roll(langid.letter_vector(ord(y), dim), 1) * langid.letter_vector(ord(z), dim)
    return out


def test_languages_equal_brute_force(spark):
    docs = plain.docs(spark).filter("text IS NULL OR length(text) < 2000")
    rows = [(r["doc_id"], r["text"], ("aa", "bb", "cc")[len(r["text"] or "") % 3]) for r in docs.collect()]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = {(lang, t) for _, t, lang in rows if t is not None}
    want = {lang: sum(plain_bundle(t, 128) for name, t in taught if name == lang) for lang in ("aa", "bb", "cc")}
    known = langid.fit(labelled, dim=128)
    assert set(known) == set(want) and all((known[lang] == want[lang]).all() for lang in want)
    found = []
    for i, t, _ in rows:
        v = plain_bundle(t, 128)
        cosine = {lang: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for lang, p in want.items()} if v.any() else {"und": 0.0}
        best = max(sorted(cosine), key=lambda lang: round(cosine[lang], 9))
        found.append((i, best, round(max(0.0, cosine[best]), 9)))
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in langid.predict(labelled, known).collect()]
    assert plain.ordered(got) == plain.ordered(found)


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) > 0.95 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_languages_of_awkward_texts(spark):
    docs = plain.docs(spark).drop("lang").withColumnRenamed("source", "lang")
    known = langid.fit(docs)
    assert list(known) == ["s"]
    got = langid.annotate(docs, known)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    for r in got.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "s") == letters and 0 <= r["score"] <= letters
    nothing = langid.fit(docs.filter("lang IS NULL"))
    assert nothing == {} and {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), known).count() == 0
    kept = [(r["doc_id"], r["text"]) for r in langid.known_language(docs, known).collect()]
    scored = [(r["doc_id"], r["text"], r["score"]) for r in langid.annotate(docs, known).collect()]
    want = [(i, t) for i, t, s in scored if any(c.isalpha() for c in t or "") and s >= 0.2 * len(t) / (len(t) + 200)]
    assert plain.ordered(kept) == plain.ordered(want) and len(kept) > 20
    assert plain.ordered(langid.known_language(docs, nothing).collect()) == plain.ordered(docs.collect())


def test_long_texts_bundle_as_a_whole(monkeypatch):
    text = "la vie en rose, tout le monde " * 200
    whole = langid.bundles([text, "x"], 256)
    monkeypatch.setattr(langid, "PIECE", 100)
    assert (langid.bundles([text, "x"], 256) == whole).all()


def test_parts_without_characters(spark, monkeypatch):
    long = "la vie en rose " * 40_000
    letters = "x" * 600_000
    for texts in ([""], ["", long], [letters], ["", letters, ""], [long, "", letters]):
        got = langid.bundles(texts, 64)
        with monkeypatch.context() as m:
            m.setattr(langid, "PIECE", 1 << 24)
            want = [langid.bundles([t, "1"], 64)[0] for t in texts]
        assert (got == np.array(want)).all()
    known = langid.fit(plain.docs(spark))
    for alone in (None, ""):
        one = spark.createDataFrame([(1, alone)], "doc_id long, text string")
        assert [tuple(r) for r in langid.predict(one, known).select("doc_id", "lang_pred", "score").collect()] == [(1, "und", 0.0)]


URLS = [
    None, "", "no scheme", "http://a.ORG", "http://a.org/", "https://Example.org/en/1x?y#z", "http://www.example.org/es/", "http://myexample.org/es/", "http://x.com/fr/1",
    "http://x.com/FR/1", "http://com/de/2", "http://x.com?de/", "http://www.cheap-pills.com/de/1", "http://casino.net/", "http://mycasino.net/", "a://b://c.org/x", "http://é.org/é\nx", "http://free-bets.net#a",
]


def test_urls(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*URLS, *URLS[4:8]])], "page_id long, url string, host string, token string")
    rules = queries.URL_RULES + urlfilter.SPAM_HOSTS
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, rules).collect()}
    assert len(got) == len(URLS) + 4
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.org", "", None, "allow") and got[4] == ("a.org", "/", "org/", "allow")
    assert got[5] == ("example.org", "/en/1x", "example.org/en/1", "block") and got[6][2:] == ("example.org/es/", "block") and got[7][2:] == ("org/", "allow")
    assert got[8][2:] == ("com/fr/", "allow") and got[9][2:] == (None, "allow") and got[10][2:] == ("com/de/", "block") and got[11][:2] == ("x.com", "")
    assert got[12][2:] == ("com/de/", "block") and got[13][2:] == (None, "block") and got[14][2:] == (None, "allow") and got[15][:2] == ("b:", "//c.org/x")
    assert got[16] == ("é.org", "/é\nx", "org/", "allow") and got[17] == ("free-bets.net", "", None, "block")
    monkeypatch.setattr(urlfilter, "INLINE", 0)  # as with rules too many to inline
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, rules).collect()} == got
    assert urlfilter.judge(pages, ()).filter("verdict <> 'allow' OR rule IS NOT NULL").count() == 0
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
