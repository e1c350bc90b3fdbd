import uuid

import numpy as np
import pytest

from framelake.llm import anchors, components, ngramjoin, rlz, spans, suffix

from . import plain


@pytest.mark.parametrize("most", [None, 1])
def test_byte_repeats(spark, monkeypatch, most):
    """``most`` = 1: every anchor takes the way for anchors that no task could hold."""
    if most:
        find = spans.find
        monkeypatch.setattr(spans, "find", lambda *a, **k: find(*a, **{**k, "most": most}))
    docs = plain.docs(spark)
    want = plain.byte_repeats(plain.rows_of(docs))
    assert plain.ordered(suffix.digests(docs).collect()) == plain.ordered(w[:5] for w in want)
    assert sum(w[2] for w in want) > 0


def test_byte_repeats_keep_the_other_columns(spark):
    docs = plain.docs(spark)
    got = suffix.remove_repeats(docs)
    assert got.columns == [*docs.columns, "n_removed", "n_spans"]
    want = plain.byte_repeats(plain.rows_of(docs))
    left = [(i, None if t is None else kept.decode("utf-8", "ignore"), n) for (i, t), (_, _, n, _, _, kept) in zip(plain.rows_of(docs), want)]
    assert plain.ordered(got.select("doc_id", "text", "n_removed").collect()) == plain.ordered(left)
    assert suffix.digests(docs.limit(0)).count() == 0 == suffix.remove_repeats(docs.limit(0)).count()


def test_suffix_buckets_of_any_size_agree(monkeypatch):
    pieces = [t.encode()[:400] for t in plain.texts() if t and len(t.encode()) > 250]
    many = [len(p) - 199 for p in pieces]
    whole = suffix.repeated(pieces, many, 200)
    seen = [p[i : i + 200] for p, n in zip(pieces, many) for i in range(n)]
    assert whole.tolist() == [seen.count(s) > 1 for s in seen] and whole.any() and not whole.all()
    monkeypatch.setattr(suffix, "BUCKET", 50)
    assert (suffix.repeated(pieces, many, 200) == whole).all()


def test_cover_reaches_every_difference():
    for a in range(suffix.V):
        for b in range(suffix.V):
            d = suffix.DISTANCE[a, b]
            assert suffix.COVER[(a + d) % suffix.V] and suffix.COVER[(b + d) % suffix.V]


def test_units_hold_every_window_once():
    for text in plain.texts():
        data = (text or "").encode()
        if len(data) >= 200:
            seen = np.zeros(len(data) - 199, "i8")
            for at, n, _, _ in anchors.units(anchors.byte_symbols(data), 200, 64):
                for a, m in zip(at, n):
                    seen[a : a + m] += 1
            assert (seen == 1).all()


@pytest.mark.parametrize("most", [None, 1])
def test_word_repeats(spark, monkeypatch, most):
    if most:
        find = spans.find
        monkeypatch.setattr(spans, "find", lambda *a, **k: find(*a, **{**k, "most": most}))
    docs = plain.docs(spark)
    want = plain.word_repeats(plain.rows_of(docs))
    assert plain.ordered(rlz.digests(docs).collect()) == plain.ordered(want)
    kept = rlz.remove_repeats(docs)
    assert all(plain.sha(r["kept"].encode()) == r["kept_sha256"] for r in kept.collect())
    assert rlz.digests(docs.limit(0)).count() == 0 and sum(w[2] for w in want) > 0


@pytest.mark.parametrize("find", [suffix.digests, rlz.digests])
def test_copies_under_one_id_are_gathered_once(spark, monkeypatch, tmp_path, find):
    """Neither the spans of a text nor the symbols sent grow with the rows that have its id and text."""
    say, inner = lambda a, b: " ".join(f"word{i}" for i in range(a, b)), spans.find

    def noted(rows, units_of, piece_of, compare, names_of, finish, *a, **k):
        def note(kind, f, size):
            def run(batches):
                batches = list(batches)
                with open(tmp_path / f"{kind}-{uuid.uuid4().hex}", "w") as out:
                    out.writelines(f"{x}\n" for b in batches for x in size(b))
                yield from f(iter(batches))

            return run

        compare = note("piece", compare, lambda b: zip(*(c.to_pylist() for c in b.columns[:3])))
        return inner(rows, units_of, piece_of, compare, names_of, note("spans", finish, lambda b: (len(x or ()) for x in b.column(2).to_pylist())), *a, **k)

    monkeypatch.setattr(spans, "find", noted)
    texts = [(1, say(0, 300)), (2, say(100, 250) + " " + say(1000, 1100)), *[(None, say(50, 350))] * 30, *[(7, say(60, 280))] * 30]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    rows = plain.rows_of(docs)
    want = [w[:5] for w in plain.byte_repeats(rows)] if find is suffix.digests else plain.word_repeats(rows)
    assert plain.ordered(find(docs).collect()) == plain.ordered(want)
    told = lambda kind: [x for f in tmp_path.glob(f"{kind}-*") for x in f.read_text().splitlines()]
    pieces, most = told("piece"), max(map(int, told("spans")))
    assert pieces and len(pieces) == len(set(pieces)) and 0 < most < 150


def test_null_ids_meet_their_own_text_only(spark, monkeypatch):
    rows = [(None, " ".join(f"{w}{i}" for i in range(40))) for w in range(20)] + [(None, " ".join(f"{w}{i}" for i in [*range(39), 99])) for w in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    met, verify = spark.sparkContext.accumulator(0), ngramjoin._verify

    def verified(batches, words, percent):
        for b in batches:
            met.add(b.num_rows)
            yield from verify(iter([b]), words, percent)

    monkeypatch.setattr(ngramjoin, "_verify", verified)
    assert ngramjoin.join(docs).count() == 40
    assert 0 < met.value <= 80


def test_parse_checks_windows_over_factor_boundaries():
    # Two stretches overlap by fewer words than a window: the window over the boundary is in neither.
    assert rlz.parse(np.array([0, 30]), np.array([60, 100]), 0, 51, 50) == [(0, 11), (30, 21)]
    assert rlz.parse(np.array([0, 5]), np.array([60, 100]), 0, 51, 50) == [(0, 11), (11, 40)]
    assert rlz.parse(np.zeros(0, "i8"), np.zeros(0, "i8"), 0, 51, 50) == []


def test_jaccard_classes(spark):
    docs = plain.docs(spark)
    rows = plain.rows_of(docs)
    for words, percent, limits in ((4, 85, {}), (5, 80, {}), (4, 85, {"block_docs": 3})):
        got = ngramjoin.join(docs, words, percent, **limits).collect()
        want = plain.jaccard(rows, words, percent)
        assert plain.ordered((i, n) for i, n, _ in got) == plain.ordered((i, n) for i, n, _ in want)
        # Rows that share an id are told apart by their number of shingles only.
        assert {(i, n, c) for i, n, c in map(tuple, got) if n} == {(i, n, c) for i, n, c in want if n}
    assert ngramjoin.join(docs.limit(0)).count() == 0


def test_similar_sets_share_a_key_whatever_is_frequent():
    """With no token, some or all of them in the frequent class; and both sides share as much of their prefixes as they need to stay."""
    rng = np.random.default_rng(8)
    for n in [*range(1, 40), 250, 256, 299, 301, 340]:
        for _ in range(6):
            x = np.unique(rng.integers(0, 1 << 62, n, dtype="u8"))
            y = np.unique(np.concatenate([rng.permutation(x)[: len(x) - rng.integers(0, len(x) // 6 + 1)], rng.integers(0, 1 << 62, rng.integers(0, n // 9 + 1), dtype="u8")]))
            both = len(np.intersect1d(x, y))
            if not 100 * both >= 85 * (len(x) + len(y) - both) or np.array_equal(x, y):
                continue
            every = np.union1d(x, y)
            for hot in (every[:0], every, every[rng.random(len(every)) < 0.5], every[rng.random(len(every)) < 0.9]):
                (r1, o1, f1), (r2, o2, f2) = (ngramjoin.prefix(s, hot, 85) for s in (x, y))
                assert len(np.intersect1d(r1, r2)) + len(np.intersect1d(o1, o2))
                for s, f in ((x, f1), (y, f2)):
                    assert len(np.intersect1d(r1, r2)) + f >= ngramjoin.least_shared(-(-85 * len(s) // 100), 85)


def test_similar_sets_share_parts():
    """As many as both of them need to stay, whatever their sizes; sets that differ more share next to none."""
    rng = np.random.default_rng(9)
    draw = lambda n: rng.integers(0, 1 << 62, n, dtype="u8")
    pairs = 0
    for percent in (50, 80, 85, 99):
        for n in [*range(1, 60), 200, 1000, 4000]:
            for _ in range(4):
                x = np.unique(draw(n))
                y = np.unique(np.concatenate([rng.permutation(x)[: n - rng.integers(0, n * (100 - percent) // 100 + 1)], draw(rng.integers(0, n * (100 - percent) // 100 + 1))]))
                both = len(np.intersect1d(x, y))
                if not 100 * both >= percent * (len(x) + len(y) - both) or np.array_equal(x, y):
                    continue
                found = [ngramjoin.parts(s, percent, 7) for s in (x, y)]
                for own, other in (found, found[::-1]):
                    names = np.concatenate([k for k, _ in other])
                    assert any(len(np.intersect1d(k, names)) >= least for k, least in own)
                pairs += 1
    assert pairs > 400
    x, often = draw(2000), draw(500)
    (k, least), *_ = ngramjoin.parts(np.unique(np.concatenate([x[:1500], often])), 85)
    other = np.concatenate([k for k, _ in ngramjoin.parts(np.unique(np.concatenate([x[1500:], often, draw(1000)])), 85)])
    assert len(np.intersect1d(k, other)) < least / 4


def test_linked_like_a_search_over_all_pairs():
    rng = np.random.default_rng(10)
    for _ in range(30):
        pool = rng.integers(0, 1 << 62, rng.integers(5, 60), dtype="u8")
        sets = [np.unique(rng.choice(pool, rng.integers(1, len(pool) + 1))) for _ in range(rng.integers(1, 40))]
        sets += [np.unique(np.concatenate([s[1:], rng.integers(0, 1 << 62, 1, dtype="u8")])) for s in sets[:10]]
        for percent in (50, 85):
            both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
            size = np.diag(both)
            near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            want = np.arange(len(sets))
            while (new := np.where(near, want, len(sets)).min(axis=1)).tolist() != want.tolist():
                want = new
            assert ngramjoin.linked(sets, percent).tolist() == want.tolist()


def test_texts_that_chance_links_are_not_verified(spark, monkeypatch):
    """Each text has half of the next one's sequences, so all have a canopy in common; only the near copies in it meet."""
    say = lambda i: " ".join(f"a{i}x{j}" for j in range(60)) + " " + " ".join(f"a{i + 1}x{j}" for j in range(60))
    rows = [(i, say(i)) for i in range(100)] + [(200 + i, say(i) + " end") for i in (3, 50)] + [(300, "start " + say(50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    met, verify = spark.sparkContext.accumulator(0), ngramjoin._verify

    def verified(batches, words, percent):
        for b in batches:
            met.add(b.num_rows)
            yield from verify(iter([b]), words, percent)

    monkeypatch.setattr(ngramjoin, "_verify", verified)
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.join(docs).collect()}
    assert got == {i: i for i in range(100)} | {203: 3, 250: 50, 300: 50}
    assert 5 <= met.value <= 20
    met.value = 0
    assert sorted(r["doc_id"] for r in ngramjoin.one_of_each(docs, 5, 80).collect()) == list(range(100))
    assert 5 <= met.value <= 20


def test_live_rows_over_batch_borders():
    rows = [(1, 3, 7, -1), (1, 3, 7, -1), (1, 3, 8, -1), (2, 3, 7, -1), (3, 3, 5, -1), (3, 3, 6, -1), (3, 3, 9, -1), (4, 3, 1, 0), (5, 3, 1, -2), (6, 3, 2, -1), (6, 3, 2, -1)]
    want = sorted(set(rows) - {(2, 3, 7, -1), (5, 3, 1, -2), (6, 3, 2, -1)})
    for size in range(1, 12):
        batches = [ngramjoin.batch_of(ngramjoin.KEYS, *zip(*rows[i : i + size])) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in ngramjoin._live(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == want


def test_one_of_each(spark):
    docs = plain.docs(spark)
    rows = plain.rows_of(docs)
    _, group = plain.classes(rows, 5, 80)
    best = {}
    for (i, t), g in zip(rows, group):
        best[g] = min(best.get(g, (1 << 62,)), (-(2**63) if i is None else i,))
    got = ngramjoin.one_of_each(docs, 5, 80)
    assert got.columns == docs.columns
    kept = [(-(2**63) if r["doc_id"] is None else r["doc_id"],) for r in got.collect()]
    wordless = [(-(2**63) if i is None else i,) for i, t in rows if not plain.shingles(t, 5)]
    texted = [b for g, b in best.items() if plain.shingles(rows[g][1], 5)]
    assert sorted(kept) == sorted(texted + wordless)
    assert ngramjoin.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_of_texts_with_one_set_under_one_id(spark):
    base = "one two three four five six seven"
    rows = [(i, t) for i in (None, 4) for t in (base, base.upper(), base.replace(" ", "  "))] + [(5, "another text"), (5, "Another Text"), (5, "another text"), (5, " "), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], (r["text"] or "").lower().split()) for r in ngramjoin.one_of_each(docs, 5, 80).collect()]
    assert plain.ordered(kept) == plain.ordered([(None, base.lower().split()), (5, ["another", "text"]), (5, []), (5, [])])


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def thue_morse(n, letters="ab"):
    """A text and its complement, which polynomial hashes modulo a power of two do not tell apart from a length of 1,024 on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def test_texts_that_rolling_hashes_take_for_equal(spark):
    one, two = thue_morse(2048)
    common = [f"word{i}" for i in range(49)]
    rows = [(1, one), (2, two), (3, " ".join([*common, one])), (4, " ".join([*common, two]))]
    rows += [(5, " ".join(thue_morse(300)[0])), (6, " ".join(reversed(thue_morse(300)[1])) + " x"), (7, "c" * 150 + one[:300]), (8, "c" * 150 + two[:300])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain.word_repeats(rows)
    assert plain.ordered(rlz.digests(docs).collect()) == plain.ordered(want) and want[3][2] == 0
    assert plain.ordered(suffix.digests(docs).collect()) == plain.ordered(w[:5] for w in plain.byte_repeats(rows))
    counts, group = plain.classes(rows, 4, 85)
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.join(docs, 4, 85).collect()}
    assert got[1] == 1 and got[2] == 2 and len({got[i] for i, _ in rows}) == len(set(group))
    assert sorted(r["doc_id"] for r in ngramjoin.one_of_each(docs, 5, 80).select("doc_id").collect())[:2] == [1, 2]


def test_word_hashes_tell_words_apart():
    words = sorted({w.encode() for n in range(1, 40) for w in (*thue_morse(n), "x" * n, "\0" * n, "x" * n + "\0", "é" * n)})
    for text in (b" ".join(words), b"\t".join(reversed(words))):
        got = ngramjoin.word_hashes(text, lower=False)
        assert len(set(got.tolist())) == len(words) and dict(zip(text.split(), got.tolist())) == dict(zip(words, [int(ngramjoin.word_hashes(w, lower=False)[0]) for w in words]))
