"""Jaccard join of documents on word n-grams, by token-combination prefixes.

A document's tokens are the hashes of its distinct n-grams. Tokens are ordered: rare ones first, by hash, then those of the
frequent class, by hash. Two documents that are similar enough lack few of each other's tokens, so they share some within
prefixes of that order. The prefix is extended until that is two tokens or more, and half as many as may be lacking. In the
rare class a shared token is a key by itself; in the frequent class only a combination of two is, so that similar documents
that share no rare token still share a key. Documents of many tokens, whose combinations would be too many, keep single tokens
in both classes; around the limit they have both kinds of key, wide enough that any similar pair has one kind in common.

The extension also tells who has no partner: a document of whose prefix too few tokens stand in any other prefix goes.

Documents that share a key stand in one canopy. Neighbours by size within a key are linked, never all pairs: a canopy is
a connected component of these links, and two documents of different canopies cannot be similar. One token by chance is
enough for a link, so canopies grow together as a corpus grows. They are therefore parted again, by keys that chance does not
share: a set's tokens are dealt to somewhat more parts, by hash, than two similar sets differ in tokens, so they
have some parts in common as a whole. A document without enough such parts goes; neighbours by size within a part are linked.

Within a canopy all overlaps are counted exactly. Canopies too large for a task are cut into blocks, and every two blocks meet in
a task.

Documents with the same token set are one entry throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import PIECE, _mix, strong
from .common import LOWER, UPPER, batch_of, by_rows, forget, stored
from .components import components

LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
ODD = np.uint64(0x9E3779B97F4A7C15)
NO_ID = -(2**63)
COMBINED = 300  # sets of up to so many tokens have combinations as keys, those of more than ``percent`` of that single tokens
TOLD = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("token", pa.int64())])
KEYS = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("sid", pa.int64()), ("kind", pa.int32())])
RARE, OTHER = -1, -2  # kinds of key; a set's row of its own has the number of frequent tokens in its prefix instead
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
DEALS = 4  # times a set is dealt to parts at most, until few of them are empty


LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], "u8")  # masks of the first bytes of eight


def _hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words part[start:end]: up to 16 bytes by mixing them eight at a time, longer ones by BLAKE2b."""
    data = part.tobytes() + bytes(16)
    eight = np.ndarray((len(part) + 9,), "<u8", data, strides=(1,))
    size = ends - starts
    low = eight[starts] & LOW_BYTES[np.minimum(size, 8)]
    high = eight[np.minimum(starts + 8, len(part))] & LOW_BYTES[np.clip(size - 8, 0, 8)]
    out = _mix((_mix(low + size.astype("u8") * ODD) ^ high) * ODD + np.uint64(1))
    for i in np.flatnonzero(size > 16).tolist():
        out[i] = strong(data[starts[i] : ends[i]])
    return out


def word_hashes(data: bytes, lower: bool = True) -> np.ndarray:
    """Hashes of the words of a text in UTF-8, A-Z lower-cased if wanted; blanks and the signs 0x09 to 0x0D part the words."""
    data, out, at = data.translate(LOWERED) if lower else data, [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        part = np.frombuffer(data, "u1", end - at, at)
        gap = SPACE[part]
        if end < len(data):  # end the piece at white space; a word longer than a piece makes a longer piece
            spaces = np.flatnonzero(gap)
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:
                rest = np.flatnonzero(SPACE[np.frombuffer(data, "u1", offset=end)])
                end = end + int(rest[0]) if len(rest) else len(data)
            part = np.frombuffer(data, "u1", end - at, at)
            gap = SPACE[part]
        edge = np.diff(np.concatenate([[True], gap, [True]]).view("i1"))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        out.append(_hashes(part, starts, ends))
        at = end
    return np.concatenate(out) if out else np.zeros(0, "u8")


def tokens(text: str | None, words: int = 4) -> np.ndarray:
    """Hashes of the distinct ``words``-grams in ascending order; of the whole text if it has fewer words; none if none."""
    w = word_hashes((text or "").encode("utf-8", "replace"))
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, "u8")
    for i in range(n):
        h = _mix((h + w[i : len(w) - n + 1 + i]) * ODD)
    return np.unique(h)


def set_id(t: np.ndarray) -> int:
    """One number for a set of tokens."""
    return int(_mix(_mix(t).sum(keepdims=True, dtype="u8") ^ _mix(t * ODD + np.uint64(1)).sum(keepdims=True, dtype="u8") * ODD).view("i8")[0]) if len(t) else 0


def lacking(n, percent: int):
    """Tokens of a set of n that a similar one may lack at most."""
    return n - -(-percent * n // 100)


def least_shared(n, percent: int):
    """How many tokens of its prefix a set of n shares with the prefix of a similar one, if its own ends first; two or more from n = 2."""
    return np.minimum(n - lacking(n, percent), lacking(n, percent) // 2 + 2)


def prefix(t: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The prefix of a set of tokens: its rare tokens, the keys of its frequent ones, and how many frequent ones there are.

    ``t`` and ``hot``, the tokens of the frequent class, are in ascending order.
    """
    n = len(t)
    size = lacking(n, percent) + int(least_shared(n, percent))
    is_hot = hot[np.minimum(np.searchsorted(hot, t), len(hot) - 1)] == t if len(hot) else np.zeros(n, bool)
    rare = t[~is_hot][:size]
    often = t[is_hot][: size - len(rare)]
    keys = [often] if n > percent * COMBINED // 100 else []
    if n <= COMBINED:
        i, j = np.triu_indices(len(often), 1)
        keys.append(_mix(often[i] * ODD + often[j]))
    return rare, np.unique(np.concatenate(keys)), len(often)


def unlike(n, percent: int):
    """Tokens that a set of n and a similar one that is no smaller differ in at most, both sides counted."""
    return (100 - percent) * n // percent


def _tops(n: int, percent: int) -> list[int]:
    """Size classes in which a set of n may have a similar one, by their largest size; a pair's class is that of the smaller set."""
    low = top = 1
    while top < n:
        before, low = top, top + 1
        top = 100 * low // percent
    return [x for x in ([before] if low > 1 else []) + [top] if 100 * x >= percent * n]


def parts(t: np.ndarray, percent: int, salt: int = 0) -> list[tuple[np.ndarray, int]]:
    """Names of the parts of a set of tokens, deal by deal, and how many of them a set shares with each similar, other one at least.

    Of either set of a pair, the number of one deal that both made holds. In a class whose sets differ in d tokens at most there
    are d and some spare parts, so at least the spare ones are equal. Empty parts have no name: a set with as many of them as
    there are spare ones is dealt anew, and in the end has one name with all such sets of its class.
    """
    out = []
    for top in _tops(len(t), percent) if percent < 100 else []:
        differ = unlike(top, percent)
        if not differ:
            continue  # only equal sets are similar
        spare = max(2, -(-differ // 4))
        for deal in range(DEALS):
            h = _mix(t * ODD + np.uint64(deal))
            part = (h >> np.uint64(32)) * np.uint64(differ + spare) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            part = part[order]
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            place = part[at] + np.uint64((top * DEALS + deal) << 32)
            names = _mix(_mix(np.add.reduceat(h[order], at) ^ np.uint64(salt)) + place * ODD)
            empty = differ + spare - len(at)
            out.append((names, max(1, spare - empty)))
            if empty < spare:
                break
        else:
            out.append((_mix(np.array([top ^ salt], "u8") * ODD), 1))
    return out


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key another set has too, and sets' rows of their own, once each; the rows come sorted by key and set."""
    last = None  # the last row so far, and whether it was given out
    for batch in batches:
        cols, given = [c.to_numpy() for c in batch.columns], False
        if last is not None:
            cols, given = [np.concatenate([h, c]) for h, c in zip(last[0], cols)], last[1]
        key, _, sid, kind = cols
        if not len(key):
            continue
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])])
        cols = [c[fresh] for c in cols]
        key, _, sid, kind = cols
        same = key[1:] == key[:-1]
        good = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (kind >= 0)
        last = [c[-1:] for c in cols], bool(good[-1]) or (given and len(key) == 1)
        good[0] &= not given
        yield batch_of(KEYS, *[c[good] for c in cols])


def _edges(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of neighbours by size within a key; the rows come sorted by key and size."""
    carry = None
    for batch in batches:
        key, n, sid = (c.to_numpy() for c in batch.columns[:3])
        if carry is not None:
            key, n, sid = (np.concatenate([[c], x]) for c, x in zip(carry, (key, n, sid)))
        if len(key):
            near = (key[1:] == key[:-1]) & (100 * n[:-1].astype("i8") >= percent * n[1:].astype("i8")) & (sid[1:] != sid[:-1])
            pairs = np.unique(np.stack([sid[1:][near], sid[:-1][near]], axis=1), axis=0)
            yield batch_of(EDGES, pairs[:, 0], pairs[:, 1])
            carry = key[-1], n[-1], sid[-1]


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first one it hangs together with by links; overlaps are exact."""
    m, size = len(sets), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m, dtype="i4"), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
    shared = ~fresh | np.concatenate([~fresh[1:], [False]])  # in two sets or more
    column, owner = np.cumsum(fresh[shared], dtype="i4") - 1, owner[shared]
    del flat, order, fresh, shared
    many = int(column[-1]) + 1 if len(column) else 0
    own = column[np.argsort(owner, kind="stable")]  # the columns of the first set, of the second, and so on
    own_at = np.searchsorted(np.sort(owner), np.arange(m + 1))
    weight = np.bincount(owner, np.bincount(column, minlength=many)[column], m)
    label, left = np.full(m, -1), m
    at = np.searchsorted(column, np.arange(many + 1))
    for i in range(m):
        if label[i] >= 0:
            continue
        label[i], front = i, [i]
        while front:
            some = min(512, max(1, int(np.searchsorted(np.cumsum(weight[front]), 1 << 20))))
            now, front = np.array(front[:some]), front[some:]
            if 2 * (free := int((label < 0).sum())) < left:  # rows of sets that have a label are of no use any more
                keep, left = label[owner] < 0, free
                column, owner = column[keep], owner[keep]
                at = np.searchsorted(column, np.arange(many + 1))
            mine = np.concatenate([own[own_at[x] : own_at[x + 1]] for x in now])
            who = np.repeat(np.arange(len(now)), own_at[now + 1] - own_at[now])
            times = at[mine + 1] - at[mine]
            place = np.repeat(at[mine] - np.cumsum(times) + times, times) + np.arange(times.sum())
            both = np.bincount(np.repeat(who, times) * m + owner[place], minlength=len(now) * m).reshape(len(now), m)
            near = 100 * both >= percent * (size[now][:, None] + size[None, :] - both)
            new = np.flatnonzero(near.any(axis=0) & (label < 0))
            label[new] = i
            front += new.tolist()
    return label


def _verify(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links within canopies; the rows (canopy, pair of blocks, sid, text) come sorted by the first two."""
    forget()
    group, sets = None, {}

    def links():
        if len(sets) > 1:
            ids, label = np.array(list(sets), "i8"), linked(list(sets.values()), percent)
            some = np.flatnonzero(label != np.arange(len(ids)))
            yield batch_of(EDGES, ids[some], ids[label[some]])

    for batch in by_rows(batches):
        for canopy, pair, sid, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (canopy, pair) != group:
                yield from links()
                group, sets = (canopy, pair), {}
            t = tokens(text, words)
            if set_id(t) == sid:  # else another text with the same id and hash
                sets[sid] = t
    yield from links()


def _shared(keys: DataFrame) -> DataFrame:
    return stored(keys.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(_live, "key long, n int, sid long, kind int"), "live")


def _canopies(live: DataFrame, some: DataFrame, percent: int) -> DataFrame:
    """``sid, canopy`` of the rows of ``live`` that go on (``some``) and have a neighbour under their key."""
    # These lists grow with the corpus, so they are merged at every size rather than sent to all tasks while they are small.
    close = live.filter("kind < 0").join(stored(some, "some").hint("merge"), some.columns).select("key", "n", "sid")
    near = close.repartition("key").sortWithinPartitions("key", "n", "sid").mapInArrow(lambda b: _edges(b, percent), "a long, b long")
    return components(near).select(F.col("node").alias("sid"), F.col("root").alias("canopy"))


def _finer(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``sid, canopy`` of the sets of ``texts`` (``canopy, sid, text``), parted within their canopies; those that have no similar one may be missing."""

    def named(batches):
        forget()
        for batch in by_rows(batches):
            rows = []
            for canopy, sid, text in zip(*(c.to_pylist() for c in batch.columns)):
                t = tokens(text, words)
                if set_id(t) == sid:
                    rows += [(names, len(t), sid, -least) for names, least in parts(t, percent, canopy & (1 << 64) - 1)]
            if rows:
                names, n, sid, kind = zip(*rows)
                many = [len(x) for x in names]
                yield batch_of(KEYS, np.concatenate(names).view("i8"), np.repeat(np.array(n, "i4"), many), np.repeat(np.array(sid, "i8"), many), np.repeat(np.array(kind, "i4"), many))

    live = _shared(texts.mapInArrow(named, "key long, n int, sid long, kind int"))
    return _canopies(live, live.groupBy("sid", "kind").agg(F.count("*").alias("times")).filter("times >= -kind").select("sid", "kind"), percent)


def classes(docs: DataFrame, words: int = 4, percent: int = 85, often: float = 0.001, block_docs: int = 1024, block_tokens: int = 1 << 21) -> tuple[DataFrame, DataFrame]:
    """What ``join`` and ``one_of_each`` build on: ``doc, h, n, sid`` of every row (``h``: a hash of the text), and ``sid, n,
    component_id, doc, first, text`` of every token set that has a partner, where ``doc, first, text`` are the id, the set and the text's
    hash of its class's first.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("doc"), F.col("text").cast("string").alias("text"))
    hashed = rows.select("doc", F.xxhash64("text").alias("h"), "text")
    total = rows.count()
    least = max(64.0, often * total)

    def described(batches):
        forget()
        for batch in by_rows(batches, 4096):
            sets = [tokens(t, words) for t in batch.column(2).to_pylist()]
            yield batch_of(TOLD, batch.column(0), batch.column(1), [len(s) for s in sets], [set_id(s) for s in sets], pa.nulls(len(sets), pa.int64()))
            # A token of the frequent class has its share of the rows in some slice.
            found, times = np.unique(np.concatenate([np.zeros(0, "u8"), *sets]), return_counts=True)
            some = times * total >= least * batch.num_rows
            none = pa.nulls(int(some.sum()), pa.int64())
            yield batch_of(TOLD, none, none, times[some], none, found[some].view("i8"))

    told = stored(hashed.mapInArrow(described, "doc long, h long, n long, sid long, token long"), "sets")
    often_found = told.filter("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("times")).filter(F.col("times") >= least / 2)
    hot = np.sort(np.array([r["token"] for r in often_found.select("token").collect()], "i8").view("u8"))
    told = told.filter("token IS NULL").select("doc", "h", "n", "sid")

    def keyed(batches):
        forget()
        for batch in by_rows(batches, 1024):
            parts: dict[int, tuple] = {}
            for t in batch.column(1).to_pylist():
                s = tokens(t, words)
                if len(s) and (sid := set_id(s)) not in parts:
                    parts[sid] = len(s), *prefix(s, hot, percent)
            if parts:
                keys, kinds, many = [], [], []
                for sid, (_, rare, other, often) in parts.items():
                    keys += [rare, other, np.array([sid]).view("u8")]
                    kinds += [np.full(len(rare), RARE), np.full(len(other), OTHER), np.array([often])]
                    many.append(len(rare) + len(other) + 1)
                yield batch_of(
                    KEYS, np.concatenate(keys).view("i8"), np.repeat(np.array([p[0] for p in parts.values()], "i4"), many),
                    np.repeat(np.array(list(parts), "i8"), many), np.concatenate(kinds).astype("i4"),
                )

    keys = rows.mapInArrow(keyed, "key long, n int, sid long, kind int")
    live = _shared(keys)
    # A set that has a similar one shares enough of its prefix; most sets do not, and go.
    shared = F.count_if(F.col("kind") == RARE) + F.max(F.when(F.col("kind") >= 0, F.col("kind")))
    partner = F.ceil(F.lit(percent) * F.col("n") / 100)
    lack = F.floor((100 - percent) * partner / 100)
    need = F.least(partner - lack, F.floor(lack / 2) + 2)
    some = live.groupBy("sid", "n").agg(shared.alias("shared")).filter(F.col("shared") >= need).select("sid", "n")
    canopies = _canopies(live, some, percent)

    # One document of each token set stands for it. The sets of a canopy get finer ones before they meet.
    first = stored(told.filter("n > 0").groupBy("sid", "n").agg(F.min(F.struct("doc", "h")).alias("own"), F.min(F.when(F.col("doc") > NO_ID, F.col("doc"))).alias("doc_id"), F.count("*").alias("copies")).select("sid", "n", "own.*", "doc_id", "copies"), "first")
    member = stored(canopies.join(first, "sid"), "members")
    texts = stored(hashed.join(member.select("doc", "h", "sid", "canopy").hint("merge"), ["doc", "h"]).select("canopy", "sid", "text"), "texts")
    finer = stored(_finer(texts, words, percent).join(member.select("sid", "n"), "sid"), "finer")
    blocks = finer.groupBy("canopy").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_tokens)).alias("blocks"))
    own = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = finer.join(blocks, "canopy").withColumn("_own", own).withColumn("_other", other)
    dealt = dealt.select("sid", "canopy", (F.least("_own", "_other") * F.col("blocks") + F.greatest("_own", "_other")).alias("pair"))
    met = texts.select("sid", "text").join(dealt.hint("merge"), "sid").select("canopy", "pair", "sid", "text").repartition("canopy", "pair").sortWithinPartitions("canopy", "pair")
    links = components(met.mapInArrow(lambda b: _verify(b, words, percent), "a long, b long"))

    found = first.join(links.select(F.col("node").alias("sid"), "root"), "sid", "left").filter("copies > 1 OR root IS NOT NULL")
    found = found.withColumn("root", F.coalesce("root", "sid"))
    heads = found.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct("doc", "sid", "h")).alias("head"))
    return told, stored(found.select("sid", "n", "root").join(heads, "root").select("sid", "n", "component_id", "head.doc", F.col("head.sid").alias("first"), F.col("head.h").alias("text")), "classes")


def join(docs: DataFrame, words: int = 4, percent: int = 85, **limits) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (``doc_id, text``).

    Documents link when 100 * intersection >= ``percent`` * union of their token sets. ``component_id``: the smallest id that
    links lead to, the own one included. A null or wordless text has no token and no link. Rows with one id are documents of
    their own; null ids take part but name a component only where there is no other. ``often``: a token of about this share of the
    documents (and of 64) is of the frequent class. The class holds at most twice the mean number of tokens over ``often``,
    whatever the corpus, and goes to every task. ``block_docs``, ``block_tokens``: about the most a task verifies at once.
    """
    told, found = classes(docs, words, percent, **limits)
    doc_id = F.when(F.col("doc") > NO_ID, F.col("doc"))
    return told.join(found.select("sid", "n", "component_id"), ["sid", "n"], "left").select(
        doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", doc_id).alias("component_id")
    )


def one_of_each(docs: DataFrame, words: int = 4, percent: int = 85, **limits) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each class that links make, the row with the smallest id stays.

    Rows without an id count as smallest. Of rows with that id one text stays, and of equal rows one; rows without a word all stay. Same parameters as ``join``.
    """
    told, found = classes(docs, words, percent, **limits)
    kept = told.join(found.withColumnRenamed("doc", "head"), ["sid", "n"], "left")
    kept = kept.filter("head IS NULL OR (doc = head AND sid = first AND h = text)").groupBy("doc", "h").agg(F.max("n").alias("n"))
    own = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_h", F.xxhash64(F.col("text").cast("string")))
    met = own.join(kept.select(F.col("doc").alias("_doc"), F.col("h").alias("_h"), F.col("n").alias("_n")), ["_doc", "_h"])
    again = F.row_number().over(Window.partitionBy("_doc", "_h").orderBy("_doc"))
    return met.withColumn("_again", again).filter("_again = 1 OR _n = 0").select(*docs.columns)
