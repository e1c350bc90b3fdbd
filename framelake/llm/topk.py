"""Exact search for the largest inner products, over buckets of vectors of like length.

Vectors are grouped by length. A first look at the longest vectors gives every query a score that its k-th best cannot
fall below. In a bucket whose longest vector has length b, a product above that score needs a cosine of at least
score / (|query| * b). If this local threshold is over 1, the query never visits the bucket. Else the bucket prunes by
length (only vectors long enough) or, where the threshold is high, by coordinates (each large coordinate of the query
bounds that of a fitting vector's direction). The products of what is left are verified.

Buckets and queries are dealt in blocks of bounded size; a query set is searched against all rows block by block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import best, matrix, usable

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
DDL = "query_id long, vec_id long, score long"
FOCUS = 3  # coordinates looked at


def grid(table: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, v`` (whole numbers floor(scale * x)), ``len`` of usable rows."""
    rows = usable(table, zero=True).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    return rows.withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact whole-number products; in doubles where no sum can leave their exact range."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), "i8")
    if float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < 2**52:
        return (q.astype("f8") @ v.astype("f8").T).astype("i8")
    return q @ v.T


def candidates(q: np.ndarray, q_len: float, floor: float, v: np.ndarray, v_len: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Places in the bucket (longest first) whose product with the query may reach ``floor``."""
    if floor <= 0 or q_len == 0:
        return np.arange(len(v))
    slack = 1 - 1e-9
    enough = int(np.searchsorted(-v_len, -(floor / q_len) * slack, "right"))  # length pruning
    near = floor / (q_len * v_len[0]) * slack if v_len[0] else 2.0
    if near > 1 or not enough:
        return np.arange(0)
    if near < 0.5:
        return np.arange(enough)
    keep = np.ones(enough, bool)  # coordinate pruning
    for f in np.argsort(-np.abs(q))[:FOCUS]:
        c = q[f] / q_len
        wide = math.sqrt(max(0.0, (1 - near * near) * (1 - c * c))) + 1e-9
        keep &= (unit[:enough, f] >= near * c - wide) if c > 0 else (unit[:enough, f] <= near * c + wide)
    return np.flatnonzero(keep)


def search_block(q_ids, q, q_len, floors, v_ids, v, v_len, k: int) -> tuple[list, list, list]:
    """The k best of one bucket for each query that may find any there."""
    order = np.argsort(-v_len, kind="stable")
    v_ids, v, v_len = v_ids[order], v[order], v_len[order]
    unit = v / np.maximum(v_len, 1e-300)[:, None]
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(q), 64):
        part = slice(at, at + 64)
        spots = [candidates(a, n, f, v, v_len, unit) for a, n, f in zip(q[part], q_len[part], floors[part])]
        reach = max((int(s[-1]) + 1 for s in spots if len(s)), default=0)
        dense = products(q[part], v[:reach]) if sum(map(len, spots)) > reach * len(spots) // 4 else None
        for i, spot in enumerate(spots):
            spot = spot[v_ids[spot] != q_ids[at + i]]
            score = dense[i, spot] if dense is not None else products(q[at + i : at + i + 1], v[spot])[0]
            fit = score >= floors[at + i]
            spot, score = spot[fit], score[fit]
            first = np.lexsort((v_ids[spot], -score))[:k]
            out[0].extend([q_ids[at + i]] * len(first))
            out[1].extend(v_ids[spot[first]])
            out[2].extend(score[first])
    return out


def top_products(table: DataFrame, every: int = 50, k: int = 5, probe: int = 1024, block: int = 8192) -> DataFrame:
    """The k largest whole-number products of each query: ``query_id, rank, vec_id, score``; ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; the row itself is no candidate. ``probe``: how many of the longest
    vectors set the first thresholds (they travel to every task: ``probe`` rows at most). ``block``: rows of a bucket block.
    Vectors that are null or hold null or non-finite components take no part; zero vectors do. Of vectors of several lengths the
    commonest length takes part; of rows with one id, the smallest vector. An empty table gives an empty result.
    """
    rows = stored(grid(table), "grid")
    total = rows.count()
    top = rows.orderBy(F.desc("len"), "vec_id").limit(probe).collect()
    p_ids, p_v = np.array([r["vec_id"] for r in top], "i8"), np.array([r["v"] for r in top], "i8")

    def floors(batches):
        for batch in batches:
            q, ids = matrix(batch.column(1), "i8"), batch.column(0).to_numpy()
            low = np.full(len(q), float(-(2**62)))
            if len(q):
                score = products(q, p_v)
                score[ids[:, None] == p_ids] = -(2**62)
                if score.shape[1] >= k:
                    low = -np.partition(-score, k - 1, axis=1)[:, k - 1].astype("f8")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low)], names=["query_id", "q", "q_len", "floor"])

    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("len").alias("q_len"))
    queries = queries.mapInArrow(floors, "query_id long, q array<long>, q_len double, floor double")
    queries = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-total // (every * 2048))))))

    # Buckets by length at quantiles (at most 256), each in shares of about ``block`` rows.
    wanted = min(256, max(1, total // block))
    cuts = sorted(set(rows.approxQuantile("len", [i / wanted for i in range(1, wanted)], 0.001))) if wanted > 1 else []
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("len"))) if cuts else F.lit(0)
    placed = rows.withColumn("bucket", bucket)
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("len").alias("longest")).collect()  # at most 256 rows
    shares = {r["bucket"]: (-(-r["n"] // block), r["longest"]) for r in sizes}
    share_of = F.create_map(*[x for b, (n, _) in shares.items() for x in (F.lit(b), F.lit(n))]) if shares else F.create_map(F.lit(0), F.lit(1))
    placed = placed.withColumn("share", F.pmod(F.xxhash64("vec_id"), share_of[F.col("bucket")].cast("long")))
    known = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("n"), F.lit(longest).alias("longest")) for b, (n, longest) in shares.items()])
    visits = queries.withColumn("b", F.explode(F.filter(known, lambda b: b["longest"] * F.col("q_len") * (1 + 1e-9) >= F.col("floor")))) if shares else queries.limit(0).withColumn("b", F.struct(F.lit(0).alias("bucket"), F.lit(1).alias("n")))
    visits = visits.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b.n").cast("long") - 1))).withColumn("bucket", F.col("b.bucket")).drop("b")
    blocks = max(1, -(-total // (every * 2048)))
    spread = placed.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def both(qs: pa.Table, vs: pa.Table) -> pa.Table:
        if not qs.num_rows or not vs.num_rows:
            return FOUND.empty_table()
        q, v = matrix(qs.column("q").combine_chunks(), "i8"), matrix(vs.column("v").combine_chunks(), "i8")
        out = search_block(qs.column("query_id").to_numpy(), q, qs.column("q_len").to_numpy(), qs.column("floor").to_numpy(), vs.column("vec_id").to_numpy(), v, vs.column("len").to_numpy(), k)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], schema=FOUND)

    keys = ["bucket", "share", "qb"]
    found = visits.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(both, DDL)
    return best(found, k, F.desc("score"))
