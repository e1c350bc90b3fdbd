"""Nearest neighbours by a forest of random-projection trees.

Each tree halves the space at every node by a random direction, at the median of a bounded sample. Every row goes down
every tree to a leaf. A query searches all trees through one priority queue: it holds the branches not taken, nearest cut
first, and gives up leaves until they hold the wanted number of rows. The leaves' rows are then ranked by true distance.

Equal vectors are one entry with its smallest ids, so a vector that a third of all rows share fills no leaf. Leaves larger than
a block are dealt in shares.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import best, matrix, usable

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Forest:
    """Trees as arrays in heap order: node n has the children 2n+1 and 2n+2."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        inner = 2**depth - 1
        self.depth = depth
        self.normals = rng.normal(size=(trees, inner, sample.shape[1]))
        self.normals /= np.linalg.norm(self.normals, axis=2, keepdims=True)
        self.cuts = np.zeros((trees, inner))
        for t in range(trees):
            node = np.zeros(len(sample), "i8")
            for n in range(inner):
                here = node == n
                side = sample[here] @ self.normals[t, n]
                if len(side):
                    self.cuts[t, n] = np.median(side)
                node[here] = 2 * n + 1 + (side > self.cuts[t, n])

    def leaves(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered from 0."""
        out = np.zeros((len(v), len(self.cuts)), "i4")
        for t in range(len(self.cuts)):
            node = np.zeros(len(v), "i8")
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", v, self.normals[t, node]) > self.cuts[t, node])
            out[:, t] = node - (2**self.depth - 1)
        return out

    def search(self, q: np.ndarray, sizes: np.ndarray, rows: int) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) in order of the nearest cut, until they hold ``rows`` rows."""
        inner = 2**self.depth - 1
        gap = np.einsum("tnd,d->tn", self.normals, q) - self.cuts
        queue = [(0.0, t, 0) for t in range(len(self.cuts))]
        out, held = [], 0
        while queue and held < rows:
            far, t, n = heapq.heappop(queue)
            while n < inner:
                side = gap[t, n] > 0
                heapq.heappush(queue, (max(far, abs(gap[t, n])), t, 2 * n + 2 - side))
                n = 2 * n + 1 + side
            out.append((t, n - inner))
            held += sizes[t, n - inner]
        return out


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: list[np.ndarray], v: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k nearest rows of a block for each query. ``ids[i]``: the smallest ids of the rows equal to ``v[i]``."""
    out: tuple[list, list, list] = ([], [], [])
    norms = (v * v).sum(axis=1)
    for at in range(0, len(q), 64):
        part = q[at : at + 64]
        rough = norms - 2 * part @ v.T  # the squared distance, less a constant of the query
        for i, row in enumerate(rough):
            spots = np.arange(len(v))
            if len(v) > k + 1:  # one entry may be the query alone
                limit = np.partition(row, k)[k]
                spots = np.flatnonzero(row <= limit + 1e-9 * (abs(limit) + norms.max(initial=0)))
            far = np.sqrt(((v[spots] - part[i]) ** 2).sum(axis=1))
            names = [ids[s] for s in spots]
            vec, dist = np.concatenate(names), np.repeat(far, [len(n) for n in names])
            other = vec != q_ids[at + i]
            vec, dist = vec[other], dist[other]
            first = np.lexsort((vec, dist))[:k]
            out[0].extend([q_ids[at + i]] * len(first))
            out[1].extend(vec[first])
            out[2].extend(dist[first])
    return out


def search(table: DataFrame, every: int = 100, k: int = 10, trees: int = 16, leaf: int = 256, share: float = 0.8, least: int = 16_384, sample: int = 16_384, block: int = 8192) -> DataFrame:
    """The k nearest rows found for each query: ``query_id, rank, vec_id, score`` (Euclidean distance); ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; the row itself is no candidate. The trees are fitted on at most about
    ``sample`` rows, drawn by a hash of the vector; every row is indexed. A query's leaves hold at least ``least`` rows or
    ``share`` of all, counted over the trees: with 16 trees, 0.8 reaches about a third to a half of the distinct rows, which vectors
    without any structure need for a recall of 0.9; clustered ones need far less. Vectors that are null or zero or hold null
    or non-finite components take no part. Of vectors of several lengths the commonest length takes part; of rows with one id,
    the smallest vector. An empty table gives an empty result.
    """
    rows = usable(table)
    near = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= k + 1)
    entries = stored(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")  # at most k + 1 ids each
    total = entries.count()
    if not total:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = entries.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(min(1.0, sample / total) * (1 << 20))).select("v").collect()
    points = np.array([r["v"] for r in drawn], "f8") if drawn else np.array([r["v"] for r in entries.limit(1).collect()], "f8")
    depth = max(0, min(math.ceil(math.log2(total / leaf)), int(math.log2(max(1, len(points) / 32)))))
    forest = Forest(points, trees, depth)

    def place(batches):
        for batch in batches:
            leaves = pa.FixedSizeListArray.from_arrays(pa.array(forest.leaves(matrix(batch.column(0))).ravel()), trees).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, leaves], names=["v", "ids", "leaves"])

    # Stored once a vector, with its leaf in each tree; only the shuffle to the leaves has a row for each tree.
    placed = stored(entries.select("v", "ids").mapInArrow(place, "v array<double>, ids array<long>, leaves array<int>"), "leaves")
    placed = placed.select("v", "ids", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = np.zeros((trees, 2**depth), "i8")
    for r in placed.groupBy("tree", "leaf").count().collect():  # as many rows as the trees have leaves, bounded by the sample
        sizes[r["tree"], r["leaf"]] = r["count"]
    wanted = max(least, int(share * total))

    def visit(batches):
        for batch in batches:
            for i, q in enumerate(matrix(batch.column(1))):
                spots = [(t, n, s) for t, n in forest.search(q, sizes, wanted) if sizes[t, n] for s in range(-(-int(sizes[t, n]) // block))]
                one = batch.slice(i, 1)
                t, n, s = zip(*spots)
                yield pa.RecordBatch.from_arrays([one.column(0).take(pa.array([0] * len(t))), one.column(1).take(pa.array([0] * len(t))), pa.array(t, pa.int32()), pa.array(n, pa.int32()), pa.array(s, pa.int32())], names=["query_id", "q", "tree", "leaf", "part"])

    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    visits = queries.mapInArrow(visit, "query_id long, q array<double>, tree int, leaf int, part int")
    parts = F.element_at(F.element_at(F.array(*[F.array(*[F.lit(int(-(-n // block))) for n in row]) for row in sizes]), F.col("tree") + 1), F.col("leaf") + 1) if sizes.max() > block else F.lit(1)
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("ids"), F.greatest(parts, F.lit(1)).cast("long")).cast("int"))

    def both(qs: pa.Table, vs: pa.Table) -> pa.Table:
        if not qs.num_rows or not vs.num_rows:
            return FOUND.empty_table()
        out = nearest(qs.column("query_id").to_numpy(), matrix(qs.column("q").combine_chunks()), [np.array(x, "i8") for x in vs.column("ids").to_pylist()], matrix(vs.column("v").combine_chunks()), k)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, FOUND)], schema=FOUND)

    keys = ["tree", "leaf", "part"]
    found = visits.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(both, "query_id long, vec_id long, score double")
    return best(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), k, F.asc("score"))
