"""Prefix trie of conversations, with count-min screening of prefix digests.

A node is a distinct sequence of first turns. Its name is the sum of numbers that the SHA-256 of each turn and its place give (two
sums of 60-bit numbers), so names of prefixes are running sums, which a long conversation's parts can take apart from each other.

Every prefix of every conversation is counted in a count-min sketch. An estimate of one proves a prefix a singleton, and with it all
longer ones of that conversation: this tail is a chain of nodes with one member, and its rows are made where the conversation
lies. Only prefixes whose estimate is higher are shuffled and grouped exactly. The sketch is of a fixed greatest size; in a larger
corpus more singletons are taken for shared, which costs shuffle and changes no result.

Sums over subtrees need no walk from level to level. A node's smallest member stands for it; what the node weighs is put on that
conversation at the node's depth and summed from the end of the conversation to its start. The sum over the members of a node is then
that of its subtree, as each node below is counted on one conversation.

Long conversations are taken in parts of ``PART`` turns, and no step gathers the turns of one conversation or node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, stored

PART = 4096  # turns of a conversation, or ids of a list, that one step takes together
FEWEST, MOST = 1 << 15, 1 << 26  # cells of a row of the sketch; a bitmap of the largest is 8 MB
ROWS = 2  # rows of the sketch
NUMBER = "decimal(38,0)"
JOINED = pa.schema([("name", pa.string()), ("first", pa.int64()), ("ids", pa.string())])
ENDED = pa.schema([("name", pa.string()), ("ends_sha256", pa.string())])
NOBODY = hashlib.sha256(b"").hexdigest()


def _before(df: DataFrame, order: str, sums: dict[str, Column]) -> DataFrame:
    """Running sums of columns along each ``conv`` by ``order``, places from 0 on: what stands before a row and the row itself."""
    df = df.withColumn("part", F.expr(f"{order} div {PART}"))
    inside = Window.partitionBy("conv", "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({k: F.sum(v).over(inside) for k, v in sums.items()})
    last = df.groupBy("conv", "part").agg(*(F.max_by(k, order).alias(f"{k}_part") for k in sums))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("conv", "part", *(F.sum(f"{k}_part").over(earlier).alias(f"{k}_before") for k in sums)).filter("part > 0")
    df = df.join(last, ["conv", "part"], "left")
    return df.select(*(c for c in df.columns if c not in sums and c != "part" and not c.endswith("_before")), *((F.col(k) + F.coalesce(f"{k}_before", F.lit(0))).cast(NUMBER).alias(k) for k in sums))


def placed(turns: DataFrame) -> DataFrame:
    """``conv, place, sha, bytes``: the turns of a conversation table in order, from place 0.

    Rows are ordered by turn (null first), those of one turn by the SHA-256 of role and text; null roles and texts are empty, rows without ``conv_id`` take no part,
    repeated rows are turns of their own. The order is cut into ranges, so that a conversation may lie in many.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("sha"), F.octet_length(text).cast("long").alias("bytes"),
    )
    rows = rows.withColumn("salt", F.monotonically_increasing_id())  # equal rows may lie in several ranges
    ranges = rows.repartitionByRange("conv", "turn", "sha", "salt").withColumn("range", F.spark_partition_id())
    ranges = stored(ranges, "conversations-ranges")
    inside = Window.partitionBy("conv", "range").orderBy("turn", "sha", "salt")
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("conv", "range").agg(F.count("*").alias("n")).withColumn("start", F.sum("n").over(earlier)).filter("start IS NOT NULL")
    rows = ranges.withColumn("at", F.row_number().over(inside) - 1).join(sizes.select("conv", "range", "start"), ["conv", "range"], "left")
    return rows.select("conv", (F.col("at") + F.coalesce("start", F.lit(0))).cast("long").alias("place"), "sha", "bytes")


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations of the rebuilt table: (``conv, place, sha, bytes``; ``conv, n``).

    Conversation c takes the first h turns of conversation c - c % ``group`` (all if fewer, none if there is none), then its own after
    its first h; h is the CRC-32 of its id in decimals, modulo ``heads``.
    """
    rows = stored(placed(turns), "conversations-turns")
    own = rows.groupBy("conv").agg(F.count("*").alias("own"))
    own = own.select("conv", "own", F.expr(f"conv - conv % {group}").alias("base"), (F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % heads).alias("h"))
    size = own.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    plan = own.join(size, "base", "left").select("conv", "base", "h", "own", F.least("h", F.coalesce("base_own", F.lit(0))).alias("taken"))
    plan = stored(plan, "conversations-plan")
    first = rows.filter(F.col("place") < heads).withColumnRenamed("conv", "base")
    taken = plan.filter("taken > 0").select("conv", "base", "taken").join(first, "base").filter("place < taken").select("conv", "place", "sha", "bytes")
    kept = rows.join(plan.select("conv", "h", "taken"), "conv").filter("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "sha", "bytes")
    return taken.unionByName(kept), plan.select("conv", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv, depth, name, above, sha, bytes``: every prefix of one turn or more, its name and that of the prefix one turn shorter."""
    token = lambda k: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(k)), "place", "sha"), 256), 1, 15), 16, 10).cast(NUMBER)
    rows = turns.withColumns({"t0": token(0), "t1": token(1)})
    rows = _before(rows, "place", {"s0": F.col("t0"), "s1": F.col("t1")})
    name = lambda a, b: F.concat_ws(".", a.cast("string"), b.cast("string"))
    s, t = (F.col("s0"), F.col("s1")), (F.col("t0"), F.col("t1"))
    return rows.select("conv", (F.col("place") + 1).alias("depth"), name(*s).alias("name"), name(s[0] - t[0], s[1] - t[1]).alias("above"), "bytes")


def _cell(row: int, width: int) -> Column:
    """The cell of a prefix in a row of the sketch."""
    return F.pmod(F.xxhash64(F.lit(row), F.col("depth"), F.col("name")), F.lit(width))


def screen(rows: DataFrame, fewest: int = FEWEST, most: int = MOST) -> DataFrame:
    """Rows with a column ``shared``: whether the count-min estimate of the prefix is above one.

    A row of the sketch has about four cells a prefix, ``most`` at most. All that leaves the executors is one bit a cell, whether
    its count is above one.
    """
    width = min(most, max(fewest, 1 << max(0, (4 * rows.count()).bit_length())))
    shared = F.lit(True)
    for row in range(ROWS):
        crowded = rows.select(_cell(row, width).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
        bits = crowded.groupBy(F.expr("bitmap_bucket_number(cell + 1)").alias(f"bucket{row}")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell + 1))").alias(f"bits{row}"))
        rows = rows.withColumn(f"cell{row}", _cell(row, width))
        rows = rows.withColumn(f"bucket{row}", F.expr(f"bitmap_bucket_number(cell{row} + 1)")).join(F.broadcast(bits), f"bucket{row}", "left")
        byte = F.expr(f"conv(hex(substring(bits{row}, cast((cell{row} % 32768) div 8 as int) + 1, 1)), 16, 10)").cast("int")
        shared = shared & F.coalesce(F.getbit(byte, (F.col(f"cell{row}") % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn("shared", shared).drop(*(f"{k}{row}" for k in ("cell", "bucket", "bits") for row in range(ROWS)))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each name, sorted, as texts of up to ``PART`` ids."""
    name, first, ids = None, 0, []

    def text():
        return batch_of(JOINED, [name], [first], [",".join(map(str, ids))])

    for batch in batches:
        for n, c in zip(batch["name"].to_pylist(), batch["conv"].to_pylist()):
            if ids and (n != name or len(ids) == PART):
                yield text()
                ids = []
            if not ids:
                name, first = n, c
            ids.append(c)
    if ids:
        yield text()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each name's texts, sorted, with commas between."""
    name, running = None, None
    for batch in batches:
        names, hashes = [], []
        for n, ids in zip(batch["name"].to_pylist(), batch["ids"].to_pylist()):
            if n != name:
                if running is not None:
                    names.append(name)
                    hashes.append(running.hexdigest())
                name, running = n, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
        yield batch_of(ENDED, names, hashes)
    if running is not None:
        yield batch_of(ENDED, [name], [running.hexdigest()])


def list_hashes(rows: DataFrame) -> DataFrame:
    """``name, ends_sha256``: SHA-256 of the ascending ids (``conv``) of each name, joined by commas.

    A hash is one running state, so one task reads the texts of a name; each text holds thousands of ids and goes as it comes.
    """
    ranges = rows.select("name", "conv").repartitionByRange("name", "conv").sortWithinPartitions("name", "conv")
    texts = ranges.mapInArrow(_joined, "name string, first long, ids string")
    return texts.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_hashed, "name string, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, fewest: int = FEWEST, most: int = MOST) -> DataFrame:
    """One row per node of the trie of conversations, root included: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    ``turns``: ``conv, place, sha, bytes``; ``convs``: ``conv, n``, also those without turns. Without conversations there is no node.
    """
    convs = stored(convs, "trie-convs")
    rows = stored(screen(stored(prefixes(turns), "trie-prefixes"), fewest, most), "trie-screened")
    # A singleton's longer prefixes are singletons: the first of them starts the tail.
    tails = rows.filter("NOT shared").groupBy("conv").agg(F.min("depth").alias("tail"), F.min_by("above", "depth").alias("above"))
    known = stored(convs.join(tails, "conv", "left"), "trie-tails")
    rows = rows.join(known.select("conv", "n", "tail"), "conv")
    alone = rows.filter("depth >= tail").select("conv", "depth", "n", "tail", "above")
    # The root is the prefix of no turns, which all conversations have.
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit("").alias("name"), F.lit("").alias("above"), F.lit(0).cast("long").alias("bytes"))
    above = F.when(F.col("depth") == 1, "").otherwise(F.col("above"))
    body = rows.filter("tail IS NULL OR depth < tail").select("conv", "depth", "name", above.alias("above"), "bytes")
    body = stored(root.unionByName(body).join(known.select("conv", "n", "tail"), "conv"), "trie-body")

    key = ["depth", "name"]
    nodes = body.groupBy(*key).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n").alias("longest"), F.first("bytes").alias("bytes"), F.first("above").alias("above"),
    )
    nodes = stored(nodes, "trie-nodes")
    chief = nodes.select(
        F.col("conv_id").alias("conv"), "depth", F.lit(1).alias("chief"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("weight"), F.expr("if(longest = depth, 1, 0)").alias("leaf"),
    )
    # By depth from the end of the part of a conversation that is in the body: its last row stands before the tail, if there is one.
    end = F.expr("coalesce(tail - 1, n)")
    marked = body.join(chief, ["conv", "depth"], "left").select(
        "conv", *key, (end - F.col("depth")).alias("back"), F.coalesce("chief", F.lit(0)).alias("chief"), F.coalesce("weight", F.lit(0)).cast(NUMBER).alias("weight"),
        (F.coalesce("leaf", F.lit(0)) + F.expr("if(depth = tail - 1, 1, 0)")).cast(NUMBER).alias("leaf"), F.expr("if(depth = tail - 1, 1, 0)").alias("starts"),
    )
    marked = _before(marked, "back", {"saved": F.col("weight"), "leaves": F.col("leaf")})
    sums = marked.groupBy(*key).agg(F.sum("saved").cast("long").alias("saved_tokens"), F.sum("leaves").cast("long").alias("n_leaves"), F.sum("starts").alias("starts"))
    # A chief one level below is one child.
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("name")).agg(F.count("*").alias("below"))
    ends = list_hashes(body.filter("depth = n").withColumn("name", F.concat_ws("|", "depth", "name")))
    ends = ends.select(F.split_part("name", F.lit("|"), F.lit(1)).cast("long").alias("depth"), F.split_part("name", F.lit("|"), F.lit(2)).alias("name"), "ends_sha256")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    parents = stored(parents, "trie-parents")

    full = nodes.join(sums, key).join(children, key, "left").join(ends, key, "left").join(parents, ["depth", "above"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (F.coalesce("below", F.lit(0)) + F.col("starts")).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"),
    )
    starts = alone.filter("depth = tail").select("conv", "depth", "n", F.when(F.col("depth") == 1, "").otherwise(F.col("above")).alias("above"))
    starts = starts.join(parents, ["depth", "above"]).select("conv", "depth", "n", "parent_conv_id")
    chain = starts.unionByName(alone.filter("depth > tail").select("conv", "depth", "n", F.col("conv").alias("parent_conv_id")))
    chain = chain.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.lit(1).cast("long").alias("n_convs"), F.expr("if(depth < n, 1L, 0L)").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("n"), F.sha2(F.encode(F.col("conv").cast("string"), "UTF-8"), 256)).otherwise(NOBODY).alias("ends_sha256"),
    )
    return full.unionByName(chain)


def prefix_trie(conversations: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """The trie of the rebuilt conversations of a table ``conv_id, turn, role, text``."""
    return trie(*rebuilt(conversations, group, heads))
