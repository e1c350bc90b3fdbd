"""Entropy-coding statistics of coefficient blocks: scan order, differences, runs, symbols, sizes."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import blocks as fb
from ..functions import fixed
from ..functions.exprs import col, idiv, int_array, let
from ..functions.orders import to_zigzag, zigzag_positions
from .ordered import previous, running_sum

KEYS = ["image_id", "ci"]


def scan_position(blocks: DataFrame, interleaved: bool = True) -> DataFrame:
    """Add the place of each block in a scan: unit row and column, row and column inside the unit, and ``pos``, a
    gapless number per component. Needs ``h, v`` and ``mcus_per_row`` on the rows.
    """
    h, v = (F.col("h"), F.col("v")) if interleaved else (F.lit(1), F.lit(1))
    row, column = idiv("by", v), idiv("bx", h)
    pos = (row * F.col("mcus_per_row") + column) * h * v + F.col("by") % v * h + F.col("bx") % h
    return blocks.withColumns(
        {"mcu_row": row, "mcu_col": column, "mcu_y": F.col("by") % v, "mcu_x": F.col("bx") % h, "pos": pos}
    )


def pad_mcu(blocks: DataFrame) -> DataFrame:
    """Add the dummy blocks that complete partial units: AC zero, DC of the block before them in the unit.

    Needs ``h, v, blocks_w, blocks_h`` on the rows. A dummy only depends on one real block, the last one of its row
    or unit, so each real block emits its own dummies: no join and no window.
    """
    h, v, bw, bh = F.col("h"), F.col("v"), F.col("blocks_w"), F.col("blocks_h")
    by, bx = F.col("by"), F.col("bx")
    spare_x = F.pmod(-bw, h).cast("int")
    spare_y = F.pmod(-bh, v).cast("int")
    last_in_row = bx == bw - 1
    last_in_unit = (by == bh - 1) & (last_in_row | (bx % h == h - 1))
    spot = "array<struct<by:int,bx:int>>"

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    beside = F.when(last_in_row, F.transform(upto(spare_x), lambda i: F.struct(by.cast("int").alias("by"), (bx + i).cast("int").alias("bx"))))
    columns = F.sequence(F.lit(0), (h - 1).cast("int"))
    below = F.when(
        last_in_unit,
        F.flatten(
            F.transform(
                upto(spare_y),
                lambda j: F.transform(
                    columns, lambda i: F.struct((by + j).cast("int").alias("by"), (idiv(bx, h) * h + i).cast("int").alias("bx"))
                ),
            )
        ),
    )
    none = F.array().cast(spot)
    spots = F.concat(F.coalesce(beside.cast(spot), none), F.coalesce(below.cast(spot), none))
    rest = [c for c in blocks.columns if c not in ("by", "bx", "coef")]
    flat = F.concat(F.array(F.col("coef")[0]), F.array_repeat(F.lit(0), 63))
    dummies = blocks.filter(last_in_row | last_in_unit).select(*rest, flat.alias("coef"), F.inline(spots)).withColumn("dummy", F.lit(True))
    return blocks.withColumn("dummy", F.lit(False)).unionByName(dummies)


def dc_diff(blocks: DataFrame, restart: int = 0, chunk: float = 65536) -> DataFrame:
    """DC minus the DC before it in scan order, per component; 0 before it at the start and at each restart.

    Needs ``pos`` (see ``scan_position``) and ``h, v``. ``restart`` counts units; 0 is none.
    """
    slim = blocks.select(*KEYS, "pos", (F.col("h") * F.col("v")).alias("_per"), F.col("coef")[0].cast("int").alias("dc"))
    seen = previous(slim, KEYS, ["pos"], {"dc": "_dc"}, chunk)
    before = F.coalesce("_dc", F.lit(0))
    if restart:
        before = F.when(F.col("pos") % (F.col("_per") * restart) == 0, F.lit(0)).otherwise(before)
    return seen.select(*KEYS, "pos", "dc", (F.col("dc") - before).alias("diff"))


def _nonzero(block, ss: int = 1, se: int = 63, al: int = 0) -> Column:
    """Non-zero coefficients of a zigzag range as ``array<struct<pos, value, run>>``; run = zeros before it."""
    values = fb.point_transform(block, ss, se, al)
    kept = F.filter(
        F.transform(values, lambda v, i: F.struct((i + ss).alias("pos"), v.alias("value"))), lambda s: s["value"] != 0
    )
    return let(
        kept,
        lambda k: F.transform(
            k,
            lambda s, i: F.struct(
                s["pos"].alias("pos"), s["value"].alias("value"),
                (s["pos"] - F.when(i == 0, F.lit(ss - 1)).otherwise(F.get(k, i - 1)["pos"]) - 1).alias("run"),
            ),
        ),
    )


def zero_runs(blocks: DataFrame) -> DataFrame:
    """One row per non-zero AC coefficient in zigzag order, with the run of zeros before it."""
    return blocks.select(*KEYS, "by", "bx", F.inline(_nonzero("coef")))


def _ac_symbols(block) -> Column:
    """Symbols of a sequential block: F0h per 16 zeros, (run, category), and 0 for zeros at the end."""

    def listed(nz: Column) -> Column:
        one = lambda s: F.concat(
            F.array_repeat(F.lit(0xF0), idiv(s["run"], 16).cast("int")),
            F.array((s["run"] % 16 * 16 + fb.category(s["value"])).cast("int")),
        )
        last = F.when(F.size(nz) > 0, F.element_at(nz, -1)["pos"]).otherwise(F.lit(0))
        ending = F.when(last < 63, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        return F.concat(F.flatten(F.transform(nz, one)), ending)

    return let(_nonzero(block), listed)


def dc_symbol_counts(diffs: DataFrame, comps: DataFrame) -> DataFrame:
    """Counts of DC categories per image and DC table. ``comps``: ``image_id, ci, dc_table``. Components that it does not list
    stay, under a null slot."""
    per = diffs.groupBy(*KEYS, fb.category("diff").alias("symbol")).agg(F.count("*").alias("n"))
    j = per.join(comps.select("image_id", "ci", F.col("dc_table").alias("slot")), KEYS, "left")
    return j.groupBy("image_id", F.lit(0).alias("class"), "slot", "symbol").agg(F.sum("n").alias("n"))


def ac_symbol_counts(blocks: DataFrame, comps: DataFrame) -> DataFrame:
    """Counts of AC symbols per image and AC table. Symbols are counted per component first, so the join to the
    tables sees at most 256 rows per component. Components that ``comps`` does not list stay, under a null slot."""
    symbols = blocks.select(*KEYS, F.explode(_ac_symbols("coef")).alias("symbol"))
    per = symbols.groupBy(*KEYS, "symbol").agg(F.count("*").alias("n"))
    j = per.join(comps.select("image_id", "ci", F.col("ac_table").alias("slot")), KEYS, "left")
    return j.groupBy("image_id", F.lit(1).alias("class"), "slot", "symbol").agg(F.sum("n").alias("n"))


MAX_EOB_RUN = 0x7FFF  # fixed value: longest end-of-block run


def eob_runs(blocks: DataFrame, ss: int, se: int, al: int, restart: int = 0, chunk: float = 65536) -> DataFrame:
    """End-of-block runs of a first progressive AC scan: ``image_id, ci, run, symbol``.

    ``blocks`` needs ``pos``, the raster position. A block with a non-zero coefficient closes the run before it; the
    running count of such blocks numbers the runs, and a run's length is a sum. ``restart`` (in blocks) closes runs.
    """
    values = fb.point_transform("coef", ss, se, al)
    marked = blocks.select(
        *KEYS, "pos",
        F.exists(values, lambda v: v != 0).cast("bigint").alias("_hit"),
        (F.element_at(values, -1) == 0).cast("bigint").alias("_tail"),
        (idiv("pos", restart) if restart else F.lit(0).cast("bigint")).alias("_part"),
    )
    numbered = running_sum(marked, KEYS, ["pos"], {"_hit": "_island"}, chunk)
    lengths = numbered.groupBy(*KEYS, "_part", "_island").agg(F.sum("_tail").alias("_len")).filter("_len > 0")
    full = F.array_repeat(F.lit(MAX_EOB_RUN).cast("bigint"), idiv("_len", MAX_EOB_RUN).cast("int"))
    rest = F.col("_len") % MAX_EOB_RUN
    runs = F.concat(full, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    return lengths.select(*KEYS, F.explode(runs).alias("run")).withColumn("symbol", (fb.category("run") - 1) * 16)


def progressive_ac_counts(blocks: DataFrame, ss: int, se: int, al: int, chunk: float = 65536) -> DataFrame:
    """Symbol counts of a first progressive AC scan per component, end-of-block runs included."""

    def listed(nz: Column) -> Column:
        return F.flatten(
            F.transform(
                nz,
                lambda s: F.concat(
                    F.array_repeat(F.lit(0xF0), idiv(s["run"], 16).cast("int")),
                    F.array((s["run"] % 16 * 16 + fb.category(s["value"])).cast("int")),
                ),
            )
        )

    own = blocks.select(*KEYS, F.explode(let(_nonzero("coef", ss, se, al), listed)).alias("symbol"))
    counted = own.groupBy(*KEYS, "symbol").agg(F.count("*").alias("n"))
    ends = eob_runs(blocks, ss, se, al, chunk=chunk).groupBy(*KEYS, F.col("symbol").cast("int").alias("symbol")).agg(F.count("*").alias("n"))
    return counted.unionByName(ends).groupBy(*KEYS, "symbol").agg(F.sum("n").alias("n"))


# First AC passes of the ten-scan script: components, first and last coefficient, bit position.
YCC_FIRST_PASSES = (((0,), 1, 5, 2), ((1, 2), 1, 63, 1), ((0,), 6, 63, 2))


def pass_counts(blocks: DataFrame, passes=YCC_FIRST_PASSES, chunk: float = 65536) -> DataFrame:
    """Symbols of sequential AC coding next to those of the first progressive AC passes, per component.

    ``blocks`` needs ``pos``, the raster position: ``image_id, ci, sequential, progressive``.
    """
    plain = blocks.select(*KEYS, F.size(_ac_symbols("coef")).alias("_n")).groupBy(*KEYS).agg(F.sum("_n").alias("sequential"))
    parts = [progressive_ac_counts(blocks.filter(F.col("ci").isin(*cis)), ss, se, al, chunk) for cis, ss, se, al in passes]
    staged = parts[0]
    for part in parts[1:]:
        staged = staged.unionByName(part)
    return plain.join(staged.groupBy(*KEYS).agg(F.sum("n").alias("progressive")), KEYS, "left")


# --- code tables ---------------------------------------------------------------------------------------


def _code_heads(bits: Column) -> Column:
    """Per length with symbols: the first code, which is the sum of the shorter counts, each shifted up to it, how many
    symbols come before, and how many have this length. At most 16 entries."""
    kind = "array<struct<_length:int,_first:bigint,_skipped:int,_n:int>>"

    def step(state: Column, l: Column) -> Column:
        n = F.get(bits, l - 1).cast("int")
        head = F.struct(l.alias("_length"), state["first"].alias("_first"), state["skipped"].alias("_skipped"), n.alias("_n"))
        return F.struct(
            ((state["first"] + n) * 2).alias("first"), (state["skipped"] + n).alias("skipped"),
            F.when(n > 0, F.concat(state["heads"], F.array(head)).cast(kind)).otherwise(state["heads"]).alias("heads"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("first"), F.lit(0).alias("skipped"), F.array().cast(kind).alias("heads"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(16)), start, step, lambda state: state["heads"])


def canonical_codes(htables: DataFrame) -> DataFrame:
    """Code of every symbol of each table, with ``ok``: all codes fit and none is all ones, symbols are unique, and DC
    symbols are at most 15. A table is one row, so this is a projection and two explodes: into code lengths, then symbols."""
    keys = [c for c in htables.columns if c not in ("bits", "vals")]
    headed = htables.withColumn("_heads", _code_heads(F.col("bits")))
    fits = F.forall("_heads", lambda s: (s["_skipped"] >= 0) & (s["_first"] + s["_n"] < F.pow(F.lit(2), s["_length"]).cast("bigint")))
    total = F.aggregate("_heads", F.lit(0), lambda a, s: a + s["_n"])
    ends = F.array_max(F.transform("_heads", lambda s: s["_skipped"] + s["_n"]))  # less than the total if a count is negative
    sized = headed.withColumns({"_total": total, "_symbols": F.slice("vals", F.lit(1), F.greatest(ends, F.lit(0)))})
    # The set difference leaves each symbol once and no NULL.
    unique = F.size(F.array_except("_symbols", F.array(F.lit(None)).cast(htables.schema["vals"].dataType.simpleString()))) == F.col("_total")
    whole = (ends == F.col("_total")) & unique
    legal = (F.col("class") == 1) | (F.array_max("_symbols") <= 15)
    judged = sized.withColumn("ok", F.coalesce(fits & whole & legal, F.lit(False)))
    # Outer forms: inner ones would compute the array a second time in a filter in front.
    per_length = judged.select(*keys, "ok", "vals", F.inline_outer("_heads")).filter("_n IS NOT NULL")
    placed = per_length.select("*", F.explode_outer(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_j"))
    return placed.select(
        *keys, "ok", F.get("vals", F.col("_skipped") + F.col("_j")).alias("symbol"), F.col("_length").alias("length"), (F.col("_first") + F.col("_j")).alias("code")
    )


def _code_lengths(symbols: list[int], counts: list[int]) -> dict[int, int]:
    """Length-limited prefix code of at most 16 bits with the all-ones code left free.

    Results must equal those of the published procedure (ITU-T T.81, annex K.2), whose way of shortening is kept.
    """
    reserved = 256
    heap = [(n, -s) for s, n in zip(symbols, counts) if n > 0] + [(1, -reserved)]
    members = {-key: [-key] for _, key in heap}
    depth = {s: 0 for s in members}
    heapq.heapify(heap)
    while len(heap) > 1:
        (n1, k1), (n2, k2) = heapq.heappop(heap), heapq.heappop(heap)
        members[-k1] += members.pop(-k2)
        for s in members[-k1]:
            depth[s] += 1
        heapq.heappush(heap, (n1 + n2, k1))
    per_length = [0] * (max(depth.values()) + 2)
    for d in depth.values():
        per_length[d] += 1
    for length in range(len(per_length) - 1, 16, -1):
        while per_length[length] > 0:
            shorter = max(j for j in range(length - 1) if per_length[j] > 0)
            per_length[length] -= 2
            per_length[length - 1] += 1
            per_length[shorter + 1] += 2
            per_length[shorter] -= 1
    longest = max(j for j, n in enumerate(per_length) if n > 0)
    per_length[longest] -= 1  # the reserved symbol
    ranked = sorted((s for s in depth if s != reserved), key=lambda s: (depth[s], s))
    lengths = [length for length, n in enumerate(per_length) for _ in range(n)]
    return dict(zip(ranked, lengths))


def optimal_lengths(counts: DataFrame) -> DataFrame:
    """Best code lengths per image and table from symbol counts, which stay on the rows.

    The counts of a table, at most 256, become one array; Python then works through batches of tables, not through one
    group at a time.
    """
    id_type = counts.schema["image_id"].dataType.simpleString()
    slim = counts.filter("n > 0").select("image_id", F.col("class").cast("int"), F.col("slot").cast("int"), F.struct(F.col("symbol").cast("int").alias("symbol"), F.col("n").cast("bigint").alias("n")).alias("s"))
    tables = slim.groupBy("image_id", "class", "slot").agg(F.sort_array(F.collect_list("s")).alias("s"))
    tables = tables.select("image_id", "class", "slot", "s.symbol", "s.n")

    def best(batches):
        for batch in batches:
            lengths = []
            for symbols, n in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                found = _code_lengths(symbols, n)
                lengths.append([found[s] for s in symbols])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths, pa.list_(pa.int32()))], names=[*batch.schema.names, "length"])

    entries = F.transform("symbol", lambda x, i: F.struct(x.alias("symbol"), F.get("n", i).alias("n"), F.get("length", i).alias("length")))
    coded = tables.mapInArrow(best, f"image_id {id_type}, class int, slot int, symbol array<int>, n array<bigint>, length array<int>")
    return coded.select("image_id", "class", "slot", F.inline(entries))


def table_symbols(lengths: DataFrame) -> DataFrame:
    """Symbols of each table in code order: by length, then value. A table has at most 256 symbols."""
    w = Window.partitionBy("image_id", "class", "slot").orderBy("length", "symbol")
    return lengths.withColumn("rank", F.row_number().over(w) - 1)


def standard_lengths(spark: SparkSession) -> DataFrame:
    """Code lengths of the standard tables: 348 fixed rows."""
    tables = (
        (0, 0, fixed.DC_LUMA_COUNTS, fixed.DC_SYMBOLS), (0, 1, fixed.DC_CHROMA_COUNTS, fixed.DC_SYMBOLS),
        (1, 0, fixed.AC_LUMA_COUNTS, fixed.AC_LUMA_SYMBOLS), (1, 1, fixed.AC_CHROMA_COUNTS, fixed.AC_CHROMA_SYMBOLS),
    )
    rows = []
    for cls, slot, counts, symbols in tables:
        lengths = [i + 1 for i, n in enumerate(counts) for _ in range(n)]
        rows += [(cls, slot, s, n) for s, n in zip(symbols, lengths)]
    return spark.createDataFrame(rows, "class int, slot int, symbol int, length int")


def extra_bits(symbol, progressive_ac: bool = False) -> Column:
    """Bits that follow a symbol: its category, or the run bits of a progressive end-of-block symbol."""
    s = col(symbol)
    low = s.bitwiseAND(15)
    if not progressive_ac:
        return low
    return F.when((low == 0) & (s < 0xF0), F.shiftright(s, 4)).otherwise(low)


def coded_size(counts: DataFrame, lengths: DataFrame, progressive_ac: bool = False) -> DataFrame:
    """Bits per image under a set of code lengths; ``uncodable`` counts symbols the tables lack.

    ``lengths`` is keyed by ``class, slot, symbol`` (one table set) or by image as well. Whether it is small enough to be sent to
    all tasks is left to the optimizer, which knows its size.
    """
    keys = [k for k in ("image_id", "class", "slot", "symbol") if k in lengths.columns]
    j = counts.join(lengths, keys, "left")
    bits = F.col("n") * (F.col("length") + extra_bits("symbol", progressive_ac))
    return j.groupBy("image_id").agg(
        F.coalesce(F.sum(bits), F.lit(0)).alias("bits"),
        F.coalesce(F.sum(F.when(F.col("length").isNull(), F.col("n"))), F.lit(0)).alias("uncodable"),
    )


def encoding_report(blocks: DataFrame, comps: DataFrame, chunk: float = 65536) -> DataFrame:
    """Size of every image under the standard and its own best tables, and the saving.

    ``blocks`` needs ``pos, h, v`` (see ``scan_position``); ``comps``: ``image_id, ci, dc_table, ac_table``. All heavy
    steps end in partial counts; what is joined afterwards is at most a few hundred rows per image. Symbols of components that
    ``comps`` does not list, which have no standard table, are among the ``uncodable`` and in ``optimal_bits`` as one more table,
    like those of slots without a standard table.
    """
    counts = dc_symbol_counts(dc_diff(blocks, chunk=chunk), comps).unionByName(ac_symbol_counts(blocks, comps))
    # The counts flow once through both sets of lengths; sizing them apart would compute them again.
    best = optimal_lengths(counts).withColumnRenamed("length", "_best")
    both = best.join(F.broadcast(standard_lengths(blocks.sparkSession)), ["class", "slot", "symbol"], "left")
    extra = extra_bits("symbol")
    sized = both.groupBy("image_id").agg(
        F.coalesce(F.sum(F.col("n") * (F.col("length") + extra)), F.lit(0)).alias("standard_bits"),
        F.sum(F.col("n") * (F.col("_best") + extra)).alias("optimal_bits"),
        F.coalesce(F.sum(F.when(F.col("length").isNull(), F.col("n"))), F.lit(0)).alias("uncodable"),
    )
    return sized.withColumn("saved_bits", F.col("standard_bits") - F.col("optimal_bits"))
