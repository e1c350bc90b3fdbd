"""Frame and scan geometry, table lookups in file order, and output parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import ceil_div, col
from .ordered import last_known


def max_sampling(comps: DataFrame) -> DataFrame:
    return comps.groupBy("image_id").agg(
        F.greatest(F.max("h"), F.lit(1)).alias("max_h"), F.greatest(F.max("v"), F.lit(1)).alias("max_v")
    )


def component_geometry(frames: DataFrame, comps: DataFrame) -> DataFrame:
    """Sizes of every component in blocks and samples.

    ``frames`` has one row per image: ``image_id, width, height, ncomp, progressive, scan_comps`` (components in
    the first scan). The three inputs meet on ``image_id`` and share one partitioning.
    """
    info = frames.select("image_id", "width", "height", "ncomp", "progressive", "scan_comps").join(
        max_sampling(comps), "image_id"
    )
    g = comps.join(info, "image_id")
    dct = fixed.DCT_SIZE
    return g.withColumns(
        {
            "blocks_w": ceil_div(F.col("width") * F.col("h"), F.col("max_h") * dct),
            "blocks_h": ceil_div(F.col("height") * F.col("v"), F.col("max_v") * dct),
            "samples_w": ceil_div(F.col("width") * F.col("h"), F.col("max_h")),
            "samples_h": ceil_div(F.col("height") * F.col("v"), F.col("max_v")),
            "imcu_rows": ceil_div(F.col("height"), F.col("max_v") * dct),
            "multi_scan": (F.col("scan_comps") < F.col("ncomp")) | F.col("progressive"),
        }
    )


def mcu_geometry(scans: DataFrame, geometry: DataFrame) -> DataFrame:
    """Unit layout of each component in each scan. ``scans``: ``image_id, scan_no, comps ARRAY<INT>``.

    A scan with one component is laid out block by block; otherwise a unit holds h x v blocks of each component.
    """
    members = scans.select("image_id", "scan_no", F.size("comps").alias("_n"), F.explode("comps").alias("ci"))
    j = members.join(geometry, ["image_id", "ci"])
    single = F.col("_n") == 1
    dct = fixed.DCT_SIZE
    rest = lambda size, s: F.when(F.col(size) % F.col(s) == 0, F.col(s)).otherwise(F.col(size) % F.col(s))
    return j.select(
        "image_id", "scan_no", "ci",
        F.when(single, F.col("blocks_w")).otherwise(ceil_div(F.col("width"), F.col("max_h") * dct)).alias("mcus_per_row"),
        F.when(single, F.col("blocks_h")).otherwise(ceil_div(F.col("height"), F.col("max_v") * dct)).alias("mcu_rows"),
        F.when(single, F.lit(1)).otherwise(F.col("h")).alias("mcu_w"),
        F.when(single, F.lit(1)).otherwise(F.col("v")).alias("mcu_h"),
        F.when(single, F.lit(1)).otherwise(F.col("h") * F.col("v")).alias("mcu_blocks"),
        F.when(single, F.lit(dct)).otherwise(F.col("h") * dct).alias("mcu_sample_w"),
        F.when(single, F.lit(1)).otherwise(rest("blocks_w", "h")).alias("last_col_w"),
        rest("blocks_h", "v").alias("last_row_h"),
    )


def mcu_blocks(scans: DataFrame, comps: DataFrame) -> DataFrame:
    """Blocks per unit of each scan; more than ten is an error in an interleaved scan."""
    members = scans.select("image_id", "scan_no", F.explode("comps").alias("ci"))
    joined = members.join(comps.select("image_id", "ci", "h", "v"), ["image_id", "ci"])
    out = joined.groupBy("image_id", "scan_no").agg(F.count("*").alias("n"), F.sum(F.col("h") * F.col("v")).alias("_b"))
    blocks = F.when(F.col("n") == 1, F.lit(1)).otherwise(F.col("_b"))
    return out.select("image_id", "scan_no", blocks.alias("blocks")).withColumn(
        "too_many", F.col("blocks") > fixed.MAX_BLOCKS_IN_MCU
    )


def latch_qtables(comps: DataFrame, scans: DataFrame, qtables: DataFrame, chunk: float = 65536) -> DataFrame:
    """The table each component uses: the last definition of its slot before its first scan.

    ``scans``: ``image_id, ci, seq``; ``qtables``: ``image_id, slot, seq, q``. Definitions and first scans are put
    on one time line per slot and the last definition is carried forward, so no pairs are formed.
    """
    first = scans.groupBy("image_id", "ci").agg(F.min("seq").alias("seq"))
    asked = comps.select("image_id", "ci", F.col("tq").alias("slot")).join(first, ["image_id", "ci"])
    line = asked.select("image_id", "slot", "seq", "ci", F.lit(None).cast(qtables.schema["q"].dataType).alias("q")).unionByName(
        qtables.select("image_id", "slot", "seq", F.lit(None).cast("int").alias("ci"), "q")
    )
    known = last_known(line, ["image_id", "slot"], ["seq"], {"q": "_q"}, chunk)
    return known.filter("ci IS NOT NULL").select("image_id", "ci", F.col("slot").alias("tq"), F.col("_q").alias("q"))


def latch_htables(scans: DataFrame, htables: DataFrame, chunk: float = 65536) -> DataFrame:
    """The entropy table in force for each scan, class and slot.

    ``scans``: ``image_id, scan_no, seq, comps ARRAY<STRUCT<dc, ac>>, ss, se, ah``. A DC table is asked for by first
    DC passes, an AC table by scans that reach past the first coefficient.
    """
    dc = F.when((F.col("ss") == 0) & (F.col("ah") == 0), F.transform("comps", lambda c: F.struct(F.lit(0).alias("class"), c["dc"].alias("slot"))))
    ac = F.when(F.col("se") > 0, F.transform("comps", lambda c: F.struct(F.lit(1).alias("class"), c["ac"].alias("slot"))))
    none = F.array().cast("array<struct<class:int,slot:int>>")
    wanted = F.array_distinct(F.concat(F.coalesce(dc, none), F.coalesce(ac, none)))
    asked = scans.select("image_id", "scan_no", "seq", F.inline(wanted))
    table = F.struct(F.col("bits"), F.col("vals"))
    defined = htables.select("image_id", "class", "slot", "seq", F.lit(None).cast("int").alias("scan_no"), table.alias("_t"))
    line = asked.select("image_id", "class", "slot", "seq", F.col("scan_no").cast("int"), F.lit(None).cast(defined.schema["_t"].dataType).alias("_t"))
    known = last_known(line.unionByName(defined), ["image_id", "class", "slot"], ["seq"], {"_t": "_k"}, chunk)
    return known.filter("scan_no IS NOT NULL").select("image_id", "scan_no", "class", "slot", "_k.bits", "_k.vals")


def needed_components(comps: DataFrame, out_space: str) -> DataFrame:
    """Components an output needs; gray output drops chroma. The filter reaches the table scan."""
    return comps.filter(F.col("ci") == 0) if out_space == "gray" else comps


# --- output parameters -------------------------------------------------------------------------------


def default_components(spark: SparkSession) -> DataFrame:
    """Template rows: ``color_space, ci, component_id, h, v, tq, entropy, write_jfif, write_adobe, jfif_major``."""
    rows = spark.createDataFrame(
        list(fixed.DEFAULT_COMPONENTS), "color_space string, ci int, component_id int, h int, v int, tq int, entropy int"
    )
    space = F.col("color_space")
    return rows.withColumns(
        {
            "write_jfif": space.isin("gray", "ycc", "bg_rgb", "bg_ycc"),
            "write_adobe": space.isin("rgb", "cmyk", "ycck"),
            "jfif_major": F.when(space.isin("bg_rgb", "bg_ycc"), 2).otherwise(1),
        }
    )


def with_default_components(frames: DataFrame, space: str = "color_space", from_rgb: bool = False) -> DataFrame:
    """Component rows for each image's colour space. The template has 21 fixed rows and is broadcast."""
    wanted = F.when(F.lit(from_rgb) & (F.col(space) == "rgb"), "ycc").otherwise(F.col(space))
    template = F.broadcast(default_components(frames.sparkSession).withColumnRenamed("color_space", "_space"))
    return frames.withColumn("_space", wanted).join(template, "_space").withColumnRenamed("_space", "target_space")


def sof_type(arithmetic, progressive, precision, block_size, max_table, max_quant) -> Column:
    """Frame marker that an output gets."""
    plain = (col(precision) == 8) & (col(block_size) == 8) & (col(max_table) <= 1) & (col(max_quant) <= 255)
    return (
        F.when(col(arithmetic) & col(progressive), fixed.SOF10)
        .when(col(arithmetic), fixed.SOF9)
        .when(col(progressive), fixed.SOF2)
        .when(plain, fixed.SOF0)
        .otherwise(fixed.SOF1)
    )


def carry_parameters(frames: DataFrame, comps: DataFrame) -> DataFrame:
    """Output parameters of a transcoded image: ids, sampling and quantiser slots are kept, entropy slots are those
    of the colour space (0 outside it), the JFIF version is kept only if its major number is 1 or 2.

    ``frames``: one row per image, ``image_id, color_space, saw_jfif, major, minor, unit, x_density, y_density``.
    """
    template = default_components(comps.sparkSession).select("color_space", "ci", "entropy", "jfif_major")
    j = comps.join(frames, "image_id").join(F.broadcast(template), ["color_space", "ci"], "left")
    keep = F.col("saw_jfif") & F.col("major").isin(1, 2)
    return j.select(
        "image_id", "ci", "component_id", "h", "v", "tq",
        F.coalesce("entropy", F.lit(0)).alias("entropy"),
        F.when(keep, F.col("major")).otherwise(F.coalesce("jfif_major", F.lit(1))).alias("out_major"),
        F.when(keep, F.col("minor")).otherwise(F.lit(1)).alias("out_minor"),
        F.when(F.col("saw_jfif"), F.col("unit")).otherwise(F.lit(0)).alias("out_unit"),
        F.when(F.col("saw_jfif"), F.col("x_density")).otherwise(F.lit(1)).alias("out_x"),
        F.when(F.col("saw_jfif"), F.col("y_density")).otherwise(F.lit(1)).alias("out_y"),
    )


def dqt_precision(used: DataFrame) -> DataFrame:
    """Tables to send, each slot once: 16-bit if any value is over 255. ``used``: ``image_id, slot, q``."""
    once = used.groupBy("image_id", "slot").agg(F.max_by("q", F.array_max("q")).alias("q"))
    return once.withColumn("bits", F.when(F.exists("q", lambda x: x > 255), 16).otherwise(8))
