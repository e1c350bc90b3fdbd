"""Progressive scripts: building, shrinking, checking, and what they leave known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .ordered import previous, running_sum

SCAN_TYPE = "array<struct<comps:array<int>,ss:int,se:int,ah:int,al:int>>"


def _scan(comps: Column, ss: int, se: int, ah: int, al: int) -> Column:
    return F.struct(
        comps.alias("comps"), F.lit(ss).alias("ss"), F.lit(se).alias("se"), F.lit(ah).alias("ah"), F.lit(al).alias("al")
    )


def progressive_script(frames: DataFrame) -> DataFrame:
    """Recommended scans of every image (``ncomp, color_space``): a projection and an explode, no join.

    Three-component luma/chroma images get the fixed ten scans. Others get, for every component, two DC and four
    AC passes, the DC passes interleaved for up to four components.
    """
    n = F.col("ncomp")
    all_comps = F.sequence(F.lit(0), n - 1)

    def each(ss, se, ah, al) -> Column:
        return F.transform(all_comps, lambda c: _scan(F.array(c), ss, se, ah, al)).cast(SCAN_TYPE)

    def dc(ah, al) -> Column:
        together = F.array(_scan(all_comps, 0, 0, ah, al)).cast(SCAN_TYPE)
        return F.when(n <= 4, together).otherwise(each(0, 0, ah, al))

    general = F.concat(
        dc(0, 1), each(1, 5, 0, 2), each(6, 63, 0, 2), each(1, 63, 2, 1), dc(1, 0), each(1, 63, 1, 0)
    )
    ycc = F.array(
        *[_scan(F.array(*[F.lit(c) for c in comps]), *rest) for comps, *rest in fixed.YCC_SCRIPT]
    ).cast(SCAN_TYPE)
    script = F.when((n == 3) & F.col("color_space").isin("ycc", "bg_ycc"), ycc).otherwise(general)
    return frames.select("image_id", F.posexplode(script).alias("scan_no", "_s")).select("image_id", "scan_no", "_s.*")


def reduce_script(scans: DataFrame, limit: int, chunk: float = 65536) -> DataFrame:
    """Script for smaller blocks: scans that start past the limit go, ends are cut to it, numbers close up."""
    kept = scans.filter(F.col("ss") <= limit).withColumn("se", F.least("se", F.lit(limit))).withColumn("_one", F.lit(1))
    numbered = running_sum(kept, ["image_id"], ["scan_no"], {"_one": "_n"}, chunk)
    return numbered.withColumn("scan_no", (F.col("_n") - 1).cast("int")).select(*scans.columns)


def _ranges(scans: DataFrame) -> DataFrame:
    """One row per component and stretch of coefficients, ``from`` to ``to``, that a scan sends.

    The coefficients of a component are cut only where one of its scans starts or ends, so scans that overlap have whole
    stretches in common. A component has at most 65 such places in a valid script.
    """
    members = scans.withColumn("ci", F.explode("comps")).filter(F.col("se") >= F.col("ss"))
    ends = members.select("image_id", "ci", F.explode(F.array(F.col("ss"), F.col("se") + 1)).alias("_at"))
    cuts = ends.groupBy("image_id", "ci").agg(F.sort_array(F.collect_set("_at")).alias("_cuts"))
    within = F.filter("_cuts", lambda c: (c >= F.col("ss")) & (c <= F.col("se")))
    after = lambda c: F.array_min(F.filter("_cuts", lambda d: d > c)) - 1
    stretches = F.transform(within, lambda c: F.struct(c.alias("from"), after(c).alias("to")))
    return members.join(cuts, ["image_id", "ci"]).select(*members.columns, F.inline(stretches))


def script_violations(scans: DataFrame, chunk: float = 65536) -> DataFrame:
    """Scans that a progressive script may not contain: ``image_id, scan_no, issue``.

    ``bad_range``: spectral range or bit positions out of bounds, DC and AC mixed, or AC of several components;
    ``bad_order``: components out of order; ``ac_before_dc``; ``bad_bits``: the first pass of a coefficient must have
    previous position 0, each later one must continue one below the pass before.
    """
    ss, se, ah, al = F.col("ss"), F.col("se"), F.col("ah"), F.col("al")
    n = F.size("comps")
    out_of_range = (
        ~ss.between(0, 63) | (se < ss) | (se > 63) | ~ah.between(0, 10) | ~al.between(0, 10)
        | F.when(ss == 0, se != 0).otherwise(n != 1)
    )
    unordered = F.exists(F.sequence(F.lit(1), n), lambda i: F.get("comps", i) <= F.get("comps", i - 1))
    own = scans.select(
        "image_id", "scan_no",
        F.explode_outer(F.array(F.when(out_of_range, "bad_range"), F.when((n > 1) & unordered, "bad_order"))).alias("issue"),
    ).filter("issue IS NOT NULL")
    members = scans.withColumn("ci", F.explode("comps"))
    first_dc = members.filter("ss = 0").groupBy("image_id", "ci").agg(F.min("scan_no").alias("_dc"))
    early = (
        members.filter("ss > 0").join(first_dc, ["image_id", "ci"], "left")
        .filter(F.col("_dc").isNull() | (F.col("_dc") > F.col("scan_no")))
        .select("image_id", "scan_no", F.lit("ac_before_dc").alias("issue"))
    )
    seen = previous(_ranges(scans), ["image_id", "ci", "from"], ["scan_no"], {"al": "_al"}, chunk)
    broken = F.when(F.col("_al").isNull(), ah != 0).otherwise((ah != F.col("_al")) | (al != ah - 1))
    bits = seen.filter(broken).select("image_id", "scan_no", F.lit("bad_bits").alias("issue"))
    return own.unionByName(early).unionByName(bits).distinct()


def script_coverage(scans: DataFrame, comps: DataFrame, progressive: bool) -> DataFrame:
    """Whether every component is sent: its DC at least (progressive), or in exactly one scan (sequential)."""
    members = scans.withColumn("ci", F.explode("comps"))
    seen = members.groupBy("image_id", "ci").agg(F.count("*").alias("_n"), F.count_if(F.col("ss") == 0).alias("_dc"))
    j = comps.select("image_id", "ci").join(seen, ["image_id", "ci"], "left")
    ok = F.coalesce(F.col("_dc") > 0 if progressive else F.col("_n") == 1, F.lit(False))
    return j.select("image_id", "ci", ok.alias("ok"))


def coef_accuracy(scans: DataFrame, comps: DataFrame) -> DataFrame:
    """Bit position each coefficient is known to, -1 if never sent: ``image_id, ci, coef, al``.

    The never-sent default is one more pass in front of the others. Of the passes of a component over the same range the last
    stays, so a valid script leaves 2,080 at most; these are one array, which is cut where a pass starts or ends. Single
    coefficients are only told at the very end.
    """
    members = scans.filter(F.col("se") >= F.col("ss")).withColumn("ci", F.explode("comps")).filter("image_id IS NOT NULL AND ci IS NOT NULL")
    last = members.groupBy("image_id", "ci", "ss", "se").agg(F.max_by("al", "scan_no").alias("al"), F.max("scan_no").alias("scan_no"))
    never = comps.select("image_id", "ci", F.lit(0).alias("ss"), F.lit(63).alias("se"), F.lit(-1).alias("al"), F.lit(-1).alias("scan_no"))
    # Sent as they are: a group of its own per component and task would only fill memory.
    passes = last.unionByName(never).repartition("image_id", "ci")
    newest = F.sort_array(F.collect_set(F.struct("scan_no", "ss", "se", "al")), asc=False)
    known = passes.groupBy("image_id", "ci").agg(newest.alias("_p"))
    ends = F.flatten(F.transform("_p", lambda p: F.array(p["ss"], p["se"] + 1)))
    known = known.withColumn("_cuts", F.array_sort(F.array_distinct(ends)))

    def stretch(start: Column, i: Column) -> Column:
        sent = F.get(F.filter("_p", lambda p: (p["ss"] <= start) & (p["se"] >= start)), F.lit(0))
        return F.struct(start.alias("_from"), (F.get("_cuts", i + 1) - 1).alias("_to"), sent.alias("_sent"))

    stretches = F.filter(F.transform("_cuts", stretch), lambda t: t["_sent"].isNotNull())
    # The outer form keeps the optimizer from cutting the array a second time in a filter in front.
    told = known.select("image_id", "ci", F.explode_outer(stretches).alias("_t")).filter("_t IS NOT NULL")
    told = told.select("image_id", "ci", "_t._from", "_t._to", F.col("_t._sent.al").alias("al"))
    return told.select("image_id", "ci", F.explode_outer(F.sequence("_from", "_to")).alias("coef"), "al")


def smoothing_ok(accuracy: DataFrame, latched: DataFrame) -> DataFrame:
    """Whether block smoothing helps an image: all six low quantisers non-zero and DC known in every component, and
    at least one of the first five AC coefficients not exact. Of a table only the verdict moves, not its 64 values."""
    low = accuracy.filter(F.col("coef") <= 5).groupBy("image_id", "ci").agg(
        F.min(F.when(F.col("coef") == 0, F.col("al"))).alias("_dc"),
        F.max((F.col("coef") > 0) & (F.col("al") != 0)).alias("_inexact"),
    )
    zero = F.exists(F.array(*[F.get("q", F.lit(i)) for i in (0, 1, 8, 16, 9, 2)]), lambda x: x == 0)
    tables = latched.select("image_id", "ci", (F.col("q").isNotNull() & ~zero).alias("_divides"))
    joined = low.join(tables, ["image_id", "ci"], "left")
    usable = F.col("_divides") & (F.col("_dc") >= 0)
    return joined.groupBy("image_id").agg(
        (F.bool_and(F.coalesce(usable, F.lit(False))) & F.bool_or("_inexact")).alias("smoothing_ok")
    )


def preview_levels(scans: DataFrame) -> DataFrame:
    """Every third level of a progressive image, with its label."""
    total = scans.groupBy("image_id").agg(F.count("*").alias("_n"))
    kept = scans.filter(F.col("scan_no") % 3 == 0).select("image_id", F.col("scan_no").alias("level"))
    label = F.concat_ws("/", F.col("level").cast("string"), (F.col("_n") - 1).cast("string"))
    return kept.join(total, "image_id").select("image_id", "level", label.alias("label"))
