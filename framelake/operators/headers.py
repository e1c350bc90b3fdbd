"""Typed tables out of header segments. All are narrow projections of ``segments``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import headers as h
from ..functions.exprs import col, starts_with


def segments(images: DataFrame) -> DataFrame:
    """One row per header marker: ``image_id, seq, offset, marker, length, discarded, payload``."""
    walked = images.select("image_id", h.segment_array("content").alias("_segs"))
    rows = walked.select("image_id", F.posexplode_outer("_segs").alias("seq", "_s"))
    # Outer form plus a filter on its output: an inner explode would walk every file again to pre-filter.
    return rows.select("image_id", "seq", "_s.*").filter("marker IS NOT NULL")


def frames(segs: DataFrame) -> DataFrame:
    found = segs.filter(F.col("marker").isin(*fixed.SUPPORTED_SOF))
    return found.select("image_id", "seq", h.sof("marker", "payload").alias("_f")).select("image_id", "seq", "_f.*")


def components(frame_rows: DataFrame) -> DataFrame:
    return frame_rows.select("image_id", F.inline_outer("components")).filter("ci IS NOT NULL")


def scans(segs: DataFrame) -> DataFrame:
    """Scan headers; ``scan_no`` counts them per image in file order (a header walk has one)."""
    found = segs.filter(F.col("marker") == fixed.SOS)
    return found.select("image_id", "seq", h.sos("payload").alias("_s")).select("image_id", "seq", "_s.*")


def qtables(segs: DataFrame, values: bool = True) -> DataFrame:
    found = segs.filter(F.col("marker") == fixed.DQT).select("image_id", "seq", h.dqt("payload", values).alias("_t"))
    return found.select("image_id", "seq", F.inline_outer("_t")).filter("slot IS NOT NULL")


def htables(segs: DataFrame, values: bool = True) -> DataFrame:
    found = segs.filter(F.col("marker") == fixed.DHT).select("image_id", "seq", h.dht("payload", values).alias("_t"))
    return found.select("image_id", "seq", F.inline_outer("_t")).filter("slot IS NOT NULL")


def restart_intervals(segs: DataFrame) -> DataFrame:
    found = segs.filter(F.col("marker") == fixed.DRI)
    return found.select("image_id", "seq", h.restart_interval("payload").alias("restart"))


def jfif(segs: DataFrame) -> DataFrame:
    found = segs.filter(F.col("marker") == fixed.APP0)
    return found.select("image_id", "seq", h.jfif("payload").alias("_j")).select("image_id", "seq", "_j.*")


def adobe(segs: DataFrame) -> DataFrame:
    found = segs.filter(F.col("marker") == fixed.APP14)
    rows = found.select("image_id", "seq", h.adobe("payload").alias("_a")).select("image_id", "seq", "_a.*")
    return rows.filter("transform IS NOT NULL")


def colour_transforms(segs: DataFrame, frame_rows: DataFrame) -> DataFrame:
    """Whether each colour-transform segment is the accepted one. Joins one frame row per image."""
    found = segs.filter(F.col("marker") == fixed.LSE).select("image_id", "seq", "payload")
    ids = frame_rows.select("image_id", F.transform("components", lambda c: c["component_id"]).alias("_ids"))
    return found.join(ids, "image_id", "left").select(
        "image_id", "seq", h.colour_transform("payload", "_ids").alias("subtract_green")
    )


def exif_tags(segs: DataFrame) -> DataFrame:
    """EXIF tags: ``image_id, seq, ifd, tag, type, count, value_offset, values``; offsets are file positions."""
    found = segs.filter((F.col("marker") == fixed.APP1) & starts_with("payload", h.EXIF_PREFIX))
    rows = found.select("image_id", "seq", "offset", h.exif_array("payload").alias("_t"))
    return rows.select("image_id", "seq", "offset", F.inline_outer("_t")).filter("tag IS NOT NULL").withColumn(
        "value_offset", F.col("value_offset") + F.col("offset") + 4
    ).drop("offset")


def xmp_orientations(segs: DataFrame) -> DataFrame:
    found = segs.filter((F.col("marker") == fixed.APP1) & starts_with("payload", h.XMP_PREFIX))
    return found.select("image_id", "seq", h.xmp_orientation("payload").alias("xmp_orientation"))


def _saved(marker: Column) -> Column:
    return marker.between(fixed.APP0, fixed.APP15) | (marker == fixed.COM)


def exif_first(segs: DataFrame) -> DataFrame:
    """Per image: is the first saved segment an EXIF one? Partial minima keep the shuffle to one row each."""
    saved = segs.filter(_saved(F.col("marker"))).withColumn(
        "_exif", (F.col("marker") == fixed.APP1) & starts_with("payload", h.EXIF_PREFIX)
    )
    return saved.groupBy("image_id").agg(F.min_by("_exif", "seq").alias("exif_first"))


def keep_markers(segs: DataFrame, option: str) -> DataFrame:
    """Copy policy: ``none``, ``comments`` (comments only) or ``all`` (comments and application segments)."""
    m = F.col("marker")
    keep = {"none": F.lit(False), "comments": m == fixed.COM, "all": _saved(m)}[option]
    return segs.filter(keep)


def drop_rewritten(segs: DataFrame, flags: DataFrame) -> DataFrame:
    """Drop the JFIF / Adobe segments that the writer will write itself.

    ``flags``: one row per image, ``image_id, write_jfif, write_adobe``.
    """
    joined = segs.join(flags.select("image_id", "write_jfif", "write_adobe"), "image_id", "left")
    dup_jfif = F.col("write_jfif") & (F.col("marker") == fixed.APP0) & starts_with("payload", b"JFIF\0")
    dup_adobe = F.col("write_adobe") & (F.col("marker") == fixed.APP14) & starts_with("payload", b"Adobe")
    return joined.filter(~F.coalesce(dup_jfif | dup_adobe, F.lit(False))).select(*segs.columns)


def infer_colorspace(ncomp, ids, saw_jfif, adobe_transform) -> Column:
    """Colour space guess from component count, ids, and JFIF / Adobe segments; ``warning`` on odd Adobe codes."""
    n, i, t = col(ncomp), col(ids), col(adobe_transform)
    jfif_seen = F.coalesce(col(saw_jfif), F.lit(False))

    def has(*want: int) -> Column:
        return F.coalesce((F.size(i) == 3) & (F.array_join(i.cast("array<string>"), ",") == ",".join(map(str, want))), F.lit(False))

    three = (
        F.when(has(0x01, 0x02, 0x03), "ycc")
        .when(has(0x01, 0x22, 0x23), "bg_ycc")
        .when(has(0x52, 0x47, 0x42), "rgb")
        .when(has(0x72, 0x67, 0x62), "bg_rgb")
        .when(jfif_seen, "ycc")
        .when(t == 0, "rgb")
        .otherwise("ycc")
    )
    by_id = has(0x01, 0x02, 0x03) | has(0x01, 0x22, 0x23) | has(0x52, 0x47, 0x42) | has(0x72, 0x67, 0x62)
    four = F.when(t.isNull() | (t == 0), "cmyk").otherwise("ycck")
    odd3 = (n == 3) & ~by_id & ~jfif_seen & t.isNotNull() & ~t.isin(0, 1)
    odd4 = (n == 4) & t.isNotNull() & ~t.isin(0, 2)
    return F.struct(
        F.when(n == 1, "gray").when(n == 3, three).when(n == 4, four).otherwise("unknown").alias("space"),
        F.coalesce(odd3 | odd4, F.lit(False)).alias("warning"),
    )


def _listed_tags(lead: Column) -> Column:
    """The tags of all EXIF segments of ``_segs`` as one array. ``lead``: where the first saved segment starts."""
    numbered = F.transform("_segs", lambda s, i: F.struct(i.alias("seq"), s["offset"].alias("offset"), s["marker"].alias("marker"), s["payload"].alias("payload")))
    exif = F.filter(numbered, lambda s: (s["marker"] == fixed.APP1) & starts_with(s["payload"], h.EXIF_PREFIX))

    def rows(s: Column) -> Column:
        def row(t: Column) -> Column:
            same = [t[c].alias(c) for c in ("ifd", "tag", "type", "count")]
            return F.struct(s["seq"].alias("seq"), *same, (t["value_offset"] + s["offset"] + 4).alias("value_offset"), t["values"].alias("values"), (s["offset"] == lead).alias("leads"))

        return F.transform(h.exif_array(s["payload"]), row)

    return F.flatten(F.filter(F.transform(exif, rows), lambda t: t.isNotNull()))


def image_headers(images: DataFrame, tags: bool = False) -> DataFrame:
    """One row per image straight from the bytes, with no shuffle: frame, orientations, colour space.

    Feeds the rotation plan: ``image_id, width, height, ncomp, max_h, max_v, exif_orientation, xmp_orientation,
    orientation_offset, big_endian, color_space, has_exif_first, xmp_offset, xmp_length`` (NULL sizes if there is no usable
    frame; the last two say where the digits of the XMP orientation stand in the file). With ``tags`` also ``exif_tags``, the
    rows of the table of that name as an array; ``leads`` marks those of a segment that is the first saved one.
    """
    extra = [c for c in images.columns if c not in ("content", "image_id")]
    files = images.filter(starts_with("content", b"\xff\xd8"))
    seg = files.select("image_id", *extra, h.segment_array("content").alias("_segs"))

    def first(*markers: int) -> Column:
        return F.get(F.filter("_segs", lambda s: s["marker"].isin(*markers)), F.lit(0))

    def app1(prefix: bytes) -> Column:
        return F.get(
            F.filter("_segs", lambda s: (s["marker"] == fixed.APP1) & starts_with(s["payload"], prefix)), F.lit(0)
        )

    adobes = F.transform(F.filter("_segs", lambda s: s["marker"] == fixed.APP14), lambda s: h.adobe(s["payload"]))
    lead = F.get(F.filter("_segs", lambda s: _saved(s["marker"])), F.lit(0))
    parts = seg.select(
        "image_id", *extra,
        first(*fixed.SUPPORTED_SOF).alias("_sof"), app1(h.EXIF_PREFIX).alias("_exif"), app1(h.XMP_PREFIX).alias("_xmp"), lead.alias("_first"),
        F.exists("_segs", lambda s: (s["marker"] == fixed.APP0) & (h.jfif(s["payload"])["kind"] == "jfif")).alias("_jfif"),
        F.get(F.filter(adobes, lambda a: a.isNotNull()), F.lit(0))["transform"].alias("_adobe"),
        *([_listed_tags(lead["offset"]).alias("exif_tags")] if tags else []),
    )
    decoded = parts.select(
        "*", h.sof("_sof.marker", "_sof.payload").alias("_f"), h.exif_array("_exif.payload").alias("_tags")
    )
    tag = F.get(F.filter("_tags", lambda t: (t["ifd"] == "ifd0") & (t["tag"] == fixed.TAG_ORIENTATION)), F.lit(0))
    sampling = lambda name: F.array_max(F.transform("_f.components", lambda c: c[name]))
    ids = F.transform("_f.components", lambda c: c["component_id"])
    row = F.struct(
        F.col("_f.width"), F.col("_f.height"), F.col("_f.ncomp"), F.col("_f.progressive"),
        sampling("h").alias("max_h"), sampling("v").alias("max_v"),
        F.coalesce(F.get(tag["values"], F.lit(0)), F.lit(0)).bitwiseAND(255).cast("int").alias("exif_orientation"),
        F.coalesce(h.xmp_orientation("_xmp.payload"), F.lit(0)).alias("xmp_orientation"),
        (tag["value_offset"] + F.col("_exif.offset") + 4).alias("orientation_offset"),
        h.exif_big_endian("_exif.payload").alias("big_endian"),
        infer_colorspace("_f.ncomp", ids, "_jfif", "_adobe")["space"].alias("color_space"),
        F.coalesce((F.col("_first.marker") == fixed.APP1) & starts_with("_first.payload", h.EXIF_PREFIX), F.lit(False))
        .alias("has_exif_first"),
        (h.xmp_digits("_xmp.payload")["at"] + F.col("_xmp.offset") + 4).alias("xmp_offset"),
        h.xmp_digits("_xmp.payload")["length"].alias("xmp_length"),
        *([F.col("exif_tags")] if tags else []),
    )
    # A one-row generator: later filters on these columns stop here instead of repeating the walk below it.
    return decoded.select("image_id", *extra, F.inline_outer(F.array(row)))
