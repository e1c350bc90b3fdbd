"""Structure checks: every finding is a row ``image_id, issue, severity``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import headers as h
from ..functions.exprs import col, starts_with, u8
from ..session import stored

ISSUE_COLUMNS = ["image_id", "issue", "severity"]


def _rows(df: DataFrame, conditions: dict[str, Column], severity: str) -> DataFrame:
    """One row per input row and condition that holds."""
    hits = F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()])
    listed = df.select("image_id", F.explode_outer(hits).alias("issue")).filter("issue IS NOT NULL")
    return listed.withColumn("severity", F.lit(severity))


def frame_issues(frames: DataFrame) -> DataFrame:
    """Checks of the frame header. Needs the columns of ``headers.frames``."""
    odd = F.exists("components", lambda c: ~c["h"].between(1, fixed.MAX_SAMPLING) | ~c["v"].between(1, fixed.MAX_SAMPLING))
    return _rows(
        frames,
        {
            "empty_image": (F.col("width") <= 0) | (F.col("height") <= 0) | (F.col("ncomp") <= 0),
            "too_big": (F.col("width") > fixed.MAX_DIMENSION) | (F.col("height") > fixed.MAX_DIMENSION),
            "bad_precision": ~F.col("precision").between(8, 12),
            "component_count": F.col("ncomp") > fixed.MAX_COMPONENTS,
            "bad_sampling": odd,
            "bad_frame_length": F.col("length") != F.col("ncomp") * 3 + 8,
        },
        "error",
    ).distinct()  # an image may have several frame headers


def structure_issues(segs: DataFrame) -> DataFrame:
    """Checks of marker order and table segments. Counts are partial before the shuffle: one row per image and task."""
    m, p = F.col("marker"), F.col("payload")
    # Tables are read once, as columns of their own, and without the values that no check looks at.
    segs = segs.withColumns({"_dqt": F.when(m == fixed.DQT, h.dqt("payload", values=False)), "_dht": F.when(m == fixed.DHT, h.dht("payload", values=False))})
    is_sof = m.isin(*fixed.SUPPORTED_SOF)
    needs_length = ~(m.between(fixed.RST0, fixed.EOI) | (m == fixed.TEM))
    reserved = ((m < fixed.SOF0) & (m != fixed.TEM)) | (m.between(0xF0, 0xFD) & (m != fixed.LSE))
    dqt, dht = F.col("_dqt"), F.col("_dht")
    total = lambda t: F.aggregate(t["bits"], F.lit(0), lambda a, b: a + b)
    used = F.aggregate(dht, F.lit(0), lambda a, t: a + total(t) + 17)
    marked = segs.select(
        "image_id", "seq", is_sof.alias("sof"), (m == fixed.SOI).alias("soi"), (m == fixed.SOS).alias("sos"),
        (needs_length & (F.col("length").isNull() | (F.col("length") < 2))).alias("bad_length"),
        reserved.alias("reserved"),
        m.isin(*fixed.UNSUPPORTED_SOF).alias("unsupported"),
        F.exists(dqt, lambda t: t["slot"] >= fixed.TABLE_SLOTS).alias("dqt_slot"),
        F.exists(dht, lambda t: t["slot"] >= fixed.TABLE_SLOTS).alias("dht_slot"),
        (F.exists(dht, lambda t: total(t) > 256) | (used > F.length(p))).alias("dht_count"),
        ((m == fixed.DRI) & (F.length(p) != 2)).alias("dri_length"),
        ((m == fixed.SOS) & ~F.coalesce(h.sos("payload")["ok"], F.lit(False))).alias("sos_length"),
    )
    flags = ["bad_length", "reserved", "unsupported", "dqt_slot", "dht_slot", "dht_count", "dri_length", "sos_length"]
    per = marked.groupBy("image_id").agg(
        F.count_if("sof").alias("n_sof"), F.count_if("soi").alias("n_soi"), F.count_if("sos").alias("n_sos"),
        F.min(F.when(F.col("sof"), F.col("seq"))).alias("at_sof"), F.min(F.when(F.col("sos"), F.col("seq"))).alias("at_sos"),
        *[F.bool_or(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags],
    )
    late = F.col("at_sof").isNull() | (F.col("at_sof") > F.col("at_sos"))
    return _rows(
        per,
        {
            "sof_duplicate": F.col("n_sof") > 1,
            "soi_duplicate": F.col("n_soi") > 1,
            "sos_before_sof": (F.col("n_sos") > 0) & late,
            "sof_without_sos": (F.col("n_sos") == 0) & (F.col("n_sof") > 0),
            "no_image": (F.col("n_sos") == 0) & (F.col("n_sof") == 0),
            "reserved_marker": F.col("reserved"),
            "unsupported_frame": F.col("unsupported"),
            "bad_length": F.col("bad_length"),
            "dqt_slot": F.col("dqt_slot"),
            "dht_slot": F.col("dht_slot"),
            "dht_count": F.col("dht_count"),
            "dri_length": F.col("dri_length"),
            "sos_length": F.col("sos_length"),
        },
        "error",
    )


def scan_parameter_issue(progressive, baseline, ncomp, ss, se, ah, al, limit=63) -> Column:
    """``bad_progression`` (error), ``not_sequential`` (warning) or NULL for one scan header."""
    ss, se, ah, al, limit = col(ss), col(se), col(ah), col(al), col(limit)
    bad = (
        F.when(ss == 0, se != 0).otherwise((se < ss) | (se > limit) | (col(ncomp) != 1))
        | ((ah != 0) & (al != ah - 1))
        | (al > 13)
    )
    odd = (ss != 0) | (ah != 0) | (al != 0) | ((col(baseline) | (se < 64)) & (se != limit))
    return F.when(col(progressive), F.when(bad, "bad_progression")).otherwise(F.when(odd, "not_sequential"))


def scan_issues(scans: DataFrame, frames: DataFrame) -> DataFrame:
    """Checks of scan parameters against the frame kind. ``frames`` is one row per image."""
    kinds = frames.select("image_id", "progressive", "baseline")
    joined = scans.join(kinds, "image_id")
    issue = scan_parameter_issue("progressive", "baseline", "ncomp", "ss", "se", "ah", "al")
    rows = joined.select("image_id", issue.alias("issue")).filter("issue IS NOT NULL").distinct()
    return rows.withColumn("severity", F.when(F.col("issue") == "bad_progression", "error").otherwise("warning"))


def missing_tables(comps: DataFrame, qtables: DataFrame) -> DataFrame:
    """Components whose quantiser slot is never defined."""
    defined = qtables.select("image_id", F.col("slot").alias("tq")).distinct()
    return comps.join(defined, ["image_id", "tq"], "left_anti")


def slot_mismatch(comps: DataFrame, latched: DataFrame, qtables: DataFrame) -> DataFrame:
    """Components whose table in use differs from what its slot holds at the end: they cannot be transcoded."""
    final = qtables.groupBy("image_id", F.col("slot").alias("tq")).agg(F.max_by("q", "seq").alias("_final"))
    use = comps.select("image_id", "ci", "tq").join(latched.select("image_id", "ci", "q"), ["image_id", "ci"])
    return use.join(final, ["image_id", "tq"]).filter(F.col("q") != F.col("_final")).select("image_id", "ci", "tq")


def resync_action(found, expected) -> Column:
    """What to do with a wrong marker: 1 discard, 2 skip forward, 3 leave it for later."""
    f, e = col(found), col(expected)
    ahead = F.pmod(f - fixed.RST0 - e, F.lit(8))
    return (
        F.when(f < fixed.SOF0, 2)
        .when(~f.between(fixed.RST0, fixed.RST7), 3)
        .when(ahead.isin(1, 2), 3)
        .when(ahead.isin(6, 7), 2)
        .otherwise(1)
    )


def restart_gaps(markers: DataFrame, chunk: float = 65536) -> DataFrame:
    """Restart markers whose number does not follow its predecessor. ``markers``: ``image_id, seq, number``."""
    from .ordered import previous

    seen = previous(markers, ["image_id"], ["seq"], {"number": "_before"}, chunk)
    expected = F.coalesce(F.pmod(F.col("_before") + 1, F.lit(8)), F.lit(0))
    return seen.withColumn("expected", expected).filter(F.col("number") != F.col("expected")).select(
        "image_id", "seq", "number", "expected"
    )


def fix_component_ids(frames: DataFrame) -> DataFrame:
    """Repeated component ids become the largest id so far plus one.

    Works inside the component array of a frame (at most 255 entries), since each fix depends on the last.
    """

    ids = distinct_ids(F.transform("components", lambda c: c["component_id"]))
    return frames.select("image_id", F.posexplode(ids).alias("ci", "component_id"))


def distinct_ids(ids) -> Column:
    """Ids in order, each repeated one as the largest id so far plus one."""

    def step(done: Column, i: Column) -> Column:
        return F.concat(done, F.array(F.when(F.array_contains(done, i), F.array_max(done) + 1).otherwise(i)))

    return F.aggregate(ids, F.array().cast("array<int>"), step)


def scan_components(scans: DataFrame, frames: DataFrame) -> DataFrame:
    """The components that each scan names: ``image_id, seq, place, component_id, ci, dc, ac``.

    Repeated ids are told apart in the frame and in the scan by one rule: the largest id so far plus one. ``ci`` is null where a frame has
    no such component, and in images without a frame; of several frames of an image the first counts. A scan has four selectors
    at most and a frame 255 components, so both stay arrays until the end.
    """
    first = frames.groupBy("image_id").agg(F.min_by(F.transform("components", lambda c: c["component_id"]), "seq").alias("_ids"))
    joined = scans.select("image_id", "seq", "comps").join(first, "image_id", "left")
    joined = joined.withColumns({"_ids": distinct_ids("_ids"), "_named": distinct_ids(F.transform("comps", lambda c: c["component_id"]))})
    place = lambda i: F.when(F.array_contains("_ids", i), F.array_position("_ids", i) - 1).cast("int")
    told = F.zip_with("_named", "comps", lambda i, c: F.struct(i.alias("component_id"), place(i).alias("ci"), c["dc"].alias("dc"), c["ac"].alias("ac")))
    rows = joined.select("image_id", "seq", F.posexplode_outer(told).alias("place", "_c")).filter("place IS NOT NULL")
    return rows.select("image_id", "seq", "place", "_c.*")


def missing_huffman(scans: DataFrame, htables: DataFrame, frames: DataFrame) -> DataFrame:
    """Entropy tables that a scan needs and that no segment before it defines: ``image_id, scan_no, class, slot``.

    Needs what ``latch_htables`` needs. Scans of arithmetic-coded frames need none.
    """
    from .frames import latch_htables

    coded = frames.filter("arithmetic").select("image_id").distinct()
    needed = latch_htables(scans.join(coded, "image_id", "left_anti"), htables)
    return needed.filter(F.col("bits").isNull() | (F.col("slot") >= fixed.TABLE_SLOTS)).select("image_id", "scan_no", "class", "slot")


def all_issues(*tables: DataFrame) -> DataFrame:
    """One log out of any number of findings."""
    return reduce(lambda a, b: a.unionByName(b), [t.select(*ISSUE_COLUMNS) for t in tables])


def as_issues(rows: DataFrame, issue: str, severity: str) -> DataFrame:
    """Turn rows that name an image into findings."""
    return rows.select("image_id").distinct().withColumns({"issue": F.lit(issue), "severity": F.lit(severity)})


def file_audit(images: DataFrame) -> DataFrame:
    """All findings that the headers of each file give, and ``not_jpeg`` for other files. One scan, no shuffle.

    ``images``: ``image_id, content``. The same rules as ``corpus_audit``, over the header segments as one array per file.
    """
    good = F.coalesce(starts_with("content", b"\xff\xd8"), F.lit(False))
    seg = images.select("image_id", good.alias("_good"), h.segment_array("content").alias("_segs"))

    def each(*markers: int, body) -> Column:
        return F.transform(F.filter("_segs", lambda s: s["marker"].isin(*markers)), body)

    read = seg.select(
        "image_id", "_good", "_segs",
        each(*fixed.SUPPORTED_SOF, body=lambda s: h.sof(s["marker"], s["payload"])).alias("_sofs"),
        each(fixed.SOS, body=lambda s: h.sos(s["payload"])).alias("_scans"),
        each(fixed.DQT, body=lambda s: h.dqt(s["payload"])).alias("_dqts"),
        each(fixed.DHT, body=lambda s: F.struct(h.dht(s["payload"]).alias("tables"), F.length(s["payload"]).alias("size"))).alias("_dhts"),
    )
    total = lambda t: F.aggregate(t["bits"], F.lit(0), lambda a, b: a + b)
    slots = F.transform(F.flatten("_dqts"), lambda t: t["slot"])
    m_exists = lambda test: F.exists("_segs", test)
    alone = lambda m: m.between(fixed.RST0, fixed.EOI) | (m == fixed.TEM)
    place = lambda markers: F.array_min(F.transform(F.filter("_segs", lambda s: s["marker"].isin(*markers)), lambda s: s["offset"]))
    n_sos, n_sof = F.size("_scans"), F.size("_sofs")
    first = F.get("_sofs", F.lit(0))
    sampled = lambda c: c["h"].between(1, fixed.MAX_SAMPLING) & c["v"].between(1, fixed.MAX_SAMPLING)
    parameter = F.transform("_scans", lambda x: F.when(first.isNotNull(), scan_parameter_issue(first["progressive"], first["baseline"], x["ncomp"], x["ss"], x["se"], x["ah"], x["al"])))
    late = place(fixed.SUPPORTED_SOF).isNull() | (place(fixed.SUPPORTED_SOF) > place([fixed.SOS]))
    errors = {
        "empty_image": F.exists("_sofs", lambda f: (f["width"] <= 0) | (f["height"] <= 0) | (f["ncomp"] <= 0)),
        "too_big": F.exists("_sofs", lambda f: (f["width"] > fixed.MAX_DIMENSION) | (f["height"] > fixed.MAX_DIMENSION)),
        "bad_precision": F.exists("_sofs", lambda f: ~f["precision"].between(8, 12)),
        "component_count": F.exists("_sofs", lambda f: f["ncomp"] > fixed.MAX_COMPONENTS),
        "bad_sampling": F.exists("_sofs", lambda f: F.exists(f["components"], lambda c: ~sampled(c))),
        "bad_frame_length": F.exists("_sofs", lambda f: f["length"] != f["ncomp"] * 3 + 8),
        "sof_duplicate": n_sof > 1,
        "soi_duplicate": F.size(F.filter("_segs", lambda s: s["marker"] == fixed.SOI)) > 1,
        "sos_before_sof": (n_sos > 0) & late,
        "sof_without_sos": (n_sos == 0) & (n_sof > 0),
        "no_image": (n_sos == 0) & (n_sof == 0),
        "reserved_marker": m_exists(lambda s: ((s["marker"] < fixed.SOF0) & (s["marker"] != fixed.TEM)) | (s["marker"].between(0xF0, 0xFD) & (s["marker"] != fixed.LSE))),
        "unsupported_frame": m_exists(lambda s: s["marker"].isin(*fixed.UNSUPPORTED_SOF)),
        "bad_length": m_exists(lambda s: ~alone(s["marker"]) & (s["length"].isNull() | (s["length"] < 2))),
        "dqt_slot": F.exists(slots, lambda n: n >= fixed.TABLE_SLOTS),
        "dht_slot": F.exists("_dhts", lambda d: F.exists(d["tables"], lambda t: t["slot"] >= fixed.TABLE_SLOTS)),
        "dht_count": F.exists("_dhts", lambda d: F.exists(d["tables"], lambda t: total(t) > 256) | (F.aggregate(d["tables"], F.lit(0), lambda a, t: a + total(t) + 17) > d["size"])),
        "dri_length": m_exists(lambda s: (s["marker"] == fixed.DRI) & (F.length(s["payload"]) != 2)),
        "sos_length": F.exists("_scans", lambda x: ~F.coalesce(x["ok"], F.lit(False))),
        "bad_progression": F.array_contains(parameter, "bad_progression"),
        "missing_table": F.exists("_sofs", lambda f: F.exists(f["components"], lambda c: ~F.array_contains(slots, c["tq"]))),
    }
    warnings = {
        "not_sequential": F.array_contains(parameter, "not_sequential"),
        "jfif_version": m_exists(lambda s: (s["marker"] == fixed.APP0) & F.coalesce(h.jfif(s["payload"])["bad_version"], F.lit(False))),
        "jfif_thumbnail": m_exists(lambda s: (s["marker"] == fixed.APP0) & F.coalesce(h.jfif(s["payload"])["bad_thumbnail"], F.lit(False))),
        "discarded_bytes": m_exists(lambda s: s["discarded"] > 0),
    }
    found = lambda name, severity: F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity"))
    told = [F.when(F.col("_good") & c, found(name, "error")) for name, c in errors.items()]
    told += [F.when(F.col("_good") & c, found(name, "warning")) for name, c in warnings.items()]
    told.append(F.when(~F.col("_good"), found("not_jpeg", "error")))
    # Outer form plus a filter on its output: an inner one would walk every file again to pre-filter.
    return read.select("image_id", F.explode_outer(F.array(*told)).alias("_i")).filter("_i IS NOT NULL").select("image_id", "_i.*")


def kept_segments(segs: DataFrame) -> DataFrame:
    """What the checks read of the segments, stored once: each finding reads it again, and the walk behind it would be done again.

    Only payloads that a check opens are kept; those of EXIF, XMP, profile and comment segments, often most of the bytes, are not.
    """
    opened = (*fixed.SUPPORTED_SOF, fixed.SOS, fixed.DQT, fixed.DHT, fixed.DRI, fixed.APP0)
    payload = F.when(F.col("marker").isin(*opened), F.col("payload")).alias("payload")
    return stored(segs.select("image_id", "seq", "marker", "length", "discarded", payload), "segments")


def corpus_audit(segs: DataFrame) -> DataFrame:
    """All findings that the header segments of a corpus give."""
    return segment_issues(kept_segments(segs))


def segment_issues(segs: DataFrame) -> DataFrame:
    """``corpus_audit`` over segments that are cheap to read several times."""
    from . import headers as hd

    frame_rows = hd.frames(segs)
    comps = hd.components(frame_rows)
    tables = hd.qtables(segs, values=False)
    one_frame = frame_rows.groupBy("image_id").agg(
        F.min_by("progressive", "seq").alias("progressive"), F.min_by("baseline", "seq").alias("baseline")
    )
    return all_issues(
        frame_issues(frame_rows),
        structure_issues(segs),
        scan_issues(hd.scans(segs), one_frame),
        as_issues(missing_tables(comps, tables), "missing_table", "error"),
        as_issues(hd.jfif(segs).filter("bad_version"), "jfif_version", "warning"),
    )


def table_issues(scripts: DataFrame | None = None, markers: DataFrame | None = None) -> DataFrame:
    """Findings over what the headers of a file don't hold: scan scripts (as ``script_violations`` reads them) and restart markers (as
    ``restart_gaps`` does). One row per image and issue; a table that is not given has no findings, but one must be."""
    from .scans import script_violations

    if scripts is None and markers is None:
        raise ValueError("scripts or markers must be given")
    found = []
    if scripts is not None:
        found.append(script_violations(scripts).select("image_id", "issue").distinct().withColumn("severity", F.lit("error")))
    if markers is not None:
        found.append(as_issues(restart_gaps(markers), "restart_gap", "warning"))
    return all_issues(*found)


def issue_log(segs: DataFrame, scripts: DataFrame | None = None, markers: DataFrame | None = None) -> DataFrame:
    """``corpus_audit`` and what needs scans, tables and components together: undefined entropy tables, selectors without a component,
    bytes that belong to no segment, and damaged thumbnails. Scripts and restart markers, where given, add ``table_issues``."""
    from . import headers as hd

    segs = kept_segments(segs)
    frame_rows, scan_rows = hd.frames(segs), hd.scans(segs).withColumn("scan_no", F.lit(0))
    return all_issues(
        segment_issues(segs),
        as_issues(missing_huffman(scan_rows, hd.htables(segs, values=False), frame_rows), "missing_huffman", "error"),
        as_issues(scan_components(scan_rows.join(frame_rows.select("image_id"), "image_id", "left_semi"), frame_rows).filter("ci IS NULL"), "bad_component_id", "error"),
        as_issues(segs.filter("discarded > 0"), "discarded_bytes", "warning"),
        as_issues(hd.jfif(segs).filter("bad_thumbnail"), "jfif_thumbnail", "warning"),
        *([] if scripts is None and markers is None else [table_issues(scripts, markers)]),
    )
