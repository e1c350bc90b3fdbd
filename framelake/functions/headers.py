"""Header bytes as columns: the marker walk and the fields of each segment type.

All of it is plain expressions over the file bytes, so reading headers needs no shuffle and no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .exprs import col, idiv, int_array, let, starts_with, u8, u16
from .orders import zigzag_ranks

# Byte patterns, on bytes read as Latin-1 text.
MARKER = "\\xff[^\\xff\\x00]"
TRAILING_FILL = "\\xff+\\z"
STUFFED = "\\xff+\\x00"
WINDOW = 4096
EXIF_PREFIX = b"Exif\0\0"
XMP_PREFIX = b"http://ns.adobe.com/xap/1.0/\0"
XMP_ORIENTATION = r"tiff:Orientation\s*(?:=\s*[\"']|>)\s*(\d+)"

SEGMENT_TYPE = "array<struct<offset:bigint,marker:int,length:int,discarded:bigint>>"
_STOPS = (fixed.SOS, fixed.EOI, *fixed.UNSUPPORTED_SOF)


def _standalone(marker: Column) -> Column:
    return marker.between(fixed.RST0, fixed.EOI) | (marker == fixed.TEM)


def _reserved(marker: Column) -> Column:
    return ((marker < fixed.SOF0) & (marker != fixed.TEM)) | (marker.between(0xF0, 0xFD) & (marker != fixed.LSE))


def segment_array(content) -> Column:
    """One struct per marker from the start of the image to the first scan header, which ends the walk.

    A marker takes two bytes, so a file has at most half as many as bytes. A fold can't end early, so the steps are a fold
    of folds, each as long as the root of that number, and an inner one runs only while the walk goes on: no file is cut
    short, and the cost follows the headers, not the file. A step normally reads a few bytes; only where the next marker
    does not follow at once are the bytes searched, first a window, then if need be the rest, skipping fill bytes and
    counting the others as discarded. The bytes are bound once: each use of a column would copy the whole file.
    """
    return let(col(content), _walk)


def _walk(c: Column) -> Column:
    size = F.length(c)
    steps = F.sequence(F.lit(1), F.ceil(F.sqrt(size / 2.0)).cast("int") + 1)

    def find(p: Column) -> Column:
        part = lambda n: F.decode(c.substr(p.cast("int") + 1, n), "ISO-8859-1")

        def search(text: Column) -> Column:
            def located(at: Column) -> Column:
                skipped = F.regexp_replace(text.substr(F.lit(1), at - 1), TRAILING_FILL, "")
                lost = F.length(F.regexp_replace(skipped, STUFFED, "zz"))
                return F.struct(
                    F.when(at > 0, p + at).cast("bigint").alias("code"), lost.cast("bigint").alias("discarded")
                )

            return let(F.regexp_instr(text, F.lit(MARKER)), located)

        at_once = (u8(c, p) == 0xFF) & ~u8(c, p + 1).isin(0x00, 0xFF)
        here = F.struct((p + 1).cast("bigint").alias("code"), F.lit(0).cast("bigint").alias("discarded"))
        near = lambda text: F.when((size - p <= WINDOW) | (F.regexp_instr(text, F.lit(MARKER)) > 0), search(text)).otherwise(let(part(size), search))
        return F.when(F.coalesce(at_once, F.lit(False)), here).otherwise(let(part(F.lit(WINDOW)), near))

    def advance(state: Column) -> Column:
        def at_marker(hit: Column) -> Column:
            def at_length(head: Column) -> Column:
                marker, length = head["m"], head["n"]
                alone = _standalone(marker)
                entry = F.struct(
                    (hit["code"] - 1).alias("offset"),
                    marker.alias("marker"),
                    F.when(~alone, length).alias("length"),
                    hit["discarded"].alias("discarded"),
                )
                after = F.when(alone, hit["code"] + 1).otherwise(hit["code"] + 1 + F.coalesce(length, F.lit(0)))
                broken = ~alone & (length.isNull() | (length < 2))
                stop = marker.isin(*_STOPS) | _reserved(marker) | broken | (after >= size)
                return F.struct(
                    after.cast("bigint").alias("pos"),
                    stop.alias("done"),
                    F.concat(state["segs"], F.array(entry)).cast(SEGMENT_TYPE).alias("segs"),
                )

            head = F.struct(
                u8(c, hit["code"]).cast("int").alias("m"), u16(c, hit["code"] + 1).cast("int").alias("n")
            )
            ended = F.struct(state["pos"].alias("pos"), F.lit(True).alias("done"), state["segs"].alias("segs"))
            return F.when(hit["code"].isNull(), ended).otherwise(let(head, at_length))

        return let(find(state["pos"]), at_marker)

    soi = F.struct(
        F.lit(0).cast("bigint").alias("offset"), F.lit(fixed.SOI).alias("marker"),
        F.lit(None).cast("int").alias("length"), F.lit(0).cast("bigint").alias("discarded"),
    )
    is_image = F.coalesce(starts_with(c, b"\xff\xd8"), F.lit(False))
    start = F.struct(
        F.lit(2).cast("bigint").alias("pos"),
        (F.length(c) <= 2).alias("done"),
        F.array(soi).cast(SEGMENT_TYPE).alias("segs"),
    )
    step = lambda state, _: F.when(state["done"], state).otherwise(advance(state))
    stretch = lambda state, _: F.when(state["done"], state).otherwise(F.aggregate(steps, state, step))
    walked = F.aggregate(steps, start, stretch, lambda state: state["segs"])
    with_payload = F.transform(
        walked,
        lambda s: F.struct(
            s["offset"].alias("offset"), s["marker"].alias("marker"), s["length"].alias("length"),
            s["discarded"].alias("discarded"),
            c.substr((s["offset"] + 5).cast("int"), F.greatest(s["length"] - 2, F.lit(0))).alias("payload"),
        ),
    )
    return F.when(is_image, with_payload)


def _indices(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def sof(marker, payload) -> Column:
    """Frame header with its component list."""
    p, m = col(payload), col(marker)
    fitting = F.least(u8(p, F.lit(5)), F.greatest(idiv(F.length(p) - 6, 3), F.lit(0)))
    comps = F.transform(
        _indices(fitting),
        lambda i: F.struct(
            i.alias("ci"),
            u8(p, i * 3 + 6).cast("int").alias("component_id"),
            F.shiftright(u8(p, i * 3 + 7), 4).cast("int").alias("h"),
            u8(p, i * 3 + 7).bitwiseAND(15).cast("int").alias("v"),
            u8(p, i * 3 + 8).cast("int").alias("tq"),
        ),
    )
    return F.struct(
        m.alias("sof"),
        u8(p, F.lit(0)).cast("int").alias("precision"),
        u16(p, F.lit(3)).cast("int").alias("width"),
        u16(p, F.lit(1)).cast("int").alias("height"),
        u8(p, F.lit(5)).cast("int").alias("ncomp"),
        (F.length(p) + 2).alias("length"),
        (m == fixed.SOF0).alias("baseline"),
        m.isin(fixed.SOF2, fixed.SOF10).alias("progressive"),
        m.isin(fixed.SOF9, fixed.SOF10).alias("arithmetic"),
        comps.alias("components"),
    )


def sos(payload) -> Column:
    """Scan header: component selectors, spectral range and bit positions. ``ok``: the length fits."""
    p = col(payload)
    n = u8(p, F.lit(0))
    fitting = F.least(n, F.greatest(idiv(F.length(p) - 4, 2), F.lit(0)))
    comps = F.transform(
        _indices(fitting),
        lambda i: F.struct(
            u8(p, i * 2 + 1).cast("int").alias("component_id"),
            F.shiftright(u8(p, i * 2 + 2), 4).cast("int").alias("dc"),
            u8(p, i * 2 + 2).bitwiseAND(15).cast("int").alias("ac"),
        ),
    )
    return F.struct(
        n.cast("int").alias("ncomp"),
        ((F.length(p) == n * 2 + 4) & (n <= 4)).alias("ok"),
        comps.alias("comps"),
        u8(p, n * 2 + 1).cast("int").alias("ss"),
        u8(p, n * 2 + 2).cast("int").alias("se"),
        F.shiftright(u8(p, n * 2 + 3), 4).cast("int").alias("ah"),
        u8(p, n * 2 + 3).bitwiseAND(15).cast("int").alias("al"),
    )


QTABLE_TYPE = "array<struct<slot:int,precision:int,q:array<int>>>"
HTABLE_TYPE = "array<struct<class:int,slot:int,bits:array<int>,vals:array<int>>>"


def dqt(payload, values: bool = True) -> Column:
    """Quantiser tables of one segment, in natural order. A short table is padded with 1. Without ``values`` ``q`` stays NULL."""
    p = col(payload)
    size = F.length(p)

    def ranks(count: Column) -> Column:
        out = F.when(count == 4, int_array(zigzag_ranks(2)))
        for n in (3, 5, 6, 7):
            out = out.when(count == n * n, int_array(zigzag_ranks(n)))
        return out.when(count == 16, int_array(zigzag_ranks(4))).otherwise(int_array(zigzag_ranks(8)))

    def read(state: Column) -> Column:
        def table(head: Column) -> Column:
            width = head["wide"] + 1
            count = F.least(F.lit(64), idiv(size - state["pos"] - 1, width))
            numbers = lambda: F.transform(
                ranks(count),
                lambda z: F.when(
                    z < count,
                    F.when(head["wide"] == 0, u8(p, state["pos"] + 1 + z)).otherwise(u16(p, state["pos"] + 1 + z * 2)),
                ).otherwise(F.lit(1).cast("bigint")),
            )
            entry = F.struct(head["slot"].alias("slot"), (head["wide"] * 8 + 8).alias("precision"), (numbers() if values else F.lit(None)).alias("q"))
            return F.struct(
                (state["pos"] + 1 + F.greatest(count, F.lit(0)) * width).cast("bigint").alias("pos"),
                F.concat(state["out"], F.array(entry).cast(QTABLE_TYPE)).alias("out"),
            )

        first = u8(p, state["pos"])
        head = F.struct(
            first.bitwiseAND(15).cast("int").alias("slot"), (F.shiftright(first, 4) > 0).cast("int").alias("wide")
        )
        return let(head, table)

    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast(QTABLE_TYPE).alias("out"))
    return F.aggregate(
        F.sequence(F.lit(0), idiv(size, 65)),
        start,
        lambda state, _: F.when(state["pos"] < size, read(state)).otherwise(state),
        lambda state: state["out"],
    )


def dht(payload, values: bool = True) -> Column:
    """Entropy tables of one segment: class (0 DC, 1 AC), slot, 16 length counts, symbols (NULL without ``values``)."""
    p = col(payload)
    size = F.length(p)

    def read(state: Column) -> Column:
        def table(bits: Column) -> Column:
            first = u8(p, state["pos"])
            total = F.aggregate(bits, F.lit(0), lambda a, b: a + b)
            vals = F.transform(_indices(total), lambda i: u8(p, state["pos"] + 17 + i).cast("int")) if values else F.lit(None)
            entry = F.struct(
                F.shiftright(first, 4).bitwiseAND(1).cast("int").alias("class"),
                (first - F.when(first.bitwiseAND(16) > 0, F.lit(16)).otherwise(F.lit(0))).cast("int").alias("slot"),
                bits.alias("bits"),
                vals.alias("vals"),
            )
            return F.struct(
                (state["pos"] + 17 + total).cast("bigint").alias("pos"),
                F.concat(state["out"], F.array(entry).cast(HTABLE_TYPE)).alias("out"),
            )

        bits = F.transform(
            F.sequence(F.lit(1), F.lit(16)), lambda i: F.coalesce(u8(p, state["pos"] + i), F.lit(0)).cast("int")
        )
        return let(bits, table)

    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast(HTABLE_TYPE).alias("out"))
    return F.aggregate(
        F.sequence(F.lit(0), idiv(size, 17)),
        start,
        lambda state, _: F.when(state["pos"] + 17 <= size, read(state)).otherwise(state),
        lambda state: state["out"],
    )


def jfif(payload) -> Column:
    """JFIF version, density and thumbnail check; ``kind`` tells a JFXX thumbnail or other APP0 apart."""
    p = col(payload)
    is_jfif = starts_with(p, b"JFIF\0") & (F.length(p) >= 14)
    is_jfxx = starts_with(p, b"JFXX\0") & (F.length(p) >= 6)
    code = u8(p, F.lit(5))
    thumb = F.when(code == 0x10, "thumb_jpeg").when(code == 0x11, "thumb_palette").when(code == 0x13, "thumb_rgb")
    return F.struct(
        F.when(is_jfif, "jfif").when(is_jfxx, F.coalesce(thumb, F.lit("extension"))).otherwise("other").alias("kind"),
        F.when(is_jfif, code).otherwise(F.lit(1)).cast("int").alias("major"),
        F.when(is_jfif, u8(p, F.lit(6))).otherwise(F.lit(1)).cast("int").alias("minor"),
        F.when(is_jfif, u8(p, F.lit(7))).otherwise(F.lit(0)).cast("int").alias("unit"),
        F.when(is_jfif, u16(p, F.lit(8))).otherwise(F.lit(1)).cast("int").alias("x_density"),
        F.when(is_jfif, u16(p, F.lit(10))).otherwise(F.lit(1)).cast("int").alias("y_density"),
        (is_jfif & ~code.isin(1, 2)).alias("bad_version"),
        (is_jfif & (F.length(p) - 14 != u8(p, F.lit(12)) * u8(p, F.lit(13)) * 3)).alias("bad_thumbnail"),
    )


def adobe(payload) -> Column:
    """Fields of an Adobe segment; NULL for any other."""
    p = col(payload)
    return F.when(
        starts_with(p, b"Adobe") & (F.length(p) >= 12),
        F.struct(
            u16(p, F.lit(5)).cast("int").alias("version"),
            u16(p, F.lit(7)).cast("int").alias("flags0"),
            u16(p, F.lit(9)).cast("int").alias("flags1"),
            u8(p, F.lit(11)).cast("int").alias("transform"),
        ),
    )


# The only accepted inverse colour transform. Before the three component ids (G R B): id 0Dh, maximum
# 255, three components. After them: centre 128 and the matrix that adds green back to red and blue.
TRANSFORM_HEAD = "0D00FF03"
TRANSFORM_TAIL = "800000000000000100000000010000"


def colour_transform(payload, component_ids) -> Column:
    """True for the accepted subtract-green segment, False for any other; ids are those of the frame."""
    ids = col(component_ids)
    text = F.hex(col(payload))
    expected = F.concat(
        F.lit(TRANSFORM_HEAD), *[F.lpad(F.hex(ids[i].cast("bigint")), 2, "0") for i in (1, 0, 2)], F.lit(TRANSFORM_TAIL)
    )
    return F.coalesce((F.size(ids) >= 3) & (text == expected), F.lit(False))


def restart_interval(payload) -> Column:
    """Interval of a restart definition; NULL unless the segment has exactly two bytes."""
    p = col(payload)
    return F.when(F.length(p) == 2, u16(p, F.lit(0))).cast("int")


# --- EXIF ------------------------------------------------------------------------------------------

TAG_TYPE = "array<struct<ifd:string,tag:int,type:int,count:bigint,value_offset:bigint,values:array<bigint>>>"


def _num(text: Column, at: int, size: int, big: Column) -> Column:
    """Unsigned integer at a byte position of a short hexadecimal text, in either byte order."""
    straight = text.substr(2 * at + 1, 2 * size)
    swapped = F.concat(*[text.substr(2 * (at + i) + 1, 2) for i in reversed(range(size))])
    return F.conv(F.when(big, straight).otherwise(swapped), 16, 10).cast("bigint")


def _entries(p: Column, at: Column, big: Column, ifd: str) -> Column:
    """Directory entries at a payload position (a bound value); entries that leave the segment end the list.

    The twelve bytes of an entry are read once, as text, and its fields are cut from that.
    """
    size = F.length(p)
    room = F.greatest(idiv(size - at - 2, 12), F.lit(0))

    def entry(k: Column) -> Column:
        def decoded(h: Column) -> Column:
            def placed(w: Column) -> Column:
                fits = (h["count"] > 0) & (w["at"] + w["unit"] * h["count"] <= size)
                n = F.when(h["type"] == 5, h["count"] * 2).otherwise(h["count"])
                step = F.least(w["unit"], F.lit(4))
                part = lambda i: F.hex(p.substr((w["at"] + i * step + 1).cast("int"), step))
                value = lambda t: F.when(step == 1, F.conv(t, 16, 10).cast("bigint")).when(
                    step == 2, _num(t, 0, 2, big)
                ).otherwise(_num(t, 0, 4, big))
                values = F.when(
                    fits, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: let(part(i), value))
                )
                return F.struct(
                    F.lit(ifd).alias("ifd"), h["tag"].cast("int").alias("tag"), h["type"].cast("int").alias("type"),
                    h["count"].alias("count"), w["at"].cast("bigint").alias("value_offset"), values.alias("values"),
                )

            unit = F.when(h["type"].isin(1, 7), 1).when(h["type"] == 3, 2).when(h["type"] == 4, 4).when(h["type"] == 5, 8)
            here = at + k * 12 + 10
            where = F.when(unit * h["count"] <= 4, here).otherwise(h["value"] + 6)
            return let(F.struct(unit.alias("unit"), where.cast("bigint").alias("at")), placed)

        def fields(t: Column) -> Column:
            head = F.struct(
                _num(t, 0, 2, big).alias("tag"), _num(t, 2, 2, big).alias("type"),
                _num(t, 4, 4, big).alias("count"), _num(t, 8, 4, big).alias("value"),
            )
            return let(head, decoded)

        return let(F.hex(p.substr((at + k * 12 + 3).cast("int"), F.lit(12))), fields)

    count = F.hex(p.substr((at + 1).cast("int"), F.lit(2)))
    n = F.least(F.coalesce(F.when(F.length(count) == 4, _num(count, 0, 2, big)), F.lit(0)), room)
    return F.transform(_indices(n), entry).cast(TAG_TYPE)


def exif_array(payload) -> Column:
    """Tags of an EXIF segment: the first directory and the EXIF sub-directory it points to.

    ``value_offset`` is the position of the value bytes in the segment payload. NULL if the segment is not EXIF
    or its byte order, mark or first offset is inconsistent.
    """
    p = col(payload)

    def walk(start: Column) -> Column:
        big = start["big"]

        def with_sub(main: Column) -> Column:
            pointer = F.filter(main, lambda t: (t["tag"] == fixed.TAG_EXIF_IFD) & (F.get(t["values"], F.lit(0)) < 65536))
            at = F.get(F.get(pointer, F.lit(0))["values"], F.lit(0)) + 6
            sub = let(at, lambda a: F.when(a.isNotNull(), _entries(p, a, big, "exif")))
            return F.concat(main, F.coalesce(sub, F.array().cast(TAG_TYPE)))

        return let(_entries(p, start["first"] + 6, big, "ifd0"), with_sub)

    order = F.hex(p.substr(F.lit(7), F.lit(8)))
    big = order.substr(1, 4) == "4D4D"
    known = starts_with(p, EXIF_PREFIX) & (F.length(p) >= 18) & (big | (order.substr(1, 4) == "4949"))
    start = F.struct(big.alias("big"), _num(order, 2, 2, big).alias("mark"), _num(order, 4, 4, big).alias("first"))
    usable = lambda x: (x["mark"] == 42) & (x["first"] < 65536) & (x["first"] + 8 <= F.length(p))
    return F.when(known, let(start, lambda x: F.when(usable(x), walk(x))))


def exif_big_endian(payload) -> Column:
    return col(payload).substr(F.lit(7), F.lit(2)) == F.unhex(F.lit("4D4D"))


def xmp_orientation(payload) -> Column:
    """The tiff:Orientation property of an XMP segment, as attribute or element; NULL if there is none."""
    p = col(payload)
    text = F.decode(p, "ISO-8859-1")
    found = F.regexp_extract(text, XMP_ORIENTATION, 1)
    return F.when(starts_with(p, XMP_PREFIX) & (found != ""), F.right(found, F.lit(32)).cast("decimal(38,0)") % 256).cast("int")


def xmp_digits(payload) -> Column:
    """Where the digits of the XMP orientation stand in the payload, and how many there are; NULL if there are none."""
    p = col(payload)
    text = F.decode(p, "ISO-8859-1")
    whole, found = F.regexp_extract(text, XMP_ORIENTATION, 0), F.regexp_extract(text, XMP_ORIENTATION, 1)
    end = F.regexp_instr(text, F.lit(XMP_ORIENTATION)) - 1 + F.length(whole)
    return F.when(starts_with(p, XMP_PREFIX) & (found != ""), F.struct((end - F.length(found)).alias("at"), F.length(found).alias("length")))
