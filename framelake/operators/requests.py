"""Composed requests: crop, transform, trim and gray in one plan, and the blocks that come of it.

The values of a plan build on each other, so they are staged as columns of successive projections: each is computed once for a
request, for both axes together, and the whole plan stays one narrow pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as fb
from ..functions import fixed
from ..functions import geometry as g
from ..functions.exprs import ceil_div, idiv
from . import blocks as bl

AXES = (("x", "w"), ("y", "h"))
CROP = ["ok_x", "ok_y", "out_w", "out_h", "x_off", "y_off", "wipe_w", "wipe_h"]


def _c(name: str) -> Column:
    return F.col(name)


def _fixed(rows: DataFrame, names: list[str], values: list[str]) -> DataFrame:
    """The columns ``names`` and ``values``, the latter as the one row of a generator.

    A filter moves down through projections and takes their whole expressions with it, which grow with every stage; it does not
    move through a generator.
    """
    return rows.select(*names, F.inline_outer(F.array(F.struct(*values))))


def resolve_crop(rows: DataFrame, spec: str = "spec") -> DataFrame:
    """Crop requests against the result they cut: adds ``readable`` and the columns of ``CROP``.

    Needs ``full_w, full_h, unit_w, unit_h, transform``. ``out_*`` is the size of the result, ``*_off`` its place in units, ``wipe_*`` the
    wiped units. An axis that does not fit has ``ok_*`` false and no numbers; a request that can't be read has nulls. Without a
    request (null) the whole result stays.
    """
    names = rows.columns
    rows = rows.withColumn("_parts", g.crop_parts(F.coalesce(spec, F.lit(""))))
    rows = rows.withColumns({f"_{k}": v for k, v in g.crop_fields(_c("_parts")).items()})
    stages: list[dict[str, Column]] = [{}, {}, {}, {}]
    for at, along in AXES:
        n = lambda k, at=at: f"_{k}_{at}"
        size, unit, asked, state, way = _c(f"full_{along}").cast("bigint"), _c(f"unit_{along}").cast("bigint"), _c(f"_{along}"), _c(f"_{along}_state"), _c(f"_{at}_state")
        off, ext, grows, real = _c(n("off")), _c(n("ext")), _c(n("grows")), _c(n("real"))
        stages[0][n("off")] = F.when(way == "unset", F.lit(0)).otherwise(_c(f"_{at}")).cast("bigint")
        stages[0][n("grows")] = (state != "unset") & (asked > size)
        stages[1][n("ext")] = F.when(state == "unset", size - off).otherwise(asked)
        fits = (
            F.when(state == "unset", off < size)
            .when(grows, (_c("transform") == fixed.NONE) & (off < ext) & (off <= ext - size))
            .otherwise((off < size) & (ext > 0) & (off <= size - ext))
        )
        stages[2][f"ok_{at}"] = fits
        stages[2][n("real")] = F.when(fits, F.when(way != "neg", off).when(grows, ext - size - off).otherwise(size - ext - off))
        wipes, covering = _c("transform") == fixed.WIPE, ext + real % unit
        stages[3][f"out_{along}"] = F.when(_c(f"ok_{at}"), F.when(wipes, size).when((state == "force") | grows, ext).otherwise(covering))
        stages[3][f"{at}_off"] = idiv(real, unit)
        stages[3][f"wipe_{along}"] = F.when(_c(f"ok_{at}") & wipes, ceil_div(covering, unit))
    for stage in stages:
        rows = rows.withColumns(stage)
    return _fixed(rows.withColumn("readable", _c("_parts").isNotNull()), [c for c in names if c not in ("readable", *CROP)], ["readable", *CROP])


def crop_status() -> Column:
    """``bad_request`` (cannot be read), ``refused`` (does not fit the image) or ``ok``, so that no request is lost."""
    fits = F.coalesce(_c("ok_x") & _c("ok_y"), F.lit(False))
    return F.when(~_c("readable"), "bad_request").when(~fits, "refused").otherwise("ok")


def plan_requests(requests: DataFrame) -> DataFrame:
    """Every request with its ``status`` and, if that is ``ok``, ``out_ncomp, out_w, out_h, x_off, y_off, wipe_w, wipe_h``.

    Needs ``width, height, ncomp, max_h, max_v, luma_h, luma_v, color_space`` of the image and ``spec`` (a crop request or null),
    ``transform, trim, perfect, gray``; null flags count as false. The steps, in this order: gray decides the number of components and so
    the unit; a perfect transform must leave no partial unit; the crop is taken from the transformed image; what the crop leaves of
    partial units at mirrored edges is trimmed. The first step that fails gives the status: ``bad_request``, ``cropOptionRequired``
    (not perfect), ``refused`` (crop outside), ``conversion_not_supported`` (gray).
    """
    flag = lambda c: F.coalesce(_c(c), F.lit(False))
    names = [c for c in requests.columns if c not in ("status", "out_ncomp", *CROP)]
    ycc = (_c("ncomp") == 3) & _c("color_space").isin("ycc", "bg_ycc")
    luma_full = (_c("luma_h") == _c("max_h")) & (_c("luma_v") == _c("max_v"))
    rows = requests.select(*names).withColumns({
        "out_ncomp": F.when(flag("gray") & F.coalesce(ycc, F.lit(False)), 1).otherwise(_c("ncomp")),
        "_gray_ok": ~flag("gray") | F.coalesce((ycc | ((_c("ncomp") == 1) & (_c("color_space") == "gray"))) & luma_full, F.lit(False)),
    })
    full_w, full_h = g.output_size("width", "height", "transform")
    unit_w, unit_h = g.imcu_size("out_ncomp", "max_h", "max_v", "transform")
    source_w, source_h = g.imcu_size("out_ncomp", "max_h", "max_v", F.lit(fixed.NONE))
    rows = rows.withColumns({"full_w": full_w, "full_h": full_h, "unit_w": unit_w, "unit_h": unit_h, "_perfect_ok": ~flag("perfect") | g.is_perfect("width", "height", source_w, source_h, "transform")})
    rows = resolve_crop(rows)
    status = F.when(~_c("readable"), "bad_request").when(~_c("_perfect_ok"), "cropOptionRequired").when(crop_status() != "ok", crop_status())
    rows = rows.withColumn("status", status.when(~_c("_gray_ok"), "conversion_not_supported").otherwise("ok"))
    tw, th = g.trim_edges("out_w", "out_h", "full_w", "full_h", "unit_w", "unit_h", "x_off", "y_off", "transform")
    rows = rows.withColumns({"_tw": F.when(flag("trim"), tw).otherwise(_c("out_w")), "_th": F.when(flag("trim"), th).otherwise(_c("out_h"))})
    good = lambda c: F.when(_c("status") == "ok", _c(c))
    result = {"out_ncomp": good("out_ncomp"), "out_w": good("_tw"), "out_h": good("_th")} | {c: good(c) for c in ("x_off", "y_off", "wipe_w", "wipe_h")}
    return _fixed(rows.select(*names, "status", *(v.alias(k) for k, v in result.items())), names, ["status", *result])


def rotate_requests(blocks: DataFrame, plan: DataFrame, comps: DataFrame) -> DataFrame:
    """Blocks of the result of every request that is ``ok``: ``image_id, request, ci, by, bx, coef``.

    ``plan``: rows of ``plan_requests`` with a ``request`` that tells the requests of an image apart; ``comps``: ``image_id, ci, h, v``. One
    band join, one projection: turned, wiped, shifted and cut. Where a result is larger than its image, the rest is blank blocks,
    which come from the plan alone.
    """
    ready = plan.filter("status = 'ok'").select("image_id", "request", "transform", "width", "height", "ncomp", "out_ncomp", "max_h", "max_v", "out_w", "out_h", "x_off", "y_off", "wipe_w", "wipe_h")
    ready = ready.withColumn("wipes", _c("transform") == fixed.WIPE)
    per_comp = ready.join(comps.select("image_id", "ci", "h", "v"), "image_id").filter("ci = 0 OR out_ncomp > 1")
    joined = bl.with_plan(blocks, per_comp).withColumn("ncomp", _c("out_ncomp"))
    placed = bl.transformed(joined, _c("transform"))
    placed = bl.wipe(placed, _c("wipes"))

    def area(transform: Column):
        dh, dv, wide, high = bl.extent(transform)
        whole_w, whole_h = fb.whole_blocks(transform, "width", "height", "ncomp", "max_h", "max_v", "h", "v")
        gx, gy = _c("out_w") > g.output_size("width", "height", transform)[0], _c("out_h") > g.output_size("width", "height", transform)[1]
        x0, y0 = F.when(_c("wipes"), 0).otherwise(_c("x_off") * dh), F.when(_c("wipes"), 0).otherwise(_c("y_off") * dv)
        inside = lambda at, grows, start, whole, size: (at >= F.when(grows, start).otherwise(0)) & (at < F.when(grows, start + whole).otherwise(size))
        covered = lambda x, y: inside(x, gx, x0, whole_w, wide) & inside(y, gy, y0, whole_h, high)
        return wide, high, gx, gy, x0, y0, covered

    out = ["image_id", "request", "ci", "by", "bx", "coef"]
    _, _, gx, gy, x0, y0, covered = area(_c("transform"))
    x, y = _c("bx") + F.when(gx, x0).otherwise(-x0), _c("by") + F.when(gy, y0).otherwise(-y0)
    kept = placed.filter(covered(x, y)).withColumns({"bx": x.cast("int"), "by": y.cast("int")}).select(*out)

    larger = per_comp.withColumn("ncomp", _c("out_ncomp"))
    wide, high, gx, gy, _, _, covered = area(_c("transform"))
    lines = larger.filter(gx | gy).withColumn("by", F.explode(F.sequence(F.lit(0), high.cast("int") - 1))).repartition("image_id", "request", "ci", "by")
    grid = lines.withColumn("bx", F.explode(F.sequence(F.lit(0), wide.cast("int") - 1)))
    return kept.unionByName(grid.filter(~covered(_c("bx"), _c("by"))).withColumn("coef", fb.zero_block()).select(*out))
