"""Geometry of label and image tables: crop, flip, rotate, resize, pad, mosaic, edges.

Random choices arrive as a parameter table with one row per sample. Where a
target pixel has one source pixel, the source is sent to its targets by
integer arithmetic, which needs no join and no shuffle. Functions accept any
extra pixel columns (gt, v, c, …) and carry them along.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.functions import columns as C
from segspark.functions.prefix import row_numbers
from segspark.operators.blocks import over_blocks, window_any
from segspark.runtime import join_pixels, join_side, salt


def _axis(size: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), size - 1))


def _rest(df: DataFrame, *drop: str) -> list[str]:
    return [c for c in df.columns if c not in drop]


# --- crop and flip ----------------------------------------------------------

def crop(px: DataFrame, boxes: DataFrame) -> DataFrame:
    """Keep pixels inside the box (x1, y1, x2, y2) of their sample and move the origin."""
    cols = px.columns
    inside = (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2"))
    cut = join_side(px, boxes.select("sample_id", "x1", "y1", "x2", "y2"), ["sample_id"]).filter(inside)
    return (cut.withColumn("x", (F.col("x") - F.col("x1")).cast("int"))
            .withColumn("y", (F.col("y") - F.col("y1")).cast("int")).select(*cols))


def choose_crop(px: DataFrame, candidates: DataFrame, max_ratio: float = 0.75, ignore: int = 255, tries: int = 10) -> DataFrame:
    """(sample_id, try_no, x1, y1, x2, y2): the first of the tried boxes with more than one class and a
    dominant share below `max_ratio`, else the draw after the last try. At most tries + 1 candidates
    (sample_id, try_no from 0, x1, y1, x2, y2) per sample."""
    box = F.struct("try_no", "x1", "y1", "x2", "y2")
    lists = candidates.groupBy("sample_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    hit = lambda b: ((F.col("x") >= b["x1"]) & (F.col("x") < b["x2"]) & (F.col("y") >= b["y1"]) & (F.col("y") < b["y2"])
                     & (b["try_no"] < tries))
    seen = join_side(px.filter(F.col("gt") != ignore).select("sample_id", "y", "x", "gt"), lists, ["sample_id"])
    counts = (seen.select("sample_id", "gt", F.explode(F.transform(F.filter("boxes", hit), lambda b: b["try_no"])).alias("try_no"))
              .groupBy("sample_id", "try_no", "gt").agg(F.count(F.lit(1)).alias("n")))
    good = (counts.groupBy("sample_id", "try_no").agg(F.count(F.lit(1)).alias("k"), (F.max("n") / F.sum("n")).alias("share"))
            .filter((F.col("k") > 1) & (F.col("share") < max_ratio)).groupBy("sample_id").agg(F.min("try_no").alias("pick")))
    chosen = lists.join(good, "sample_id", "left")
    pick = F.coalesce("pick", F.lit(tries))
    return chosen.select("sample_id", F.inline(F.filter("boxes", lambda b: b["try_no"] == pick)))


def flip(px: DataFrame, height: int | Column, width: int | Column, direction: str | Column = "horizontal") -> DataFrame:
    """direction: horizontal, vertical, diagonal or none, per table or per row."""
    d = F.lit(direction) if isinstance(direction, str) else direction
    return (px.withColumn("y", F.when(d.isin("vertical", "diagonal"), F.lit(height) - 1 - F.col("y")).otherwise(F.col("y")))
            .withColumn("x", F.when(d.isin("horizontal", "diagonal"), F.lit(width) - 1 - F.col("x")).otherwise(F.col("x"))))


def flip_boxes(boxes: DataFrame, height: int, width: int, direction: str = "horizontal") -> DataFrame:
    out = boxes
    if direction in ("horizontal", "diagonal"):
        out = out.withColumns({"x1": width - F.col("x2"), "x2": width - F.col("x1")})
    if direction in ("vertical", "diagonal"):
        out = out.withColumns({"y1": height - F.col("y2"), "y2": height - F.col("y1")})
    return out


def rotate(px: DataFrame, params: DataFrame, fill: dict[str, int | float]) -> DataFrame:
    """Rotate clockwise by `angle` degrees about the centre; params(sample_id, h, w, angle).

    Every target pixel looks up the rounded source position; `fill` names the
    value columns and what they hold outside the source.
    """
    a = F.radians("angle")
    cx, cy = (F.col("w") - 1) / 2.0, (F.col("h") - 1) / 2.0
    grid = params.withColumn("ty", _axis(F.col("h"))).withColumn("tx", _axis(F.col("w")))
    dx, dy = F.col("tx") - cx, F.col("ty") - cy
    near = lambda v: F.floor(F.round(v, 9) + 0.5).cast("int")
    source = grid.select("sample_id", F.col("ty"), F.col("tx"), near(F.cos(a) * dx + F.sin(a) * dy + cx).alias("x"),
                         near(F.cos(a) * dy - F.sin(a) * dx + cy).alias("y"))
    joined = join_pixels(source, px.select("sample_id", "y", "x", *fill), ["sample_id", "y", "x"], "left")
    return joined.select("sample_id", F.col("ty").alias("y"), F.col("tx").alias("x"),
                         *[F.coalesce(c, F.lit(v)).alias(c) for c, v in fill.items()])


def rot90_flip(px: DataFrame, params: DataFrame) -> DataFrame:
    """k quarter turns against the clock, then a flip along `axis` (0 rows, 1 columns, NULL none);
    params(sample_id, h, w, k, axis)."""
    cols = px.columns
    p = join_side(px, params.select("sample_id", "h", "w", "k", "axis"), ["sample_id"])
    y, x, h, w, k = (F.col(c) for c in ("y", "x", "h", "w", "k"))
    ny = F.when(k == 1, w - 1 - x).when(k == 2, h - 1 - y).when(k == 3, x).otherwise(y)
    nx = F.when(k == 1, y).when(k == 2, w - 1 - x).when(k == 3, h - 1 - y).otherwise(x)
    nh, nw = F.when(k % 2 == 1, w).otherwise(h), F.when(k % 2 == 1, h).otherwise(w)
    moved = p.select(*_rest(px, "y", "x"), "axis", ny.alias("y"), nx.alias("x"), nh.alias("nh"), nw.alias("nw"))
    return (moved.withColumn("y", F.when(F.col("axis") == 0, F.col("nh") - 1 - F.col("y")).otherwise(F.col("y")))
            .withColumn("x", F.when(F.col("axis") == 1, F.col("nw") - 1 - F.col("x")).otherwise(F.col("x"))).select(*cols))


# --- resize -----------------------------------------------------------------

def _ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b.cast("double")).cast("int")


def _targets(pos: str, src: Column, dst: Column) -> Column:
    """Target positions t with floor(t * src / dst) = pos."""
    lo = _ceil_div(F.col(pos) * dst, src)
    hi = _ceil_div((F.col(pos) + 1) * dst, src) - 1
    return F.explode(F.when(lo <= hi, F.sequence(lo, hi)))


def resize_nearest(px: DataFrame, h: Column, w: Column, new_h: Column, new_w: Column) -> DataFrame:
    """Nearest neighbour by the floor rule; sizes are columns of `px` or literals."""
    cols = px.columns
    sized = px.withColumns({"__h": h, "__w": w, "__nh": new_h, "__nw": new_w})
    return (sized.withColumn("__ty", _targets("y", F.col("__h"), F.col("__nh")))
            .withColumn("__tx", _targets("x", F.col("__w"), F.col("__nw")))
            .withColumn("y", F.col("__ty")).withColumn("x", F.col("__tx")).select(*cols))


def resize_bilinear(px: DataFrame, h: Column, w: Column, new_h: Column, new_w: Column, value: str = "v",
                    by: list[str] | None = None, align_corners: bool = False) -> DataFrame:
    """Bilinear resize of (sample_id, y, x, by…, value): a source pixel sends weighted shares to the
    targets within one source step, then shares are summed."""
    by = list(by or [])

    def shares(df: DataFrame, pos: str, src: Column, dst: Column, target: str, weight: str) -> DataFrame:
        s, d = src.cast("double"), dst.cast("double")
        if align_corners:
            step = F.when(dst > 1, (s - 1) / (d - 1)).otherwise(F.lit(0.0))
            at = lambda t: t * step
            lo = F.when(step > 0, F.floor((F.col(pos) - 1) / step)).otherwise(F.lit(0))
            hi = F.when(step > 0, F.ceil((F.col(pos) + 1) / step)).otherwise(dst - 1)
        else:
            at = lambda t: F.least(F.greatest((t + 0.5) * s / d - 0.5, F.lit(0.0)), s - 1)
            lo = F.floor((F.col(pos) - 0.5) * d / s - 0.5)
            hi = F.ceil((F.col(pos) + 1.5) * d / s - 0.5)
        span = F.sequence(F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, dst - 1).cast("int"))
        # Rows, not functions on arrays: these run as generated code.
        return df.withColumn(target, F.explode(span)).withColumn(weight, 1 - F.abs(at(F.col(target)) - F.col(pos))).filter(F.col(weight) > 0)

    sized = px.select("sample_id", "y", "x", *by, F.col(value).alias("v"),
                      h.alias("h"), w.alias("w"), new_h.alias("nh"), new_w.alias("nw"))
    sent = shares(shares(sized, "y", F.col("h"), F.col("nh"), "__ty", "__wy"), "x", F.col("w"), F.col("nw"), "__tx", "__wx")
    return (sent.groupBy("sample_id", F.col("__ty").alias("y"), F.col("__tx").alias("x"), *by)
            .agg(F.sum(F.col("__wy") * F.col("__wx") * F.col("v")).alias(value)))


def multiple_of(size: Column, divisor: int) -> Column:
    return (F.ceil(size / F.lit(float(divisor))) * divisor).cast("int")


def keep_ratio_shape(h: Column, w: Column, max_long: int, max_short: int) -> tuple[Column, Column]:
    """Largest size with the same ratio inside (max_long, max_short), rounded half up."""
    s = F.least(F.lit(float(max_long)) / F.greatest(h, w), F.lit(float(max_short)) / F.least(h, w))
    return F.floor(h * s + 0.5).cast("int"), F.floor(w * s + 0.5).cast("int")


def factor_shape(h: Column, w: Column, factor: float | Column) -> tuple[Column, Column]:
    f = F.lit(factor) if isinstance(factor, float) else factor
    return F.floor(h * f + 0.5).cast("int"), F.floor(w * f + 0.5).cast("int")


def shortest_edge_shape(h: Column, w: Column, size: int, max_size: int) -> tuple[Column, Column]:
    """Short side becomes `size`, unless the long side would pass `max_size`."""
    scale = F.lit(float(size)) / F.least(h, w)
    nh, nw = F.when(h < w, float(size)).otherwise(scale * h), F.when(h < w, scale * w).otherwise(float(size))
    long = F.greatest(nh, nw)
    shrink = F.when(long > max_size, F.lit(float(max_size)) / long).otherwise(1.0)
    return F.floor(nh * shrink + 0.5).cast("int"), F.floor(nw * shrink + 0.5).cast("int")


def longest_side_shape(h: Column, w: Column, target: int) -> tuple[Column, Column]:
    s = F.lit(float(target)) / F.greatest(h, w)
    return F.floor(h * s + 0.5).cast("int"), F.floor(w * s + 0.5).cast("int")


def scale_points(df: DataFrame, columns_x: list[str], columns_y: list[str], h: Column, w: Column, new_h: Column, new_w: Column) -> DataFrame:
    out = {c: F.col(c) * new_w / w for c in columns_x} | {c: F.col(c) * new_h / h for c in columns_y}
    return df.withColumns(out)


def random_ratio(seed: int, lo: float = 0.5, hi: float = 2.0, draw=None) -> Column:
    """Reproducible resize ratio per sample."""
    return F.lit(lo) + (draw or C.hashed(seed))(0, F.col("sample_id")) * (hi - lo)


# --- pad and un-pad ---------------------------------------------------------

def batch_shapes(meta: DataFrame, size: tuple[int, int] | None = None, divisor: int | None = None) -> DataFrame:
    """(sample_id, h, w, pad_h, pad_w): target size fixed, or the batch maximum rounded up to a divisor.
    meta(sample_id, h, w[, batch])."""
    if (size is None) == (divisor is None):
        raise ValueError("give exactly one of size and divisor")
    if size is not None:
        return meta.select("sample_id", "h", "w", F.greatest(F.lit(size[0]), "h").alias("pad_h"), F.greatest(F.lit(size[1]), "w").alias("pad_w"))
    top = meta.groupBy("batch").agg(F.max("h").alias("mh"), F.max("w").alias("mw"))
    up = lambda c: multiple_of(F.col(c), divisor) if divisor > 1 else F.col(c)
    return (join_side(meta, top, ["batch"]).select("sample_id", "h", "w", up("mh").alias("pad_h"), up("mw").alias("pad_w")))


def pad(px: DataFrame, shapes: DataFrame, fill: dict[str, int | float], keys: dict[str, list] | None = None) -> DataFrame:
    """Right and bottom padding: only the added pixels are generated and appended.

    `fill` names the value columns; `keys` adds literal key columns (for
    example all channels) to every added pixel.
    """
    h, w, ph, pw = (F.col(c) for c in ("h", "w", "pad_h", "pad_w"))
    added = (shapes.filter((ph > h) | (pw > w)).withColumn("y", _axis(ph))
             .withColumn("x0", F.when(F.col("y") < h, w).otherwise(F.lit(0))).filter(F.col("x0") < pw)
             .withColumn("x", F.explode(F.sequence(F.col("x0"), pw - 1))))
    for name, values in (keys or {}).items():
        added = added.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    for name, value in fill.items():
        added = added.withColumn(name, F.lit(value))
    cols = ["sample_id", "y", "x", *(keys or {}), *fill]
    return px.select(*cols).unionByName(added.select(*cols))


def unpad(px: DataFrame, h: Column | int, w: Column | int, padding: tuple[int, int, int, int]) -> DataFrame:
    """Drop (left, right, top, bottom) padding from predictions of size h x w."""
    left, right, top, bottom = padding
    keep = F.col("x").between(left, F.lit(w) - right - 1) & F.col("y").between(top, F.lit(h) - bottom - 1)
    return px.filter(keep).withColumn("x", F.col("x") - left).withColumn("y", F.col("y") - top)


def multi_view(px: DataFrame, h: Column, w: Column, scales: list[float], flips: list[bool]) -> DataFrame:
    """One copy of each sample per scale and flip: adds (view, scale, flipped)."""
    views = [F.struct(F.lit(i).alias("view"), F.lit(float(s)).alias("scale"), F.lit(f).alias("flipped"))
             for i, (s, f) in enumerate((s, f) for s in scales for f in flips)]
    out = px.withColumn("__v", F.explode(F.array(*views))).select(*px.columns, "__v.*")
    nh, nw = factor_shape(h, w, F.col("scale"))
    out = resize_nearest(out.withColumns({"__oh": nh, "__ow": nw}), h, w, F.col("__oh"), F.col("__ow"))
    return out.withColumn("x", F.when(F.col("flipped"), F.col("__ow") - 1 - F.col("x")).otherwise(F.col("x"))).drop("__oh", "__ow")


# --- mixing -----------------------------------------------------------------

QUADRANTS = ("top_left", "top_right", "bottom_left", "bottom_right")


def mosaic(px: DataFrame, shapes: DataFrame, params: DataFrame, size: tuple[int, int], fill: dict[str, int | float]) -> DataFrame:
    """Four samples around (center_x, center_y) on a canvas of twice `size`: (mosaic_id, y, x, values…).

    params(mosaic_id, center_x, center_y, top_left, top_right, bottom_left,
    bottom_right); shapes(sample_id, h, w). Sources are resized to fit `size`
    by the nearest rule. Canvas pixels outside every pasted box are generated
    from the box arithmetic, so pixels are never joined to a canvas.
    """
    big_h, big_w = size[0] * 2, size[1] * 2
    parts = params.select("mosaic_id", "center_x", "center_y", F.explode(F.array(*[
        F.struct(F.lit(q).alias("quadrant"), F.col(q).alias("sample_id")) for q in QUADRANTS])).alias("p"))
    # A row per image: files of few bytes would have Spark send this table to the driver.
    sized = parts.select("mosaic_id", "center_x", "center_y", "p.*").join(shapes.hint("merge"), "sample_id")
    ratio = F.least(F.lit(float(size[0])) / F.col("h"), F.lit(float(size[1])) / F.col("w"))
    sized = sized.withColumns({"nh": F.floor(F.col("h") * ratio).cast("int"), "nw": F.floor(F.col("w") * ratio).cast("int")})
    left, top = F.col("quadrant").endswith("left"), F.col("quadrant").startswith("top")
    cx, cy, nw, nh = (F.col(c) for c in ("center_x", "center_y", "nw", "nh"))
    box = {"px1": F.when(left, F.greatest(cx - nw, F.lit(0))).otherwise(cx),
           "py1": F.when(top, F.greatest(cy - nh, F.lit(0))).otherwise(cy),
           "px2": F.when(left, cx).otherwise(F.least(cx + nw, F.lit(big_w))),
           "py2": F.when(top, cy).otherwise(F.least(cy + nh, F.lit(big_h)))}
    placed = sized.withColumns(box)
    # Left and top parts keep their far corner, the others their near one.
    placed = placed.withColumns({
        "dx": F.when(left, F.col("px2") - nw).otherwise(F.col("px1")), "dy": F.when(top, F.col("py2") - nh).otherwise(F.col("py1"))})
    joined = _scatter_into(px, placed, fill)
    corners = ("px1", "py1", "px2", "py2")
    boxes = placed.groupBy("mosaic_id").agg(*[F.max(F.when(F.col("quadrant") == q, F.col(c))).alias(f"{q}_{c}")
                                              for q in QUADRANTS for c in corners])
    inside = lambda q: ((F.col("x") >= F.col(f"{q}_px1")) & (F.col("x") < F.col(f"{q}_px2"))
                        & (F.col("y") >= F.col(f"{q}_py1")) & (F.col("y") < F.col(f"{q}_py2")))
    covered = inside(QUADRANTS[0]) | inside(QUADRANTS[1]) | inside(QUADRANTS[2]) | inside(QUADRANTS[3])
    bare = (boxes.withColumn("y", _axis(F.lit(big_h))).withColumn("x", _axis(F.lit(big_w)))
            .filter(~covered).select("mosaic_id", "y", "x", *[F.lit(v).alias(c) for c, v in fill.items()]))
    return joined.unionByName(bare)


def _scatter_into(px: DataFrame, placed: DataFrame, fill: dict) -> DataFrame:
    """Pixels of each used sample, resized and moved into its box. A sample may serve many mosaics, so
    the uses are spread with the pixels' own salt."""
    salts = 16
    uses = placed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = px.select("sample_id", "y", "x", *fill).withColumn(
        "__salt", salt(px, ["sample_id"], salts))
    moved = spread.join(uses.hint("merge"), ["sample_id", "__salt"])
    out = resize_nearest(moved, F.col("h"), F.col("w"), F.col("nh"), F.col("nw"))
    out = out.withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")})
    inside = (F.col("x") >= F.col("px1")) & (F.col("x") < F.col("px2")) & (F.col("y") >= F.col("py1")) & (F.col("y") < F.col("py2"))
    return out.filter(inside).select("mosaic_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *fill)


def mix_partners(samples: DataFrame, partners: int = 3, seed: int = 0, draw=None) -> DataFrame:
    """(sample_id, k, partner_id): reproducible partners drawn by index over the whole set."""
    indexed = row_numbers(samples.select("sample_id"), [F.col("sample_id")], name="idx")
    n = samples.count()
    draws = indexed.select("sample_id", F.explode(F.sequence(F.lit(1), F.lit(partners))).alias("k")).withColumn(
        "idx", (F.floor((draw or C.hashed(seed))(0, F.col("sample_id"), F.col("k")) * n) + 1).cast("bigint"))
    return draws.join(indexed.select("idx", F.col("sample_id").alias("partner_id")), "idx").select("sample_id", "k", "partner_id")


def cut_out(px: DataFrame, holes: DataFrame, fill: dict[str, int | float]) -> DataFrame:
    """Overwrite the columns named in `fill` inside holes(sample_id, x1, y1, x2, y2); a few holes per sample."""
    lists = holes.groupBy("sample_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("holes"))
    hit = F.exists("holes", lambda b: (F.col("x") >= b["x1"]) & (F.col("x") < b["x2"]) & (F.col("y") >= b["y1"]) & (F.col("y") < b["y2"]))
    joined = join_side(px, lists, ["sample_id"], "left").withColumn("__hit", F.coalesce(hit, F.lit(False)))
    return joined.select(*[F.when(F.col("__hit"), F.lit(fill[c])).otherwise(F.col(c)).alias(c) if c in fill else F.col(c)
                           for c in px.columns])


def concat_channels(first: DataFrame, second: DataFrame, channels: int) -> DataFrame:
    return first.unionByName(second.withColumn("c", F.col("c") + channels).select(*first.columns))


def depth_mix(image: DataFrame, depth: DataFrame, params: DataFrame, channels: int) -> DataFrame:
    """Replace columns left .. left+width-1 of every channel by depth(sample_id, y, x, v).

    The strip is taken from the depth table and the rest from the image, so
    the two pixel tables are appended, not joined.
    """
    strip = F.col("x").between(F.col("left"), F.col("left") + F.col("width") - 1)
    side = params.select("sample_id", "left", "width")
    kept = join_side(image, side, ["sample_id"], "left").filter(~F.coalesce(strip, F.lit(False)))
    new = join_side(depth, side, ["sample_id"]).filter(strip).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    cols = ["sample_id", "y", "x", "c", "v"]
    return kept.select(*cols).unionByName(new.select(*cols))


def depth_mix_strip(width: Column, seed: int, ratio: float = 0.75) -> tuple[Column, Column]:
    """Reproducible (left, width) of the strip for an image `width` wide."""
    left = F.floor(width * C.unit_draw(seed, F.col("sample_id"), F.lit("left"))).cast("int")
    size = F.greatest(F.lit(1), F.floor((width - left) * ratio * C.unit_draw(seed, F.col("sample_id"), F.lit("width"))).cast("int"))
    return left, size


# --- neighbourhoods ---------------------------------------------------------

def edge_map(px: DataFrame, width: int = 3, ignore: int = 255, side: int = 256) -> DataFrame:
    """(sample_id, y, x, edge): a pixel is an edge when its label differs from the one above, to the
    right, or on a lower diagonal, both not ignored; then dilated by a width x width square.

    One shuffle, by blocks of `side` x `side` pixels. Pixels that `px` lacks or whose label is NULL count as ignored.
    """
    before, after = width // 2, width - 1 - width // 2
    reach = 1 + max(before, after)

    def work(block):
        gt = block.grid("gt", ignore, pad=1)
        h, w = block.shape
        own = gt[:, 1:-1, 1:-1]
        edge = np.zeros(block.full, bool)
        for dy, dx in ((-1, 0), (0, 1), (1, -1), (1, 1)):
            other = gt[:, 1 + dy:1 + dy + h, 1 + dx:1 + dx + w]
            edge |= (own != other) & (own != ignore) & (other != ignore)
        for axis in (1, 2) if width > 1 else ():
            edge = window_any(edge, before, after, axis)
        return edge[block.at].astype(np.int32)

    rows = px.select("sample_id", "y", "x", F.col("gt").cast("int").alias("gt")).filter("gt is not null")
    side = max(side, 2 * reach)
    return over_blocks(rows, ["sample_id"], ["y", "x"], [side] * 2, [reach] * 2, work, T.StructField("edge", T.IntegerType()),
                       ["sample_id", "y", "x"])


def boundary_pyramid(px: DataFrame, h: Column, w: Column, side: int = 256) -> DataFrame:
    """(sample_id, y, x, boundary): Laplacian responses at strides 1, 2 and 4, thresholded at 0.1 and
    fused with weights 6 : 3 : 1. Labels enter the filter as they are; outside counts as zero.

    `h` and `w` are the image's size, as literals or columns of `px`. A coarse
    response is taken at every stride-th pixel and read back by the floor rule,
    so it lies less than a stride away: one shuffle, by blocks with four rows of margin.
    """
    rows = px.select("sample_id", "y", "x", F.col("gt").cast("bigint").alias("gt"), h.cast("int").alias("__h"), w.cast("int").alias("__w"))

    def work(block):
        gt = block.grid("gt", 0, pad=1)
        n, m = block.shape
        around = sum(gt[:, i:i + n, j:j + m] for i in range(3) for j in range(3))
        there = np.zeros(block.full, bool)
        there[block.at] = True
        hot = (9 * gt[:, 1:-1, 1:-1] - around > 0) & there
        fused = 6 * hot[block.at].astype(np.int32)
        for stride, weight in ((2, 3), (4, 1)):
            inside = np.ones(len(fused), bool)
            source = []
            for axis, length in enumerate(("__h", "__w")):
                size = block.table.column(length).to_numpy().astype(np.int64)
                at = block.place[axis] * -(-size // stride) // size * stride - block.lo[axis]
                inside &= (block.place[axis] < size) & (at >= 0) & (at < block.shape[axis])
                source.append(np.clip(at, 0, block.shape[axis] - 1))
            fused += weight * (hot[(block.which, *source)] & inside)
        return (fused > 1).astype(np.int32)

    return over_blocks(rows, ["sample_id"], ["y", "x"], [side] * 2, [4] * 2, work, T.StructField("boundary", T.IntegerType()),
                       ["sample_id", "y", "x"])
