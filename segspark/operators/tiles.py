"""Tile grids, cutting, stitching and write-back. Grids need (sample_id, h, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.runtime import join_pixels, join_side


def _steps(size: Column, clip: int, stride: int) -> Column:
    """Last tile index along one axis."""
    n = F.ceil((size - clip) / F.lit(float(stride)))
    return F.when(n * stride + clip >= size, n).otherwise(n + 1).cast("int")


def tile_grid(meta: DataFrame, clip: int, stride: int, unique: bool = True) -> DataFrame:
    """(sample_id, seq, x1, y1, x2, y2). Origins step by `clip` while the counts follow `stride`;
    a tile over the border is shifted inward. Boxes that fall together are kept once unless `unique`
    is off, under the smallest seq."""
    cols, rows = _steps(F.col("w"), clip, stride), _steps(F.col("h"), clip, stride)
    axis = lambda last: F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0))))
    cells = (meta.select("sample_id", "h", "w", cols.alias("nc")).withColumn("row", axis(rows))
             .withColumn("col", axis(F.col("nc"))))
    edge = lambda i, size: F.least(F.col(i) * clip, F.col(size) - clip)
    stop = lambda i, size: F.least(F.col(i) * clip + clip, F.col(size))
    boxes = cells.select("sample_id", (F.col("row") * (F.col("nc") + 1) + F.col("col")).alias("seq"),
                         edge("col", "w").alias("x1"), edge("row", "h").alias("y1"),
                         stop("col", "w").alias("x2"), stop("row", "h").alias("y2"))
    if not unique:
        return boxes
    return boxes.groupBy("sample_id", "x1", "y1", "x2", "y2").agg(F.min("seq").alias("seq"))


def overlap_grid(meta: DataFrame, patch_h: int, patch_w: int, overlap: int) -> DataFrame:
    """Distinct boxes of step patch - overlap. A side is padded up to the patch when it is smaller,
    unless the other side equals its patch exactly."""
    h, w = F.col("h"), F.col("w")
    pad_h = F.when((h < patch_h) & (w != patch_w), F.lit(patch_h)).otherwise(h)
    pad_w = F.when((w < patch_w) & (h != patch_h), F.lit(patch_w)).otherwise(w)
    axis = lambda size, step: F.explode(F.sequence(F.lit(0), F.col(size) - 1, F.lit(step)))
    cells = (meta.select("sample_id", pad_h.alias("ph"), pad_w.alias("pw"))
             .withColumn("x", axis("pw", patch_w - overlap)).withColumn("y", axis("ph", patch_h - overlap)))
    x2, y2 = F.least(F.col("x") + patch_w, F.col("pw")), F.least(F.col("y") + patch_h, F.col("ph"))
    return cells.select("sample_id", (x2 - patch_w).alias("x1"), (y2 - patch_h).alias("y1"),
                        x2.alias("x2"), y2.alias("y2")).distinct()


def window_grid(meta: DataFrame, win_w: int, win_h: int, stride_x: int = 0, stride_y: int = 0) -> DataFrame:
    """(sample_id, grid_seq, x_off, y_off, x_size, y_size, x_crop_off, y_crop_off, x_crop_size, y_crop_size)."""
    sx, sy = stride_x or win_w, stride_y or win_h
    half_x, half_y = (win_w - sx + 1) // 2, (win_h - sy + 1) // 2
    axis = lambda size, step: F.explode(F.sequence(F.lit(0), F.col(size) - 1, F.lit(step)))
    cells = meta.withColumn("y", axis("h", sy)).withColumn("x", axis("w", sx))

    def side(pos: str, size: str, win: int, half: int) -> tuple[Column, Column, Column]:
        last = F.col(pos) + win >= F.col(size)
        off = F.when(last, F.col(size) - win).otherwise(F.col(pos))
        crop = F.when(off == 0, 0).otherwise(half)
        return off, crop, F.when(last, win).otherwise(F.lit(win) - crop)

    x_off, x_crop, x_len = side("x", "w", win_w, half_x)
    y_off, y_crop, y_len = side("y", "h", win_h, half_y)
    per_row = F.ceil(F.col("w") / F.lit(float(sx)))
    seq = (F.expr(f"y div {sy}") * per_row + F.expr(f"x div {sx}")).cast("bigint")
    return cells.select("sample_id", seq.alias("grid_seq"), x_off.alias("x_off"), y_off.alias("y_off"),
                        F.lit(win_w).alias("x_size"), F.lit(win_h).alias("y_size"), x_crop.alias("x_crop_off"),
                        y_crop.alias("y_crop_off"), x_len.alias("x_crop_size"), y_len.alias("y_crop_size"))


def slide_windows(size: Column, crop: int, stride: int) -> Column:
    """Start positions of the sliding windows along one axis, last ones shifted inward."""
    n = F.floor(F.greatest(size - crop + stride - 1, F.lit(0)) / stride)
    return F.array_distinct(F.transform(F.sequence(F.lit(0).cast("bigint"), n),
                                        lambda i: F.greatest(F.least(i * stride + crop, size) - crop, F.lit(0)).cast("int")))


def cover_slide(px: DataFrame, height: Column, width: Column, crop: int, stride: int) -> DataFrame:
    """Copy every pixel to the sliding windows that cover it: adds (wy, wx), the window origin.

    The covering windows come from arithmetic on the pixel position: regular
    window i covers [i*stride, i*stride + crop), and the shifted last window
    ends at the border.
    """
    def starts(pos: str, size: Column) -> Column:
        p = F.col(pos)
        last = F.greatest(size - crop, F.lit(0))
        n = F.floor((last + stride - 1) / stride)
        lo = F.when(p < crop, 0).otherwise(F.floor((p - crop + stride) / stride))
        hi = F.least(F.floor(p / stride), n - 1)
        regular = [F.when(lo + i <= hi, (lo + i) * stride) for i in range(-(-crop // stride))]
        return F.explode(F.array(*regular, F.when(p >= last, last)).cast("array<int>"))

    return (px.withColumn("wy", starts("y", height)).filter("wy is not null")
            .withColumn("wx", starts("x", width)).filter("wx is not null"))


def cut_regular(px: DataFrame, size: int) -> DataFrame:
    """Tiles that do not overlap: adds tile_y, tile_x and moves the origin."""
    return (px.withColumn("tile_y", F.expr(f"cast(y div {size} as int)")).withColumn("tile_x", F.expr(f"cast(x div {size} as int)"))
            .withColumn("y", F.col("y") % size).withColumn("x", F.col("x") % size))


def cut_tiles(px: DataFrame, grid: DataFrame, clip: int) -> DataFrame:
    """Tiles of a grid of clip x clip boxes: pixels get (x1, y1) of each covering box and local y, x.

    Both sides meet on `clip`-sized cells: a box touches at most four of them
    and a pixel lies in one, so the join key is exact and the fan-out bounded.
    """
    extra = [c for c in grid.columns if c not in px.columns and c not in ("x1", "y1", "x2", "y2")]
    axis = lambda c: F.explode(F.array_distinct(F.array(F.floor(F.col(c) / clip), F.floor((F.col(c) + clip - 1) / clip))))
    spots = grid.select("sample_id", "x1", "y1", *extra).withColumn("cx", axis("x1")).withColumn("cy", axis("y1"))
    cells = px.withColumn("cx", F.floor(F.col("x") / clip)).withColumn("cy", F.floor(F.col("y") / clip))
    inside = F.col("x").between(F.col("x1"), F.col("x1") + clip - 1) & F.col("y").between(F.col("y1"), F.col("y1") + clip - 1)
    return (join_side(cells, spots, ["sample_id", "cx", "cy"], salts=1).filter(inside).drop("cx", "cy")
            .withColumn("x", F.col("x") - F.col("x1")).withColumn("y", F.col("y") - F.col("y1")))


def write_back(blocks: DataFrame) -> DataFrame:
    """blocks: window_grid columns + local (y, x) + pred. Keeps the un-haloed part of each window;
    the window with the highest grid_seq wins a pixel."""
    ly, lx = F.col("y"), F.col("x")
    inner = (ly.between(F.col("y_crop_off"), F.col("y_crop_off") + F.col("y_crop_size") - 1)
             & lx.between(F.col("x_crop_off"), F.col("x_crop_off") + F.col("x_crop_size") - 1))
    placed = blocks.filter(inner).select("sample_id", (ly + F.col("y_off")).cast("int").alias("y"),
                                         (lx + F.col("x_off")).cast("int").alias("x"), "grid_seq", "pred")
    return placed.groupBy("sample_id", "y", "x").agg(F.max_by("pred", "grid_seq").alias("pred"))


def stitch(windows: DataFrame, values: list[str]) -> DataFrame:
    """Mean of each value over the windows that cover a pixel, and the cover count."""
    return windows.groupBy("sample_id", "y", "x").agg(
        *[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("cover"))


def stitch_logits(windows: DataFrame, classes: int) -> DataFrame:
    """(sample_id, y, x, logits, cover) from windowed (…, logits); one row per pixel and window is shuffled."""
    names = [f"l{i}" for i in range(classes)]
    flat = windows.select("sample_id", "y", "x", *[F.get("logits", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return stitch(flat, names).select("sample_id", "y", "x", F.array(*names).alias("logits"), "cover")


def uncovered(meta: DataFrame, stitched: DataFrame) -> DataFrame:
    """Samples whose stitched pixels do not fill (h, w): (sample_id, missing)."""
    got = stitched.select("sample_id", "y", "x").distinct().groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    return (meta.join(got, "sample_id", "left")
            .withColumn("missing", F.col("h").cast("bigint") * F.col("w") - F.coalesce("n", F.lit(0)))
            .filter("missing > 0").select("sample_id", "missing"))


def stitch_with_flip(plain: DataFrame, flipped: DataFrame, crop: int) -> DataFrame:
    """Depth stitching: the mirrored prediction is turned back inside its window (wy, wx), averaged with
    the plain one, then windows are averaged per pixel."""
    back = flipped.withColumn("x", 2 * F.col("wx") + crop - 1 - F.col("x"))
    both = plain.select("sample_id", "wy", "wx", "y", "x", "v").unionByName(back.select("sample_id", "wy", "wx", "y", "x", "v"))
    per_window = both.groupBy("sample_id", "wy", "wx", "y", "x").agg(F.avg("v").alias("v"))
    return per_window.groupBy("sample_id", "y", "x").agg(F.avg("v").alias("v"))


def crop_layers(meta: DataFrame, layers: int, overlap_ratio: float) -> DataFrame:
    """(sample_id, layer, x1, y1, x2, y2): layer i has (2^i)^2 overlapping boxes, layer 0 the whole image."""
    base = (meta.select("sample_id", "h", "w", F.explode(F.sequence(F.lit(0), F.lit(layers))).alias("layer"))
            .withColumn("n", F.pow(F.lit(2), F.col("layer")).cast("int")))
    overlap = F.floor(F.lit(overlap_ratio) * F.least("h", "w") * (F.lit(2.0) / F.col("n")))
    base = base.withColumn("o", F.when(F.col("layer") == 0, F.lit(0).cast("bigint")).otherwise(overlap))
    length = lambda side: F.ceil((F.col("o") * (F.col("n") - 1) + F.col(side)) / F.col("n").cast("double"))
    axis = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    cells = (base.withColumn("cw", length("w")).withColumn("ch", length("h")).withColumn("i", axis).withColumn("j", axis))
    x0, y0 = (F.col("cw") - F.col("o")) * F.col("i"), (F.col("ch") - F.col("o")) * F.col("j")
    return cells.select("sample_id", "layer", x0.cast("int").alias("x1"), y0.cast("int").alias("y1"),
                        F.least(x0 + F.col("cw"), F.col("w")).cast("int").alias("x2"),
                        F.least(y0 + F.col("ch"), F.col("h")).cast("int").alias("y2"))


def point_grid(meta: DataFrame, per_side: int, layers: int, scale_per_layer: int) -> DataFrame:
    """(sample_id, layer, px, py) in image coordinates: evenly spaced points, fewer on deeper layers."""
    sizes = F.array(*[F.lit(int(per_side / scale_per_layer**i)) for i in range(layers + 1)])
    base = meta.select("sample_id", "h", "w", F.posexplode(sizes).alias("layer", "n")).filter("n > 0")
    axis = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    cells = base.withColumn("i", axis).withColumn("j", axis)
    at = lambda k: (F.col(k) * 2 + 1) / (F.col("n") * 2).cast("double")
    return cells.select("sample_id", "layer", (at("i") * F.col("w")).alias("px"), (at("j") * F.col("h")).alias("py"))


def pad_patch(cut: DataFrame, grid: DataFrame, patch_h: int, patch_w: int, fill: int) -> DataFrame:
    """Complete cut tiles to full patches: missing pixels take `fill`."""
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    canvas = grid.select("sample_id", "x1", "y1").withColumn("y", axis(patch_h)).withColumn("x", axis(patch_w))
    return (join_pixels(canvas, cut, ["sample_id", "x1", "y1", "y", "x"], "left")
            .withColumn("gt", F.coalesce("gt", F.lit(fill))))
