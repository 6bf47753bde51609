"""Photometric work on image tables (sample_id, y, x, c, v) and drawing helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.operators.blocks import group_chunks, together
from segspark.runtime import join_pixels, join_side


def normalise(image: DataFrame, mean: list[float], std: list[float]) -> DataFrame:
    pick = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("c"))
    return image.withColumn("v", (F.col("v") - pick(mean)) / pick(std))


def swap_channels(image: DataFrame, channels: int = 3) -> DataFrame:
    """BGR to RGB or back; images without three channels stay."""
    return image if channels != 3 else image.withColumn("c", 2 - F.col("c"))


def rerange(image: DataFrame, lo: float = 0.0, hi: float = 255.0) -> DataFrame:
    """Stretch min..max of each sample to [lo, hi]; a constant sample fails the job."""
    ends = image.groupBy("sample_id").agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    span = F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo")).otherwise(
        F.raise_error(F.concat(F.lit("constant image: "), F.col("sample_id").cast("string"))).cast("double"))
    return (join_side(image, ends, ["sample_id"])
            .withColumn("v", (F.col("v") - F.col("__lo")) / span * (hi - lo) + lo).select(*image.columns))


def to_gray(image: DataFrame, weights: tuple = (0.299, 0.587, 0.114), out_channels: int | None = None) -> DataFrame:
    """Weighted channel sum repeated to `out_channels` (as many as weights when not given)."""
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("c"))
    gray = image.groupBy("sample_id", "y", "x").agg(F.sum(F.col("v") * w).alias("v"))
    n = len(weights) if out_channels is None else out_channels
    return gray.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("sample_id", "y", "x", "c", "v")


def adjust_gamma(v: Column, gamma: float) -> Column:
    """The 8-bit gamma curve, truncated as a lookup table would hold it."""
    return F.floor(F.pow(v / 255.0, F.lit(1.0 / gamma)) * 255).cast("int")


def linear(v: Column, alpha: float | Column = 1.0, beta: float | Column = 0.0) -> Column:
    """Brightness and contrast: clip(alpha * v + beta, 0, 255), truncated."""
    a = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    b = F.lit(beta) if isinstance(beta, (int, float)) else beta
    return F.floor(F.least(F.greatest(v * a + b, F.lit(0.0)), F.lit(255.0))).cast("int")


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit HSV: hue in half degrees 0..179, saturation and value 0..255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    sat = F.when(top == 0, 0).otherwise(F.rint(span * 255.0 / top))
    deg = (F.when(span == 0, F.lit(0.0)).when(top == r, 60.0 * (g - b) / span)
           .when(top == g, 120.0 + 60.0 * (b - r) / span).otherwise(240.0 + 60.0 * (r - g) / span))
    deg = F.when(deg < 0, deg + 360).otherwise(deg)
    hue = F.pmod(F.rint(deg / 2).cast("int"), F.lit(180))
    return hue, sat.cast("int"), top.cast("int")


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    sector = F.floor(h / 30.0).cast("int")
    part = h / 30.0 - sector
    sat = s / 255.0
    p, q, t = v * (1 - sat), v * (1 - sat * part), v * (1 - sat * (1 - part))
    pick = lambda seq: F.rint(F.get(F.array(*[c.cast("double") for c in seq]), sector)).cast("int")
    return pick((v, q, p, p, t, v)), pick((t, v, v, q, p, p)), pick((p, p, t, v, v, q))


def saturate(px: DataFrame, alpha: Column) -> DataFrame:
    """Wide pixels (r, g, b): scale the saturation, clipped to 0..255 and truncated."""
    h, s, v = rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    hsv = px.withColumns({"__h": h, "__s": linear(s.cast("double"), alpha), "__v": v})
    return _back(hsv, px.columns)


def shift_hue(px: DataFrame, delta: Column) -> DataFrame:
    h, s, v = rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    hsv = px.withColumns({"__h": F.pmod(h + delta, F.lit(180)), "__s": s, "__v": v})
    return _back(hsv, px.columns)


def _back(hsv: DataFrame, columns: list[str]) -> DataFrame:
    r, g, b = hsv_to_rgb(F.col("__h"), F.col("__s"), F.col("__v"))
    return hsv.select(*[{"r": r, "g": g, "b": b}.get(c, F.col(c)).alias(c) for c in columns])


def distort(px: DataFrame, params: DataFrame) -> DataFrame:
    """Photometric distortion of wide pixels with params(sample_id, brightness, contrast, saturation, hue,
    contrast_last); NULL leaves a step out. Contrast runs before the colour steps, or after them when
    `contrast_last`."""
    names = ("brightness", "contrast", "saturation", "hue", "contrast_last")
    whole = T.IntegerType()
    schema = T.StructType([T.StructField(f.name, whole) if f.name in ("r", "g", "b") else f for f in px.schema])
    out = join_side(px.withColumns({c: F.col(c).cast("double") for c in ("r", "g", "b")}), params.select("sample_id", *names), ["sample_id"])
    sent = out.select(*px.columns, *[F.col(c).cast("boolean" if c == "contrast_last" else "double").alias(f"__{c}") for c in names])

    # As generated code the steps are one method that is too long to be compiled, so they are taken on arrays.
    def walk(batches):
        for batch in batches:
            value = lambda c, none: pc.fill_null(batch.column(c), none).to_numpy(zero_copy_only=False)
            last, contrast = value("__contrast_last", False), value("__contrast", 1.0)
            # A channel without a value is black.
            rgb = [np.where(batch.column(c).is_valid().to_numpy(zero_copy_only=False), _clipped(value(c, 0.0) * 1.0 + value("__brightness", 0.0)), 0.0) for c in "rgb"]
            rgb = [_clipped(v * np.where(last, 1.0, contrast)) for v in rgb]
            for step in ("__saturation", "__hue"):
                on = batch.column(step).is_valid().to_numpy(zero_copy_only=False)
                if on.any():
                    h, s, v = _hsv(*rgb)
                    if step == "__hue":
                        h = np.mod(h + value(step, 0.0), 180)
                    else:
                        s = _clipped(s * value(step, 1.0))
                    rgb = [np.where(on, new, old) for new, old in zip(_rgb(h, s, v), rgb)]
            rgb = [_clipped(v * np.where(last, contrast, 1.0)).astype(np.int32) for v in rgb]
            told = dict(zip("rgb", rgb))
            yield pa.RecordBatch.from_arrays([pa.array(told[c]) if c in told else batch.column(c) for c in schema.names], names=schema.names)

    return sent.mapInArrow(walk, schema)


def _clipped(v: np.ndarray) -> np.ndarray:
    """`linear` after its sum: NaN is above all values."""
    return np.floor(np.where(np.isnan(v), 255.0, np.clip(v, 0.0, 255.0)))


def _hsv(r, g, b):
    """`rgb_to_hsv` on arrays."""
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = top - low
    some = np.where(span == 0, 1.0, span)
    sat = np.where(top == 0, 0.0, np.rint(span * 255.0 / np.where(top == 0, 1.0, top)))
    deg = np.where(span == 0, 0.0, np.where(top == r, 60.0 * (g - b) / some, np.where(top == g, 120.0 + 60.0 * (b - r) / some, 240.0 + 60.0 * (r - g) / some)))
    return np.mod(np.rint(np.where(deg < 0, deg + 360, deg) / 2), 180), sat, top


def _rgb(h, s, v):
    """`hsv_to_rgb` on arrays."""
    sector = np.floor(h / 30.0).astype(np.int64)
    part, sat = h / 30.0 - sector, s / 255.0
    p, q, t = (np.rint(c) for c in (v * (1 - sat), v * (1 - sat * part), v * (1 - sat * (1 - part))))
    v = np.rint(v)
    return [np.choose(sector, seq) for seq in ((v, q, p, p, t, v), (t, v, v, q, p, p), (p, p, t, v, v, q))]


WHOLE_ROWS = 1 << 20  # of an image, that a task may hold
BINS = 1 << 22  # of the histograms that are made at once


def clahe(image: DataFrame, h: int, w: int, clip_limit: float = 40.0, tiles: tuple[int, int] = (8, 8)) -> DataFrame:
    """Contrast-limited adaptive equalisation of every channel, bins 0..255.

    Histograms are counted per tile; clipped excess is shared evenly, the
    remainder goes one by one to evenly spaced bins. Each pixel then mixes the
    curves of its four nearest tiles. A curve is the running sum of the clipped
    counts, an entry per value, and the shares up to that value. Images are
    equalised where they lie, many side by side; if one has more than
    `WHOLE_ROWS` rows, tiles and pixels meet by groupings. Runs a job that
    counts rows while it is built.
    """
    ty, tx = tiles
    th, tw = -(-h // ty), -(-w // tx)
    area = th * tw
    limit = max(int(clip_limit * area / 256), 1) if clip_limit > 0 else area
    placed = F.concat(*[F.col(c).cast("string") for c in ("c", "y", "x")]).isNotNull()
    beyond = image.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.min(placed).alias("placed")).filter((F.col("n") > WHOLE_ROWS) | ~F.col("placed"))
    if ty * tx * 256 <= BINS and beyond.isEmpty():
        return _clahe_whole(image, h, w, tiles, limit)
    mirrored = lambda pos, n, full: F.explode(F.filter(
        F.array(F.col(pos), 2 * (n - 1) - F.col(pos)), lambda p, i: (i == 0) | ((p >= n) & (p < full))))
    seen = (image.select("sample_id", "c", _binned().alias("v"), mirrored("y", h, th * ty).alias("y"), "x")
            .withColumn("x", mirrored("x", w, tw * tx)))
    hist = (seen.groupBy("sample_id", "c", F.floor(F.col("y") / th).alias("i"), F.floor(F.col("x") / tw).alias("j"), "v")
            .agg(F.count(F.lit(1)).alias("n")))
    tile = ["sample_id", "c", "i", "j"]
    clipped = F.sum(F.least(F.col("n"), F.lit(limit))).over(Window.partitionBy(*tile).orderBy("v")).cast("int")
    # At most 256 bins per tile.
    full = (hist.withColumn("upto", clipped).groupBy(*tile)
            .agg(F.array_sort(F.collect_list(F.struct("v", "upto"))).alias("bins"), F.sum(F.greatest(F.col("n") - limit, F.lit(0))).alias("excess")))
    last = F.transform("bins", lambda b, k: F.array_repeat(b["upto"], F.coalesce(F.get("bins", k + 1)["v"], F.lit(256)) - b["v"]))
    below = F.flatten(F.concat(F.array(F.array_repeat(F.lit(0), F.get("bins", F.lit(0))["v"])), last))
    luts = full.select("sample_id", "c", *[F.col(t).cast("int").alias(t) for t in ("i", "j")], below.alias("below"),
                       F.floor(F.col("excess") / 256).alias("even"), (F.col("excess") % 256).alias("left"))
    step = F.floor(256 / F.greatest("left", F.lit(1)))
    total = F.get("below", F.col("v")) + F.col("even") * (F.col("v") + 1) + F.least("left", F.floor(F.col("v") / step) + 1)
    curve = F.least(F.greatest(F.rint(total * 255.0 / area), F.lit(0.0)), F.lit(255.0))

    fy, fx = F.col("y") / float(th) - 0.5, F.col("x") / float(tw) - 0.5
    corner = lambda f, n: F.array(*[F.struct(F.least(F.greatest(F.floor(f) + k, F.lit(0)), F.lit(n - 1)).cast("int").alias("t"),
                                             (1 - F.abs(f - F.floor(f) - k)).alias("wt")) for k in (0, 1)])
    sent = (image.withColumn("ry", F.explode(corner(fy, ty))).withColumn("rx", F.explode(corner(fx, tx)))
            .select("sample_id", "c", "y", "x", F.col("v").cast("int").alias("v"), F.col("ry.t").alias("i"), F.col("rx.t").alias("j"),
                    (F.col("ry.wt") * F.col("rx.wt")).alias("wt")))
    return (join_side(sent, luts, ["sample_id", "c", "i", "j"], salts=4)
            .groupBy("sample_id", "y", "x", "c").agg(F.sum(curve * F.col("wt")).alias("v"))
            .withColumn("v", F.bround("v", 0).cast("int")))


def _binned() -> Column:
    value = F.col("v").cast("int")
    return F.when(value.between(0, 255), value).otherwise(F.raise_error(F.lit("pixel values must be 0 to 255")).cast("int"))


def _clahe_whole(image: DataFrame, h: int, w: int, tiles: tuple[int, int], limit: int) -> DataFrame:
    """`clahe` of images that a task can hold."""
    ty, tx = tiles
    th, tw = -(-h // ty), -(-w // tx)
    rows = image.select("sample_id", "y", "x", "c", _binned().alias("v"))
    schema = T.StructType([f if f.name != "v" else T.StructField("v", T.IntegerType()) for f in rows.schema])

    def both(pos, n, full):
        """Where a row counts: at its place and, where the padding mirrors it, there too."""
        other = 2 * (n - 1) - pos
        return [(np.ones(len(pos), bool), pos), ((other >= n) & (other < full), other)]

    def corners(pos, size, n):
        f = pos / float(size) - 0.5
        return [(np.clip(np.floor(f) + k, 0, n - 1).astype(np.int64), 1 - np.abs(f - np.floor(f) - k)) for k in (0, 1)]

    def equalised(plane, planes, y, x, v):
        """The mixed value of each row, and whether it met a tile."""
        hist = np.zeros(planes * ty * tx * 256, np.int64)
        for some_y, py in both(y, h, th * ty):
            for some_x, px in both(x, w, tw * tx):
                i, j = py // th, px // tw
                at = some_y & some_x & (i >= 0) & (i < ty) & (j >= 0) & (j < tx)
                if at.any():
                    hist += np.bincount((((plane * ty + i) * tx + j) * 256 + v)[at], minlength=len(hist))
        hist = hist.reshape(planes * ty * tx, 256)
        there = hist.any(axis=1)
        excess, value = np.maximum(hist - limit, 0).sum(axis=1)[:, None], np.arange(256)
        left = excess % 256
        total = np.minimum(hist, limit).cumsum(axis=1) + excess // 256 * (value + 1) + np.minimum(left, value // (256 // np.maximum(left, 1)) + 1)
        curve = np.clip(np.rint(total * 255.0 / (th * tw)), 0.0, 255.0)
        mixed, met = np.zeros(len(v)), np.zeros(len(v), bool)
        for i, wy in corners(y, th, ty):
            for j, wx in corners(x, tw, tx):
                tile = (plane * ty + i) * tx + j
                mixed += np.where(there[tile], curve[tile, v] * (wy * wx), 0.0)
                met |= there[tile]
        return mixed, met

    def walk(batches):
        for table, number in group_chunks(batches, ["sample_id"]):
            known = table.column("sample_id").is_valid().to_numpy()
            table, number = table.filter(pa.array(known)), number[known]
            if not len(number):
                continue
            channel = table.column("c").combine_chunks().dictionary_encode()
            channels = len(channel.dictionary)
            plane = (number - number[0]) * channels + channel.indices.to_numpy()
            y, x, v = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x", "v"))
            mixed, met = np.empty(len(v)), np.empty(len(v), bool)
            step = max(1, BINS // (channels * ty * tx * 256))  # images at once
            cuts = np.flatnonzero(np.r_[True, (number[1:] - number[0]) // step != (number[:-1] - number[0]) // step, True])
            for lo, hi in zip(cuts, cuts[1:]):
                at, first = slice(lo, hi), (number[lo] - number[0]) * channels
                planes = int(number[hi - 1] - number[lo] + 1) * channels
                mixed[at], met[at] = equalised(plane[at] - first, planes, y[at], x[at], v[at])
            # Rows of one pixel and channel are added up.
            wide, tall = int(x.max() - x.min()) + 1, int(y.max() - y.min()) + 1
            pixel = (plane * tall + (y - y.min())) * wide + (x - x.min())
            _, first, of = np.unique(pixel, return_index=True, return_inverse=True)
            if len(first) < len(pixel):
                mixed, met = np.bincount(of, mixed), np.bincount(of, met) > 0
                table = table.take(pa.array(first))
            place = table.schema.get_field_index("v")
            yield from table.set_column(place, "v", pa.array(np.rint(mixed).astype(np.int32))).filter(pa.array(met)).to_batches()

    return together(rows, ["sample_id"]).mapInArrow(walk, schema).select("sample_id", "y", "x", "c", "v")


def image_stats(image: DataFrame) -> DataFrame:
    return image.groupBy("sample_id", "c").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
                                               F.min("v").alias("min"), F.max("v").alias("max"))


def blend(image: DataFrame, labels: DataFrame, palette: DataFrame, alpha: float = 0.8) -> DataFrame:
    """Mix palette(class_id, r, g, b) over RGB channels by label, truncated; labels outside the palette show black."""
    side = palette.select(F.col("class_id").alias("gt"), F.array("r", "g", "b").alias("rgb"))
    coloured = join_side(labels.select("sample_id", "y", "x", "gt"), side, ["gt"], "left").select("sample_id", "y", "x", "rgb")
    joined = join_pixels(image, coloured, ["sample_id", "y", "x"])
    paint = F.coalesce(F.get("rgb", F.col("c")), F.lit(0))
    return joined.select("sample_id", "y", "x", "c", F.floor(F.col("v") * (1 - alpha) + paint * alpha).cast("int").alias("v"))


def label_anchors(px: DataFrame, num_classes: int) -> DataFrame:
    """(sample_id, gt, x, y): the row with most pixels of the class (the first on ties), and the
    middle pixel of that row."""
    rows = px.filter(F.col("gt") < num_classes)
    per_row = rows.groupBy("sample_id", "gt", "y").agg(F.count(F.lit(1)).alias("n"))
    best = per_row.groupBy("sample_id", "gt").agg(F.max_by(F.struct("y", "n"), F.struct("n", -F.col("y"))).alias("b"))
    best = best.select("sample_id", "gt", F.col("b.y").alias("y"), F.floor(F.col("b.n") / 2).alias("k"))
    # One row of one image at a time.
    w = Window.partitionBy("sample_id", "gt", "y").orderBy("x")
    inside = join_side(rows.select("sample_id", "gt", "y", "x"), best, ["sample_id", "gt", "y"])
    return (inside.withColumn("r", F.row_number().over(w)).filter(F.col("r") == F.col("k") + 1)
            .select("sample_id", "gt", "x", "y"))


def side_by_side(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    return left.unionByName(right.withColumn("x", F.col("x") + width))


def stacked(upper: DataFrame, lower: DataFrame, height: int) -> DataFrame:
    return upper.unionByName(lower.withColumn("y", F.col("y") + height))
