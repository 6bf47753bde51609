"""Volumetric work on voxels (sample_id, c, z, y, x, v, gt)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.functions import columns as C
from segspark.operators.blocks import mirrored, over_blocks
from segspark.runtime import join_side

AXES = ("z", "y", "x")


def pick_foreground(vox: DataFrame, voxel_key: Column, class_key: Column) -> DataFrame:
    """(sample_id, class_id, z, y, x): one foreground class per sample by the smallest class key, and of it
    the voxel with the smallest voxel key. Both keys need ties broken by position, which is added."""
    fg = vox.filter(F.col("gt") > 0).withColumns({"__vk": voxel_key, "__ck": class_key})
    order = F.struct("__vk", "z", "y", "x")
    per_class = fg.groupBy("sample_id", "gt").agg(F.min(order).alias("v"), F.min("__ck").alias("__ck"))
    return (per_class.groupBy("sample_id").agg(F.min_by(F.struct("gt", "v"), F.struct("__ck", "gt")).alias("p"))
            .select("sample_id", F.col("p.gt").alias("class_id"), *[F.col(f"p.v.{a}").alias(a) for a in AXES]))


def foreground_boxes(shapes: DataFrame, picked: DataFrame, size: tuple[int, int, int], draws: tuple[Column, Column, Column]) -> DataFrame:
    """(sample_id, z1, y1, x1, z2, y2, x2). The margin is the picked voxel minus half the crop, clamped to
    the volume (the full slack when nothing is picked); the start is drawn in 0..margin by draws in [0, 1)."""
    out = shapes.select("sample_id", F.col("d").alias("n_z"), F.col("h").alias("n_y"), F.col("w").alias("n_x")).join(
        picked.select("sample_id", *AXES), "sample_id", "left")
    for a, s, u in zip(AXES, size, draws):
        slack = F.greatest(F.col(f"n_{a}") - s, F.lit(0))
        margin = F.when(F.col(a).isNull(), slack).otherwise(
            F.greatest(F.least(F.greatest(F.col(a) - s // 2, F.lit(0)), F.col(f"n_{a}") - s), F.lit(0)))
        out = out.withColumn(f"{a}1", F.floor(u * (margin + 1)).cast("int")).withColumn(f"{a}2", F.col(f"{a}1") + s)
    return out.select("sample_id", *[f"{a}1" for a in AXES], *[f"{a}2" for a in AXES])


def crop(vox: DataFrame, boxes: DataFrame) -> DataFrame:
    cols = vox.columns
    out = join_side(vox, boxes, ["sample_id"])
    for a in AXES:
        out = out.filter((F.col(a) >= F.col(f"{a}1")) & (F.col(a) < F.col(f"{a}2"))).withColumn(a, (F.col(a) - F.col(f"{a}1")).cast("int"))
    return out.select(*cols)


def gaussian_noise(vox: DataFrame, mean: float = 0.0, std: float = 0.1, prob: float = 0.1, seed: int = 0,
                   draw=None) -> DataFrame:
    """Reproducible noise (two hashed uniforms per voxel) for a hashed share of the samples."""
    keys = [F.col(c) for c in ("sample_id", "c", "z", "y", "x")]
    draw = draw or C.hashed(seed)
    u = F.greatest(draw(1, *keys), F.lit(1e-12))
    noise = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * draw(2, *keys)) * std + mean
    chosen = draw(3, F.col("sample_id")) < prob
    return vox.withColumn("v", F.when(chosen, F.col("v") + noise).otherwise(F.col("v")))


def gaussian_blur(vox: DataFrame, shape: tuple[int, int, int], sigma: tuple[float, float, float], truncate: float = 4.0,
                  side: int = 32) -> DataFrame:
    """Separable blur of v along z, y and x, mirrored at the border (edge voxel repeated); other columns stay.

    One shuffle, by blocks with a margin of the kernel's radius; the three axes are
    blurred inside a block, many blocks at once. Voxels that are missing or NULL count as zero. A
    block's side is at least four radii, so a voxel travels to few blocks and a task holds one block or a chunk of rows.
    """
    radius = [int(truncate * s + 0.5) if s > 0 else 0 for s in sigma]

    def work(block):
        v = block.grid("v", 0.0)
        for axis, (n, s, r) in enumerate(zip(shape, sigma, radius)):
            if r == 0:
                continue
            weights = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
            wide, size = mirrored(v, block.lo[axis], n, r, axis + 1), v.shape[axis + 1]
            ahead = (slice(None),) * (axis + 1)
            v = sum(w * wide[(*ahead, slice(k, k + size))] for k, w in enumerate(weights / weights.sum()))
        return v[block.at]

    rows = vox.withColumn("v", F.col("v").cast("double"))
    keys = [c for c in ("sample_id", "c") if c in vox.columns]
    return over_blocks(rows, keys, list(AXES), [max(side, 4 * r) for r in radius], radius, work, T.StructField("v", T.DoubleType()), vox.columns)


def adjust_gamma(vox: DataFrame, gamma: Column, per_channel: bool = False, invert: bool = False, retain_stats: bool = False) -> DataFrame:
    """Power curve between the minimum and maximum of a sample (or of each channel); `retain_stats`
    restores the old mean and deviation afterwards. `gamma` is an expression over the voxel columns."""
    keys = ["sample_id", "c"] if per_channel else ["sample_id"]
    sign = -1 if invert else 1
    base = vox.withColumns({"v": F.col("v") * sign, "__g": gamma})
    stats = base.groupBy(*keys).agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"), F.avg("v").alias("__m"), F.stddev_pop("v").alias("__s"))
    span = F.col("__hi") - F.col("__lo")
    curved = join_side(base, stats, keys).withColumn(
        "v", F.pow((F.col("v") - F.col("__lo")) / (span + 1e-7), F.col("__g")) * span + F.col("__lo"))
    if retain_stats:
        after = curved.groupBy(*keys).agg(F.avg("v").alias("__m2"), F.stddev_pop("v").alias("__s2"))
        curved = join_side(curved, after, keys).withColumn(
            "v", (F.col("v") - F.col("__m2")) / (F.col("__s2") + 1e-8) * F.col("__s") + F.col("__m"))
    return curved.withColumn("v", F.col("v") * sign).select(*vox.columns)


def pad_centre(vox: DataFrame, shapes: DataFrame, size: tuple[int, int, int], value: float = 0.0, label: int = 0, channels: int = 1) -> DataFrame:
    """Centre each volume in at least `size`; half of the missing part (rounded down) goes in front.
    shapes(sample_id, d, h, w). Only added voxels are generated; pixels are shifted in place."""
    names = dict(zip(AXES, ("d", "h", "w")))
    spec = shapes.select("sample_id", "d", "h", "w")
    for a, s in zip(AXES, size):
        n = F.col(names[a])
        spec = spec.withColumns({f"f_{a}": F.floor(F.greatest(F.lit(s) - n, F.lit(0)) / 2).cast("int"), f"t_{a}": F.greatest(F.lit(s), n)})
    moved = join_side(vox, spec.select("sample_id", "f_z", "f_y", "f_x"), ["sample_id"])
    moved = moved.withColumns({a: F.col(a) + F.col(f"f_{a}") for a in AXES}).select(*vox.columns)
    grid = spec
    for a in AXES:
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.col(f"t_{a}") - 1)))
    inside = F.lit(True)
    for a in AXES:
        inside = inside & (F.col(a) >= F.col(f"f_{a}")) & (F.col(a) < F.col(f"f_{a}") + F.col(names[a]))
    added = grid.filter(~inside).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    added = added.withColumns({"v": F.lit(float(value)), "gt": F.lit(label)})
    return moved.unionByName(added.select(*vox.columns))


def flip(vox: DataFrame, shape: tuple[int, int, int], axes: tuple[Column, Column, Column],
         swap_pairs: list[tuple[int, int]] | None = None) -> DataFrame:
    """Mirror along z, y, x where the flag of the axis is true; label pairs are swapped in every volume
    that is given, as left and right change sides."""
    out = vox
    for a, n, flag in zip(AXES, shape, axes):
        out = out.withColumn(a, F.when(flag, n - 1 - F.col(a)).otherwise(F.col(a)))
    if swap_pairs:
        mapping = {p: q for a, b in swap_pairs for p, q in ((a, b), (b, a))}
        out = out.withColumn("gt", C.lookup(F.col("gt"), mapping))
    return out


def transpose_axes(vox: DataFrame) -> DataFrame:
    """XYZ to ZYX and back: a rename."""
    swap = {"z": "x", "x": "z"}
    return vox.select(*[F.col(swap.get(c, c)).alias(c) for c in vox.columns])
