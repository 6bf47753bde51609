"""Raster, volume and depth sources, and the sinks for predictions.

Array payloads are cut to tiles or chunks of bounded length, so a huge image
never becomes one row or one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.runtime import require_columns


def to_pixels(rasters: DataFrame) -> DataFrame:
    """(sample_id, h, w, c, data row-major HWC[, y0, x0]) to (sample_id, y, x, c, v)."""
    require_columns(rasters, "sample_id", "h", "w", "c", "data")
    y0 = F.col("y0") if "y0" in rasters.columns else F.lit(0)
    x0 = F.col("x0") if "x0" in rasters.columns else F.lit(0)
    shape_ok = F.size("data") == F.col("h") * F.col("w") * F.col("c")
    data = F.when(shape_ok, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("bad raster shape: "), F.col("sample_id").cast("string"))))
    cells = rasters.select("sample_id", "w", F.col("c").alias("n"), y0.alias("y0"), x0.alias("x0"), F.posexplode(data).alias("p", "v"))
    return cells.select("sample_id", F.expr("cast(p div (n * w) + y0 as int)").alias("y"),
                        F.expr("cast((p div n) % w + x0 as int)").alias("x"), F.expr("cast(p % n as int)").alias("c"), "v")


def pair_rasters(first: DataFrame, second: DataFrame) -> DataFrame:
    """Join two raster tables on sample_id; unequal shapes fail the job."""
    other = second.select("sample_id", *[F.col(c).alias(f"{c}2") for c in ("h", "w", "c", "data")])
    both = first.join(other, "sample_id")
    same = (F.col("h") == F.col("h2")) & (F.col("w") == F.col("w2"))
    checked = F.when(same, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("unequal shapes: "), F.col("sample_id").cast("string"))))
    return both.withColumn("data", checked)


def to_voxels(volumes: DataFrame, reverse_axes: bool = False, label_last: bool = False) -> DataFrame:
    """(sample_id, n, d, h, w, data row-major NZYX) to (sample_id, c, z, y, x, v[, gt]).

    `reverse_axes` reads the axes as XYZ. `label_last` takes the last channel
    as the label of every voxel.
    """
    # Voxel (z, y, x) is the inner product position; the label sits at a fixed
    # distance in the same array, so no join is needed.
    vol = F.col("d") * F.col("h") * F.col("w")
    label = F.get("data", ((F.col("n") - 1) * vol + F.col("p") % vol).cast("int")).cast("int") if label_last else None
    cells = volumes.select("*", F.posexplode("data").alias("p", "v"))
    if label_last:
        cells = cells.withColumn("gt", label).filter(F.col("p") < (F.col("n") - 1) * vol)
    c, a = F.expr("cast(p div (d*h*w) as int)"), F.expr("cast((p div (h*w)) % d as int)")
    b, e = F.expr("cast((p div w) % h as int)"), F.expr("cast(p % w as int)")
    z, y, x = (e, b, a) if reverse_axes else (a, b, e)
    return cells.select("sample_id", c.alias("c"), z.alias("z"), y.alias("y"), x.alias("x"), "v", *(["gt"] if label_last else []))


def scale_depth(depth: DataFrame, factor: float = 1.0, column: str = "gt_depth") -> DataFrame:
    return depth.withColumn(column, F.col(column).cast("float") * F.lit(float(factor)))


def restore_zero_label(label: Column) -> Column:
    return label + 1


def depth_to_uint16(v: Column, scale: float) -> Column:
    """Scaled and truncated toward zero."""
    return F.when(v * scale >= 0, F.floor(v * scale)).otherwise(F.ceil(v * scale)).cast("int")


def to_tiles(px: DataFrame, value: str, tile: int = 256) -> DataFrame:
    """(sample_id, tile_y, tile_x, data): values row-major inside a tile of at most tile x tile pixels."""
    t = F.lit(tile)
    return (px.select("sample_id", F.expr(f"y div {tile}").alias("tile_y"), F.expr(f"x div {tile}").alias("tile_x"),
                      ((F.col("y") % t) * t + F.col("x") % t).alias("p"), F.col(value).alias("v"))
            .groupBy("sample_id", "tile_y", "tile_x")
            .agg(F.array_sort(F.collect_list(F.struct("p", "v")))["v"].alias("data")))


def write_predictions(px: DataFrame, target: str, value: str = "pred", add_one: bool = False, tile: int = 256) -> None:
    """Sink of label maps as tiles; `add_one` undoes the zero-label reduction."""
    out = px.withColumn(value, restore_zero_label(F.col(value))) if add_one else px
    to_tiles(out, value, tile).write.mode("errorifexists").parquet(target)


def pack_chw(image: DataFrame, meta: DataFrame, height: int, width: int, chunk: int = 65536) -> DataFrame:
    """(sample_id, chunk, data, meta): pixels reordered to CHW, in chunks of bounded length.

    meta has one row per sample; all its other columns go into one struct.
    """
    pos = (F.col("c").cast("bigint") * height + F.col("y")) * width + F.col("x")
    packed = (image.select("sample_id", pos.alias("p"), "v").withColumn("chunk", F.expr(f"p div {chunk}"))
              .groupBy("sample_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("p", "v")))["v"].alias("data")))
    keys = [c for c in meta.columns if c != "sample_id"]
    side = meta.select("sample_id", F.struct(*keys).alias("meta"))
    return packed.join(side.hint("merge"), "sample_id")


def pack_label(px: DataFrame, height: int, width: int, chunk: int = 65536) -> DataFrame:
    """Label map with a leading axis of one: (sample_id, shape, chunk, data)."""
    pos = F.col("y").cast("bigint") * width + F.col("x")
    return (px.select("sample_id", pos.alias("p"), F.col("gt").alias("v")).withColumn("chunk", F.expr(f"p div {chunk}"))
            .groupBy("sample_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("p", "v")))["v"].alias("data"))
            .withColumn("shape", F.array(F.lit(1), F.lit(height), F.lit(width))))


def inference_inputs(by_path: DataFrame, by_array: DataFrame) -> DataFrame:
    """One table from path rows and array rows; the loader of a row is told in `kind`."""
    return (by_path.withColumn("kind", F.lit("path"))
            .unionByName(by_array.withColumn("kind", F.lit("array")), allowMissingColumns=True))


def change_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Second image's channels behind the first's, per pixel."""
    return first.select("sample_id", "y", "x", "c", "v").unionByName(second.select("sample_id", "y", "x", "c", "v"))


