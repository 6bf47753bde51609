"""Annotation conversion: colours, value tables, channels, run lengths, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.functions import columns as C
from segspark.runtime import join_side


def remap_ids(px: DataFrame, mapping: dict[int, int], column: str = "gt", default: int | None = None) -> DataFrame:
    """Literal id table; ids not listed pass through, or take `default`."""
    return px.withColumn(column, C.lookup(F.col(column), mapping, None if default is None else F.lit(default)))


def rank_ids(px: DataFrame, ids: list[int], column: str = "gt") -> DataFrame:
    """Position of each id in the sorted list; an id that is not listed fails the job."""
    ordered = {v: i for i, v in enumerate(sorted(ids))}
    found = C.lookup(F.col(column), ordered, F.lit(None).cast("int"))
    return px.withColumn(column, F.coalesce(found, F.raise_error(
        F.concat(F.lit("label outside the mapping: "), F.col(column).cast("string"))).cast("int")))


def widen_channels(image: DataFrame, channels: int = 3) -> DataFrame:
    """(sample_id, y, x, c, v) to one row per pixel with c0, c1, …"""
    return image.groupBy("sample_id", "y", "x").agg(
        *[F.max(F.when(F.col("c") == i, F.col("v"))).alias(f"c{i}") for i in range(channels)])


def colours_to_labels(px: DataFrame, palette: DataFrame, default: int = 0) -> DataFrame:
    """Exact match of (c0, c1, c2) with palette(class_id, r, g, b)."""
    side = palette.select(F.col("r").alias("c0"), F.col("g").alias("c1"), F.col("b").alias("c2"), F.col("class_id").alias("gt"))
    return (join_side(px, side, ["c0", "c1", "c2"], "left")
            .select("sample_id", "y", "x", F.coalesce("gt", F.lit(default)).alias("gt")))


def weighted_code(px: DataFrame, colours: tuple, weights: tuple[int, int, int] = (2, 3, 4)) -> DataFrame:
    """Class by weighted channel sum; colours that share a code share a class, unknown codes are 0."""
    total = lambda p: p[0] * weights[0] + p[1] * weights[1] + p[2] * weights[2]
    codes = {total(c): i for i, c in enumerate(colours)}
    code = (F.col("c0") * weights[0] + F.col("c1") * weights[1] + F.col("c2") * weights[2]).cast("int")
    return px.select("sample_id", "y", "x", C.lookup(code, codes, F.lit(0)).alias("gt"))


def packed_index(px: DataFrame, colours: DataFrame) -> DataFrame:
    """Class by 24-bit colour; colours(class_id, r, g, b), unknown colours are 0."""
    pack = lambda r, g, b: ((F.col(r).cast("int") * 256 + F.col(g).cast("int")) * 256 + F.col(b).cast("int")).alias("code")
    side = colours.select(pack("r", "g", "b"), F.col("class_id").alias("gt"))
    return (join_side(px.select("sample_id", "y", "x", pack("c0", "c1", "c2")), side, ["code"], "left")
            .select("sample_id", "y", "x", F.coalesce("gt", F.lit(0)).alias("gt")))


def binarise(v: Column, divisor: int = 128) -> Column:
    return F.floor(v / divisor).cast("int")


def binarise_unless_binary(px: DataFrame, column: str = "v") -> DataFrame:
    """Threshold at 128, except for samples that hold exactly two values, one of them 1."""
    values = px.select("sample_id", F.col(column).alias("u")).distinct()
    kind = values.groupBy("sample_id").agg(((F.count(F.lit(1)) == 2) & F.max(F.col("u") == 1)).alias("is_binary"))
    cut = F.when(F.col("is_binary"), F.col(column)).when(F.col(column) < 128, 0).otherwise(1)
    return join_side(px, kind, ["sample_id"]).withColumn(column, cut.cast("int")).select(*px.columns)


def change_label(image: DataFrame) -> DataFrame:
    """First channel of a 0/255 change map as 0/1."""
    return image.filter("c = 0").select("sample_id", "y", "x", F.when(F.col("v") == 255, 1).otherwise(F.col("v")).cast("int").alias("gt"))


def channels_to_labels(onehot: DataFrame, channels: int) -> DataFrame:
    """(sample_id, y, x, c, v) with v >= 1 marking a channel: channel j stands for class (j+1) mod channels,
    so the last one is background; the highest marked channel wins."""
    top = F.max(F.when(F.col("v") >= 1, F.col("c")))
    return (onehot.groupBy("sample_id", "y", "x").agg(top.alias("top"))
            .select("sample_id", "y", "x", F.coalesce((F.col("top") + 1) % channels, F.lit(0)).cast("int").alias("gt")))


def instances_to_labels(px: DataFrame, types: DataFrame) -> DataFrame:
    """px(sample_id, y, x, inst) with types(sample_id, inst, class_id); instance 0 is background."""
    joined = join_side(px, types, ["sample_id", "inst"], "left")
    return joined.select("sample_id", "y", "x", F.coalesce("class_id", F.lit(0)).alias("gt"))


def decode_relative_rle(records: DataFrame) -> DataFrame:
    """records(sample_id, h, w, rle): `gap length gap length …`, each gap counted from the end of the
    last run, columns first. Returns the foreground (sample_id, y, x); '-1' has none.

    The first size given plays the role of the column length, as the masks are written.
    """
    nums = F.transform(F.split(F.trim("rle"), r"\s+"), lambda s: s.cast("bigint"))
    runs = (records.filter(F.trim("rle") != "-1")
            .select("sample_id", "h", F.posexplode(nums).alias("i", "n")))
    # One record's own runs; the window never mixes records.
    w = Window.partitionBy("sample_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = runs.withColumn("stop", F.sum("n").over(w)).filter("i % 2 = 1 and n > 0")
    pos = spans.select("sample_id", "h", F.explode(F.sequence(F.col("stop") - F.col("n"), F.col("stop") - 1)).alias("p"))
    return pos.select("sample_id", F.expr("cast(p % h as int)").alias("y"), F.expr("cast(p div h as int)").alias("x"))


def slice_volume(vox: DataFrame, prefix: str = "case", id_width: int = 4, slice_width: int = 3) -> DataFrame:
    """Voxels to 2-D pixels; the slice number becomes part of the name."""
    name = F.concat(F.lit(prefix), C.zfill(F.col("sample_id"), id_width),
                    F.lit("_slice"), C.zfill(F.col("z"), slice_width))
    return vox.select(name.alias("name"), "y", "x", *[c for c in vox.columns if c not in ("sample_id", "z", "y", "x", "c")])


def intensity_window(v: Column, lo: float = -125.0, hi: float = 275.0) -> Column:
    """Clip to [lo, hi] and scale to 0..255."""
    return (F.least(F.greatest(v, F.lit(lo)), F.lit(hi)) - lo) / (hi - lo) * 255


def mirror_x(px: DataFrame, width: int) -> DataFrame:
    return px.withColumn("x", width - 1 - F.col("x"))


def min_max_to_uint8(px: DataFrame, lo: float = 0.0, hi: float = 255.0) -> DataFrame:
    """Per-sample linear scaling to [lo, hi], rounded half to even; a constant sample becomes lo."""
    ends = px.groupBy("sample_id").agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    scaled = F.coalesce(F.try_divide(F.col("v") - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0)) * (hi - lo) + lo
    return join_side(px, ends, ["sample_id"]).withColumn("v", F.bround(scaled, 0).cast("int")).select(*px.columns)


def stack_to_rows(stacks: DataFrame, width: int = 8) -> DataFrame:
    """stacks(container, images array<array<…>>) to one row per image with an index-padded name."""
    return (stacks.select("container", F.posexplode("images").alias("i", "data"))
            .select(F.concat("container", F.lit("_"), C.zfill(F.col("i"), width)).alias("name"), "data"))
