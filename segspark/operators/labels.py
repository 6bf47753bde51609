"""Label maps, palettes and label audits.

Pixel tables carry (sample_id, y, x, gt); class tables carry
(class_id, class_name[, r, g, b]).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.functions import columns as C
from segspark.runtime import join_side, require_columns

IGNORE = 255


def build_label_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id) from two class tables; classes that are not kept go to 255.

    Raises when a new class is unknown to the old list.
    """
    unknown = new.join(old, "class_name", "left_anti").select("class_name").limit(5).collect()
    if unknown:
        raise ValueError(f"new classes are not a subset of the old ones: {[r[0] for r in unknown]}")
    kept = new.select("class_name", F.col("class_id").alias("new_id"))
    return (old.join(kept, "class_name", "left")
            .select(F.col("class_id").alias("old_id"), F.coalesce("new_id", F.lit(IGNORE)).alias("new_id")))


def reduce_zero_label(label: Column) -> Column:
    """0 becomes 255, 255 stays, every other label moves down by one."""
    return F.when((label == 0) | (label == IGNORE), F.lit(IGNORE)).otherwise(label - 1)


def apply_label_map(px: DataFrame, label_map: DataFrame, column: str = "gt", default: int | None = None) -> DataFrame:
    """Map all ids at once through (old_id, new_id); ids not listed pass through or take `default`."""
    require_columns(label_map, "old_id", "new_id")
    side = label_map.select(F.col("old_id").alias(column), F.col("new_id").alias("__new"))
    other = F.col(column) if default is None else F.lit(default)
    joined = join_side(px, side, [column], "left")
    return joined.select(*[F.coalesce("__new", other).alias(c) if c == column else c for c in px.columns])


def prepare_labels(px: DataFrame, reduce_zero: bool = False, label_map: DataFrame | None = None) -> DataFrame:
    """Zero-label reduction first, then the label map."""
    if reduce_zero:
        px = px.withColumn("gt", reduce_zero_label(F.col("gt")))
    return px if label_map is None else apply_label_map(px, label_map)


def resolve_palette(palette: DataFrame, label_map: DataFrame | None = None) -> DataFrame:
    """Palette (class_id, r, g, b), subset and renumbered by a label map."""
    if label_map is None:
        return palette
    kept = label_map.filter(F.col("new_id") != IGNORE)
    return (kept.join(palette, kept["old_id"] == palette["class_id"])
            .select(F.col("new_id").alias("class_id"), "r", "g", "b"))


def generated_palette(classes: DataFrame, seed: int = 42, draw=None) -> DataFrame:
    """Reproducible random colours for classes that come without a palette."""
    byte = lambda salt: F.floor((draw or C.hashed(seed))(salt, F.col("class_id")) * 256).cast("int")
    return classes.select("class_id", byte(1).alias("r"), byte(2).alias("g"), byte(3).alias("b"))


def classes_of(aliases: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Class rows for requested dataset aliases; an unknown alias fails the job."""
    named = wanted.join(aliases, "alias", "left")
    checked = named.withColumn("dataset", F.when(
        F.col("dataset").isNull(), F.raise_error(F.concat(F.lit("unrecognized dataset: "), F.col("alias")))
    ).otherwise(F.col("dataset")))
    return checked.join(classes, "dataset")


def fold_labels(px: DataFrame, folds: dict[int, int], column: str = "gt") -> DataFrame:
    return px.withColumn(column, C.lookup(F.col(column), folds))


def coarsen(px: DataFrame, ranges: list[tuple[int, int]], column: str = "gt", name: str = "coarse") -> DataFrame:
    """Coarse id by [lo, hi) range of the fine id; anything else is 255."""
    out = F.lit(IGNORE)
    for i, (lo, hi) in enumerate(ranges):
        out = F.when((F.col(column) >= lo) & (F.col(column) < hi), F.lit(i)).otherwise(out)
    return px.withColumn(name, out)


def class_presence(px: DataFrame, classes: DataFrame) -> DataFrame:
    """(sample_id, class_id, present 0/1), one row per sample and class."""
    seen = px.select("sample_id", F.col("gt").alias("class_id")).distinct().withColumn("present", F.lit(1))
    ids = classes.agg(F.sort_array(F.collect_set("class_id")).alias("ids"))
    spine = seen.select("sample_id").distinct().select(
        "sample_id", F.explode(ids.scalar()).alias("class_id"))
    return (spine.join(seen.hint("merge"), ["sample_id", "class_id"], "left")
            .select("sample_id", "class_id", F.coalesce("present", F.lit(0)).alias("present")))


def binary_masks(px: DataFrame, ignore: int = IGNORE) -> DataFrame:
    """One foreground mask per class that occurs: (sample_id, class_id, y, x), foreground pixels only."""
    return px.filter(F.col("gt") != ignore).select("sample_id", F.col("gt").alias("class_id"), "y", "x")


def mask_index(px: DataFrame, ignore: int = IGNORE) -> DataFrame:
    """(sample_id, class_id, area): the masks of `binary_masks` with their size."""
    return (px.filter(F.col("gt") != ignore).groupBy("sample_id", F.col("gt").alias("class_id"))
            .agg(F.count(F.lit(1)).alias("area")))


def label_histogram(px: DataFrame) -> DataFrame:
    return px.groupBy("sample_id", "gt").agg(F.count(F.lit(1)).alias("n"))


def unique_labels(px: DataFrame) -> DataFrame:
    return px.select("gt").distinct()


def with_class_weight(px: DataFrame, weights: DataFrame, default: float = 1.0) -> DataFrame:
    """weights: (class_id, weight)."""
    side = weights.select(F.col("class_id").alias("gt"), F.col("weight").alias("__w"))
    return (join_side(px, side, ["gt"], "left").withColumn("weight", F.coalesce("__w", F.lit(default)))
            .select(*px.columns, "weight"))


def confident_boundary(px: DataFrame, threshold: float = 0.8, ignore: int = IGNORE) -> DataFrame:
    """Keep the label where sigmoid(boundary) > threshold, ignore it elsewhere."""
    return px.withColumn("gt", F.when(C.sigmoid(F.col("boundary")) > threshold, F.col("gt")).otherwise(ignore))


def label_violations(px: DataFrame, domain: DataFrame) -> DataFrame:
    """(gt, pixels, samples) of labels outside domain(class_id)."""
    allowed = domain.select(F.col("class_id").alias("gt"))
    per_sample = join_side(px.groupBy("gt", "sample_id").agg(F.count(F.lit(1)).alias("n")), allowed, ["gt"], "left_anti")
    return per_sample.groupBy("gt").agg(F.sum("n").alias("pixels"), F.count(F.lit(1)).alias("samples"))


def shape_violations(shapes: DataFrame) -> DataFrame:
    """Samples whose label map is not two-dimensional: shapes(sample_id, dims array<int>)."""
    return shapes.filter(F.size("dims") != 2).select("sample_id", F.size("dims").alias("ndim"))


def relabel_for_submission(px: DataFrame, train_to_id: dict[int, int], column: str = "pred") -> DataFrame:
    return px.withColumn(column, C.lookup(F.col(column), train_to_id))


def join_on_sample(px: DataFrame, meta: DataFrame, how: str = "inner") -> DataFrame:
    """Attach one-row-per-sample columns (parameters, shapes) to pixels."""
    return join_side(px, meta, ["sample_id"], how)
