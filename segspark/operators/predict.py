"""Prediction post-processing: softmax, argmax, merging, uncertainty, bins, hierarchy, and the model hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.functions import columns as C
from segspark.functions.prefix import top_k_per_group
from segspark.operators import tiles
from segspark.runtime import join_pixels, join_side

PIXEL = ["sample_id", "y", "x"]


def class_probabilities(df: DataFrame, classes: int | None = None) -> DataFrame:
    """Add probs: softmax over several logits, sigmoid of a single one."""
    single = F.transform("logits", C.sigmoid)
    if classes is not None:
        return df.withColumn("probs", single if classes == 1 else C.softmax(F.col("logits"), classes))
    return df.withColumn("probs", F.when(F.size("logits") == 1, single).otherwise(C.softmax(F.col("logits"))))


def predict_labels(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Add pred: argmax (lowest class on ties), or sigmoid > threshold for a single channel."""
    binary = F.when(C.sigmoid(F.get("logits", F.lit(0))) > threshold, 1).otherwise(0)
    return df.withColumn("pred", F.when(F.size("logits") == 1, binary).otherwise(C.argmax(F.col("logits"))))


def _mean_vectors(df: DataFrame, column: str, classes: int, keys: list[str]) -> DataFrame:
    flat = df.select(*keys, *[F.get(column, F.lit(i)).alias(f"m{i}") for i in range(classes)])
    return (flat.groupBy(*keys).agg(*[F.avg(f"m{i}").alias(f"m{i}") for i in range(classes)])
            .select(*keys, F.array(*[f"m{i}" for i in range(classes)]).alias("score")))


def merge_views(views: DataFrame, classes: int, threshold: float = 0.3, keys: list[str] | None = None) -> DataFrame:
    """Mean of the probabilities of all views of a pixel, then the label. Views must be turned back
    (un-flipped, resized) before."""
    keys = keys or PIXEL
    mean = _mean_vectors(class_probabilities(views, classes), "probs", classes, keys)
    if classes == 1:
        return mean.select(*keys, "score", F.when(F.get("score", F.lit(0)) > threshold, 1).otherwise(0).alias("pred"))
    return mean.select(*keys, "score", C.argmax(F.col("score")).alias("pred"))


def ensemble_logits(members: DataFrame, classes: int, keys: list[str] | None = None) -> DataFrame:
    """Mean of the logits of several models, then argmax."""
    keys = keys or PIXEL
    return _mean_vectors(members, "logits", classes, keys).select(*keys, C.argmax(F.col("score")).alias("pred"), "score")


def combine_queries(class_logits: DataFrame, masks: DataFrame, classes: int) -> DataFrame:
    """(sample_id, y, x, score): sum over queries of softmax(class)·sigmoid(mask), without the
    no-object class. class_logits(sample_id, q, logits[classes + 1]); masks(sample_id, q, y, x, v)."""
    probs = class_logits.select("sample_id", "q", C.softmax(F.col("logits"), classes + 1).alias("p"))
    gate = C.sigmoid(F.col("v"))
    scored = join_side(masks, probs, ["sample_id", "q"]).select(*PIXEL, gate.alias("g"), "p")
    sums = [F.sum(F.get("p", F.lit(i)) * F.col("g")).alias(f"m{i}") for i in range(classes)]
    return scored.groupBy(*PIXEL).agg(*sums).select(*PIXEL, F.array(*[f"m{i}" for i in range(classes)]).alias("score"))


def uncertainty(logits: Column) -> Column:
    """Second best minus best logit; minus the absolute value for a single logit."""
    ordered = F.sort_array(logits, False)
    return F.when(F.size(logits) == 1, -F.abs(F.get(logits, F.lit(0)))).otherwise(
        F.get(ordered, F.lit(1)) - F.get(ordered, F.lit(0)))


def uncertain_points(df: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """(sample_id, rank, pos, px, py): the k most uncertain pixels of each image in normalised coordinates."""
    scored = df.select("sample_id", (F.col("y") * width + F.col("x")).alias("pos"), uncertainty(F.col("logits")).alias("u"))
    top = top_k_per_group(scored, ["sample_id"], [F.col("u").desc(), F.col("pos")], min(k, height * width))
    return top.select("sample_id", "rank", "pos", ((F.col("pos") % width + 0.5) / width).alias("px"),
                      ((F.floor(F.col("pos") / width) + 0.5) / height).alias("py"))


def sample_points(points: DataFrame, df: DataFrame, height: int, width: int, classes: int) -> DataFrame:
    """Bilinear logits at points(sample_id, pt, px, py); outside the image counts as zero."""
    fx, fy = F.col("px") * width - 0.5, F.col("py") * height - 0.5
    corner = lambda f: F.explode(F.array(*[F.struct((F.floor(f) + k).cast("int").alias("t"), (1 - F.abs(f - F.floor(f) - k)).alias("wt")) for k in (0, 1)]))
    near = points.withColumn("cy", corner(fy)).withColumn("cx", corner(fx))
    near = near.select("sample_id", "pt", "px", "py", F.col("cy.t").alias("y"), F.col("cx.t").alias("x"), (F.col("cy.wt") * F.col("cx.wt")).alias("wt"))
    hit = join_pixels(near, df.select(*PIXEL, "logits"), PIXEL, "left")
    sums = [F.sum(F.col("wt") * F.coalesce(F.get("logits", F.lit(i)), F.lit(0.0))).alias(f"m{i}") for i in range(classes)]
    return (hit.groupBy("sample_id", "pt", "px", "py").agg(*sums)
            .select("sample_id", "pt", "px", "py", F.array(*[f"m{i}" for i in range(classes)]).alias("logits")))


def importance_points(df: DataFrame, height: int, width: int, classes: int, num: int, oversample: float = 3.0,
                      importance: float = 0.75, seed: int = 0, draw=None) -> DataFrame:
    """(sample_id, px, py, kind): the most uncertain of `num * oversample` drawn points, filled up with random ones."""
    n = int(num * oversample)
    keep = int(importance * num)
    draw = draw or C.hashed(seed)
    at = lambda salt: draw(salt, F.col("sample_id"), F.col("pt"))
    ids = df.select("sample_id").distinct()
    points = lambda count, salt: ids.withColumn("pt", F.explode(F.sequence(F.lit(1), F.lit(count)))).withColumns(
        {"px": at(salt), "py": at(salt + 1)})
    scored = sample_points(points(n, 1), df, height, width, classes)
    # Sums of four shares depend on their order in the last bits; snapping keeps the choice reproducible.
    scored = scored.withColumn("u", C.snap(uncertainty(F.col("logits")), 9))
    best = top_k_per_group(scored.select("sample_id", "pt", "px", "py", "u"), ["sample_id"], [F.col("u").desc(), F.col("pt")], keep)
    out = best.select("sample_id", "px", "py", F.lit("uncertain").alias("kind"))
    if num > keep:
        out = out.unionByName(points(num - keep, 3).select("sample_id", "px", "py", F.lit("random").alias("kind")))
    return out


def repair_depth(v: Column, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; infinities become hi, NaN becomes lo."""
    v = v.cast("double")
    return (F.when(F.isnan(v), F.lit(lo)).when(F.abs(v) == float("inf"), F.when(v > 0, hi).otherwise(lo))
            .otherwise(F.least(F.greatest(v, F.lit(lo)), F.lit(hi))))


def bin_centres(widths: DataFrame, lo: float, hi: float) -> DataFrame:
    """(sample_id, centres): widths(sample_id, bin, width) are normalised, scaled to [lo, hi] and added up.
    The number of bins per sample is the model's."""
    w = Window.partitionBy("sample_id")
    norm = F.col("width") / F.sum("width").over(w) * (hi - lo)
    stop = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) + lo
    cells = widths.withColumn("n", norm).withColumn("centre", stop - F.col("n") / 2)
    return cells.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("bin", "centre")))["centre"].alias("centres"))


def expected_depth(df: DataFrame, centres: DataFrame, bins: int | None = None) -> DataFrame:
    """Sum of probability times bin centre per pixel; df has probs."""
    return join_side(df, centres, ["sample_id"]).withColumn("depth", C.dot(F.col("probs"), F.col("centres"), bins)).drop("centres")


def parent_scores(probs: Column, ranges: list[tuple[int, int]], fine: int) -> list[Column]:
    """Each coarse class takes the maximum of its own score and its children's."""
    return [F.greatest(*[F.get(probs, F.lit(i)) for i in range(lo, hi)], F.get(probs, F.lit(fine + k))) for k, (lo, hi) in enumerate(ranges)]


def child_scores(probs: Column, ranges: list[tuple[int, int]], fine: int) -> list[Column]:
    """Each fine class takes the minimum of its own score and its parent's."""
    parent = {i: k for k, (lo, hi) in enumerate(ranges) for i in range(lo, hi)}
    return [F.least(F.get(probs, F.lit(i)), F.get(probs, F.lit(fine + parent[i]))) for i in range(fine)]


def hierarchy_consistent(df: DataFrame, ranges: list[tuple[int, int]], fine: int) -> DataFrame:
    """Add parents and children arrays to rows with probs (fine classes, then coarse ones)."""
    p = F.col("probs")
    return df.withColumns({"parents": F.array(*parent_scores(p, ranges, fine)), "children": F.array(*child_scores(p, ranges, fine))})


# --- model hook -------------------------------------------------------------

def apply_model(rasters: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: T.StructType | str,
                batch_size: int = 16) -> DataFrame:
    """Run a model over raster rows in batches. `load()` is called once per task and returns a function
    from a frame of rows to a frame of `schema`."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                yield model(frame.iloc[start:start + batch_size])
    return rasters.mapInPandas(run, schema)


def slide_inference(px: DataFrame, height: int, width: int, crop: int, stride: int, classes: int,
                    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], value: str = "v") -> DataFrame:
    """Cut windows, run the model on each, stitch the logits. The model gets (sample_id, wy, wx, data) with
    row-major values and returns (sample_id, wy, wx, data) with classes-last logits."""
    win = tiles.cover_slide(px, F.lit(height), F.lit(width), crop, stride)
    at = (F.col("y") - F.col("wy")) * crop + F.col("x") - F.col("wx")
    # A window holds crop x crop values.
    blocks = (win.select("sample_id", "wy", "wx", at.alias("p"), F.col(value).cast("double").alias("v"))
              .groupBy("sample_id", "wy", "wx").agg(F.array_sort(F.collect_list(F.struct("p", "v")))["v"].alias("data")))
    id_type = px.schema["sample_id"].dataType.simpleString()
    logits = apply_model(blocks, load, f"sample_id {id_type}, wy int, wx int, data array<double>")
    cells = logits.select("sample_id", "wy", "wx", "data", F.explode(F.sequence(F.lit(0), F.lit(crop * crop - 1))).alias("p"))
    flat = cells.select("sample_id", (F.col("wy") + F.floor(F.col("p") / crop)).cast("int").alias("y"),
                        (F.col("wx") + F.col("p") % crop).cast("int").alias("x"),
                        F.slice("data", F.col("p") * classes + 1, classes).alias("logits"))
    return tiles.stitch_logits(flat.filter((F.col("y") < height) & (F.col("x") < width)), classes)
