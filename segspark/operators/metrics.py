"""Evaluation: confusion, IoU/Dice/F-score, depth metrics, top-k accuracy.

One pass over the pixels gives (gt, pred) counts with map-side partial sums;
everything after that works on at most classes x classes rows (per sample).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.functions import columns as C
from segspark.functions.prefix import segments

ALLOWED = ("mIoU", "mDice", "mFscore")


def pair_counts(px: DataFrame, by: list[str] | None = None, ignore: int = 255) -> DataFrame:
    """(by…, gt, pred, n) over pixels that are not ignored."""
    return (px.filter(F.col("gt") != ignore).groupBy(*(by or []), "gt", "pred")
            .agg(F.count(F.lit(1)).alias("n")))


def areas(pairs: DataFrame, num_classes: int, by: list[str] | None = None, dense: bool = True) -> DataFrame:
    """(by…, class_id, inter, pred_area, label_area, union_area).

    Each side drops its own values outside [0, num_classes). Every count row
    is sent to its gt class and, when different, to its pred class, so one
    more aggregation is enough. `dense` adds classes that never occur.
    """
    by = list(by or [])
    hit = F.col("gt") == F.col("pred")
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    as_gt = F.struct(F.col("gt").alias("class_id"), F.when(hit, n).otherwise(zero).alias("inter"),
                     F.when(hit, n).otherwise(zero).alias("pred_area"), n.alias("label_area"))
    as_pred = F.struct(F.col("pred").alias("class_id"), zero.alias("inter"), n.alias("pred_area"), zero.alias("label_area"))
    sides = F.array(as_gt, F.when(~hit, as_pred))
    rows = pairs.select(*by, F.explode(sides).alias("s")).filter("s is not null").select(*by, "s.*")
    rows = rows.filter(F.col("class_id").between(0, num_classes - 1))
    names = ("inter", "pred_area", "label_area")
    if dense and not by:
        spine = F.explode(F.sequence(F.lit(0), F.lit(num_classes - 1))).alias("class_id")
        rows = rows.unionByName(pairs.sparkSession.range(1).select(spine, *[zero.alias(c) for c in names]))
    total = rows.groupBy(*by, "class_id").agg(*[F.sum(c).alias(c) for c in names])
    if dense and by:
        # At most num_classes entries per group.
        entries = F.map_from_entries(F.collect_list(F.struct("class_id", F.struct(*names).alias("a"))))
        total = (total.groupBy(*by).agg(entries.alias("m"))
                 .select(*by, "m", F.explode(F.sequence(F.lit(0), F.lit(num_classes - 1))).alias("class_id"))
                 .withColumn("a", F.try_element_at("m", F.col("class_id")))
                 .select(*by, "class_id", *[F.coalesce(F.col(f"a.{c}"), zero).alias(c) for c in names]))
    return total.withColumn("union_area", F.col("pred_area") + F.col("label_area") - F.col("inter"))


def image_areas(px: DataFrame, num_classes: int, ignore: int = 255) -> DataFrame:
    return areas(pair_counts(px, ["sample_id"], ignore), num_classes, ["sample_id"])


def total_areas(per_image: DataFrame) -> DataFrame:
    cols = ("inter", "pred_area", "label_area", "union_area")
    return per_image.groupBy("class_id").agg(*[F.sum(c).alias(c) for c in cols])


def dataset_areas(px: DataFrame, num_classes: int, ignore: int = 255) -> DataFrame:
    return areas(pair_counts(px, None, ignore), num_classes)


def _ratio(a: str | Column, b: Column) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.try_divide(a.cast("double"), b.cast("double"))


def class_metrics(area: DataFrame, metrics: list[str] | str = "mIoU", beta: float = 1.0,
                  nan_to_num: float | None = None, by: list[str] | None = None) -> DataFrame:
    """Per-class ratios; 0/0 is NULL unless `nan_to_num` replaces it."""
    metrics = [metrics] if isinstance(metrics, str) else list(metrics)
    unknown = [m for m in metrics if m not in ALLOWED]
    if unknown:
        raise KeyError(f"metrics {unknown} are not supported")
    inter, pred, label, union = (F.col(c) for c in ("inter", "pred_area", "label_area", "union_area"))
    cols: dict[str, Column] = {}
    for m in metrics:
        if m == "mIoU":
            cols |= {"iou": _ratio(inter, union), "acc": _ratio(inter, label)}
        elif m == "mDice":
            cols |= {"dice": _ratio(2 * inter, pred + label), "acc": _ratio(inter, label)}
        else:
            p, r = _ratio(inter, pred), _ratio(inter, label)
            f = F.try_divide((1 + beta**2) * p * r, beta**2 * p + r)
            cols |= {"fscore": f, "precision": p, "recall": r}
    if nan_to_num is not None:
        cols = {k: F.coalesce(v, F.lit(float(nan_to_num))) for k, v in cols.items()}
    return area.select(*(by or []), "class_id", *[v.alias(k) for k, v in cols.items()])


def overall_accuracy(area: DataFrame) -> DataFrame:
    return area.agg(_ratio(F.sum("inter"), F.sum("label_area")).alias("a_acc"))


def summary(area: DataFrame, metrics: list[str] | str = "mIoU", beta: float = 1.0,
            nan_to_num: float | None = None) -> DataFrame:
    """One row: overall accuracy and the NULL-skipping mean of every ratio, x100, two decimals."""
    per_class = class_metrics(area, metrics, beta, nan_to_num)
    names = [c for c in per_class.columns if c != "class_id"]
    joined = area.join(per_class, "class_id")
    return joined.agg(F.bround(_ratio(F.sum("inter"), F.sum("label_area")) * 100, 2).alias("a_acc"),
                      *[F.bround(F.avg(c) * 100, 2).alias(f"m_{c}") for c in names])


def class_table(area: DataFrame, metrics: list[str] | str = "mIoU") -> DataFrame:
    """Per-class rows plus a summary row whose class_id is NULL (values x100, two decimals)."""
    per_class = class_metrics(area, metrics)
    names = [c for c in per_class.columns if c != "class_id"]
    sets = per_class.groupingSets([[F.col("class_id")], []], "class_id").agg(
        *[F.bround(F.avg(c) * 100, 2).alias(c) for c in names])
    return sets


def confusion(px: DataFrame, num_classes: int, ignore: int = 255) -> DataFrame:
    """Dense (gt, pred, n): classes x classes rows."""
    pairs = pair_counts(px, None, ignore).filter(
        F.col("gt").between(0, num_classes - 1) & F.col("pred").between(0, num_classes - 1))
    return dense_confusion(pairs, num_classes)


def dense_confusion(pairs: DataFrame, num_classes: int) -> DataFrame:
    axis = F.sequence(F.lit(0), F.lit(num_classes - 1))
    spine = (pairs.sparkSession.range(1).select(F.explode(axis).alias("gt"))
             .withColumn("pred", F.explode(axis)).withColumn("n", F.lit(0).cast("bigint")))
    return pairs.unionByName(spine).groupBy("gt", "pred").agg(F.sum("n").alias("n"))


def confusion_percent(conf: DataFrame) -> DataFrame:
    """Rows normalised by their gt total; an empty row gives NULL."""
    totals = conf.groupBy("gt").agg(F.sum("n").alias("row_total"))
    return conf.join(totals, "gt").select("gt", "pred", "n", (_ratio("n", F.col("row_total")) * 100).alias("pct"))


def confusion_wide(conf: DataFrame, num_classes: int) -> DataFrame:
    return conf.groupBy("gt").pivot("pred", list(range(num_classes))).agg(F.first("n"))


def category_metrics(px: DataFrame, class_to_category: dict[int, int], num_categories: int,
                     ignore: int = 255) -> DataFrame:
    """IoU after folding classes to categories; folding happens on the counts, not on the pixels."""
    pairs = pair_counts(px, None, ignore)
    fold = lambda c: C.lookup(F.col(c), class_to_category, F.lit(ignore))
    folded = (pairs.select(fold("gt").alias("gt"), fold("pred").alias("pred"), "n")
              .filter(F.col("gt") != ignore).groupBy("gt", "pred").agg(F.sum("n").alias("n")))
    return class_metrics(areas(folded, num_categories))


def depth_mask(min_depth: float = 0.0, max_depth: float = float("inf"), crop: str | None = None) -> Column:
    """Strict depth bounds; `nyu_crop` keeps rows 45..470 and columns 41..600."""
    keep = (F.col("gt_depth") > min_depth) & (F.col("gt_depth") < max_depth)
    if crop == "nyu_crop":
        keep = keep & F.col("y").between(45, 470) & F.col("x").between(41, 600)
    elif crop is not None:
        raise ValueError(f"unknown crop {crop}")
    return keep


DEPTH_METRICS = ("d1", "d2", "d3", "abs_rel", "sq_rel", "rmse", "rmse_log", "log10", "silog")


def depth_per_image(depth: DataFrame, metrics: list[str] | tuple = DEPTH_METRICS, **mask) -> DataFrame:
    """Depth metrics per sample over its masked pixels."""
    unknown = [m for m in metrics if m not in DEPTH_METRICS]
    if unknown:
        raise KeyError(f"metrics {unknown} are not supported")
    g, p = F.col("gt_depth"), F.col("pred_depth")
    ratio = F.greatest(F.try_divide(g, p), F.try_divide(p, g))
    base = depth.filter(depth_mask(**mask)).select(
        "sample_id", ratio.alias("r"), (p - g).alias("e"), g.alias("g"), (C.ln(p) - C.ln(g)).alias("dl"))
    within = lambda t: F.avg(F.when(F.col("r") < t, 1.0).otherwise(0.0))
    e, dl = F.col("e"), F.col("dl")
    cols = {
        "d1": within(1.25), "d2": within(1.25**2), "d3": within(1.25**3),
        "abs_rel": F.avg(F.abs(e) / F.col("g")), "sq_rel": F.avg(e * e / F.col("g")),
        "rmse": F.sqrt(F.avg(e * e)), "rmse_log": F.sqrt(F.avg(dl * dl)),
        "log10": F.avg(F.abs(dl)) / F.lit(2.302585092994046),
        # Rounding can put a zero variance a hair below zero.
        "silog": F.sqrt(F.greatest(F.avg(dl * dl) - 0.5 * F.avg(dl) * F.avg(dl), F.lit(0.0))),
    }
    return base.groupBy("sample_id").agg(*[cols[m].alias(m) for m in metrics])


def depth_dataset(per_image: DataFrame) -> DataFrame:
    """Unweighted mean over images."""
    return per_image.agg(*[F.avg(c).alias(c) for c in per_image.columns if c != "sample_id"])


FLOAT32_EPS = 1.1920928955078125e-07


def topk_accuracy(df: DataFrame, topk: tuple[int, ...] = (1,), thresh: float | None = None,
                  ignore: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Per cent of rows whose label is among the k best logits: acc_1, acc_3, …

    The rank of the label is the number of larger logits, plus equal ones of a
    lower class. `df` has (logits, gt).
    """
    rows = df if ignore is None else df.filter(F.col("gt") != ignore)
    own = F.get("logits", F.col("gt"))
    better = F.size(F.filter("logits", lambda v, i: (v > own) | ((v == own) & (i < F.col("gt")))))
    ok = own.isNotNull() if thresh is None else own > thresh
    ranked = rows.select(*(by or []), better.alias("better"), ok.alias("ok"))
    n = F.count(F.lit(1)) + F.lit(FLOAT32_EPS)
    hits = [F.coalesce(F.sum(F.when(F.col("ok") & (F.col("better") < k), 1.0).otherwise(0.0)), F.lit(0.0)) for k in topk]
    return ranked.groupBy(*(by or [])).agg(
        *[((h + FLOAT32_EPS) * 100.0 / n).alias(f"acc_{k}") for k, h in zip(topk, hits)])


STARTS_PER_TASK = 500_000


def confusion_from_runs(gt_runs: DataFrame, pred_runs: DataFrame, partitions: int | None = None, ignore: int = 255) -> DataFrame:
    """(gt, pred, n) from run-length masks (sample_id, start, len, label) without going to pixels.

    The starts of both sides are merged in order of position and each side's
    last run is carried forward to the next start; what lies between two starts
    is covered as far as both runs reach. So a run of any length is one row, and
    an image of any number of runs goes to many tasks. Runs of one side must not
    overlap; cells that only one side covers do not count.
    """
    def starts(runs: DataFrame, side: str) -> DataFrame:
        pos = F.col("start").cast("bigint")
        return runs.filter("len > 0").select("sample_id", pos.alias("pos"), F.struct("label", (pos + F.col("len")).alias("stop")).alias(side))

    # A task gets a bounded number of starts, however many there are.
    many = lambda rows: max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // STARTS_PER_TASK))
    merged = starts(gt_runs.filter(F.col("label") != ignore), "gt").unionByName(starts(pred_runs, "pred"), allowMissingColumns=True)
    both = segments(merged, "pos", ["gt", "pred"], ["sample_id"], partitions or many(merged)).filter("gt is not null and pred is not null")
    # The last start has no next one; `least` passes over it.
    shared = F.least("until", "gt.stop", "pred.stop") - F.col("pos")
    return (both.withColumn("n", shared).filter("n > 0").groupBy(F.col("gt.label").alias("gt"), F.col("pred.label").alias("pred"))
            .agg(F.sum("n").alias("n")))


def custom_metric(px: DataFrame, partial, final) -> DataFrame:
    """User metric: `partial(px)` reduces pixels to small rows, `final(rows)` to the result."""
    return final(partial(px))
