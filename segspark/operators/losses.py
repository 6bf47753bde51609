"""Losses as aggregates over scoring tables (logits, gt[, weight, sample_id, y, x])."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.functions import columns as C
from segspark.functions.prefix import kth_value, row_numbers, running_totals, top_k_per_group
from segspark.operators.distance import mask_distances, squared_distance_transform
from segspark.runtime import join_side

EPS32 = 1.1920928955078125e-07


def _literals(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def reduce_loss(df: DataFrame, loss: str = "loss", weight: str | None = None, reduction: str = "mean",
                avg_factor: float | Column | None = None, name: str = "loss") -> DataFrame:
    """Element weights, then none, mean or sum. `avg_factor` replaces the count of a mean and may be an
    aggregate expression; with `sum` it is an error."""
    if reduction not in ("none", "mean", "sum"):
        raise ValueError(f"unknown reduction {reduction}")
    if avg_factor is not None and reduction == "sum":
        raise ValueError('avg_factor can not be used with reduction="sum"')
    value = F.col(loss) if weight is None else F.col(loss) * F.col(weight)
    if reduction == "none":
        return df.withColumn(name, value)
    if reduction == "sum":
        return df.agg(F.sum(value).alias(name))
    if avg_factor is None:
        return df.agg(F.avg(value).alias(name))
    by = F.lit(float(avg_factor)) if isinstance(avg_factor, (int, float)) else avg_factor
    return df.agg((F.sum(value) / (by + EPS32)).alias(name))


def pixel_cross_entropy(classes: int | None = None, class_weight: list[float] | None = None, ignore: int = 255) -> Column:
    """Cross-entropy of one row; 0 for ignored rows."""
    own = C.log_sum_exp(F.col("logits"), classes) - F.get("logits", F.col("gt"))
    if class_weight is not None:
        own = own * F.get(_literals(class_weight), F.col("gt"))
    return F.when(F.col("gt") == ignore, F.lit(0.0)).otherwise(own)


def cross_entropy(df: DataFrame, classes: int | None = None, class_weight: list[float] | None = None, ignore: int = 255,
                  avg_non_ignore: bool = False, reduction: str = "mean", avg_factor: float | None = None,
                  weight: str | None = None) -> DataFrame:
    """The mean divides by all rows, by the rows not ignored, or by the class weights of the rows."""
    rows = df.withColumn("loss", pixel_cross_entropy(classes, class_weight, ignore))
    factor: float | Column | None = avg_factor
    if factor is None and reduction == "mean":
        kept = F.col("gt") != ignore
        if class_weight is not None:
            factor = F.sum(F.when(kept, F.get(_literals(class_weight), F.col("gt"))).otherwise(0.0))
        else:
            factor = F.sum(F.when(kept, 1).otherwise(0)) if avg_non_ignore else F.count(F.lit(1))
    return reduce_loss(rows, "loss", weight, reduction, factor)


def _bce(x: Column, t: Column, pos_weight: Column | None = None) -> Column:
    if pos_weight is None:
        return C.bce_logits(x, t)
    return (1 - t) * x + (1 + (pos_weight - 1) * t) * (F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0)))


def _by_class(df: DataFrame, classes: int) -> DataFrame:
    """A row (…, class_id, score) for each class of each row of logits."""
    rest = [c for c in df.columns if c not in ("logits", "class_id", "score")]
    return df.select(*rest, F.posexplode("logits").alias("class_id", "score")).filter(F.col("class_id") < classes)


def _reduce_classes(df: DataFrame, element, weight: Column, classes: int, reduction: str, avg_factor: float | None,
                    counted: Column | None = None) -> DataFrame:
    """Reduction of element(class, score) times the row's weight over rows x classes. `counted` is what a row adds
    per class to the divisor of a mean.

    Few classes are added up inside the row, in generated code; many become rows, summed before any shuffle.
    """
    unrolled = reduction != "none" and classes <= C.UNROLL_LIMIT
    if unrolled:
        own = fold(lambda a, b: a + b, [element(F.lit(i), F.get("logits", F.lit(i))) for i in range(classes)])
        rows = df.withColumns({"loss": own, "__w": weight})
    else:
        rows = _by_class(df, classes)
        rows = rows.withColumns({"loss": element(F.col("class_id"), F.col("score")), "__w": weight})
    if avg_factor is not None or reduction != "mean":
        return reduce_loss(rows, "loss", "__w", reduction, avg_factor).drop("__w")
    by = (F.count(F.lit(1)) if counted is None else F.sum(counted)) * (classes if unrolled else 1)
    return rows.agg((F.sum(F.col("loss") * F.col("__w")) / (by if counted is None else by + EPS32)).alias("loss"))


def binary_cross_entropy(df: DataFrame, classes: int, pos_weight: list[float] | None = None, ignore: int = 255,
                         avg_non_ignore: bool = False, weight: str | None = None, reduction: str = "mean",
                         avg_factor: float | None = None) -> DataFrame:
    """One-hot binary cross-entropy averaged over rows x classes (or over the valid ones).

    `weight` names a column with a row's weight. `none` gives (…, class_id, score, loss) for each row and class.
    """
    valid = F.when((F.col("gt") >= 0) & (F.col("gt") != ignore), 1.0).otherwise(0.0)
    hot = lambda i: F.when(F.col("gt") == i, 1.0).otherwise(0.0)
    own = lambda i, x: _bce(x, hot(i), None if pos_weight is None else F.get(_literals(pos_weight), i))
    return _reduce_classes(df, own, valid if weight is None else valid * F.col(weight), classes, reduction, avg_factor,
                           valid if avg_non_ignore else None)


def mask_cross_entropy(df: DataFrame) -> DataFrame:
    """Rows (logits, label, target): binary cross-entropy of the labelled channel, mean over rows."""
    return df.agg(F.avg(_bce(F.get("logits", F.col("label")), F.col("target").cast("double"))).alias("loss"))


def focal(df: DataFrame, classes: int, gamma: float = 2.0, alpha: float | list[float] = 0.5,
          class_weight: list[float] | None = None, ignore: int = 255, weight: str | None = None, reduction: str = "mean",
          avg_factor: float | None = None) -> DataFrame:
    """Sigmoid focal loss over one-hot labels, mean over rows x classes; ignored rows count as zero.

    `weight` names a column with a row's weight. `none` gives (…, class_id, score, loss) for each row and class.
    """
    def own(i, x):
        t = F.when(F.col("gt") == i, 1.0).otherwise(0.0)
        p = C.sigmoid(x)
        a = F.get(_literals(alpha), i) if isinstance(alpha, list) else F.lit(float(alpha))
        miss = (1 - p) * t + p * (1 - t)
        loss = C.bce_logits(x, t) * (a * t + (1 - a) * (1 - t)) * F.pow(miss, F.lit(gamma))
        return loss if class_weight is None else loss * F.get(_literals(class_weight), i)

    kept = F.when(F.col("gt") == ignore, 0.0).otherwise(1.0)
    return _reduce_classes(df, own, kept if weight is None else kept * F.col(weight), classes, reduction, avg_factor)


def dice(df: DataFrame, classes: int, eps: float = 1e-3, naive: bool = False, ignore_class: int | None = 255,
         by: str = "sample_id", weight: str | None = None, reduction: str = "mean", avg_factor: float | None = None) -> DataFrame:
    """Per-sample dice over all classes and pixels, then reduced. `ignore_class` leaves a class channel
    out; pixels of unknown labels stay with an all-zero target. `weight` names a column with one weight per sample."""
    if classes < 1 or (classes == 1 and ignore_class == 0):
        raise ValueError("the ignored class is the only class")
    extra = [] if weight is None else [weight]
    rows = df.select(by, "gt", *extra, C.softmax(F.col("logits"), classes).alias("p"))
    term = (lambda v: v) if naive else (lambda v: v * v)
    total = C.sum_over(F.col("p"), term, classes)
    known = F.col("gt").between(0, classes - 1)
    if ignore_class is not None and 0 <= ignore_class < classes:
        others = F.concat(F.slice("p", 1, ignore_class), F.slice("p", ignore_class + 2, classes))
        total, known = C.sum_over(others, term, classes - 1), known & (F.col("gt") != ignore_class)
    hit, target = F.when(known, F.get("p", F.col("gt"))).otherwise(0.0), F.when(known, 1.0).otherwise(0.0)
    parts = rows.groupBy(by).agg(F.sum(hit).alias("a"), F.sum(total).alias("b"), F.sum(target).alias("c"), *[F.max(c).alias(c) for c in extra])
    d = (2 * F.col("a") + eps) / (F.col("b") + F.col("c") + eps) if naive else 2 * F.col("a") / (F.col("b") + eps + F.col("c") + eps)
    return reduce_loss(parts.select(by, *extra, (1 - d).alias("loss")), "loss", weight, reduction, avg_factor)


def tversky(df: DataFrame, classes: int, alpha: float = 0.3, beta: float = 0.7, smooth: float = 1.0,
            class_weight: list[float] | None = None, ignore: int = 255, by: str = "sample_id") -> DataFrame:
    """Mean over samples of each class's Tversky loss, weighted, summed and divided by the class count."""
    if abs(alpha + beta - 1.0) > 1e-12:
        raise ValueError("alpha + beta must be 1")
    # A sample without valid pixels has zero sums and a loss of zero.
    valid = F.when(F.col("gt") != ignore, 1.0).otherwise(0.0)
    label = F.least(F.greatest("gt", F.lit(0)), F.lit(classes - 1))
    rows = df.select(by, valid.alias("valid"), label.alias("label"), C.softmax(F.col("logits"), classes).alias("logits"))
    hot = lambda i: F.when(F.col("label") == i, F.col("valid")).otherwise(0.0)
    sums = lambda i, p: {"tp": F.sum(p * hot(i)), "p": F.sum(p * F.col("valid")), "t": F.sum(hot(i))}
    if classes <= C.UNROLL_LIMIT:
        kept = [i for i in range(classes) if i != ignore]
        wide = rows.groupBy(by).agg(*[v.alias(f"{n}{i}") for i in kept for n, v in sums(i, F.get("logits", F.lit(i))).items()])
        per = wide.select(by, F.inline(F.array(*[F.struct(F.lit(i).alias("class_id"), *[F.col(f"{n}{i}").alias(n) for n in ("tp", "p", "t")])
                                                 for i in kept])))
    else:
        long = _by_class(rows, classes).filter(F.col("class_id") != ignore)
        per = long.groupBy(by, "class_id").agg(*[v.alias(n) for n, v in sums(F.col("class_id"), F.col("score")).items()])
    tp, fp, fn = F.col("tp"), F.col("p") - F.col("tp"), F.col("t") - F.col("tp")
    own = 1 - (tp + smooth) / (tp + alpha * fp + beta * fn + smooth)
    if class_weight is not None:
        own = own * F.get(_literals(class_weight), F.col("class_id"))
    # Every sample has a row for each class, so the mean over both is a class's mean over samples, averaged.
    counted = classes if not 0 <= ignore < classes else classes - 1
    return per.agg((F.avg(own) * counted / classes).alias("loss"))


WHOLE_ROWS = 1 << 20  # of an image, that a task may put in order


def _small_groups(rows: DataFrame, group: list[str]) -> bool:
    """Whether a task can hold any group; only the keys are computed."""
    return bool(group) and rows.groupBy(*group).count().filter(F.col("count") > WHOLE_ROWS).isEmpty()


def _lovasz_sum(errors: DataFrame, totals: DataFrame, keys: list[str], small: bool = False) -> DataFrame:
    """Sum of error times Jaccard step per key. errors(keys…, err, fg); totals(keys…, gts).

    Equal errors form one step, since the steps between them telescope; only
    positive errors contribute, and smaller ones never change a larger one's
    step, so the others are not ranked.
    """
    if small:  # each where it lies; all errors, for the total of the foreground
        steps = errors.dropna(subset=keys).groupBy(*keys, "err").agg(F.count(F.lit(1)).alias("n"), F.sum("fg").alias("f"))
        whole = Window.partitionBy(*keys)
        so_far = whole.orderBy(F.col("err").desc()).rowsBetween(Window.unboundedPreceding, 0)
        ranked = steps.withColumns({"cn": F.sum("n").over(so_far), "cf": F.sum("f").over(so_far), "gts": F.sum("f").over(whole)}).filter("err > 0")
    else:
        steps = errors.filter("err > 0").groupBy(*keys, "err").agg(F.count(F.lit(1)).alias("n"), F.sum("fg").alias("f"))
        ranked = running_totals(steps, [F.col("err").desc()], {"cn": F.col("n"), "cf": F.col("f")}, keys)
    gts = F.col("gts")
    jaccard = lambda n, f: F.when(n == 0, 0.0).otherwise(1 - (gts - f) / (gts + n - f))
    step = jaccard(F.col("cn"), F.col("cf")) - jaccard(F.col("cn") - F.col("n"), F.col("cf") - F.col("f"))
    joined = (ranked if small else join_side(ranked, totals, keys) if keys
              else ranked.withColumn("gts", totals.select("gts").scalar()))
    return joined.groupBy(*keys).agg(F.sum(F.col("err") * step).alias("loss"))


def lovasz_softmax(df: DataFrame, classes: int, chosen: str | list[int] = "present", per_image: bool = False,
                   class_weight: list[float] | None = None, ignore: int | None = 255, reduction: str = "mean",
                   avg_factor: float | None = None) -> DataFrame:
    """Lovász-softmax over all rows, or per sample_id; the samples' losses are then reduced (`reduction` and
    `avg_factor` count only there)."""
    group = ["sample_id"] if per_image else []
    rows = df if ignore is None else df.filter(F.col("gt") != ignore)
    probs = rows.select(*group, "gt", C.softmax(F.col("logits"), classes).alias("logits"))
    hot = lambda i: F.when(F.col("gt") == i, 1).otherwise(0)
    error = lambda i, p: F.abs(hot(i).cast("double") - p)
    wanted = list(range(classes)) if isinstance(chosen, str) else list(chosen)
    if classes <= C.UNROLL_LIMIT:
        per_class = [F.struct(F.lit(i).alias("class_id"), hot(i).alias("fg"), error(i, F.get("logits", F.lit(i))).alias("err")) for i in wanted]
        errors = probs.select(*group, F.explode(F.array(*per_class)).alias("e")).select(*group, "e.*")
    else:
        errors = _by_class(probs, classes).filter(F.col("class_id").isin(*wanted)).select(
            *group, "class_id", hot(F.col("class_id")).alias("fg"), error(F.col("class_id"), F.col("score")).alias("err"))
    keys = [*group, "class_id"]
    totals = errors.groupBy(*keys).agg(F.sum("fg").alias("gts"))
    if chosen == "present":
        totals = totals.filter("gts > 0")
    scored = totals.join(_lovasz_sum(errors, totals, keys, _small_groups(rows, group)).hint("merge"), keys, "left").withColumn("loss", F.coalesce("loss", F.lit(0.0)))
    if class_weight is not None:
        scored = scored.withColumn("loss", F.col("loss") * F.get(_literals(class_weight), F.col("class_id")))
    if per_image:
        return reduce_loss(scored.groupBy("sample_id").agg(F.avg("loss").alias("loss")), "loss", None, reduction, avg_factor)
    return scored.agg(F.avg("loss").alias("loss"))


def lovasz_hinge(df: DataFrame, per_image: bool = False, ignore: int | None = 255, reduction: str = "mean",
                 avg_factor: float | None = None) -> DataFrame:
    """Binary hinge variant over rows (logit, gt 0/1); reduced over samples as `lovasz_softmax`."""
    key = ["sample_id"] if per_image else []
    rows = df if ignore is None else df.filter(F.col("gt") != ignore)
    errors = rows.select(*key, (1 - F.col("logit") * (2.0 * F.col("gt") - 1)).alias("err"), F.col("gt").alias("fg"))
    totals = errors.groupBy(*key).agg(F.sum("fg").alias("gts"))
    scored = _lovasz_sum(errors, totals, key, _small_groups(rows, key))
    if per_image:
        per = totals.join(scored.hint("merge"), key, "left").select(*key, F.coalesce("loss", F.lit(0.0)).alias("loss"))
        return reduce_loss(per, "loss", None, reduction, avg_factor)
    return scored.agg(F.avg(F.coalesce("loss", F.lit(0.0))).alias("loss"))


def silog(df: DataFrame, eps: float = 1e-4, weight: str | None = None, reduction: str = "mean") -> DataFrame:
    """Scale-invariant log loss per sample over (pred_depth, gt_depth), then reduced."""
    d = F.log(F.greatest("gt_depth", F.lit(eps))) - F.log(F.greatest("pred_depth", F.lit(eps)))
    ok = (F.col("gt_depth") > eps) & ~F.isnan(d)
    keep = F.when(ok, d)
    n = F.greatest(F.sum(F.when(ok, 1.0).otherwise(0.0)), F.lit(eps))
    mean = F.coalesce(F.sum(keep), F.lit(0.0)) / n
    square = F.coalesce(F.sum(keep * keep), F.lit(0.0)) / n
    extra = [] if weight is None else [F.first(weight).alias(weight)]
    per = df.groupBy("sample_id").agg(F.sqrt(F.greatest(square - 0.5 * mean * mean, F.lit(0.0))).alias("loss"), *extra)
    return reduce_loss(per, "loss", weight, reduction)


def kl_divergence(df: DataFrame, temperature: float = 1.0, mode: str = "reference", reduction: str = "mean",
                  by: str = "sample_id") -> DataFrame:
    """Per-sample mean or sum of target·(log target − input) over (logits, target_logits).

    mode `reference` takes the student's probabilities as input, `kl` their logarithms.
    """
    if mode not in ("reference", "kl"):
        raise ValueError(mode)
    soft = lambda c: C.softmax(F.transform(c, lambda v: v / temperature))
    rows = df.select(by, soft("logits").alias("p"), soft("target_logits").alias("t"))
    inp = (lambda p: p) if mode == "reference" else F.log
    # A zero target adds nothing.
    term = F.zip_with("t", "p", lambda t, p: F.when(t > 0, t * (F.log(t) - inp(p))).otherwise(0.0) * temperature**2)
    rows = rows.select(by, F.aggregate(term, F.lit(0.0), lambda a, v: a + v).alias("s"), F.size("p").alias("n"))
    total = F.sum("s")
    return rows.groupBy(by).agg((total if reduction == "sum" else total / F.sum("n")).alias("loss"))


def boundary_bce(df: DataFrame, loss_weight: float = 1.0) -> DataFrame:
    """Rows (logit, gt): positives weighted by the share of negatives and the other way round, mean over all rows."""
    l = _bce(F.col("logit"), F.col("gt").cast("double"))
    sums = df.agg(F.sum(F.when(F.col("gt") == 1, l).otherwise(0.0)).alias("lp"), F.sum(F.when(F.col("gt") == 0, l).otherwise(0.0)).alias("ln"),
                  F.sum(F.when(F.col("gt") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("gt") == 0, 1).otherwise(0)).alias("n"),
                  F.count(F.lit(1)).alias("m"))
    both = F.col("p") + F.col("n")
    return sums.select(((F.col("lp") * F.col("n") + F.col("ln") * F.col("p")) / both / F.col("m") * loss_weight).alias("loss"))


def ohem_cross_entropy(df: DataFrame, thresh: float = 0.7, min_kept: int = 100000, loss_weight: float = 1.0) -> DataFrame:
    """Mean loss of the rows whose target probability is under max(thresh, the min_kept-th smallest).
    df has (prob, loss) of rows that are not ignored."""
    floor = kth_value(df, "prob", min_kept)
    if floor is None:
        return df.agg(F.lit(0.0).alias("loss"))
    return df.agg((F.avg(F.when(F.col("prob") < max(floor, thresh), F.col("loss"))) * loss_weight).alias("loss"))


def target_scores(df: DataFrame, classes: int, ignore: int = 255, digits: int | None = None) -> DataFrame:
    """Rows not ignored with prob of the target class and its loss; `digits` rounds the probability."""
    prob = C.softmax_at(F.col("logits"), F.col("gt"), classes)
    rows = df.filter(F.col("gt") != ignore).withColumns({"prob": prob, "loss": pixel_cross_entropy(classes, None, ignore)})
    return rows if digits is None else rows.withColumns({"prob": C.snap(F.col("prob"), digits), "loss": C.snap(F.col("loss"), digits)})


def hausdorff(df: DataFrame, classes: int, mode: str = "reference", class_weight: list[float] | None = None, ignore: int = 255) -> DataFrame:
    """Distance-weighted squared error over (sample_id, y, x, logits, gt).

    mode `reference` compares every class with the raw label and takes one
    foreground mask (label non-zero; prediction = argmax non-zero); mode
    `class` compares with the one-hot label and takes per-class masks. A pixel
    carries all its masks through one distance transform, with the errors that
    its distances are to weigh, so nothing is joined; where an image has more
    than `WHOLE_ROWS` pixels, it travels once per mask. A mask without
    background adds nothing. Runs a job that counts pixels while it is built.
    """
    if mode not in ("reference", "class"):
        raise ValueError(mode)
    scored = [c for c in range(1, classes) if c != ignore]
    weight = _literals([1.0] * classes if class_weight is None else class_weight)
    base = df.select("sample_id", "y", "x", "gt", C.softmax(F.col("logits"), classes).alias("p"), C.argmax(F.col("logits")).alias("am"))
    added = lambda terms: fold(lambda a, b: a + b, [F.lit(0.0), *terms])
    of = lambda c, goal: F.pow(F.get("p", F.lit(c)) - goal, F.lit(2.0)) * F.get(weight, F.lit(c))
    if mode == "class":
        errors = [of(c, F.when(F.col("gt") == c, 1.0).otherwise(0.0)) for c in scored]
        hits = [lambda label, c=c: F.col(label) == c for c in scored]
    else:
        errors = [added([of(c, F.col("gt").cast("double")) for c in scored])]
        hits = [lambda label: F.col(label) != 0]
    masks = {f"{label}{i}": F.when(hit(label), 1).otherwise(0) for i, hit in enumerate(hits) for label in ("gt", "am")}
    px = base.select("sample_id", "y", "x", *[e.alias(f"e{i}") for i, e in enumerate(errors)], *[m.cast("tinyint").alias(n) for n, m in masks.items()])
    error = lambda name: F.col(f"e{name[2:]}")
    if _small_groups(df, ["sample_id"]):
        far = mask_distances(px, ["sample_id"], list(masks))
        total = F.sum(added([F.when(F.col(n) == 1, F.coalesce(error(n) * F.col(f"d2_{n}"), F.lit(0.0))).otherwise(0.0) for n in masks]))
        return far.agg((total / F.count(F.lit(1)) / classes).alias("loss"))
    side_by_side = F.posexplode(F.array(*[F.struct(error(n).alias("e"), F.col(n).cast("int").alias("fg")) for n in masks])).alias("mask", "m")
    far = squared_distance_transform(px.select("sample_id", "y", "x", side_by_side).select("sample_id", "mask", "y", "x", "m.*"), layer="mask", layers=len(masks))
    total = F.sum(F.when(F.col("fg") == 1, F.coalesce(F.col("e") * F.col("d2"), F.lit(0.0))).otherwise(0.0))
    return far.agg((total / (F.count(F.lit(1)) / len(masks)) / classes).alias("loss"))


def hierarchical_bce(df: DataFrame, ranges: list[tuple[int, int]], fine: int, gamma: float | None = None, eps: float = 1e-8,
                     ignore: int = 255) -> DataFrame:
    """Fine and coarse binary cross-entropy on consistent scores, times five; `gamma` gives the focal form.
    logits hold the fine classes, then the coarse ones."""
    whole = lambda values: F.array(*[F.lit(v) for v in values])
    coarse = len(ranges)
    parent = {i: k for k, (lo, hi) in enumerate(ranges) for i in range(lo, hi)}
    up = F.get(whole([parent.get(i, ignore) for i in range(fine)]), F.col("gt"))
    s = df.select(F.transform("logits", C.sigmoid).alias("p"), "gt", F.coalesce(F.when(F.col("gt") >= 0, up), F.lit(ignore)).alias("top"))
    p = F.col("p")

    def child(i):
        own = F.get(p, i)
        return F.struct(F.col("gt").alias("label"), F.lit(0).alias("level"), i.alias("i"),
                        F.least(own, F.get(p, F.get(whole([fine + parent[k] for k in range(fine)]), i))).alias("pos"), own.alias("neg"))

    def group(k):
        own = F.get(p, fine + k)
        below = F.slice(p, F.get(whole([lo + 1 for lo, _ in ranges]), k), F.get(whole([hi - lo for lo, hi in ranges]), k))
        return F.struct(F.col("top").alias("label"), F.lit(1).alias("level"), k.alias("i"), own.alias("pos"),
                        F.greatest(F.array_max(below), own).alias("neg"))

    scores = F.concat(F.transform(whole(range(fine)), child), F.transform(whole(range(coarse)), group))
    a, b = F.log(F.col("pos") + eps), F.log(1 - F.col("neg") + eps)
    if gamma is not None:
        a, b = a * F.pow(1 - F.col("pos"), F.lit(gamma)), b * F.pow(F.col("neg"), F.lit(gamma))
    own = F.when(F.col("label") == F.col("i"), -a).otherwise(-b)
    mean = lambda level: F.avg(F.when((F.col("level") == level) & (F.col("label") != ignore), own))
    return s.select(F.inline(scores)).agg((5 * (mean(0) + mean(1))).alias("loss"))


def tree_triplet(df: DataFrame, ranges: list[tuple[int, int]], fine: int, order: list[Column], max_triplet: int | None = None,
                 margin: float = 0.6, ignore: int = 255) -> DataFrame:
    """(loss, class_count) over (feats, gt): the i-th anchor, positive (same group, other class) and negative
    of every class, in row order, up to the smallest of the three lists, or `max_triplet` where it is given.
    """
    rows = df.select("gt", "feats", F.struct(*order).alias("o"))
    if max_triplet:  # the first rows of each label hold all that any list can use
        rows = top_k_per_group(rows, ["gt"], [F.col("o")], max_triplet).drop("rank")
    group = {i: (lo, hi) for lo, hi in ranges for i in range(lo, hi)}
    role = lambda i: (F.when(F.col("gt") == i, "a").when((F.col("gt") >= group[i][0]) & (F.col("gt") < group[i][1]), "p").otherwise("n"))
    uses = rows.select("feats", "o", F.explode(F.array(*[F.struct(F.lit(i).alias("class_id"), role(i).alias("role"))
                                                         for i in range(fine) if i != ignore])).alias("u"))
    placed = row_numbers(uses.select("feats", "o", "u.*"), [F.col("o")], ["class_id", "role"], "k")
    if max_triplet:
        placed = placed.filter(F.col("k") <= max_triplet)
    pick = lambda r: placed.filter(F.col("role") == r).select("class_id", "k", F.col("feats").alias(r))
    trio = pick("a").join(pick("p"), ["class_id", "k"]).join(pick("n"), ["class_id", "k"])
    gap = C.dot(F.col("a"), F.col("n")) - C.dot(F.col("a"), F.col("p")) + margin
    per = trio.groupBy("class_id").agg(F.avg(F.greatest(gap, F.lit(0.0))).alias("loss"))
    return per.agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("class_count"))


def sum_losses(named: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row per loss name; equal names add up."""
    rows = fold(lambda a, b: a.unionByName(b), [df.select(F.lit(n).alias("name"), F.col("loss")) for n, df in named])
    return rows.groupBy("name").agg(F.sum("loss").alias("loss"))


def presence_bce(px: DataFrame, scores: DataFrame, classes: int) -> DataFrame:
    """Binary cross-entropy of scores(sample_id, logits) against the classes that occur in a sample."""
    seen = px.filter(F.col("gt").between(0, classes - 1)).select("sample_id", F.col("gt").cast("int").alias("class_id"), F.lit(1.0).alias("hot")).distinct()
    rows = _by_class(scores.select("sample_id", "logits"), classes).join(seen, ["sample_id", "class_id"], "left")
    return rows.agg(F.avg(_bce(F.col("score"), F.coalesce("hot", F.lit(0.0)))).alias("loss"))
