"""Hard-example mining and data-set selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.functions import columns as C
from segspark.functions.prefix import kth_smallest, kth_value, row_numbers
from segspark.runtime import materialize


def hard_pixels_by_confidence(scored: DataFrame, thresh: float, min_kept: int, batch_size: int = 1) -> DataFrame:
    """Add weight: 1 where prob is under max(thresh, the (min_kept * batch)-th smallest), else 0.
    `scored` holds the rows that are not ignored, with prob."""
    floor = kth_value(scored, "prob", min_kept * batch_size)
    cut = thresh if floor is None else max(floor, thresh)
    return scored.withColumn("weight", F.when(F.col("prob") < cut, 1.0).otherwise(0.0))


def hard_pixels_by_loss(scored: DataFrame, order: list[str], min_kept: int, batch_size: int = 1) -> DataFrame:
    """Add weight: 1 for the min_kept * batch rows of largest loss, the `order` columns (a total order,
    ascending) deciding among equals.

    Loss and order columns are written once; the cut value and the last kept
    one of its ties are found there, and the weight is a plain comparison.
    """
    k = min_kept * batch_size
    slim = materialize(scored.select(*order, (-F.col("loss")).alias("__neg")))
    edge = kth_smallest(slim, "__neg", k - 1, stored=True)
    if edge is None:
        return scored.withColumn("weight", F.lit(0.0))
    ties = row_numbers(slim.filter(F.col("__neg") == edge.value), [F.col(o) for o in order], name="__rank")
    last = ties.filter(F.col("__rank") <= k - edge.below).agg(F.max(F.struct("__rank", *order)).alias("m")).first()["m"]
    early, same = F.lit(False), F.lit(True)
    for o in order:
        early = early | (same & (F.col(o) < F.lit(last[o])))
        same = same & (F.col(o) == F.lit(last[o]))
    kept = (F.col("loss") > -edge.value) | ((F.col("loss") == -edge.value) & (early | same))
    return scored.withColumn("weight", F.when(kept, 1.0).otherwise(0.0))


def fraction_subset(samples: DataFrame, fraction: float, seed: int = 0, key: str = "name", draw=None) -> DataFrame:
    """floor(n * fraction) reproducible rows, indexed again from 0 in key order."""
    drawn = samples.withColumn("__h", (draw or C.hashed(seed))(0, F.col(key)))
    keep = int(samples.count() * fraction)
    ranked = row_numbers(drawn, [F.col("__h"), F.col(key)], name="__rank").filter(F.col("__rank") <= keep).drop("__rank", "__h")
    return with_index(ranked, [F.col(key)])


def with_index(samples: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """0-based position in a total order."""
    return row_numbers(samples, order, name=name).withColumn(name, F.col(name) - 1)


def first_n(samples: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """First n rows (last ones when n is negative), as an index range."""
    indexed = with_index(samples, order)
    if n >= 0:
        return indexed.filter(F.col("idx") < n)
    return indexed.filter(F.col("idx") >= samples.count() + n)


def by_index(samples: DataFrame, indices: DataFrame, order: list[Column]) -> DataFrame:
    """Rows whose position is listed in indices(idx)."""
    return with_index(samples, order).join(indices.select("idx"), "idx", "left_semi")


def repeat(samples: DataFrame, times: int) -> DataFrame:
    return samples.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def concat(datasets: list[DataFrame]) -> DataFrame:
    """Rows of several data sets with their number in `dataset_idx`."""
    out = None
    for i, df in enumerate(datasets):
        tagged = df.withColumn("dataset_idx", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def locate(indices: DataFrame, sizes: list[int]) -> DataFrame:
    """(idx, dataset_idx, local_idx) in the concatenation of data sets of the given sizes; negative
    indices count from the end, others outside fail the job."""
    total = sum(sizes)
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    at = F.when(F.col("idx") < 0, F.col("idx") + total).otherwise(F.col("idx"))
    checked = F.when((at >= 0) & (at < total), at).otherwise(F.raise_error(
        F.concat(F.lit("index out of range: "), F.col("idx").cast("string"))).cast("bigint"))
    begin = F.array(*[F.lit(s).cast("bigint") for s in starts])
    sizes_ = F.array(*[F.lit(s).cast("bigint") for s in sizes])
    # Empty data sets share a start; the last one that starts at or before the index and is not empty holds it.
    home = F.array_max(F.transform(begin, lambda s, i: F.when((s <= checked) & (F.get(sizes_, i) > 0), i).otherwise(-1)))
    return indices.withColumn("dataset_idx", home).withColumn("local_idx", checked - F.get(begin, F.col("dataset_idx")))


def run_steps(df: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], skip: set[str] = frozenset()) -> DataFrame:
    """Chain named DataFrame functions, leaving out the skipped names."""
    unknown = set(skip) - {n for n, _ in steps}
    if unknown:
        raise ValueError(f"unknown steps {sorted(unknown)}")
    for name, fn in steps:
        if name not in skip:
            df = df.transform(fn)
    return df
