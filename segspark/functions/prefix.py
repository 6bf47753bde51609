"""Ranks, running totals and order statistics without one-task windows.

Rows are range-partitioned on (group, order), the partition number is frozen
in a written table, and each partition only adds the totals of the partitions
before it. A group of any size is therefore spread over as many tasks as it
needs; only one row per (group, partition) is ever brought together.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.runtime import materialize, salt

PART = "__part"


def _ranged(df: DataFrame, group: list[str], order: list[Column], partitions: int | None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group]
    return materialize(df.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id()))


def _earlier(group: list[str]):
    keys = group or [F.lit(0)]
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column],
                   group: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Add inclusive running sums, in `order`, within each group.

    `order` must be a total order, or the sums must not care how ties fall.
    """
    group = list(group or [])
    named = df
    for name, value in sums.items():
        named = named.withColumn(name, value)
    base = _ranged(named, group, order, partitions)
    totals = base.groupBy(*group, PART).agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    offsets = totals.select(*group, PART, *[
        F.coalesce(F.sum(f"__t_{s}").over(_earlier(group)), F.lit(0)).alias(f"__o_{s}") for s in sums])
    inside = Window.partitionBy(*group, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = base.join(offsets, [*group, PART])
    keep = [c for c in df.columns if c not in sums]
    return out.select(*keep, *[(F.col(f"__o_{s}") + F.sum(s).over(inside)).alias(s) for s in sums])


def row_numbers(df: DataFrame, order: list[Column], group: list[str] | None = None,
                name: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based position in `order` within each group."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, group, partitions)


def carry_forward(df: DataFrame, order: list[str], column: str, group: list[str] | None = None,
                  partitions: int | None = None) -> DataFrame:
    """Replace NULLs of `column` by the last earlier value of the same group.

    `order` names columns, taken ascending.
    """
    group = list(group or [])
    keys = [F.col(o) for o in order]
    base = _ranged(df, group, keys, partitions)
    inside = Window.partitionBy(*group, PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumn("__seen", F.last(column, ignorenulls=True).over(inside))
    seat = F.when(F.col(column).isNotNull(), F.struct(*keys))
    ends = base.groupBy(*group, PART).agg(F.max_by(F.col(column), seat).alias("__end"))
    before = ends.select(*group, PART, F.last("__end", ignorenulls=True).over(_earlier(group)).alias("__carry"))
    return (local.join(before, [*group, PART])
            .select(*[F.coalesce("__seen", "__carry").alias(c) if c == column else F.col(c) for c in df.columns]))


def segments(df: DataFrame, position: str, columns: list[str], group: list[str],
             partitions: int | None = None) -> DataFrame:
    """`df` with the NULLs of `columns` replaced by the last earlier values of the group, and `until`: the
    next row's position (NULL on the last). A column has at most one value at a position; all but one of the rows
    of a position have no length."""
    order = [F.col(position)]
    base = _ranged(df, group, order, partitions)
    inside = Window.partitionBy(*group, PART).orderBy(*order)
    dealt = base.repartition(partitions, *group, PART) if partitions else base
    local = dealt.withColumns({
        **{f"__seen_{c}": F.last(c, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for c in columns},
        "__next": F.lead(position).over(inside)})
    seat = lambda c: F.when(F.col(c).isNotNull(), F.struct(*order))
    ends = base.groupBy(*group, PART).agg(F.min(position).alias("__first"),
                                          *[F.max_by(F.col(c), seat(c)).alias(f"__end_{c}") for c in columns])
    parts = Window.partitionBy(*group).orderBy(PART)
    around = ends.select(*group, PART, F.lead("__first").over(parts).alias("__after"),
                         *[F.last(f"__end_{c}", ignorenulls=True).over(_earlier(group)).alias(f"__carry_{c}") for c in columns])
    return local.join(around, [*group, PART]).select(
        *[F.coalesce(f"__seen_{c}", f"__carry_{c}").alias(c) if c in columns else F.col(c) for c in df.columns],
        F.coalesce("__next", "__after").alias("until"))


class OrderStatistic(NamedTuple):
    value: float
    below: int


def kth_smallest(df: DataFrame, value: str, k: int, stored: bool = False, buckets: int = 4096) -> OrderStatistic | None:
    """The value at 0-based position min(k, n-1) and how many values are smaller; None for no values.

    The value column alone is written once, so a costly score is computed in
    one scan (`stored` says that `df` already is such a table). Then come the
    range, a histogram with map-side counts, and a ranking of the one bucket
    that holds the k-th value. The driver sees one row of each pass.
    """
    slim = df.select(F.col(value).alias("v"))
    rows = (slim if stored else materialize(slim)).filter("v is not null")
    lo, hi, n = rows.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    if not n:
        return None
    goal = min(k, n - 1)
    if lo == hi:
        return OrderStatistic(lo, 0)
    cut = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(hi - lo) * buckets), F.lit(buckets - 1)).cast("int")
    numbered = rows.withColumn("b", cut)
    counts = numbered.groupBy("b").agg(F.count(F.lit(1)).alias("m"))
    # A window over at most `buckets` rows.
    ladder = counts.withColumn("upto", F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy("b")))
    bucket, before = ladder.filter(F.col("upto") > goal).agg(F.min("b"), F.min(F.col("upto") - F.col("m"))).first()
    near = numbered.filter(F.col("b") == bucket).groupBy("v").agg(F.count(F.lit(1)).alias("m"))
    ranked = running_totals(near, [F.col("v")], {"upto": F.col("m")})
    top, smaller = (ranked.filter(F.col("upto") + before > goal)
                    .agg(F.min("v"), F.min(F.col("upto") - F.col("m"))).first())
    return OrderStatistic(top, before + smaller)


def kth_value(df: DataFrame, value: str, k: int) -> float | None:
    found = kth_smallest(df, value, k)
    return None if found is None else found.value


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, salts: int = 32,
                    name: str = "rank") -> DataFrame:
    """Best k rows of each group, cut per salt first so that a hot group is
    never sorted by one task. `order` must be a total order."""
    salted = df.withColumn("__salt", salt(df, group, salts))
    first = Window.partitionBy(*group, "__salt").orderBy(*order)
    cut = salted.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= k).drop("__r", "__salt")
    last = Window.partitionBy(*group).orderBy(*order)
    return cut.withColumn(name, F.row_number().over(last)).filter(F.col(name) <= k)
