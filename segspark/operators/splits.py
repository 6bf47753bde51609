"""Splits, pairings and checks on sample lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.functions import columns as C
from segspark.functions.prefix import row_numbers, top_k_per_group
from segspark.runtime import join_side


def merged_list(train: DataFrame, extra: DataFrame, val: DataFrame) -> DataFrame:
    """Distinct names of (train + extra) that are not in val."""
    return train.select("name").union(extra.select("name")).join(val, "name", "left_anti").distinct()


def extra_only(train: DataFrame, extra: DataFrame, val: DataFrame) -> DataFrame:
    return extra.select("name").join(train.select("name").union(val.select("name")), "name", "left_anti").distinct()


def expect_count(df: DataFrame, expected: int, strict: bool = False) -> DataFrame:
    """One row (found, expected, ok); `strict` fails the job instead of reporting."""
    report = df.agg(F.count(F.lit(1)).alias("found")).withColumn("expected", F.lit(expected).cast("bigint"))
    ok = F.col("found") == F.col("expected")
    if strict:
        ok = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unexpected count "), F.col("found").cast("string"))).cast("boolean"))
    return report.withColumn("ok", ok)


def split_by_list(samples: DataFrame, listed: DataFrame, default: str = "val") -> DataFrame:
    """listed(key, split) decides; other keys take `default`."""
    return (join_side(samples, listed, ["key"], "left")
            .withColumn("split", F.coalesce("split", F.lit(default))))


def first_n_by_name(samples: DataFrame, n: int, group: str = "source") -> DataFrame:
    """The first n names of each source are train, the rest val. `name` is unique within a source."""
    head = (top_k_per_group(samples.select(group, "name"), [group], [F.col("name")], n)
            .select(group, "name", F.lit("train").alias("split")))
    return (samples.join(head, [group, "name"], "left")
            .withColumn("split", F.coalesce("split", F.lit("val"))))


def every_third_to_val(tiles: DataFrame, seq: str = "seq") -> DataFrame:
    return tiles.withColumn("split", F.when(F.pmod(F.col(seq), F.lit(3)) == 0, "val").otherwise("train"))


def random_split(samples: DataFrame, test_share: float = 0.2, seed: int = 0, key: str = "name", draw=None) -> DataFrame:
    """Exact-size random split: ceil(n * share) rows with the smallest draw go to val."""
    drawn = samples.withColumn("__h", (draw or C.hashed(seed))(0, F.col(key)))
    ranked = row_numbers(drawn, [F.col("__h"), F.col(key)], name="__rank")
    n = samples.count()
    cut = -int(-n * test_share // 1)
    return (ranked.withColumn("split", F.when(F.col("__rank") <= cut, "val").otherwise("train"))
            .drop("__h", "__rank"))


def concat_folds(folds: list[DataFrame], width: int = 4) -> DataFrame:
    """Rows (i, …) of several folds under names fold<k>_<i padded>."""
    out = None
    for k, df in enumerate(folds, 1):
        named = df.withColumn("name", F.concat(F.lit(f"fold{k}_"), C.zfill(F.col("i"), width)))
        out = named if out is None else out.unionByName(named)
    return out


def pair_by_stem(images: DataFrame, masks: DataFrame) -> DataFrame:
    """images(stem, img), masks(stem, mask): pairs go to train, images without a mask to test,
    masks without an image are reported as orphan."""
    both = images.join(masks, "stem", "full_outer")
    split = (F.when(F.col("img").isNull(), "orphan").when(F.col("mask").isNull(), "test").otherwise("train"))
    return both.select("stem", "img", "mask", split.alias("split"))


def fill_missing_masks(samples: DataFrame, mask_px: DataFrame, height: int, width: int) -> DataFrame:
    """Every sample gets mask pixels; one without a mask gets zeros."""
    bare = samples.select("sample_id").join(mask_px.select("sample_id").distinct(), "sample_id", "left_anti")
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    zeros = bare.withColumn("y", axis(height)).withColumn("x", axis(width)).withColumn("gt", F.lit(0))
    return mask_px.select("sample_id", "y", "x", "gt").unionByName(zeros)


def read_pairs(lines: DataFrame, img_drop: str = "", ann_drop: str = "") -> DataFrame:
    """First two white-space separated fields of `value`, with a folder part removed."""
    parts = F.split(F.trim("value"), r"\s+")
    return (lines.filter(F.length(F.trim("value")) > 0)
            .select(F.replace(parts[0], F.lit(img_drop), F.lit("")).alias("img_path"),
                    F.replace(parts[1], F.lit(ann_drop), F.lit("")).alias("seg_map_path")))


def select_listed(samples: DataFrame, names: DataFrame) -> DataFrame:
    return samples.join(names.select("name"), "name", "left_semi")


def first_existing(samples: DataFrame, listing: DataFrame, suffixes: list[str]) -> DataFrame:
    """samples(stem) to the first candidate stem+suffix found in listing(path)."""
    tries = F.array(*[F.struct(F.lit(i).alias("priority"), F.concat("stem", F.lit(s)).alias("path"))
                      for i, s in enumerate(suffixes)])
    cand = samples.select("stem", F.explode(tries).alias("t")).select("stem", "t.priority", "t.path")
    return (cand.join(listing.select("path"), "path", "left_semi")
            .groupBy("stem").agg(F.min_by("path", "priority").alias("path")))


def regroup_members(members: DataFrame) -> DataFrame:
    """Archive paths <Split>/<Location>/<kind>/<file> to (path, target); masks of the test split are left out."""
    part = lambda i: F.regexp_extract("path", r"^([^/]+)/([^/]+)/([^/]+)/(.+)$", i)
    kind = F.when(part(3) == "images_png", "img_dir").when(part(3) == "masks_png", "ann_dir")
    split = F.lower(part(1))
    return (members.withColumn("kind", kind).withColumn("split", split)
            .filter(F.col("kind").isNotNull() & ~((F.col("split") == "test") & (F.col("kind") == "ann_dir")))
            .select("path", F.concat_ws("/", "kind", "split", part(4)).alias("target")))


def pair_by_position(left: DataFrame, right: DataFrame, left_order: Column, right_order: Column) -> DataFrame:
    """Pair the k-th rows of two sorted lists; a missing partner shows as NULL. Orders must be total."""
    a = row_numbers(left, [left_order], name="position")
    b = row_numbers(right, [right_order], name="position")
    return a.join(b, "position", "full_outer")


def missing_files(samples: DataFrame, listing: DataFrame) -> DataFrame:
    return samples.join(listing.select("path"), "path", "left_anti")


