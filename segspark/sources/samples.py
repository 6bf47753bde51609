"""Sample indexes: one row per image/annotation pair, from listings, split files and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.runtime import join_side


def stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def list_files(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(path, length, modified) of files under `folder`, recursive; contents are never read."""
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", f"*{suffix}").load(folder))
    return listing.select("path", "length", F.col("modificationTime").alias("modified"))


def scan_samples(spark: SparkSession, img_dir: str, img_suffix: str, ann_dir: str | None = None,
                 seg_suffix: str = ".png") -> DataFrame:
    """(img_path[, seg_map_path]) sorted by img_path."""
    files = list_files(spark, img_dir, img_suffix).select(F.col("path").alias("img_path"))
    if ann_dir is not None:
        rel = F.regexp_replace("img_path", r"^.*?" + _quoted(img_dir.rstrip("/")) + "/", "")
        files = files.withColumn("seg_map_path", F.concat(F.lit(ann_dir.rstrip("/") + "/"), swap_suffix(rel, img_suffix, seg_suffix)))
    return files.orderBy("img_path")


def _quoted(text: str) -> str:
    import re
    return re.escape(text)


def swap_suffix(path: Column, old: str, new: str) -> Column:
    return F.concat(F.substring(path, F.lit(1), F.length(path) - len(old)), F.lit(new))


def with_seg_path(df: DataFrame, img_suffix: str, seg_suffix: str) -> DataFrame:
    return df.withColumn("seg_map_path", swap_suffix(F.col("img_path"), img_suffix, seg_suffix))


def samples_from_split(lines: DataFrame, img_dir: str, ann_dir: str | None, img_suffix: str = ".jpg",
                       seg_suffix: str = ".png") -> DataFrame:
    """One stem per line (`value`), trimmed."""
    name = strip(F.col("value"))
    out = [F.concat(F.lit(img_dir + "/"), name, F.lit(img_suffix)).alias("img_path")]
    if ann_dir is not None:
        out.append(F.concat(F.lit(ann_dir + "/"), name, F.lit(seg_suffix)).alias("seg_map_path"))
    return lines.select(*out)


def change_samples(lines: DataFrame, img_dir: str, img_dir2: str, ann_dir: str | None, img_suffix: str = ".jpg",
                   img_suffix2: str = ".jpg", seg_suffix: str = ".png") -> DataFrame:
    """Two images per line; an extension written on the line replaces both suffixes of that line."""
    line = strip(F.col("value"))
    ext = F.regexp_extract(line, r"[^/](\.[^./]*)$", 1)
    name = F.when(ext != "", F.substring(line, F.lit(1), F.length(line) - F.length(ext))).otherwise(line)
    pick = lambda s: F.when(ext != "", ext).otherwise(F.lit(s))
    out = [F.concat(F.lit(img_dir + "/"), name, pick(img_suffix)).alias("img_path"),
           F.concat(F.lit(img_dir2 + "/"), name, pick(img_suffix2)).alias("img_path2")]
    if ann_dir is not None:
        out.append(F.concat(F.lit(ann_dir + "/"), name, F.lit(seg_suffix)).alias("seg_map_path"))
    return lines.select(*out)


def annotated_samples(annotations: DataFrame, images: DataFrame, ann_suffix: str, img_suffix: str) -> DataFrame:
    """annotations(name) whose image exists in images(name): (img_name, seg_name)."""
    wanted = annotations.select(swap_suffix(F.col("name"), ann_suffix, img_suffix).alias("img_name"),
                                F.col("name").alias("seg_name"))
    return wanted.join(images.select(F.col("name").alias("img_name")), "img_name", "left_semi")


MANIFEST = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("tensorImageSize", T.StringType()),
    T.StructField("modality", T.MapType(T.StringType(), T.StringType())),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("numTraining", T.LongType()), T.StructField("numTest", T.LongType()),
    T.StructField("training", T.ArrayType(T.StructType([
        T.StructField("image", T.StringType()), T.StructField("label", T.StringType())]))),
    T.StructField("test", T.ArrayType(T.StringType()))])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", "true").json(path)


def manifest_samples(manifest: DataFrame, root: Column, split: str = "train") -> DataFrame:
    """(name, img_path[, seg_map_path]); a leading ./ of a relative path is dropped."""
    join = lambda p: F.concat(root, F.lit("/"), F.regexp_replace(p, r"^\./", ""))
    if split == "test":
        return manifest.select("name", F.explode("test").alias("t")).select("name", join(F.col("t")).alias("img_path"))
    rows = manifest.select("name", F.explode("training").alias("t"))
    return rows.select("name", join(F.col("t.image")).alias("img_path"), join(F.col("t.label")).alias("seg_map_path"))


def manifest_classes(manifest: DataFrame) -> DataFrame:
    return (manifest.select("name", F.explode("labels").alias("id", "class_name"))
            .select("name", F.col("id").cast("int").alias("class_id"), "class_name"))


def depth_samples(listing: DataFrame, classes: DataFrame, img_suffix: str = ".jpg", depth_suffix: str = ".png") -> DataFrame:
    """(img_path, depth_map_path, category_id): the category is the file name up to one character
    before its first digit; unknown names give -1. classes(class_id, class_name) is a dimension."""
    base = F.element_at(F.split("img_path", "/"), -1)
    named = listing.withColumn("class_name", F.regexp_extract(base, r"^(\D*)\D\d", 1))
    ids = classes.select("class_name", F.col("class_id").alias("category_id"))
    return (join_side(named, ids, ["class_name"], "left")
            .select("img_path", swap_suffix(F.col("img_path"), img_suffix, depth_suffix).alias("depth_map_path"),
                    F.coalesce("category_id", F.lit(-1)).alias("category_id")))


def csv_samples(lines: DataFrame) -> DataFrame:
    """Text before the last comma of each line."""
    return lines.select(F.regexp_replace(strip(F.col("value")), r",[^,]*$", "").alias("img_path"))


DECLARED = T.StructType([T.StructField("samples", T.ArrayType(T.StructType([
    T.StructField("media", T.StructType([
        T.StructField("image", T.StringType()), T.StructField("image_shape", T.ArrayType(T.IntegerType()))])),
    T.StructField("label_map", T.StringType()), T.StructField("instance_map", T.StringType())])))])


def read_declared(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DECLARED).option("multiLine", "true").json(path)


def declared_samples(files: DataFrame, root: Column) -> DataFrame:
    """(img_path, seg_map_path, h, w) of a declarative sample file."""
    rows = files.select(F.explode("samples").alias("s"))
    return rows.select(F.concat(root, F.lit("/"), F.col("s.media.image")).alias("img_path"),
                       F.concat(root, F.lit("/"), F.col("s.label_map")).alias("seg_map_path"),
                       F.try_element_at("s.media.image_shape", F.lit(1)).alias("h"),
                       F.try_element_at("s.media.image_shape", F.lit(2)).alias("w"))


def split_list(samples: DataFrame, path_column: str = "img_path") -> DataFrame:
    """Sorted stems, one per line."""
    return samples.select(stem(F.col(path_column)).alias("value")).orderBy("value")


def write_split_list(samples: DataFrame, target: str, path_column: str = "img_path") -> None:
    split_list(samples, path_column).write.text(target)
