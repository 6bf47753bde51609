"""Segmentation tables derived from the given tables, in Spark and as SQL text.

Every derivation reads its whole source table; the pixel tables multiply each
row by a 16 x 16 grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.plans.registry import table
from segspark.runtime import by_image, spread

SIDE = 16
CLASSES = 6


def _grid(df: DataFrame) -> DataFrame:
    axis = F.sequence(F.lit(0), F.lit(SIDE - 1))
    return df.withColumn("y", F.explode(axis)).withColumn("x", F.explode(axis))


def images(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """(sample_id, p_size, more…): a row per image, dealt as its pixels are."""
    return by_image(table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), "p_size", *more), "sample_id")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, y, x, gt, pred): six classes, 255 ignored, 6 out of range."""
    base = _grid(images(spark, d))
    block = F.expr("(y div 4) + (x div 4) + p_size")
    gt = F.when((F.col("sample_id") * 7 + F.col("y") * 16 + F.col("x")) % 97 == 0, 255).otherwise(block % 6)
    pred = (F.when((F.col("sample_id") + F.col("y") * 5 + F.col("x") * 3) % 11 == 0, (block + 1) % 6)
            .when((F.col("sample_id") + F.col("x") + F.col("y")) % 89 == 0, 6).otherwise(block % 6))
    return base.select("sample_id", "y", "x", gt.cast("int").alias("gt"), pred.cast("int").alias("pred"))


PIXELS = """px AS (
  SELECT sample_id, y, x,
    (CASE WHEN (sample_id*7 + y*16 + x) % 97 = 0 THEN 255 ELSE blk % 6 END)::INT AS gt,
    (CASE WHEN (sample_id + y*5 + x*3) % 11 = 0 THEN (blk+1) % 6
          WHEN (sample_id + x + y) % 89 = 0 THEN 6 ELSE blk % 6 END)::INT AS pred
  FROM (SELECT p_partkey AS sample_id, y::INT AS y, x::INT AS x, (y//4 + x//4 + p_size) AS blk
        FROM part, range(16) gy(y), range(16) gx(x)) g)"""


def pixel_logits(spark: SparkSession, d: str) -> DataFrame:
    """pixels + logits array<double>(6); the predicted class gets a bonus."""
    px = pixels(spark, d)
    base = F.col("sample_id") * 31 + F.col("y") * 17 + F.col("x") * 13
    vals = [((base + c * 29) % 101).cast("double") / 25.0 + F.when(F.col("pred") == c, 1.5).otherwise(0.0)
            for c in range(CLASSES)]
    return px.select("sample_id", "y", "x", "gt", "pred", F.array(*vals).alias("logits"))


PIXEL_LOGITS = PIXELS + """, lg AS (
  SELECT sample_id, y, x, gt, pred, c::INT AS c,
    ((sample_id*31 + y*17 + x*13 + c*29) % 101)::DOUBLE / 25.0 + CASE WHEN pred = c THEN 1.5 ELSE 0.0 END AS v
  FROM px, range(6) k(c))"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, gt, logits array<double>(10)): every embedding, folded by index mod 10."""
    emb = spread(table(spark, d, "embeddings"), "vec_id")
    e = F.col("embedding")
    fold = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.aggregate(
        F.filter(e, lambda v, i: i % 10 == c), F.lit(0.0), lambda a, v: a + v.cast("double")) * 4.0)
    return emb.select(F.col("vec_id").alias("id"), F.col("label").alias("gt"), fold.alias("logits"))


VECTORS = """vc AS (
  SELECT vec_id AS id, label AS gt, c::INT AS c,
    4.0 * list_sum([embedding[i+1]::DOUBLE for i in range(c, len(embedding), 10)]) AS v
  FROM embeddings, range(10) k(c))"""


def depths(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, y, x, gt_depth, pred_depth) from the order lines."""
    li = table(spark, d, "lineitem")
    gt = F.col("l_extendedprice") / 1000
    return li.select(F.col("l_orderkey").alias("sample_id"), F.pmod("l_partkey", F.lit(480)).cast("int").alias("y"),
                     F.pmod("l_suppkey", F.lit(640)).cast("int").alias("x"), gt.alias("gt_depth"),
                     (gt * (1 - F.col("l_discount") + F.col("l_tax"))).alias("pred_depth"))


DEPTHS = """dp AS (
  SELECT l_orderkey AS sample_id, (l_partkey % 480)::INT AS y, (l_suppkey % 640)::INT AS x,
    l_extendedprice/1000 AS gt_depth, l_extendedprice/1000 * (1 - l_discount + l_tax) AS pred_depth
  FROM lineitem)"""


def image(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, y, x, c, v): three channels of integers 0..255."""
    base = _grid(images(spark, d)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(2))))
    v = (F.col("p_size") * 7 + F.col("y") * 13 + F.col("x") * 31 + F.col("c") * 17 + F.col("sample_id") % 101) % 256
    return base.select("sample_id", "y", "x", "c", v.cast("double").alias("v"))


IMAGE = """im AS (
  SELECT p_partkey AS sample_id, y::INT AS y, x::INT AS x, c::INT AS c,
    ((p_size*7 + y*13 + x*31 + c*17 + p_partkey % 101) % 256)::DOUBLE AS v
  FROM part, range(16) gy(y), range(16) gx(x), range(3) gc(c))"""


def volume(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, c, z, y, x, v, gt): an 8 x 8 x 8 volume per part, one channel."""
    part = images(spark, d)
    axis = F.sequence(F.lit(0), F.lit(7))
    vox = (part.withColumn("z", F.explode(axis)).withColumn("y", F.explode(axis)).withColumn("x", F.explode(axis)))
    key = F.col("p_size") * 5 + F.col("z") * 11 + F.col("y") * 3 + F.col("x") * 7 + F.col("sample_id") % 13
    gt = F.when(key % 9 == 0, 1).when(key % 9 == 4, 2).otherwise(0)
    return vox.select("sample_id", F.lit(0).alias("c"), "z", "y", "x", (key % 64).cast("double").alias("v"),
                      gt.cast("int").alias("gt"))


VOLUME = """vx AS (
  SELECT sample_id, 0 AS c, z, y, x, (k % 64)::DOUBLE AS v,
    (CASE WHEN k % 9 = 0 THEN 1 WHEN k % 9 = 4 THEN 2 ELSE 0 END)::INT AS gt
  FROM (SELECT p_partkey AS sample_id, z::INT AS z, y::INT AS y, x::INT AS x,
               p_size*5 + z*11 + y*3 + x*7 + p_partkey % 13 AS k
        FROM part, range(8) a(z), range(8) b(y), range(8) e(x)) g)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, box_id, x1, y1, x2, y2, score): eight order keys form an image."""
    from pyspark.sql import Window
    li = table(spark, d, "lineitem")
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    w = Window.partitionBy("l_orderkey").orderBy(*cols)
    li = li.select(*cols, F.row_number().over(w).alias("rn"))
    x1, y1 = F.pmod("l_partkey", F.lit(100)).cast("double"), F.pmod("l_suppkey", F.lit(100)).cast("double")
    return li.select(F.expr("l_orderkey div 8").alias("image_id"),
                     (F.col("l_orderkey") * 1000 + F.col("rn")).alias("box_id"), x1.alias("x1"), y1.alias("y1"),
                     (x1 + F.col("l_quantity")).alias("x2"),
                     (y1 + 1 + F.col("l_linenumber") * 5).alias("y2"), F.col("l_discount").alias("score"))


BOXES = """bx AS (
  SELECT l_orderkey // 8 AS image_id, l_orderkey*1000 + rn AS box_id, (l_partkey % 100)::DOUBLE AS x1,
    (l_suppkey % 100)::DOUBLE AS y1, (l_partkey % 100)::DOUBLE + l_quantity AS x2,
    (l_suppkey % 100)::DOUBLE + 1 + l_linenumber*5 AS y2, l_discount AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber,
      l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn
    FROM lineitem) t)"""


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """(run, line_no, ts, step, metric, value, line): a JSON log line per event."""
    ev = table(spark, d, "events")
    step = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("bigint")).when(
        F.col("event_id") % 11 == 0, F.lit(0).cast("bigint")).otherwise(F.expr("event_id div 5"))
    body = F.to_json(F.struct(step.alias("step"), F.col("value").alias("loss"),
                              F.get_json_object("props", "$.k").cast("double").alias("mIoU")))
    return ev.select(F.col("user_id").alias("run"), F.col("event_id").alias("line_no"), "ts",
                     step.alias("step"), F.col("event_type").alias("mode"), "value", body.alias("line"), "props")


LOG_LINES = """lg AS (
  SELECT user_id AS run, event_id AS line_no, ts,
    CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 0 ELSE event_id // 5 END AS step,
    event_type AS mode, value, json_extract_string(props, '$.k')::DOUBLE AS k
  FROM events)"""


# Reproducible draws that both engines can compute.
_STEPS = (31, 1009, 65537, 257, 131)


def draw(salt, *keys):
    total = F.lit(salt * 7919 + 17).cast("bigint")
    for k, m in zip(keys, _STEPS):
        total = total + k.cast("bigint") * m
    return (F.pmod(F.pmod(total, F.lit(2147483647)) * 48271, F.lit(2147483647))).cast("double") / 2147483647.0


def draw_sql(salt, *keys):
    total = " + ".join([str(salt * 7919 + 17), *[f"({k})::BIGINT*{m}" for k, m in zip(keys, _STEPS)]])
    return f"((({total}) % 2147483647)*48271 % 2147483647)::DOUBLE/2147483647.0::DOUBLE"
