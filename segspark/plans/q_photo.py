"""Queries for photometric work and drawing."""

from pyspark.sql import functions as F

from segspark.operators import convert as V, photo as P
from segspark.plans import fixtures as X
from segspark.plans.q_geometry import digest, digest_sql
from segspark.plans.registry import query, table


def chan(df, digits=3):
    at = F.col("y") * 64 + F.col("x") + 1
    return df.groupBy("sample_id", "c").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), digits).alias("total"),
                                            F.round(F.sum(F.col("v") * at), digits).alias("checksum"))


def chan_sql(src, digits=3):
    return (f"SELECT sample_id, c, count(*) AS n, round(sum(v)::DOUBLE, {digits}) AS total, "
            f"round(sum(v*(y*64 + x + 1))::DOUBLE, {digits}) AS checksum FROM {src} GROUP BY 1, 2")


@query("f01_normalise", f"""WITH {X.IMAGE}, o AS (SELECT sample_id, y, x, c, (v - [123.675::DOUBLE, 116.28, 103.53][c+1]) / [58.395::DOUBLE, 57.12, 57.375][c+1] AS v FROM im) {chan_sql('o')}""")
def normalise(spark, d):
    return chan(P.normalise(X.image(spark, d), [123.675, 116.28, 103.53], [58.395, 57.12, 57.375]))


@query("f02_swap_channels", f"WITH {X.IMAGE}, o AS (SELECT sample_id, y, x, 2 - c AS c, v FROM im) {chan_sql('o')}")
def swap(spark, d):
    return chan(P.swap_channels(X.image(spark, d)))


@query("f03_rerange", f"""WITH {X.IMAGE}, e AS (SELECT sample_id, min(v) AS lo, max(v) AS hi FROM im GROUP BY 1),
o AS (SELECT sample_id, y, x, c, (v - lo)/(hi - lo)*2 - 1 AS v FROM im JOIN e USING (sample_id)) {chan_sql('o')}""")
def rerange(spark, d):
    return chan(P.rerange(X.image(spark, d), -1.0, 1.0))


@query("f04_gray", f"""WITH {X.IMAGE}, g AS (SELECT sample_id, y, x, sum(v * [0.299::DOUBLE, 0.587, 0.114][c+1]) AS v FROM im GROUP BY 1, 2, 3),
o AS (SELECT sample_id, y, x, k::INT AS c, v FROM g, range(2) t(k)) {chan_sql('o')}""")
def gray(spark, d):
    return chan(P.to_gray(X.image(spark, d), out_channels=2))


@query("f05_gamma", f"""WITH {X.IMAGE}, o AS (SELECT sample_id, y, x, c, floor(pow(v/255.0::DOUBLE, 1.0::DOUBLE/1.5)*255)::INT AS v FROM im) {chan_sql('o')}""")
def gamma(spark, d):
    return chan(X.image(spark, d).withColumn("v", P.adjust_gamma(F.col("v"), 1.5)).withColumn("v", F.col("v").cast("double")))


@query("f06_brightness_contrast", f"""WITH {X.IMAGE}, o AS (SELECT sample_id, y, x, c, floor(least(greatest(v*1.25 - 16, 0), 255))::INT AS v FROM im) {chan_sql('o')}""")
def brightness(spark, d):
    return chan(X.image(spark, d).withColumn("v", P.linear(F.col("v"), 1.25, -16.0).cast("double")))


def _wide(spark, d):
    return V.widen_channels(X.image(spark, d)).select("sample_id", "y", "x", *[F.col(f"c{i}").cast("int").alias(n) for i, n in enumerate("rgb")])


@query("f07_distort")
def distort(spark, d):
    params = X.images(spark, d).select(
        "sample_id", (F.col("p_size") % 17 - 8).cast("double").alias("brightness"),
        (0.75 + F.col("p_size") % 5 / 8.0).alias("contrast"),
        F.when(F.col("p_size") % 2 == 0, 1.25).alias("saturation"), F.when(F.col("p_size") % 3 == 0, F.col("p_size") % 18).alias("hue"),
        (F.col("p_size") % 2 == 1).alias("contrast_last"))
    out = P.distort(_wide(spark, d), params)
    return out.groupBy("sample_id").agg(*[F.sum(c).alias(c) for c in "rgb"])


@query("f08_clahe")
def clahe(spark, d):
    return chan(P.clahe(X.image(spark, d), X.SIDE, X.SIDE, 2.0, (2, 2)).withColumn("v", F.col("v").cast("double")))


@query("f09_image_stats", f"""WITH {X.IMAGE} SELECT sample_id, c, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max FROM im GROUP BY 1, 2""")
def stats(spark, d):
    return P.image_stats(X.image(spark, d)).select("sample_id", "c", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


def _palette(spark, d):
    c = (F.col("p_size") % 6).cast("int")
    return table(spark, d, "part").select(c.alias("class_id")).distinct().select(
        "class_id", (F.col("class_id") * 40).alias("r"), (F.col("class_id") * 30 + 5).alias("g"), (255 - F.col("class_id") * 20).alias("b"))


@query("f10_blend", f"""WITH {X.PIXELS}, {X.IMAGE}, o AS (SELECT im.sample_id, im.y, im.x, c, floor(v*0.5 + CASE WHEN gt = 255 THEN 0 ELSE [gt*40, gt*30 + 5, 255 - gt*20][c+1] END*0.5)::INT AS v
  FROM im JOIN px USING (sample_id, y, x)) {chan_sql('o')}""")
def blend(spark, d):
    return chan(P.blend(X.image(spark, d), X.pixels(spark, d), _palette(spark, d), 0.5).withColumn("v", F.col("v").cast("double")))


@query("f11_anchor", f"""WITH {X.PIXELS}, n AS (SELECT sample_id, gt, y, count(*) AS n FROM px WHERE gt < 6 GROUP BY 1, 2, 3),
b AS (SELECT sample_id, gt, y, n FROM n QUALIFY row_number() OVER (PARTITION BY sample_id, gt ORDER BY n DESC, y) = 1),
r AS (SELECT px.*, n, row_number() OVER (PARTITION BY px.sample_id, px.gt ORDER BY x) AS k FROM px JOIN b USING (sample_id, gt, y))
SELECT sample_id, gt, x, y FROM r WHERE k = n // 2 + 1""")
def anchor(spark, d):
    return P.label_anchors(X.pixels(spark, d), X.CLASSES)


@query("f12_compose", f"""WITH {X.PIXELS}, o AS (SELECT sample_id, y, x, gt AS v FROM px UNION ALL SELECT sample_id, y, x + 16, pred FROM px) {digest_sql('o', 'v')}""")
def compose(spark, d):
    px = X.pixels(spark, d)
    pick = lambda c: px.select("sample_id", "y", "x", F.col(c).alias("v"))
    return digest(P.side_by_side(pick("gt"), pick("pred"), X.SIDE), "v")


@query("f12_stack", f"""WITH {X.PIXELS}, o AS (SELECT sample_id, y, x, gt AS v FROM px UNION ALL SELECT sample_id, y + 16, x, pred FROM px) {digest_sql('o', 'v')}""")
def stack(spark, d):
    px = X.pixels(spark, d)
    pick = lambda c: px.select("sample_id", "y", "x", F.col(c).alias("v"))
    return digest(P.stacked(pick("gt"), pick("pred"), X.SIDE), "v")
