"""Queries for the user-function surface."""

import numpy as np
from pyspark.sql import functions as F

from segspark.functions import sql as Q
from segspark.operators import labels as L, metrics as M, predict as H
from segspark.plans import fixtures as X
from segspark.plans.q_geometry import digest, digest_sql
from segspark.plans.q_masks import MASK, _rle
from segspark.plans.registry import query, table


def _two_class_model():
    """Window values to logits (v, 100 - v), classes last."""
    def run(frame):
        data = frame["data"].map(lambda v: np.stack([np.asarray(v), 100.0 - np.asarray(v)], axis=1).ravel())
        return frame.assign(data=data)
    return run


@query("u01_slide_inference", f"""WITH {X.PIXELS} SELECT sample_id, y, x, (gt*17 % 101 < 50)::INT AS pred FROM px""")
def slide(spark, d):
    px = X.pixels(spark, d).select("sample_id", "y", "x", (F.col("gt") * 17 % 101).cast("double").alias("v"))
    out = H.slide_inference(px, X.SIDE, X.SIDE, 8, 5, 2, _two_class_model)
    return H.predict_labels(out).select("sample_id", "y", "x", "pred")


@query("u01_whole_inference", "SELECT vec_id AS sample_id, (list_sum([z::DOUBLE for z in embedding]) > 0)::INT AS pred FROM embeddings")
def whole(spark, d):
    def load():
        return lambda f: f[["sample_id"]].assign(pred=f["data"].map(lambda v: int(np.sum(v) > 0)))
    rasters = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("data"))
    return H.apply_model(rasters, load, "sample_id bigint, pred int")


@query("u02_named_transforms", f"WITH {X.PIXELS}, o AS (SELECT sample_id, y, x, CASE WHEN gt IN (0, 255) THEN 255 ELSE gt - 1 END AS gt FROM px WHERE y < 8) {digest_sql('o')}")
def named(spark, d):
    if "reduce_zero" not in Q.TRANSFORMS:
        Q.transform("reduce_zero")(lambda df: df.withColumn("gt", L.reduce_zero_label(F.col("gt"))))
        Q.transform("top_rows")(lambda df, rows: df.filter(F.col("y") < rows))
    return digest(Q.build([{"type": "reduce_zero"}, {"type": "top_rows", "rows": 8}])(X.pixels(spark, d)))


@query("u03_custom_metric", f"WITH {X.PIXELS} SELECT sample_id, round(avg((gt = pred)::INT), 6) AS hit_rate FROM px WHERE gt <> 255 GROUP BY sample_id")
def custom(spark, d):
    partial = lambda px: M.pair_counts(px, ["sample_id"])
    final = lambda rows: rows.groupBy("sample_id").agg(F.round(
        F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("hit_rate"))
    return M.custom_metric(X.pixels(spark, d), partial, final)


@query("u04_window_function", """WITH m AS (SELECT p_partkey AS sample_id, p_size + 20 AS h, p_size + 30 AS w FROM part),
s AS (SELECT sample_id, w, h, ay.i AS iy, ax.i AS ix FROM m, unnest(range(0, (greatest(h - 16 + 11, 0) // 12) + 1)) ay(i), unnest(range(0, (greatest(w - 16 + 11, 0) // 12) + 1)) ax(i))
SELECT DISTINCT sample_id, greatest(least(ix*12 + 16, w) - 16, 0)::INT AS x1, greatest(least(iy*12 + 16, h) - 16, 0)::INT AS y1, least(greatest(least(ix*12 + 16, w) - 16, 0) + 16, w)::INT AS x2,
  least(greatest(least(iy*12 + 16, h) - 16, 0) + 16, h)::INT AS y2 FROM s""")
def windows(spark, d):
    Q.register_tables(spark)
    meta = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), (F.col("p_size") + 20).alias("h"), (F.col("p_size") + 30).alias("w"))
    return spark.sql("SELECT sample_id, t.* FROM {meta}, LATERAL seg_windows(h, w, 16, 12) t", meta=meta)


@query("u04_rle_pixels", f"WITH {MASK} SELECT sample_id, count(*) AS n, sum(y*16 + x)::BIGINT AS checksum FROM mk WHERE v = 1 GROUP BY sample_id")
def rle_pixels(spark, d):
    Q.register_tables(spark)
    return spark.sql("SELECT sample_id, count(*) AS n, sum(t.y*16 + t.x) AS checksum FROM {r}, LATERAL seg_rle_pixels(counts, h) t GROUP BY sample_id", r=_rle(spark, d))


@query("u05_sql_functions", f"""WITH {X.PIXEL_LOGITS}, b AS (SELECT sample_id, y, x, any_value(gt) AS gt, max(v) AS mx FROM lg GROUP BY 1, 2, 3),
a AS (SELECT lg.sample_id, min(c) AS am, any_value(b.gt) AS gt FROM lg JOIN b USING (sample_id, y, x) WHERE v = mx GROUP BY lg.sample_id, y, x)
SELECT sample_id, sum(am)::BIGINT AS classes, sum(CASE WHEN gt IN (0, 255) THEN 255 ELSE gt - 1 END)::BIGINT AS reduced FROM a GROUP BY sample_id""")
def sql_functions(spark, d):
    Q.register_scalars(spark)
    return spark.sql("SELECT sample_id, sum(seg_argmax(logits)) AS classes, sum(seg_reduce_zero(gt)) AS reduced FROM {lg} GROUP BY sample_id",
                     lg=X.pixel_logits(spark, d))
