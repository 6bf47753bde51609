"""Queries for evaluation metrics."""

from pyspark.sql import functions as F

from segspark.operators import masks, metrics as M
from segspark.plans import fixtures as X
from segspark.plans.registry import query

AREAS = X.PIXELS + """, ok AS (SELECT * FROM px WHERE gt <> 255),
cls AS (SELECT c::INT AS class_id FROM range(6) k(c)),
ar AS (SELECT class_id,
   (SELECT count(*) FROM ok WHERE gt = class_id AND pred = class_id) AS inter,
   (SELECT count(*) FROM ok WHERE pred = class_id) AS pred_area,
   (SELECT count(*) FROM ok WHERE gt = class_id) AS label_area FROM cls)"""


@query("i01_image_areas", f"""WITH {X.PIXELS}
SELECT s.sample_id, c.class_id,
  count(CASE WHEN gt = class_id AND pred = class_id THEN 1 END) AS inter,
  count(CASE WHEN pred = class_id THEN 1 END) AS pred_area,
  count(CASE WHEN gt = class_id THEN 1 END) AS label_area,
  count(CASE WHEN gt = class_id OR pred = class_id THEN 1 END) AS union_area
FROM px s, (SELECT k::INT AS class_id FROM range(6) t(k)) c WHERE gt <> 255 GROUP BY s.sample_id, c.class_id""")
def image_areas(spark, d):
    return M.image_areas(X.pixels(spark, d), X.CLASSES)


@query("i02_total_areas", f"""WITH {AREAS}
SELECT class_id, inter, pred_area, label_area, pred_area + label_area - inter AS union_area FROM ar""")
def total_areas(spark, d):
    return M.total_areas(M.image_areas(X.pixels(spark, d), X.CLASSES))


@query("i03_overall_accuracy", f"WITH {AREAS} SELECT round(sum(inter)::DOUBLE / sum(label_area), 6) AS a_acc FROM ar")
def overall(spark, d):
    return M.overall_accuracy(M.dataset_areas(X.pixels(spark, d), X.CLASSES)).select(F.round("a_acc", 6).alias("a_acc"))


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in df.columns if c not in keys])


@query("i04_class_iou", f"""WITH {AREAS} SELECT class_id,
  round(inter::DOUBLE / nullif(pred_area + label_area - inter, 0), 6) AS iou,
  round(inter::DOUBLE / nullif(label_area, 0), 6) AS acc FROM ar""")
def class_iou(spark, d):
    return _rounded(M.class_metrics(M.dataset_areas(X.pixels(spark, d), X.CLASSES)), "class_id")


@query("i05_dice", f"""WITH {AREAS} SELECT class_id,
  round(2.0 * inter::DOUBLE / nullif(pred_area + label_area, 0), 6) AS dice,
  round(inter::DOUBLE / nullif(label_area, 0), 6) AS acc FROM ar""")
def dice(spark, d):
    return _rounded(M.class_metrics(M.dataset_areas(X.pixels(spark, d), X.CLASSES), "mDice"), "class_id")


@query("i06_fscore", f"""WITH {AREAS}, pr AS (SELECT class_id, inter::DOUBLE / nullif(pred_area, 0) AS p,
  inter::DOUBLE / nullif(label_area, 0) AS r FROM ar)
SELECT class_id, round(5.0 * p * r / nullif(4.0 * p + r, 0), 6) AS fscore, round(p, 6) AS precision,
  round(r, 6) AS recall FROM pr""")
def fscore(spark, d):
    return _rounded(M.class_metrics(M.dataset_areas(X.pixels(spark, d), X.CLASSES), "mFscore", beta=2.0), "class_id")


# Ten classes are asked for, so four never occur and 0/0 is replaced before the mean.
@query("i07_nan_to_num", f"""WITH {X.PIXELS}, ok AS (SELECT * FROM px WHERE gt <> 255),
cls AS (SELECT c::INT AS class_id FROM range(10) k(c)),
m AS (SELECT class_id, (SELECT count(*) FROM ok WHERE gt = class_id AND pred = class_id)::DOUBLE
   / nullif((SELECT count(*) FROM ok WHERE gt = class_id OR pred = class_id), 0) AS iou FROM cls)
SELECT round_even(avg(iou) * 100, 2) AS plain_miou, round_even(avg(coalesce(iou, -1)) * 100, 2) AS filled_miou FROM m""")
def nan_to_num(spark, d):
    area = M.dataset_areas(X.pixels(spark, d), 10)
    plain = M.class_metrics(area).withColumnRenamed("iou", "p")
    filled = M.class_metrics(area, nan_to_num=-1)
    return plain.join(filled, "class_id").agg(F.bround(F.avg("p") * 100, 2).alias("plain_miou"),
                                              F.bround(F.avg("iou") * 100, 2).alias("filled_miou"))


@query("i08_metric_selection", f"""WITH {AREAS}
SELECT 'mDice' AS metric, round_even(avg(2.0*inter/nullif(pred_area+label_area,0))*100, 2) AS mean_value FROM ar
UNION ALL SELECT 'mFscore', round_even(avg(2.0*inter/nullif(pred_area+label_area,0))*100, 2) FROM ar
UNION ALL SELECT 'mIoU', round_even(avg(inter::DOUBLE/nullif(pred_area+label_area-inter,0))*100, 2) FROM ar""")
def metric_selection(spark, d):
    area = M.dataset_areas(X.pixels(spark, d), X.CLASSES)
    main = {"mIoU": "iou", "mDice": "dice", "mFscore": "fscore"}
    per_class = None
    for m, c in main.items():
        part = M.class_metrics(area, m).select("class_id", F.col(c).alias(m))
        per_class = part if per_class is None else per_class.join(part, "class_id")
    means = per_class.agg(*[F.bround(F.avg(m) * 100, 2).alias(m) for m in main])
    return means.unpivot([], list(main), "metric", "mean_value")


@query("i09_summary", f"""WITH {AREAS}, m AS (SELECT class_id, inter::DOUBLE / nullif(pred_area+label_area-inter, 0) AS iou,
  inter::DOUBLE / nullif(label_area, 0) AS acc FROM ar)
SELECT class_id, round_even(avg(iou)*100, 2) AS iou, round_even(avg(acc)*100, 2) AS acc FROM m
GROUP BY GROUPING SETS ((class_id), ())""")
def class_table(spark, d):
    return M.class_table(M.dataset_areas(X.pixels(spark, d), X.CLASSES))


CONF = X.PIXELS + """, cf AS (SELECT g::INT AS gt, p::INT AS pred, coalesce(n, 0) AS n
  FROM range(6) a(g) CROSS JOIN range(6) b(p) LEFT JOIN
    (SELECT gt, pred, count(*) AS n FROM px WHERE gt <> 255 GROUP BY gt, pred) t ON t.gt = g AND t.pred = p)"""


@query("i10_confusion", f"WITH {CONF} SELECT gt, pred, n FROM cf")
def confusion(spark, d):
    return M.confusion(X.pixels(spark, d), X.CLASSES)


@query("i11_confusion_pct", f"""WITH {CONF} SELECT gt, pred, n,
  round(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY gt), 0) * 100, 6) AS pct FROM cf""")
def confusion_pct(spark, d):
    return _rounded(M.confusion_percent(M.confusion(X.pixels(spark, d), X.CLASSES)), "gt", "pred", "n")


@query("i12_category_iou", f"""WITH {X.PIXELS}, f AS (SELECT gt//2 AS g, CASE WHEN pred < 6 THEN pred//2 END AS p FROM px WHERE gt <> 255),
cat AS (SELECT c::INT AS class_id FROM range(3) k(c))
SELECT class_id,
  round((SELECT count(*) FROM f WHERE g = class_id AND p = class_id)::DOUBLE /
    nullif((SELECT count(*) FROM f WHERE g = class_id OR p = class_id), 0), 6) AS iou,
  round((SELECT count(*) FROM f WHERE g = class_id AND p = class_id)::DOUBLE /
    nullif((SELECT count(*) FROM f WHERE g = class_id), 0), 6) AS acc FROM cat""")
def category_iou(spark, d):
    fold = {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2}
    return _rounded(M.category_metrics(X.pixels(spark, d), fold, 3), "class_id")


DEPTH = """, dm AS (SELECT sample_id, greatest(gt_depth/pred_depth, pred_depth/gt_depth) AS r, pred_depth - gt_depth AS e,
  gt_depth AS g, ln(pred_depth) - ln(gt_depth) AS dl FROM dp {where}),
di AS (SELECT sample_id, avg((r < 1.25)::INT) AS d1, avg((r < 1.5625)::INT) AS d2, avg((r < 1.953125)::INT) AS d3,
  avg(abs(e)/g) AS abs_rel, avg(e*e/g) AS sq_rel, sqrt(avg(e*e)) AS rmse, sqrt(avg(dl*dl)) AS rmse_log,
  avg(abs(dl))/2.302585092994046 AS log10, sqrt(greatest(avg(dl*dl) - 0.5*avg(dl)*avg(dl), 0)) AS silog
  FROM dm GROUP BY sample_id)"""
DEPTH_COLS = ", ".join(f"round({c}, 5) AS {c}" for c in M.DEPTH_METRICS)


def _depth_rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 5).alias(c) for c in M.DEPTH_METRICS])


@query("i13_depth_per_image", f"WITH {X.DEPTHS}{DEPTH.format(where='')} SELECT sample_id, {DEPTH_COLS} FROM di")
def depth_per_image(spark, d):
    return _depth_rounded(M.depth_per_image(X.depths(spark, d)), "sample_id")


@query("i14_depth_mask", f"""WITH {X.DEPTHS}{DEPTH.format(where='''WHERE gt_depth > 1 AND gt_depth < 80
  AND y BETWEEN 45 AND 470 AND x BETWEEN 41 AND 600''')} SELECT sample_id, {DEPTH_COLS} FROM di""")
def depth_masked(spark, d):
    return _depth_rounded(M.depth_per_image(X.depths(spark, d), min_depth=1.0, max_depth=80.0, crop="nyu_crop"), "sample_id")


@query("i15_depth_dataset", f"WITH {X.DEPTHS}{DEPTH.format(where='')} SELECT "
       + ", ".join(f"round(avg({c}), 5) AS {c}" for c in M.DEPTH_METRICS) + " FROM di")
def depth_dataset(spark, d):
    return _depth_rounded(M.depth_dataset(M.depth_per_image(X.depths(spark, d))))


TOPK = """, rk AS (SELECT o.{key}, {extra} count(CASE WHEN l.v > o.v OR (l.v = o.v AND l.c < o.c) THEN 1 END) AS better, any_value(o.v) AS own
  FROM (SELECT * FROM {t} WHERE c = gt) o JOIN {t} l ON {on} GROUP BY o.{key}{group})"""


@query("i16_topk_accuracy", f"""WITH {X.VECTORS}{TOPK.format(key='id', extra='', t='vc', on='l.id = o.id', group='')}
SELECT """ + ", ".join(f"round(100.0*(count(CASE WHEN better < {k} AND own > 0.1 THEN 1 END) + 1.1920928955078125e-07)"
                       f"/(count(*) + 1.1920928955078125e-07), 5) AS acc_{k}" for k in (1, 3, 5)) + " FROM rk")
def topk(spark, d):
    acc = M.topk_accuracy(X.vectors(spark, d), (1, 3, 5), thresh=0.1)
    return acc.select(*[F.round(c, 5).alias(c) for c in acc.columns])


@query("i17_accuracy_per_step", f"""WITH {X.PIXEL_LOGITS}, best AS (
  SELECT sample_id % 50 AS step, y, x, sample_id, any_value(gt) AS gt, max_by(c, v - c * 1e-9) AS top FROM lg WHERE gt <> 255
  GROUP BY sample_id, y, x)
SELECT step, round(100.0*(count(CASE WHEN gt = top THEN 1 END) + 1.1920928955078125e-07)
  /(count(*) + 1.1920928955078125e-07), 5) AS acc_1 FROM best GROUP BY step""")
def accuracy_per_step(spark, d):
    rows = X.pixel_logits(spark, d).withColumn("step", F.col("sample_id") % 50)
    return M.topk_accuracy(rows, (1,), ignore=255, by=["step"]).select("step", F.round("acc_1", 5).alias("acc_1"))


@query("i18_confusion_runs", f"""WITH {X.PIXELS} SELECT gt, pred, count(*) AS n FROM px WHERE gt <> 255 GROUP BY gt, pred""")
def confusion_runs(spark, d):
    px = X.pixels(spark, d).withColumn("pos", F.col("y") * X.SIDE + F.col("x"))
    runs = lambda c: masks.encode_runs(px.select("sample_id", "pos", F.col(c).alias("label")), ["sample_id"])
    return M.confusion_from_runs(runs("gt"), runs("pred"))
