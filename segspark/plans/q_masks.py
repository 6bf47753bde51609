"""Queries for mask records."""

from pyspark.sql import functions as F

from segspark.operators import masks as M
from segspark.plans import fixtures as X
from segspark.plans.q_predict import QUERIES, SOFT, _queries
from segspark.plans.registry import query, table

MASK = X.PIXELS + ", mk AS (SELECT sample_id, y, x, (gt < 6 AND gt % 2 = 1)::INT AS v FROM px)"
RUNS = """ps AS (SELECT sample_id, x*16 + y AS pos, v FROM mk),
fl AS (SELECT *, (lag(v) OVER w IS DISTINCT FROM v)::INT AS s FROM ps WINDOW w AS (PARTITION BY sample_id ORDER BY pos)),
gr AS (SELECT *, sum(s) OVER (PARTITION BY sample_id ORDER BY pos) AS g FROM fl),
rn AS (SELECT sample_id, min(pos) AS start, count(*) AS len, any_value(v) AS label FROM gr GROUP BY sample_id, g)"""


def _mask(spark, d):
    hit = (F.col("gt") < 6) & (F.col("gt") % 2 == 1)
    return X.pixels(spark, d).select("sample_id", "y", "x", F.when(hit, 1).otherwise(0).alias("v"))


def _rle(spark, d):
    return M.encode_rle(_mask(spark, d), ["sample_id"], X.SIDE, X.SIDE)


@query("l01_runs", f"WITH {MASK}, {RUNS} SELECT sample_id, start, len, label FROM rn")
def runs(spark, d):
    # Chunks of 16 positions make runs cross borders.
    px = _mask(spark, d).select("sample_id", (F.col("x") * 16 + F.col("y")).alias("pos"), F.col("v").alias("label"))
    return M.encode_runs(px, ["sample_id"], chunk=16)


@query("l01_rle_encode", f"""WITH {MASK}, {RUNS} SELECT sample_id, 16 AS h, 16 AS w,
  CASE WHEN arg_min(label, start) = 1 THEN '0,' ELSE '' END || string_agg(len::VARCHAR, ',' ORDER BY start) AS counts FROM rn GROUP BY sample_id""")
def rle_encode(spark, d):
    return _rle(spark, d).withColumn("counts", F.array_join(F.col("counts").cast("array<string>"), ","))


@query("l02_rle_decode", f"WITH {MASK} SELECT sample_id, y, x FROM mk WHERE v = 1")
def rle_decode(spark, d):
    return M.decode_rle(_rle(spark, d), ["sample_id"])


@query("l03_area", f"WITH {MASK} SELECT sample_id, sum(v)::BIGINT AS area FROM mk GROUP BY sample_id")
def area(spark, d):
    return _rle(spark, d).select("sample_id", M.rle_area(F.col("counts")).alias("area"))


@query("l04_stability", f"""WITH {QUERIES} SELECT sample_id, q, round(count(*) FILTER (WHERE v > 1.3)::DOUBLE / nullif(count(*) FILTER (WHERE v > -0.7), 0), 6) AS stability FROM mk GROUP BY 1, 2""")
def stability(spark, d):
    out = M.stability(_queries(spark, d)[1], ["sample_id", "q"], 0.3, 1.0)
    return out.select("sample_id", "q", F.round("stability", 6).alias("stability"))


@query("l05_box", f"""WITH {X.PIXELS}, ls AS (SELECT p_partkey AS sample_id, k::INT AS class_id FROM part, range(8) t(k))
SELECT ls.sample_id, ls.class_id, coalesce(min(x), 0) AS x1, coalesce(min(y), 0) AS y1, coalesce(max(x), 0) AS x2, coalesce(max(y), 0) AS y2
FROM ls LEFT JOIN px ON px.sample_id = ls.sample_id AND px.pred = ls.class_id GROUP BY 1, 2""")
def box(spark, d):
    fg = X.pixels(spark, d).select("sample_id", F.col("pred").alias("class_id"), "y", "x")
    listed = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("class_id"))
    return M.mask_boxes(fg, listed, ["sample_id", "class_id"])


@query("l06_box_formats", f"WITH {X.BOXES} SELECT box_id, x1, y1, x2 - x1 AS w, y2 - y1 AS h, x1 + (x2 - x1) AS x2, y1 + (y2 - y1) AS y2 FROM bx")
def box_formats(spark, d):
    return M.to_xyxy(M.to_xywh(X.boxes(spark, d))).select("box_id", "x1", "y1", "w", "h", "x2", "y2")


@query("l07_uncrop", f"""WITH {X.BOXES} SELECT box_id, x1 + image_id % 50 AS x1, y1 + 7 AS y1, x2 + image_id % 50 AS x2, y2 + 7 AS y2 FROM bx""")
def uncrop(spark, d):
    return M.uncrop_boxes(X.boxes(spark, d), F.col("image_id") % 50, F.lit(7)).select("box_id", "x1", "y1", "x2", "y2")


@query("l07_uncrop_masks", f"""WITH {MASK} SELECT sample_id, (y + 3)::INT AS y, (x + sample_id % 9)::INT AS x FROM mk WHERE v = 1""")
def uncrop_masks(spark, d):
    fg = _mask(spark, d).filter("v = 1").select("sample_id", "y", "x")
    out = M.uncrop_points(fg, F.col("sample_id") % 9, F.lit(3))
    return out.select("sample_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))


@query("l08_edge_boxes", f"""WITH {X.BOXES} SELECT box_id FROM bx WHERE NOT (
  (abs(x1 - 10) <= 5 AND NOT abs(x1 - 0) <= 5) OR (abs(y1 - 10) <= 5 AND NOT abs(y1 - 0) <= 5)
  OR (abs(x2 - 100) <= 5 AND NOT abs(x2 - 150) <= 5) OR (abs(y2 - 90) <= 5 AND NOT abs(y2 - 150) <= 5))""")
def edge_boxes(spark, d):
    return X.boxes(spark, d).filter(~M.near_crop_edge((10, 10, 100, 90), (0, 0, 150, 150), 5.0)).select("box_id")


@query("l09_quality", f"""WITH {X.BOXES} SELECT box_id, round(score*10, 6) AS pred_iou, round(1 - score, 6) AS stability FROM bx WHERE score*10 > 0.35 AND 1 - score >= 0.925""")
def quality(spark, d):
    recs = X.boxes(spark, d).withColumns({"pred_iou": F.col("score") * 10, "stability": 1 - F.col("score")})
    return M.quality_filter(recs, 0.35, 0.925).select("box_id", F.round("pred_iou", 6).alias("pred_iou"), F.round("stability", 6).alias("stability"))


def _nms_sql(order, thr, source="bx", more=""):
    """Greedy suppression as a recursion over ranks, carrying the kept boxes of an image."""
    inter = ("greatest(least(k.x2, b.x2) - greatest(k.x1, b.x1), 0) * greatest(least(k.y2, b.y2) - greatest(k.y1, b.y1), 0)")
    union = f"((k.x2 - k.x1)*(k.y2 - k.y1) + (b.x2 - b.x1)*(b.y2 - b.y1) - {inter})"
    return f"""WITH RECURSIVE {X.BOXES}{more}, rk AS (SELECT image_id, {{'id': box_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS b,
  row_number() OVER (PARTITION BY image_id ORDER BY {order}) AS i FROM {source}),
r AS (SELECT image_id, i, [b] AS kept FROM rk WHERE i = 1 UNION ALL
  SELECT rk.image_id, rk.i, CASE WHEN len(list_filter(kept, lambda k: {union} > 0 AND {inter} / {union} > {thr})) > 0 THEN kept ELSE list_append(kept, b) END
  FROM r JOIN rk ON rk.image_id = r.image_id AND rk.i = r.i + 1),
f AS (SELECT image_id, unnest(arg_max(kept, i)).id AS box_id FROM r GROUP BY image_id) SELECT box_id FROM f"""


@query("l10_nms", _nms_sql("score DESC, box_id", 0.5))
def nms(spark, d):
    return M.box_nms(X.boxes(spark, d), 0.5).select("box_id")


@query("l10_nms_rounds", _nms_sql("score DESC, box_id", 0.5))
def nms_rounds(spark, d):
    return M.box_nms(X.boxes(spark, d), 0.5).select("box_id")


# One row of boxes per image, each over the threshold with the next and scored lower: every decision waits for the one before.
_CHAIN = """, ch AS (SELECT p_partkey % 2 AS image_id, p_partkey AS box_id, (p_partkey // 2 * 20)::DOUBLE AS x1, 0.0::DOUBLE AS y1,
  (p_partkey // 2 * 20 + 60)::DOUBLE AS x2, 40.0::DOUBLE AS y2, -p_partkey::DOUBLE AS score FROM part)"""


def _chain(spark, d):
    x = (F.expr("p_partkey div 2") * 20).cast("double")
    return table(spark, d, "part").select((F.col("p_partkey") % 2).alias("image_id"), F.col("p_partkey").alias("box_id"), x.alias("x1"),
                                          F.lit(0.0).alias("y1"), (x + 60).alias("x2"), F.lit(40.0).alias("y2"),
                                          (-F.col("p_partkey")).cast("double").alias("score"))


@query("l10_chain", _nms_sql("score DESC, box_id", 0.3, "ch", _CHAIN))
def nms_chain(spark, d):
    return M.box_nms(_chain(spark, d), 0.3).select("box_id")


# Every fifth box has no area, every box occurs twice.
_AWKWARD = """, aw AS (SELECT image_id, unnest([box_id, -box_id]) AS box_id, x1, y1, CASE WHEN box_id % 5 = 0 THEN x1 ELSE x2 END AS x2, y2, score FROM bx)"""


def _awkward(boxes):
    return (boxes.withColumn("x2", F.when(F.col("box_id") % 5 == 0, F.col("x1")).otherwise(F.col("x2")))
            .withColumn("box_id", F.explode(F.array("box_id", -F.col("box_id")))))


@query("l10_nms_awkward", _nms_sql("score DESC, box_id", 0.4, "aw", _AWKWARD))
def nms_awkward(spark, d):
    return M.box_nms(_awkward(X.boxes(spark, d)), 0.4).select("box_id")


@query("l10_nms_whole", _nms_sql("score DESC, box_id", 1.0, "aw", _AWKWARD))
def nms_whole(spark, d):
    return M.box_nms(_awkward(X.boxes(spark, d)), 1.0).select("box_id")


@query("l10_nms_small_crops_first", _nms_sql("box_id % 3, box_id", 0.3))
def nms_crops(spark, d):
    return M.box_nms(X.boxes(spark, d), 0.3, rank=[F.col("box_id") % 3, F.col("box_id")]).select("box_id")


def _regions_sql(value, keep):
    """Closure over horizontal runs that touch (8 neighbours), then sizes."""
    return f"""WITH RECURSIVE {MASK}, st AS (SELECT *, (lag(x) OVER w IS DISTINCT FROM x - 1)::INT AS s FROM mk WHERE v = {value} WINDOW w AS (PARTITION BY sample_id, y ORDER BY x)),
ru AS (SELECT sample_id, y, g, min(x) AS a, max(x) AS b, count(*) AS n, row_number() OVER (PARTITION BY sample_id ORDER BY y, g) AS id FROM
  (SELECT *, sum(s) OVER (PARTITION BY sample_id, y ORDER BY x) AS g FROM st) z GROUP BY sample_id, y, g),
ed AS (SELECT p.sample_id, p.id AS u, q.id AS v FROM ru p JOIN ru q ON p.sample_id = q.sample_id AND abs(p.y - q.y) = 1 AND p.a <= q.b + 1 AND q.a <= p.b + 1),
cl AS (SELECT sample_id, id AS u, id AS v FROM ru UNION SELECT cl.sample_id, cl.u, ed.v FROM cl JOIN ed ON ed.sample_id = cl.sample_id AND ed.u = cl.v),
rt AS (SELECT sample_id, u AS id, min(v) AS root FROM cl GROUP BY 1, 2),
sz AS (SELECT sample_id, root, sum(n) AS n FROM ru JOIN rt USING (sample_id, id) GROUP BY 1, 2)
{keep}"""


@query("l11_remove_islands", _regions_sql(1, """, kp AS (SELECT sample_id, sum(CASE WHEN n >= 12 THEN n END) AS big, max(n) AS most FROM sz GROUP BY 1)
SELECT p_partkey AS sample_id, coalesce(big, most, 0)::BIGINT AS area FROM part LEFT JOIN kp ON kp.sample_id = p_partkey"""))
def islands(spark, d):
    return M.remove_small_regions(_mask(spark, d), ["sample_id"], 12, "islands").groupBy("sample_id").agg(F.sum("v").alias("area"))


@query("l11_fill_holes", _regions_sql(0, """, fl AS (SELECT sample_id, sum(n) AS filled FROM sz WHERE n < 12 GROUP BY 1),
ar AS (SELECT sample_id, sum(v) AS area FROM mk GROUP BY 1)
SELECT sample_id, (area + coalesce(filled, 0))::BIGINT AS area FROM ar LEFT JOIN fl USING (sample_id)"""))
def holes(spark, d):
    return M.remove_small_regions(_mask(spark, d), ["sample_id"], 12, "holes").groupBy("sample_id").agg(F.sum("v").alias("area"))


@query("l12_records", f"""WITH {MASK}, {RUNS}, rl AS (SELECT sample_id, CASE WHEN arg_min(label, start) = 1 THEN '0,' ELSE '' END || string_agg(len::VARCHAR, ',' ORDER BY start) AS counts FROM rn GROUP BY 1),
b AS (SELECT sample_id, min(x) AS x, min(y) AS y, max(x) - min(x) AS w, max(y) - min(y) AS h, count(*) AS area FROM mk WHERE v = 1 GROUP BY 1)
SELECT p_partkey AS sample_id, '16,16' AS size, counts, coalesce(area, 0) AS area, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(w, 0) AS w, coalesce(h, 0) AS h, p_retailprice AS pred_iou
FROM part JOIN rl ON rl.sample_id = p_partkey LEFT JOIN b ON b.sample_id = p_partkey""")
def records(spark, d):
    mask = _mask(spark, d)
    listed = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"))
    boxes = M.mask_boxes(mask.filter("v = 1"), listed, ["sample_id"])
    scores = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_retailprice").alias("pred_iou"))
    recs = M.assemble_records(_rle(spark, d), boxes, scores, ["sample_id"])
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return recs.select("sample_id", join("segmentation.size").alias("size"), join("segmentation.counts").alias("counts"), "area", "bbox.*", "pred_iou")


def _match_sql(own):
    return f"""WITH {X.PIXELS}, {QUERIES}, {SOFT.format(k='sample_id, q', t='cl')},
g AS (SELECT sample_id, gt AS g, y, x FROM px WHERE gt < 4), gs AS (SELECT sample_id, g, sum(n)::BIGINT AS n FROM (SELECT sample_id, g, 1 AS n FROM g UNION ALL SELECT DISTINCT sample_id, 3, 0 FROM px) z GROUP BY 1, 2),
q AS (SELECT *, 1/(1+exp(-v)) AS p, greatest(v, 0) - v + ln(1 + exp(-abs(v))) AS pos, greatest(v, 0) + ln(1 + exp(-abs(v))) AS neg FROM mk),
qs AS (SELECT sample_id, q, sum({own}) AS ps FROM q GROUP BY 1, 2),
pr AS (SELECT q.sample_id, q.q, gs.g, any_value(gs.n) AS n, sum(CASE WHEN g.g IS NOT NULL THEN q.p ELSE 0 END) AS hit, avg(CASE WHEN g.g IS NOT NULL THEN pos ELSE neg END) AS ce
  FROM q JOIN gs ON gs.sample_id = q.sample_id LEFT JOIN g ON g.sample_id = q.sample_id AND g.g = gs.g AND g.y = q.y AND g.x = q.x GROUP BY 1, 2, 3)
SELECT pr.sample_id, pr.q, pr.g, round(-2*sm.p, 5) AS cls_cost, round(5*(1 - (2*hit + 0.001)/(ps + n + 0.001)), 5) AS dice_cost, round(5*ce, 5) AS ce_cost
FROM pr JOIN qs ON qs.sample_id = pr.sample_id AND qs.q = pr.q JOIN sm ON sm.sample_id = pr.sample_id AND sm.q = pr.q AND sm.c = pr.g"""


def _match_cost(spark, d, **how):
    cls, pred = _queries(spark, d)
    gt = X.pixels(spark, d).filter("gt < 4").select("sample_id", F.col("gt").alias("g"), "y", "x")
    # Each sample has mask 3, with or without pixels.
    whole = X.pixels(spark, d).select("sample_id", F.lit(3).alias("g"))
    labels = gt.select("sample_id", "g").unionByName(whole).distinct().withColumn("label", F.col("g"))
    out = M.match_cost(cls, pred, gt, labels, (2.0, 5.0, 5.0), **how)
    return out.select("sample_id", "q", "g", *[F.round(c, 5).alias(c) for c in ("cls_cost", "dice_cost", "ce_cost")])


@query("l13_match_cost", _match_sql("p"))
def match_cost(spark, d):
    return _match_cost(spark, d)


@query("l13_match_cost_squared", _match_sql("p*p"))
def match_cost_squared(spark, d):
    return _match_cost(spark, d, naive_dice=False)
