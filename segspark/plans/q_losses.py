"""Queries for losses."""

from pyspark.sql import functions as F

from segspark.operators import losses as J
from segspark.plans import fixtures as X
from segspark.plans.q_predict import PX, SOFT
from segspark.plans.registry import query, table

# Per pixel: log-sum-exp and the target logit.
ROWS = f"""rw AS (SELECT {PX}, any_value(gt) AS gt, max(v) + ln(sum(exp(v - mx))) AS lse, max(CASE WHEN c = gt THEN v END) AS own
  FROM (SELECT *, max(v) OVER (PARTITION BY {PX}) AS mx FROM lg) z GROUP BY {PX}),
ce AS (SELECT *, CASE WHEN gt = 255 THEN 0 ELSE lse - own END AS loss FROM rw)"""
W = [0.8, 1.1, 0.9, 1.3, 1.0, 0.7]
WL = "[" + ", ".join(f"{w}::DOUBLE" for w in W) + "]"


def one(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("j01_cross_entropy", f"WITH {X.PIXEL_LOGITS}, {ROWS} SELECT round(avg(loss), 6) AS loss FROM ce")
def cross_entropy(spark, d):
    return one(J.cross_entropy(X.pixel_logits(spark, d), X.CLASSES))


@query("j01_cross_entropy_valid", f"WITH {X.PIXEL_LOGITS}, {ROWS} SELECT round(sum(loss) / count(*) FILTER (WHERE gt <> 255), 6) AS loss FROM ce")
def cross_entropy_valid(spark, d):
    return one(J.cross_entropy(X.pixel_logits(spark, d), X.CLASSES, avg_non_ignore=True))


@query("j01_cross_entropy_weighted", f"""WITH {X.PIXEL_LOGITS}, {ROWS} SELECT round(sum(loss * {WL}[gt+1]) FILTER (WHERE gt <> 255) / sum({WL}[gt+1]) FILTER (WHERE gt <> 255), 6) AS loss FROM ce""")
def cross_entropy_weighted(spark, d):
    return one(J.cross_entropy(X.pixel_logits(spark, d), X.CLASSES, class_weight=W, avg_non_ignore=True))


BCE = "greatest({x}, 0) - {x}*{t} + ln(1 + exp(-abs({x})))"


@query("j02_bce", f"""WITH {X.PIXEL_LOGITS}, b AS (SELECT gt, CASE WHEN gt = 255 THEN 0 ELSE {BCE.format(x='v', t='(c = gt)::INT')} END AS l FROM lg)
SELECT round(avg(l), 6) AS loss FROM b""")
def bce(spark, d):
    return one(J.binary_cross_entropy(X.pixel_logits(spark, d), X.CLASSES))


@query("j02_bce_pos_weight", f"""WITH {X.PIXEL_LOGITS}, b AS (SELECT (1-t)*v + (1 + ({WL}[c+1] - 1)*t)*(ln(1 + exp(-abs(v))) + greatest(-v, 0)) AS l
  FROM (SELECT *, (c = gt)::INT AS t FROM lg WHERE gt <> 255) z) SELECT round(avg(l), 6) AS loss FROM b""")
def bce_pos_weight(spark, d):
    return one(J.binary_cross_entropy(X.pixel_logits(spark, d), X.CLASSES, pos_weight=W, avg_non_ignore=True))


@query("j03_mask_ce", f"""WITH {X.PIXEL_LOGITS}, m AS (SELECT v, ((y + x) % 3 = 0)::INT AS t FROM lg WHERE c = sample_id % 6)
SELECT round(avg({BCE.format(x='v', t='t')}), 6) AS loss FROM m""")
def mask_ce(spark, d):
    rows = X.pixel_logits(spark, d).select("logits", (F.col("sample_id") % 6).cast("int").alias("label"),
                                           F.when((F.col("y") + F.col("x")) % 3 == 0, 1).otherwise(0).alias("target"))
    return one(J.mask_cross_entropy(rows))


@query("j04_reductions", f"""WITH {X.PIXEL_LOGITS}, {ROWS}, w AS (SELECT loss, 1 + (y % 3)*0.5::DOUBLE AS w FROM ce)
SELECT round(avg(loss*w), 6) AS mean_loss, round(sum(loss*w), 2) AS sum_loss, round(sum(loss*w) / (1000 + 1.1920928955078125e-07), 4) AS factor_loss FROM w""")
def reductions(spark, d):
    rows = X.pixel_logits(spark, d).withColumn("loss", J.pixel_cross_entropy(X.CLASSES)).withColumn("w", 1 + F.col("y") % 3 * 0.5)
    none = J.reduce_loss(rows, "loss", "w", "none", name="weighted")
    means = J.reduce_loss(rows, "loss", "w").select(F.round("loss", 6).alias("mean_loss")).scalar()
    factor = J.reduce_loss(rows, "loss", "w", avg_factor=1000.0).select(F.round("loss", 4).alias("factor_loss")).scalar()
    return none.agg(F.round(F.sum("weighted"), 2).alias("sum_loss")).select(means.alias("mean_loss"), "sum_loss", factor.alias("factor_loss"))


@query("j05_focal", f"""WITH {X.PIXEL_LOGITS}, s AS (SELECT gt, v, (c = gt)::INT AS t, 1/(1+exp(-v)) AS p, {WL}[c+1] AS w FROM lg),
f AS (SELECT CASE WHEN gt = 255 THEN 0 ELSE ({BCE.format(x='v', t='t')}) * (0.25*t + 0.75*(1-t)) * pow((1-p)*t + p*(1-t), 2.0) * w END AS l FROM s) SELECT round(avg(l), 6) AS loss FROM f""")
def focal(spark, d):
    return one(J.focal(X.pixel_logits(spark, d), X.CLASSES, alpha=0.25, class_weight=W))


PROB = f"""{X.PIXEL_LOGITS}, {SOFT.format(k=PX, t='lg')}"""


@query("j06_dice", f"""WITH {PROB}, s AS (SELECT sample_id, sum(p*(c = gt)::INT) AS a, sum(p*p) AS b, sum((c = gt)::INT) AS c FROM sm GROUP BY 1)
SELECT round(avg(1 - 2*a/(b + 0.001 + c + 0.001)), 6) AS loss FROM s""")
def dice(spark, d):
    return one(J.dice(X.pixel_logits(spark, d), X.CLASSES))


@query("j06_dice_naive", f"""WITH {PROB}, s AS (SELECT sample_id, sum(p*(c = gt)::INT) AS a, sum(p) AS b, sum((c = gt)::INT) AS c FROM sm WHERE c <> 0 GROUP BY 1)
SELECT round(avg(1 - (2*a + 0.001)/(b + c + 0.001)), 6) AS loss FROM s""")
def dice_naive(spark, d):
    return one(J.dice(X.pixel_logits(spark, d), X.CLASSES, naive=True, ignore_class=0))


WPX = "(1 + (y % 3)*0.5::DOUBLE)"


def _weighted(spark, d):
    return X.pixel_logits(spark, d).withColumn("w", 1 + (F.col("y") % 3) * 0.5)


def _side_by_side(total, scaled):
    """One row of two tables of one row, without a join."""
    none = F.lit(None).cast("double")
    both = total.select("total", none.alias("scaled")).unionByName(scaled.select(none.alias("total"), "scaled"))
    return both.agg(F.max("total").alias("total"), F.max("scaled").alias("scaled"))


@query("j02_bce_reductions", f"""WITH {X.PIXEL_LOGITS}, b AS (SELECT gt, CASE WHEN gt = 255 THEN 0 ELSE ({BCE.format(x='v', t='(c = gt)::INT')}) * {WPX} END AS l FROM lg)
SELECT round(sum(l) / 1e3, 4) AS total, round(sum(l) / 5000, 4) AS scaled FROM b""")
def bce_reductions(spark, d):
    px = _weighted(spark, d)
    total = J.binary_cross_entropy(px, X.CLASSES, weight="w", reduction="sum").select(F.round(F.col("loss") / 1e3, 4).alias("total"))
    scaled = J.binary_cross_entropy(px, X.CLASSES, weight="w", avg_factor=5000.0).select(F.round("loss", 4).alias("scaled"))
    return _side_by_side(total, scaled)


@query("j05_focal_reductions", f"""WITH {X.PIXEL_LOGITS}, s AS (SELECT y, gt, v, (c = gt)::INT AS t, 1/(1+exp(-v)) AS p, {WL}[c+1] AS a FROM lg),
f AS (SELECT CASE WHEN gt = 255 THEN 0 ELSE ({BCE.format(x='v', t='t')}) * (a*t + (1-a)*(1-t)) * pow((1-p)*t + p*(1-t), 1.5) * {WPX} END AS l FROM s)
SELECT round(sum(l) / 1e3, 4) AS total, round(sum(l) / 5000, 4) AS scaled FROM f""")
def focal_reductions(spark, d):
    px, how = _weighted(spark, d), {"gamma": 1.5, "alpha": W, "weight": "w"}
    total = J.focal(px, X.CLASSES, **how, reduction="sum").select(F.round(F.col("loss") / 1e3, 4).alias("total"))
    scaled = J.focal(px, X.CLASSES, **how, avg_factor=5000.0).select(F.round("loss", 4).alias("scaled"))
    return _side_by_side(total, scaled)


EMB = """em AS (SELECT vec_id, label AS gt, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings)"""


@query("j05_focal_many_classes", f"""WITH {EMB}, s AS (SELECT x, (i = gt)::INT AS t, 1/(1+exp(-x)) AS p FROM em)
SELECT round(avg(({BCE.format(x='x', t='t')}) * 0.5 * pow((1-p)*t + p*(1-t), 2.0)), 8) AS loss FROM s""")
def focal_many(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label").alias("gt"), F.col("embedding").cast("array<double>").alias("logits"))
    return one(J.focal(rows, 64), 8)


@query("j06_dice_reductions", f"""WITH {PROB}, s AS (SELECT sample_id, sum(p*(c = gt)::INT) AS a, sum(p*p) AS b, sum((c = gt)::INT) AS c FROM sm GROUP BY 1)
SELECT sample_id, round((1 - 2*a/(b + 0.001 + c + 0.001)) * (1 + (sample_id % 4)), 6) AS loss FROM s""")
def dice_reductions(spark, d):
    px = X.pixel_logits(spark, d).withColumn("w", 1.0 + F.col("sample_id") % 4)
    return one(J.dice(px, X.CLASSES, weight="w", reduction="none").select("sample_id", "loss"))


@query("j06_dice_avg_factor", f"""WITH {PROB}, s AS (SELECT sample_id, sum(p*(c = gt)::INT) AS a, sum(p) AS b, sum((c = gt)::INT) AS c FROM sm WHERE c <> 2 GROUP BY 1)
SELECT round(sum((1 - (2*a + 0.001)/(b + c + 0.001)) * (1 + (sample_id % 4))) / 100, 4) AS loss FROM s""")
def dice_avg_factor(spark, d):
    px = X.pixel_logits(spark, d).withColumn("w", 1.0 + F.col("sample_id") % 4)
    return one(J.dice(px, X.CLASSES, naive=True, ignore_class=2, weight="w", avg_factor=100.0), 4)


@query("j07_tversky", f"""WITH {PROB}, s AS (SELECT sample_id, c, sum(p*t) AS tp, sum(p*(1-t)) AS fp, sum((1-p)*t) AS fn FROM (SELECT *, (c = gt)::INT AS t FROM sm WHERE gt <> 255) z GROUP BY 1, 2),
k AS (SELECT c, avg(1 - (tp + 1)/(tp + 0.3*fp + 0.7*fn + 1)) AS l FROM s GROUP BY c)
SELECT round(sum(l * {WL}[c+1]) / 6, 6) AS loss FROM k""")
def tversky(spark, d):
    return one(J.tversky(X.pixel_logits(spark, d), X.CLASSES, class_weight=W))


LOVASZ = """er AS (SELECT {k}, abs(t - p) AS e, t FROM (SELECT *, (c = gt)::INT AS t FROM sm WHERE gt <> 255) z),
cu AS (SELECT {k}, e, sum(t) OVER (PARTITION BY {k}) AS g, count(*) OVER w AS n, sum(t) OVER w AS f, t FROM er WINDOW w AS (PARTITION BY {k} ORDER BY e DESC ROWS UNBOUNDED PRECEDING)),
st AS (SELECT {k}, e, 1 - (g - f)/(g + n - f) AS j, CASE WHEN n = 1 THEN 0 ELSE 1 - (g - (f - t))/(g + (n - 1) - (f - t)) END AS j0 FROM cu WHERE g > 0),
lo AS (SELECT {k}, sum(e*(j - j0)) AS l FROM st GROUP BY {k})"""


@query("j08_lovasz", f"WITH {PROB}, {LOVASZ.format(k='c')} SELECT round(avg(l), 5) AS loss FROM lo")
def lovasz(spark, d):
    return one(J.lovasz_softmax(X.pixel_logits(spark, d), X.CLASSES), 5)


@query("j08_lovasz_per_image", f"WITH {PROB}, {LOVASZ.format(k='sample_id, c')} SELECT round(avg(m), 5) AS loss FROM (SELECT avg(l) AS m FROM lo GROUP BY sample_id) z")
def lovasz_per_image(spark, d):
    return one(J.lovasz_softmax(X.pixel_logits(spark, d), X.CLASSES, per_image=True), 5)


@query("j08_lovasz_reductions", f"WITH {PROB}, {LOVASZ.format(k='sample_id, c')} SELECT round(sum(m) / 50, 4) AS loss FROM (SELECT avg(l) AS m FROM lo GROUP BY sample_id) z")
def lovasz_reductions(spark, d):
    return one(J.lovasz_softmax(X.pixel_logits(spark, d), X.CLASSES, per_image=True, avg_factor=50.0), 4)


@query("j09_lovasz_hinge", f"""WITH {X.PIXEL_LOGITS}, er AS (SELECT 1 - (v - 2)*(2*(gt % 2) - 1) AS e, gt % 2 AS t FROM lg WHERE c = 1 AND gt <> 255),
cu AS (SELECT e, sum(t) OVER () AS g, row_number() OVER w AS n, sum(t) OVER w AS f, t FROM er WINDOW w AS (ORDER BY e DESC ROWS UNBOUNDED PRECEDING)),
st AS (SELECT greatest(e, 0) AS e, 1 - (g - f)/(g + n - f) AS j, CASE WHEN n = 1 THEN 0 ELSE 1 - (g - (f - t))/(g + (n - 1) - (f - t)) END AS j0 FROM cu)
SELECT round(sum(e*(j - j0)), 5) AS loss FROM st""")
def lovasz_hinge(spark, d):
    rows = X.pixel_logits(spark, d).filter("gt != 255").select((F.get("logits", F.lit(1)) - 2).alias("logit"), (F.col("gt") % 2).alias("gt"))
    return one(J.lovasz_hinge(rows, ignore=None), 5)


@query("j10_silog", f"""WITH {X.DEPTHS}, s AS (SELECT sample_id, avg(dl*dl) AS q, avg(dl) AS m FROM (SELECT sample_id, ln(gt_depth) - ln(pred_depth) AS dl FROM dp) z GROUP BY 1)
SELECT round(avg(sqrt(greatest(q - 0.5*m*m, 0))), 6) AS loss FROM s""")
def silog(spark, d):
    return one(J.silog(X.depths(spark, d)))


KL = f"""{X.VECTORS}, a AS (SELECT id, c, v/2 AS v FROM vc), b AS (SELECT id, c, lead_v/2 AS v FROM (SELECT id, c, coalesce(lead(v) OVER (PARTITION BY id ORDER BY c), first_value(v) OVER (PARTITION BY id ORDER BY c)) AS lead_v FROM vc) z),
p AS (SELECT id, c, exp(v)/sum(exp(v)) OVER (PARTITION BY id) AS p FROM a), t AS (SELECT id, c, exp(v)/sum(exp(v)) OVER (PARTITION BY id) AS t FROM b)"""


def _teacher(spark, d):
    shifted = F.concat(F.slice("logits", 2, 9), F.slice("logits", 1, 1))
    return X.vectors(spark, d).select(F.col("id").alias("sample_id"), "logits", shifted.alias("target_logits"))


@query("j11_kl", f"WITH {KL} SELECT id AS sample_id, round(avg(t*(ln(t) - p)*4), 6) AS loss FROM p JOIN t USING (id, c) GROUP BY id")
def kl(spark, d):
    return one(J.kl_divergence(_teacher(spark, d), 2.0))


@query("j11_kl_textbook", f"WITH {KL} SELECT id AS sample_id, round(sum(t*(ln(t) - ln(p))*4), 6) AS loss FROM p JOIN t USING (id, c) GROUP BY id")
def kl_textbook(spark, d):
    return one(J.kl_divergence(_teacher(spark, d), 2.0, mode="kl", reduction="sum"))


@query("j12_boundary_bce", f"""WITH {X.PIXEL_LOGITS}, r AS (SELECT v - 2 AS x, CASE WHEN gt = 255 THEN 255 ELSE (gt = 0)::INT END AS t FROM lg WHERE c = 0),
n AS (SELECT count(*) FILTER (WHERE t = 1) AS p, count(*) FILTER (WHERE t = 0) AS q FROM r)
SELECT round(20 * avg(CASE t WHEN 1 THEN q::DOUBLE/(p+q) WHEN 0 THEN p::DOUBLE/(p+q) ELSE 0 END * ({BCE.format(x='x', t='t')})), 6) AS loss FROM r, n""")
def boundary_bce(spark, d):
    gt = F.when(F.col("gt") == 255, 255).when(F.col("gt") == 0, 1).otherwise(0)
    rows = X.pixel_logits(spark, d).select((F.get("logits", F.lit(0)) - 2).alias("logit"), gt.alias("gt"))
    return one(J.boundary_bce(rows, 20.0))


OHEM = f"""sc AS (SELECT {PX}, gt, floor(exp(own - lse)*1e9 + 0.5)/1e9 AS prob, floor((lse - own)*1e9 + 0.5)/1e9 AS loss FROM rw WHERE gt <> 255)"""


@query("j13_ohem", f"""WITH {X.PIXEL_LOGITS}, {ROWS}, {OHEM}, k AS (SELECT greatest(0.05, (SELECT prob FROM (SELECT prob, row_number() OVER (ORDER BY prob) - 1 AS i, count(*) OVER () AS n FROM sc) z WHERE i = least(100000, n - 1))) AS t)
SELECT round(avg(loss), 6) AS loss FROM sc, k WHERE prob < t""")
def ohem(spark, d):
    rows = J.target_scores(X.pixel_logits(spark, d), X.CLASSES, digits=9)
    return one(J.ohem_cross_entropy(rows, 0.05, 100000))


@query("j14_kth_value", f"""WITH {X.PIXEL_LOGITS}, {ROWS}, {OHEM}, o AS (SELECT prob, row_number() OVER (ORDER BY prob) - 1 AS i, count(*) OVER () AS n FROM sc)
SELECT k::BIGINT AS k, prob AS value FROM o, (SELECT unnest([0, 1000, 250000]) AS k) t WHERE i = least(k, n - 1)""")
def kth(spark, d):
    rows = J.target_scores(X.pixel_logits(spark, d), X.CLASSES, digits=9)
    found = [(k, J.kth_value(rows, "prob", k)) for k in (0, 1000, 250000)]
    return spark.createDataFrame(found, "k bigint, value double")


@query("j15_hausdorff", f"""WITH {PROB}, am AS (SELECT {PX}, any_value(gt) AS gt, min(c) FILTER (WHERE v = mx) AS a, list(p ORDER BY c) AS ps FROM sm GROUP BY {PX}),
hg AS (SELECT a.sample_id, a.y, a.x, min((a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x)) AS d FROM am a JOIN am b ON a.sample_id = b.sample_id AND b.gt = 0 AND a.gt <> 0 GROUP BY 1, 2, 3),
hs AS (SELECT a.sample_id, a.y, a.x, min((a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x)) AS d FROM am a JOIN am b ON a.sample_id = b.sample_id AND b.a = 0 AND a.a <> 0 GROUP BY 1, 2, 3),
al AS (SELECT am.*, coalesce(hg.d, 0) + coalesce(hs.d, 0) AS dtm FROM am LEFT JOIN hg USING (sample_id, y, x) LEFT JOIN hs USING (sample_id, y, x))
SELECT round((""" + " + ".join(f"avg((ps[{c+1}] - gt)*(ps[{c+1}] - gt)*dtm)" for c in range(1, 6)) + ")/6, 4) AS loss FROM al")
def hausdorff(spark, d):
    return one(J.hausdorff(X.pixel_logits(spark, d), X.CLASSES), 4)


@query("j15_hausdorff_per_class", f"""WITH {PROB}, am AS (SELECT {PX}, any_value(gt) AS gt, min(c) FILTER (WHERE v = mx) AS a, list(p ORDER BY c) AS ps FROM sm GROUP BY {PX}),
hg AS (SELECT a.sample_id, a.y, a.x, min((a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x)) AS d FROM am a JOIN am b ON a.sample_id = b.sample_id AND b.gt <> a.gt AND a.gt BETWEEN 1 AND 5 GROUP BY 1, 2, 3),
hs AS (SELECT a.sample_id, a.y, a.x, min((a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x)) AS d FROM am a JOIN am b ON a.sample_id = b.sample_id AND b.a <> a.a AND a.a BETWEEN 1 AND 5 GROUP BY 1, 2, 3),
al AS (SELECT am.*, k::INT AS k, CASE WHEN gt = k THEN coalesce(hg.d, 0) ELSE 0 END + CASE WHEN a = k THEN coalesce(hs.d, 0) ELSE 0 END AS dtm
  FROM am LEFT JOIN hg USING (sample_id, y, x) LEFT JOIN hs USING (sample_id, y, x), range(1, 6) t(k))
SELECT round(sum(l)/6, 4) AS loss FROM (SELECT avg((ps[k+1] - (gt = k)::INT)*(ps[k+1] - (gt = k)::INT)*dtm) AS l FROM al GROUP BY k) z""")
def hausdorff_per_class(spark, d):
    return one(J.hausdorff(X.pixel_logits(spark, d), X.CLASSES, mode="class"), 4)


# Images of 2,048 rows, with background in few places only.
@query("j15_tall", """WITH px AS (SELECT event_id // 32768 AS sample_id, (event_id % 2048)::INT AS y, (event_id // 2048 % 16)::INT AS x,
  CASE WHEN event_id % 397 = 5 AND event_id % 2048 < 1500 THEN 0 ELSE 1 END AS fg FROM events)
SELECT a.sample_id, a.y, a.x, min((a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x))::BIGINT AS d2 FROM px a LEFT JOIN px b ON a.sample_id = b.sample_id AND b.fg = 0 GROUP BY 1, 2, 3""")
def tall(spark, d):
    e = F.col("event_id")
    px = table(spark, d, "events").select(
        F.expr("event_id div 32768").alias("sample_id"), (e % 2048).cast("int").alias("y"), F.expr("int(event_id div 2048 % 16)").alias("x"),
        F.when((e % 397 == 5) & (e % 2048 < 1500), 0).otherwise(1).alias("fg"))
    return J.squared_distance_transform(px, block=8).select("sample_id", "y", "x", "d2")


HIER = f"""{X.VECTORS}, s AS (SELECT id, any_value(CASE WHEN gt < 7 THEN gt ELSE 255 END) AS gt, list(1/(1+exp(-v)) ORDER BY c) AS p FROM vc GROUP BY id),
g AS (SELECT *, CASE WHEN gt < 2 THEN 0 WHEN gt < 5 THEN 1 WHEN gt < 7 THEN 2 ELSE 255 END AS top FROM s),
lo AS (SELECT id, gt, i, p[i+1] AS neg, least(p[i+1], p[CASE WHEN i < 2 THEN 8 WHEN i < 5 THEN 9 ELSE 10 END]) AS pos FROM g, range(7) t(i) WHERE gt <> 255),
hi AS (SELECT id, top, k, p[k+8] AS pos, CASE k WHEN 0 THEN greatest(p[1], p[2], p[8]) WHEN 1 THEN greatest(p[3], p[4], p[5], p[9]) ELSE greatest(p[6], p[7], p[10]) END AS neg FROM g, range(3) t(k) WHERE top <> 255)"""


def _hier(spark, d):
    return X.vectors(spark, d).select("logits", F.when(F.col("gt") < 7, F.col("gt")).otherwise(255).alias("gt"))


@query("j16_hierarchical_bce", f"""WITH {HIER} SELECT round(5*((SELECT avg(CASE WHEN gt = i THEN -ln(pos + 1e-8) ELSE -ln(1 - neg + 1e-8) END) FROM lo)
  + (SELECT avg(CASE WHEN top = k THEN -ln(pos + 1e-8) ELSE -ln(1 - neg + 1e-8) END) FROM hi)), 6) AS loss""")
def hierarchical(spark, d):
    return one(J.hierarchical_bce(_hier(spark, d), [(0, 2), (2, 5), (5, 7)], 7))


@query("j16_hierarchical_focal", f"""WITH {HIER} SELECT round(5*((SELECT avg(CASE WHEN gt = i THEN -pow(1-pos, 2)*ln(pos + 1e-8) ELSE -pow(neg, 2)*ln(1 - neg + 1e-8) END) FROM lo)
  + (SELECT avg(CASE WHEN top = k THEN -pow(1-pos, 2)*ln(pos + 1e-8) ELSE -pow(neg, 2)*ln(1 - neg + 1e-8) END) FROM hi)), 6) AS loss""")
def hierarchical_focal(spark, d):
    return one(J.hierarchical_bce(_hier(spark, d), [(0, 2), (2, 5), (5, 7)], 7, gamma=2.0))


_TRIPLET = """WITH e AS (SELECT vec_id AS id, label AS gt, embedding AS f, CASE WHEN label < 3 THEN 0 WHEN label < 7 THEN 1 ELSE 2 END AS grp FROM embeddings),
u AS (SELECT k::INT AS class_id, CASE WHEN gt = k THEN 'a' WHEN grp = CASE WHEN k < 3 THEN 0 WHEN k < 7 THEN 1 ELSE 2 END THEN 'p' ELSE 'n' END AS role, id, f FROM e, range(10) t(k)),
r AS (SELECT *, row_number() OVER (PARTITION BY class_id, role ORDER BY id) AS i FROM u),
t AS (SELECT a.class_id, greatest(list_dot_product(a.f::DOUBLE[], n.f::DOUBLE[]) - list_dot_product(a.f::DOUBLE[], p.f::DOUBLE[]) + 0.6, 0) AS tl
  FROM r a JOIN r p ON p.class_id = a.class_id AND p.i = a.i AND p.role = 'p' JOIN r n ON n.class_id = a.class_id AND n.i = a.i AND n.role = 'n'
  WHERE a.role = 'a' AND a.i <= %d)
SELECT round(avg(l), 6) AS loss, count(*) AS class_count FROM (SELECT avg(tl) AS l FROM t GROUP BY class_id) z"""


def _triplet_rows(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("gt"), F.col("embedding").alias("feats"))


@query("j17_tree_triplet", _TRIPLET % 200)
def tree_triplet(spark, d):
    return one(J.tree_triplet(_triplet_rows(spark, d), [(0, 3), (3, 7), (7, 10)], 10, [F.col("id")], max_triplet=200))


@query("j17_tree_triplet_all", _TRIPLET % 2**40)
def tree_triplet_all(spark, d):
    return one(J.tree_triplet(_triplet_rows(spark, d), [(0, 3), (3, 7), (7, 10)], 10, [F.col("id")]))


@query("j18_sum_losses", f"""WITH {X.PIXEL_LOGITS}, {ROWS}, b AS (SELECT avg(CASE WHEN gt = 255 THEN 0 ELSE {BCE.format(x='v', t='(c = gt)::INT')} END) AS l FROM lg)
SELECT 'loss_aux' AS name, round((SELECT l FROM b), 6) AS loss UNION ALL SELECT 'loss_ce', round((SELECT avg(loss) FROM ce) + (SELECT l FROM b), 6)""")
def sum_losses(spark, d):
    rows = X.pixel_logits(spark, d)
    ce, bce_ = J.cross_entropy(rows, X.CLASSES), J.binary_cross_entropy(rows, X.CLASSES)
    return one(J.sum_losses([("loss_ce", ce), ("loss_ce", bce_), ("loss_aux", bce_)]))


@query("j19_presence_bce", f"""WITH {X.PIXELS}, s AS (SELECT p_partkey AS sample_id, c::INT AS c, ((p_size*3 + c*7) % 19 - 9)::DOUBLE / 3 AS x FROM part, range(6) t(c)),
h AS (SELECT DISTINCT sample_id, gt AS c FROM px WHERE gt < 6),
j AS (SELECT x, (h.c IS NOT NULL)::INT AS t FROM s LEFT JOIN h ON h.sample_id = s.sample_id AND h.c = s.c) SELECT round(avg({BCE.format(x='x', t='t')}), 6) AS loss FROM j""")
def presence(spark, d):
    logits = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda c: ((F.col("p_size") * 3 + c * 7) % 19 - 9).cast("double") / 3)
    scores = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), logits.alias("logits"))
    return one(J.presence_bce(X.pixels(spark, d), scores, X.CLASSES))
