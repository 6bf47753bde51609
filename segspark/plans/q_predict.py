"""Queries for prediction post-processing."""

from pyspark.sql import functions as F

from segspark.functions import columns as C
from segspark.operators import geometry as G, predict as H
from segspark.plans import fixtures as X
from segspark.plans.registry import query, table

SOFT = """sm AS (SELECT *, exp(v - mx) / sum(exp(v - mx)) OVER (PARTITION BY {k}) AS p FROM
  (SELECT *, max(v) OVER (PARTITION BY {k}) AS mx FROM {t}) z)"""
PX = "sample_id, y, x"


@query("h01_softmax", f"""WITH {X.VECTORS}, {SOFT.format(k='id', t='vc')} SELECT id, c, round(p, 6) AS p, round(1/(1+exp(-v)), 6) AS s FROM sm""")
def softmax(spark, d):
    rows = H.class_probabilities(X.vectors(spark, d), 10)
    return (rows.select("id", "logits", F.posexplode("probs").alias("c", "p"))
            .select("id", "c", F.round("p", 6).alias("p"), F.round(C.sigmoid(F.get("logits", F.col("c"))), 6).alias("s")))


@query("h02_argmax", f"""WITH {X.PIXEL_LOGITS} SELECT {PX}, min(c) FILTER (WHERE v = mx)::INT AS pred FROM
  (SELECT *, max(v) OVER (PARTITION BY {PX}) AS mx FROM lg) z GROUP BY {PX}""")
def argmax(spark, d):
    return H.predict_labels(X.pixel_logits(spark, d)).select("sample_id", "y", "x", "pred")


@query("h02_binary", f"""WITH {X.VECTORS} SELECT id, (1/(1+exp(-v)) > 0.3)::INT AS pred FROM vc WHERE c = 0""")
def binary(spark, d):
    one = X.vectors(spark, d).withColumn("logits", F.slice("logits", 1, 1))
    return H.predict_labels(one, 0.3).select("id", "pred")


def _views(spark, d):
    """The plain view and a mirrored one whose logits lean to the next class."""
    lg = X.pixel_logits(spark, d).select("sample_id", "y", "x", "logits")
    lean = F.array(*[F.get("logits", F.lit(i)) + (F.col("x") * 3 + F.col("sample_id") + i * 7) % 5 * 0.37 for i in range(X.CLASSES)])
    mirrored = G.flip(lg.withColumn("logits", lean), X.SIDE, X.SIDE, "horizontal")
    return lg.unionByName(G.flip(mirrored, X.SIDE, X.SIDE, "horizontal"))


VIEWS = X.PIXEL_LOGITS + """, vw AS (SELECT sample_id, y, x, c, v, 0 AS w FROM lg UNION ALL
  SELECT sample_id, y, x, c, v + ((c*7 + x*3 + sample_id) % 5)*0.37::DOUBLE, 1 FROM lg)"""
TOP = "SELECT sample_id, y, x, arg_max(c, round(s, 9) - c*1e-12)::INT AS pred FROM me GROUP BY 1, 2, 3"


@query("h03_tta_merge", f"""WITH {VIEWS}, {SOFT.format(k='sample_id, y, x, w', t='vw')}, me AS (SELECT {PX}, c, avg(p) AS s FROM sm GROUP BY {PX}, c)
SELECT sample_id, round(sum(s*s), 5) AS energy, round(sum(s*(c+1)*(y*16 + x + 1)), 3) AS checksum FROM me GROUP BY sample_id""")
def tta_merge(spark, d):
    merged = H.merge_views(_views(spark, d), X.CLASSES)
    at = F.col("y") * 16 + F.col("x") + 1
    energy = F.aggregate("score", F.lit(0.0), lambda a, v: a + v * v)
    lead = F.aggregate(F.transform("score", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return merged.groupBy("sample_id").agg(F.round(F.sum(energy), 5).alias("energy"), F.round(F.sum(lead * at), 3).alias("checksum"))


@query("h04_logit_ensemble", f"""WITH {VIEWS}, me AS (SELECT {PX}, c, round(avg(v), 9) AS s FROM vw GROUP BY {PX}, c),
tp AS (SELECT *, max(s) OVER (PARTITION BY {PX}) AS mx FROM me)
SELECT {PX}, min(c) FILTER (WHERE s = mx)::INT AS pred FROM tp GROUP BY {PX}""")
def ensemble(spark, d):
    # Means are rounded before the argmax, so that equal means tie on both sides.
    out = H.ensemble_logits(_views(spark, d), X.CLASSES)
    return out.select("sample_id", "y", "x", C.argmax(F.transform("score", lambda v: F.round(v, 9))).alias("pred"))


def _queries(spark, d):
    """Three queries per part: class logits for four classes and no-object, and dense mask logits."""
    q = X.images(spark, d).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(2))))
    logits = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: ((F.col("p_size") * 3 + F.col("q") * 11 + c * 7) % 23).cast("double") / 4)
    cls = q.select("sample_id", "q", logits.alias("logits"))
    px = X.pixels(spark, d).select("sample_id", "y", "x", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("q"))
    v = ((F.col("sample_id") * 13 + F.col("q") * 37 + F.col("y") * 5 + F.col("x") * 11) % 41 - 20).cast("double") / 5
    return cls, px.withColumn("v", v)


QUERIES = """cl AS (SELECT p_partkey AS sample_id, q::INT AS q, c::INT AS c, ((p_size*3 + q*11 + c*7) % 23)::DOUBLE/4 AS v FROM part, range(3) a(q), range(5) b(c)),
mk AS (SELECT p_partkey AS sample_id, q::INT AS q, y::INT AS y, x::INT AS x, ((p_partkey*13 + q*37 + y*5 + x*11) % 41 - 20)::DOUBLE/5 AS v
  FROM part, range(3) a(q), range(16) gy(y), range(16) gx(x))"""


@query("h05_query_masks", f"""WITH {QUERIES}, {SOFT.format(k='sample_id, q', t='cl')},
sc AS (SELECT mk.sample_id, y, x, c, sum(p / (1 + exp(-mk.v))) AS s FROM mk JOIN sm ON sm.sample_id = mk.sample_id AND sm.q = mk.q WHERE c < 4 GROUP BY 1, 2, 3, 4)
SELECT sample_id, c, round(sum(s), 4) AS total, round(sum(s*(y*16 + x + 1)), 3) AS checksum FROM sc GROUP BY 1, 2""")
def query_masks(spark, d):
    cls, masks = _queries(spark, d)
    out = H.combine_queries(cls, masks, 4).select("sample_id", "y", "x", F.posexplode("score").alias("c", "s"))
    return out.groupBy("sample_id", "c").agg(F.round(F.sum("s"), 4).alias("total"),
                                             F.round(F.sum(F.col("s") * (F.col("y") * 16 + F.col("x") + 1)), 3).alias("checksum"))


@query("h06_uncertainty", f"""WITH {X.VECTORS}, l AS (SELECT id, list_sort(list(v), 'DESC') AS s, max(CASE WHEN c = 0 THEN -abs(v) END) AS single FROM vc GROUP BY id)
SELECT id, round(s[2] - s[1], 6) AS u, round(single, 6) AS single FROM l""")
def uncertainty(spark, d):
    v = X.vectors(spark, d)
    return v.select("id", F.round(H.uncertainty(F.col("logits")), 6).alias("u"),
                    F.round(H.uncertainty(F.slice("logits", 1, 1)), 6).alias("single"))


@query("h07_uncertain_topk", f"""WITH {X.PIXEL_LOGITS}, u AS (SELECT sample_id, y*16 + x AS pos, round(s[2] - s[1], 9) AS u FROM
  (SELECT {PX}, list_sort(list(v), 'DESC') AS s FROM lg GROUP BY {PX}) z),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY u DESC, pos)::INT AS rank FROM u)
SELECT sample_id, rank, pos, round((pos % 16 + 0.5)/16, 6) AS px, round((pos // 16 + 0.5)/16, 6) AS py FROM r WHERE rank <= 12""")
def uncertain_topk(spark, d):
    # Logits are multiples of 1/50; rounding makes equal gaps equal on both sides.
    lg = X.pixel_logits(spark, d).withColumn("logits", F.transform("logits", lambda v: F.round(v * 50, 0)))
    out = H.uncertain_points(lg, 12, X.SIDE, X.SIDE)
    return out.select("sample_id", "rank", "pos", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


def _points(n, salt):
    return f"SELECT p_partkey AS sample_id, pt, {X.draw_sql(salt, 'p_partkey', 'pt')} AS px, {X.draw_sql(salt + 1, 'p_partkey', 'pt')} AS py FROM part, range(1, {n + 1}) t(pt)"


# 48 points are drawn, the 12 most uncertain stay, and 4 more come at random.
@query("h08_importance_points", f"""WITH {X.PIXEL_LOGITS}, pt AS ({_points(48, 1)}),
nb AS (SELECT sample_id, pt, (floor(py*16 - 0.5) + a.o)::INT AS y, (floor(px*16 - 0.5) + b.o)::INT AS x,
  (1 - abs(py*16 - 0.5 - floor(py*16 - 0.5) - a.o)) * (1 - abs(px*16 - 0.5 - floor(px*16 - 0.5) - b.o)) AS w FROM pt, range(2) a(o), range(2) b(o)),
lv AS (SELECT nb.sample_id, nb.pt, lg.c, sum(w*v) AS v FROM nb JOIN lg USING (sample_id, y, x) GROUP BY 1, 2, 3),
u AS (SELECT sample_id, pt, floor((s[2] - s[1])*1e9 + 0.5)/1e9 AS u FROM (SELECT sample_id, pt, list_sort(list(v), 'DESC') AS s FROM lv GROUP BY 1, 2) z),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY u DESC, pt) AS k FROM u)
SELECT sample_id, round(px, 6) AS px, round(py, 6) AS py, 'uncertain' AS kind FROM r JOIN pt USING (sample_id, pt) WHERE k <= 12
UNION ALL SELECT sample_id, round(px, 6), round(py, 6), 'random' FROM ({_points(4, 3)}) z""")
def importance(spark, d):
    out = H.importance_points(X.pixel_logits(spark, d), X.SIDE, X.SIDE, X.CLASSES, 16, draw=X.draw)
    return out.select("sample_id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), "kind")


@query("h09_repair_depth", f"""WITH {X.DEPTHS}, b AS (SELECT *, CASE WHEN y % 11 = 0 THEN 'NaN'::DOUBLE WHEN y % 13 = 0 THEN 'Infinity'::DOUBLE WHEN y % 17 = 0 THEN '-Infinity'::DOUBLE ELSE pred_depth END AS v FROM dp)
SELECT sample_id, CASE WHEN isnan(v) THEN 1 WHEN v > 80 THEN 80 WHEN v < 1 THEN 1 ELSE v END AS depth FROM b""")
def repair(spark, d):
    inf = float("inf")
    y = F.col("y")
    v = F.when(y % 11 == 0, float("nan")).when(y % 13 == 0, inf).when(y % 17 == 0, -inf).otherwise(F.col("pred_depth"))
    return X.depths(spark, d).select("sample_id", H.repair_depth(v, 1.0, 80.0).alias("depth"))


@query("h10_expected_depth", f"""WITH {X.PIXEL_LOGITS}, {SOFT.format(k=PX, t='lg')}, wd AS (SELECT p_partkey AS sample_id, b::INT AS bin, (1 + (p_size + b*3) % 7)::DOUBLE AS width FROM part, range(6) t(b)),
n AS (SELECT *, width / sum(width) OVER (PARTITION BY sample_id) * 9.5 AS nw FROM wd),
ce AS (SELECT sample_id, bin, sum(nw) OVER (PARTITION BY sample_id ORDER BY bin) + 0.5 - nw/2 AS centre FROM n),
ex AS (SELECT sm.sample_id, y, x, sum(p*centre) AS depth FROM sm JOIN ce ON ce.sample_id = sm.sample_id AND bin = c GROUP BY 1, 2, 3)
SELECT sample_id, round(sum(depth), 4) AS total, round(sum(depth*(y*16 + x + 1)), 3) AS checksum FROM ex GROUP BY 1""")
def expected_depth(spark, d):
    widths = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), "p_size", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("bin"))
    widths = widths.select("sample_id", "bin", (1 + (F.col("p_size") + F.col("bin") * 3) % 7).cast("double").alias("width"))
    rows = H.class_probabilities(X.pixel_logits(spark, d), X.CLASSES).select("sample_id", "y", "x", "probs")
    out = H.expected_depth(rows, H.bin_centres(widths, 0.5, 10.0), X.CLASSES)
    return out.groupBy("sample_id").agg(F.round(F.sum("depth"), 4).alias("total"),
                                        F.round(F.sum(F.col("depth") * (F.col("y") * 16 + F.col("x") + 1)), 3).alias("checksum"))


@query("h11_hierarchy", f"""WITH {X.VECTORS}, s AS (SELECT id, list(1/(1+exp(-v)) ORDER BY c) AS p FROM vc GROUP BY id)
SELECT id, round(greatest(p[1], p[2], p[8]), 6) AS parent0, round(greatest(p[3], p[4], p[5], p[9]), 6) AS parent1, round(greatest(p[6], p[7], p[10]), 6) AS parent2,
  round(least(p[1], p[8]), 6) AS child0, round(least(p[4], p[9]), 6) AS child3, round(least(p[7], p[10]), 6) AS child6 FROM s""")
def hierarchy(spark, d):
    rows = X.vectors(spark, d).withColumn("probs", F.transform("logits", C.sigmoid))
    out = H.hierarchy_consistent(rows, [(0, 2), (2, 5), (5, 7)], 7)
    pick = lambda c, i, n: F.round(F.get(c, F.lit(i)), 6).alias(n)
    return out.select("id", *[pick("parents", i, f"parent{i}") for i in range(3)], *[pick("children", i, f"child{i}") for i in (0, 3, 6)])
