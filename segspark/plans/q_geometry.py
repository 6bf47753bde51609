"""Queries for geometry on label and image tables."""

from pyspark.sql import functions as F

from segspark.operators import geometry as G, labels as L
from segspark.plans import fixtures as X
from segspark.plans.registry import query, table

S = X.SIDE


def _part(spark, d, **cols):
    base = X.images(spark, d).withColumns({"h": F.lit(S), "w": F.lit(S)})
    return base.select("sample_id", "h", "w", *[F.expr(e).alias(n) for n, e in cols.items()])


def digest(df, value="gt", key="sample_id"):
    """Per-sample size and position-weighted checksum of every pixel."""
    at = F.col("y") * 64 + F.col("x") + 1
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("bigint")).alias("total"),
                               F.sum(F.col(value).cast("bigint") * at).alias("checksum"))


def digest_sql(src, value="gt", key="sample_id"):
    return (f"SELECT {key}, count(*) AS n, sum({value})::BIGINT AS total, sum({value}*(y*64 + x + 1))::BIGINT AS checksum "
            f"FROM {src} GROUP BY {key}")


CROP = "bxs AS (SELECT p_partkey AS sample_id, p_size % 7 AS x1, p_size % 5 AS y1, p_size % 7 + 9 AS x2, p_size % 5 + 10 AS y2 FROM part)"


@query("e01_crop", f"""WITH {X.PIXELS}, {CROP} SELECT px.sample_id, (y - y1)::INT AS y, (x - x1)::INT AS x, gt FROM px JOIN bxs USING (sample_id)
WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2""")
def crop(spark, d):
    boxes = _part(spark, d, x1="p_size % 7", y1="p_size % 5", x2="p_size % 7 + 9", y2="p_size % 5 + 10")
    return G.crop(X.pixels(spark, d).drop("pred"), boxes)


@query("e02_crop_choice", f"""WITH {X.PIXELS}, cand AS (SELECT p_partkey AS sample_id, t::INT AS try_no, ((p_size + t*5) % 12)::INT AS x1, ((p_size*3 + t*7) % 12)::INT AS y1
  FROM part, range(11) k(t)),
cnt AS (SELECT c.sample_id, try_no, gt, count(*) AS n FROM cand c JOIN px USING (sample_id) WHERE try_no < 10 AND gt <> 255
  AND x >= x1 AND x < x1 + 5 AND y >= y1 AND y < y1 + 5 GROUP BY 1, 2, 3),
ok AS (SELECT sample_id, try_no FROM cnt GROUP BY 1, 2 HAVING count(*) > 1 AND max(n)::DOUBLE / sum(n) < 0.45),
pick AS (SELECT sample_id, min(try_no) AS p FROM ok GROUP BY 1)
SELECT c.sample_id, c.try_no, x1, y1, x1 + 5 AS x2, y1 + 5 AS y2 FROM cand c LEFT JOIN pick USING (sample_id) WHERE c.try_no = coalesce(p, 10)""")
def crop_choice(spark, d):
    cand = _part(spark, d, p_size="p_size").withColumn("try_no", F.explode(F.sequence(F.lit(0), F.lit(10))))
    cand = cand.select("sample_id", "try_no", F.expr("(p_size + try_no*5) % 12").alias("x1"), F.expr("(p_size*3 + try_no*7) % 12").alias("y1"))
    cand = cand.withColumns({"x2": F.col("x1") + 5, "y2": F.col("y1") + 5})
    return G.choose_crop(X.pixels(spark, d), cand, 0.45)


@query("e03_flip", f"""WITH {X.PIXELS}, f AS (SELECT sample_id, gt, sample_id % 4 AS k, x, y FROM px)
SELECT sample_id, (CASE WHEN k IN (1, 3) THEN 15 - y ELSE y END)::INT AS y, (CASE WHEN k IN (2, 3) THEN 15 - x ELSE x END)::INT AS x, gt FROM f""")
def flip(spark, d):
    names = F.array(F.lit("none"), F.lit("vertical"), F.lit("horizontal"), F.lit("diagonal"))
    return G.flip(X.pixels(spark, d).drop("pred"), S, S, F.get(names, (F.col("sample_id") % 4).cast("int")))


@query("e03_flip_boxes", f"""WITH {X.BOXES} SELECT box_id, 200 - x2 AS x1, 200 - y2 AS y1, 200 - x1 AS x2, 200 - y1 AS y2 FROM bx""")
def flip_boxes(spark, d):
    return G.flip_boxes(X.boxes(spark, d), 200, 200, "diagonal").select("box_id", "x1", "y1", "x2", "y2")


@query("e04_rotate", f"""WITH {X.PIXELS}, g AS (SELECT p_partkey AS sample_id, y::INT AS y, x::INT AS x, radians((p_size % 40) - 20 + 0.37::DOUBLE) AS a
  FROM part, range(16) gy(y), range(16) gx(x)),
s AS (SELECT sample_id, y, x, floor(round(cos(a)*(x-7.5::DOUBLE) + sin(a)*(y-7.5::DOUBLE) + 7.5, 9) + 0.5)::INT AS sx,
  floor(round(cos(a)*(y-7.5::DOUBLE) - sin(a)*(x-7.5::DOUBLE) + 7.5, 9) + 0.5)::INT AS sy FROM g),
o AS (SELECT s.sample_id, s.y, s.x, coalesce(gt, 255) AS gt FROM s LEFT JOIN px ON px.sample_id = s.sample_id AND px.y = sy AND px.x = sx)
{digest_sql('o')}""")
def rotate(spark, d):
    params = _part(spark, d, angle="(p_size % 40) - 20 + 0.37D")
    return digest(G.rotate(X.pixels(spark, d), params, {"gt": 255}))


@query("e05_rot90_flip", f"""WITH {X.PIXELS}, r AS (SELECT sample_id, gt, (p_size % 2) AS axis,
  CASE p_size % 4 WHEN 1 THEN 15 - x WHEN 2 THEN 15 - y WHEN 3 THEN x ELSE y END AS y1,
  CASE p_size % 4 WHEN 1 THEN y WHEN 2 THEN 15 - x WHEN 3 THEN 15 - y ELSE x END AS x1 FROM px JOIN part ON p_partkey = sample_id),
o AS (SELECT sample_id, gt, CASE WHEN axis = 0 THEN 15 - y1 ELSE y1 END AS y, CASE WHEN axis = 1 THEN 15 - x1 ELSE x1 END AS x FROM r) {digest_sql('o')}""")
def rot90(spark, d):
    return digest(G.rot90_flip(X.pixels(spark, d), _part(spark, d, k="p_size % 4", axis="p_size % 2")))


def _resize_sql(nh, nw, extra=""):
    return f"""WITH {X.PIXELS}, z AS (SELECT p_partkey AS sample_id, {nh} AS nh, {nw} AS nw FROM part),
o AS (SELECT z.sample_id, ty::INT AS y, tx::INT AS x, gt FROM z, unnest(range(0, nh)) a(ty), unnest(range(0, nw)) b(tx), px
  WHERE px.sample_id = z.sample_id AND px.y = (ty*16)//nh AND px.x = (tx*16)//nw) {digest_sql('o')}"""


@query("e06_resize_nearest", _resize_sql("10 + p_size % 13", "9 + p_size % 17"))
def resize(spark, d):
    px = L.join_on_sample(X.pixels(spark, d).drop("pred"), _part(spark, d, nh="10 + p_size % 13", nw="9 + p_size % 17"))
    return digest(G.resize_nearest(px, F.col("h"), F.col("w"), F.col("nh"), F.col("nw")))


def _bilinear_sql(n, scale):
    return f"""WITH {X.IMAGE}, t AS (SELECT k::INT AS t, {scale} AS s FROM range({n}) u(k)),
ax AS (SELECT t, floor(s)::INT AS i0, least(floor(s)::INT + 1, 15) AS i1, s - floor(s) AS f FROM t),
o AS (SELECT im.sample_id, ay.t AS y, ax.t AS x, c, sum(v * ((CASE WHEN im.y = ay.i0 THEN 1-ay.f ELSE 0 END) + (CASE WHEN im.y = ay.i1 THEN ay.f ELSE 0 END))
   * ((CASE WHEN im.x = ax.i0 THEN 1-ax.f ELSE 0 END) + (CASE WHEN im.x = ax.i1 THEN ax.f ELSE 0 END))) AS v
  FROM im JOIN ax ay ON im.y IN (ay.i0, ay.i1) JOIN ax ON im.x IN (ax.i0, ax.i1) GROUP BY 1, 2, 3, 4)
SELECT sample_id, c, count(*) AS n, round(sum(v), 4) AS total, round(sum(v*(y*64 + x + 1)), 2) AS checksum FROM o GROUP BY 1, 2"""


def _bilinear(spark, d, n, align):
    im = X.image(spark, d)
    out = G.resize_bilinear(im, F.lit(S), F.lit(S), F.lit(n), F.lit(n), by=["c"], align_corners=align)
    return out.groupBy("sample_id", "c").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"),
                                             F.round(F.sum(F.col("v") * (F.col("y") * 64 + F.col("x") + 1)), 2).alias("checksum"))


@query("e07_resize_bilinear", _bilinear_sql(11, "least(greatest((k + 0.5::DOUBLE)*16/11 - 0.5::DOUBLE, 0), 15)"))
def bilinear(spark, d):
    return _bilinear(spark, d, 11, False)


@query("e07_resize_aligned", _bilinear_sql(11, "k::DOUBLE * 15 / 10"))
def bilinear_aligned(spark, d):
    return _bilinear(spark, d, 11, True)


@query("e08_resize_multiple", _resize_sql("32", "32"))
def resize_multiple(spark, d):
    up = lambda n: G.multiple_of(F.lit(n), 32)
    return digest(G.resize_nearest(X.pixels(spark, d).drop("pred"), F.lit(S), F.lit(S), up(S), up(S)))


SHAPES = "mt AS (SELECT p_partkey AS sample_id, p_size*13 + 100 AS h, p_size*17 + 120 AS w FROM part)"


def _shapes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), (F.col("p_size") * 13 + 100).alias("h"), (F.col("p_size") * 17 + 120).alias("w"))


@query("e09_shortest_edge", f"""WITH {SHAPES}, a AS (SELECT *, 512::DOUBLE/least(h, w) AS s FROM mt),
b AS (SELECT *, CASE WHEN h < w THEN 512::DOUBLE ELSE s*h END AS nh, CASE WHEN h < w THEN s*w ELSE 512::DOUBLE END AS nw FROM a),
c AS (SELECT *, CASE WHEN greatest(nh, nw) > 640 THEN 640::DOUBLE/greatest(nh, nw) ELSE 1 END AS k FROM b)
SELECT sample_id, floor(nh*k + 0.5)::INT AS new_h, floor(nw*k + 0.5)::INT AS new_w FROM c""")
def shortest_edge(spark, d):
    nh, nw = G.shortest_edge_shape(F.col("h"), F.col("w"), 512, 640)
    return _shapes(spark, d).select("sample_id", nh.alias("new_h"), nw.alias("new_w"))


@query("e10_label_rescale", _resize_sql("8", "8"))
def rescale(spark, d):
    nh, nw = G.factor_shape(F.lit(S), F.lit(S), 0.5)
    return digest(G.resize_nearest(X.pixels(spark, d).drop("pred"), F.lit(S), F.lit(S), nh, nw))


_SIDE = f"floor(16*(0.5 + {X.draw_sql(0, 'p_partkey')}*1.5) + 0.5)::INT"


@query("e11_random_resize", _resize_sql(_SIDE, _SIDE))
def random_resize(spark, d):
    nh, nw = G.factor_shape(F.lit(S), F.lit(S), G.random_ratio(7, draw=X.draw))
    return digest(G.resize_nearest(X.pixels(spark, d).drop("pred"), F.lit(S), F.lit(S), nh, nw))


@query("e12_pad_batch", f"""WITH {X.PIXELS}, m AS (SELECT p_partkey AS sample_id, p_partkey // 4 AS b, 16 - p_size % 9 AS h, 16 - p_size % 7 AS w FROM part),
t AS (SELECT sample_id, h, w, (ceil(max(h) OVER (PARTITION BY b)/5.0)*5)::INT AS ph, (ceil(max(w) OVER (PARTITION BY b)/5.0)*5)::INT AS pw FROM m),
o AS (SELECT t.sample_id, y, x, coalesce(gt, 255) AS gt FROM t, unnest(range(0, ph)) a(y), unnest(range(0, pw)) b(x)
  LEFT JOIN (SELECT sample_id AS s, y AS py, x AS pxx, gt FROM px) q ON s = t.sample_id AND py = y AND pxx = x AND y < h AND x < w) {digest_sql('o')}""")
def pad_batch(spark, d):
    meta = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.expr("p_partkey div 4").alias("batch"),
                                          (16 - F.col("p_size") % 9).alias("h"), (16 - F.col("p_size") % 7).alias("w"))
    px = L.join_on_sample(X.pixels(spark, d).drop("pred"), meta.drop("batch")).filter("y < h and x < w").drop("h", "w")
    return digest(G.pad(px, G.batch_shapes(meta, divisor=5), {"gt": 255}))


@query("e12_pad_size", f"""WITH {X.PIXELS}, o AS (SELECT s.sample_id, y, x, coalesce(gt, 7) AS gt FROM
  (SELECT p_partkey AS sample_id, y, x FROM part, range(20) a(y), range(23) b(x)) s LEFT JOIN px USING (sample_id, y, x)) {digest_sql('o')}""")
def pad_size(spark, d):
    return digest(G.pad(X.pixels(spark, d), G.batch_shapes(_part(spark, d), size=(20, 23)), {"gt": 7}))


@query("e13_mosaic", f"""WITH {X.PIXELS}, nn AS (SELECT count(*) AS n FROM part), pr AS (SELECT p_partkey AS mosaic_id, 8 + p_size % 17 AS cx, 6 + p_size % 19 AS cy,
  p_partkey AS s0, (p_partkey*3 + 1) % n AS s1, (p_partkey*7 + 2) % n AS s2, (p_partkey*11 + 3) % n AS s3 FROM part, nn),
cv AS (SELECT mosaic_id, y, x, CASE WHEN x < cx AND y < cy AND x >= cx-16 AND y >= cy-16 THEN s0 WHEN x >= cx AND y < cy AND x < cx+16 AND y >= cy-16 THEN s1
   WHEN x < cx AND y >= cy AND x >= cx-16 AND y < cy+16 THEN s2 WHEN x >= cx AND y >= cy AND x < cx+16 AND y < cy+16 THEN s3 END AS sid,
  CASE WHEN x < cx THEN x - cx + 16 ELSE x - cx END AS sx, CASE WHEN y < cy THEN y - cy + 16 ELSE y - cy END AS sy
  FROM pr, range(32) a(y), range(32) b(x)),
o AS (SELECT mosaic_id, cv.y, cv.x, coalesce(gt, 255) AS gt FROM cv LEFT JOIN px ON px.sample_id = sid AND px.y = sy AND px.x = sx)
{digest_sql('o', key='mosaic_id')}""")
def mosaic(spark, d):
    part = table(spark, d, "part")
    n = part.agg(F.count(F.lit(1)).alias("n")).scalar()
    k = F.col("p_partkey")
    params = part.select(k.alias("mosaic_id"), (8 + F.col("p_size") % 17).alias("center_x"), (6 + F.col("p_size") % 19).alias("center_y"),
                         k.alias("top_left"), ((k * 3 + 1) % n).alias("top_right"), ((k * 7 + 2) % n).alias("bottom_left"),
                         ((k * 11 + 3) % n).alias("bottom_right"))
    return digest(G.mosaic(X.pixels(spark, d), _part(spark, d), params, (16, 16), {"gt": 255}), key="mosaic_id")


@query("e14_mix_partners", f"""WITH n AS (SELECT p_partkey AS sample_id, row_number() OVER (ORDER BY p_partkey) AS idx, count(*) OVER () AS n FROM part),
q AS (SELECT sample_id, k::INT AS k, (floor({X.draw_sql(0, 'sample_id', 'k')}*n) + 1)::BIGINT AS idx FROM n, range(1, 4) t(k))
SELECT q.sample_id, k, n.sample_id AS partner_id FROM q JOIN n USING (idx)""")
def mix_partners(spark, d):
    return G.mix_partners(_part(spark, d).select("sample_id"), 3, draw=X.draw)


@query("e15_cut_out", f"""WITH {X.PIXELS}, hl AS (SELECT p_partkey AS sample_id, (p_size + k*5) % 16 AS x1, (p_size*3 + k*7) % 16 AS y1 FROM part, range(2) t(k)),
o AS (SELECT sample_id, y, x, CASE WHEN EXISTS (SELECT 1 FROM hl WHERE hl.sample_id = px.sample_id AND px.x >= x1 AND px.x < least(x1+4, 16) AND px.y >= y1 AND px.y < least(y1+3, 16))
  THEN 254 ELSE gt END AS gt FROM px) {digest_sql('o')}""")
def cut_out(spark, d):
    holes = _part(spark, d, p_size="p_size").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(1))))
    holes = holes.select("sample_id", F.expr("(p_size + k*5) % 16").alias("x1"), F.expr("(p_size*3 + k*7) % 16").alias("y1"))
    holes = holes.withColumns({"x2": F.least(F.col("x1") + 4, F.lit(S)), "y2": F.least(F.col("y1") + 3, F.lit(S))})
    return digest(G.cut_out(X.pixels(spark, d), holes, {"gt": 254}))


@query("e16_concat_channels", f"""WITH {X.IMAGE}, o AS (SELECT sample_id, y, x, c, v FROM im UNION ALL SELECT sample_id, y, x, c + 3, 255 - v FROM im)
SELECT sample_id, c, count(*) AS n, sum(v) AS total FROM o GROUP BY 1, 2""")
def concat_channels(spark, d):
    im = X.image(spark, d)
    out = G.concat_channels(im, im.withColumn("v", 255 - F.col("v")), 3)
    return out.groupBy("sample_id", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("e17_depth_mix", f"""WITH {X.IMAGE}, p AS (SELECT p_partkey AS sample_id, p_size % 11 AS l, 1 + p_size % 6 AS wd FROM part),
o AS (SELECT im.sample_id, y, x, c, CASE WHEN x >= l AND x < l + wd THEN (y*16 + x)::DOUBLE / 10 ELSE v END AS v FROM im JOIN p USING (sample_id))
SELECT sample_id, c, count(*) AS n, round(sum(v), 4) AS total FROM o GROUP BY 1, 2""")
def depth_mix(spark, d):
    depth = X.pixels(spark, d).select("sample_id", "y", "x", ((F.col("y") * 16 + F.col("x")).cast("double") / 10).alias("v"))
    params = _part(spark, d, left="p_size % 11", width="1 + p_size % 6")
    out = G.depth_mix(X.image(spark, d), depth, params, 3)
    return out.groupBy("sample_id", "c").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


# Neighbours by shifted copies.
EDGE = """nb AS (SELECT sample_id, y+1 AS y, x, gt AS g FROM px UNION ALL SELECT sample_id, y, x-1, gt FROM px
  UNION ALL SELECT sample_id, y-1, x-1, gt FROM px UNION ALL SELECT sample_id, y-1, x+1, gt FROM px),
ed AS (SELECT px.sample_id, px.y, px.x, coalesce(max((gt <> 255 AND g <> 255 AND gt <> g)::INT), 0) AS e FROM px LEFT JOIN nb USING (sample_id, y, x) GROUP BY 1, 2, 3)"""


@query("e18_edges", f"""WITH {X.PIXELS}, {EDGE}, dl AS (SELECT DISTINCT sample_id, y + a.o AS y, x + b.o AS x FROM ed, (SELECT unnest([-1,0,1]) AS o) a, (SELECT unnest([-1,0,1]) AS o) b WHERE e = 1),
o AS (SELECT px.sample_id, px.y, px.x, (dl.y IS NOT NULL)::INT AS gt FROM px LEFT JOIN dl ON dl.sample_id = px.sample_id AND dl.y = px.y AND dl.x = px.x) {digest_sql('o')}""")
def edges(spark, d):
    return digest(G.edge_map(X.pixels(spark, d).drop("pred"), 3), "edge")


@query("e19_boundary_pyramid", f"""WITH {X.PIXELS}, nb AS (SELECT sample_id, y + a.o AS y, x + b.o AS x, sum(gt) AS s FROM px, (SELECT unnest([-1,0,1]) AS o) a, (SELECT unnest([-1,0,1]) AS o) b GROUP BY 1, 2, 3),
r AS (SELECT px.sample_id, px.y, px.x, (9*gt - s > 0)::INT AS b FROM px JOIN nb USING (sample_id, y, x)),
o AS (SELECT a.sample_id, a.y, a.x, (6*a.b + 3*c.b + e.b > 1)::INT AS gt FROM r a JOIN r c ON c.sample_id = a.sample_id AND c.y = a.y//2*2 AND c.x = a.x//2*2
  JOIN r e ON e.sample_id = a.sample_id AND e.y = a.y//4*4 AND e.x = a.x//4*4) {digest_sql('o')}""")
def pyramid(spark, d):
    return digest(G.boundary_pyramid(X.pixels(spark, d).drop("pred"), F.lit(S), F.lit(S)), "boundary")


@query("e20_unpad", f"""WITH {X.PIXELS}, o AS (SELECT sample_id, y-1 AS y, x-2 AS x, gt FROM px WHERE x BETWEEN 2 AND 12 AND y BETWEEN 1 AND 11) {digest_sql('o')}""")
def unpad(spark, d):
    return digest(G.unpad(X.pixels(spark, d), S, S, (2, 3, 1, 4)))


@query("e21_multi_view", f"""WITH {X.PIXELS}, vw AS (SELECT (i*2 + f)::INT AS view, [8, 16, 24][i+1] AS n, f FROM range(3) a(i), range(2) b(f)),
o AS (SELECT px.sample_id, view, ty::INT AS y, CASE WHEN f = 1 THEN n-1-tx ELSE tx END::INT AS x, gt FROM vw, unnest(range(0, n)) a(ty), unnest(range(0, n)) b(tx), px
  WHERE px.y = (ty*16)//n AND px.x = (tx*16)//n)
SELECT sample_id, view, count(*) AS n, sum(gt*(y*64 + x + 1))::BIGINT AS checksum FROM o GROUP BY 1, 2""")
def multi_view(spark, d):
    views = G.multi_view(X.pixels(spark, d).drop("pred"), F.lit(S), F.lit(S), [0.5, 1.0, 1.5], [False, True])
    return views.groupBy("sample_id", "view").agg(F.count(F.lit(1)).alias("n"),
                                                  F.sum(F.col("gt") * (F.col("y") * 64 + F.col("x") + 1)).alias("checksum"))


@query("e22_longest_side", f"""WITH {X.BOXES}, m AS (SELECT *, floor(300*(1024::DOUBLE/300) + 0.5) AS nw, floor(200*(1024::DOUBLE/300) + 0.5) AS nh FROM bx)
SELECT box_id, nh::INT AS new_h, nw::INT AS new_w, round(x1*nw/300, 4) AS x1, round(y1*nh/200, 4) AS y1, round(x2*nw/300, 4) AS x2, round(y2*nh/200, 4) AS y2 FROM m""")
def longest_side(spark, d):
    nh, nw = G.longest_side_shape(F.lit(200), F.lit(300), 1024)
    out = G.scale_points(X.boxes(spark, d), ["x1", "x2"], ["y1", "y2"], F.lit(200), F.lit(300), nh, nw)
    return out.select("box_id", nh.alias("new_h"), nw.alias("new_w"), *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")])
