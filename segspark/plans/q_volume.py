"""Queries for volumetric work."""

from pyspark.sql import functions as F

from segspark.operators import volume as G
from segspark.plans import fixtures as X
from segspark.plans.registry import query, table


def vdigest(df, digits=3):
    at = F.col("z") * 400 + F.col("y") * 20 + F.col("x") + 1
    return df.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("v") * at), digits).alias("checksum"),
                                       F.sum(F.col("gt") * at).alias("labels"))


def vdigest_sql(src, digits=3):
    return (f"SELECT sample_id, count(*) AS n, round(sum(v*(z*400 + y*20 + x + 1)), {digits}) AS checksum, "
            f"sum(gt*(z*400 + y*20 + x + 1))::BIGINT AS labels FROM {src} GROUP BY 1")


def _shapes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), *[F.lit(8).alias(c) for c in "dhw"])


@query("g01_crop_foreground", f"""WITH {X.VOLUME}, f AS (SELECT *, (z*31 + y*17 + x*13 + sample_id) % 101 AS vk, (sample_id + gt) % 2 AS ck FROM vx WHERE gt > 0),
pc AS (SELECT sample_id, gt, z, y, x, ck FROM f QUALIFY row_number() OVER (PARTITION BY sample_id, gt ORDER BY vk, z, y, x) = 1),
pk AS (SELECT * FROM pc QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ck, gt) = 1),
m AS (SELECT p_partkey AS sample_id, coalesce(least(greatest(z-2, 0), 4), 4) AS mz, coalesce(least(greatest(y-2, 0), 4), 4) AS my,
  coalesce(least(greatest(x-2, 0), 4), 4) AS mx FROM part LEFT JOIN pk ON pk.sample_id = p_partkey),
s AS (SELECT sample_id, floor((sample_id % 7)/7.0::DOUBLE*(mz+1))::INT AS z1, floor((sample_id % 5)/5.0::DOUBLE*(my+1))::INT AS y1, floor((sample_id % 3)/3.0::DOUBLE*(mx+1))::INT AS x1 FROM m),
o AS (SELECT vx.sample_id, z-z1 AS z, y-y1 AS y, x-x1 AS x, v, gt FROM vx JOIN s USING (sample_id) WHERE z BETWEEN z1 AND z1+3 AND y BETWEEN y1 AND y1+3 AND x BETWEEN x1 AND x1+3)
{vdigest_sql('o')}""")
def crop_foreground(spark, d):
    vox = X.volume(spark, d)
    key = (F.col("z") * 31 + F.col("y") * 17 + F.col("x") * 13 + F.col("sample_id")) % 101
    picked = G.pick_foreground(vox, key, (F.col("sample_id") + F.col("gt")) % 2)
    draws = tuple((F.col("sample_id") % k) / float(k) for k in (7, 5, 3))
    return vdigest(G.crop(vox, G.foreground_boxes(_shapes(spark, d), picked, (4, 4, 4), draws)))


_KEYS = ("sample_id", "c", "z", "y", "x")


@query("g02_noise", f"""WITH {X.VOLUME}, o AS (SELECT sample_id, z, y, x, gt, CASE WHEN {X.draw_sql(3, 'sample_id')} < 0.5 THEN
  v + sqrt(-2*ln(greatest({X.draw_sql(1, *_KEYS)}, 1e-12)))*cos(2*pi()*{X.draw_sql(2, *_KEYS)})*0.5 ELSE v END AS v FROM vx) {vdigest_sql('o')}""")
def noise(spark, d):
    return vdigest(G.gaussian_noise(X.volume(spark, d), 0.0, 0.5, 0.5, draw=X.draw))


def _blur_axis(src, out, axis):
    k = f"kernel AS (SELECT k, exp(-0.5*k*k) / (SELECT sum(exp(-0.5*j*j)) FROM range(-4, 5) t(j)) AS wt FROM range(-4, 5) u(k))"
    cols = ", ".join(a if a != axis else f"{axis}2 AS {axis}" for a in "zyx")
    group = ", ".join(a if a != axis else f"{axis}2" for a in "zyx")
    return k, f"""{out} AS (SELECT sample_id, {cols}, sum(v*wt) AS v FROM
  (SELECT sample_id, {", ".join(a for a in "zyx" if a != axis)}, t AS {axis}2, v, wt FROM {src} JOIN
    (SELECT t, wt, CASE WHEN t + k < 0 THEN -1 - (t + k) WHEN t + k > 7 THEN 15 - (t + k) ELSE t + k END AS src FROM range(8) a(t), kernel) q ON q.src = {axis}) z
  GROUP BY sample_id, {group})"""


_K, _Z = _blur_axis("vx", "bz", "z")
_, _Y = _blur_axis("bz", "by_", "y")
_, _X = _blur_axis("by_", "bx_", "x")


@query("g03_blur", f"""WITH {X.VOLUME}, {_K}, {_Z}, {_Y}, {_X}, o AS (SELECT bx_.*, gt FROM bx_ JOIN vx USING (sample_id, z, y, x)) {vdigest_sql('o', 2)}""")
def blur(spark, d):
    return vdigest(G.gaussian_blur(X.volume(spark, d), (8, 8, 8), (1.0, 1.0, 1.0)), 2)


@query("g04_gamma", f"""WITH {X.VOLUME}, n AS (SELECT sample_id, z, y, x, gt, -v AS v, 0.7::DOUBLE + (sample_id % 8)/10.0::DOUBLE AS g FROM vx),
s AS (SELECT sample_id, min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_pop(v) AS sd FROM n GROUP BY 1),
c AS (SELECT n.*, m, sd, pow((v-lo)/(hi-lo+1e-7), g)*(hi-lo) + lo AS w FROM n JOIN s USING (sample_id)),
s2 AS (SELECT sample_id, avg(w) AS m2, stddev_pop(w) AS sd2 FROM c GROUP BY 1),
o AS (SELECT sample_id, z, y, x, gt, -((w-m2)/(sd2+1e-8)*sd + m) AS v FROM c JOIN s2 USING (sample_id)) {vdigest_sql('o', 1)}""")
def gamma(spark, d):
    g = 0.7 + (F.col("sample_id") % 8) / 10.0
    return vdigest(G.adjust_gamma(X.volume(spark, d), g, invert=True, retain_stats=True), 1)


@query("g05_pad_centre", f"""WITH {X.VOLUME}, o AS (SELECT g.sample_id, g.z, g.y, g.x, coalesce(v, -1) AS v, coalesce(gt, 7) AS gt FROM
  (SELECT p_partkey AS sample_id, z, y, x FROM part, range(11) a(z), range(8) b(y), range(10) e(x)) g
  LEFT JOIN vx ON vx.sample_id = g.sample_id AND vx.z = g.z - 1 AND vx.y = g.y AND vx.x = g.x - 1) {vdigest_sql('o')}""")
def pad_centre(spark, d):
    return vdigest(G.pad_centre(X.volume(spark, d), _shapes(spark, d), (11, 6, 10), -1.0, 7))


@query("g06_flip", f"""WITH {X.VOLUME}, o AS (SELECT sample_id, CASE WHEN sample_id % 2 = 0 THEN 7-z ELSE z END AS z, y, CASE WHEN sample_id % 3 = 0 THEN 7-x ELSE x END AS x, v,
  CASE gt WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE gt END AS gt FROM vx) {vdigest_sql('o')}""")
def flip(spark, d):
    k = F.col("sample_id")
    return vdigest(G.flip(X.volume(spark, d), (8, 8, 8), (k % 2 == 0, F.lit(False), k % 3 == 0), [(1, 2)]))


@query("g07_transpose", f"WITH {X.VOLUME}, o AS (SELECT sample_id, x AS z, y, z AS x, v, gt FROM vx) {vdigest_sql('o')}")
def transpose(spark, d):
    return vdigest(G.transpose_axes(X.volume(spark, d)))
