"""Queries for tiling, stitching and write-back."""

from pyspark.sql import functions as F

from segspark.operators import tiles as T
from segspark.plans import fixtures as X
from segspark.plans.q_convert import META, _meta
from segspark.plans.registry import query, table


@query("d01_tile_grid", f"""WITH {META}, g AS (SELECT *, ceil((w-128)/64.0)::INT AS nc0, ceil((h-128)/64.0)::INT AS nr0 FROM mt),
n AS (SELECT *, CASE WHEN nc0*64 + 128 >= w THEN nc0 ELSE nc0+1 END AS nc, CASE WHEN nr0*64 + 128 >= h THEN nr0 ELSE nr0+1 END AS nr FROM g),
b AS (SELECT sample_id, r*(nc+1) + c AS seq, least(c*128, w-128) AS x1, least(r*128, h-128) AS y1, least(c*128+128, w) AS x2,
  least(r*128+128, h) AS y2 FROM n, unnest(range(0, greatest(nr, 0)+1)) t(r), unnest(range(0, greatest(nc, 0)+1)) u(c))
SELECT sample_id, x1::INT AS x1, y1::INT AS y1, x2::INT AS x2, y2::INT AS y2, min(seq)::INT AS seq FROM b GROUP BY ALL""")
def tile_grid(spark, d):
    return T.tile_grid(_meta(spark, d), 128, 64)


@query("d02_overlap_grid", f"""WITH {META}, p AS (SELECT sample_id, CASE WHEN h < 400 AND w <> 500 THEN 400 ELSE h END AS ph,
  CASE WHEN w < 500 AND h <> 400 THEN 500 ELSE w END AS pw FROM mt)
SELECT DISTINCT sample_id, (least(x+500, pw) - 500)::INT AS x1, (least(y+400, ph) - 400)::INT AS y1, least(x+500, pw)::INT AS x2,
  least(y+400, ph)::INT AS y2 FROM p, unnest(range(0, pw, 400)) a(x), unnest(range(0, ph, 300)) b(y)""")
def overlap_grid(spark, d):
    return T.overlap_grid(_meta(spark, d), 400, 500, 100)


WINDOWS = """wg AS (SELECT sample_id, (y//{s}*ceil(w/{s}.0) + x//{s})::BIGINT AS grid_seq, xo AS x_off, yo AS y_off,
  CASE WHEN xo = 0 THEN 0 ELSE {h} END AS x_crop_off, CASE WHEN yo = 0 THEN 0 ELSE {h} END AS y_crop_off,
  CASE WHEN x + {c} >= w THEN {c} ELSE {c} - CASE WHEN xo = 0 THEN 0 ELSE {h} END END AS x_crop_size,
  CASE WHEN y + {c} >= h THEN {c} ELSE {c} - CASE WHEN yo = 0 THEN 0 ELSE {h} END END AS y_crop_size
  FROM (SELECT *, CASE WHEN x + {c} >= w THEN w - {c} ELSE x END AS xo, CASE WHEN y + {c} >= h THEN h - {c} ELSE y END AS yo
    FROM mt, unnest(range(0, h, {s})) a(y), unnest(range(0, w, {s})) b(x)) z)"""


@query("d03_window_grid", f"""WITH {META}, {WINDOWS.format(c=128, s=96, h=16)} SELECT sample_id, grid_seq, x_off::INT AS x_off, y_off::INT AS y_off,
  128 AS x_size, 128 AS y_size, x_crop_off::INT AS x_crop_off, y_crop_off::INT AS y_crop_off, x_crop_size::INT AS x_crop_size, y_crop_size::INT AS y_crop_size FROM wg""")
def window_grid(spark, d):
    return T.window_grid(_meta(spark, d), 128, 128, 96, 96)


@query("d04_tile_stats", f"""WITH {X.PIXELS} SELECT sample_id, (y//8)::INT AS tile_y, (x//8)::INT AS tile_x, count(DISTINCT gt) AS labels,
  sum(gt*((y%8)*8 + x%8))::BIGINT AS checksum FROM px GROUP BY 1, 2, 3""")
def tile_stats(spark, d):
    cut = T.cut_regular(X.pixels(spark, d), 8)
    return cut.groupBy("sample_id", "tile_y", "tile_x").agg(
        F.count_distinct("gt").alias("labels"), F.sum(F.col("gt") * (F.col("y") * 8 + F.col("x"))).alias("checksum"))


def _small(spark, d):
    return X.images(spark, d).select("sample_id", F.lit(X.SIDE).alias("h"), F.lit(X.SIDE).alias("w"))


SMALL = "mt AS (SELECT p_partkey AS sample_id, 16 AS h, 16 AS w FROM part)"


@query("d04_cut_tiles", f"""WITH {X.PIXELS}, o AS (SELECT column0 AS s FROM (VALUES (0), (4), (8)) v(column0))
SELECT sample_id, a.s AS x1, b.s AS y1, count(*) AS n, sum(gt*((y-b.s)*8 + x-a.s))::BIGINT AS checksum
FROM px, o a, o b WHERE x BETWEEN a.s AND a.s+7 AND y BETWEEN b.s AND b.s+7 GROUP BY 1, 2, 3""")
def cut_tiles(spark, d):
    cut = T.cut_tiles(X.pixels(spark, d), T.overlap_grid(_small(spark, d), 8, 8, 4), 8)
    return cut.groupBy("sample_id", "x1", "y1").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("gt") * (F.col("y") * 8 + F.col("x"))).alias("checksum"))


@query("d02_pad_patch", f"""WITH {X.PIXELS}, o AS (SELECT column0 AS s FROM (VALUES (0), (4), (8)) v(column0)),
c AS (SELECT p_partkey AS sample_id, a.s AS x1, b.s AS y1, y, x FROM part, o a, o b, range(8) t(y), range(8) u(x)),
f AS (SELECT c.*, coalesce(gt, 255) AS gt FROM c LEFT JOIN px ON px.sample_id = c.sample_id AND px.x = c.x1 + c.x AND px.y = c.y1 + c.y AND px.x < 13 AND px.y < 11)
SELECT sample_id, x1, y1, count(*) AS n, sum((gt = 255)::INT)::BIGINT AS filled, sum(gt*(y*8 + x))::BIGINT AS checksum FROM f GROUP BY 1, 2, 3""")
def pad_patch(spark, d):
    """Patches of images that end at row 11 and column 13, completed to full size."""
    grid = T.overlap_grid(_small(spark, d), 8, 8, 4)
    cut = T.cut_tiles(X.pixels(spark, d).filter("x < 13 and y < 11"), grid, 8).select("sample_id", "x1", "y1", "y", "x", "gt")
    return T.pad_patch(cut, grid, 8, 8, 255).groupBy("sample_id", "x1", "y1").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("gt") == 255).alias("filled"), F.sum(F.col("gt") * (F.col("y") * 8 + F.col("x"))).alias("checksum"))


@query("d05_last_writer", f"""WITH {X.PIXELS}, {SMALL}, {WINDOWS.format(c=8, s=6, h=1)},
b AS (SELECT px.sample_id, px.y, px.x, grid_seq, ((gt + grid_seq) % 7)::BIGINT AS pred FROM px JOIN wg ON wg.sample_id = px.sample_id
  AND px.x - x_off BETWEEN x_crop_off AND x_crop_off + x_crop_size - 1 AND px.y - y_off BETWEEN y_crop_off AND y_crop_off + y_crop_size - 1
  AND px.x - x_off < 8 AND px.y - y_off < 8)
SELECT sample_id, y, x, max_by(pred, grid_seq) AS pred FROM b GROUP BY 1, 2, 3""")
def last_writer(spark, d):
    grid = T.window_grid(_small(spark, d), 8, 8, 6, 6)
    boxes = grid.withColumns({"x1": F.col("x_off"), "y1": F.col("y_off")})
    blocks = T.cut_tiles(X.pixels(spark, d).drop("pred"), boxes, 8).withColumn("pred", (F.col("gt") + F.col("grid_seq")) % 7)
    return T.write_back(blocks)


SLIDE = "sw AS (SELECT column0 AS s FROM (VALUES (0), (5), (8)) v(column0))"


@query("d06_stitch", f"""WITH {X.PIXEL_LOGITS}, {SLIDE}, w AS (SELECT sample_id, y, x, c, v + (a.s*3 + b.s) % 7 * 0.25 AS v
  FROM lg, sw a, sw b WHERE y BETWEEN a.s AND a.s+7 AND x BETWEEN b.s AND b.s+7),
m AS (SELECT sample_id, y, x, c, avg(v) AS v, count(*) AS cover FROM w GROUP BY 1, 2, 3, 4)
SELECT sample_id, round(sum(v), 4) AS total, round(sum(v*(c+1)*(y*16+x+1)), 2) AS checksum, sum(CASE WHEN c = 0 THEN cover END)::BIGINT AS cover
FROM m GROUP BY sample_id""")
def stitch(spark, d):
    side = F.lit(X.SIDE)
    lg = X.pixel_logits(spark, d).select("sample_id", "y", "x", "logits")
    win = T.cover_slide(lg, side, side, 8, 5)
    shift = (F.col("wy") * 3 + F.col("wx")) % 7 * 0.25
    shifted = F.array(*[F.get("logits", F.lit(i)) + shift for i in range(X.CLASSES)])
    st = T.stitch_logits(win.withColumn("logits", shifted), X.CLASSES)
    at = F.col("y") * 16 + F.col("x") + 1
    total = sum((F.get("logits", F.lit(i)) for i in range(1, X.CLASSES)), F.get("logits", F.lit(0)))
    weighted = sum((F.get("logits", F.lit(i)) * (i + 1) for i in range(1, X.CLASSES)), F.get("logits", F.lit(0)))
    return st.groupBy("sample_id").agg(F.round(F.sum(total), 4).alias("total"),
                                       F.round(F.sum(weighted * at), 2).alias("checksum"), F.sum("cover").alias("cover"))


# Windows of the middle row are lost for large parts; rows 0-7 and 8-15 still cover all, so the lower ones go too.
@query("d06_coverage", """SELECT p_partkey AS sample_id, 128::BIGINT AS missing FROM part WHERE p_size > 25""")
def coverage(spark, d):
    side = F.lit(X.SIDE)
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), "p_size")
    win = T.cover_slide(X.pixels(spark, d).select("sample_id", "y", "x", "gt"), side, side, 8, 8).join(sizes, "sample_id")
    left = win.filter("p_size <= 25 or wy = 0")
    return T.uncovered(_small(spark, d), T.stitch(left, ["gt"]))


@query("d07_stitch_flip", f"""WITH {X.PIXELS}, {SLIDE}, w AS (SELECT sample_id, a.s AS wy, b.s AS wx, y, x,
   (gt + a.s + b.s)::DOUBLE AS v, (pred + a.s - b.s)::DOUBLE AS f FROM px, sw a, sw b WHERE y BETWEEN a.s AND a.s+7 AND x BETWEEN b.s AND b.s+7)
SELECT sample_id, y, x, round(avg((v + f)/2), 6) AS v FROM w GROUP BY 1, 2, 3""")
def stitch_flip(spark, d):
    side = F.lit(X.SIDE)
    win = T.cover_slide(X.pixels(spark, d), side, side, 8, 5)
    plain = win.withColumn("v", (F.col("gt") + F.col("wy") + F.col("wx")).cast("double"))
    mirror = (win.withColumn("v", (F.col("pred") + F.col("wy") - F.col("wx")).cast("double"))
              .withColumn("x", 2 * F.col("wx") + 7 - F.col("x")))
    return T.stitch_with_flip(plain, mirror, 8).withColumn("v", F.round("v", 6))


@query("d08_crop_layers", f"""WITH {META}, l AS (SELECT sample_id, h, w, k::INT AS layer, (1 << k)::INT AS n FROM mt, range(3) t(k)),
o AS (SELECT *, CASE WHEN layer = 0 THEN 0 ELSE floor(512.0::DOUBLE/1500 * least(h, w) * (2.0::DOUBLE / n)) END AS ov FROM l),
c AS (SELECT *, ceil((ov*(n-1) + w)/n::DOUBLE) AS cw, ceil((ov*(n-1) + h)/n::DOUBLE) AS ch FROM o)
SELECT sample_id, layer, ((cw-ov)*i)::INT AS x1, ((ch-ov)*j)::INT AS y1, least((cw-ov)*i + cw, w)::INT AS x2, least((ch-ov)*j + ch, h)::INT AS y2
FROM c, unnest(range(0, n)) a(i), unnest(range(0, n)) b(j)""")
def crop_layers(spark, d):
    return T.crop_layers(_meta(spark, d), 2, 512 / 1500)


@query("d09_point_grid", f"""WITH {META}, g AS (SELECT sample_id, h, w, k::INT AS layer, (8 // (1 << k))::INT AS n FROM mt, range(3) t(k))
SELECT sample_id, layer, round((2*i + 1)::DOUBLE/(2*n)*w, 6) AS px, round((2*j + 1)::DOUBLE/(2*n)*h, 6) AS py
FROM g, unnest(range(0, n)) a(i), unnest(range(0, n)) b(j)""")
def point_grid(spark, d):
    grid = T.point_grid(_meta(spark, d), 8, 2, 2)
    return grid.select("sample_id", "layer", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))
