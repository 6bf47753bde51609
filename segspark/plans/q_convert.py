"""Queries for annotation conversion and split handling."""

from pyspark.sql import functions as F

from segspark import catalog as K
from segspark.operators import convert as V, splits as P, tiles
from segspark.plans import fixtures as X
from segspark.plans.registry import query, table
from segspark.runtime import spread


def _ids(spark, d, n):
    px = X.pixels(spark, d)
    return px.select("sample_id", "y", "x", ((F.col("sample_id") * 7 + F.col("y") * 16 + F.col("x")) % n).cast("int").alias("gt"))


def _count(df, *by):
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def _ids_sql(n):
    return X.PIXELS + f", q AS (SELECT sample_id, y, x, ((sample_id*7 + y*16 + x) % {n})::INT AS gt FROM px)"


def _sql_list(values):
    return "[" + ", ".join(str(v) if not isinstance(v, tuple) else _sql_list(v) for v in values) + "]"


@query("c01_remap_stuff", f"""WITH {_ids_sql(182)}, m AS (SELECT sample_id, CASE WHEN list_contains({_sql_list(K.STUFF_GAPS)}, gt) THEN gt
  ELSE gt - len(list_filter({_sql_list(K.STUFF_GAPS)}, lambda g: g < gt)) END::INT AS gt FROM q)
SELECT sample_id, sum(gt)::BIGINT AS total, sum(gt*gt)::BIGINT AS squares FROM m GROUP BY sample_id""")
def remap_stuff(spark, d):
    out = V.remap_ids(_ids(spark, d, 182), K.dense_map(K.STUFF_IDS, K.STUFF_GAPS))
    return out.groupBy("sample_id").agg(F.sum("gt").alias("total"), F.sum(F.col("gt") * F.col("gt")).alias("squares"))


@query("c01_remap_stuff10k", f"""WITH {_ids_sql(183)}, m AS (SELECT CASE WHEN list_contains({_sql_list(K.STUFF_GAPS)}, gt-1) THEN gt
  ELSE gt - len(list_filter({_sql_list(K.STUFF_GAPS)}, lambda g: g + 1 < gt)) END::INT AS gt FROM q)
SELECT gt, count(*) AS n FROM m GROUP BY gt""")
def remap_stuff10k(spark, d):
    ids = K.dense_map(K.STUFF_IDS + 1, tuple(g + 1 for g in K.STUFF_GAPS))
    return _count(V.remap_ids(_ids(spark, d, 183), ids), "gt")


@query("c02_rank_ids", f"""WITH {_ids_sql(60)} SELECT sample_id, y, x,
  (list_position(list_sort({_sql_list(K.CONTEXT_IDS)}), {_sql_list(K.CONTEXT_IDS)}[gt+1]) - 1)::INT AS gt FROM q""")
def rank_ids(spark, d):
    px = _ids(spark, d, 60)
    ids = F.array(*[F.lit(i) for i in K.CONTEXT_IDS])
    return V.rank_ids(px.withColumn("gt", F.get(ids, F.col("gt"))), list(K.CONTEXT_IDS))


def _colours(spark, d, colours):
    """Wide pixels with colours taken in turn; the last one is not in the palette."""
    full = list(colours) + [(9, 9, 9)]
    px = _ids(spark, d, len(full))
    pick = lambda ch: F.get(F.array(*[F.lit(c[ch]) for c in full]), F.col("gt")).alias(f"c{ch}")
    return px.select("sample_id", "y", "x", pick(0), pick(1), pick(2))


def _palette(spark, d, colours):
    """Palette table whose ids come from the part sizes."""
    ids = table(spark, d, "part").select((F.col("p_size") % len(colours)).cast("int").alias("class_id")).distinct()
    pick = lambda ch, n: F.get(F.array(*[F.lit(c[ch]) for c in colours]), F.col("class_id")).alias(n)
    return ids.select("class_id", pick(0, "r"), pick(1, "g"), pick(2, "b"))


def _label_sql(colours):
    n = len(colours)
    return f"WITH {_ids_sql(n + 1)} SELECT sample_id, y, x, CASE WHEN gt = {n} THEN 0 ELSE gt END::INT AS gt FROM q"


@query("c03_colour_to_class", _label_sql(K.ISAID_PALETTE))
def colour_to_class(spark, d):
    return V.colours_to_labels(_colours(spark, d, K.ISAID_PALETTE), _palette(spark, d, K.ISAID_PALETTE))


@query("c04_weighted_code", f"""WITH {_ids_sql(8)}, pal AS (SELECT list_concat({_sql_list(K.TILE_COLOURS)}, [[9,9,9]]) AS p),
code AS (SELECT q.*, p[gt+1][1]*2 + p[gt+1][2]*3 + p[gt+1][3]*4 AS v FROM q, pal)
SELECT sample_id, y, x, (CASE v WHEN 2295 THEN 1 WHEN 510 THEN 2 WHEN 1275 THEN 3 WHEN 765 THEN 4 WHEN 1785 THEN 5 WHEN 1020 THEN 6 ELSE 0 END)::INT AS gt FROM code""")
def weighted(spark, d):
    return V.weighted_code(_colours(spark, d, K.TILE_COLOURS), K.TILE_COLOURS)


@query("c05_packed_index", _label_sql(K.ISPRS_PALETTE))
def packed(spark, d):
    return V.packed_index(_colours(spark, d, K.ISPRS_PALETTE), _palette(spark, d, K.ISPRS_PALETTE))


@query("c06_binarise", f"WITH {X.IMAGE} SELECT sample_id, c, floor(v / 128)::INT AS bit, count(*) AS n FROM im GROUP BY 1, 2, 3")
def binarise(spark, d):
    return _count(X.image(spark, d).select("sample_id", "c", V.binarise(F.col("v")).alias("bit")), "sample_id", "c", "bit")


def _mixed(spark, d):
    px = X.pixels(spark, d)
    raw = ((F.col("sample_id") * 3 + F.col("y") * 16 + F.col("x")) % 256).cast("int")
    return px.select("sample_id", "y", "x", F.when(F.col("sample_id") % 2 == 1, F.col("gt") % 2).otherwise(raw).alias("v"))


@query("c07_binarise_detect", f"""WITH {X.PIXELS}, q AS (SELECT sample_id, y, x, (CASE WHEN sample_id % 2 = 1 THEN gt % 2 ELSE (sample_id*3 + y*16 + x) % 256 END)::INT AS v FROM px),
k AS (SELECT sample_id, count(DISTINCT v) = 2 AND bool_or(v = 1) AS isb FROM q GROUP BY sample_id)
SELECT sample_id, y, x, (CASE WHEN isb THEN v WHEN v < 128 THEN 0 ELSE 1 END)::INT AS v FROM q JOIN k USING (sample_id)""")
def binarise_detect(spark, d):
    return V.binarise_unless_binary(_mixed(spark, d))


@query("c08_value_table", f"""WITH {X.PIXELS}, q AS (SELECT [0, 128, 255][pred % 3 + 1] AS v FROM px)
SELECT CASE v WHEN 0 THEN 2 WHEN 128 THEN 1 ELSE 0 END::INT AS gt, count(*) AS n FROM q GROUP BY 1""")
def value_table(spark, d):
    v = F.get(F.array(F.lit(0), F.lit(128), F.lit(255)), F.col("pred") % 3)
    return _count(V.remap_ids(X.pixels(spark, d).withColumn("gt", v), {0: 2, 128: 1}, default=0), "gt")


@query("c09_change_label", f"""WITH {X.PIXELS} SELECT sample_id, y, x, (gt % 2)::INT AS gt FROM px""")
def change_label(spark, d):
    px = X.pixels(spark, d)
    img = px.select("sample_id", "y", "x", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c"), ((F.col("gt") % 2) * 255).alias("v"))
    return V.change_label(img)


@query("c10_channel_argmax", f"""WITH {X.PIXELS}, oh AS (SELECT sample_id, y, x, c, ((sample_id + y*c + x + c*c) % 4 = 0)::INT AS v FROM px, range(6) k(c))
SELECT sample_id, y, x, coalesce((max(CASE WHEN v = 1 THEN c END) + 1) % 6, 0)::INT AS gt FROM oh GROUP BY 1, 2, 3""")
def channel_argmax(spark, d):
    px = X.pixels(spark, d).select("sample_id", "y", "x", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("c"))
    c = F.col("c")
    v = F.when((F.col("sample_id") + F.col("y") * c + F.col("x") + c * c) % 4 == 0, 1).otherwise(0)
    return V.channels_to_labels(px.withColumn("v", v), 6)


@query("c11_instances", f"""WITH {X.PIXELS}, q AS (SELECT sample_id, y, x, y//4*4 + x//4 AS inst FROM px),
ty AS (SELECT p_partkey AS sample_id, i::INT AS inst, ((p_partkey + i) % 7 + 1)::INT AS class_id FROM part, range(1, 16) t(i))
SELECT sample_id, y, x, coalesce(class_id, 0)::INT AS gt FROM q LEFT JOIN ty USING (sample_id, inst)""")
def instances(spark, d):
    px = X.pixels(spark, d).select("sample_id", "y", "x", F.expr("cast(y div 4 * 4 + x div 4 as int)").alias("inst"))
    types = (X.images(spark, d).select("sample_id", F.explode(F.sequence(F.lit(1), F.lit(15))).alias("inst"))
             .withColumn("class_id", ((F.col("sample_id") + F.col("inst")) % 7 + 1).cast("int")))
    return V.instances_to_labels(px, types)


@query("c12_rle_decode", """WITH r AS (SELECT p_partkey AS sample_id, p_size AS s FROM part WHERE p_size % 5 <> 0),
runs AS (SELECT sample_id, s AS a, s + 3 + s AS b, s + 3 + s + 4 + 7 AS c FROM r),
px AS (SELECT sample_id, p FROM runs, range(256) t(p) WHERE p >= a AND p < a+3 OR p >= b AND p < b+4 OR p >= c AND p < c+1)
SELECT sample_id, (p % 16)::INT AS y, (p // 16)::INT AS x FROM px""")
def rle_decode(spark, d):
    rle = F.when(F.col("p_size") % 5 == 0, "-1").otherwise(F.format_string("%d 3 %d 4 7 1", "p_size", "p_size"))
    recs = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.lit(16).alias("h"), F.lit(16).alias("w"), rle.alias("rle"))
    return V.decode_relative_rle(spread(recs, "sample_id"))


@query("c13_slices", f"""WITH {X.VOLUME} SELECT 'case' || format('{{:04d}}', sample_id) || '_slice' || format('{{:03d}}', z) AS name,
  sum(v * (y*8 + x + 1)) AS checksum, sum(gt)::BIGINT AS marked FROM vx GROUP BY 1""")
def slices(spark, d):
    px = V.slice_volume(X.volume(spark, d), id_width=4)
    return px.groupBy("name").agg(F.sum(F.col("v") * (F.col("y") * 8 + F.col("x") + 1)).alias("checksum"), F.sum("gt").alias("marked"))


@query("c14_intensity_window", f"""WITH {X.VOLUME} SELECT sample_id, z, y, 7 - x AS x, round((least(greatest(v*10 - 200, -125), 275) + 125) / 400 * 255, 6) AS v FROM vx""")
def intensity(spark, d):
    vox = X.volume(spark, d).select("sample_id", "z", "y", "x", F.round(V.intensity_window(F.col("v") * 10 - 200), 6).alias("v"))
    return V.mirror_x(vox, 8)


@query("c15_label_whitelist", f"""WITH {_ids_sql(14)} SELECT sample_id, y, x, CASE gt WHEN 8 THEN 1 WHEN 4 THEN 2 WHEN 3 THEN 3 WHEN 2 THEN 4
  WHEN 6 THEN 5 WHEN 11 THEN 6 WHEN 1 THEN 7 WHEN 7 THEN 8 ELSE 0 END::INT AS gt FROM q""")
def whitelist(spark, d):
    return V.remap_ids(_ids(spark, d, 14), K.ORGAN_LABELS, default=0)


@query("c16_min_max", f"""WITH {X.IMAGE}, e AS (SELECT sample_id, min(v) AS lo, max(v) AS hi FROM im GROUP BY 1),
s AS (SELECT sample_id, c, round_even((v - lo) / (hi - lo) * 255, 0)::INT AS v FROM im JOIN e USING (sample_id))
SELECT sample_id, c, sum(v)::BIGINT AS total, sum(v*v)::BIGINT AS squares FROM s GROUP BY 1, 2""")
def min_max(spark, d):
    out = V.min_max_to_uint8(X.image(spark, d))
    return out.groupBy("sample_id", "c").agg(F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"))


# --- split handling ---------------------------------------------------------

def _names(df, col="doc_id"):
    return df.select(F.col(col).cast("string").alias("name"))


def _lists(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return _names(docs.filter("lang = 'en'")), _names(labels.filter("quality = 1")), _names(labels.filter("toxic = 1"))


LISTS = """tr AS (SELECT doc_id::VARCHAR AS name FROM documents WHERE lang = 'en'),
ex AS (SELECT doc_id::VARCHAR AS name FROM labels WHERE quality = 1), va AS (SELECT doc_id::VARCHAR AS name FROM labels WHERE toxic = 1)"""


@query("c17_merged_list", f"WITH {LISTS} (SELECT name FROM tr UNION SELECT name FROM ex) EXCEPT SELECT name FROM va")
def merged(spark, d):
    return P.merged_list(*_lists(spark, d))


@query("c17_split_diff", f"WITH {LISTS} SELECT name FROM ex EXCEPT (SELECT name FROM tr UNION SELECT name FROM va)")
def split_diff(spark, d):
    return P.extra_only(*_lists(spark, d))


@query("c18_expected_count", """SELECT count(*) AS found, 1000::BIGINT AS expected, count(*) = 1000 AS ok FROM documents""")
def expected(spark, d):
    return P.expect_count(table(spark, d, "documents"), 1000)


@query("c19_listed_split", """SELECT doc_id, source AS key, CASE WHEN regexp_matches(source, '[02468]$') THEN 'train' ELSE 'val' END AS split FROM documents""")
def listed(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("key"))
    ids = docs.select("key").distinct().filter(F.col("key").rlike("[02468]$")).withColumn("split", F.lit("train"))
    return P.split_by_list(docs, ids).select("doc_id", "key", "split")


@query("c20_first_n", """WITH n AS (SELECT source, lpad(doc_id::VARCHAR, 12, '0') AS name FROM documents)
SELECT source, name, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY name) <= 20 THEN 'train' ELSE 'val' END AS split FROM n""")
def first_n(spark, d):
    docs = table(spark, d, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"))
    return P.first_n_by_name(docs, 20)


def _meta(spark, d):
    part = spread(table(spark, d, "part"), "p_partkey")
    return part.select(F.col("p_partkey").alias("sample_id"), (F.col("p_size") * 13 + 100).alias("h"), (F.col("p_size") * 17 + 120).alias("w"))


META = "mt AS (SELECT p_partkey AS sample_id, p_size*13 + 100 AS h, p_size*17 + 120 AS w FROM part)"


@query("c21_every_third", f"""WITH {META}, g AS (SELECT sample_id, h, w, ceil((w-128)/64.0)::INT AS nc0, ceil((h-128)/64.0)::INT AS nr0 FROM mt),
n AS (SELECT *, CASE WHEN nc0*64 + 128 >= w THEN nc0 ELSE nc0+1 END AS nc, CASE WHEN nr0*64 + 128 >= h THEN nr0 ELSE nr0+1 END AS nr FROM g)
SELECT split, count(*) AS n FROM (SELECT CASE WHEN (r*(nc+1) + c) % 3 = 0 THEN 'val' ELSE 'train' END AS split
  FROM n, unnest(range(0, nr+1)) t(r), unnest(range(0, nc+1)) u(c)) z GROUP BY split""")
def every_third(spark, d):
    return _count(P.every_third_to_val(tiles.tile_grid(_meta(spark, d), 128, 64, unique=False)), "split")


@query("c22_random_split", f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {X.draw_sql(0, 'doc_id')}, doc_id) AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k <= ceil(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM r""")
def random_split(spark, d):
    return P.random_split(table(spark, d, "documents").select("doc_id"), key="doc_id", draw=X.draw)


@query("c23_folds", """SELECT 'fold1_' || format('{:06d}', doc_id) AS name FROM documents UNION ALL
SELECT 'fold2_' || format('{:06d}', page_id) FROM pages UNION ALL SELECT 'fold3_' || format('{:06d}', vec_id) FROM embeddings""")
def folds(spark, d):
    part = lambda t, c: table(spark, d, t).select(F.col(c).alias("i"))
    return P.concat_folds([part("documents", "doc_id"), part("pages", "page_id"), part("embeddings", "vec_id")], 6).select("name")


@query("c24_pairing", """SELECT coalesce(a.doc_id, b.page_id)::VARCHAR AS stem, a.doc_id || '.png' AS img, b.page_id || '_mask.png' AS mask,
  CASE WHEN a.doc_id IS NULL THEN 'orphan' WHEN b.page_id IS NULL THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id FROM labels) a FULL JOIN pages b ON a.doc_id = b.page_id""")
def pairing(spark, d):
    img = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("stem"), F.concat("doc_id", F.lit(".png")).alias("img"))
    mask = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("stem"), F.concat("page_id", F.lit("_mask.png")).alias("mask"))
    return P.pair_by_stem(img, mask)


@query("c25_fill_missing_masks", f"""WITH {X.PIXELS}, k AS (SELECT px.* FROM px JOIN part ON p_partkey = sample_id WHERE p_type = 'ECONOMY'),
f AS (SELECT sample_id, y, x, gt FROM k UNION ALL SELECT sample_id, y, x, 0 FROM px WHERE sample_id NOT IN (SELECT sample_id FROM k))
SELECT sample_id, count(*) AS n, sum(gt*(y*16+x+1))::BIGINT AS checksum FROM f GROUP BY sample_id""")
def fill_masks(spark, d):
    kept = table(spark, d, "part").filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("sample_id"))
    masks = X.pixels(spark, d).join(kept, "sample_id", "left_semi")
    samples = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"))
    out = P.fill_missing_masks(samples, masks, X.SIDE, X.SIDE)
    return out.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("gt") * (F.col("y") * 16 + F.col("x") + 1)).alias("checksum"))


@query("c26_pair_lines", """SELECT 'bath/' || doc_id || '.jpg' AS img_path, 'bath/' || doc_id || '.png' AS seg_map_path FROM documents""")
def pair_lines(spark, d):
    lines = table(spark, d, "documents").select(F.format_string("bath/rgb/%d.jpg  bath/sync_depth/%d.png 518.8579", "doc_id", "doc_id").alias("value"))
    return P.read_pairs(lines, "rgb/", "sync_depth/")


@query("c27_select_listed", "SELECT doc_id::VARCHAR AS name FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def select_listed(spark, d):
    return P.select_listed(_names(table(spark, d, "documents")), _names(table(spark, d, "labels").filter("quality = 1")))


@query("c28_first_existing", """SELECT d.doc_id::VARCHAR AS stem, d.doc_id || CASE WHEN quality = 1 THEN '_a.png' ELSE '.png' END AS path
FROM documents d JOIN labels USING (doc_id)""")
def first_existing(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("stem"))
    lab = table(spark, d, "labels")
    listing = (lab.select(F.concat("doc_id", F.lit(".png")).alias("path"))
               .union(lab.filter("quality = 1").select(F.concat("doc_id", F.lit("_a.png")))))
    return P.first_existing(docs, listing, [".tif", "_a.png", ".png"])


@query("c29_regroup_members", """WITH m AS (SELECT *, CASE WHEN lang = 'en' THEN 'Train' WHEN lang = 'fr' THEN 'Val' ELSE 'Test' END AS s,
  CASE WHEN doc_id % 2 = 0 THEN 'images_png' ELSE 'masks_png' END AS k FROM documents)
SELECT s || '/Rural/' || k || '/' || doc_id || '.png' AS path,
  CASE k WHEN 'images_png' THEN 'img_dir' ELSE 'ann_dir' END || '/' || lower(s) || '/' || doc_id || '.png' AS target
FROM m WHERE NOT (s = 'Test' AND k = 'masks_png')""")
def regroup(spark, d):
    s = F.when(F.col("lang") == "en", "Train").when(F.col("lang") == "fr", "Val").otherwise("Test")
    k = F.when(F.col("doc_id") % 2 == 0, "images_png").otherwise("masks_png")
    members = table(spark, d, "documents").select(F.concat(s, F.lit("/Rural/"), k, F.lit("/"), "doc_id", F.lit(".png")).alias("path"))
    return P.regroup_members(members)


@query("c30_stack_rows", """SELECT vec_id || '_' || format('{:08d}', i) AS name, round(list_sum([z::DOUBLE for z in embedding[i*16+1:i*16+16]]), 6) AS total
FROM embeddings, range(4) t(i)""")
def stack_rows(spark, d):
    e = F.col("embedding").cast("array<double>")
    stacks = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("container"),
                                                  F.array(*[F.slice(e, i * 16 + 1, 16) for i in range(4)]).alias("images"))
    rows = V.stack_to_rows(stacks)
    return rows.select("name", F.round(F.aggregate("data", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("c31_rank_pairing", """WITH a AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS img, row_number() OVER (ORDER BY doc_id) AS position FROM documents),
b AS (SELECT url AS mask, row_number() OVER (ORDER BY url, page_id) AS position FROM pages)
SELECT position, img, mask FROM a FULL JOIN b USING (position)""")
def rank_pairing(spark, d):
    img = table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("img"))
    mask = table(spark, d, "pages").select(F.col("url").alias("mask"), "page_id")
    return P.pair_by_position(img, mask, F.col("img"), F.struct("mask", "page_id")).select("position", "img", "mask")


@query("c32_missing", "SELECT doc_id || '.png' AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing(spark, d):
    path = lambda t: table(spark, d, t).select(F.concat("doc_id", F.lit(".png")).alias("path"))
    return P.missing_files(path("documents"), path("labels"))
