"""Queries for sample indexes, raster sources and sinks."""

from pyspark.sql import functions as F

from segspark.plans import fixtures as X
from segspark.plans.registry import query, table
from segspark.runtime import new_scratch_path, spread
from segspark.sources import rasters as R, samples as S


@query("a01_scan_samples")
def scan(spark, d):
    return S.scan_samples(spark, d, ".parquet", "/ann", ".png")


def _lines(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("  "), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(" \t")).alias("value"))


@query("a02_split_file", """SELECT 'img/' || source || '/' || doc_id || '.jpg' AS img_path,
  'ann/' || source || '/' || doc_id || '.png' AS seg_map_path FROM documents""")
def split_file(spark, d):
    return S.samples_from_split(_lines(spark, d), "img", "ann")


@query("a03_change_pairs", """WITH t AS (SELECT source || '/' || doc_id AS n, CASE WHEN doc_id % 3 = 0 THEN '.tif' ELSE '.jpg' END AS e FROM documents)
SELECT 'A/' || n || e AS img_path, 'B/' || n || e AS img_path2, 'label/' || n || '.png' AS seg_map_path FROM t""")
def change(spark, d):
    lines = table(spark, d, "documents").select(F.concat(
        "source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".tif").otherwise(""), F.lit("\n")).alias("value"))
    return S.change_samples(lines, "A", "B", "label")


@query("a04_seg_path", """SELECT url || '_leftImg8bit.png' AS img_path, url || '_gtFine_labelTrainIds.png' AS seg_map_path FROM pages""")
def seg_path(spark, d):
    pages = table(spark, d, "pages").select(F.concat("url", F.lit("_leftImg8bit.png")).alias("img_path"))
    return S.with_seg_path(pages, "_leftImg8bit.png", "_gtFine_labelTrainIds.png")


@query("a05_annotated_only", """SELECT doc_id || '.jpg' AS img_name, doc_id || '.png' AS seg_name FROM labels
WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def annotated(spark, d):
    ann = table(spark, d, "labels").select(F.concat("doc_id", F.lit(".png")).alias("name"))
    img = table(spark, d, "documents").filter("lang = 'en'").select(F.concat("doc_id", F.lit(".jpg")).alias("name"))
    return S.annotated_samples(ann, img, ".png", ".jpg")


def _manifests(spark, d):
    docs = table(spark, d, "documents")
    rel = lambda kind, i: F.concat(F.lit(f"./{kind}/"), F.col("doc_id"), F.lit(f"_{i}.nii.gz"))
    train = F.array(*[F.struct(rel("imagesTr", i).alias("image"), rel("labelsTr", i).alias("label")) for i in range(2)])
    body = F.struct(F.concat(F.lit("task"), F.col("doc_id")).alias("name"), F.col("source").alias("description"),
                    F.create_map(F.lit("0"), F.lit("background"), F.lit("1"), F.col("lang")).alias("labels"),
                    train.alias("training"), F.array(rel("imagesTs", 0)).alias("test"))
    # Through JSON text, as a manifest file arrives.
    return docs.select(F.from_json(F.to_json(body), S.MANIFEST).alias("m")).select("m.*")


@query("a06_manifest", """SELECT 'task' || doc_id AS name, 'root/imagesTr/' || doc_id || '_' || i || '.nii.gz' AS img_path,
  'root/labelsTr/' || doc_id || '_' || i || '.nii.gz' AS seg_map_path FROM documents, range(2) t(i)""")
def manifest(spark, d):
    return S.manifest_samples(_manifests(spark, d), F.lit("root"))


@query("a06_manifest_test", "SELECT 'task' || doc_id AS name, 'root/imagesTs/' || doc_id || '_0.nii.gz' AS img_path FROM documents")
def manifest_test(spark, d):
    return S.manifest_samples(_manifests(spark, d), F.lit("root"), "test")


@query("a06_manifest_classes", """SELECT 'task' || doc_id AS name, 0 AS class_id, 'background' AS class_name FROM documents
UNION ALL SELECT 'task' || doc_id, 1, lang FROM documents""")
def manifest_classes(spark, d):
    return S.manifest_classes(_manifests(spark, d))


@query("a07_category_id", """WITH c AS (SELECT 'src' AS class_name, 0 AS class_id UNION ALL SELECT 'small ring', 1),
cl AS (SELECT p_name AS class_name, (min(p_partkey) % 1000)::BIGINT AS class_id FROM part GROUP BY p_name HAVING count(*) > 30)
SELECT 'img/' || p_name || '_' || p_partkey || '.jpg' AS img_path, 'img/' || p_name || '_' || p_partkey || '.png' AS depth_map_path,
  coalesce(cl.class_id, -1) AS category_id FROM part LEFT JOIN cl ON cl.class_name = p_name""")
def category(spark, d):
    part = table(spark, d, "part")
    listing = part.select(F.concat(F.lit("img/"), "p_name", F.lit("_"), "p_partkey", F.lit(".jpg")).alias("img_path"))
    classes = (part.groupBy(F.col("p_name").alias("class_name"))
               .agg((F.min("p_partkey") % 1000).alias("class_id"), F.count(F.lit(1)).alias("n")).filter("n > 30").drop("n"))
    return S.depth_samples(listing, classes)


@query("a08_csv_list", """SELECT source || ',v2/' || doc_id AS img_path FROM documents""")
def csv_list(spark, d):
    lines = table(spark, d, "documents").select(F.concat("source", F.lit(",v2/"), "doc_id", F.lit(","), "lang").alias("value"))
    return S.csv_samples(lines)


@query("a09_declared_samples", """SELECT 'root/media/' || page_id || '.jpg' AS img_path, 'root/label_map/' || page_id || '.png' AS seg_map_path,
  (page_id % 7 + 300)::INT AS h, 400 AS w FROM pages""")
def declared(spark, d):
    item = F.struct(
        F.struct(F.concat(F.lit("media/"), "page_id", F.lit(".jpg")).alias("image"),
                 F.array((F.col("page_id") % 7 + 300).cast("int"), F.lit(400)).alias("image_shape")).alias("media"),
        F.concat(F.lit("label_map/"), "page_id", F.lit(".png")).alias("label_map"), F.lit("").alias("instance_map"))
    text = table(spark, d, "pages").select(F.to_json(F.struct(F.array(item).alias("samples"))).alias("t"))
    return S.declared_samples(text.select(F.from_json("t", S.DECLARED).alias("f")).select("f.*"), F.lit("root"))


def _rasters(spark, d):
    """Every embedding as a raster of 4 x 8 pixels and 2 bands."""
    emb = spread(table(spark, d, "embeddings"), "vec_id")
    return emb.select(F.col("vec_id").alias("sample_id"), F.lit(4).alias("h"), F.lit(8).alias("w"), F.lit(2).alias("c"),
                      F.col("embedding").cast("array<double>").alias("data"))


@query("a10_raster_source", """SELECT vec_id AS sample_id, (p // 16)::INT AS y, ((p // 2) % 8)::INT AS x, (p % 2)::INT AS c,
  round(embedding[p+1]::DOUBLE, 6) AS v FROM embeddings, range(64) t(p)""")
def raster_source(spark, d):
    return R.to_pixels(_rasters(spark, d)).withColumn("v", F.round("v", 6))


@query("a11_raster_pair", """SELECT vec_id AS sample_id, 4 AS h, 8 AS w, round(list_sum([z::DOUBLE * z::DOUBLE for z in embedding]), 6) AS dot FROM embeddings""")
def raster_pair(spark, d):
    a = _rasters(spark, d)
    both = R.pair_rasters(a, a)
    s = F.aggregate(F.zip_with("data", "data2", lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    return both.select("sample_id", "h", "w", F.round(s, 6).alias("dot"))


@query("a12_volume_source", """SELECT vec_id AS sample_id, 0 AS c, (p % 4)::INT AS z, ((p // 4) % 4)::INT AS y, (p // 16)::INT AS x,
  round(embedding[p+1]::DOUBLE, 6) AS v, trunc(embedding[32+p+1]::DOUBLE * 10)::INT AS gt FROM embeddings, range(32) t(p)""")
def volume_source(spark, d):
    emb = spread(table(spark, d, "embeddings"), "vec_id")
    e = F.col("embedding").cast("array<double>")
    data = F.transform(e, lambda v, i: F.when(i >= 32, v * 10).otherwise(v))
    vols = emb.select(F.col("vec_id").alias("sample_id"), F.lit(2).alias("n"), F.lit(2).alias("d"), F.lit(4).alias("h"),
                      F.lit(4).alias("w"), data.alias("data"))
    return R.to_voxels(vols, reverse_axes=True, label_last=True).withColumn("v", F.round("v", 6))


@query("a13_depth_source", """SELECT l_orderkey AS sample_id, round(l_extendedprice::FLOAT::DOUBLE * 0.5, 6) AS gt_depth FROM lineitem""")
def depth_source(spark, d):
    raw = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_extendedprice").alias("gt_depth"))
    return R.scale_depth(raw, 0.5).withColumn("gt_depth", F.round("gt_depth", 6))


@query("a14_prediction_sink", f"""WITH {X.PIXELS} SELECT sample_id, (y // 8)::BIGINT AS tile_y, (x // 8)::BIGINT AS tile_x,
  string_agg((pred + 1)::VARCHAR, ',' ORDER BY y, x) AS data FROM px GROUP BY 1, 2, 3""")
def prediction_sink(spark, d):
    path = new_scratch_path(spark, "pred")
    R.write_predictions(X.pixels(spark, d), path, add_one=True, tile=8)
    back = spark.read.parquet(path)
    return back.withColumn("data", F.array_join(F.col("data").cast("array<string>"), ","))


@query("a15_depth_sink", f"""WITH {X.DEPTHS} SELECT sample_id, trunc(pred_depth * 256)::INT AS depth16 FROM dp""")
def depth_sink(spark, d):
    return X.depths(spark, d).select("sample_id", R.depth_to_uint16(F.col("pred_depth"), 256.0).alias("depth16"))


@query("a16_format_only", f"WITH {X.PIXELS} SELECT pred, count(*) AS n FROM px GROUP BY pred")
def format_only(spark, d):
    path = new_scratch_path(spark, "format")
    R.write_predictions(X.pixels(spark, d).drop("gt"), path, tile=16)
    return spark.read.parquet(path).select(F.explode("data").alias("pred")).groupBy("pred").agg(F.count(F.lit(1)).alias("n"))


@query("a17_pack", f"""WITH {X.IMAGE}, q AS (SELECT sample_id, (c*16 + y)*16 + x AS p, v FROM im)
SELECT q.sample_id, (p // 512)::BIGINT AS chunk, string_agg(v::INT::VARCHAR, ',' ORDER BY p) AS data, any_value(p_name) AS ori_name
FROM q JOIN part ON p_partkey = q.sample_id GROUP BY 1, 2""")
def pack(spark, d):
    meta = X.images(spark, d, "p_name").select("sample_id", F.col("p_name").alias("ori_name"))
    packed = R.pack_chw(X.image(spark, d), meta, X.SIDE, X.SIDE, chunk=512)
    return packed.select("sample_id", "chunk", F.array_join(F.col("data").cast("array<int>").cast("array<string>"), ",").alias("data"),
                         F.col("meta.ori_name").alias("ori_name"))


@query("a17_pack_label", f"""WITH {X.PIXELS} SELECT sample_id, '1,16,16' AS shape, ((y*16 + x) // 65536)::BIGINT AS chunk,
  string_agg(gt::VARCHAR, ',' ORDER BY y, x) AS data FROM px GROUP BY 1, 3""")
def pack_label(spark, d):
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return R.pack_label(X.pixels(spark, d), X.SIDE, X.SIDE).select("sample_id", "chunk", join("data"), join("shape"))


@query("a18_input_dispatch", """SELECT 'path' AS kind, url AS img_path, NULL::BIGINT AS sample_id, NULL::BIGINT AS n_values FROM pages
UNION ALL SELECT 'array', NULL, vec_id, len(embedding) FROM embeddings""")
def dispatch(spark, d):
    paths = table(spark, d, "pages").select(F.col("url").alias("img_path"))
    both = R.inference_inputs(paths, _rasters(spark, d).select("sample_id", "data"))
    return both.select("kind", "img_path", "sample_id", F.when(F.col("data").isNotNull(), F.size("data").cast("bigint")).alias("n_values"))


@query("a19_split_list", "SELECT doc_id::VARCHAR AS value FROM documents")
def split_list(spark, d):
    path = new_scratch_path(spark, "split")
    docs = table(spark, d, "documents").select(F.concat(F.lit("train/"), "source", F.lit("/"), "doc_id", F.lit(".png")).alias("img_path"))
    S.write_split_list(docs, path)
    return spark.read.text(path)
