"""Queries for label maps, palettes and label audits."""

from pyspark.sql import functions as F

from segspark.operators import labels as L
from segspark.plans import fixtures as X
from segspark.plans.registry import query, table


def _brands(spark, d):
    """Class table of the 25 brands: (class_id, class_name)."""
    return (table(spark, d, "part").select(F.col("p_brand").alias("class_name")).distinct()
            .select(F.regexp_extract("class_name", r"(\d+)", 1).cast("int").alias("class_id"), "class_name"))


BRANDS = "old AS (SELECT DISTINCT p_brand AS class_name, substr(p_brand, 7)::INT AS class_id FROM part)"


@query("b01_label_map", f"""WITH {BRANDS}, nw AS (SELECT class_name, (class_id//2)::INT AS class_id FROM old WHERE class_id % 2 = 0)
SELECT old.class_id AS old_id, coalesce(nw.class_id, 255)::INT AS new_id FROM old LEFT JOIN nw USING (class_name)""")
def label_map(spark, d):
    old = _brands(spark, d)
    new = old.filter("class_id % 2 = 0").select("class_name", F.expr("cast(class_id div 2 as int)").alias("class_id"))
    return L.build_label_map(old, new)


@query("b02_reduce_zero", f"""WITH {X.PIXELS} SELECT sample_id, y, x,
  CASE WHEN gt = 0 OR gt = 255 THEN 255 ELSE gt - 1 END AS gt FROM px""")
def reduce_zero(spark, d):
    return X.pixels(spark, d).select("sample_id", "y", "x", L.reduce_zero_label(F.col("gt")).alias("gt"))


def _map_df(spark, d):
    """(old_id, new_id) for the label ids that occur as part sizes: swaps 1 and 2, drops 3."""
    ids = table(spark, d, "part").select((F.col("p_size") % 6).cast("int").alias("old_id")).distinct()
    return ids.filter("old_id in (1, 2, 3)").withColumn(
        "new_id", F.when(F.col("old_id") == 1, 2).when(F.col("old_id") == 2, 1).otherwise(255))


@query("b03_relabel", f"""WITH {X.PIXELS}, rz AS (SELECT sample_id, y, x, CASE WHEN gt IN (0, 255) THEN 255 ELSE gt - 1 END AS gt FROM px)
SELECT sample_id, y, x, CASE gt WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 255 ELSE gt END::INT AS gt FROM rz""")
def relabel(spark, d):
    px = X.pixels(spark, d).select("sample_id", "y", "x", "gt")
    return L.prepare_labels(px, reduce_zero=True, label_map=_map_df(spark, d))


@query("b04_palette", f"""WITH {BRANDS} SELECT (class_id//2)::INT AS class_id, (class_id*37 % 256)::INT AS r,
  (class_id*59 % 256)::INT AS g, (class_id*83 % 256)::INT AS b FROM old WHERE class_id % 2 = 0""")
def palette(spark, d):
    c = F.col("class_id")
    colours = _brands(spark, d).select("class_id", (c * 37 % 256).alias("r"), (c * 59 % 256).alias("g"), (c * 83 % 256).alias("b"))
    return L.resolve_palette(colours, label_map(spark, d))


@query("b04_generated_palette", f"WITH {BRANDS} SELECT class_id, " + ", ".join(
    f"floor({X.draw_sql(i, 'class_id')}*256)::INT AS {c}" for i, c in ((1, "r"), (2, "g"), (3, "b"))) + " FROM old")
def generated(spark, d):
    return L.generated_palette(_brands(spark, d), draw=X.draw)


@query("b05_classes_of", """WITH c AS (SELECT DISTINCT p_brand AS dataset, p_type AS class_name FROM part),
w AS (SELECT DISTINCT lower(p_brand) AS alias, p_brand AS dataset FROM part)
SELECT w.alias, w.dataset, c.class_name FROM w JOIN c USING (dataset)""")
def classes_of(spark, d):
    part = table(spark, d, "part")
    classes = part.select(F.col("p_brand").alias("dataset"), F.col("p_type").alias("class_name")).distinct()
    aliases = part.select(F.lower("p_brand").alias("alias"), F.col("p_brand").alias("dataset")).distinct()
    wanted = part.select(F.lower("p_brand").alias("alias")).distinct()
    return L.classes_of(aliases, classes, wanted)


@query("b06_fold", f"""WITH {X.PIXELS} SELECT gt, count(*) AS n FROM
 (SELECT CASE gt WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE gt END::INT AS gt FROM px) t GROUP BY gt""")
def fold(spark, d):
    return L.fold_labels(X.pixels(spark, d), {3: 1, 4: 2}).groupBy("gt").agg(F.count(F.lit(1)).alias("n"))


@query("b07_coarsen", f"""WITH {X.PIXELS} SELECT sample_id, y, x, gt, (CASE WHEN gt < 2 THEN 0 WHEN gt < 5 THEN 1 WHEN gt < 6 THEN 2 ELSE 255 END)::INT AS coarse FROM px""")
def coarsen(spark, d):
    return L.coarsen(X.pixels(spark, d).drop("pred"), [(0, 2), (2, 5), (5, 6)])


@query("b08_submission_ids", f"""WITH {X.PIXELS} SELECT sample_id, y, x, CASE pred WHEN 0 THEN 7 WHEN 1 THEN 8 WHEN 2 THEN 11
  WHEN 3 THEN 12 WHEN 4 THEN 13 WHEN 5 THEN 17 ELSE pred END::INT AS pred FROM px""")
def submission(spark, d):
    ids = {0: 7, 1: 8, 2: 11, 3: 12, 4: 13, 5: 17}
    return L.relabel_for_submission(X.pixels(spark, d).drop("gt"), ids)


@query("b09_presence", f"""WITH {X.PIXELS}, c AS (SELECT DISTINCT (p_size % 8)::INT AS class_id FROM part)
SELECT s.sample_id, c.class_id, max((gt = class_id)::INT) AS present FROM px s, c GROUP BY s.sample_id, c.class_id""")
def presence(spark, d):
    classes = table(spark, d, "part").select((F.col("p_size") % 8).cast("int").alias("class_id")).distinct()
    return L.class_presence(X.pixels(spark, d), classes)


@query("b10_binary_masks", f"WITH {X.PIXELS} SELECT sample_id, gt AS class_id, count(*) AS area FROM px WHERE gt <> 255 GROUP BY sample_id, gt")
def masks(spark, d):
    return L.mask_index(X.pixels(spark, d))


@query("b11_histogram", f"WITH {X.PIXELS} SELECT sample_id, gt, count(*) AS n FROM px GROUP BY sample_id, gt")
def histogram(spark, d):
    return L.label_histogram(X.pixels(spark, d))


@query("b11_unique_labels", f"WITH {X.PIXELS} SELECT DISTINCT gt FROM px")
def uniques(spark, d):
    return L.unique_labels(X.pixels(spark, d))


@query("b12_class_weights", f"""WITH {X.PIXELS}, w AS (SELECT (p_size % 6)::INT AS class_id, round(avg(p_retailprice)/1000, 6) AS weight FROM part GROUP BY 1)
SELECT px.gt, round(sum(coalesce(weight, 1.0)), 3) AS weight FROM px LEFT JOIN w ON px.gt = w.class_id GROUP BY px.gt""")
def weights(spark, d):
    w = (table(spark, d, "part").groupBy((F.col("p_size") % 6).cast("int").alias("class_id"))
         .agg(F.round(F.avg("p_retailprice") / 1000, 6).alias("weight")))
    px = X.pixels(spark, d).select("sample_id", "gt")
    return L.with_class_weight(px, w).groupBy("gt").agg(F.round(F.sum("weight"), 3).alias("weight"))


@query("b13_boundary_relabel", f"""WITH {X.PIXELS}, b AS (SELECT *, ((sample_id*3 + y*5 + x*7) % 41 - 20)::DOUBLE / 5 AS bd FROM px)
SELECT sample_id, y, x, (CASE WHEN 1/(1+exp(-bd)) > 0.8 THEN gt ELSE 255 END)::INT AS gt FROM b""")
def boundary(spark, d):
    px = X.pixels(spark, d).drop("pred")
    score = ((F.col("sample_id") * 3 + F.col("y") * 5 + F.col("x") * 7) % 41 - 20).cast("double") / 5
    return L.confident_boundary(px.withColumn("boundary", score)).drop("boundary")


@query("b14_label_violations", f"""WITH {X.PIXELS}, dom AS (SELECT DISTINCT (p_size % 6)::INT AS class_id FROM part)
SELECT gt, count(*) AS pixels, count(DISTINCT sample_id) AS samples FROM px WHERE gt NOT IN (SELECT class_id FROM dom) GROUP BY gt""")
def violations(spark, d):
    domain = table(spark, d, "part").select((F.col("p_size") % 6).cast("int").alias("class_id")).distinct()
    return L.label_violations(X.pixels(spark, d), domain)


@query("b14_shape_violations", """SELECT p_partkey AS sample_id, 3 AS ndim FROM part WHERE p_size % 7 = 0""")
def shapes(spark, d):
    dims = F.when(F.col("p_size") % 7 == 0, F.array(F.lit(16), F.lit(16), F.lit(3))).otherwise(F.array(F.lit(16), F.lit(16)))
    return L.shape_violations(table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), dims.alias("dims")))
