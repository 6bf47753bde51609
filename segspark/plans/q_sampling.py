"""Queries for hard-example mining and data-set selection."""

from pyspark.sql import functions as F

from segspark.operators import labels as L, losses as J, sampling as K
from segspark.plans import fixtures as X
from segspark.plans.q_geometry import digest
from segspark.plans.q_losses import OHEM, ROWS
from segspark.plans.registry import query, table


@query("k01_ohem_threshold", f"""WITH {X.PIXEL_LOGITS}, {ROWS}, {OHEM}, k AS (SELECT greatest(0.05, (SELECT prob FROM (SELECT prob, row_number() OVER (ORDER BY prob) - 1 AS i, count(*) OVER () AS n FROM sc) z WHERE i = least(100000, n - 1))) AS t)
SELECT sample_id, y, x, (prob < t)::INT::DOUBLE AS weight FROM sc, k""")
def by_confidence(spark, d):
    rows = J.target_scores(X.pixel_logits(spark, d), X.CLASSES, digits=9)
    return K.hard_pixels_by_confidence(rows, 0.05, 50000, 2).select("sample_id", "y", "x", "weight")


@query("k02_ohem_topk", f"""WITH {X.PIXEL_LOGITS}, {ROWS}, {OHEM}
SELECT sample_id, y, x, (row_number() OVER (ORDER BY loss DESC, sample_id, y, x) <= 100000)::INT::DOUBLE AS weight FROM sc""")
def by_loss(spark, d):
    rows = J.target_scores(X.pixel_logits(spark, d), X.CLASSES, digits=9)
    return K.hard_pixels_by_loss(rows, ["sample_id", "y", "x"], 100000).select("sample_id", "y", "x", "weight")


def _docs(spark, d):
    return table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), "source")


@query("k03_fraction_subset", f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {X.draw_sql(0, 'doc_id')}, doc_id) AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM r WHERE k <= floor(n * 0.3)""")
def fraction(spark, d):
    return K.fraction_subset(table(spark, d, "documents").select("doc_id"), 0.3, key="doc_id", draw=X.draw)


@query("k04_first_n", """SELECT lpad(doc_id::VARCHAR, 12, '0') AS name, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents ORDER BY doc_id LIMIT 250""")
def first_n(spark, d):
    return K.first_n(_docs(spark, d).select("name"), 250, [F.col("name")])


@query("k04_by_index", """SELECT name, idx FROM (SELECT lpad(doc_id::VARCHAR, 12, '0') AS name, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents) t
WHERE idx IN (SELECT page_id * 3 FROM pages)""")
def by_index(spark, d):
    idx = table(spark, d, "pages").select((F.col("page_id") * 3).alias("idx"))
    return K.by_index(_docs(spark, d).select("name"), idx, [F.col("name")]).select("name", "idx")


@query("k05_repeat", "SELECT doc_id, k::INT AS copy FROM documents, range(3) t(k)")
def repeat(spark, d):
    return K.repeat(table(spark, d, "documents").select("doc_id"), 3)


@query("k06_concat", """SELECT doc_id::VARCHAR AS name, 0 AS dataset_idx FROM documents UNION ALL SELECT url, 1 FROM pages UNION ALL SELECT vec_id::VARCHAR, 2 FROM embeddings""")
def concat(spark, d):
    pick = lambda t, c: table(spark, d, t).select(F.col(c).cast("string").alias("name"))
    return K.concat([pick("documents", "doc_id"), pick("pages", "url"), pick("embeddings", "vec_id")])


@query("k07_locate", """WITH n AS (SELECT (SELECT count(*) FROM documents) AS a, (SELECT count(*) FROM pages) AS b, (SELECT count(*) FROM embeddings) AS c),
i AS (SELECT l_orderkey AS k, l_orderkey % (2*(a+b+c)) - (a+b+c) AS idx, a, b, c FROM lineitem, n),
w AS (SELECT idx, CASE WHEN idx < 0 THEN idx + a+b+c ELSE idx END AS pos, a, b, c FROM i)
SELECT idx, (CASE WHEN pos < a THEN 0 WHEN pos < a+b THEN 1 ELSE 2 END)::INT AS dataset_idx, CASE WHEN pos < a THEN pos WHEN pos < a+b THEN pos - a ELSE pos - a - b END AS local_idx FROM w""")
def locate(spark, d):
    sizes = [table(spark, d, t).count() for t in ("documents", "pages", "embeddings")]
    n = sum(sizes)
    return K.locate(table(spark, d, "lineitem").select((F.col("l_orderkey") % (2 * n) - n).alias("idx")), sizes)


@query("k08_skip_steps", f"""WITH {X.PIXELS}, o AS (SELECT sample_id, y, 15 - x AS x, CASE WHEN gt IN (0, 255) THEN 255 ELSE gt - 1 END AS gt FROM px)
SELECT sample_id, count(*) AS n, sum(gt)::BIGINT AS total, sum(gt*(y*64 + x + 1))::BIGINT AS checksum FROM o GROUP BY sample_id""")
def skip_steps(spark, d):
    steps = [("reduce", lambda df: df.withColumn("gt", L.reduce_zero_label(F.col("gt")))),
             ("crop", lambda df: df.filter("y < 8")),
             ("flip", lambda df: df.withColumn("x", X.SIDE - 1 - F.col("x")))]
    return digest(K.run_steps(X.pixels(spark, d), steps, {"crop"}))
