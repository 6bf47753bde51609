"""Queries for prompts, text and embeddings."""

from pyspark.sql import functions as F

from segspark import templates
from segspark.operators import text as M
from segspark.plans.registry import query, table

SP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _unescape(s):
    for e, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        s = f"replace({s}, '{e}', '{c}')"
    return s


def _clean(s):
    return f"lower(trim(regexp_replace({_unescape(_unescape(s))}, '{SP}', ' ', 'g')))"


@query("m01_prompts", """WITH t AS (SELECT column0 AS template_id, column1 AS t FROM (VALUES (0, 'a photo of a {}.'), (1, 'There is a {} in the scene'), (2, 'itap of my {}.')) v(column0, column1))
SELECT p_partkey, p_name AS class_name, template_id, replace(t, '{}', p_name) AS prompt FROM part, t""")
def prompts(spark, d):
    names = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("class_name"))
    return M.expand_prompts(names, ["a photo of a {}.", "There is a {} in the scene", "itap of my {}."])


@query("m01_prompt_counts", f"""SELECT p_name AS class_name, count(*) * {len(templates.IMAGENET)} AS prompts FROM part GROUP BY p_name""")
def prompt_counts(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("class_name"))
    return M.expand_prompts(names, templates.predefined("imagenet")).groupBy("class_name").agg(F.count("prompt").alias("prompts"))


@query("m02_clean", f"""SELECT 'page' AS kind, page_id AS id, md5({_clean('html')}) AS digest, length({_clean('html')}) AS n FROM pages
UNION ALL SELECT 'document', doc_id, md5({_clean('text')}), length({_clean('text')}) FROM documents""")
def clean(spark, d):
    both = (table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("t"))
            .union(table(spark, d, "documents").select(F.lit("document"), "doc_id", "text")))
    return both.select("kind", "id", M.clean(F.col("t")).alias("t")).select(
        "kind", "id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n"))


TOK = r"(?i)<start_of_text>|<end_of_text>|''s|''t|''re|''ve|''m|''ll|''d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@query("m03_pre_tokens", f"""WITH t AS (SELECT doc_id, regexp_extract_all({_clean('text')}, '{TOK}') AS tk FROM documents)
SELECT doc_id, len(tk) AS n, md5(array_to_string(tk, '|')) AS digest FROM t""")
def pre_tokens(spark, d):
    rows = table(spark, d, "documents").select("doc_id", M.pre_tokens(M.clean(F.col("text"))).alias("tk"))
    return rows.select("doc_id", F.size("tk").cast("bigint").alias("n"), F.md5(F.array_join("tk", "|")).alias("digest"))


@query("m04_token_rows", f"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all({_clean('text')}, '{TOK}'), lambda w: length(w)) AS ids FROM documents),
f AS (SELECT doc_id, list_concat([49406], ids, [49407]) AS f FROM t),
c AS (SELECT doc_id, CASE WHEN len(f) > 77 THEN list_concat(f[1:76], [49407]) ELSE f END AS c FROM f)
SELECT doc_id, array_to_string(list_concat(c, list_transform(range(0, 77 - len(c)), lambda z: 0)), ',') AS ids FROM c""")
def token_rows(spark, d):
    # Word lengths stand in for vocabulary ids.
    rows = table(spark, d, "documents").select("doc_id", M.pre_tokens(M.clean(F.col("text"))).alias("tk"))
    ids = M.token_row(F.transform("tk", lambda w: F.length(w)))
    return rows.select("doc_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


EMB = """nv AS (SELECT label AS class_id, list_transform(embedding, lambda z: z::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
mv AS (SELECT class_id, i::INT AS i, avg(v[i+1]) AS x FROM nv, range(64) t(i) GROUP BY 1, 2),
ce AS (SELECT class_id, i, x / sqrt(sum(x*x) OVER (PARTITION BY class_id)) AS x FROM mv)"""


def _classes(spark, d):
    return M.class_embeddings(table(spark, d, "embeddings").select(F.col("label").alias("class_id"), "embedding"))


@query("m05_class_embedding", f"WITH {EMB} SELECT class_id, i, round(x, 6) AS x FROM ce")
def class_embedding(spark, d):
    return _classes(spark, d).select("class_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("m06_cache", """WITH c AS (SELECT DISTINCT p_name AS class_name FROM part WHERE p_size <= 25 AND p_type = 'ECONOMY')
SELECT class_name, 'cached' AS origin FROM c UNION ALL SELECT DISTINCT p_name, 'encoded' FROM part WHERE p_name NOT IN (SELECT class_name FROM c)""")
def cache(spark, d):
    part = table(spark, d, "part").withColumnRenamed("p_name", "class_name")
    stored = part.filter("p_size <= 25 and p_type = 'ECONOMY'").select("class_name").distinct().withColumn("origin", F.lit("cached"))
    return M.refresh_cache(part, stored, lambda new: new.withColumn("origin", F.lit("encoded")))


@query("m07_cosine", f"""WITH {EMB}, p AS (SELECT vec_id, i, embedding[i+1]::DOUBLE AS v FROM embeddings, range(64) t(i))
SELECT vec_id, class_id AS c, round(100 * sum(v*x) / sqrt(sum(v*v)), 5) AS logit FROM p JOIN ce USING (i) GROUP BY 1, 2""")
def cosine(spark, d):
    out = M.cosine_logits(table(spark, d, "embeddings"), _classes(spark, d))
    return out.select("vec_id", F.posexplode("logits").alias("c", "logit")).withColumn("logit", F.round("logit", 5))
