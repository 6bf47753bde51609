"""Prompts, text cleaning, token rows and class embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.functions import columns as C

# Entities that are decoded; the ampersand comes last, so one pass decodes one level.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
# White space as Unicode text knows it.
SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# Fixed value: the pre-token pattern.
TOKENS = r"(?i)<start_of_text>|<end_of_text>|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def expand_prompts(names: DataFrame, templates: tuple[str, ...] | list[str], column: str = "class_name") -> DataFrame:
    """One row per name and template: (…, template_id, prompt)."""
    listed = F.posexplode(F.array(*[F.lit(t) for t in templates])).alias("template_id", "template")
    return (names.select("*", listed)
            .withColumn("prompt", F.replace(F.col("template"), F.lit("{}"), F.col(column))).drop("template"))


def unescape(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def clean(text: Column) -> Column:
    """Decode entities twice, squeeze white space, trim, lower."""
    once = unescape(unescape(text))
    return F.lower(F.trim(F.regexp_replace(once, SPACES, " ")))


def pre_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))


def token_row(ids: Column, length: int = 77, start: int = 49406, end: int = 49407) -> Column:
    """start + ids + end, cut to `length` with `end` kept last, zeros behind."""
    full = F.concat(F.array(F.lit(start)), ids, F.array(F.lit(end)))
    cut = F.when(F.size(full) > length, F.concat(F.slice(full, 1, length - 1), F.array(F.lit(end)))).otherwise(full)
    return F.concat(cut, F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(cut), F.lit(0))))


def class_embeddings(rows: DataFrame, key: str = "class_id", column: str = "embedding") -> DataFrame:
    """(key, embedding): normalise each template's vector, average, normalise again."""
    vec = rows.select(key, F.col(column).cast("array<double>").alias("v")).withColumn("n", C.norm(F.col("v")))
    cells = vec.select(key, F.posexplode(F.transform("v", lambda x: x / F.col("n"))).alias("i", "x"))
    means = cells.groupBy(key, "i").agg(F.avg("x").alias("x"))
    # As many entries as the vector has dimensions.
    whole = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("v"))
    return whole.withColumn("n", C.norm(F.col("v"))).select(key, F.transform("v", lambda x: x / F.col("n")).alias("embedding"))


def missing_from_cache(names: DataFrame, cache: DataFrame, column: str = "class_name") -> DataFrame:
    return names.select(column).distinct().join(cache, column, "left_anti")


def refresh_cache(names: DataFrame, cache: DataFrame, encode, column: str = "class_name") -> DataFrame:
    """Cache plus the rows that `encode` gives for names not in it."""
    return cache.unionByName(encode(missing_from_cache(names, cache, column)).select(*cache.columns))


def cosine_logits(rows: DataFrame, classes: DataFrame, scale: float = 100.0, column: str = "embedding", key: str = "class_id") -> DataFrame:
    """Add logits: scale * cosine to each class embedding, classes in key order. The class table is a
    dimension and enters every row as one array."""
    table = classes.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("embedding").alias("e"))))["e"].alias("t"))
    unit = (rows.withColumn("__v", F.col(column).cast("array<double>")).withColumn("__n", C.norm(F.col("__v")))
            .withColumn("__t", table.scalar()))
    return unit.withColumn("logits", F.transform("__t", lambda e: C.dot(e, F.col("__v")) / F.col("__n") * scale)).drop("__v", "__n", "__t")
