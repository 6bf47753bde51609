"""Small tables with every odd case, and plain versions of what the operators count."""

import re

from pyspark.sql import types as T

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns whose names operators use inside.
CLASHING = ["score", "row", "row_key", "n", "block", "kept", "size", "h"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       *[T.StructField(c, T.StringType()) for c in CLASHING]])


def documents(spark, rows):
    """Rows are (id, text) or (id, text, lang)."""
    return spark.createDataFrame([(*r, *[None] * (3 - len(r)), *["x"] * len(CLASHING)) for r in rows], SCHEMA)


ODD = [(1, ""), (2, None), (None, "one text without an id"), (None, None), (3, "   \n\t "), (4, "word"), (4, "word"), (5, "ÀÉ ß 日本 \x00 x"),
       (6, "long " * 30_000), (7, "No" + "o" * 100_000)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low_words(text):
    return words((text or "").translate(LOWER))


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]
