import random

import duckdb

from segspark.llm import decontaminate, queries
from tests.llm.helpers import ODD, documents, rows_of

ITEMS = "item_id long, text string, value string, size string, row string"


def items(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], ITEMS)


def by_sql(docs, bench):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    con.register("benchmark", bench.select("item_id", "text").toArrow())
    return con.sql(queries.CONTAMINATION_SQL).fetchall()


def as_rows(found):
    import hashlib
    return [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"])
            for r in rows_of(found)]


def same(a, b):
    return sorted(map(str, a)) == sorted(map(str, b))


def test_random_texts_as_the_sql(spark):
    draw = random.Random(4)

    def text(n):
        return " ".join(draw.choice(["a", "B", "c,", "d.", "é", "F9"]) for _ in range(n))
    bench = [(k, text(draw.choice([1, 2, 3, 5, 8, 12, 13, 14, 20, 40]))) for k in range(30)]
    docs = [(k, text(draw.randrange(0, 60)) + " " + (draw.choice(bench)[1] if k % 3 == 0 else "") + " " + text(draw.randrange(30))) for k in range(60)]
    d, b = documents(spark, docs), items(spark, bench)
    assert same(as_rows(decontaminate.contamination(d, b)), by_sql(d, b))


def test_odd_rows(spark):
    passage = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = [(1, passage), (1, passage), (2, passage.upper()), (None, "another item of nine words without an id here"), (3, ""), (4, None), (10, "Short!"),
             (11, "long " * 13)]
    docs = [*ODD, (20, passage), (20, passage), (21, "before " * 300 + passage), (22, "short"), (23, passage[4:60]),
            (24, "Another item of nine words; without an id here.")]
    d, b = documents(spark, docs), items(spark, bench)
    got = as_rows(decontaminate.contamination(d, b))
    assert same(got, by_sql(d, b)) and len(got) == len(docs)
    clean = as_rows(decontaminate.contamination(d, b.limit(0)))
    assert not any(r[5] for r in clean) and len(clean) == len(docs)
    assert decontaminate.contamination(d.limit(0), b).count() == 0


def test_every_window_has_a_fingerprint_of_its_own():
    import numpy as np
    import pyarrow as pa
    from segspark.llm.textarrays import texts_of
    draw = random.Random(8)
    words = [draw.choice("abcdefgh") for _ in range(200)]
    for size in (1, 2, 3, 7, 12, 13):
        scheme = decontaminate.Scheme(size)
        _, whole = decontaminate.fingerprints(texts_of(pa.array([" ".join(words)])), scheme)
        for s in range(0, 200 - size + 1, 9):
            _, part = decontaminate.fingerprints(texts_of(pa.array([" ".join(words[s:s + size])])), scheme)
            assert len(part.value) and np.isin(part.value + 0, whole.value).all()
