import re
from collections import Counter

import pyarrow as pa

from segspark.llm import quality, queries
from segspark.llm.textarrays import texts_of
from tests.llm.helpers import ODD, documents, rows_of, words


def plain(text):
    text = text or ""
    w, seen, dup = words(text), set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if count[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_counts_against_plain_loops():
    texts = [t for _, t, *_ in ODD] + ["a\nb\na\na", "\n\nx\n\n x\nx\n", "a b c d e f a b c d e", "é <ü> # a\t\n"]
    got = list(zip(*[c.tolist() for c in quality.base_counts(texts_of(pa.array(texts)))]))
    assert got == [plain(t) for t in texts]


def test_odd_rows_and_whole_table(spark):
    docs = documents(spark, ODD)
    ratio = quality.fit_ratio(docs, docs.select("doc_id"))
    got = rows_of(quality.judge_documents(docs, ratio))
    assert len(got) == len(ODD) and not any(r["kept"] for r in got if r["n_words"] < 10)
    assert quality.judge_documents(docs.limit(0), ratio).count() == 0
    nothing = quality.fit_ratio(docs, docs.limit(0).select("doc_id"))
    assert {r["llr"] for r in rows_of(quality.judge_documents(docs, nothing))} == {0.0}


def test_labels_are_told_apart(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op6_quality_ratio"](spark, d)
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, d, "documents").collect()}
    for r in rows_of(got):
        n = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert n == plain(texts[r["doc_id"]])
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
    labelled = got.join(queries.table(spark, d, "labels"), "doc_id").groupBy("quality").agg({"kept": "count"}).count()
    kept = {r["quality"]: r["k"] for r in got.join(queries.table(spark, d, "labels"), "doc_id").filter("not base_failed")
            .selectExpr("quality", "cast(kept as int) as k").groupBy("quality").agg({"k": "avg"}).withColumnRenamed("avg(k)", "k").collect()}
    assert labelled == 2 and kept[1] > 0.98 and kept[0] < 0.1


def test_every_trusted_row_counts(spark):
    docs = spark.range(50_400).selectExpr("id as doc_id", "concat('w', id % 997, ' of ', id) as text")
    ratio = quality.fit_ratio(docs, docs.select("doc_id"))  # the target is the whole corpus
    assert not ratio.weights.any()
    other = quality.fit_ratio(docs, docs.selectExpr("cast(doc_id as int) as item"))  # ids of another type
    assert not other.weights.any()
