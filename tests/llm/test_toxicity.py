import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from segspark.llm import queries, toxicity
from segspark.llm.textarrays import texts_of
from tests.llm.helpers import ODD, documents, rows_of


def test_windows_hold_all_words_once():
    texts = ["One, two3three FOUR five", "", None, "...", "a b c d e f g"]
    w = toxicity.windows_of(texts_of(pa.array(texts)))
    raw = w.stream.tobytes()
    got = [raw[w.edge[i] - 1:w.edge[i + 1]].decode() for i in range(len(w.text))]
    assert got == [" one two three ", " four five ", " a b c ", " d e f ", " g "]
    assert w.text.tolist() == [0, 0, 4, 4, 4] and w.counts.tolist() == [2, 0, 0, 0, 3]


def test_gain_is_what_the_toxic_dictionary_saves():
    pair = toxicity._Pair(b" the house by the river and the mill ", b" horrible  unspeakable ")
    w = toxicity.windows_of(texts_of(pa.array(["the horrible mill", "the house by", "an unspeakable", "unrelated words here"])))
    gains = pair.gains(w)
    assert gains[0] > 3 and gains[2] > 3 and gains[1] == gains[3] == 0


def test_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    docs = documents(spark, ODD)
    nothing = toxicity.fit(docs, labels)  # no usable label
    got = rows_of(toxicity.score_documents(docs, nothing))
    assert len(got) == len(ODD) and {round(r["score"], 6) for r in got} == {0.5}
    assert toxicity.score_documents(docs.limit(0), nothing).count() == 0


def test_planted_words(spark):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "re", "to") for b in ("la", "ne", "si", "vu") for c in ("ra", "do", "ki")]
    rows, labels = [], []
    for k in range(400):
        text = list(rng.choice(words, 60))
        if k % 2:
            for bad in rng.choice(["wretched", "vermin", "fiend"], 3):
                text.insert(int(rng.integers(60)), bad)
        rows.append((k, " ".join(text)))
        labels.append((k, k % 2))
    docs = documents(spark, rows)
    known = spark.createDataFrame([x for x in labels if x[0] < 300], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = {r["doc_id"]: r for r in rows_of(toxicity.score_documents(docs, model))}
    assert all(got[k]["predicted"] == k % 2 for k in range(300, 400))
    assert model.toxic == toxicity.fit(docs.repartition(5), known).toxic


def test_an_id_with_several_texts_counts_by_its_smallest(spark):
    rows = [(k, f"plain words of text number {'abcdefgh'[k % 8]}" + (" wretched vermin" * (k % 2))) for k in range(60)]
    known = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    again = [(k, "zz later text " * 5) for k in range(60)]
    once, twice = documents(spark, rows), documents(spark, again + rows)
    a, b = toxicity.fit(once, known), toxicity.fit(twice.repartition(7), known)
    assert a.toxic == b.toxic and a.ordinary == b.ordinary and np.array_equal(a.weights, b.weights)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = queries.QUERIES["op1_zstd_toxicity"](spark, d).filter("held_out").join(queries.table(spark, d, "labels"), "doc_id")
    right = got.groupBy("toxic").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("p"))
    rate = {r["toxic"]: r["p"] for r in right.collect()}
    assert rate[0] > 0.97 and rate[1] > 0.7
