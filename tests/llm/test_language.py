import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from segspark.llm import language, queries
from tests.llm.helpers import ODD, documents, rows_of

EN = "the house stands near the old river and the children walk along its banks every morning"
DE = "das Haus steht nahe am alten Fluss und die Kinder gehen jeden Morgen an seinem Ufer entlang"
RU = "дом стоит у старой реки и дети гуляют каждое утро вдоль её берега"


@pytest.fixture(scope="module")
def model(spark):
    return language.train(documents(spark, [(1, EN, "en"), (2, DE, "de"), (3, RU, "ru"), (4, None, "en"), (5, EN, None)]))


def test_script_narrows(model):
    assert model.languages == ["de", "en", "ru"]
    cyrillic = language.NAMES.index("cyrillic")
    assert model.allowed[cyrillic].tolist() == [False, False, True]
    assert model.allowed[language.NAMES.index("han")].all()  # used by none: narrows nothing


def test_viterbi_is_the_best_path():
    draw = np.random.default_rng(5)
    for n in (1, 2, 5, 7):
        scores = draw.normal(0, 3, (n, 3)).astype(np.float32)

        def cost(path):
            return sum(float(scores[i, k]) for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
        best = max(itertools.product(range(3), repeat=n), key=cost)
        assert cost(language.viterbi(scores, np.array([0, n]), 2.0)) == pytest.approx(cost(best))


def test_long_and_short_walks_agree(monkeypatch):
    scores = np.random.default_rng(6).normal(0, 5, (400, 4)).astype(np.float32)
    first = np.array([0, 0, 150, 151, 400])
    want = language.viterbi(scores, first, 4.0)
    monkeypatch.setattr(language, "LONG", 0)
    assert (language.viterbi(scores, first, 4.0) == want).all()


def test_mixed_text_has_spans(spark, model):
    text = f"{EN}. {RU}! {DE}"
    got = rows_of(language.label_documents(documents(spark, [(1, text)]), model, ["doc_id"]))[0]
    assert [s["lang"] for s in got["spans"]] == ["en", "ru", "de"]
    russian = got["spans"][1]
    assert text[russian["start"]:russian["end"]] == RU


def test_odd_rows(spark, model):
    docs = documents(spark, [*ODD, (8, "12 — 34 !")])
    got = rows_of(language.label_documents(docs, model, ["doc_id"], spans=False))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 8)} == {"und"}
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["lang_pred"] != "und" for r in got)
    assert language.label_documents(docs.limit(0), model, ["doc_id"]).count() == 0
    empty = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in rows_of(language.label_documents(docs, empty, ["doc_id"]))} == {"und"}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op5_language_spans"](spark, d).filter("held_out")
    right = got.join(queries.table(spark, d, "documents").select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")))
    assert right.first()[0] > 0.97
