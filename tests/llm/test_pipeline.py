"""run() and each stage against plain versions over the smallest corpus."""

import hashlib
import re
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as pipeline
from segspark.llm import bpe, pii
from tests.llm.helpers import ODD, documents, rows_of
from tests.llm.test_neardup import roots, shingles

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    from segspark.runtime import materialize
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], D)))
    return [df.toPandas() for df in out]


def test_stages_are_the_contract():
    assert [name for name, _ in pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "surrogates", "tokens"]


def test_columns_stay_until_the_last(steps):
    assert all(list(s.columns) == list(steps[0].columns) for s in steps[:5])


def test_language_drops_texts_without_letters_only(steps):
    letters = {r.doc_id for r in steps[0].itertuples() if any(c.isalpha() for c in r.text or "")}
    assert set(steps[1].doc_id) == letters


def test_one_of_each_group_stays(steps):
    rows = list(steps[1].itertuples())
    sets = [shingles(r.text) for r in rows]
    edges = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least = defaultdict(list)
    for r, root in zip(rows, roots(len(rows), edges)):
        least[root].append(r.doc_id)
    assert sorted(steps[2].doc_id) == sorted(min(g) for g in least.values())


def test_contaminated_go_and_clean_stay(steps, spark):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    windows = set()
    for r in spark.read.parquet(f"{D}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i:i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}
    keep = []
    for r in steps[2].itertuples():
        w = words(r.text)
        hit = {j for n in sizes for i in range(len(w) - n + 1) if tuple(w[i:i + n]) in windows for j in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            keep.append(r.doc_id)
    assert sorted(steps[3].doc_id) == sorted(keep)


def test_personal_data_is_replaced(steps):
    # The pattern in the dialect of Python's regex module.
    import regex
    old, new = dict(zip(steps[3].doc_id, steps[3].text)), dict(zip(steps[4].doc_id, steps[4].text))
    assert old.keys() == new.keys()
    pattern, changed = regex.compile(pii.PATTERN), 0
    for k, text in old.items():
        found, now = pattern.findall(text), pattern.findall(new[k])
        changed += bool(found)
        assert len(found) == len(now) and all(a != b for a, b in zip(found, now))
        assert pattern.split(text) == pattern.split(new[k])  # nothing between entities changes
    assert changed


def test_tokens_of_the_last_stage(steps):
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(pipeline.VOCABULARY))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in steps[5].itertuples()}
    for r in steps[4].itertuples():
        ids = enc.encode_ordinary(r.text)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())


def test_run_is_the_stages(steps, spark):
    assert sorted(map(str, pipeline.run(spark, D).toPandas().itertuples(index=False))) == sorted(map(str, steps[5].itertuples(index=False)))


@pytest.mark.parametrize("rows", [[], [*ODD, (60, "the house by the river " * 9, "en"), (60, "the house by the river " * 9, "en"), (61, "the house by the river " * 9, None)]])
def test_odd_rows_pass_every_stage(spark, rows):
    docs = documents(spark, rows)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, D)
        if name != "tokens":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert len(rows_of(docs)) <= len(rows)


def test_without_labels_the_language_stage_drops_texts_without_letters_only(spark):
    rows = [(20, "plain words"), (21, "12 34"), (22, None), (23, "日本"), (24, "")]
    docs = documents(spark, rows)  # lang is NULL throughout
    assert sorted(r["doc_id"] for r in rows_of(pipeline.identify_language(spark, docs, D))) == [20, 23]
    labelled = documents(spark, [*rows, (25, "99", "en")])  # the only labelled row has no letters
    assert sorted(r["doc_id"] for r in rows_of(pipeline.identify_language(spark, labelled, D))) == [20, 23]
