import random
import re

import numpy as np
import pyarrow as pa

from segspark.llm import textarrays as A

TEXTS = ["Hello  world\tfoo", "", None, "é Ü\n x", " ", "a b c d a b c d", "x"]


def test_words_and_hashes():
    texts = A.texts_of(pa.chunked_array([pa.array(["skip", *TEXTS]).slice(1)]))
    words = A.words_of(texts, A.SPACE)
    for i, text in enumerate(TEXTS):
        got = [texts.data[words.start[k]:words.end[k]].tobytes().decode() for k in range(words.first[i], words.first[i + 1])]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", text or "")
    upper = A.texts_of(pa.array([(t or "").replace("hello", "HELLO") for t in TEXTS]))
    assert (A.word_hashes(texts, words) == A.word_hashes(upper, A.words_of(upper, A.SPACE))).all()


def test_shingle_sets_count_distinct_sequences():
    texts = A.texts_of(pa.array(TEXTS))
    _, first = A.shingle_sets(texts, 4)
    assert np.diff(first).tolist() == [1, 0, 0, 1, 0, 4, 1]


def test_sliding_min():
    draw = np.random.default_rng(1)
    for width in (1, 2, 7, 46):
        x = draw.integers(0, 50, 300)
        assert A.sliding_min(x, width).tolist() == [x[i:i + width].min() for i in range(300 - width + 1)]


def test_runs_cross_batches():
    keys = sorted(random.Random(2).choices(range(9), k=100))
    table = pa.table({"k": pa.array(keys, pa.int64())})
    runs = [r.column("k").to_pylist() for r in A.runs_of(table.to_batches(max_chunksize=7), ["k"])]
    assert [len(set(r)) for r in runs] == [1] * len(set(keys)) and sum(runs, []) == keys


def test_slices_hold_every_row_once():
    batch = pa.record_batch({"text": ["x" * n for n in (5, 100, 1, 1, 0, 30)]})
    parts = list(A.sliced([batch, batch.slice(0, 0)], "text", 20))
    assert [t for p in parts for t in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(parts) > 2
