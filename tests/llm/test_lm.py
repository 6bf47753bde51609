import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from segspark.llm import lm, queries
from tests.llm.helpers import ODD, documents, low_words, rows_of

END = object()


def plain(rows, train, frequent=0.0):
    """(n_tokens, n_known, N, base, score) of each row, by walking the automaton word by word."""
    texts = [[*low_words(t), END] for _, t, *_ in rows]
    seen = [t for t, use in zip(texts, train) if use]
    count = Counter(w for t in seen for w in t)
    total, kinds = sum(count.values()), len(count)
    states = {w for w in count if count[w] >= max(frequent * total, 1)}
    arcs = Counter((a, b) for t in seen for a, b in zip(t, t[1:]) if a in states and b in states)
    unigram = lambda w: (count[w] + 1) / (total + kinds + 1)
    kept, below = defaultdict(float), defaultdict(float)
    for (a, b), n in arcs.items():
        kept[a] += n - lm.DISCOUNT
        below[a] += unigram(b)
    failure = {a: (1 - kept[a] / count[a]) / (1 - below[a]) if below[a] < 1 else 0 for a in states}
    out = []
    for t in texts:
        state, score = None, 0.0
        for w in t:
            if (state, w) in arcs:
                score += math.log10((arcs[state, w] - lm.DISCOUNT) / count[state])
            else:
                score += math.log10(unigram(w)) + (math.log10(max(failure[state], 1e-12)) if state is not None else 0)
            state = w if w in states else None
        out.append((len(t), sum(count[w] > 0 for w in t), total, sum(math.log10(unigram(w)) for w in t), score))
    return out, (states, arcs, failure, unigram, count)


def compare(got, rows, want):
    key = lambda r: (str(r[0]), r[1:])
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows_of(got)), key=key)
    want = sorted(((k[0], *w) for k, w in zip(rows, want)), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9, abs=1e-9) and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("stored", [False, True])
def test_corpus_as_the_literal_automaton(spark, stored):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want, (states, arcs, failure, unigram, count) = plain(rows, [zlib.crc32(str(k).encode()) % 7 != 2 for k, _ in rows])
    compare(lm.score_documents(docs, ~queries.fold(7, 2), stored=stored), rows, want)
    for a in sorted(states - {END})[:5]:  # the probabilities of a state sum to one
        mass = sum((arcs[a, w] - lm.DISCOUNT) / count[a] if (a, w) in arcs else failure[a] * unigram(w) for w in count)
        assert mass + failure[a] / (sum(count.values()) + len(count) + 1) == pytest.approx(1)


def test_odd_rows_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1000)
    rows = [*ODD, (40, "a b a b c"), (41, "b A"), (41, "b A")]
    docs = documents(spark, rows)
    train = F.col("doc_id") != 41  # NULL for rows without an id: not learned from
    compare(lm.score_documents(docs, train), rows, plain(rows, [k not in (None, 41) for k, *_ in rows])[0])
    compare(lm.score_documents(docs, F.lit(False)), rows, plain(rows, [False] * len(rows))[0])
    assert lm.score_documents(docs.limit(0), train).count() == 0


def test_bigrams_of_rare_words_are_arcs(spark):
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(1000))) for k in range(30)]
    rows += [(50, "w3x7 w3x8 w4x9 new w5x1 w5x2"), (51, "w5x2 w5x1")]
    train = [k < 50 for k, _ in rows]
    want, (states, arcs, *_) = plain(rows, train, frequent=0)
    assert len(states) == 30_001 and len(arcs) == 30_000
    compare(lm.score_documents(documents(spark, rows), F.col("doc_id") < 50), rows, want)
