import random
from collections import defaultdict

import pytest

from segspark.llm import components, neardup, queries
from tests.llm.helpers import ODD, documents, low_words, rows_of


def shingles(text):
    w = low_words(text)
    return frozenset(tuple(w[i:i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def roots(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain(rows):
    """(id, n_shingles, component, kept) by comparing all pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    edges = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    groups = defaultdict(list)
    for i, r in enumerate(roots(len(rows), edges)):
        groups[r].append(i)
    out = []
    for members in groups.values():
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), least, rows[i][0] == least) for i in members]
    return sorted(map(str, out))


def spark_rows(df):
    return sorted(str((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in rows_of(df))


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [512, 8])
def test_groups_of_edited_copies(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    draw = random.Random(block)
    rows, k = [], 100
    for length in (6, 20, 60, 200):
        base = [f"b{draw.randrange(400)}" for _ in range(length)]
        for _ in range(25):
            rows.append((k, edited(draw, base, draw.randrange(0, 1 + length // 16))))
            k += 1
    rows += [(k + i, "a passage that many share of some words " + edited(draw, ["x"] * 30, 28)) for i in range(30)]
    draw.shuffle(rows)
    assert spark_rows(neardup.near_duplicates(documents(spark, rows))) == plain(rows)


def test_chain_is_one_component(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[4 * i:4 * i + 80])) for i in range(10)]  # each like the next, the ends unlike
    assert {r["component_id"] for r in rows_of(neardup.near_duplicates(documents(spark, rows)))} == {0}


def test_odd_rows(spark):
    rows = [*ODD, (30, "One two three four five"), (31, "one TWO three\tfour five"), (None, "one two three four five"), (32, "word"), (30, "other text of this id")]
    got = neardup.near_duplicates(documents(spark, rows))
    assert spark_rows(got) == plain([(k, t) for k, t, *_ in rows])
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_small_corpus(spark):
    d = "/root/testdata/sf0.001"
    docs = queries.table(spark, d, "documents")
    assert spark_rows(neardup.near_duplicates(docs)) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_components_of_random_graphs(spark):
    draw = random.Random(11)
    for n, m in ((2, 1), (60, 40), (200, 150)):
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n // 2, n - 1)]
        want = {i: r for i, r in enumerate(roots(n, edges)) if any(i in e and e[0] != e[1] for e in edges)}
        got = {r["node"]: r["component"] for r in rows_of(components.connected(spark.createDataFrame(edges, "u long, v long")))}
        assert got == want
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0
