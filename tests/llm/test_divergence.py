import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.llm import divergence
from tests.llm.helpers import CLASHING, LOWER, rows_of

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "lang", "source", *[c for c in CLASHING if c != "source"], "term", "total")])


def plain(rows, min_docs, top):
    """(lang, source, part, item, value, rank) of (text, lang, source), straight from the definition."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        mine = [s for g, s in groups if g == lang]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = shares(count[lang, source]), shares(sum((count[lang, s] for s in mine), Counter()))
        pairs = [(-sum(abs(p[t] - r[t]) for t in kept), s) for s in mine if s != source for r in [shares(count[lang, s])]]
        terms = [(q[t] - p[t], t) for t in kept if count[lang, source][t] and p[t] > q[t]]
        for part, ranked in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
            out += [(lang, source, part, item, -value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def compare(spark, rows, min_docs, top):
    docs = spark.createDataFrame([(*r, *["x"] * (len(SCHEMA) - 3)) for r in rows], SCHEMA)
    got = sorted(tuple(r.values()) for r in rows_of(divergence.audit_sources(docs, min_docs, top)))
    want = plain(rows, min_docs, top)
    assert got == want
    return want


def corpus(n, seed=3):
    draw = random.Random(seed)
    words = [*(draw.choice("abcdé") + draw.choice("xyzÜ") + draw.choice("stu日") for _ in range(200)), "The", "the"]
    return [(" ".join(draw.choices(words, k=draw.randint(0, 60))), draw.choice(["en", "de", None, ""]), draw.choice(["s1", "s2", "é", "Z", None])) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_as_the_definition(spark, monkeypatch, small):
    if small:  # many buckets, and skybands reduced again and again
        monkeypatch.setattr(divergence, "CELLS", 50)
        monkeypatch.setattr(divergence, "HELD_ROWS", 64)
    assert len(compare(spark, corpus(600), 20, 5)) > 100


def test_odd_rows(spark):
    rows = [("", "a", "s"), (None, "a", "t"), (None, None, None), ("word WORD wörd", "b", "s"), ("word WORD wörd", "b", "s"), ("x " * 50_000, "b", "u"),
            ("y" * 300_000, "b", "v"), ("\x00 1 2 _ ~ 日本", "c", "s"), ("Ä", "c", "only"), (None, "alone", "s")]
    assert compare(spark, rows, 1, 50)
    compare(spark, rows, 3, 2)
    assert compare(spark, [], 1, 50) == []


def test_skyband_keeps_all_that_can_rank():
    draw = np.random.default_rng(1)
    for _ in range(30):
        size, k = int(draw.integers(1, 900)), int(draw.integers(1, 8))
        n, m, place = draw.integers(1, 12, size), draw.integers(1, 12, size), draw.permutation(size)
        ahead = ((n[:, None] >= n) & (m[:, None] <= m) & (place[:, None] < place)).sum(0)
        assert sorted(divergence.skyband(n, m, place, k).tolist()) == np.flatnonzero(ahead < k).tolist()


def test_shares_stay_exact(spark):
    big = 9 * 10 ** 17
    [row] = spark.range(1).select(divergence.share(F.lit(big), F.lit(10 * big + 7), F.lit(3)).alias("p")).collect()
    assert row.p == 1 + 1_000_000_000 * (big + 5) // (10 * big + 7 + 15)
