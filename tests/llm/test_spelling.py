import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from segspark.llm import batches, spelling
from tests.llm.helpers import LOWER, ODD, documents, rows_of


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, min_count=5, ratio=5):
    count = Counter()
    for key, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += len(run) >= 6
    words = {w: n for w, n in count.items() if n >= min_count}
    out, forms = {}, {}
    for w, n in words.items():
        others = [v for v in words if abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] < ratio * n:
            best = None
        forms[w] = best
        out[w] = n, len(others), best
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        yield w, out[w][2], root, out[w][0], out[w][1], words.get(out[w][2])


def compare(spark, rows, **options):
    key = lambda r: r[0]
    got = sorted((tuple(r.values()) for r in rows_of(spelling.group_variants(documents(spark, rows), **options))), key=key)
    assert got == sorted(plain([r[:2] for r in rows], **options), key=key)
    return got


def corpus(n, letters, seed):
    draw = random.Random(seed)
    stems = ["".join(draw.choices(letters, k=draw.randint(6, 9))) for _ in range(40)]
    weights = [5 ** draw.randint(0, 5) for _ in stems]

    def spoilt(w):
        i = draw.randrange(len(w))
        return draw.choice([w, w, w, w[:i] + draw.choice(letters) + w[i:], w[:i] + w[i + 1:], w[:i] + draw.choice(letters) + w[i + 1:]])

    return [(k, " ".join(spoilt(spoilt(w)) for w in draw.choices(stems, weights, k=300))) for k in range(n)]


@pytest.mark.parametrize("letters", ["ab", "abcdeÀÿ÷"])
def test_as_brute_force(spark, letters):
    got = compare(spark, corpus(60, letters, 5))
    assert sum(r[1] is not None for r in got) > 20 and any(r[1] != r[2] for r in got if r[1])


def test_odd_rows(spark, monkeypatch):
    rows = [*ODD, (7, "Straße_STRASSE-straße " * 9), (7, "Straße_STRASSE-straße " * 9), (None, "strabe " * 60), (8, "Ā" + "ÀÁÂÃÄÅ " * 5 + "×÷×÷×÷ " * 5), (9, "q" * 200 + " " + "r" * 64)]
    assert compare(spark, rows)
    assert compare(spark, rows, min_count=1, ratio=2)
    assert compare(spark, [(1, None)]) == [] == rows_of(spelling.group_variants(documents(spark, rows).limit(0)))
    monkeypatch.setattr(batches, "HELD_ROWS", 8)
    assert compare(spark, rows, min_count=1)


def test_checksums():
    draw = random.Random(2)
    words = [bytes(draw.choices(range(256), k=draw.choice([0, 1, 5, 63, 64, 65, 300]))) for _ in range(200)]
    ends = np.cumsum([len(w) for w in words])
    before = np.array([zlib.crc32(f"{k}:".encode()) for k in range(200)], np.uint32)
    got = spelling.checksums(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends, before)
    assert got.tolist() == [zlib.crc32(f"{k}:".encode() + w) for k, w in enumerate(words)]


def test_every_edit_shares_a_signature():
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcé", k=draw.randint(6, 12)))
    for _ in range(300):
        a = word()
        i = draw.randrange(len(a) + 1)
        b = draw.choice([a[:i] + "x" + a[i:], a[:i] + "y" + a[i + 1:] if i < len(a) else a + "y"])
        keys = [{(role, int(k[j])) for role, k in spelling.signatures(pa.array([a, b]))} for j in (0, 1)]
        if len(a) == len(b):
            assert {k for r, k in keys[0] if r == "same"} & {k for r, k in keys[1] if r == "same"}
        else:
            assert {k for r, k in keys[0] if r == "shorter"} & {k for r, k in keys[1] if r == "longer"}
