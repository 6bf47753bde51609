import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from segspark.llm import bpe
from tests.llm.helpers import ODD, documents, rows_of

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.serialise_model(bpe.read_ranks(PATH)), bpe.aligned_pattern(P.PATTERN))


def ids(codec, text):
    return [i for _, forms in codec.forms_of([text]) for f in forms for i in f.ids]


def test_random_texts_as_the_library(codec, reference):
    draw = random.Random(3)
    for _ in range(400):
        text = "".join(chr(draw.choice([draw.randrange(1, 0x250), draw.randrange(0x250, 0xD7FF), draw.randrange(0x10000, 0x110000)]))
                       for _ in range(50))
        assert ids(codec, text) == reference.encode_ordinary(text)
        assert codec.decode(ids(codec, text)) == text.encode()


def test_texts_in_parts(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "AT_A_TIME", 40)
    text = "It's 12 o'clock;  don't wait\n\n <|endoftext|> " * 20
    assert ids(codec, text) == reference.encode_ordinary(text)


def test_vocabulary_must_hold_all_bytes():
    with pytest.raises(ValueError):
        bpe.serialise_model([b"a", b"b"])


def test_odd_rows(spark, reference):
    docs = documents(spark, ODD)
    got = rows_of(bpe.round_trip_digests(docs, PATH, P.PATTERN))
    want = []
    for k, text, *_ in [tuple(r) for r in docs.collect()]:
        n = reference.encode_ordinary(text or "")
        want.append((k, len(n), hashlib.sha256(" ".join(map(str, n)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r.values())) for r in got)
    assert bpe.round_trip_digests(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_encode_then_decode(spark):
    docs = documents(spark, ODD)
    encoded = bpe.encode_documents(docs, PATH, P.PATTERN)
    back = rows_of(bpe.decode_documents(encoded, PATH, P.PATTERN))
    assert sorted(str((r["doc_id"], bytes(r["decoded"]))) for r in back) == sorted(str((r[0], (r[1] or "").encode())) for r in docs.collect())
