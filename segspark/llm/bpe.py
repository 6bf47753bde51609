"""Byte-level BPE encoding and decoding through a sentencepiece model.

The model is written directly from the rank file of a vocabulary: each piece
is the token's bytes, every byte mapped to one character; its score is minus
its rank, so sentencepiece merges the pair of lowest rank first and the
leftmost of equals, as the rank file asks. The normaliser is the identity.
Pre-tokens are cut by the pattern and encoded one by one, so that no merge
crosses a pre-token. Decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Byte b is the character of this code plus b: no character of the map is a space or a control.
BYTE_ZERO = 0x100
#: Different pre-tokens that a worker remembers with their ids before it starts anew.
REMEMBERED = 150_000
#: Characters of texts that are encoded at a time; a longer text goes in parts of as many pre-tokens.
AT_A_TIME = 500_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks 0..n-1, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [base64.b64decode(token) for token, _ in sorted(pairs, key=lambda p: int(p[1]))]
    if [int(rank) for _, rank in sorted(pairs, key=lambda p: int(p[1]))] != list(range(len(pairs))):
        raise ValueError("ranks must be 0..n-1 without gaps")
    return tokens


_CHARACTERS = "".join(chr(BYTE_ZERO + b) for b in range(256))


def as_characters(raw: bytes) -> str:
    return codecs.charmap_decode(raw, "strict", _CHARACTERS)[0]


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto (protobuf wire format) whose piece ids are the ranks.

    One piece for unknown characters follows the last rank; no text reaches
    it, as all 256 bytes must be tokens.
    """
    if len({t for t in tokens if len(t) == 1}) != 256:
        raise ValueError("the vocabulary must hold all 256 bytes")
    pieces = [_block(1, as_characters(t).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, 1)
              for rank, t in enumerate(tokens)]
    unknown = _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2)
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens))  # BPE, vocabulary size, unknown id
    for field in (41, 42, 43):  # no begin, end and padding pieces
        trainer += _number(field, (1 << 64) - 1)
    # identity; no dummy prefix, white space is neither removed nor escaped
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(_block(1, p) for p in [*pieces, unknown]) + _block(2, trainer) + _block(3, normaliser)


class Pattern(NamedTuple):
    """A pattern as two engines see it: `strict` where a text has characters from `first_odd` on, else `plain`."""

    plain: str
    strict: str
    first_odd: str


@lru_cache(maxsize=4)
def aligned_pattern(pattern: str) -> Pattern:
    """The pattern with the letters and numbers that the tiktoken library's engine knows.

    The two regular-expression engines follow different Unicode versions; the
    characters that only the one at hand takes for letters or numbers are
    subtracted. Both engines are asked about every character once, on the
    driver. Texts without such characters give the same matches either way.
    """
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    strict, first = pattern, 0x110000
    for name in (r"\p{L}", r"\p{N}"):
        there = tiktoken.Encoding("one", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs = set(there.decode(there.encode_ordinary(every)))
        ours = set(regex.findall(name, every))
        if theirs - ours:
            raise ValueError(f"{len(theirs - ours)} characters of {name} are unknown to the regex module")
        if odd := set(map(ord, ours - theirs)):
            starts, ends = sorted(c for c in odd if c - 1 not in odd), sorted(c for c in odd if c + 1 not in odd)
            spans = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))
            strict, first = strict.replace(name, f"[{name}--[{spans}]]"), min(first, starts[0])
    return Pattern(pattern, "(?V1)" + strict, chr(min(first, 0x10FFFF)))


class Form(NamedTuple):
    """A pre-token's ids, how many, each after a space, and the bytes they decode to."""

    count: int
    numbers: str
    raw: bytes
    ids: list[int]


class Codec:
    """Encoder and decoder of one process."""

    def __init__(self, model: bytes, pattern: Pattern):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.plain, self.strict = regex.compile(pattern.plain), regex.compile(pattern.strict)
        self.odd = regex.compile(f"[{pattern.first_odd}-\U0010ffff]")
        unknown = self.model.unk_id()
        self.bytes_of = [bytes(ord(c) - BYTE_ZERO for c in self.model.id_to_piece(i)) for i in range(unknown)]
        self.forms: dict[str, Form] = {}

    def pretokens(self, text: str) -> Iterator[list[str]]:
        """Matches of the pattern; of a long text some thousand at a time."""
        pattern = self.strict if self.odd.search(text) else self.plain
        if len(text) <= AT_A_TIME:
            yield pattern.findall(text)
            return
        found = (m[0] for m in pattern.finditer(text))
        while part := list(islice(found, AT_A_TIME)):
            yield part

    def encode_each(self, pretokens: list[str]) -> list[list[int]]:
        return self.model.encode([as_characters(t.encode()) for t in pretokens], num_threads=1)

    def decode(self, ids: list[int]) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])

    def learn(self, parts: list[list[str]]) -> None:
        """Encode and decode what is not yet remembered of these pre-tokens."""
        if len(self.forms) > REMEMBERED:
            self.forms.clear()
        if new := list(set().union(*parts).difference(self.forms)):
            for t, ids in zip(new, self.encode_each(new)):
                self.forms[t] = Form(len(ids), "".join([f" {i}" for i in ids]), self.decode(ids), ids)

    def forms_of(self, texts: list[str]) -> Iterator[tuple[int, list[Form]]]:
        """(number of the text, forms of its pre-tokens), in order; a long text comes in several parts."""
        group, size = [], 0
        for k, text in enumerate(texts):
            for part in self.pretokens(text):
                group.append((k, part))
                size += len(text)
                if size >= AT_A_TIME:
                    yield from self._flush(group)
                    group, size = [], 0
        yield from self._flush(group)

    def _flush(self, group: list[tuple[int, list[str]]]) -> Iterator[tuple[int, list[Form]]]:
        self.learn([part for _, part in group])
        known = self.forms
        for k, part in group:
            yield k, [known[t] for t in part]


@lru_cache(maxsize=2)
def _codec(model: bytes, pattern: Pattern) -> Codec:
    return Codec(model, pattern)


def _model(df: DataFrame, vocabulary: str):
    # About 1 MB: as large as the vocabulary file, whatever the corpus.
    return df.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(vocabulary)))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row; NULL and empty texts have no ids.

    One row in, one row out, in place: no shuffle. Repeated rows and NULL ids
    are rows like others, other columns are not read. Characters that the
    pattern does not match are left out, as by tiktoken.
    """
    model, pattern = _model(docs, vocabulary), aligned_pattern(pattern)

    def encode(batches):
        codec = _codec(model.value, pattern)
        for batch in batches:
            ids = [[] for _ in range(batch.num_rows)]
            for k, forms in codec.forms_of([t or "" for t in batch.column(1).to_pylist()]):
                ids[k].extend(i for form in forms for i in form.ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(id_col, text_col).mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
                     ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) of each row of ids; NULL decodes to no bytes."""
    model, pattern = _model(encoded, vocabulary), aligned_pattern(pattern)

    def decode(batches):
        codec = _codec(model.value, pattern)
        for batch in batches:
            raw = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[id_col, "decoded"])

    schema = T.StructType([encoded.schema[id_col], T.StructField("decoded", T.BinaryType())])
    return encoded.select(id_col, ids_col).mapInArrow(decode, schema)


def round_trip_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, decode, digest of both.

    Ids and decoded bytes go into the digests part by part, so a text of any
    length needs the memory of the text itself.
    """
    model, pattern = _model(docs, vocabulary), aligned_pattern(pattern)

    def digest(batches):
        codec = _codec(model.value, pattern)
        for batch in batches:
            counts = [0] * batch.num_rows
            of_ids, of_bytes = ([hashlib.sha256() for _ in counts] for _ in range(2))
            for k, forms in codec.forms_of([t or "" for t in batch.column(1).to_pylist()]):
                if forms:
                    n, numbers, raw, _ = zip(*forms)
                    numbers = "".join(numbers)
                    of_ids[k].update((numbers if counts[k] else numbers[1:]).encode())
                    of_bytes[k].update(b"".join(raw))
                    counts[k] += sum(n)
            id_sums, byte_sums = ([x.hexdigest() for x in sums] for sums in (of_ids, of_bytes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(byte_sums, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.forms.clear()  # the process goes on to other work

    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(id_col, text_col).mapInArrow(digest, schema)
