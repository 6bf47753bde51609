"""Words, grams and windows of many texts at once, as numpy arrays over UTF-8 bytes.

A batch of texts is one byte array with the start of each text. Word patterns
whose separators are ASCII are exact on bytes, as no byte of a longer UTF-8
sequence is ASCII. Hashes are 64-bit polynomials over a fixed table of random
numbers, taken from prefix sums, so that any word or gram costs a subtraction.
Memory is about 30 bytes for each byte of a slice; a slice holds `SLICE_BYTES`
of text, or one single text that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

U64 = np.uint64
_BASE, _GRAM_BASE = 0x9E3779B97F4A7C13, 0xD6E8FEB86659FD95
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Everything but a-z, A-Z, 0-9 and non-ASCII characters.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[0x80:] = False
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    PUNCTUATION[_lo:_hi] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (one to one)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_table(lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    if lower:
        table[0x41:0x5B] = table[0x61:0x7B]
    return table


BYTES_AS_IS, BYTES_LOWER = _byte_table(False), _byte_table(True)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


_BYTE_POWERS, _GRAM_POWERS = _Powers(_BASE), _Powers(_GRAM_BASE)


class Texts(NamedTuple):
    """Texts 0..n-1: the bytes of text i are data[start[i]:start[i + 1]]. NULL is an empty text."""

    data: np.ndarray
    start: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.start[i]:self.start[i + 1]].tobytes()


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    _, offsets, data = column.buffers()
    start = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[start[0]:start[-1]], start - start[0])


def sliced(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches to about `limit` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = texts_of(batch.column(column)).start
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


class Words(NamedTuple):
    """Words of all texts in order; those of text i are first[i]..first[i + 1] - 1."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(texts: Texts, separator: np.ndarray) -> Words:
    """Maximal runs of bytes that are no separators; no run crosses from one text to the next."""
    inside = ~separator[texts.data]
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(texts.start), np.int64))
    edge = np.zeros(n + 1, bool)
    edge[texts.start] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, texts.start).astype(np.int64))


def word_hashes(texts: Texts, words: Words, table: np.ndarray = BYTES_LOWER) -> np.ndarray:
    if not len(words.start):
        return np.zeros(0, np.uint64)
    up, down = _BYTE_POWERS.upto(len(texts.data) + 1)
    sums = np.zeros(len(texts.data) + 1, np.uint64)
    np.cumsum(table[texts.data] * up[:len(texts.data)], out=sums[1:])
    return mix((sums[words.end] - sums[words.start]) * down[words.start])


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values; entry i covers i..i+n-1. Shorter input has none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = _GRAM_POWERS.upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[:len(hashes) - n + 1] + U64(n))


def whole_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash for the whole sequence of each text (0 for none)."""
    up, down = _GRAM_POWERS.upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:len(hashes)], out=sums[1:])
    lengths = np.diff(first)
    out = mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + lengths.astype(np.uint64))
    return np.where(lengths > 0, out, U64(0))


def grams_inside(words: Words, n: int) -> np.ndarray:
    """Which of the gram positions 0..len-n stay inside one text."""
    total = len(words.start)
    if total < n:
        return np.zeros(0, bool)
    last = np.repeat(words.first[1:], words.counts)  # end of the text of each word
    return np.arange(total - n + 1) + n <= last[:total - n + 1]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def shingle_sets(texts: Texts, n: int, separator: np.ndarray = SPACE, table: np.ndarray = BYTES_LOWER,
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, sorted, and the start of each text's part.

    A text of fewer words, but not none, has its whole sequence as the one shingle.
    """
    words = words_of(texts, separator)
    hashes = word_hashes(texts, words, table)
    grams, ok = gram_hashes(hashes, n), grams_inside(words, n)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    value = np.concatenate([grams[ok], whole_hashes(hashes, words.first)[short]])
    owner = np.concatenate([words.text[:len(grams)][ok], short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int64)


def whole_runs(batches, keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys, many at a time, and where each run begins; batches are sorted by the keys."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        starts = run_starts(table, keys)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
        held = table.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64)


def run_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        c = table.column(key).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def runs_of(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches sorted by the keys; a key's rows are bounded by the caller."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        for key in keys:
            c = table.column(key).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(new)])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield table.slice(lo, hi - lo)
        held = table.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held
