"""Spelling variants of words: groups of words one edit apart, each led to its most frequent form.

Two words that differ by one inserted, deleted or replaced code point have letter
multisets that, read as binary vectors over (code point, occurrence), are at most
two bits apart: one bit if a code point was inserted, two if it was replaced.
PartEnum signatures find such vectors: the dimensions are dealt to `PARTS` parts,
and of vectors at most k bits apart all but k parts agree somewhere among the
ways to leave out k of them. Words that have a signature in common are joined
and held against each other letter by letter.

Anagrams agree in all parts, so signatures also carry the half of the word that
an edit leaves alone: everything before or everything after its middle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.batches import pieces, small_batches, summed_in_task
from segspark.llm.textarrays import BYTES_LOWER, SPACE, U64, Texts, mix, sliced, texts_of, word_hashes, words_of
from segspark.runtime import materialize, require_columns

MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: Of equally long words two bits may differ, of others one: parts of the vector, and how many a signature leaves out.
PARTS = {"same": (4, 2), "longer": (2, 1)}
#: One in so many runs, by checksum, loses a letter.
DAMAGED = 199

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each stretch start..end, going on from the checksum `before` it."""
    lengths = end - start
    order = np.argsort(-lengths, kind="stable")
    begin, length = start[order], lengths[order]
    c = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    long = int(np.searchsorted(-length, -_LONG, "left"))  # longer ones than _LONG one by one
    for j in range(min(_LONG, int(length.max(initial=0)))):
        active = slice(long, int(np.searchsorted(-length, -j, "left")))
        c[active] = _CRC[(c[active] ^ data[begin[active] + j]) & np.uint32(255)] ^ (c[active] >> np.uint32(8))
    out = np.empty(len(start), np.uint32)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[start[i]:end[i]].tobytes(), int(before[i]))
    return out


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n): occurrences of words in `rows` (id as text, text), summed in each task as far as memory allows."""

    def slices(batches):
        for batch in sliced(batches, "text"):
            texts = texts_of(batch.column(1))
            # Letters, and U+00C0 to U+00FF, which UTF-8 writes as C3 and one byte.
            high = texts.data == 0xC3
            inside = _LETTER[texts.data] | high
            inside[1:] |= high[:-1]
            texts = Texts(np.where(inside, _LOWER[texts.data], np.uint8(0x20)), texts.start)
            words = words_of(texts, SPACE)
            second = np.concatenate([[0], np.cumsum((texts.data & 0xC0) == 0x80)])
            letters = words.end - words.start - (second[words.end] - second[words.start])
            use = np.flatnonzero(letters >= MIN_LETTERS)
            if not len(use):
                continue
            start, end, letters = words.start[use], words.end[use], letters[use]
            prefix = np.array([zlib.crc32(f"{i or ''}:".encode()) for i in batch.column(0).to_pylist()], np.uint32)
            h = checksums(texts.data, start, end, prefix[words.text[use]])
            hit = h % DAMAGED == 0
            damaged = Counter()
            for i in np.flatnonzero(hit & (letters > MIN_LETTERS)).tolist():
                run, k = texts.data[start[i]:end[i]].tobytes().decode(), int(h[i]) % int(letters[i])
                damaged[run[:k] + run[k + 1:]] += 1
            hashes = word_hashes(texts, words._replace(start=start[~hit], end=end[~hit]), BYTES_LOWER)
            _, first, n = np.unique(hashes, return_index=True, return_counts=True)
            whole = pieces(texts.data, start[~hit][first], end[~hit][first])
            yield pa.table({"word": pa.concat_arrays([whole, pa.array(list(damaged), pa.string())]),
                            "n": pa.array(np.concatenate([n, np.fromiter(damaged.values(), np.int64, len(damaged))]))})

    return rows.mapInArrow(lambda batches: summed_in_task(slices(batches), ["word"], ["n"]), "word string, n long")


def _vectors(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, the word of each, and a hash of (code point, how many of it came before in the word)."""
    text = words.to_pylist()
    points = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(text)), [len(w) for w in text])
    order = np.lexsort((points, owner))
    new = np.ones(len(order), bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (points[order][1:] != points[order][:-1])
    at = np.flatnonzero(new)
    nth = np.empty(len(order), np.uint64)
    nth[order] = np.arange(len(order)) - np.repeat(at, np.diff(np.concatenate([at, [len(order)]])))
    return points, owner, mix(points * U64(0x9E3779B97F4A7C15) + nth + U64(1))


def signatures(words: pa.Array) -> list[tuple[str, np.ndarray]]:
    """(role, keys of all words) for each signature; roles: same, and shorter with longer by one code point."""
    points, owner, bits = _vectors(words)
    n = len(words)
    length = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(length)])
    place = (np.arange(len(points)) - first[owner]).astype(np.uint64)

    def total(values):  # sums modulo 2 ** 64 per word
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return upto[first[1:]] - upto[first[:-1]]

    out = []
    for kind, (parts, without) in PARTS.items():
        part = ((bits >> U64(40)) % U64(parts)).astype(np.int64)
        sums = [total(np.where(part == p, bits, U64(0))) for p in range(parts)]
        for role, less in ((kind, 0),) if kind == "same" else (("shorter", 0), ("longer", 1)):
            size = (length - less).astype(np.uint64)  # of the shorter word, which says where the middle is
            half = size >> U64(1)
            head = total(np.where(place < half[owner], mix(points + (place << U64(32))), U64(0)))
            # After the middle, counted from the end: what an edit before it leaves alone.
            back = length[owner].astype(np.uint64) - place
            tail = total(np.where(back <= (size - half)[owner], mix(points + (back << U64(32)) + U64(1 << 63)), U64(0)))
            for chosen in combinations(range(parts), parts - without):
                agree = np.zeros(n, np.uint64)
                for p in chosen:
                    agree = mix(agree + sums[p] + U64(p + 1))
                # Which parts, of which kind of pair, for words of which size, and which half.
                label = (size << U64(9)) + U64(sum(1 << p for p in chosen) << 2 | (kind == "same") << 1)
                out += [(role, mix(mix(agree + side) + label + U64(s)).view(np.int64)) for s, side in enumerate((head, tail))]
    return out


def _postings(words: DataFrame) -> DataFrame:
    """(role, key, word, n): each word under each of its signatures."""

    def post(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                for role, keys in signatures(part.column(0)):
                    yield pa.RecordBatch.from_arrays([pa.array([role] * part.num_rows), pa.array(keys), part.column(0), part.column(1)],
                                                     names=["role", "key", "word", "n"])

    return words.select("word", "n").mapInArrow(post, "role string, key long, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): words of `words` (word, n; distinct) one edit apart, each pair once."""
    posted = materialize(_postings(words))
    side = lambda role, name: posted.filter(F.col("role") == role).select("key", F.col("word").alias(name), F.col("n").alias(f"{name}_n"))
    same = side("same", "a").join(side("same", "b"), "key").filter("a < b")
    longer = side("shorter", "a").join(side("longer", "b"), "key")
    return same.unionByName(longer).filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def roots_of(forms: DataFrame, largest: int, smallest: int, ratio: int) -> DataFrame:
    """(word, root) of each row (word, form), following forms to the last.

    A form is `ratio` times as frequent as its word, which bounds the steps;
    each round doubles them.
    """
    steps = 1
    while smallest * ratio ** (steps + 1) <= largest:
        steps += 1
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(steps)) if steps > 1 else 0):
        roots = materialize(roots)
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("last"))
        roots = roots.join(after, "root", "left").select("word", F.coalesce("last", "root").alias("root"))
    return roots


def group_variants(docs: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of `docs`.

    Words are the runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased,
    with at least `MIN_LETTERS` code points and `min_count` occurrences. Of a run
    whose crc32 of `<id>:<run>` is divisible by `DAMAGED` one code point is
    left out, the one at the checksum modulo the length. n_near words are one
    edit apart; form is the most frequent of them (ties: the smallest by code
    points) if it is `ratio` times as frequent as the word, root the end of the
    chain of forms, or the word itself. NULL texts have no words, a NULL id is
    read as ''; repeated rows count again; other columns are not read. Without
    words the result is empty. Runs jobs while it is built.
    """
    require_columns(docs, id_col, text_col)
    if ratio < 2 or min_count < 1:
        raise ValueError("a form must be at least twice as frequent as its word")
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession, 2000):
        words = materialize(count_words(rows).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))
        pairs = materialize(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    known = words.join(near, "word", "left")
    has = -F.col("best.n") >= F.col("n") * ratio
    named = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.other")).alias("form"),
                                     F.when(has, -F.col("best.n")).alias("form_n")))
    forms = named.filter("form is not null")
    largest = named.agg(F.max("n")).first()[0] or 0
    return (named.join(roots_of(forms, largest, min_count, ratio), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
