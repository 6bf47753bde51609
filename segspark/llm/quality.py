"""Quality rules: exact text counts and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to `2 ** bits` buckets. One multinomial is fitted
to the raw corpus (all rows), one to trusted target rows. A document's score is
the log-likelihood ratio of target against raw, divided by its number of
n-grams; it passes if the base rules hold and the score reaches the threshold.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.llm.bitmaps import bit_map, in_map
from segspark.llm.textarrays import (BYTES_AS_IS, PUNCTUATION, SPACE, U64, Texts, gram_hashes, grams_inside, mix, sliced,
                                     texts_of, word_hashes, words_of)

BITS = 16
#: Pseudo-count of each bucket.
ALPHA = 1.0
#: Score (nats per n-gram) from which a document passes.
THRESHOLD = -0.4
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _repeats(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How many earlier and later entries have the same owner and value: 1 first of several, 2 later ones, 0 single."""
    order = np.lexsort((value, owner))  # stable: equal entries stay in order
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (value[order][1:] == value[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    kind = np.zeros(len(order), np.int8)
    kind[order] = np.where(same[:-1], 2, np.where(same[1:], 1, 0))
    return kind


class Counts(NamedTuple):
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray

    def failed(self) -> np.ndarray:
        return (self.n_words < 10) | (100 * self.n_repeat_words > 20 * self.n_words)


def base_counts(texts: Texts) -> Counts:
    data, start, n = texts.data, texts.start, len(texts)
    words = words_of(texts, SPACE)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[start])
    chars = sums(~SPACE[data] & ~_CONTINUES[data])
    symbols = sums(_SYMBOL[data])

    # Lines: cut at \n and at text ends; those with a word count.
    cut = np.flatnonzero(data == 10)
    begin = np.union1d(start[:-1], cut + 1) if n else start[:0]
    begin = begin[begin < len(data)]
    stop = np.concatenate([begin[1:], [len(data)]]) if len(begin) else begin
    stop = stop - (data[stop - 1] == 10) if len(begin) else stop
    has_word = np.searchsorted(words.start, stop) > np.searchsorted(words.start, begin)
    begin, stop = begin[has_word], stop[has_word]
    lines = words._replace(start=begin, end=stop)
    line_of = np.searchsorted(start, begin, "right") - 1
    again = _repeats(line_of, word_hashes(texts, lines, BYTES_AS_IS)) == 2
    dup_lines = np.bincount(line_of[again], minlength=n)

    # Five-word windows found twice or more in a text cover their words.
    grams = gram_hashes(word_hashes(texts, words, BYTES_AS_IS), WINDOW)
    at = np.flatnonzero(grams_inside(words, WINDOW))
    owner = words.text
    twice = at[_repeats(owner[at], grams[at]) > 0]
    cover = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.subtract.at(cover, twice + WINDOW, 1)
    covered = np.cumsum(cover[:-1]) > 0
    repeat_words = np.bincount(owner[covered], minlength=n)
    return Counts(words.counts, chars, symbols, dup_lines, repeat_words)


def features(texts: Texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and the text of each: words, word pairs and runs of other characters.

    Words are runs of letters and digits, lower-cased; a run of punctuation or
    symbols is a feature by its characters, so markup and shouting leave traces.
    """
    words = words_of(texts, SPACE)
    low, owner = word_hashes(texts, words), words.text
    inside = grams_inside(words, 2)
    marks = words_of(texts, ~PUNCTUATION | SPACE)
    marked = word_hashes(texts, marks, BYTES_AS_IS)
    # The case of a word's first two bytes is a feature of its own.
    first, second = texts.data[words.start], texts.data[np.minimum(words.start + 1, max(len(texts.data) - 1, 0))]
    upper = lambda b: (b >= 0x41) & (b <= 0x5A)
    shape = mix((upper(first).astype(np.uint64) << U64(1) | upper(second).astype(np.uint64)) + U64(77))
    value = np.concatenate([low, gram_hashes(low, 2)[inside], mix(marked ^ U64(0x5bd1e995)), shape])
    of = np.concatenate([owner, owner[:len(inside)][inside], marks.text, owner])
    return (value >> U64(64 - bits)).astype(np.int64), of


class Ratio(NamedTuple):
    """log P(bucket | target) - log P(bucket | raw)."""

    weights: np.ndarray


def fit_ratio(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              bits: int = BITS) -> Ratio:
    """Multinomials of all rows of `docs` and of those whose id is in `trusted` (one id column).

    Both cover every row that is theirs. The driver gets one row for each
    bucket. Without trusted rows all weights are equal to those of raw text
    turned to zero: every score is 0.
    """
    ids = trusted.select(F.col(trusted.columns[0]).alias("__id")).filter("__id is not null").distinct()
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    named = rows.filter("__id is not null")
    if ids.schema["__id"].dataType == rows.schema["__id"].dataType:  # equal ids have equal hashes: sift texts before the exact join
        shared = docs.sparkSession.sparkContext.broadcast(bit_map(ids.select(F.xxhash64("__id").alias("h")), "h"))

        def sift(batches):
            for batch in batches:
                yield batch.filter(pa.array(in_map(shared.value, batch.column(2).to_numpy()))).select(["__id", "text"])

        named = named.withColumn("h", F.xxhash64("__id")).mapInArrow(sift, named.schema)

    def count(batches):
        n = np.zeros(1 << bits, np.int64)
        for batch in sliced(batches, "text"):
            n += np.bincount(features(texts_of(batch.column(0)), bits)[0], minlength=1 << bits)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["bucket", "n"])

    raw, target = (x.select("text").mapInArrow(count, "bucket int, n long") for x in (rows, named.join(ids.hint("merge"), "__id", "left_semi")))
    nothing = F.lit(0).cast("long")
    table = (raw.select("bucket", F.col("n").alias("raw"), nothing.alias("target"))
             .unionByName(target.select("bucket", nothing.alias("raw"), F.col("n").alias("target"))).groupBy("bucket")
             .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow())
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[table.column("bucket").to_numpy()] = table.column("raw").to_numpy()
    target[table.column("bucket").to_numpy()] = table.column("target").to_numpy()
    if not target.sum():
        return Ratio(np.zeros(1 << bits))
    share = lambda c: np.log((c + ALPHA) / (c.sum() + ALPHA * len(c)))
    return Ratio(share(target) - share(raw))


def scores(texts: Texts, ratio: Ratio) -> np.ndarray:
    """Log-likelihood ratio per n-gram; 0 for a text without any."""
    bucket, of = features(texts, int(np.log2(len(ratio.weights))))
    n = np.bincount(of, minlength=len(texts))
    return np.bincount(of, ratio.weights[bucket], len(texts)) / np.maximum(n, 1)


def judge_documents(docs: DataFrame, ratio: Ratio, threshold: float = THRESHOLD, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept) of each row.

    One row in, one row out, in place: no shuffle; NULL ids and repeated rows
    are rows like others, other columns are not read. NULL and empty texts
    have no words and fail the base rules.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # 2 ** bits numbers

    def judge(batches):
        for batch in sliced(batches, text_col):
            texts = texts_of(batch.column(1))
            base = base_counts(texts)
            failed, llr = base.failed(), scores(texts, shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(np.asarray(c, np.int64)) for c in base], pa.array(failed), pa.array(llr),
                 pa.array(~failed & (llr >= threshold))], names=schema.names)

    schema = T.StructType([docs.schema[id_col], *[T.StructField(c, T.LongType()) for c in Counts._fields],
                           T.StructField("base_failed", T.BooleanType()), T.StructField("llr", T.DoubleType()),
                           T.StructField("kept", T.BooleanType())])
    return docs.select(id_col, text_col).mapInArrow(judge, schema)
