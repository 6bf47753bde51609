"""Benchmark decontamination by winnowing.

A benchmark window is 13 consecutive words of an item (a shorter item is one
window). Of the k-gram hashes in each window the minimum is a fingerprint, so
any text that holds a whole window holds its fingerprint too. Document
fingerprints are matched with those of the benchmark and each match is extended
word by word to both sides; matches that span a window are hits.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.llm.bitmaps import bit_map, in_map
from segspark.llm.textarrays import (PUNCTUATION, U64, Texts, gram_hashes, mix, sliced, sliding_min, texts_of, word_hashes,
                                     words_of)
from segspark.runtime import materialize

WINDOW = 13


class Scheme(NamedTuple):
    """How windows of `size` words are fingerprinted: minimum of the k-grams that fit into one."""

    size: int

    @property
    def k(self) -> int:
        return (self.size + 1) // 2

    @property
    def spread(self) -> int:
        return self.size - self.k + 1


class Prints(NamedTuple):
    text: np.ndarray  # number of the text
    at: np.ndarray  # word where the gram starts, counted inside the text
    value: np.ndarray
    around: np.ndarray  # (prints, spread - 1 + size) word hashes; `outside` beyond the text


def fingerprints(texts: Texts, scheme: Scheme, only=None, outside: int = 0) -> tuple[np.ndarray, Prints]:
    """Word counts of the texts, and the winnowed grams of all windows of `scheme.size` words.

    `only(values)` says which prints are wanted. Of equal minima all are taken.
    """
    words = words_of(texts, PUNCTUATION)
    hashes, owner = word_hashes(texts, words), words.text
    k, spread = scheme.k, scheme.spread
    grams = mix(gram_hashes(hashes, k) + U64(scheme.size))
    if len(hashes) < scheme.size:
        chosen = np.zeros(0, np.int64)
    else:
        floor = sliding_min(grams, spread)
        inside = owner[:len(floor)] == owner[scheme.size - 1:]
        floor = np.where(inside, floor, U64(0))  # no window across texts
        edge = np.zeros(spread - 1, np.uint64)
        most = ~sliding_min(~np.concatenate([edge, floor, edge]), spread)  # largest minimum of the windows around
        chosen = np.flatnonzero((most == grams) & (most > 0))
        if only is not None:
            chosen = chosen[only(grams[chosen])]
    index = chosen[:, None] + np.arange(-(spread - 1), scheme.size)[None, :]
    safe = np.clip(index, 0, max(len(hashes) - 1, 0))
    if len(chosen):
        same = (index == safe) & (owner[safe] == owner[chosen][:, None])
        around = np.where(same, hashes[safe], U64(outside))
    else:
        around = np.zeros(index.shape, np.uint64)
    return words.counts, Prints(owner[chosen], chosen - words.first[owner[chosen]], grams[chosen], around)


def item_sizes(items: DataFrame, text_col: str = "text") -> list[int]:
    """Window sizes that the items need: 13, and the lengths of shorter items."""

    def sizes(batches):
        found: set[int] = set()
        for batch in sliced(batches, text_col):
            counts = words_of(texts_of(batch.column(0)), PUNCTUATION).counts
            found |= set(np.minimum(counts, WINDOW)[counts > 0].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], names=["size"])

    rows = items.select(text_col).mapInArrow(sizes, "size int").distinct().toArrow()  # at most 13
    return sorted({WINDOW, *rows.column("size").to_pylist()})


PRINT = [T.StructField("size", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("value", T.LongType()),
         T.StructField("around", T.ArrayType(T.LongType()))]


def _prints_table(prints: Prints, size: int) -> list[pa.Array]:
    width = prints.around.shape[1]
    flat = pa.array(prints.around.reshape(-1).view(np.int64))
    around = pa.ListArray.from_arrays(np.arange(len(prints.at) + 1, dtype=np.int32) * width, flat)
    return [pa.array(np.full(len(prints.at), size, np.int32)), pa.array(prints.at.astype(np.int64)),
            pa.array(prints.value.view(np.int64)), around]


def item_prints(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, size, value, around) for each fingerprint of each item; repeated ones once."""
    kind = items.schema[id_col].dataType

    def prints(batches):
        for batch in sliced(batches, text_col):
            texts, ids = texts_of(batch.column(1)), batch.column(0)
            counts = words_of(texts, PUNCTUATION).counts
            for size in np.unique(np.minimum(counts, WINDOW)).tolist():
                if not size:
                    continue
                # 1 beyond an item, 0 beyond a document: neither equals the other or, but by chance, a word.
                _, found = fingerprints(texts, Scheme(size), outside=1)
                mine = (np.minimum(counts, WINDOW) == size)[found.text]
                found = Prints(*(x[mine] for x in found))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(found.text)), *_prints_table(found, size)],
                                                 names=["item", "size", "at", "value", "around"])

    schema = T.StructType([T.StructField("item", kind), *PRINT])
    return items.select(id_col, text_col).mapInArrow(prints, schema).drop("at").distinct()


def document_prints(docs: DataFrame, sizes: list[int], bits: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, row_key, n_words, prints) of each row; of its fingerprints those whose bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def prints(batches):
        def wanted(values):
            return in_map(shared.value, values)

        for batch in sliced(batches, text_col):
            texts = texts_of(batch.column(1))
            parts = []
            for size in sizes:
                counts, found = fingerprints(texts, Scheme(size), wanted)
                parts.append((found.text, _prints_table(found, size)))
            owner = np.concatenate([p[0] for p in parts])
            order = np.argsort(owner, kind="stable")
            columns = [pa.concat_arrays([p[1][k] for p in parts]).take(pa.array(order)) for k in range(4)]
            offsets = np.searchsorted(owner[order], np.arange(len(texts) + 1)).astype(np.int32)
            rows = pa.StructArray.from_arrays(columns, names=["size", "at", "value", "around"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts.astype(np.int64)),
                                              pa.ListArray.from_arrays(offsets, rows)], names=[id_col, "row_key", "n_words", "prints"])

    schema = T.StructType([docs.schema[id_col], T.StructField("row_key", T.LongType()), T.StructField("n_words", T.LongType()),
                           T.StructField("prints", T.ArrayType(T.StructType(PRINT)))])
    return docs.select(id_col, text_col, F.xxhash64(id_col, text_col).alias("row_key")).mapInArrow(prints, schema)


def _extend(batches):
    """Rows whose matching words, left and right of the gram, span a window: (row, item, lo, hi)."""
    for batch in batches:
        t = pa.table(batch)
        for size in np.unique(t.column("size").to_numpy()).tolist():
            part = t.filter(pa.compute.equal(t.column("size"), size)).combine_chunks()
            scheme = Scheme(size)
            n, width, left = part.num_rows, scheme.spread - 1 + size, scheme.spread - 1
            a, b = (part.column(c).combine_chunks().flatten().to_numpy().reshape(n, width) for c in ("around", "item_around"))
            same = a == b
            before = np.cumprod(same[:, :left][:, ::-1], axis=1).sum(1)
            after = np.cumprod(same[:, left:], axis=1).sum(1)
            hit = before + after >= size
            at = part.column("at").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [part.column("row").filter(pa.array(hit)).combine_chunks(), part.column("item").filter(pa.array(hit)).combine_chunks(),
                 pa.array((at - before)[hit]), pa.array((at + after)[hit])], names=["row", "item", "lo", "hi"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated, row_key) of each row of `docs`; row_key is xxhash64 of id and text.

    A word is hit if it lies in an occurrence of a window of an item; a
    document is contaminated if at least one in 20 of its words is hit. `items`
    lists the ids of items with occurring windows, sorted as text. Each row of
    `docs` is judged by itself, so repeated rows and NULL ids are rows like
    others; NULL and empty texts have no words and are clean. Items without
    words hit nothing, items without an id hit words but are not listed, items
    with equal ids count once. Without items every document is clean.

    Only fingerprints whose bit is set in a map of fixed size leave the scan;
    they are joined by value, where Spark splits a frequent one.
    """
    wanted = materialize(item_prints(items, item_col, item_text_col))
    bits = bit_map(wanted, "value")
    found = materialize(document_prints(docs, item_sizes(items, item_text_col), bits, id_col, text_col)
                        .withColumn("row", F.monotonically_increasing_id()))
    mine = found.select("row", F.explode("prints").alias("p")).select("row", "p.*")
    both = mine.join(wanted.withColumnRenamed("around", "item_around"), ["size", "value"])
    kind = items.schema[item_col].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("item", kind), T.StructField("lo", T.LongType()),
                           T.StructField("hi", T.LongType())])
    hits = materialize(both.select("row", "item", "size", "at", "around", "item_around").mapInArrow(_extend, schema))
    # Union of the spans of one document: what each adds beyond the furthest end so far.
    earlier = Window.partitionBy("row").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("row", "lo", "hi").distinct().withColumn("reached", F.coalesce(F.max("hi").over(earlier), F.lit(0)))
    n_hit = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "reached"))).alias("n_hit"))
    listed = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    out = found.drop("prints").join(n_hit, "row", "left").join(listed, "row", "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col(id_col), "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
                      names.alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "row_key")
