"""How the sources of a language differ in their use of terms.

Terms are counted in the scan; a language keeps those that enough of its
documents have. A group (language, source) or a whole language gives each kept
term a smoothed whole-number share p of `SCALE`. Two reports come of it: the
distance of each two sources of a language, summed over all kept terms, and the
terms that a source has most beyond its language.

The second is ranked by a dominance skyband. A term that occurs at least as often
in the group, at most as often in the language and comes earlier by its UTF-8
bytes ranks before another, whatever the totals are. So partitions keep only the
terms that fewer than k others dominate, skybands are merged the same way, and
what is left is ranked exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.llm.batches import pieces, small_batches, summed_in_task
from segspark.llm.textarrays import BYTES_LOWER, sliced, texts_of, word_hashes, words_of
from segspark.runtime import materialize, require_columns

MIN_DOCS, TOP = 30, 50
SCALE, EXTRA = 1_000_000_000, 5
#: Rows that a task holds back before it reduces them to their skyband; cells of a language that are compared in one task.
HELD_ROWS, CELLS = 1 << 17, 1 << 15

#: Everything but letters a-z, A-Z and non-ASCII characters.
NO_LETTER = np.zeros(256, bool)
for _lo, _hi in ((0x00, 0x41), (0x5B, 0x61), (0x7B, 0x80)):
    NO_LETTER[_lo:_hi] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + EXTRA) / (total + EXTRA * kinds)), exact for any count below 10 ** 18."""
    up = (count + EXTRA).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", up, (total + kinds * EXTRA).cast("decimal(19,0)")) + 1


def count_terms(rows: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): counts of the terms of `rows` (lang, source, text), summed in each task as far as memory allows."""

    def slices(batches):
        for batch in sliced(batches, "text"):
            texts = texts_of(batch.column(2))
            groups = pa.StructArray.from_arrays(batch.columns[:2], names=["lang", "source"])
            names: dict = {}
            group = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in groups.to_pylist()], np.int64)
            words = words_of(texts, NO_LETTER)
            if not len(words.start):
                continue
            text, hashes = words.text, word_hashes(texts, words, BYTES_LOWER)
            order = np.lexsort((text, hashes, group[text]))
            g, h, t = group[text][order], hashes[order], text[order]
            new = np.ones(len(order), bool)
            new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
            new_doc = new.copy()
            new_doc[1:] |= t[1:] != t[:-1]
            at = np.flatnonzero(new)
            first = order[at]
            term = pieces(_LOWER[texts.data], words.start[first], words.end[first])
            keys = list(names)
            of = pa.array(g[at])
            columns = [pa.array([k[i] for k in keys], pa.string()).take(of) for i in (0, 1)]
            yield pa.Table.from_arrays([*columns, term, pa.array(np.diff(np.concatenate([at, [len(order)]]))),
                                              pa.array(np.add.reduceat(new_doc.astype(np.int64), at))], names=["lang", "source", "term", "n", "docs"])

    return rows.mapInArrow(lambda batches: summed_in_task(slices(batches), ["lang", "source", "term"], ["n", "docs"]),
                           "lang string, source string, term string, n long, docs long")


def kept_cells(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of terms in at least `min_docs` documents of the language; `first` marks one row of each term."""
    # Tasks have counted before the shuffle, and one exchange serves all steps.
    cells = count_terms(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    wide = cells.select("*", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("lang_docs"),
                        (F.row_number().over(term.orderBy("source")) == 1).alias("first"))
    return wide.filter(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "first")


def skyband(n: np.ndarray, lang_n: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Rows that fewer than k others dominate: n at least, lang_n at most as large, and an earlier place (places differ).

    All who dominate a row come before it by (n falling, lang_n, place), and the
    first k of them are in the skyband themselves; so counting there is enough.
    """
    order = np.lexsort((place, lang_n, -n))
    kept = np.empty(len(order), np.int64)
    kept_n, kept_place, m = np.empty(len(order), np.int64), np.empty(len(order), np.int64), 0
    for lo in range(0, len(order), 256):
        block = order[lo:lo + 256]
        before = ((kept_n[:m] <= lang_n[block][:, None]) & (kept_place[:m] < place[block][:, None])).sum(1)
        start = m
        for row, count in zip(block.tolist(), before.tolist()):
            if count < k and count + np.count_nonzero((kept_n[start:m] <= lang_n[row]) & (kept_place[start:m] < place[row])) < k:
                kept[m], kept_n[m], kept_place[m] = row, lang_n[row], place[row]
                m += 1
    return kept[:m]


_BAND = "lang string, source string, term string, n long, lang_n long"


def skybands(cells: DataFrame, k: int = TOP) -> DataFrame:
    """The rows (lang, source, term, n, lang_n) of each partition that fewer than k of their group in it dominate."""

    def reduce(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        group = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in ("lang", "source")], names=["lang", "source"])
        names: dict = {}
        of = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in group.to_pylist()], np.int64)
        place = np.empty(table.num_rows, np.int64)
        place[pc.sort_indices(table.column("term").cast(pa.binary())).to_numpy()] = np.arange(table.num_rows)
        n, lang_n = table.column("n").to_numpy(), table.column("lang_n").to_numpy()
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(names) + 1))
        rows = [order[lo:hi][skyband(n[order[lo:hi]], lang_n[order[lo:hi]], place[order[lo:hi]], k)] for lo, hi in zip(cuts[:-1], cuts[1:])]
        return table.take(pa.array(np.concatenate(rows)))

    def band(batches):
        held, n, base = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                n += batch.num_rows
            if n >= base + HELD_ROWS:
                held = [reduce(pa.concat_tables(held))]
                n = base = held[0].num_rows
        if held:
            yield from reduce(pa.concat_tables(held)).to_batches()

    return cells.select("lang", "source", "term", "n", "lang_n").mapInArrow(band, _BAND)


def _distances(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language: |p - q| summed over all kept terms.

    Cells are dealt by term to buckets of about `CELLS`; the groups of the
    language go to each of its buckets, so that a term's missing sources have
    their share too.
    """
    buckets = groups.select("lang", "source", "total", "kinds", "buckets", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    none = F.lit(None)
    dealt = (cells.join(groups.select("lang", "source", "total", "kinds", "buckets"), ["lang", "source"])
             .select("lang", F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"), "source", "term",
                     share(F.col("n"), F.col("total"), F.col("kinds")).alias("p")))
    both = dealt.unionByName(buckets.select("lang", "bucket", "source", none.cast("string").alias("term"),
                                            F.when(F.col("kinds") > 0, share(F.lit(0), F.col("total"), F.col("kinds"))).otherwise(0).alias("p")))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        bare = pc.is_null(table.column("term"))
        sources, cells_ = table.filter(bare), table.filter(pc.invert(bare))
        names = sources.column("source").combine_chunks()
        zero = sources.column("p").to_numpy()
        s = len(names)
        row = pc.index_in(cells_.column("source"), names).to_numpy()
        terms = cells_.column("term").combine_chunks().dictionary_encode()
        term, kinds, p = terms.indices.to_numpy(), len(terms.dictionary), cells_.column("p").to_numpy()
        order = np.argsort(term, kind="stable")
        row, term, p = row[order], term[order], p[order]
        step = max(1, (1 << 21) // max(s, 1))
        sums = [np.zeros(s - i - 1, np.int64) for i in range(s)]
        for lo in range(0, kinds, step):  # dense tables of up to 2 M shares, sources by terms
            here = slice(*np.searchsorted(term, [lo, lo + step]))
            dense = np.repeat(zero[:, None], min(step, kinds - lo), 1)
            dense[row[here], term[here] - lo] = p[here]
            for i in range(s - 1):
                sums[i] += np.abs(dense[i + 1:] - dense[i]).sum(1)
        a = np.repeat(np.arange(s), np.arange(s)[::-1])
        b = np.concatenate([np.arange(i + 1, s) for i in range(s)]) if s else a
        lang = pa.array([table.column("lang")[0].as_py()] * len(a), pa.string())
        return pa.Table.from_arrays([lang, names.take(pa.array(a)), names.take(pa.array(b)), pa.array(np.concatenate(sums) if s else a)], schema=schema)

    parts = both.groupBy("lang", "bucket").applyInArrow(compare, "lang string, source string, item string, value long")
    each = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return each.unionByName(each.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of each group (lang, source) of `docs`.

    Part `pair` ranks the other sources of the language by the distance of their
    shares, all of them; part `term` ranks the terms whose share in the group is
    above that in the language by the difference, up to `top`. Ranks go by
    falling value, then by the item's UTF-8 bytes. NULL text, lang and source
    are read as ''; a group without terms has pairs, and a language without kept
    terms pairs of value 0. Repeated rows are documents of their own, other
    columns are not read; an empty table gives an empty report. Runs jobs while
    it is built.
    """
    require_columns(docs, text_col, lang_col, source_col)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    with small_batches(docs.sparkSession, 2000):
        cells = materialize(kept_cells(rows, min_docs))
    langs = cells.groupBy("lang").agg(F.count_if("first").alias("kinds"), F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("cells"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = materialize(rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
                         .select("lang", "source", zero("total"), zero("kinds"), zero("lang_total"),
                                 (F.floor(F.coalesce("cells", F.lit(0)) / CELLS) + 1).alias("buckets")))
    pairs = _distances(cells, groups).withColumn("part", F.lit("pair"))

    # First in the partitions that terms were dealt to, then in a few for each group, then all that is left.
    local = materialize(skybands(cells, top).withColumn("part", F.spark_partition_id()))
    merged = skybands(local.repartition("lang", "source", F.floor(F.sqrt("part"))), top)
    more = share(F.col("n"), F.col("total"), F.col("kinds")) - share(F.col("lang_n"), F.col("lang_total"), F.col("kinds"))
    terms = (merged.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), more.alias("value"), F.lit("term").alias("part"))
             .filter("value > 0"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = (terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
              .unionByName(pairs.withColumn("rank", F.row_number().over(best))))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
