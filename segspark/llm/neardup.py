"""Near-duplicate documents by an inverted join on MinHash coordinates.

A document's set is that of its distinct 4-word shingles. Documents with equal
sets are one class. A class has `COORDINATES` minima and is posted under each of
the first `PREFIX` coordinate-value pairs. Classes that share a posting count
how many coordinates agree; pairs from `MATCHES` on are checked on their full
sets.

Links are taken in two rounds. First every class is held against the first
class of each of its lists, which joins most of a large group at once. Classes
of lists that still hold several components are posted again under triples of
coordinates, three of each group of four: a pair that agrees on fewer is
skipped unseen. Those lists are compared inside, in blocks of bounded size, and
only pairs across components go on, each at the first triple it shares; where
they crowd, their sets are brought to the block and only links that join its
components leave it. So no group emits all its pairs, and no link between components is left out but by
the chance that MinHash has: a pair at the similarity bound has no list in
common in the first round with probability 0.2 ** 16, none in the second with
0.18 ** 8 = 1e-6, and fewer than 36 of 64 matches with 1e-6.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.llm.batches import small_batches
from segspark.llm.bitmaps import bit_map, in_map
from segspark.llm.components import connected
from segspark.llm.textarrays import U64, mix, runs_of, shingle_sets, sliced, texts_of
from segspark.runtime import materialize

SHINGLE = 4
COORDINATES, PREFIX, MATCHES = 64, 16, 36
#: Similarity bound as a fraction: 100 * intersection >= 80 * union.
PERCENT = 80
#: Triples of coordinates: three of each of the first eight groups of four.
TRIPLES = np.array([[4 * g + c for c in range(4) if c != out] for g in range(8) for out in range(4)])
#: Longer lists are compared in blocks of about this many.
BLOCK = 512
#: A block with more candidate pairs than this for each member checks them where they are.
CROWD = 4

_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * U64(0xA24BAED4963EE407)) | U64(1)


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES) minima of each text's shingles; texts must not be empty.

    Postings take all 32 bits of a minimum, comparisons its low 16.
    """
    out = np.empty((len(starts), COORDINATES), np.uint32)
    for k, factor in enumerate(_FACTORS):
        low = ((values * factor) >> U64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(low, starts)
    return out


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rk, n_shingles, k1, k2, minima, signature) of each row: rk identifies id and text, k1 and k2 the set."""
    rows = docs.select(id_col, text_col, F.xxhash64(id_col, text_col).alias("rk"))

    def features(batches):
        for batch in sliced(batches, text_col):
            value, first = shingle_sets(texts_of(batch.column(1)), SHINGLE)
            n = np.diff(first)
            some = np.flatnonzero(n)
            keys = np.zeros((len(n), 2), np.int64)
            minima, short = [None] * len(n), [None] * len(n)
            if len(some):
                for i in some:
                    keys[i] = np.frombuffer(hashlib.blake2b(value[first[i]:first[i + 1]].tobytes(), digest_size=16).digest(), np.int64)
                for i, row in zip(some, signatures(value, first[:-1][some])):
                    minima[i], short[i] = row[:PREFIX].tobytes(), row.astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n.astype(np.int64)), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                 pa.array(minima, pa.binary()), pa.array(short, pa.binary())], names=schema.names)

    schema = T.StructType([docs.schema[id_col], T.StructField("rk", T.LongType()), T.StructField("n_shingles", T.LongType()),
                           T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("minima", T.BinaryType()),
                           T.StructField("signature", T.BinaryType())])
    return rows.mapInArrow(features, schema)


def _postings(classes: DataFrame) -> DataFrame:
    """(i, v, cid) for each class and each of the first coordinates, of lists with two classes or more."""

    def post(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                minima = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, PREFIX)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(PREFIX, dtype=np.int32), n)), pa.array(minima.reshape(-1).astype(np.int64)),
                     pa.array(np.repeat(batch.column(0).to_numpy(), PREFIX))], names=["i", "v", "cid"])

    posted = classes.select("cid", "minima").mapInArrow(post, "i int, v long, cid long")
    lists = posted.groupBy("i", "v").agg(F.count(F.lit(1)).alias("size"), F.min("cid").alias("leader"))
    return posted.join(lists.filter("size > 1"), ["i", "v"])


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(-1)


def _similar_size(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def _minima(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def _star_pairs(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of each class and the leaders of its lists, as far as enough coordinates agree."""
    slim = classes.select("cid", "n", "signature")
    pairs = postings.filter("cid <> leader").select("leader", "cid").distinct()
    both = (pairs.join(slim, "cid")
            .join(slim.select(F.col("cid").alias("leader"), F.col("n").alias("m"), F.col("signature").alias("other")), "leader"))

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                enough = _agreement(_minima(batch.column(3)), _minima(batch.column(5))) >= MATCHES
                enough &= _similar_size(batch.column(2).to_numpy(), batch.column(4).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(enough)), batch.column(1).filter(pa.array(enough))],
                                                 names=["a", "b"])

    return both.select("leader", "cid", "n", "signature", "m", "other").mapInArrow(count, "a long, b long")


def _cross_pairs(postings: DataFrame, classes: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates across components: pairs (a, b); members (cid, i, v, x, y, block) of blocks with more than
    `CROWD` pairs a member; and (cid, component, n, signature) of all members."""
    component = F.coalesce("component", F.col("cid"))
    members = (postings.select("i", "v", "cid").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
               .withColumn("component", component))
    mixed = members.groupBy("i", "v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    open_ = materialize(members.join(mixed.select("i", "v"), ["i", "v"]).select("cid", "component").distinct()
                        .join(classes.select("cid", "n", "signature"), "cid"))

    def post(batches):
        for batch in batches:
            if batch.num_rows:
                values = _minima(batch.column(2))[:, TRIPLES].astype(np.uint64)  # (classes, triples, 3)
                packed = values[..., 0] << U64(32) | values[..., 1] << U64(16) | values[..., 2]
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(len(TRIPLES), dtype=np.int32), n)), pa.array(packed.reshape(-1).view(np.int64)),
                     pa.array(np.repeat(batch.column(0).to_numpy(), len(TRIPLES))),
                     pa.array(np.repeat(batch.column(1).to_numpy(), len(TRIPLES)))], names=["i", "v", "cid", "component"])

    posted = open_.select("cid", "component", "signature").mapInArrow(post, "i int, v long, cid long, component long")
    lists = (posted.groupBy("i", "v").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"))
             .filter("lo < hi").select("i", "v", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    # Members are dealt to blocks by hash; each pair of blocks meets once.
    dealt = posted.join(lists, ["i", "v"]).withColumn("block", F.expr("cast(pmod(xxhash64(cid), blocks) as int)"))
    dealt = dealt.withColumn("other", F.expr("explode(sequence(0, blocks - 1))")).withColumns(
        {"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    keys = ["i", "v", "x", "y"]
    rows = (dealt.select(*keys, "block", "cid", "component").join(open_.select("cid", "n", "signature"), "cid")
            .repartition(*keys).sortWithinPartitions(*keys, "cid"))

    def compare(batches):
        for run in runs_of(batches, keys):
            parts = [(p, q) for p, q, _ in _candidates(run)]
            p, q = (np.concatenate([part[k] for part in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
            cid, n = run.column("cid").to_numpy(), run.num_rows
            if len(p) <= CROWD * n:
                lists = [np.minimum(cid[p], cid[q]), np.maximum(cid[p], cid[q])]
                here = [np.zeros(len(p), np.int64)] * 5
            else:  # the members themselves go on
                lists = [cid, np.full(n, -1)]
                here = [run.column(c).to_numpy() for c in (*keys, "block")]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (*lists, *here)], names=["a", "b", *keys, "block"])

    found = materialize(rows.mapInArrow(compare, "a long, b long, i long, v long, x long, y long, block long"))
    return found.filter("b >= 0").select("a", "b"), found.filter("b < 0").drop("b").withColumnRenamed("a", "cid"), open_


def _candidates(run: pa.Table):
    """(rows, rows, agreement) of a pair of blocks: pairs across components with enough agreement, each only in
    the list of the first triple that it shares."""
    i, x, y = (run.column(c)[0].as_py() for c in ("i", "x", "y"))
    cid, comp, n, block = (run.column(c).to_numpy() for c in ("cid", "component", "n", "block"))
    minima = _minima(run.column("signature"))
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    for lo in range(0, len(left), 64):
        a = left[lo:lo + 64]
        ok = (comp[a][:, None] != comp[right]) & _similar_size(n[a][:, None], n[right])
        if x == y:
            ok &= cid[a][:, None] < cid[right]
        p, q = np.nonzero(ok)
        p, q = a[p], right[q]
        for at in range(0, len(p), 1 << 14):
            s, t = p[at:at + (1 << 14)], q[at:at + (1 << 14)]
            same = minima[s] == minima[t]
            agree = same.sum(1)
            enough = agree >= MATCHES
            s, t, same, agree = s[enough], t[enough], same[enough], agree[enough]
            first = same[:, TRIPLES].all(2).argmax(1) == i
            yield s[first], t[first], agree[first]


def _sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cid, items) for each cid of `wanted`: its sorted shingles, from one more scan that skips other texts."""
    needed = materialize(wanted.select("cid").distinct().join(classes.select("cid", "rk"), "cid"))
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(needed, "rk"))

    def sets(batches):
        def sift():
            for batch in batches:
                yield batch.filter(pa.array(in_map(shared.value, batch.column(0).to_numpy())))

        for batch in sliced(sift(), text_col):
            value, first = shingle_sets(texts_of(batch.column(1)), SHINGLE)
            raw = pa.array([value[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw], names=["rk", "items"])

    rows = docs.select(F.xxhash64(id_col, text_col).alias("rk"), F.col(text_col))
    # Repeated rows have equal rk and equal sets.
    held = needed.join(rows.mapInArrow(sets, "rk long, items binary"), "rk").select("cid", "items")
    return materialize(held.groupBy("cid").agg(F.first("items").alias("items")))


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, sets_of) -> DataFrame:
    """The pairs (as u, v) whose full sets reach the similarity bound."""
    held = sets_of(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")))
    both = (pairs.join(held.select(F.col("cid").alias("a"), "items"), "a")
            .join(held.select(F.col("cid").alias("b"), F.col("items").alias("others")), "b"))

    def verify(batches):
        for batch in batches:
            keep = pa.array([_linked(np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64))
                             for s, t in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return both.select("a", "b", "items", "others").mapInArrow(verify, "u long, v long")


def _confirmed_in_place(crowded: DataFrame, open_: DataFrame, sets_of) -> DataFrame:
    """Links (u, v) of crowded blocks: the sets go where the candidates meet, and a block sends on links that
    join its components, no others."""
    keys = ["i", "v", "x", "y"]
    rows = (crowded.join(open_, "cid").join(sets_of(crowded), "cid").repartition(*keys).sortWithinPartitions(*keys, "cid"))

    def verify(batches):
        for run in runs_of(batches, keys):
            cid, comp = (run.column(c).to_numpy() for c in ("cid", "component"))
            items = run.column("items").to_pylist()
            root = {c: c for c in comp.tolist()}

            def find(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            found = []
            for p, q, agree in _candidates(run):
                for k in np.argsort(-agree, kind="stable").tolist():  # the likeliest first
                    s, t = int(p[k]), int(q[k])
                    a, b = find(int(comp[s])), find(int(comp[t]))
                    if a != b and _linked(np.frombuffer(items[s], np.uint64), np.frombuffer(items[t], np.uint64)):
                        root[max(a, b)] = min(a, b)
                        found.append((int(cid[s]), int(cid[t])))
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return rows.mapInArrow(verify, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept, row_key) of each row of `docs`; row_key is xxhash64 of id and text.

    component_id is the smallest id that links reach; a document is kept if it
    is its own. A text of fewer than four words is one shingle; NULL and empty
    texts have none and are linked with nothing. Rows with equal id and text
    stay or go together. A row without an id takes part in links; it is kept
    only if its component has no id at all. Runs jobs while it is built.
    """
    with small_batches(docs.sparkSession):
        rows = materialize(_features(docs, id_col, text_col))
        # Equal sets are one class, represented by its smallest id; NULL ids come last.
        first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "rk"))
        classes = materialize(rows.filter("n_shingles > 0").groupBy("k1", "k2")
                              .agg(first.alias("first"), F.min("n_shingles").alias("n"), F.min("minima").alias("minima"),
                                   F.min("signature").alias("signature"))
                              .select("k1", "k2", "n", "minima", "signature", F.col("first.id").alias("id"), F.col("first.rk").alias("rk"))
                              .withColumn("cid", F.monotonically_increasing_id()))
        postings = materialize(_postings(classes))

        def sets_of(wanted):
            return _sets(wanted, classes, docs, id_col, text_col)

        edges = materialize(_confirmed(materialize(_star_pairs(postings, classes)), sets_of))
        joined = materialize(connected(edges))
        pairs, crowded, open_ = _cross_pairs(postings, classes, joined)
        more = materialize(_confirmed(pairs, sets_of).unionByName(_confirmed_in_place(crowded, open_, sets_of)))
        if not more.isEmpty():
            joined = materialize(connected(edges.unionByName(more)))
    member = classes.join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = member.groupBy("component").agg(F.min("id").alias("component_id"))
    named = member.join(least, "component").select("k1", "k2", "component_id")
    out = rows.join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(id_col))
    return out.select(F.col(id_col), "n_shingles", component.alias("component_id"), F.col(id_col).eqNullSafe(component).alias("kept"),
                      F.col("rk").alias("row_key"))
