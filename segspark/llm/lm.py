"""Language-model scores by a weighted backoff automaton over word bigrams.

States are the root and one for each word of the training rows. An arc from a
state takes a word that followed it in training, with an absolutely discounted
probability; the failure arc goes to the root with the backoff weight that makes
the state's probabilities sum to one. The root's arcs are the add-one unigrams
of every word. A text is read once, left to right: the state after a word is
the word's own, or the root where training never saw it.

The counts and failure weights grow with the corpus and are never gathered in
one place. Rows are scored in blocks of bounded size; each block asks for the
counts of the words and bigrams that occur in it, and for the failure weights of
the states it leaves that way, and gets the part of the automaton that it needs.
It counts its own training rows itself, so only counts that other blocks add to
are sent. Questions and answers are packed: the items of a block that one task
counts are one row, sorted, as steps and counts; its answer is in the same order.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from segspark.llm.batches import released_shuffles
from segspark.llm.textarrays import SPACE, U64, mix, sliced, texts_of, word_hashes, words_of
from segspark.runtime import materialize

#: Bytes of text in a block, but for a longer single text.
BLOCK_BYTES = 12 << 20
#: Bytes of text whose items one task counts, about.
PART_BYTES = 8 << 20
DISCOUNT = 0.75
#: Stands for the end of a text.
END = U64(0x5DEECE66D1CE4E5B)
_PAIR = U64(0xD1B54A32D192ED03)


class Tokens(NamedTuple):
    hashes: np.ndarray  # all tokens, text after text, an end after each
    first: np.ndarray  # tokens of text i are first[i]..first[i + 1] - 1


def tokens_of(column) -> Tokens:
    texts = texts_of(column)
    words = words_of(texts, SPACE)
    out = np.full(len(words.start) + len(texts), END)
    first = words.first + np.arange(len(words.first))
    inside = np.ones(len(out), bool)
    inside[first[1:] - 1] = False
    out[inside] = word_hashes(texts, words)
    return Tokens(out, first)


def bigrams_of(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """For each token the hash of the one before and itself, and whether there is one before it in its text."""
    out = np.zeros(len(tokens.hashes), np.uint64)
    out[1:] = mix(tokens.hashes[:-1] * _PAIR + tokens.hashes[1:])
    follows = np.ones(len(out), bool)
    follows[tokens.first[:-1]] = False
    return out, follows


def _blocks(docs: DataFrame, id_col: str, text_col: str, train: Column) -> tuple[DataFrame, int]:
    """(block, id, text, train): rows of one file split, dealt by hash to blocks of about `BLOCK_BYTES`; and the bytes of all texts.

    The split's name and start are the same in every scan of the same files.
    """
    rows = docs.select(F.struct(F.input_file_name(), F.input_file_block_start()).alias("split"), F.col(id_col).alias("id"),
                       F.col(text_col).alias("text"), train.alias("train"))
    largest, size = rows.groupBy("split").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n"), F.sum("n")).first()
    parts = 1 + (largest or 0) // BLOCK_BYTES
    return rows.select(F.xxhash64("split", F.pmod(F.xxhash64("id", "text"), F.lit(parts))).alias("block"), "id", "text", "train"), size or 0


class Counted(NamedTuple):
    """Distinct items of a block, in order."""

    value: np.ndarray
    count: np.ndarray  # in the training rows: of the block, or of all blocks
    one: np.ndarray  # whether this block is the one that tells of the item
    at: np.ndarray  # a place where the item occurs
    item: np.ndarray  # the item of each place


def counted(items: np.ndarray, train: np.ndarray) -> Counted:
    """The distinct `items` of a block and what its own training rows count."""
    value, at, item = np.unique(items, return_index=True, return_inverse=True)
    count = np.bincount(item, train, len(value)).astype(np.int64)
    return Counted(value, count, count > 0, at, item)


def pack_items(value: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as their steps, each as wide as the widest; the first byte is the width."""
    steps = value.copy()
    steps[1:] -= value[:-1]
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_items(packed: bytes) -> np.ndarray:
    width = packed[0]
    wide = np.zeros((len(packed) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(count: np.ndarray) -> tuple[bytes, bytes]:
    """A byte for each count, and 8 for each of those that need more."""
    return np.minimum(count, 255).astype(np.uint8).tobytes(), count[count >= 255].astype("<i8").tobytes()


def unpack_counts(small: bytes, large: bytes) -> np.ndarray:
    count = np.frombuffer(small, np.uint8).astype(np.int64)
    count[count == 255] = np.frombuffer(large, "<i8")
    return count


ASKED = "kind byte, part int, block long, items binary, small binary, large binary"
ANSWERED = "kind byte, part int, block long, n int, shared binary, marks binary, small binary, large binary, total long, kinds long"
WORDS, PAIRS = 0, 1


def _asked(blocks: DataFrame, bits: int) -> DataFrame:
    """Rows `ASKED`: the distinct words and bigrams of each block, and how often each is in its training rows.

    Items are dealt to 2 ** bits parts by their leading bits; a block has one
    row for each part that it has items in. A block lies in one split.
    """

    def ask(batches):
        # The rows of a split come together, so a task keeps the distinct items of its few blocks.
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in sliced(batches, "text"):
            tokens = tokens_of(batch.column(1))
            pair, follows = bigrams_of(tokens)
            lengths = np.diff(tokens.first)
            block = np.repeat(batch.column(0).to_numpy(), lengths)
            train = np.repeat(batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), lengths)
            for b in np.unique(batch.column(0).to_numpy()).tolist():
                mine = block == b
                for kind, value, use in ((WORDS, tokens.hashes, mine), (PAIRS, pair, mine & follows)):
                    own = counted(value[use], train[use])
                    parts = held.setdefault((b, kind), [])
                    parts.append((own.value, own.count))
                    if len(parts) > 4:
                        parts[:] = [_merged(parts)]
        for (b, kind), parts in held.items():
            value, count = _merged(parts)
            part = (value >> U64(64 - bits)).astype(np.int32) if bits else np.zeros(len(value), np.int32)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            rows = [(kind, int(part[lo]), b, pack_items(value[lo:hi]), *pack_counts(count[lo:hi]))
                    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(part)])]
            held[b, kind] = []
            for lo in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo:lo + 256]), _arrow(ASKED))], schema=_arrow(ASKED))

    return blocks.select("block", "text", "train").mapInArrow(ask, ASKED)


def _arrow(schema: str) -> pa.Schema:
    types = {"byte": pa.int8(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, types[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    items, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return items, np.bincount(where, np.concatenate([p[1] for p in parts]), len(items)).astype(np.int64)


def _answered(asked: DataFrame) -> DataFrame:
    """Rows `ANSWERED`: for each row asked which of its items other blocks have too, and of those the count over all blocks.

    `marks` tells of which shared items this block is the one to tell. A row
    without a block has the part's training occurrences and distinct items. An
    item is here once for each block it is in, however often that is.
    """
    schema = _arrow(ANSWERED)

    def answer(key, table):
        kind, part = key[0].as_py(), key[1].as_py()
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("block", "items", "small", "large"))))
        values = [unpack_items(r[1]) for r in rows]
        ends = np.cumsum([len(v) for v in values])
        _, first, item, times = np.unique(np.concatenate(values), return_index=True, return_inverse=True, return_counts=True)
        count = np.bincount(item, np.concatenate([unpack_counts(*r[2:]) for r in rows]), len(first)).astype(np.int64)
        one = np.zeros(len(item), bool)
        one[first] = True
        out = []
        for r, lo, hi in zip(rows, [0, *ends[:-1].tolist()], ends.tolist()):
            shared = times[item[lo:hi]] > 1
            out.append((kind, part, r[0], hi - lo, np.packbits(shared).tobytes(), np.packbits(one[lo:hi][shared]).tobytes(),
                        *pack_counts(count[item[lo:hi][shared]]), None, None))
        out.append((kind, part, *[None] * 6, int(count.sum()), int((count > 0).sum())))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return asked.groupBy("kind", "part").applyInArrow(answer, ANSWERED)


def informed(own: Counted, kind: int, answers: pa.Table) -> Counted:
    """`own` with the counts over all blocks, from the block's rows of `ANSWERED`."""
    count, one, at = own.count.copy(), own.one.copy(), 0
    rows = [r for r in answers.to_pylist() if r["kind"] == kind]
    for r in sorted(rows, key=lambda r: r["part"]):
        shared = at + np.flatnonzero(np.unpackbits(np.frombuffer(r["shared"], np.uint8), count=r["n"]))
        count[shared] = unpack_counts(r["small"], r["large"])
        one[shared] = np.unpackbits(np.frombuffer(r["marks"], np.uint8), count=len(shared))
        at += r["n"]
    if at != len(count):
        raise ValueError(f"{at} items answered of {len(count)}")
    return own._replace(count=count, one=one)


class Walk(NamedTuple):
    known: np.ndarray  # for each token: whether training saw it
    unigram: np.ndarray  # its add-one term
    weight: np.ndarray  # that of the arc taken, or of the root's arc after a failure arc
    failed: np.ndarray  # whether the failure arc of the state before is taken: its weight is to be added
    state: np.ndarray  # states that this block tells of, by hash
    count: np.ndarray  # their training counts
    arcs: np.ndarray  # how many of their arcs it tells of
    below: np.ndarray  # sum of the unigram probabilities of those


def walk(tokens: Tokens, here: np.ndarray, word: Counted, pair: Counted, total: int, kinds: int) -> Walk:
    """The automaton over the texts of a block but for the failure weights, and what the block adds to these.

    `here` are the places that follow another of their text; `pair` has an item for each of them.
    """
    count = word.count[word.item]
    unigram = np.log10((count + 1.0) / (total + 1.0 * (kinds + 1)))
    times = pair.count[pair.item]
    weight, failed = unigram.copy(), np.zeros(len(count), bool)
    taken = times > 0
    weight[here[taken]] = np.log10((times[taken] - DISCOUNT) / count[here[taken] - 1])
    failed[here] = ~taken & (count[here - 1] > 0)
    told = here[pair.at[pair.one & (pair.count > 0)]]
    state, first, item = np.unique(tokens.hashes[told - 1].view(np.int64), return_index=True, return_inverse=True)
    return Walk(count > 0, unigram, weight, failed, state, count[told - 1][first], np.bincount(item, minlength=len(state)),
                np.bincount(item, 10 ** unigram[told], len(state)))


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row; counts from the rows where `train` is true.

    base_score is the sum of add-one unigram log10 probabilities, score that of
    the automaton. A text's tokens are its words, lower-cased in ASCII, and one
    end; a NULL or empty text is the end alone. Repeated rows and NULL ids are
    rows like others; a NULL `train` is false. Without training rows every
    unigram has probability one. `stored` says that `docs` is read straight
    from files; else it is first written to the shared folder. Runs jobs while
    it is built.
    """
    train = F.coalesce(train, F.lit(False))
    if not stored:
        docs, train = materialize(docs.select(id_col, text_col, train.alias("train"))), F.col("train")
    with released_shuffles(docs.sparkSession):
        return _scored(docs, train, id_col, text_col)


def _scored(docs: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    blocks, size = _blocks(docs, id_col, text_col, train)
    answers = materialize(_answered(_asked(blocks, (size // PART_BYTES).bit_length())))
    total, kinds = answers.filter(F.col("block").isNull() & (F.col("kind") == WORDS)).agg(F.sum("total"), F.sum("kinds")).first()
    total, kinds = total or 0, kinds or 0
    wanted = answers.filter("block is not null").drop("total", "kinds")
    id_type = docs.schema[id_col].dataType
    long, double = T.LongType(), T.DoubleType()
    schema = T.StructType([T.StructField("block", long), T.StructField("id", id_type), T.StructField("n_tokens", long), T.StructField("n_known", long),
                           T.StructField("base", double), T.StructField("score", double), T.StructField("failed", T.ArrayType(long)),
                           T.StructField("h", long), T.StructField("n", long), T.StructField("arcs", long), T.StructField("below", double)])
    walked_schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def read(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        parts = [tokens_of(batch.column(2)) for batch in sliced(texts.to_batches(), "text")]
        if not parts:
            return walked_schema.empty_table()
        lengths = np.concatenate([np.diff(p.first) for p in parts])
        tokens = Tokens(np.concatenate([p.hashes for p in parts]), np.concatenate([[0], np.cumsum(lengths)]))
        train_ = np.repeat(texts.column("train").to_numpy().astype(np.int64), lengths)
        value, follows = bigrams_of(tokens)
        here = np.flatnonzero(follows)
        word = informed(counted(tokens.hashes, train_), WORDS, answers)
        pair = informed(counted(value[here], train_[here]), PAIRS, answers)
        got = walk(tokens, here, word, pair, total, kinds)
        sums = [np.add.reduceat(x, tokens.first[:-1]) for x in (got.known.astype(np.int64), got.unigram, got.weight)]
        places = np.flatnonzero(got.failed)
        failed = pa.ListArray.from_arrays(pa.array(np.searchsorted(places, tokens.first).astype(np.int32)),
                                          pa.array(tokens.hashes[places - 1].view(np.int64)))
        n, m = len(lengths), len(got.state)
        b = key[0].as_py()
        rows = [np.full(n, b), texts.column("id").combine_chunks(), lengths.astype(np.int64), *sums, failed, *[pa.nulls(n)] * 4]
        told = [np.full(m, b), *[pa.nulls(m)] * 6, got.state, got.count, got.arcs.astype(np.int64), got.below]
        return pa.concat_tables([pa.Table.from_arrays([(x if isinstance(x, pa.Array | pa.ChunkedArray) else pa.array(x)).cast(f.type)
                                                       for x, f in zip(columns, walked_schema)], schema=walked_schema) for columns in (rows, told)])

    walked = materialize(blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(read, schema))
    rows, told = walked.filter("n_tokens IS NOT NULL").drop("h", "n", "arcs", "below"), walked.filter("h IS NOT NULL")
    # A training token has one successor, so the discounted shares of a state sum to 1 - DISCOUNT * arcs / n.
    left, rest = F.col("arcs") * DISCOUNT / F.col("n"), 1 - F.col("below")
    failure = (told.groupBy("h").agg(F.max("n").alias("n"), F.sum("arcs").alias("arcs"), F.sum("below").alias("below"))
               .select("h", F.log10(F.greatest(left, F.lit(1e-12)) / F.greatest(rest, F.lit(1e-12))).alias("failure")))
    open_ = rows.filter(F.size("failed") > 0)
    weights = materialize(open_.select("block", F.explode("failed").alias("h")).distinct().join(failure, "h").select("block", "h", "failure"))
    scored_schema = pa.schema([f for f in walked_schema if f.name in ("id", "n_tokens", "n_known", "base", "score")])

    def add(key, texts: pa.Table, weights: pa.Table) -> pa.Table:
        h, weight = weights.column("h").to_numpy(), weights.column("failure").to_numpy()
        order = np.argsort(h)
        h, weight = h[order], weight[order]
        lists = texts.column("failed").combine_chunks()
        more = weight[np.searchsorted(h, lists.flatten().to_numpy())]
        lengths = pa.compute.list_value_length(lists).to_numpy()
        more = np.bincount(np.repeat(np.arange(len(lengths)), lengths), more, len(lengths))
        score = pa.array(texts.column("score").to_numpy() + more)
        return pa.Table.from_arrays([texts.column(c) if c != "score" else score for c in scored_schema.names], schema=scored_schema)

    added = open_.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(add, T.StructType([schema[c] for c in scored_schema.names]))
    every = rows.filter(F.size("failed") == 0).select(scored_schema.names).unionByName(added)
    return every.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                        F.col("base").alias("base_score"), "score")
