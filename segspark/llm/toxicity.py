"""Toxicity by compression distance.

Windows of three words are compressed with an ordinary zstandard dictionary and
with that and a toxic one together; the bytes that the toxic one saves are the
window's gain. How many windows of a document reach each gain, put through
calibrated weights, gives its score. A window that shares no run of `RUN` bytes
with the toxic dictionary has a gain of 0 by definition and is not compressed.

The ordinary dictionary is trained by zstandard. The toxic one is raw content: a
list of the words that toxic text holds more often than chance allows. A trained
one finds fewer toxic documents, since segments that cut words also save bytes in ordinary windows.

The classifier is fitted to a bounded sample of labelled rows on the driver;
every row is scored where it lies.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.llm.textarrays import U64, Texts, sliced, texts_of, words_of

#: Labelled rows of each class that the classifier is fitted to at most, in the order of a hash of the id.
SAMPLE_ROWS = 3000
WINDOW = 3
RUN = 5
ORDINARY_BYTES, TOXIC_BYTES = 1 << 15, 1 << 14
#: A toxic segment stands in at least so many distinct contexts, and its share among the contexts of
#: toxic text exceeds that of ordinary text by so many standard errors.
CONTEXTS, STANDARD_ERRORS = 4, 4.5
GAINS = np.arange(1, 9)
#: Both dictionaries end with this run, and each window begins with it, so that every window is
#: compressed (zstandard stores tiny inputs as they are) and a gain counts byte by byte.
CARRIER = bytes([*range(1, 9), 0x0B, *range(0x0E, 0x1D)])

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[0x41:0x5B] = _SEPARATOR[0x61:0x7B] = _SEPARATOR[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Windows(NamedTuple):
    """Lower-cased words, a space after each; window w is stream[edge[w] - 1:edge[w + 1]]."""

    stream: np.ndarray
    edge: np.ndarray
    text: np.ndarray  # text of each window
    of_byte: np.ndarray  # window of each byte
    counts: np.ndarray  # windows of each text


def windows_of(texts: Texts) -> Windows:
    words = words_of(texts, _SEPARATOR)
    size = words.end - words.start + 1
    begin = np.cumsum(size) - size + 1
    stream = np.full(int(size.sum()) + 1, 0x20, np.uint8)
    of_word = np.repeat(np.arange(len(size)), size - 1)
    inside = np.arange(len(of_word)) - (begin - 1 - np.arange(len(size)))[of_word]
    stream[begin[of_word] + inside] = _LOWER[texts.data[words.start[of_word] + inside]]
    opens = np.zeros(len(size), bool)
    rank = np.arange(len(size)) - np.repeat(words.first[:-1], words.counts)
    opens[rank % WINDOW == 0] = True
    heads = np.flatnonzero(opens)
    of_byte = np.zeros(len(stream), np.int64)
    of_byte[1:] = np.repeat(np.cumsum(opens) - 1, size)
    counts = -(-words.counts // WINDOW)
    return Windows(stream, np.concatenate([begin[heads], [len(stream)]]), words.text[heads], of_byte, counts)


def _runs(stream: np.ndarray) -> np.ndarray:
    n = max(len(stream) - RUN + 1, 0)
    value = np.zeros(n, np.uint64)
    for k in range(RUN):
        value = value << U64(8) | stream[k:k + n]
    return value


class Classifier(NamedTuple):
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    held = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    how = zstd.ZstdCompressionParameters(
        strategy=zstd.STRATEGY_BTULTRA2, min_match=4, window_log=17, hash_log=15, chain_log=16, search_log=4, target_length=32,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS)
    held.precompute_compress(compression_params=how)
    return zstd.ZstdCompressor(dict_data=held, compression_params=how)


class _Pair:
    """Compressors of one process."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain = _compressor(ordinary + CARRIER).compress
        self.both = _compressor(ordinary + toxic + CARRIER).compress
        self.runs = np.unique(_runs(np.frombuffer(toxic, np.uint8)))
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self._slot(self.runs)] = True

    @staticmethod
    def _slot(runs: np.ndarray) -> np.ndarray:
        return ((runs * U64(0x9E3779B97F4A7C15)) >> U64(48)).astype(np.int64)

    def gains(self, windows: Windows) -> np.ndarray:
        out = np.zeros(len(windows.text), np.int64)
        runs = _runs(windows.stream)
        at = np.flatnonzero(self.sieve[self._slot(runs)])
        at = at[np.isin(runs[at], self.runs)]
        raw = windows.stream.tobytes()
        for w in np.unique(windows.of_byte[at + 1]).tolist():
            window = CARRIER + raw[windows.edge[w] - 1:windows.edge[w + 1]]
            out[w] = len(self.plain(window)) - len(self.both(window))
        return out


@lru_cache(maxsize=2)
def _pair(ordinary: bytes, toxic: bytes) -> _Pair:
    return _Pair(ordinary, toxic)


def _features(texts: Texts, pair: _Pair) -> tuple[np.ndarray, np.ndarray]:
    """For each text the logarithm of how many windows reach each gain, and of all windows; the largest gain."""
    windows = windows_of(texts)
    gains, n = pair.gains(windows), len(texts)
    reach = [np.bincount(windows.text[gains >= g], minlength=n) for g in GAINS]
    top = np.zeros(n, np.int64)
    np.maximum.at(top, windows.text, gains)
    return np.log1p(np.stack([*reach, windows.counts], 1)), top


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary, without its header; the samples themselves where they are too few."""
    try:
        raw = zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]
    text = re.search(rb"[a-z\x80-\xff ]{40,}", raw)
    return raw[text.start():] if text else b"".join(samples)[-size:]


def _segments(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Words that stand in many more distinct contexts of toxic than of ordinary text, the surest last.

    A context is a word with its neighbours; copies of a passage count once.
    """
    def contexts(texts):
        seen = {c for w in texts for c in zip([b"", *w[:-1]], w, [*w[1:], b""])}
        return Counter(c[1] for c in seen), max(len(seen), 1)

    (there, n), (here, m) = contexts(toxic), contexts(ordinary)
    sure = {}
    for word, k in there.items():
        if k >= CONTEXTS and len(word) >= 4:
            share = (k + here[word]) / (n + m)
            sure[word] = (k / n - here[word] / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m) + 1e-15)
    return sorted((w for w in sure if sure[w] >= STANDARD_ERRORS), key=lambda w: (sure[w], w))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and spread of the features and weights of a ridge logistic regression (Newton steps)."""
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    ridge = np.r_[np.full(x.shape[1], 1.0), 1e-3]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, spread, w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit to at most `sample_rows` labelled rows of each class.

    `labels` holds (id, label 0/1); NULL ids, labels and texts are left out, ids
    with both labels too; of several texts of an id the smallest counts. Each half of the rows (by hash) is compressed with
    dictionaries of the other half to calibrate the weights; the dictionaries
    that are kept come from all of them. Without rows of both classes every score is the share of label 1.
    """
    known = (labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).dropna()
             .groupBy("__id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most"))
    order = F.xxhash64("__id")
    chosen = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy(order, "__id").limit(sample_rows).select("__id", "label")
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 x sample_rows ids are broadcast and as many texts collected.
    rows = (docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).filter("text is not null")
            .join(F.broadcast(chosen), "__id").groupBy("__id", "label").agg(F.min("text").alias("text"))
            .select("text", "label", (order % 2 == 0).alias("even"))
            .toArrow())
    order_of = sorted(range(rows.num_rows), key=lambda i: rows.column("text")[i].as_py())  # as the rows came in any order
    rows = rows.take(pa.array(order_of, pa.int64()))
    y, even = np.array(rows.column("label").to_pylist(), float), np.array(rows.column("even").to_pylist(), bool)
    texts = rows.column("text")
    halves = [np.flatnonzero(even), np.flatnonzero(~even)]
    if any(len(set(y[half])) < 2 for half in halves):
        share, nothing = y.mean() if len(y) else 0.5, np.zeros(len(GAINS) + 1)
        return Classifier(b" ", b" ", nothing, nothing + 1, np.r_[nothing, np.log((share + 1e-3) / (1 - share + 1e-3))])
    words = [windows_of(texts_of(texts.slice(i, 1))).stream.tobytes().split() for i in range(len(y))]

    def dictionaries(of: np.ndarray) -> tuple[bytes, bytes]:
        ordinary, toxic = ([words[i] for i in of if y[i] == label] for label in (0, 1))
        plain = {b" " + b" ".join(w[i:i + WINDOW]) + b" " for w in ordinary for i in range(0, len(w), WINDOW)}
        marked = (b" " + b"  ".join(_segments(toxic, ordinary)) + b" ")[-TOXIC_BYTES:]
        # Ordinary words that share runs with toxic segments cost the same under both dictionaries, if both hold them.
        runs = {marked[i:i + RUN] for i in range(len(marked) - RUN + 1)}
        common = Counter(v for w in ordinary for v in w)
        near = [w for w in common if any(w[i:i + RUN] in runs for i in range(len(w) - RUN + 1))]
        near = b" " + b"  ".join(sorted(near, key=lambda w: (common[w], w))) + b" "
        return _dictionary(sorted(plain), ORDINARY_BYTES) + near[-ORDINARY_BYTES:], marked

    x = np.zeros((len(y), len(GAINS) + 1))
    for mine, other in (halves, halves[::-1]):
        pair = _Pair(*dictionaries(other))
        for i in range(0, len(mine), 500):
            x[mine[i:i + 500]] = _features(texts_of(texts.take(pa.array(mine[i:i + 500]))), pair)[0]
    return Classifier(*dictionaries(np.arange(len(y))), *_logistic(x, y))


def score_documents(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, n_windows, top_gain) of each row.

    One row in, one row out, in place: no shuffle; NULL ids and repeated rows
    are rows like others, other columns are not read. NULL and empty texts have
    no windows and the score of a text without evidence.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # two dictionaries of 16 kB

    def score(batches):
        model = shared.value
        pair = _pair(model.ordinary, model.toxic)
        for batch in sliced(batches, text_col):
            x, top = _features(texts_of(batch.column(1)), pair)
            z = np.clip(np.c_[(x - model.mean) / model.spread, np.ones(len(x))] @ model.weights, -30, 30)
            p = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                 pa.array(np.rint(np.expm1(x[:, -1])).astype(np.int64)), pa.array(top)], names=schema.names)

    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
                           T.StructField("n_windows", T.LongType()), T.StructField("top_gain", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(score, schema)
