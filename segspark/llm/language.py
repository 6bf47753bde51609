"""Language spans of mixed texts, and the language of whole texts.

A word is a run of letters. The script of its first letter narrows the
languages it may have; its score in each of them is the log-likelihood of its
hashed letter trigrams (with word ends). Viterbi over the words of a text, with
a penalty for each switch, labels spans; the text's language is the one with
most letters in its spans. Counts come from all training rows; the model has
`2 ** BITS` numbers for each language, whatever the corpus.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.llm.textarrays import U64, Texts, mix, sliced, texts_of

BITS = 15
#: Log-likelihood that a change of language between two words costs.
SWITCH_PENALTY = 12.0
#: A language uses a script if at least this part of its training letters is in it.
SCRIPT_SHARE = 0.01
#: Texts of more words are walked one by one, shorter ones side by side.
LONG = 2000
UNKNOWN = "und"

#: First code points of ranges and the script from there on.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([first for first, _ in SCRIPTS])
_SCRIPT_OF = np.array([NAMES.index(name) for _, name in SCRIPTS])


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower case (itself unless that is one character)."""
    every = range(0x110000)
    low = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(np.fromiter((x.isupper() or x.istitle() for x in map(chr, every)), bool, 0x110000)).tolist():
        if len(chr(c).lower()) == 1:
            low[c] = ord(chr(c).lower())
    return np.fromiter(map(str.isalpha, map(chr, every)), bool, 0x110000), low


class LetterWords(NamedTuple):
    """Words of a slice of texts: character spans, the text of each, its script and its trigrams."""

    start: np.ndarray  # character positions in the slice
    end: np.ndarray
    first: np.ndarray  # words of text i are first[i]..first[i + 1] - 1
    script: np.ndarray
    grams: np.ndarray  # trigram buckets of all words, word after word; a word has as many as letters
    base: np.ndarray  # character position where each text starts


def letter_words(texts: Texts) -> LetterWords:
    letter, low = _tables()
    points = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=heads[1:])
    base = heads[texts.start]
    n = len(points)
    inside = letter[points]
    edge = np.zeros(n + 1, bool)
    edge[base] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, last = np.flatnonzero(begins), np.flatnonzero(ends)
    # Word ends count as the number 0.
    code = np.where(inside, low[points], 0).astype(np.uint64)
    left, right = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    left[1:], right[:-1] = code[:-1], code[1:]
    left[start], right[last] = 0, 0
    at = np.flatnonzero(inside)
    grams = (mix(left[at] << U64(42) | code[at] << U64(21) | right[at]) >> U64(64 - BITS)).astype(np.int32)
    script = _SCRIPT_OF[np.searchsorted(_STARTS, points[start], "right") - 1]
    return LetterWords(start, last + 1, np.searchsorted(start, base).astype(np.int64), script, grams, base)


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # (buckets, languages): log-probabilities of trigrams
    allowed: np.ndarray  # (scripts, languages)


def _counts(docs: DataFrame, text_col: str, lang: Column) -> DataFrame:
    """(lang, slot, n) of all rows with a language; slots past the buckets count letters by script."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in sliced(batches, text_col):
            words = letter_words(texts_of(batch.column(0)))
            letters = words.end - words.start
            ends = np.concatenate([[0], np.cumsum(letters)])
            langs = batch.column(1).to_pylist()
            for i, name in enumerate(langs):
                if name is None:
                    continue
                total = totals.setdefault(name, np.zeros((1 << BITS) + len(NAMES), np.int64))
                lo, hi = words.first[i], words.first[i + 1]
                np.add.at(total, words.grams[ends[lo]:ends[hi]], 1)
                np.add.at(total, (1 << BITS) + words.script[lo:hi], letters[lo:hi])
        for name, total in totals.items():
            slot = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(slot), pa.string()), pa.array(slot.astype(np.int32)),
                                              pa.array(total[slot])], names=["lang", "slot", "n"])

    rows = docs.select(F.col(text_col).alias("text"), lang.alias("lang")).filter("lang is not null and text is not null")
    return rows.withColumnRenamed("text", text_col).mapInArrow(count, "lang string, slot int, n long")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None) -> Model:
    """Model of the rows of `docs` with a language, a text and, if given, `where`.

    The driver gets one row for each language and slot, at most
    (2 ** 15 + 12) x languages. Without any training row the model has no
    language and every text is `und`.
    """
    rows = docs if where is None else docs.filter(where)
    table = _counts(rows, text_col, F.col(lang_col)).groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = table.column("lang").to_pylist()
    languages = sorted(set(names))
    place = {name: k for k, name in enumerate(languages)}
    counts = np.zeros(((1 << BITS) + len(NAMES), len(languages)))
    counts[table.column("slot").to_numpy(), [place[name] for name in names]] = table.column("n").to_numpy()
    grams, scripts = counts[:1 << BITS], counts[1 << BITS:]
    weights = np.log(grams + 0.5) - np.log(grams.sum(0) + 0.5 * (1 << BITS))
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    allowed[~allowed.any(1)] = True  # a script that no language uses narrows nothing
    return Model(languages, weights.astype(np.float32), allowed)


def word_scores(words: LetterWords, model: Model) -> np.ndarray:
    """(words, languages): sum of trigram weights; far below any sum for languages of another script."""
    if not len(words.start):
        return np.zeros((0, len(model.languages)), np.float32)
    letters = words.end - words.start
    begins = np.cumsum(letters) - letters
    scores = np.add.reduceat(model.weights[words.grams], begins, axis=0)
    return np.where(model.allowed[words.script], scores, scores - 1000.0 * letters[:, None])


def _walk_one(rows: list[list[float]], penalty: float) -> list[int]:
    """Best labels of one text."""
    best, back = rows[0], []
    for row in rows[1:]:
        top = max(best)
        floor, lead = top - penalty, best.index(top)
        back.append([k if v >= floor else lead for k, v in enumerate(best)])
        best = [(v if v >= floor else floor) + e for v, e in zip(best, row)]
    label = best.index(max(best))
    out = [label]
    for came in reversed(back):
        label = came[label]
        out.append(label)
    return out[::-1]


def _walk_many(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float, labels: np.ndarray) -> None:
    """Best labels of many texts side by side, one word of each per step."""
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    live = np.searchsorted(-count, -np.arange(1, count[0] + 1), "right")  # texts with at least t words
    own = np.arange(scores.shape[1], dtype=np.int16)
    best, back = scores[first].astype(np.float64), []
    final = np.zeros(len(first), np.int64)
    for t in range(1, int(count[0])):
        k = live[t]
        final[k:len(best)] = best[k:].argmax(1)
        best = best[:k]
        lead = best.argmax(1)
        floor = best[np.arange(k), lead][:, None] - penalty
        stay = best >= floor
        back.append(np.where(stay, own, lead[:, None]).astype(np.int16))
        best = np.where(stay, best, floor) + scores[first[:k] + t]
    final[:len(best)] = best.argmax(1)
    for t in range(int(count[0]) - 1, -1, -1):
        k = live[t]
        labels[first[:k] + t] = final[:k]
        if t:
            final[:k] = back[t - 1][np.arange(k), final[:k]]


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Label of each word; ties go to staying, then to the language first in order."""
    labels = np.zeros(len(scores), np.int64)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count <= LONG))
    if len(short):
        _walk_many(scores, first[:-1][short], count[short], penalty, labels)
    for i in np.flatnonzero(count > LONG):
        labels[first[i]:first[i + 1]] = _walk_one(scores[first[i]:first[i + 1]].tolist(), penalty)
    return labels


class Verdict(NamedTuple):
    language: list[str]
    score: np.ndarray
    words: LetterWords
    labels: np.ndarray


def identify(texts: Texts, model: Model, penalty: float = SWITCH_PENALTY) -> Verdict:
    """Language of each text: most letters in its spans (of equals the first in order); score: their share."""
    words = letter_words(texts)
    n, k = len(texts), len(model.languages)
    if not k:
        return Verdict([UNKNOWN] * n, np.zeros(n), words, np.zeros(len(words.start), np.int64))
    labels = viterbi(word_scores(words, model), words.first, penalty)
    owner = np.repeat(np.arange(n), np.diff(words.first))
    letters = np.bincount(owner * k + labels, words.end - words.start, n * k).reshape(n, k)
    total = letters.sum(1)
    top = letters.argmax(1)
    names = [model.languages[t] if some else UNKNOWN for t, some in zip(top, total)]
    return Verdict(names, np.where(total > 0, letters.max(1) / np.maximum(total, 1), 0.0), words, labels)


def _spans(verdict: Verdict, languages: list[str]) -> list[list[dict]]:
    out = []
    words, labels = verdict.words, verdict.labels
    for i in range(len(verdict.language)):
        lo, hi = words.first[i], words.first[i + 1]
        part: list[dict] = []
        if hi > lo and languages:
            starts = lo + np.concatenate([[0], np.flatnonzero(np.diff(labels[lo:hi])) + 1])
            for a, b in zip(starts, [*starts[1:], hi]):
                part.append({"lang": languages[labels[a]], "start": int(words.start[a] - words.base[i]),
                             "end": int(words.end[b - 1] - words.base[i])})
        out.append(part)
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()),
                                 T.StructField("end", T.LongType())]))


def label_documents(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text",
                    spans: bool = True, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Columns `keep` of each row, lang_pred, score and, if asked for, spans (lang, start, end in characters).

    One row in, one row out, in place: no shuffle, NULL keys and repeated rows
    are rows like others. A NULL text, or one without a letter, is `und` with
    score 0 and no spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2 ** 15 numbers

    def label(batches):
        for batch in sliced(batches, text_col):
            verdict = identify(texts_of(batch.column(len(keep))), shared.value, penalty)
            columns = [batch.column(k) for k in range(len(keep))]
            columns += [pa.array(verdict.language, pa.string()), pa.array(verdict.score, pa.float64())]
            if spans:
                columns.append(pa.array(_spans(verdict, shared.value.languages), pa.list_(pa.struct(
                    [("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", *["spans"] * spans])

    fields = [docs.schema[k] for k in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    inputs = [F.col(k) for k in keep] + [F.col(text_col)]
    return docs.select(*inputs).mapInArrow(label, T.StructType(fields + [T.StructField("spans", SPAN)] * spans))


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language (a text without letters or NULL goes)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def sift(batches):
        for batch in sliced(batches, text_col):
            verdict = identify(texts_of(batch.column(place)), shared.value)
            # Without any language to tell apart, a text with letters still has one.
            known = [name != UNKNOWN or (not shared.value.languages and some) for name, some in
                     zip(verdict.language, np.diff(verdict.words.first).tolist())]
            yield batch.filter(pa.array([bool(x) for x in known], pa.bool_()))

    return docs.mapInArrow(sift, docs.schema)
