"""URL rules and block lists by cascades of Bloom filters, in DataFrame functions only.

A cascade tells exactly which keys of a known universe are listed. Its first
level is a Bloom filter of the listed keys; the second holds the unlisted keys
of the universe that pass the first, the third the listed keys that pass the
second, and so on until a level lets nothing pass by mistake. A key that fails at
an odd level is unlisted, at an even level listed.

The universe are all keys that the URLs at hand can ask for: each suffix of a
host with each path prefix whose length some rule has, and the host itself.
Listed keys that no URL asks for need no bits. A cascade is one array of at most
`MAX_BITS` bits, read by the scan of the URLs as a scalar subquery; a longer list
is dealt by hash to several cascades, which are asked one after the other.
"""

from __future__ import annotations

from math import ceil, log, log2, sqrt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.runtime import materialize, require_columns

#: Bits that one cascade is planned for: 8 MB.
MAX_BITS = 1 << 26
#: Share of false positives of the levels after the first.
DEEPER = 1 / 16


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL and where there is no `://`."""
    host, path = (F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", k), F.lit("")) for k in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


class Level(NamedTuple):
    offset: int  # in 64-bit words
    bits: int
    hashes: int


class Cascade(NamedTuple):
    words: DataFrame | None  # (word, bits); None if nothing is listed
    levels: list[Level]
    part: int  # keys of this part of the hash are its own
    parts: int

    def bits(self) -> Column:
        """All words in order, as a scalar subquery."""
        if self.words is None:
            return F.array().cast("array<bigint>")
        return self.words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select("w.bits").scalar()

    def holds(self, key: Column, bits: Column) -> Column:
        """Whether a key of the universe is listed; `bits` is a column with the value of `bits()`."""
        listed = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            listed = F.when(_passes(key, bits, self.levels[number - 1], number), listed).otherwise(F.lit(number % 2 == 0))
        return listed if self.parts == 1 else (_part(key, self.parts) == self.part) & listed


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))


def _place(key: Column, number: int, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(number * 64 + j)), F.lit(bits).cast("bigint"))


def _passes(key: Column, bits: Column, level: Level, number: int) -> Column:
    at = [_place(key, number, j, level.bits) for j in range(level.hashes)]
    tests = [F.getbit(F.get(bits, (F.floor(p / 64) + level.offset).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in at]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def _shape(n: int, others: int, first: bool) -> tuple[int, int]:
    """Bits and hash functions for n keys that `others` are held against."""
    share = min(0.5, n * sqrt(0.5) / max(others, 1)) if first else DEEPER
    return 64 * ceil((n * -log(share) / log(2) ** 2 + 1) / 64), max(1, round(-log2(share)))


def build(keys: DataFrame, listed: str) -> list[Cascade]:
    """Cascades for the keys of the universe (`key`, distinct) whose column `listed` is true; runs a few jobs."""
    n, size = keys.agg(F.count_if(F.col(listed)), F.count(F.lit(1))).first()
    parts = max(1, ceil(n * (1.45 * max(1.0, log2(max(size, 1) / max(n, 1))) + 8) / MAX_BITS))
    return [_build(keys if parts == 1 else keys.filter(_part(F.col("key"), parts) == p), listed, p, parts) for p in range(parts)]


def _build(keys: DataFrame, listed: str, part: int, parts: int) -> Cascade:
    spark = keys.sparkSession
    mine, others = (materialize(keys.filter(F.col(listed) == here).select("key")) for here in (True, False))
    n, m = mine.count(), others.count()
    levels, words, offset = [], None, 0
    while n:
        number = len(levels) + 1
        bits, hashes = _shape(n, m, number == 1)
        places = mine.select(F.explode(F.array(*[_place(F.col("key"), number, j, bits) for j in range(hashes)])).alias("p"))
        filled = places.select(F.floor(F.col("p") / 64).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bits"))
        empty = spark.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
        level = materialize(filled.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits")))
        alone = Cascade(level, [Level(0, bits, hashes)], 0, 1)
        passed = others.withColumn("__bits", alone.bits()).filter(_passes(F.col("key"), F.col("__bits"), alone.levels[0], number)).select("key")
        level = level.withColumn("word", F.col("word") + offset)
        words = level if words is None else words.unionByName(level)
        levels.append(Level(offset, bits, hashes))
        offset += bits // 64
        mine, others = materialize(passed), mine
        n, m = mine.count(), n
    return Cascade(words, levels, part, parts)


def members(rows: DataFrame, keys: str, cascades: list[Cascade], out: str) -> DataFrame:
    """Adds `out`: those of the array column `keys` that are listed. One pass for each cascade."""
    found = rows.withColumn(out, F.array().cast("array<string>"))
    for cascade in cascades:
        if cascade.words is None:
            continue
        asked = found.withColumn("__bits", cascade.bits())
        mine = F.filter(keys, lambda k: cascade.holds(k, F.col("__bits")))  # noqa: B023 - built at once
        found = asked.withColumn(out, F.concat(out, mine)).drop("__bits")
        if len(cascades) > 1:
            found = materialize(found)
    return found


def exact_host(host: Column) -> Column:
    """Key of a host without its subdomains; no rule has such a key."""
    return F.concat(F.lit("="), host)


def _asked(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Keys that a URL asks for: rules that would fit it, and its host."""
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(path))
    paths = F.transform(fitting, lambda n: F.left(path, n))
    count = F.least(F.size(F.split(host, r"\.")), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), count), lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    rules = F.flatten(F.transform(suffixes, lambda s: F.transform(paths, lambda p: F.concat(s, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(rules, F.array(exact_host(host))))


def judge_urls(pages: DataFrame, rules: DataFrame, blocked: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of each row of `pages`.

    `rules` are (host, path, verdict allow or block): a rule fits its host and
    all subdomains if the URL's path starts with the rule's; the longest wins,
    of equal length the one with the longer host, and block if it is listed as
    both. Where no rule fits, `rule` is NULL and the verdict is block if the host
    itself is in `blocked` (one column), else allow. Rules without a host or
    path, NULL or empty, fit nothing. A NULL url and one without `://` have
    empty host and path, fit no rule and are allowed. One row in, one row out;
    repeated rows and NULL ids are rows like others, other columns are not read.
    Runs jobs while it is built.
    """
    require_columns(pages, id_col, url_col)
    rules = rules.select("host", "path", "verdict").filter("host <> '' and path <> ''")
    labels, lengths = rules.agg(F.max(F.size(F.split("host", r"\."))), F.sort_array(F.collect_set(F.length("path")))).first()
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    asked = _asked(F.col("host"), F.col("path"), labels or 1, lengths)

    # The keys of the corpus: hosts and the parts of paths that rules look at are few beside the URLs.
    ways = urls.select("host", F.left("path", F.lit(max(lengths, default=0))).alias("path")).distinct()
    listed = (rules.select(F.concat("host", "path").alias("key"), "verdict")
              .unionByName(blocked.select(exact_host(F.col(blocked.columns[0])).alias("key"), F.lit("block").alias("verdict"))))
    marked = (ways.select(F.explode(asked).alias("key"), F.lit(True).alias("seen"), F.lit(None).cast("string").alias("verdict"))
              .unionByName(listed.select("key", F.lit(False).alias("seen"), "verdict")))
    is_ = lambda verdict: F.coalesce(F.max(F.col("verdict") == verdict), F.lit(False)).alias(verdict)
    keys = materialize(marked.groupBy("key").agg(F.max("seen").alias("seen"), is_("allow"), is_("block")).filter("seen").drop("seen"))

    found = urls.withColumn("__keys", asked)
    for verdict in ("allow", "block"):
        found = members(found, "__keys", build(keys, verdict), f"__{verdict}")
    fits = lambda verdict: F.transform(F.filter(f"__{verdict}", lambda k: ~k.startswith("=")), lambda k: F.struct(
        F.length(k).alias("n"), F.length(F.substring_index(k, "/", 1)).alias("host"), F.lit(verdict).alias("verdict"), k.alias("rule")))
    best = F.array_max(F.concat(fits("allow"), fits("block")))
    by_host = F.when(F.array_contains("__block", exact_host(F.col("host"))), "block").otherwise("allow")
    return (found.withColumn("__best", best)
            .select(F.col(id_col), "host", "path", F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.verdict"), by_host).alias("verdict")))
