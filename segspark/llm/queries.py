"""Queries opN_<name> of this subpackage and the SQL that states the same result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm import bpe, decontaminate, divergence, language, lm, neardup, passages, pii, quality, spelling, toxicity, urlfilter, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has this remainder; a NULL id has none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


@query("op1_zstd_toxicity")
def op1_zstd_toxicity(spark, sf_dir):
    docs, held_out = table(spark, sf_dir, "documents"), fold(5, 0)
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_windows", "top_gain")


# Words of a text, lower-cased in ASCII only.
_WORDS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS gram
  FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT r, s, size, array_to_string(w[s:s + size - 1], ' ') AS gram
  FROM d, sizes, unnest(range(1, greatest(1, len(w) - size + 2))) AS u(s)),
hits AS (SELECT r, s, size, item_id FROM doc_windows JOIN item_windows USING (size, gram)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + size)) AS u(p) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


@query("op2_winnowing", CONTAMINATION_SQL)
def op2_winnowing(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query("op3_minhash_join")
def op3_minhash_join(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("row_key")


# The SQL states what the archives must give back; sizes and digests there are those of the bytes read.
ARCHIVE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS digest,
             octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)"""


@query("op4_warc_index", ARCHIVE_SQL)
def op4_warc_index(spark, sf_dir):
    records = warc.archive_and_read(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_language_spans")
def op5_language_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = fold(3, 1)
    model = language.train(docs, where=~held_out & F.col("doc_id").isNotNull())
    labelled = language.label_documents(docs, model, ["doc_id"], spans=False)
    return labelled.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op6_quality_ratio")
def op6_quality_ratio(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality.judge_documents(docs, quality.fit_ratio(docs, trusted))


#: Key of the surrogates in the registered queries; a real run takes its own from a secret store.
SURROGATE_KEY = "registered-queries"


@query("op7_surrogates")
def op7_surrogates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, SURROGATE_KEY, entities_col="n_entities")


@query("op8_byte_bpe")
def op8_byte_bpe(spark, sf_dir):
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                  public_tokenizers.PATTERN)


@query("op9_backoff_automaton")
def op9_backoff_automaton(spark, sf_dir):
    docs, held_out = table(spark, sf_dir, "documents"), fold(7, 2)
    scored = lm.score_documents(docs, ~held_out & F.col("doc_id").isNotNull(), stored=True)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op10_compact_windows")
def op10_compact_windows(spark, sf_dir):
    return passages.passage_report(table(spark, sf_dir, "documents"))


#: Fixed values of the contract: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
             ("net", "/fr/", "block")]
#: Hosts with one of these words as a part of their name are listed as blocked.
BLOCKED_PARTS = "(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)"

URL_SQL = f"""
WITH u AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(rule_host, rule_path, said) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
n AS (SELECT row_number() OVER () AS r, * FROM u),
best AS (SELECT r, arg_max(rule_host || rule_path, (length(rule_host || rule_path), length(rule_host))) AS rule,
    arg_max(said, (length(rule_host || rule_path), length(rule_host))) AS said
  FROM n, rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r)
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL THEN said WHEN regexp_matches(host, '{BLOCKED_PARTS}') THEN 'block' ELSE 'allow' END AS verdict
FROM n LEFT JOIN best USING (r)"""


@query("op13_bloom_cascade", URL_SQL)
def op13_bloom_cascade(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host = urlfilter.split_url(F.col("url"))[0]
    blocked = pages.select(host.alias("host")).filter(F.col("host").rlike(BLOCKED_PARTS)).distinct()
    return urlfilter.judge_urls(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"), blocked)


DIVERGENCE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
tf AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS m FROM tf GROUP BY ALL HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS kinds, sum(m) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT g.lang, g.source, kept.term, m, coalesce(n, 0) AS n
  FROM g JOIN kept USING (lang) LEFT JOIN tf ON tf.lang = g.lang AND tf.source = g.source AND tf.term = kept.term),
s AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
p AS (SELECT cells.*, 1 + (1000000000::HUGEINT * (n + 5)) // (s.total + 5 * kinds) AS p,
    1 + (1000000000::HUGEINT * (m + 5)) // (v.total + 5 * kinds) AS q FROM cells JOIN s USING (lang, source) JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) GROUP BY ALL),
parts AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN sums ON sums.lang = x.lang AND sums.source = x.source AND sums.item = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50"""


@query("op11_skyband_audit", DIVERGENCE_SQL)
def op11_skyband_audit(spark, sf_dir):
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


# Near words: one is the other without a code point, or both are equal but for one at the same place.
VARIANTS_SQL = """
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS c FROM range(256) AS u(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS steps FROM bits WHERE k = 8),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
runs AS (SELECT id, run, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(text, '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM d)
  WHERE length(run) >= 6 GROUP BY ALL),
spelled AS (SELECT run, n, hex(encode(id || ':' || run)) AS x FROM runs),
summed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x) // 2),
    lambda i: CAST((strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1 AS BIGINT))),
    lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM spelled, crc),
left_over AS (SELECT n, CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM summed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM left_over WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM words, unnest(range(length(word))) AS u(i)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b USING (i, rest) WHERE a.word <> b.word UNION
  SELECT cuts.word, words.word, words.n FROM cuts JOIN words ON words.word = rest UNION
  SELECT words.word, cuts.word, cuts.n FROM cuts JOIN words ON words.word = rest),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
named AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * words.n THEN other END AS form,
    CASE WHEN other_n >= 5 * words.n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, form, 1 AS step FROM named WHERE form IS NOT NULL UNION ALL
  SELECT chain.word, named.form, step + 1 FROM chain JOIN named ON named.word = chain.form WHERE named.form IS NOT NULL),
ends AS (SELECT word, arg_max(form, step) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM named LEFT JOIN ends USING (word)"""


@query("op12_partenum_variants", VARIANTS_SQL)
def op12_partenum_variants(spark, sf_dir):
    return spelling.group_variants(table(spark, sf_dir, "documents"))
