import random

import pytest
from pyspark.sql import functions as F

from segspark.llm import queries, urlfilter
from tests.llm.helpers import LOWER, rows_of

RULE = "host string, path string, verdict string"


def plain(url, rules, blocked):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:end].translate(LOWER), rest[end:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules
            if h and p and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "block" if host and host in blocked else "allow"


def judged(spark, urls, rules, blocked):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in urls], "page_id long, url string, host string, verdict string")
    got = rows_of(urlfilter.judge_urls(pages, spark.createDataFrame(rules, RULE), spark.createDataFrame([(b,) for b in blocked], "h string")))
    key = lambda r: str(r)
    want = [(k, *plain(u, rules, blocked)) for k, u in urls]
    assert sorted((tuple(r.values()) for r in got), key=key) == sorted(want, key=key)


ODD = [(1, None), (2, ""), (3, "no scheme"), (4, "://"), (None, "http://a.com/en/x"), (5, "http://a.com"), (5, "http://a.com"), (6, "HTTP://A.B.COM/En/"),
       (7, "x://a.com://b.net/es/"), (8, "http://com/en/"), (9, "http://com.com./"), (10, "http://a.com:80/en/"), (11, "http://u@a.com/?://b.net/es/"),
       (12, "http://" + "a." * 20_000 + "com/en/" + "p" * 100_000), (13, "http://.com/en/"), (14, "http://é.com/ü?x"), (15, "http://xcom/en/"),
       (16, "http://a.com#/en/"), (17, "http://a\nb.com/e\nn/"), (18, "://=a.com/en/")]


def test_odd_urls(spark):
    judged(spark, ODD, queries.URL_RULES + [("é.com", "/ü", "block"), ("a.com", "/en", "allow"), ("com", "/en/x", "block"), ("com", "/en/x", "allow"),
                                           ("", "/x", "block"), ("b.com", "", "block"), ("com.", "/", "block")], ["a.com:80", "com", "u@a.com", ""])


def test_nothing_listed_and_empty_tables(spark):
    judged(spark, ODD, [], [])
    judged(spark, [], queries.URL_RULES, ["a.com"])


@pytest.mark.parametrize("bits", [1 << 26, 4096])
def test_long_lists_as_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(urlfilter, "MAX_BITS", bits)  # the smaller one needs several cascades
    draw = random.Random(7)
    name = lambda: ".".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 4)))
    part = lambda: "/" + "/".join(draw.choice("xyz") for _ in range(draw.randint(0, 3)))
    urls = [(k, f"http://{name()}{part()}?q=://z") for k in range(4000)]
    rules = [(name(), part(), draw.choice(["allow", "block"])) for _ in range(300)]
    judged(spark, urls, rules, [name() for _ in range(700)])


def test_a_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 7 == 0).alias("listed")).cache()
    [cascade] = urlfilter.build(keys, "listed")
    assert len(cascade.levels) > 2
    wrong = keys.withColumn("bits", cascade.bits()).filter(cascade.holds(F.col("key"), F.col("bits")) != F.col("listed"))
    assert wrong.count() == 0


def test_native(spark):
    plan = queries.QUERIES["op13_bloom_cascade"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExternalRDD", "CartesianProduct", "Join"))
