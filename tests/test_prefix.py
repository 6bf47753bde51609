import random

import pytest
from pyspark.sql import functions as F

from segspark.functions import prefix as P


@pytest.fixture(scope="module")
def skewed(spark):
    """Group 0 holds two thirds of the rows."""
    rnd = random.Random(1)
    rows = [(0 if rnd.random() < 0.67 else rnd.randrange(1, 5), i, rnd.randrange(50)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "g int, i int, v int").repartition(5)


@pytest.mark.parametrize("partitions", [1, 7, 33])
def test_running_totals(skewed, partitions):
    rows, df = skewed
    got = {r["i"]: (r["s"], r["n"]) for r in P.running_totals(
        df, [F.col("i").desc()], {"s": F.col("v"), "n": F.lit(1)}, ["g"], partitions).collect()}
    want, acc = {}, {}
    for g, i, v in sorted(rows, key=lambda r: -r[1]):
        s, n = acc.get(g, (0, 0))
        acc[g] = want[i] = (s + v, n + 1)
    assert got == want


def test_row_numbers_without_group(skewed):
    rows, df = skewed
    got = {r["i"]: r["rank"] for r in P.row_numbers(df, [F.col("v"), F.col("i")]).collect()}
    assert got == {r[1]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[2], r[1])), 1)}


@pytest.mark.parametrize("partitions", [1, 16])
def test_carry_forward(spark, partitions):
    rnd = random.Random(2)
    rows = [(i % 3 // 2, i, i if rnd.random() < 0.05 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, i int, v int")
    got = {r["i"]: r["v"] for r in P.carry_forward(df, ["i"], "v", ["g"], partitions).collect()}
    last, want = {}, {}
    for g, i, v in rows:
        last[g] = v if v is not None else last.get(g)
        want[i] = last[g]
    assert got == want


def test_kth_smallest(spark):
    rnd = random.Random(3)
    values = [rnd.choice([0.25, 0.5, rnd.random(), rnd.random() * 1e-6]) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    order = sorted(values)
    for k in (0, 1, 999, 1999, 10**6):
        found = P.kth_smallest(df, "v", k)
        assert found.value == order[min(k, 1999)]
        assert found.below == sum(v < found.value for v in values)
    assert P.kth_value(df.filter("v > 9"), "v", 3) is None
    assert P.kth_value(df.withColumn("v", F.lit(7.0)), "v", 3) == 7.0


def test_top_k_per_group(skewed):
    rows, df = skewed
    got = {(r["g"], r["rank"]): r["i"] for r in P.top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("i")], 7).collect()}
    want = {}
    for g in range(5):
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:7]
        want |= {(g, k): r[1] for k, r in enumerate(best, 1)}
    assert got == want
