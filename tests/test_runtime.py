import pathlib
import re

import pytest
from pyspark.sql import functions as F

from segspark import runtime as R


def test_scratch_dir_is_the_shared_one(spark):
    assert R.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.range(10).withColumn("a", F.array("id"))
    back = R.materialize(df)
    assert back.dtypes == df.dtypes and back.count() == 10


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_side_salted_equals_plain(spark, how):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    side = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    want = sorted(big.join(side, "k", how).collect())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = R.join_side(big, side, ["k"], how)
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(joined.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_generated_side_is_never_broadcast(spark):
    big = spark.range(100).withColumnRenamed("id", "k")
    side = spark.range(2).select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k"))
    assert "BroadcastHashJoin" not in R.join_side(big, side, ["k"], "left_semi")._jdf.queryExecution().executedPlan().toString()


def test_require_columns(spark):
    with pytest.raises(ValueError):
        R.require_columns(spark.range(1), "nope")


def test_no_forbidden_calls_in_the_library():
    root = pathlib.Path(R.__file__).parent
    text = "\n".join(p.read_text() for p in root.rglob("*.py"))
    for word in ("localCheckpoint", "crossJoin", ".toPandas(", "sparkContext.parallelize", "F.rand("):
        assert word not in text, word
    # Drivers only see counts, scalars and error samples.
    assert len(re.findall(r"\.collect\(\)", text)) <= 1


def test_scope_removes_what_operators_wrote(spark, tmp_path):
    from segspark.functions import prefix
    folder = pathlib.Path(re.sub("^file:(//)?", "", R.scratch_dir(spark)))
    before = set(folder.iterdir()) if folder.exists() else set()
    kept = R.materialize(spark.range(3))
    with R.scratch_scope():
        out = prefix.row_numbers(spark.range(50), [F.col("id")])
        out.write.parquet(str(tmp_path / "out"))
        assert len(set(folder.iterdir()) - before) > 1
    assert len(set(folder.iterdir()) - before) == 1 and kept.count() == 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_images_are_dealt_over_as_many_tasks_as_they_need(spark, tmp_path, monkeypatch):
    """Many splits or few: tasks grow with the images, and grouping their pixels needs no other shuffle."""
    from segspark import runtime
    from segspark.plans import fixtures as X
    rows = spark.range(400).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size")
    rows.repartition(32).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(runtime, "IMAGES_PER_TASK", 10)
    image = X.image(spark, str(tmp_path))
    assert image.rdd.getNumPartitions() == 40
    plan = image.groupBy("sample_id", "y", "x").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert X.pixels(spark, str(tmp_path)).count() == 400 * X.SIDE**2


def _dealt(spark, n=40):
    ids = R.by_image(spark.range(n).select((F.col("id") % 30).alias("i")), "i")
    return ids.select("i", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("y"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_pixels_equals_a_join_and_shuffles_nothing_of_dealt_tables(spark, how):
    """Keys that repeat or are NULL on both sides; rows without a key stay in a left join."""
    cells = "i long, y int, v int"
    left = spark.createDataFrame([(1, 0, 5), (1, 0, 5), (1, 1, None), (None, 0, 7), (None, 0, 7), (2, None, 8), (3, 0, 9)], cells)
    right = spark.createDataFrame([(1, 0, 50), (1, 0, 51), (1, 1, None), (None, 0, 70), (2, None, 80), (4, 0, 90)], "i long, y int, w int")
    want = left.join(right, ["i", "y"], how)
    got = R.join_pixels(left, right, ["i", "y"], how)
    assert got.dtypes == want.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    near = R.join_pixels(_dealt(spark).withColumn("v", F.lit(1)), _dealt(spark).withColumn("w", F.lit(2)), ["i", "y"], how)
    assert "ENSURE_REQUIREMENTS" not in near._jdf.queryExecution().executedPlan().toString()
    assert near.count() == 10 * (10 * 4 + 20)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_side_takes_repeated_and_missing_keys_and_shuffles_nothing_of_dealt_tables(spark, how, monkeypatch):
    monkeypatch.setattr(R, "_fits_broadcast", lambda df: False)
    big = spark.createDataFrame([(1, 5), (1, 6), (None, 7), (2, 8), (3, None)], "k int, v int")
    side = spark.createDataFrame([(1, 50), (1, 51), (None, 70), (3, None)], "k long, w int")
    want, got = big.join(side, "k", how), R.join_side(big, side, ["k"], how)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    rows = _dealt(spark)
    near = R.join_side(rows, rows.select("i").distinct().withColumn("w", F.lit(2)), ["i"], how)
    assert "ENSURE_REQUIREMENTS" not in near._jdf.queryExecution().executedPlan().toString()
    assert near.count() == (0 if how == "left_anti" else 400)
