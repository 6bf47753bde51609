"""Operators that work on whole images where they lie: plans, and results against the other path."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from segspark.operators import blocks, distance, losses, masks as M, photo as P


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    d = tmp_path_factory.mktemp("parts")
    n = 40
    pq.write_table(pa.table({"p_partkey": pa.array(range(n), pa.int64()), "p_size": pa.array([k % 7 + 1 for k in range(n)], pa.int32())}), d / "part.parquet")
    return str(d)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", ["l13_match_cost", "l13_match_cost_squared", "e13_mosaic"])
def test_tables_of_a_row_per_image_are_not_broadcast(spark, parts, name):
    """Few bytes of a file may be many rows, which the driver would have to hold."""
    assert "Broadcast" not in plan(entry.queries()[name](spark, parts))


def test_instances_shuffle_nothing_of_dealt_images(spark, parts):
    assert "ENSURE_REQUIREMENTS" not in plan(entry.queries()["c11_instances"](spark, parts))


def test_distort_on_arrays_equals_the_columns(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 256, (400, 3)).tolist()
    v[0], v[1], v[2] = [None, 7, 9], [255, 255, 255], [0, 0, 0]
    px = spark.createDataFrame([(i % 8, 0, i, *map(lambda c: c if c is None else int(c), t)) for i, t in enumerate(v)], "sample_id int, y int, x int, r int, g int, b int")
    sets = [(s, [None, 3.0, -8.0][s % 3], [None, 0.75, 1.25][s // 3 % 3], 1.25 if s % 2 else None, s * 9 if s % 4 > 1 else None, bool(s % 2)) for s in range(8)]
    params = spark.createDataFrame(sets, "sample_id int, brightness double, contrast double, saturation double, hue int, contrast_last boolean")
    out = P.distort(px, params)
    assert "MapInArrow" in plan(out)  # as generated code it was one method too long to be compiled
    step = lambda df, a, b: df.withColumns({c: P.linear(F.col(c).cast("double"), a, b) for c in "rgb"})
    for s, light, contrast, saturation, hue, last in sets:
        want = step(px.filter(F.col("sample_id") == s), 1.0, light or 0.0)
        want = step(want, 1.0 if last else contrast or 1.0, 0.0)
        want = P.saturate(want, F.lit(saturation)) if saturation else want
        want = P.shift_hue(want, F.lit(hue)) if hue is not None else want
        want = step(want, (contrast or 1.0) if last else 1.0, 0.0)
        assert rows(out.filter(F.col("sample_id") == s)) == rows(want)


def test_clahe_of_whole_images_equals_groupings(spark, monkeypatch):
    rng = np.random.default_rng(6)
    some = [(s, y, x, c, float(rng.integers(0, 256) // (s or 1))) for s in (1, 2, 30) for c in (0, 2) for y in range(7) for x in range(11)]
    some += some[:40] + [(None, 0, 0, 0, 3.0)] + [(77, 3, 8, 1, 9.0), (77, 0, 0, 1, 200.0)]
    # Sides of tiles are powers of two, so sums of weights are exact in any order.
    image = spark.createDataFrame(some, "sample_id int, y int, x int, c int, v double")
    whole = P.clahe(image, 7, 11, 3.0, (2, 3))
    assert "MapInArrow" in plan(whole)
    got, kind = rows(whole), whole.schema
    monkeypatch.setattr(P, "BINS", 2 * 2 * 3 * 256)  # an image at a time
    assert rows(P.clahe(image, 7, 11, 3.0, (2, 3))) == got
    monkeypatch.setattr(P, "WHOLE_ROWS", 5)
    other = P.clahe(image, 7, 11, 3.0, (2, 3))
    assert "MapInArrow" not in plan(other) and [f.dataType for f in other.schema] == [f.dataType for f in kind] and other.columns == whole.columns
    assert rows(other) == got


@pytest.mark.parametrize("mode", ["islands", "holes"])
def test_small_regions_of_whole_images_equal_blocks(spark, monkeypatch, mode):
    rng = np.random.default_rng(7)
    some = [(s, y + s, x, int(rng.random() < 0.35 + 0.1 * (s % 4))) for s in range(6) for y in range(12) for x in range(10)]
    some += [(9, 5, 5, 1), (9, 9, 9, 1), (9, 9, 8, 0), (10, 0, 0, 0)] + some[:50] + [(None, 1, 1, 1), (None, 4, 4, 0), (3, 40, 40, None)]
    mask = spark.createDataFrame(some, "sample_id int, y int, x int, v int")
    out = M.remove_small_regions(mask, ["sample_id"], 4, mode)
    assert "parquet" not in plan(out).lower()  # nothing is written on the way
    got = rows(out)
    monkeypatch.setattr(M, "REGION_ROWS", 3)
    assert rows(M.remove_small_regions(mask, ["sample_id"], 4, mode)) == got


def test_distances_of_several_masks(spark):
    rng = np.random.default_rng(8)
    some = [(s, y, x, int(rng.random() < 0.8), int(s != 1)) for s in range(3) for y in range(9) for x in range(4 + s)]
    some += [(4, y, 3, int(y != 60), 1) for y in range(90)] + some[:30] + [(None, 0, 0, 1, 0), (None, 0, 1, 1, 1)]
    px = spark.createDataFrame(some, "sample_id int, y int, x int, a int, b int")
    found = distance.mask_distances(px, ["sample_id"], ["a", "b"]).collect()
    assert len(found) == len(some)
    for r in found:
        for m, k in (("a", 3), ("b", 4)):
            zero = [(y, x) for s, y, x, *v in some if s == r["sample_id"] and v[k - 3] == 0]
            want = min(((r["y"] - y) ** 2 + (r["x"] - x) ** 2 for y, x in zero), default=None)
            assert r[f"d2_{m}"] == want


@pytest.mark.parametrize("mode", ["reference", "class"])
def test_hausdorff_sends_a_pixel_once(spark, monkeypatch, mode):
    rng = np.random.default_rng(9)
    some = [(s, y, x, int(rng.integers(0, 4)) if rng.random() < 0.9 else 255, rng.normal(size=4).tolist()) for s in range(4) for y in range(6) for x in range(7)]
    px = spark.createDataFrame(some, "sample_id int, y int, x int, gt int, logits array<double>")
    out = losses.hausdorff(px, 4, mode=mode)
    assert "Generate" not in plan(out)  # a row per mask
    got = out.first()["loss"]
    monkeypatch.setattr(losses, "WHOLE_ROWS", 5)
    assert got == pytest.approx(losses.hausdorff(px, 4, mode=mode).first()["loss"], rel=1e-12) and got > 0


def test_blocks_that_are_alike_are_worked_on_together(spark):
    px = spark.createDataFrame([(s, y, x) for s in range(3) for y in range(2) for x in range(2 + s // 2)], "sample_id int, y int, x int").coalesce(1)
    work = lambda b: np.full(len(b.which), b.full[0], np.int32)
    out = blocks.over_blocks(px.repartition(1, "sample_id"), ["sample_id"], ["y", "x"], [8, 8], [0, 0], work, T.StructField("n", T.IntegerType()), ["sample_id"])
    assert {(r["sample_id"], r["n"]) for r in out.collect()} == {(0, 2), (1, 2), (2, 1)}
