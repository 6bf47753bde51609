import json

import pytest
from pyspark.sql import functions as F

from segspark.operators import logs as N, sampling as K, splits as P
from segspark.sources import samples as S
from segspark.streaming import streams as T


def folder(tmp_path):
    for sub, suffix in (("imgs", "img.jpg"), ("gts", "gt.png")):
        (tmp_path / sub).mkdir()
        for i in range(5):
            (tmp_path / sub / f"0000{i}_{suffix}").write_bytes(b"x")
    return tmp_path


def test_index_by_folder(spark, tmp_path):
    d = folder(tmp_path)
    rows = S.scan_samples(spark, str(d / "imgs"), "img.jpg", "/ann", "gt.png").collect()
    assert [r["img_path"].rsplit("/", 1)[1] for r in rows] == [f"0000{i}_img.jpg" for i in range(5)]
    assert [r["seg_map_path"] for r in rows] == [f"/ann/0000{i}_gt.png" for i in range(5)]


def test_listing_reads_no_contents(spark, tmp_path):
    d = folder(tmp_path)
    plan = S.list_files(spark, str(d), "img.jpg")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan


def test_index_by_split_file(spark, tmp_path):
    (tmp_path / "train.txt").write_text("00000\n00001 \n 00002\n00003\n")
    got = [tuple(r) for r in S.samples_from_split(spark.read.text(str(tmp_path / "train.txt")), "imgs", "gts", "_img.jpg", "_gt.png").collect()]
    assert sorted(got) == [(f"imgs/0000{i}_img.jpg", f"gts/0000{i}_gt.png") for i in range(4)]


def test_manifest_file(spark, tmp_path):
    doc = {"name": "BRATS", "description": "d", "tensorImageSize": "4D", "modality": {"0": "FLAIR"}, "labels": {"0": "background", "1": "edema"},
           "numTraining": 2, "numTest": 1, "training": [{"image": f"./imagesTr/{i}.nii.gz", "label": f"./labelsTr/{i}.nii.gz"} for i in range(2)],
           "test": ["./imagesTs/9.nii.gz"]}
    (tmp_path / "dataset.json").write_text(json.dumps(doc, indent=1))
    m = S.read_manifest(spark, str(tmp_path / "dataset.json"))
    assert sorted(r["seg_map_path"] for r in S.manifest_samples(m, F.lit("root")).collect()) == ["root/labelsTr/0.nii.gz", "root/labelsTr/1.nii.gz"]
    assert S.manifest_samples(m, F.lit("root"), "test").first()["img_path"] == "root/imagesTs/9.nii.gz"
    assert {(r["class_id"], r["class_name"]) for r in S.manifest_classes(m).collect()} == {(0, "background"), (1, "edema")}


def test_category_of_depth_file(spark):
    files = spark.createDataFrame([("a/bookstore_0001d_00001.jpg",), ("a/attic_2.jpg",), ("a/none.jpg",)], "img_path string")
    classes = spark.createDataFrame([(2, "bookstore")], "class_id int, class_name string")
    got = {r["img_path"]: (r["depth_map_path"], r["category_id"]) for r in S.depth_samples(files, classes).collect()}
    assert got["a/bookstore_0001d_00001.jpg"] == ("a/bookstore_0001d_00001.png", 2)
    assert got["a/attic_2.jpg"][1] == -1 and got["a/none.jpg"][1] == -1


def test_extension_on_the_line(spark):
    lines = spark.createDataFrame([("a/1.tif",), ("b.c/2",)], "value string")
    got = [tuple(r) for r in S.change_samples(lines, "A", "B", None).collect()]
    assert got == [("A/a/1.tif", "B/a/1.tif"), ("A/b.c/2.jpg", "B/b.c/2.jpg")]


def test_random_split_size_and_repeatability(spark):
    df = spark.range(101).select(F.col("id").cast("string").alias("name"))
    a = P.random_split(df, 0.2, seed=1)
    assert a.filter("split = 'val'").count() == 21
    same = P.random_split(df.repartition(9), 0.2, seed=1)
    assert sorted(a.collect()) == sorted(same.collect())
    assert sorted(a.collect()) != sorted(P.random_split(df, 0.2, seed=2).collect())


def test_expected_count_strict(spark):
    assert P.expect_count(spark.range(3), 3, strict=True).first()["ok"]
    with pytest.raises(Exception, match="unexpected count"):
        P.expect_count(spark.range(3), 4, strict=True).collect()


def test_locate_out_of_range_and_empty_sets(spark):
    idx = lambda *v: spark.createDataFrame([(x,) for x in v], "idx bigint")
    got = [tuple(r) for r in K.locate(idx(0, 2, 3, -1), [3, 0, 2]).collect()]
    assert got == [(0, 0, 0), (2, 0, 2), (3, 2, 0), (-1, 2, 1)]
    with pytest.raises(Exception, match="index out of range"):
        K.locate(idx(5), [3, 0, 2]).collect()


def test_steps_restart_per_run(spark):
    lines = [("a", 0, {"mIoU": 1}), ("a", 1, {"step": 5, "loss": 2}), ("a", 2, {"step": 0, "mIoU": 3}), ("b", 0, {"loss": 9}), ("b", 1, {"step": 7})]
    df = spark.createDataFrame([(r, i, json.dumps(j)) for r, i, j in lines], "run string, line_no bigint, line string")
    got = {(r["run"], r["line_no"]): r["step"] for r in N.fill_steps(N.parse_lines(df), 5).collect()}
    assert got == {("a", 0): 0, ("a", 1): 5, ("a", 2): 5, ("b", 0): 0, ("b", 1): 7}


# --- streams ----------------------------------------------------------------

def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_step_carry_over_batches(spark, tmp_path):
    src, schema = str(tmp_path / "log"), "run bigint, line_no bigint, line string"
    line = lambda r, i, s: (r, i, json.dumps({} if s is None else {"step": s}))
    batches = [[line(1, 0, None), line(1, 1, 3), line(2, 0, 4)], [line(1, 2, None), line(2, 1, 0)], [line(1, 3, 8), line(3, 0, None), line(1, 4, None)]]
    target = str(tmp_path / "out")
    for rows in batches:
        put(spark, tmp_path, "log", rows, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    T.carry_steps(stream, target)
    got = {(r["run"], r["line_no"]): r["step"] for r in spark.read.parquet(f"{target}/rows").collect()}
    want = {(1, 0): 0, (1, 1): 3, (2, 0): 4, (1, 2): 3, (2, 1): 4, (1, 3): 8, (3, 0): 0, (1, 4): 8}
    assert got == want


def test_step_carry_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "COMPACT_EVERY", 2)
    src, schema, target = str(tmp_path / "log"), "run bigint, line_no bigint, line string", str(tmp_path / "out")
    want = {}
    for i in range(6):  # run 1 is touched by every batch, run 2 by the first and the last only
        rows = [(1, i, json.dumps({"step": i + 1} if i % 2 == 0 else {}))]
        want[1, i] = i + 1 if i % 2 == 0 else i
        if i in (0, 5):
            rows.append((2, i, json.dumps({"step": 7} if i == 0 else {})))
            want[2, i] = 7
        put(spark, tmp_path, "log", rows, schema)
        T.carry_steps(spark.readStream.schema(schema).parquet(src), target)
    out = spark.read.parquet(f"{target}/rows")
    assert {(r["run"], r["line_no"]): r["step"] for r in out.collect()} == want
    assert out.count() == len(want) and out.select("batch").distinct().count() == 6
    state = spark.read.parquet(f"{target}/state").groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in state} == {0: 2, 1: 1, 2: 2, 3: 1, 4: 2, 5: 2}


def test_drain_needs_a_place_for_its_checkpoint(spark, tmp_path):
    put(spark, tmp_path, "x", [(1,)], "a int")
    with pytest.raises(ValueError):
        T.drain(spark.readStream.schema("a int").parquet(str(tmp_path / "x")), each=lambda df, i: None)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    schema = "ts timestamp, value double"
    import datetime as dt
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    src = str(tmp_path / "ev")
    for i, rows in enumerate([[(at(1), 1.0), (at(120), 1.0)], [(at(130), 1.0)], [(at(2), 1.0), (at(140), 1.0)]]):
        put(spark, tmp_path, "ev", rows, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
    out = str(tmp_path / "win")
    query = T.drain(T.windowed_throughput(stream, "10 minutes", delay="5 minutes"), out)
    rows = {r["start"].isoformat(): r["n"] for r in spark.read.parquet(out).collect()}
    assert rows.get("2024-01-01T00:00:00") == 1
    assert T.late_rows(query) == 1


def test_sessions_close_in_append_mode(spark, tmp_path):
    import datetime as dt
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    put(spark, tmp_path, "ev", [(1, at(0)), (1, at(3)), (1, at(30)), (2, at(31)), (2, at(300))], "run bigint, ts timestamp")
    stream = spark.readStream.schema("run bigint, ts timestamp").parquet(str(tmp_path / "ev"))
    out = str(tmp_path / "ses")
    T.drain(T.run_sessions(stream, "5 minutes", "1 minute"), out)
    got = sorted((r["run"], r["start"], r["n"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, at(0), 2), (1, at(30), 1), (2, at(31), 1)]


def test_running_metrics_equal_batch(spark, tmp_path, grid):
    from segspark.operators import metrics as M
    px = grid({0: [[0, 1], [1, 255]], 1: [[1, 1], [0, 0]]}).withColumn("pred", F.lit(1))
    for s in (0, 1):
        px.filter(F.col("sample_id") == s).coalesce(1).write.mode("append").parquet(str(tmp_path / "px"))
    stream = spark.readStream.schema(px.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "px"))
    T.running_class_metrics(stream, 2, str(tmp_path / "iou"))
    got = sorted(map(tuple, T.latest_batch(spark, str(tmp_path / "iou")).select("class_id", "iou").collect()))
    want = sorted(map(tuple, M.class_metrics(M.dataset_areas(px, 2)).select("class_id", "iou").collect()))
    assert got == want
