import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import to_dict
from segspark.operators import labels as L, metrics as M


def blocks():
    a = np.zeros((10, 10), dtype=int)
    a[2:4, 2:4], a[2:4, 6:8], a[6:8, 2:4], a[6:8, 6:8] = 1, 2, 3, 4
    return a


def as_array(df, value, shape):
    out = np.full(shape, -1)
    for (s, y, x), v in to_dict(df, value).items():
        out[y, x] = v
    return out


@pytest.mark.parametrize("mapping", [{3: 1}, {3: 2, 4: 1}, {1: 2, 2: 1}])
def test_label_map_is_simultaneous(spark, grid, mapping):
    a = blocks()
    m = spark.createDataFrame(list(mapping.items()), "old_id int, new_id int")
    want = np.vectorize(lambda v: mapping.get(v, v))(a)
    assert (as_array(L.apply_label_map(grid({0: a}), m), "gt", a.shape) == want).all()


def test_reduce_zero_then_map(spark, grid):
    a = blocks()
    a[0, 0] = 255
    m = spark.createDataFrame([(0, 0), (1, 255), (2, 1), (3, 2)], "old_id int, new_id int")
    got = as_array(L.prepare_labels(grid({0: a}), True, m), "gt", a.shape)
    want = np.vectorize({0: 255, 255: 255, 1: 0, 2: 255, 3: 1, 4: 2}.get)(a)
    assert (got == want).all()


def test_label_map_from_names(spark):
    old = spark.createDataFrame([(0, "road"), (1, "car"), (2, "sky")], "class_id int, class_name string")
    new = spark.createDataFrame([(0, "sky"), (1, "road")], "class_id int, class_name string")
    assert {r["old_id"]: r["new_id"] for r in L.build_label_map(old, new).collect()} == {0: 1, 1: 255, 2: 0}
    with pytest.raises(ValueError):
        L.build_label_map(new, old)


def test_unknown_alias_fails(spark):
    from segspark import catalog as K
    ask = lambda *n: spark.createDataFrame([(x,) for x in n], "alias string")
    found = L.classes_of(K.alias_table(spark), K.class_tables(spark), ask("voc12"))
    assert found.count() == 21
    with pytest.raises(Exception, match="unrecognized dataset"):
        L.classes_of(K.alias_table(spark), K.class_tables(spark), ask("nope")).collect()


def test_voc_palette_rule():
    from segspark import catalog as K
    assert K.voc_palette(4) == ((0, 0, 0), (128, 0, 0), (0, 128, 0), (128, 128, 0))
    assert K.voc_palette(21)[20] == (0, 64, 128)


def numpy_areas(gt, pred, n):
    m = gt != 255
    g, p = gt[m], pred[m]
    hist = lambda v: np.array([(v == c).sum() for c in range(n)])
    i, pa, la = hist(p[p == g]), hist(p), hist(g)
    return i, pa, la, pa + la - i


@pytest.fixture(scope="module")
def scene():
    rng = np.random.default_rng(0)
    gt = {s: rng.integers(0, 5, (16, 16)) for s in range(3)}
    pred = {s: np.where(rng.random((16, 16)) < 0.6, gt[s], rng.integers(0, 7, (16, 16))) for s in gt}
    for s in gt:
        gt[s][rng.random((16, 16)) < 0.1] = 255
    return gt, pred


def scene_px(grid, scene):
    return grid(scene[0]).join(grid(scene[1], "pred"), ["sample_id", "y", "x"])


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_areas_do_not_depend_on_partitions(grid, scene, parts):
    px = scene_px(grid, scene).repartition(parts)
    per = {(r["sample_id"], r["class_id"]): tuple(r)[2:] for r in M.image_areas(px, 5).collect()}
    for s in scene[0]:
        want = list(zip(*numpy_areas(scene[0][s], scene[1][s], 5)))
        assert [per[s, c] for c in range(5)] == [tuple(int(v) for v in w) for w in want]


def test_summary_matches_numpy(grid, scene):
    g = np.concatenate([scene[0][s].ravel() for s in scene[0]])
    p = np.concatenate([scene[1][s].ravel() for s in scene[0]])
    i, pa, la, u = numpy_areas(g, p, 6)
    with np.errstate(all="ignore"):
        iou, acc, dice = i / u, i / la, 2 * i / (pa + la)
    got = M.summary(M.dataset_areas(scene_px(grid, scene), 6), ["mIoU", "mDice"]).first()
    assert got["a_acc"] == pytest.approx(round(100 * i.sum() / la.sum(), 2), abs=0.011)
    assert got["m_iou"] == pytest.approx(100 * np.nanmean(iou), abs=0.011)
    assert got["m_dice"] == pytest.approx(100 * np.nanmean(dice), abs=0.011)
    filled = M.summary(M.dataset_areas(scene_px(grid, scene), 6), "mIoU", nan_to_num=-1).first()
    assert filled["m_acc"] == pytest.approx(100 * np.nan_to_num(acc, nan=-1).mean(), abs=0.011)


def test_confusion_sums_to_valid_pixels(grid, scene):
    px = scene_px(grid, scene)
    valid = px.filter("gt != 255 and pred < 5").count()
    conf = M.confusion(px, 5)
    assert conf.count() == 25 and conf.agg(F.sum("n")).first()[0] == valid
    wide = M.confusion_wide(conf, 5)
    assert wide.count() == 5 and len(wide.columns) == 6


def test_all_ignored_and_empty(grid):
    px = grid({0: [[255, 255]]}).withColumn("pred", F.lit(1))
    assert all(r["iou"] is None for r in M.class_metrics(M.dataset_areas(px, 3)).collect())
    assert M.summary(M.dataset_areas(px, 3)).first()["m_iou"] is None
    assert M.image_areas(px.limit(0), 3).count() == 0


def test_unknown_metric(grid):
    with pytest.raises(KeyError):
        M.class_metrics(grid({0: [[1]]}), "mXyz")
    with pytest.raises(KeyError):
        M.depth_per_image(grid({0: [[1]]}), ["d9"])


def test_depth_metrics_with_negative_predictions(spark):
    rng = np.random.default_rng(1)
    gt, good = rng.uniform(0.5, 9, 50), rng.uniform(0.5, 9, 50)
    bad = good.copy()
    bad[3] = -1.0
    rows = [(s, i, 0, float(g), float(p)) for s, pr in ((0, good), (1, bad)) for i, (g, p) in enumerate(zip(gt, pr))]
    df = spark.createDataFrame(rows, "sample_id int, y int, x int, gt_depth double, pred_depth double")
    got = {r["sample_id"]: r for r in M.depth_per_image(df).collect()}
    dl = np.log(good) - np.log(gt)
    ratio = np.maximum(gt / good, good / gt)
    want = {"d1": (ratio < 1.25).mean(), "abs_rel": (abs(good - gt) / gt).mean(), "rmse": math.sqrt(((good - gt) ** 2).mean()),
            "rmse_log": math.sqrt((dl**2).mean()), "log10": abs(dl / math.log(10)).mean(),
            "silog": math.sqrt((dl**2).mean() - 0.5 * dl.mean() ** 2)}
    for k, v in want.items():
        assert got[0][k] == pytest.approx(v, rel=1e-9)
    assert math.isnan(got[1]["rmse_log"]) and not math.isnan(got[1]["rmse"])


def test_topk_accuracy(spark):
    rng = np.random.default_rng(2)
    logits, gt = rng.normal(size=(200, 6)), rng.integers(0, 6, 200)
    df = spark.createDataFrame([([float(v) for v in l], int(g)) for l, g in zip(logits, gt)], "logits array<double>, gt int")
    got = M.topk_accuracy(df, (1, 3)).first()
    order = np.argsort(-logits, axis=1)
    for k in (1, 3):
        assert got[f"acc_{k}"] == pytest.approx(100 * (order[:, :k] == gt[:, None]).any(1).mean(), abs=1e-4)
    assert M.topk_accuracy(df.withColumn("gt", F.lit(255)), (1,), ignore=255).first()["acc_1"] == pytest.approx(100.0)


@pytest.mark.parametrize("bucket", [3, 64])
def test_confusion_from_runs(spark, grid, scene, bucket):
    from segspark.operators import masks
    px = scene_px(grid, scene).withColumn("pos", F.col("y") * 16 + F.col("x"))
    runs = lambda c: masks.encode_runs(px.select("sample_id", "pos", F.col(c).alias("label")), ["sample_id"], chunk=10)
    got = {(r["gt"], r["pred"]): r["n"] for r in M.confusion_from_runs(runs("gt"), runs("pred"), bucket).collect()}
    want = {(r["gt"], r["pred"]): r["n"] for r in M.pair_counts(px).collect()}
    assert got == want


RUNS = "sample_id string, start bigint, len bigint, label int"


def test_confusion_of_runs_with_gaps(spark):
    rng = np.random.default_rng(3)

    def side():
        rows, cells = [], {}
        for s in ("a", "b"):
            at = 0
            for _ in range(60):
                at += int(rng.integers(0, 3))
                n, label = int(rng.integers(0, 6)), int(rng.integers(0, 4))
                rows.append((s, at, n, label))
                cells.update({(s, at + i): label for i in range(n)})
                at += n
        return spark.createDataFrame(rows, RUNS), cells

    (gt, g), (pred, p) = side(), side()
    want = {}
    for k in g.keys() & p.keys():
        if g[k] != 2:
            want[g[k], p[k]] = want.get((g[k], p[k]), 0) + 1
    assert {(r["gt"], r["pred"]): r["n"] for r in M.confusion_from_runs(gt, pred, 5, ignore=2).collect()} == want


def test_confusion_of_a_huge_run(spark):
    gt = spark.createDataFrame([("a", 0, 10 ** 9, 1), ("a", 10 ** 9, 5, 3)], RUNS)
    pred = spark.createDataFrame([("a", 7, 10 ** 9 - 7, 2), ("a", 10 ** 9, 9, 3), ("b", 0, 4, 3)], RUNS)
    got = {(r["gt"], r["pred"]): r["n"] for r in M.confusion_from_runs(gt, pred).collect()}
    assert got == {(1, 2): 10 ** 9 - 7, (3, 3): 5}
    assert M.confusion_from_runs(gt.filter("false"), pred).count() == 0


def test_presence_sends_no_pixel_table_to_the_driver(spark):
    """The labels seen come from a row generator, whose planned size is far too low for a broadcast."""
    ids = spark.range(50).select(F.col("id").alias("sample_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("gt"))
    out = L.class_presence(ids, spark.createDataFrame([(1,), (2,), (3,)], "class_id int"))
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(out.groupBy("class_id").agg(F.sum("present")).collect()) == [(1, 50), (2, 50), (3, 0)]


def test_confusion_from_runs_gives_a_task_a_bounded_number_of_starts(spark, monkeypatch):
    used = []
    plain = M.segments
    monkeypatch.setattr(M, "STARTS_PER_TASK", 10)
    monkeypatch.setattr(M, "segments", lambda df, pos, cols, group, n: used.append(n) or plain(df, pos, cols, group, n))
    runs = lambda m: spark.range(100).select((F.col("id") % 3).alias("sample_id"), (F.col("id") * 2).alias("start"),
                                             F.lit(2).alias("len"), (F.col("id") % m).cast("int").alias("label"))
    got = {(r["gt"], r["pred"]): r["n"] for r in M.confusion_from_runs(runs(2), runs(1)).collect()}
    assert used == [20] and got == {(0, 0): 100, (1, 0): 100}
