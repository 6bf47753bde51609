import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from segspark.operators import losses as J, predict as H, sampling as K


@pytest.fixture(scope="module")
def batch(spark):
    rng = np.random.default_rng(5)
    logits, gt = rng.normal(size=(4, 36, 5)), rng.integers(0, 5, (4, 36))
    gt[rng.random(gt.shape) < 0.1] = 255
    rows = [(s, p // 6, p % 6, [float(v) for v in logits[s, p]], int(gt[s, p])) for s in range(4) for p in range(36)]
    return logits, gt, spark.createDataFrame(rows, "sample_id int, y int, x int, logits array<double>, gt int")


def softmax(x):
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def value(df):
    return df.first()["loss"]


@pytest.mark.parametrize("classes", [5, None])
def test_cross_entropy(batch, classes):
    logits, gt, df = batch
    p, ok = softmax(logits), gt != 255
    l = -np.log(np.take_along_axis(p, np.where(ok, gt, 0)[..., None], -1)[..., 0]) * ok
    assert value(J.cross_entropy(df, classes)) == pytest.approx(l.mean())
    assert value(J.cross_entropy(df, classes, avg_non_ignore=True)) == pytest.approx(l.sum() / ok.sum(), rel=1e-6)
    assert value(J.cross_entropy(df, classes, reduction="sum")) == pytest.approx(l.sum())
    assert value(J.cross_entropy(df, classes, class_weight=[1.0] * 5, avg_non_ignore=True)) == pytest.approx(l.sum() / ok.sum(), rel=1e-6)


def test_reduction_contract(batch):
    with pytest.raises(ValueError):
        J.reduce_loss(batch[2], "gt", reduction="sum", avg_factor=3.0)
    with pytest.raises(ValueError):
        J.reduce_loss(batch[2], "gt", reduction="median")
    with pytest.raises(ValueError):
        J.tversky(batch[2], 5, alpha=0.3, beta=0.3)
    with pytest.raises(ValueError):
        J.dice(batch[2], 1, ignore_class=0)


def lovasz(err, fg):
    o = np.argsort(-err, kind="stable")
    e, f = err[o], fg[o]
    inter, union = f.sum() - f.cumsum(), f.sum() + (1 - f).cumsum()
    j = 1 - inter / union
    j[1:] -= j[:-1].copy()
    return float((np.maximum(e, 0) * j).sum())


@pytest.mark.parametrize("chosen", ["present", "all", [1, 3]])
@pytest.mark.parametrize("per_image", [False, True])
def test_lovasz_softmax(batch, chosen, per_image):
    logits, gt, df = batch
    p = softmax(logits)

    def one(p, g):
        ok = g != 255
        p, g = p[ok], g[ok]
        wanted = range(5) if isinstance(chosen, str) else chosen
        parts = [lovasz(abs((g == c) - p[:, c]), (g == c).astype(float)) for c in wanted if chosen != "present" or (g == c).any()]
        return np.mean(parts)

    want = np.mean([one(p[s], gt[s]) for s in range(4)]) if per_image else one(p.reshape(-1, 5), gt.ravel())
    assert value(J.lovasz_softmax(df, 5, chosen, per_image)) == pytest.approx(want)


@pytest.mark.parametrize("per_image", [False, True])
def test_lovasz_hinge(batch, per_image):
    logits, gt, df = batch
    rows = df.select("sample_id", F.get("logits", F.lit(0)).alias("logit"), F.when(F.col("gt") == 255, 255).otherwise(F.col("gt") % 2).alias("gt"))

    def one(x, g):
        ok = g != 255
        x, g = x[ok], g[ok] % 2
        return lovasz(1 - x * (2.0 * g - 1), g.astype(float))

    want = np.mean([one(logits[s, :, 0], gt[s]) for s in range(4)]) if per_image else one(logits[..., 0].ravel(), gt.ravel())
    assert value(J.lovasz_hinge(rows, per_image)) == pytest.approx(want)


def test_dice_and_tversky(batch):
    logits, gt, df = batch
    p = softmax(logits)
    hot = (gt[..., None] == np.arange(5)).astype(float)
    a, b, c = (p * hot).sum((1, 2)), (p * p).sum((1, 2)) + 1e-3, hot.sum((1, 2)) + 1e-3
    assert value(J.dice(df, 5)) == pytest.approx((1 - 2 * a / (b + c)).mean())
    ok = (gt != 255)[..., None]
    tp, fp, fn = ((p * hot * ok).sum(1), (p * (1 - hot) * ok).sum(1), ((1 - p) * hot * ok).sum(1))
    assert value(J.tversky(df, 5)) == pytest.approx((1 - (tp + 1) / (tp + 0.3 * fp + 0.7 * fn + 1)).mean(0).sum() / 5)


def test_silog_golden(spark):
    pred, target, weight = [[1, 2], [3.5, 4]], [[0, 2], [3, 4]], [1, 0.5]
    rows = [(s, float(p), float(t), float(weight[s])) for s in range(2) for p, t in zip(pred[s], target[s])]
    df = spark.createDataFrame(rows, "sample_id int, pred_depth double, gt_depth double, w double")
    assert value(J.silog(df, weight="w")) == pytest.approx(0.02, abs=0.005)


def test_kl_modes(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], [2.0, 0.5])], "sample_id int, logits array<double>, target_logits array<double>")
    p, t = softmax(np.array([1.0, 2.0])), softmax(np.array([2.0, 0.5]))
    assert value(J.kl_divergence(df)) == pytest.approx((t * (np.log(t) - p)).mean())
    assert value(J.kl_divergence(df, mode="kl", reduction="sum")) == pytest.approx((t * np.log(t / p)).sum())


def test_hard_pixel_weights(batch):
    _, gt, df = batch
    scored = J.target_scores(df, 5)
    by_loss = K.hard_pixels_by_loss(scored, ["sample_id", "y", "x"], 5, batch_size=4)
    rows = by_loss.select("loss", "weight").collect()
    kept = [r["loss"] for r in rows if r["weight"] == 1]
    assert len(kept) == 20 and min(kept) >= max(r["loss"] for r in rows if r["weight"] == 0)
    conf = K.hard_pixels_by_confidence(scored, 0.7, 5, batch_size=4).select("prob", "weight").collect()
    probs = sorted(r["prob"] for r in conf)
    cut = max(0.7, probs[20])
    assert all((r["prob"] < cut) == (r["weight"] == 1) for r in conf)


def test_hard_pixels_break_ties_by_position(batch):
    tied = J.target_scores(batch[2], 5).withColumn("loss", F.lit(1.0))
    got = [(r["sample_id"], r["y"], r["x"]) for r in K.hard_pixels_by_loss(tied, ["sample_id", "y", "x"], 7).filter("weight = 1").collect()]
    assert sorted(got) == sorted((r["sample_id"], r["y"], r["x"]) for r in tied.collect())[:7]


def test_distance_transform(spark):
    rng = np.random.default_rng(6)
    fg = (rng.random((9, 11)) < 0.7).astype(int)
    df = spark.createDataFrame([(0, y, x, int(fg[y, x])) for y in range(9) for x in range(11)], "sample_id int, y int, x int, fg int")
    zeros = np.argwhere(fg == 0)
    for r in J.squared_distance_transform(df).collect():
        assert r["d2"] == ((zeros - [r["y"], r["x"]]) ** 2).sum(1).min()


@pytest.mark.parametrize("height, width, share, block", [(300, 5, 0.995, 2), (40, 70, 0.9, 64), (7, 3, 1.0, 64)])
def test_distance_transform_of_many_masks(spark, height, width, share, block):
    rng = np.random.default_rng(height)
    fg = (rng.random((2, height, width)) < share).astype(int)
    rows = [(k, y, x, int(fg[k, y, x]), y * width + x) for k in range(2) for y in range(height) for x in range(width)]
    df = spark.createDataFrame(rows, "mask int, y int, x int, fg int, extra int").repartition(5)
    got = J.squared_distance_transform(df, ("mask",), block).collect()
    layered = J.squared_distance_transform(df.withColumn("s", F.lit("a")), ("s",), block, "mask", 2).drop("s").collect()
    assert set(got) == set(layered)
    assert len(got) == len(rows)
    zeros = [np.array([(y, x) for m, y, x, f, _ in rows if m == k and f == 0]).reshape(-1, 2) for k in range(2)]
    for r in got:
        near = ((zeros[r["mask"]] - [r["y"], r["x"]]) ** 2).sum(1)
        assert r["d2"] == (near.min() if len(near) else None) and r["extra"] == r["y"] * width + r["x"]


def test_softmax_paths_agree(batch):
    df = batch[2]
    long = H.class_probabilities(df).select(F.explode("probs").alias("p")).agg(F.sum(F.col("p") * F.col("p"))).first()[0]
    short = H.class_probabilities(df, 5).select(F.explode("probs").alias("p")).agg(F.sum(F.col("p") * F.col("p"))).first()[0]
    assert long == pytest.approx(short) and not math.isnan(long)


@pytest.mark.parametrize("limit", [32, 0])
def test_reductions_over_classes(batch, monkeypatch, limit):
    """The form for few and the one for many classes give the plain result under every reduction."""
    monkeypatch.setattr(J.C, "UNROLL_LIMIT", limit)
    logits, gt, df = batch
    df = df.withColumn("w", 1.0 + F.col("y") % 3)
    hot, ok = (gt[..., None] == np.arange(5)).astype(float), (gt != 255)[..., None]
    w = (1.0 + np.arange(36) // 6 % 3)[None, :, None] * ok
    plain = np.maximum(logits, 0) - logits * hot + np.log1p(np.exp(-np.abs(logits)))
    p = 1 / (1 + np.exp(-logits))
    hard = plain * (0.3 * hot + 0.7 * (1 - hot)) * ((1 - p) * hot + p * (1 - hot)) ** 2 * np.arange(1, 6)
    for loss, each, more in ((J.binary_cross_entropy, plain, {}), (J.focal, hard, {"alpha": 0.3, "class_weight": [1.0, 2.0, 3.0, 4.0, 5.0]})):
        assert value(loss(df, 5, **more)) == pytest.approx((each * ok).mean())
        assert value(loss(df, 5, weight="w", **more)) == pytest.approx((each * w).mean())
        assert value(loss(df, 5, weight="w", reduction="sum", **more)) == pytest.approx((each * w).sum())
        assert value(loss(df, 5, weight="w", avg_factor=7.0, **more)) == pytest.approx((each * w).sum() / 7)
        rows = loss(df, 5, weight="w", reduction="none", **more).collect()
        got = {(r["sample_id"], r["y"] * 6 + r["x"], r["class_id"]): r["loss"] for r in rows}
        assert len(got) == each.size and all(v == pytest.approx((each * w)[k]) for k, v in got.items())
        with pytest.raises(ValueError):
            loss(df, 5, reduction="sum", avg_factor=2.0)
    assert value(J.binary_cross_entropy(df, 5, avg_non_ignore=True)) == pytest.approx((plain * ok).sum() / ok.sum() / 5)
    test_dice_and_tversky((logits, gt, df))
    test_lovasz_softmax((logits, gt, df), [1, 3], True)


@pytest.mark.parametrize("skip", [None, 2])
def test_dice_reductions(batch, skip):
    logits, gt, df = batch
    kept = [i for i in range(5) if i != skip]
    p, hot = softmax(logits)[..., kept], (gt[..., None] == np.array(kept)).astype(float)
    each = (1 - 2 * (p * hot).sum((1, 2)) / ((p * p).sum((1, 2)) + 1e-3 + hot.sum((1, 2)) + 1e-3)) * np.array([1.0, 2.0, 3.0, 4.0])
    df = df.withColumn("w", 1.0 + F.col("sample_id"))
    got = J.dice(df, 5, ignore_class=skip, weight="w", reduction="none").orderBy("sample_id").collect()
    assert [r["loss"] for r in got] == pytest.approx(list(each))
    assert value(J.dice(df, 5, ignore_class=skip, weight="w", reduction="sum")) == pytest.approx(each.sum())
    assert value(J.dice(df, 5, ignore_class=skip, weight="w", avg_factor=3.0)) == pytest.approx(each.sum() / 3)


def test_lovasz_reductions(batch):
    _, _, df = batch
    total = value(J.lovasz_softmax(df, 5, per_image=True, reduction="sum"))
    assert total == pytest.approx(4 * value(J.lovasz_softmax(df, 5, per_image=True)))
    assert value(J.lovasz_softmax(df, 5, per_image=True, avg_factor=10.0)) == pytest.approx(total / 10)
    assert J.lovasz_softmax(df, 5, per_image=True, reduction="none").count() == 4


def test_distances_are_found_where_images_lie_and_by_passes_for_tall_blocks(spark, monkeypatch):
    """Many blocks in one pass, a NULL image, and blocks too tall for a task; dealt images are not shuffled."""
    from segspark.operators import distance
    from segspark.runtime import by_image
    ids = by_image(spark.range(30).select(F.when(F.col("id") > 0, F.col("id")).alias("sample_id")), "sample_id")
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    px = ids.withColumn("y", axis(9)).withColumn("x", axis(11))
    px = px.withColumn("fg", ((F.coalesce("sample_id", F.lit(7)) * 5 + F.col("y") * 3 + F.col("x") * 7) % 13 != 0).cast("int"))
    near = J.squared_distance_transform(px, block=4)
    assert near._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rows = near.collect()
    zeros = {}
    for r in rows:
        if r["fg"] == 0:
            zeros.setdefault(r["sample_id"], []).append((r["y"], r["x"]))
    for r in rows:
        assert r["d2"] == min((r["y"] - y) ** 2 + (r["x"] - x) ** 2 for y, x in zeros[r["sample_id"]])
    monkeypatch.setattr(distance, "WHOLE_ROWS", 10)
    assert sorted(map(repr, J.squared_distance_transform(px, block=4).collect())) == sorted(map(repr, rows))


def test_lovasz_ranks_small_images_where_they_lie(spark, monkeypatch):
    """No written table and no shuffle of the ranked errors; images too large for a task give the same."""
    from segspark.operators import losses
    from segspark.runtime import by_image
    px = by_image(spark.range(40).select((F.col("id") % 37).alias("sample_id")), "sample_id").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(20))))
    px = px.select("sample_id", ((F.col("sample_id") + F.col("y")) % 3).cast("int").alias("gt"),
                   F.array(*[((F.col("sample_id") * 7 + F.col("y") * (5 + c)) % 11).cast("double") / 4 for c in range(3)]).alias("logits"))
    seen = []
    plain = losses._lovasz_sum
    monkeypatch.setattr(losses, "_lovasz_sum", lambda *a: seen.append(plain(*a)) or seen[-1])
    small = value(J.lovasz_softmax(px, 3, per_image=True))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and "Join" not in plan
    monkeypatch.setattr(losses, "WHOLE_ROWS", 5)
    assert value(J.lovasz_softmax(px, 3, per_image=True)) == pytest.approx(small)
