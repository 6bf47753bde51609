import numpy as np
import pytest
from pyspark.sql import functions as F

from segspark.operators import masks as M
from segspark.operators.blocks import component_starts


def mask_df(spark, a):
    return spark.createDataFrame([(s, y, x, int(v)) for s in a for (y, x), v in np.ndenumerate(a[s])], "sample_id int, y int, x int, v int")


@pytest.fixture(scope="module")
def shapes(spark):
    rng = np.random.default_rng(9)
    a = {s: (rng.random((12, 9)) < p).astype(int) for s, p in enumerate((0.0, 0.35, 0.6, 1.0))}
    return a, mask_df(spark, a)


def test_rle_round_trip_and_first_zero(shapes):
    a, df = shapes
    rle = M.encode_rle(df, ["sample_id"], 12, 9)
    rows = {r["sample_id"]: r["counts"] for r in rle.collect()}
    for s, m in a.items():
        assert sum(rows[s]) == 108
        assert (rows[s][0] == 0) == bool(m[0, 0])
        assert sum(rows[s][1::2]) == m.sum()
    back = {tuple(r) for r in M.decode_rle(rle, ["sample_id"]).select("sample_id", "y", "x").collect()}
    assert back == {(s, int(y), int(x)) for s in a for y, x in np.argwhere(a[s])}


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_runs_join_across_chunks(shapes, chunk):
    a, df = shapes
    px = df.select("sample_id", (F.col("y") * 9 + F.col("x")).alias("pos"), F.col("v").alias("label"))
    got = sorted(tuple(r) for r in M.encode_runs(px, ["sample_id"], chunk).select("sample_id", "start", "len", "label").collect())
    want = []
    for s, m in a.items():
        flat, start = m.ravel(), 0
        for i in range(1, len(flat) + 1):
            if i == len(flat) or flat[i] != flat[start]:
                want.append((s, start, i - start, int(flat[start])))
                start = i
    assert got == sorted(want)


def regions(m):
    """Flood fill, 8 neighbours."""
    label, n = np.zeros_like(m), 0
    for y, x in np.argwhere(m):
        if label[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        while stack:
            p, q = stack.pop()
            if 0 <= p < m.shape[0] and 0 <= q < m.shape[1] and m[p, q] and not label[p, q]:
                label[p, q] = n
                stack += [(p + i, q + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return label, n


def drop_small(m, limit, holes):
    work = 1 - m if holes else m
    label, n = regions(work)
    sizes = [(label == i).sum() for i in range(1, n + 1)]
    small = [i + 1 for i, s in enumerate(sizes) if s < limit]
    if not small:
        return m
    if holes:
        return np.where(np.isin(label, [0, *small]), 1, 0)
    keep = [i for i in range(1, n + 1) if i not in small] or [int(np.argmax(sizes)) + 1]
    return np.isin(label, keep).astype(int)


@pytest.mark.parametrize("side", [2, 5, 256])
def test_connected_regions(shapes, side):
    a, df = shapes
    got = M.connected_regions(df.filter("v = 1"), ["sample_id"], side).collect()
    for s, m in a.items():
        label, n = regions(m)
        pairs = {(r["region"], int(label[r["y"], r["x"]])) for r in got if r["sample_id"] == s}
        assert len(pairs) == n == len({p[0] for p in pairs}) and sum(r["sample_id"] == s for r in got) == m.sum()


def test_component_starts():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.4, 0.6, 0.9):
        m = (rng.random((23, 17)) < share).astype(int)
        y, x = rng.permutation(np.argwhere(m)).T
        label, _ = regions(m)
        first = {}
        for p in np.argwhere(m):
            first.setdefault(label[tuple(p)], tuple(p))
        got = component_starts(y, x)
        assert [first[label[p]] for p in zip(y, x)] == list(zip(*got))


@pytest.mark.parametrize("mode", ["islands", "holes"])
@pytest.mark.parametrize("limit", [3, 500])
def test_remove_small_regions(spark, mode, limit):
    rng = np.random.default_rng(4)
    a = {s: (rng.random((11, 8)) < 0.4).astype(int) for s in range(3)}
    got = {(r["sample_id"], r["y"], r["x"]): r["v"] for r in M.remove_small_regions(mask_df(spark, a), ["sample_id"], limit, mode).collect()}
    for s, m in a.items():
        want = drop_small(m, limit, mode == "holes")
        if mode == "holes" and limit == 500:
            want = np.ones_like(m)
        assert all(got[s, y, x] == want[y, x] for y, x in np.ndindex(m.shape))


NMS_BOXES = "image_id int, box_id int, x1 double, y1 double, x2 double, y2 double, score double"


def greedy(boxes, thr):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[6], b[1])):
        def iou(k):
            w, h = min(b[4], k[4]) - max(b[2], k[2]), min(b[5], k[5]) - max(b[3], k[3])
            inter = max(w, 0) * max(h, 0)
            union = (b[4] - b[2]) * (b[5] - b[3]) + (k[4] - k[2]) * (k[5] - k[3]) - inter
            return inter / union if union else 0.0
        if all(iou(k) <= thr for k in kept):
            kept.append(b)
    return {b[1] for b in kept}


@pytest.mark.parametrize("threshold", [0.0, 0.05, 0.4, 0.9, 1.0])
def test_nms_as_brute_force(spark, threshold):
    rng = np.random.default_rng(7)
    rows, bid = [], 0
    for img, n in ((0, 60), (1, 20), (2, 1)):
        for _ in range(n):
            x, y = rng.integers(0, 60, 2)
            w, h = rng.integers(0, 30, 2)  # some without area
            rows.append((img, bid, float(x), float(y), float(x + w), float(y + h), float(rng.integers(0, 5)) / 5))
            bid += 1
    rows += [(0, bid + i, *rows[0][2:]) for i in range(5)]  # exact copies
    df = spark.createDataFrame(rows, NMS_BOXES)
    got = {r["box_id"] for r in M.box_nms(df, threshold).collect()}
    assert got == set().union(*(greedy([r for r in rows if r[0] == i], threshold) for i in range(3)))


def test_nms_rounds_do_not_grow_with_the_image(spark, monkeypatch):
    rng = np.random.default_rng(3)
    side = 10_000
    xy = rng.integers(0, side, (10_000, 2))
    rows = [(0, i, float(x), float(y), float(x + 12), float(y + 9), float(i % 17)) for i, (x, y) in enumerate(xy.tolist())]
    tables = []
    real = M.materialize
    monkeypatch.setattr(M, "materialize", lambda df: tables.append(1) or real(df))
    assert M.box_nms(spark.createDataFrame(rows, NMS_BOXES), 0.5).count() > 9000
    assert len(tables) < 1 + 3 * 20


def written_tables(monkeypatch):
    tables, real = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda df: tables.append(1) or real(df))
    return tables


@pytest.mark.parametrize("step, threshold", [(20, 0.3), (64, 0.5)])
def test_nms_chain_takes_few_rounds(spark, monkeypatch, step, threshold):
    """Falling scores along a row: overlapping neighbours wait for each other, separate ones for nobody."""
    rows = [(0, i, float(step * i), 0.0, step * i + 60.0, 40.0, -float(i)) for i in range(1000)]
    tables = written_tables(monkeypatch)
    got = {r["box_id"] for r in M.box_nms(spark.createDataFrame(rows, NMS_BOXES), threshold).collect()}
    assert got == (set(range(0, 1000, 2)) if step == 20 else set(range(1000)))
    assert len(tables) < 10


@pytest.mark.parametrize("most", [8, 40])
def test_nms_crowds(spark, monkeypatch, most):
    """Tiles that hold more than they may are thinned by their leaders, with the same result."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(70):
        side = float(rng.integers(3, 40))
        x, y = rng.integers(0, 25 if i % 2 else 400, 2).tolist()
        rows.append((i % 2, i, float(x), float(y), x + side, y + side * 0.8, float(rng.integers(0, 9))))
    monkeypatch.setattr(M, "TILE_ROWS", most)
    got = {r["box_id"] for r in M.box_nms(spark.createDataFrame(rows, NMS_BOXES), 0.4).collect()}
    assert got == set().union(*(greedy([r for r in rows if r[0] == i], 0.4) for i in range(2)))


def test_nms_edges(spark):
    rows = [(0, 1, 0.0, 0.0, 4.0, 4.0, 1.0), (0, 2, None, 0.0, 4.0, 4.0, 2.0), (0, 3, 0.0, 0.0, 4.0, 4.0, None)]
    df = spark.createDataFrame(rows, NMS_BOXES)
    kept = {r["box_id"] for r in M.box_nms(df, 0.5).collect()}
    assert 2 in kept and len(kept & {1, 3}) == 1  # a box without all corners meets nothing
    assert M.box_nms(df.filter("false"), 0.5).count() == 0
    with pytest.raises(ValueError):
        M.box_nms(df, -0.1)


def test_boxes_and_edges(spark, shapes):
    a, df = shapes
    got = {r["sample_id"]: tuple(r)[1:] for r in M.mask_boxes(df.filter("v = 1"), df.select("sample_id").distinct(), ["sample_id"]).collect()}
    assert got[0] == (0, 0, 0, 0) and got[3] == (0, 0, 8, 11)
    b = spark.createDataFrame([(1, 30.0, 30.0, 60.0, 60.0), (2, 12.0, 30.0, 60.0, 60.0), (3, 5.0, 0.0, 50.0, 60.0)],
                              "i int, x1 double, y1 double, x2 double, y2 double")
    near = {r["i"] for r in b.filter(M.near_crop_edge((10, 0, 100, 100), (0, 0, 200, 200), 5.0)).collect()}
    assert near == {2}  # box 3 is as near to the image edge


def test_stability_of_empty_union(spark):
    df = spark.createDataFrame([(0, -5.0), (0, -6.0), (1, 3.0), (1, 0.5)], "k int, v double")
    got = {r["k"]: r["stability"] for r in M.stability(df, ["k"]).collect()}
    assert got == {0: None, 1: 0.5}


@pytest.mark.parametrize("tile", [20_000, 30])
def test_nms_crowded_images_by_tiles(spark, monkeypatch, tile):
    """Images beyond `WHOLE_ROWS` are decided by tiles, with boxes of many sizes and a row in which each waits for the next."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        side = float(rng.integers(2, 60))
        x, y = (30 * i, int(rng.integers(0, 8))) if i % 2 else rng.integers(0, 60, 2).tolist()
        rows.append((i % 3, i, float(x), float(y), x + side, y + side * 0.8, -float(x)))
    monkeypatch.setattr(M, "WHOLE_ROWS", 3)
    monkeypatch.setattr(M, "TILE_ROWS", tile)
    got = {r["box_id"] for r in M.box_nms(spark.createDataFrame(rows, NMS_BOXES), 0.3).collect()}
    assert got == set().union(*(greedy([r for r in rows if r[0] == i], 0.3) for i in range(3)))


def test_nms_long_chain_beyond_a_tile(spark, monkeypatch):
    """A chain of many more boxes than a tile may hold takes as many rounds as a short one."""
    monkeypatch.setattr(M, "WHOLE_ROWS", 8)
    monkeypatch.setattr(M, "TILE_ROWS", 60)
    rows = [(0, i, 20.0 * i, 0.0, 20.0 * i + 60, 40.0, -float(i)) for i in range(3000)]
    tables = written_tables(monkeypatch)
    got = {r["box_id"] for r in M.box_nms(spark.createDataFrame(rows, NMS_BOXES), 0.3).collect()}
    assert got == set(range(0, 3000, 2))
    assert len(tables) < 25


def test_nms_small_images_take_one_pass(spark, monkeypatch):
    """Many images of few boxes, some larger than an Arrow batch's rest, without tiles."""
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(0, 400)) if i % 3 else 0, i, *xy, xy[0] + 20.0, xy[1] + 15.0, float(i % 7))
            for i, xy in enumerate(rng.integers(0, 60, (3000, 2)).astype(float).tolist())]
    tables = written_tables(monkeypatch)
    got = {r["box_id"] for r in M.box_nms(spark.createDataFrame(rows, NMS_BOXES), 0.4).collect()}
    assert got == set().union(*(greedy([r for r in rows if r[0] == i], 0.4) for i in {r[0] for r in rows}))
    assert len(tables) == 2


def test_regions_of_many_images_are_found_together(spark, monkeypatch):
    """A task's images go to Python in few calls, not one for each image, with the same regions."""
    rng = np.random.default_rng(8)
    a = {s: (rng.random((9, 7)) < 0.45).astype(int) for s in range(300)}
    df = mask_df(spark, a).filter("v = 1").repartition(1, "sample_id")
    for side in (256, 4):
        got = M.connected_regions(df, ["sample_id"], side).collect()
        regions = {}
        for r in got:
            regions.setdefault((r["sample_id"], r["region"]), set()).add((r["y"], r["x"]))
        assert sum(map(len, regions.values())) == sum(int(m.sum()) for m in a.values())
        for (s, root), cells in regions.items():
            first = min(cells)
            todo, seen = [first], {first}
            while todo:
                y, x = todo.pop()
                near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} - seen
                near = {(i, j) for i, j in near if 0 <= i < 9 and 0 <= j < 7 and a[s][i, j]}
                todo += near
                seen |= near
            assert seen == cells and root == (first[0] << 32) + first[1]
    plan = M._block_components(df, ["sample_id"], 256)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
