import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import to_dict
from segspark.operators import geometry as G, photo as P, tiles as T, volume as V


def image(df, value, shape, fill=-1):
    out = np.full(shape, fill)
    for (_, y, x), v in to_dict(df, value).items():
        out[y, x] = v
    return out


def edges(a, width, ignore=255):
    """Edge map and square dilation by looking at every neighbour."""
    h, w = a.shape
    e = np.zeros_like(a)
    for y in range(h):
        for x in range(w):
            for dy, dx in ((-1, 0), (0, 1), (1, 1), (1, -1)):
                p, q = y + dy, x + dx
                if 0 <= p < h and 0 <= q < w and a[y, x] != a[p, q] and ignore not in (a[y, x], a[p, q]):
                    e[y, x] = 1
    out = np.zeros_like(e)
    lo, hi = width // 2, width - 1 - width // 2
    for y, x in np.argwhere(e):
        out[max(y - hi, 0):y + lo + 1, max(x - hi, 0):x + lo + 1] = 1
    return out


@pytest.mark.parametrize("width,side", [(1, 256), (2, 4), (3, 256), (3, 5), (6, 8)])
def test_edge_map(grid, width, side):
    rng = np.random.default_rng(3)
    a = np.kron(rng.integers(0, 3, (5, 8)), np.ones((4, 3), dtype=int))
    a[rng.random(a.shape) < 0.05] = 255
    assert (image(G.edge_map(grid({0: a}), width, side=side), "edge", a.shape) == edges(a, width)).all()


def test_edge_map_of_a_sparse_image(spark):
    df = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 2), (0, 5, 5, 1), (0, 5, 7, 2), (None, 1, 1, 3), (1, 0, 0, None)],
                               "sample_id int, y int, x int, gt int")
    got = {(r["sample_id"], r["y"], r["x"]): r["edge"] for r in G.edge_map(df, 1).collect()}
    assert got == {(0, 0, 0): 1, (0, 0, 1): 0, (0, 5, 5): 0, (0, 5, 7): 0, (None, 1, 1): 0}
    assert G.edge_map(df.limit(0), 3).count() == 0


@pytest.mark.parametrize("shape,side", [((16, 12), 256), ((13, 18), 6), ((9, 7), 3)])
def test_boundary_pyramid(grid, shape, side):
    h, w = shape
    a = np.random.default_rng(5).integers(0, 4, shape)
    p = np.pad(a, 1)
    hot = 9 * a - sum(p[i:i + h, j:j + w] for i in range(3) for j in range(3)) > 0
    fused = 6 * hot
    for stride, weight in ((2, 3), (4, 1)):
        ys = np.arange(h) * -(-h // stride) // h
        xs = np.arange(w) * -(-w // stride) // w
        fused = fused + weight * hot[::stride, ::stride][ys][:, xs]
    got = image(G.boundary_pyramid(grid({0: a}), F.lit(h), F.lit(w), side), "boundary", shape)
    assert (got == (fused > 1)).all()


def test_edge_map_triangle(grid):
    """Two labels split by a diagonal; the marked pixels lie on it."""
    a = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 1, 2], [1, 1, 1, 2, 2], [1, 1, 2, 2, 2], [1, 2, 2, 2, 2], [2, 2, 2, 2, 2]])
    got = image(G.edge_map(grid({0: a}), 1), "edge", a.shape)
    assert (got == edges(a, 1)).all() and got.sum() > 0 and got[0, 0] == 0


def test_unpad_golden(grid):
    a = np.zeros((10, 10), dtype=int)
    a[:8, :8] = 1
    got = G.unpad(grid({0: a}), 10, 10, (0, 2, 0, 2))
    assert got.count() == 64 and got.agg(F.min("gt")).first()[0] == 1


@pytest.mark.parametrize("new", [(3, 5), (8, 6), (16, 13)])
def test_resize_nearest(grid, new):
    a = np.arange(56).reshape(7, 8)
    got = image(G.resize_nearest(grid({0: a}), F.lit(7), F.lit(8), F.lit(new[0]), F.lit(new[1])), "gt", new)
    ys, xs = np.arange(new[0]) * 7 // new[0], np.arange(new[1]) * 8 // new[1]
    assert (got == a[ys][:, xs]).all()


@pytest.mark.parametrize("align", [True, False])
@pytest.mark.parametrize("new", [4, 13])
def test_bilinear_keeps_constants_and_matches(spark, align, new):
    rng = np.random.default_rng(1)
    a = rng.random((6, 6))
    df = spark.createDataFrame([(0, y, x, float(a[y, x])) for y in range(6) for x in range(6)], "sample_id int, y int, x int, v double")
    got = to_dict(G.resize_bilinear(df, F.lit(6), F.lit(6), F.lit(new), F.lit(new), align_corners=align), "v")
    at = (lambda t: t * 5 / (new - 1)) if align else (lambda t: max((t + 0.5) * 6 / new - 0.5, 0))
    for y in range(new):
        for x in range(new):
            sy, sx = at(y), at(x)
            y0, x0 = int(sy), int(sx)
            y1, x1 = min(y0 + 1, 5), min(x0 + 1, 5)
            fy, fx = sy - y0, sx - x0
            want = (a[y0, x0] * (1 - fy) * (1 - fx) + a[y0, x1] * (1 - fy) * fx + a[y1, x0] * fy * (1 - fx) + a[y1, x1] * fy * fx)
            assert got[0, y, x] == pytest.approx(want)


def test_rot90_flip(spark, grid):
    a = np.arange(12).reshape(3, 4)
    for k in range(4):
        for axis in (0, 1, None):
            params = spark.createDataFrame([(0, 3, 4, k, axis)], "sample_id int, h int, w int, k int, axis int")
            want = np.rot90(a, k) if axis is None else np.flip(np.rot90(a, k), axis)
            assert (image(G.rot90_flip(grid({0: a}), params), "gt", want.shape) == want).all()


def test_rotate_by_quarter_turn_and_zero(spark, grid):
    a = np.arange(25).reshape(5, 5)
    for angle, want in ((0.0, a), (90.0, np.rot90(a, -1)), (180.0, np.rot90(a, 2))):
        params = spark.createDataFrame([(0, 5, 5, angle)], "sample_id int, h int, w int, angle double")
        assert (image(G.rotate(grid({0: a}), params, {"gt": 255}), "gt", (5, 5)) == want).all()


def test_crop_choice_takes_last_draw_when_none_fits(spark, grid):
    a = np.ones((8, 8), dtype=int)
    cand = spark.createDataFrame([(0, t, t % 4, 0, t % 4 + 4, 4) for t in range(11)], "sample_id int, try_no int, x1 int, y1 int, x2 int, y2 int")
    assert G.choose_crop(grid({0: a}), cand, 0.75).first()["try_no"] == 10
    a[:, 5:] = 2
    assert G.choose_crop(grid({0: a}), cand, 0.9).first()["try_no"] == 2


@pytest.mark.parametrize("crop,stride", [(4, 3), (5, 5), (7, 2), (20, 5)])
def test_slide_windows_cover_and_stitch_constant(grid, crop, stride):
    a = np.full((11, 13), 7)
    win = T.cover_slide(grid({0: a}), F.lit(11), F.lit(13), crop, stride)
    starts = lambda n: {max(min(i * stride + crop, n) - crop, 0) for i in range(max(n - crop + stride - 1, 0) // stride + 1)}
    got = {(r["wy"], r["wx"]) for r in win.select("wy", "wx").distinct().collect()}
    assert got == {(y, x) for y in starts(11) for x in starts(13)}
    cover = {(r["y"], r["x"]): (r["gt"], r["cover"]) for r in T.stitch(win, ["gt"]).collect()}
    for y in range(11):
        for x in range(13):
            n = sum(s <= y < s + crop for s in starts(11)) * sum(s <= x < s + crop for s in starts(13))
            assert cover[y, x] == (7.0, n)


def test_window_grid_golden(spark):
    meta = spark.createDataFrame([(0, 64, 48)], "sample_id int, h int, w int")
    assert T.window_grid(meta, 16, 16, 16, 16).count() == 12
    boxes = T.tile_grid(spark.createDataFrame([(0, 6, 6)], "sample_id int, h int, w int"), 4, 4).collect()
    assert {(r["x1"], r["y1"]) for r in boxes} == {(0, 0), (2, 0), (0, 2), (2, 2)}


def test_hsv_round_trip_and_known_colours(spark):
    colours = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255), (0, 0, 0), (128, 128, 128), (255, 255, 0)]
    df = spark.createDataFrame(colours, "r int, g int, b int")
    h, s, v = P.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    got = {(r["r"], r["g"], r["b"]): (r["h"], r["s"], r["v"]) for r in df.select("*", h.alias("h"), s.alias("s"), v.alias("v")).collect()}
    assert got[255, 0, 0] == (0, 255, 255) and got[0, 255, 0] == (60, 255, 255) and got[0, 0, 255] == (120, 255, 255)
    assert got[255, 255, 255] == (0, 0, 255) and got[0, 0, 0] == (0, 0, 0) and got[255, 255, 0] == (30, 255, 255)
    back = {tuple(r)[:3]: tuple(r)[3:] for r in df.select("r", "g", "b", *[c.alias(f"n{i}") for i, c in enumerate(P.hsv_to_rgb(h, s, v))]).collect()}
    assert all(k == w for k, w in back.items())


def test_distort_without_steps_is_identity(spark):
    px = spark.createDataFrame([(0, 0, i, i * 7 % 256, i * 31 % 256, i * 11 % 256) for i in range(64)], "sample_id int, y int, x int, r int, g int, b int")
    params = spark.createDataFrame([(0, None, None, None, None, False)], "sample_id int, brightness double, contrast double, saturation double, hue int, contrast_last boolean")
    assert sorted(P.distort(px, params).collect()) == sorted(px.collect())
    brighter = params.withColumn("brightness", F.lit(10.0))
    got = {r["x"]: r["r"] for r in P.distort(px, brighter).collect()}
    assert all(got[r["x"]] == min(r["r"] + 10, 255) for r in px.collect())


def test_clahe_against_plain_loops(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(90, 160, (10, 12))  # does not divide into 4 x 4 tiles
    ty, tx, clip = 4, 4, 3.0
    th, tw = -(-10 // ty), -(-12 // tx)
    full = np.pad(a, ((0, th * ty - 10), (0, tw * tx - 12)), mode="reflect")
    area, limit = th * tw, max(int(clip * th * tw / 256), 1)
    luts = {}
    for i in range(ty):
        for j in range(tx):
            n = np.bincount(full[i * th:(i + 1) * th, j * tw:(j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            rest = over % 256
            if rest:
                for b in range(0, 256, max(256 // rest, 1)):
                    if rest == 0:
                        break
                    n[b] += 1
                    rest -= 1
            luts[i, j] = np.clip(np.rint(n.cumsum() * 255.0 / area), 0, 255)
    df = spark.createDataFrame([(0, y, x, 0, float(a[y, x])) for y in range(10) for x in range(12)], "sample_id int, y int, x int, c int, v double")
    got = to_dict(P.clahe(df, 10, 12, clip, (ty, tx)), "v")
    for y in range(10):
        for x in range(12):
            fy, fx = y / th - 0.5, x / tw - 0.5
            y1, x1 = int(np.floor(fy)), int(np.floor(fx))
            ya, xa = fy - y1, fx - x1
            pick = lambda i, j: luts[min(max(i, 0), ty - 1), min(max(j, 0), tx - 1)][a[y, x]]
            want = (pick(y1, x1) * (1 - xa) + pick(y1, x1 + 1) * xa) * (1 - ya) + (pick(y1 + 1, x1) * (1 - xa) + pick(y1 + 1, x1 + 1) * xa) * ya
            assert abs(got[0, y, x] - want) <= 0.5 + 1e-9


def test_constant_image_cannot_be_reranged(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 3.0), (0, 0, 1, 0, 3.0)], "sample_id int, y int, x int, c int, v double")
    with pytest.raises(Exception, match="constant image"):
        P.rerange(df).collect()


@pytest.mark.parametrize("n,sigma,side", [(6, 0.5, 32), (3, 1.5, 32), (10, 0.25, 4), (9, 0.5, 4)])
def test_blur_against_padding(spark, n, sigma, side):
    rng = np.random.default_rng(8)
    a = rng.random((n, n, n))
    df = spark.createDataFrame([(0, 0, *map(int, i), float(v), 1) for i, v in np.ndenumerate(a)], "sample_id int, c int, z int, y int, x int, v double, gt int")
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    want = a
    for ax in range(3):
        pad = [(r, r) if i == ax else (0, 0) for i in range(3)]
        want = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), ax, np.pad(want, pad, mode="symmetric"))
    for row in V.gaussian_blur(df, (n, n, n), (sigma,) * 3, side=side).collect():
        assert row["v"] == pytest.approx(want[row["z"], row["y"], row["x"]]) and row["gt"] == 1


def half_even(v):
    return int(np.rint(v))


def plain_hsv(r, g, b):
    top, low = max(r, g, b), min(r, g, b)
    span = top - low
    s = half_even(span * 255.0 / top) if top else 0
    if span == 0:
        deg = 0.0
    elif top == r:
        deg = 60.0 * (g - b) / span
    elif top == g:
        deg = 120.0 + 60.0 * (b - r) / span
    else:
        deg = 240.0 + 60.0 * (r - g) / span
    return half_even((deg + 360 if deg < 0 else deg) / 2) % 180, s, top


def plain_rgb(h, s, v):
    k, f, s = int(h / 30.0), h / 30.0 - int(h / 30.0), s / 255.0
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    return tuple(half_even(c) for c in ((v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q))[k])


@pytest.mark.parametrize("last", [False, True])
def test_distort_against_plain_loops(spark, last):
    rng = np.random.default_rng(12)
    px = [(0, 0, i, *map(int, rng.integers(0, 256, 3))) for i in range(300)]
    df = spark.createDataFrame(px, "sample_id int, y int, x int, r int, g int, b int")
    params = spark.createDataFrame([(0, -9.0, 1.25, 0.75, 14, last)],
                                   "sample_id int, brightness double, contrast double, saturation double, hue int, contrast_last boolean")
    cut = lambda v: int(min(max(v, 0), 255))
    got = {r["x"]: (r["r"], r["g"], r["b"]) for r in P.distort(df, params).collect()}
    for _, _, i, *rgb in px:
        rgb = [cut(c - 9.0) for c in rgb]
        if not last:
            rgb = [cut(c * 1.25) for c in rgb]
        h, s, v = plain_hsv(*rgb)
        rgb = plain_rgb(h, cut(s * 0.75), v)
        h, s, v = plain_hsv(*rgb)
        rgb = plain_rgb((h + 14) % 180, s, v)
        if last:
            rgb = tuple(cut(c * 1.25) for c in rgb)
        assert got[i] == tuple(rgb)


def test_bilinear_shares_run_as_generated_code(spark):
    """No function on arrays per pixel: such ones are interpreted."""
    px = spark.range(4).select(F.lit(1).alias("sample_id"), (F.col("id") % 2).cast("int").alias("y"),
                               F.expr("cast(id div 2 as int)").alias("x"), F.col("id").cast("double").alias("v"))
    out = G.resize_bilinear(px, F.lit(2), F.lit(2), F.lit(3), F.lit(3), align_corners=True)
    assert "lambdafunction" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["y"], r["x"]): r["v"] for r in out.collect()} == {(y, x): y / 2 + x for y in range(3) for x in range(3)}


def test_clahe_shuffles_nothing_of_dealt_images_and_takes_bytes_only(spark):
    from segspark.runtime import by_image
    axis = F.explode(F.sequence(F.lit(0), F.lit(7)))
    im = by_image(spark.range(12).withColumnRenamed("id", "sample_id"), "sample_id").withColumn("y", axis).withColumn("x", axis)
    im = im.select("sample_id", "y", "x", F.lit(0).alias("c"), ((F.col("y") * 31 + F.col("x") * 7) % 256).cast("double").alias("v"))
    out = P.clahe(im, 8, 8, 2.0, (2, 2))
    assert "ENSURE_REQUIREMENTS" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 12 * 64
    for wrong in (F.lit(None).cast("double"), F.lit(300.0)):
        with pytest.raises(Exception, match="0 to 255"):
            P.clahe(im.withColumn("v", F.when(F.col("x") == 3, wrong).otherwise(F.col("v"))), 8, 8, 2.0, (2, 2)).collect()
