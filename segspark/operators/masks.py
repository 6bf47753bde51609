"""Mask records: runs, RLE, boxes, stability, suppression, small regions, matching costs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.functions import columns as C
from segspark.functions.prefix import carry_forward
from segspark.operators.blocks import component_starts, group_chunks, together
from segspark.runtime import join_pixels, join_side, materialize


# --- runs and RLE -----------------------------------------------------------

def encode_runs(px: DataFrame, keys: list[str], chunk: int = 4096) -> DataFrame:
    """(keys…, start, len, label): maximal runs of equal labels over consecutive `pos`.

    Runs are found inside chunks of positions, so a huge image is many small
    windows; only pieces that touch across a chunk border are joined up.
    """
    w = Window.partitionBy(*keys, "b").orderBy("pos")
    cells = px.select(*keys, "pos", "label", F.floor(F.col("pos") / chunk).alias("b"))
    same = F.lag("label").over(w).eqNullSafe(F.col("label")) & (F.lag("pos").over(w) == F.col("pos") - 1)
    begun = cells.withColumn("s", F.when(F.coalesce(same, F.lit(False)), F.lit(None)).otherwise(F.col("pos")))
    placed = begun.withColumn("start", F.max("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = materialize(placed.groupBy(*keys, "b", "start", "label").agg(F.count(F.lit(1)).alias("len")))

    heads = pieces.filter(F.col("start") == F.col("b") * chunk).select(*keys, "b", "label", "start")
    tails = pieces.filter(F.col("start") + F.col("len") == (F.col("b") + 1) * chunk).select(
        *keys, (F.col("b") + 1).alias("b"), "label", F.col("start").alias("tail"))
    links = heads.join(tails, [*keys, "b", "label"])
    out = [*keys, "start", "len", "label"]
    if links.isEmpty():
        return pieces.select(*out)
    touched = (links.select(*keys, "start", F.lit(1).alias("cont"))
               .unionByName(links.select(*keys, F.col("tail").alias("start"), F.lit(0).alias("cont")))
               .groupBy(*keys, "start").agg(F.max("cont").alias("cont")))
    marked = materialize(pieces.join(touched, [*keys, "start"], "left"))
    chained = marked.filter("cont is not null").withColumn("head", F.when(F.col("cont") == 0, F.col("start")))
    merged = (carry_forward(chained, ["start"], "head", keys).groupBy(*keys, F.col("head").alias("start"), "label")
              .agg(F.sum("len").alias("len")))
    return marked.filter("cont is null").select(*out).unionByName(merged.select(*out))


def encode_rle(mask: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """(keys…, h, w, counts): column-major run lengths, background first (0 when the mask starts set).

    `mask` has (keys…, y, x, v) with v in {0, 1}, one row per pixel.
    """
    pos = F.col("x").cast("bigint") * height + F.col("y")
    runs = encode_runs(mask.select(*keys, pos.alias("pos"), F.col("v").alias("label")), keys)
    ordered = F.array_sort(F.collect_list(F.struct("start", "len", "label")))
    # The record holds all runs of one mask by definition; `runs` is the layout for unbounded masks.
    return (runs.groupBy(*keys).agg(ordered.alias("r"))
            .select(*keys, F.lit(height).alias("h"), F.lit(width).alias("w"),
                    F.when(F.col("r")[0]["label"] == 1, F.concat(F.array(F.lit(0).cast("bigint")), F.col("r.len")))
                    .otherwise(F.col("r.len")).alias("counts")))


def decode_rle(records: DataFrame, keys: list[str], counts: str = "counts", height: str = "h") -> DataFrame:
    """Foreground pixels (keys…, y, x) of column-major run lengths."""
    runs = records.select(*keys, F.col(height).alias("h"), F.posexplode(counts).alias("i", "n"))
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = runs.withColumn("stop", F.sum("n").over(w)).filter((F.col("i") % 2 == 1) & (F.col("n") > 0))
    pos = spans.select(*keys, "h", F.explode(F.sequence(F.col("stop") - F.col("n"), F.col("stop") - 1)).alias("p"))
    return pos.select(*keys, F.expr("int(p % h)").alias("y"), F.expr("int(p div h)").alias("x"))


def rle_area(counts: Column) -> Column:
    return F.aggregate(F.filter(counts, lambda c, i: i % 2 == 1), F.lit(0).cast("bigint"), lambda a, c: a + c)


# --- scores and boxes -------------------------------------------------------

def stability(logits: DataFrame, keys: list[str], threshold: float = 0.0, offset: float = 1.0) -> DataFrame:
    """IoU of the masks at threshold +/- offset over (keys…, v)."""
    over = lambda t: F.sum(F.when(F.col("v") > t, 1).otherwise(0))
    return logits.groupBy(*keys).agg(
        F.try_divide(over(threshold + offset).cast("double"), over(threshold - offset).cast("double")).alias("stability"))


def mask_boxes(foreground: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """Tight box with inclusive corners per listed mask; zeros for an empty one."""
    tight = foreground.groupBy(*keys).agg(F.min("x").alias("x1"), F.min("y").alias("y1"),
                                          F.max("x").alias("x2"), F.max("y").alias("y2"))
    return (masks.select(*keys).join(tight, keys, "left")
            .select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("x1", "y1", "x2", "y2")]))


def to_xywh(df: DataFrame) -> DataFrame:
    return df.withColumn("w", F.col("x2") - F.col("x1")).withColumn("h", F.col("y2") - F.col("y1"))


def to_xyxy(df: DataFrame) -> DataFrame:
    return df.withColumn("x2", F.col("x1") + F.col("w")).withColumn("y2", F.col("y1") + F.col("h"))


def uncrop_boxes(df: DataFrame, x0: Column, y0: Column) -> DataFrame:
    return df.withColumns({"x1": F.col("x1") + x0, "x2": F.col("x2") + x0, "y1": F.col("y1") + y0, "y2": F.col("y2") + y0})


def uncrop_points(df: DataFrame, x0: Column, y0: Column) -> DataFrame:
    """Also serves foreground pixels: padding a mask adds background only."""
    return df.withColumns({"x": F.col("x") + x0, "y": F.col("y") + y0})


def near_crop_edge(crop: tuple, image: tuple, atol: float = 20.0) -> Column:
    """True when an un-cropped box lies near a crop edge that is not an image edge."""
    hit = F.lit(False)
    for c, at, img in zip(("x1", "y1", "x2", "y2"), crop, image):
        hit = hit | ((F.abs(F.col(c) - at) <= atol) & ~(F.abs(F.col(c) - img) <= atol))
    return hit


def quality_filter(records: DataFrame, min_iou: float, min_stability: float) -> DataFrame:
    return records.filter((F.col("pred_iou") > min_iou) & (F.col("stability") >= min_stability))


def assemble_records(rles: DataFrame, boxes: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, segmentation, area, bbox xywh, scores…)."""
    joined = rles.join(boxes, keys).join(scores, keys)
    extra = [c for c in scores.columns if c not in keys]
    return joined.select(
        *keys, F.struct(F.array("h", "w").alias("size"), "counts").alias("segmentation"),
        rle_area(F.col("counts")).alias("area"),
        F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"),
                 (F.col("y2") - F.col("y1")).alias("h")).alias("bbox"), *extra)


# --- suppression ------------------------------------------------------------

TILE_ROWS = 20_000  # boxes that one tile may hold; crowded places are thinned by their leaders first
WHOLE_ROWS = 4096  # boxes of an image that is decided at once, without tiles


def box_nms(boxes: DataFrame, iou_threshold: float, rank: list[Column] | None = None) -> DataFrame:
    """Greedy suppression per image_id; returns the kept rows.

    Rank is score descending, then box_id (`rank` overrides it: numeric
    columns, smallest first, a total order). A box goes if its IoU with a kept
    better one exceeds the threshold; an IoU over an empty union is no number
    and suppresses nothing. Runs jobs while it is built. Images of up to
    WHOLE_ROWS boxes are decided at once, many side by side. In larger ones a
    box waits only for better boxes that it conflicts with: tiles are decided
    in one pass each, and only boxes that wait for one beyond their tile see
    another round, with tiles of twice the side. A box that waits for one other
    is that one's opposite; inside a tile it is done with as such, so a chain
    of boxes shrinks to its boxes at tile borders.
    """
    if iou_threshold < 0:
        raise ValueError("iou_threshold must not be negative")
    order = rank or [-F.col("score"), F.col("box_id")]
    rows = boxes.select("image_id", "box_id", *[F.col(c).cast("double").alias(c) for c in BOX],
                        F.struct(*[c.alias(f"r{i}") for i, c in enumerate(order)]).alias("__rank"))
    return boxes.join(_undominated(rows, iou_threshold).hint("merge"), ["image_id", "box_id"], "left_semi")


BOX = ["x1", "y1", "x2", "y2"]
TILE = ["image_id", "grid", "tx", "ty"]


def _undominated(ranked: DataFrame, threshold: float) -> DataFrame:
    """(image_id, box_id) kept. Boxes that cannot suppress or be suppressed are kept at once."""
    solid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & F.lit(threshold < 1)
    all_ = materialize(ranked.dropna(subset=["image_id"]).withColumn("solid", F.coalesce(solid, F.lit(False))))
    box = ["image_id", "box_id"]
    loose, rows = all_.filter("not solid").select(*box), all_.filter("solid").drop("solid")
    crowded = materialize(rows.groupBy("image_id").count().filter(F.col("count") > WHOLE_ROWS).select("image_id"))
    if crowded.isEmpty():
        return loose.unionByName(_decide_images(rows, threshold))
    few = _decide_images(join_side(rows, crowded, ["image_id"], "left_anti"), threshold)
    many = _decide_crowded(join_side(rows, crowded, ["image_id"], "left_semi"), threshold)
    return reduce(DataFrame.unionByName, [loose, few, *many])


def _decide_images(rows: DataFrame, threshold: float) -> DataFrame:
    """(image_id, box_id) kept of images of up to WHOLE_ROWS boxes, by one pass over them in order of rank."""
    ordered = rows.repartition("image_id").sortWithinPartitions("image_id", "__rank").select("image_id", "box_id", *BOX)

    def walk(batches):
        for table, ends in _whole_groups(batches, ["image_id"]):
            xy = np.column_stack([table.column(c).to_numpy() for c in BOX])
            kept = _greedy(xy, ends, threshold)
            yield from table.select(["image_id", "box_id"]).filter(pa.array(kept)).to_batches()

    return ordered.mapInArrow(walk, rows.select("image_id", "box_id").schema)


def _whole_groups(batches, keys: list[str]):
    """Tables of whole groups of sorted rows, and where each group ends; at most one group is held back."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = _group_ends(batch, keys)
        if held and _group_ends(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]), keys)[0] == 1:
            yield _ended(held, keys)
            held = []
        if len(ends) > 1:
            yield _ended([*held, batch.slice(0, ends[-2])], keys)
            held = [batch.slice(ends[-2])]
        else:
            held.append(batch)
    if held:
        yield _ended(held, keys)


def _ended(batches, keys):
    table = pa.Table.from_batches(batches)
    return table, _group_ends(table, keys)


def _group_ends(rows, keys: list[str]) -> np.ndarray:
    """Ends of the runs of equal keys, nulls being equal."""
    change = np.zeros(rows.num_rows, bool)
    change[-1] = True
    for k in keys:
        column = rows.column(k)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        change[np.asarray(pc.run_end_encode(column).run_ends) - 1] = True
    return np.flatnonzero(change) + 1


def _greedy(xy: np.ndarray, ends: np.ndarray, threshold: float, cells: int = 1 << 16) -> np.ndarray:
    """Which boxes are kept, in groups of rows in order of rank. Groups of like size are decided side by side."""
    counts = np.diff(ends, prepend=0)
    kept = np.zeros(len(xy), bool)
    size = np.ceil(np.log2(counts)).astype(int)
    for s in np.unique(size):
        members = np.flatnonzero(size == s)
        n, step = int(counts[members].max()), max(1, cells >> s)
        for lo in range(0, len(members), step):
            part = members[lo:lo + step]
            at = (ends - counts)[part][:, None] + np.arange(n)
            alive = np.arange(n) < counts[part][:, None]
            boxes = xy[np.where(alive, at, 0)]
            for i in range(n - 1):
                lead = np.flatnonzero(alive[:, i])
                if len(lead):
                    alive[lead, i + 1:] &= ~_meet(boxes[lead, i, None], boxes[lead, i + 1:], threshold)
            kept[at[alive]] = True
    return kept


def _decide_crowded(rows: DataFrame, threshold: float) -> list[DataFrame]:
    """Tables (image_id, box_id) of the boxes kept, by tiles.

    IoU is at most the ratio of the smaller side to the larger, so boxes meet
    only if their levels (longest side up to 2^level) differ by `reach` at
    most. `root` is the number of the box whose fate a waiting box shares or,
    with `flip`, has the opposite of.
    """
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    level = F.ceil(F.log2(F.when(side > 0, side))).cast("int")
    # The logarithm may be rounded down to a whole number.
    sized = rows.withColumn("level", level).withColumn(
        "level", F.when(F.pow(F.lit(2.0), "level") < side, F.col("level") + 1).otherwise(F.col("level")))
    open_ = materialize(sized.withColumns({"kept": F.lit(False), "n": F.monotonically_increasing_id(),
                                           "root": F.lit(None).cast("bigint"), "flip": F.lit(False)}))
    low, top = open_.agg(F.min("level"), F.max("level")).first()
    reach = 0
    while reach < top - low and 2.0 ** -reach > threshold:
        reach += 1
    won, gone, done, span = [], [], [], 5
    while not open_.filter("not kept").isEmpty():
        placed = _tiles(open_, low, top, reach, span)
        fullest = placed.groupBy(*TILE).count().agg(F.max("count")).first()[0]
        if fullest > TILE_ROWS and span > 0:
            span -= 1
            continue
        if fullest > TILE_ROWS:
            # Leaders are in: what they suppress goes before tiles are tried again.
            lead, rest = materialize(_leaders(open_, top, reach)), open_.filter("not kept")
            left = materialize(_without_suppressed(rest, lead, open_.filter("kept"), top, reach, threshold))
            over = rest.join(left.select("n").unionByName(lead.select("n")).hint("merge"), "n", "left_anti")
            fates = materialize(lead.withColumn("fate", F.lit("kept")).unionByName(over.withColumn("fate", F.lit("gone"))))
        else:
            # New ones stay for one more round, in which all that they suppress goes.
            fates = materialize(_decide(placed, threshold))
            left, span = fates.filter("fate = 'open' or fate = 'kept'").drop("fate"), span + 1
        done.append(fates.filter("fate = 'done'"))
        won.append(fates.filter("fate = 'kept'"))
        gone.append(fates.filter("fate = 'gone'"))
        open_, learnt = _pass_on(left, fates)
        won += [t.filter("kept") for t in learnt]
        gone += [t.filter("not kept") for t in learnt]
    box = ["image_id", "box_id"]
    return [t.select(*box) for t in [*won, *_resolve(done, won, gone)]]


def _pass_on(open_: DataFrame, fates: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """`open_` with roots replaced by what they turned out to be, and the boxes so decided (no table or one)."""
    waiting = open_.filter("not kept and root is not null")
    if waiting.isEmpty():
        return open_, []
    ends = _ends(_facts(fates.filter("fate != 'open' or root is not null")), fates.select("root").unionByName(waiting.select("root")))
    met = materialize(waiting.join(ends.hint("merge"), "root", "left").select(
        *[c for c in open_.columns if c not in ("root", "flip", "kept")],
        (F.col("__kept") != F.col("flip")).alias("kept"), F.coalesce("__root", "root").alias("root"),
        (F.col("flip") != F.coalesce("__flip", F.lit(False))).alias("flip")))
    rest = met.filter("kept is null or kept").withColumn("kept", F.coalesce("kept", F.lit(False)))
    return materialize(open_.filter("kept or root is null").unionByName(rest)), [met.filter("kept is not null")]


def _resolve(done: list[DataFrame], won: list[DataFrame], gone: list[DataFrame]) -> list[DataFrame]:
    """Tables (image_id, box_id) of the boxes that are kept among those left with a root."""
    links = materialize(reduce(DataFrame.unionByName, done))
    if links.isEmpty():
        return []
    box = lambda t: t.select("n", "root", "flip", "fate")
    learnt = [t if "fate" in t.columns else t.withColumn("fate", F.lit(fate)) for fate, ts in (("kept", won), ("gone", gone)) for t in ts]
    ends = _ends(_facts(reduce(DataFrame.unionByName, [box(t) for t in (links, *learnt)])), links.select("root"))
    return [links.join(ends.hint("merge"), "root").filter(F.col("__kept") != F.col("flip"))]


def _facts(fates: DataFrame) -> DataFrame:
    """(root, __kept, __root, __flip): the fate of each box, or the root that it was left with."""
    known = F.col("fate").isin("kept", "gone")
    return fates.select(F.col("n").alias("root"), F.when(known, F.col("fate") == "kept").alias("__kept"),
                        F.when(~known, F.col("root")).alias("__root"), F.when(~known, F.col("flip")).alias("__flip"))


def _ends(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """Facts on the boxes that are roots of others, followed to their ends: steps along the roots double each time."""
    ends = materialize(facts.join(asked.dropna().distinct().hint("merge"), "root", "left_semi"))
    while True:
        hops = ends.select(F.col("root").alias("__root"), F.col("__kept").alias("k"), F.col("__root").alias("r"), F.col("__flip").alias("f"), F.lit(True).alias("hit"))
        if ends.join(hops.hint("merge"), "__root", "left_semi").isEmpty():
            return ends
        hit = F.col("hit").isNotNull()
        ends = materialize(ends.join(hops.hint("merge"), "__root", "left").select(
            "root", F.when(hit, F.col("k") != F.col("__flip")).otherwise(F.col("__kept")).alias("__kept"),
            F.when(hit, F.col("r")).otherwise(F.col("__root")).alias("__root"),
            F.when(hit, F.col("f") != F.col("__flip")).otherwise(F.col("__flip")).alias("__flip")))


def _tiles(open_: DataFrame, low: int, top: int, reach: int, span: int) -> DataFrame:
    """Boxes on each tile that needs them; `own` on the one tile where a box sees all that it may conflict with.

    Grid g has tiles of side 2^(g + span). A box of level n is decided on grid
    n + reach, in the tile of its first corner, and lent to grids up to
    n + 2 * reach, there to every tile that holds the first corner of a box that
    may overlap it: at most 2^g before its own. A `lone` box is on one tile.
    """
    side = F.pow(F.lit(2.0), F.col("grid") + span)
    ahead = F.pow(F.lit(2.0), F.col("grid"))
    at = lambda c: F.floor(F.col(c) / side)
    axis = lambda lo, hi: F.sequence(F.floor((F.col(lo) - ahead) / side), at(hi))
    # No box is decided on a grid below the first.
    grids = F.sequence(F.greatest(F.col("level"), F.lit(low + reach)), F.least(F.lit(top), F.col("level") + 2 * reach))
    return (open_.withColumn("__grids", grids).withColumn("grid", F.explode("__grids"))
            .withColumns({"__across": axis("x1", "x2"), "__down": axis("y1", "y2")})
            .withColumn("lone", (F.size("__grids") == 1) & (F.size("__across") == 1) & (F.size("__down") == 1))
            .withColumn("tx", F.explode("__across")).withColumn("ty", F.explode("__down"))
            .withColumn("own", (F.col("grid") == F.least(F.lit(top), F.col("level") + reach))
                        & (F.col("tx") == at("x1")) & (F.col("ty") == at("y1")))
            .drop("__grids", "__across", "__down"))


def _decide(placed: DataFrame, threshold: float) -> DataFrame:
    """Own boxes that are open, with their `fate`: kept, gone, done (left with a root) or open."""
    out = [c for c in placed.columns if c not in ("grid", "tx", "ty", "own", "lone")]
    schema = T.StructType([*placed.select(*out).schema, T.StructField("fate", T.StringType())])
    rows = placed.repartition(*TILE).sortWithinPartitions(*TILE, "__rank")
    # The rank has done its work in the sort: Python gets the place of the row's own data only.
    slim = rows.select(*TILE, *BOX, "own", "lone", "kept", "n", F.coalesce("root", F.lit(-1)).alias("root"), "flip", F.struct(*out).alias("row"))

    def walk(batches):
        for table, ends in _whole_groups(batches, TILE):
            xy = np.column_stack([table.column(c).to_numpy() for c in BOX])
            own, lone, known, n, root, flip = (table.column(c).to_numpy() for c in ("own", "lone", "kept", "n", "root", "flip"))
            fate, to, turned = np.empty(len(xy), object), np.empty(len(xy), np.int64), np.empty(len(xy), bool)
            for lo, hi in zip([0, *ends], ends):
                at = slice(lo, hi)
                fate[at], to[at], turned[at] = _tile_fates(xy[at], own[at], lone[at], known[at], n[at], root[at], flip[at], threshold)
            row = pa.RecordBatch.from_struct_array(table.column("row").combine_chunks())
            told = {"kept": pa.array(fate == "kept"), "root": pa.array(to, mask=to < 0), "flip": pa.array(turned), "fate": pa.array(fate, pa.string())}
            cells = [told[f.name] if f.name in told else row.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(cells, names=schema.names).filter(pa.array(own & ~known))

    return slim.mapInArrow(walk, schema)


KEPT, GONE = -1, -2  # a fate that is known; others are twice the place of a root, odd for the opposite. One bit turns any of them


def _tile_fates(xy, own, lone, known, n, root, flip, threshold: float, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fate, root (-1: none) and flip of each box of a tile, all in order of rank.

    A box that meets a kept one is gone. If all that it may wait for share a
    fate, it has the opposite one; if some have opposite fates and no others,
    one of them is kept. What waits for several stays open, and so do the boxes
    that it meets and those that other tiles see.
    """
    size = len(xy)
    numbers, place = np.unique(np.r_[n, root], return_inverse=True)
    own_place, root_place = place[:size], place[size:]
    now = 2 * np.arange(len(numbers))
    linked = root >= 0
    code, needed = np.empty(size, np.int64), np.zeros(size, bool)
    most = 2 * len(numbers)
    for lo in range(0, size, block):
        hi = min(lo + block, size)
        mine = xy[lo:hi]
        over, least, last = np.zeros(hi - lo, bool), np.full(hi - lo, most), np.full(hi - lo, -1)
        for start in range(0, lo, block):
            held = np.flatnonzero(code[start:start + block] != GONE) + start
            if not len(held):
                continue
            meet, codes = _overlaps(mine, xy[held], threshold), code[held]
            over |= meet[:, codes == KEPT].any(axis=1)
            meet[:, codes == KEPT] = False
            least = np.minimum(least, np.where(meet, codes, most).min(axis=1))
            last = np.maximum(last, np.where(meet, codes, -1).max(axis=1))
        meet = _overlaps(mine, mine, threshold)
        several = np.zeros(hi - lo, bool)
        for i in range(hi - lo):
            r = lo + i
            met = code[lo:r][meet[i, :i]]
            met = met[met != GONE]
            if known[r]:
                c = KEPT
            elif over[i] or (met == KEPT).any():
                c = GONE
            elif linked[r]:
                c = now[root_place[r]] ^ int(flip[r])
            elif not own[r]:
                c = 2 * own_place[r]
            else:
                a, b = (min(least[i], met.min()), max(last[i], met.max())) if len(met) else (least[i], last[i])
                several[i] = a < b and not (a ^ 1 == b)
                c = KEPT if b < 0 else a ^ 1 if a == b else GONE if a ^ 1 == b else 2 * own_place[r]
            code[r] = now[own_place[r]] = c
        if several.any():
            for start in range(0, hi, block):
                part = slice(start, min(start + block, hi))
                needed[part] |= _overlaps(xy[part], mine[several], threshold).any(axis=1)
    waits = code >= 0
    apart = waits & (code != 2 * own_place)
    fate = np.select([code == KEPT, code == GONE, apart & lone & own & ~needed], ["kept", "gone", "done"], "open").astype(object)
    return fate, np.where(apart, numbers[np.where(waits, code >> 1, 0)], -1), apart & (code % 2 == 1)


def _overlaps(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """IoU over the threshold, each of `a` with each of `b`."""
    return _meet(a[:, None], b[None], threshold)


def _meet(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """IoU over the threshold, for boxes with an area."""
    w = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    h = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    inter = np.maximum(w, 0) * np.maximum(h, 0)
    area = lambda r: (r[..., 2] - r[..., 0]) * (r[..., 3] - r[..., 1])
    return inter / (area(a) + area(b) - inter) > threshold


SPOT = ["image_id", "grid", "cx", "cy"]


def _cells(df: DataFrame, top: int, reach: int) -> DataFrame:
    """Boxes on cells of their own size and of the larger sizes that they may meet."""
    axis = lambda lo, hi: F.sequence(F.floor(F.col(lo) / F.pow(F.lit(2.0), "grid")), F.floor(F.col(hi) / F.pow(F.lit(2.0), "grid")))
    return (df.withColumn("grid", F.explode(F.sequence(F.col("level"), F.least(F.lit(top), F.col("level") + reach))))
            .withColumn("cx", F.explode(axis("x1", "x2"))).withColumn("cy", F.explode(axis("y1", "y2"))))


def _leaders(open_: DataFrame, top: int, reach: int) -> DataFrame:
    """Open boxes that lead every cell they are in, as kept: no better open box can suppress them.

    Boxes that one kept before still has to suppress may lead too, so those go first.
    """
    cells = _cells(open_.filter("not kept"), top, reach)
    lead = cells.groupBy(*SPOT).agg(F.min("__rank").alias("lead_rank"))
    box = ["image_id", "box_id"]
    claims = _cells(open_.filter("kept"), top, reach).select(*SPOT).distinct().withColumn("held", F.lit(True))
    seen = join_side(join_side(cells, lead, SPOT), claims, SPOT, "left")
    won = seen.groupBy(*box).agg(F.min((F.col("lead_rank") == F.col("__rank")) & F.col("held").isNull()).alias("won"))
    # A box with a root is no leader: boxes that it waits for may be done with.
    return (open_.filter("not kept and root is null").join(won.filter("won").hint("merge"), box, "left_semi")
            .withColumn("kept", F.lit(True)))


def _without_suppressed(open_: DataFrame, won: DataFrame, before: DataFrame, top: int, reach: int, threshold: float) -> DataFrame:
    """Open boxes that no kept one suppresses, themselves left out."""
    claims = _cells(won.unionByName(before), top, reach).select(*SPOT, F.struct(*BOX).alias("lead"))
    hit = _cells(open_, top, reach).join(claims.hint("merge"), SPOT).filter(_iou(F.col("lead")) > threshold)
    gone = hit.select("image_id", "box_id").unionByName(won.select("image_id", "box_id")).distinct()
    return open_.join(gone.hint("merge"), ["image_id", "box_id"], "left_anti")


def _iou(other: Column) -> Column:
    w = F.greatest(F.least("x2", other["x2"]) - F.greatest("x1", other["x1"]), F.lit(0.0))
    h = F.greatest(F.least("y2", other["y2"]) - F.greatest("y1", other["y1"]), F.lit(0.0))
    own = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    theirs = (other["x2"] - other["x1"]) * (other["y2"] - other["y1"])
    return F.try_divide(w * h, own + theirs - w * h)


# --- connected regions ------------------------------------------------------

def connected_regions(foreground: DataFrame, keys: list[str], side: int = 256) -> DataFrame:
    """(keys…, y, x, region): 8-connected components of foreground pixels.

    Components are found inside blocks of `side` x `side` pixels, each pixel
    travelling once. Only pixels at a block's border are compared with their
    neighbours, which links components of different blocks; these links are
    solved by alternating star contractions, whose rounds grow with the
    logarithm of the number of blocks that a component crosses. `region` is the
    number of the component's first pixel (y * 2^32 + x).
    """
    cells = materialize(_block_components(foreground.select(*keys, "y", "x"), keys, side))

    on_edge = lambda c: F.pmod(F.col(c), F.lit(side)).isin(0, side - 1)
    steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    shout = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"))
                                for k, (dy, dx) in enumerate(steps)]))
    heard = (cells.filter(on_edge("y") | on_edge("x")).select(*keys, "node", shout.alias("t")).groupBy(*keys, "t.y", "t.x")
             .agg(*[F.max(F.when(F.col("t.k") == k, F.col("node"))).alias(f"n{k}") for k in range(5)]).filter("n0 is not null"))
    pairs = materialize(heard.select(*keys, F.col("n0").alias("b"), F.explode(F.array("n1", "n2", "n3", "n4")).alias("a"))
                        .filter("a is not null and a != b").select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if pairs.isEmpty():
        return cells.withColumnRenamed("node", "region")
    roots = _star_contract(pairs, keys).select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
    named = join_side(cells, roots, [*keys, "node"], "left")
    return named.select(*keys, "y", "x", F.coalesce("root", "node").alias("region"))


def _block_components(cells: DataFrame, keys: list[str], side: int) -> DataFrame:
    """(keys…, y, x, node): components inside blocks of `side` x `side`. The many blocks of an Arrow batch are solved at once."""
    names = ["__by", "__bx"]
    placed = cells.withColumns({n: F.floor(F.col(c) / side) for n, c in zip(names, "yx")})
    # The window brings the rows of a block together, which shuffles nothing of tables dealt by image.
    w = Window.partitionBy(*keys, *names).orderBy("y", "x")
    ordered = placed.withColumn("__i", F.row_number().over(w))
    schema = T.StructType([*cells.select(*keys, "y", "x").schema, T.StructField("node", T.LongType())])

    def walk(batches):
        for table, ends in _whole_groups(batches, [*keys, *names]):
            # Blocks lie below each other, with two empty rows between.
            ahead = np.repeat(np.arange(len(ends)) * (side + 2), np.diff(ends, prepend=0))
            y0, x0 = (table.column(n).to_numpy() * side for n in names)
            y, x = component_starts(table.column("y").to_numpy() - y0 + ahead, table.column("x").to_numpy() - x0)
            node = (y - ahead + y0 << 32) + x + x0
            yield from table.select([*keys, "y", "x"]).append_column("node", pa.array(node.astype(np.int64))).to_batches()

    return ordered.mapInArrow(walk, schema)


def _star_contract(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (u > v) become stars (u, root) by large-star / small-star rounds.

    The joins pair an edge table with one row per node; a hot root is split by
    the adaptive skew join of the sort-merge strategy.
    """
    pair = lambda a, b: [*keys, F.col(a).alias("u"), F.col(b).alias("v")]
    while True:
        both = edges.select(*pair("u", "v")).unionByName(edges.select(*pair("v", "u")))
        low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low.hint("merge"), [*keys, "u"]).select(*pair("v", "m")).distinct()
        # Small star: point each node and its smaller neighbours to the smallest of them.
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        rest = large.join(least.hint("merge"), [*keys, "u"]).filter("v > m").select(*pair("v", "m"))
        edges = materialize(least.select(*pair("u", "m")).unionByName(rest).distinct())
        # Done when every node points to one root and no root points on.
        roles = (edges.select(*keys, F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("inn"))
                 .unionByName(edges.select(*keys, F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("inn")))
                 .groupBy(*keys, "node").agg(F.sum("out").alias("out"), F.max("inn").alias("inn")))
        if roles.filter("out > 1 or (out = 1 and inn = 1)").isEmpty():
            return edges


REGION_ROWS = 1 << 20  # of an image, that a task may hold


def remove_small_regions(mask: DataFrame, keys: list[str], min_area: int, mode: str) -> DataFrame:
    """mask(keys…, y, x, v) with small islands dropped or small holes filled.

    Islands: when every region is small the largest stays (the first in
    row-major order on ties). Images are worked on where they lie, many side by
    side; if one has more than `REGION_ROWS` rows, by blocks. Runs a job that
    counts rows while it is built.
    """
    if mode not in ("islands", "holes"):
        raise ValueError(mode)
    value = 1 if mode == "islands" else 0
    if mask.groupBy(*keys).count().filter(F.col("count") > REGION_ROWS).isEmpty():
        return _small_regions_whole(mask, keys, min_area, value)
    regions = materialize(connected_regions(mask.filter(F.col("v") == value), keys))
    sizes = regions.groupBy(*keys, "region").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.filter(F.col("n") < min_area)
    if mode == "islands":
        best = sizes.groupBy(*keys).agg(F.max_by("region", F.struct("n", -F.col("region"))).alias("top"),
                                        F.max("n").alias("most"))
        small = small.join(best, keys).filter((F.col("most") >= min_area) | (F.col("region") != F.col("top"))).select(*keys, "region")
    gone = join_side(regions, small.select(*keys, "region"), [*keys, "region"], "left_semi")
    flip = gone.select(*keys, "y", "x", F.lit(1).alias("flip"))
    return (join_pixels(mask, flip, [*keys, "y", "x"], "left")
            .select(*keys, "y", "x", F.when(F.col("flip") == 1, 1 - F.col("v")).otherwise(F.col("v")).cast("int").alias("v")))


def _small_regions_whole(mask: DataFrame, keys: list[str], min_area: int, value: int) -> DataFrame:
    """`remove_small_regions` of images that a task can hold."""
    rows = mask.select(*keys, "y", "x", F.col("v").cast("int").alias("v"))

    def walk(batches):
        for table, number in group_chunks(batches, keys):
            placed = np.logical_and.reduce([table.column(c).is_valid().to_numpy() for c in (*keys, "y", "x")])
            cells = np.flatnonzero(placed & pc.fill_null(pc.equal(table.column("v"), value), False).to_numpy())
            if not len(cells):
                yield from table.to_batches()
                continue
            y, x = (pc.fill_null(table.column(c), 0).to_numpy().astype(np.int64) for c in ("y", "x"))
            # Images lie below each other, with two empty rows between.
            starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            top, end = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)
            below = np.r_[0, np.cumsum(end - top + 3)[:-1]] - top
            image = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(number)]))
            first = component_starts(y[cells] + below[image[cells]], x[cells])
            # Regions in order of image and first pixel.
            _, where, region, size = np.unique(first[0] * (int(x.max() - x.min()) + 1) + first[1] - x.min(), return_index=True, return_inverse=True, return_counts=True)
            small = size < min_area
            if value:
                owner = image[cells[where]]
                best = np.lexsort((np.arange(len(size)), -size, owner))
                lead = best[np.r_[True, owner[best][1:] != owner[best][:-1]]]
                small[lead[small[lead]]] = False
            gone = cells[small[region]]
            # A pixel that comes more than once meets each of its lost rows.
            pixel = np.flatnonzero(np.r_[True, (image[1:] != image[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1])])
            of = np.repeat(np.arange(len(pixel)), np.diff(np.r_[pixel, len(number)]))
            times = np.where(placed, np.bincount(of[gone], minlength=len(pixel))[of], 0)
            v = table.column("v")
            turned = pc.if_else(pa.array(times > 0), pc.subtract(pa.scalar(1, pa.int32()), v), v)
            out = table.set_column(table.schema.get_field_index("v"), "v", turned)
            yield from (out if times.max() <= 1 else out.take(pa.array(np.repeat(np.arange(len(times)), np.maximum(times, 1))))).to_batches()

    return together(rows, keys, "y", "x").mapInArrow(walk, rows.schema)


# --- matching costs ---------------------------------------------------------

def match_cost(class_logits: DataFrame, pred: DataFrame, gt: DataFrame, gt_labels: DataFrame,
               weights: tuple[float, float, float] = (1.0, 1.0, 1.0), eps: float = 1e-3, pred_act: bool = True,
               naive_dice: bool = True) -> DataFrame:
    """(sample_id, q, g, cls_cost, dice_cost, ce_cost, cost) for every query and ground-truth mask of a sample.

    class_logits(sample_id, q, logits); pred(sample_id, q, y, x, v) is dense;
    gt(sample_id, g, y, x) lists foreground pixels; gt_labels(sample_id, g, label).
    Sums over all pixels are taken per query, so only foreground pixels are
    joined; a mask without pixels has sums of zero. `naive_dice=False` divides
    by the sums of squares.
    """
    act = C.sigmoid(F.col("v")) if pred_act else F.col("v")
    on, off = C.bce_logits(F.col("v"), F.lit(1.0)), C.bce_logits(F.col("v"), F.lit(0.0))
    scored = pred.select("sample_id", "q", "y", "x", act.alias("p"), (on - off).alias("gain"), off.alias("off"))
    own = F.col("p") if naive_dice else F.col("p") * F.col("p")
    whole = scored.groupBy("sample_id", "q").agg(F.sum(own).alias("p_sum"), F.sum("off").alias("off_sum"),
                                                 F.count(F.lit(1)).alias("n"))
    inside = (scored.select("sample_id", "q", "y", "x", "p", "gain").transform(lambda df: join_pixels(df, gt, ["sample_id", "y", "x"]))
              .groupBy("sample_id", "q", "g").agg(F.sum("p").alias("hit"), F.sum("gain").alias("gain"),
                                                  F.count(F.lit(1)).alias("g_sum")))
    probs = class_logits.select("sample_id", "q", C.softmax(F.col("logits")).alias("probs"))
    # Rows per query and mask: too many for a broadcast, whatever the files weigh that they are made from.
    t = (whole.join(gt_labels.hint("merge"), "sample_id").join(inside.hint("merge"), ["sample_id", "q", "g"], "left").na.fill(0, ["hit", "gain", "g_sum"])
         .join(probs.hint("merge"), ["sample_id", "q"]))
    cls = -F.get("probs", F.col("label")) * weights[0]
    dice = (1 - (2 * F.col("hit") + eps) / (F.col("p_sum") + F.col("g_sum") + eps)) * weights[1]
    ce = ((F.col("gain") + F.col("off_sum")) / F.col("n")) * weights[2]
    return t.select("sample_id", "q", "g", cls.alias("cls_cost"), dice.alias("dice_cost"), ce.alias("ce_cost"),
                    (cls + dice + ce).alias("cost"))
