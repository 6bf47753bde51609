"""Exact squared distance transform: windows along rows, lower envelopes of parabolas along columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.operators.blocks import _numbered, group_chunks, together

WHOLE_ROWS = 1 << 20  # of a block of columns, that a task may hold
CHUNK_ROWS = 200_000
FLAT_ROWS = 64  # of an image whose columns are solved row against row
FAR = 1 << 29


def mask_distances(px: DataFrame, keys: list[str], masks: list[str]) -> DataFrame:
    """The columns of `px` (keys…, y, x, masks…, …) and a column `d2_<mask>` for each mask: squared distance to
    the nearest pixel where the mask is 0, NULL where it has none.

    Images are held whole, many side by side, so each may have `WHOLE_ROWS` rows at most. Rows and columns as in
    `squared_distance_transform`.
    """
    schema = T.StructType([*px.schema, *[T.StructField(f"d2_{m}", T.LongType()) for m in masks]])

    def walk(batches):
        for table, image in group_chunks(batches, keys):
            y, x = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
            even = _even_images(image, y, x)
            for m in masks:
                g2 = _along_rows(image, y, x, pc.fill_null(table.column(m), 1).to_numpy() == 0)
                d2 = np.empty(len(g2), np.int64)
                for rows, shape in even:
                    d2[rows] = _along_columns(g2[rows].reshape(shape)).ravel()
                rest = even.rest
                if len(rest):
                    column = np.unique(image[rest] * (int(x.max()) + 1) + x[rest], return_inverse=True)[1]
                    d2[rest] = np.minimum(*[np.where(found < 0, FAR, found) for found in (_swept(y[rest], column, g2[rest]), _swept(-y[rest], column, g2[rest]))])
                table = table.append_column(f"d2_{m}", pa.array(d2, mask=d2 == FAR))
            yield from table.to_batches()

    return together(px, keys, "y", "x").mapInArrow(walk, schema)


class _even_images(list):
    """(rows, shape) of images of equal size, each with all rows and columns once; `rest` are the rows of other images."""

    def __init__(self, image: np.ndarray, y: np.ndarray, x: np.ndarray):
        starts = np.flatnonzero(np.r_[True, image[1:] != image[:-1]])
        count = np.diff(np.r_[starts, len(image)])
        y0, x0 = np.repeat(y[starts], count), np.repeat(np.minimum.reduceat(x, starts), count)
        h, w = (np.maximum.reduceat(p, starts) - p0[starts] + 1 for p, p0 in ((y, y0), (x, x0)))
        at = np.arange(len(y)) - np.repeat(starts, count)
        wide = np.repeat(w, count)
        right = np.logical_and.reduceat((y - y0 == at // wide) & (x - x0 == at % wide), starts) & (count == h * w) & (h <= FLAT_ROWS) & (w <= 1 << 14)
        kind = np.where(right, h * (1 << 20) + w, -1)
        of_row = np.repeat(kind, count)
        super().__init__((np.flatnonzero(of_row == k), (-1, int(k >> 20), int(k & (1 << 20) - 1))) for k in np.unique(kind) if k >= 0)
        self.rest = np.flatnonzero(of_row < 0)


def _along_rows(image: np.ndarray, y: np.ndarray, x: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Squared distance to the nearest `empty` pixel of the row, -1 without one; pixels are in order of image, y and x."""
    at = np.arange(len(x))
    new = np.r_[True, (image[1:] != image[:-1]) | (y[1:] != y[:-1])]
    first = np.maximum.accumulate(np.where(new, at, 0))
    last = np.minimum.accumulate(np.where(np.r_[new[1:], True], at, len(x))[::-1])[::-1]
    left = np.maximum.accumulate(np.where(empty, at, -1))
    right = np.minimum.accumulate(np.where(empty, at, len(x))[::-1])[::-1]
    none = 1 << 40
    gap = np.minimum(np.where(left >= first, x - x[left], none), np.where(right <= last, x[np.minimum(right, len(x) - 1)] - x, none))
    return np.where(gap == none, -1, gap * gap)


def _along_columns(g2: np.ndarray) -> np.ndarray:
    """The lowest of (y - q)^2 + g2[q] over the rows q of an image, for all rows y of many images; FAR without one."""
    g2 = np.where(g2 < 0, FAR, g2).astype(np.int32)
    best, rows = g2.copy(), g2.shape[1]
    for step in range(1, rows):
        if step * step >= best.max():
            break
        np.minimum(best[:, step:], g2[:, :-step] + step * step, out=best[:, step:])
        np.minimum(best[:, :-step], g2[:, step:] + step * step, out=best[:, :-step])
    return np.minimum(best, FAR)


def squared_distance_transform(px: DataFrame, keys: tuple[str, ...] = ("sample_id",), block: int = 64,
                               layer: str | None = None, layers: int = 1) -> DataFrame:
    """The columns of `px` (keys…, y, x, fg, …) and d2: squared distance of each pixel to the nearest one with fg = 0.

    Several masks of one image go side by side: `layer` names a column with
    values 0 to `layers` - 1. Masks are dense: every row has every column.

    Along each row the nearest background comes from two windows. Along
    columns, blocks of `block` columns are swept down and up, many blocks at a
    time, where their rows lie; images dealt by their keys are not shuffled.
    Where a block has more than `WHOLE_ROWS` rows, each sweep is a pass of its
    own, row by row; a task then holds, per column, only those earlier rows that
    may still be nearest to a later one. Work is linear in the pixels. d2 is
    NULL where a mask has no background. Rows and columns are whole numbers
    under 2^20. Runs a job that counts rows while it is built.
    """
    keys, side_by_side = list(keys), [layer] if layer else []
    row = Window.partitionBy(*keys, *side_by_side, "y").orderBy("x")
    zero = F.when(F.col("fg") == 0, F.col("x"))
    left = F.last(zero, ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(zero, ignorenulls=True).over(row.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col("x") - left, right - F.col("x")).cast("bigint")
    near = px.withColumns({"__g2": gap * gap, "__block": F.floor(F.col("x") / block), "d2": F.lit(None).cast("bigint"),
                           "__slot": ((F.col(layer) if layer else F.lit(0)) * block + F.pmod(F.col("x"), F.lit(block))).cast("bigint")})
    group = [*keys, "__block"]
    tall = px.select(*keys, F.floor(F.col("x") / block).alias("__block")).groupBy(*group).count().filter(F.col("count") > WHOLE_ROWS)
    if tall.isEmpty():
        return _both_ways(near, group).select(*px.columns, "d2")
    down = _sweep(near, keys, block * layers, 1)
    return _sweep(down, keys, block * layers, -1).drop("__g2", "__block", "__slot")


def _both_ways(df: DataFrame, group: list[str]) -> DataFrame:
    """d2 of both sweeps, for blocks that a task can hold."""
    # A window puts rows in order, and like a grouping leaves those alone that lie in the right task.
    rows = df.withColumn("__at", F.row_number().over(Window.partitionBy(*group).orderBy("y", "__slot")))
    place = df.columns.index("d2")

    def solve(part: pa.Table, block: np.ndarray):
        y, slot, g2 = (pc.fill_null(part.column(c), -1).to_numpy().astype(np.int64) for c in ("y", "__slot", "__g2"))
        column = np.unique(block * (int(slot.max()) + 1) + slot, return_inverse=True)[1]
        best = np.minimum(*[np.where(found < 0, np.iinfo(np.int64).max, found) for found in (_swept(y, column, g2), _swept(-y, column, g2))])
        d2 = pa.array(best, mask=best == np.iinfo(np.int64).max)
        return part.drop_columns("__at").set_column(place, "d2", d2).to_batches()

    def walk(batches):
        held = None
        for batch in batches:
            here = pa.Table.from_batches([batch])
            held = here if held is None else pa.concat_tables([held, here])
            if len(held) >= CHUNK_ROWS:
                block = _numbered(held, group)
                cut = int(np.searchsorted(block, block[-1]))  # the last block may go on
                if cut:
                    yield from solve(held.slice(0, cut), block[:cut])
                    held = held.slice(cut)
        if held is not None and len(held):
            yield from solve(held, _numbered(held, group))

    return rows.mapInArrow(walk, df.schema)


def _swept(y: np.ndarray, column: np.ndarray, g2: np.ndarray) -> np.ndarray:
    """The lowest value at each row by the rows of its column up to it in order of `y`, -1 without one."""
    envelope, found = _Envelopes(int(column.max()) + 1), np.empty(len(y), np.int64)
    order = np.argsort(y, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(y[order])) + 1):
        found[rows] = envelope.step(int(y[rows[0]]), column[rows], g2[rows])
    return found


def _sweep(df: DataFrame, keys: list[str], slots: int, step: int) -> DataFrame:
    """d2 lowered by the nearest background of this and earlier rows (`step` -1: later rows)."""
    group = [*keys, "__block"]
    rows = df.repartition(*group).sortWithinPartitions(*group, F.col("y") * step, "__slot")
    place = df.columns.index("d2")

    def walk(batches):
        last, envelope = None, None
        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in group]))
            y, slot = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("y", "__slot"))
            g2, best = (pc.fill_null(batch.column(c), -1).to_numpy(zero_copy_only=False).copy() for c in ("__g2", "d2"))
            cuts = [i for i in range(len(y)) if i == 0 or y[i] != y[i - 1] or names[i] != names[i - 1]] + [len(y)]
            for lo, hi in zip(cuts, cuts[1:]):
                if names[lo] != last:
                    last, envelope = names[lo], _Envelopes(slots)
                found = envelope.step(int(y[lo]) * step, slot[lo:hi], g2[lo:hi])
                old = best[lo:hi]
                best[lo:hi] = np.where((found >= 0) & ((old < 0) | (found < old)), found, old)
            yield batch.set_column(place, "d2", pa.array(best, mask=best < 0))

    return rows.mapInArrow(walk, df.schema)


class _Envelopes:
    """Per column, the parabolas (y - q)^2 + g that are lowest at some row from here on, in order of q.

    Two parabolas cross once and the later one gains with every row, so the
    first in line is the lowest now and the others take over one by one.
    """

    def __init__(self, columns: int, room: int = 8):
        self.q, self.g = np.zeros((columns, room), np.int64), np.zeros((columns, room), np.int64)
        self.head, self.end = np.zeros(columns, np.int64), np.zeros(columns, np.int64)

    def step(self, y: int, cols: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Adds the row's parabolas (g < 0: none); the lowest value per column, -1 without one."""
        some = g >= 0
        self._push(y, cols[some], g[some])
        self._advance(y, cols)
        return np.where(self.end[cols] > self.head[cols], self._value(cols, self.head[cols], y), -1)

    def _value(self, cols, at, y):
        at = np.minimum(at, self.q.shape[1] - 1)
        return (y - self.q[cols, at]) ** 2 + self.g[cols, at]

    def _push(self, y, cols, g):
        c, new = cols, g
        while len(c):
            at, held = self.end[c] - 1, self.end[c] - self.head[c]
            q, low = self.q[c, at], self.g[c, at]
            q0, low0 = self.q[c, at - 1], self.g[c, at - 1]
            beaten = (held >= 1) & (new <= (y - q) ** 2 + low)
            # The one before it hands over to the new one before the last gets its turn.
            skipped = (held >= 2) & (((low + q * q) - (low0 + q0 * q0)) * (y - q) >= ((new + y * y) - (low + q * q)) * (q - q0))
            drop = beaten | skipped
            c, new = c[drop], new[drop]
            self.end[c] -= 1
        if len(cols) and (self.end[cols] >= self.q.shape[1]).any():
            self._make_room()
        self.q[cols, self.end[cols]], self.g[cols, self.end[cols]] = y, g
        self.end[cols] += 1

    def _advance(self, y, cols):
        c = cols[self.end[cols] - self.head[cols] >= 2]
        while len(c):
            c = c[self._value(c, self.head[c] + 1, y) <= self._value(c, self.head[c], y)]
            self.head[c] += 1
            c = c[self.end[c] - self.head[c] >= 2]

    def _make_room(self):
        held = self.end - self.head
        at = np.minimum(self.head[:, None] + np.arange(2 * (int(held.max()) + 4)), self.q.shape[1] - 1)
        self.q, self.g = np.take_along_axis(self.q, at, 1), np.take_along_axis(self.g, at, 1)
        self.head, self.end = np.zeros_like(self.head), held
