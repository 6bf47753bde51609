"""Neighbourhoods on images and volumes: blocks with a margin, one shuffle, arrays inside a block.

A row goes to the block it lies in and, near a border, to the blocks whose
margin it is in; all others travel once. A block has a bounded number of rows,
so an image that holds a third of a table is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


CHUNK_ROWS = 50_000  # rows that are worked on at once
STACK_CELLS = 1 << 22  # cells of the blocks that lie in one array


def together(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The rows of a group one after the other, in `order`, with a column `__at` that `group_chunks` leaves out.

    A window, like a grouping, shuffles nothing of tables dealt by some of the keys.
    """
    return df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or keys))))


def group_chunks(batches, keys: list[str]):
    """(table, number of each row's group) from rows that lie by groups: whole groups, many at a time. NULL keys are equal."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch.drop_columns("__at"))
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            table = pa.Table.from_batches(held)
            number = _numbered(table, keys)
            cut = int(np.searchsorted(number, number[-1]))  # the last group may go on
            if cut:
                yield table.slice(0, cut), number[:cut]
            held = table.slice(cut).to_batches()
            rows = (len(table) - cut) if cut else 0  # a large group is looked at again when it has grown by a chunk
    if held:
        table = pa.Table.from_batches(held)
        if len(table):
            yield table, _numbered(table, keys)


def _numbered(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(table), bool)
    for k in keys:
        a, b = table.column(k).slice(1), table.column(k).slice(0, len(table) - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differ.to_numpy()
    return np.cumsum(new)


class Blocks:
    """Rows of blocks whose smallest boxes are alike: `lo` is the first corner, `shape` the size. `at` places
    a row in an array of all of them, the first axis being the block."""

    def __init__(self, table: pa.Table, place: list[np.ndarray], which: np.ndarray, lo: list[int], shape: tuple[int, ...]):
        self.table, self.place, self.which, self.lo, self.shape = table, place, which, lo, shape
        self.full = (int(which[-1]) + 1, *shape)
        self.at = (which, *[p - first for p, first in zip(place, lo)])

    def grid(self, column: str, empty, pad: int = 0) -> np.ndarray:
        """The column as an array, `empty` where no row or no value is, with `pad` cells around each block."""
        values = pc.fill_null(self.table.column(column), empty).to_numpy()
        out = np.full([self.full[0], *[n + 2 * pad for n in self.shape]], empty, values.dtype)
        out[(self.which, *[p + pad for p in self.at[1:]])] = values
        return out


def _stacks(table: pa.Table, number: np.ndarray, place: list[np.ndarray]):
    """(rows, Blocks) of the blocks of a chunk, those alike together as long as their arrays stay small."""
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    low = np.stack([np.minimum.reduceat(p, starts) for p in place], axis=1)
    size = np.stack([np.maximum.reduceat(p, starts) for p in place], axis=1) - low + 1
    kinds, kind = np.unique(np.hstack([low, size]), axis=0, return_inverse=True)
    of_row, dims = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(number)])), len(place)
    kind = kind.ravel()
    for k, lo_size in enumerate(kinds):
        shape = tuple(int(n) for n in lo_size[dims:])
        members = np.flatnonzero(kind == k)
        step = max(1, STACK_CELLS // max(int(np.prod(shape, dtype=object)), 1))
        for first in range(0, len(members), step):
            part = members[first:first + step]
            rank = np.full(len(starts), -1)
            rank[part] = np.arange(len(part))
            whole = len(part) == len(starts)
            rows = np.arange(len(number)) if whole else np.flatnonzero(rank[of_row] >= 0)
            yield rows, Blocks(table if whole else table.take(pa.array(rows)), [p[rows] for p in place], rank[of_row[rows]], [int(n) for n in lo_size[:dims]], shape)


def over_blocks(df: DataFrame, keys: list[str], axes: list[str], sides: list[int], reach: list[int], work, column: T.StructField,
                keep: list[str]) -> DataFrame:
    """The columns `keep` of each row of `df`, and `column` as computed by `work(blocks)` for all rows of many blocks.

    Positions are whole numbers from 0. Only a block's own rows come back; their
    result may rest on rows up to `reach` away along each axis.
    """
    names = [f"__block_{a}" for a in axes]
    for a, name, side, r in zip(axes, names, sides, reach):
        first = F.floor((F.greatest(F.col(a) - r, F.lit(0))) / side)
        df = df.withColumn(name, F.explode(F.sequence(first, F.floor((F.col(a) + r) / side))) if r else F.floor(F.col(a) / side))

    order = keep if column.name in keep else [*keep, column.name]

    def walk(batches):
        for table, number in group_chunks(batches, [*keys, *names]):
            place = [table.column(a).to_numpy().astype(np.int64) for a in axes]
            own = np.logical_and.reduce([p // s == table.column(n).to_numpy() for p, s, n in zip(place, sides, names)])
            found = None
            for rows, blocks in _stacks(table, number, place):
                part = work(blocks)
                found = np.empty(len(number), part.dtype) if found is None else found
                found[rows] = part
            kept = table.select([c for c in keep if c != column.name]).append_column(column.name, pa.array(found))
            yield from kept.select(order).filter(pa.array(own)).to_batches()

    schema = T.StructType([column if c == column.name else df.schema[c] for c in order])
    return together(df, [*keys, *names]).mapInArrow(walk, schema)


def window_any(mask: np.ndarray, before: int, after: int, axis: int) -> np.ndarray:
    """True where any cell from `before` cells earlier to `after` later along the axis is."""
    lengths = [(0, 0)] * mask.ndim
    lengths[axis] = (before + 1, after)
    total = np.cumsum(np.pad(mask, lengths), axis=axis, dtype=np.int32)
    n, width = mask.shape[axis], before + 1 + after
    return np.take(total, np.arange(width, width + n), axis) > np.take(total, np.arange(n), axis)


def mirrored(values: np.ndarray, lo: int, n: int, radius: int, axis: int) -> np.ndarray:
    """`values`, cells `lo`… of an axis of `n` cells, with `radius` more at both ends: the axis is mirrored
    at its borders (the edge cell repeated), cells of the axis that `values` lacks are zero."""
    size = values.shape[axis]
    spot = np.arange(lo - radius, lo + size + radius) % (2 * n)
    spot = np.where(spot >= n, 2 * n - 1 - spot, spot) - lo
    there = (spot >= 0) & (spot < size)
    shape = [1] * values.ndim
    shape[axis] = len(there)
    return np.take(values, np.clip(spot, 0, size - 1), axis) * there.reshape(shape)


def component_starts(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel the first pixel (row by row) of its 8-connected component among them.

    Pixels become runs; runs of neighbouring rows are paired by binary search
    on their ends, and every run takes the least number that it can reach.
    """
    order = np.lexsort((x, y))
    left, width = int(x.min()) - 1, int(x.max() - x.min()) + 3
    place = y[order] * width + (x[order] - left)  # a gap of two cells between rows
    opens = np.r_[True, np.diff(place) > 1]
    start, end = place[opens], place[np.r_[opens[1:], True]]
    first = np.searchsorted(end, start + width - 1, "left")
    count = np.maximum(np.searchsorted(start, end + width + 1, "right") - first, 0)
    above = np.repeat(np.arange(len(start)), count)
    below = np.arange(len(above)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    root = np.arange(len(start))
    while True:
        a, b = root[above], root[below]
        apart = a != b
        if not apart.any():
            break
        above, below = above[apart], below[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]
    of = np.empty(len(order), np.int64)
    of[order] = root[np.cumsum(opens) - 1]
    return start[of] // width, start[of] % width + left
