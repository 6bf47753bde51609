"""SQL names for the helpers: table functions and scalar functions, registered on a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

# Scalar helpers as SQL expressions, so that they stay in the optimizer.
SCALARS = {
    "seg_argmax": ("l ARRAY<DOUBLE>", "INT", "CAST(array_position(l, array_max(l)) - 1 AS INT)"),
    "seg_sigmoid": ("x DOUBLE", "DOUBLE", "1 / (1 + exp(-x))"),
    "seg_reduce_zero": ("v INT", "INT", "CASE WHEN v IN (0, 255) THEN 255 ELSE v - 1 END"),
    "seg_colour_index": ("r INT, g INT, b INT", "INT", "(r * 256 + g) * 256 + b"),
    "seg_rle_area": ("c ARRAY<BIGINT>", "BIGINT", "aggregate(filter(c, (v, i) -> i % 2 = 1), 0L, (a, v) -> a + v)"),
}


def register_scalars(spark: SparkSession) -> list[str]:
    for name, (args, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return list(SCALARS)


@udtf(returnType="x1 int, y1 int, x2 int, y2 int")
class SegWindows:
    """Sliding windows of an h x w image, last ones shifted inward: seg_windows(h, w, crop, stride)."""

    def eval(self, h: int, w: int, crop: int, stride: int):
        starts = lambda n: sorted({max(min(i * stride + crop, n) - crop, 0) for i in range(max(n - crop + stride - 1, 0) // stride + 1)})
        for y in starts(h):
            for x in starts(w):
                yield x, y, min(x + crop, w), min(y + crop, h)


@udtf(returnType="y int, x int")
class SegRlePixels:
    """Foreground pixels of column-major run lengths: seg_rle_pixels(counts, h)."""

    def eval(self, counts: list[int], h: int):
        pos = 0
        for i, n in enumerate(counts):
            if i % 2:
                for p in range(pos, pos + n):
                    yield p % h, p // h
            pos += n


def register_tables(spark: SparkSession) -> list[str]:
    spark.udtf.register("seg_windows", SegWindows)
    spark.udtf.register("seg_rle_pixels", SegRlePixels)
    return ["seg_windows", "seg_rle_pixels"]


def register_all(spark: SparkSession) -> list[str]:
    return register_scalars(spark) + register_tables(spark)


# --- user transforms --------------------------------------------------------

TRANSFORMS: dict[str, Callable[..., DataFrame]] = {}


def transform(name: str):
    """Register a DataFrame function under a name; a second registration is an error."""
    def put(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in TRANSFORMS:
            raise KeyError(f"transform {name} is already registered")
        TRANSFORMS[name] = fn
        return fn
    return put


def build(steps: list[dict]) -> Callable[[DataFrame], DataFrame]:
    """[{type: name, **arguments}, …] to one DataFrame function."""
    for s in steps:
        if s["type"] not in TRANSFORMS:
            raise KeyError(f"transform {s['type']} is not registered")

    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = TRANSFORMS[s["type"]](df, **{k: v for k, v in s.items() if k != "type"})
        return df
    return run
