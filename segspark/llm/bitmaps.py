"""Maps of hashes with a fixed size, to sift rows in a scan before an exact join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.textarrays import U64

#: Bits of a map: 1 MB, whatever it is made of.
MAP_BITS = 23
_CHUNK_BITS = 16


def bit_map(hashes: DataFrame, column: str) -> np.ndarray:
    """Map of the leading bits of 64-bit hashes: at most 2 ** (MAP_BITS - 3) bytes reach the driver."""
    places = hashes.select(F.shiftrightunsigned(column, 64 - MAP_BITS).alias("place")).distinct()

    def pack(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _CHUNK_BITS, np.uint8)
        bits[group.column("place").to_numpy() & ((1 << _CHUNK_BITS) - 1)] = 1
        chunk = group.column("chunk")[0].as_py()
        return pa.table({"chunk": pa.array([chunk], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    # A group holds at most 65,536 distinct places.
    packed = (places.withColumn("chunk", F.shiftright("place", _CHUNK_BITS)).groupBy("chunk")
              .applyInArrow(pack, "chunk long, bits binary").toArrow())
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    width = 1 << (_CHUNK_BITS - 3)
    for r in packed.to_pylist():
        out[r["chunk"] * width:(r["chunk"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes.view(np.uint64) >> U64(64 - MAP_BITS)).astype(np.int64)
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
