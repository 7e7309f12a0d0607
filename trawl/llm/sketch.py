"""A count-min sketch built per partition, merged by blocks, and asked which items may repeat.

Counters saturate at two, all that "seen again" needs. Its size is fixed by ``width`` and
``depth`` whatever the input, so the merged bits may go to the driver and be broadcast
(depth * width / 8 bytes, 8 MB as set). More items than counters make it let more through,
never less: an estimate is never below the count.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trawl.llm.common import U64, mixed, shuffle_width

WIDTH_BITS = 25
DEPTH = 2
BLOCK = 1 << 17


def slots(items: np.ndarray, row: int, width_bits: int = WIDTH_BITS) -> np.ndarray:
    return (mixed(items.astype(U64), 100 + row) >> U64(64 - width_bits)).astype(np.int64)


def repeated(df: DataFrame, items_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], width_bits: int = WIDTH_BITS, depth: int = DEPTH, least: int = 2) -> np.ndarray:
    """Bits [row][slot] that are set where an estimate is ``least`` (1 or 2) or more.

    ``items_of`` turns the batches of a partition into arrays of 64-bit items.
    """
    blocks = max(1, (1 << width_bits) // BLOCK)
    size = (1 << width_bits) // blocks

    def build(batches):
        state = np.zeros((depth, 1 << width_bits), np.uint8)
        for items in items_of(batches):
            for r in range(depth):
                at, n = np.unique(slots(items, r, width_bits), return_counts=True)
                state[r][at] = np.minimum(2, state[r][at] + n)
        where, what = [], []
        for r in range(depth):
            for b in range(blocks):
                part = state[r, b * size : (b + 1) * size]
                if part.any():
                    where.append(r * blocks + b)
                    what.append(zlib.compress(np.packbits(part >= 1).tobytes() + np.packbits(part >= 2).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(what, pa.binary())], names=["block", "planes"])

    def merge(batches):
        found = {}
        for batch in batches:
            for b, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one, two = np.frombuffer(zlib.decompress(z), np.uint8).reshape(2, -1)
                if b in found:
                    a = found[b]
                    a[1] |= two | (a[0] & one)
                    a[0] |= one
                else:
                    found[b] = [one.copy(), two.copy()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()), pa.array([zlib.compress(x[least - 1].tobytes(), 1) for x in found.values()], pa.binary())], names=["block", "planes"]
        )

    parts = df.mapInArrow(build, "block int, planes binary")
    merged = parts.repartition(min(depth * blocks, shuffle_width(df.sparkSession)), "block").mapInArrow(merge, "block int, planes binary")
    out = np.zeros((depth, (1 << width_bits) // 8), np.uint8)
    for b, z in merged.toLocalIterator():  # depth * blocks rows at most
        r, b = divmod(b, blocks)
        out[r, b * size // 8 : (b + 1) * size // 8] = np.frombuffer(zlib.decompress(z), np.uint8)
    return out


def may_repeat(bits: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Which items have their bit set in every row."""
    width_bits = (bits.shape[1] * 8).bit_length() - 1
    ok = np.ones(len(items), bool)
    for r in range(len(bits)):
        at = slots(items, r, width_bits)
        ok &= (bits[r][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return ok
