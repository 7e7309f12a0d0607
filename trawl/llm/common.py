"""What the operators share: the shared folder, whole-text passes in numpy, connected components.

A text pass reads (id, text) through Arrow, a few megabytes of text at a time, and works on the
UTF-8 bytes of all its texts at once: a word is a run of bytes outside \\x20 and \\x09-\\x0D.
Hashes of runs come from prefix sums of a polynomial modulo 2**64, so a window's hash costs a
subtraction and a product whatever its length.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.session import shared_dir

U64 = np.uint64
PIECE_BYTES = 1_000_000  # of text that a pass holds at once; one longer text is a piece of its own
PIECE_ROWS = 50_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_scopes: list[list[str]] = []


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: computed once, and safe from lost executors.

    The files stay until the ``staging`` scope around them ends, with ``keep`` until the next outer one does.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for paths in _scopes[-2:-1] if keep else _scopes[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unstage(*dfs: DataFrame) -> None:
    """Delete the files of staged tables that nothing will read again."""
    for df in dfs:
        for f in {os.path.dirname(x) for x in df.inputFiles()}:
            _delete(df.sparkSession, f)


@contextlib.contextmanager
def staging(spark: SparkSession):
    """A scope at whose end the tables staged in it are deleted; what it returns must be written by then."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.pop()
        for path in paths:
            _delete(spark, path)


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, with marks appended to those that a column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- texts as bytes


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pa.compute.fill_null(column, b"")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices with (bytes, offsets) of their texts, each of about ``most`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = texts_of(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < len(off) - 1:
            to = min(max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1), at + PIECE_ROWS)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words; words of text i are first[i]:first[i+1]."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~_SPACE[data]
    edge = np.empty(n, bool)
    edge[0] = word[0]
    np.greater(word[1:], word[:-1], out=edge[1:])
    cut = off[1:-1]
    cut = cut[cut < n]
    edge[cut] = word[cut]
    starts = np.flatnonzero(edge)
    edge[-1] = word[-1]
    np.greater(word[:-1], word[1:], out=edge[:-1])
    last = off[1:-1] - 1
    last = last[last >= 0]
    edge[last] = word[last]
    ends = np.flatnonzero(edge) + 1
    return starts, ends, np.searchsorted(starts, off)


# ---------------------------------------------------------------- hashes

_BASE = U64(0x9E3779B97F4A7C15)  # 5 modulo 8
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ U64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def byte_codes(seed: int) -> np.ndarray:
    """A random 64-bit code for each byte value."""
    return mixed(np.arange(1, 257, dtype=U64), seed + 77)


class Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> Powers:
        if len(self.up) < n:
            n = max(n, len(self.up) + len(self.up) // 8)
            up, down = np.full(n, _BASE, U64), np.full(n, _INVERSE, U64)
            up[0] = down[0] = U64(1)
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        """Prefix sums from which ``ranges`` has the hash of any range of ``codes``."""
        self.to(len(codes) + 1)
        out = np.zeros(len(codes) + 1, U64)
        np.cumsum(codes * self.up[: len(codes)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(U64), seed)

    def windows(self, prefix: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
        """Hashes of all ranges of ``width`` codes, by their start."""
        n = len(prefix) - width
        return mixed((prefix[width:] - prefix[:n]) * self.down[:n] + U64(width), seed) if n > 0 else np.zeros(0, U64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers, lower: bool = False, seed: int = 0) -> np.ndarray:
    codes = byte_codes(seed)
    prefix = powers.prefix((codes[_LOWER] if lower else codes)[data])
    return powers.ranges(prefix, starts, ends, seed)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i+width] for every whole window, in three passes."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % width
    top = np.iinfo(x.dtype).max
    rows = np.concatenate([x, np.full(pad, top, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of ``counts``, one after another."""
    total = int(counts.sum())
    out = np.arange(total)
    return out - np.repeat(np.cumsum(counts) - counts, counts)


# ---------------------------------------------------------------- connected components


def connected(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(id, component) of every end of ``edges`` (a, b): the smallest id that links reach.

    Alternates large-star and small-star steps, each a pre-aggregated minimum and a join, until
    nothing changes; every step is a table in the shared folder. Hubs are safe: their minimum is
    combined before the shuffle and the join back is one that AQE can split. Self-loops count as
    an end without links; nulls are ignored.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = staged(e, name)
    before = None
    old: list[DataFrame] = []
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(e.where("u = v").select("u", "v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = staged(small.union(low.select("u", F.col("m").alias("v"))).distinct(), name)
        old.append(e)
        e = nxt
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        unstage(*old[:-1])
        old = old[-1:]
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    unstage(*old)
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
