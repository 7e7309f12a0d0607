"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors of cosine c lie at squared distance 2 - 2c. After a rotation their coordinates are
dealt into blocks; the squared distance is the sum over blocks, so a pair within the whole budget
is within its proportional share in at least one block. Every block is range-joined on its leading
coordinates (cells as wide as the block's radius, each met with itself and its later neighbours;
more rows take more coordinates), in tiles of bounded rows. What travels to the range join is a
block's coordinates in 16 bits, and what comes back is which rows have a partner there; only their
vectors are fetched. A pair is verified with the original vectors in the first block that finds
it, so it counts once.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import connected, staged, texts_of

THRESHOLD = 0.9
BLOCKS = 4
TILE = 16_384  # rows of a cell in one tile: half a megabyte of block coordinates
CELLS = 20_000  # of all blocks, at most: their counts are broadcast
SAMPLE = 10_000  # vectors that the rotation is fitted on, at most: those of least hash
SLACK = 1e-5  # of squared distance, for rounding
GRAIN = 32_767  # steps of a coordinate from 0 to 1


def _rotation(sample: np.ndarray, d: int, blocks: int) -> np.ndarray:
    """Principal axes, dealt so that every block leads with one of the widest."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else np.zeros((0, d))
    _, axes = np.linalg.eigh(unit.T @ unit + 1e-9 * np.eye(d))
    axes = axes[:, ::-1]
    return axes[:, np.concatenate([np.arange(b, d, blocks) for b in range(blocks)])]


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d).astype(np.float64)


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    vec_id, link with nothing; so do vectors of different lengths. Rows of one vector are copies
    of one class and link with each other, repeated rows included. Only vec_id and embedding are
    read, so other columns may have any name.
    """
    spark = vectors.sparkSession
    good = (
        F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    )
    key = ["h1", "h2", "d"]
    rows = vectors.select("vec_id", "embedding", good.alias("good"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.reverse("embedding"), F.lit(1)).alias("h2"), F.size("embedding").alias("d"))
    classes = rows.where("good").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    # numbered where they are written: a class is more than its least id, which rows of other vectors may share
    classes = staged(classes.withColumn("class", F.monotonically_increasing_id()), "vectors")
    found = None
    for d, n in classes.groupBy("d").count().collect():  # lengths of vectors, not data
        part = _links(spark, classes.where(F.col("d") == d), d, n, threshold, min(blocks, d), tile)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "class long, reached long, links long")
    found = staged(found, "vector-links")
    component = staged(connected(found.select(F.col("class").alias("a"), F.col("reached").alias("b")), "vector-components"), "vector-components")
    least = classes.select("class", "rep").join(component, F.col("class") == F.col("id")).groupBy("component").agg(F.min("rep").alias("least"))
    named = component.join(least, "component").select(F.col("id").alias("class"), "least")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    owner = staged(
        classes.drop("embedding").join(links, "class", "left").join(named, "class", "left")
        .select(*key, F.coalesce("least", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")),
        "vector-owners",
    )
    out = rows.select("vec_id", "good", *key).join(owner, key, "left")
    component = F.when(F.col("good"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.when(F.col("good"), F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def _links(spark, classes: DataFrame, d: int, n: int, threshold: float, blocks: int, tile: int) -> DataFrame:
    """(class, reached, links): link counts, and links enough to connect what is connected."""
    budget = 2 - 2 * threshold
    size = [len(range(b, d, blocks)) for b in range(blocks)]
    edge = np.concatenate([[0], np.cumsum(size)])
    share = np.array([budget * s / d for s in size]) + SLACK
    radius = np.sqrt(share)
    # of two rounded rows: the error's length, and what it may add to a squared distance
    error = np.sqrt(size) / GRAIN
    reach = (share + 2 * radius * error + error**2 + SLACK).astype(np.float32)
    # coordinates of unit vectors lie in [-1, 1]: cells are bounded whatever the rows
    across = 2 / radius.min() + 2
    depth = 1
    while depth < min(size) and blocks * across ** (depth + 1) <= CELLS and n > 4 * tile * 3 ** (depth - 1):
        depth += 1
    sample = classes.orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("embedding").toArrow().combine_chunks()
    sample = _vectors(sample["embedding"].chunk(0), d) if sample.num_rows else np.zeros((0, d))
    axes = spark.sparkContext.broadcast(_rotation(sample, d, blocks))

    def rotated(x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes.value

    def cells(batches):
        for b in batches:
            r = rotated(_vectors(b.column("embedding"), d))
            at = np.zeros((len(r), blocks), np.int64)
            for k in range(blocks):
                for i in range(depth):
                    at[:, k] = (at[:, k] << 12) + np.floor(r[:, edge[k] + i] / radius[k]).astype(np.int64) + 2048
            cell = pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), blocks).cast(pa.list_(pa.int64()))
            grain = np.rint(np.clip(r, -1, 1) * GRAIN).astype("<i2")
            bound = pa.py_buffer((np.arange(len(r) + 1) * 2 * d).astype(np.int32))
            coords = pa.Array.from_buffers(pa.binary(), len(r), [None, bound, pa.py_buffer(np.ascontiguousarray(grain))])
            yield pa.RecordBatch.from_arrays([b.column("class"), cell, coords], names=["class", "cells", "coords"])

    flat = staged(classes.select("class", "embedding").mapInArrow(cells, "class long, cells array<long>, coords binary"), "cells")
    placed = flat.select(F.posexplode("cells").alias("block", "cell"))
    tiles = placed.groupBy("block", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    tiles = F.broadcast(staged(tiles, "tiles"))  # CELLS rows at most, or those of one coordinate
    steps = [sum(o << (12 * (depth - 1 - i)) for i, o in enumerate(step)) for step in product((-1, 0, 1), repeat=depth) if step >= (0,) * depth]
    part = F.lit(None).cast("binary")
    for k in range(blocks):
        part = F.when(F.col("block") == k, F.substring("coords", int(2 * edge[k] + 1), 2 * size[k])).otherwise(part)
    # a row is at home in its own cell and a guest in those that it is a later neighbour of; of
    # a cell's tiles, it is at home in one and a guest in those before
    dealt = (
        flat.select("class", "coords", F.posexplode("cells").alias("block", "home")).select("class", "block", "home", part.alias("coords"))
        .withColumn("cell", F.explode(F.transform(F.array(*[F.lit(s) for s in steps]), lambda s: F.col("home") - s)))
        .join(tiles, ["block", "cell"])
        .withColumn("mine", F.when(F.col("cell") == F.col("home"), F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")))
        .withColumn("tile", F.explode(F.sequence(F.lit(0), F.coalesce("mine", F.col("tiles") - 1))))
        .select("class", "block", "cell", "tile", "coords", F.coalesce(F.col("mine") != F.col("tile"), F.lit(True)).alias("guest"))
    )

    def near(sub: np.ndarray, guest: np.ndarray, most: np.float32):
        """(rows, columns) of pairs within reach, of which one at least is at home, a part at a time."""
        left = np.flatnonzero(~guest)
        right = np.concatenate([left, np.flatnonzero(guest)])
        # one product gives squared distances: (-2 a, |a|^2, 1) . (b, 1, |b|^2)
        norm, one = (sub * sub).sum(1, keepdims=True), np.ones((len(sub), 1), np.float32)
        lhs, rhs = np.hstack([-2 * sub, norm, one]), np.ascontiguousarray(np.hstack([sub, one, norm])[right].T)
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            i, j = np.divmod(np.flatnonzero(lhs[rows] @ rhs[:, at:] <= most), len(right) - at)
            ok = i < j  # of those at home, the upper triangle
            yield rows[i[ok]], right[j[ok] + at]

    def partners(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        b = group["block"][0].as_py()
        data, _ = texts_of(group["coords"].combine_chunks().chunk(0) if isinstance(group["coords"].combine_chunks(), pa.ChunkedArray) else group["coords"].combine_chunks())
        sub = np.frombuffer(data.tobytes(), "<i2").reshape(-1, size[b]).astype(np.float32) / np.float32(GRAIN)
        has = np.zeros(len(sub), bool)
        for p, q in near(sub, group["guest"].to_numpy(), reach[b]):
            has[p] = True
            has[q] = True
        return group.select(["class", "block", "cell", "tile", "guest"]).filter(pa.array(has))

    met = staged(dealt.groupBy("block", "cell", "tile").applyInArrow(partners, "class long, block int, cell long, tile int, guest boolean"), "partners")

    def join(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        b = group["block"][0].as_py()
        emb = group["embedding"].combine_chunks()
        x = _vectors(emb.chunk(0) if isinstance(emb, pa.ChunkedArray) else emb, d)
        r = rotated(x)
        member, copies = group["class"].to_numpy(), group["copies"].to_numpy()
        links = np.zeros(len(member), np.int64)
        reached = np.arange(len(member))

        def root(i):
            while reached[i] != i:
                reached[i] = reached[reached[i]]
                i = reached[i]
            return i

        for i, j in near(r[:, edge[b] : edge[b + 1]].astype(np.float32), group["guest"].to_numpy(), np.float32(share[b] + SLACK)):
            for k in range(0, len(i), 50_000):
                p, q = i[k : k + 50_000], j[k : k + 50_000]
                apart = r[p] - r[q]
                inside = np.stack([(apart[:, edge[c] : edge[c + 1]] ** 2).sum(1) <= share[c] for c in range(b + 1)], axis=1)
                first = inside[:, b] & ~inside[:, :b].any(1)  # the first block that finds it
                p, q = p[first], q[first]
                cosine = (x[p] * x[q]).sum(1) / np.sqrt((x[p] ** 2).sum(1) * (x[q] ** 2).sum(1))
                p, q = p[cosine >= threshold], q[cosine >= threshold]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                for m, n in zip(p.tolist(), q.tolist()):
                    m, n = root(m), root(n)
                    if m != n:
                        m, n = (m, n) if member[m] < member[n] else (n, m)
                        reached[n] = m
        hit = np.flatnonzero(links)
        return pa.table({"class": member[hit], "reached": member[[root(i) for i in hit.tolist()]] if len(hit) else member[hit], "links": links[hit]})

    whole = met.join(classes.select("class", "copies", "embedding"), "class")
    return whole.groupBy("block", "cell", "tile").applyInArrow(join, "class long, reached long, links long")
