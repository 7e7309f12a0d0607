"""Sharding by a k-d tree over metadata, in DataFrame operations only.

Every row is a point of three dimensions drawn from its text: log size, share of bytes beyond one
a character, and checksum. A node that stands for k shards is split along its widest dimension at
the weighted quantile floor(k/2)/k, until it stands for one shard of the target bytes. Quantiles
come from histograms that are refined inside the crossing bin; only that bin's row of each node
reaches the driver. Ties on a value are ordered by a hash of the text, so equal texts share a key and
never part. The one exception is a group of equal texts that outweighs a whole shard's target and so
fits no shard: its ties are ordered by a hash of doc_id, and cuts run through it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.llm.common import staged

SHARDS = 24
DIMENSIONS = 3
BINS = 4096
CLOSE = 0.0005  # of the target bytes: a crossing bin as light as this is split no further
SLOT_ROWS = 20_000  # rows that one task numbers
_HIGH = 31  # bits of a value and of the hash that orders its ties


def _points(docs: DataFrame, shards: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    rows = docs.select(
        "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"),
        F.when(F.octet_length(text) > 0, 1 - F.char_length(text) / F.octet_length(text)).otherwise(0.0).alias("wide"),
    )
    rows = staged(rows, "points")
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy = rows.groupBy("group").agg(F.sum("size").alias("w")).where(F.col("w") > total / shards).select("group", F.lit(True).alias("heavy"))
    # fewer than ``shards`` groups can weigh that much: the broadcast is bounded
    rows = rows.join(F.broadcast(heavy), "group", "left")
    tie = F.shiftrightunsigned(F.when(F.col("heavy"), F.xxhash64("doc_id", "group")).otherwise(F.xxhash64("group")), 64 - _HIGH)
    top = (1 << _HIGH) - 1
    values = (F.log2(F.col("size")) / 48, F.col("wide"), F.col("text_crc32") / 2**32)
    keys = [(F.shiftleft(F.least(F.floor(v * top), F.lit(top)).cast("long"), _HIGH) + tie).alias(f"k{i}") for i, v in enumerate(values)]
    return staged(rows.select("doc_id", "size", "text_crc32", *keys), "keyed")


def _pick(choices: dict[int, Column], node: Column, default: Column) -> Column:
    out = default
    for n, c in choices.items():
        out = F.when(node == n, c).otherwise(out)
    return out


def _quantiles(points: DataFrame, node: Column, want: dict[int, tuple[int, float]], span: dict[int, tuple[int, int]], close: float) -> dict[int, int]:
    """For each node (dimension, weight): the least key up to which the node holds that weight."""
    lo = {n: span[n][0] for n in want}
    hi = {n: span[n][1] for n in want}
    before = dict.fromkeys(want, 0)
    done: dict[int, int] = {}
    while want.keys() - done.keys():
        open_ = [n for n in want if n not in done]
        step = {n: max(1, -(-(hi[n] - lo[n] + 1) // BINS)) for n in open_}
        key = _pick({n: F.col(f"k{want[n][0]}") for n in open_}, F.col("node"), F.lit(None).cast("long"))
        part = points.select(node.cast("int").alias("node"), "size", *[f"k{i}" for i in range(DIMENSIONS)]).where(F.col("node").isin(open_)).withColumn("key", key)
        inside = F.lit(False)
        for n in open_:
            inside = inside | ((F.col("node") == n) & F.col("key").between(lo[n], hi[n]))
        bin_ = _pick({n: F.floor((F.col("key") - F.lit(lo[n])) / F.lit(step[n]).cast("decimal(20,0)")).cast("long") for n in open_}, F.col("node"), F.lit(0).cast("long"))
        bins = part.where(inside).groupBy("node", bin_.alias("bin")).agg(F.sum("size").alias("w"))
        upto = F.sum("w").over(W.partitionBy("node").orderBy("bin"))  # BINS rows of a node at most
        goal = _pick({n: F.lit(want[n][1] - before[n]) for n in open_}, F.col("node"), F.lit(0.0))
        crossing = bins.withColumn("upto", upto).where((F.col("upto") >= goal) & (F.col("upto") - F.col("w") < goal)).collect()
        found = {r["node"]: r for r in crossing}
        for n in open_:
            if n not in found:
                done[n] = hi[n]
                continue
            r = found[n]
            first = lo[n] + r["bin"] * step[n]
            last = min(hi[n], first + step[n] - 1)
            below = before[n] + r["upto"] - r["w"]
            if step[n] == 1 or r["w"] <= close:
                # the nearer end of the bin
                done[n] = last if before[n] + r["upto"] - want[n][1] <= want[n][1] - below else first - 1
            else:
                lo[n], hi[n], before[n] = first, last, below
    return done


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    The law is ``bytes``: shards 0 to shards-1 hold nearly equal sums of size, the text's UTF-8
    bytes plus 8. Equal texts share a shard unless together they outweigh its target. Null texts
    count as empty (size 8, checksum 0); null ids are placed like others and numbered first;
    repeated rows get slots of their own. slot numbers a shard's rows from 0 without gaps. An
    empty table gives no rows. Only doc_id and text are read, so other columns may have any name.
    """
    points = _points(docs, shards)
    total = points.agg(F.sum("size")).first()[0] or 0
    close = CLOSE * total / shards
    node, number = F.lit(0), 1
    open_ = {0: shards}
    order: dict[int, int] = {0: 0}  # a node's least shard
    root: list[float] = []
    while any(k > 1 for k in open_.values()) and total:
        split = {n: k for n, k in open_.items() if k > 1}
        ends = (
            points.groupBy(node.alias("node"))
            .agg(F.sum("size").alias("w"), *[f(f"k{i}").alias(f"{f.__name__}{i}") for i in range(DIMENSIONS) for f in (F.min, F.max)])
            .collect()
        )  # a row for each node
        ends = {r["node"]: r for r in ends}
        if not root:
            root = [max(1, ends[0][f"max{i}"] - ends[0][f"min{i}"]) for i in range(DIMENSIONS)]
        want, span = {}, {}
        for n, k in split.items():
            if n not in ends:
                continue
            r = ends[n]
            widest = max(range(DIMENSIONS), key=lambda i: ((r[f"max{i}"] - r[f"min{i}"]) / root[i], -i))
            want[n] = widest, r["w"] * (k // 2) / k
            span[n] = r[f"min{widest}"], r[f"max{widest}"]
        at = _quantiles(points, node, want, span, close)
        nxt = {n: k for n, k in open_.items() if k == 1}
        choices = {}
        for n, k in split.items():
            left, right = number, number + 1
            number += 2
            nxt[left], nxt[right] = k // 2, k - k // 2
            order[left], order[right] = order[n], order[n] + k // 2
            if n in at:
                choices[n] = F.when(F.col(f"k{want[n][0]}") <= at[n], F.lit(left)).otherwise(F.lit(right))
        # the tree so far is an expression over the keys: no row is rewritten to descend
        node = _pick(choices, node, node)
        open_ = nxt
        if len(open_) > 2:
            columns = [c for c in points.columns if c != "node"]
            points = staged(points.select(*columns, node.alias("node")), "descended")
            node = F.col("node")
    shard_of = {n: F.lit(order[n]) for n in open_}
    placed = points.select("doc_id", "size", "text_crc32", _pick(shard_of, node, F.lit(0)).cast("int").alias("shard"))
    rows = placed.agg(F.count(F.lit(1))).first()[0]
    parts = max(1, -(-rows // (SLOT_ROWS * shards)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts)))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("start"))
    mine = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("mine", mine).join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("mine") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
