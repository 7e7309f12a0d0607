"""Suffix-array dedup by bytes: remove what a string of 400 bytes covers that starts elsewhere too.

Texts are cut into segments of windows with one anchor (``winnow``); windows that are equal meet
under one anchor hash. Equal segments are counted before anything moves: two of them make all
their windows repeated. Where an anchor has several different segments, one copy of each goes
to a bucket of bounded bytes, where ``bwt`` expands intervals up to the minimum length. The
segments of an anchor too heavy for a bucket are cut again by longer anchors: half of what is
missing to the minimum is added each time, until the parts fit or an anchor is a whole window.
A sketch of anchors of fixed size only spares work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.llm import sketch
from trawl.llm.bwt import repeated_starts
from trawl.llm.common import Powers, byte_codes, free, pieces, spread, staged, texts_of
from trawl.llm.winnow import segments

LEAST = 400
CELL_BYTES = 500_000  # of different segments of one anchor that a bucket takes uncut
BUCKET_BYTES = 1_500_000
SPREAD = 32  # buckets that one task packs
PASS_BYTES = 400_000  # of text at once: a byte takes some 80 bytes of temporary arrays
OUT = ("n_bytes", "n_removed", "removed_spans", "kept_bytes", "kept_text")
_KEY = ("_key1", "_key2")


def _text_keys() -> tuple[Column, Column]:
    return F.xxhash64("text"), F.hash(F.coalesce("text", F.lit("")), F.lit(7))


def _keys(df: DataFrame) -> DataFrame:
    return df.withColumns(dict(zip(_KEY, _text_keys())))


def _segmented(batches, least, gram):
    powers, codes = Powers(), byte_codes(0)
    for rows, data, off in pieces(batches, most=PASS_BYTES):
        yield rows, data, off, segments(codes[data], off, least, gram, powers)


_SEG = ["anchor", "hash", "count"]
_HOME = ["anchor0", "hash0", "count0"]  # the segment of a text that a cut came from, and where in it
_RUN = "anchor0 long, hash0 long, count0 int, at int, len int"


def _runs(flag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, length) of runs of set flags within each text."""
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    other = np.ones(len(flag) + 1, bool)
    other[1:-1] = owner[1:] != owner[:-1]
    on = np.concatenate([[False], flag, [False]])
    rise = np.flatnonzero(flag & (~on[:-2] | other[:-1]))
    fall = np.flatnonzero(flag & (~on[2:] | other[1:]))
    return owner[rise], rise - off[owner[rise]], fall - rise + 1


def _expanded(cuts: DataFrame, weights: DataFrame, least: int) -> DataFrame:
    """Runs of repeated starts in ``cuts`` (anchor, home, at, content); weights: bytes of each anchor.

    Anchors are packed into buckets by running sums of their bytes, so a bucket holds
    BUCKET_BYTES and one anchor's at most.
    """
    total = weights.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, round(total / (SPREAD * BUCKET_BYTES)))
    upto = F.sum("bytes").over(W.partitionBy("part").orderBy("anchor"))
    packed = weights.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts))).select("anchor", "part", F.floor(upto / BUCKET_BYTES).alias("bucket"))

    def expand(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        data, off = texts_of(group["content"].combine_chunks() if isinstance(group["content"], pa.ChunkedArray) else group["content"])
        owner, start, size = _runs(repeated_starts(np.ascontiguousarray(data), off, least), off)
        pick = pa.array(owner)
        at = group["at"].to_numpy()[owner] + start
        return pa.table({**{c: group[c].take(pick) for c in _HOME}, "at": pa.array(at.astype(np.int32)), "len": pa.array(size.astype(np.int32))})

    return cuts.join(packed, "anchor").select("part", "bucket", *_HOME, "at", "content").groupBy("part", "bucket").applyInArrow(expand, _RUN)


def _cut_finer(cuts: DataFrame, least: int, gram: int) -> DataFrame:
    """Segments by anchors of ``gram`` bytes of what ``cuts`` hold, each with its home."""

    def finer(batches):
        for rows, data, off, s in _segmented(batches, least, gram):
            doc, size = pa.array(s["doc"]), s["count"] + least - 1
            content = data[np.repeat(s["at"], size) + spread(size)]
            bound = pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32))
            at = rows.column("at").to_numpy()[s["doc"]] + s["start"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(s["anchor"]), pa.array(s["hash"].view(np.int64)), pa.array(s["count"].astype(np.int32)), *(rows.column(c).take(doc) for c in _HOME),
                    pa.array(at.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(doc), [None, bound, pa.py_buffer(content)]),
                ],
                names=[*_SEG, *_HOME, "at", "text"],
            )

    schema = "anchor long, hash long, count int, anchor0 long, hash0 long, count0 int, at int, text binary"
    return cuts.select(*_HOME, "at", F.col("content").alias("text")).mapInArrow(finer, schema)


def repeated_strings(docs: DataFrame, least: int = LEAST, cell_bytes: int = CELL_BYTES, width_bits: int = sketch.WIDTH_BITS) -> DataFrame:
    """(_key1, _key2, _ranges): by text, runs (start, count) of starts of strings that also start elsewhere."""
    texts = _keys(docs.select("text")).where("text IS NOT NULL")
    gram = least // 2

    def anchors(batches):
        for *_, s in _segmented(batches, least, gram):
            yield s["anchor"]

    bits = docs.sparkSession.sparkContext.broadcast(sketch.repeated(texts.select("text"), anchors, width_bits))

    def candidates(batches):
        for rows, _, _, s in _segmented(batches, least, gram):
            keep = np.flatnonzero(sketch.may_repeat(bits.value, s["anchor"])) if len(s["doc"]) else s["doc"]
            if len(keep):
                doc = pa.array(s["doc"][keep])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s["anchor"][keep]), pa.array(s["hash"][keep].view(np.int64)), pa.array(s["count"][keep].astype(np.int32)),
                        rows.column("_key1").take(doc), rows.column("_key2").take(doc), pa.array(s["start"][keep].astype(np.int32)),
                    ],
                    names=[*_SEG, *_KEY, "start"],
                )

    found = staged(
        texts.mapInArrow(candidates, "anchor long, hash long, count int, _key1 long, _key2 int, start int")
        .groupBy(*_SEG, *_KEY, "start").agg(F.count(F.lit(1)).alias("n")),
        "strings",
    )
    kinds = staged(found.groupBy(*_SEG).agg(F.sum("n").alias("n"), F.min(F.struct(*_KEY, "start")).alias("one")), "kinds")

    def mixed(kinds: DataFrame) -> DataFrame:
        """Anchors with several different segments of which one isn't repeated as a whole."""
        found = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("n"), F.sum(F.col("count") + least - 1).alias("bytes"))
        return found.where("kinds > 1 AND n = 1").select("anchor", "bytes")

    cells = staged(mixed(kinds), "cells")
    wanted = kinds.join(cells, "anchor").select(*_SEG, "one.*").groupBy(*_KEY).agg(F.collect_list(F.struct(*_SEG, "start")).alias("_wanted"))
    # the texts that hold them, with the segments to cut out
    holders = texts.join(wanted, list(_KEY))

    def cut(batches):
        for rows, data, off in pieces(batches):
            w = rows.column("_wanted")
            n = pa.compute.list_value_length(w).to_numpy()
            w = w.flatten()
            at = np.repeat(off[:-1], n) + w.field("start").to_numpy()
            size = w.field("count").to_numpy().astype(np.int64) + least - 1
            content = data[np.repeat(at, size) + spread(size)]
            bound = pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(w.field(x) for x in _SEG), pa.Array.from_buffers(pa.binary(), len(at), [None, bound, pa.py_buffer(content)])], names=[*_SEG, "content"])

    cuts = holders.mapInArrow(cut, "anchor long, hash long, count int, content binary").dropDuplicates(_SEG)
    cuts = staged(cuts.select("anchor", *[F.col(a).alias(b) for a, b in zip(_SEG, _HOME)], F.lit(0).alias("at"), "content"), "cuts")
    runs = None
    while True:
        fits = (F.col("bytes") <= cell_bytes) | F.lit(gram >= least)
        got = _expanded(cuts, cells.where(fits), least)
        runs = got if runs is None else runs.unionByName(got)
        heavy = cells.where(~fits)
        if not heavy.limit(1).count():
            break
        gram = least - (least - gram) // 2
        finer = staged(_cut_finer(cuts.join(heavy.select("anchor"), "anchor"), least, gram), "finer")
        sub = staged(finer.groupBy(*_SEG).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_HOME, "at")).alias("one")), "subkinds")
        # equal parts of different segments are repeated as a whole
        again = finer.select(*_SEG, *_HOME, "at").join(sub.where("n > 1").select(*_SEG), _SEG).select(*_HOME, "at", F.col("count").alias("len"))
        runs = runs.unionByName(again)
        cells = staged(mixed(sub), "cells")
        one = sub.join(cells.select("anchor"), "anchor").select("anchor", "one.*")
        cuts = staged(one.join(finer.select("anchor", *_HOME, "at", F.col("text").alias("content")), ["anchor", *_HOME, "at"]), "cuts")
    runs = runs.groupBy(*[F.col(b).alias(a) for a, b in zip(_SEG, _HOME)]).agg(F.collect_list(F.struct("at", "len")).alias("runs"))
    # a table of its own, so that both sides of the next join are plain exchanges, which AQE can split
    owners = staged(kinds.select(*_SEG, "n").join(runs, _SEG, "left").where("n > 1 OR runs IS NOT NULL"), "owners")
    # an owner is one row of its segment, so this gives as many rows as there are places, whatever
    # repeats; a text's runs are gathered from them without a row for each
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("count").alias("len")))
    mine = F.when(F.col("n") > 1, whole).otherwise(F.col("runs"))  # null where nothing repeats
    placed = F.transform(mine, lambda r: F.struct((F.col("start") + r["at"]).alias("start"), r["len"].alias("count")))
    return found.drop("n").join(owners, _SEG, "left").groupBy(*_KEY).agg(F.flatten(F.collect_list(placed)).alias("_ranges"))


def suffix_dedup(docs: DataFrame, least: int = LEAST, cell_bytes: int = CELL_BYTES, width_bits: int = sketch.WIDTH_BITS) -> DataFrame:
    """``docs`` with n_bytes, n_removed, removed_spans (start, end), kept_bytes and kept_text.

    kept_bytes is what no repeated string covers; as a span may end inside a character,
    kept_text narrows every span to whole characters. Null and empty texts have no bytes; texts
    shorter than ``least`` stay whole; repeated rows count as two texts, so both lose their long
    strings; null ids don't matter, rows go by their text. Input columns named like an output are
    replaced.
    """
    ranges = repeated_strings(docs, least, cell_bytes, width_bits)
    docs = docs.drop(*OUT)
    keys, (held,) = free(docs, *_KEY), free(docs, "_ranges")
    ranges = ranges.select(*[F.col(k).alias(x) for k, x in zip(_KEY, keys)], F.col("_ranges").alias(held))
    both = docs.withColumns(dict(zip(keys, _text_keys()))).join(ranges, keys, "left").drop(*keys)
    keep = docs.schema.fields
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in keep]
        + ["n_bytes long, n_removed long, removed_spans array<struct<start:long,end:long>>, kept_bytes binary, kept_text string"]
    )

    def strings(kind, gone, data, off):
        total = np.concatenate([[0], np.cumsum(~gone)])
        return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(total[off].astype(np.int64)), pa.py_buffer(data[~gone])]).cast(kind), total

    def cut(batches):
        for rows, data, off in pieces(batches):
            ranges = rows.column(rows.schema.get_field_index(held))
            flat = ranges.flatten()
            gone = np.zeros(len(data), bool)
            if len(flat):
                step = np.zeros(len(data) + 1, np.int32)
                n = pa.compute.fill_null(pa.compute.list_value_length(ranges), 0).to_numpy()
                lo = np.repeat(off[:-1], n) + flat.field("start").to_numpy()
                np.add.at(step, lo, 1)
                np.add.at(step, lo + flat.field("count").to_numpy() + least - 1, -1)
                gone = np.cumsum(step[:-1]) > 0
            owner = np.searchsorted(off, np.flatnonzero(gone), "right") - 1
            at = np.flatnonzero(gone)
            rise = np.ones(len(at), bool)
            rise[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
            fall = np.append(rise[1:], True) if len(at) else rise
            who = owner[rise]
            spans = pa.StructArray.from_arrays([pa.array(at[rise] - off[who]), pa.array(at[fall] + 1 - off[who])], names=["start", "end"])
            bound = np.searchsorted(who, np.arange(len(off)))
            kept, total = strings(pa.binary(), gone, data, off)
            if len(flat) and gone.any():
                lead = np.flatnonzero((data & 0xC0) != 0x80)
                size = np.diff(np.append(lead, len(data)))
                gone = np.repeat(np.add.reduceat(gone.astype(np.int32), lead) == size, size)
            text, _ = strings(pa.string(), gone, data, off)
            cols = [rows.column(rows.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(np.diff(off)), pa.array(np.diff(off) - np.diff(total[off])), pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), spans), kept, text],
                names=[f.name for f in keep] + list(OUT),
            )

    return both.mapInArrow(cut, schema)
