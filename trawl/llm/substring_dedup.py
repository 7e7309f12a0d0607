"""Substring dedup by words: a count-min prefilter, then exact groups of what it lets through.

Windows of 50 words are counted by their anchor n-gram (see ``winnow``): a window occurs no more
often than its anchor, so the sketch's estimate for the anchor overestimates the window's count
and no repeated window is lost. The second pass keeps segments whose anchor is estimated
repeated; equal segments are combined first, and only where one anchor has different segments
are windows grouped one by one, by anchor and hash (108 bits).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm import sketch
from trawl.llm.common import Powers, free, pieces, spread, staged, word_hashes, words_of
from trawl.llm.winnow import segments

WINDOW = 50
SENT = 300_000  # segments that a task remembers to have sent
PASS_BYTES = 400_000  # of text at once: a byte takes some 80 bytes of temporary arrays
OUT = ("n_words", "n_removed", "kept_text")


def _segmented(batches, window, gram):
    powers = Powers()
    for rows, data, off in pieces(batches, most=PASS_BYTES):
        starts, ends, first = words_of(data, off)
        codes = word_hashes(data, starts, ends, powers)
        yield rows, segments(codes, first, window, gram, powers), powers


def repeated_windows(docs: DataFrame, window: int = WINDOW, width_bits: int = sketch.WIDTH_BITS) -> DataFrame:
    """(doc_id, text_key, _ranges): by text, runs (start, count) of windows that also start in a smaller doc_id.

    ``count`` windows begin at word ``start`` and the words after it. Rows without doc_id
    neither lose words nor make others lose any.
    """
    gram = window // 2
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_key"))

    def anchors(batches):
        for _, s, _ in _segmented(batches, window, gram):
            yield s["anchor"]

    bits = docs.sparkSession.sparkContext.broadcast(sketch.repeated(texts.select("text"), anchors, width_bits))

    def candidates(batches):
        sent = set()  # segments whose windows this task has sent: equal ones needn't carry them again
        for rows, s, powers in _segmented(batches, window, gram):
            keep = np.flatnonzero(sketch.may_repeat(bits.value, s["anchor"])) if len(s["doc"]) else s["doc"]
            if not len(keep):
                continue
            if len(sent) > SENT:
                sent.clear()
            kinds, where = np.unique(s["hash"][keep], return_index=True)
            new = [i for h, i in zip(kinds.tolist(), where.tolist()) if h not in sent]
            sent.update(kinds.tolist())
            bare = np.ones(len(keep), bool)
            bare[new] = False
            count = s["count"][keep]
            at, carried = s["at"][keep], np.where(bare, 0, count)
            p = np.repeat(at, carried) + spread(carried)
            wins = powers.ranges(s["prefix"], p, p + window, 7)
            doc = pa.array(s["doc"][keep])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(s["anchor"][keep]), pa.array(s["hash"][keep].view(np.int64)), pa.array(count.astype(np.int32)),
                    rows.column("doc_id").take(doc), rows.column("text_key").take(doc), pa.array(s["start"][keep].astype(np.int32)),
                    pa.ListArray.from_arrays(
                        pa.array(np.append(0, np.cumsum(carried)).astype(np.int32), mask=np.append(bare, False)), pa.array(wins.view(np.int64))
                    ),
                ],
                names=["anchor", "hash", "count", "doc_id", "text_key", "start", "windows"],
            )

    found = staged(
        texts.mapInArrow(candidates, f"anchor long, hash long, count int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, start int, windows array<long>"),
        "windows",
    )
    seg = ["anchor", "hash", "count"]
    # equal segments: all but those of the least document go whole
    least = found.groupBy(*seg).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("windows", ignorenulls=True).alias("windows"))
    least = staged(least, "segments")
    # several different segments of one anchor: their windows are grouped one by one
    mixed = least.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    each = least.join(mixed, "anchor").select("anchor", "hash", "count", "least", F.posexplode("windows").alias("i", "window"))
    first = each.groupBy("anchor", "window").agg(F.min("least").alias("first"))
    later = each.join(first, ["anchor", "window"]).where("first < least").groupBy(*seg).agg(F.collect_list("i").alias("at"))
    # a table of its own, so that both sides of the next join are plain exchanges, which AQE can split
    owners = staged(least.select(*seg, "least", "most").join(later, seg, "left").where("most > least OR at IS NOT NULL").drop("most"), "owners")
    # an owner is one row of its segment: as many rows as there are places, whatever repeats
    whole = F.array(F.struct("start", "count"))
    some = F.transform("at", lambda i: F.struct((F.col("start") + i).alias("start"), F.lit(1).alias("count")))
    placed = F.when(F.col("doc_id") > F.col("least"), whole).otherwise(some)  # null where nothing goes
    hit = found.drop("windows").join(owners, seg)
    return hit.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list(placed)).alias("_ranges"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, width_bits: int = sketch.WIDTH_BITS) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (kept words joined by one space).

    A word goes if a window of ``window`` words that covers it also starts in a document of
    smaller doc_id; windows are judged on the input. Null and empty texts have no words and an
    empty kept_text; texts shorter than a window stay whole; rows with a null doc_id stay whole;
    repeated rows (same id and text) get the same result; of rows that share an id but not the
    text, none makes the other lose words. Input columns named like an output are replaced.
    """
    ranges = repeated_windows(docs, window, width_bits)
    docs = docs.drop(*OUT)
    key, held, owner = free(docs, "_text_key", "_ranges", "_owner")
    ranges = ranges.select(F.col("doc_id").alias(owner), F.col("text_key").alias(key), F.col("_ranges").alias(held))
    docs = docs.withColumn(f"{key}2", F.xxhash64("text"))
    both = docs.join(ranges, (docs["doc_id"] == ranges[owner]) & (docs[f"{key}2"] == ranges[key]), "left").drop(key, f"{key}2", owner)
    keep = [f for f in both.schema.fields if f.name != held]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["n_words long", "n_removed long", "kept_text string"])

    def cut(batches):
        for rows, data, off in pieces(batches, most=PASS_BYTES):
            starts, ends, first = words_of(data, off)
            ranges = rows.column(rows.schema.get_field_index(held))
            # +1 where a covered run starts, -1 past its end, summed over the words
            step = np.zeros(len(starts) + 1, np.int64)
            flat = ranges.flatten()
            if len(flat):
                n = np.nan_to_num(np.asarray(pa.compute.list_value_length(ranges).to_numpy(zero_copy_only=False), float)).astype(np.int64)
                lo = np.repeat(first[:-1], n) + flat.field("start").to_numpy()
                np.add.at(step, lo, 1)
                np.add.at(step, lo + flat.field("count").to_numpy() + window - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[first[1:]] - total[first[:-1]]
            kept = np.flatnonzero(~gone)
            # bytes of kept words, and one blank after each but the text's last
            at = np.searchsorted(kept, first)
            glue = np.ones(len(kept), bool)
            glue[at[1:][at[1:] > at[:-1]] - 1] = False
            size = ends[kept] - starts[kept] + glue
            src = np.repeat(starts[kept], size) + spread(size)
            text = data[np.minimum(src, max(0, len(data) - 1))]
            ends_at = np.cumsum(size)
            text[ends_at[glue] - 1] = 0x20
            bound = np.concatenate([[0], ends_at])[at]
            out = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(bound.astype(np.int64)), pa.py_buffer(text)).cast(pa.string())
            cols = [rows.column(rows.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays(
                cols + [pa.array(np.diff(first)), pa.array(removed), out], names=[f.name for f in keep] + list(OUT)
            )

    return both.mapInArrow(cut, schema)
