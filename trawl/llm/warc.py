"""WARC records and a Merkle audit of their fixity.

Pages become WARC response records in files of ordered offsets. Every record is hashed; hashes of
FANOUT neighbours in offset order are hashed together, level by level, into one root per file.
Two replicas are compared by their roots; only children of mismatching nodes are joined on the way
down, which ends at the offset ranges of the records that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.llm.common import staged

FANOUT = 16
FILE_RECORDS = 4096  # ids of a file
NULL_FILES = 1 << 16  # over which records without an id are dealt
LEVELS = 4  # of nodes above a record: enough for FANOUT ** LEVELS records of a file
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"


def record(url: Column, body: Column, record_id: Column) -> Column:
    """A WARC response record without the two line ends that close it."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit(END), body,
    )


def layout(pages: DataFrame, with_record: bool = True) -> DataFrame:
    """(page_id, file, seq, offset, length, sha256, record): the records of all pages, placed.

    Records are hashed where they are read; without ``with_record`` only hashes and lengths move.
    Files hold FILE_RECORDS ids each, ordered by id and, for repeated ids, by content. Pages are
    few to an id; ids repeated beyond FANOUT ** LEVELS rows of a file would need more levels. Rows
    without an id are dealt to files -1 to -NULL_FILES by their hash, null pages are empty bodies,
    null URLs empty.
    """
    rows = pages.select("page_id", record(F.col("url"), F.col("html"), F.col("page_id")).alias("record"))
    file = F.coalesce(F.floor(F.col("page_id") / FILE_RECORDS).cast("long"), -1 - F.pmod(F.xxhash64("record"), F.lit(NULL_FILES)))
    rows = rows.select("page_id", file.alias("file"), (F.octet_length("record") + 4).cast("long").alias("length"), F.sha2("record", 256).alias("sha256"), *["record"] * with_record)
    order = W.partitionBy("file").orderBy("page_id", "sha256")
    return rows.select(
        "page_id", "file", (F.row_number().over(order) - 1).cast("long").alias("seq"),
        (F.sum("length").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("length")).alias("offset"), "length", "sha256", *["record"] * with_record,
    )


def leaves(records: DataFrame) -> DataFrame:
    """(file, level 0, node = seq, start, end, hash) of placed records."""
    return records.select(
        "file", F.lit(0).alias("level"), F.col("seq").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), F.col("sha256").alias("hash")
    )


def merkle(leaf: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Nodes (file, level, node, start, end, hash) of all levels; level ``levels`` is the root.

    A node's hash is that of its children's hex hashes joined in offset order, with its offset
    range, so that a shifted range shows as well.
    """
    out, below = leaf, leaf
    for level in range(1, levels + 1):
        below = (
            below.groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("node"))
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("parts"))
            .select("file", F.lit(level).alias("level"), "node", "start", "end", F.sha2(F.concat_ws("|", F.col("start").cast("string"), F.col("end").cast("string"), F.array_join("parts.hash", "")), 256).alias("hash"))
        )
        out = out.unionByName(below)
    return out


def audit(one: DataFrame, two: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(file, node, start, end, hash, other): leaves that differ between two trees.

    Starts at the roots and joins children of mismatching nodes only. A file or record that just
    one tree has shows with a null hash on the other side. Equal trees give no rows.
    """

    def differ(a, b):
        key = ["file", "node"]
        both = a.select(*key, "start", "end", "hash").join(b.select(*key, F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("hash").alias("other")), key, "full")
        # a range that moved is a difference too
        same = F.col("hash").eqNullSafe(F.col("other")) & F.col("start").eqNullSafe(F.col("start2")) & F.col("end").eqNullSafe(F.col("end2"))
        return both.where(~same).select(*key, F.coalesce("start", "start2").alias("start"), F.coalesce("end", "end2").alias("end"), "hash", "other")

    wrong = differ(one.where(F.col("level") == levels), two.where(F.col("level") == levels))
    for level in range(levels - 1, -1, -1):
        # the few nodes that mismatch, written so that both sides descend from one result
        parent = staged(wrong.select("file", F.col("node").alias("parent")), "mismatches")
        under = lambda t: t.where(F.col("level") == level).withColumn("parent", F.floor(F.col("node") / fanout).cast("long")).join(parent, ["file", "parent"], "left_semi")  # noqa: E731, B023
        wrong = differ(under(one), under(two))
    return wrong


def write_warc(records: DataFrame, path: str) -> None:
    """Write placed records as WARC text, a folder file=N for each file, in offset order."""
    (
        records.repartition("file").sortWithinPartitions("file", "seq").select("file", F.col("record").alias("value"))
        .write.partitionBy("file").option("lineSep", END).text(path)
    )


def read_warc(spark, path: str) -> DataFrame:
    """(file, offset, url, record_id, html) of the WARC records under ``path``; lengths come from the headers."""

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = 0
                while at < len(data):
                    head = data.index(b"\r\n\r\n", at)
                    fields = dict(x.split(": ", 1) for x in data[at:head].decode().split("\r\n")[1:])
                    size = int(fields["Content-Length"])
                    body = data[head + 4 : head + 4 + size]
                    out.append((name, at, fields["WARC-Target-URI"], fields["WARC-Record-ID"][10:-1], body.decode()))
                    at = head + 4 + size + 4
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "offset", "url", "record_id", "html"), r)) for r in out], schema=pa.schema([("path", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("html", pa.string())]))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    found = files.select("path", "content").mapInArrow(rows, "path string, offset long, url string, record_id string, html string")
    return found.select(F.regexp_extract("path", r"file=(-?\d+)", 1).cast("long").alias("file"), "offset", "url", "record_id", "html")


def fixity_audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """(page_id, file, seq, offset, length, sha256, intact) for every page, against a replica of the pages.

    A record is intact if the descent doesn't end at it. Null bodies and URLs count as empty;
    repeated rows are records of their own; an empty table gives no rows.
    """
    mine = staged(layout(pages, with_record=False), "records")
    leaf = leaves(mine)
    theirs = staged(leaves(layout(replica, with_record=False)), "replica")
    wrong = audit(staged(merkle(leaf), "tree"), staged(merkle(theirs), "tree"))
    bad = wrong.where("hash IS NOT NULL").select("file", F.col("node").alias("seq"), F.lit(False).alias("found"))
    return mine.join(bad, ["file", "seq"], "left").select("page_id", "file", "seq", "offset", "length", "sha256", F.coalesce("found", F.lit(True)).alias("intact"))
