"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters.

Documents link when their sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

1. Sets go through one shuffle as 64-bit tokens, packed by cell of the token space, to learn
   document frequencies; only tokens of two or more documents come back, packed by batch of
   documents. A token that is frequent within a batch travels as one count, so a common passage
   weighs as many entries as there are batches.
2. A document's tokens in order of (frequency, token) begin with its unshared ones, which can't
   match; if they fill the prefix, the document links with nothing.
3. Documents of equal sets are one class. A class lives in a tile: classes with the same rarest
   shared token and about the same length live together, those too heavy for a tile in several.
4. The join is on prefix tokens, and says which tiles a class must visit: those where one of its
   prefix tokens lives in a class of a length that may match. A class travels once to each pair
   of tiles, whatever the number of tokens, so copies follow shared tokens, not components.
5. In a pair of tiles, pairs of classes pass the length, positional and suffix filters and are
   verified once, by their first common token. Only counts and links that connect leave it.

Frequencies are kept in steps of an eighth of a doubling, which is an order like any other. Sets
are compared by tokens: two sets of m and n shingles count one too many in common with a chance of
m * n / 2**64 at most, 2e-11 for two texts of 20,000 words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import U64, Powers, connected, mixed, pieces, shuffle_width, spread, staged, texts_of, word_hashes, words_of

SHINGLE = 5
CELL_BITS = 12  # of a token that name its cell, at least; one more for each doubling beyond CELL_TEXT a cell
CELL_TEXT = 128_000_000  # bytes of text whose tokens share a cell
HOT = 64  # entries of a token in a batch from which they travel as a count
SENT = 500_000  # sets that a task remembers to have sent
KEPT = 1_000_000  # shared tokens that a task gathers before it sends them back
TILE_TOKENS = 400_000  # shared tokens of a tile's classes
BATCH_BYTES = 2_000_000
BAND = 1.26  # between lengths of neighbouring bands: sets that link are a band apart at most


def _prefix_length(n):
    return n - (4 * n + 4) // 5 + 1


def shingle_sets(data, off, powers):
    """(owner, token, n, s1, s2): distinct shingles by token and text; size and 128-bit sum of each set."""
    docs = len(off) - 1
    starts, ends, first = words_of(data, off)
    prefix = powers.prefix(word_hashes(data, starts, ends, powers, lower=True))
    n = np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    p = np.repeat(first[:-1], count) + spread(count)
    token = powers.ranges(prefix, p, np.minimum(p + SHINGLE, np.repeat(first[1:], count)), 21)
    order = np.argsort(token, kind="stable")  # texts stay in order within a token
    token, owner = token[order], np.repeat(np.arange(docs), count)[order]
    if len(token):
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])])
        token, owner = token[new], owner[new]
    sums = np.zeros((2, docs), U64)
    for row, seed in zip(sums, (31, 32)):
        np.add.at(row, owner, mixed(token, seed))
    return owner, token, np.bincount(owner, minlength=docs), sums[0], sums[1]


def _pack(*arrays):
    return b"".join([np.array([len(a) for a in arrays], np.uint32).tobytes(), *(a.tobytes() for a in arrays)])


def _unpack(blob, *kinds):
    """Arrays of a packed blob; a kind that is a number stands for unsigned integers of so many bytes."""
    size = np.frombuffer(blob, np.uint32, len(kinds))
    out, at = [], 4 * len(kinds)
    for n, kind in zip(size.tolist(), kinds):
        if isinstance(kind, int):
            out.append(np.frombuffer(blob, np.uint8, n * kind, at).reshape(n, kind))
            at += n * kind
        else:
            out.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return out


def _narrow(x: np.ndarray, width: int) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _wide(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, : x.shape[1]] = x
    return out.view("<u8").ravel()


_HOME = ("u1", "<i4", "<u8", "<u8", "<u8", "<u2")  # ids, n, s1, s2, hot token, hot owner


def _sets(docs: DataFrame, cell_bits: int) -> DataFrame:
    """(doc_id, n, s1, s2, prefix, shared, ranks): for a document that may link, its shared tokens by
    (rank of frequency, token), and how many of them lie in its prefix."""
    cells, rest = 1 << cell_bits, U64(64 - cell_bits)
    low = U64((1 << (64 - cell_bits)) - 1)
    width = -(-(64 - cell_bits) // 8)
    batch_bytes = min(32_000_000, BATCH_BYTES << (cell_bits - min(cell_bits, 12)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def send(batches):
        powers, seen, seq = Powers(), set(), 0
        base = TaskContext.get().partitionId() << 24
        for rows, data, off in pieces(batches, most=batch_bytes):
            owner, token, n, s1, s2 = shingle_sets(data, off, powers)
            # a set that this task has sent already needn't go again
            new = np.zeros(len(n), bool)
            if len(seen) > SENT:
                seen.clear()
            for i, k in enumerate(zip(n.tolist(), s1.tolist(), s2.tolist())):
                if k not in seen:
                    seen.add(k)
                    new[i] = True
            mine = new[owner]
            owner, token = owner[mine].astype(np.uint16), token[mine]
            head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
            runs = np.diff(np.append(head, len(token)))
            hot = runs > HOT
            many = np.repeat(hot, runs)
            sink = pa.BufferOutputStream()
            ids = pa.record_batch([rows.column("doc_id")], names=["doc_id"])
            with pa.ipc.new_stream(sink, ids.schema) as to:
                to.write_batch(ids)
            home = _pack(np.frombuffer(sink.getvalue(), np.uint8), n.astype("<i4"), s1, s2, token[many], owner[many])
            batch = base | seq
            seq += 1
            out_cell, out = [-1], [home]
            hot_token, hot_runs = token[head[hot]], runs[hot].astype(np.uint32)
            token, owner = token[~many], owner[~many]
            cell = np.arange(cells).astype(U64) << rest
            a, b = np.append(np.searchsorted(token, cell), len(token)), np.append(np.searchsorted(hot_token, cell), len(hot_token))
            rem, hot_rem = _narrow(token & low, width), _narrow(hot_token & low, width)
            for c in np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)).tolist():
                out_cell.append(c)
                out.append(_pack(rem[a[c] : a[c + 1]], owner[a[c] : a[c + 1]], hot_rem[b[c] : b[c + 1]], hot_runs[b[c] : b[c + 1]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_cell, pa.int32()), pa.array(np.full(len(out), batch)), pa.array(out, pa.binary())], names=["cell", "batch", "blob"]
            )

    def in_runs(batches):
        """(key, rows) of successive rows with equal first column."""
        key, rows = None, []
        for part in batches:
            for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                if row[0] != key and rows:
                    yield key, rows
                    rows = []
                key = row[0]
                rows.append(row[1:])
        if rows:
            yield key, rows

    def counted_cell(c, rows):
        """(batch, owner, token, rank) of a cell's tokens that two or more documents hold."""
        token, owner, batch, weight = [], [], [], []
        for k, (_, blob) in enumerate(rows):
            rem, idx, hot, runs = _unpack(blob.as_buffer(), width, "<u2", width, "<u4")
            token += [_wide(rem), _wide(hot)]
            owner += [idx, np.full(len(hot), 0xFFFF, np.uint16)]
            weight += [np.ones(len(rem), np.uint32), runs]
            batch.append(np.full(len(rem) + len(hot), k, np.int32))
        token, owner, batch, weight = map(np.concatenate, (token, owner, batch, weight))
        order = np.argsort(token, kind="stable")
        token = token[order]
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        df = np.add.reduceat(weight[order].astype(np.int64), head)
        rank = np.minimum(8 * np.log2(df), 255).astype(np.uint8)
        runs = np.diff(np.append(head, len(token)))
        keep = np.repeat(df > 1, runs)
        order = order[keep]
        return np.array([b for b, _ in rows])[batch[order]], owner[order], (U64(c) << rest) | token[keep], np.repeat(rank, runs)[keep]

    def packed(parts):
        batch, owner, token, rank = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(batch, kind="stable")
        batch, owner, token, rank = batch[order], owner[order], token[order], rank[order]
        head = np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]])) if len(batch) else np.zeros(0, np.int64)
        ends = np.append(head[1:], len(batch))
        blobs = [_pack(token[a:b], owner[a:b], rank[a:b]) for a, b in zip(head, ends)]
        return pa.RecordBatch.from_arrays([pa.array(batch[head], pa.int64()), pa.array(np.zeros(len(head), bool)), pa.array(blobs, pa.binary())], names=["batch", "home", "blob"])

    def count(batches):
        parts = []
        for c, rows in in_runs(batches):
            if c < 0:
                for b, blob in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([True]), pa.array([blob.as_py()], pa.binary())], names=["batch", "home", "blob"])
                continue
            parts.append(counted_cell(c, rows))
            if sum(len(x[0]) for x in parts) > KEPT:
                yield packed(parts)
                parts = []
        if parts:
            yield packed(parts)

    def resolve(batches):
        for _, rows in in_runs(batches):
            ids, n, s1, s2, hot, hot_owner = next(_unpack(blob.as_py(), *_HOME) for home, blob in rows if home)
            ids = pa.ipc.open_stream(pa.py_buffer(ids)).read_all().column(0).combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            has = pa.compute.is_valid(ids).to_numpy(zero_copy_only=False)
            got = [_unpack(blob.as_py(), "<u8", "<u2", "u1") for home, blob in rows if not home]
            none = (np.zeros(0, U64), np.zeros(0, np.uint16), np.zeros(0, np.uint8))
            token, owner, rank = (np.concatenate(x) for x in zip(none, *got))
            common = owner == 0xFFFF
            if common.any():  # frequent in this batch: their owners stayed at home
                by = np.argsort(token[common])
                at = by[np.searchsorted(token[common][by], hot)]
                token, owner, rank = (np.concatenate([x[~common], y]) for x, y in ((token, hot), (owner, hot_owner), (rank, rank[common][at])))
            order = np.lexsort((token, rank, owner))
            token, owner, rank = token[order], owner[order], rank[order]
            shared = np.bincount(owner, minlength=len(n))
            prefix = np.minimum(shared, _prefix_length(n) - (n - shared))
            prefix[(n == 0) | ~has] = 0
            prefix = np.maximum(prefix, 0)
            keep = np.repeat(prefix > 0, shared)
            bound = np.concatenate([[0], np.cumsum(np.where(prefix > 0, shared, 0))]).astype(np.int32)
            ranks = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bound), pa.py_buffer(rank[keep].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(prefix.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(bound), pa.array(token[keep].view(np.int64))), ranks,
                ],
                names=["doc_id", "n", "s1", "s2", "prefix", "shared", "ranks"],
            )

    width_ = shuffle_width(docs.sparkSession)
    sent = docs.select("doc_id", "text").mapInArrow(send, "cell int, batch long, blob binary")
    # homes are spread by their batch; in a partition, a cell's or a batch's rows come together
    by_cell = sent.repartition(width_, F.when(F.col("cell") < 0, -1 - F.col("batch")).otherwise(F.col("cell"))).sortWithinPartitions("cell")
    counted = by_cell.mapInArrow(count, "batch long, home boolean, blob binary")
    by_batch = counted.repartition(width_, "batch").sortWithinPartitions("batch")
    return by_batch.mapInArrow(resolve, f"doc_id {kind}, n long, s1 long, s2 long, prefix int, shared array<long>, ranks binary")


def _may_overlap(x: np.ndarray, y: np.ndarray, need: int, depth: int = 2) -> bool:
    """Suffix filter: no more can be common than the parts on either side of a middle token allow."""

    def most(x, y, depth):
        if not depth or len(x) < 8 or len(y) < 8:
            return min(len(x), len(y))
        mid = y[len(y) // 2]
        i, j = np.searchsorted(x, mid), len(y) // 2
        return most(x[:i], y[:j], depth - 1) + most(x[i:], y[j:], depth - 1)

    return most(x, y, depth) >= need


def links(member: np.ndarray, n: np.ndarray, prefix: np.ndarray, tokens: np.ndarray, ranks: np.ndarray, at: np.ndarray, tile: np.ndarray, copies: np.ndarray, two: bool):
    """(link counts, least member reached) of the members of a block.

    tokens[at[i]:at[i+1]] are member i's shared tokens by (rank, token). In a block of two tiles
    members of unequal tile meet, in a block of one tile all do.
    """
    size = np.diff(at)
    skip = n - size  # unshared tokens come first
    order = np.lexsort((member, n))
    found = np.zeros(len(member), np.int64)
    reached = np.arange(len(member))
    by = np.lexsort((tokens, ranks))
    new = np.ones(len(by), bool)
    new[1:] = tokens[by[1:]] != tokens[by[:-1]]
    code = np.empty(len(by), np.int64)
    code[by] = np.cumsum(new) - 1
    kinds = int(new.sum())
    take = prefix.astype(np.int64)
    entry = np.repeat(at[:-1], take) + spread(take)
    e_token, e_row, e_pos = code[entry], np.repeat(np.arange(len(member)), take), np.repeat(skip, take) + spread(take)
    rank = np.empty(len(member), np.int64)
    rank[order] = np.arange(len(member))
    by = np.lexsort((rank[e_row], e_token))
    e_token, e_row, e_pos = e_token[by], e_row[by], e_pos[by]
    lo, hi = np.searchsorted(e_token, np.arange(kinds)), np.searchsorted(e_token, np.arange(kinds), "right")
    mark = np.zeros(kinds, bool)

    def root(i):
        while reached[i] != i:
            reached[i] = reached[reached[i]]
            i = reached[i]
        return i

    for i in order.tolist():
        mine = code[at[i] : at[i] + take[i]]
        runs = hi[mine] - lo[mine]
        if runs.max(initial=0) < 2:
            continue
        where = np.repeat(lo[mine], runs) + spread(runs)
        my_pos = np.repeat(skip[i] + np.arange(len(mine)), runs)
        other = e_row[where]
        ok = rank[other] > rank[i]  # a later, so no smaller, set
        ok &= 4 * n[other] <= 5 * n[i]  # length filter
        if two:
            ok &= tile[other] != tile[i]
        other, pos, my_pos = other[ok], e_pos[where][ok], my_pos[ok]
        other, once = np.unique(other, return_index=True)  # at the first common token
        need = -(-4 * (n[other] + n[i]) // 9)
        ok = 1 + np.minimum(n[i] - my_pos[once] - 1, n[other] - pos[once] - 1) >= need  # positional filter
        other, need = other[ok], need[ok]
        x = code[at[i] : at[i + 1]]
        ok = np.array([_may_overlap(x, code[at[j] : at[j + 1]], k) for j, k in zip(other.tolist(), need.tolist())], bool)
        other, need = other[ok], need[ok]
        if not len(other):
            continue
        mark[x] = True
        c = size[other]
        hits = mark[code[np.repeat(at[other], c) + spread(c)]]
        common = np.add.reduceat(hits.astype(np.int64), np.concatenate([[0], np.cumsum(c)[:-1]]))
        mark[x] = False
        linked = other[common >= need]
        found[i] += copies[linked].sum()
        found[linked] += copies[i]
        for j in linked.tolist():
            a, b = root(i), root(j)
            if a != b:
                a, b = (a, b) if member[a] < member[b] else (b, a)
                reached[b] = a
    return found, member[[root(i) for i in range(len(member))]]


def ngram_join(docs: DataFrame, cell_bits: int | None = None, tile_tokens: int = TILE_TOKENS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs``.

    Words are runs outside \\x20 and \\x09-\\x0D with A-Z lowered; a set has the distinct 5-word
    shingles, of fewer words the whole sequence as one. Ids may have any type that has an order.
    Null and empty texts have an empty set, link with nothing and are their own component; rows
    with a null doc_id have their set's size, no component and no links; repeated rows are copies
    of one class and link with each other. n_links counts the other rows linked directly, copies
    included. Only doc_id and text are read, so other columns may have any name.
    """
    if cell_bits is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        cell_bits = max(CELL_BITS, math.ceil(math.log2(max(1, size / CELL_TEXT))))
    sets = staged(_sets(docs, cell_bits), "sets")
    key = ["n", "s1", "s2"]
    known = sets.where("doc_id IS NOT NULL AND n > 0")
    classes = known.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min(F.when(F.col("prefix") > 0, F.col("doc_id"))).alias("holder"))
    # numbered where they are written: a class is more than its least id, which rows of other texts may share
    classes = staged(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    holders = classes.where("holder IS NOT NULL").select(*key, "holder", "class", "copies")
    loads = known.where("prefix > 0").withColumnRenamed("doc_id", "holder")
    one = [*key, "holder"]
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)).cast("int")
    weight = (F.length("ranks") + 1).alias("weight")
    index = loads.select(*one, weight, F.expr("slice(shared, 1, prefix)").alias("tokens")).join(holders, one).dropDuplicates(one)
    index = staged(index.select("class", band.alias("band"), "weight", F.posexplode("tokens").alias("pos", "token")), "prefixes")
    shared = index.groupBy("token").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most").select("token")
    index = staged(index.join(shared, "token"), "postings")
    anchors = index.groupBy("class", "band", "weight").agg(F.min(F.struct("pos", "token"))["token"].alias("anchor"))
    anchors = staged(anchors, "anchors")
    tiles = max(1, math.ceil((anchors.agg(F.sum("weight")).first()[0] or 0) / tile_tokens))
    together = ["anchor", "band"]
    # staged, so that AQE can split the join with a common anchor's classes
    heavy = staged(anchors.groupBy(*together).agg(F.ceil(F.sum("weight") / tile_tokens).alias("parts")).where("parts > 1"), "heavy")
    part = F.coalesce(F.pmod(F.xxhash64("class"), F.col("parts")), F.lit(0))
    placed = anchors.join(heavy, together, "left").select("class", F.pmod(F.xxhash64(*together, part), F.lit(tiles)).alias("tile"))
    index = staged(index.select("class", "band", "token").join(placed, "class"), "placed")
    homes = index.select("token", "band", F.col("tile").alias("other")).distinct()
    homes = homes.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    visits = index.join(homes, ["token", "band"]).select("class", "tile", "other").distinct()
    who = visits.groupBy("class", "tile").agg(F.collect_list("other").alias("others")).join(holders, "class")
    dealt = (
        loads.select(*one, "prefix", "shared", "ranks").join(who, one).dropDuplicates(one)
        .select("class", "copies", "n", "prefix", "shared", "ranks", "tile", F.explode("others").alias("other"))
        .withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other")).drop("other")
    )

    def join(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        col = lambda c: group[c].to_numpy().astype(np.int64)
        flat = lambda c: group[c].combine_chunks().chunk(0) if isinstance(group[c].combine_chunks(), pa.ChunkedArray) else group[c].combine_chunks()
        shared, (ranks, _) = flat("shared"), texts_of(flat("ranks"))
        at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(shared).to_numpy())])
        member = col("class")
        found, reached = links(member, col("n"), col("prefix"), shared.flatten().to_numpy().view(U64), ranks, at, col("tile"), col("copies"), col("lo")[0] != col("hi")[0])
        hit = np.flatnonzero(found)
        return pa.table({"class": member[hit], "reached": reached[hit], "links": found[hit]})

    linked = staged(dealt.groupBy("lo", "hi").applyInArrow(join, "class long, reached long, links long"), "links")
    component = staged(connected(linked.select(F.col("class").alias("a"), F.col("reached").alias("b")), "joined"), "joined")
    member = classes.select("class", "rep").join(component, F.col("class") == F.col("id"))
    least = member.groupBy("component").agg(F.min("rep").alias("least"))
    named = component.join(least, "component").select(F.col("id").alias("class"), "least")
    total = linked.groupBy("class").agg(F.sum("links").alias("links"))
    owner = staged(
        classes.join(total, "class", "left").join(named, "class", "left").select(
            *key, F.coalesce("least", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
        ),
        "owners",
    )
    return sets.select("doc_id", *key).join(owner, key, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component"))).alias("component_id"),
        F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.lit(0)).otherwise(F.col("links")).alias("n_links"),
    )
