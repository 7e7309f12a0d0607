import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from trawl.llm.embedding_dedup import embedding_dedup
from trawl.llm.kd_shards import kd_shards
from trawl.session import table


def test_shards_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = kd_shards(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "bytes" and r.grown_shard is None
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(size) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(size.values()) / 24, max(r.size for r in rows)
    groups = Counter()
    for r in rows:
        groups[texts[r.doc_id]] += r.size
    assert max(size.values()) - min(size.values()) <= max(largest, *groups.values())
    parted = defaultdict(set)
    for r in rows:
        parted[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for t, s in parted.items() if groups[t] <= mean)
    assert max(size.values()) <= 1.1 * mean


def test_shards_with_a_heavy_group_and_nulls(spark):
    rng = random.Random(1)
    rows = [(i, "same text " * 20) for i in range(400)] + [(400 + i, "w" * rng.randint(0, 300)) for i in range(800)] + [(None, None), (5, None), (7, "same text " * 20)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, shard string")
    got = kd_shards(df, shards=6).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert max(size.values()) <= 1.03 * sum(size.values()) / 6
    shards, weight = defaultdict(set), Counter()
    for r in got:
        shards[r.text_crc32].add(r.shard)
        weight[r.text_crc32] += r.size
    light = [c for c in shards if weight[c] <= sum(size.values()) / 6]
    assert len(light) > 200 and all(len(shards[c]) == 1 for c in light)  # equal texts together unless they outweigh a shard
    assert kd_shards(df.limit(0), shards=6).collect() == []


def brute(rows, threshold=0.9):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float32).astype(float)
            good[k] = a / np.sqrt((a * a).sum())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = Counter()
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                links[a] += 1
                links[b] += 1
                parent[root(b)] = root(a)
    least = {}
    for k in good:
        least[root(k)] = min(least.get(root(k), 1 << 60), rows[k][0])
    out = []
    for k, (i, _) in enumerate(rows):
        c = least[root(k)] if k in good else i
        out.append((i, links[k], c, i is not None and i == c))
    return sorted(out, key=str)


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(12):
        base = rng.normal(size=16)
        for j in range(rng.integers(1, 25)):
            rows.append((len(rows), (base + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.3])).astype(np.float32).tolist()))
    rows += [(len(rows) + i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(150)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1001, rows[3][1]), (1002, [0.0] * 16), (1003, None), (1004, [float("nan")] * 16), (1005, [None] * 16)]
    rows += [(1006, []), (1007, [float("inf")] + [1.0] * 15), (None, rows[3][1]), (1008, [1.0, 2.0, 3.0]), (1009, [2.0, 4.0, 6.0]), (1010, [5.0]), (1011, [2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n_links int").repartition(4)
    for kw in ({}, {"tile": 20}, {"blocks": 2}):
        assert sorted(map(tuple, embedding_dedup(df, **kw).collect()), key=str) == brute(rows), kw


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup(df).collect() == []


def test_one_id_on_two_vectors(spark):
    a, b = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.1, 0.0]
    rows = [(1, a), (2, [x * 1.01 + 0.001 for x in a]), (1, b), (3, [x + 0.002 for x in b])]
    got = sorted(map(tuple, embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
