import random
import re

import numpy as np
import pyarrow as pa
import pytest

from trawl.llm import sketch
from trawl.llm.common import Powers, connected, pieces, word_hashes, words_of
from trawl.llm.substring_dedup import substring_dedup
from trawl.llm.winnow import segments

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """rows: (id, text) -> (n_words, n_removed, kept) in order of rows."""
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), " ".join(kept)))
    return out


def texts(seed, window):
    rng = random.Random(seed)
    vocab = ["a", "b", "é", "c.", "ß"]
    phrase = [[rng.choice(vocab) for _ in range(rng.randint(window - 2, 3 * window))] for _ in range(6)]
    out = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [f"x{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, window))] + rng.choice(phrase)
        out.append((rng.randint(0, 80), rng.choice([" ", "\n", "\t \r\n"]).join(w)))
    return out + [(5, None), (6, ""), (7, " \x0b"), (None, out[3][1]), (None, None), (200, " ".join(["a"] * 5 * window)), (201, " ".join(["a"] * window))]


@pytest.mark.parametrize("seed,window", [(1, 6), (2, 11), (3, 50)])
def test_by_brute_force(spark, seed, window):
    rows = texts(seed, window)
    ids = {}
    rows = [(i if ids.setdefault(i, t) == t else 1000 + k, t) for k, (i, t) in enumerate(rows)]  # one text an id
    rows += rows[:5]  # repeated rows
    df = spark.createDataFrame([(k, i, t, "x") for k, (i, t) in enumerate(rows)], "k long, doc_id long, text string, n_words string").repartition(3)
    got = substring_dedup(df, window, width_bits=16).orderBy("k").collect()
    assert [(r.n_words, r.n_removed, r.kept_text) for r in got] == brute(rows, window)


def test_a_saturated_sketch_loses_nothing(spark):
    rows = [(k, t) for k, (_, t) in enumerate(texts(4, 6))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup(df, 6, width_bits=4).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_text) for r in got] == brute(rows, 6)


def test_empty(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_and_segments():
    rng = random.Random(0)
    batch = pa.RecordBatch.from_pydict({"text": ["", " a  bc\n", None, "d", " x y", "".join(rng.choice("ab ") for _ in range(999))]})
    for rows, data, off in pieces(iter([batch]), most=20):
        starts, ends, first = words_of(data, off)
        for i, t in enumerate(rows.column(0).to_pylist()):
            got = [bytes(data[a:b]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
            assert got == WORD.findall(t or "")
        s = segments(word_hashes(data, starts, ends, Powers()), first, 5, 2, Powers())
        assert s["count"].sum() == np.maximum(np.diff(first) - 4, 0).sum()


def test_sketch_never_underestimates(spark):
    df = spark.range(5000).selectExpr("id % 3000 AS x").repartition(4)

    def items(batches):
        for b in batches:
            yield b.column(0).to_numpy().astype(np.uint64)

    twice = np.arange(2000, dtype=np.uint64)
    bits = sketch.repeated(df, items, 18)
    assert sketch.may_repeat(bits, twice).all()
    assert sketch.may_repeat(bits, np.arange(2000, 3000, dtype=np.uint64)).mean() < 0.05
    assert sketch.may_repeat(sketch.repeated(df, items, 18, least=1), np.arange(3000, dtype=np.uint64)).all()


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 900), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.id: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
