import random
import re

import pytest

from trawl.llm.ngram_join import ngram_join
from trawl.session import table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """docs: (id, text) pairs with distinct ids -> {id: (size, component, links)}"""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}
    links = {i: 0 for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                links[i] += 1
                links[j] += 1
                a_, b_ = sorted((root(i), root(j)))
                parent[b_] = a_
    return {i: (len(x), root(i), links[i]) for i, x in sets}


def near_copies(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ÀB", "Mixed", "mixed"]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 6, 40, 90]))] for _ in range(8)]
    line = [rng.choice(vocab) for _ in range(30)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            k = rng.randrange(len(w))
            w[k : k + rng.choice([0, 1])] = [rng.choice(vocab)]
        if rng.random() < 0.3:
            w += line
        out.append((i * 3 + 1, rng.choice([" ", "\n", "\t "]).join(w)))
    return out + [(5000, None), (5001, ""), (5002, " \n"), (5003, out[0][1]), (5004, out[0][1].upper() if out[0][1].isascii() else out[0][1])]


@pytest.mark.parametrize("tile_tokens", [400_000, 200])
def test_join_by_brute_force(spark, tile_tokens, monkeypatch):
    monkeypatch.setattr("trawl.llm.ngram_join.HOT", 10)
    docs = near_copies(4, 220)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "'x' AS n", "1 AS component_id")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join(df, tile_tokens=tile_tokens).collect()}
    assert got == brute(docs)


def test_join_null_ids_and_empty(spark):
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join(df).collect()), key=str)
    assert got == sorted([(None, 1, None, 0), (1, 1, 1, 1), (1, 1, 1, 1)], key=str)


def test_join_documents(spark):
    from trawl.llm.q_ngram_join import query

    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = brute(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in query(spark, sf).collect()}
    assert got == want
    assert sum(v[2] for v in want.values()) > 50


def test_join_of_other_ids_and_of_one_id_on_two_texts(spark):
    docs = [(f"d{i:04}", t) for i, t in near_copies(9, 60)]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join(df, cell_bits=15, tile_tokens=300).collect()}
    assert got == brute(docs)
    # id 1 stands on two texts, each with a near copy: neither link is lost
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, one), (2, one + " more"), (1, two), (3, two + " more")]
    got = sorted(map(tuple, ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 56, 1, 1), (1, 56, 1, 1), (2, 57, 1, 1), (3, 57, 1, 1)]


def test_join_of_very_long_texts(spark):
    rng = random.Random(2)
    long = [f"w{rng.randrange(5000)}" for _ in range(250_000)]
    other = long[:]
    for k in range(0, 250_000, 400):
        other[k] = "changed"
    far = long[:]
    for k in range(0, 250_000, 10):
        far[k] = "changed"
    docs = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(far)), (4, "short")]
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
