import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from trawl.llm.bwt import repeated_starts, suffix_array
from trawl.llm.suffix_dedup import suffix_dedup
from trawl.session import table


def brute_suffix(texts, least):
    seen = Counter()
    for t in texts:
        b = (t or "").encode()
        seen.update(b[i : i + least] for i in range(len(b) - least + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_sorts():
    rng = random.Random(3)
    s = [rng.randint(1, 3) for _ in range(400)]
    for i in range(40, 400, 57):
        s[i] = 0
    s[-1] = 0
    x = np.array(s, np.int16)
    sa, _ = suffix_array(x)
    # up to their separators, suffixes ascend; suffixes equal so far may stand in any order
    key = lambda i: s[i : i + s[i:].index(0)] + [0]
    assert sorted(sa) == list(range(len(s)))
    assert [key(i) for i in sa] == sorted(key(i) for i in range(len(s)))


@pytest.mark.parametrize("seed", range(6))
def test_repeated_starts_by_brute_force(seed):
    rng = random.Random(seed)
    base = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(12)]
    texts = [b"".join(rng.choices(base, k=3)) for _ in range(10)]
    least = rng.choice([3, 9, 25])
    seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    want = [seen[t[i : i + least]] > 1 and i + least <= len(t) for t in texts for i in range(len(t))]
    off = np.cumsum([0] + [len(t) for t in texts])
    assert repeated_starts(np.frombuffer(b"".join(texts), np.uint8), off, least).tolist() == want


def rows_of(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")
    got = {r.doc_id: r for r in suffix_dedup(df, **kw).collect()}
    return [(r.n_bytes, r.n_removed, len(r.removed_spans), hashlib.sha256(bytes(r.kept_bytes)).hexdigest()) for _, r in sorted(got.items())], got


@pytest.mark.parametrize("cell_bytes", [500_000, 1000, 1])
def test_suffix_dedup_small(spark, cell_bytes):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdéfg") for _ in range(rng.randint(1, 7)))
    passage = [" ".join(word() for _ in range(40)) for _ in range(5)]
    texts = [None, "", "short", "ab" * 90]
    texts += [" ".join([word(), rng.choice(passage)[rng.randint(0, 9) :], word(), rng.choice(passage), word()]) for _ in range(40)]
    texts += [texts[7]] * 3 + ["é" * 70, "x" + "é" * 70]
    got, rows = rows_of(spark, texts, least=60, cell_bytes=cell_bytes, width_bits=16)
    assert got == brute_suffix(texts, 60)
    for i, t in enumerate(texts):  # spans of whole characters: what is left is text
        assert rows[i].kept_text is not None and len(rows[i].kept_text.encode()) >= len(rows[i].kept_bytes)


def test_suffix_dedup_empty(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_dedup_documents(spark):
    from trawl.llm.q_suffix_dedup import query

    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect())
    want = brute_suffix([t for _, t in docs], 400)
    got = sorted(query(spark, sf).collect())
    assert [tuple(r)[1:] for r in got] == want
    assert sum(w[1] for w in want) > 0


def test_one_anchor_of_thousands_of_kinds(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    common = word(75)  # under the minimum of 80, so its anchors meet thousands of different windows
    tails = [word(rng.randint(4, 40)) for _ in range(2500)]
    texts = [word(rng.randint(0, 30)) + common + (rng.choice(tails) if i % 50 == 0 else tails[i % 2500]) for i in range(3000)]
    got, _ = rows_of(spark, texts, least=80, cell_bytes=20_000, width_bits=16)
    assert got == brute_suffix(texts, 80)
    assert sum(r[1] > 0 for r in got) > 300


def test_one_text_beyond_a_million_bytes(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage, again = word(150), "xy" * 50
    long = word(5000) + passage + word((1 << 20) - 5000 - 150 - 70) + again + passage + again + word(60_000) + passage
    texts = [long, "short " + passage[20:120] + " end", again, None]
    got, _ = rows_of(spark, texts, least=60, width_bits=20)
    assert got == brute_suffix(texts, 60)
    assert got[0][0] > 1 << 20 and got[0][1] > 3 * 150
