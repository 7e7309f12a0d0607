import zlib

import numpy as np
import pytest

from trawl.llm import quality, toxicity
from trawl.llm.common import Powers
from trawl.session import table

SF = "/root/testdata/sf0.01"


def as_bytes(texts):
    blobs = [t.encode() for t in texts]
    return np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([0] + [len(b) for b in blobs])


def test_features_by_hand():
    data, off = as_bytes(["", "The cat! The cat | x\nyes\nyes", "é 12"])
    x = quality.features_of(data, off, Powers())
    f = dict(zip(quality.FEATURES, x[1]))
    assert not x[0].any()
    assert f["distinct_words"] == pytest.approx(6 / 8) and f["commonest_word"] == pytest.approx(2 / 8)
    assert f["same_as_last"] == pytest.approx(1 / 8) and f["bangs"] == pytest.approx(1 / 8) and f["bars"] == pytest.approx(1 / 8)
    assert f["lines"] == pytest.approx(3 / 8) and f["repeated_lines"] == pytest.approx(1 / 3)
    assert x[2][quality.FEATURES.index("digits")] == pytest.approx(2 / 5)


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.9


def scan_by_hand(p, q, r, s):
    x, out = 1.0, []
    for a, b, c, d in zip(p, q, r, s):
        x = (a + b * x) / (c + d * x)
        out.append(x)
    return np.array(out)


@pytest.mark.parametrize("n", [1, 31, 5000])
def test_scan(n):
    rng = np.random.default_rng(n)
    v = [rng.random(n) + 0.1 for _ in range(4)]
    np.testing.assert_allclose(toxicity.scan(*v), scan_by_hand(*v), rtol=1e-9)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    n = 6
    slot = (np.arange(2)[:, None] << toxicity.BITS) + rng.integers(0, 50, (2, n))
    fresh = np.array([True, False, False, True, False, False])
    f = toxicity.Field(rng.normal(size=2 << toxicity.BITS), rng.normal(size=(2, 2)), 0.3)
    e = f.weights[slot].sum(0)
    weight = np.zeros(n)
    total = 0.0
    for code in range(1 << n):
        z = [code >> i & 1 for i in range(n)]
        s = sum(e[i] for i in range(n) if z[i])
        s += sum(f.start if z[i] else 0 for i in range(n) if fresh[i])
        s += sum(f.move[z[i - 1], z[i]] for i in range(1, n) if not fresh[i])
        total += np.exp(s)
        weight += np.exp(s) * np.array(z)
    np.testing.assert_allclose(f.marginals(slot, fresh), weight / total, rtol=1e-9)


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_held_out_accuracy(spark, label):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    found = quality.quality_scores(docs, labels) if label == "quality" else toxicity.toxicity(docs, labels)
    known = {r.doc_id: r[label] for r in labels.collect()}
    rows = found.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in test) >= 0.93 * len(test)


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "x y", "b"), (2, "", "c"), (2, "idiot " * 30000, "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for f in (quality.quality_scores, toxicity.toxicity):
        assert len(f(docs, labels).collect()) == 4
        assert len(f(docs, labels.limit(0)).collect()) == 4
        assert f(docs.limit(0), labels).collect() == []


def test_spans_are_offsets(spark):
    docs = [(i, f"you are a clown number {'very ' * (i % 3)}nice{i}" if i % 2 else f"you are a good person nice{i}", None) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(400)], "doc_id long, toxic int")
    for r in toxicity.toxicity(df, labels).collect():
        text = docs[r.doc_id][1]
        got = [text.encode()[s["start"] : s["end"]].decode() for s in r.spans]
        assert r.predicted == r.doc_id % 2
        assert ("clown" in got) == bool(r.doc_id % 2)
