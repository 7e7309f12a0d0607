from itertools import permutations

from trawl.plans import stores


def test_relations_of_long_documents_by_brute_force(spark, monkeypatch):
    long = "Zürich lies near Basel and " + "so " * 900 + "Geneva or Ähtäri with Basel beside Oslo. " + "so " * 40 + "Turin"
    texts = [(1, long, len(long)), (2, "Anna meets Otto", None), (3, None, None), (4, "Lima to Rome", 12)]
    monkeypatch.setattr(stores, "docs", lambda s, d: s.createDataFrame(texts, "doc_id long, text string, n_chars long"))
    want = set()
    for i, t, _ in texts:
        names = {w: len(t[: t.index(w)].encode()) for w in t.split() if w[0].isupper() and len(w.encode()) > 3} if t else {}
        want |= {(i, a, b) for a, b in permutations(names, 2) if (names[a], a) < (names[b], b) and names[b] - names[a] < 100}
    assert {tuple(r) for r in stores.kg_relations_whole(spark, "").collect()} == want
    assert any(r[0] == 1 for r in want) and any(r[0] == 2 for r in want)
