"""Queries that SQL can't check exactly: estimates within their bounds, recall against brute force."""

import numpy as np
from compare import duck

from trawl.plans import registry
from trawl.session import table

SF = "/root/testdata/sf0.001"


def test_approximate_counts_are_near(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.queries()["rel_approx_distinct"](spark, sf).first()["parts"]
    want = duck(sf).execute("SELECT count(DISTINCT l_partkey) FROM lineitem").fetchone()[0]
    assert abs(got - want) <= 0.05 * want


def test_ivf_recall(spark):
    rows = table(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in registry.queries()["vector_ivf"](spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q, found in got.items():
        order = ids[np.argsort(-(x @ x[ids == q][0]), kind="stable")]
        near = [i for i in order if i != q or q in found][: len(found)]
        hits += len(found & set(near))
        total += len(near)
    assert total and hits >= 0.9 * total
