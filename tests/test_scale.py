"""Operators that narrow, collapse or iterate instead of gathering, against brute force."""

import collections

import numpy as np
import pytest
from compare import SF, duck
from pyspark.sql import functions as F

from trawl.operators import anomaly as A
from trawl.operators import graph as G
from trawl.operators import kg as K
from trawl.operators import ranking as R
from trawl.plans import registry
from trawl.plans.web import PAGE_EDGES
from trawl.sources import pages as P

SHARES = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]


@pytest.mark.parametrize("whole", [0, 10**6])
def test_quantiles_equal_numpy(spark, whole):
    rng = np.random.default_rng(3)
    values = {"a": [*rng.normal(size=300), *[2.5] * 200, None, float("nan"), float("inf")], None: [1e308, -1e308, 5e-324, 0.0, -7.0], "one": [4.0], "same": [1.0] * 9, "none": [None]}
    rows = spark.createDataFrame([(k, None if v is None else float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    got = {r.k: r.quantiles for r in A.quantiles(rows, "v", SHARES, ["k"], whole=whole, bins=8).collect()}
    assert set(got) == {"a", None, "one", "same"}
    for k, q in got.items():
        x = sorted(v for v in values[k] if v is not None and np.isfinite(v))
        at = [s * (len(x) - 1) for s in SHARES]
        want = [x[int(p)] if p == int(p) else x[int(p)] + (p - int(p)) * (x[int(p) + 1] - x[int(p)]) for p in at]
        assert np.allclose(q, want, rtol=1e-9, atol=0), (k, q, want)


@pytest.mark.parametrize("whole", [0, 10**6])
def test_quantiles_of_all_rows_and_of_none(spark, whole):
    rows = spark.range(1001).select((F.col("id") * 0.5).alias("v"))
    assert A.quantiles(rows, "v", [0.5, 0.999], whole=whole, bins=16).first().quantiles == pytest.approx([250.0, 499.5])
    log = A.query_log(spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double"))
    assert A.profile(log).first().n == 0 and A.iqr_outliers(log).count() == 0


def page_edges():
    return duck(SF).execute(f"WITH {PAGE_EDGES} SELECT src, dst FROM e").fetchall()


def test_pagerank_of_pages_settles(spark):
    e = page_edges()
    ids = sorted({x for p in e for x in p})
    at = {x: i for i, x in enumerate(ids)}
    out = collections.Counter(a for a, _ in e)
    r = np.full(len(ids), 1 / len(ids))
    for _ in range(200):
        new = np.full(len(ids), 0.15 / len(ids))
        for a, b in e:
            new[at[b]] += 0.85 * r[at[a]] / out[a]
        r = new
    got = {x["id"]: x["rank"] for x in registry.queries()["graph_pages_pagerank"](spark, SF).collect()}
    assert set(got) == set(ids) and sum(abs(got[x] - r[at[x]]) for x in ids) < 1e-5


def test_hits_of_pages_equal_a_loop(spark):
    e = page_edges()
    hub = auth = dict.fromkeys({x for p in e for x in p}, 1.0)
    scaled = lambda c: {x: c[x] / sum(v * v for v in c.values()) ** 0.5 for x in hub}  # noqa: B023, E731
    for _ in range(20):
        old, was = hub, auth
        a, h = collections.Counter(), collections.Counter()
        for x, y in e:
            a[y] += hub[x]
        auth = scaled(a)
        for x, y in e:
            h[x] += auth[y]
        hub = scaled(h)
        if sum(abs(hub[x] - old[x]) + abs(auth[x] - was[x]) for x in hub) <= 1e-6:
            break
    got = {r.id: (r.hub, r.authority) for r in registry.queries()["graph_pages_hits"](spark, SF).collect()}
    assert set(got) == set(hub) and all(abs(got[x][0] - hub[x]) + abs(got[x][1] - auth[x]) < 1e-9 for x in hub)


def test_labels_of_pages_equal_a_loop(spark):
    e = page_edges()
    near = collections.defaultdict(set)
    for a, b in e:
        near[a].add(b)
        near[b].add(a)
    label = {x: x for x in near}
    for _ in range(20):
        n = {x: collections.Counter(label[y] for y in near[x]) for x in near}
        new = {x: min(c, key=lambda k: (-c[k], k)) for x, c in n.items()}
        if new == label:
            break
        label = new
    assert {r.id: r.label for r in registry.queries()["graph_pages_labels"](spark, SF).collect()} == label


def test_annealing_parts_cliques(spark):
    clique = lambda ids: [(a, b, 1.0) for a in ids for b in ids if a < b]
    two = spark.createDataFrame([*clique(range(1, 6)), *clique(range(11, 16)), (5, 11, 1.0)], "src long, dst long, weight double")
    got = G.annealed(two)
    assert got.count() == 10 and G.modularity(two, got).first()[0] > 0.3
    assert G.annealed(two.limit(0)).count() == 0


def test_tfidf_pairs_are_between_classes(spark):
    texts = {1: "red green blue", 2: "Blue, red green!", 3: "red green blue sky", 4: "something else", 5: "", 6: "something else"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    member = {r.doc_id: r.class_id for r in R.copies(docs).collect()}
    assert member == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 4}
    pairs = R.tfidf_cosine(docs, 0.5)
    words = {i: collections.Counter("".join(c for c in t if c.isalnum() or c == " ").lower().split()) for i, t in texts.items()}
    df = collections.Counter(w for c in words.values() for w in c)
    vec = {i: {w: n * (np.log(7 / (1 + df[w])) + 1) for w, n in c.items()} for i, c in words.items()}
    dot = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items())
    got = {(r.a, r.b): r.cosine for r in pairs.collect()}
    assert got == {(1, 3): pytest.approx(dot(vec[1], vec[3]) / (dot(vec[1], vec[1]) * dot(vec[3], vec[3])) ** 0.5)}
    scored = spark.createDataFrame([(1, 0.1), (2, 0.9), (3, 0.5), (4, 0.2), (5, 0.0), (6, 0.2)], "doc_id long, score double")
    assert sorted(r.doc_id for r in R.greedy_representatives(scored, pairs, R.copies(docs)).collect()) == [2, 4, 5]


def test_linking_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh "), rng.integers(0, 9)))
    known = [(i, word(), "xy"[i % 2]) for i in range(60)]
    names = {(word(), "xy"[i % 2]) for i in range(200)} | {("", "x"), ("ABC", "z")}
    sets = lambda s: set(s.lower())
    want = {}
    for n, t in names:
        exact = [i for i, k, u in known if u == t and k.lower() == n.lower()]
        like = [(-len(sets(n) & sets(k)) / len(sets(n) | sets(k)), i) for i, k, u in known if u == t and sets(n) | sets(k)]
        if exact:
            want[n, t] = (min(exact), "exact")
        elif like and -min(like)[0] > 0.8:
            want[n, t] = (min(like)[1], "fuzzy")
    got = K.linked(spark.createDataFrame(sorted(names), "name string, type string"), spark.createDataFrame(known, "entity_id long, name string, type string"))
    assert {(r.name, r.type): (r.entity_id, r.how) for r in got.collect()} == want


def test_page_contents_of_odd_markup(spark):
    html = """<TABLE class=a><tr><td>1<td>2</td></tr></TABLE><thead></thead><table></table><form><textarea name='t'></textarea><input type="EMAIL"></form><img src='a' width="12px" height="7"><meta name="x"><script>1</script>"""
    r = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(P.tables(F.col("h")).alias("t"), P.forms(F.col("h")).alias("f"), P.images(F.col("h")).alias("i"), P.scripts(F.col("h")).alias("s"), P.metadata(F.col("h")).alias("m")).collect()
    assert r[0].t == [[["1 2"]], []]
    assert [(f.action, f.method, [tuple(x) for x in f.fields]) for f in r[0].f] == [("", "get", [("t", "textarea"), ("", "email")])]
    assert [tuple(x) for x in r[0].i] == [("a", "", "", None, 7)] and r[0].s == [""] and r[0].m == []
    assert r[1].t is None and r[2].t == [] and r[2].f == []
