"""Hand-computed cases of operators whose rows SQL doesn't check."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators import anomaly as A
from trawl.operators import graph as G
from trawl.operators import quality as C
from trawl.operators import queries as Q
from trawl.operators import ranking as R
from trawl.operators import relational as L
from trawl.operators import vector as V
from trawl.operators import verticals as X
from trawl.sources import pages as P


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


def test_text_functions(spark):
    t = lambda f, s: one(spark, f(F.col("s")), s=s)
    assert t(T.mark_negations, "i do not like it. but ok") == "i do not NOT_like NOT_it. but ok"
    assert t(T.script, "漢字かな漢") == "Han" and t(T.script, "привет x") == "Cyrillic" and t(T.script, "12") == "Unknown"
    assert t(T.language, "the cat and the dog") == "en" and t(T.language, "zzz") == "unknown"
    assert t(T.without_diacritics, "Éàü") == "Eau"
    assert [(r["kind"], r["value"]) for r in t(T.typed_tokens, "me@x.org at 12:30 $5")] == [("email", "me@x.org"), ("currency", "$5"), ("time", "12:30"), ("mention", "@x")]
    assert t(lambda c: T.ngrams(T.words(c), 3), "a b") == [] and t(T.char_shingles, "abab") == ["aba", "bab"]
    assert one(spark, T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert [one(spark, T.syllables(F.lit(w))) for w in ("table", "e", "banana", "xyz")] == [1, 1, 3, 1]


def test_sql_engine(spark):
    e = L.QueryEngine(spark)
    a, b = e.execute_batch([("SELECT :x AS v", {"x": 3}), ("SELECT nonsense FROM nowhere", None)])
    assert a.first().v == 3 and isinstance(b, Exception)
    assert e.execute("SELECT :x  AS v", {"x": 3}) is a and e.execute("SELECT :x AS v", {"x": 4}).first().v == 4
    assert {(r.kind, r.n, r.failed) for r in e.statistics().collect()} == {("SELECT", 4, 1)}
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_totalprice > 5")
    assert any("GreaterThan(o_totalprice" in f for f in e.pushed_filters(df))


def test_cooldown(spark):
    rows = [(i, t, "r", "s") for i, t in enumerate((0, 100, 299, 300, 450, 601))]
    df = spark.createDataFrame(rows, "event_id long, t int, rule string, severity string").select("event_id", F.timestamp_seconds("t").alias("ts"), "rule", "severity")
    assert [r.event_id for r in A.cooled_alerts(df, ["rule"], 300).orderBy("event_id").collect()] == [0, 3, 5]
    assert A.cooled_alerts(df, ["rule"], 300, hourly=2).count() == 2


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")


def clique(ids):
    return [(a, b) for a in ids for b in ids if a < b]


def test_graph_properties(spark):
    two = edges(spark, [*clique(range(1, 6)), *clique(range(11, 16)), (5, 11)])
    lp = {r.id: r.label for r in G.label_propagation(two).collect()}
    assert len({lp[i] for i in range(1, 6)}) == 1 and len({lp[i] for i in range(11, 16)}) == 1
    moved = G.local_moves(two)
    q = G.modularity(two, moved).first()[0]
    alone = G.modularity(two, G.vertices(two).withColumn("label", F.col("id"))).first()[0]
    assert q > 0.3 > alone
    assert {r.size for r in G.communities(two, moved).collect()} == {5}
    h = G.hits(two, 5).collect()
    assert math.isclose(sum(r.hub**2 for r in h), 1, rel_tol=1e-9) and math.isclose(sum(r.authority**2 for r in h), 1, rel_tol=1e-9)
    ring = edges(spark, [(1, 2), (2, 3), (3, 1)])
    assert all(abs(r["rank"] - 1 / 3) < 1e-9 for r in G.pagerank(ring, rounds=10).collect())
    chain = {r.id: r.distance for r in G.shortest_paths(edges(spark, [(1, 2), (2, 3), (3, 4), (9, 1)]), 1).collect()}
    assert chain == {1: 0, 2: 1, 3: 2, 4: 3}
    assert G.pagerank(edges(spark, []), rounds=2).count() == 0


def test_pages(spark):
    base = F.lit("https://a.org/x/y.html?q=1")
    got = {h: one(spark, P.resolved(F.lit(h), base)) for h in ("z.html", "/z", "//b.org/c", "http://c.org/d#e", "#top", "mailto:me@x", "", "../u")}
    assert got["z.html"] == "https://a.org/x/z.html" and got["/z"] == "https://a.org/z" and got["//b.org/c"] == "https://b.org/c" and got["http://c.org/d#e"] == "http://c.org/d"
    assert got["#top"] is None and got["mailto:me@x"] is None and got[""] is None
    html = '<meta property="og:title" content="T"><meta property="og:type" content="a"><script type="application/ld+json">{"a":1}</script><p>x <b>y</b></p>'
    assert one(spark, P.open_graph(F.lit(html))) == {"title": "T", "type": "a"} and one(spark, P.json_ld(F.lit(html))) == '{"a":1}' and one(spark, P.tag_free(F.lit(html))) == "x y"
    assert one(spark, P.link_quality(F.lit("some text"), F.lit("javascript:x"))) == pytest.approx(0.5)
    assert one(spark, P.link_confidence(F.lit("click here now"))) == pytest.approx(0.84)
    assert [one(spark, P.document_type(F.lit(t))) for t in ('{"a":1}', "<rss>", "<feed>", "<urlset>", "<a/>", "x")] == ["json", "rss", "atom", "sitemap", "xml", "unknown"]


def test_query_understanding(spark):
    q = spark.createDataFrame([(1, "what is that?"), (2, "buy a lamp"), (3, "cats")], "query_id int, query string")
    assert [r[0] for r in q.select(Q.intent(F.col("query"))).collect()] == ["question", "commercial", "informational"]
    words = spark.createDataFrame([("lerning",), ("xyzzyx",), ("machine",)], "word string")
    d = spark.createDataFrame([("learning",), ("machine",), ("leaning",)], "word string")
    assert {r.word: (r.correction, r.edits) for r in Q.spelling(words, d).collect()} == {"lerning": ("leaning", 1), "machine": ("machine", 0)}


def test_spelling_finds_all_within_two_edits(spark):
    rng = random.Random(1)
    vocab = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(60)})
    asked = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(40)})

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    want = {}
    for a in asked:
        best = min((lev(a, b), b) for b in vocab)
        if best[0] <= 2:
            want[a] = (best[1], best[0])
    got = Q.spelling(spark.createDataFrame([(a,) for a in asked], "word string"), spark.createDataFrame([(b,) for b in vocab], "word string"))
    assert {r.word: (r.correction, r.edits) for r in got.collect()} == want


def test_ranking(spark):
    assert one(spark, R.phrase_match(F.lit("big cat food"), F.lit("my big cat eats"))) == 0.5
    assert one(spark, R.combined({"a": F.lit(1.0), "b": F.lit(None).cast("double")}, {"a": 0.3, "b": 0.7})) == 1.0
    assert one(spark, R.ensemble_confidence([F.lit(1.0), F.lit(1.0)])) == 1.0
    s = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7)], "doc_id long, score double")
    near = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert [r.doc_id for r in R.greedy_representatives(s, near).collect()] == [1]


def test_blacklist(spark):
    v = spark.createDataFrame([("https://bad.org/x",), ("http://ok.org/free money",), ("10.0.0.1",), ("me@spam.io",), ("fine",)], "value string")
    e = spark.createDataFrame(
        [("domain", "bad.org", True), ("keyword", "free money", True), ("ip", "10.0.0.1", True), ("email", "me@spam.io", True), ("regex", "^f.*e$", False), ("keyword", "bad", True)], "type string, entry string, is_active boolean"
    )
    assert {r.value: r.kind for r in C.blacklisted(v, e).collect()} == {"https://bad.org/x": "domain", "http://ok.org/free money": "keyword", "10.0.0.1": "ip", "me@spam.io": "email"}


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nSitemap: https://a.org/s.xml\n\nUser-agent: bot\nCrawl-delay: 2\nDisallow: /"
    rules = X.robots_rules(spark.createDataFrame([("a.org", text), ("b.org", None)], "domain string, robots_txt string")).cache()
    urls = spark.createDataFrame([(f"https://a.org{p}", "a.org") for p in ("/", "/private/x", "/private/open/y", "/a.pdf", "/a.pdfx")] + [("https://b.org/z", "b.org")], "url string, domain string")
    got = {r.url.split("org")[1]: r.allowed for r in X.robots_allowed(urls, rules).collect()}
    assert got == {"/": True, "/private/x": False, "/private/open/y": True, "/a.pdf": False, "/a.pdfx": True, "/z": True}
    assert not any(r.allowed for r in X.robots_allowed(urls.where("domain = 'a.org'"), rules, "bot").collect())
    strict = {r.url.split("org")[1]: r.allowed for r in X.robots_allowed(urls, rules, strict=True).collect()}
    assert strict["/"] is False and strict["/z"] is True and strict["/private/open/y"] is False
    assert one(spark, X.sitemaps(F.lit(text))) == ["https://a.org/s.xml"]
    assert {r.delay for r in rules.where("delay IS NOT NULL").collect()} == {2.0}


def test_limits_and_latest(spark):
    req = spark.createDataFrame([("k", t, i) for i, t in enumerate((0, 1, 2, 9, 10, 11, 12))], "key string, t int, request_id long").select("key", F.timestamp_seconds("t").alias("ts"), "request_id")
    got = {r.request_id: r.allowed for r in X.fixed_window_limit(req, 2, 10).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False}
    ch = spark.createDataFrame([("a", "1", 0, None, 1, False), ("a", "2", 5, None, 2, False), ("b", "x", 0, 3, 1, False), ("c", "y", 0, None, 1, True)], "key string, value string, t int, ttl int, version int, deleted boolean")
    ch = ch.withColumn("ts", F.timestamp_seconds("t"))
    assert [(r.key, r.value) for r in X.latest(ch, F.timestamp_seconds(F.lit(10))).collect()] == [("a", "2")]


def test_images_and_news(spark):
    im = spark.createDataFrame([(1, [[250, 5, 5]], 640), (2, [[0, 0, 250]], 200)], "image_id int, colours array<array<int>>, width int")
    assert [r.image_id for r in X.image_filters(im, {"colour": "red", "min_width": 300}).collect()] == [1]
    dates = [one(spark, X.parsed_date(F.lit(d))) for d in ("2024-01-31", "01/31/2024", "January 31, 2024", "nonsense")]
    assert dates[0] == dates[1] == dates[2] and dates[3] is None
    assert one(spark, X.quotes(F.lit('He said "this is quite long" and "no"'))) == ["this is quite long"]


def test_crawl(spark):
    jobs = spark.createDataFrame([(1, "u1", "d1", 5, 0), (2, "u1", "d1", 9, 0), (3, "u2", "d1", 7, 0), (4, "u3", "d2", 1, 0)], "job_id int, url string, domain string, priority int, scheduled int")
    f = X.frontier(jobs, spark.createDataFrame([("u3",)], "url string"))
    assert {r.job_id: r["rank"] for r in f.collect()} == {2: 1, 3: 2}
    d = spark.createDataFrame([("d1", 0)], "domain string, t int").select("domain", F.timestamp_seconds("t").alias("last"))
    assert [r.job_id for r in X.next_jobs(f, d, F.timestamp_seconds(F.lit(5))).collect()] == [2]
    assert one(spark, X.backoff(F.lit(3))) == 8.0


def test_vector_metrics_and_recall(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    got = {m: one(spark, V.distance(a, b, m)) for m in ("cosine", "euclidean", "manhattan", "dot", "hamming", "jaccard")}
    assert got == {"cosine": 1.0, "euclidean": pytest.approx(math.sqrt(5)), "manhattan": 3.0, "dot": 0.0, "hamming": 2.0, "jaccard": pytest.approx(2 / 3)}
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = v.where("vec_id % 100 = 0")
    exact = {(r.query_id, r.vec_id) for r in V.knn(q, v, 10).collect()}
    model, indexed = V.ivf_index(v)
    near = {(r.query_id, r.vec_id) for r in V.ivf_search(model, indexed, q, 10, probes=12).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    h = one(spark, V.hashed_embedding(F.array(F.lit("a"), F.lit("b"))))
    assert len(h) == 64 and math.isclose(sum(x * x for x in h), 1.0)


def test_fuzzy_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    keys = {"".join(rng.choice("ab") for _ in range(n)) for n in (1, 9, 10, 11, 19, 20, 21, 22) for _ in range(12)}
    for n in (10, 19, 22, 27, 29, 30, 33, 41):
        base = [rng.choice("abcdé") for _ in range(n)]
        for _ in range(12):
            k = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(k))
                k[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é", "aa"])
            keys.add("".join(k))
    keys = sorted(keys)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
        return row[-1]

    want = {}
    for a in range(len(keys)):
        for b in range(a + 1, len(keys)):
            r = 1 - distance(keys[a], keys[b]) / max(len(keys[a]), len(keys[b]))
            if r >= 0.9 - 1e-9:
                want[a, b] = round(r, 9)
    got = R.fuzzy_pairs(spark.createDataFrame(list(enumerate(keys)), "id int, name string"), "name").collect()
    assert len(got) == len(want) > 50 and {(r.a, r.b): round(r.ratio, 9) for r in got} == want


def test_fuzzy_pairs_do_not_meet_on_what_all_keys_share(spark):
    n = 12_000  # pairs that share a piece would be over n * n
    keys = spark.range(n).select("id", F.concat(F.lit("omer#000"), F.lpad((F.col("id") * 7919 % 10**6).cast("string"), 6, "0"), F.lit("FURNITURE")).alias("name"))
    began = time.monotonic()
    assert R.fuzzy_pairs(keys, "name").count() > n
    assert time.monotonic() - began < 45
