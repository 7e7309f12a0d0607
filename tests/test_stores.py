from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators import kg as K
from trawl.operators import ml as M
from trawl.operators import store as S
from trawl.session import table
from trawl.sources import formats as X

SF = "/root/testdata/sf0.01"


def test_store_versions(spark):
    empty = spark.createDataFrame([], "doc_id long, content string, status string, version int, checksum string")
    one = S.stored(empty, spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, content string"))
    two = S.stored(one, spark.createDataFrame([(1, "c")], "doc_id long, content string"))
    three = S.deleted(two, spark.createDataFrame([(2,)], "doc_id long"))
    assert {(r.doc_id, r.content, r.version) for r in S.current(three).collect()} == {(1, "c", 2)}
    assert [r.content for r in S.history(three, 1).collect()] == ["a", "c"]
    assert S.verified(three).count() == 0 and S.verified(three.withColumn("content", F.lit("x"))).count() == 4


def test_files(spark):
    p = spark.createDataFrame([("a/b.txt",), ("a/b.tmp",), ("c.txt",)], "path string")
    assert [r.path for r in p.where(S.glob(F.col("path"), ["*.txt"], ["c*"])).collect()] == ["a/b.txt"]
    f = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, checksum string")
    m = spark.createDataFrame([("x", "1"), ("y", "9")], "path string, checksum string")
    assert [r.path for r in S.incremental(f, m).collect()] == ["y"]
    b = spark.createDataFrame([("s", i, i) for i in range(5)], "name string, created int, backup_id int")
    assert sorted(r.backup_id for r in S.kept_backups(b, 2).collect()) == [3, 4]


def test_knowledge_graph(spark):
    known = spark.createDataFrame([(1, "Berlin", "place"), (2, "Marie Curie", "person")], "entity_id int, name string, type string").withColumn("confidence", F.lit(0.9))
    m = spark.createDataFrame([("berlin", "place"), ("Marie Curiee", "person"), ("Oslo", "place"), ("Berlin", "person")], "name string, type string")
    assert {(r.name, r.entity_id, r.how) for r in K.linked(m, known).collect()} == {("berlin", 1, "exact"), ("Marie Curiee", 2, "fuzzy")}
    facts = spark.createDataFrame([("a", "is", "b"), ("b", "is", "c"), ("c", "is", "a"), ("x", "has", "y")], "subject string, predicate string, object string")
    assert K.inferred(facts, "is").count() == 9
    assert [r.name for r in K.search(known, "curie").collect()] == ["Marie Curie"]


def test_chains_of_any_length(spark):
    n = 14  # links, more than ten rounds reach
    e = spark.range(n + 1).select(F.concat(F.lit("p:"), F.col("id").cast("string")).alias("key"), "id")
    d = e.where("id > 0").select("key", F.concat(F.lit("p:"), (F.col("id") - 1).cast("string")).alias("on"))
    d = d.union(spark.createDataFrame([("p:3", "p:9")], "key string, on string"))  # a circle
    assert {r.key for r in S.invalidated(e.select("key"), d, ["p:1"]).collect()} == {f"p:{i}" for i in range(1, n + 1)}
    chain = spark.range(n).select(F.col("id").alias("subject"), (F.col("id") + 1).alias("object"), F.lit("is").alias("predicate"))
    assert K.inferred(chain, "is").count() == n * (n + 1) // 2


def test_formats(spark, tmp_path):
    rss = "<rss><channel><item><title>A</title><link>u</link></item></channel></rss>"
    atom = '<feed><entry><title>B</title><link href="v"/></entry></feed>'
    d = spark.createDataFrame([(1, rss), (2, atom)], "doc_id int, text string")
    assert {(r.doc_id, r.title, r.link) for r in X.feed_items(d).collect()} == {(1, "A", "u"), (2, "B", "v")}
    x = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert x(X.site_urls(F.lit("<urlset><url><loc>p</loc></url></urlset>"))) == ["p"]
    assert x(X.flat_text(F.lit('{"a":"one","b":["two",3,"three"]}'))) == "one two three" and x(X.flat_text(F.lit("<a>x<b> y</b></a>"))) == "x y"
    assert x(X.valid_json(F.lit("{"))) is False and x(X.valid_json(F.lit("[1]"))) is True
    n = table(spark, SF, "nation")
    for fmt in ("parquet", "orc", "json", "csv"):
        X.export(n, str(tmp_path / fmt), fmt)
        back = X.imported(spark, str(tmp_path / fmt), "n_nationkey int, n_name string, n_regionkey int", fmt)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, n.select("n_nationkey", "n_name", "n_regionkey").collect()))
    X.archive(n, str(tmp_path / "cold"), "n_nationkey")
    assert X.retrieved(spark, str(tmp_path / "cold"), "n_nationkey").where("intact").count() == n.count()


def test_models(spark):
    d, l = table(spark, SF, "documents"), table(spark, SF, "labels").withColumn("bad", 1 - F.col("quality"))
    got = M.voted(d, M.spam_models(d, l, "bad")).join(l, "doc_id")
    assert got.where("CAST(spam AS INT) = bad").count() >= 0.9 * l.count()
    rows = spark.createDataFrame([(i, (i * 37 % 100) / 100.0) for i in range(500)] + [(1000, 9.0)], "event_id long, value double")
    top = M.isolation_scores(rows, ["value"]).orderBy(F.desc("isolation")).first()
    assert top.event_id == 1000
    r = spark.createDataFrame([("q", 1, 1.0), ("q", 2, 3.0)], "query_id string, rank int, gain double")
    assert 0.5 < M.ndcg(r).first().ndcg < 0.8


def test_words(spark):
    x = lambda c: spark.range(1).select(c.alias("c")).first().c
    words = F.array(*[F.lit(w) for w in ("ponies", "caresses", "cats", "glass", "played", "relational")])
    assert x(M.stemmed(words)) == ["poni", "caress", "cat", "glass", "play", "relate"]
    lex = {"good": 1.0, "bad": -1.0}
    assert x(M.sentiment(T.words(F.lit("good good")), lex)) == 1.0
    assert x(M.sentiment(F.split(T.mark_negations(F.lit("not good")), " "), lex)) == -1.0
    assert x(M.sentiment_label(F.lit(-0.7))) == "very_negative"
