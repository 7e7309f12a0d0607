import pytest
from pyspark.sql import functions as F

from trawl.functions import scoring as S
from trawl.sources import pages as P


def x(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_words_and_translation(spark):
    assert x(spark, S.social_clean(F.lit("Hi @bob 😍 see https://x.y #tag"))) == "hi POSITIVE_EMOJI see"
    assert [(t.token, t.kind) for t in x(spark, S.token_kinds(F.lit("Ab, 12é")))] == [("Ab", "word"), (",", "mark"), ("12", "number"), ("é", "word")]
    assert x(spark, S.translated(F.lit("hello"), {"hello": "bonjour"}, {}, "fr")) == "bonjour"
    assert x(spark, S.translated(F.lit("big Cat"), {"hello": "bonjour"}, {"cat": "chat"}, "fr")) == "[fr] big chat"
    assert x(spark, S.translation_confidence(F.lit("abcd"), F.lit("abc"))) == 0.8 and x(spark, S.translation_confidence(F.lit("abcd"), F.lit("a"))) == 0.6


def test_scores(spark):
    assert x(spark, S.interest(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert x(spark, S.image_quality(F.lit("a long description"), F.lit(""), F.lit(4), F.lit(3))) == pytest.approx(1.0)
    assert x(spark, S.anchor_quality(F.lit("read more about it"))) == pytest.approx(0.84)
    assert x(spark, S.link_weight(F.lit("advertisement"), F.lit(1.0), F.lit(0.1))) == 0.1
    assert x(spark, S.credibility(F.lit("bbc.com"), F.lit(None).cast("string"), F.lit(None).cast("date"), F.lit(""))) == "high"
    assert x(spark, S.credibility(F.lit("e.org"), F.lit("A"), F.lit(None).cast("date"), F.lit("plain"))) == "low"
    assert x(spark, S.embedding_quality(F.lit("short text here"), F.lit(1.0))) == pytest.approx(0.4)
    features = {"q": F.lit(1.0), "len": F.lit(2.0)}
    assert x(spark, S.intent_scores(features, {"a": {"q": 1.0}, "b": {"len": 1.0}}, {"a": 0.5})) == "b"


def test_outline(spark):
    o = S.outline(F.lit("<h1>T <b>x</b></h1><ul><li>a</li><li>b</li></ul><table></table><blockquote>q</blockquote><h2>U</h2>"))
    assert x(spark, o["headings"]) == ["T x", "U"] and x(spark, o["items"]) == ["a", "b"] and x(spark, o["quotes"]) == ["q"] and x(spark, o["n_tables"]) == 1


def test_link_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", '<a href="/x">One two</a><a href="/x">Again</a><a href="http://b.org/#f">Out</a><a href="/">self</a>')], "page_id long, url string, html string")
    u = P.unique_links(P.links(pages)).orderBy("pos").collect()
    assert [(r.target, r.anchor, r.internal) for r in u] == [("http://a.org/x", "One two", True), ("http://b.org/", "Out", False)]


def test_nulls_pass_through(spark):
    null = F.lit(None).cast("string")
    assert x(spark, S.social_clean(null)) is None and x(spark, S.token_kinds(null)) is None
