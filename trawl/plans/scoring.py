"""Queries over score formulas, token kinds and link tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.functions import scoring as S
from trawl.functions import text as T
from trawl.plans.registry import query
from trawl.plans.text import SENT, SYL, WORDS
from trawl.session import table
from trawl.sources import pages as P


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(
    "text_token_kinds",
    r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]')) AS t FROM documents) SELECT doc_id, CASE WHEN regexp_matches(t, '^\p{L}') THEN 'word' WHEN regexp_matches(t, '^\p{N}') THEN 'number' ELSE 'mark' END AS kind, count(*) AS n, count(DISTINCT t) AS kinds FROM t GROUP BY ALL""",
)
def text_token_kinds(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", F.explode(S.token_kinds(F.col("text"))).alias("t")).select("doc_id", "t.*")
    return t.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("token").alias("kinds"))


@query("text_social_clean", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), 'https?://\S+|@\w+|#\w+', '', 'g'), '\s+', ' ', 'g'))) AS h FROM documents")
def text_social_clean(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(S.social_clean(F.col("text"))).alias("h"))


@query(
    "text_bundle",
    rf"""WITH d AS (SELECT doc_id, text, {WORDS} AS w, {SENT} AS s FROM documents) SELECT doc_id, len(w)::INT AS words, len(s)::INT AS sentences, len(list_filter(string_split_regex(text, '\n+'), lambda p: trim(p) <> ''))::INT AS paragraphs,
    round(len(w) / greatest(1, len(s)), 6) AS words_a_sentence, round(list_sum(list_transform(w, lambda x: {SYL.format('x')})) / len(w), 6) AS syllables_a_word FROM d""",
)
def text_bundle(spark, sf_dir):
    w, s = T.words(F.col("text")), T.sentences(F.col("text"))
    d = docs(spark, sf_dir).select(
        "doc_id", F.size(w).alias("words"), F.size(s).alias("sentences"), F.size(F.filter(F.split("text", r"\n+"), lambda p: F.trim(p) != "")).alias("paragraphs"),
        F.aggregate(w, F.lit(0), lambda a, x: a + T.syllables(x)).alias("syl"),
    )
    return d.select("doc_id", "words", "sentences", "paragraphs", F.round(F.col("words") / F.greatest(F.lit(1), "sentences"), 6).alias("words_a_sentence"), F.round(F.col("syl") / F.col("words"), 6).alias("syllables_a_word"))


@query(
    "score_news_quality",
    rf"""WITH d AS (SELECT doc_id, text, {WORDS} AS w, greatest(1, len({SENT})) AS s, len(list_filter(string_split_regex(text, '\n+'), lambda p: trim(p) <> '')) AS p FROM documents)
    SELECT doc_id, round(CASE WHEN len(w) BETWEEN 300 AND 2000 THEN 0.3 WHEN len(w) >= 100 THEN 0.15 ELSE 0 END + CASE WHEN p >= 3 THEN 0.2 ELSE 0 END + CASE WHEN contains(text, '"') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 0.1 ELSE 0 END
    + 0.2 * greatest(0, least(1, (206.835 - 1.015 * (len(w) / s) - 84.6 * (list_sum(list_transform(w, lambda x: length(x))) / len(w))) / 100)), 6) AS quality FROM d""",
)
def score_news_quality(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(S.news_quality(F.col("text")), 6).alias("quality"))


@query("score_credibility", """SELECT doc_id, CASE WHEN n >= 3 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS credibility FROM (SELECT doc_id, 1 + regexp_matches(lower(text), 'according to|study|report')::INT + contains(text, '"')::INT + (source <> 'src1')::INT AS n FROM documents)""")
def score_credibility(spark, sf_dir):
    author = F.when(F.col("source") != "src1", F.col("source"))
    return docs(spark, sf_dir).select("doc_id", S.credibility(F.lit("e.org"), author, F.lit("2024-01-01").cast("date"), F.col("text")).alias("credibility"))


@query(
    "score_contextual",
    """WITH e AS (SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'news' WHEN 'click' THEN 'entertainment' ELSE 'other' END AS kind FROM events) SELECT event_id, round(least(1, 0.25 * 0.5 + 0.25 + 0.1 + CASE WHEN kind = 'news' AND hour(ts) BETWEEN 9 AND 17 AND isodow(ts) < 6 THEN 0.3 ELSE 0 END + CASE WHEN kind = 'entertainment' AND isodow(ts) >= 6 THEN 0.2 ELSE 0 END), 6)::DOUBLE AS score FROM e""",
)
def score_contextual(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "news").when(F.col("event_type") == "click", "entertainment").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", F.round(S.contextual(F.lit(0.5), F.lit(1.0), F.lit(True), F.col("ts"), kind), 6).alias("score"))


@query(
    "score_document_groups",
    "SELECT p_partkey AS id, round(0.15 * (p_size / 50) + 0.08 * 0.1 + 0.05 * 0.6 + 0.05 * least(1, p_retailprice / 300) + 0.10 * 0.5, 6) AS quality, round(0.08 * 0.2 + 0.05 * 0.1 + 0.07 * ln(p_size + 1) + 0.10 * 0.3, 6) AS behaviour FROM part",
)
def score_document_groups(spark, sf_dir):
    q = S.document_quality(F.col("p_size") / 50, F.lit(0.1), F.lit(0.4), F.col("p_retailprice"), F.lit(0.5))
    b = S.behaviour(F.lit(0.2), F.lit(0.1), F.col("p_size"), F.lit(0.3))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(q, 6).alias("quality"), F.round(b, 6).alias("behaviour"))


@query(
    "score_bm25_fixed",
    f"WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT doc_id, round(ln((1e6 - 999.5) / 1000.5) * len(list_filter(w, lambda x: x = 'the')) * 2.2 / (len(list_filter(w, lambda x: x = 'the')) + 1.2 * (0.25 + 0.75 * len(w) / 1000)), 6) AS score FROM d",
)
def score_bm25_fixed(spark, sf_dir):
    w = T.words(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.round(S.bm25_fixed(F.size(F.filter(w, lambda x: x == "the")), F.size(w)), 6).alias("score"))


@query("score_explained", "SELECT doc_id, concat_ws('; ', CASE WHEN n_chars > 2000 THEN 'long' END, CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN contains(text, '!!') THEN 'shouting' END) AS why FROM documents")
def score_explained(spark, sf_dir):
    rules = [(F.col("n_chars") > 2000, "long"), (F.col("lang") == "en", "english"), (F.contains("text", F.lit("!!")), "shouting")]
    return docs(spark, sf_dir).select("doc_id", S.explained(rules).alias("why"))


@query("score_personalised", "SELECT c_custkey AS id, round(CASE WHEN c_nationkey % 2 = 0 THEN 0.7 * (c_acctbal / 10000) + 0.3 * (c_nationkey / 25) ELSE c_acctbal / 10000 END, 9) AS score FROM customer")
def score_personalised(spark, sf_dir):
    p = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey") / 25)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(S.personalised(F.col("c_acctbal") / 10000, p), 9).alias("score"))


@query(
    "page_outline",
    r"""SELECT page_id, len(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>'))::INT AS items, len(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>'))::INT AS paragraphs, len(regexp_extract_all(html, '(?i)<table[\s>]'))::INT AS tables, len(regexp_extract_all(html, '(?i)<form[\s>]'))::INT AS forms, len(regexp_extract_all(html, '(?i)<script[\s>]'))::INT AS scripts, len(regexp_extract_all(html, '(?i)<style[\s>]'))::INT AS styles FROM pages""",
)
def page_outline(spark, sf_dir):
    o = S.outline(F.col("html"))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.size(o["items"]).alias("items"), F.size(o["paragraphs"]).alias("paragraphs"), o["n_tables"].alias("tables"), o["n_forms"].alias("forms"), o["n_scripts"].alias("scripts"), o["n_styles"].alias("styles")
    )


@query("link_internal_share", r"""WITH l AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href FROM pages) SELECT count(*) FILTER (regexp_matches(href, '^(?i)https?://')) AS absolute, count(*) FILTER (href LIKE '/%' AND href NOT LIKE '//%') AS rooted FROM l""")
def link_internal_share(spark, sf_dir):
    l = P.links(table(spark, sf_dir, "pages"))
    return l.agg(F.count_if(F.col("href").rlike("^(?i)https?://")).alias("absolute"), F.count_if(F.col("href").startswith("/") & ~F.col("href").startswith("//")).alias("rooted"))
