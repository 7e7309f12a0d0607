"""Queries over scoring, sharding, store, news, image and control functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from trawl.functions import scoring as S
from trawl.functions import text as T
from trawl.operators import graph as G
from trawl.operators import index as I
from trawl.operators import kg as K
from trawl.operators import quality as Q
from trawl.operators import queries as U
from trawl.operators import ranking as R
from trawl.operators import store as D
from trawl.operators import vector as V
from trawl.operators import verticals as X
from trawl.plans.graphs import TRADE, trade
from trawl.plans.registry import query
from trawl.plans.text import SENT, WORDS
from trawl.session import table

TOKENS = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', '', 'g'), '\s+'), lambda t: strlen(t) >= 3)"
LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def part(spark, sf_dir):
    return table(spark, sf_dir, "part")


# ---------------------------------------------------------------- index and text


@query("index_damped_tf", f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL) SELECT floor(1 + ln(tf))::BIGINT AS damped, count(*) AS n FROM p GROUP BY 1")
def index_damped_tf(spark, sf_dir):
    return I.postings(docs(spark, sf_dir)).groupBy(I.damped(F.col("tf")).alias("damped")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "index_posting_quality",
    f"WITH t AS (SELECT DISTINCT doc_id, least(1, n_chars / 1000) AS q, unnest({TOKENS}) AS term FROM documents) SELECT doc_id, count(*) AS terms, round(sum(CASE WHEN strlen(term) > 50 THEN 0.5 ELSE 1 END * CASE WHEN len(list_distinct(string_split(term, ''))) / strlen(term) > 0.5 THEN 1.2 ELSE 1 END * q)::DOUBLE, 4) AS quality FROM t GROUP BY doc_id",
)
def index_posting_quality(spark, sf_dir):
    p = I.postings(docs(spark, sf_dir)).join(docs(spark, sf_dir).select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 1000).alias("q")), "doc_id")
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum(I.posting_quality(F.col("term"), F.col("q"))), 4).alias("quality"))


GRAM_WORDS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda t: NOT list_contains(" + LIST(T.STOP_EN) + ", t))"


@query(
    "text_tfidf_keywords",
    f"WITH d AS (SELECT doc_id, {GRAM_WORDS} AS w FROM documents), g AS (SELECT doc_id, unnest(w) AS term FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d), n AS (SELECT doc_id, term, count(*) AS n FROM g GROUP BY ALL), k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) <= 10) SELECT doc_id, term, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS score FROM k",
)
def text_tfidf_keywords(spark, sf_dir):
    return T.tfidf_keywords(docs(spark, sf_dir)).withColumn("score", F.round("score", 6))


VOCABULARY = {"[UNK]": 0, "[CLS]": 1, "[SEP]": 2} | {w: i + 3 for i, w in enumerate(dict.fromkeys(T.STOP_EN))}


@query(
    "text_token_ids",
    rf"WITH d AS (SELECT doc_id, list_concat(list_concat(['[CLS]'], list_transform(list_filter(string_split_regex(text, '\s+'), lambda x: strlen(x) >= 2), lambda x: lower(x))), ['[SEP]'])[1:128] AS t FROM documents) SELECT doc_id, len(t)::INT AS n, list_sum(list_transform(t, lambda x, i: i * (coalesce(list_position({LIST(VOCABULARY)}, x), 1) - 1)))::BIGINT AS weighed FROM d",
)
def text_token_ids(spark, sf_dir):
    """The count of ids of every text and their sum weighed by place."""
    ids = T.token_ids(F.col("text"), VOCABULARY)
    d = docs(spark, sf_dir).select("doc_id", ids.alias("ids"))
    weighed = F.aggregate(F.transform("ids", lambda x, i: ((i + 1) * x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("doc_id", F.size("ids").alias("n"), weighed.alias("weighed"))


@query("text_token_statistics", r"""WITH t AS (SELECT lang, unnest(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]')) AS t FROM documents) SELECT lang, CASE WHEN regexp_matches(t, '^\p{L}') THEN 'word' WHEN regexp_matches(t, '^\p{N}') THEN 'number' ELSE 'mark' END AS kind, count(*) AS n FROM t GROUP BY ALL""")
def text_token_statistics(spark, sf_dir):
    t = docs(spark, sf_dir).select("lang", F.explode(S.token_kinds(F.col("text"))).alias("t"))
    return t.groupBy("lang", F.col("t.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _emoji_sql(text: str) -> str:
    for e, s in S.EMOJI.items():
        text = f"replace({text}, '{e}', ' {'POSITIVE' if s > 0.5 else 'NEGATIVE' if s < -0.5 else 'NEUTRAL'}_EMOJI ')"
    return text


FACES = "".join(S.EMOJI)


@query("text_emoji_words", f"SELECT doc_id, md5({_emoji_sql(f"text || '{FACES}' || doc_id || '👍x'")}) AS h FROM documents")
def text_emoji_words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(S.emoji_words(F.concat("text", F.lit(FACES), F.col("doc_id").cast("string"), F.lit("👍x")))).alias("h"))


@query("text_translation_confidence", "SELECT doc_id, CASE WHEN strlen(text || repeat(lang, 100)) / greatest(1, strlen(text)) < 2 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence FROM documents")
def text_translation_confidence(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", S.translation_confidence(F.col("text"), F.concat("text", F.repeat("lang", F.lit(100)))).alias("confidence"))


@query("text_shingle_jaccard", "WITH s AS (SELECT n_nationkey AS k, list_distinct(list_transform(range(1, greatest(1, length(n_name) - 1)), lambda i: substring(n_name, i, 3))) AS s FROM nation) SELECT a.k AS a, b.k AS b, round(CASE WHEN len(list_distinct(list_concat(a.s, b.s))) > 0 THEN len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) ELSE 0 END::DOUBLE, 6) AS jaccard FROM s a JOIN s b ON a.k < b.k")
def text_shingle_jaccard(spark, sf_dir):
    """All pairs of the 25 nations' names, a table of fixed size."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), T.char_shingles(F.col("n_name")).alias("s"))
    a, b = n.select(F.col("k").alias("a"), F.col("s").alias("x")), n.select(F.col("k").alias("b"), F.col("s").alias("y"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


# ---------------------------------------------------------------- queries and ranking


@query(
    "query_filters_boosts",
    "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'product' END AS content_type, strftime(ts, '%Y-%m-%d') AS date_range, CASE WHEN event_type = 'purchase' THEN 2.0 END::DOUBLE AS title, 1.5::DOUBLE AS content FROM events",
)
def query_filters_boosts(spark, sf_dir):
    """Filters and boosts of queries made of an event's type, value and date."""
    text = F.concat_ws(" ", "event_type", F.floor("value").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    q = table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), text.alias("query"))
    t = U.terms(q).groupBy("query_id").agg(F.collect_set("kind").alias("kinds"), F.max_by("term", F.when(F.col("kind") == "date", F.col("pos"))).alias("date"))
    f, b = U.filters_and_boosts(U.intent(F.col("query")), F.col("kinds"), F.col("date"))
    both = q.join(t, "query_id").select("query_id", f.alias("f"), b.alias("b"))
    pick = lambda m, *ks: [F.col(m)[k].alias(k) for k in ks]
    return both.select(F.col("query_id").alias("event_id"), *pick("f", "content_type", "date_range"), *pick("b", "title", "content"))


@query("query_intent_code", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'what|how|why|when|where') THEN 0 WHEN regexp_matches(lower(text), 'buy|purchase|shop') THEN 1 ELSE 2 END AS code, regexp_matches(lower(text), 'technical|medical|legal|scientific|academic') AS special FROM conversations")
def query_intent_code(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", U.intent_code(t).alias("code"), U.domain_specific(t).alias("special"))


@query("rank_term_ratio", f"WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT doc_id, round(CASE WHEN len(w) > 0 THEN (len(list_filter(w, lambda x: x = 'the')) + len(list_filter(w, lambda x: x = 'and')) * 2) / len(w) ELSE 0 END::DOUBLE, 6) AS ratio FROM d")
def rank_term_ratio(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(R.term_ratio(F.lit("The and AND"), F.col("text")), 6).alias("ratio"))


@query("rank_phrase_match", "SELECT doc_id, CASE WHEN contains(lower(text), 'of the and') THEN 1.0 WHEN contains(lower(text), 'of the') OR contains(lower(text), 'the and') THEN 0.5 ELSE 0.0 END::DOUBLE AS match FROM documents")
def rank_phrase_match(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", R.phrase_match(F.lit("Of the and"), F.col("text")).alias("match"))


@query("rank_freshness", "SELECT o_orderkey, round(exp(-greatest(0, epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate::TIMESTAMP)) / 86400 / 30), 9) AS monthly, round(exp(-0.1 * greatest(0, epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate::TIMESTAMP)) / 86400), 9) AS daily FROM orders")
def rank_freshness(spark, sf_dir):
    now = F.lit("1998-01-01 00:00:00")
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(R.decay(d, now, 1 / 30), 9).alias("monthly"), F.round(R.decay(d, now, 0.1), 9).alias("daily"))


@query("rank_user_features", "SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END AS clicks, 0.0::DOUBLE AS dwell, CASE WHEN c_acctbal > 5000 THEN 0.9 ELSE 0.5 END::DOUBLE AS satisfaction, CASE WHEN c_nationkey = 7 THEN 1.0 ELSE 0.0 END::DOUBLE AS location, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS device FROM customer")
def rank_user_features(spark, sf_dir):
    b = F.col("c_acctbal")
    device = F.when(F.col("c_mktsegment") == "BUILDING", "mobile").when(F.col("c_mktsegment") == "MACHINERY", "tablet").otherwise("desktop")
    f = R.user_features(F.when(b > 0, b), F.lit(None).cast("double"), F.when(b > 5000, 0.9), F.col("c_nationkey"), F.lit(7), device)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *[c.alias(k) for k, c in f.items()])


# ---------------------------------------------------------------- results, duplicates, anomalies

TITLE = r"array_to_string(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')[1:8], ' ')"


def items(spark, sf_dir):
    w = F.array_join(F.slice(T.words(F.col("text")), 1, 8), " ")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), w.alias("title"), F.col("text").alias("content"))


@query(
    "results_semantic_pairs",
    f"WITH s AS (SELECT min(item_id) AS id, t, c FROM (SELECT item_id, list_sort(list_distinct({WORDS}[1:8])) AS t, list_sort(list_distinct({WORDS})) AS c FROM (SELECT * FROM benchmark UNION ALL SELECT item_id + 10000, text || ' more' FROM benchmark)) GROUP BY t, c), p AS (SELECT a.id AS a, b.id AS b, 0.6 * len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) + 0.4 * len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))) AS s FROM s a JOIN s b ON a.id < b.id) SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.8",
)
def results_semantic_pairs(spark, sf_dir):
    """Benchmark items, each also with a word more: titles are the first eight words."""
    i = items(spark, sf_dir)
    more = i.select((F.col("id") + 10000).alias("id"), "title", F.concat("content", F.lit(" more")).alias("content"))
    return R.semantic_pairs(i.unionAll(more)).withColumn("similarity", F.round("similarity", 6))


@query("results_fuzzy_pairs", "WITH s AS (SELECT min(c_custkey) AS id, c_name AS s FROM (SELECT c_custkey, substring(c_name, 5) || c_mktsegment AS c_name FROM customer WHERE c_nationkey = 3) GROUP BY c_name), p AS (SELECT a.id AS a, b.id AS b, 1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)) AS r FROM s a JOIN s b ON a.id < b.id) SELECT a, b, round(r, 6) AS ratio FROM p WHERE r >= 0.9 - 1e-9")
def results_fuzzy_pairs(spark, sf_dir):
    """Names of one nation's customers that differ in few letters."""
    c = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("id"), F.concat(F.expr("substring(c_name, 5)"), "c_mktsegment").alias("name"))
    return R.fuzzy_pairs(c, "name").withColumn("ratio", F.round("ratio", 6))


@query("results_duplicate_statistics", "SELECT count(*) AS fingerprints, count(*) FILTER (n > 1) AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(text))")
def results_duplicate_statistics(spark, sf_dir):
    return R.duplicate_statistics(F.sha2("text", 256), docs(spark, sf_dir))


@query("news_duplicate_counts", "SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) - 1 AS others FROM documents")
def news_duplicate_counts(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(d.groupBy("h").agg((F.count(F.lit(1)) - 1).alias("others")), "h").select("doc_id", "others")


@query("news_trending", "WITH d AS (SELECT event_type AS topic, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT topic, day, n, lag(n) OVER (PARTITION BY topic ORDER BY day) AS before FROM d) SELECT topic, day, n, round(n / greatest(1, coalesce(before, 0)), 6) AS growth FROM b")
def news_trending(spark, sf_dir):
    """Events of a topic by day over those of its day before."""
    from pyspark.sql import Window as W

    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("topic"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.lag("n").over(W.partitionBy("topic").orderBy("day")), F.lit(0))
    return d.select("topic", "day", "n", F.round(F.col("n") / F.greatest(F.lit(1), before), 6).alias("growth"))


# ---------------------------------------------------------------- quality

DIMS = {"readability": "p_size / 50", "accuracy": "(p_partkey % 10) / 10", "completeness": "(p_partkey % 7) / 7", "authority": "(p_partkey % 3) / 3", "structure": "p_retailprice / 2000"}


@query("quality_recommendations", "SELECT p_partkey AS id, concat_ws(' | ', " + ", ".join(f"CASE WHEN {e} < 0.3 THEN '{Q.ADVICE[k]}' END" for k, e in DIMS.items()) + f", CASE WHEN p_size / 50 < 0.5 THEN '{Q.ADVICE_OVERALL}' END) AS advice FROM part")
def quality_recommendations(spark, sf_dir):
    advice = Q.recommendations({k: F.expr(e) for k, e in DIMS.items()}, F.expr("p_size / 50"))
    return part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.array_join(advice, " | ").alias("advice"))


@query(
    "spam_explanation",
    "WITH f AS (SELECT p_partkey AS id, p_size % 3 AS w, p_partkey % 2 AS s, p_size / 50 AS c, (p_partkey % 5) / 10 AS m, p_partkey % 9 AS u, (p_partkey % 11) / 11 AS r, (p_partkey % 4) / 4 AS a, p_size > 25 AS spam FROM part), e AS (SELECT id, spam, concat_ws('; ', CASE WHEN w > 0 THEN 'Contains ' || w || ' spam keywords' END, CASE WHEN s > 0 THEN 'Has ' || s || ' suspicious domains' END, CASE WHEN c > 0.3 THEN 'High ratio of capital letters' END, CASE WHEN m > 0.2 THEN 'High ratio of special characters' END, CASE WHEN u > 5 THEN 'Contains many URLs' END, CASE WHEN r > 0.5 THEN 'High word repetition' END, CASE WHEN a < 0.3 THEN 'Low domain authority' END) AS why FROM f) SELECT id, CASE WHEN spam THEN 'Classified as spam: ' ELSE 'Classified as legitimate: ' END || CASE WHEN why = '' THEN 'Standard content analysis' ELSE why END AS why FROM e",
)
def spam_explanation(spark, sf_dir):
    e = {"spam_words": "p_size % 3", "suspicious_domains": "p_partkey % 2", "capitals": "p_size / 50", "marks": "(p_partkey % 5) / 10", "urls": "p_partkey % 9", "repetition": "(p_partkey % 11) / 11", "authority": "(p_partkey % 4) / 4"}
    return part(spark, sf_dir).select(F.col("p_partkey").alias("id"), Q.spam_explanation({k: F.expr(x) for k, x in e.items()}, F.col("p_size") > 25).alias("why"))


@query("spam_heuristic", "WITH s AS (SELECT doc_id, (CASE WHEN contains(lower(text), 'the') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(text), 'click here') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(text), 'and') THEN 0.3 ELSE 0 END)::DOUBLE AS score FROM documents) SELECT doc_id, round(score, 6) AS score, score > 0.5 AS spam FROM s")
def spam_heuristic(spark, sf_dir):
    score, spam = Q.spam_heuristic(F.col("text"), ("the", "click here", "and"))
    return docs(spark, sf_dir).select("doc_id", F.round(score, 6).alias("score"), spam.alias("spam"))


@query("quality_level", "SELECT p_partkey AS id, CASE WHEN p_size / 50 >= 0.8 THEN 'excellent' WHEN p_size / 50 >= 0.6 THEN 'good' WHEN p_size / 50 >= 0.4 THEN 'fair' WHEN p_size / 50 >= 0.2 THEN 'poor' ELSE 'bad' END AS level FROM part")
def quality_level(spark, sf_dir):
    return part(spark, sf_dir).select(F.col("p_partkey").alias("id"), Q.level(F.col("p_size") / 50).alias("level"))


@query("sentiment_vote", "WITH v AS (SELECT p_partkey AS id, 0.5::DOUBLE * (p_size / 50) * (CASE WHEN p_size % 2 = 0 THEN 1 ELSE -1 END) AS a, 0.3::DOUBLE * 0.8 * (CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE -1 END) AS b, 0.2::DOUBLE * 0.6 * (CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE -1 END) AS c FROM part), s AS (SELECT id, greatest(a, 0) + greatest(b, 0) + greatest(c, 0) AS up, -least(a, 0) - least(b, 0) - least(c, 0) AS down FROM v) SELECT id, up > down AS positive, round(greatest(up, down), 6) AS confidence FROM s")
def sentiment_vote(spark, sf_dir):
    votes = {"a": (F.col("p_size") % 2 == 0, F.col("p_size") / 50), "b": (F.col("p_partkey") % 3 == 0, F.lit(0.8)), "c": (F.col("p_partkey") % 5 == 0, F.lit(0.6))}
    up, confidence = Q.ensemble_vote(votes, {"a": 0.5, "b": 0.3, "c": 0.2})
    return part(spark, sf_dir).select(F.col("p_partkey").alias("id"), up.alias("positive"), F.round(confidence, 6).alias("confidence"))


# ---------------------------------------------------------------- news and images


@query("news_quotes_statistics", r"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '"([^"]+)"', 1), lambda q: length(q) > 10))::INT AS quotes, len(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?%|[0-9]+(?:,[0-9]{3})+|[0-9]+ out of [0-9]+'))::INT AS numbers FROM (SELECT doc_id, text || ' "said in ' || doc_id || ' words" 12.5% of 1,234,567 or 3 out of 4 "short"' AS text FROM documents)""")
def news_quotes_statistics(spark, sf_dir):
    t = F.concat("text", F.lit(' "said in '), F.col("doc_id").cast("string"), F.lit(' words" 12.5% of 1,234,567 or 3 out of 4 "short"'))
    return docs(spark, sf_dir).select("doc_id", F.size(X.quotes(t)).alias("quotes"), F.size(X.statistics(t)).alias("numbers"))


@query("news_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def news_dates(spark, sf_dir):
    """Order dates read back from five ways to write them, of which the last is none."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    t = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MM/dd/yyyy")).when(k == 2, F.date_format(d, "dd-MM-yyyy")).when(k == 3, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date(X.parsed_date(t)).alias("day"))


IMAGES = "i AS (SELECT p_partkey AS image_id, p_size * 40 AS width, 300 + p_partkey % 500 AS height, p_retailprice / 2000 AS quality, p_brand AS license, p_name AS alt, p_type AS title, (p_partkey % 17) / 17 AS score, DATE '2024-01-01' + (p_partkey % 300)::INT AS created, [p_size * 5, (p_partkey % 256)::INT, 128] AS colour FROM part)"


def images(spark, sf_dir):
    return part(spark, sf_dir).select(
        F.col("p_partkey").alias("image_id"), (F.col("p_size") * 40).alias("width"), (300 + F.col("p_partkey") % 500).alias("height"), (F.col("p_retailprice") / 2000).alias("quality"), F.col("p_brand").alias("license"),
        F.col("p_name").alias("alt"), F.col("p_type").alias("title"), ((F.col("p_partkey") % 17) / 17).alias("score"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int")).alias("created"),
        F.array(F.array(F.col("p_size") * 5, (F.col("p_partkey") % 256).cast("int"), F.lit(128))).alias("colours"),
    )


@query("image_filtered", f"WITH {IMAGES} SELECT image_id FROM i WHERE width >= 600 AND height >= 350 AND quality >= 0.5 AND created >= DATE '2024-02-01' AND created <= DATE '2024-09-30' AND sqrt(pow(colour[1] - 128, 2) + pow(colour[2] - 128, 2) + pow(colour[3] - 128, 2)) < 100")
def image_filtered(spark, sf_dir):
    f = {"min_width": 600, "min_height": 350, "min_quality": 0.5, "after": "2024-02-01", "before": "2024-09-30", "colour": "gray"}
    return X.image_filters(images(spark, sf_dir), f).select("image_id")


@query("image_colour_distance", f"WITH {IMAGES} SELECT image_id, round(sqrt(pow(colour[1] - 255, 2) + pow(colour[2] - 165, 2) + pow(colour[3], 2)), 6) AS distance FROM i")
def image_colour_distance(spark, sf_dir):
    return images(spark, sf_dir).select("image_id", F.round(X.colour_distance(F.col("colours"), X.COLOURS["orange"]), 6).alias("distance"))


@query("image_quality", f"WITH {IMAGES} SELECT image_id, round((0.5 + 0.3 + CASE WHEN length(alt) > 10 THEN 0.1 ELSE 0 END + 0.1 + CASE WHEN width / height > 0.5 AND width / height < 2 THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS quality FROM i")
def image_quality(spark, sf_dir):
    i = images(spark, sf_dir)
    return i.select("image_id", F.round(S.image_quality(F.col("alt"), F.col("title"), F.col("width"), F.col("height")), 6).alias("quality"))


@query("image_types", f"WITH {IMAGES} SELECT image_id, CASE WHEN image_id % 13 = 0 THEN 'illustration' WHEN width / height > 1.5 AND width > 1000 THEN 'screenshot' WHEN score > 0.8 THEN 'diagram' WHEN width < 500 AND height < 500 AND image_id % 100 > 50 THEN 'logo' ELSE 'photo' END AS kind FROM i")
def image_types(spark, sf_dir):
    edges = F.when(F.col("score") > 0.8, 0.2).otherwise(0.0)
    return images(spark, sf_dir).select("image_id", X.image_type(F.col("image_id") % 13 == 0, F.col("width"), F.col("height"), edges, F.col("image_id") % 100).alias("kind"))


ORDERS = {"relevance": "score", "popularity": "score", "date": "created", "size": "width * height", "quality": "quality"}


@query("image_sorted", f"WITH {IMAGES} " + " UNION ALL ".join(f"(SELECT '{k}' AS by, image_id, row_number() OVER (ORDER BY {e} DESC, image_id)::INT AS rank FROM i QUALIFY rank <= 20)" for k, e in ORDERS.items()))
def image_sorted(spark, sf_dir):
    i = images(spark, sf_dir)
    return reduce(lambda a, b: a.unionByName(b), [X.image_order(i, k).select(F.lit(k).alias("by"), "image_id", "rank") for k in ORDERS])


@query("image_query_errors", "SELECT p_partkey AS id, CASE WHEN p_size * 3 NOT BETWEEN 1 AND 100 THEN 'limit' WHEN p_partkey % 5 - 1 < 0 THEN 'offset' END AS error FROM part")
def image_query_errors(spark, sf_dir):
    return part(spark, sf_dir).select(F.col("p_partkey").alias("id"), X.image_query_errors(F.col("p_size") * 3, F.col("p_partkey") % 5 - 1).alias("error"))


@query("image_suggestions", "SELECT p_type AS text, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, text LIMIT 5")
def image_suggestions(spark, sf_dir):
    """The five most popular texts, a report."""
    return part(spark, sf_dir).groupBy(F.col("p_type").alias("text")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "text").limit(5)


NEIGHBOURS = "d AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


@query("image_related", "WITH q AS (SELECT vec_id AS image_id, embedding::DOUBLE[64] AS q FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT image_id, vec_id, round(1 - array_inner_product(q, embedding::DOUBLE[64]) / (sqrt(array_inner_product(q, q)) * sqrt(array_inner_product(embedding::DOUBLE[64], embedding::DOUBLE[64]))), 9) AS d FROM q JOIN embeddings ON vec_id <> image_id) SELECT image_id, vec_id, row_number() OVER (PARTITION BY image_id ORDER BY d, vec_id)::INT AS rank FROM d QUALIFY rank <= 5")
def image_related(spark, sf_dir):
    """The five nearest other images of every image whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings")
    return V.knn(e.where("vec_id % 100 = 0"), e, k=5, exclude_self=True).select(F.col("query_id").alias("image_id"), "vec_id", "rank")


@query(
    "vector_distance_scores",
    f"WITH {NEIGHBOURS}, m AS (SELECT vec_id, list_sum(list_transform(list_zip(x, y), lambda p: CASE WHEN abs(p[1] - p[2]) >= 1e-6 THEN 1 ELSE 0 END))::DOUBLE AS h, sqrt(list_sum(list_transform(list_zip(x, y), lambda p: pow(p[1] - p[2], 2)))) AS e, list_distinct(list_transform(x, lambda v: greatest(0, floor(v * 1000))::BIGINT)) AS a, list_distinct(list_transform(y, lambda v: greatest(0, floor(v * 1000))::BIGINT)) AS b FROM d) SELECT vec_id, h AS hamming, round(1 / (1 + h), 6) AS hamming_score, round(1 / (1 + e), 6) AS euclidean_score, round((1 - (1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))))::DOUBLE, 6) AS jaccard_score FROM m",
)
def vector_distance_scores(spark, sf_dir):
    """Distances and scores between vectors of neighbouring ids."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    d = {m: V.distance(F.col("embedding"), F.col("y"), m) for m in ("hamming", "euclidean", "jaccard")}
    return p.select("vec_id", d["hamming"].alias("hamming"), *[F.round(V.score(d[m], m), 6).alias(f"{m}_score") for m in d])


@query("vector_updates", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS s FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 5 <> 0 UNION ALL SELECT vec_id, 3.0 FROM embeddings WHERE vec_id % 5 = 0")
def vector_updates(spark, sf_dir):
    """An index after removing every seventh vector and replacing every fifth."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    new = e.where("vec_id % 5 = 0").select("vec_id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    return V.updated(e, new, e.where("vec_id % 7 = 0")).select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("s"))


@query("vector_embedding_quality", f"WITH t AS (SELECT doc_id, text, len({WORDS}) / greatest(1, len({SENT})) AS x FROM documents) SELECT doc_id, round(least(1, CASE WHEN strlen(text) < 50 THEN 0.8 WHEN strlen(text) > 1000 THEN 0.9 ELSE 1 END * CASE WHEN doc_id % 4 = 0 THEN 0.7 ELSE 1 END * CASE WHEN x < 5 THEN 0.5 WHEN x > 20 THEN 1.5 ELSE 0.5 + (x - 5) / 15 END)::DOUBLE, 6) AS quality FROM t")
def vector_embedding_quality(spark, sf_dir):
    magnitude = F.when(F.col("doc_id") % 4 == 0, 20.0).otherwise(1.0)
    return docs(spark, sf_dir).select("doc_id", F.round(S.embedding_quality(F.col("text"), magnitude), 6).alias("quality"))


# ---------------------------------------------------------------- graphs and knowledge


@query("graph_added", "WITH l AS (SELECT c_nationkey AS src, (c_nationkey + 1) % 25 AS dst, 1.0::DOUBLE AS weight, 0 AS n FROM customer UNION ALL SELECT c_nationkey, c_custkey % 40, 2.0, 1 FROM customer), k AS (SELECT * FROM l WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)) SELECT src, dst, arg_min(weight, (n, weight)) AS weight FROM k GROUP BY ALL")
def graph_added(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.select(F.col("c_nationkey").cast("long").alias("src"), ((F.col("c_nationkey") + 1) % 25).cast("long").alias("dst"), F.lit(1.0).alias("weight"))
    new = c.select(F.col("c_nationkey").cast("long").alias("src"), (F.col("c_custkey") % 40).alias("dst"), F.lit(2.0).alias("weight"))
    known = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").cast("long").alias("id"))
    return G.added(known, old, new)


@query("kg_added", "WITH e AS (SELECT p_partkey AS entity_id, split_part(p_name, ' ', 1) AS name, p_brand AS type, p_size / 50 AS confidence, p_partkey % 2 AS n FROM part) SELECT entity_id, name, type, round(confidence, 6) AS confidence FROM e QUALIFY row_number() OVER (PARTITION BY lower(name), type ORDER BY n, entity_id) = 1")
def kg_added(spark, sf_dir):
    p = part(spark, sf_dir).select(F.col("p_partkey").alias("entity_id"), F.split("p_name", " ")[0].alias("name"), F.col("p_brand").alias("type"), F.round(F.col("p_size") / 50, 6).alias("confidence"))
    return K.added(p.where("entity_id % 2 = 0"), p.where("entity_id % 2 = 1"))


@query("kg_statistics", "SELECT p_brand AS type, count(*) AS n, round(avg(p_size / 50), 6) AS confidence FROM part GROUP BY 1")
def kg_statistics(spark, sf_dir):
    p = part(spark, sf_dir).select(F.col("p_brand").alias("type"), (F.col("p_size") / 50).alias("confidence"))
    return K.statistics(p).withColumn("confidence", F.round("confidence", 6))


@query("kg_search", "SELECT n_name AS name FROM nation WHERE contains(lower(n_name), 'an') ORDER BY n_nationkey DESC, n_name LIMIT 10")
def kg_search(spark, sf_dir):
    """The ten most confident entities whose name holds a text."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("confidence"))
    return K.search(n, "An").select("name")


@query("kg_inferred", "WITH RECURSIVE f AS (SELECT DISTINCT 'c' || c_custkey AS s, 'n' || c_nationkey AS o FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region), t AS (SELECT s, o FROM f UNION SELECT t.s, f.o FROM t JOIN f ON t.o = f.s) SELECT s AS subject, o AS object FROM t")
def kg_inferred(spark, sf_dir):
    fact = lambda t, a, b, x, y: table(spark, sf_dir, t).select(F.concat(F.lit(x), F.col(a).cast("string")).alias("subject"), F.concat(F.lit(y), F.col(b).cast("string")).alias("object"))
    world = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("subject"), F.lit("world").alias("object"))
    facts = fact("customer", "c_custkey", "c_nationkey", "c", "n").union(fact("nation", "n_nationkey", "n_regionkey", "n", "r")).union(world)
    return K.inferred(facts.withColumn("predicate", F.lit("in")), "in")


# ---------------------------------------------------------------- store and control


@query("store_history", "SELECT doc_id, 1 AS version, 'ACTIVE' AS status, md5(text) AS h FROM documents WHERE doc_id = 3 UNION ALL SELECT doc_id, 2, 'ACTIVE', md5(text || '!') FROM documents WHERE doc_id = 3 UNION ALL SELECT doc_id, 3, 'DELETED', md5(text || '!') FROM documents WHERE doc_id = 3")
def store_history(spark, sf_dir):
    """Versions of a document that was stored twice and deleted."""
    d = docs(spark, sf_dir).select("doc_id", F.col("text").alias("content")).distinct()
    empty = spark.createDataFrame([], "doc_id long, content string, status string, version int, checksum string")
    one = D.stored(empty, d)
    two = D.stored(one, d.where("doc_id % 3 = 0").withColumn("content", F.concat("content", F.lit("!"))))
    return D.history(D.deleted(two, d.where("doc_id % 3 = 0")), 3).select("doc_id", "version", "status", F.md5("content").alias("h"))


@query("store_expired", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND epoch(TIMESTAMP '1997-01-01') - epoch(o_orderdate::TIMESTAMP) > 3600")
def store_expired(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "COMMITTED").when(F.col("o_orderstatus") == "O", "ABORTED").otherwise("ACTIVE")
    t = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("ended"))
    return D.expired(t, F.lit("1997-01-01 00:00:00").cast("timestamp")).select("o_orderkey")


@query("store_kept_backups", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 2")
def store_kept_backups(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("backup_id"))
    return D.kept_backups(o, 2).select(F.col("backup_id").alias("o_orderkey"))


@query("store_incremental", "SELECT doc_id::VARCHAR AS path FROM documents WHERE doc_id % 3 = 0 OR doc_id % 10 = 1")
def store_incremental(spark, sf_dir):
    """Files that are new or changed since a manifest without every third and with another checksum for some."""
    f = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("checksum"), "doc_id")
    old = f.where("doc_id % 3 <> 0").withColumn("checksum", F.when(F.col("doc_id") % 10 == 1, "old").otherwise(F.col("checksum")))
    return D.incremental(f, old).select("path")


@query("store_glob", "SELECT page_id, (url LIKE 'http://%.html' OR url LIKE '%/de/%') AND NOT url LIKE '%blog%' AS hit FROM pages")
def store_glob(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", D.glob(F.col("url"), ["http://*.html", "*/de/*"], ["*blog*"]).alias("hit"))


@query("shard_range", "SELECT c_custkey, (((ascii(lower(substring(c_mktsegment, 1, 1))) - 97) % 4 + 4) % 4)::INT AS shard FROM customer")
def shard_range(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.range_shard(F.col("c_mktsegment"), 4).alias("shard"))


@query("shard_round_robin", "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 5)::INT AS shard FROM orders")
def shard_round_robin(spark, sf_dir):
    return X.round_robin(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 5).select("o_orderkey", "shard")


@query("store_scaling", "WITH s AS (SELECT count(*) AS healthy, avg(s_acctbal) AS mean FROM supplier WHERE s_acctbal > 0) SELECT healthy, round(mean, 6) AS mean, CASE WHEN healthy < 1000000 AND mean > 4000 THEN 'up' WHEN healthy > 1 AND mean < 1000 THEN 'down' ELSE 'stay' END AS action FROM s")
def store_scaling(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") > 0).alias("healthy"), F.col("s_acctbal").alias("connections"))
    return X.scaling(s, 1, 1_000_000, 4000, 1000).withColumn("mean", F.round("mean", 6))


JOBS = "j AS (SELECT 'd' || user_id AS domain, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'queued' ELSE 'done' END AS status FROM events)"


def crawl_jobs(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "queued").otherwise("done")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("domain"), status.alias("status"))


@query("crawl_statistics", f"WITH {JOBS}, s AS (SELECT count(*) AS scheduled, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM j) SELECT scheduled, done, failed, round(done / (done + failed), 6) AS success_rate FROM s")
def crawl_statistics(spark, sf_dir):
    return X.frontier_statistics(crawl_jobs(spark, sf_dir))[0].withColumn("success_rate", F.round("success_rate", 6))


@query("crawl_top_domains", f"WITH {JOBS} SELECT domain, count(*) AS requests FROM j GROUP BY 1 ORDER BY requests DESC, domain LIMIT 10")
def crawl_top_domains(spark, sf_dir):
    return X.frontier_statistics(crawl_jobs(spark, sf_dir))[1]


@query("crawl_backoff", "SELECT p_partkey AS id, least(3600, pow(2, p_size % 15))::DOUBLE AS seconds FROM part")
def crawl_backoff(spark, sf_dir):
    return part(spark, sf_dir).select(F.col("p_partkey").alias("id"), X.backoff(F.col("p_size") % 15).alias("seconds"))


LOG = "l AS (SELECT user_id AS txn, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'abort' ELSE 'operation' END AS action, ts FROM events)"


@query(
    "store_transactions",
    f"WITH {LOG}, t AS (SELECT txn, arg_min(action, seq) FILTER (action <> 'operation') AS e, min(seq) FILTER (action <> 'operation') AS ended, min(ts) AS began FROM l GROUP BY txn) SELECT txn, CASE WHEN e = 'commit' THEN 'COMMITTED' ELSE 'ABORTED' END AS status, (SELECT count(*) FROM l WHERE l.txn = t.txn AND action = 'operation' AND (ended IS NULL OR seq < ended)) AS operations FROM t",
)
def store_transactions(spark, sf_dir):
    """A user's events as one transaction's log: a purchase commits, an error aborts; in the end all are old."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "abort").otherwise("operation")
    l = e.select(F.col("user_id").alias("txn"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), action.alias("action"), F.col("ts").cast("timestamp").alias("ts"))
    return D.transactions(l, F.lit("2030-01-01 00:00:00").cast("timestamp"))


@query("store_two_phase", "WITH v AS (SELECT o_custkey AS txn, o_orderstatus AS p, bool_or(o_totalprice > 50000) AS y FROM orders GROUP BY ALL) SELECT txn, CASE WHEN count(*) FILTER (y AND p IN ('F', 'O')) = 2 THEN 'commit' ELSE 'abort' END AS decision FROM v GROUP BY txn")
def store_two_phase(spark, sf_dir):
    """Votes of two participants, F and O: an order of over 50,000 is a yes."""
    v = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("txn"), F.col("o_orderstatus").alias("participant"), (F.col("o_totalprice") > 50_000).alias("vote"))
    return D.two_phase(v, spark.createDataFrame([("F",), ("O",)], "participant string"))


@query("cache_hit_rate", "SELECT event_type AS layer, count(*) AS requests, count(*) FILTER (value < 50) AS hits, round(count(*) FILTER (value < 50) / count(*), 6) AS rate FROM events GROUP BY 1")
def cache_hit_rate(spark, sf_dir):
    l = table(spark, sf_dir, "events").select(F.col("event_type").alias("layer"), (F.col("value") < 50).alias("hit"))
    return D.hit_rate(l, "layer").withColumn("rate", F.round("rate", 6))


@query("cache_invalidated", "WITH RECURSIVE e AS (SELECT p_partkey AS k FROM part), h AS (SELECT k FROM e WHERE 'p:' || k LIKE 'p:1_' UNION SELECT e.k FROM h JOIN e ON e.k = h.k * 2) SELECT 'p:' || k AS key FROM h")
def cache_invalidated(spark, sf_dir):
    """Keys p:10 to p:19 and what depends on them: a part on that of half its number."""
    e = part(spark, sf_dir).select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("key"), "p_partkey")
    on = F.concat(F.lit("p:"), F.expr("p_partkey div 2").cast("string"))
    return D.invalidated(e.select("key"), e.where("p_partkey % 2 = 0").select("key", on.alias("on")), ["p:1?"])


@query("crawl_breakers", "WITH o AS (SELECT user_id AS key, max((ts, event_id)) FILTER (event_type NOT IN ('error', 'view', 'click')) AS ok FROM events GROUP BY 1), f AS (SELECT user_id AS key, count(*) AS n FROM events JOIN o ON user_id = key WHERE event_type IN ('error', 'view', 'click') AND (ok IS NULL OR (ts, event_id) > ok) GROUP BY 1) SELECT key, CASE WHEN coalesce(n, 0) < 3 THEN 'closed' ELSE 'half_open' END AS state, coalesce(n, 0) AS failing FROM o LEFT JOIN f USING (key)")
def crawl_breakers(spark, sf_dir):
    """Users as hosts: errors, views and clicks fail; all have rested by now."""
    c = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (~F.col("event_type").isin("error", "view", "click")).alias("ok"))
    return D.breaker(c, F.lit("2030-01-01 00:00:00").cast("timestamp"), failures=3)


@query("search_federated", "WITH s AS (SELECT 'documents' AS store, doc_id AS id, text FROM documents UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations) SELECT store, id FROM s WHERE regexp_matches(lower(text), '(^|\\s)the(\\s|$)') AND regexp_matches(lower(text), '(^|\\s)and(\\s|$)')")
def search_federated(spark, sf_dir):
    """Texts of two stores with both words."""
    c = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("store"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    s = docs(spark, sf_dir).select(F.lit("documents").alias("store"), F.col("doc_id").alias("id"), "text").unionByName(c)
    w = T.words(F.col("text"))
    return s.where(F.array_contains(w, "the") & F.array_contains(w, "and")).select("store", "id")


@query("sql_parameters", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' GROUP BY 1")
def sql_parameters(spark, sf_dir):
    """A statement with parameters, through the engine and its plan cache."""
    from trawl.operators.relational import QueryEngine
    from trawl.session import views

    views(spark, sf_dir, "orders")
    engine = QueryEngine(spark)
    args = {"least": 100000, "status": "F"}
    text = "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status GROUP BY 1"
    engine.execute(text, args)
    return engine.execute(text.replace(" WHERE", "  WHERE"), args)


@query("sql_batch_statistics", "SELECT * FROM (VALUES ('SELECT', 3, 1), ('WITH', 1, 0)) t(kind, n, failed)")
def sql_batch_statistics(spark, sf_dir):
    """Statements run at once, one of which fails alone, counted by kind."""
    from trawl.operators.relational import QueryEngine
    from trawl.session import views

    views(spark, sf_dir, "region", "nation")
    engine = QueryEngine(spark)
    engine.execute_batch([("SELECT * FROM region", None), ("SELECT * FROM nation WHERE n_nationkey = :k", {"k": 3}), ("SELECT nothing FROM region", None), ("WITH a AS (SELECT 1) SELECT * FROM a", None)])
    return engine.statistics()


@query(
    "graph_communities",
    f"WITH {TRADE}, l AS (SELECT n_nationkey AS id, n_regionkey AS label FROM nation), p AS (SELECT a.label AS a, b.label AS b FROM e JOIN l a ON a.id = src JOIN l b ON b.id = dst WHERE src <> dst), s AS (SELECT label, count(*) AS size FROM l GROUP BY 1), c AS (SELECT label, size, (SELECT count(*) FROM p WHERE a = label AND b = label) AS i, (SELECT count(*) FROM p WHERE a <> b AND (a = label OR b = label)) AS x FROM s) SELECT label, size, i AS internal, x AS external, round(2 * i / (size * (size - 1)), 6) AS density, round(CASE WHEN 2 * i + x > 0 THEN x / (2 * i + x) ELSE 0 END, 6) AS conductance FROM c",
)
def graph_communities(spark, sf_dir):
    """Regions as communities of the nations' trade."""
    label = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("label"))
    c = G.communities(trade(spark, sf_dir), label)
    return c.withColumns({k: F.round(k, 6) for k in ("density", "conductance")})
