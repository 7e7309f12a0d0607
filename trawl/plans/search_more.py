"""Queries over query understanding, ranking, results, verticals and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators import queries as Q
from trawl.operators import quality as C
from trawl.operators import ranking as R
from trawl.operators import verticals as X
from trawl.plans.registry import query
from trawl.plans.text import WORDS, lst
from trawl.session import table

# fixed values: query strings and dictionaries
QUERIES = [
    (1, "what is machine learning?"), (2, "buy cheap laptop 2024"), (3, '"exact phrase" AND wild*'), (4, "machne lerning algorithms"), (5, "coffee shop near me"), (6, "funny cat video"),
    (7, "/reg.ex/ 2024-01-31 3.14"), (8, "login page"), (9, "the"), (10, "weather forecast"),
]
DICTIONARY = "what is machine learning buy cheap laptop algorithms coffee shop near me funny cat video login page the weather forecast deep network".split()
SYNONYMS = [("laptop", ["notebook", "computer"]), ("cheap", ["affordable", "budget"]), ("machine", ["device"]), ("learning", ["training", "study"])]


def frames(spark):
    return (
        spark.createDataFrame(QUERIES, "query_id int, query string"), spark.createDataFrame([(w,) for w in DICTIONARY], "word string"),
        spark.createDataFrame([("laptop",), ("coffee",)], "term string"), spark.createDataFrame(SYNONYMS, "term string, related array<string>"),
    )


def values(rows):
    return "(VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows) + ")"


@query(
    "query_terms",
    f"""WITH q(query_id, query) AS (SELECT * FROM {values(QUERIES)}), t AS (SELECT query_id, unnest(regexp_extract_all(query, '"[^"]*"|\\S+')) AS term FROM q),
    k AS (SELECT query_id, term, CASE WHEN try_cast(term AS DOUBLE) IS NOT NULL THEN 'number' WHEN regexp_matches(term, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$|^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') THEN 'date' WHEN upper(term) IN ('AND', 'OR', 'NOT') THEN 'boolean'
    WHEN regexp_matches(term, '^/.*/$') THEN 'regex' WHEN regexp_matches(term, '[*?]') THEN 'wildcard' WHEN term LIKE '"%"' THEN 'phrase' ELSE 'keyword' END AS kind FROM t)
    SELECT query_id, term, kind, round(CASE kind WHEN 'phrase' THEN 2.0::DOUBLE WHEN 'number' THEN 1.2 WHEN 'date' THEN 1.3 WHEN 'boolean' THEN 0.5 ELSE 1.0 END * CASE WHEN strlen(term) > 10 THEN 1.1::DOUBLE WHEN strlen(term) < 3 THEN 0.8 ELSE 1 END, 6) AS weight FROM k""",
)
def query_terms(spark, sf_dir):
    return Q.terms(frames(spark)[0]).select("query_id", "term", "kind", F.round("weight", 6).alias("weight"))


@query("query_understanding")
def query_understanding(spark, sf_dir):
    """The whole chain over a set of queries; its parts are tested by hand."""
    q, d, e, s = frames(spark)
    return Q.processed(q, d, e, s).select("query_id", "corrected", "intent", "n_terms", "entities", "expansions", F.round("confidence", 6).alias("confidence"))


@query(
    "query_spelling",
    f"""WITH d(w) AS (SELECT unnest({lst(DICTIONARY)})), b AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(lower(regexp_replace(text, '[^\\w\\s]', '', 'g')), '\\s+'), lambda x: length(x) BETWEEN 4 AND 7)) AS word FROM benchmark), u AS (SELECT DISTINCT word FROM b),
    c AS (SELECT word, w AS correction, levenshtein(word, w) AS edits FROM u, d WHERE levenshtein(word, w) <= 2) SELECT word, correction, edits::INT AS edits FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY edits, correction) = 1""",
)
def query_spelling(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.regexp_replace("text", r"[^\w\s]", ""))).alias("word")).where(F.char_length("word").between(4, 7))
    return Q.spelling(w, frames(spark)[1])


@query(
    "query_spelling_whole",
    f"""WITH d(w) AS (SELECT unnest({lst(DICTIONARY)})), b AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(lower(regexp_replace(text, '[^\\w\\s]', '', 'g')), '\\s+'), lambda x: x <> '')) AS word FROM benchmark), u AS (SELECT DISTINCT word FROM b),
    c AS (SELECT word, w AS correction, levenshtein(word, w) AS edits FROM u, d WHERE levenshtein(word, w) <= 2) SELECT word, correction, edits::INT AS edits FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY edits, correction) = 1""",
)
def query_spelling_whole(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.regexp_replace("text", r"[^\w\s]", ""))).alias("word"))
    return Q.spelling(w, frames(spark)[1])


def results(spark, sf_dir):
    """Documents as results of sources: title the first 60 characters, url by id, score by length."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.concat(F.lit("https://e/"), (F.col("doc_id") % 50).cast("string")).alias("url"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"),
        ((F.col("n_chars") % 100 + 1) / 100).alias("score"), F.when(F.col("lang") == "en", 0.6).otherwise(0.4).alias("weight"), "source", "lang",
    )


_RES = "WITH r AS (SELECT doc_id, 'https://e/' || (doc_id % 50) AS url, text, (n_chars % 100 + 1) / 100 AS score, CASE WHEN lang = 'en' THEN 0.6 ELSE 0.4 END::DOUBLE AS weight FROM documents)"
_HOW = {
    "weighted_sum": "sum(weight * score)", "average": "sum(weight * score) / sum(weight)", "maximum": "max(score)", "minimum": "min(score)", "harmonic": "count(*) / sum(1 / score)", "geometric": "exp(avg(ln(score)))",
}


def _aggregate(strategy):
    @query(f"results_{strategy}", f"{_RES} SELECT url, round({_HOW[strategy]}, 6) AS score FROM r GROUP BY url")
    def run(spark, sf_dir):
        return R.aggregated(results(spark, sf_dir), strategy).select("url", F.round("score", 6).alias("score"))

    return run


for _s in _HOW:
    _aggregate(_s)


@query("results_unique_urls", f"{_RES} SELECT doc_id, url FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY score DESC, doc_id) = 1")
def results_unique_urls(spark, sf_dir):
    return R.first_of(results(spark, sf_dir), F.col("url"), [F.desc("score"), "doc_id"]).select("doc_id", "url")


@query("results_unique_content", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def results_unique_content(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("h")


@query(
    "results_quality",
    """WITH r AS (SELECT doc_id, length(text[:60]) AS t, length(text) AS c FROM documents) SELECT doc_id, round(0.3 * CASE WHEN t = 0 THEN 0 WHEN t BETWEEN 10 AND 60 THEN 1 WHEN t < 10 THEN t / 10 ELSE greatest(0.5, 1 - (t - 60) / 100) END
    + 0.4 * CASE WHEN c = 0 THEN 0 WHEN c < 100 THEN c / 100 WHEN c <= 5000 THEN 1 ELSE 0.8 END + 0.1 + 0.2, 6) AS quality FROM r""",
)
def results_quality(spark, sf_dir):
    return results(spark, sf_dir).select("doc_id", F.round(R.result_quality(F.col("title"), F.col("content"), F.col("url")), 6).alias("quality"))


@query("results_category_diversity", "WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT n / (SELECT count(*) FROM documents) AS p FROM n) SELECT round(-sum(p * log2(p)) / log2(count(*)), 6) AS diversity FROM p")
def results_category_diversity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.array("lang").alias("categories"))
    return R.category_diversity(d).select(F.round("diversity", 6).alias("diversity"))


_TFIDF = r"""WITH w AS (SELECT item_id AS doc_id, unnest(list_filter(string_split_regex(lower(regexp_replace(text, '[^\w\s]', '', 'g')), '\s+'), lambda x: x <> '')) AS term FROM benchmark), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), x AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term)), u AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS u FROM x)
SELECT a.doc_id AS a, b.doc_id AS b, round(sum(a.u * b.u), 6) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL HAVING sum(a.u * b.u) >= 0.3"""


@query("results_tfidf_pairs", _TFIDF)
def results_tfidf_pairs(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return R.tfidf_cosine(b, 0.3).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(
    "rank_rerank_features",
    f"""WITH d AS (SELECT doc_id, text, {WORDS} AS t, ['the', 'and', 'that'] AS q FROM documents) SELECT doc_id, round(len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t))), 6) AS jaccard, round(len(list_intersect(q, t)) / 3, 6) AS overlap, round(3 / len(t), 6) AS length_ratio,
    round(len(list_filter(t, lambda w: list_contains(['the', 'and', 'that'], w))) / len(t), 6) AS term_frequency FROM d""",
)
def rank_rerank_features(spark, sf_dir):
    f = R.rerank_features(F.lit("the and that"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[F.round(f[k], 6).alias(k) for k in ("jaccard", "overlap", "length_ratio", "term_frequency")])


@query(
    "rank_cascade",
    f"""WITH d AS (SELECT doc_id, lang, n_chars, {WORDS} AS t FROM documents), c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 100),
    s AS (SELECT doc_id, lang, len(list_filter(t, lambda w: w = 'the')) / len(t) AS score FROM c) SELECT doc_id, lang, round(score, 6) AS score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 10""",
)
def rank_cascade(spark, sf_dir):
    t = T.words(F.col("text"))
    exact = F.size(F.filter(t, lambda w: w == "the")) / F.size(t)
    return R.cascade(table(spark, sf_dir, "documents"), F.col("n_chars"), exact, ["lang"]).select("doc_id", "lang", F.round("score", 6).alias("score"), "rank")


@query(
    "rank_relevance",
    """WITH d AS (SELECT doc_id, n_chars, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id % 700) AS ts FROM documents), g AS (SELECT *, exp(-0.01 * (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000) AS f FROM d)
    SELECT doc_id, round(least(1, 0.4 * (0.25 * (1 + ln(n_chars % 9 + 1)) + 0.2 * 0.5 + 0.15 * 1 + 0.1 * 1) + 0.25 * 0.5 + 0.15 * f + 0.1 * 0.2 + 0.05 * 0.3 + 0.05 * 0.4), 6) AS score FROM g""",
)
def rank_relevance(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("ts", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, CAST(doc_id % 700 AS INT))"))
    text = R.text_relevance(F.col("n_chars") % 9 + 1, F.lit(0.5), F.lit(1), F.lit(1))
    fresh = R.decay(F.col("ts"), F.lit("2024-01-31").cast("timestamp"), 0.01)
    return d.select("doc_id", F.round(R.relevance(text, F.lit(0.5), fresh, F.lit(0.2), F.lit(0.3), F.lit(0.4)), 6).alias("score"))


@query(
    "quality_features",
    rf"""WITH d AS (SELECT doc_id, text, {WORDS} AS w, greatest(1, length(text)) AS n FROM documents) SELECT doc_id, length(text)::INT AS chars, len(w)::INT AS words, len(regexp_extract_all(text, '[.!?]'))::INT AS sentences, round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / n, 6) AS capitals,
    round(length(regexp_replace(text, '[^0-9]', '', 'g')) / n, 6) AS digits, round(len(list_distinct(w)) / len(w), 6) AS "distinct" FROM d""",
)
def quality_features(spark, sf_dir):
    f = C.text_features(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", f["chars"].alias("chars"), f["words"].alias("words"), f["sentences"].alias("sentences"), *[F.round(f[k], 6).alias(k) for k in ("capitals", "digits", "distinct")])


@query(
    "quality_repetition",
    f"WITH w AS (SELECT doc_id, unnest({WORDS}) AS word FROM documents), n AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL) SELECT doc_id, sum(n)::BIGINT AS words, count(*) FILTER (n > 1) AS repeated, round(max(n) / sum(n), 6) AS most FROM n GROUP BY 1",
)
def quality_repetition(spark, sf_dir):
    return C.repetition(table(spark, sf_dir, "documents")).select("doc_id", "words", "repeated", F.round("most", 6).alias("most"))


@query("quality_structure", r"""SELECT doc_id, len(regexp_extract_all(text, '[-*]'))::INT AS bullets, len(regexp_extract_all(text, '#'))::INT AS headings, len(regexp_extract_all(text, 'http'))::INT AS links, len(regexp_extract_all(text, '\n'))::INT AS lines FROM documents""")
def quality_structure(spark, sf_dir):
    f = C.structure_features(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[f[k].alias(k) for k in ("bullets", "headings", "links", "lines")])


@query("shard_hash", "SELECT doc_id, (('0x' || md5(doc_id::VARCHAR)[:15])::BIGINT % 8)::INT AS shard FROM documents")
def shard_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.hash_shard(F.col("doc_id"), 8).alias("shard"))


@query(
    "shard_ring",
    "WITH s AS (SELECT 's' || i AS s FROM range(5) r(i)), p AS (SELECT ('0x' || md5(s || ':' || i)[:15])::BIGINT AS p, s FROM s, range(100) r(i)), d AS (SELECT doc_id, ('0x' || md5(doc_id::VARCHAR)[:15])::BIGINT AS h FROM documents) SELECT doc_id, coalesce((SELECT min_by(s, p) FROM p WHERE p >= h), (SELECT min_by(s, p) FROM p)) AS shard FROM d",
)
def shard_ring(spark, sf_dir):
    return X.ring_shard(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", [f"s{i}" for i in range(5)])


@query("shard_replicas", "SELECT doc_id, [((doc_id + 1) % 8)::BIGINT, ((doc_id + 2) % 8)::BIGINT]::VARCHAR AS replicas FROM documents")
def shard_replicas(spark, sf_dir):
    r = X.replicas(F.pmod("doc_id", F.lit(8)), 8, 2)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(r.cast("array<string>"), ", "), F.lit("]")).alias("replicas"))


@query(
    "limit_fixed_window",
    """WITH RECURSIVE e AS (SELECT user_id AS key, floor(epoch(ts))::BIGINT AS t, event_id AS request_id FROM events), w AS (SELECT key, min(t) AS s FROM e GROUP BY key UNION ALL SELECT w.key, min(e.t) FROM w JOIN e ON e.key = w.key AND e.t >= w.s + 86400 GROUP BY w.key)
    SELECT e.key, request_id, row_number() OVER (PARTITION BY e.key, s ORDER BY t, request_id) <= 3 AS allowed FROM e JOIN w ON e.key = w.key AND e.t >= w.s AND e.t < w.s + 86400""",
)
def limit_fixed_window(spark, sf_dir):
    """A user's first three requests of each day-long window."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("request_id"))
    return X.fixed_window_limit(e, 3, 86_400)


@query("crawl_moving_average", "SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY ts, event_id)), lambda a, x: 0.9 * a + 0.1 * x), 6) AS ema FROM events GROUP BY user_id")
def crawl_moving_average(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("v"))
    return e.select("user_id", F.round(X.moving_average(F.col("v")), 6).alias("ema"))


@query(
    "news_category",
    "SELECT doc_id, CASE " + "greatest(" + ", ".join("+".join(f"(3 * (contains(lower(text[:60]), '{w}'))::INT + contains(lower(text), '{w}')::INT)" for w in ws) for ws in X.CATEGORIES.values()) + ") WHEN 0 THEN 'world' "
    + " ".join("WHEN " + "+".join(f"(3 * (contains(lower(text[:60]), '{w}'))::INT + contains(lower(text), '{w}')::INT)" for w in ws) + f" THEN '{k}'" for k, ws in X.CATEGORIES.items()) + " END AS category FROM documents",
)
def news_category(spark, sf_dir):
    d = results(spark, sf_dir)
    return d.select("doc_id", X.category(F.col("title"), F.col("content")).alias("category"))


@query(
    "news_flags",
    "SELECT doc_id, " + ", ".join(f"regexp_matches(lower(text), '{p}') AS {k}" for k, p in X.FLAGS.items()) + " FROM documents",
)
def news_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in X.flags(F.col("text")).items()])


@query("news_freshness", "WITH a AS (SELECT event_id, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 3600000000 AS h FROM events) SELECT event_id, CASE WHEN h <= 1 THEN 1.0 WHEN h <= 6 THEN 0.9 WHEN h <= 24 THEN 0.7 WHEN h <= 72 THEN 0.5 WHEN h <= 168 THEN 0.3 ELSE 0.1 END::DOUBLE AS f FROM a")
def news_freshness(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("last"))
    age = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3_600_000_000
    return e.crossJoin(F.broadcast(last)).select("event_id", X.news_freshness(age).alias("f"))


@query("news_article_id", "SELECT doc_id, sha256(text[:60] || text) AS id FROM documents")
def news_article_id(spark, sf_dir):
    return results(spark, sf_dir).select("doc_id", X.article_id(F.lit(None).cast("string"), F.col("title"), F.col("content")).alias("id"))


@query("kg_entities", r"""SELECT doc_id, word AS name, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS word FROM documents) WHERE regexp_matches(word, '^\p{Lu}') AND strlen(word) > 3 GROUP BY ALL""")
def kg_entities(spark, sf_dir):
    """Capitalised words of more than three bytes, as entities of a document."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("name"))
    return w.where(F.col("name").rlike(r"^\p{Lu}") & (F.octet_length("name") > 3)).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))
