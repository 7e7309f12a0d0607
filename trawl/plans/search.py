"""Queries over the inverted index."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.operators import index as ix
from trawl.plans.registry import query
from trawl.session import table

QUERY_TERMS = ["the", "and", "theand"]
_TERMS_SQL = "('the','and','theand')"
TOKENS_SQL = r"""toks AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', '', 'g'), '\s+'), lambda x: strlen(x) >= 3) AS toks FROM documents)"""
POST_SQL = TOKENS_SQL + ", post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM toks) GROUP BY term, doc_id)"


@query(
    "search_tfidf_topk",
    f"""WITH {POST_SQL}, q AS (SELECT * FROM post WHERE term IN {_TERMS_SQL}),
    df AS (SELECT term, count(*) AS df FROM q GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
    s AS (SELECT doc_id, sum((1 + ln(tf)) * ln(n / df)) AS score FROM q JOIN df USING (term), n GROUP BY doc_id ORDER BY round(score, 9) DESC, doc_id LIMIT 10)
    SELECT s.doc_id, round(score, 6) AS score, d.text[:60] AS snippet FROM s JOIN documents d USING (doc_id)""",
)
def search_tfidf_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    top = ix.tfidf_search(docs, QUERY_TERMS)
    # ten rows at most: the limit bounds the broadcast side
    return (
        docs.join(F.broadcast(top), "doc_id")
        .select("doc_id", F.round("score", 6).alias("score"), F.substring("text", 1, 60).alias("snippet"))
    )


@query(
    "search_bm25_topk",
    f"""WITH {POST_SQL}, dl AS (SELECT doc_id, len(toks) AS dl FROM toks), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    q AS (SELECT * FROM post JOIN dl USING (doc_id) WHERE term IN {_TERMS_SQL}), df AS (SELECT term, count(*) AS df FROM q GROUP BY term)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
    FROM q JOIN df USING (term), st GROUP BY doc_id ORDER BY round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) DESC, doc_id LIMIT 10""",
)
def search_bm25_topk(spark, sf_dir):
    return ix.bm25_search(table(spark, sf_dir, "documents"), QUERY_TERMS).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "index_term_stats",
    f"""WITH {POST_SQL} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, round(avg(tf), 6) AS avg_tf, max(tf) AS max_tf,
    round(ln((SELECT count(*) FROM documents) / count(*)), 6) AS idf FROM post GROUP BY term""",
)
def index_term_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    post = ix.postings(docs)
    stats = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.avg("tf").alias("avg_tf"), F.max("tf").alias("max_tf"))
    return stats.crossJoin(F.broadcast(n)).select(
        "term", "df", "cf", F.round("avg_tf", 6).alias("avg_tf"), "max_tf", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf")
    )
