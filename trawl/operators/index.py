"""Inverted index: postings, term statistics and retrieval.

An index is a long DataFrame (term, doc_id, tf, ...); nothing is collected, top-k goes through
TakeOrderedAndProject, and query terms are literals or a DataFrame joined on the term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def index_tokens(text: Column, min_bytes: int = 3) -> Column:
    """Lower-case, keep letters, digits and blanks, split, keep tokens of ``min_bytes`` or more."""
    clean = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", "")
    return F.filter(F.split(clean, r"\s+"), lambda t: F.octet_length(t) >= min_bytes)


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc_id, tf): one row per distinct term of a document. Null texts have no terms."""
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.explode(index_tokens(F.col(text))).alias("term"))
        .groupBy("term", "doc_id")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def postings_with_positions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc_id, tf, positions): positions are ascending token offsets from 0."""
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(index_tokens(F.col(text))).alias("pos", "term"))
        .groupBy("term", "doc_id")
        .agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    )


def term_stats(post: DataFrame, n_docs: Column) -> DataFrame:
    """(term, df, cf, avg_tf, max_tf, idf) with idf = ln(N / df)."""
    return post.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"),
        F.sum("tf").alias("cf"),
        F.avg("tf").alias("avg_tf"),
        F.max("tf").alias("max_tf"),
        F.log(n_docs / F.count(F.lit(1))).alias("idf"),
    )


def query_postings(docs: DataFrame, terms: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings of the query's terms only; the filter on terms precedes the shuffle."""
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.explode(index_tokens(F.col(text))).alias("term"))
        .where(F.col("term").isin(terms))
        .groupBy("term", "doc_id")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def _query_counts(docs: DataFrame, terms: list[str], doc_id: str, text: str) -> DataFrame:
    """(term, doc_id, dl, s): counts of the query's terms in one pass over the texts.

    Every document also adds to one row without a term, which sums what is known of all of them;
    it is combined before the shuffle. All that is counted is one struct, so that what reads
    postings and what reads totals share the shuffle.
    """
    toks = docs.select(F.col(doc_id).alias("doc_id"), index_tokens(F.col(text)).alias("toks"))
    counts = F.transform(F.array(*[F.lit(t) for t in dict.fromkeys(terms)]), lambda t: F.struct(t.alias("term"), F.coalesce(F.size(F.filter("toks", lambda x: x == t)), F.lit(0)).alias("tf")))
    total = F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("tf"))
    cells = toks.select("doc_id", F.size("toks").alias("dl"), F.explode(F.concat(F.filter(counts, lambda c: c["tf"] > 0), F.array(total))).alias("c"))
    one = F.col("c.term").isNotNull()
    keys = cells.select(F.col("c.term").alias("term"), F.when(one, F.col("doc_id")).alias("doc_id"), F.when(one, F.col("dl")).alias("dl"), F.col("c.tf").alias("tf"), F.col("dl").alias("length"))
    return keys.groupBy("term", "doc_id", "dl").agg(F.struct(F.max(F.col("term").isNull()).alias("all"), F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("n"), F.avg("length").alias("avgdl")).alias("s"))


def _top(counts: DataFrame, weight: Column, k: int) -> DataFrame:
    """Top k of the sum over a document's terms of ``weight`` of tf, dl, df, n and avgdl; ties by doc_id."""
    post = counts.where("NOT s.all").select("term", "doc_id", "dl", F.col("s.tf").alias("tf"))
    df = post.groupBy("term").agg(F.count("tf").alias("df")).crossJoin(F.broadcast(counts.where("s.all").select("s.n", "s.avgdl")))
    # a row for each term of the query
    return post.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.sum(weight).alias("score")).orderBy(F.round("score", 9).desc(), "doc_id").limit(k)


def tfidf_search(docs: DataFrame, terms: list[str], k: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Top k of sum((1 + ln tf) * ln(N / df)), ties by doc_id; (doc_id, score)."""
    return _top(_query_counts(docs, terms, doc_id, text), (1 + F.log("tf")) * F.log(F.col("n") / F.col("df")), k)


def bm25_search(
    docs: DataFrame, terms: list[str], k: int = 10, k1: float = 1.2, b: float = 0.75, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Top k by BM25 with corpus N, df and average length; ties by doc_id."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return _top(_query_counts(docs, terms, doc_id, text), idf * tf, k)


def damped(tf: Column) -> Column:
    """A term frequency in whole logarithmic steps."""
    return F.floor(1 + F.log(tf)).cast("long")


def field_weights(terms: Column, title: Column, url: Column) -> Column:
    """Map of the fields in which one of the terms is found: title 2, url 1.5; content 1 if there are terms."""
    within = lambda field: F.arrays_overlap(terms, F.split(F.lower(field), r"\s+"))
    found = F.create_map(F.lit("title"), F.when(within(title), 2.0), F.lit("url"), F.when(within(url), 1.5), F.lit("content"), F.when(F.size(terms) > 0, 1.0))
    return F.map_filter(found, lambda k, v: v.isNotNull())


def posting_quality(term: Column, doc_quality: Column) -> Column:
    """The document's quality, halved for terms under 2 or over 50 bytes, 1.2 times for diverse characters."""
    n = F.octet_length(term)
    kinds = F.size(F.array_distinct(F.filter(F.split(term, ""), lambda c: c != "")))
    return F.when((n < 2) | (n > 50), 0.5).otherwise(1.0) * F.when(kinds / n > 0.5, 1.2).otherwise(1.0) * doc_quality
