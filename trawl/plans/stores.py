"""Queries over document stores, knowledge graphs, formats and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators import index as ix
from trawl.operators import kg as K
from trawl.operators import ml as M
from trawl.operators import store as S
from trawl.plans.registry import query
from trawl.plans.search import POST_SQL, TOKENS_SQL
from trawl.session import table
from trawl.sources import formats as X


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("search_all_terms", f"WITH {TOKENS_SQL}, t AS (SELECT doc_id, unnest(toks) AS term FROM toks) SELECT doc_id, count(*) AS tf FROM t WHERE term IN ('the', 'and', 'that') GROUP BY 1 HAVING count(DISTINCT term) = 3")
def search_all_terms(spark, sf_dir):
    return S.boolean_search(docs(spark, sf_dir), ["the", "and", "that"]).select("doc_id", "tf")


@query("search_any_term", f"WITH {TOKENS_SQL}, t AS (SELECT doc_id, unnest(toks) AS term FROM toks) SELECT doc_id, count(DISTINCT term) AS hits, count(*) AS tf FROM t WHERE term IN ('the', 'and', 'that') GROUP BY 1")
def search_any_term(spark, sf_dir):
    return S.boolean_search(docs(spark, sf_dir), ["the", "and", "that"], "any")


@query("search_page", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 10")
def search_page(spark, sf_dir):
    return S.page(S.matching(docs(spark, sf_dir), language="en").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 2, 10)


@query("search_suggestions", f"WITH {POST_SQL} SELECT term, count(*) AS df FROM post WHERE term LIKE 'the%' GROUP BY 1 ORDER BY df DESC, term LIMIT 10")
def search_suggestions(spark, sf_dir):
    return S.suggestions(ix.postings(docs(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "the")


@query("search_postings", f"WITH {TOKENS_SQL}, p AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM toks) SELECT term, doc_id, count(*) AS tf, min(pos)::BIGINT AS first, max(pos)::BIGINT AS last, floor(1 + ln(count(*)))::BIGINT AS damped FROM p GROUP BY ALL")
def search_postings(spark, sf_dir):
    p = ix.postings_with_positions(docs(spark, sf_dir))
    return p.select("term", "doc_id", "tf", F.element_at("positions", 1).cast("long").alias("first"), F.element_at("positions", -1).cast("long").alias("last"), F.floor(1 + F.log("tf")).alias("damped"))


@query("index_without_documents", f"WITH {POST_SQL} SELECT term, count(*) AS df FROM post WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def index_without_documents(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1")
    return S.without(ix.postings(docs(spark, sf_dir)), gone).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("store_current", "SELECT conv_id AS doc_id, max(turn)::BIGINT AS version, max_by(sha256(text), turn) AS checksum FROM conversations GROUP BY 1")
def store_current(spark, sf_dir):
    """Turns as versions of a document: the last of each."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("content"), F.lit("ACTIVE").alias("status"), F.col("turn").alias("version"), F.sha2("text", 256).alias("checksum"))
    return S.current(c).select("doc_id", "version", "checksum")


@query(
    "kg_relations",
    r"""WITH w AS (SELECT DISTINCT doc_id, text, unnest(string_split_regex(text, '\s+')) AS name FROM documents WHERE n_chars < 2000), e AS (SELECT doc_id, name, strlen(text[:instr(text, name) - 1]) AS at FROM w WHERE regexp_matches(name, '^\p{Lu}') AND strlen(name) > 3)
    SELECT a.doc_id, a.name AS subject, b.name AS object FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.at - a.at < 100 AND (a.at < b.at OR (a.at = b.at AND a.name < b.name))""",
)
def kg_relations(spark, sf_dir):
    """Related entities of documents that aren't long: the length is part of the query, as a filter."""
    return K.relations(K.entities(docs(spark, sf_dir).where("n_chars < 2000"))).select("doc_id", "subject", "object")


@query("kg_relations_whole")
def kg_relations_whole(spark, sf_dir):
    """Related entities of all documents; the SQL of kg_relations, a self-join, is for those under 2,000 characters."""
    return K.relations(K.entities(docs(spark, sf_dir))).select("doc_id", "subject", "object")


@query(
    "kg_linking",
    """WITH m AS (SELECT DISTINCT c_mktsegment || 'S' AS name FROM customer UNION SELECT n_name FROM nation), k AS (SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 100, 'BUILDING'), x AS (SELECT m.name, min(id) AS id FROM m JOIN k ON lower(m.name) = lower(k.name) GROUP BY 1) SELECT name, id AS entity_id FROM x""",
)
def kg_linking(spark, sf_dir):
    seg = table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.lit("S")).alias("name"))
    n = table(spark, sf_dir, "nation")
    m = seg.union(n.select("n_name")).withColumn("type", F.lit("place"))
    known = n.select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("name"), F.lit("place").alias("type")).union(spark.createDataFrame([(100, "BUILDING", "place")], "entity_id int, name string, type string"))
    return K.linked(m, known).where("how = 'exact'").select("name", "entity_id")


@query("format_json_round_trip", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) + 1 AS k FROM events")
def format_json_round_trip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (X.json_path(F.col("props"), "$.k").cast("int") + 1).alias("k"))
    return X.as_json(e).select(F.from_json("json", "event_id long, k int").alias("x")).select("x.*")


@query("ml_spam_vote")
def ml_spam_vote(spark, sf_dir):
    """Low quality by a vote of models trained on the labels; tested for accuracy."""
    d, l = docs(spark, sf_dir), table(spark, sf_dir, "labels").withColumn("bad", 1 - F.col("quality"))
    models = M.spam_models(d, l, "bad", least=50)
    return M.voted(d, models).select("doc_id", "spam", F.round("confidence", 6).alias("confidence"))


@query("ml_recommendations")
def ml_recommendations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("item"))
    return M.recommendations(e, e.select("user_id").distinct()).select("user_id", "item")


@query("ml_isolation")
def ml_isolation(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", F.hour("ts").alias("hour"))
    return M.isolation_scores(e, ["value", "hour"]).select("event_id", F.round("isolation", 6).alias("isolation"))


@query(
    "text_stems",
    r"""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents WHERE lang = 'en') SELECT doc_id, count(*) AS n FROM t WHERE w LIKE '%sses' OR w LIKE '%ies' GROUP BY 1""",
)
def text_stems(spark, sf_dir):
    """Words whose plural the stemmer shortens by rule, counted where the stem differs."""
    w = docs(spark, sf_dir).where("lang = 'en'").select("doc_id", F.explode(T.words(F.col("text"))).alias("w")).where("w LIKE '%sses' OR w LIKE '%ies'")
    s = w.withColumn("s", F.element_at(M.stemmed(F.array("w")), 1)).where("s <> w")
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
