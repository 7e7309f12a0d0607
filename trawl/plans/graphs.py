"""Queries over pages, their links and other graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.operators import graph as G
from trawl.plans.registry import query
from trawl.session import table
from trawl.sources import pages as P


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@query("page_title", r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def page_title(spark, sf_dir):
    return P.document(pages(spark, sf_dir)).select("page_id", "title")


@query(
    "page_text",
    r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM pages""",
)
def page_text(spark, sf_dir):
    return P.document(pages(spark, sf_dir)).select("page_id", F.md5("text").alias("h"))


@query("page_counts", r"""SELECT page_id, md5(html) AS hash, len(regexp_extract_all(html, '(?i)<h[1-6][\s>]'))::INT AS headings, len(regexp_extract_all(html, '(?i)<p[\s>]'))::INT AS paragraphs FROM pages""")
def page_counts(spark, sf_dir):
    return P.document(pages(spark, sf_dir)).select("page_id", "hash", "headings", "paragraphs")


@query("page_links", r"""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href FROM pages) GROUP BY ALL""")
def page_links(spark, sf_dir):
    return P.links(pages(spark, sf_dir)).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query("page_hosts", r"SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def page_hosts(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(P.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def trade(spark, sf_dir):
    """Nations as vertices: links from customers' nations to their suppliers' nations, weighted by orders."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, l["l_suppkey"] == s["s_suppkey"])
    return j.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight")).where("weight >= 2")


TRADE = """e AS MATERIALIZED (SELECT c_nationkey AS src, s_nationkey AS dst, count(*)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL HAVING count(*) >= 2)"""
VERTICES = "v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) AS n FROM v)"


def _pagerank_sql(rounds, share, bias):
    steps = [f"r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank FROM v, n)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"r{i} AS MATERIALIZED (SELECT v.id, 0.15 * {bias} + 0.85 * coalesce(g, 0) AS rank FROM v CROSS JOIN n LEFT JOIN (SELECT dst, sum(rank * share) AS g FROM s JOIN r{i - 1} ON src = id GROUP BY dst) ON v.id = dst)"
        )
    return f"WITH {TRADE}, {VERTICES}, s AS MATERIALIZED (SELECT src, dst, weight / {share} OVER (PARTITION BY src) AS share FROM e), {', '.join(steps)} SELECT id, round(rank, 6) AS rank FROM r{rounds}"


@query("graph_pagerank", _pagerank_sql(5, "count(*)", "1.0 / n"))
def graph_pagerank(spark, sf_dir):
    """Five rounds by link counts; with raw weights the ranks need not sum to one."""
    return G.pagerank(trade(spark, sf_dir), rounds=5, eps=0.0).select("id", F.round("rank", 6).alias("rank"))


@query("graph_pagerank_normalised", _pagerank_sql(10, "sum(weight)", "1.0 / n"))
def graph_pagerank_normalised(spark, sf_dir):
    return G.pagerank(trade(spark, sf_dir), rounds=10, eps=0.0, normalised=True).select("id", F.round("rank", 6).alias("rank"))


@query("graph_pagerank_topic", _pagerank_sql(10, "sum(weight)", "CASE WHEN v.id IN (1, 2) THEN 0.5 ELSE 0 END"))
def graph_pagerank_topic(spark, sf_dir):
    topic = spark.createDataFrame([(1, 1.0), (2, 1.0)], "id int, bias double")
    return G.pagerank(trade(spark, sf_dir), rounds=10, eps=0.0, normalised=True, teleport=topic).select("id", F.round("rank", 6).alias("rank"))


def _hits_sql(rounds):
    steps = ["h0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS hub FROM v)"]
    for i in range(1, rounds + 1):
        steps.append(f"x{i} AS MATERIALIZED (SELECT v.id, coalesce(a, 0) AS a FROM v LEFT JOIN (SELECT dst, sum(hub) AS a FROM e JOIN h{i - 1} ON src = id GROUP BY dst) ON v.id = dst)")
        steps.append(f"a{i} AS MATERIALIZED (SELECT id, a / (SELECT sqrt(sum(a * a)) FROM x{i}) AS authority FROM x{i})")
        steps.append(f"y{i} AS MATERIALIZED (SELECT v.id, coalesce(h, 0) AS h FROM v LEFT JOIN (SELECT src, sum(authority) AS h FROM e JOIN a{i} ON dst = id GROUP BY src) ON v.id = src)")
        steps.append(f"h{i} AS MATERIALIZED (SELECT id, h / (SELECT sqrt(sum(h * h)) FROM y{i}) AS hub FROM y{i})")
    return f"WITH {TRADE}, {VERTICES}, {', '.join(steps)} SELECT id, round(hub, 6) AS hub, round(authority, 6) AS authority FROM h{rounds} JOIN a{rounds} USING (id)"


@query("graph_hits", _hits_sql(4))
def graph_hits(spark, sf_dir):
    return G.hits(trade(spark, sf_dir), rounds=4).select("id", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


@query(
    "graph_metrics",
    f"WITH {TRADE}, d AS (SELECT id, sum(i) AS i, sum(o) AS o FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id) SELECT count(*) AS vertices, sum(o)::BIGINT AS edges, max(i)::BIGINT AS max_in, max(o)::BIGINT AS max_out, round(sum(o) / count(*), 6) AS mean_degree, round(sum(o) / (count(*) * (count(*) - 1)), 6) AS density FROM d",
)
def graph_metrics(spark, sf_dir):
    return G.metrics(trade(spark, sf_dir)).select("vertices", "edges", "max_in", "max_out", F.round("mean_degree", 6).alias("mean_degree"), F.round("density", 6).alias("density"))


@query(
    "graph_clustering",
    f"WITH {TRADE}, u AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), d AS (SELECT src, count(*) AS d FROM u GROUP BY 1), t AS (SELECT a.src, count(*) AS t FROM u a JOIN u b ON a.dst = b.src JOIN u c ON c.src = a.src AND c.dst = b.dst GROUP BY 1) SELECT d.src AS id, round(CASE WHEN d > 1 THEN coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 6) AS coefficient FROM d LEFT JOIN t USING (src)",
)
def graph_clustering(spark, sf_dir):
    return G.clustering(trade(spark, sf_dir)).select("id", F.round("coefficient", 6).alias("coefficient"))


def _lpa_sql(rounds):
    steps = ["l0 AS MATERIALIZED (SELECT id, id AS label FROM v)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"l{i} AS MATERIALIZED (SELECT v.id, coalesce(b.label, l.label) AS label FROM v JOIN l{i - 1} l USING (id) LEFT JOIN (SELECT src, label FROM (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS k FROM b JOIN l{i - 1} ON dst = id GROUP BY src, label) WHERE k = 1) b ON v.id = b.src)"
        )
    return f"WITH {TRADE}, {VERTICES}, b AS MATERIALIZED (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), {', '.join(steps)} SELECT * FROM l{rounds}"


@query("graph_label_propagation", _lpa_sql(3))
def graph_label_propagation(spark, sf_dir):
    return G.label_propagation(trade(spark, sf_dir), rounds=3)


@query(
    "graph_modularity",
    f"WITH {TRADE}, x AS (SELECT * FROM e WHERE src <> dst), l AS (SELECT n_nationkey AS id, n_regionkey AS label FROM nation), m AS (SELECT sum(weight) AS m FROM x), i AS (SELECT a.label, sum(weight) AS w FROM x JOIN l a ON src = a.id JOIN l b ON dst = b.id WHERE a.label = b.label GROUP BY 1), d AS (SELECT label, sum(weight) AS d FROM (SELECT src AS id, weight FROM x UNION ALL SELECT dst, weight FROM x) JOIN l USING (id) GROUP BY 1) SELECT round(sum(coalesce(w, 0) / m - (d / (2 * m)) * (d / (2 * m))), 6) AS modularity FROM d LEFT JOIN i USING (label), m",
)
def graph_modularity(spark, sf_dir):
    label = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("label"))
    return G.modularity(trade(spark, sf_dir), label).select(F.round("modularity", 6).alias("modularity"))


@query("graph_local_moves")
def graph_local_moves(spark, sf_dir):
    """Modularity optimisation; tested to improve on singletons and to part cliques."""
    return G.local_moves(trade(spark, sf_dir))


@query(
    "graph_shortest_paths",
    f"WITH RECURSIVE {TRADE}, r AS (SELECT min(src) AS id, 0 AS distance FROM e UNION SELECT e.dst, r.distance + 1 FROM r JOIN e ON e.src = r.id WHERE r.distance < 6) SELECT id, min(distance) AS distance FROM r GROUP BY id",
)
def graph_shortest_paths(spark, sf_dir):
    e = trade(spark, sf_dir)
    return G.shortest_paths(e, e.agg(F.min("src")).first()[0], rounds=6)
