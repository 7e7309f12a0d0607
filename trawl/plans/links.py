"""DuckDB SQL for resolved links, and queries over links and pages that build on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.functions import scoring as S
from trawl.operators import index as I
from trawl.operators import quality as Q
from trawl.operators import verticals as X
from trawl.plans.registry import query
from trawl.session import table
from trawl.sources import pages as P

A = r"""'(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>'"""
BARE_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
SCHEME = "[a-zA-Z][a-zA-Z0-9+.-]*"
HOST = rf"lower(regexp_extract({{0}}, '^{SCHEME}://([^/?#]*)', 1))"
# l: every link, resolved; u: the first of each (url, target)
LINKS = rf"""raw AS (SELECT page_id, url, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href, unnest(a) AS anchor FROM (SELECT page_id, url, regexp_extract_all(html, {A}, 1) AS h, regexp_extract_all(html, {A}, 2) AS a FROM pages)),
parts AS (SELECT page_id, url, pos, href, {BARE_TEXT.format('anchor')} AS anchor, regexp_extract(url, '^({SCHEME}):', 1) AS scheme, regexp_extract(url, '^({SCHEME}://[^/?#]*)', 1) AS root,
regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '(^{SCHEME}://[^/]*)$', '\1/'), '[^/]*$', '') AS folder FROM raw),
l AS (SELECT page_id, url, pos, href, anchor, regexp_replace(CASE WHEN regexp_matches(href, '^(?i)https?://') THEN href WHEN href LIKE '//%' THEN scheme || ':' || href WHEN regexp_matches(href, '^{SCHEME}:') OR href = '' OR href LIKE '#%' THEN NULL
WHEN href LIKE '/%' THEN root || href ELSE folder || href END, '[?#].*$', '') AS target FROM parts),
i AS (SELECT *, coalesce({HOST.format('target')} = {HOST.format('url')}, false) AS internal FROM l),
u AS (SELECT *, md5(url || '->' || target || ':' || anchor) AS link_id FROM i WHERE target IS NOT NULL AND target <> url QUALIFY row_number() OVER (PARTITION BY url, target ORDER BY page_id, pos) = 1)"""
KIND = "CASE WHEN regexp_matches(lower(anchor), 'home|menu|next|previous') THEN 'navigation' WHEN regexp_matches(lower(anchor), 'source|reference|cite') THEN 'reference' WHEN contains(lower(anchor), 'ad') THEN 'advertisement' WHEN internal THEN 'internal' ELSE 'content' END"
QUALITY = "greatest(0, least(1, 0.5::DOUBLE + CASE WHEN length(anchor) > 5 AND length(anchor) < 100 THEN 0.2 ELSE 0 END - CASE WHEN length(anchor) = 0 THEN 0.3 ELSE 0 END - CASE WHEN href LIKE '#%' THEN 0.1 ELSE 0 END - CASE WHEN href LIKE 'javascript:%' THEN 0.2 ELSE 0 END - CASE WHEN href LIKE 'mailto:%' THEN 0.1 ELSE 0 END))"
CONFIDENCE = "greatest(0.1, least(2, CASE WHEN length(anchor) = 0 THEN 0.3 ELSE 1.0 END * CASE WHEN contains(lower(anchor), 'click here') THEN 0.7 ELSE 1 END * CASE WHEN contains(lower(anchor), 'read more') THEN 0.7 ELSE 1 END * CASE WHEN contains(lower(anchor), 'learn more') THEN 0.7 ELSE 1 END * CASE WHEN strlen(anchor) BETWEEN 10 AND 100 THEN 1.2::DOUBLE ELSE 1 END))"
ANCHOR_QUALITY = r"(CASE WHEN contains(lower(anchor), 'click here') THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN contains(lower(anchor), 'read more') THEN 0.7 ELSE 1 END * CASE WHEN contains(lower(anchor), 'learn more') THEN 0.7 ELSE 1 END * CASE WHEN contains(lower(anchor), 'here') THEN 0.7 ELSE 1 END * CASE WHEN length(anchor) BETWEEN 11 AND 99 THEN 1.2 ELSE 1 END * CASE WHEN length(regexp_replace(anchor, '[a-zA-Z0-9_\s]', '', 'g')) > 0.3 * length(anchor) THEN 0.8 ELSE 1 END)"
BASE = "CASE kind WHEN 'navigation' THEN 0.5 WHEN 'reference' THEN 1.5 WHEN 'advertisement' THEN 0.3 WHEN 'internal' THEN 1.0 WHEN 'content' THEN 2.0 ELSE 1.0 END"


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def unique(spark, sf_dir):
    return P.unique_links(P.links(pages(spark, sf_dir)))


@query("page_links_resolved", f"WITH {LINKS} SELECT page_id, pos::INT AS pos, href, md5(anchor) AS anchor, target, internal FROM i")
def page_links_resolved(spark, sf_dir):
    return P.links(pages(spark, sf_dir)).select("page_id", "pos", "href", F.md5("anchor").alias("anchor"), "target", "internal")


@query("page_link_scores", f"WITH {LINKS} SELECT link_id, url, target, round(({QUALITY})::DOUBLE, 6) AS quality, round(({CONFIDENCE})::DOUBLE, 6) AS confidence, {KIND} AS kind FROM u")
def page_link_scores(spark, sf_dir):
    """Unique resolved links with quality, confidence and type."""
    a, h = F.col("anchor"), F.col("href")
    kind = P.link_type(a, F.col("internal")).alias("kind")
    return unique(spark, sf_dir).select("link_id", "url", "target", F.round(P.link_quality(a, h), 6).alias("quality"), F.round(P.link_confidence(a), 6).alias("confidence"), kind)


@query(
    "page_quality",
    rf"""WITH n AS (SELECT page_id, len(regexp_extract_all(html, {A}, 1)) AS n FROM pages), d AS (SELECT page_id, length({BARE_TEXT.format('html')}) AS t, len(regexp_extract_all(html, '(?i)<h[1-6][\s>]')) AS h, len(regexp_extract_all(html, '(?i)<p[\s>]')) AS p,
trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(html, '(?is)<meta[^>]*name=["'']description["''][^>]*content=["'']([^"'']*)["'']', 1) AS description, len(regexp_extract_all(html, '(?is)<img\s[^>]*?src=["'']([^"'']*)["''][^>]*>', 1)) AS images FROM pages)
SELECT page_id, round((0.4 * least(1, t / 1000) + 0.2 * least(1, (h + p) / 10) + 0.2 * (CASE WHEN title <> '' THEN 0.5 ELSE 0 END + CASE WHEN description <> '' THEN 0.5 ELSE 0 END) + 0.1 * least(1, n / 10) + 0.1 * least(1, images / 3))::DOUBLE, 6) AS quality FROM d JOIN n USING (page_id)""",
)
def page_quality(spark, sf_dir):
    p = pages(spark, sf_dir)
    n = P.links(p).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))
    d = P.document(p).join(n, "page_id", "left").fillna(0, ["n_links"])
    return P.page_quality(d).select("page_id", F.round("quality", 6).alias("quality"))


@query("link_weights", f"WITH {LINKS}, k AS (SELECT link_id, anchor, {KIND} AS kind, {ANCHOR_QUALITY} AS quality, {CONFIDENCE} AS confidence FROM u) SELECT link_id, kind, round(quality, 6) AS quality, round(greatest(0.1, least(5, {BASE} * quality * confidence))::DOUBLE, 6) AS weight FROM k")
def link_weights(spark, sf_dir):
    """Unique links with type, anchor quality and weight."""
    a = F.col("anchor")
    kind = P.link_type(a, F.col("internal"))
    return unique(spark, sf_dir).select("link_id", kind.alias("kind"), F.round(S.anchor_quality(a), 6).alias("quality"), F.round(S.link_weight(kind, S.anchor_quality(a), P.link_confidence(a)), 6).alias("weight"))


@query("link_anchor_index", rf"WITH {LINKS}, w AS (SELECT link_id, unnest(list_distinct(list_filter(string_split_regex(lower(anchor), '\s+'), lambda x: x <> ''))) AS word FROM u) SELECT word, count(*) AS n FROM w WHERE strlen(word) > 2 GROUP BY word")
def link_anchor_index(spark, sf_dir):
    """Words of more than two bytes of anchors with the number of links that have them."""
    from trawl.functions import text as T

    w = unique(spark, sf_dir).select("link_id", F.explode(F.array_distinct(T.words(F.col("anchor")))).alias("word")).where(F.octet_length("word") > 2)
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("link_page_counts", f"WITH {LINKS}, o AS (SELECT url AS id, count(*) AS n FROM u GROUP BY 1), t AS (SELECT target AS id, count(*) AS n FROM u GROUP BY 1) SELECT coalesce(o.id, t.id) AS id, coalesce(t.n, 0)::BIGINT AS in_links, coalesce(o.n, 0)::BIGINT AS out_links FROM o FULL JOIN t ON o.id = t.id")
def link_page_counts(spark, sf_dir):
    """Links in and out of every page that a link names."""
    from trawl.operators.graph import degrees

    return degrees(unique(spark, sf_dir).select(F.col("url").alias("src"), F.col("target").alias("dst"))).select("id", "in_links", "out_links")


SPAM_ANCHORS, SUSPICIOUS = r"casino|viagra|free money|the", ["spam.example", "www.theran.example.net"]


@query("link_spam", f"WITH {LINKS} SELECT link_id, regexp_matches(lower(anchor), '{SPAM_ANCHORS}') OR {HOST.format('target')} IN ('{SUSPICIOUS[0]}', '{SUSPICIOUS[1]}') AS spam FROM u")
def link_spam(spark, sf_dir):
    spam = F.lower("anchor").rlike(SPAM_ANCHORS) | P.host(F.col("target")).isin(SUSPICIOUS)
    return unique(spark, sf_dir).select("link_id", spam.alias("spam"))


@query("link_valid", f"WITH {LINKS} SELECT link_id, length(anchor) BETWEEN 2 AND 40 AND NOT contains(target, 'blog') AND contains(target, 'example') AS valid FROM u")
def link_valid(spark, sf_dir):
    """Links with an anchor of 2 to 40 characters, of allowed and not of blocked hosts."""
    t = F.col("target")
    return unique(spark, sf_dir).select("link_id", (F.char_length("anchor").between(2, 40) & ~F.contains(t, F.lit("blog")) & F.contains(t, F.lit("example"))).alias("valid"))


@query("page_document_kinds", r"""WITH d AS (SELECT html AS t FROM pages UNION ALL SELECT props FROM events UNION ALL SELECT '  <rss version="2">' UNION ALL SELECT '<feed xmlns="x">' UNION ALL SELECT '<urlset>' UNION ALL SELECT 'plain') SELECT CASE WHEN ltrim(t) LIKE '{%' OR ltrim(t) LIKE '[%' THEN 'json' WHEN contains(t, '<rss') THEN 'rss' WHEN contains(t, '<feed') THEN 'atom' WHEN contains(t, '<urlset') OR contains(t, '<sitemapindex') THEN 'sitemap' WHEN ltrim(t) LIKE '<%' THEN 'xml' ELSE 'unknown' END AS kind, count(*) AS n FROM d GROUP BY 1""")
def page_document_kinds(spark, sf_dir):
    few = spark.createDataFrame([('  <rss version="2">',), ('<feed xmlns="x">',), ("<urlset>",), ("plain",)], "t string")
    d = pages(spark, sf_dir).select(F.col("html").alias("t")).unionAll(table(spark, sf_dir, "events").select("props")).unionAll(few)
    return d.groupBy(P.document_type(F.col("t")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


HEAD = """<meta property="og:title" content="T' || page_id || '"><meta property="og:type" content="page"><meta property="og:title" content="again"><script type="application/ld+json">{"id":' || page_id || '}</script>"""


@query("page_open_graph", "SELECT page_id, 'T' || page_id AS title, 'page' AS kind, 2 AS n, '{\"id\":' || page_id || '}' AS ld FROM pages")
def page_open_graph(spark, sf_dir):
    """Properties and JSON-LD of pages with a head that holds them, one twice."""
    one, two, three = HEAD.split("' || page_id || '")
    i = F.col("page_id").cast("string")
    p = pages(spark, sf_dir).select("page_id", F.concat(F.lit(one), i, F.lit(two), i, F.lit(three), "html").alias("html")).withColumn("og", P.open_graph(F.col("html")))
    return p.select("page_id", F.col("og")["title"].alias("title"), F.col("og")["type"].alias("kind"), F.size("og").alias("n"), P.json_ld(F.col("html")).alias("ld"))


@query("quality_metadata", f"SELECT page_id, length(url) AS url_length, length(url) - length(replace(url, '/', '')) AS url_depth, CASE WHEN url LIKE 'https%' THEN 1.0 ELSE 0.0 END::DOUBLE AS has_https, length({HOST.format('url')}) AS domain_length, CASE WHEN contains({HOST.format('url')}, '.') THEN 1.0 ELSE 0.0 END::DOUBLE AS has_subdomain, (30 - page_id % 40)::DOUBLE AS content_age_days, CASE WHEN 30 - page_id % 40 < 7 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_recent FROM pages")
def quality_metadata(spark, sf_dir):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + (F.col("page_id") % 40) * 86_400)
    f = Q.metadata_features(F.col("url"), P.host(F.col("url")), at, now)
    return pages(spark, sf_dir).select("page_id", *[c.alias(k) for k, c in f.items()])


@query("blacklist_hits", r"""SELECT DISTINCT url AS value, CASE WHEN lower(regexp_extract(url, '^(?:https?://)?([^/:?#]+)', 1)) = 'www.theran.example.net' THEN 'domain' WHEN contains(lower(url), 'blog') THEN 'keyword' ELSE 'regex' END AS kind FROM pages WHERE lower(regexp_extract(url, '^(?:https?://)?([^/:?#]+)', 1)) = 'www.theran.example.net' OR contains(lower(url), 'blog') OR regexp_matches(url, '/en/[0-9]+$')""")
def blacklist_hits(spark, sf_dir):
    rules = [("domain", "WWW.theran.example.net", True), ("keyword", "Blog", True), ("regex", "/en/[0-9]+$", True), ("keyword", "http", False)]
    entries = spark.createDataFrame(rules, "type string, entry string, is_active boolean")
    return Q.blacklisted(pages(spark, sf_dir).select(F.col("url").alias("value")), entries).select("value", "kind")


@query("blacklist_normal_url", "SELECT page_id, lower(regexp_replace(regexp_replace(url || '//?a=b#c/', '[?#].*$', ''), '/+$', '')) AS u FROM pages")
def blacklist_normal_url(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", Q.normal_url(F.concat("url", F.lit("//?a=b#c/"))).alias("u"))


ROBOTS = "User-agent: *\nDisallow: /de/\nAllow: /de/1\nDisallow: /*9$ # ends so\nCrawl-delay: 2\n\nUser-agent: other\nDisallow: /\n"


@query("robots_allowed", rf"""WITH p AS (SELECT DISTINCT url, regexp_replace(url, '^{SCHEME}://[^/]*', '') AS p FROM pages) SELECT url, CASE WHEN p LIKE '/de/1%' THEN true WHEN p LIKE '/de/%' THEN false WHEN p LIKE '/%9' THEN false ELSE true END AS allowed FROM p""")
def robots_allowed(spark, sf_dir):
    """Page URLs by the rules of a robots.txt that all hosts share: the longest match decides."""
    p = pages(spark, sf_dir).select("url", P.host(F.col("url")).alias("domain"))
    rules = X.robots_rules(p.select("domain", F.lit(ROBOTS).alias("robots_txt")).distinct())
    return X.robots_allowed(p, rules)


@query("crawl_frontier", f"WITH j AS (SELECT page_id AS job_id, url, {HOST.format('url')} AS domain, page_id % 7 AS priority, page_id % 11 AS scheduled FROM pages), s AS (SELECT url FROM pages WHERE page_id % 5 = 0), o AS (SELECT * FROM j WHERE url NOT IN (SELECT url FROM s) QUALIFY row_number() OVER (PARTITION BY url ORDER BY priority DESC, scheduled, job_id) = 1) SELECT job_id, domain, row_number() OVER (PARTITION BY domain ORDER BY priority DESC, scheduled, job_id)::INT AS rank FROM o")
def crawl_frontier(spark, sf_dir):
    return X.frontier(jobs(spark, sf_dir), pages(spark, sf_dir).where("page_id % 5 = 0")).select("job_id", "domain", "rank")


def jobs(spark, sf_dir):
    return pages(spark, sf_dir).select(F.col("page_id").alias("job_id"), "url", P.host(F.col("url")).alias("domain"), (F.col("page_id") % 7).alias("priority"), (F.col("page_id") % 11).alias("scheduled"))


@query("crawl_next_jobs", f"WITH j AS (SELECT page_id AS job_id, url, {HOST.format('url')} AS domain, page_id % 7 AS priority, page_id % 11 AS scheduled FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY priority DESC, scheduled, job_id) = 1), r AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY domain ORDER BY priority DESC, scheduled, job_id) = 1) SELECT job_id, domain FROM r WHERE length(domain) % 2 = 0 ORDER BY priority DESC, scheduled, job_id LIMIT 100")
def crawl_next_jobs(spark, sf_dir):
    """The best job of each domain that has rested, a hundred at most as the scheduler's batch; hosts of odd length have not."""
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    ready = F.when(F.char_length("domain") % 2 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp")).otherwise(now)
    j = jobs(spark, sf_dir)
    domains = j.select("domain", ready.alias("last")).distinct()
    return X.next_jobs(X.frontier(j, j.limit(0)), domains, now).select("job_id", "domain")


@query("index_field_weights", rf"WITH d AS (SELECT page_id, string_split_regex(lower(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))), '\s+') AS t FROM pages) SELECT page_id, CASE WHEN list_has_any(t, ['the', 'und', 'de', 'la']) THEN 2.0 END::DOUBLE AS title, NULL::DOUBLE AS url, 1.0::DOUBLE AS content FROM d")
def index_field_weights(spark, sf_dir):
    d = P.document(pages(spark, sf_dir))
    w = I.field_weights(F.array(*[F.lit(x) for x in ("the", "und", "de", "la")]), F.col("title"), F.col("url"))
    return d.select("page_id", w.alias("w")).select("page_id", *[F.col("w")[k].alias(k) for k in ("title", "url", "content")])
