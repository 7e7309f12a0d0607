"""Web pages: extraction by patterns, links, link scores, URL forms, structured documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: patterns of markup
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
META = r"""(?is)<meta[^>]*name=["']{0}["'][^>]*content=["']([^"']*)["']"""
CANONICAL = r"""(?is)<link[^>]*rel=["']canonical["'][^>]*href=["']([^"']*)["']"""
OG = r"""(?is)<meta[^>]*property=["']og:([^"']+)["'][^>]*content=["']([^"']*)["']"""
JSON_LD = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
ANCHOR = r"""(?is)<a\s[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""
IMAGE = r"""(?is)<img\s[^>]*?src=["']([^"']*)["'][^>]*>"""


def tag_free(html: Column) -> Column:
    """Without scripts, styles, comments and tags; single blanks."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def document(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, description, canonical, text, hash, headings, paragraphs, images) of every page."""
    h = F.col("html")
    return pages.select(
        "page_id", "url", F.trim(F.regexp_extract(h, TITLE, 1)).alias("title"), F.regexp_extract(h, META.format("description"), 1).alias("description"),
        F.regexp_extract(h, CANONICAL, 1).alias("canonical"), tag_free(h).alias("text"), F.md5(h).alias("hash"),
        F.regexp_count(h, F.lit(r"(?i)<h[1-6][\s>]")).alias("headings"), F.regexp_count(h, F.lit(r"(?i)<p[\s>]")).alias("paragraphs"),
        F.size(F.regexp_extract_all(h, F.lit(IMAGE), 1)).alias("images"),
    )


def open_graph(html: Column) -> Column:
    """Map of og: properties; the first of repeated ones stands."""
    keys, values = F.regexp_extract_all(html, F.lit(OG), 1), F.regexp_extract_all(html, F.lit(OG), 2)
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.when(F.map_contains_key(m, e["k"]), m).otherwise(F.map_concat(m, F.create_map(e["k"], e["v"]))))


def json_ld(html: Column) -> Column:
    return F.array_join(F.regexp_extract_all(html, F.lit(JSON_LD), 1), "\n")


def attribute(tag: Column, name: str) -> Column:
    """A quoted attribute of an opening tag; empty if it has none."""
    return F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1)


def _elements(html: Column, tag: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{tag})(?:\s[^>]*)?>(.*?)</(?:{tag})>"), group)


def tables(html: Column) -> Column:
    """Tables as arrays of rows of cell texts; a table within a table ends the outer one."""
    row = lambda r: F.transform(_elements(r, "td|th"), tag_free)
    return F.transform(_elements(html, "table"), lambda t: F.transform(_elements(t, "tr"), row))


def forms(html: Column) -> Column:
    """Forms as (action, method, fields of name and type); get and text where nothing is said."""
    kind = lambda i: F.when(attribute(i, "type") != "", F.lower(attribute(i, "type"))).when(i.rlike("(?i)^<input"), "text").otherwise(F.lower(F.regexp_extract(i, r"^<(\w+)", 1)))
    fields = lambda f: F.transform(F.regexp_extract_all(f, F.lit(r"(?is)<(?:input|select|textarea)[\s>][^>]*>?"), 0), lambda i: F.struct(attribute(i, "name").alias("name"), kind(i).alias("type")))
    method = lambda f: F.when(F.lower(attribute(F.regexp_extract(f, r"(?is)^<form[^>]*>", 0), "method")) == "post", "post").otherwise("get")
    one = lambda f: F.struct(attribute(F.regexp_extract(f, r"(?is)^<form[^>]*>", 0), "action").alias("action"), method(f).alias("method"), fields(f).alias("fields"))
    return F.transform(_elements(html, "form", 0), one)


def images(html: Column) -> Column:
    """Images with a source as (src, alt, title, width, height); sizes null where they are no numbers."""
    size = lambda i, n: F.when(attribute(i, n).rlike(r"^\d{1,9}$"), attribute(i, n)).cast("int")
    one = lambda i: F.struct(attribute(i, "src").alias("src"), attribute(i, "alt").alias("alt"), attribute(i, "title").alias("title"), size(i, "width").alias("width"), size(i, "height").alias("height"))
    return F.transform(F.regexp_extract_all(html, F.lit(IMAGE), 0), one)


def scripts(html: Column) -> Column:
    """Sources of scripts, in order; empty for one in the page."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>"), 0), lambda s: attribute(s, "src"))


def metadata(html: Column) -> Column:
    """Entries (name or property in lower case, content) of meta tags that have both, in order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), 0)
    name = lambda t: F.when(attribute(t, "name") != "", attribute(t, "name")).otherwise(attribute(t, "property"))
    both = F.transform(tags, lambda t: F.struct(F.lower(name(t)).alias("name"), attribute(t, "content").alias("content")))
    return F.filter(both, lambda m: (m["name"] != "") & (m["content"] != ""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def bare(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def resolved(href: Column, base: Column) -> Column:
    """An absolute URL for absolute, scheme-relative, rooted and relative links; null for others."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(bare(base), r"(^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)$", "$1/")
    folder = F.regexp_replace(folder, r"[^/]*$", "")
    raw = (
        F.when(href.rlike(r"^(?i)https?://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | (href == "") | href.startswith("#"), F.lit(None))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(folder, href))
    )
    return bare(raw)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, anchor, target, internal): every link of every page, resolved."""
    zipped = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), 1).alias("href"), F.regexp_extract_all("html", F.lit(ANCHOR), 2).alias("anchor"))
    e = pages.select("page_id", "url", F.posexplode(zipped).alias("pos", "l")).select(
        "page_id", "url", "pos", F.col("l.href").alias("href"), tag_free(F.col("l.anchor")).alias("anchor")
    )
    e = e.withColumn("target", resolved(F.col("href"), F.col("url")))
    return e.withColumn("internal", F.coalesce(host(F.col("target")) == host(F.col("url")), F.lit(False)))


GENERIC = ["click here", "read more", "learn more", "here", "more", "link"]  # fixed values: anchors that say nothing


def link_quality(anchor: Column, href: Column) -> Column:
    """0.5, with 0.2 for 6 to 99 characters, less 0.3 empty, 0.1 '#', 0.2 javascript:, 0.1 mailto:, within 0 and 1."""
    n = F.char_length(anchor)
    s = (
        0.5 + F.when((n > 5) & (n < 100), 0.2).otherwise(0.0) - F.when(n == 0, 0.3).otherwise(0.0) - F.when(href.startswith("#"), 0.1).otherwise(0.0)
        - F.when(href.startswith("javascript:"), 0.2).otherwise(0.0) - F.when(href.startswith("mailto:"), 0.1).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def link_confidence(anchor: Column) -> Column:
    """0.3 without text, 0.7 for each generic phrase in it, 1.2 for 10 to 100 bytes; within 0.1 and 2."""
    s = F.when(F.char_length(anchor) == 0, 0.3).otherwise(1.0)
    for g in GENERIC[:3]:
        s = s * F.when(F.contains(F.lower(anchor), F.lit(g)), 0.7).otherwise(1.0)
    s = s * F.when(F.octet_length(anchor).between(10, 100), 1.2).otherwise(1.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(2.0), s))


def link_type(anchor: Column, internal: Column) -> Column:
    """Navigation, reference and advertising words of the anchor come before inside and outside."""
    a = F.lower(anchor)
    return (
        F.when(a.rlike("home|menu|next|previous"), "navigation").when(a.rlike("source|reference|cite"), "reference").when(F.contains(a, F.lit("ad")), "advertisement")
        .when(internal, "internal").otherwise("content")
    )


def unique_links(found: DataFrame) -> DataFrame:
    """The first link of each (url, target), with id md5(url->target:anchor); no self-links."""
    w = W.partitionBy("url", "target").orderBy("page_id", "pos")
    u = found.where("target IS NOT NULL AND target <> url").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return u.withColumn("link_id", F.md5(F.concat("url", F.lit("->"), "target", F.lit(":"), "anchor")))


def document_type(text: Column) -> Column:
    """xml, rss, atom, sitemap, json or unknown by what a document begins with."""
    t = F.ltrim(text)
    return (
        F.when(t.startswith("{") | t.startswith("["), "json").when(F.contains(t, F.lit("<rss")), "rss").when(F.contains(t, F.lit("<feed")), "atom")
        .when(F.contains(t, F.lit("<urlset")) | F.contains(t, F.lit("<sitemapindex")), "sitemap").when(t.startswith("<"), "xml").otherwise("unknown")
    )


def page_quality(doc: DataFrame) -> DataFrame:
    """0.4 text, 0.2 structure, 0.2 metadata, 0.1 links, 0.1 images, each within 0 and 1; needs n_links."""
    clip = lambda c: F.least(F.lit(1.0), c)
    text = clip(F.char_length("text") / 1000)
    structure = clip((F.col("headings") + F.col("paragraphs")) / 10)
    meta = F.when(F.col("title") != "", 0.5).otherwise(0.0) + F.when(F.col("description") != "", 0.5).otherwise(0.0)
    return doc.withColumn("quality", 0.4 * text + 0.2 * structure + 0.2 * meta + 0.1 * clip(F.col("n_links") / 10) + 0.1 * clip(F.col("images") / 3))
