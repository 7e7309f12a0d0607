"""Score formulas, explanations and structure extraction as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions import text as T

# fixed values: emoji and their scores
EMOJI = {"😀": 0.8, "😃": 0.8, "😄": 0.9, "😊": 0.7, "😍": 0.9, "👍": 0.6, "❤": 0.9, "🙂": 0.4, "😐": 0.0, "🙁": -0.4, "😢": -0.7, "😭": -0.8, "😡": -0.9, "👎": -0.6, "😠": -0.8, "💔": -0.8}
CREDIBLE = "reuters.com apnews.com bbc.com nature.com".split()
DOUBTFUL = "theonion.com infowars.com".split()


def emoji_words(text: Column) -> Column:
    """Emoji as POSITIVE_EMOJI (above 0.5), NEGATIVE_EMOJI (below -0.5) or NEUTRAL_EMOJI."""
    for e, s in EMOJI.items():
        word = "POSITIVE" if s > 0.5 else "NEGATIVE" if s < -0.5 else "NEUTRAL"
        text = F.replace(text, F.lit(e), F.lit(f" {word}_EMOJI "))
    return text


def social_clean(text: Column) -> Column:
    """Lower case without links, mentions and hashtags; emoji as words; single blanks."""
    t = emoji_words(F.lower(text))
    return T.squeeze(F.regexp_replace(t, r"https?://\S+|@\w+|#\w+", ""))


def token_kinds(text: Column) -> Column:
    """array<struct<token, kind, at>>: words, numbers and marks with their order."""
    raw = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"), 0)
    kind = lambda t: F.when(t.rlike(r"^\p{L}"), "word").when(t.rlike(r"^\p{N}"), "number").otherwise("mark")
    return F.transform(raw, lambda t, i: F.struct(t.alias("token"), kind(t).alias("kind"), i.alias("at")))


def intent_scores(features: dict[str, Column], weights: dict[str, dict[str, float]], bias: dict[str, float]) -> Column:
    """The intent of greatest bias + sum of weights * features, ties to the first by name."""
    s = [F.struct((F.lit(bias.get(k, 0.0)) + reduce(lambda a, b: a + b, [features[f] * w.get(f, 0.0) for f in features])).alias("s"), F.lit(k).alias("k")) for k, w in sorted(weights.items(), reverse=True)]
    return F.greatest(*s)["k"]


def translated(text: Column, memory: dict[str, str], terms: dict[str, str], target: str) -> Column:
    """The memory's translation, else the text with terms replaced, marked with its target: no model is bound."""
    out = reduce(lambda t, kv: F.regexp_replace(t, rf"(?i)\b{kv[0]}\b", kv[1]), terms.items(), text)
    m = F.create_map(*[x for k, v in memory.items() for x in (F.lit(k), F.lit(v))]) if memory else None
    draft = F.concat(F.lit(f"[{target}] "), out)
    return F.coalesce(F.try_element_at(m, text), draft) if m is not None else draft


def translation_confidence(source: Column, target: Column) -> Column:
    r = F.octet_length(target) / F.greatest(F.lit(1), F.octet_length(source))
    return F.when((r > 0.5) & (r < 2.0), 0.8).otherwise(0.6)


def embedding_quality(text: Column, magnitude: Column) -> Column:
    """1, times 0.8 below 50 bytes, 0.9 above 1000, 0.7 for a magnitude outside 0.1 to 10, and complexity; 1 at most."""
    n = F.octet_length(text)
    q = F.when(n < 50, 0.8).when(n > 1000, 0.9).otherwise(1.0) * F.when((magnitude < 0.1) | (magnitude > 10), 0.7).otherwise(1.0)
    return F.least(F.lit(1.0), q * T.complexity(text))


def personalised(score: Column, personal: Column) -> Column:
    return F.when(personal.isNotNull(), 0.7 * score + 0.3 * personal).otherwise(score)


def interest(interests: Column, categories: Column) -> Column:
    """Share of a user's interests among a document's categories."""
    return F.when(F.size(interests) > 0, F.size(F.array_intersect(interests, categories)) / F.size(interests)).otherwise(0.0)


def explained(rules: list[tuple[Column, str]]) -> Column:
    """The texts of the rules that hold, joined by '; '."""
    return F.concat_ws("; ", *[F.when(c, t) for c, t in rules])


def credibility(host: Column, author: Column, date: Column, text: Column) -> Column:
    """high or low for listed sources; else by how many of author, date, citation and quotation there are."""
    n = reduce(lambda a, b: a + b, [x.cast("int") for x in (F.coalesce(author, F.lit("")) != "", date.isNotNull(), F.lower(text).rlike("according to|study|report"), F.contains(text, F.lit('"')))])
    return F.when(host.isin(CREDIBLE), "high").when(host.isin(DOUBTFUL), "low").when(n >= 3, "high").when(n >= 2, "medium").otherwise("low")


def news_quality(text: Column) -> Column:
    """0.3 for 300 to 2000 words (0.15 beyond 100), 0.2 for three paragraphs, 0.2 a quotation, 0.1 a number, 0.2 readability."""
    n = F.size(T.words(text))
    paragraphs = F.size(F.filter(F.split(text, r"\n+"), lambda p: F.trim(p) != ""))
    return (
        F.when(n.between(300, 2000), 0.3).when(n >= 100, 0.15).otherwise(0.0) + F.when(paragraphs >= 3, 0.2).otherwise(0.0) + F.when(F.contains(text, F.lit('"')), 0.2).otherwise(0.0)
        + F.when(text.rlike(r"[0-9]"), 0.1).otherwise(0.0) + 0.2 * T.news_readability(text)
    )


def contextual(location: Column, language: Column, mobile: Column, at: Column, kind: Column) -> Column:
    """Half location and language, a tenth for a mobile match, 0.3 for news in business hours, 0.2 for entertainment at weekends; 1 at most."""
    hour, day = F.hour(at), F.weekday(at)
    s = 0.25 * location + 0.25 * language + F.when(mobile, 0.1).otherwise(0.0)
    s = s + F.when((kind == "news") & hour.between(9, 17) & (day < 5), 0.3).otherwise(0.0) + F.when((kind == "entertainment") & (day >= 5), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), s)


def behaviour(engagement: Column, social: Column, backlinks: Column, authority: Column) -> Column:
    return 0.08 * engagement + 0.05 * social + 0.07 * F.log(backlinks + 1) + 0.10 * authority


def document_quality(pagerank: Column, ctr: Column, bounce: Column, seconds: Column, quality: Column) -> Column:
    return 0.15 * pagerank + 0.08 * ctr + 0.05 * (1 - bounce) + 0.05 * F.least(F.lit(1.0), seconds / 300) + 0.10 * quality


def bm25_fixed(tf: Column, length: Column, mean: float = 1000.0, k1: float = 1.2, b: float = 0.75, n: float = 1e6, df: float = 1000.0) -> Column:
    """A term's BM25 with an assumed corpus, for scoring a text without an index."""
    import math

    return math.log((n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def outline(html: Column) -> dict[str, Column]:
    """Headings, list items, quotations and code of a page, as arrays of texts; counts of tables, forms, scripts, styles."""
    inner = lambda tag: F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), 1), lambda x: T.squeeze(F.regexp_replace(x, r"(?s)<[^>]*>", " ")))
    count = lambda tag: F.regexp_count(html, F.lit(rf"(?i)<{tag}[\s>]"))
    return {
        "headings": F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h\1>"), 2), lambda x: T.squeeze(F.regexp_replace(x, r"(?s)<[^>]*>", " "))),
        "items": inner("li"), "quotes": inner("blockquote"), "code": inner("code"), "paragraphs": inner("p"),
        "n_tables": count("table"), "n_forms": count("form"), "n_scripts": count("script"), "n_styles": count("style"),
    }


def image_quality(alt: Column, title: Column, width: Column, height: Column) -> Column:
    a = width / height
    return 0.5 + F.when(F.char_length(alt) > 0, 0.3).otherwise(0.0) + F.when(F.char_length(alt) > 10, 0.1).otherwise(0.0) + F.when(F.char_length(title) > 0, 0.1).otherwise(0.0) + F.when((a > 0.5) & (a < 2), 0.1).otherwise(0.0)


def anchor_quality(anchor: Column) -> Column:
    """1, times 0.7 for each generic phrase, 1.2 for 11 to 99 characters, 0.8 if over 30 % are marks."""
    s = F.lit(1.0)
    for g in ("click here", "read more", "learn more", "here"):
        s = s * F.when(F.contains(F.lower(anchor), F.lit(g)), 0.7).otherwise(1.0)
    n = F.char_length(anchor)
    return s * F.when(n.between(11, 99), 1.2).otherwise(1.0) * F.when(T.count_of(anchor, r"[^\w\s]") > 0.3 * n, 0.8).otherwise(1.0)


LINK_BASE = {"navigation": 0.5, "reference": 1.5, "advertisement": 0.3, "internal": 1.0, "content": 2.0}  # fixed values


def link_weight(kind: Column, quality: Column, confidence: Column) -> Column:
    base = reduce(lambda a, kv: a.when(kind == kv[0], kv[1]), list(LINK_BASE.items())[1:], F.when(kind == "navigation", 0.5)).otherwise(1.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(5.0), base * quality * confidence))
