"""Content quality, spam, reputation and blacklists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.functions import text as T


def level(score: Column, names=("excellent", "good", "fair", "poor", "bad")) -> Column:
    return F.when(score >= 0.8, names[0]).when(score >= 0.6, names[1]).when(score >= 0.4, names[2]).when(score >= 0.2, names[3]).otherwise(names[4])


def text_features(text: Column) -> dict[str, Column]:
    """Lengths, counts and ratios over characters, words, sentences and paragraphs."""
    n = F.char_length(text)
    w = T.words(text)
    some = F.greatest(F.lit(1), n)
    return {
        "chars": n,
        "words": F.size(w),
        "sentences": F.regexp_count(text, F.lit("[.!?]")),
        "paragraphs": F.size(F.filter(F.split(text, r"\n\n"), lambda p: F.trim(p) != "")),
        "word_length": F.when(F.size(w) > 0, F.aggregate(w, F.lit(0), lambda a, x: a + F.char_length(x)) / F.size(w)).otherwise(0.0),
        "capitals": T.count_of(text, "[A-Z]") / some,
        "digits": T.count_of(text, "[0-9]") / some,
        "marks": T.count_of(text, r"[^\w\s]") / some,
        "distinct": F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0),
    }


def structure_features(text: Column) -> dict[str, Column]:
    """Counts of markup-like characters."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    return {"headings": count("#"), "bullets": count("[-*]"), "links": count("http"), "codes": count("`"), "lines": count("\n")}


def repetition(docs: DataFrame) -> DataFrame:
    """(doc_id, words, repeated, most): words in all, words that occur more than once, and the commonest's share."""
    w = docs.select("doc_id", F.explode(T.words(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return w.groupBy("doc_id").agg(F.sum("n").alias("words"), F.count_if(F.col("n") > 1).alias("repeated"), (F.max("n") / F.sum("n")).alias("most"))


def spam_heuristic(text: Column, words=("buy now", "click here", "free money")) -> tuple[Column, Column]:
    """(score, spam): 0.3 for each of the words, spam above 0.5."""
    score = reduce(lambda a, b: a + b, [F.when(F.contains(F.lower(text), F.lit(w)), 0.3).otherwise(0.0) for w in words])
    return score, score > 0.5


def ensemble_vote(votes: dict[str, tuple[Column, Column]], weights: dict[str, float]) -> tuple[Column, Column]:
    """(spam, confidence) of weighted boolean votes with confidences."""
    total = sum(weights[k] for k in votes)
    up = reduce(lambda a, b: a + b, [F.when(v, weights[k] * c).otherwise(0.0) for k, (v, c) in votes.items()])
    down = reduce(lambda a, b: a + b, [F.when(~v, weights[k] * c).otherwise(0.0) for k, (v, c) in votes.items()])
    return up > down, F.greatest(up, down) / total


def reputation(updates: DataFrame, weights: dict[str, float], other: float = 1.0) -> DataFrame:
    """(domain, score, level): the latest score of every source, weighted."""
    last = updates.groupBy("domain", "source").agg(F.max_by("score", F.struct("ts", "event_id")).alias("score"))
    w = reduce(lambda a, k: a.when(F.col("source") == k, weights[k]), list(weights)[1:], F.when(F.col("source") == next(iter(weights)), next(iter(weights.values())))).otherwise(other)
    s = last.groupBy("domain").agg((F.sum(w * F.col("score")) / F.sum(w)).alias("score"))
    return s.withColumn("level", level(F.col("score")))


def reputation_trend(updates: DataFrame, window: int = 10) -> DataFrame:
    """Direction, strength, volatility and mean of the last ``window`` scores of each domain."""
    w = W.partitionBy("domain").orderBy("ts", "event_id").rowsBetween(1 - window, 0)
    last = W.partitionBy("domain").orderBy(F.desc("ts"), F.desc("event_id"))
    t = updates.select("domain", "score", F.first("score").over(w).alias("f"), F.stddev_pop("score").over(w).alias("volatility"), F.avg("score").over(w).alias("mean"), F.row_number().over(last).alias("k"))
    d = F.col("score") - F.col("f")
    return t.where("k = 1").select("domain", F.when(d > 0.1, "up").when(d < -0.1, "down").otherwise("stable").alias("direction"), F.abs(d).alias("strength"), "volatility", "mean")


def reputation_alerts(updates: DataFrame) -> DataFrame:
    """Drops of more than 0.2 (high beyond half the score) and rises of more than 0.3."""
    old = F.lag("score").over(W.partitionBy("domain").orderBy("ts", "event_id"))
    u = updates.withColumn("old", old)
    fall = F.col("old") - F.col("score")
    return u.where((fall > 0.2) | (fall < -0.3)).select(
        "event_id", "domain", "old", "score", F.when(fall > 0.2, "drop").otherwise("rise").alias("alert"), F.when(fall > 0.5 * F.col("old"), "high").otherwise("medium").alias("severity")
    )


# fixed values: the order in which kinds of entries are tried
BLACKLIST_ORDER = ("domain", "ip", "url", "email", "keyword", "regex")


def normal_url(url: Column) -> Column:
    """scheme://host/path without query, fragment and closing slash, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", ""))


def blacklisted(values: DataFrame, entries: DataFrame, most: int = 100_000) -> DataFrame:
    """(value, kind, entry) of the first active entry that matches, kinds in BLACKLIST_ORDER.

    Domains, addresses, URLs and e-mails are equality joins. Keywords and patterns have no key to
    join on; they are a rule set, refused beyond ``most`` entries, and broadcast.
    """
    on = entries.where("is_active")
    v = values.select("value").distinct()
    keys = {
        "domain": F.lower(F.regexp_extract("value", r"^(?:https?://)?([^/:?#]+)", 1)), "ip": F.regexp_extract("value", r"(\d+\.\d+\.\d+\.\d+)", 1),
        "url": normal_url(F.col("value")), "email": F.lower(F.regexp_extract("value", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)", 1)),
    }
    found = None
    for kind, key in keys.items():
        e = on.where(F.col("type") == kind).select((normal_url(F.col("entry")) if kind == "url" else F.lower("entry")).alias("k"), "entry")
        part = v.withColumn("k", key).join(e, "k").select("value", F.lit(kind).alias("kind"), "entry")
        found = part if found is None else found.unionByName(part)
    rules = on.where(F.col("type").isin("keyword", "regex")).select("type", "entry").limit(most + 1)
    if rules.count() > most:
        raise ValueError("too many keyword and pattern entries to broadcast")
    hit = F.when(F.col("type") == "keyword", F.contains(F.lower("value"), F.lower("entry"))).otherwise(F.rlike(F.col("value"), F.col("entry")))
    found = found.unionByName(v.join(F.broadcast(rules), hit).select("value", F.col("type").alias("kind"), "entry"))
    order = reduce(lambda a, k: a.when(F.col("kind") == k[1], k[0]), list(enumerate(BLACKLIST_ORDER))[1:], F.when(F.col("kind") == BLACKLIST_ORDER[0], 0))
    return found.groupBy("value").agg(F.min(F.struct(order.alias("o"), "entry", "kind")).alias("m")).select("value", "m.kind", "m.entry")


def metadata_features(url: Column, domain: Column, at: Column, now: Column) -> dict[str, Column]:
    """URL length, depth and scheme, domain length and dots, age in days."""
    age = (F.unix_seconds(now) - F.unix_seconds(at)) / 86_400
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "url_length": F.char_length(url), "url_depth": F.regexp_count(url, F.lit("/")), "has_https": flag(url.startswith("https")),
        "domain_length": F.char_length(domain), "has_subdomain": flag(F.contains(domain, F.lit("."))), "content_age_days": age, "is_recent": flag(age < 7),
    }


# fixed values: what is advised where a dimension is weak
ADVICE = {
    "readability": "Improve readability by using shorter sentences and simpler words",
    "accuracy": "Verify facts and ensure accuracy of information",
    "completeness": "Add more comprehensive information to cover the topic thoroughly",
    "relevance": "Ensure content is relevant to the target audience",
    "authority": "Add credible sources and author information",
    "freshness": "Update content with more recent information",
    "uniqueness": "Ensure content is original and not duplicated",
    "structure": "Improve content structure with headings and organization",
    "language_quality": "Improve grammar, spelling, and language quality",
    "factual_accuracy": "Verify factual accuracy and add citations",
}
ADVICE_OVERALL = "Consider a comprehensive content review and rewrite"


def recommendations(scores: dict[str, Column], overall: Column) -> Column:
    """Advice for every dimension below 0.3, and for an overall score below 0.5."""
    return F.array_compact(F.array(*[F.when(s < 0.3, ADVICE[k]) for k, s in scores.items()], F.when(overall < 0.5, ADVICE_OVERALL)))


def spam_explanation(f: dict[str, Column], spam: Column) -> Column:
    """Why a document was classified, from spam_words, suspicious_domains, capitals, marks, urls, repetition and authority."""
    # fixed values: texts and limits
    why = F.concat_ws(
        "; ",
        F.when(f["spam_words"] > 0, F.format_string("Contains %d spam keywords", f["spam_words"])),
        F.when(f["suspicious_domains"] > 0, F.format_string("Has %d suspicious domains", f["suspicious_domains"])),
        F.when(f["capitals"] > 0.3, "High ratio of capital letters"), F.when(f["marks"] > 0.2, "High ratio of special characters"), F.when(f["urls"] > 5, "Contains many URLs"),
        F.when(f["repetition"] > 0.5, "High word repetition"), F.when(f["authority"] < 0.3, "Low domain authority"),
    )
    return F.concat(F.when(spam, "Classified as spam: ").otherwise("Classified as legitimate: "), F.when(why == "", "Standard content analysis").otherwise(why))
