"""News and image scoring, crawl control and sharding as columns and small folds."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.functions import text as T

# fixed values: categories and their words, in the order that breaks ties
CATEGORIES = {
    "politics": "election government president senate vote policy".split(), "business": "market stock economy company trade profit".split(),
    "technology": "software computer internet data device startup".split(), "sports": "game team player season match coach".split(),
    "health": "hospital doctor disease patient vaccine medical".split(), "science": "research study scientist space climate discovery".split(),
}
FLAGS = {
    "breaking": "breaking|urgent|just in|developing", "opinion": "opinion|editorial|commentary|column", "satire": "satire|parody|humor", "press_release": "press release|announces|for immediate release",
}
COLOURS = {"red": (255, 0, 0), "green": (0, 255, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0), "orange": (255, 165, 0), "purple": (128, 0, 128), "pink": (255, 192, 203), "brown": (165, 42, 42), "black": (0, 0, 0), "white": (255, 255, 255), "gray": (128, 128, 128)}


def category(title: Column, content: Column) -> Column:
    """The category with the most hits, a title's counting three; the first of equals, world without any."""
    t, c = F.lower(title), F.lower(content)
    hits = {k: reduce(lambda a, b: a + b, [3 * F.contains(t, F.lit(w)).cast("int") + F.contains(c, F.lit(w)).cast("int") for w in ws]) for k, ws in CATEGORIES.items()}
    most = F.greatest(*hits.values())
    out = F.when(most == 0, "world")
    for k, h in hits.items():
        out = out.when(h == most, k)
    return out


def flags(text: Column) -> dict[str, Column]:
    return {k: F.lower(text).rlike(p) for k, p in FLAGS.items()}


def news_freshness(age_hours: Column) -> Column:
    return F.when(age_hours <= 1, 1.0).when(age_hours <= 6, 0.9).when(age_hours <= 24, 0.7).when(age_hours <= 72, 0.5).when(age_hours <= 168, 0.3).otherwise(0.1)


def quotes(text: Column) -> Column:
    """Quoted runs of more than ten characters."""
    return F.filter(F.regexp_extract_all(text, F.lit('"([^"]+)"'), 1), lambda q: F.char_length(q) > 10)


def statistics(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?%|\d+(?:,\d{3})+|\d+ out of \d+"), 0)


def parsed_date(text: Column) -> Column:
    """A timestamp by the first format that fits; null if none does."""
    formats = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy", "MMMM d, yyyy")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def article_id(url: Column, title: Column, content: Column) -> Column:
    return F.sha2(F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(F.concat(F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))), 256)


def colour_distance(colours: Column, to: tuple[int, int, int]) -> Column:
    """Least Euclidean distance of an array of RGB arrays from a colour; null without colours."""
    one = lambda c: F.sqrt(reduce(lambda a, b: a + b, [(c[i] - to[i]) * (c[i] - to[i]) for i in range(3)]).cast("double"))
    return F.array_min(F.transform(colours, one))


def image_filters(images: DataFrame, f: dict) -> DataFrame:
    """Images that meet every given filter: type, least width, height and quality, license, dates, colour within 100."""
    out = images
    for key, test in (
        ("type", lambda v: F.col("type") == v), ("min_width", lambda v: F.col("width") >= v), ("min_height", lambda v: F.col("height") >= v), ("min_quality", lambda v: F.col("quality") >= v),
        ("license", lambda v: F.col("license") == v), ("after", lambda v: F.col("created") >= F.lit(v)), ("before", lambda v: F.col("created") <= F.lit(v)),
        ("colour", lambda v: colour_distance(F.col("colours"), COLOURS[v]) < 100),
    ):
        if key in f:
            out = out.where(test(f[key]))
    return out


def frontier(jobs: DataFrame, seen: DataFrame) -> DataFrame:
    """New jobs, one of each URL, with their rank by priority, then schedule."""
    new = jobs.join(seen.select("url"), "url", "left_anti")
    one = new.withColumn("_n", F.row_number().over(W.partitionBy("url").orderBy(F.desc("priority"), "scheduled", "job_id"))).where("_n = 1").drop("_n")
    return one.withColumn("rank", F.row_number().over(W.partitionBy("domain").orderBy(F.desc("priority"), "scheduled", "job_id")))


def next_jobs(jobs: DataFrame, domains: DataFrame, now: Column, delay: float = 1.0, most: int = 100) -> DataFrame:
    """The first job of every domain that has rested ``delay`` seconds, best first."""
    ready = domains.where(F.unix_seconds(now) - F.unix_seconds("last") >= delay).select("domain")
    return jobs.where("rank = 1").join(ready, "domain", "left_semi").orderBy(F.desc("priority"), "scheduled", "job_id").limit(most)


def moving_average(values: Column, start: float = 0.0, keep: float = 0.9) -> Column:
    """Exponential average of an array in order."""
    return F.aggregate(values, F.lit(start), lambda a, x: keep * a + (1 - keep) * x.cast("double"))


def backoff(attempt: Column, base: float = 1.0, most: float = 3600.0) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt))


def robots_rules(robots: DataFrame) -> DataFrame:
    """(domain, agent, allow, path, delay) of robots.txt texts: one row for each rule and agent of its group."""

    def parse(batches):
        for pdf in batches:
            out = []
            for domain, text in zip(pdf["domain"], pdf["robots_txt"]):
                agents, open_ = [], False
                for line in (text or "").splitlines():
                    key, _, value = line.split("#", 1)[0].partition(":")
                    key, value = key.strip().lower(), value.strip()
                    if key == "user-agent":
                        agents = [*agents, value.lower()] if open_ else [value.lower()]
                        open_ = True
                    elif key in ("allow", "disallow", "crawl-delay"):
                        open_ = False
                        number = value.replace(".", "", 1).isdigit()
                        for a in agents:
                            if key == "crawl-delay":
                                out.append((domain, a, None, None, float(value) if number else None))
                            elif value:
                                out.append((domain, a, key == "allow", value, None))
            yield pd.DataFrame(out, columns=["domain", "agent", "allow", "path", "delay"])

    return robots.select("domain", "robots_txt").mapInPandas(parse, "domain string, agent string, allow boolean, path string, delay double")


def sitemaps(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1), lambda x: x)


def _pattern(path: Column) -> Column:
    """A rule's path as a regular expression: * is any run, a final $ the end."""
    quoted = F.regexp_replace(path, r"([\\.\[\]{}()+?^|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\$(?!$)", r"\\\$"))


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*", strict: bool = False) -> DataFrame:
    """(url, allowed): by the longest matching rule of the agent's group, or of '*' if it has none.

    An allow wins over a disallow of equal length. With ``strict``, any matching disallow blocks,
    and a URL that no rule matches is blocked where its domain has disallows.
    """
    own = rules.where((F.col("agent") == agent.lower()) & F.col("path").isNotNull())
    other = rules.where((F.col("agent") == "*") & F.col("path").isNotNull()).join(rules.where(F.col("agent") == agent.lower()).select("domain").distinct(), "domain", "left_anti")
    use = own if agent == "*" else own.unionByName(other)
    path = F.regexp_replace("url", r"^[a-zA-Z]+://[^/]*", "")
    u = urls.select("url", "domain", F.when(path == "", "/").otherwise(path).alias("p")).distinct()
    hit = u.join(use.select("domain", "allow", "path", _pattern(F.col("path")).alias("rx")), "domain", "left").withColumn("hit", F.coalesce(F.rlike(F.col("p"), F.col("rx")), F.lit(False)))
    if strict:
        a = hit.groupBy("url").agg(F.bool_or(F.col("hit") & ~F.col("allow")).alias("no"), F.bool_or(F.col("hit") & F.col("allow")).alias("yes"), F.bool_or(~F.coalesce("allow", F.lit(True))).alias("some"))
        return a.select("url", (~F.coalesce("no", F.lit(False)) & (F.coalesce("yes", F.lit(False)) | ~F.col("some"))).alias("allowed"))
    best = F.max(F.when(F.col("hit"), F.struct(F.char_length("path").alias("n"), "allow")))
    return hit.groupBy("url").agg(best.alias("b")).select("url", F.coalesce(F.col("b.allow"), F.lit(True)).alias("allowed"))


def hash_shard(key: Column, shards: int) -> Column:
    """md5 of the key modulo the number of shards, by its first 15 hex digits."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long"), F.lit(shards)).cast("int")


def ring(shards: list[str], points: int = 100) -> list[tuple[int, str]]:
    """Points of a consistent-hash ring: the first 15 hex digits of md5('shard:i')."""
    import hashlib

    return sorted((int(hashlib.md5(f"{s}:{i}".encode()).hexdigest()[:15], 16), s) for s in shards for i in range(points))


def ring_shard(rows: DataFrame, key: str, shards: list[str], points: int = 100) -> DataFrame:
    """``rows`` with shard: the owner of the first ring point at or after the key's hash, around the end.

    A binary search in the sorted points, on Arrow batches; the ring is as large as the shards make it.
    """
    r = ring(shards, points)
    names = [s for _, s in r] + [r[0][1]]
    at = [p for p, _ in r]

    @F.pandas_udf("string")
    def owner(h: pd.Series) -> pd.Series:
        return pd.Series(np.array(names, dtype=object)[np.searchsorted(np.array(at, np.int64), h.to_numpy().astype(np.int64))])

    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("long")
    return rows.withColumn("shard", owner(F.coalesce(h, F.lit(0))))


def replicas(shard: Column, n: int, r: int) -> Column:
    """The next r shards modulo n."""
    return F.transform(F.sequence(F.lit(1), F.lit(r)), lambda i: F.pmod(shard + i, F.lit(n)))


def fixed_window_limit(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(key, request_id, allowed): the first ``limit`` of a key's window, which opens at the first request
    after the last window's end.

    A gap of a window's length ends any window, so runs without such a gap are folded apart, in
    time order on Arrow batches.
    """
    order = W.partitionBy("key").orderBy("t", "request_id")
    r = requests.select("key", "request_id", F.unix_seconds("ts").alias("t"))
    new = F.when(F.col("t") - F.lag("t").over(order) >= seconds, 1).otherwise(0)
    r = r.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "request_id"])
        start, n, ok = None, 0, []
        for t in pdf["t"]:
            if start is None or t >= start + seconds:
                start, n = t, 0
            n += 1
            ok.append(n <= limit)
        return pdf[["key", "request_id"]].assign(allowed=ok)

    kind = lambda c: requests.schema[c].dataType.simpleString()
    return r.groupBy("key", F.floor(F.col("_run") / 1024)).applyInPandas(fold, f"key {kind('key')}, request_id {kind('request_id')}, allowed boolean")


def latest(changes: DataFrame, now: Column, ttl: str = "ttl") -> DataFrame:
    """The last change of every key that is neither deleted nor expired."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("value", "ts", F.col(ttl).alias("ttl"), "deleted"), F.struct("ts", "version")).alias("v"), F.max("version").alias("version"))
    alive = F.col("v.ttl").isNull() | (F.unix_seconds(now) < F.unix_seconds("v.ts") + F.col("v.ttl"))
    return last.where(~F.col("v.deleted") & alive).select("key", F.col("v.value").alias("value"), F.col("v.ts").alias("ts"), "version")


def range_shard(key: Column, shards: int) -> Column:
    """The first letter's place after a, modulo the number of shards; an empty key counts as a."""
    first = F.when(F.char_length(key) > 0, F.ascii(F.substring(F.lower(key), 1, 1))).otherwise(97)
    return F.pmod(first - 97, F.lit(shards)).cast("int")


def round_robin(rows: DataFrame, order: list[str], shards: int) -> DataFrame:
    """``rows`` with shard: 0, 1, ... in turn by ``order``.

    Rows are numbered within ranges of the order, whose sizes are added up: no task sees them all.
    """
    parts = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).drop("_n")  # a row a partition
    mine = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_mine", mine).join(F.broadcast(before), "_part").withColumn("shard", F.pmod(F.col("_before") + F.col("_mine"), F.lit(shards)).cast("int")).drop("_part", "_mine", "_before")


def scaling(stores: DataFrame, least: int, most: int, up: float, down: float) -> DataFrame:
    """One row (healthy, mean, action): up, down or stay by the healthy stores' mean connections."""
    one = stores.where("healthy").agg(F.count(F.lit(1)).alias("healthy"), F.avg("connections").alias("mean"))
    action = F.when((F.col("healthy") < most) & (F.col("mean") > up), "up").when((F.col("healthy") > least) & (F.col("mean") < down), "down").otherwise("stay")
    return one.withColumn("action", action)


def frontier_statistics(jobs: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(totals, domains): jobs done and failed with their success rate, and the domains with most requests."""
    done, failed = F.count_if(F.col("status") == "done"), F.count_if(F.col("status") == "failed")
    totals = jobs.agg(F.count(F.lit(1)).alias("scheduled"), done.alias("done"), failed.alias("failed"), F.when(done + failed > 0, done / (done + failed)).otherwise(0.0).alias("success_rate"))
    domains = jobs.groupBy("domain").agg(F.count(F.lit(1)).alias("requests")).orderBy(F.desc("requests"), "domain").limit(most)
    return totals, domains


def image_order(images: DataFrame, by: str = "relevance", most: int = 20) -> DataFrame:
    """Images ranked by relevance, popularity (the same), date, size or quality, best first."""
    key = {"relevance": F.col("score"), "popularity": F.col("score"), "date": F.col("created"), "size": F.col("width") * F.col("height"), "quality": F.col("quality")}[by]
    top = images.orderBy(F.desc(key), "image_id").limit(most)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(key), "image_id")))  # of ``most`` rows


def image_type(transparent: Column, width: Column, height: Column, edges: Column, contrast: Column) -> Column:
    """Illustration, screenshot, diagram, logo or photo by transparency, shape, edge density and contrast."""
    return (
        F.when(transparent, "illustration").when((width / height > 1.5) & (width > 1000), "screenshot").when(edges > 0.1, "diagram")
        .when((width < 500) & (height < 500) & (contrast > 50), "logo").otherwise("photo")
    )


def image_query_errors(limit: Column, offset: Column) -> Column:
    """What is wrong with a query's page, null if nothing is: limit within 1 and 100, offset 0 or more."""
    return F.when(~limit.between(1, 100), "limit").when(offset < 0, "offset")
