"""Relevance scores, re-ranking features, result aggregation and diversity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.functions import text as T


def days(since: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 86_400_000_000


def decay(since: Column, now: Column, rate: float) -> Column:
    """exp(-rate * days), 1 for what is yet to come."""
    return F.exp(-rate * F.greatest(F.lit(0.0), days(since, now)))


def text_relevance(tf: Column, idf: Column, field: Column, coverage: Column) -> Column:
    return 0.25 * F.when(tf > 0, 1 + F.log(tf)).otherwise(0.0) + 0.20 * idf + 0.15 * field + 0.10 * coverage


def relevance(text: Column, quality: Column, fresh: Column, behaviour: Column, query: Column, context: Column) -> Column:
    """0.40, 0.25, 0.15, 0.10, 0.05 and 0.05 of the six groups, 1 at most."""
    return F.least(F.lit(1.0), 0.40 * text + 0.25 * quality + 0.15 * fresh + 0.10 * behaviour + 0.05 * query + 0.05 * context)


def phrase_match(query: Column, text: Column) -> Column:
    """1 if the text holds the query, 0.5 if it holds a pair of neighbours, else 0."""
    q, t = F.lower(query), F.lower(text)
    return F.when(F.contains(t, q), 1.0).when(F.exists(T.ngrams(T.words(q), 2), lambda g: F.contains(t, g)), 0.5).otherwise(0.0)


def rerank_features(query: Column, text: Column) -> dict[str, Column]:
    """Overlaps of words, characters and word pairs, length ratio and term frequency."""
    q, t = T.words(query), T.words(text)
    hits = F.size(F.array_intersect(q, t))
    return {
        "jaccard": T.jaccard(F.array_distinct(q), F.array_distinct(t)),
        "overlap": F.when(F.size(q) > 0, hits / F.size(F.array_distinct(q))).otherwise(0.0),
        "length_ratio": F.when(F.size(t) > 0, F.size(q) / F.size(t)).otherwise(0.0),
        "char_overlap": T.jaccard(F.array_distinct(F.split(F.lower(query), "")), F.array_distinct(F.split(F.lower(text), ""))),
        "bigram_overlap": T.jaccard(F.array_distinct(T.ngrams(q, 2)), F.array_distinct(T.ngrams(t, 2))),
        "term_frequency": F.when(F.size(t) > 0, F.size(F.filter(t, lambda w: F.array_contains(q, w))) / F.size(t)).otherwise(0.0),
    }


def cascade(rows: DataFrame, cheap: Column, exact: Column, by: list[str], first: int = 100, k: int = 10) -> DataFrame:
    """The k best by ``exact`` among the ``first`` best by ``cheap``, within each of ``by``."""
    a = rows.withColumn("_c", F.row_number().over(W.partitionBy(*by).orderBy(cheap.desc(), "doc_id"))).where(F.col("_c") <= first).drop("_c")
    return a.withColumn("score", exact).withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


def combined(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the scores that are present; null if none is."""
    num = reduce(lambda a, b: a + b, [F.coalesce(c * weights[k], F.lit(0.0)) for k, c in scores.items()])
    den = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), weights[k]).otherwise(0.0) for k, c in scores.items()])
    return F.when(den > 0, num / den)


def ensemble_confidence(scores: list[Column]) -> Column:
    """1 / (1 + variance) of the models' scores."""
    m = reduce(lambda a, b: a + b, scores) / len(scores)
    return 1 / (1 + reduce(lambda a, b: a + b, [(s - m) * (s - m) for s in scores]) / len(scores))


def aggregated(results: DataFrame, strategy: str = "weighted_sum") -> DataFrame:
    """(url, score) over sources with weights: weighted_sum, average, maximum, minimum, harmonic or geometric."""
    s, w = F.col("score"), F.col("weight")
    how = {
        "weighted_sum": F.sum(w * s), "average": F.sum(w * s) / F.sum(w), "maximum": F.max(s), "minimum": F.min(s),
        "harmonic": F.when(F.min(s) > 0, F.count(s) / F.sum(1 / s)).otherwise(0.0), "geometric": F.when(F.min(s) > 0, F.exp(F.avg(F.log(s)))).otherwise(0.0),
    }[strategy]
    return results.groupBy("url").agg(how.alias("score"))


def first_of(results: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key in order: exact deduplication by URL, content or title."""
    return results.withColumn("_k", key).withColumn("_n", F.row_number().over(W.partitionBy("_k").orderBy(*order))).where("_n = 1").drop("_k", "_n")


def result_quality(title: Column, content: Column, url: Column) -> Column:
    """0.3 title, 0.4 content and 0.1 URL by length bands, 0.2 for what is given."""
    t, c = F.char_length(title), F.char_length(content)
    tq = F.when(t == 0, 0.0).when(t.between(10, 60), 1.0).when(t < 10, t / 10).otherwise(F.greatest(F.lit(0.5), 1 - (t - 60) / 100))
    cq = F.when(c == 0, 0.0).when(c < 100, c / 100).when(c <= 5000, 1.0).otherwise(0.8)
    uq = F.when(url.startswith("https"), 1.0).when(url.startswith("http"), 0.8).otherwise(0.3)
    return 0.3 * tq + 0.4 * cq + 0.1 * uq + 0.2


def category_diversity(results: DataFrame) -> DataFrame:
    """One row (diversity): entropy of categories over the greatest possible, 0 for one category."""
    n = results.select(F.explode("categories").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    total = results.agg(F.count(F.lit(1)).alias("t"))
    p = F.col("n") / F.col("t")
    return n.crossJoin(F.broadcast(total)).agg(F.when(F.count(F.lit(1)) > 1, -F.sum(p * F.log2(p)) / F.log2(F.count(F.lit(1)))).otherwise(0.0).alias("diversity"))


def _word_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, words, key): words of a text in order of value, and their hash."""
    words = F.array_sort(T.words(F.regexp_replace("text", r"[^\w\s]", "")))
    return docs.select("doc_id", words.alias("words")).withColumn("key", F.sha2(F.array_join("words", " "), 256))


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every document: the least id of those with the same words."""
    w = _word_classes(docs).select("doc_id", "key")
    return w.join(w.groupBy("key").agg(F.min("doc_id").alias("class_id")), "key").select("doc_id", "class_id")


def tfidf_cosine(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, cosine) of documents whose smoothed, normalised TF-IDF vectors are that near.

    Documents of the same words are one class with one vector; pairs are between classes, by their
    least ids, and ``copies`` has the members. An inverted join with prefix filtering: in order of
    rising document frequency, the terms whose remaining norm is below ``least`` can't alone make a
    pair near, so only the terms before them are joined, and the rarest common term of a near pair
    is among those of both.
    """
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    one = _word_classes(docs).groupBy("key").agg(F.min(F.struct("doc_id", "words")).alias("d"), F.count(F.lit(1)).alias("same"))
    tf = one.select("d.doc_id", "same", F.explode("d.words").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("same").alias("same"))
    df = tf.groupBy("term").agg(F.sum("same").alias("df"))
    w = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    w = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_id"))))
    left = F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_id").orderBy(F.desc("df"), F.desc("term")))
    w = w.withColumn("left", left)
    prefix = w.where(F.col("left") >= least * least - 1e-9)
    a, b = prefix.select(F.col("doc_id").alias("a"), "term"), prefix.select(F.col("doc_id").alias("b"), "term")
    pairs = a.join(b, "term").where("a < b").select("a", "b").distinct()
    x, y = w.select(F.col("doc_id").alias("a"), "term", F.col("w").alias("x")), w.select(F.col("doc_id").alias("b"), "term", F.col("w").alias("y"))
    c = pairs.join(x, "a").join(y, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))
    return c.where(F.col("cosine") >= least)


def greedy_representatives(scored: DataFrame, pairs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Rows without a near row of higher rank: (score desc, doc_id) order, near pairs given.

    With ``members`` (doc_id, class_id), pairs are of classes, whose rows are all near each other.
    """
    s = scored.select("doc_id", "score")
    s = s.withColumn("class_id", F.col("doc_id")) if members is None else s.join(members, "doc_id")
    best = s.groupBy("class_id").agg(F.min(F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("s"), "doc_id")).alias("best"))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    side = lambda i: best.select(F.col("class_id").alias(i), F.col("best").alias(f"best_{i}"))
    lose = both.join(side("a"), "a").join(side("b"), "b").where("best_b < best_a").select(F.col("a").alias("class_id")).distinct()
    return scored.join(best.join(lose, "class_id", "left_anti").select("best.doc_id"), "doc_id", "left_semi")


def term_ratio(query: Column, content: Column) -> Column:
    """Occurrences of the query's words among the content's, over the content's words."""
    q, w = T.words(query), T.words(content)
    hits = F.aggregate(q, F.lit(0), lambda a, x: a + F.size(F.filter(w, lambda y: y == x)))
    return F.when(F.size(w) > 0, hits / F.size(w)).otherwise(0.0)


def user_features(clicks: Column, dwell: Column, satisfaction: Column, here: Column, there: Column, device: Column) -> dict[str, Column]:
    """Click history, dwell time, satisfaction (0.5 unknown), equal locations, and a device's code."""
    zero = F.lit(0.0)
    return {
        "clicks": F.coalesce(clicks, zero), "dwell": F.coalesce(dwell, zero), "satisfaction": F.coalesce(satisfaction, F.lit(0.5)),
        "location": F.when(here == there, 1.0).otherwise(0.0), "device": F.when(device == "mobile", 1).when(device == "tablet", 2).otherwise(0),
    }


def semantic_pairs(results: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, similarity) of results (id, title, content): 0.6 of the titles' and 0.4 of the contents' word Jaccard.

    Results of equal words are one class, of least id, and pairs are between classes. As contents
    add 0.4 at most, titles of a pair are alike to (least - 0.4) / 0.6: pairs meet on the rarest
    words that such a likeness can't do without.
    """
    sets = results.select("id", F.array_sort(F.array_distinct(T.words(F.col("title")))).alias("t"), F.array_sort(F.array_distinct(T.words(F.col("content")))).alias("c"))
    classes = sets.groupBy("t", "c").agg(F.min("id").alias("id"))
    share = (least - 0.4) / 0.6
    words = classes.select("id", F.size("t").alias("n"), F.explode("t").alias("w"))
    df = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(W.partitionBy("id").orderBy("df", "w"))
    prefix = words.join(df, "w").withColumn("k", place).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1)
    a, b = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "w"), prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "w")
    met = a.join(b, "w").where((F.col("a") < F.col("b")) & (F.col("na") >= share * F.col("nb") - 1e-9) & (F.col("nb") >= share * F.col("na") - 1e-9)).select("a", "b").distinct()
    x, y = (classes.select(F.col("id").alias(i), F.col("t").alias(f"t{i}"), F.col("c").alias(f"c{i}")) for i in "ab")
    both = met.join(x, "a").join(y, "b")
    s = both.select("a", "b", (0.6 * T.jaccard(F.col("ta"), F.col("tb")) + 0.4 * T.jaccard(F.col("ca"), F.col("cb"))).alias("similarity"))
    return s.where(F.col("similarity") >= least)


def fuzzy_pairs(results: DataFrame, key: str, least: float = 0.9) -> DataFrame:
    """(a, b, ratio) of different keys (of ids a < b) whose edit distance leaves ``least`` of the longer one.

    Two keys up to two edits apart become equal when each loses as many characters at most: they
    meet on what is left, however much the keys of a table have in common. Of two keys d > 2 edits
    apart, one of d + 1 equal pieces of the shorter stands unchanged in the other, shifted by d at
    most: these meet on pieces.
    """
    keys = results.where(F.char_length(key) > 0).groupBy(F.col(key).alias("s")).agg(F.min("id").alias("id")).withColumn("n", F.char_length("s"))
    edits = lambda n: F.floor(n * (1 - least) + 1e-9).cast("int")

    # characters i and j > i are lost, or one (j = i), or none (0); of a run of equal characters the first ones
    width = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a key makes hundreds of rows: no few tasks may take all keys
    few = keys.withColumn("d", edits(F.col("n"))).where("d <= 2").repartition(width, "id")
    new = lambda k: F.substring("s", k, 1) != F.substring("s", k - 1, 1)
    one = few.withColumn("i", F.explode(F.sequence(F.lit(0), F.when(F.col("d") > 0, F.col("n")).otherwise(0)))).where((F.col("i") <= 1) | new(F.col("i")))
    two = one.withColumn("j", F.explode(F.sequence("i", F.when((F.col("d") > 1) & (F.col("i") > 0), F.col("n")).otherwise(F.col("i")))))
    two = two.where((F.col("j") <= F.col("i") + 1) | new(F.col("j")))
    i, j = F.col("i"), F.col("j")
    left = F.concat(F.substring("s", F.lit(1), i - 1), F.substring("s", i + 1, j - i - 1), F.substring("s", j + 1, F.col("n")))
    left = two.select("id", F.xxhash64(left).alias("h"))
    near = left.select(F.col("id").alias("x"), "h").join(left.select(F.col("id").alias("y"), "h"), "h").where("x < y").select("x", "y").distinct()
    text = keys.select("id", "s", "n")
    near = near.join(text.toDF("x", "sx", "nx"), "x").join(text.toDF("y", "sy", "ny"), "y").withColumn("m", F.greatest("nx", "ny")).where(edits(F.col("m")) <= 2)

    # lengths of a pair differ by the edits of the longer at most: every length that may be the shorter's partner
    small = keys.withColumn("m", F.explode(F.sequence(F.col("n"), F.floor(F.col("n") / least + 1e-9).cast("int")))).withColumn("d", edits(F.col("m"))).where("d > 2 AND m - n <= d")
    begin = lambda i: F.floor(i * F.col("n") / (F.col("d") + 1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("d")), lambda i: F.struct(i.alias("i"), F.substring("s", begin(i) + 1, begin(i + 1) - begin(i)).alias("w")))
    small = small.select(F.col("id").alias("x"), F.col("s").alias("sx"), "n", "m", "d", F.explode(cut).alias("p")).select("x", "sx", "n", "m", "d", "p.*")
    sizes = F.broadcast(small.select("n", "m", "d").distinct())  # pairs of lengths
    big = keys.select(F.col("id").alias("y"), F.col("s").alias("sy"), F.col("n").alias("m")).join(sizes, "m")
    at = F.transform(F.sequence(F.lit(0), F.col("d")), lambda i: F.transform(F.sequence(-F.col("d"), F.col("d")), lambda o: F.struct(i.alias("i"), F.substring("sy", F.greatest(F.lit(1), begin(i) + 1 + o), begin(i + 1) - begin(i)).alias("w"))))
    big = big.select("y", "sy", "n", "m", F.explode(F.array_distinct(F.flatten(at))).alias("p")).select("y", "sy", "n", "m", "p.*")
    far = small.join(big, ["n", "m", "i", "w"]).where("sx <> sy AND x <> y")

    met = near.select("x", "sx", "y", "sy", "m").unionAll(far.select("x", "sx", "y", "sy", "m"))
    ratio = met.withColumn("ratio", 1 - F.levenshtein("sx", "sy") / F.col("m")).where(F.col("ratio") >= least - 1e-9)
    return ratio.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "ratio").distinct()


def duplicate_statistics(fingerprints: Column, rows: DataFrame) -> DataFrame:
    """One row: fingerprints in all, and those that more than one row has."""
    return rows.groupBy(fingerprints.alias("f")).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("fingerprints"), F.count_if(F.col("n") > 1).alias("duplicates"))
