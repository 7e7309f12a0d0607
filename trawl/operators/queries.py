"""Query understanding: terms, spelling, intent, entities, expansion, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.functions import text as T

# fixed values: words that tell an intent, tried in this order
INTENTS = {
    "navigational": "login homepage website site official".split(),
    "commercial": "buy price cheap deal discount purchase shop order".split(),
    "local": "near nearby local location directions map".split(),
    "multimedia": "video image photo picture music audio".split(),
}
QUESTION = r"^(what|how|why|when|where|who|which|can|does|is|are)\b"


def term_type(term: Column) -> Column:
    """Number, date, boolean, wildcard, regex, phrase or keyword of a raw term."""
    return (
        F.when(term.try_cast("double").isNotNull(), "number")
        .when(term.rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{1,2}/\d{1,2}/\d{4}$|^\d{4}$"), "date")
        .when(F.upper(term).isin("AND", "OR", "NOT"), "boolean")
        .when(term.rlike(r"^/.*/$"), "regex")
        .when(term.rlike(r"[*?]"), "wildcard")
        .when(term.startswith('"') & term.endswith('"'), "phrase")
        .otherwise("keyword")
    )


def term_weight(term: Column, kind: Column) -> Column:
    base = F.when(kind == "phrase", 2.0).when(kind == "entity", 1.5).when(kind == "number", 1.2).when(kind == "date", 1.3).when(kind == "boolean", 0.5).otherwise(1.0)
    n = F.octet_length(term)
    return base * F.when(n > 10, 1.1).when(n < 3, 0.8).otherwise(1.0)


def intent(text: Column) -> Column:
    """A question by its first word, else the first list with a word of the query, else informational."""
    words = T.words(F.regexp_replace(text, r"[^\w\s]", ""))
    out = F.when(F.lower(F.trim(text)).rlike(QUESTION) | text.endswith("?"), "question")
    for name, list_ in INTENTS.items():
        out = out.when(F.arrays_overlap(words, T.array_of(list_)), name)
    return out.otherwise("informational")


def terms(queries: DataFrame) -> DataFrame:
    """(query_id, pos, term, kind, weight) of every query's raw terms; phrases in quotes stay whole."""
    raw = F.regexp_extract_all("query", F.lit(r'"[^"]*"|\S+'), 0)
    e = queries.select("query_id", F.posexplode(raw).alias("pos", "term"))
    return e.withColumn("kind", term_type(F.col("term"))).withColumn("weight", term_weight(F.col("term"), F.col("kind")))


def spelling(words: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """(word, correction, edits): the nearest dictionary word within ``most`` edits, ties to the first.

    Candidates share a deletion neighbour: two strings within k edits have a common string after at
    most k deletions from each. So the join is on equality, not over all pairs.
    """

    def neighbours(c: Column) -> Column:
        def shorter(list_: Column) -> Column:
            return F.flatten(F.transform(list_, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(w))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.char_length(w))))))

        level = F.array(c)
        out = level
        for _ in range(most):
            level = F.array_distinct(shorter(level))
            out = F.array_union(out, level)
        return out

    a = words.select("word").distinct().withColumn("_n", F.explode(neighbours(F.col("word"))))
    b = dictionary.select(F.col("word").alias("correction")).distinct().withColumn("_n", F.explode(neighbours(F.col("correction"))))
    c = a.join(b, "_n").select("word", "correction").distinct().withColumn("edits", F.levenshtein("word", "correction", most)).where("edits >= 0")
    w = W.partitionBy("word").orderBy("edits", "correction")
    return c.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def expansion(query_terms: DataFrame, synonyms: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, expansions): sorted distinct synonyms and related words of a query's terms, ``most`` of them."""
    hit = query_terms.join(synonyms.select("term", F.explode("related").alias("x")), "term")
    return hit.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set("x")), 1, most).alias("expansions"))


def confidence(n_terms: Column, corrected: Column, intent_: Column, entities: Column) -> Column:
    c = F.when(n_terms < 2, 0.7).otherwise(1.0) * F.when(corrected, 0.9).otherwise(1.0) * F.when(intent_ == "unknown", 0.8).otherwise(1.0)
    return F.least(F.lit(1.0), c * (1 + 0.1 * entities))


def processed(queries: DataFrame, dictionary: DataFrame, entities: DataFrame, synonyms: DataFrame) -> DataFrame:
    """One row a query: corrected text, intent, number of terms and entities, expansions, confidence."""
    t = terms(queries).withColumn("term", F.lower("term"))
    known = dictionary.select(F.col("word").alias("term"))
    wrong = t.where("kind = 'keyword'").join(known, "term", "left_anti").select(F.col("term").alias("word")).distinct()
    fix = spelling(wrong, dictionary).select(F.col("word").alias("term"), "correction")
    t = t.join(fix, "term", "left").join(entities.select("term", F.lit(1).alias("e")), "term", "left")
    per = t.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum(F.coalesce("e", F.lit(0))).alias("entities"), F.bool_or(F.col("correction").isNotNull()).alias("changed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("correction", "term").alias("w")))), lambda x: x["w"]), " ").alias("corrected"),
    )
    out = queries.join(per, "query_id", "left").join(expansion(t, synonyms), "query_id", "left").withColumn("intent", intent(F.col("query")))
    return out.withColumn("confidence", confidence(F.col("n_terms"), F.col("changed"), F.col("intent"), F.col("entities")))


def filters_and_boosts(intent_: Column, kinds: Column, date: Column) -> tuple[Column, Column]:
    """(filters, boosts) as maps, by intent and by the kinds of a query's terms; ``date`` is its last date term.

    What a term asks for stands over what the intent asks for.
    """
    has = lambda k: F.array_contains(kinds, k)
    title = F.when(has("entity"), 2.0).when(intent_ == "navigational", 3.0).when(intent_ == "commercial", 2.0)
    content = F.when(has("number"), 1.5).when(intent_ == "informational", 2.0)
    url = F.when(intent_ == "navigational", 2.0)
    kind = F.when(intent_ == "commercial", "product").when(intent_ == "multimedia", "multimedia")
    some = lambda **m: F.map_filter(F.create_map(*[x for k, v in m.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return some(content_type=kind, location=F.when(intent_ == "local", "local"), date_range=F.when(has("date"), date)), some(title=title, url=url, content=content)


def intent_code(text: Column) -> Column:
    """0 informational, 1 commercial, 2 navigational, by what the query contains."""
    t = F.lower(text)
    return F.when(t.rlike("what|how|why|when|where"), 0).when(t.rlike("buy|purchase|shop"), 1).otherwise(2)


def domain_specific(text: Column) -> Column:
    return F.lower(text).rlike("technical|medical|legal|scientific|academic")
