"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.plans.registry import query
from trawl.session import table

WORDS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')"


def lst(words):
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(
    "text_query_tokens",
    r"""SELECT doc_id, len(t)::INT AS n, t[1] AS first, t[len(t)] AS last FROM (SELECT doc_id, list_filter(string_split_regex(lower(regexp_replace(text, '[^\p{L}\p{N}\s"'']', '', 'g')), '\s+'), lambda x: x <> '') AS t FROM documents)""",
)
def text_query_tokens(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", T.query_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.try_element_at("t", F.lit(1)).alias("first"), F.try_element_at("t", F.lit(-1)).alias("last"))


@query(
    "text_valid_terms",
    rf"""SELECT doc_id, len(list_filter(w, lambda t: strlen(t) BETWEEN 2 AND 100 AND length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / strlen(t) >= 0.5 AND NOT list_contains({lst(T.STOP_EN)}, t)))::INT AS n FROM (SELECT doc_id, {WORDS} AS w FROM documents)""",
)
def text_valid_terms(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(T.valid_terms(T.words(F.col("text")))).alias("n"))


@query("text_dedup_normal", r"""SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h FROM documents""")
def text_dedup_normal(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.dedup_normal(F.col("text"))).alias("h"))


@query(
    "text_dedup_strict",
    rf"""SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(lower(regexp_replace(text, '[^\w\s]', '', 'g')), '\s+'), lambda w: strlen(w) > 2 AND NOT list_contains({lst(T.STOP_EN)}, w)), ' ')) AS h FROM documents""",
)
def text_dedup_strict(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.dedup_strict(F.col("text"))).alias("h"))


@query("text_without_diacritics", """SELECT doc_id, translate(text, 'àáâãäåèéêëìíîïòóôõöùúûüýÿñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÑÇ', 'aaaaaaeeeeiiiiooooouuuuyyncAAAAAAEEEEIIIIOOOOOUUUUYNC')[:80] AS t FROM documents""")
def text_without_diacritics(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.substring(T.without_diacritics(F.col("text")), 1, 80).alias("t"))


@query("text_without_diacritics_whole", """SELECT doc_id, md5(translate(text, 'àáâãäåèéêëìíîïòóôõöùúûüýÿñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÑÇ', 'aaaaaaeeeeiiiiooooouuuuyyncAAAAAAEEEEIIIIOOOOOUUUUYNC')) AS h FROM documents""")
def text_without_diacritics_whole(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.without_diacritics(F.col("text"))).alias("h"))


@query(
    "text_typographic",
    "SELECT doc_id, md5(lower(trim(regexp_replace(replace(translate(text, '“”„‘’‚–—', '" + '"' * 3 + "''" * 3 + r"--'), '…', '...'), '\s+', ' ', 'g')))) AS h FROM documents",
)
def text_typographic(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.typographic(F.col("text"))).alias("h"))


def hits_sql():
    return ", ".join(f"len(list_intersect(d, {lst(v)})) AS {k}_" for k, v in T.FUNCTION_WORDS.items())


@query(
    "text_language",
    f"""WITH t AS (SELECT doc_id, lang, list_distinct({WORDS}) AS d FROM documents), h AS (SELECT doc_id, lang, {hits_sql()} FROM t)
    SELECT doc_id, lang, CASE WHEN greatest(en_, es_, fr_, de_) = 0 THEN 'unknown' WHEN en_ = greatest(en_, es_, fr_, de_) THEN 'en' WHEN es_ = greatest(en_, es_, fr_, de_) THEN 'es' WHEN fr_ = greatest(en_, es_, fr_, de_) THEN 'fr' ELSE 'de' END AS found FROM h""",
)
def text_language(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "lang", T.language(F.col("text")).alias("found"))


@query("text_language_share", """SELECT doc_id, CASE WHEN length(text) > 0 THEN round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text), 6) ELSE 0 END AS share FROM documents""")
def text_language_share(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(T.language_share(F.col("text")), 6).alias("share"))


@query("text_script", """SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'Latin' ELSE 'Unknown' END AS script FROM documents""")
def text_script(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.script(F.col("text")).alias("script"))


@query(
    "text_keywords",
    rf"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(regexp_replace(text, '[^\w\s]', '', 'g')), '\s+'), lambda x: length(x) > 2 AND NOT list_contains({lst(T.STOP_EN)}, x))) AS word FROM documents),
    c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL) SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word)::INT AS rank FROM c QUALIFY rank <= 20""",
)
def text_keywords(spark, sf_dir):
    w = docs(spark, sf_dir).select("doc_id", F.explode(T.words(F.regexp_replace("text", r"[^\w\s]", ""))).alias("word"))
    w = w.where((F.char_length("word") > 2) & ~F.col("word").isin(T.STOP_EN)).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return w.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "word"))).where("rank <= 20")


@query(
    "text_repeated_phrases",
    f"""WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents), g AS (SELECT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM t, (VALUES (2), (3)) AS n(k), unnest(generate_series(1, len(w) - k + 1)) AS s(i))
    SELECT doc_id, k, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 3""",
)
def text_repeated_phrases(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("w"))
    g = None
    for k in (2, 3):
        part = t.select("doc_id", F.lit(k).alias("k"), F.explode(T.ngrams(F.col("w"), k)).alias("phrase"))
        g = part if g is None else g.union(part)
    return g.groupBy("doc_id", "k", "phrase").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


SENT = r"list_filter(string_split_regex(text, '[.!?]+'), lambda s: trim(s) <> '')"


@query("text_summary", f"""SELECT doc_id, array_to_string(list_transform(({SENT})[1:3], lambda s: trim(s, ' ')), '. ') AS summary FROM documents""")
def text_summary(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.summary(F.col("text")).alias("summary"))


@query(
    "text_snippet",
    """WITH h AS (SELECT doc_id, text, text[:200] AS head FROM documents), p AS (SELECT *, 200 - instr(reverse(head), ' ') AS last FROM h)
    SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE (CASE WHEN last > 100 THEN head[:last] ELSE head END) || '...' END AS snippet FROM p""",
)
def text_snippet(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.snippet(F.col("text")).alias("snippet"))


SYL = "greatest(1, len(regexp_extract_all({0}, '[aeiouy]+')) - CASE WHEN {0} LIKE '%e' THEN 1 ELSE 0 END)"


@query(
    "text_readability",
    f"""WITH t AS (SELECT doc_id, text, {WORDS} AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, greatest(1, len(string_split(text, '.'))) AS s,
    list_sum(list_transform(w, lambda x: {SYL.format('x')})) AS syl, len(list_filter(w, lambda x: {SYL.format('x')} > 2)) AS hard FROM t)
    SELECT doc_id, round(greatest(0, least(100, 206.835 - 1.015 * (n / s) - 84.6 * (syl / n))), 6) AS flesch, round(greatest(0, 0.39 * (n / s) + 11.8 * (syl / n) - 15.59), 6) AS grade, round(greatest(0, 0.4 * (n / s + 100 * hard / n)), 6) AS fog FROM c""",
)
def text_readability(spark, sf_dir):
    flesch, grade, fog = T.readability(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.round(flesch, 6).alias("flesch"), F.round(grade, 6).alias("grade"), F.round(fog, 6).alias("fog"))


@query(
    "text_news_readability",
    f"""WITH t AS (SELECT doc_id, {WORDS} AS w, greatest(1, len({SENT})) AS s FROM documents)
    SELECT doc_id, round(greatest(0, least(1, (206.835 - 1.015 * (len(w) / s) - 84.6 * (list_sum(list_transform(w, lambda x: length(x))) / len(w))) / 100)), 6) AS r FROM t""",
)
def text_news_readability(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(T.news_readability(F.col("text")), 6).alias("r"))


@query(
    "text_complexity",
    f"""WITH t AS (SELECT doc_id, len({WORDS}) / greatest(1, len({SENT})) AS x FROM documents) SELECT doc_id, round(CASE WHEN x < 5 THEN 0.5 WHEN x > 20 THEN 1.5 ELSE 0.5 + (x - 5) / 15 END, 6) AS c FROM t""",
)
def text_complexity(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(T.complexity(F.col("text")), 6).alias("c"))


@query(
    "text_subjectivity",
    f"""WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents), c AS (SELECT doc_id, len(list_filter(w, lambda x: list_contains({lst(T.SUBJECTIVE)}, x))) / greatest(1, len(w)) AS a, len(list_filter(w, lambda x: list_contains({lst(T.OBJECTIVE)}, x))) / greatest(1, len(w)) AS b FROM t)
    SELECT doc_id, round(a / (a + b + 1e-6), 6) AS s FROM c""",
)
def text_subjectivity(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(T.subjectivity(F.col("text")), 6).alias("s"))


@query(
    "text_typed_tokens",
    " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS v FROM documents) GROUP BY doc_id" for k, p in T.PATTERNS.items()),
)
def text_typed_tokens(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", F.explode(T.typed_tokens(F.col("text"))).alias("t"))
    return t.groupBy("doc_id", F.col("t.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_char_entropy",
    """WITH c AS (SELECT doc_id, unnest(string_split(lower(text), '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM n)
    SELECT doc_id, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM s GROUP BY doc_id""",
)
def text_char_entropy(spark, sf_dir):
    n = docs(spark, sf_dir).select("doc_id", F.explode(F.split(F.lower("text"), "")).alias("ch")).where("ch <> ''").groupBy("doc_id", "ch").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy("doc_id"))
    return n.withColumn("p", p).groupBy("doc_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


@query(
    "text_benchmark_jaccard",
    f"""WITH b AS (SELECT item_id, list_distinct({WORDS}) AS w FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS j FROM b AS a JOIN b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.2""",
)
def text_benchmark_jaccard(spark, sf_dir):
    """Word Jaccard of benchmark items that share a word: an inverted join, not all pairs."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.words(F.col("text"))).alias("w"))
    word = b.select("item_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    x, y = word.alias("x"), word.alias("y")
    common = x.join(y, (F.col("x.word") == F.col("y.word")) & (F.col("x.item_id") < F.col("y.item_id"))).groupBy(
        F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")
    ).agg(F.count(F.lit(1)).alias("c"))
    j = F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))
    return common.where(j >= 0.2).select("a", "b", F.round(j, 6).alias("j"))
