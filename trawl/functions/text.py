"""Text scalar functions as columns: tokenising, normalising, language, readability, similarity.

All stay in the JVM. Lengths are code points unless a name says bytes. Lists of words and
patterns that results depend on are fixed values and stand together below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: word lists
STOP_EN = (
    "a an and are as at be by for from has he in is it its of on that the to was were will with the this but they have had what said each which their time if"
).split()
FUNCTION_WORDS = {
    "en": "the and or but in on at to for of with by".split(),
    "es": "el la de que y a en un es se no te".split(),
    "fr": "le de et à un il être en avoir que pour".split(),
    "de": "der die und in den von zu das mit sich des auf".split(),
}
SUBJECTIVE = "think feel believe opinion seems appears probably maybe perhaps might could should would".split()
OBJECTIVE = "is are was were has have had will shall must fact data evidence proof".split()
CYRILLIC, HAN, KANA, HANGUL, ARABIC, LATIN = r"[Ѐ-ӿ]", r"[一-鿿]", r"[぀-ヿ]", r"[가-힯]", r"[؀-ۿ]", r"[A-Za-z]"


def array_of(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def words(text: Column) -> Column:
    """Lower-cased runs without blanks."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def query_tokens(text: Column) -> Column:
    """Keep letters, digits, blanks and quotes; lower-case; split on blanks."""
    return words(F.regexp_replace(text, r"""[^\p{L}\p{N}\s"']""", ""))


def valid_terms(tokens: Column, stop=STOP_EN) -> Column:
    """Terms of 2 to 100 bytes whose letters are half of their bytes or more, without stop words."""

    def ok(t):
        letters = F.char_length(F.regexp_replace(t, r"[^\p{L}]", ""))
        return F.octet_length(t).between(2, 100) & (letters / F.octet_length(t) >= 0.5) & ~F.array_contains(array_of(stop), t)

    return F.filter(tokens, ok)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def dedup_normal(text: Column) -> Column:
    """Lower-case with single blanks."""
    return squeeze(F.lower(text))


def dedup_strict(text: Column, stop=STOP_EN) -> Column:
    """Lower-case, without punctuation, stop words and words of two bytes or fewer."""
    kept = F.filter(words(F.regexp_replace(text, r"[^\w\s]", "")), lambda w: (F.octet_length(w) > 2) & ~F.array_contains(array_of(stop), w))
    return F.array_join(kept, " ")


def typographic(text: Column) -> Column:
    """Straight quotes and dashes, three dots for an ellipsis, single blanks, lower case."""
    t = F.translate(text, "“”„‘’‚–—", "\"\"\"'''--")
    return F.lower(squeeze(F.replace(t, F.lit("…"), F.lit("..."))))


def without_diacritics(text: Column) -> Column:
    return F.translate(text, "àáâãäåèéêëìíîïòóôõöùúûüýÿñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÑÇ", "aaaaaaeeeeiiiiooooouuuuyyncAAAAAAEEEEIIIIOOOOOUUUUYNC")


def count_of(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def script(text: Column) -> Column:
    """The script with the most characters; Han comes before kana, unknown without any letter."""
    kinds = [("Han", HAN), ("Kana", KANA), ("Hangul", HANGUL), ("Arabic", ARABIC), ("Cyrillic", CYRILLIC), ("Latin", LATIN)]
    counts = [(n, count_of(text, p)) for n, p in kinds]
    most = F.greatest(*[c for _, c in counts])
    out = F.when(most == 0, "Unknown")
    for n, c in counts:
        out = out.when(c == most, n)
    return out


def language(text: Column) -> Column:
    """The language with the most of its function words present, in the order en, es, fr, de; else unknown."""
    distinct = F.array_distinct(words(text))
    hits = {k: F.size(F.array_intersect(distinct, array_of(v))) for k, v in FUNCTION_WORDS.items()}
    most = F.greatest(*hits.values())
    out = F.when(most == 0, "unknown")
    for k, c in hits.items():
        out = out.when(c == most, k)
    return out


def language_share(text: Column, pattern: str = LATIN) -> Column:
    """Share of characters that belong to the language's script; above 0.8 it's reliable."""
    n = F.char_length(text)
    return F.when(n > 0, count_of(text, pattern) / n).otherwise(0.0)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(s) != "")


def summary(text: Column, most: int = 3) -> Column:
    """The first sentences, joined by '. '."""
    return F.array_join(F.slice(F.transform(sentences(text), lambda s: F.trim(s)), 1, most), ". ")


def snippet(text: Column, size: int = 200, least: int = 100) -> Column:
    """The first ``size`` characters, cut back to the last blank if that lies beyond ``least``."""
    head = F.substring(text, 1, size)
    last = F.lit(size) - F.instr(F.reverse(head), " ")
    return F.when(F.char_length(text) <= size, text).otherwise(F.concat(F.when(last > least, F.substring(head, F.lit(1), last)).otherwise(head), F.lit("...")))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by a blank."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def jaccard(a: Column, b: Column) -> Column:
    """Size of intersection over union of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def char_shingles(text: Column, n: int = 3) -> Column:
    m = F.char_length(text)
    return F.array_distinct(F.transform(F.when(m >= n, F.sequence(F.lit(1), m - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(n))))


def syllables(word: Column) -> Column:
    """Vowel groups, one less for a final e, one at least."""
    groups = F.regexp_count(F.lower(word), F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), groups - F.when(F.lower(word).endswith("e"), 1).otherwise(0))


def readability(text: Column) -> tuple[Column, Column, Column]:
    """(Flesch reading ease, Flesch-Kincaid grade, Gunning fog) over words and sentence ends.

    Words, syllables and words of three syllables or more (see ``syllables``) are counted by
    patterns over the whole text, without a list of words.
    """
    t = F.lower(text)
    count = lambda p: F.regexp_count(t, F.lit(p))
    v, c = "[aeiouy]", r"[^\saeiouy]"
    n = count(r"\S+")
    s = F.greatest(F.lit(1), F.size(F.split(text, r"\.")))
    # groups less final e's; a word without a vowel, and one whose only group ends it with an e, has one all the same
    syl = count(f"{v}+") - count(r"e(?!\S)") + count(rf"(?<!\S){c}++(?!\S)") + count(rf"(?<!\S){c}*+{v}*e(?!\S)")
    hard = count(rf"(?<!\S){c}*+(?:{v}++{c}++){{2}}(?:{v}++{c}++(?!\S)|{v}*[aiouy](?!\S)|{v}++{c}++{v})")
    per_sentence, per_word = n / s, syl / n
    flesch = 206.835 - 1.015 * per_sentence - 84.6 * per_word
    grade = 0.39 * per_sentence + 11.8 * per_word - 15.59
    fog = 0.4 * (per_sentence + 100 * hard / n)
    zero = F.lit(0.0)
    return F.when(n > 0, F.greatest(zero, F.least(F.lit(100.0), flesch))).otherwise(zero), F.when(n > 0, F.greatest(zero, grade)).otherwise(zero), F.when(n > 0, F.greatest(zero, fog)).otherwise(zero)


def news_readability(text: Column) -> Column:
    """Reading ease with mean word length for syllables, over 100, within 0 and 1."""
    w = words(text)
    n, s = F.size(w), F.greatest(F.lit(1), F.size(sentences(text)))
    letters = F.aggregate(w, F.lit(0), lambda a, x: a + F.char_length(x))
    ease = 206.835 - 1.015 * (n / s) - 84.6 * (letters / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ease / 100))).otherwise(0.0)


def complexity(text: Column) -> Column:
    """0.5 below 5 words a sentence, 1.5 above 20, linear between."""
    x = F.size(words(text)) / F.greatest(F.lit(1), F.size(sentences(text)))
    return F.when(x < 5, 0.5).when(x > 20, 1.5).otherwise(0.5 + (x - 5) / 15)


def subjectivity(text: Column) -> Column:
    """Share of subjective among subjective and objective words."""
    w = words(text)
    n = F.greatest(F.lit(1), F.size(w))
    a = F.size(F.filter(w, lambda x: F.array_contains(array_of(SUBJECTIVE), x))) / n
    b = F.size(F.filter(w, lambda x: F.array_contains(array_of(OBJECTIVE), x))) / n
    return a / (a + b + 1e-6)


# fixed values: patterns of typed tokens
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "url": r"https?://[^\s]+",
    "phone": r"\d{3}[-.]\d{3}[-.]\d{4}",
    "date": r"\d{1,2}/\d{1,2}/\d{2,4}",
    "currency": r"[$€£]\d+(?:\.\d+)?",
    "time": r"\d{1,2}:\d{2}",
    "hashtag": r"#\w+",
    "mention": r"@\w+",
}


def typed_tokens(text: Column) -> Column:
    """array<struct<kind, value>> of every match of PATTERNS, kind by kind."""

    def found(kind, pattern):
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    parts = [found(k, p) for k, p in PATTERNS.items()]
    return F.concat(*parts)


NEGATIONS = "not no never neither nor none nobody nothing nowhere cannot".split()


def mark_negations(text: Column) -> Column:
    """Prefix NOT_ to words after a negation, up to a word that ends in punctuation or another negation."""
    w = words(text)

    def step(acc, x):
        neg = F.array_contains(array_of(NEGATIONS), x)
        stop = x.rlike(r"[.,!?;:]$")
        out = F.when(acc["on"] & ~neg, F.concat(F.lit("NOT_"), x)).otherwise(x)
        on = F.when(neg, True).when(stop, False).otherwise(acc["on"])
        return F.struct(F.concat(acc["out"], F.array(out)).alias("out"), on.alias("on"))

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("on"))
    return F.array_join(F.aggregate(w, zero, step)["out"], " ")


def any_of(text: Column, words_: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words_])


def tfidf_keywords(docs, most: int = 10, stop=STOP_EN):
    """(doc_id, term, score): each document's ``most`` commonest words and pairs of words, by name where equal.

    Words have two letters or digits at least and are no stop words; scores are counts over their
    Euclidean norm among the terms kept.
    """
    from pyspark.sql import Window as W

    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), 0), lambda t: ~t.isin(list(stop)))
    d = docs.select("doc_id", w.alias("w")).select("doc_id", F.explode(F.concat("w", ngrams(F.col("w"), 2))).alias("term"))
    n = d.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    top = n.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "term"))).where(F.col("k") <= most)
    return top.select("doc_id", "term", (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy("doc_id")))).alias("score"))


def token_ids(text: Column, vocabulary: dict[str, int], most: int = 128) -> Column:
    """Ids of [CLS], the words of two bytes or more and [SEP], cut to ``most``; words it lacks are [UNK]."""
    w = F.transform(F.filter(F.split(text, r"\s+"), lambda x: F.octet_length(x) >= 2), F.lower)
    tokens = F.slice(F.concat(F.array(F.lit("[CLS]")), w, F.array(F.lit("[SEP]"))), 1, most)
    ids = F.create_map(*[F.lit(x) for kv in vocabulary.items() for x in kv])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(ids, t), F.lit(vocabulary["[UNK]"])))
