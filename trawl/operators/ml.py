"""Models by MLlib where the reference binds others: spam ensembles, learning to rank, recommendations, outliers."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators.quality import ensemble_vote, text_features

WEIGHTS = {"forest": 0.3, "boosted": 0.3, "linear": 0.25, "bayes": 0.15}


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, features) as an ML vector of the text features."""
    from pyspark.ml.feature import VectorAssembler

    f = text_features(F.col("text"))
    rows = docs.select("doc_id", *[c.cast("double").alias(k) for k, c in f.items()])
    return VectorAssembler(inputCols=list(f), outputCol="features").transform(rows).select("doc_id", "features")


def spam_models(docs: DataFrame, labels: DataFrame, label: str, least: int = 100):
    """Fitted models by name; an error below ``least`` labelled documents."""
    from pyspark.ml.classification import GBTClassifier, LinearSVC, NaiveBayes, RandomForestClassifier

    rows = feature_rows(docs).join(labels.select("doc_id", F.col(label).cast("double").alias("label")), "doc_id").persist()
    try:
        if rows.count() < least:
            raise ValueError(f"fewer than {least} labelled documents")
        kinds = {
            "forest": RandomForestClassifier(numTrees=20, seed=7), "boosted": GBTClassifier(maxIter=10, seed=7), "linear": LinearSVC(maxIter=20), "bayes": NaiveBayes(modelType="gaussian"),
        }
        return {k: m.fit(rows) for k, m in kinds.items()}
    finally:
        rows.unpersist()


def voted(docs: DataFrame, models: dict, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(doc_id, spam, confidence) by the weighted vote of the models."""
    rows = feature_rows(docs)
    for k, m in models.items():
        rows = m.transform(rows).withColumnRenamed("prediction", k).drop("rawPrediction", "probability")
    spam, confidence = ensemble_vote({k: (F.col(k) == 1.0, F.lit(1.0)) for k in models}, weights)
    return rows.select("doc_id", spam.alias("spam"), confidence.alias("confidence"))


def ranking_model(rows: DataFrame, features: list[str], label: str = "label"):
    """A boosted regression on graded relevance, and its pipeline of assembling and scaling."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    return Pipeline(
        stages=[VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol=label, maxIter=15, seed=7)]
    ).fit(rows)


def ndcg(ranked: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) of rows (query_id, rank, gain)."""
    from pyspark.sql import Window as W

    ideal = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("gain")))
    r = ranked.withColumn("i", ideal)
    at = lambda c: F.when(F.col(c) <= k, (F.pow(F.lit(2.0), "gain") - 1) / F.log2(F.col(c) + 1)).otherwise(0.0)
    return r.groupBy("query_id").agg((F.sum(at("rank")) / F.nullif(F.sum(at("i")), F.lit(0.0))).alias("ndcg"))


def recommendations(interactions: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
    """(user_id, item, rating) by alternating least squares, without items a user has had."""
    from pyspark.ml.recommendation import ALS

    r = interactions.groupBy("user_id", "item").agg(F.count(F.lit(1)).cast("float").alias("rating")).withColumn("user_id", F.col("user_id").cast("int"))
    model = ALS(userCol="user_id", itemCol="item", ratingCol="rating", implicitPrefs=True, rank=8, maxIter=5, seed=7).fit(r)
    # users by the power of two that bounds what they have had: so many more candidates leave n new ones, if there are
    had = r.groupBy("user_id").agg(F.ceil(F.log2(F.count(F.lit(1)))).cast("int").alias("class"))
    asked = users.select(F.col("user_id").cast("int").alias("user_id")).distinct().join(had, "user_id")
    classes = sorted(x[0] for x in had.select("class").distinct().collect())  # few: logarithms
    top = reduce(DataFrame.unionByName, [model.recommendForUserSubset(asked.where(F.col("class") == c).select("user_id"), n + 2**c) for c in classes])
    e = top.select("user_id", F.explode("recommendations").alias("x")).select("user_id", F.col("x.item").alias("item"), F.col("x.rating").alias("rating"))
    from pyspark.sql import Window as W

    new = e.join(r.select("user_id", "item"), ["user_id", "item"], "left_anti")
    return new.withColumn("_n", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("rating"), "item"))).where(F.col("_n") <= n).drop("_n")


def isolation_scores(rows: DataFrame, features: list[str], trees: int = 50, sample: int = 256, seed: int = 42) -> DataFrame:
    """``rows`` with isolation: 2 ** (-mean path / expected path) over random trees of bounded samples.

    The trees are grown on the driver from ``trees * sample`` rows at most, those of least hash; scoring
    is a vectorised map over all rows.
    """
    got = rows.select(*[F.col(f).cast("double").alias(f) for f in features]).orderBy(F.xxhash64(*features)).limit(trees * sample).toPandas().to_numpy()
    rng = np.random.default_rng(seed)
    norm = lambda n: 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def grow(x, depth):
        if len(x) <= 1 or depth >= np.ceil(np.log2(max(2, sample))):
            return depth + norm(len(x))
        f = rng.integers(x.shape[1])
        lo, hi = x[:, f].min(), x[:, f].max()
        if lo == hi:
            return depth + norm(len(x))
        cut = rng.uniform(lo, hi)
        return (f, cut, grow(x[x[:, f] < cut], depth + 1), grow(x[x[:, f] >= cut], depth + 1))

    forest = [grow(got[rng.permutation(len(got))[:sample]], 0) for _ in range(trees)] if len(got) else []
    expected = max(norm(min(sample, max(2, len(got)))), 1e-9)

    def path(node, x, at, out):
        if not len(at):
            return
        if not isinstance(node, tuple):
            out[at] += node
            return
        f, cut, left, right = node
        less = x[at, f] < cut
        path(left, x, at[less], out)
        path(right, x, at[~less], out)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in cols], axis=1)
        out = np.zeros(len(x))
        for t in forest:
            path(t, x, np.arange(len(x)), out)
        return pd.Series(2.0 ** (-out / max(1, len(forest)) / expected))

    return rows.withColumn("isolation", score(*[F.col(f).cast("double") for f in features]))


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("alli", "al"), ("ousli", "ous"), ("ation", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("aliti", "al"), ("biliti", "ble")]


def stemmed(tokens) -> object:
    """Light English stems of a token array: plurals, -ed, -ing, final y and a few long suffixes."""

    def one(w):
        w = F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "sses$", "ss"), "ies$", "i"), r"(?<=[^s])s$", "")
        w = F.regexp_replace(F.regexp_replace(w, r"(?<=[aeiouy].{0,40})(?:ed|ing)$", ""), r"(?<=[aeiou].{0,40}[^aeiou])y$", "i")
        for a, b in _STEP2:
            w = F.regexp_replace(w, f"(?<=.{{2,40}}){a}$", b)
        return w

    return F.transform(tokens, one)


def sentiment(tokens, lexicon: dict[str, float]):
    """Mean score of the lexicon's words that are present; a NOT_ word counts the other way."""
    m = F.create_map(*[x for k, v in lexicon.items() for x in (F.lit(k), F.lit(v))])
    bare = lambda t: F.regexp_replace(t, "^NOT_", "")
    s = F.filter(F.transform(tokens, lambda t: F.try_element_at(m, bare(t)) * F.when(t.startswith("NOT_"), -1.0).otherwise(1.0)), lambda x: x.isNotNull())
    return F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s)).otherwise(0.0)


def sentiment_label(score):
    return F.when(score > 0.5, "very_positive").when(score > 0, "positive").when(score == 0, "neutral").when(score >= -0.5, "negative").otherwise("very_negative")


def language_stop_words(tokens, language):
    """Tokens without the function words of their text's language."""
    out = tokens
    for k, ws in T.FUNCTION_WORDS.items():
        out = F.when(language == k, F.array_except(tokens, T.array_of(ws))).otherwise(out)
    return out
