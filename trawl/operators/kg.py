"""Knowledge graphs: entities, relations by proximity, linking, inference."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, name, at, confidence): capitalised words of more than three bytes with their first byte offset."""
    w = docs.select("doc_id", "text", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("name"))
    w = w.where(F.col("name").rlike(r"^\p{Lu}") & (F.octet_length("name") > 3))
    at = F.octet_length(F.substring("text", F.lit(1), F.instr(F.col("text"), F.col("name")) - 1))
    return w.select("doc_id", "name", at.alias("at"), F.lit(0.7).alias("confidence"))


def relations(found: DataFrame, within: int = 100) -> DataFrame:
    """(doc_id, subject, object, predicate, confidence) of entities of a document first seen within ``within`` bytes.

    Offsets are dealt into bins of that width and met with the same and the next bin, so that a long
    document makes only near pairs.
    """
    a = found.select("doc_id", F.col("name").alias("subject"), F.col("at").alias("a"), F.explode(F.array(F.floor(F.col("at") / within), F.floor(F.col("at") / within) + 1)).alias("bin"))
    b = found.select("doc_id", F.col("name").alias("object"), F.col("at").alias("b"), F.floor(F.col("at") / within).alias("bin"))
    near = a.join(b, ["doc_id", "bin"]).where((F.col("b") - F.col("a") < within) & ((F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("subject") < F.col("object")))))
    return near.select("doc_id", "subject", "object", F.lit("related_to").alias("predicate"), F.lit(0.6).alias("confidence")).distinct()


def char_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters, without regard to case."""
    x, y = F.array_distinct(F.split(F.lower(a), "")), F.array_distinct(F.split(F.lower(b), ""))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def linked(mentions: DataFrame, known: DataFrame, least: float = 0.8) -> DataFrame:
    """(name, type, entity_id, how) of mentions (name, type): exact by lower case, else the most similar above ``least``.

    Similarity is that of the sets of characters. Names of equal sets are one class; of each class
    only its rarest characters are joined, as many as a pair above ``least`` can't do without, and
    only with sets of a size that may match. Ties go to the least entity_id.
    """
    m = mentions.select("name", "type").distinct()
    exact = m.withColumn("k", F.lower("name")).join(known.select(F.lower("name").alias("k"), "type", "entity_id"), ["k", "type"])
    exact = exact.groupBy("name", "type").agg(F.min("entity_id").alias("entity_id")).withColumn("how", F.lit("exact"))
    chars = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("name"), ""), lambda x: x != "")))
    rest = m.join(exact, ["name", "type"], "left_anti").select("name", "type", chars.alias("x"))
    a = rest.select("type", "x").distinct()
    b = known.select("type", chars.alias("y"), "entity_id").groupBy("type", "y").agg(F.min("entity_id").alias("entity_id"))
    df = b.select("type", F.explode("y").alias("c")).groupBy("type", "c").agg(F.count(F.lit(1)).alias("df"))

    def rarest(sets: DataFrame, x: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy("type", x).orderBy(F.coalesce("df", F.lit(0)), "c"))
        each = sets.withColumn("c", F.explode(x)).join(df, ["type", "c"], "left").withColumn("k", place)
        return each.where(F.col("k") <= F.size(x) - F.ceil(F.size(x) * least - 1e-9) + 1).drop("k", "df")

    met = rarest(a, "x").join(rarest(b, "y"), ["type", "c"]).where((F.size("x") >= least * F.size("y") - 1e-9) & (F.size("y") >= least * F.size("x") - 1e-9))
    met = met.select("type", "x", "y", "entity_id").distinct()
    s = met.withColumn("s", F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).where(F.col("s") > least)
    best = s.groupBy("type", "x").agg(F.min_by("entity_id", F.struct(-F.col("s"), "entity_id")).alias("entity_id"))
    return exact.unionByName(rest.join(best, ["type", "x"]).select("name", "type", "entity_id", F.lit("fuzzy").alias("how")))


def search(known: DataFrame, text: str, most: int = 10) -> DataFrame:
    """Entities whose name contains ``text``, most confident first."""
    return known.where(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy(F.desc("confidence"), "name").limit(most)


def inferred(facts: DataFrame, predicate: str, rounds: int | None = None) -> DataFrame:
    """(subject, object): the transitive closure of a predicate, by joins until nothing is new, or in ``rounds`` at most."""
    from trawl.operators.graph import cut

    base = cut(facts.where(F.col("predicate") == predicate).select("subject", "object").distinct())
    all_ = front = base
    for _ in itertools.count() if rounds is None else range(rounds):
        step = front.join(base.select(F.col("subject").alias("object"), F.col("object").alias("to")), "object").select("subject", F.col("to").alias("object")).distinct()
        front = cut(step.join(all_, ["subject", "object"], "left_anti"))
        if not front.limit(1).count():
            break
        all_ = cut(all_.union(front))
    return all_


def statistics(known: DataFrame) -> DataFrame:
    return known.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))


def added(known: DataFrame, more: DataFrame) -> DataFrame:
    """``known`` entities (entity_id, name, type, confidence) with those of ``more`` whose name and type are new."""
    both = known.withColumn("_n", F.lit(0)).unionByName(more.withColumn("_n", F.lit(1)))
    first = F.min_by(F.struct("entity_id", "name", "confidence"), F.struct("_n", "entity_id")).alias("e")
    return both.groupBy(F.lower("name").alias("_k"), "type").agg(first).select("e.entity_id", "e.name", "type", "e.confidence")


def by_name(known: DataFrame, names: list[str]) -> DataFrame:
    return known.where(F.lower("name").isin([n.lower() for n in names]))
