"""A corpus pipeline: five stages from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage
returns as Parquet in the shared folder and gives it to the next. All stages but the last return
the columns of ``documents``. Rows without a doc_id, which no decision could name, go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import staged, staging, unstage
from trawl.llm.decontaminate import contaminated
from trawl.llm.ngram_join import ngram_join
from trawl.llm.quality import quality_scores
from trawl.llm.sentencepiece_viterbi import encode
from trawl.llm.suffix_dedup import suffix_dedup
from trawl.session import table

# A passage of 50 words takes 242 to 390 bytes of these texts, half of them under 311 and one in a
# hundred under 264: this reaches nearly all such passages and leaves shorter common phrases.
REPEATED_BYTES = 280
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    good = quality_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select("doc_id").distinct()
    return docs.join(good, "doc_id", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each component of near-duplicates."""
    kept = ngram_join(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of REPEATED_BYTES that start elsewhere too; what is left empty goes."""
    found = suffix_dedup(docs.select(*COLUMNS), REPEATED_BYTES)
    text = F.col("kept_text")
    kept = found.where((F.col("n_removed") == 0) | (F.length(F.trim(text)) > 0))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    held = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return encode(docs.select(*COLUMNS)).select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", tokens),
]

# boosted tables, components and suffixes are beyond SQL; tests/llm/test_pipeline.py uses brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; a stage's own tables go when its result is written."""
    docs, last = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES[:-1]:
        with staging(spark):
            docs = staged(stage(spark, docs, sf_dir), name, keep=True)
        unstage(*last)
        last = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
