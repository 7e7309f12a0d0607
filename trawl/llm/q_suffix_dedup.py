"""op3: suffix-array dedup over all documents."""

from pyspark.sql import functions as F

from trawl.llm.suffix_dedup import suffix_dedup
from trawl.session import table

NAME = "op3_suffix_dedup"
SQL = None  # strings of bytes at every offset: tested against brute force


def query(spark, sf_dir):
    found = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))
