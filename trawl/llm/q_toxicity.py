"""op2: toxicity of all documents."""

from pyspark.sql import functions as F

from trawl.llm.toxicity import toxicity
from trawl.session import table

NAME = "op2_toxicity"


def query(spark, sf_dir):
    found = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.transform("spans", lambda s: F.struct(s["start"], s["end"])).alias("spans"))
