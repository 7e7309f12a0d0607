"""op9: quality scores of all documents."""

from trawl.llm.quality import quality_scores
from trawl.session import table

NAME = "op9_quality_classifier"


def query(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
