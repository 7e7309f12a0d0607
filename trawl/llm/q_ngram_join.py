"""op1: n-gram Jaccard join of all documents."""

from trawl.llm.ngram_join import ngram_join
from trawl.session import table

NAME = "op1_ngram_jaccard_join"


def query(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
