"""op8: pairs of a document and a benchmark item that it holds."""

from trawl.llm.decontaminate import contaminated
from trawl.session import table

NAME = "op8_decontamination"


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "item_id", "item_words", "covered_words", "reparameterised").distinct()
