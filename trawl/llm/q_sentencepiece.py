"""op6: all documents encoded, with a check that they decode to their texts."""

from trawl.llm.sentencepiece_viterbi import encode
from trawl.session import table

NAME = "op6_sentencepiece"


def query(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "ids", "round_trip")
