"""op4: all documents in 24 shards of nearly equal bytes."""

from trawl.llm.kd_shards import kd_shards
from trawl.session import table

NAME = "op4_kd_sharding"


def query(spark, sf_dir):
    return kd_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
