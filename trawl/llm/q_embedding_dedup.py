"""op10: near-dedup of all embeddings."""

from trawl.llm.embedding_dedup import embedding_dedup
from trawl.session import table

NAME = "op10_embedding_near_dedup"
SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND array_inner_product(a.e, b.e) / (sqrt(array_inner_product(a.e, a.e)) * sqrt(array_inner_product(b.e, b.e))) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


def query(spark, sf_dir):
    return embedding_dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
