"""op7: substring dedup over all documents."""

from pyspark.sql import functions as F

from trawl.llm.substring_dedup import substring_dedup
from trawl.session import table

NAME = "op7_substring_dedup"

SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, sha256(array_to_string(ws[p : p + 49], ' ')) AS h FROM w, unnest(generate_series(1, len(ws) - 49)) AS g(p) WHERE len(ws) >= 50),
first AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
bad AS (SELECT DISTINCT win.doc_id, unnest(generate_series(p, p + 49)) AS i FROM win JOIN first USING (h) WHERE f < win.doc_id),
pos AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(generate_series(1, len(ws))) AS g(i)),
kept AS (SELECT pos.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos.i) AS t FROM pos ANTI JOIN bad ON pos.doc_id = bad.doc_id AND pos.i = bad.i GROUP BY pos.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


def query(spark, sf_dir):
    found = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
