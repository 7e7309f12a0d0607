"""op5: fixity audit of all pages against a replica in which some bodies are corrupted."""

from pyspark.sql import functions as F

from trawl.llm.warc import fixity_audit
from trawl.session import table

NAME = "op5_warc_merkle_audit"
# a body is corrupted where the md5 of its id begins so: its first byte becomes a blank
CORRUPT = "substr(md5(CAST(page_id AS VARCHAR)), 1, 2) = '3c'"
SQL = f"""WITH r AS (SELECT page_id, page_id // 4096 AS file, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id
|| '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
|| 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html AS record, html = '' OR html[1] = ' ' OR NOT ({CORRUPT}) AS intact FROM pages),
l AS (SELECT *, (strlen(record) + 4)::BIGINT AS length FROM r)
SELECT page_id, file, (row_number() OVER w - 1)::BIGINT AS seq, (sum(length) OVER w - length)::BIGINT AS "offset", length, sha256(record) AS sha256, intact FROM l
WINDOW w AS (PARTITION BY file ORDER BY page_id, sha256(record) ROWS UNBOUNDED PRECEDING)"""


def replica_of(pages):
    """The pages with a blank for the first character of the bodies that CORRUPT names."""
    hit = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2) == "3c"
    return pages.withColumn("html", F.when(hit & (F.length("html") > 0), F.overlay("html", F.lit(" "), 1, 1)).otherwise(F.col("html")))


def query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return fixity_audit(pages, replica_of(pages))
