from pyspark.sql import functions as F

from trawl.llm.common import staged
from trawl.llm.warc import audit, fixity_audit, layout, leaves, merkle, read_warc, write_warc

ROWS = [(i, f"http://a/{i}", f"<p>page {i} é</p>") for i in range(60)] + [(5, "http://a/5", "again"), (None, None, None), (7000, "http://b", "")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_audit_finds_what_differs(spark):
    one = pages(spark)
    two = one.withColumn("html", F.when(F.col("page_id").isin(17, 44), F.regexp_replace("html", "page", "pagf")).otherwise(F.col("html")))
    got = fixity_audit(one, two).collect()
    assert len(got) == len(ROWS)
    assert sorted(r.page_id for r in got if not r.intact) == [17, 44]
    trees = [staged(merkle(leaves(layout(x))), "tree") for x in (one, two)]
    wrong = audit(*trees).collect()
    assert [r.hash != r.other for r in wrong] == [True, True]
    assert audit(trees[0], trees[0]).count() == 0


def test_audit_of_a_lost_record(spark):
    one = pages(spark, ROWS[:40])
    trees = [staged(merkle(leaves(layout(x))), "tree") for x in (one, one.where("page_id < 39"))]
    wrong = audit(*trees).collect()
    assert [(r.node, r.other) for r in wrong] == [(39, None)]


def test_round_trip_through_files(spark, tmp_path):
    placed = layout(pages(spark))
    write_warc(placed, f"file://{tmp_path}/w")
    back = {(r.file, r.offset): (r.url, r.html) for r in read_warc(spark, f"file://{tmp_path}/w").collect()}
    want = {(r.file, r.offset) for r in placed.collect()}
    assert set(back) == want
    assert sorted(h for _, h in back.values()) == sorted(r[2] or "" for r in ROWS)


def test_empty(spark):
    assert fixity_audit(pages(spark, []), pages(spark, [])).count() == 0


def test_rows_without_ids_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    from trawl.llm.warc import fixity_audit

    rows = [(i if i % 3 else None, f"http://a/{i}", f"<p>{i}</p>", "x", 5) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string, seq int")
    hit = F.col("html").isin("<p>6</p>", "<p>7</p>")
    found = fixity_audit(pages, pages.withColumn("html", F.when(hit, F.lit("changed!")).otherwise(F.col("html")))).collect()
    assert len(found) == 300 and len({r.file for r in found if r.page_id is None}) > 50
    assert sorted(str(r.page_id) for r in found if not r.intact) == ["7", "None"]
