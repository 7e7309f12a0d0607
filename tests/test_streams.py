import os

import pytest
from pyspark.sql import functions as F

from trawl.operators import anomaly as A
from trawl.plans import registry
from trawl.streaming import streams as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """The event log in order of time, as five files."""
    path = str(tmp_path_factory.mktemp("feed"))
    e = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect()
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    for i in range(5):
        part = e[i * len(e) // 5 : (i + 1) * len(e) // 5]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.startswith("part-") and not os.path.exists(f"{path}/{f}.t"):
                os.utime(f"{path}/{f}", (1_000_000 + 100 * i,) * 2) if f.endswith(".parquet") and os.path.getmtime(f"{path}/{f}") > 2_000_000 else None
    return path


def batch(spark):
    return spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_windows_equal_the_batch(spark, feed):
    s = S.events_stream(spark, feed)
    assert same(S.drain(S.tumbling(s), "complete").select("start", "event_type", "n"), S.tumbling(batch(spark)).select("start", "event_type", "n"))
    assert same(S.drain(S.sliding(s), "complete").select("start", "n"), S.sliding(batch(spark)).select("start", "n"))


def test_sessions_equal_the_batch_and_the_window_form(spark, feed):
    got = S.drain(S.sessions(S.events_stream(spark, feed)), "complete")
    assert same(got, S.sessions(batch(spark)))
    w = A.sessions(A.query_log(spark.read.parquet(f"{SF}/events.parquet")))
    assert sorted((r.user_id, r.n) for r in w.collect()) == sorted((r.user_id, r.n) for r in got.collect())


def test_deduplication(spark, feed):
    s = S.events_stream(spark, feed)
    twice = s.union(s)
    assert S.drain(S.deduplicated(twice, ["event_id"])).count() == batch(spark).count()


def test_queries_lose_no_rows_of_files_out_of_order(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    old = e.withColumns({"event_id": F.col("event_id") + 10**6, "ts": F.expr("ts - INTERVAL 100 DAYS")})
    where = str(tmp_path / "events.parquet")
    for rows, at in ((e.where("event_id % 2 = 0"), 1_000_000), (e.where("event_id % 2 = 1"), 1_000_100), (old, 1_000_200)):  # the oldest rows come last
        rows.coalesce(1).write.mode("append").parquet(where)
        for f in os.listdir(where):
            if f.endswith(".parquet") and os.path.getmtime(f"{where}/{f}") > 2_000_000:
                os.utime(f"{where}/{f}", (at, at))
    ids = [r.event_id for r in registry.queries()["stream_deduplicated"](spark, str(tmp_path)).collect()]
    assert len(ids) == len(set(ids)) == 2 * e.count()
    got = registry.queries()["stream_sessions"](spark, str(tmp_path))
    assert got.agg(F.sum("n")).first()[0] == 2 * e.count() and got.count() == 2 * registry.queries()["stream_sessions"](spark, SF).count()


def test_results_are_files_and_not_kept_by_the_driver(spark, feed, tmp_path):
    s = S.events_stream(spark, feed)
    for got in (S.drain(S.deduplicated(s.union(s), ["event_id"])), S.drain(S.sessions(s), "complete")):
        assert got.inputFiles() and got.count()
    (tmp_path / "none").mkdir()
    nothing = S.drain(S.deduplicated(S.events_stream(spark, str(tmp_path / "none")), ["event_id"]))
    assert nothing.count() == 0 and nothing.columns == batch(spark).columns


def test_static_baseline_and_cooldown(spark, feed):
    base = A.profile(A.query_log(batch(spark)))
    s = S.checked(S.events_stream(spark, feed), base)
    want = A.rule_anomalies(A.query_log(batch(spark)), base)
    assert sorted(r.event_id for r in S.drain(s).collect()) == sorted(r.event_id for r in want.collect())
    cool = S.drain(S.cooled(s, 3600))
    fold = A.cooled_alerts(want.select("event_id", "ts", "rule", "severity"), ["rule", "severity"], 3600, hourly=10**6)
    assert sorted(r.event_id for r in cool.collect()) == sorted(r.event_id for r in fold.collect())


def test_interval_join(spark, feed):
    s = S.events_stream(spark, feed)
    got = S.drain(S.matched(s.where("event_type = 'click'"), s.where("event_type = 'purchase'")))
    b = batch(spark)
    want = S.matched(b.where("event_type = 'click'"), b.where("event_type = 'purchase'"))
    assert same(got, want)


def test_incremental_index(spark, tmp_path):
    from trawl.operators.index import postings

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    q = S.index_into(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert got.count() == postings(docs).count() and got.exceptAll(postings(docs)).count() == 0
