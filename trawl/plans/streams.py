"""Streaming queries run over what their source has; their rows equal the batch's."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.plans.registry import query
from trawl.streaming import streams as S


def feed(spark, sf_dir):
    # A pattern: the table may be a file or a folder. Its files, in whatever order of time, come as one batch:
    # no row is behind a watermark that others have moved, and complete results are written once.
    return S.events_stream(spark, f"{sf_dir}/event[s].parquet", None)


@query("stream_tumbling", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return S.drain(S.tumbling(feed(spark, sf_dir)), "complete").select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query(
    "stream_sliding",
    "WITH w AS (SELECT epoch_us(time_bucket(INTERVAL 15 MINUTE, ts)) - 900000000 * i AS start, ts, value FROM events, range(4) r(i)) SELECT start::BIGINT AS start, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY start",
)
def stream_sliding(spark, sf_dir):
    return S.drain(S.sliding(feed(spark, sf_dir)), "complete").select(F.unix_micros("start").alias("start"), "n", F.round("mean", 6).alias("mean"))


@query(
    "stream_sessions",
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts))::BIGINT AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark, sf_dir):
    return S.drain(S.sessions(feed(spark, sf_dir)), "complete").select("user_id", F.unix_micros("start").alias("start"), "n")


@query("stream_deduplicated", "SELECT event_id, user_id FROM events")
def stream_deduplicated(spark, sf_dir):
    s = feed(spark, sf_dir)
    return S.drain(S.deduplicated(s.union(s), ["event_id"], "60 days")).select("event_id", "user_id")


@query("stream_interval_join", "SELECT a.event_id AS click_id, b.event_id AS buy_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR")
def stream_interval_join(spark, sf_dir):
    s = feed(spark, sf_dir)
    return S.drain(S.matched(s.where("event_type = 'click'"), s.where("event_type = 'purchase'"), late="60 days"))
