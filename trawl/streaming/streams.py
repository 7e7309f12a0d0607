"""Structured Streaming over event logs: windows, sessions, deduplication, alerts, incremental indexing.

The functions take a streaming (or batch) DataFrame with ``ts`` and return one; ``drain`` runs a
query over what its source has and gives the result as a table, which is how tests compare streams
with batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.session import shared_dir


def events_stream(spark: SparkSession, path: str, files_per_trigger: int | None = 1) -> DataFrame:
    """The event log as a file stream, None for all files at once; ts becomes a timestamp, as watermarks need one."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        raw = raw.option("maxFilesPerTrigger", files_per_trigger)
    return raw.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by window; rows later than the watermark are dropped."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """(start, n, mean) of overlapping windows."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): sessions by gap."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark; state is dropped as it passes."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def checked(events: DataFrame, base: DataFrame, k: float = 2.5) -> DataFrame:
    """Rule anomalies of a stream against a static baseline row."""
    from trawl.operators.anomaly import query_log, rule_anomalies

    return rule_anomalies(query_log(events), base, k)


def matched(clicks: DataFrame, buys: DataFrame, within: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Clicks with purchases of the same user up to ``within`` later: a stream-stream interval join."""
    a = clicks.withWatermark("ts", late).select(F.col("event_id").alias("click_id"), F.col("user_id").alias("cu"), F.col("ts").alias("ct"))
    b = buys.withWatermark("ts", late).select(F.col("event_id").alias("buy_id"), F.col("user_id").alias("bu"), F.col("ts").alias("bt"))
    return a.join(b, F.expr(f"cu = bu AND bt > ct AND bt <= ct + INTERVAL {within}")).select("click_id", "buy_id")


def cooled(alerts: DataFrame, seconds: int = 300) -> DataFrame:
    """Alerts (event_id, ts, rule, severity) that no alert of their rule and severity passed within ``seconds`` before."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        keep = []
        for t in rows["ts"]:
            at = t.timestamp()
            ok = last is None or at - last >= seconds
            keep.append(ok)
            last = at if ok else last
        state.update((last,))
        yield rows[keep][["event_id", "ts", "rule", "severity"]]

    schema = "event_id long, ts timestamp, rule string, severity string"
    return alerts.select("event_id", "ts", "rule", "severity").groupBy("rule", "severity").applyInPandasWithState(step, schema, "last double", "append", "NoTimeout")


def index_into(docs: DataFrame, path: str, checkpoint: str):
    """Append postings of arriving documents to a table; a batch's folder is replaced if it is run again."""
    from trawl.operators.index import postings

    def write(batch: DataFrame, number: int) -> None:
        postings(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that a streaming query gives for its present input, written by the executors to the shared folder."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    given: dict[int, str] = {}

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/{number}")
        if mode == "complete":  # it holds what the batches before it gave
            given.clear()
        given[number] = f"{where}/{number}"

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(*given.values()) if given else spark.createDataFrame([], df.schema)
