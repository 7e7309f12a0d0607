"""Query-log analytics: outliers, rolling statistics, profiles, baselines, alerts.

A log has (event_id, ts, user_id, kind, value, ok). Statistics are aggregates joined back by a
broadcast of one row or of one row an hour; only per-user work uses windows, partitioned by user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.operators.graph import cut


def query_log(events: DataFrame) -> DataFrame:
    """Events as a query log: value is the response time, errors have status 500."""
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("kind"), "value",
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
    )


def zscore_outliers(log: DataFrame, value: str = "value", threshold: float = 3.0) -> DataFrame:
    """Rows with |x - mean| / population deviation above the threshold; none for fewer than 3 rows or no spread."""
    s = log.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count(value).alias("_n"))
    z = F.abs(F.col(value) - F.col("_m")) / F.col("_s")
    return log.crossJoin(F.broadcast(s)).withColumn("z", F.when((F.col("_n") >= 3) & (F.col("_s") > 0), z).otherwise(0.0)).where(F.col("z") > threshold).drop("_m", "_s", "_n")


def _beside(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right``, by equal keys; null keys are equal."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    names = [f"_by{i}" for i in range(len(by))]
    right = right.withColumnsRenamed(dict(zip(by, names)))
    on = [left[k].eqNullSafe(right[n]) for k, n in zip(by, names)]
    return left.join(right, on, how).drop(*names)


def quantiles(rows: DataFrame, value: str, shares: list[float], by: list[str] = (), whole: int = 1_000_000, bins: int = 4096) -> DataFrame:
    """(keys..., quantiles): exact, interpolated; null, NaN and infinite values are left out.

    Equal values are counted first. Up to ``whole`` different ones are aggregated at once. Beyond
    that, every wanted rank has a range of values, cut into ``bins`` and narrowed to the bin that
    holds the rank until it is one value; a round is a pass over the counted values, and no task
    holds more than ``bins`` rows of a rank.
    """
    by, v = list(by), F.col(value).cast("double")
    counts = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).groupBy(*by, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = cut(counts)
    if counts.limit(whole + 1).count() <= whole:
        return counts.groupBy(*by).agg(F.percentile("_v", F.array(*map(F.lit, shares)), F.col("_n")).alias("quantiles"))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_t"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = [(F.col("_t") - 1) * F.lit(s) for s in shares]
    ranks = [F.struct(F.lit(2 * i + up).alias("_i"), f(p).cast("long").alias("_r")) for i, p in enumerate(place) for up, f in enumerate((F.floor, F.ceil))]
    state = cut(total.withColumn("_k", F.explode(F.array(*ranks))).select(*by, "_lo", "_hi", F.lit(0).cast("long").alias("_below"), "_k.*"))
    done = None
    while True:
        settled = state.where("_lo = _hi")
        done = settled if done is None else done.unionByName(settled)
        state = state.where("_lo < _hi")
        if not state.limit(1).count():
            break
        inside = _beside(counts, state, by).where("_v BETWEEN _lo AND _hi")
        bin_ = F.coalesce(F.floor(F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2) * bins), F.when(F.col("_v") > F.col("_lo"), bins).otherwise(0))
        held = inside.groupBy(*by, "_i", "_r", "_below", F.least(F.lit(bins - 1), bin_).alias("_b")).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_n"))
        upto = F.col("_below") + F.sum("_n").over(W.partitionBy(*by, "_i").orderBy("_b"))
        found = held.withColumn("_upto", upto).where("_r < _upto AND _r >= _upto - _n")
        state = cut(found.select(*by, "_lo", "_hi", (F.col("_upto") - F.col("_n")).alias("_below"), "_i", "_r"))
    at = done.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_lo"))).alias("_at"))  # two values a share
    at = _beside(at, total.select(*by, "_t"), by)
    value_at = lambda i: F.element_at("_at", F.lit(i))
    between = [value_at(2 * i) + (p - F.floor(p)) * (value_at(2 * i + 1) - value_at(2 * i)) for i, p in enumerate(place)]
    return at.select(*by, F.array(*between).alias("quantiles"))


def iqr_outliers(log: DataFrame, value: str = "value", k: float = 1.5) -> DataFrame:
    """Rows beyond k interquartile ranges of the exact, interpolated quartiles; none for fewer than 4 rows."""
    s = log.agg(F.count(value).alias("_n")).crossJoin(quantiles(log, value, [0.25, 0.75]).withColumnRenamed("quantiles", "_q"))
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    x = F.col(value)
    return log.crossJoin(F.broadcast(s)).where((F.col("_n") >= 4) & ((x < lo - k * (hi - lo)) | (x > hi + k * (hi - lo)))).drop("_q", "_n")


def rolling(log: DataFrame, keys: list[str], order: list[str], value: str = "value", window: int = 10) -> DataFrame:
    """Mean, sample deviation (0 for one row), least and greatest of the last ``window`` rows of a key."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(1 - window, 0)
    return log.select(
        "*", F.avg(value).over(w).alias("mean"), F.coalesce(F.nanvl(F.stddev_samp(value).over(w), F.lit(0.0)), F.lit(0.0)).alias("std"),
        F.min(value).over(w).alias("least"), F.max(value).over(w).alias("greatest"),
    )


def profile(log: DataFrame, value: str = "value", by: list[str] = ()) -> DataFrame:
    """Mean, median, population deviation, 95th and 99th percentile, exact."""
    s = log.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    s = _beside(s, quantiles(log, value, [0.5, 0.95, 0.99], by), list(by), "left")
    p = F.col("quantiles")
    return s.select(*by, "n", "mean", "std", p[0].alias("median"), p[1].alias("p95"), p[2].alias("p99"))


def user_profiles(log: DataFrame, least: int = 5, top: int = 3) -> DataFrame:
    """(user_id, n, mean, top_kinds) of users with ``least`` rows or more; kinds by count, then name."""
    n = log.groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("c"), F.sum("value").alias("s"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "kind")))  # a row for each kind of a user
    u = n.groupBy("user_id").agg(F.sum("c").alias("n"), (F.sum("s") / F.sum("c")).alias("mean"), ranked.alias("_k"))
    return u.where(F.col("n") >= least).select("user_id", "n", "mean", F.transform(F.slice("_k", 1, top), lambda x: x["kind"]).alias("top_kinds"))


def baselines(log: DataFrame) -> DataFrame:
    """(hour, n, mean, std, p95, p99): one row over all (hour null) and one an hour."""
    hours = log.withColumn("hour", F.explode(F.array(F.lit(None).cast("int"), F.hour("ts"))))
    return profile(hours, by=["hour"]).select("hour", "n", "mean", "std", "p95", "p99")


def severity(deviation: Column) -> Column:
    return F.when(deviation > 5, "critical").when(deviation > 3, "high").when(deviation > 2, "medium").otherwise("low")


def rule_anomalies(log: DataFrame, base: DataFrame, k: float = 2.5) -> DataFrame:
    """(event_id, rule, actual, expected, deviation, severity, confidence) of rows that break a rule.

    ``base`` is one row with mean, std and p95; it may be a static side of a streaming log.
    """
    rules = F.array_compact(
        F.array(
            F.when(F.col("value") > F.col("p95") + k * F.col("std"), F.struct(F.lit("slow").alias("rule"), F.col("value").alias("actual"), F.col("p95").alias("expected"))),
            F.when(F.col("status") >= 400, F.struct(F.lit("error").alias("rule"), F.col("status").cast("double").alias("actual"), F.lit(200.0).alias("expected"))),
        )
    )
    hit = log.crossJoin(F.broadcast(base.select("mean", "std", "p95"))).select("event_id", "ts", F.explode(rules).alias("r")).select("event_id", "ts", "r.*")
    d = F.abs(F.col("actual") - F.col("expected")) / F.col("expected")
    return hit.withColumn("deviation", d).withColumn("severity", severity(F.col("deviation"))).withColumn("confidence", F.least(F.lit(1.0), F.col("deviation") / 2))


def seasonal_anomalies(log: DataFrame, base: DataFrame, k: float = 2.0, least: int = 5) -> DataFrame:
    """Hours whose mean lies k deviations or more from the baseline's row for the hour."""
    now = log.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("now_n"), F.avg("value").alias("now_mean")).where(F.col("now_n") >= least)
    b = F.broadcast(base.where("hour IS NOT NULL"))  # 24 rows
    return now.join(b, "hour").where(F.abs(F.col("now_mean") - F.col("mean")) > k * F.col("std")).select("hour", "now_n", "now_mean", "mean", "std")


def chi_square(now: DataFrame, then: DataFrame, key: str) -> DataFrame:
    """(statistic, cells): of current counts against past ones scaled to the same total."""
    a = now.groupBy(key).agg(F.count(F.lit(1)).alias("o"))
    b = then.groupBy(key).agg(F.count(F.lit(1)).alias("h"))
    both = a.join(b, key, "full").select(F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("h", F.lit(0)).alias("h"))
    total = both.agg(F.sum("o").alias("no"), F.sum("h").alias("nh"))
    e = F.col("h") * F.col("no") / F.col("nh")
    return both.crossJoin(F.broadcast(total)).where("h > 0").agg(F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("statistic"), F.count(F.lit(1)).alias("cells"))


def cooled_alerts(alerts: DataFrame, keys: list[str], cooldown: int = 300, hourly: int = 100) -> DataFrame:
    """Alerts that pass a cooldown of seconds by key and a cap by clock hour.

    An alert passes if none passed within the cooldown before it. Where a key is quiet for a cooldown,
    the next alert passes whatever came before, so runs without such a gap are folded apart, in time
    order by ``applyInPandas``. The cap then ranks an hour's alerts.
    """
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        last, keep = None, []
        for t in pdf["ts"]:
            ok = last is None or (t - last).total_seconds() >= cooldown
            keep.append(ok)
            last = t if ok else last
        return pdf[keep]

    order = W.partitionBy(*keys).orderBy("ts", "event_id")
    quiet = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp")) >= cooldown * 1_000_000
    runs = alerts.withColumn("_new", F.when(quiet, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    # runs that follow one another share a call
    schema = runs.schema
    passed = runs.groupBy(*keys, F.floor(F.col("_run") / 1024)).applyInPandas(fold, schema).drop("_new", "_run")
    w = W.partitionBy(F.date_trunc("hour", "ts")).orderBy("ts", "event_id", *keys)
    return passed.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= hourly).drop("_n")


def histogram(log: DataFrame, value: str = "value", start: float = 0.001, buckets: int = 20) -> DataFrame:
    """(bucket, n): exponential buckets with bounds start * 2**i."""
    b = F.when(F.col(value) <= start, 0).otherwise(F.least(F.lit(buckets), F.ceil(F.log2(F.col(value) / start))))
    return log.groupBy(b.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def sessions(log: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """(user_id, session, start, end, n): runs of a user's rows with gaps below ``gap_minutes``."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) < gap_minutes * 60_000_000, 0).otherwise(1)
    s = log.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"))
