"""Queries over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.operators import anomaly as A
from trawl.plans import registry
from trawl.plans.registry import query
from trawl.session import table


def log(spark, sf_dir):
    return A.query_log(table(spark, sf_dir, "events"))


@query("log_zscore_outliers", "SELECT event_id, round(abs(value - m) / s, 6) AS z FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) WHERE abs(value - m) / s > 3")
def log_zscore_outliers(spark, sf_dir):
    return A.zscore_outliers(log(spark, sf_dir)).select("event_id", F.round("z", 6).alias("z"))


@query(
    "log_iqr_outliers",
    "SELECT event_id FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)",
)
def log_iqr_outliers(spark, sf_dir):
    return A.iqr_outliers(log(spark, sf_dir)).select("event_id")


@query(
    "log_rolling",
    """SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(coalesce(stddev_samp(value) OVER w, 0), 6) AS std, round(min(value) OVER w, 6) AS least, round(max(value) OVER w, 6) AS greatest FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING)""",
)
def log_rolling(spark, sf_dir):
    r = A.rolling(log(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    return r.select("event_id", *[F.round(c, 6).alias(c) for c in ("mean", "std", "least", "greatest")])


@query("log_hourly", "SELECT hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def log_hourly(spark, sf_dir):
    return log(spark, sf_dir).groupBy(F.hour("ts").alias("hour"), F.weekday("ts").alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"))


_PROFILE = "count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99"


@query("log_profile", f"SELECT {_PROFILE}, round(median(value), 6) AS median FROM events")
def log_profile(spark, sf_dir):
    return A.profile(log(spark, sf_dir)).select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "p95", "p99")])


@query("log_baselines", f"SELECT hour(ts)::INT AS hour, {_PROFILE} FROM events GROUP BY GROUPING SETS ((hour(ts)), ())")
def log_baselines(spark, sf_dir):
    return A.baselines(log(spark, sf_dir)).select("hour", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p95", "p99")])


@query(
    "log_user_profiles",
    """WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) AS k FROM c),
    u AS (SELECT user_id, count(*) AS n, round(avg(value), 9) AS mean FROM events GROUP BY 1 HAVING count(*) >= 5)
    SELECT u.user_id, n, mean, (SELECT string_agg(event_type, ',' ORDER BY k) FROM r WHERE r.user_id = u.user_id AND k <= 3) AS kinds FROM u""",
)
def log_user_profiles(spark, sf_dir):
    return A.user_profiles(log(spark, sf_dir)).select("user_id", "n", F.round("mean", 9).alias("mean"), F.array_join("top_kinds", ",").alias("kinds"))


@query(
    "log_rule_anomalies",
    """WITH b AS (SELECT avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.95) AS p FROM events), r AS (SELECT event_id, 'slow' AS rule, value AS actual, p AS expected FROM events, b WHERE value > p + 2.5 * s UNION ALL SELECT event_id, 'error', 500, 200 FROM events WHERE event_type = 'error'),
    d AS (SELECT *, abs(actual - expected) / expected AS dev FROM r) SELECT event_id, rule, round(dev, 6) AS deviation, CASE WHEN dev > 5 THEN 'critical' WHEN dev > 3 THEN 'high' WHEN dev > 2 THEN 'medium' ELSE 'low' END AS severity, round(least(1, dev / 2), 6) AS confidence FROM d""",
)
def log_rule_anomalies(spark, sf_dir):
    l = log(spark, sf_dir)
    return A.rule_anomalies(l, A.profile(l)).select("event_id", "rule", F.round("deviation", 6).alias("deviation"), "severity", F.round("confidence", 6).alias("confidence"))


@query(
    "log_seasonal_anomalies",
    """WITH h AS (SELECT hour(ts)::INT AS hour, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE day(ts) <= 15 GROUP BY 1), n AS (SELECT hour(ts)::INT AS hour, count(*) AS n, avg(value) AS m FROM events WHERE day(ts) > 15 GROUP BY 1 HAVING count(*) >= 5)
    SELECT hour, n.n AS now_n, round(n.m, 6) AS now_mean FROM n JOIN h USING (hour) WHERE abs(n.m - h.m) > 0.05 * h.s""",
)
def log_seasonal_anomalies(spark, sf_dir):
    l = log(spark, sf_dir)
    found = A.seasonal_anomalies(l.where("day(ts) > 15"), A.baselines(l.where("day(ts) <= 15")), k=0.05)
    return found.select("hour", "now_n", F.round("now_mean", 6).alias("now_mean"))


@query(
    "log_chi_square",
    """WITH o AS (SELECT event_type AS k, count(*) AS o FROM events WHERE day(ts) > 15 GROUP BY 1), h AS (SELECT event_type AS k, count(*) AS h FROM events WHERE day(ts) <= 15 GROUP BY 1),
    b AS (SELECT coalesce(o, 0) AS o, h, h * (SELECT sum(o) FROM o) / (SELECT sum(h) FROM h) AS e FROM h LEFT JOIN o USING (k)) SELECT round(sum((o - e) * (o - e) / e), 6) AS statistic, count(*) AS cells FROM b""",
)
def log_chi_square(spark, sf_dir):
    l = log(spark, sf_dir)
    return A.chi_square(l.where("day(ts) > 15"), l.where("day(ts) <= 15"), "kind").select(F.round("statistic", 6).alias("statistic"), "cells")


@query("log_histogram", "SELECT CASE WHEN value <= 0.001 THEN 0 ELSE least(20, ceil(log2(value / 0.001))) END::INT AS bucket, count(*) AS n FROM events GROUP BY 1")
def log_histogram(spark, sf_dir):
    return A.histogram(log(spark, sf_dir))


@query(
    "log_sessions",
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n, (max(epoch_us(ts)) - min(epoch_us(ts)))::BIGINT AS span FROM s GROUP BY user_id, session""",
)
def log_sessions(spark, sf_dir):
    s = A.sessions(log(spark, sf_dir))
    return s.select("user_id", "session", "n", (F.unix_micros("end") - F.unix_micros("start")).alias("span"))


RULES = registry.sql("log_rule_anomalies")


@query("log_anomaly_statistics", f"SELECT rule, severity, count(*) AS n FROM ({RULES}) GROUP BY ALL")
def log_anomaly_statistics(spark, sf_dir):
    l = log(spark, sf_dir)
    return A.rule_anomalies(l, A.profile(l)).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "log_cooled_alerts",
    f"""WITH RECURSIVE a AS MATERIALIZED (SELECT event_id, ts, rule, severity FROM ({RULES}) JOIN events USING (event_id)), p AS (SELECT rule, severity, min(ts) AS ts FROM a GROUP BY ALL UNION ALL SELECT p.rule, p.severity, min(a.ts) FROM p JOIN a ON a.rule = p.rule AND a.severity = p.severity AND a.ts >= p.ts + INTERVAL 300 SECOND GROUP BY ALL),
    q AS (SELECT min(event_id) AS event_id, ts, rule, severity FROM a JOIN p USING (rule, severity, ts) GROUP BY ALL) SELECT event_id, rule, severity FROM q QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id, rule, severity) <= 100""",
)
def log_cooled_alerts(spark, sf_dir):
    """Alerts after cooldown and cap: an order-dependent fold."""
    l = log(spark, sf_dir)
    a = A.rule_anomalies(l, A.profile(l)).select("event_id", "ts", "rule", "severity")
    return A.cooled_alerts(a, ["rule", "severity"]).select("event_id", "rule", "severity")


@query("log_click_rate", "SELECT CAST(json_extract(props, '$.k') AS INT) AS item, round(count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type IN ('click', 'view')), 6) AS ctr FROM events GROUP BY 1 HAVING count(*) FILTER (event_type IN ('click', 'view')) > 0")
def log_click_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("item"))
    n, c = F.count_if(F.col("event_type").isin("click", "view")), F.count_if(F.col("event_type") == "click")
    return e.agg(c.alias("c"), n.alias("n")).where("n > 0").select("item", F.round(F.col("c") / F.col("n"), 6).alias("ctr"))


@query("log_load_statistics", "SELECT event_type AS kind, count(*) AS n, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 6) AS rps, round(avg(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END), 6) AS success FROM events GROUP BY 1")
def log_load_statistics(spark, sf_dir):
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1_000_000
    return log(spark, sf_dir).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / span, 6).alias("rps"), F.round(F.avg((F.col("status") < 400).cast("int")), 6).alias("success")
    )


_REP = """WITH u AS (SELECT CAST(json_extract(props, '$.k') AS INT) AS domain, event_type AS source, value / (SELECT max(value) FROM events) AS score, ts, event_id FROM events)"""


def updates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    top = e.agg(F.max("value").alias("top"))
    return e.crossJoin(F.broadcast(top)).select(
        F.get_json_object("props", "$.k").cast("int").alias("domain"), F.col("event_type").alias("source"), (F.col("value") / F.col("top")).alias("score"), "ts", "event_id"
    )


@query(
    "reputation_score",
    _REP + """, l AS (SELECT domain, source, max_by(score, (ts, event_id)) AS score FROM u GROUP BY ALL), w AS (SELECT *, CASE source WHEN 'view' THEN 0.4 WHEN 'click' THEN 0.3 WHEN 'purchase' THEN 0.2 WHEN 'signup' THEN 0.1 ELSE 1.0 END AS w FROM l),
    s AS (SELECT domain, sum(w * score) / sum(w) AS score FROM w GROUP BY domain) SELECT domain, round(score, 6) AS score, CASE WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.6 THEN 'good' WHEN score >= 0.4 THEN 'fair' WHEN score >= 0.2 THEN 'poor' ELSE 'bad' END AS level FROM s""",
)
def reputation_score(spark, sf_dir):
    from trawl.operators.quality import reputation

    r = reputation(updates(spark, sf_dir), {"view": 0.4, "click": 0.3, "purchase": 0.2, "signup": 0.1})
    return r.select("domain", F.round("score", 6).alias("score"), "level")


@query(
    "reputation_trend",
    _REP + """, w AS (SELECT *, first_value(score) OVER t AS f, stddev_pop(score) OVER t AS v, avg(score) OVER t AS m, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) AS k FROM u WINDOW t AS (PARTITION BY domain ORDER BY ts, event_id ROWS 9 PRECEDING))
    SELECT domain, CASE WHEN score - f > 0.1 THEN 'up' WHEN score - f < -0.1 THEN 'down' ELSE 'stable' END AS direction, round(abs(score - f), 6) AS strength, round(v, 6) AS volatility, round(m, 6) AS mean FROM w WHERE k = 1""",
)
def reputation_trend(spark, sf_dir):
    from trawl.operators.quality import reputation_trend as trend

    t = trend(updates(spark, sf_dir))
    return t.select("domain", "direction", *[F.round(c, 6).alias(c) for c in ("strength", "volatility", "mean")])


@query(
    "reputation_alerts",
    _REP + """, l AS (SELECT *, lag(score) OVER (PARTITION BY domain ORDER BY ts, event_id) AS old FROM u)
    SELECT event_id, CASE WHEN old - score > 0.2 THEN 'drop' ELSE 'rise' END AS alert, CASE WHEN old - score > 0.5 * old THEN 'high' ELSE 'medium' END AS severity FROM l WHERE old - score > 0.2 OR score - old > 0.3""",
)
def reputation_alerts(spark, sf_dir):
    from trawl.operators.quality import reputation_alerts as alerts

    return alerts(updates(spark, sf_dir)).select("event_id", "alert", "severity")
