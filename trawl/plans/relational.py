"""The relational surface: joins, windows, grouping sets, set operations, constraints, SQL statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.operators import relational as R
from trawl.plans.registry import query
from trawl.session import table, views


def t(spark, sf_dir, name):
    return table(spark, sf_dir, name)


@query(
    "rel_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def rel_pricing_summary(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"),
    )


_TOP_SQL = """SELECT n.n_name AS nation, c.c_mktsegment AS segment, round(sum(o.o_totalprice), 2) AS total, count(*) AS orders
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, c.c_mktsegment ORDER BY total DESC, nation, segment LIMIT 20"""


@query("rel_join_topk", _TOP_SQL)
def rel_join_topk(spark, sf_dir):
    """The SQL entry point: text in, DataFrame out; Catalyst picks the joins."""
    views(spark, sf_dir, "orders", "customer", "nation")
    return spark.sql(_TOP_SQL)


@query("rel_semi_join", "SELECT count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)")
def rel_semi_join(spark, sf_dir):
    big = t(spark, sf_dir, "orders").where("o_totalprice > 100000")
    c = t(spark, sf_dir, "customer")
    return c.join(big, c["c_custkey"] == big["o_custkey"], "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("rel_anti_join", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def rel_anti_join(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


@query(
    "rel_outer_join",
    "SELECT n_name, count(s_suppkey) AS suppliers, round(coalesce(sum(s_acctbal), 0), 2) AS balance FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
)
def rel_outer_join(spark, sf_dir):
    n, s = t(spark, sf_dir, "nation"), t(spark, sf_dir, "supplier")
    return n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").groupBy("n_name").agg(
        F.count("s_suppkey").alias("suppliers"), F.round(F.coalesce(F.sum("s_acctbal"), F.lit(0)), 2).alias("balance")
    )


@query(
    "rel_full_outer_distribution",
    """WITH a AS (SELECT event_type AS k, count(*) AS x FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS k, count(*) AS y FROM events WHERE event_id % 2 = 1 AND event_type <> 'error' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN b ON a.k = b.k""",
)
def rel_full_outer_distribution(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    a = e.where("event_id % 2 = 0").groupBy(F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("x"))
    b = e.where("event_id % 2 = 1 AND event_type <> 'error'").groupBy(F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("y"))
    return a.join(b, "k", "full").select("k", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))


@query(
    "rel_range_join",
    """SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR""",
)
def rel_range_join(spark, sf_dir):
    """Clicks with the purchases of the same user in the six hours after: an interval join by time bins."""
    e = t(spark, sf_dir, "events")
    left = e.where("event_type = 'click'").select(F.col("event_id").alias("a"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    right = e.where("event_type = 'purchase'").select(F.col("event_id").alias("b"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("bt"))
    return R.interval_join(left, right, ["user_id"], "at", "bt", 6 * 3600 * 1_000_000).select("a", "b")


@query(
    "rel_asof_join",
    """SELECT p.event_id, (SELECT max_by(c.event_id, (c.ts, c.event_id)) FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts <= p.ts) AS click_id FROM events p WHERE p.event_type = 'purchase'""",
)
def rel_asof_join(spark, sf_dir):
    """Each purchase with the last click of its user at or before it."""
    e = t(spark, sf_dir, "events")
    buy = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    click = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return R.asof_join(buy, click, ["user_id"], "ts", "click_id").select("event_id", "click_id")


@query(
    "rel_rollup",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
)
def rel_rollup(spark, sf_dir):
    return t(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("rel_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rel_cube(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("rel_facets", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def rel_facets(spark, sf_dir):
    """Facet counts of a result in one pass."""
    views(spark, sf_dir, "documents")
    return spark.sql("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")


@query("rel_pivot", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def rel_pivot(spark, sf_dir):
    e = t(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).count()
    return e.select("user_id", F.coalesce("click", F.lit(0)).alias("click"), F.coalesce("view", F.lit(0)).alias("view"))


@query(
    "rel_rank_per_group",
    "SELECT c_mktsegment, c_custkey, rank() OVER w AS r, dense_rank() OVER w AS d FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY round(c_acctbal, -2) DESC) QUALIFY r <= 5",
)
def rel_rank_per_group(spark, sf_dir):
    w = W.partitionBy("c_mktsegment").orderBy(F.round("c_acctbal", -2).desc())
    c = t(spark, sf_dir, "customer")
    return c.select("c_mktsegment", "c_custkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d")).where("r <= 5")


@query(
    "rel_running_total",
    "SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders",
)
def rel_running_total(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = t(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0)), 2).alias("running"), F.lag("o_orderkey").over(w).alias("before"))


@query(
    "rel_range_frame",
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS last_day FROM events",
)
def rel_range_frame(spark, sf_dir):
    """A true sliding window: a user's requests in the day up to each."""
    e = t(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    w = W.partitionBy("user_id").orderBy("at").rangeBetween(-86_400_000_000, 0)
    return e.select("event_id", F.count(F.lit(1)).over(w).alias("last_day"))


@query("rel_set_operations", "(SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def rel_set_operations(spark, sf_dir):
    s, c = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), t(spark, sf_dir, "customer").select("c_nationkey")
    return s.intersect(c).exceptAll(t(spark, sf_dir, "nation").where("n_regionkey = 0").select("n_nationkey"))


@query("rel_union_by_name", "SELECT name, sum(balance)::DECIMAL(18,2)::DOUBLE AS balance FROM (SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier) GROUP BY name")
def rel_union_by_name(spark, sf_dir):
    c = t(spark, sf_dir, "customer").selectExpr("c_name AS name", "c_acctbal AS balance")
    s = t(spark, sf_dir, "supplier").selectExpr("s_acctbal AS balance", "s_name AS name")
    return c.unionByName(s).groupBy("name").agg(F.round(F.sum("balance"), 2).alias("balance"))


@query("rel_approx_distinct")
def rel_approx_distinct(spark, sf_dir):
    """Vocabulary size by a sketch, where the reference keeps a Bloom filter; tested within 5 %."""
    return t(spark, sf_dir, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("rel_json_scalar", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def rel_json_scalar(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(
    "rel_trending",
    """SELECT CAST(json_extract(props, '$.k') AS INT) AS item, count(*) AS views FROM events WHERE event_type = 'view' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1 ORDER BY views DESC, item LIMIT 20""",
)
def rel_trending(spark, sf_dir):
    """Items most viewed in the seven days before the last event."""
    e = t(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("last"))
    return (
        e.where("event_type = 'view'").join(F.broadcast(last), F.expr("ts >= last - INTERVAL 7 DAYS"))
        .groupBy(F.get_json_object("props", "$.k").cast("int").alias("item")).agg(F.count(F.lit(1)).alias("views"))
        .orderBy(F.desc("views"), "item").limit(20)
    )


@query("rel_primary_key_violations", "SELECT doc_id AS key, count(*) AS n FROM (SELECT o_custkey AS doc_id FROM orders) GROUP BY 1 HAVING count(*) > 1")
def rel_primary_key_violations(spark, sf_dir):
    return R.duplicate_keys(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), ["key"])


@query("rel_foreign_key_violations", "SELECT DISTINCT p.p_partkey AS key FROM part p WHERE p.p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def rel_foreign_key_violations(spark, sf_dir):
    parts = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    return R.missing_references(parts, t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("key")), ["key"]).distinct()


@query("rel_check_violations", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_discount <= 0.05 OR l_quantity > 10)")
def rel_check_violations(spark, sf_dir):
    return R.check_violations(t(spark, sf_dir, "lineitem"), "l_discount <= 0.05 OR l_quantity > 10").select("l_orderkey", "l_linenumber")


# a log of statements for the statement statistics: fixed values
STATEMENTS = [
    "SELECT * FROM a WHERE x = 1", "SELECT a.x FROM a JOIN b ON a.k = b.k", "INSERT INTO a VALUES (1)", "UPDATE a SET x = 2", "DELETE FROM a",
    "SELECT x, count(*) FROM (SELECT * FROM a) GROUP BY x", "CREATE TABLE c (x INT)", "select 1",
]


@query(
    "sql_complexity",
    "WITH s(sql) AS (VALUES " + ", ".join(f"('{x}')" for x in STATEMENTS) + """), u AS (SELECT sql, upper(sql) AS q FROM s)
    SELECT sql, round(1 + 0.01 * strlen(sql) + 0.5 * len(regexp_extract_all(q, 'JOIN')) + 0.3 * greatest(0, len(regexp_extract_all(q, 'SELECT')) - 1) + 0.2 * len(regexp_extract_all(q, 'GROUP BY')), 6) AS complexity,
    CASE WHEN q LIKE '%WHERE%' THEN 'WHERE' WHEN q LIKE '%JOIN%' THEN 'JOIN' WHEN q LIKE '%INSERT%' THEN 'INSERT' WHEN q LIKE '%UPDATE%' THEN 'UPDATE' WHEN q LIKE '%DELETE%' THEN 'DELETE' ELSE 'UNKNOWN' END AS pattern FROM u""",
)
def sql_complexity(spark, sf_dir):
    s = spark.createDataFrame([(x,) for x in STATEMENTS], "sql string")
    return s.select("sql", F.round(R.sql_complexity(F.col("sql")), 6).alias("complexity"), R.sql_pattern(F.col("sql")).alias("pattern"))
