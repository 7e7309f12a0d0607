"""Relational operators that Spark has no single call for, and the SQL entry points."""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, bt: str, span: int) -> DataFrame:
    """Pairs of equal keys with 0 < right.bt - left.at <= span.

    Both times are dealt into bins of ``span``; a left row meets its own and the next bin, so the
    join is on equality of keys and bin and needs no theta join over a key's rows.
    """
    a = left.withColumn("_bin", F.explode(F.array(F.floor(F.col(at) / span), F.floor(F.col(at) / span) + 1)))
    b = right.withColumn("_bin", F.floor(F.col(bt) / span))
    return a.join(b, [*keys, "_bin"]).where((F.col(bt) > F.col(at)) & (F.col(bt) - F.col(at) <= span)).drop("_bin")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the last right row of equal keys at or before its time.

    A union sorted by time and one window: every row is shuffled once, and no pairs are made.
    Ties on time go to the greatest value; left rows without a match get null.
    """
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_l", F.lit(1)).unionByName(
        right.select(*keys, at, F.col(value).alias("_v")).withColumn("_l", F.lit(0)), allowMissingColumns=True
    )
    w = W.partitionBy(*keys).orderBy(at, "_l", "_v").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_l = 1").drop("_v", "_l")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of a primary or unique key: keys with their counts above one."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_references(df: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of a foreign key: rows whose keys the target lacks."""
    return df.join(target.select(*keys).distinct(), keys, "left_anti")


def check_violations(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which a check is false; a null passes, as in SQL."""
    return df.where(~F.expr(condition))


def sql_complexity(sql: Column) -> Column:
    """1 + 0.01 a byte, 0.5 a JOIN, 0.3 a SELECT beyond the first, 0.2 a GROUP BY."""
    q = F.upper(sql)
    return (
        1 + 0.01 * F.octet_length(sql) + 0.5 * F.regexp_count(q, F.lit("JOIN"))
        + 0.3 * F.greatest(F.lit(0), F.regexp_count(q, F.lit("SELECT")) - 1) + 0.2 * F.regexp_count(q, F.lit("GROUP BY"))
    )


def sql_pattern(sql: Column) -> Column:
    """The first of WHERE, JOIN, INSERT, UPDATE and DELETE that a statement contains."""
    q, out = F.upper(sql), None
    for word in ("WHERE", "JOIN", "INSERT", "UPDATE", "DELETE"):
        hit = F.contains(q, F.lit(word))
        out = F.when(hit, word) if out is None else out.when(hit, word)
    return out.otherwise("UNKNOWN")


class QueryEngine:
    """SQL text in, DataFrames out, with a plan cache by normalised text and parameters.

    What is cached is the lazy DataFrame: Spark plans it again only if the text, the parameters
    or the tables change. Statistics are kept on the driver, one row for each statement.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.plans: dict[str, DataFrame] = {}
        self.history: list[tuple[str, str, bool]] = []

    def key(self, sql: str, args: dict | None) -> str:
        return hashlib.sha256(json.dumps([" ".join(sql.split()), args or {}], sort_keys=True, default=str).encode()).hexdigest()

    def execute(self, sql: str, args: dict | None = None) -> DataFrame:
        k = self.key(sql, args)
        kind = sql.split(None, 1)[0].upper() if sql.strip() else ""
        try:
            df = self.plans.get(k) or self.spark.sql(sql, args=args or {})
        except Exception:
            self.history.append((sql, kind, False))
            raise
        if kind in ("SELECT", "WITH"):
            self.plans[k] = df
        self.history.append((sql, kind, True))
        return df

    def execute_batch(self, statements: list[tuple[str, dict | None]], threads: int = 4) -> list[DataFrame | Exception]:
        """Several statements at once; an error is the result of its statement alone."""

        def one(x):
            try:
                return self.execute(*x)
            except Exception as e:  # noqa: BLE001  the error is the result
                return e

        with ThreadPoolExecutor(threads) as pool:
            return list(pool.map(one, statements))

    def statistics(self) -> DataFrame:
        """(kind, n, failed) of the statements so far."""
        rows = self.spark.createDataFrame(self.history, "sql string, kind string, ok boolean")
        return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("failed"))

    def pushed_filters(self, df: DataFrame) -> list[str]:
        """The filters that reach the scans of a plan."""
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [x.split("]")[0] for x in plan.split("PushedFilters: [")[1:]]
