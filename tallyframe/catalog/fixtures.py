"""Drifted copies of the given tables, as Spark frames and as SQL with the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders_source(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").withColumn(
        "o_orderstatus", F.when(k % 106 != 0, F.col("o_orderstatus"))
    )


def orders_target(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    drifted = base.where(k % 97 != 0).select(
        k,
        F.when(k % 59 == 0, F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(k % 53 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 31 == 0, price + 1.0).when(k % 37 == 0, price + 0.001).otherwise(price).alias("o_totalprice"),
        F.when(k % 47 == 0, F.col("o_orderdate") + F.expr("interval 1 second"))
        .otherwise(F.col("o_orderdate")).alias("o_orderdate"),
        F.when(k % 41 == 0, F.lower(priority))
        .when(k % 43 == 0, F.concat(F.lit("  "), F.replace(priority, F.lit(" "), F.lit("  ")), F.lit(" ")))
        .otherwise(priority).alias("o_orderpriority"),
    )
    added = base.where(k % 101 == 0).withColumn("o_orderkey", k + 10_000_000)
    return drifted.unionByName(added)


ORDERS_SQL = """
src AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderkey % 106 <> 0 THEN o_orderstatus END AS o_orderstatus,
         o_totalprice, o_orderdate, o_orderpriority
  FROM orders),
tgt AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 59 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS o_custkey,
         CASE WHEN o_orderkey % 53 <> 0 THEN o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 31 = 0 THEN o_totalprice + CAST(1.0 AS DOUBLE)
              WHEN o_orderkey % 37 = 0 THEN o_totalprice + CAST(0.001 AS DOUBLE)
              ELSE o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 47 = 0 THEN o_orderdate + INTERVAL 1 SECOND ELSE o_orderdate END AS o_orderdate,
         CASE WHEN o_orderkey % 41 = 0 THEN lower(o_orderpriority)
              WHEN o_orderkey % 43 = 0 THEN '  ' || replace(o_orderpriority, ' ', '  ') || ' '
              ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL
  SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 101 = 0)
"""

ORDER_COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def differs_sql(column: str, tolerance: float | None = None, s: str = "s", t: str = "t") -> str:
    a, b = f"{s}.{column}", f"{t}.{column}"
    equal = f"abs({a} - {b}) <= {tolerance!r}" if tolerance is not None else f"{a} = {b}"
    return (
        f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 0"
        f" WHEN {a} IS NULL OR {b} IS NULL THEN 1 WHEN {equal} THEN 0 ELSE 1 END"
    )


def events_dirty(spark: SparkSession, folder: str) -> DataFrame:
    k, v = F.col("event_id"), F.col("value")
    return table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "event_type",
        F.when(k % 997 == 0, v * 100).otherwise(v).alias("value"),
        F.when(k % 61 == 0, F.lit("n/a")).otherwise(v.cast("string")).alias("value_text"),
    )


EVENTS_SQL = """
ev AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_id % 997 = 0 THEN value * 100 ELSE value END AS value,
         CASE WHEN event_id % 61 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value_text
  FROM events)
"""
