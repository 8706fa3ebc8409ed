"""Profile, statistics, schema and segment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.catalog import query
from tallyframe.catalog.fixtures import (
    EVENTS_SQL, ORDER_COLUMNS, ORDERS_SQL, differs_sql, events_dirty, orders_source, orders_target, table,
)
from tallyframe.operators import profile as P
from tallyframe.operators import schemas as S
from tallyframe.operators import segments as G
from tallyframe.operators.reconcile import Comparison, CompareOptions
from tallyframe.operators.rules import Rule, spark_sql

_NUMBERS = ["null_rate", "mean_val", "std_val", "p25", "p50", "p75", "p95"]


def _profile_sql(source: str, column: str, numeric: str | None) -> str:
    x = numeric or "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{column}' AS column_name,
  round(CAST(count(*) - count({column}) AS DOUBLE) / count(*), 6) AS null_rate,
  count(DISTINCT {column}) AS distinct_count, CAST(min({column}) AS VARCHAR) AS min_val,
  CAST(max({column}) AS VARCHAR) AS max_val, round(avg({x}), 4) AS mean_val, round(stddev_samp({x}), 4) AS std_val,
  round(quantile_cont({x}, 0.25), 4) AS p25, round(quantile_cont({x}, 0.5), 4) AS p50,
  round(quantile_cont({x}, 0.75), 4) AS p75, round(quantile_cont({x}, 0.95), 4) AS p95 FROM {source}"""


def _rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*[
        F.round(c, 6 if c == "null_rate" else places).alias(c) if c in _NUMBERS else F.col(c) for c in df.columns
    ])


_LINE_PROFILE = [
    ("l_orderkey", "l_orderkey"), ("l_partkey", "l_partkey"), ("l_suppkey", "l_suppkey"),
    ("l_linenumber", "l_linenumber"), ("l_quantity", "l_quantity"), ("l_extendedprice", "l_extendedprice"),
    ("l_discount", "l_discount"), ("l_tax", "l_tax"), ("l_returnflag", None), ("l_linestatus", None),
    ("l_shipdate", None),
]


@query("profile_columns", " UNION ALL ".join(_profile_sql("lineitem", c, x) for c, x in _LINE_PROFILE))
def profile_columns(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(P.profile(table(spark, folder, "lineitem")))


_TEXT_NUM = "try_cast(value_text AS DOUBLE)"


@query(
    "profile_numeric_text",
    f"WITH {EVENTS_SQL} {_profile_sql('ev', 'value_text', _TEXT_NUM)} UNION ALL {_profile_sql('ev', 'event_type', None)}",
)
def profile_numeric_text(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(P.profile(events_dirty(spark, folder), ["value_text", "event_type"]))


@query(
    "profile_drift",
    f"""WITH {EVENTS_SQL}, cur AS ({_profile_sql('ev', 'value', 'value')} UNION ALL {_profile_sql('ev', 'user_id', 'user_id')}),
  prev AS ({_profile_sql('events', 'value', 'value')} UNION ALL {_profile_sql('events', 'user_id', 'user_id')})
SELECT c.column_name, concat_ws(',',
  {', '.join(f"CASE WHEN (p.{m} = 0 AND c.{m} <> 0) OR (p.{m} <> 0 AND abs(c.{m} - p.{m}) / abs(p.{m}) * 100 > 10) THEN '{m}' END" for m in P.DRIFT_METRICS)}) AS metrics
FROM cur c JOIN prev p USING (column_name) WHERE metrics <> ''""",
)
def profile_drift(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["value", "user_id"]
    current = P.profile(events_dirty(spark, folder), columns)
    previous = P.profile(table(spark, folder, "events"), columns)
    return P.profile_drift(current, previous, 10.0).withColumn("metrics", F.concat_ws(",", "metrics"))


@query(
    "suggest_rules",
    f"""WITH pr AS ({' UNION ALL '.join(_profile_sql('orders', c, x) for c, x in (('o_totalprice', 'o_totalprice'), ('o_custkey', 'o_custkey'), ('o_orderstatus', None)))})
SELECT 'completeness_ratio' AS type, column_name, CAST(NULL AS DOUBLE) AS percentile,
  round(greatest(0.0, 1.0 - null_rate - 0.05), 3) AS min_value, CAST(NULL AS DOUBLE) AS max_value FROM pr
UNION ALL SELECT 'column_value_between', column_name, NULL, CAST(min_val AS DOUBLE), round(CAST(max_val AS DOUBLE) * 1.1, 4)
FROM pr WHERE try_cast(min_val AS DOUBLE) IS NOT NULL
UNION ALL SELECT 'column_percentile', column_name, 95.0, NULL, round(p95 * 1.2, 4) FROM pr WHERE p95 IS NOT NULL""",
)
def suggest_rules(spark: SparkSession, folder: str) -> DataFrame:
    profiles = P.profile(table(spark, folder, "orders"), ["o_totalprice", "o_custkey", "o_orderstatus"])
    return P.suggest_rules(profiles).select(
        "type", "column_name", "percentile", "min_value", F.round("max_value", 4).alias("max_value")
    )


_DAY = "CAST(date_trunc('day', ts) AS VARCHAR)[1:10]"


def _profile_history(spark: SparkSession, folder: str) -> DataFrame:
    """One profile per day of the events, as a history table."""
    return table(spark, folder, "events").groupBy(
        F.date_format("ts", "yyyy-MM-dd").alias("captured_at"), F.col("event_type").alias("job_name")
    ).agg(F.avg("value").alias("mean_val"), F.max("value").alias("max_val")).withColumn("column_name", F.lit("value"))


@query(
    "preview_rule",
    f"""WITH h AS (SELECT {_DAY} AS d, avg(value) AS m FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT 'column_value_between' AS rule_type, CAST(count(*) AS DOUBLE) AS actual_value FROM h WHERE m < 45 OR m > 55
HAVING count(*) > 0""",
)
def preview_rule(spark: SparkSession, folder: str) -> DataFrame:
    history = _profile_history(spark, folder).where("job_name = 'click'")
    rule = Rule("column_value_between", min_value=45, max_value=55, column="value")
    return P.preview_rule(history, "value", "mean_val", rule).select("rule_type", "actual_value")


@query(
    "latest_profiles",
    f"""WITH h AS (SELECT {_DAY} AS captured_at, event_type AS job_name, avg(value) AS m, max(value) AS hi FROM events GROUP BY 1, 2)
SELECT job_name, captured_at, round(m, 6) AS mean_val, hi AS max_val FROM h
QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY captured_at DESC) = 1""",
)
def latest_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return P.latest_profiles(_profile_history(spark, folder)).select(
        "job_name", "captured_at", F.round("mean_val", 6).alias("mean_val"), "max_val"
    )


@query(
    "profile_history",
    f"""SELECT event_type AS job_name, {_DAY} AS captured_at, round(avg(value), 6) AS mean_val FROM events
WHERE event_type = 'view' GROUP BY 1, 2""",
)
def profile_history(spark: SparkSession, folder: str) -> DataFrame:
    history = _profile_history(spark, folder).where("job_name = 'view' and column_name = 'value'")
    return history.orderBy("captured_at").select(
        "job_name", "captured_at", F.round("mean_val", 6).alias("mean_val")
    )


def _stat_sql(column: str, numeric: bool) -> str:
    def one(source: str, a: str) -> str:
        lo, hi = (f"min({column})", f"max({column})") if numeric else ("NULL", "NULL")
        if column == "o_orderdate":
            lo, hi = f"epoch_us(min({column})) / 1e6", f"epoch_us(max({column})) / 1e6"
        mean, sd, total = (
            (f"avg({column})", f"stddev_samp({column})", f"sum({column})") if numeric else ("NULL",) * 3
        )
        return (
            f"SELECT unnest(['row_count', 'null_count', 'distinct_count', 'mean', 'std_dev', 'sum', 'min_value', 'max_value']) AS metric, "
            f"unnest([CAST(x AS DOUBLE) for x in [CAST(count(*) AS DOUBLE), count(*) - count({column}), count(DISTINCT {column}), "
            f"{mean}, {sd}, {total}, {lo}, {hi}]]) AS {a} FROM {source}"
        )

    return (
        f"SELECT '{column}' AS column_name, metric, a AS source_value, b AS target_value, b - a AS delta "
        f"FROM ({one('src', 'a')}) JOIN ({one('tgt', 'b')}) USING (metric) WHERE abs(a - b) > 1e-6"
    )


@query(
    "column_stats_diff",
    f"""WITH {ORDERS_SQL}, d AS ({' UNION ALL '.join(_stat_sql(c, n) for c, n in (('o_orderkey', True), ('o_custkey', True), ('o_orderstatus', False), ('o_totalprice', True), ('o_orderdate', False), ('o_orderpriority', False)))})
SELECT column_name, metric, round(source_value, 2) AS source_value, round(target_value, 2) AS target_value FROM d
UNION ALL SELECT 'o_clerk', 'present', 0.0, 1.0""",
)
def column_stats_diff(spark: SparkSession, folder: str) -> DataFrame:
    diff = P.column_statistics_diff(
        orders_source(spark, folder), orders_target(spark, folder).withColumn("o_clerk", F.lit("c")), 1e-6
    )
    return diff.select(
        "column_name", "metric", F.round("source_value", 2).alias("source_value"),
        F.round("target_value", 2).alias("target_value"),
    )


@query(
    "result_metrics",
    f"""WITH {EVENTS_SQL}
SELECT 'value_text' AS column_name, count(*) AS row_count, count(*) - count(value_text) AS null_count,
  count(DISTINCT value_text) AS distinct_count, CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value,
  CAST(NULL AS DOUBLE) AS avg_value FROM ev
UNION ALL SELECT 'blank', count(*), count(*) FILTER (WHERE event_id % 7 = 0), count(DISTINCT user_id) FILTER (WHERE event_id % 7 <> 0),
  min(user_id) FILTER (WHERE event_id % 7 <> 0), max(user_id) FILTER (WHERE event_id % 7 <> 0),
  round(avg(user_id) FILTER (WHERE event_id % 7 <> 0), 6) FROM ev""",
)
def result_metrics(spark: SparkSession, folder: str) -> DataFrame:
    ev = events_dirty(spark, folder)
    answer = spark_sql(
        spark,
        "SELECT value_text, CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(user_id AS STRING) END AS blank FROM ev",
        {"ev": ev},
    )
    return P.result_metrics(answer).withColumn("avg_value", F.round("avg_value", 6))


@query(
    "metric_assertions",
    """SELECT 'o_orderkey.distinct_count' AS path, '1.0' AS expected, CAST(CAST(count(DISTINCT o_orderkey) AS DOUBLE) AS VARCHAR) AS actual,
  'metric_mismatch' AS mismatch_type FROM orders
UNION ALL SELECT 'o_clerk.null_count', '0.0', '<missing>', 'metric_mismatch'
UNION ALL SELECT 'row_count', '10', CAST(count(*) AS VARCHAR), 'row_count_above_max' FROM orders""",
)
def metric_assertions(spark: SparkSession, folder: str) -> DataFrame:
    metrics = P.result_metrics(table(spark, folder, "orders").select("o_orderkey", "o_custkey"))
    return P.metric_assertions(
        metrics, {"o_orderkey.distinct_count": 1, "o_orderkey.null_count": 0, "o_clerk.null_count": 0},
        min_rows=1, max_rows=10,
    )


@query(
    "segment_candidates",
    """WITH p AS (SELECT unnest(['l_returnflag', 'l_linestatus', 'l_linenumber', 'l_quantity', 'l_partkey']) AS column_name,
   unnest([count(DISTINCT l_returnflag), count(DISTINCT l_linestatus), count(DISTINCT l_linenumber), count(DISTINCT l_quantity), count(DISTINCT l_partkey)]) AS distinct_count
  FROM lineitem)
SELECT * FROM p WHERE column_name <> 'l_linenumber' AND distinct_count <= 50 ORDER BY distinct_count, column_name LIMIT 3""",
)
def segment_candidates(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_partkey"]
    profiles = P.profile(table(spark, folder, "lineitem"), columns)
    return P.segment_candidates(profiles, ["l_linenumber"]).select("column_name", "distinct_count")


_SEGMENT_ROWS = f"""seg AS (
  SELECT 'missing_in_target' AS kind, s.o_orderstatus AS a, s.o_orderpriority AS b FROM src s
    WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE s.o_orderkey = t.o_orderkey)
  UNION ALL SELECT 'missing_in_source', t.o_orderstatus, t.o_orderpriority FROM tgt t
    WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.o_orderkey = t.o_orderkey)
  UNION ALL {' UNION ALL '.join(
      f"SELECT 'value_diff', coalesce(s.o_orderstatus, t.o_orderstatus), coalesce(s.o_orderpriority, t.o_orderpriority) FROM src s JOIN tgt t ON s.o_orderkey = t.o_orderkey WHERE {differs_sql(c, 1e-9 if c == 'o_totalprice' else None)} = 1"
      for c in ORDER_COLUMNS)})"""


@query(
    "segment_summary",
    f"""WITH {ORDERS_SQL}, {_SEGMENT_ROWS},
 tall AS (SELECT kind, 'o_orderstatus' AS segment_column, coalesce(a, '(null)') AS value FROM seg
          UNION ALL SELECT kind, 'o_orderpriority', coalesce(b, '(null)') FROM seg),
 g AS (SELECT segment_column, value, count(*) AS mismatch_count,
         count(*) FILTER (WHERE kind = 'missing_in_target') AS missing_in_target,
         count(*) FILTER (WHERE kind = 'missing_in_source') AS missing_in_source,
         count(*) FILTER (WHERE kind = 'value_diff') AS value_diff FROM tall GROUP BY 1, 2)
SELECT *, round(100.0 * mismatch_count / (SELECT count(*) FROM seg), 2) AS pct_of_total FROM g
QUALIFY row_number() OVER (PARTITION BY segment_column ORDER BY mismatch_count DESC, value) <= 3""",
)
def segment_summary(spark: SparkSession, folder: str) -> DataFrame:
    segments = ["o_orderstatus", "o_orderpriority"]
    c = Comparison(
        orders_source(spark, folder), orders_target(spark, folder),
        CompareOptions(key_columns=["o_orderkey"], segment_columns=segments),
    )
    return G.segment_summary(c.records(), segments, top_n=3)


@query(
    "segment_drilldown",
    f"""WITH {ORDERS_SQL},
 a AS (SELECT coalesce(o_orderstatus, '(null)') AS value, count(*) AS n FROM src GROUP BY 1),
 b AS (SELECT coalesce(o_orderstatus, '(null)') AS value, count(*) AS n FROM tgt GROUP BY 1)
SELECT coalesce(a.value, b.value) AS value, coalesce(a.n, 0) AS source_count, coalesce(b.n, 0) AS target_count,
  coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL OUTER JOIN b ON a.value = b.value""",
)
def segment_drilldown(spark: SparkSession, folder: str) -> DataFrame:
    return G.segment_drilldown(orders_source(spark, folder), orders_target(spark, folder), "o_orderstatus")


@query(
    "mismatch_distribution",
    f"""WITH {ORDERS_SQL}, r AS (
  SELECT 'o_orderstatus' AS column_name, s.o_orderstatus AS source_value, t.o_orderstatus AS target_value
    FROM src s JOIN tgt t ON s.o_orderkey = t.o_orderkey WHERE {differs_sql('o_orderstatus')} = 1
  UNION ALL SELECT 'o_orderpriority', s.o_orderpriority, t.o_orderpriority
    FROM src s JOIN tgt t ON s.o_orderkey = t.o_orderkey WHERE {differs_sql('o_orderpriority')} = 1)
SELECT column_name, source_value, target_value, count(*) AS occurrences FROM r GROUP BY 1, 2, 3
ORDER BY occurrences DESC, column_name, source_value, target_value LIMIT 6""",
)
def mismatch_distribution(spark: SparkSession, folder: str) -> DataFrame:
    c = Comparison(
        orders_source(spark, folder), orders_target(spark, folder),
        CompareOptions(key_columns=["o_orderkey"], exclude_columns=["o_custkey", "o_totalprice", "o_orderdate"]),
    )
    return G.mismatch_distribution(c.records().where("mismatch_type = 'value_diff'"), 6)


_TYPES_SQL = """lower(CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE data_type END)"""


def _evolved_customer(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("int").alias("c_custkey"), "c_name",
        F.col("c_nationkey").cast("bigint").alias("c_nationkey"),
        F.col("c_acctbal").cast("string").alias("c_acctbal"), F.lit(True).alias("c_active"),
    )


_SCHEMA_SQL = """
prev AS (SELECT column_name AS name, lower(CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE column_type END) AS dtype
         FROM (DESCRIBE SELECT * FROM customer)),
cur AS (SELECT column_name AS name, lower(CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE column_type END) AS dtype
        FROM (DESCRIBE SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
                CAST(c_acctbal AS VARCHAR) AS c_acctbal, true AS c_active FROM customer)),
d AS (SELECT coalesce(c.name, p.name) AS column_name, p.dtype AS from_type, c.dtype AS to_type
      FROM cur c FULL OUTER JOIN prev p ON c.name = p.name WHERE c.dtype IS DISTINCT FROM p.dtype),
g AS (SELECT column_name, CASE WHEN from_type IS NULL THEN 'added' WHEN to_type IS NULL THEN 'removed' ELSE 'changed' END AS change,
        from_type, to_type, CASE WHEN from_type IS NULL THEN 'non_breaking' WHEN to_type IS NULL THEN 'breaking'
          WHEN from_type = 'int' AND to_type = 'bigint' THEN 'non_breaking' WHEN from_type = 'bigint' AND to_type = 'int' THEN 'breaking'
          ELSE 'risky' END AS compatibility FROM d)
"""


@query("schema_diff", f"WITH {_SCHEMA_SQL} SELECT * FROM g")
def schema_diff(spark: SparkSession, folder: str) -> DataFrame:
    return S.schema_diff(
        S.snapshot(_evolved_customer(spark, folder)), S.snapshot(table(spark, folder, "customer"))
    )


@query(
    "schema_compat",
    f"""WITH {_SCHEMA_SQL} SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed,
  count(*) FILTER (WHERE change = 'changed') AS changed,
  CASE max(CASE compatibility WHEN 'breaking' THEN 3 WHEN 'risky' THEN 2 WHEN 'non_breaking' THEN 1 ELSE 0 END)
    WHEN 3 THEN 'breaking' WHEN 2 THEN 'risky' WHEN 1 THEN 'non_breaking' ELSE 'full' END AS compatibility FROM g""",
)
def schema_compat(spark: SparkSession, folder: str) -> DataFrame:
    return S.compatibility(schema_diff(spark, folder))


@query(
    "schema_history",
    f"""WITH {_SCHEMA_SQL}
SELECT 'customers' AS job_name, 'prod' AS env, captured_at, column_name, change, compatibility FROM (
  SELECT 2 AS captured_at, column_name, change, compatibility FROM g
  UNION ALL SELECT 3, column_name, CASE change WHEN 'added' THEN 'removed' WHEN 'removed' THEN 'added' ELSE change END,
    CASE WHEN change = 'added' THEN 'breaking' WHEN change = 'removed' THEN 'non_breaking'
         WHEN compatibility = 'breaking' THEN 'non_breaking' WHEN compatibility = 'non_breaking' THEN 'breaking' ELSE compatibility END FROM g)""",
)
def schema_history(spark: SparkSession, folder: str) -> DataFrame:
    first = S.snapshot(table(spark, folder, "customer"))
    second = S.snapshot(_evolved_customer(spark, folder))
    history = None
    for at, snap in ((1, first), (2, second), (3, first)):
        rows = snap.select(
            F.lit("customers").alias("job_name"), F.lit("prod").alias("env"), F.lit(at).alias("captured_at"),
            "name", "dtype",
        )
        history = rows if history is None else history.unionByName(rows)
    return S.snapshot_history_diffs(history).drop("from_type", "to_type")


@query(
    "expected_schema",
    """SELECT unnest(['c_phone', 'c_mktsegment', 'c_acctbal']) AS column_name,
  unnest(['missing_in_target', 'extra_in_target', 'type_mismatch']) AS problem,
  unnest(['string', NULL, 'int64']) AS expected_type, unnest([NULL, 'string', 'float64']) AS actual_type
FROM (SELECT count(*) FROM customer)""",
)
def expected_schema(spark: SparkSession, folder: str) -> DataFrame:
    return S.expected_schema_diff(
        table(spark, folder, "customer"),
        {"c_custkey": "long", "c_name": "str", "c_nationkey": "Integer", "c_acctbal": "bigint", "c_phone": "string"},
    )


@query(
    "catalog_compare",
    """SELECT unnest(['c_mktsegment', 'c_note', 'c_acctbal']) AS subject,
  unnest(['missing_column', 'extra_column', 'type_mismatch']) AS problem,
  unnest(['string', NULL, 'float64']) AS source_value, unnest([NULL, 'string', 'string']) AS target_value
FROM (SELECT count(*) FROM customer)""",
)
def catalog_compare(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "customer").createOrReplaceTempView("tf_catalog_source")
    table(spark, folder, "customer").select(
        "c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("string").alias("c_acctbal"),
        F.lit("n").alias("c_note"),
    ).createOrReplaceTempView("tf_catalog_target")
    return S.compare_catalog_tables(spark, "tf_catalog_source", "tf_catalog_target")
