"""Data-quality rule queries; bounds are chosen so that rules fire and report their value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.catalog import query
from tallyframe.catalog.fixtures import (
    EVENTS_SQL, ORDERS_SQL, events_dirty, orders_source, orders_target, table,
)
from tallyframe.operators.rules import Rule, evaluate, rolling_zscore, violations_frame


def _report(spark: SparkSession, found, places: int = 6) -> DataFrame:
    return violations_frame(spark, found).select(
        "rule_index", "rule_type", "column_name", "severity",
        F.round("actual_value", places).alias("actual_value"),
    )


def _expected(ctes: str, source: str, parts: list[tuple], places: int = 6) -> str:
    """Expected violations from (type, column, SQL value, severity) in rule order."""
    rows = []
    for i, (kind, column, value, *severity) in enumerate(parts):
        shown = "NULL" if column is None else f"'{column}'"
        rows.append(
            f"SELECT {i} AS rule_index, '{kind}' AS rule_type, CAST({shown} AS VARCHAR) AS column_name, "
            f"'{severity[0] if severity else 'error'}' AS severity, "
            f"round(CAST({value} AS DOUBLE), {places}) AS actual_value FROM {source}"
        )
    body = " UNION ALL ".join(rows)
    return f"WITH {ctes} SELECT * FROM ({body}) WHERE actual_value IS NOT NULL"


def _n(condition: str) -> str:
    return f"nullif(count(*) FILTER (WHERE {condition}), 0)"


_ROW_RULES = [
    Rule("not_null", "o_orderstatus"),
    Rule("unique", "o_custkey", severity="warn"),
    Rule("row_count_min", min_value=1e9),
    Rule("row_count_max", max_value=10),
    Rule("row_count_between", min_value=1, max_value=10),
    Rule("match_regex", "o_orderpriority", pattern="[1-5]-[A-Z]+"),
    Rule("custom_sql", sql="o_totalprice > 400000"),
    Rule("column_max_length", "o_orderpriority", max_value=8),
    Rule("column_min_length", "o_orderpriority", min_value=6),
    Rule("value_in_set", "o_orderstatus", values=["O", "F"]),
    Rule("value_not_in_set", "o_orderstatus", sql="P, X", severity="warn"),
    Rule("column_contains", "o_orderpriority", pattern="E"),
    Rule("date_range", "o_orderdate", min_date="1996-01-01", max_date="1998-12-31"),
    Rule("pii_mask_check", "o_orderpriority", pattern=r"\s*\d-HIGH"),
    Rule("no_whitespace", "o_orderpriority"),
    Rule("not_null", "o_orderkey"),
    Rule("not_null", "no_such_column"),
]


@query(
    "dq_row_rules",
    _expected(ORDERS_SQL, "tgt", [
        ("not_null", "o_orderstatus", _n("o_orderstatus IS NULL")),
        ("unique", "o_custkey", "nullif(count(*) - count(DISTINCT o_custkey), 0)", "warn"),
        ("row_count_min", None, "count(*)"),
        ("row_count_max", None, "count(*)"),
        ("row_count_between", None, "count(*)"),
        ("match_regex", "o_orderpriority", _n("NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z]+')")),
        ("custom_sql", None, _n("o_totalprice > 400000")),
        ("column_max_length", "o_orderpriority", _n("length(o_orderpriority) > 8")),
        ("column_min_length", "o_orderpriority", _n("length(o_orderpriority) < 6")),
        ("value_in_set", "o_orderstatus", _n("coalesce(o_orderstatus, 'None') NOT IN ('O', 'F')")),
        ("value_not_in_set", "o_orderstatus", _n("o_orderstatus IN ('P', 'X')"), "warn"),
        ("column_contains", "o_orderpriority", _n("NOT contains(o_orderpriority, 'E')")),
        ("date_range", "o_orderdate",
         _n("o_orderdate IS NULL OR o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate > TIMESTAMP '1998-12-31'")),
        ("pii_mask_check", "o_orderpriority", _n(r"regexp_matches(o_orderpriority, '^\s*\d-HIGH')")),
        ("no_whitespace", "o_orderpriority", _n("o_orderpriority <> trim(o_orderpriority)")),
    ]),
)
def dq_row_rules(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, evaluate(orders_target(spark, folder), _ROW_RULES))


_NUM = "try_cast(value_text AS DOUBLE)"


@query(
    "dq_numeric_text_rules",
    _expected(EVENTS_SQL, "ev", [
        ("positive_values", "value_text", _n(f"{_NUM} IS NULL OR {_NUM} <= 0")),
        ("negative_values", "value_text", _n(f"{_NUM} IS NULL OR {_NUM} >= 0")),
        ("column_type_check", "value_text", _n(f"value_text IS NOT NULL AND {_NUM} IS NULL")),
        ("column_type_check", "event_type", "count(*)"),
        ("column_type_check", "event_type", "count(*)"),
        ("column_value_between", "value_text", _n(f"{_NUM} < 5 OR {_NUM} > 60")),
        ("cross_column_consistency", "value", _n("value > user_id")),
        ("cross_column_consistency", "value", _n("value < user_id")),
        ("cross_column_consistency", "value_text", _n(f"{_NUM} IS NULL OR {_NUM} <> value")),
        ("value_in_set", "event_type", _n("event_type NOT IN ('click', 'view')")),
    ]),
)
def dq_numeric_text_rules(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, evaluate(events_dirty(spark, folder), [
        Rule("positive_values", "value_text"),
        Rule("negative_values", "value_text"),
        Rule("column_type_check", "value_text", expected_type="float"),
        Rule("column_type_check", "event_type", expected_type="date"),
        Rule("column_type_check", "event_type", expected_type="uuid"),
        Rule("column_value_between", "value_text", min_value=5, max_value=60),
        Rule("cross_column_consistency", "value", column_b="user_id"),
        Rule("cross_column_consistency", "value", column_b="user_id", operator=">="),
        Rule("cross_column_consistency", "value_text", column_b="value", operator="=="),
        Rule("value_in_set", "event_type", sql="click, view"),
    ]))


@query(
    "dq_agg_rules",
    _expected("li AS (FROM lineitem)", "li", [
        ("column_mean_between", "l_extendedprice", "avg(l_extendedprice)"),
        ("completeness_ratio", "l_tax", "count(l_tax) / count(*)"),
        ("distinct_count_between", "l_partkey", "count(DISTINCT l_partkey)"),
        ("column_sum_between", "l_quantity", "sum(l_quantity)"),
        ("column_std_dev_between", "l_extendedprice", "stddev_samp(l_extendedprice)"),
        ("column_percentile", "l_extendedprice", "quantile_cont(l_extendedprice, 0.95)"),
        ("column_percentile", "l_quantity", "quantile_cont(l_quantity, 0.5)"),
        ("column_percentile", "l_extendedprice", "quantile_cont(l_extendedprice, 0.333)"),
    ], 3),
)
def dq_agg_rules(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, evaluate(table(spark, folder, "lineitem"), [
        Rule("column_mean_between", "l_extendedprice", min_value=0, max_value=1),
        Rule("completeness_ratio", "l_tax", min_value=1.5),
        Rule("distinct_count_between", "l_partkey", max_value=3),
        Rule("column_sum_between", "l_quantity", max_value=1),
        Rule("column_std_dev_between", "l_extendedprice", max_value=1),
        Rule("column_percentile", "l_extendedprice", percentile=95, max_value=1),
        Rule("column_percentile", "l_quantity", percentile=50, max_value=1),
        Rule("column_percentile", "l_extendedprice", percentile=33.3, max_value=1),
    ]), 3)


@query(
    "dq_undefined_aggregates",
    """SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS rule_index,
       unnest(['column_mean_between', 'column_std_dev_between', 'column_percentile']) AS rule_type,
       CAST(NULL AS DOUBLE) AS actual_value FROM (SELECT count(*) FROM events)""",
)
def dq_undefined_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    found = evaluate(table(spark, folder, "events").select("event_type"), [
        Rule("column_mean_between", "event_type", min_value=0),
        Rule("column_std_dev_between", "event_type", min_value=0),
        Rule("column_percentile", "event_type", percentile=50, min_value=0),
        Rule("column_sum_between", "event_type", min_value=0),
    ])
    return violations_frame(spark, found).select("rule_index", "rule_type", "actual_value")


@query(
    "dq_referential",
    _expected(ORDERS_SQL, "tgt", [
        ("referential_check", "o_custkey", _n("o_custkey NOT IN (SELECT c_custkey FROM customer)")),
    ]),
)
def dq_referential(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, evaluate(
        orders_target(spark, folder),
        [Rule("referential_check", "o_custkey", lookup_query="SELECT c_custkey FROM customer")],
        {"customer": table(spark, folder, "customer")},
    ))


@query(
    "dq_sql_assert",
    """SELECT 0 AS rule_index, 'custom_sql_assert' AS rule_type, CAST(NULL AS VARCHAR) AS column_name,
  'warn' AS severity, CAST(count(*) AS DOUBLE) AS actual_value FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 2, 'custom_sql_assert', NULL, 'error', NULL""",
)
def dq_sql_assert(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, evaluate(
        table(spark, folder, "customer"),
        [
            Rule("custom_sql_assert", sql="SELECT count(*) FROM customer WHERE c_acctbal < 0",
                 operator="==", severity="warn"),
            Rule("custom_sql_assert", sql="SELECT count(*) FROM customer", operator=">", min_value=1),
            Rule("custom_sql_assert", sql="SELECT c_custkey, c_name FROM customer", operator=">"),
        ],
        {"customer": table(spark, folder, "customer")},
    ))


@query(
    "dq_outlier_zscore",
    _expected(EVENTS_SQL + """, m AS (SELECT avg(value) AS mean, stddev_samp(value) AS sd,
        avg(try_cast(value_text AS DOUBLE)) AS tm, stddev_samp(try_cast(value_text AS DOUBLE)) AS ts FROM ev),
      z AS (SELECT abs(value - mean) / sd AS z, abs(try_cast(value_text AS DOUBLE) - tm) / m.ts AS zt FROM ev, m)""", "z", [
        ("outlier_zscore", "value", _n("z > 3")),
        ("outlier_zscore", "value_text", _n("zt > 2.5")),
    ]),
)
def dq_outlier_zscore(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, evaluate(events_dirty(spark, folder), [
        Rule("outlier_zscore", "value"), Rule("outlier_zscore", "value_text", threshold=2.5),
    ]))


@query(
    "dq_outlier_iqr",
    _expected(EVENTS_SQL + """, m AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM ev),
      z AS (SELECT value, a, b, b - a AS w FROM ev, m)""", "z", [
        ("outlier_iqr", "value", _n("value < a - 1.5 * w OR value > b + 1.5 * w")),
        ("outlier_iqr", "value", _n("value < a - 3.0 * w OR value > b + 3.0 * w")),
    ]),
)
def dq_outlier_iqr(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, evaluate(events_dirty(spark, folder), [
        Rule("outlier_iqr", "value"), Rule("outlier_iqr", "value", fence_type="outer"),
    ]))


@query(
    "dq_grubbs",
    _expected(EVENTS_SQL, "ev", [
        ("outlier_grubbs", "value", "greatest(max(value) - avg(value), avg(value) - min(value)) / stddev_samp(value)"),
    ]),
)
def dq_grubbs(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, evaluate(events_dirty(spark, folder), [Rule("outlier_grubbs", "value")]))


def _ks_sql(cdf: str) -> str:
    return f"""ranked AS (SELECT value AS v, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n,
         min(value) OVER () AS lo, max(value) OVER () AS hi FROM events),
       placed AS (SELECT i, n, {cdf} AS f FROM ranked)
       SELECT max(greatest(CAST(i AS DOUBLE) / n - f, f - CAST(i - 1 AS DOUBLE) / n)) AS d, max(n) AS n FROM placed"""


@query(
    "dq_ks",
    f"""SELECT * FROM (
  SELECT 0 AS rule_index, 'uniform' AS distribution, round(d, 9) AS statistic, d > 1.358 / sqrt(n) AS fires
    FROM (WITH {_ks_sql('(v - lo) / (hi - lo)')})
  UNION ALL
  SELECT 1, 'exp', round(d, 9), d > 1.358 / sqrt(n) FROM (WITH {_ks_sql('1 - exp(-v * 0.1)')}))
WHERE fires""",
)
def dq_ks(spark: SparkSession, folder: str) -> DataFrame:
    rules = [
        Rule("distribution_ks_test", "value", distribution="uniform"),
        Rule("distribution_ks_test", "value", distribution="exp", distribution_params={"lam": 0.1}),
    ]
    found = violations_frame(spark, evaluate(table(spark, folder, "events"), rules))
    return found.select(
        "rule_index",
        F.when(F.col("rule_index") == 0, "uniform").otherwise("exp").alias("distribution"),
        F.round("statistic", 9).alias("statistic"), F.lit(True).alias("fires"),
    )


# DuckDB has no error function: the normal distribution function as its odd series,
# which is exact to double precision for the small z of a flat column.
_NORMAL_SQL = """
base AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n,
           (o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER () AS z FROM orders),
placed AS (SELECT i, n, z, 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(60),
           lambda k: z ** (2 * k + 1) * 2.0 ** (k + 1) * exp(lgamma(k + 2.0) - lgamma(2.0 * k + 3.0)))) AS f FROM base)
"""


@query(
    "dq_ks_normal",
    f"""WITH {_NORMAL_SQL}
SELECT 0 AS rule_index, round(max(greatest(CAST(i AS DOUBLE) / n - f, f - CAST(i - 1 AS DOUBLE) / n)), 7) AS statistic
FROM placed HAVING max(greatest(CAST(i AS DOUBLE) / n - f, f - CAST(i - 1 AS DOUBLE) / n)) > 1.358 / sqrt(max(n))""",
)
def dq_ks_normal(spark: SparkSession, folder: str) -> DataFrame:
    found = evaluate(table(spark, folder, "orders"), [Rule("distribution_ks_test", "o_totalprice")])
    return violations_frame(spark, found).select("rule_index", F.round("statistic", 7).alias("statistic"))


@query(
    "dq_anderson",
    f"""WITH {_NORMAL_SQL}
SELECT 0 AS rule_index, round(-max(n) - sum((2 * i - 1) * ln(f) + (2 * n + 1 - 2 * i) * ln(1 - f)) / max(n), 4)
  AS actual_value FROM placed""",
)
def dq_anderson(spark: SparkSession, folder: str) -> DataFrame:
    found = evaluate(table(spark, folder, "orders"), [Rule("distribution_anderson_darling", "o_totalprice")])
    return violations_frame(spark, found).select("rule_index", F.round("actual_value", 4).alias("actual_value"))


@query(
    "dq_chi_square",
    """WITH m AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n FROM lineitem),
  o AS (SELECT least(floor((l_quantity - lo) / (hi - lo) * 10), 9) AS b, count(*) AS c FROM lineitem, m GROUP BY 1),
  e AS (SELECT unnest(range(10)) AS b, unnest([1, 1, 1, 1, 1, 2, 2, 2, 2, 2]) AS w),
  x AS (SELECT sum((coalesce(c, 0) - w * n / 15.0) ** 2 / (w * n / 15.0)) AS s FROM e LEFT JOIN o ON e.b = o.b, m)
SELECT 0 AS rule_index, round(CAST(s AS DOUBLE), 6) AS statistic FROM x WHERE s > 16.919""",
)
def dq_chi_square(spark: SparkSession, folder: str) -> DataFrame:
    rule = Rule("distribution_chi_square", "l_quantity", expected_frequencies=[1, 1, 1, 1, 1, 2, 2, 2, 2, 2])
    found = violations_frame(spark, evaluate(table(spark, folder, "lineitem"), [rule]))
    return found.select("rule_index", F.round("statistic", 6).alias("statistic"))


@query(
    "dq_proportion",
    """SELECT 0 AS rule_index, round(z, 9) AS statistic FROM (
  SELECT (avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) - 0.5) / sqrt(0.25 / count(*)) AS z FROM events)
WHERE abs(z) > 1.959964""",
)
def dq_proportion(spark: SparkSession, folder: str) -> DataFrame:
    rules = [
        Rule("hypothesis_test_proportion", "event_type", condition="click", expected_proportion=0.5),
        Rule("hypothesis_test_proportion", "event_type", condition="none", expected_proportion=0.0),
    ]
    found = violations_frame(spark, evaluate(table(spark, folder, "events"), rules))
    return found.select("rule_index", F.round("statistic", 9).alias("statistic"))


def _rolling_sql(partition: str, order: str, size: int) -> str:
    w = f"({partition} ORDER BY {order} ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING)"
    return f"""WITH {EVENTS_SQL},
  z AS (SELECT event_id, value AS x, CASE WHEN count(value) OVER {w} >= 2 THEN avg(value) OVER {w} END AS m,
          stddev_samp(value) OVER {w} AS s FROM ev)
SELECT event_id, round(abs(x - m) / s, 5) AS z FROM z WHERE s > 0 AND abs(x - m) / s > 3"""


@query("rolling_sigma_rows", _rolling_sql("PARTITION BY user_id", "ts, event_id", 10))
def rolling_sigma_rows(spark: SparkSession, folder: str) -> DataFrame:
    marked = rolling_zscore(events_dirty(spark, folder), F.col("value"), 10, ["ts", "event_id"], ["user_id"])
    return marked.where("z > 3").select("event_id", F.round("z", 5).alias("z"))


@query(
    "dq_rolling_sigma",
    f"""SELECT 0 AS rule_index, CAST(count(*) AS DOUBLE) AS actual_value
FROM ({_rolling_sql('', 'ts, event_id', 20)}) HAVING count(*) > 0""",
)
def dq_rolling_sigma(spark: SparkSession, folder: str) -> DataFrame:
    rule = Rule("anomaly_detection_sigma", "value", window=20, order_by=["ts", "event_id"])
    found = violations_frame(spark, evaluate(events_dirty(spark, folder), [rule]))
    return found.select("rule_index", "actual_value")
