"""Queries over result histories; the histories are derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.catalog import query
from tallyframe.catalog.fixtures import ORDERS_SQL, orders_source, orders_target, table
from tallyframe.catalog.reconciling import _records_sql
from tallyframe.operators import contracts as C
from tallyframe.operators import coverage as V
from tallyframe.operators import history as H
from tallyframe.operators import search as Q
from tallyframe.operators.reconcile import Comparison, CompareOptions

NOW = "2024-02-01 00:00:00"


def _results(spark: SparkSession, folder: str) -> DataFrame:
    """One result per event type (the job) and day (the run)."""
    v = F.col("value")
    day = F.date_trunc("day", "ts")
    return table(spark, folder, "events").groupBy(
        F.col("event_type").alias("job_name"), day.alias("completed_at")
    ).agg(
        F.count(F.lit(1)).alias("source_row_count"),
        F.count_if(v > 100).alias("value_mismatch_count"),
        F.count_if(v < 1).alias("missing_in_target_count"),
        F.count_if((v >= 1) & (v < 2)).alias("missing_in_source_count"),
        F.max(v).alias("duration_seconds"),
    ).select(
        F.date_format("completed_at", "yyyy-MM-dd").alias("run_id"), "*",
        F.when(F.col("value_mismatch_count") > 9, "FAILED").when(F.col("missing_in_target_count") > 3, "SLOW")
        .when(F.col("missing_in_source_count") > 3, "ERROR").otherwise("PASSED").alias("status"),
        F.when(F.dayofmonth("completed_at") == 7, "PASSED").alias("override_status"),
    )


RESULTS_SQL = """
hist AS (
  SELECT CAST(completed_at AS VARCHAR)[1:10] AS run_id, *,
    CASE WHEN value_mismatch_count > 9 THEN 'FAILED' WHEN missing_in_target_count > 3 THEN 'SLOW'
         WHEN missing_in_source_count > 3 THEN 'ERROR' ELSE 'PASSED' END AS status,
    CASE WHEN day(completed_at) = 7 THEN 'PASSED' END AS override_status
  FROM (SELECT event_type AS job_name, CAST(date_trunc('day', ts) AS TIMESTAMP) AS completed_at,
          count(*) AS source_row_count, count(*) FILTER (WHERE value > 100) AS value_mismatch_count,
          count(*) FILTER (WHERE value < 1) AS missing_in_target_count,
          count(*) FILTER (WHERE value >= 1 AND value < 2) AS missing_in_source_count,
          max(value) AS duration_seconds
        FROM events GROUP BY 1, 2)),
eff AS (SELECT *, coalesce(override_status, status) AS effective,
          value_mismatch_count + missing_in_target_count + missing_in_source_count AS issues FROM hist)
"""

_COMPARE_SQL = f"""WITH {RESULTS_SQL},
 a AS (SELECT * FROM eff WHERE run_id = '2024-01-06' AND job_name <> 'view'),
 b AS (SELECT * FROM eff WHERE run_id = '2024-01-07' AND job_name <> 'click'),
 c AS (SELECT coalesce(a.job_name, b.job_name) AS test_name, a.effective AS status_a, b.effective AS status_b,
   a.duration_seconds AS duration_a, b.duration_seconds AS duration_b, a.issues AS mismatches_a, b.issues AS mismatches_b,
   CASE WHEN b.job_name IS NULL THEN 'only_in_a' WHEN a.job_name IS NULL THEN 'only_in_b'
        WHEN a.effective = 'PASSED' AND b.effective <> 'PASSED' THEN 'regressed'
        WHEN a.effective <> 'PASSED' AND b.effective = 'PASSED' THEN 'improved' ELSE 'unchanged' END AS change
   FROM a FULL OUTER JOIN b ON a.job_name = b.job_name)"""


def _two_runs(spark: SparkSession, folder: str) -> DataFrame:
    results = _results(spark, folder)
    return H.compare_runs(
        results.where("run_id = '2024-01-06' and job_name <> 'view'"),
        results.where("run_id = '2024-01-07' and job_name <> 'click'"),
    )


@query("run_compare", f"{_COMPARE_SQL} SELECT * FROM c")
def run_compare(spark: SparkSession, folder: str) -> DataFrame:
    return _two_runs(spark, folder)


@query(
    "run_compare_summary",
    f"""{_COMPARE_SQL} SELECT {', '.join(f"count(*) FILTER (WHERE change = '{n}') AS {n}" for n in ('improved', 'regressed', 'unchanged', 'only_in_a', 'only_in_b'))} FROM c""",
)
def run_compare_summary(spark: SparkSession, folder: str) -> DataFrame:
    return H.compare_runs_summary(_two_runs(spark, folder))


_STATS_SQL = f"""{RESULTS_SQL},
 sa AS (SELECT job_name AS test_name, status, source_row_count, source_row_count AS target_row_count, issues AS total_issues
        FROM eff WHERE run_id = '2024-01-06'),
 sb AS (SELECT job_name AS test_name, status, source_row_count, source_row_count AS target_row_count,
          CASE WHEN job_name = 'view' THEN issues + 1 ELSE issues END AS total_issues
        FROM eff WHERE run_id = '2024-01-06' AND job_name <> 'error'),
 tall AS (SELECT coalesce(sa.test_name, sb.test_name) AS test_name,
   unnest(['status', 'source_row_count', 'target_row_count', 'total_issues']) AS column_name,
   unnest([sa.status, CAST(sa.source_row_count AS VARCHAR), CAST(sa.target_row_count AS VARCHAR), CAST(sa.total_issues AS VARCHAR)]) AS a,
   unnest([sb.status, CAST(sb.source_row_count AS VARCHAR), CAST(sb.target_row_count AS VARCHAR), CAST(sb.total_issues AS VARCHAR)]) AS b
   FROM sa FULL OUTER JOIN sb ON sa.test_name = sb.test_name)"""


def _stats(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    day = _results(spark, folder).where("run_id = '2024-01-06'").select(
        F.col("job_name").alias("test_name"), "status", "source_row_count",
        F.col("source_row_count").alias("target_row_count"), H.issues().alias("total_issues"),
    )
    changed = day.where("test_name <> 'error'").withColumn(
        "total_issues", F.when(F.col("test_name") == "view", F.col("total_issues") + 1).otherwise(F.col("total_issues"))
    )
    return day, changed


@query(
    "report_stats_compare",
    f"""WITH {_STATS_SQL} SELECT test_name, column_name, coalesce(a, '') AS source_value, coalesce(b, '') AS target_value,
  'stat_diff' AS mismatch_type FROM tall WHERE a IS DISTINCT FROM b""",
)
def report_stats_compare(spark: SparkSession, folder: str) -> DataFrame:
    return H.compare_report_stats(*_stats(spark, folder))


@query(
    "report_stats_result",
    f"""WITH {_STATS_SQL} SELECT (SELECT count(DISTINCT test_name) FROM tall) - count(DISTINCT test_name) AS matched_count,
  count(*) AS value_mismatch_count, 'FAILED' AS status FROM tall WHERE a IS DISTINCT FROM b""",
)
def report_stats_result(spark: SparkSession, folder: str) -> DataFrame:
    return H.report_stats_result(*_stats(spark, folder))


@query(
    "mismatch_diff",
    f"""WITH {ORDERS_SQL}, r AS MATERIALIZED ({_records_sql()}),
 u AS (SELECT *, 1 AS run FROM r WHERE o_orderkey % 5 <> 0 UNION ALL SELECT *, 2 FROM r WHERE o_orderkey % 7 <> 0),
 g AS (SELECT o_orderkey, column_name, mismatch_type, min(run) AS first_run, max(run) AS last_run,
         arg_max(struct_pack(s := source_value, t := target_value), run) AS shown FROM u GROUP BY ALL)
SELECT '{{"o_orderkey":"' || o_orderkey || '"}}' AS key, column_name, mismatch_type,
  CASE WHEN first_run = 2 THEN 'new' WHEN last_run = 1 THEN 'resolved' ELSE 'persistent' END AS change,
  shown.s AS source_value, shown.t AS target_value FROM g""",
)
def mismatch_diff(spark: SparkSession, folder: str) -> DataFrame:
    records = _order_records(spark, folder)
    key = F.col("key_values")["o_orderkey"].cast("bigint")
    return H.diff_mismatches(records.where(key % 5 != 0), records.where(key % 7 != 0))


def _order_records(spark: SparkSession, folder: str) -> DataFrame:
    return Comparison(
        orders_source(spark, folder), orders_target(spark, folder), CompareOptions(key_columns=["o_orderkey"])
    ).records()


_RANKED = "CASE {s} WHEN 'ERROR' THEN {e} WHEN 'FAILED' THEN {f} WHEN 'SLOW' THEN 2 ELSE 1 END"


@query(
    "run_status_rollup",
    f"""WITH {RESULTS_SQL} SELECT run_id, ['PASSED', 'SLOW', 'FAILED', 'ERROR'][max({_RANKED.format(s='status', e=4, f=3)})] AS status
FROM eff GROUP BY 1""",
)
def run_status_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return H.run_status(_results(spark, folder))


@query(
    "report_status_rollup",
    f"""WITH {RESULTS_SQL} SELECT run_id, ['PASSED', 'SLOW', 'ERROR', 'FAILED'][max({_RANKED.format(s='effective', e=3, f=4)})] AS status
FROM eff GROUP BY 1""",
)
def report_status_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return H.report_status(_results(spark, folder))


@query(
    "run_metrics",
    f"""WITH {RESULTS_SQL} SELECT run_id, count(*) AS total_tests, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in ('PASSED', 'FAILED', 'SLOW', 'ERROR', 'SKIPPED'))},
  round(sum(duration_seconds), 4) AS total_duration_seconds, CAST(sum(issues) AS BIGINT) AS total_issues FROM eff GROUP BY 1""",
)
def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return H.run_metrics(_results(spark, folder)).withColumn(
        "total_duration_seconds", F.round("total_duration_seconds", 4)
    )


@query(
    "flaky_report",
    f"""WITH {RESULTS_SQL},
 rec AS (SELECT job_name, effective, row_number() OVER (PARTITION BY job_name ORDER BY completed_at DESC) AS rn FROM eff),
 lagged AS (SELECT *, lead(effective) OVER (PARTITION BY job_name ORDER BY rn) AS older FROM rec WHERE rn <= 20),
 g AS (SELECT job_name, CAST(count(*) AS INTEGER) AS "window", CAST(count(*) FILTER (WHERE effective <> older) AS INTEGER) AS transitions,
   string_agg(effective, ',' ORDER BY rn) FILTER (WHERE rn <= 10) AS recent_statuses FROM lagged GROUP BY 1)
SELECT job_name, round(transitions / ("window" - 1), 3) AS score, transitions, "window",
  transitions / ("window" - 1) >= 0.3 AS flaky, recent_statuses FROM g WHERE transitions > 0""",
)
def flaky_report(spark: SparkSession, folder: str) -> DataFrame:
    return H.flakiness(_results(spark, folder)).withColumn("recent_statuses", F.concat_ws(",", "recent_statuses"))


def _trend_sql(value: str, extra: str = "true") -> str:
    return f"""WITH {RESULTS_SQL}, p AS (SELECT job_name, run_id, completed_at, round(CAST({value} AS DOUBLE), 6) AS value FROM eff WHERE {extra})"""


@query(
    "trend_points",
    f"{_trend_sql('issues / source_row_count', extra=chr(39) + '2024-01-10' + chr(39) + ' <= run_id')} SELECT job_name, run_id, value FROM p",
)
def trend_points(spark: SparkSession, folder: str) -> DataFrame:
    return H.trend_points(_results(spark, folder), since="2024-01-10").drop("completed_at")


_DRIFT = """, l AS (SELECT job_name, count(*) AS points, max_by(value, completed_at) AS last_value, max(completed_at) AS last_at FROM p GROUP BY 1),
 m AS (SELECT p.job_name, avg(value) AS m, stddev_samp(value) AS s FROM p JOIN l USING (job_name) WHERE completed_at < last_at GROUP BY 1)
SELECT job_name, points, last_value, round(m, 6) AS mean_before, last_value - m > 2 * s AS drift_detected FROM l JOIN m USING (job_name)"""


@query(
    "trend_drift",
    " UNION ALL ".join(
        f"SELECT '{name}' AS metric, * FROM ({_trend_sql(value)}{_DRIFT})"
        for name, value in (
            ("mismatch_rate", "issues / source_row_count"),
            ("row_count_delta", "missing_in_target_count - missing_in_source_count"),
            ("duration_seconds", "duration_seconds"), ("issues", "issues"),
        )
    ),
)
def trend_drift(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for metric in ("mismatch_rate", "row_count_delta", "duration_seconds", "issues"):
        one = H.trend_drift(H.trend_points(_results(spark, folder), metric)).withColumn("metric", F.lit(metric))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("mean_before", F.round("mean_before", 6))


@query(
    "latest_results",
    f"""WITH {RESULTS_SQL} SELECT job_name, run_id, status FROM eff
QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY completed_at DESC) = 1""",
)
def latest_results(spark: SparkSession, folder: str) -> DataFrame:
    return H.latest_per(_results(spark, folder), ["job_name"], ["completed_at"]).select("job_name", "run_id", "status")


@query(
    "recent_results",
    f"""WITH {RESULTS_SQL} SELECT job_name, run_id, CAST(row_number() OVER (PARTITION BY job_name ORDER BY completed_at DESC) AS INTEGER) AS recency
FROM eff QUALIFY recency <= 20""",
)
def recent_results(spark: SparkSession, folder: str) -> DataFrame:
    return H.recent_per(_results(spark, folder), ["job_name"], ["completed_at"], 20).select(
        "job_name", "run_id", "recency"
    )


# Triage: mismatches of the drifted orders, decided by rules on the key.
def _decided(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("key_values")["o_orderkey"].cast("bigint")
    records = _order_records(spark, folder).select(
        "*", key.alias("k"),
        F.concat_ws("|", key.cast("string"), "column_name", "mismatch_type").alias("mismatch_id"),
        F.when(F.col("column_name") == F.lit("<row>"), "rows").otherwise(F.col("column_name")).alias("job_name"),
        F.lit("r1").alias("run_id"), F.lit("orders").alias("test_name"),
    )
    first = records.where((F.col("k") % 2 == 0) | (F.col("job_name") == "o_orderdate")).select(
        "mismatch_id", F.lit("accepted").alias("decision"), F.lit(1).alias("decided_at")
    )
    second = records.where((F.col("k") % 10 == 0) & (F.col("job_name") != "o_orderdate")).select(
        "mismatch_id", F.lit("rejected").alias("decision"), F.lit(2).alias("decided_at")
    )
    return H.with_decisions(records, first.unionByName(second))


_DECIDED_SQL = f"""{ORDERS_SQL}, r AS ({_records_sql()}),
 dec AS (SELECT *, CASE column_name WHEN '<row>' THEN 'rows' ELSE column_name END AS job_name,
   CASE WHEN o_orderkey % 10 = 0 AND column_name <> 'o_orderdate' THEN 'rejected'
        WHEN o_orderkey % 2 = 0 OR column_name = 'o_orderdate' THEN 'accepted' END AS decision FROM r)"""


@query(
    "triage_rollup",
    f"""WITH {_DECIDED_SQL} SELECT job_name, CASE WHEN bool_and(coalesce(decision = 'accepted', false)) THEN 'PASSED' ELSE 'FAILED' END AS effective,
  count(*) FILTER (WHERE decision = 'accepted') AS accepted, count(*) FILTER (WHERE decision = 'rejected') AS rejected,
  count(*) AS stored FROM dec GROUP BY 1""",
)
def triage_rollup(spark: SparkSession, folder: str) -> DataFrame:
    decided = _decided(spark, folder)
    results = decided.select("run_id", "job_name").distinct().select(
        "*", F.lit("FAILED").alias("status"), F.lit(None).cast("string").alias("override_status")
    )
    return H.triaged_results(results, decided).select(
        "job_name", H.effective_status().alias("effective"), "accepted", "rejected", "stored"
    )


@query(
    "triage_carried",
    f"""WITH {_DECIDED_SQL} SELECT column_name, decision, count(*) AS n FROM dec GROUP BY 1, 2""",
)
def triage_carried(spark: SparkSession, folder: str) -> DataFrame:
    decided = _decided(spark, folder)
    earlier = decided.select(
        "test_name", "column_name", "decision", F.lit(1).alias("decided_at"),
        F.transform_values("key_values", lambda k, v: F.concat(v, F.lit(".0"))).alias("key_values"),
    )
    return H.carry_triage(decided.drop("decision"), earlier).groupBy("column_name", "decision").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "run_insights",
    f"""WITH {_DECIDED_SQL}
SELECT 'column' AS part, name, n FROM (SELECT column_name AS name, count(*) AS n FROM dec GROUP BY 1 ORDER BY n DESC, name LIMIT 3)
UNION ALL SELECT 'type', mismatch_type, count(*) FROM dec GROUP BY mismatch_type
UNION ALL SELECT 'accepted', 'orders', count(*) FROM dec WHERE decision = 'accepted'
UNION ALL SELECT 'open', 'orders', count(*) FROM dec WHERE decision IS NULL""",
)
def run_insights(spark: SparkSession, folder: str) -> DataFrame:
    parts = H.run_insights(_decided(spark, folder), top_n=3)
    out = parts["columns"].select(F.lit("column").alias("part"), F.col("column_name").alias("name"), F.col("mismatches").alias("n"))
    out = out.unionByName(parts["types"].select(F.lit("type").alias("part"), F.col("mismatch_type").alias("name"), F.col("mismatches").alias("n")))
    for part in ("accepted", "open"):
        out = out.unionByName(parts["tests"].select(F.lit(part).alias("part"), F.col("test_name").alias("name"), F.col(part).alias("n")))
    return out


@query(
    "mismatch_page",
    f"""WITH {_DECIDED_SQL} SELECT o_orderkey, column_name, mismatch_type FROM dec
WHERE decision = 'accepted' AND mismatch_type = 'value_diff' AND column_name = 'o_orderpriority' AND contains(lower(coalesce(source_value, '')), 'urgent')
ORDER BY column_name, CAST(o_orderkey AS VARCHAR) || '|' LIMIT 15 OFFSET 5""",
)
def mismatch_page(spark: SparkSession, folder: str) -> DataFrame:
    kept = H.filter_mismatches(
        _decided(spark, folder),
        H.MismatchFilter(column="o_orderpriority", mismatch_type="value_diff", decision="accepted", text="URGENT"),
    )
    return H.page_mismatches(kept, "column", 15, 5).select(
        F.col("k").alias("o_orderkey"), "column_name", "mismatch_type"
    )


@query(
    "mismatch_search",
    f"""WITH {ORDERS_SQL}, r AS ({_records_sql()}),
 f AS (SELECT *, lower('orders ' || column_name || ' ' || mismatch_type || ' {{"o_orderkey":"' || o_orderkey || '"}}  ' || coalesce(source_value, '') || ' ' || coalesce(target_value, '')) AS hay,
   lower(coalesce(source_value, '') || ' ' || coalesce(target_value, '')) AS val FROM r)
SELECT q, count(*) AS hits FROM (
  SELECT 'urgent col:priority' AS q FROM f WHERE contains(hay, 'urgent') AND contains(column_name, 'priority')
  UNION ALL SELECT 'test:orders -type:missing key:31' FROM f WHERE NOT contains(mismatch_type, 'missing') AND contains(CAST(o_orderkey AS VARCHAR), '31')
  UNION ALL SELECT '"4-not specified" src:SPEC' FROM f WHERE contains(hay, '4-not specified') AND contains(lower(coalesce(source_value, '')), 'spec')
  UNION ALL SELECT 'note:x' FROM f WHERE contains(hay, 'note:x')
  UNION ALL SELECT 'val:00:00:01 tgt:1997' FROM f WHERE contains(val, '00:00:01') AND contains(lower(coalesce(target_value, '')), '1997'))
GROUP BY 1""",
)
def mismatch_search(spark: SparkSession, folder: str) -> DataFrame:
    records = _order_records(spark, folder).withColumn("test_name", F.lit("orders"))
    out = None
    for text in ("urgent col:priority", "test:orders -type:missing key:31", '"4-not specified" src:SPEC', "note:x",
                 "val:00:00:01 tgt:1997"):
        one = Q.search(records, text).groupBy(F.lit(text).alias("q")).agg(F.count(F.lit(1)).alias("hits"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "cross_job_assertion",
    f"""WITH {RESULTS_SQL}, runs AS (SELECT DISTINCT run_id FROM hist),
 a AS (SELECT run_id, source_row_count AS n FROM hist WHERE job_name = 'click'),
 b AS (SELECT run_id, source_row_count AS n FROM hist WHERE job_name = 'view' AND run_id <> '2024-01-03')
SELECT run_id, CAST(a.n AS DOUBLE) AS source_value, CAST(b.n AS DOUBLE) AS target_value,
  CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'SKIPPED' WHEN abs(a.n - b.n) <= a.n * 0.1 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM runs LEFT JOIN a USING (run_id) LEFT JOIN b USING (run_id)""",
)
def cross_job_assertion(spark: SparkSession, folder: str) -> DataFrame:
    results = _results(spark, folder).where("not (job_name = 'view' and run_id = '2024-01-03')")
    return H.cross_job_assertion(results, None, "click", "view", tolerance=10, tolerance_type="percent")


@query(
    "freshness",
    """SELECT * FROM (SELECT 'fresh' AS test, CAST(max(ts) AS VARCHAR) AS newest, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 3.6e9, 6) AS age_hours,
    CASE WHEN (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 3.6e9 > 48 THEN 'FAILED' ELSE 'PASSED' END AS status FROM events)
UNION ALL SELECT 'stale', CAST(max(o_orderdate) AS VARCHAR), round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(o_orderdate))) / 3.6e9, 6), 'FAILED' FROM orders
UNION ALL SELECT 'unreadable', NULL, NULL, 'FAILED'
UNION ALL SELECT 'absent', NULL, NULL, 'PASSED'""",
)
def freshness(spark: SparkSession, folder: str) -> DataFrame:
    events, orders = table(spark, folder, "events"), table(spark, folder, "orders")
    tests = {
        "fresh": H.freshness(events, "ts", 48, NOW), "stale": H.freshness(orders, "o_orderdate", 48, NOW),
        "unreadable": H.freshness(events, "event_type", 48, NOW), "absent": H.freshness(events, "no_column", 48, NOW),
    }
    out = None
    for name, one in tests.items():
        one = one.select(
            F.lit(name).alias("test"), F.col("newest").cast("string").alias("newest"),
            F.round("age_hours", 6).alias("age_hours"), "status",
        )
        out = one if out is None else out.unionByName(one)
    return out


# Jobs derived from suppliers: each depends on two others and queries a few tables.
def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    return table(spark, folder, "supplier").select(
        F.col("s_name").alias("job_name"), s,
        F.element_at(F.array(F.lit("reconciliation"), F.lit("profile"), F.lit("health_check")), (s % 3 + 1).cast("int")).alias("job_type"),
        (s % 10 != 9).alias("enabled"),
        F.concat(
            F.lit("WITH c AS (SELECT * FROM raw.Nation_"), text(F.col("s_nationkey")),
            F.lit(') SELECT * FROM c join "Sales".[T'), text(s % 7), F.lit("] t ON c.k = t.k"),
        ).alias("query"),
        F.array(F.struct(F.lit("not_null").alias("type"), F.concat(F.lit("R"), text(s % 4)).alias("column"))).alias("rules"),
        F.array(F.concat(F.lit("k"), text(s % 2))).alias("key_columns"),
        F.array(F.lit("C3")).alias("exclude_columns"),
        F.array(F.concat(F.lit("Supplier#"), F.lpad(text(F.floor(s / 2)), 9, "0")), F.concat(F.lit("Supplier#"), F.lpad(text(F.floor(s / 3)), 9, "0"))).alias("depends_on"),
    )


def _observed(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("s_suppkey"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("column_name")
    ).distinct()
    return lines.join(_jobs(spark, folder).select("s_suppkey", "job_name"), "s_suppkey").select("job_name", "column_name")


_JOBS_SQL = """
jobs AS (SELECT s_suppkey AS s, s_name AS job_name, ['reconciliation', 'profile', 'health_check'][s_suppkey % 3 + 1] AS job_type,
           s_suppkey % 10 <> 9 AS enabled, s_nationkey FROM supplier),
live AS (SELECT * FROM jobs WHERE enabled AND job_type <> 'health_check'),
jt AS (SELECT job_name, 'raw.nation_' || s_nationkey AS table_name FROM live
       UNION ALL SELECT job_name, 'sales.t' || (s % 7) FROM live),
seen AS (SELECT DISTINCT live.job_name, live.job_type, 'c' || l_linenumber AS column_name FROM lineitem JOIN live ON l_suppkey = s),
jc AS (SELECT job_name, column_name, CASE WHEN job_type = 'reconciliation' AND column_name <> 'c3' THEN 2 ELSE 1 END AS lvl, NULL AS rule FROM seen
       UNION ALL SELECT job_name, 'r' || (s % 4), 2, 'not_null' FROM live
       UNION ALL SELECT job_name, 'k' || (s % 2), CASE WHEN job_type = 'reconciliation' THEN 2 ELSE 0 END, NULL FROM live),
m AS (SELECT table_name, column_name, ['untested', 'observed', 'tested'][max(lvl) + 1] AS level,
        string_agg(DISTINCT job_name, ',' ORDER BY job_name) AS jobs, coalesce(string_agg(DISTINCT rule, ','), '') AS rules
      FROM jt JOIN jc USING (job_name) GROUP BY 1, 2)
"""


@query("coverage_matrix", f"WITH {_JOBS_SQL} SELECT * FROM m")
def coverage_matrix(spark: SparkSession, folder: str) -> DataFrame:
    matrix = V.coverage(_jobs(spark, folder), _observed(spark, folder))
    return matrix.withColumn("jobs", F.concat_ws(",", "jobs")).withColumn("rules", F.concat_ws(",", "rules"))


@query(
    "coverage_by_table",
    f"""WITH {_JOBS_SQL} SELECT table_name, count(*) AS columns, round(100.0 * count(*) FILTER (WHERE level = 'tested') / count(*), 1) AS tested_pct,
  round(100.0 * count(*) FILTER (WHERE level = 'observed') / count(*), 1) AS observed_pct FROM m GROUP BY 1
UNION ALL SELECT 'all ' || count(DISTINCT table_name), count(*), round(100.0 * count(*) FILTER (WHERE level = 'tested') / count(*), 1),
  round(100.0 * count(*) FILTER (WHERE level = 'observed') / count(*), 1) FROM m""",
)
def coverage_by_table(spark: SparkSession, folder: str) -> DataFrame:
    matrix = V.coverage(_jobs(spark, folder), _observed(spark, folder))
    overall = V.coverage_overall(matrix).select(
        F.concat(F.lit("all "), F.col("tables").cast("string")).alias("table_name"), "columns", "tested_pct", "observed_pct"
    )
    return V.coverage_by_table(matrix).unionByName(overall)


_EDGES_SQL = """
e AS (SELECT DISTINCT 'Supplier#' || lpad(CAST(s_suppkey // d AS VARCHAR), 9, '0') AS upstream, s_name AS downstream
      FROM supplier, (SELECT unnest([2, 3]) AS d))"""


@query(
    "lineage",
    f"""WITH {_EDGES_SQL}
SELECT 'edge' AS part, upstream AS a, downstream AS b FROM e
UNION ALL SELECT 'upstream of 12', upstream, NULL FROM e WHERE downstream = 'Supplier#000000012'
UNION ALL SELECT 'downstream of 3', downstream, NULL FROM e WHERE upstream = 'Supplier#000000003'
UNION ALL SELECT 'node', s_name, ['reconciliation', 'profile', 'health_check'][s_suppkey % 3 + 1] FROM supplier""",
)
def lineage(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder)
    edges = H.lineage_edges(jobs)
    none = F.lit(None).cast("string")
    parts = [
        edges.select(F.lit("edge").alias("part"), F.col("upstream").alias("a"), F.col("downstream").alias("b")),
        H.upstream_of(edges, "Supplier#000000012").select(F.lit("upstream of 12").alias("part"), F.col("upstream").alias("a"), none.alias("b")),
        H.downstream_of(edges, "Supplier#000000003").select(F.lit("downstream of 3").alias("part"), F.col("downstream").alias("a"), none.alias("b")),
        H.lineage_nodes(jobs, edges).select(F.lit("node").alias("part"), F.col("job_name").alias("a"), F.col("job_type").alias("b")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Schedules: user_id % 12 names the schedule of an event; schedules 10 and up have no runs of their own below.
def _telemetry(spark: SparkSession, folder: str) -> DataFrame:
    status = F.create_map(*[F.lit(x) for x in (
        "click", "PASSED", "view", "SLOW", "error", "ERROR", "signup", "FAILED", "purchase", "CANCELLED")])
    return table(spark, folder, "events").select(
        "event_id", (F.col("user_id") % 12).alias("schedule_id"),
        F.concat(F.lit("nightly "), (F.col("user_id") % 12).cast("string")).alias("schedule_name"),
        status[F.col("event_type")].alias("status"), F.col("ts").alias("started_at"),
        F.when(F.col("event_id") % 13 != 0, F.floor(F.col("value") * 1000)).alias("duration_ms"),
    )


_TELEMETRY_SQL = """
tel AS (SELECT event_id, user_id % 12 AS schedule_id, 'nightly ' || (user_id % 12) AS schedule_name,
  CASE event_type WHEN 'click' THEN 'PASSED' WHEN 'view' THEN 'SLOW' WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'FAILED' ELSE 'CANCELLED' END AS status,
  ts AS started_at, CASE WHEN event_id % 13 <> 0 THEN CAST(floor(value * 1000) AS BIGINT) END AS duration_ms FROM events)"""


def _schedules(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("schedule_id")).where("schedule_id < 15")
    return ids.select("schedule_id", F.concat(F.lit("nightly "), F.col("schedule_id").cast("string")).alias("name"), (F.col("schedule_id") % 4 != 3).alias("enabled"))


_SCHEDULES_SQL = f"""{_TELEMETRY_SQL},
sch AS (SELECT CAST(n_nationkey AS BIGINT) AS schedule_id, 'nightly ' || n_nationkey AS name, n_nationkey % 4 <> 3 AS enabled FROM nation WHERE n_nationkey < 15),
recent AS (SELECT * FROM tel WHERE started_at >= TIMESTAMP '2024-01-22'),
st AS (SELECT sch.schedule_id, name, enabled, count(event_id) AS runs_triggered,
  count(*) FILTER (WHERE status IN ('PASSED', 'SLOW')) AS passed, count(*) FILTER (WHERE status = 'FAILED') AS failed,
  count(*) FILTER (WHERE status = 'ERROR') AS error, count(*) FILTER (WHERE status = 'CANCELLED') AS cancelled,
  count(*) FILTER (WHERE status = 'BLOCKED') AS blocked, sum(duration_ms / 1000.0) AS t, count(duration_ms) AS n,
  max_by(status, started_at) AS last_status FROM sch LEFT JOIN recent USING (schedule_id) GROUP BY 1, 2, 3)"""


def _schedule_stats(spark: SparkSession, folder: str) -> DataFrame:
    runs = _telemetry(spark, folder).withColumn("duration_seconds", F.col("duration_ms") / 1000.0)
    return H.schedule_statistics(_schedules(spark, folder), runs, NOW, days=10)


@query(
    "schedule_stats",
    f"""WITH {_SCHEDULES_SQL} SELECT schedule_id, name, enabled, runs_triggered, passed, failed, error, cancelled, blocked,
  round(passed / nullif(runs_triggered, 0) * 100, 2) AS success_rate, round(t / nullif(n, 0), 2) AS average_duration_seconds, last_status FROM st""",
)
def schedule_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _schedule_stats(spark, folder).drop("last_run_at", "duration_total", "duration_count")


@query(
    "schedule_summary",
    f"""WITH {_SCHEDULES_SQL} SELECT count(*) AS total_schedules, count(*) FILTER (WHERE enabled) AS enabled_schedules,
  {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('runs_triggered', 'passed', 'failed', 'error', 'cancelled', 'blocked'))},
  round(sum(passed) / sum(runs_triggered) * 100, 2) AS success_rate, round(sum(t) / sum(n), 2) AS average_duration_seconds,
  CASE WHEN round(sum(passed) / sum(runs_triggered) * 100, 2) >= 50 THEN 'passed' ELSE 'failed' END AS gate FROM st""",
)
def schedule_summary(spark: SparkSession, folder: str) -> DataFrame:
    return H.schedule_summary(_schedule_stats(spark, folder), min_success_rate=50)


@query(
    "telemetry_summary",
    f"""WITH {_TELEMETRY_SQL}, f AS (SELECT * FROM tel WHERE contains(schedule_name, 'nightly 1') AND started_at >= TIMESTAMP '2024-01-05')
SELECT count(*) AS total_events, count(*) FILTER (WHERE status IN ('PASSED', 'SLOW')) AS passed, count(*) FILTER (WHERE status = 'FAILED') AS failed,
  count(*) FILTER (WHERE status = 'ERROR') AS error, count(*) FILTER (WHERE status = 'CANCELLED') AS cancelled, CAST(0 AS BIGINT) AS blocked,
  round(count(*) FILTER (WHERE status IN ('PASSED', 'SLOW')) / count(*) * 100, 1) AS success_rate,
  round(floor(sum(duration_ms) / count(duration_ms)) / 1000, 3) AS avg_duration_seconds FROM f""",
)
def telemetry_summary(spark: SparkSession, folder: str) -> DataFrame:
    kept = H.filter_telemetry(
        _telemetry(spark, folder), H.TelemetryFilter(name="NIGHTLY 1", since="2024-01-05 00:00:00")
    )
    return H.telemetry_summary(kept)


@query(
    "telemetry_metrics",
    f"""WITH {_TELEMETRY_SQL}, d AS (SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) - 1 AS i, count(*) OVER () AS n FROM tel WHERE duration_ms IS NOT NULL)
SELECT count(*) AS count, round(floor(avg(duration_ms)) / 1000, 3) AS avg_seconds,
  round(max(duration_ms) FILTER (WHERE i = floor((n - 1) * 0.95)) / 1000, 3) AS p95_seconds FROM d""",
)
def telemetry_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return H.telemetry_runtime(_telemetry(spark, folder))


@query("telemetry_outcomes", f"WITH {_TELEMETRY_SQL} SELECT status, count(*) AS count FROM tel GROUP BY 1")
def telemetry_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return H.telemetry_outcomes(_telemetry(spark, folder))


@query(
    "telemetry_grid",
    f"""WITH {_SCHEDULES_SQL} SELECT schedule_id, name, enabled, max_by(status, started_at) AS last_status,
  round(arg_max_null(duration_ms, started_at) / 1000, 3) AS last_duration_seconds FROM sch LEFT JOIN tel USING (schedule_id) GROUP BY 1, 2, 3""",
)
def telemetry_grid(spark: SparkSession, folder: str) -> DataFrame:
    return H.telemetry_grid(_schedules(spark, folder), _telemetry(spark, folder))


@query(
    "telemetry_timeline",
    f"""WITH {_TELEMETRY_SQL} SELECT schedule_id, event_id, status, CAST(epoch_us(started_at) AS BIGINT) AS started_us,
  round(duration_ms / 1000, 3) AS duration_seconds FROM tel""",
)
def telemetry_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return H.telemetry_timeline(_telemetry(spark, folder)).withColumn(
        "started_us", F.unix_micros(F.col("started_at").cast("timestamp"))
    ).drop("started_at")


# Contracts: one or two per event type; an inactive one never breaches.
def _contracts(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "events").select(F.col("event_type").alias("source_job")).distinct()
    return jobs.select(
        F.explode(F.array(F.lit(1), F.lit(2))).alias("i"), "source_job"
    ).select(
        F.concat_ws("-", "source_job", F.col("i").cast("string")).alias("contract_id"), "source_job",
        F.when(F.col("i") == 1, 24.0).otherwise(400.0).alias("sla_hours"),
        (~((F.col("i") == 2) & (F.col("source_job") == "view"))).alias("active"),
    )


_CONTRACTS_SQL = f"""{RESULTS_SQL},
con AS (SELECT source_job || '-' || i AS contract_id, source_job, CASE i WHEN 1 THEN 24.0 ELSE 400.0 END AS sla_hours,
          NOT (i = 2 AND source_job = 'view') AS active FROM (SELECT DISTINCT event_type AS source_job FROM events), (SELECT unnest([1, 2]) AS i)),
o AS (SELECT job_name, run_id, completed_at, status IN ('FAILED', 'ERROR') AS failing FROM hist),
p AS (SELECT *, coalesce(lag(failing) OVER (PARTITION BY job_name ORDER BY completed_at), false) AS before FROM o),
starts AS (SELECT * FROM p WHERE failing AND NOT before),
ep AS (SELECT s.job_name, s.run_id, s.completed_at AS opened_at, min(e.completed_at) AS resolved_at
       FROM starts s LEFT JOIN o e ON e.job_name = s.job_name AND NOT e.failing AND e.completed_at > s.completed_at GROUP BY 1, 2, 3),
br AS (SELECT contract_id, source_job, run_id, opened_at, resolved_at, sla_hours,
         (epoch_us(coalesce(resolved_at, TIMESTAMP '2024-02-01')) - epoch_us(opened_at)) / 3.6e9 AS age
       FROM ep JOIN con ON source_job = job_name WHERE active)"""


@query(
    "contract_breaches",
    f"""WITH {_CONTRACTS_SQL} SELECT contract_id, source_job, run_id, CAST(opened_at AS VARCHAR) AS opened_at, CAST(resolved_at AS VARCHAR) AS resolved_at,
  CAST(resolved_at AS VARCHAR)[1:10] AS resolution_run_id, CASE WHEN resolved_at IS NOT NULL THEN round(age, 4) END AS duration_hours,
  resolved_at IS NULL AND age >= sla_hours AS escalated FROM br""",
)
def contract_breaches(spark: SparkSession, folder: str) -> DataFrame:
    found = C.breach_episodes(_contracts(spark, folder), _results(spark, folder), NOW)
    return found.drop("breach_type").withColumn("opened_at", F.col("opened_at").cast("string")).withColumn(
        "resolved_at", F.col("resolved_at").cast("string")
    )


@query(
    "contract_status",
    f"""WITH {_CONTRACTS_SQL}, op AS (SELECT contract_id, bool_or(age >= sla_hours) AS late FROM br WHERE resolved_at IS NULL GROUP BY 1)
SELECT con.contract_id, source_job, CASE WHEN op.contract_id IS NULL THEN 'OK' WHEN late THEN 'OVERDUE' ELSE 'BREACHED' END AS status
FROM con LEFT JOIN op USING (contract_id)""",
)
def contract_status(spark: SparkSession, folder: str) -> DataFrame:
    contracts = _contracts(spark, folder)
    return C.contract_status(contracts, C.breach_episodes(contracts, _results(spark, folder), NOW))


@query(
    "contract_run_update",
    f"""WITH {_CONTRACTS_SQL},
 first AS (SELECT job_name FROM hist WHERE run_id = '2024-01-05' AND status IN ('FAILED', 'ERROR')),
 second AS (SELECT job_name, bool_or(status IN ('FAILED', 'ERROR')) AS bad FROM hist WHERE run_id = '2024-01-06' GROUP BY 1)
SELECT contract_id, CASE WHEN f.job_name IS NOT NULL THEN '2024-01-05' ELSE '2024-01-06' END AS run_id,
  CASE WHEN f.job_name IS NOT NULL AND NOT s.bad THEN CAST(24.0 AS DOUBLE) END AS duration_hours,
  f.job_name IS NOT NULL AND s.bad AND sla_hours <= 24 AS escalated
FROM con LEFT JOIN first f ON source_job = f.job_name LEFT JOIN second s ON source_job = s.job_name
WHERE active AND (f.job_name IS NOT NULL OR s.bad)""",
)
def contract_run_update(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs applied one after the other, the second one twice."""
    contracts, results = _contracts(spark, folder), _results(spark, folder)
    state = spark.createDataFrame(
        [], "contract_id string, source_job string, run_id string, breach_type string, opened_at timestamp, "
        "resolved_at timestamp, resolution_run_id string, duration_hours double, escalated boolean",
    )
    for day in ("2024-01-05", "2024-01-06", "2024-01-06"):
        state = C.apply_run(state, contracts, results.where(F.col("run_id") == day), day, f"{day} 00:00:00")
    return state.select("contract_id", "run_id", "duration_hours", "escalated")


@query(
    "publish_gate",
    f"""WITH {_CONTRACTS_SQL}, jobs AS (SELECT DISTINCT event_type AS job_name FROM events UNION ALL SELECT 'unknown'),
 last AS (SELECT job_name, max_by(status, completed_at) AS result_status, max(run_id) AS run_id FROM hist GROUP BY 1),
 op AS (SELECT source_job AS job_name, count(*) AS n FROM br WHERE resolved_at IS NULL GROUP BY 1)
SELECT job_name, run_id, result_status, concat_ws('; ', CASE WHEN result_status IS NULL THEN 'no result' END,
   CASE WHEN result_status <> 'PASSED' THEN 'latest result is ' || result_status END, CASE WHEN n > 0 THEN n || ' open breach(es)' END) AS reasons,
  CASE WHEN result_status = 'PASSED' AND n IS NULL THEN 'PROMOTE' ELSE 'HOLD' END AS verdict
FROM jobs LEFT JOIN last USING (job_name) LEFT JOIN op USING (job_name)""",
)
def publish_gate(spark: SparkSession, folder: str) -> DataFrame:
    contracts, results = _contracts(spark, folder), _results(spark, folder)
    breaches = C.breach_episodes(contracts, results, NOW)
    jobs = table(spark, folder, "events").select(F.col("event_type").alias("job_name")).distinct().unionByName(
        spark.createDataFrame([("unknown",)], "job_name string")
    )
    return C.publish_gate(jobs, results, contracts, breaches).withColumn("reasons", F.concat_ws("; ", "reasons"))
