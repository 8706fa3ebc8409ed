"""Time the headline queries once each and print one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores. Every query is
run to completion by a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import catalog
from tallyframe.catalog.fixtures import table
from tallyframe.operators.profile import profile
from tallyframe.operators.reconcile import Comparison, CompareOptions
from tallyframe.operators.rules import Rule, evaluate, violations_frame
from tallyframe.session import local_session


def _lines(spark: SparkSession, folder: str) -> Comparison:
    lines = table(spark, folder, "lineitem")
    drifted = lines.where(F.col("l_orderkey") % 97 != 0).withColumn(
        "l_quantity", F.when(F.col("l_partkey") % 31 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    )
    return Comparison(lines, drifted, CompareOptions(key_columns=["l_orderkey", "l_linenumber"]))


def reconcile_lineitem_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).summary()


def reconcile_lineitem_records(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).records(limit=1000)


def dq_fused_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = [
        Rule("not_null", "l_orderkey"), Rule("unique", "l_orderkey"), Rule("row_count_min", min_value=1),
        Rule("row_count_max", max_value=1), Rule("row_count_between", min_value=1, max_value=2),
        Rule("match_regex", "l_returnflag", pattern="[AN]"), Rule("custom_sql", sql="l_discount > 0.09"),
        Rule("column_max_length", "l_returnflag", max_value=0), Rule("column_min_length", "l_returnflag", min_value=2),
        Rule("value_in_set", "l_linestatus", values=["O"]), Rule("value_not_in_set", "l_linestatus", values=["F"]),
        Rule("column_contains", "l_returnflag", pattern="R"),
        Rule("date_range", "l_shipdate", min_date="1996-01-01", max_date="1998-01-01"),
        Rule("positive_values", "l_tax"), Rule("negative_values", "l_tax"),
        Rule("column_type_check", "l_returnflag", expected_type="int"),
        Rule("column_value_between", "l_quantity", min_value=5, max_value=40),
        Rule("cross_column_consistency", "l_discount", column_b="l_tax"),
        Rule("pii_mask_check", "l_returnflag", pattern="N"), Rule("no_whitespace", "l_returnflag"),
        Rule("column_mean_between", "l_quantity", max_value=1), Rule("completeness_ratio", "l_tax", min_value=1),
        Rule("distinct_count_between", "l_partkey", max_value=1), Rule("column_sum_between", "l_quantity", max_value=1),
        Rule("column_std_dev_between", "l_quantity", max_value=1),
        Rule("column_percentile", "l_extendedprice", percentile=95, max_value=1),
    ]
    return violations_frame(spark, evaluate(table(spark, folder, "lineitem"), rules))


def profile_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return profile(table(spark, folder, "lineitem"))


def profile_lineitem_approximate(spark: SparkSession, folder: str) -> DataFrame:
    return profile(table(spark, folder, "lineitem"), approximate=True)


NAMED = (
    "reconcile_orders_summary", "reconcile_orders_records", "reconcile_heavy_key", "reconcile_positional",
    "checksum_precheck", "dq_row_rules", "dq_outlier_iqr", "dq_rolling_sigma", "column_stats_diff",
    "segment_summary", "mismatch_diff", "trend_drift", "contract_breaches", "coverage_matrix", "multi_file_rollup",
    "json_flatten_scan", "difference_export",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    runs = {
        f.__name__: f for f in (
            reconcile_lineitem_summary, reconcile_lineitem_records, dq_fused_rules, profile_lineitem,
            profile_lineitem_approximate,
        )
    }
    runs.update({name: catalog.QUERIES[name] for name in NAMED})
    table(spark, folder, "lineitem").agg(F.sum("l_quantity")).collect()  # starts the executor threads
    seconds = {}
    for name, fn in runs.items():
        start = time.perf_counter()
        fn(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
