"""Whole jobs put together from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import history as H
from tallyframe.operators import pairing as P
from tallyframe.operators.reconcile import Comparison, CompareOptions
from tallyframe.operators.rules import Violation, spark_sql
from tallyframe.sources.discovery import discover
from tallyframe.sources.readers import read_files, read_pages


@dataclass(frozen=True)
class TransformCase:
    """A SQL transform over named fixture tables and the rows it should give."""

    transform_sql: str
    inputs: Mapping[str, DataFrame]
    expected: DataFrame
    key_columns: Sequence[str] = ()
    float_tolerance: float = 1e-9

    def output(self) -> DataFrame:
        return spark_sql(self.expected.sparkSession, self.transform_sql, self.inputs)

    def run(self) -> Comparison:
        options = CompareOptions(key_columns=self.key_columns, float_tolerance=self.float_tolerance)
        return Comparison(self.output(), self.expected, options)


def compare_queries(spark: SparkSession, source_sql: str, target_sql: str, options: CompareOptions,
                    views: Mapping[str, DataFrame] | None = None) -> Comparison:
    """SQL against SQL; keys are guessed by well-known names when none are given."""
    return Comparison(
        spark_sql(spark, source_sql, views), spark_sql(spark, target_sql, views), replace(options, ad_hoc_keys=True)
    )


def compare_files(spark: SparkSession, source: str, target: str, options: CompareOptions,
                  source_format: str | None = None, target_format: str | None = None) -> Comparison:
    """File against file, of the same or of different formats."""
    return Comparison(
        read_files(spark, source, source_format), read_files(spark, target, target_format),
        replace(options, ad_hoc_keys=True),
    )


def compare_many_files(spark: SparkSession, source_root: str, source_pattern: str, target_root: str,
                       target_pattern: str, match_on: Sequence[str], options: CompareOptions,
                       fmt: str | None = None) -> tuple[DataFrame, Comparison]:
    """Discover, pair by tokens and compare all pairs in one plan; gives the mapping and the comparison.

    Pairs with a file that cannot be read get an ``error`` in the mapping and stay out of the comparison.
    """
    mapping = P.pair_by_tokens(
        discover(spark, source_root, source_pattern, "source"), discover(spark, target_root, target_pattern, "target"), match_on
    )
    mapping = P.with_errors(spark, mapping, fmt)
    comparison = P.compare_pairs(
        P.pair_rows(spark, mapping, "source", fmt), P.pair_rows(spark, mapping, "target", fmt), options
    )
    return mapping, comparison


def compare_pages(spark: SparkSession, source: str, target: str | None, options: CompareOptions, root: str = "") -> Comparison | None:
    """Landed response pages on both sides; nothing to do (SKIPPED) without a target."""
    if target is None:
        return None
    return Comparison(read_pages(spark, source, root), read_pages(spark, target, root), options)


def compare_environments(results_a: DataFrame, results_b: DataFrame) -> DataFrame:
    """The same jobs run under two source bindings, test by test."""
    return H.compare_runs(results_a, results_b)


@dataclass(frozen=True)
class PassCondition:
    min_row_count: int | None = None
    max_row_count: int | None = None
    max_value_mismatches: int | None = None
    max_missing_in_target: int | None = None
    max_missing_in_source: int | None = None
    require_status: Sequence[str] = ()
    pass_sql: str | None = None
    pass_sql_mode: str = "rows_mean_pass"
    views: Mapping[str, DataFrame] = field(default_factory=dict)


def apply_pass_condition(results: DataFrame, condition: PassCondition) -> DataFrame:
    """Results with the ``violations`` of the condition; each one counts as a mismatch and fails the result."""
    c = condition
    checks = []

    def above(column: str, limit: int | None) -> None:
        if limit is not None:
            checks.append(F.when(F.col(column) > limit, F.concat(F.lit(f"{column} "), F.col(column).cast("string"), F.lit(f" > {limit}"))))

    if c.min_row_count is not None:
        checks.append(F.when(
            F.col("source_row_count") < c.min_row_count,
            F.concat(F.lit("source_row_count "), F.col("source_row_count").cast("string"), F.lit(f" < {c.min_row_count}")),
        ))
    above("source_row_count", c.max_row_count)
    above("value_mismatch_count", c.max_value_mismatches)
    above("missing_in_target_count", c.max_missing_in_target)
    above("missing_in_source_count", c.max_missing_in_source)
    if c.require_status:
        checks.append(F.when(~F.col("status").isin(*c.require_status), F.concat(F.lit("status "), "status")))
    if c.pass_sql:
        try:
            has_rows = not spark_sql(results.sparkSession, c.pass_sql, c.views).isEmpty()
            if c.pass_sql_mode == "rows_mean_pass" and not has_rows:
                checks.append(F.lit("pass_sql gave no rows"))
            elif c.pass_sql_mode == "rows_mean_fail" and has_rows:
                checks.append(F.lit("pass_sql gave rows"))
        except Exception as error:
            checks.append(F.lit(f"pass_sql failed: {type(error).__name__}"))
    found = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    broken = F.size("violations") > 0
    return (
        results.withColumn("violations", found)
        .withColumn("value_mismatch_count", F.col("value_mismatch_count") + F.size("violations"))
        .withColumn("status", F.when(broken, "FAILED").otherwise(F.col("status")))
    )


def fold_violations(result: DataFrame, violations: Sequence[Violation]) -> DataFrame:
    """A result with its rule violations: each is one mismatch more, and an error fails it."""
    failed = any(v.severity == "error" for v in violations)
    out = result.withColumn("value_mismatch_count", F.col("value_mismatch_count") + len(violations))
    return out.withColumn("status", F.lit("FAILED")) if failed else out


def violation_records(spark: SparkSession, violations: Sequence[Violation]) -> DataFrame:
    """Rule violations in the shape of mismatch records."""
    rows = [
        ({"dq_rule": v.rule_type}, v.column or "", "" if v.actual_value is None else str(v.actual_value), "", "dq_violation")
        for v in violations
    ]
    return spark.createDataFrame(
        rows, "key_values map<string,string>, column_name string, source_value string, target_value string, mismatch_type string"
    )


def summary_with_violations(by_column: DataFrame, violations: Sequence[Violation], rows: int) -> DataFrame:
    """The per-column summary with the violations added to their columns."""
    spark = by_column.sparkSession
    extra = spark.createDataFrame(
        [(v.column or "(none)", 1, max(rows, 1)) for v in violations],
        "column_name string, mismatch_count bigint, compared_rows bigint",
    )
    return by_column.select(*extra.columns).unionByName(extra).groupBy("column_name").agg(
        F.sum("mismatch_count").alias("mismatch_count"), F.max("compared_rows").alias("compared_rows")
    )
