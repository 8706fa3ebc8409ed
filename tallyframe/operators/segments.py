"""Where mismatches sit: segment summaries, drill-downs and distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import cells
from tallyframe.operators.reconcile import MISSING_IN_SOURCE, MISSING_IN_TARGET, VALUE_DIFF

NULL_BUCKET = "(null)"


def pairs_of(records: DataFrame) -> Column:
    """For how many mismatches a record stands; tables without the column hold single ones."""
    return (F.col("pair_count") if "pair_count" in records.columns else F.lit(1)).cast("bigint")


def segment_summary(records: DataFrame, segments: Sequence[str], top_n: int = 20) -> DataFrame:
    """Mismatch counts per segment value and type, the ``top_n`` values per segment."""
    entries = F.array(*[
        F.struct(
            F.lit(s).alias("segment_column"),
            F.coalesce(F.try_element_at("segment_values", F.lit(s)), F.lit(NULL_BUCKET)).alias("value"),
        )
        for s in segments
    ])
    pairs = pairs_of(records)

    def of(kind: str):
        return F.coalesce(F.sum(F.when(F.col("mismatch_type") == kind, pairs)), F.lit(0)).alias(kind)

    counted = (
        records.select("mismatch_type", pairs.alias("pair_count"), F.inline(entries))
        .groupBy("segment_column", "value")
        .agg(F.sum("pair_count").alias("mismatch_count"), of(MISSING_IN_TARGET), of(MISSING_IN_SOURCE), of(VALUE_DIFF))
    )
    # One row per segment column; a window over all values of a column would sit in one task.
    totals = counted.groupBy("segment_column").agg(F.sum("mismatch_count").alias("total"))
    first = Window.partitionBy("segment_column").orderBy(F.col("mismatch_count").desc(), "value")
    top = counted.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= top_n).drop("rn")
    return top.join(totals, "segment_column").withColumn(
        "pct_of_total", F.round(100.0 * F.col("mismatch_count") / F.col("total"), 2)
    ).drop("total")


def segment_drilldown(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Rows per segment value on both sides, largest difference first."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        if column not in df.columns:
            return df.sparkSession.createDataFrame([], f"value string, {name} bigint")
        shown = F.coalesce(cells.text(cells.q(column), df.schema[column].dataType), F.lit(NULL_BUCKET))
        return df.groupBy(shown.alias("value")).agg(F.count(F.lit(1)).alias(name))

    if column not in source.columns and column not in target.columns:
        raise ValueError(f"segment column '{column}' is on neither side")
    joined = counts(source, "source_count").join(counts(target, "target_count"), "value", "full_outer").na.fill(0)
    return joined.withColumn("delta", F.col("target_count") - F.col("source_count")).orderBy(
        F.abs("delta").desc(), "value"
    )


def mismatch_distribution(records: DataFrame, top_n: int = 10) -> DataFrame:
    """The most frequent (column, source value, target value) combinations."""
    return (
        records.groupBy("column_name", "source_value", "target_value")
        .agg(F.sum(pairs_of(records)).alias("occurrences"))
        .orderBy(F.col("occurrences").desc(), "column_name", "source_value", "target_value").limit(top_n)
    )
