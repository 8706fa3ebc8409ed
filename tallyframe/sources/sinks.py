"""Writing differences, results and history tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.history import canonical_key, effective_status, run_metrics
from tallyframe.operators.segments import pairs_of

DIFFERENCE_FIELDS = [
    "test_name", "key_values", "column_name", "source_value", "target_value", "mismatch_type", "delta",
    "relative_delta", "pair_count",
]
CAPPED_FIELDS = DIFFERENCE_FIELDS[:6]
# Fixed value: rows read for the capped export.
CAPPED_ROWS = 100_000
RESULT_FIELDS = [
    "run_id", "query_name", "status", "effective_status", "duration_seconds", "source_row_count",
    "target_row_count", "value_mismatch_count", "missing_in_target_count", "missing_in_source_count",
]


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def difference_rows(records: DataFrame, test_name: str | None = None) -> DataFrame:
    """The export fields and, last, how many pairs a row stands for; a missing cell is blank."""
    test = F.lit(test_name).alias("test_name") if test_name is not None else F.col("test_name")
    return records.select(
        test, canonical_key(F.col("key_values")).alias("key_values"), _blank("column_name"), _blank("source_value"),
        _blank("target_value"), _blank("mismatch_type"), "delta", "relative_delta",
        pairs_of(records).alias("pair_count"),
    )


def write_table(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> str:
    """CSV with a header, JSON lines, or Parquet, which keeps its types when empty."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported export format: {fmt}")
    return path


def export_differences(records: DataFrame, test_name: str, path: str, fmt: str) -> str:
    """Every difference, without a cap."""
    return write_table(difference_rows(records, test_name), path, fmt)


def export_stored_differences(stored: DataFrame, run_id: str, path: str, fmt: str) -> str:
    return write_table(difference_rows(stored.where(F.col("run_id") == run_id)), path, fmt)


def export_capped(records: DataFrame, test_name: str, path: str, limit: int = CAPPED_ROWS) -> str:
    """The six-field export for people, which the reader caps."""
    return write_table(difference_rows(records, test_name).select(*CAPPED_FIELDS).limit(limit), path, "csv")


def export_results(results: DataFrame, path: str) -> str:
    rows = results.withColumn("query_name", F.col("job_name")).withColumn("effective_status", effective_status())
    return write_table(rows.select(*RESULT_FIELDS), path, "csv")


def append_history(df: DataFrame, path: str, run_id: str, job_name: str | None = None) -> str:
    """Store the results, records, profiles or snapshots of a run in a history table, once however often it is tried.

    A call holds all rows of a run, or with ``job_name`` all of one of its jobs,
    and replaces what an earlier try of the same has stored; the rows of other
    runs are not touched. Files are staged and put in place when the job ends, so
    a writer that fails on its way leaves the table as it was. A table takes
    either form, not both; a try without rows replaces nothing.
    """
    places = ["run_id"] + (["job_name"] if job_name is not None else [])
    rows = df.withColumn("run_id", F.lit(run_id))
    if job_name is not None:
        rows = rows.withColumn("job_name", F.lit(job_name))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*places).parquet(path)
    return path


def write_metrics(results: DataFrame, path: str) -> str:
    return write_table(run_metrics(results), path, "json")


def write_manifest(mapping: DataFrame, run_id: str, job_name: str, strategy: str, path: str) -> str:
    """How files were paired in a run, as JSON lines."""
    return write_table(
        mapping.select(F.lit(run_id).alias("run_id"), F.lit(job_name).alias("job_name"), F.lit(strategy).alias("strategy"), "*"),
        path, "json",
    )


def persist_pairs(rows: DataFrame, path: str, run_id: str, job_name: str, side: str) -> str:
    """Keep one side of all compared pairs for a later comparison."""
    place = f"{path}/run_id={run_id}/job_name={job_name}/side={side}"
    rows.write.mode("overwrite").partitionBy("__pair__").parquet(place)
    return place


def load_artifact(results: DataFrame, run_id: str, job_name: str | None = None, side: str = "source") -> DataFrame:
    """The data kept by an earlier run, found by run, or by run and job."""
    found = results.where(F.col("run_id") == run_id)
    if job_name is not None:
        found = found.where(F.col("job_name") == job_name)
    paths = [r[0] for r in found.select(f"{side}_artifact_path").where(f"{side}_artifact_path is not null").limit(2).collect()]
    if len(paths) != 1:
        raise ValueError(f"run {run_id} keeps {'no' if not paths else 'more than one'} {side} artifact")
    return results.sparkSession.read.parquet(paths[0])
