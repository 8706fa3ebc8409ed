"""Tables of past results: comparisons between runs, trends, flakiness and triage.

A results table has one row per run and test: ``run_id, job_name, status,
override_status, completed_at, source_row_count, target_row_count, matched_count,
missing_in_target_count, missing_in_source_count, value_mismatch_count,
duration_seconds``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import cells
from tallyframe.functions.ranks import exact_percentiles
from tallyframe.operators.segments import pairs_of

FLAKY_FROM = 0.3


def issues() -> Column:
    return sum(
        (F.coalesce(F.col(c), F.lit(0)) for c in ("missing_in_target_count", "missing_in_source_count")),
        F.coalesce(F.col("value_mismatch_count"), F.lit(0)),
    )


def effective_status() -> Column:
    return F.coalesce(F.col("override_status"), F.col("status"))


def canonical_key(key: Column) -> Column:
    """A key map as JSON with its names in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(key))))


# -- Two runs side by side -------------------------------------------------


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per test with both outcomes and the direction of change."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            F.col("job_name").alias("test_name"), effective_status().alias(f"status_{tag}"),
            F.col("duration_seconds").alias(f"duration_{tag}"), issues().cast("bigint").alias(f"mismatches_{tag}"),
            F.lit(True).alias(f"in_{tag}"),
        )

    passed_a, passed_b = F.col("status_a") == "PASSED", F.col("status_b") == "PASSED"
    change = (
        F.when(F.col("in_b").isNull(), "only_in_a").when(F.col("in_a").isNull(), "only_in_b")
        .when(passed_a & ~passed_b, "regressed").when(~passed_a & passed_b, "improved").otherwise("unchanged")
    )
    return side(a, "a").join(side(b, "b"), "test_name", "full_outer").withColumn("change", change).drop("in_a", "in_b")


def compare_runs_summary(compared: DataFrame) -> DataFrame:
    names = ("improved", "regressed", "unchanged", "only_in_a", "only_in_b")
    return compared.agg(*[F.count_if(F.col("change") == n).alias(n) for n in names])


STAT_METRICS = ("status", "source_row_count", "target_row_count", "total_issues")


def compare_report_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differing per-test metrics of two reports: one ``stat_diff`` row each."""
    joined = a.select("test_name", *[F.col(m).cast("string").alias(f"a_{m}") for m in STAT_METRICS]).join(
        b.select("test_name", *[F.col(m).cast("string").alias(f"b_{m}") for m in STAT_METRICS]), "test_name", "full_outer"
    )
    tall = joined.select(
        "test_name",
        F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("a"), F.col(f"b_{m}").alias("b"))
            for m in STAT_METRICS
        ])),
    )
    return tall.where(~F.col("a").eqNullSafe(F.col("b"))).select(
        "test_name", F.col("metric").alias("column_name"), F.coalesce("a", F.lit("")).alias("source_value"),
        F.coalesce("b", F.lit("")).alias("target_value"), F.lit("stat_diff").alias("mismatch_type"),
    )


def report_stats_result(a: DataFrame, b: DataFrame) -> DataFrame:
    """The one result of a report comparison; two empty reports are a failure."""
    names = a.select("test_name").unionByName(b.select("test_name")).distinct()
    wrong = compare_report_stats(a, b).groupBy("test_name").agg(F.count(F.lit(1)).alias("differences"))
    both = a.select("test_name").distinct().join(b.select("test_name").distinct(), "test_name")
    judged = names.join(wrong, "test_name", "left").join(both.withColumn("both", F.lit(True)), "test_name", "left")
    bad = F.greatest(
        F.coalesce("differences", F.lit(0)), F.when(F.col("both").isNull(), F.lit(1)).otherwise(F.lit(0))
    )
    return judged.agg(
        F.count_if(bad == 0).alias("matched_count"),
        F.coalesce(F.nullif(F.sum(bad), F.lit(0)), F.when(F.count(F.lit(1)) == 0, F.lit(1)).otherwise(F.lit(0)))
        .alias("value_mismatch_count"),
        F.when((F.count(F.lit(1)) > 0) & (F.count_if(bad > 0) == 0), "PASSED").otherwise("FAILED").alias("status"),
    )


def diff_mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """New, resolved and persistent mismatches between an earlier and a later run."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(canonical_key(F.col("key_values")).alias("key"), "column_name", "mismatch_type").agg(
            F.max(F.struct("source_value", "target_value")).alias(tag)
        )

    joined = side(a, "a").join(side(b, "b"), ["key", "column_name", "mismatch_type"], "full_outer")
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "resolved").otherwise("persistent")
    shown = F.coalesce("b", "a")
    return joined.select(
        "key", "column_name", "mismatch_type", change.alias("change"),
        shown["source_value"].alias("source_value"), shown["target_value"].alias("target_value"),
    )


# -- Roll-ups --------------------------------------------------------------

RUN_RANK = ("PASSED", "SLOW", "FAILED", "ERROR")


def run_status(results: DataFrame) -> DataFrame:
    """The status of each run: errors before failures before slow tests."""
    ranks = F.array(*[F.lit(s) for s in RUN_RANK])
    rank = F.array_position(ranks, F.col("status"))
    worst = F.greatest(F.max(rank), F.lit(1)).cast("int")
    return results.groupBy("run_id").agg(F.element_at(ranks, worst).alias("status"))


def report_status(results: DataFrame) -> DataFrame:
    """The status a report shows, where a manual override counts and failures come first."""
    order = F.array(*[F.lit(s) for s in ("PASSED", "SLOW", "ERROR", "FAILED")])
    rank = F.array_position(order, effective_status())
    return results.groupBy("run_id").agg(
        F.element_at(order, F.greatest(F.max(rank), F.lit(1)).cast("int")).alias("status")
    )


def run_metrics(results: DataFrame) -> DataFrame:
    """Counts per status and total duration of each run."""
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_tests"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASSED", "FAILED", "SLOW", "ERROR", "SKIPPED")],
        F.sum("duration_seconds").alias("total_duration_seconds"),
        F.sum(issues()).cast("bigint").alias("total_issues"),
    )


def run_insights(records: DataFrame, top_n: int = 10) -> dict[str, DataFrame]:
    """Worst columns, totals per type, and decided against open mismatches per test; a record counts its pairs."""
    pairs = pairs_of(records)
    columns = records.groupBy("column_name").agg(F.sum(pairs).alias("mismatches")).orderBy(
        F.col("mismatches").desc(), "column_name"
    ).limit(top_n)
    types = records.groupBy("mismatch_type").agg(F.sum(pairs).alias("mismatches"))

    def where(condition: Column) -> Column:
        return F.sum(F.when(condition, pairs).otherwise(0))

    decision = F.col("decision")
    tests = records.groupBy("test_name").agg(
        where(decision == "accepted").alias("accepted"), where(decision == "rejected").alias("rejected"),
        where(decision.isNull()).alias("open"),
    )
    return {"columns": columns, "types": types, "tests": tests}


# -- Histories -------------------------------------------------------------


def latest_per(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each group; map tasks keep one row per group before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    newest = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return newest.select(*by, "r.*")


def recent_per(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The newest ``n`` rows of each group, numbered from the newest."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def flakiness(results: DataFrame, window: int = 20) -> DataFrame:
    """How often a job's outcome flipped over its last ``window`` finished runs."""
    rows = results.where("completed_at is not null and status not in ('SKIPPED', 'CANCELLED')")
    recent = recent_per(
        rows.select("job_name", "completed_at", "run_id", effective_status().alias("status")),
        ["job_name"], ["completed_at", "run_id"], window,
    )
    # Groups hold at most `window` rows from here on.
    grouped = recent.groupBy("job_name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("recency", "status"))), lambda x: x["status"]
        ).alias("newest_first")
    )
    pairs = F.zip_with(
        F.slice("newest_first", 2, window), F.slice("newest_first", 1, F.greatest(F.size("newest_first") - 1, F.lit(0))),
        lambda a, b: (a != b).cast("int"),
    )
    counted = grouped.withColumn("transitions", F.aggregate(pairs, F.lit(0), lambda a, x: a + x)).withColumn(
        "window", F.size("newest_first")
    ).where("transitions > 0")
    score = F.col("transitions") / (F.col("window") - 1)
    return counted.select(
        "job_name", F.round(score, 3).alias("score"), "transitions", "window",
        (score >= FLAKY_FROM).alias("flaky"), F.slice("newest_first", 1, 10).alias("recent_statuses"),
    )


def trend_points(results: DataFrame, metric: str = "mismatch_rate", since: str | None = None) -> DataFrame:
    """The value of one metric per finished run, in time order."""
    rows = results.where("completed_at is not null")
    if since is not None:
        rows = rows.where(F.col("completed_at") >= F.lit(since).cast(rows.schema["completed_at"].dataType))
    value = {
        "mismatch_rate": F.coalesce(F.try_divide(issues(), F.col("source_row_count")), F.lit(0.0)),
        "row_count_delta": (
            F.coalesce(F.col("missing_in_target_count"), F.lit(0)) - F.coalesce(F.col("missing_in_source_count"), F.lit(0))
        ),
        "duration_seconds": F.coalesce(F.col("duration_seconds"), F.lit(0)),
    }.get(metric, issues())
    return rows.select("job_name", "run_id", "completed_at", F.round(value.cast("double"), 6).alias("value"))


def trend_drift(points: DataFrame) -> DataFrame:
    """Whether each job's last value left the band of its earlier ones (two deviations above)."""
    last = points.groupBy("job_name").agg(
        F.max(F.struct("completed_at", "run_id", "value")).alias("last"), F.count(F.lit(1)).alias("points")
    )
    earlier = points.join(last.select("job_name", "last"), "job_name").where(
        F.struct("completed_at", "run_id") < F.struct("last.completed_at", "last.run_id")
    ).groupBy("job_name").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )
    value = F.col("last.value")
    flat = F.col("low") == F.col("high")
    drift = F.when(F.col("points") < 3, False).when(flat, value != F.col("low")).otherwise(
        value - F.col("mean") > 2 * F.col("std")
    )
    return last.join(earlier, "job_name", "left").select(
        "job_name", "points", value.alias("last_value"), F.col("mean").alias("mean_before"),
        F.coalesce(drift, F.lit(False)).alias("drift_detected"),
    )


# -- Triage ----------------------------------------------------------------


def with_decisions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Attach the last decision per mismatch (``mismatch_id, decision, decided_at``)."""
    last = decisions.groupBy("mismatch_id").agg(F.max_by("decision", "decided_at").alias("decision"))
    return records.join(last, "mismatch_id", "left")


def triaged_results(results: DataFrame, decided: DataFrame) -> DataFrame:
    """A result whose mismatches are all accepted counts as passed."""
    per_test = decided.groupBy("run_id", "job_name").agg(
        F.bool_and(F.coalesce(F.col("decision") == "accepted", F.lit(False))).alias("all_accepted"),
        F.count_if(F.col("decision") == "accepted").alias("accepted"),
        F.count_if(F.col("decision") == "rejected").alias("rejected"),
        F.count(F.lit(1)).alias("stored"),
    )
    joined = results.join(per_test, ["run_id", "job_name"], "left")
    return joined.withColumn(
        "override_status", F.when(F.col("all_accepted"), "PASSED").otherwise(F.col("override_status"))
    ).na.fill(0, ["accepted", "rejected", "stored"])


def plain_number_text(value: Column) -> Column:
    """Whole numbers lose a trailing ``.0``, so 9.0 and 9 are one key."""
    return F.regexp_replace(value, r"^(-?\d+)\.0+$", "$1")


def triage_key(key: Column) -> Column:
    return canonical_key(F.transform_values(key, lambda k, v: plain_number_text(v)))


def carry_triage(records: DataFrame, earlier: DataFrame) -> DataFrame:
    """Earlier decisions on recomputed differences, matched by test, column and key."""
    kept = earlier.where("decision is not null").groupBy(
        "test_name", "column_name", triage_key(F.col("key_values")).alias("triage_key")
    ).agg(F.max_by("decision", "decided_at").alias("decision"))
    return (
        records.withColumn("triage_key", triage_key(F.col("key_values")))
        .join(kept, ["test_name", "column_name", "triage_key"], "left").drop("triage_key")
    )


@dataclass(frozen=True)
class MismatchFilter:
    column: str | None = None
    mismatch_type: str | None = None
    decision: str | None = None  # accepted, rejected or open
    text: str | None = None


def filter_mismatches(records: DataFrame, f: MismatchFilter) -> DataFrame:
    out = records
    if f.column:
        out = out.where(F.col("column_name") == f.column)
    if f.mismatch_type:
        out = out.where(F.col("mismatch_type") == f.mismatch_type)
    if f.decision:
        out = out.where(
            F.col("decision").isNull() if f.decision == "open" else F.col("decision") == f.decision
        )
    if f.text:
        hay = F.lower(F.concat_ws(
            " ", "column_name", "source_value", "target_value", canonical_key(F.col("key_values"))
        ))
        out = out.where(hay.contains(F.lit(f.text.lower())))
    return out


def page_mismatches(records: DataFrame, sort: str = "id", limit: int = 100, offset: int = 0) -> DataFrame:
    """One page; types sort as missing in target, missing in source, then value differences."""
    kind = (
        F.when(F.col("mismatch_type") == "missing_in_target", 0)
        .when(F.col("mismatch_type") == "missing_in_source", 1)
        .when(F.col("mismatch_type") == "value_diff", 2).otherwise(3)
    )
    order = {"type": [kind, F.col("column_name")], "column": [F.col("column_name")]}.get(sort, [])
    return records.orderBy(*order, "mismatch_id").offset(offset).limit(limit)


# -- Assertions across jobs ------------------------------------------------


def cross_job_assertion(results: DataFrame, profiles: DataFrame | None, source_job: str, target_job: str,
                        source_metric: str = "count", target_metric: str = "count",
                        source_column: str = "", target_column: str = "",
                        tolerance: float = 0.0, tolerance_type: str = "absolute") -> DataFrame:
    """Per run: whether a metric of one job agrees with a metric of another; skipped when absent."""

    def values(job: str, metric: str, column: str, name: str) -> DataFrame:
        if metric == "count":
            rows = results.where(F.col("job_name") == job)
            return rows.groupBy("run_id").agg(F.max(F.col("source_row_count").cast("double")).alias(name))
        rows = profiles.where((F.col("job_name") == job) & (F.col("column_name") == column))
        return rows.groupBy("run_id").agg(F.max(F.col("distinct_count").cast("double")).alias(name))

    runs = results.select("run_id").distinct()
    a = values(source_job, source_metric, source_column, "source_value")
    b = values(target_job, target_metric, target_column, "target_value")
    allowed = F.lit(float(tolerance))
    if tolerance_type == "percent":
        allowed = F.abs("source_value") * F.lit(float(tolerance)) / 100
    gap = F.abs(F.col("source_value") - F.col("target_value"))
    status = F.when(gap.isNull(), "SKIPPED").when(gap <= allowed, "PASSED").otherwise("FAILED")
    return runs.join(a, "run_id", "left").join(b, "run_id", "left").withColumn("status", status)


# -- Freshness -------------------------------------------------------------


def freshness(df: DataFrame, column: str, max_age_hours: float, now: str) -> DataFrame:
    """Age of the newest timestamp; an empty table or absent column passes, all nulls fail."""
    if column not in df.columns:
        return df.sparkSession.range(1).select(
            F.lit(None).cast("timestamp").alias("newest"), F.lit(None).cast("double").alias("age_hours"),
            F.lit("PASSED").alias("status"),
        )
    at = cells.moment(cells.q(column), df.schema[column].dataType)
    newest = df.agg(F.max(at).alias("newest"), F.count(F.lit(1)).alias("rows"))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("newest")) / 3.6e9
    status = (
        F.when(F.col("rows") == 0, "PASSED").when(F.col("newest").isNull(), "FAILED")
        .when(age > max_age_hours, "FAILED").otherwise("PASSED")
    )
    return newest.select("newest", age.alias("age_hours"), status.alias("status"))


# -- Lineage ---------------------------------------------------------------


def lineage_edges(jobs: DataFrame) -> DataFrame:
    """``upstream, downstream`` from each job's ``depends_on`` list."""
    return jobs.select(F.explode("depends_on").alias("upstream"), F.col("job_name").alias("downstream")).distinct()


def lineage_nodes(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """Every job on an edge or in the job table, with its type where known."""
    names = (
        edges.select(F.col("upstream").alias("job_name"))
        .unionByName(edges.select(F.col("downstream").alias("job_name")))
        .unionByName(jobs.select("job_name")).distinct()
    )
    return names.join(jobs.select("job_name", "job_type"), "job_name", "left")


def upstream_of(edges: DataFrame, job: str) -> DataFrame:
    return edges.where(F.col("downstream") == job).select("upstream")


def downstream_of(edges: DataFrame, job: str) -> DataFrame:
    return edges.where(F.col("upstream") == job).select("downstream")


# -- Schedules and telemetry -----------------------------------------------

SUCCESS = ("PASSED", "COMPLETED", "SLOW")


def _outcomes() -> list[Column]:
    status = F.upper("status")
    out = [F.count_if(status.isin(*SUCCESS)).alias("passed")]
    return out + [F.count_if(status == s.upper()).alias(s) for s in ("failed", "error", "cancelled", "blocked")]


def schedule_statistics(schedules: DataFrame, runs: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Runs, outcomes, success rate and mean duration per schedule over the last ``days``.

    ``schedules``: ``schedule_id, name, enabled``; ``runs``: ``schedule_id, status,
    started_at, duration_seconds``. Schedules without runs stay in.
    """
    since = F.lit(now).cast(runs.schema["started_at"].dataType) - F.make_dt_interval(F.lit(days))
    recent = runs.where(F.col("started_at") >= since).groupBy("schedule_id").agg(
        F.count(F.lit(1)).alias("runs_triggered"), *_outcomes(),
        F.sum("duration_seconds").alias("duration_total"), F.count("duration_seconds").alias("duration_count"),
        F.max("started_at").alias("last_run_at"), F.max_by("status", "started_at").alias("last_status"),
    )
    counts = ["runs_triggered", "passed", "failed", "error", "cancelled", "blocked", "duration_count"]
    joined = schedules.join(recent, "schedule_id", "left").na.fill(0, counts)
    return joined.select(
        *schedules.columns, *counts[:-1],
        F.round(F.try_divide(F.col("passed"), F.col("runs_triggered")) * 100, 2).alias("success_rate"),
        F.round(F.try_divide(F.col("duration_total"), F.col("duration_count")), 2).alias("average_duration_seconds"),
        "last_run_at", "last_status", "duration_total", "duration_count",
    )


def schedule_summary(statistics: DataFrame, min_success_rate: float | None = None) -> DataFrame:
    """All schedules together, with the gate on the success rate."""
    counts = ["runs_triggered", "passed", "failed", "error", "cancelled", "blocked"]
    totals = statistics.agg(
        F.count(F.lit(1)).alias("total_schedules"), F.count_if(F.col("enabled")).alias("enabled_schedules"),
        *[F.sum(c).alias(c) for c in counts],
        F.sum("duration_total").alias("t"), F.sum("duration_count").alias("n"),
    )
    rate = F.round(F.try_divide(F.col("passed"), F.col("runs_triggered")) * 100, 2)
    gate = F.lit("passed")
    if min_success_rate is not None:
        gate = F.when(F.coalesce(rate >= min_success_rate, F.lit(False)), "passed").otherwise("failed")
    return totals.select(
        "total_schedules", "enabled_schedules", *counts, rate.alias("success_rate"),
        F.round(F.try_divide(F.col("t"), F.col("n")), 2).alias("average_duration_seconds"), gate.alias("gate"),
    )


@dataclass(frozen=True)
class TelemetryFilter:
    schedule_id: int | None = None
    status: str | None = None
    name: str | None = None
    since: str | None = None
    until: str | None = None


def filter_telemetry(events: DataFrame, f: TelemetryFilter) -> DataFrame:
    out = events
    if f.schedule_id is not None:
        out = out.where(F.col("schedule_id") == f.schedule_id)
    if f.status:
        out = out.where(F.upper("status") == f.status.upper())
    if f.name:
        out = out.where(F.lower("schedule_name").contains(F.lit(f.name.lower())))
    if f.since:
        out = out.where(F.col("started_at") >= F.lit(f.since).cast(out.schema["started_at"].dataType))
    if f.until:
        out = out.where(F.col("started_at") <= F.lit(f.until).cast(out.schema["started_at"].dataType))
    return out


def _seconds(ms: Column) -> Column:
    return F.round(ms / 1000, 3)


def telemetry_summary(events: DataFrame) -> DataFrame:
    totals = events.agg(
        F.count(F.lit(1)).alias("total_events"), *_outcomes(),
        F.sum("duration_ms").alias("t"), F.count("duration_ms").alias("n"),
    )
    done = sum((F.col(c) for c in ("failed", "error", "cancelled", "blocked")), F.col("passed"))
    return totals.select(
        "total_events", "passed", "failed", "error", "cancelled", "blocked",
        F.round(F.try_divide(F.col("passed"), done) * 100, 1).alias("success_rate"),
        _seconds(F.floor(F.try_divide(F.col("t"), F.col("n")))).alias("avg_duration_seconds"),
    )


def telemetry_outcomes(events: DataFrame) -> DataFrame:
    return events.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def telemetry_runtime(events: DataFrame) -> DataFrame:
    """Count, mean and nearest-rank 95th percentile of the durations."""
    p95 = exact_percentiles(events.select("duration_ms"), {"duration_ms": [0.95]}, interpolate=False)
    return events.agg(
        F.count("duration_ms").alias("count"),
        _seconds(F.floor(F.avg("duration_ms"))).alias("avg_seconds"),
    ).withColumn("p95_seconds", _seconds(F.lit(p95["duration_ms"][0.95]).cast("double")))


def telemetry_grid(schedules: DataFrame, events: DataFrame) -> DataFrame:
    """Every schedule with its latest event."""
    last = events.groupBy("schedule_id").agg(
        F.max_by(F.struct("status", "duration_ms"), F.struct("started_at", "event_id")).alias("r")
    )
    return schedules.join(last, "schedule_id", "left").select(
        *schedules.columns, F.col("r.status").alias("last_status"), _seconds(F.col("r.duration_ms")).alias("last_duration_seconds")
    )


def telemetry_timeline(events: DataFrame) -> DataFrame:
    return events.where("started_at is not null").select(
        "schedule_id", "event_id", "status", "started_at", _seconds(F.col("duration_ms")).alias("duration_seconds")
    ).orderBy("started_at", "event_id")
