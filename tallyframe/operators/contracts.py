"""Contract breaches: opened by failures, resolved by passes, escalated by age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.ranks import with_previous

FAILING = ("FAILED", "ERROR")
HEALTHY = ("PASSED", "SLOW")


def _hours(start: str, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(F.col(start))) / 3.6e9


def breach_episodes(contracts: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """All breaches implied by a history of results.

    A job's first failure opens a breach; further failures change nothing until a
    pass resolves it. ``contracts``: ``contract_id, source_job, sla_hours, active``;
    ``results``: ``job_name, run_id, status, completed_at``.
    """
    outcomes = results.where(F.col("status").isin(*FAILING, *HEALTHY)).select(
        "job_name", "completed_at", "run_id", F.col("status").isin(*FAILING).alias("failing")
    )
    seen = with_previous(outcomes, ["job_name"], ["completed_at", "run_id"], ["failing"])
    # What stays is one row per change of state: a failure, then the pass that ends it.
    edges = seen.where(F.col("failing") != F.coalesce("previous_failing", F.lit(False))).drop("previous_failing")
    placed = with_previous(edges, ["job_name"], ["completed_at", "run_id"], ["completed_at", "run_id"])
    resolved = placed.where("not failing").select(
        "job_name", F.col("previous_completed_at").alias("opened_at"), F.col("previous_run_id").alias("run_id"),
        F.col("completed_at").alias("resolved_at"), F.col("run_id").alias("resolution_run_id"),
    )
    still_open = (
        edges.groupBy("job_name").agg(F.max(F.struct("completed_at", "run_id", "failing")).alias("e"))
        .where("e.failing").select(
            "job_name", F.col("e.completed_at").alias("opened_at"), F.col("e.run_id").alias("run_id"),
            F.lit(None).cast("timestamp").alias("resolved_at"), F.lit(None).cast("string").alias("resolution_run_id"),
        )
    )
    moment = F.lit(now).cast("timestamp")
    age = _hours("opened_at", F.coalesce("resolved_at", moment))
    return resolved.unionByName(still_open).join(
        contracts.where("active"), F.col("job_name") == F.col("source_job")
    ).select(
        "contract_id", "source_job", "run_id", F.lit("dq_violation").alias("breach_type"), "opened_at",
        "resolved_at", "resolution_run_id",
        F.when(F.col("resolved_at").isNotNull(), F.round(age, 4)).alias("duration_hours"),
        (F.col("resolved_at").isNull() & (age >= F.col("sla_hours"))).alias("escalated"),
    )


def apply_run(breaches: DataFrame, contracts: DataFrame, results: DataFrame, run_id: str, now: str) -> DataFrame:
    """The breach table after one run; applying the same run twice changes nothing more."""
    moment = F.lit(now).cast("timestamp")
    jobs = results.groupBy(F.col("job_name").alias("source_job")).agg(
        F.bool_or(F.col("status").isin(*FAILING)).alias("failed"),
        F.bool_or(F.col("status").isin(*HEALTHY)).alias("healthy"),
    )
    live = contracts.where("active").select("contract_id", "source_job", "sla_hours")
    state = breaches.join(live.select("contract_id", "sla_hours"), "contract_id", "left").join(
        jobs.select("source_job", "failed", "healthy"), "source_job", "left"
    )
    is_open = F.col("resolved_at").isNull()
    closes = is_open & F.coalesce(F.col("healthy") & ~F.col("failed"), F.lit(False)) & F.col("sla_hours").isNotNull()
    overdue = is_open & ~closes & (_hours("opened_at", moment) >= F.col("sla_hours"))
    kept = state.select(
        "contract_id", "source_job", "run_id", "breach_type", "opened_at",
        F.when(closes, moment).otherwise(F.col("resolved_at")).alias("resolved_at"),
        F.when(closes, F.lit(run_id)).otherwise(F.col("resolution_run_id")).alias("resolution_run_id"),
        F.when(closes, F.round(_hours("opened_at", moment), 4)).otherwise(F.col("duration_hours")).alias("duration_hours"),
        (F.col("escalated") | F.coalesce(overdue, F.lit(False))).alias("escalated"),
    )
    opened = (
        live.join(jobs.where("failed"), "source_job", "left_semi")
        .join(breaches.where("resolved_at is null"), "contract_id", "left_anti")
        .select(
            "contract_id", "source_job", F.lit(run_id).alias("run_id"), F.lit("dq_violation").alias("breach_type"),
            moment.alias("opened_at"), F.lit(None).cast("timestamp").alias("resolved_at"),
            F.lit(None).cast("string").alias("resolution_run_id"), F.lit(None).cast("double").alias("duration_hours"),
            F.lit(False).alias("escalated"),
        )
    )
    return kept.unionByName(opened)


def contract_status(contracts: DataFrame, breaches: DataFrame) -> DataFrame:
    """OK, BREACHED or OVERDUE per contract."""
    open_now = breaches.where("resolved_at is null").groupBy("contract_id").agg(
        F.max_by("escalated", "opened_at").alias("escalated")
    )
    status = F.when(F.col("escalated").isNull(), "OK").when(F.col("escalated"), "OVERDUE").otherwise("BREACHED")
    return contracts.join(open_now, "contract_id", "left").select("contract_id", "source_job", status.alias("status"))


def publish_gate(jobs: DataFrame, results: DataFrame, contracts: DataFrame, breaches: DataFrame) -> DataFrame:
    """PROMOTE or HOLD per job, with the reasons for holding."""
    latest = results.groupBy("job_name").agg(
        F.max_by(F.struct("status", "run_id"), F.struct("completed_at", "run_id")).alias("r")
    ).select("job_name", F.col("r.status").alias("result_status"), F.col("r.run_id").alias("run_id"))
    open_count = (
        breaches.where("resolved_at is null").join(contracts.where("active").select("contract_id"), "contract_id", "left_semi")
        .groupBy(F.col("source_job").alias("job_name")).agg(F.count(F.lit(1)).alias("open_breaches"))
    )
    joined = jobs.select("job_name").distinct().join(latest, "job_name", "left").join(open_count, "job_name", "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("result_status").isNull(), "no result"),
        F.when(F.col("result_status") != "PASSED", F.concat(F.lit("latest result is "), "result_status")),
        F.when(F.col("open_breaches") > 0, F.concat(F.col("open_breaches").cast("string"), F.lit(" open breach(es)"))),
    ))
    return joined.select(
        "job_name", "run_id", "result_status", reasons.alias("reasons"),
        F.when(F.size(reasons) == 0, "PROMOTE").otherwise("HOLD").alias("verdict"),
    )
