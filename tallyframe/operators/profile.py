"""Column profiles, column statistics, their drift, and rules suggested by them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import cells
from tallyframe.functions.ranks import exact_percentiles
from tallyframe.operators.rules import Rule, distinct_counts, evaluate, violations_frame

PROFILE_SCHEMA = (
    "column_name string, null_rate double, distinct_count bigint, min_val string, max_val string, "
    "mean_val double, std_val double, p25 double, p50 double, p75 double, p95 double"
)
QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
DRIFT_METRICS = ("mean_val", "std_val", "null_rate", "p25", "p50", "p75", "p95")
STAT_METRICS = ("row_count", "null_count", "distinct_count", "mean", "std_dev", "sum", "min_value", "max_value")


def profile(df: DataFrame, columns: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """One row per column; all columns when none are named.

    ``approximate`` trades the exact distinct counts and percentiles for sketches
    that need a single scan and no shuffle of values.
    """
    df = cells.normalised(df)
    names = [c for c in (columns or df.columns) if c in df.columns]
    df = df.select(*[cells.q(c) for c in names])
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    # Bounds of text need an aggregate without code generation, so they do not
    # share one with the rest.
    text_bounds: list[Column] = []
    numeric = []
    for i, name in enumerate(names):
        t = df.schema[name].dataType
        c, x = cells.q(name), cells.number(cells.q(name), t)
        plain = c if not isinstance(t, (T.ArrayType, T.MapType, T.StructType)) else F.to_json(c)
        bounds = [F.min(plain).cast("string").alias(f"lo{i}"), F.max(plain).cast("string").alias(f"hi{i}")]
        aggs.append(F.count(c).alias(f"c{i}"))
        if cells.is_numeric(t) or cells.is_temporal(t) or isinstance(t, T.BooleanType):
            aggs += bounds
        else:
            text_bounds += bounds
        if cells.is_numeric(t) or isinstance(t, (T.StringType, T.BooleanType)):
            numeric.append(i)
            aggs += [F.count(x).alias(f"x{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
    row = df.agg(*aggs).first().asDict()
    if text_bounds:
        row.update(df.agg(*text_bounds).first().asDict())
    if approximate:
        sketches = [F.approx_count_distinct(cells.q(n)).alias(f"d{i}") for i, n in enumerate(names)]
        row.update(df.agg(*sketches).first().asDict())
    numeric = [i for i in numeric if row[f"x{i}"]]
    numbers = df.select(*[
        cells.number(cells.q(names[i]), df.schema[names[i]].dataType).alias(names[i]) for i in numeric
    ]) if numeric else None
    if approximate:
        distinct = {n: row[f"d{i}"] for i, n in enumerate(names)}
        found = {}
        if numbers is not None:
            qs = F.array(*[F.lit(v) for v in QUANTILES.values()])
            got = numbers.agg(*[
                F.percentile_approx(cells.q(names[i]), qs).alias(str(i)) for i in numeric
            ]).first()
            found = {names[i]: dict(zip(QUANTILES.values(), got[str(i)])) for i in numeric}
    else:
        distinct = {n: v[2] for n, v in distinct_counts(df, names).items()}
        found = exact_percentiles(
            numbers, {names[i]: list(QUANTILES.values()) for i in numeric}
        ) if numbers is not None else {}
    out = []
    for i, name in enumerate(names):
        some = i in numeric
        ps = [found[name][v] if some else None for v in QUANTILES.values()]
        rows = row["rows"]
        out.append((
            name, (rows - row[f"c{i}"]) / rows if rows else 0.0, distinct[name], row[f"lo{i}"], row[f"hi{i}"],
            row[f"m{i}"] if some else None, row[f"s{i}"] if some else None, *ps,
        ))
    return df.sparkSession.createDataFrame(out, PROFILE_SCHEMA)


def profile_drift(current: DataFrame, previous: DataFrame, threshold_pct: float) -> DataFrame:
    """Columns of which some metric moved by more than ``threshold_pct`` percent."""
    both = current.alias("c").join(previous.alias("p"), "column_name")
    moved = []
    for m in DRIFT_METRICS:
        c, p = F.col(f"c.{m}"), F.col(f"p.{m}")
        change = F.when(p == 0, c != 0).otherwise(F.abs(c - p) / F.abs(p) * 100 > threshold_pct)
        moved.append(F.when(F.coalesce(change, F.lit(False)), F.lit(m)))
    metrics = F.array_compact(F.array(*moved))
    return both.select("column_name", metrics.alias("metrics")).where(F.size("metrics") > 0)


def column_statistics(df: DataFrame) -> DataFrame:
    """Tall ``column_name, metric, value``: counts, moments and bounds per column."""
    df = cells.normalised(df)
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema):
        c = cells.q(f.name)
        x = cells.number(c, f.dataType)
        if cells.is_temporal(f.dataType):
            x = F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000.0)
        aggs += [
            F.count(c).alias(f"c{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
            F.avg(x).alias(f"m{i}"), F.when(F.count(x) > 1, F.stddev_samp(x)).alias(f"s{i}"),
            F.sum(x).alias(f"t{i}"),
        ]
    row = df.agg(*aggs).first().asDict()
    distinct = distinct_counts(df, df.columns)
    out = []
    for i, f in enumerate(df.schema):
        moments = (None, None, None) if cells.is_temporal(f.dataType) else (row[f"m{i}"], row[f"s{i}"], row[f"t{i}"])
        values = (
            row["rows"], row["rows"] - row[f"c{i}"], distinct[f.name][2], *moments, row[f"lo{i}"], row[f"hi{i}"],
        )
        out += [(f.name, m, None if v is None else float(v)) for m, v in zip(STAT_METRICS, values)]
    return df.sparkSession.createDataFrame(out, "column_name string, metric string, value double")


def column_statistics_diff(source: DataFrame, target: DataFrame, float_tolerance: float = 1e-9,
                           row_count_tolerance: int = 0) -> DataFrame:
    """Metrics that differ; a column on one side only gives the pseudo-metric ``present``."""
    s, t = column_statistics(source), column_statistics(target)
    joined = s.withColumnRenamed("value", "source_value").withColumn("in_s", F.lit(1)).join(
        t.withColumnRenamed("value", "target_value").withColumn("in_t", F.lit(1)),
        ["column_name", "metric"], "full_outer",
    )
    gap = F.abs(F.col("source_value") - F.col("target_value"))
    allowed = (
        F.when(F.col("metric") == "row_count", F.lit(float(row_count_tolerance)))
        .when(F.col("metric").isin("null_count", "distinct_count"), F.lit(0.0))
        .otherwise(F.lit(float(float_tolerance)))
    )
    same = F.when(F.col("source_value").isNull() & F.col("target_value").isNull(), F.lit(True)).otherwise(
        F.coalesce(gap <= allowed, F.lit(False))
    )
    both = joined.where("in_s = 1 and in_t = 1").where(~same).select(
        "column_name", "metric", "source_value", "target_value",
        (F.col("target_value") - F.col("source_value")).alias("delta"),
    )
    one_sided = joined.where("(in_s is null or in_t is null) and metric = 'row_count'").select(
        "column_name", F.lit("present").alias("metric"),
        F.coalesce(F.col("in_s"), F.lit(0)).cast("double").alias("source_value"),
        F.coalesce(F.col("in_t"), F.lit(0)).cast("double").alias("target_value"),
        F.lit(None).cast("double").alias("delta"),
    )
    return both.unionByName(one_sided)


def result_metrics(df: DataFrame) -> DataFrame:
    """Per column: rows, null-or-empty cells, distinct values, bounds if all values are numbers."""
    shown = df.select(*[cells.text(cells.q(f.name), f.dataType).alias(f.name) for f in df.schema])
    filled = shown.select(*[F.nullif(cells.q(c), F.lit("")).alias(c) for c in shown.columns])
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(filled.columns):
        c, x = cells.q(name), cells.number(cells.q(name), T.StringType())
        aggs += [
            F.count(c).alias(f"c{i}"), F.count_if(c.isNotNull() & x.isNull()).alias(f"b{i}"),
            F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"m{i}"),
        ]
    row = filled.agg(*aggs).first().asDict()
    distinct = distinct_counts(filled, filled.columns)
    out = []
    for i, name in enumerate(filled.columns):
        numeric = row[f"c{i}"] > 0 and row[f"b{i}"] == 0
        bounds = (row[f"lo{i}"], row[f"hi{i}"], row[f"m{i}"]) if numeric else (None, None, None)
        out.append((name, row["rows"], row["rows"] - row[f"c{i}"], distinct[name][2], *bounds))
    return df.sparkSession.createDataFrame(
        out, "column_name string, row_count bigint, null_count bigint, distinct_count bigint, "
        "min_value double, max_value double, avg_value double",
    )


def metric_assertions(metrics: DataFrame, expected: Mapping[str, float], min_rows: int | None = None,
                      max_rows: int | None = None) -> DataFrame:
    """Row bounds and ``column.metric`` expectations that do not hold."""
    spark = metrics.sparkSession
    tall = metrics.select(
        "column_name",
        F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("actual"))
            for m in ("row_count", "null_count", "distinct_count", "min_value", "max_value", "avg_value")
        ])),
    ).withColumn("path", F.concat_ws(".", "column_name", "metric"))
    wanted = spark.createDataFrame(
        [(k, float(v)) for k, v in expected.items()], "path string, expected double"
    )
    wrong = wanted.join(tall, "path", "left").where(~F.col("expected").eqNullSafe(F.col("actual"))).select(
        "path", F.col("expected").cast("string").alias("expected"),
        F.coalesce(F.col("actual").cast("string"), F.lit("<missing>")).alias("actual"),
        F.lit("metric_mismatch").alias("mismatch_type"),
    )
    total = metrics.agg(F.coalesce(F.max("row_count"), F.lit(0)).alias("n"))
    for bound, op, kind in (
        (min_rows, F.col("n") < F.lit(min_rows or 0), "row_count_below_min"),
        (max_rows, F.col("n") > F.lit(max_rows or 0), "row_count_above_max"),
    ):
        if bound is not None:
            wrong = wrong.unionByName(total.where(op).select(
                F.lit("row_count").alias("path"), F.lit(str(bound)).alias("expected"),
                F.col("n").cast("string").alias("actual"), F.lit(kind).alias("mismatch_type"),
            ))
    return wrong


def suggest_rules(profiles: DataFrame) -> DataFrame:
    """Completeness, range and p95 rules derived from a profile."""
    number = F.col("min_val").try_cast("double"), F.col("max_val").try_cast("double")
    none = F.lit(None).cast("double")
    complete = profiles.where("null_rate < 1.0").select(
        F.lit("completeness_ratio").alias("type"), "column_name", none.alias("percentile"),
        F.round(F.greatest(F.lit(0.0), 1.0 - F.col("null_rate") - 0.05), 3).alias("min_value"),
        none.alias("max_value"),
    )
    between = profiles.where(number[0].isNotNull() & number[1].isNotNull()).select(
        F.lit("column_value_between").alias("type"), "column_name", none.alias("percentile"),
        number[0].alias("min_value"), (number[1] * 1.1).alias("max_value"),
    )
    tail = profiles.where("p95 is not null").select(
        F.lit("column_percentile").alias("type"), "column_name", F.lit(95.0).alias("percentile"),
        none.alias("min_value"), F.round(F.col("p95") * 1.2, 4).alias("max_value"),
    )
    return reduce(DataFrame.unionByName, [complete, between, tail]).withColumn("severity", F.lit("warn"))


def preview_rule(history: DataFrame, column: str, metric: str, rule: Rule) -> DataFrame:
    """A rule applied to the past values of one profile metric of one column."""
    values = history.where((F.col("column_name") == column) & F.col(metric).isNotNull()).select(
        F.col("captured_at"), F.col(metric).alias(rule.column or column)
    )
    return violations_frame(history.sparkSession, evaluate(values, [rule]))


def latest_profiles(history: DataFrame) -> DataFrame:
    """The newest profile row per job and column."""
    w = Window.partitionBy("job_name", "column_name").orderBy(F.col("captured_at").desc())
    return history.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def segment_candidates(profiles: DataFrame, key_columns: Sequence[str] = (), most: int = 3,
                       max_distinct: int = 50) -> DataFrame:
    """The columns with the fewest distinct values that are no keys."""
    return (
        profiles.where((F.col("distinct_count") <= max_distinct) & ~F.col("column_name").isin(list(key_columns)))
        .orderBy("distinct_count", "column_name").limit(most)
    )
