"""Data-quality rules compiled to a few passes over a DataFrame.

Row and aggregate rules share one aggregate. Rules on distinct values share one
grouped count, percentile rules one bracketed search, and rules that need a
second look (outlier counts) share one more aggregate. Only scalars per rule
reach the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import cells, stats
from tallyframe.functions.normal import log_normal_cdf, normal_cdf
from tallyframe.functions.ranks import exact_percentiles, in_blocks, running_total


@dataclass(frozen=True)
class Rule:
    type: str
    column: str | None = None
    severity: str = "error"
    min_value: float | None = None
    max_value: float | None = None
    min_date: str | None = None
    max_date: str | None = None
    pattern: str | None = None
    values: Sequence[Any] | None = None
    sql: str | None = None
    column_b: str | None = None
    operator: str | None = None
    percentile: float | None = None
    expected_type: str | None = None
    lookup_query: str | None = None
    threshold: float | None = None
    iqr_multiplier: float | None = None
    fence_type: str | None = None
    alpha: float | None = None
    distribution: str | None = None
    distribution_params: Mapping[str, float] = field(default_factory=dict)
    bins: int | None = None
    expected_frequencies: Sequence[float] | None = None
    expected_proportion: float | None = None
    condition: Any = None
    window: int | None = None
    order_by: Sequence[str] = ()
    partition_by: Sequence[str] = ()


@dataclass(frozen=True)
class Violation:
    rule_index: int
    rule_type: str
    column: str | None
    message: str
    severity: str
    actual_value: float | None
    statistic: float | None = None


class Verdict(NamedTuple):
    value: float | None
    message: str
    severity: str | None = None
    statistic: float | None = None


VIOLATION_SCHEMA = (
    "rule_index int, rule_type string, column_name string, message string, "
    "severity string, actual_value double, statistic double"
)


def violations_frame(spark: SparkSession, found: Sequence[Violation]) -> DataFrame:
    """The violations as a table; at most one row per rule."""
    return spark.createDataFrame(
        [(v.rule_index, v.rule_type, v.column, v.message, v.severity,
          _float(v.actual_value), _float(v.statistic)) for v in found],
        VIOLATION_SCHEMA,
    )


def _float(value: float | None) -> float | None:
    return None if value is None else float(value)


def spark_sql(spark: SparkSession, sql: str, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Analyse ``sql`` with the given frames as views; the view names are free again afterwards."""
    before = {}
    for name, frame in (views or {}).items():
        if spark.catalog.tableExists(name):
            before[name] = spark.table(name)
        frame.createOrReplaceTempView(name)
    try:
        return spark.sql(sql)
    finally:
        for name in views or {}:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def java_pattern(pattern: str) -> str | None:
    """A Python pattern in Java syntax, anchored at the start; None when it does not compile."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    out = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m.group(1).replace('_', '')}>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{m.group(1).replace('_', '')}>", out)
    return r"(?U)\A(?:" + out.replace(r"\Z", r"\z") + ")"


def _bounds(rule: Rule) -> tuple[float, float]:
    low = -math.inf if rule.min_value is None else rule.min_value
    high = math.inf if rule.max_value is None else rule.max_value
    return low, high


class RuleSet:
    def __init__(self, df: DataFrame, rules: Sequence[Rule], views: Mapping[str, DataFrame] | None = None):
        self.spark = df.sparkSession
        self.df = cells.normalised(df)
        self.rules = list(rules)
        self.views = views or {}
        self._types = {f.name: f.dataType for f in self.df.schema}

    # Column readings -----------------------------------------------------

    def _raw(self, name: str) -> Column:
        return cells.q(name)

    def _num(self, name: str) -> Column:
        return cells.number(cells.q(name), self._types[name])

    def _time(self, name: str) -> Column:
        return cells.moment(cells.q(name), self._types[name])

    def _text(self, name: str) -> Column:
        t = self._types[name]
        c = cells.text(cells.q(name), t)
        return F.initcap(c) if isinstance(t, T.BooleanType) else c

    def _shown(self, name: str) -> Column:
        """Text with the word a null is printed as, so that null cells are judged too."""
        t = self._types[name]
        word = "nan" if cells.is_numeric(t) else "NaT" if cells.is_temporal(t) else "None"
        return F.coalesce(self._text(name), F.lit(word))

    def _has(self, *names: str | None) -> bool:
        return all(n in self._types for n in names)

    # One aggregate for the row and scalar rules ---------------------------

    def _bad_rows(self, r: Rule) -> Column | None:
        """True for rows that break the rule; None for other rules and for incomplete ones."""
        kind, c = r.type, r.column
        if kind == "custom_sql":
            fragment = r.pattern or r.sql
            return F.expr(fragment) if fragment else None
        if not self._has(c):
            return None
        if kind == "not_null":
            return self._raw(c).isNull()
        if kind in ("match_regex", "pii_mask_check"):
            pattern = java_pattern(r.pattern) if r.pattern else None
            if pattern is None or not self._compiles(pattern):
                return None
            hit = self._shown(c).rlike(pattern)
            return ~hit if kind == "match_regex" else hit
        if kind == "column_max_length":
            return None if r.max_value is None else F.length(self._text(c)) > r.max_value
        if kind == "column_min_length":
            return None if r.min_value is None else F.length(self._text(c)) < r.min_value
        if kind in ("value_in_set", "value_not_in_set"):
            values = [str(v) for v in r.values] if r.values else [
                v.strip() for v in (r.sql or "").split(",") if r.sql
            ]
            if not values:
                return None
            hit = self._shown(c).isin(values)
            return ~hit if kind == "value_in_set" else hit
        if kind == "column_contains":
            return ~self._text(c).contains(F.lit(r.pattern)) if r.pattern else None
        if kind == "date_range":
            return self._outside_dates(r)
        if kind == "positive_values":
            return F.coalesce(self._num(c) <= 0, F.lit(True))
        if kind == "negative_values":
            return F.coalesce(self._num(c) >= 0, F.lit(True))
        if kind == "column_type_check":
            present = self._raw(c).isNotNull()
            if r.expected_type in ("int", "float"):
                return present & self._num(c).isNull()
            if r.expected_type == "date":
                return present & self._time(c).isNull()
            if r.expected_type == "uuid":
                return present & ~self._text(c).rlike(cells.UUID_PATTERN)
            return F.lit(False) if r.expected_type else None
        if kind == "column_value_between":
            low, high = _bounds(r)
            return (self._num(c) < low) | (self._num(c) > high)
        if kind == "cross_column_consistency":
            if not self._has(r.column_b):
                return None
            a, b = self._num(c), self._num(r.column_b)
            return {
                "<=": a > b, "<": a >= b, ">=": a < b, ">": a <= b, "==": F.coalesce(a != b, F.lit(True)),
            }.get(r.operator or "<=", F.lit(False))
        if kind == "no_whitespace":
            t = self._text(c)
            return t != F.regexp_replace(t, r"(?U)\A\s+|\s+\z", "")
        return None

    def _outside_dates(self, r: Rule) -> Column:
        at = self._time(r.column)

        def bound(date: str | None, value: float | None) -> Column | None:
            if date is not None:
                return F.lit(date).cast("timestamp")
            if value is not None:  # a bare number is nanoseconds since 1970
                return F.timestamp_micros(F.lit(int(value // 1000)))
            return None

        low, high = bound(r.min_date, r.min_value), bound(r.max_date, r.max_value)
        bad = at.isNull()
        if low is not None:
            bad = bad | (at < low)
        if high is not None:
            bad = bad | (at > high)
        return bad

    def _compiles(self, pattern: str) -> bool:
        try:
            self.spark.range(1).select(F.lit("").rlike(pattern)).first()
            return True
        except Exception:
            return False

    def _scalars(self, r: Rule) -> dict[str, Column]:
        kind, c = r.type, r.column
        if kind in ("row_count_min", "row_count_max", "row_count_between"):
            return {"n": F.count(F.lit(1))}
        if not self._has(c):
            return {}
        x = self._num(c)
        if kind == "column_mean_between":
            return {"v": F.avg(x)}
        if kind == "completeness_ratio":
            return {"v": F.count(self._raw(c)), "n": F.count(F.lit(1))}
        if kind == "column_sum_between":
            return {"v": F.coalesce(F.sum(x), F.lit(0.0))}
        if kind == "column_std_dev_between":
            return {"v": F.stddev_samp(x), "n": F.count(x)}
        if kind in ("outlier_zscore", "outlier_grubbs", "distribution_ks_test", "distribution_chi_square",
                    "distribution_anderson_darling", "anomaly_detection_sigma"):
            return {
                "n": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x),
            }
        if kind == "hypothesis_test_proportion":
            t = self._text(c)
            return {"v": F.count_if(t == F.lit(str(r.condition))), "n": F.count(t)}
        return {}

    def evaluate(self) -> list[Violation]:
        aggs: dict[str, Column] = {}
        for i, r in enumerate(self.rules):
            bad = self._bad_rows(r)
            if bad is not None:
                aggs[f"bad_{i}"] = F.count_if(bad)
            for name, c in self._scalars(r).items():
                aggs[f"{name}_{i}"] = c
        row = self.df.agg(*[c.alias(k) for k, c in aggs.items()]).first().asDict() if aggs else {}
        distinct = self._distinct_counts()
        percentiles = self._percentiles()
        second = self._second_look(row, percentiles)
        found: list[Violation] = []
        for i, r in enumerate(self.rules):
            verdict = self._verdict(i, r, row, distinct, percentiles, second)
            if verdict is not None:
                v = Verdict(*verdict)
                column = None if r.type.startswith(("row_count", "custom_sql")) else r.column
                found.append(
                    Violation(i, r.type, column, v.message, v.severity or r.severity, v.value, v.statistic)
                )
        return found

    # Distinct values ------------------------------------------------------

    def _distinct_counts(self) -> dict[str, tuple[int, int, int]]:
        """Per column: rows, distinct values counting NULL as one, distinct non-null values."""
        wanted = sorted({
            r.column for r in self.rules
            if r.type in ("unique", "distinct_count_between") and self._has(r.column)
        })
        return distinct_counts(self.df, wanted)

    # Percentiles ----------------------------------------------------------

    def _percentiles(self) -> dict[str, dict[float, float | None]]:
        wanted: dict[str, set[float]] = {}
        for r in self.rules:
            if not self._has(r.column):
                continue
            if r.type == "column_percentile" and r.percentile is not None:
                wanted.setdefault(r.column, set()).add(r.percentile / 100)
            elif r.type == "outlier_iqr":
                wanted.setdefault(r.column, set()).update((0.25, 0.75))
        if not wanted:
            return {}
        numbers = self.df.select(*[self._num(c).alias(c) for c in wanted])
        return exact_percentiles(numbers, {c: sorted(qs) for c, qs in wanted.items()})

    # Outlier counts -------------------------------------------------------

    def _second_look(self, row: dict, percentiles: dict) -> dict[int, int]:
        aggs = []
        for i, r in enumerate(self.rules):
            if r.type == "outlier_zscore" and row.get(f"n_{i}", 0) > 1 and (row[f"std_{i}"] or 0) > 0:
                limit = 3.0 if r.threshold is None else r.threshold
                z = F.abs((self._num(r.column) - row[f"mean_{i}"]) / row[f"std_{i}"])
                aggs.append(F.count_if(z > limit).alias(str(i)))
            elif r.type == "outlier_iqr" and r.column in percentiles:
                fence = self._fence(r, percentiles)
                if fence is not None:
                    x = self._num(r.column)
                    aggs.append(F.count_if((x < fence[0]) | (x > fence[1])).alias(str(i)))
        if not aggs:
            return {}
        return {int(k): v for k, v in self.df.agg(*aggs).first().asDict().items()}

    @staticmethod
    def _fence(r: Rule, percentiles: dict) -> tuple[float, float] | None:
        q1, q3 = percentiles[r.column][0.25], percentiles[r.column][0.75]
        if q1 is None:
            return None
        k = 1.5 if r.iqr_multiplier is None else r.iqr_multiplier
        if r.fence_type == "outer":
            k = max(k, 3.0)
        return q1 - k * (q3 - q1), q3 + k * (q3 - q1)

    # Verdicts -------------------------------------------------------------

    def _verdict(self, i: int, r: Rule, row: dict, distinct: dict, percentiles: dict, second: dict):
        kind = r.type
        if f"bad_{i}" in row:
            bad = row[f"bad_{i}"]
            return (bad, f"{bad} row(s) break {kind}" + (f" on '{r.column}'" if r.column else "")) if bad else None
        if kind.startswith("row_count"):
            low, high = _bounds(r)
            if kind == "row_count_min":
                high = math.inf
            elif kind == "row_count_max":
                low = -math.inf
            return _outside("row count", row[f"n_{i}"], low, high)
        if kind == "referential_check" and self._has(r.column) and r.lookup_query:
            return self._referential(r)
        if kind == "custom_sql_assert" and r.sql and r.operator:
            return self._sql_assert(r)
        if not self._has(r.column):
            return None
        low, high = _bounds(r)
        if kind == "unique":
            rows, values, _ = distinct[r.column]
            return (rows - values, f"{rows - values} duplicate value(s) in '{r.column}'") if rows > values else None
        if kind == "distinct_count_between":
            return _outside(f"distinct count of '{r.column}'", distinct[r.column][2], low, high)
        if kind in ("column_mean_between", "column_sum_between"):
            return _outside(f"{kind.split('_')[1]} of '{r.column}'", row[f"v_{i}"], low, high)
        if kind == "column_std_dev_between":
            value = row[f"v_{i}"] if row[f"n_{i}"] > 1 else None
            return _outside(f"standard deviation of '{r.column}'", value, low, high)
        if kind == "column_percentile" and r.percentile is not None:
            value = percentiles[r.column][r.percentile / 100]
            return _outside(f"p{r.percentile} of '{r.column}'", value, low, high)
        if kind == "completeness_ratio" and r.min_value is not None and row[f"n_{i}"]:
            ratio = row[f"v_{i}"] / row[f"n_{i}"]
            return (ratio, f"completeness of '{r.column}' is {ratio:.2%}") if ratio < r.min_value else None
        if i in second:
            return (second[i], f"{second[i]} outlier(s) in '{r.column}'") if second[i] else None
        tests = {
            "outlier_grubbs": self._grubbs,
            "distribution_ks_test": self._kolmogorov,
            "distribution_chi_square": self._chi_square,
            "distribution_anderson_darling": self._anderson,
            "hypothesis_test_proportion": self._proportion,
            "anomaly_detection_sigma": self._rolling,
        }
        if kind not in tests:
            return None
        mine = {k.rsplit("_", 1)[0]: v for k, v in row.items() if k.endswith(f"_{i}")}
        return tests[kind](r, mine)

    def _referential(self, r: Rule):
        lookup = spark_sql(self.spark, r.lookup_query, self.views)
        bad = missing_references(
            self.df.select(self._text(r.column).alias("v")), lookup
        ).first()["bad"]
        return (bad, f"{bad} value(s) in '{r.column}' not in the lookup result") if bad else None

    def _sql_assert(self, r: Rule):
        try:
            answer = spark_sql(self.spark, r.sql, self.views).limit(2)
            rows = answer.collect()
            if len(rows) != 1 or len(answer.columns) != 1:
                return None, "custom_sql_assert needs one row and one column", "error"
            scalar = float(rows[0][0])
        except Exception as error:
            return None, f"custom_sql_assert failed: {type(error).__name__}"
        limit = 0.0 if r.min_value is None else r.min_value
        holds = {
            ">=": scalar >= limit, ">": scalar > limit, "<=": scalar <= limit,
            "<": scalar < limit, "==": scalar == limit, "!=": scalar != limit,
        }.get(r.operator, False)
        return None if holds else (scalar, f"scalar {scalar} is not {r.operator} {limit}")

    def _grubbs(self, r: Rule, m: dict):
        n, std = m["n"], m["std"]
        if n <= 2 or not std:
            return None
        g = max(m["max"] - m["mean"], m["mean"] - m["min"]) / std
        critical = stats.grubbs_critical(n, 0.05 if r.alpha is None else r.alpha)
        return (g, f"outlier in '{r.column}': G={g:.4g} > {critical:.4g}") if g > critical else None

    def _ranked_values(self, column: str) -> DataFrame:
        """Distinct values ``v`` with their count ``w`` and the running count ``upto``."""
        counted = (
            self.df.select(self._num(column).alias("v")).where("v is not null")
            .groupBy("v").agg(F.count(F.lit(1)).alias("w"))
        )
        return running_total(counted, [F.col("v").asc()], "w", "upto", "bigint")

    def _kolmogorov(self, r: Rule, m: dict):
        n = m["n"]
        if n <= 1:
            return None
        kind, given = r.distribution or "normal", r.distribution_params or {}
        v = F.col("v")
        if kind == "normal":
            loc, scale = given.get("mean", m["mean"]), given.get("std", m["std"] or 1.0)
            cdf = normal_cdf((v - float(loc)) / float(scale))
        elif kind == "uniform":
            low, high = float(given.get("min", m["min"])), float(given.get("max", m["max"]))
            span = high - low if high > low else 1.0
            cdf = F.least(F.greatest((v - low) / span, F.lit(0.0)), F.lit(1.0))
        else:
            rate = float(given.get("lam", 1.0))
            cdf = F.when(v <= 0, F.lit(0.0)).otherwise(1.0 - F.exp(-v * rate))
        placed = self._ranked_values(r.column).withColumn("f", cdf)
        gap = F.greatest(F.col("upto") / n - F.col("f"), F.col("f") - (F.col("upto") - F.col("w")) / n)
        d = placed.agg(F.max(gap).alias("d")).first()["d"]
        p = stats.kolmogorov_tail(d, n)
        alpha = 0.05 if r.alpha is None else r.alpha
        return Verdict(p, f"'{r.column}' is not {kind}: p={p:.4g} < {alpha}", None, d) if p < alpha else None

    def _chi_square(self, r: Rule, m: dict):
        expected = list(r.expected_frequencies or [])
        bins = len(expected) if r.bins is None else r.bins
        n = m["n"]
        if not n or not expected or bins != len(expected):
            return None
        low, high = m["min"], m["max"]
        if low == high:
            low, high = low - 0.5, high + 0.5
        x = self._num(r.column)
        place = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1))
        # At most one row per bin comes back.
        seen = {
            row["b"]: row["c"]
            for row in self.df.where(x.isNotNull()).groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()
        }
        scaled = [e * n / sum(expected) for e in expected]
        statistic = sum((seen.get(b, 0) - e) ** 2 / e for b, e in enumerate(scaled))
        p = stats.chi_square_tail(statistic, bins - 1)
        alpha = 0.05 if r.alpha is None else r.alpha
        if p >= alpha:
            return None
        return Verdict(p, f"'{r.column}' departs from the expected frequencies: p={p:.4g} < {alpha}", None, statistic)

    def _anderson(self, r: Rule, m: dict):
        n, std = m["n"], m["std"]
        if n <= 1 or not std:
            return None
        z = (F.col("v") - m["mean"]) / std
        w, before = F.col("w"), F.col("upto") - F.col("w")
        low_weight = (w * (2 * before + w)).cast("double")
        high_weight = 2.0 * n * w - low_weight
        total = self._ranked_values(r.column).agg(
            F.sum(low_weight * log_normal_cdf(z) + high_weight * log_normal_cdf(-z)).alias("s")
        ).first()["s"]
        statistic = -n - total / n
        critical = stats.anderson_critical(n, 0.05 if r.alpha is None else r.alpha)
        if statistic <= critical:
            return None
        return statistic, f"'{r.column}' is not normal: {statistic:.4g} > {critical:.4g}"

    def _proportion(self, r: Rule, m: dict):
        if r.expected_proportion is None or r.condition is None or not m["n"]:
            return None
        p0 = float(r.expected_proportion)
        error = math.sqrt(p0 * (1 - p0) / m["n"])
        if error <= 0:
            return None
        z = (m["v"] / m["n"] - p0) / error
        p = 2 * stats.normal_tail(abs(z))
        alpha = 0.05 if r.alpha is None else r.alpha
        if p >= alpha:
            return None
        return Verdict(p, f"proportion of '{r.condition}' in '{r.column}': p={p:.4g} < {alpha}", None, z)

    def _rolling(self, r: Rule, m: dict):
        size = 10 if r.window is None else r.window
        if m["n"] <= 1 or size <= 1:
            return None
        if not r.order_by:
            raise ValueError("anomaly_detection_sigma needs order_by: a DataFrame has no row order")
        limit = 3.0 if r.threshold is None else r.threshold
        marked = rolling_zscore(self.df, self._num(r.column), size, r.order_by, r.partition_by)
        bad = marked.agg(F.count_if(F.col("z") > limit).alias("bad")).first()["bad"]
        return (bad, f"{bad} value(s) in '{r.column}' leave the rolling {limit} sigma band") if bad else None


def _outside(what: str, value: float | None, low: float, high: float):
    """A missing aggregate is outside every range."""
    if value is not None and low <= value <= high:
        return None
    return value, f"{what} is {value}, not in [{low}, {high}]"


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, int, int]]:
    """Exact distinct counts of several columns from one grouped pass."""
    if not columns:
        return {}
    entries = []
    for i, name in enumerate(columns):
        t = df.schema[name].dataType
        slots = {"whole": F.lit(None).cast("bigint"), "real": F.lit(None).cast("double"), "txt": F.lit(None).cast("string")}
        c = cells.q(name)
        if isinstance(t, T.TimestampType):
            slots["whole"] = F.unix_micros(c)
        elif isinstance(t, T.DateType):
            slots["whole"] = F.unix_date(c).cast("bigint")
        elif cells.is_integral(t) or isinstance(t, T.BooleanType):
            slots["whole"] = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            slots["real"] = c.cast("double")
        else:
            slots["txt"] = cells.text(c, t)
        entries.append(F.struct(F.lit(i).alias("i"), *[v.alias(k) for k, v in slots.items()]))
    present = F.coalesce(F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("txt").isNotNull(), F.lit(False))
    counted = (
        df.select(F.inline(F.array(*entries))).groupBy("i", "whole", "real", "txt")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("i").agg(
            F.sum("n").alias("rows"), F.count(F.lit(1)).alias("all"), F.count_if(present).alias("values")
        )
    )
    found = {r["i"]: (r["rows"], r["all"], r["values"]) for r in counted.collect()}
    return {name: found.get(i, (0, 0, 0)) for i, name in enumerate(columns)}


def missing_references(values: DataFrame, lookup: DataFrame) -> DataFrame:
    """How many non-null values are absent from the first lookup column.

    Values are counted before the join, so a frequent value travels as one row.
    """
    name = lookup.columns[0]
    known = lookup.select(cells.text(cells.q(name), lookup.schema[name].dataType).alias("v")).distinct()
    return (
        values.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        .join(known, "v", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bad"))
    )


def rolling_zscore(df: DataFrame, value: Column, size: int, order_by: Sequence[str],
                   partition_by: Sequence[str] = ()) -> DataFrame:
    """Distance of each value from the mean of the ``size`` rows before it, in their deviations.

    Rows are numbered globally and windowed in blocks of bounded size; each block
    also gets the last ``size`` rows of the one before it. ``order_by`` should
    order rows completely.
    """
    names = [*partition_by, *order_by]
    spread = in_blocks(df.select(*[cells.q(c) for c in names], value.alias("x")), names, size)
    w = Window.partitionBy(*[cells.q(c) for c in partition_by], "block").orderBy("r").rowsBetween(-size, -1)
    mean, std = F.avg("x").over(w), F.stddev_samp("x").over(w)
    gap = F.abs(F.col("x") - F.col("mean"))
    z = F.when(F.col("std") > 0, gap / F.col("std")).when(gap > 0, F.lit(float("inf")))
    return (
        spread.withColumn("mean", mean)
        .withColumn("std", F.when(F.count("x").over(w) >= 2, std))
        .where("block = home")
        .select(*[cells.q(c) for c in names], "x", F.when(F.col("std").isNotNull(), z).alias("z"))
    )


def evaluate(df: DataFrame, rules: Sequence[Rule], views: Mapping[str, DataFrame] | None = None) -> list[Violation]:
    return RuleSet(df, rules, views).evaluate()
