"""Which columns of which tables are tested, only observed, or neither."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Job types with SQL text.
SQL_JOB_TYPES = ("reconciliation", "freshness", "profile", "schema_snapshot")
LEVELS = ["untested", "observed", "tested"]

# One SQL token: comment, string, bracketed or quoted name, word, or any other sign.
_TOKEN = "|".join((
    r"--[^\n]*+", r"/[*][\s\S]*?[*]/", r"'(?:[^']|'')*+'", r"\[[^\]]*+\]", r'"(?:[^"]|"")*+"',
    r"[\p{L}_][\p{L}\p{N}_$#@]*+", r"\S",
))


def _is_name(token: Column) -> Column:
    return token.rlike(r'^[\p{L}_\["]')


def _bare(token: Column) -> Column:
    """A name in lower case without its brackets or quotes."""
    inside = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.lower(F.when(token.rlike(r'^[\["]'), inside).otherwise(token))


def _step(seen: Column, token: Column) -> Column:
    """Read one token. A name is open behind FROM or JOIN and goes on over dots."""
    opens = F.lower(token).isin("from", "join")
    begins = (seen["wants"] == "name") & _is_name(token)
    dotted = (seen["wants"] == "dot") & (token == ".")
    closed = F.when(
        seen["open"].isNotNull(), F.array_append(seen["found"], seen["open"])
    ).otherwise(seen["found"])
    none = F.lit(None).cast("string")

    def state(wants: Column, name: Column, found: Column) -> Column:
        return F.struct(wants.alias("wants"), name.alias("open"), found.alias("found"))

    longer = F.when(seen["open"].isNull(), _bare(token)).otherwise(F.concat(seen["open"], _bare(token)))
    return F.when(begins, state(F.lit("dot"), longer, seen["found"])).when(
        dotted, state(F.lit("name"), F.concat(seen["open"], F.lit(".")), seen["found"])
    ).otherwise(state(F.when(opens, "name").otherwise("none"), none, closed))


def referenced_tables(sql: Column) -> Column:
    """Distinct lower-case table names after FROM and JOIN, without the statement's own CTEs.

    The statement is cut into tokens, so names inside strings and comments do not count.
    """
    tokens = F.filter(
        F.regexp_extract_all(sql, F.lit(_TOKEN), F.lit(0)), lambda t: ~t.startswith("--") & ~t.startswith("/*")
    )
    start = F.struct(
        F.lit("none").alias("wants"), F.lit(None).cast("string").alias("open"),
        F.array().cast("array<string>").alias("found"),
    )

    def tables(own: Column) -> Column:
        # A closing sign ends a name that is still open.
        read = F.aggregate(F.array_append(own, F.lit(";")), start, _step, lambda seen: seen["found"])

        def defines(token: Column, at: Column) -> Column:
            before = F.lower(F.get(own, at - 1))
            return (
                _is_name(token) & before.isin("with", "recursive", ",")
                & (F.lower(F.get(own, at + 1)) == "as") & (F.get(own, at + 2) == "(")
            )

        ctes = F.transform(F.filter(own, defines), _bare)
        return F.array_except(F.array_distinct(read), ctes)

    return F.transform(F.array(tokens), tables)[0]


def coverage(jobs: DataFrame, observed: DataFrame) -> DataFrame:
    """One row per table and column with its best level, jobs and rules.

    ``jobs``: ``job_name, job_type, enabled, query, rules ARRAY<STRUCT<type,column>>,
    key_columns, exclude_columns``; ``observed``: ``job_name, column_name`` from
    profiles and latest schema snapshots.
    """
    live = jobs.where(F.col("enabled") & F.col("job_type").isin(*SQL_JOB_TYPES))
    tables = live.select("job_name", F.explode(referenced_tables(F.col("query"))).alias("table_name"))
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, column: Column, observed: bool, key: bool, rule: Column) -> DataFrame:
        return df.select(
            "job_name", F.lower(column).alias("column_name"), F.lit(int(observed)).alias("seen"),
            F.lit(int(key)).alias("key"), rule.alias("rule"),
        )

    by_rule = live.select("job_name", F.inline("rules"))
    by_key = live.select("job_name", F.explode("key_columns").alias("column_name"))
    seen = observed.join(live.select("job_name"), "job_name", "left_semi").select("job_name", "column_name").distinct()
    facts = reduce(DataFrame.unionByName, [
        rows(by_rule, F.col("column"), False, False, F.col("type")),
        rows(by_key, F.col("column_name"), False, True, none),
        rows(seen, F.col("column_name"), True, False, none),
    ]).where("column_name is not null and column_name <> ''")
    per_job = facts.groupBy("job_name", "column_name").agg(
        F.max("seen").alias("seen"), F.max("key").alias("key"), F.collect_set("rule").alias("rules")
    )
    described = per_job.join(live.select("job_name", "job_type", "exclude_columns"), "job_name")
    excluded = F.array_contains(F.transform("exclude_columns", F.lower), F.col("column_name"))
    reconciled = (F.col("job_type") == "reconciliation") & (
        (F.col("key") == 1) | ((F.col("seen") == 1) & ~F.coalesce(excluded, F.lit(False)))
    )
    level = F.when((F.size("rules") > 0) | reconciled, 2).when(F.col("seen") == 1, 1).otherwise(0)
    matrix = tables.join(described.select("job_name", "column_name", "rules", level.alias("level")), "job_name")
    return matrix.groupBy("table_name", "column_name").agg(
        F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.max("level") + 1).alias("level"),
        F.array_sort(F.collect_set("job_name")).alias("jobs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("rules")))).alias("rules"),
    )


def coverage_by_table(matrix: DataFrame) -> DataFrame:
    tested = F.count_if(F.col("level") == "tested")
    n = F.count(F.lit(1))
    return matrix.groupBy("table_name").agg(
        n.alias("columns"), F.round(100.0 * tested / n, 1).alias("tested_pct"),
        F.round(100.0 * F.count_if(F.col("level") == "observed") / n, 1).alias("observed_pct"),
    )


def coverage_overall(matrix: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return matrix.agg(
        F.count_distinct("table_name").alias("tables"), n.alias("columns"),
        F.coalesce(F.round(100.0 * F.try_divide(F.count_if(F.col("level") == "tested"), n), 1), F.lit(0.0)).alias("tested_pct"),
        F.coalesce(F.round(100.0 * F.try_divide(F.count_if(F.col("level") == "observed"), n), 1), F.lit(0.0)).alias("observed_pct"),
    )
