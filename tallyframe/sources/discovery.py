"""Finding files: token patterns, listings, readiness, partitions and row counts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What the kinds of a `{name:kind}` token match.
TOKEN_KINDS = {
    "": r"[^_./\\]+", "num": r"\d+", "number": r"\d+", "alpha": "[A-Za-z]+", "alnum": "[A-Za-z0-9]+", "any": r"[^/\\]+",
}
DATE_DIGITS = {"%Y": 4, "%m": 2, "%d": 2, "%H": 2, "%M": 2, "%S": 2}
_NAME = re.compile(r"\{([A-Za-z_]\w*)(:|\})")


@dataclass(frozen=True)
class TokenPattern:
    """A file-name pattern as a regular expression, and the group number of each token."""

    regex: str
    groups: dict[str, int]

    def tokens(self, name: Column) -> Column:
        if not self.groups:
            return F.create_map().cast("map<string,string>")
        return F.create_map(*[
            x for token, i in self.groups.items()
            for x in (F.lit(token), F.regexp_extract(name, self.regex, i))
        ])


def _plain(text: str) -> str:
    return "".join({"*": ".*", "?": "."}.get(ch) or re.escape(ch) for ch in text)


def _kind(name: str, spec: str) -> str:
    if spec in TOKEN_KINDS:
        return TOKEN_KINDS[spec]
    if spec.startswith("regex(") and spec.endswith(")"):
        inner = spec[6:-1]
        try:
            re.compile(inner)
        except re.error as error:
            raise ValueError(f"token '{name}': invalid regex: {error}") from error
        if not inner or "(?P<" in inner:
            raise ValueError(f"token '{name}': regex must not be empty or name groups")
        return inner
    parts = re.split("(%[YmdHMS])", spec)
    return "".join(rf"\d{{{DATE_DIGITS[p]}}}" if p in DATE_DIGITS else re.escape(p) for p in parts)


def _close(pattern: str, start: int) -> int:
    """Where the token whose kind begins at ``start`` ends; braces may stand in its regex."""
    if not pattern.startswith("regex(", start):
        return pattern.find("}", start)
    ends = [m.start() + 1 for m in re.finditer(r"\)\}", pattern[start:])]
    for end in ends:  # the first closing that leaves a regex that compiles
        try:
            re.compile(pattern[start + 6:start + end - 1])
            return start + end
        except re.error:
            continue
    raise ValueError("token has an invalid regex")


def token_pattern(pattern: str) -> TokenPattern:
    """``{tok}``, ``{tok:%Y%m%d}``, ``{tok:num}``, ``{tok:regex(..)}``, ``*`` and ``?``."""
    out, groups, pos, number = [], {}, 0, 1
    while m := _NAME.search(pattern, pos):
        name, spec, end = m[1], "", m.end() - 1
        if m[2] == ":":
            end = _close(pattern, m.end())
            if end < 0:
                break
            spec = pattern[m.end():end]
        body = _kind(name, spec)
        if name in groups:
            raise ValueError(f"token '{name}' is given twice")
        groups[name] = number
        number += 1 + re.compile(body).groups
        out += [_plain(pattern[pos:m.start()]), f"({body})"]
        pos = end + 1
    out.append(_plain(pattern[pos:]))
    return TokenPattern("^" + "".join(out) + "$", groups)


def list_files(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """``path, file_name, length, modified``; file contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
    return listed.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("modified"),
    )


def discover(spark: SparkSession, root: str, pattern: str, side: str = "source") -> DataFrame:
    """Files right below ``root`` whose name matches, with their tokens."""
    compiled = token_pattern(pattern)
    files = list_files(spark, root).where(F.col("file_name").rlike(compiled.regex))
    return files.select(F.lit(side).alias("side"), "path", "file_name", compiled.tokens(F.col("file_name")).alias("tokens"))


def readiness(files: DataFrame, expected: int) -> DataFrame:
    """Whether at least ``expected`` files are there."""
    return files.agg(F.count(F.lit(1)).alias("found")).select(
        "found", F.lit(expected).alias("expected"), (F.col("found") >= expected).alias("ready")
    )


def partition_values(path: Column) -> Column:
    """The ``key=value`` folders of a path, in order."""
    parts = F.filter(F.split(path, "/"), lambda p: p.rlike("^[^=]+=") )
    return F.transform(
        parts, lambda p: F.struct(F.regexp_extract(p, "^([^=]+)=", 1).alias("column"), F.regexp_replace(p, "^[^=]+=", "").alias("value"))
    )


def file_row_counts(spark: SparkSession, root: str, fmt: str, recursive: bool = True) -> DataFrame:
    """Rows per file. Columnar formats answer from their footers."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if fmt == "csv":
        reader = reader.option("header", True)
    rows = reader.format(fmt).load(root)
    return rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("row_count"))


def discover_partitions(spark: SparkSession, root: str, fmt: str | None = None) -> DataFrame:
    """One row per leaf partition: its values, files and, with ``fmt``, rows."""
    files = list_files(spark, root, recursive=True).select(
        "path", partition_values(F.regexp_replace("path", "/[^/]*$", "")).alias("partition")
    ).where(F.size("partition") > 0)
    if fmt is None:
        return files.groupBy("partition").agg(F.count(F.lit(1)).alias("object_count"), F.lit(None).cast("bigint").alias("row_count"))
    joined = files.join(file_row_counts(spark, root, fmt), "path", "left")
    return joined.groupBy("partition").agg(
        F.count(F.lit(1)).alias("object_count"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count")
    )


def partition_check(partitions: DataFrame, expected_columns: Sequence[str] | None = None,
                    min_partitions: int | None = None) -> DataFrame:
    """Partition columns and count against what is expected; no rows when all is well."""
    row = partitions.agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(F.transform("partition", lambda p: p["column"]), F.size("partition")).alias("columns"),
    ).first()
    problems = []
    if expected_columns is not None and list(expected_columns) != list(row["columns"] or []):
        problems.append(("partition_columns", ",".join(expected_columns), ",".join(row["columns"] or []), "partition_columns_mismatch"))
    if min_partitions is not None and row["n"] < min_partitions:
        problems.append(("partition_count", str(min_partitions), str(row["n"]), "partition_count_below_min"))
    return partitions.sparkSession.createDataFrame(
        problems, "column_name string, source_value string, target_value string, mismatch_type string"
    )


def row_count_check(count: int, min_rows: int | None, max_rows: int | None) -> list[tuple[str, str, str, str]]:
    problems = []
    if min_rows is not None and count < min_rows:
        problems.append(("row_count", str(min_rows), str(count), "row_count_below_min"))
    if max_rows is not None and count > max_rows:
        problems.append(("row_count", str(max_rows), str(count), "row_count_above_max"))
    return problems


def describe_delimited(spark: SparkSession, files: DataFrame, sep: str = ",") -> DataFrame:
    """Add each file's ``columns`` and ``rows`` (lines below the header) from one scan of the lines."""
    paths = [r["path"] for r in files.select("path").collect()]
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    ).where(F.trim("value") != "")
    per_file = lines.groupBy("path").agg(
        (F.count(F.lit(1)) - 1).alias("rows"),
        F.min(F.when(F.col("start") == 0, F.struct("line", "value")))["value"].alias("header"),
    )
    columns = F.transform(F.split("header", re.escape(sep)), lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")))
    return files.join(per_file.select("path", "rows", columns.alias("columns")), "path")
