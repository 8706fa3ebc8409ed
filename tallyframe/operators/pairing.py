"""Many files against many files: pairing by tokens or likeness, and one joint comparison."""

from __future__ import annotations

import difflib
import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.reconcile import Comparison, CompareOptions
from tallyframe.session import materialise
from tallyframe.sources.readers import FEW_FILES, FORMATS, read_files, typed, unreadable_files

PAIR_KEY = "__pair__"
SIGNALS = ("filename_tokens", "column_signature", "row_count_ratio")


def pair_by_tokens(source: DataFrame, target: DataFrame, match_on: Sequence[str]) -> DataFrame:
    """Groups of files with equal tokens: ``pair, status, source_files, target_files``.

    Without tokens to match on, all files of a side are one group.
    """

    def grouped(files: DataFrame, name: str) -> DataFrame:
        values = [F.try_element_at("tokens", F.lit(t)) for t in match_on]
        for token, value in zip(match_on, values):
            absent = files.where(value.isNull()).select("file_name").first()
            if absent is not None:
                raise ValueError(f"file '{absent['file_name']}' has no token '{token}'")
        pair = F.to_json(F.map_from_arrays(
            F.array(*[F.lit(t) for t in match_on]), F.array(*values)
        )) if match_on else F.lit("{}")
        entry = F.array_sort(F.collect_list(F.struct("file_name", "path")))
        return files.groupBy(pair.alias("pair")).agg(entry.alias(name))

    joined = grouped(source, "source_files").join(grouped(target, "target_files"), "pair", "full_outer")
    status = (
        F.when(F.col("target_files").isNull(), "unmatched_source")
        .when(F.col("source_files").isNull(), "unmatched_target").otherwise("paired")
    )
    return joined.withColumn("status", status)


@F.pandas_udf(T.DoubleType())
def _stem_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two file names without their last extension."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def likeness(source: DataFrame, target: DataFrame, threshold: float = 0.7,
             signals: Sequence[str] = SIGNALS) -> DataFrame:
    """Scored pairs of described files (``path, file_name, columns, rows``) at or above ``threshold``.

    Only pairs that can reach the threshold meet, by equality joins. A signal is
    at most one, so each must reach ``floor`` for the mean to do so; where that
    bound says nothing, at least one signal must reach the threshold itself. A
    pair without any likeness is never scored, so the threshold must be positive.
    """
    unknown = [s for s in signals if s not in SIGNALS]
    if unknown or not signals:
        raise ValueError(f"unknown similarity signals: {unknown}")
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    floor = len(signals) * threshold - (len(signals) - 1)
    if floor > 0:
        useful = [s for s in signals if s != "filename_tokens"] or ["filename_tokens"]
        met = _candidates(source, target, {s: floor for s in useful})
    else:
        met = reduce(DataFrame.unionByName, [_candidates(source, target, {s: threshold}) for s in signals])
    pairs = met.dropDuplicates(["s_path", "t_path"])
    rows_s, rows_t = F.col("s_rows"), F.col("t_rows")
    union = F.size(F.array_union("s_columns", "t_columns"))
    pairs = pairs.withColumn(
        "row_count_ratio",
        F.when((rows_s == 0) & (rows_t == 0), 1.0).otherwise(F.least(rows_s, rows_t) / F.greatest(rows_s, rows_t)),
    ).withColumn(
        "column_signature",
        F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("s_columns", "t_columns")) / union),
    )
    # The cheap signals are settled before any name is compared in Python.
    cheap = [F.col(s) for s in signals if s != "filename_tokens"]
    best = reduce(lambda a, b: a + b, cheap, F.lit(float("filename_tokens" in signals))) / float(len(signals))
    scored = pairs.where(best >= threshold - 1e-12).withColumn(
        "filename_tokens", _stem_likeness(_stem(F.col("s_file_name")), _stem(F.col("t_file_name")))
    )
    score = reduce(lambda a, b: a + b, [F.col(n) for n in signals]) / F.lit(float(len(signals)))
    kept = scored.withColumn("score", score).where(F.col("score") >= threshold)
    return kept.select(
        F.col("s_path").alias("source_path"), F.col("s_file_name").alias("source_file"),
        F.col("t_path").alias("target_path"), F.col("t_file_name").alias("target_file"), "score", *SIGNALS,
    )


def _candidates(source: DataFrame, target: DataFrame, least: dict[str, float]) -> DataFrame:
    """Pairs that may reach all the given least values, as equality joins on block columns."""
    if "row_count_ratio" in least:
        bound = least["row_count_ratio"]
        width = math.log(1.0 / bound) + 1e-9 if bound < 1 else 1e-9
        place = F.when(F.col("rows") == 0, F.lit(-9)).otherwise(F.floor(F.log(F.col("rows").cast("double")) / width))
        near = F.when(F.col("rows") == 0, F.array(F.lit(-9).cast("bigint"))).otherwise(F.array(place - 1, place, place + 1))
        source = source.withColumn("block_rows", place)
        target = target.withColumn("block_rows", F.explode(near))
    if "column_signature" in least:
        source, target = _by_rare_column(source, target, least["column_signature"])
    if "filename_tokens" in least:
        chars = F.filter(F.array_distinct(F.split(_stem(F.col("file_name")), "")), lambda ch: ch != "")
        source = source.withColumn("block_char", F.explode(chars))
        target = target.withColumn("block_char", F.explode(chars))
    blocks = [c for c in source.columns if c.startswith("block_")]
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns])
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns])
    on = reduce(lambda a, b: a & b, [F.col(f"s_{c}") == F.col(f"t_{c}") for c in blocks])
    plain = ["path", "file_name", "columns", "rows"]
    return s.join(t, on).select(*[f"{side}_{c}" for side in "st" for c in plain])


def _by_rare_column(source: DataFrame, target: DataFrame, bound: float) -> tuple[DataFrame, DataFrame]:
    """With a file's columns sorted from rare to common, files of enough overlap share
    one of the first ``n - ceil(bound * n) + 1``; the common ones make no blocks."""
    both = source.select("path", "columns").unionByName(target.select("path", "columns"))
    frequency = both.distinct().select(F.explode("columns").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("f"))

    def headed(files: DataFrame) -> DataFrame:
        wanted = files.select("path", "columns").distinct()
        ranked = wanted.select("path", F.explode(F.array_distinct("columns")).alias("c")).join(frequency, "c").groupBy("path").agg(
            F.array_sort(F.collect_list(F.struct("f", "c"))).alias("ranked")
        )
        n = F.size("ranked")
        keep = F.greatest(n - F.ceil(F.lit(bound - 1e-12) * n) + 1, F.lit(1)).cast("int")
        heads = ranked.select("path", F.explode(F.slice("ranked", F.lit(1), keep)).alias("r"))
        bare = wanted.where(F.size("columns") == 0).select("path", F.lit("").alias("block_column"))
        return files.join(heads.select("path", F.col("r.c").alias("block_column")).unionByName(bare), "path")

    return headed(source), headed(target)


def pair_by_likeness(source: DataFrame, target: DataFrame, threshold: float = 0.7,
                     signals: Sequence[str] = SIGNALS) -> DataFrame:
    """One-to-one pairs, best score first and ties by name.

    A pair that is the best one left for both of its files is the pair a walk
    down the sorted list would take, so all such pairs are taken at once, round
    by round.
    """
    left = materialise(likeness(source, target, threshold, signals), "likeness")
    taken: DataFrame | None = None
    while True:
        order = F.struct(-F.col("score"), F.col("source_file"), F.col("target_file"), F.col("source_path"), F.col("target_path"))
        ranked = left.withColumn("o", order)
        by_source = ranked.groupBy("source_path").agg(F.min("o").alias("bs"))
        by_target = ranked.groupBy("target_path").agg(F.min("o").alias("bt"))
        best = ranked.join(by_source, "source_path").join(by_target, "target_path").where(
            (F.col("o") == F.col("bs")) & (F.col("o") == F.col("bt"))
        ).select(*left.columns)
        best = materialise(best, "pairs")
        if best.isEmpty():
            return taken if taken is not None else best
        taken = best if taken is None else taken.unionByName(best)
        left = materialise(
            left.join(best.select("source_path"), "source_path", "left_anti")
            .join(best.select("target_path"), "target_path", "left_anti").select(*left.columns),
            "likeness",
        )


def unmatched(files: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    return files.join(pairs.select(F.col(f"{side}_path").alias("path")), "path", "left_anti")


def _side_files(mapping: DataFrame, side: str) -> DataFrame:
    return mapping.where("status = 'paired'").select(
        F.col("pair").alias(PAIR_KEY), F.explode(f"{side}_files").alias("f")
    ).select(PAIR_KEY, F.col("f.path").alias("__path"))


def _format_of(path: Column, fmt: str | None) -> Column:
    """The format of a file by its extension, unless one is given for all."""
    if fmt is not None:
        return F.lit(fmt)
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1)))


def with_errors(spark: SparkSession, mapping: DataFrame, fmt: str | None = None) -> DataFrame:
    """Add ``error``: why a pair cannot be compared, null for pairs whose files can all be read.

    Files are looked into before the joint plan, all of one format at a time, so
    one bad file spoils its own pair only.
    """
    files = _side_files(mapping, "source").unionByName(_side_files(mapping, "target"))
    files = materialise(files.withColumn("fmt", _format_of(F.col("__path"), fmt)), "pair-files")
    unknown = F.col("fmt").isNull()
    problems = files.where(unknown).select("__path", F.lit("format cannot be paired").alias("problem"))
    for kind in [r["fmt"] for r in files.where(~unknown).select("fmt").distinct().collect()]:
        paths = [r["__path"] for r in files.where(F.col("fmt") == kind).select("__path").distinct().collect()]
        found = unreadable_files(spark, paths, kind)
        problems = problems.unionByName(found.select(F.col("file").alias("__path"), "problem"))
    bad = files.join(problems, "__path").groupBy(F.col(PAIR_KEY).alias("pair")).agg(
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(": ", F.element_at(F.split("__path", "/"), -1), "problem"))), "; ")
        .alias("error")
    )
    return materialise(mapping.join(bad, "pair", "left"), "pair-mapping")


def pair_rows(spark: SparkSession, mapping: DataFrame, side: str, fmt: str | None = None) -> DataFrame:
    """All rows of one side of the paired files, each with its pair; one read for each format."""
    if "error" in mapping.columns:
        mapping = mapping.where("error is null")
    places = materialise(
        _side_files(mapping, side).withColumn("fmt", _format_of(F.col("__path"), fmt)), "pair-places"
    )
    # One row per file: a few are broadcast, so that the rows of a large file do not meet in one task.
    small = places.count() <= FEW_FILES
    parts = []
    for kind in sorted(r["fmt"] for r in places.select("fmt").distinct().collect()):
        own = places.where(F.col("fmt") == kind).drop("fmt")
        paths = [r["__path"] for r in own.select("__path").distinct().collect()]
        rows = read_files(spark, paths, kind, path_column="__path")
        if kind == "xml":  # text like that of delimited files
            rows = typed(rows, ("__path",))
        parts.append(rows.join(F.broadcast(own) if small else own, "__path").drop("__path"))
    if not parts:
        return spark.createDataFrame([], f"{PAIR_KEY} string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def compare_pairs(source: DataFrame, target: DataFrame, options: CompareOptions) -> Comparison:
    """All pairs in one comparison, the pair being the first key."""
    keys = [PAIR_KEY, *options.key_columns]
    return Comparison(source, target, CompareOptions(**{**options.__dict__, "key_columns": keys}))


def pair_results(comparison: Comparison, mapping: DataFrame) -> DataFrame:
    """One result per pair; a pair whose files hold no rows passes, one with an error is an ERROR."""
    names = lambda c: F.transform(c, lambda x: x["file_name"])
    error = F.col("error") if "error" in mapping.columns else F.lit(None).cast("string")
    paired = mapping.where("status = 'paired'").select(
        F.col("pair").alias(PAIR_KEY), names(F.col("source_files")).alias("source_files"),
        names(F.col("target_files")).alias("target_files"), error.isNotNull().alias("__bad"),
    )
    found = comparison.summary_by(PAIR_KEY)
    counts = [c for c in found.columns if c.endswith("_count")]
    settled = paired.join(found, PAIR_KEY, "left").na.fill(0, counts).na.fill({"status": "PASSED"})
    return settled.withColumn("status", F.when(F.col("__bad"), "ERROR").otherwise(F.col("status"))).drop("__bad")


def rolled_up(results: DataFrame) -> DataFrame:
    """The one result of a multi-file comparison; errors before failures."""
    counts = [c for c in results.columns if c.endswith("_count")]
    passed, errored = F.count_if(F.col("status") == "PASSED"), F.count_if(F.col("status") == "ERROR")
    total = F.count(F.lit(1))
    return results.agg(
        total.alias("pairs_total"), passed.alias("pairs_passed"), (total - passed - errored).alias("pairs_failed"),
        errored.alias("pairs_errored"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
        F.when(errored > 0, "ERROR").when(passed == total, "PASSED").otherwise("FAILED").alias("status"),
    )
