"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import words_of

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du en est et la le les par pas pour que qui sur un une "
    "das dem den der die ein eine im ist mit nicht sich und von zu auf für "
    "como con del el ella las los más no para por se su una y lo"
).split()


@dataclass(frozen=True)
class Threshold:
    """A document passes while ``low <= measure <= high``; a missing bound does not bind.

    The rule is silent on texts of fewer than ``min_words`` words, where the ratio says little.
    """

    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


# Ratios of words, lines and characters of prose; junk of symbols, capitals, menus and stutter falls outside.
THRESHOLDS = (
    Threshold("mean_word_chars", 2.0, 14.0),
    Threshold("symbol_ratio", None, 0.1),
    Threshold("bang_ratio", None, 0.2),
    Threshold("capital_ratio", None, 0.5),
    Threshold("stop_ratio", 0.06, None, min_words=50),
    Threshold("dup_line_ratio", None, 0.34),
)


def measured(docs: DataFrame) -> DataFrame:
    """Counts per document: the base columns and those that the ratios need."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    parts = text.select(
        "doc_id", "t", words_of(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    # One hash for each window of five words; equal windows have equal hashes. The words are bound once, so that
    # no plan can split a text again for each window.
    def hashed(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])
        )

    windows = parts.select(
        "*",
        F.when(F.size("w") >= 5, F.transform(F.array("w"), hashed)[0])
        .otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    return windows.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        _without("t", r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0)).otherwise(_covered("h"))
        .cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        _without("t", "[A-Z]").alias("n_capitals"),
        _without("t", "[a-z]").alias("n_small"),
        _without("t", "!").alias("n_bangs"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
    )


def _without(column: str, pattern: str) -> Column:
    return (F.length(column) - F.length(F.regexp_replace(column, pattern, ""))).cast("bigint")


def _covered(hashes: str) -> Column:
    """Words inside windows whose hash occurs twice or more: the union of [i, i + 5)."""
    at = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def starts(s: Column) -> Column:
        def same(k: Column, other: Column) -> Column:
            return F.coalesce(F.get(s, other)["x"] == F.get(s, k)["x"], F.lit(False))

        hits = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1)
        )
        return F.array_sort(F.transform(hits, lambda k: F.get(s, k)["i"]))

    found = F.transform(F.array(at), starts)[0]
    return F.aggregate(
        found,
        F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def ratios() -> dict[str, Column]:
    """Every measure that a threshold may name; a ratio without a denominator is 0."""
    def share(top: str, bottom: Column) -> Column:
        return F.when(bottom > 0, F.col(top) / bottom).otherwise(F.lit(0.0))

    words = F.col("n_words")
    return {
        "n_words": words.cast("double"),
        "mean_word_chars": share("word_chars", words),
        "symbol_ratio": share("n_symbols", words),
        "bang_ratio": share("n_bangs", words),
        "stop_ratio": share("n_stop_words", words),
        "capital_ratio": share("n_capitals", F.col("n_capitals") + F.col("n_small")),
        "dup_line_ratio": share("n_dup_lines", F.col("n_lines")),
        "repeat_ratio": share("n_repeat_words", words),
    }


def verdict(thresholds: Sequence[Threshold] = THRESHOLDS) -> Column:
    """The table compiled into one boolean expression."""
    named = ratios()
    passed = F.lit(True)
    for rule in thresholds:
        value, silent = named[rule.measure], F.col("n_words") < rule.min_words
        if rule.low is not None:
            passed = passed & (silent | (value >= F.lit(float(rule.low))))
        if rule.high is not None:
            passed = passed & (silent | (value <= F.lit(float(rule.high))))
    return passed


def quality(docs: DataFrame, thresholds: Sequence[Threshold] = THRESHOLDS) -> DataFrame:
    """Counts, base verdict and final verdict of every row of ``docs`` (doc_id, text).

    One projection over the scan: no shuffle, no user function. Rows are judged
    one by one, so repeated rows and ids give as many results. A null or empty
    text has no words and fails; a null doc_id stays null; other columns of
    ``docs`` are not read, whatever their names; no rows give no rows.
    """
    counts = measured(docs)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & verdict(thresholds)).alias("kept"),
        "n_lines", "n_stop_words", "n_capitals", "n_small", "n_bangs",
    )


def keep_good(docs: DataFrame, thresholds: Sequence[Threshold] = THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    # The whole row travels as one struct, so no column of docs can clash with a count.
    rows = docs.select(F.col("text"), F.struct(F.struct(*docs.columns).alias("row")).alias("doc_id"))
    # A row number is no function of the row, so the filter stays above the measures and does not repeat them.
    judged = quality(rows, thresholds).withColumn("at", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("at") >= 0)).select("doc_id.row.*")
