"""Running totals, row numbers and exact percentiles over a global order.

A window without ``partitionBy`` sends every row to one task. Here the order is
made by a range shuffle, written once, and continued across its partitions with
one small offset per partition.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import materialise

ROWS_PER_BLOCK = 65_536
ROWS_PER_RANGE = 1_000_000
FEW_ROWS = 20_000


def running_total(
    df: DataFrame,
    order: Sequence[Column],
    weight: str,
    total: str = "running_total",
    total_type: str = "decimal(38,0)",
) -> DataFrame:
    """Add the inclusive running sum of ``weight`` in the given global order.

    Rows that are equal under ``order`` come in the order of a hash of all their
    columns.
    """
    # The rows are counted first, so that a range is of bounded size at any scale. Ties of the order, even equal
    # rows, are broken by a hash and a number, so one value cannot fill a range.
    columns = [F.col(f"`{c}`") for c in df.columns]
    numbered = materialise(
        df.select("*", F.xxhash64(*columns).alias("__tie"), F.monotonically_increasing_id().alias("__id")), "unranged"
    )
    rows = numbered.count()
    wide = min(df.sparkSession.sparkContext.defaultParallelism, rows // FEW_ROWS)
    total_order = [*order, F.col("__tie"), F.col("__id")]
    ranged = materialise(
        numbered.repartitionByRange(max(1, wide, -(-rows // ROWS_PER_RANGE)), *total_order)
        .withColumn("__part", F.spark_partition_id()),
        "ranged",
    )
    per_part = ranged.groupBy("__part").agg(F.sum(F.col(weight).cast(total_type)).alias("__sum"))
    # One row per shuffle partition, so this ordered window is of bounded size.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).cast(total_type).alias("__offset")
    )
    inside = (
        Window.partitionBy("__part").orderBy(*total_order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        ranged.withColumn("__inside", F.sum(F.col(weight).cast(total_type)).over(inside))
        .join(F.broadcast(offsets), "__part")
        .withColumn(total, (F.col("__inside") + F.col("__offset")).cast(total_type))
        .drop("__part", "__inside", "__offset", "__tie", "__id")
    )


def with_row_number(df: DataFrame, order: Sequence[str], name: str = "__row__") -> DataFrame:
    """Number the rows 1..n after a nulls-first sort on ``order``.

    Equal rows are counted first and spread out again afterwards in blocks, so
    neither the sort nor the expansion meets a hot group. Columns outside
    ``order`` are not kept. Spark takes the expanded rows to be as few as the
    groups they come from, so a hint keeps joins from broadcasting them.
    """
    keys = [F.col(f"`{c}`") for c in order]
    counted = df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    ends = running_total(
        counted, [k.asc_nulls_first() for k in keys], "__n", "__end", "bigint"
    )
    start = F.col("__end") - F.col("__n")
    first_block = F.floor(start / F.lit(ROWS_PER_BLOCK)).cast("bigint")
    last_block = F.floor((F.col("__end") - 1) / F.lit(ROWS_PER_BLOCK)).cast("bigint")
    # A given number of tasks, as few groups would else be expanded in one.
    blocks = ends.withColumn("__start", start).withColumn(
        "__block", F.explode(F.sequence(first_block, last_block))
    ).repartition(df.sparkSession.sparkContext.defaultParallelism, "__block")
    low = F.greatest(F.col("__start"), F.col("__block") * ROWS_PER_BLOCK)
    high = F.least(F.col("__end"), (F.col("__block") + 1) * ROWS_PER_BLOCK) - 1
    return blocks.select(F.explode(F.sequence(low + 1, high + 1)).alias(name), *keys).hint("merge")


def in_blocks(df: DataFrame, order: Sequence[str], before: int) -> DataFrame:
    """Number the rows in a total order and lay them out in overlapping blocks.

    Adds ``r`` (row number), ``block`` and ``home``. Each block also holds the
    ``before`` rows ahead of it, so a window over that many preceding rows can be
    partitioned by block; keep the rows with ``block = home`` afterwards.
    """
    rows = df.withColumn("__one", F.lit(1))
    numbered = running_total(rows, [F.col(f"`{c}`").asc_nulls_first() for c in order], "__one", "r", "bigint")
    size = max(ROWS_PER_BLOCK, 4 * before)
    home = F.floor((F.col("r") - 1) / size)
    homes = F.when((F.col("r") - 1) % size >= size - before, F.array(home, home + 1)).otherwise(F.array(home))
    return numbered.drop("__one").withColumn("home", home).withColumn("block", F.explode(homes))


def with_previous(df: DataFrame, partition: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Add ``previous_<column>`` from the row before, within ``partition``; any partition size."""
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in partition], "block").orderBy("r")
    laid = in_blocks(df, [*partition, *order], 1)
    for c in columns:
        laid = laid.withColumn(f"previous_{c}", F.lag(F.col(f"`{c}`")).over(w))
    return laid.where("block = home").drop("r", "block", "home")


def exact_percentiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], accuracy: int = 10_000,
    rows_per_bracket: int = 2_000_000, interpolate: bool = True,
) -> dict[str, dict[float, float | None]]:
    """Exact linearly interpolated percentiles of numeric columns.

    The mergeable sketch behind ``percentile_approx`` brackets every percentile;
    while a bracket may still hold too many rows it is sketched again from the
    inside. The last pass counts what lies below each bracket and the distinct
    values within it, so only narrow brackets are shuffled. A bracket that turns
    out not to hold its rank (the sketch bounds its error, but not for every
    merge tree) is settled by a full running total. Without ``interpolate`` the
    value at the lower rank is returned.
    """
    cols = list(wanted)
    result: dict[str, dict[float, float | None]] = {c: {q: None for q in wanted[c]} for c in cols}
    if not cols:
        return result
    slack = 4.0 / accuracy
    probes = [
        p for q in sorted({q for qs in wanted.values() for q in qs})
        for p in (max(q - slack, 0.0), min(q + slack, 1.0))
    ]
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        aggs.append(F.count(x).alias(f"n{i}"))
        aggs.append(
            F.percentile_approx(x, F.array(*[F.lit(p) for p in probes]), F.lit(accuracy)).alias(f"p{i}")
        )
    first = df.agg(*aggs).first()
    brackets = []
    for i, c in enumerate(cols):
        n = first[f"n{i}"]
        if not n:
            continue
        bounds = dict(zip(probes, first[f"p{i}"]))
        for j, q in enumerate(wanted[c]):
            target = (n - 1) * q
            low, high = bounds[max(q - slack, 0.0)], bounds[min(q + slack, 1.0)]
            brackets.append((i, j, low, high, math.floor(target), math.ceil(target)))
    if not brackets:
        return result
    tall = df.select(
        F.inline(
            F.array(*[
                F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("v"))
                for i, c in enumerate(cols)
            ])
        )
    ).where("v is not null")
    inside = 2 * slack * max(first[f"n{i}"] for i in range(len(cols)))
    while inside > rows_per_bracket:
        brackets = _narrowed(tall, brackets, slack, accuracy)
        inside *= 2 * slack
    found = _picked(tall, brackets)
    for i, j, _, _, lo_rank, hi_rank in brackets:
        c, q = cols[i], wanted[cols[i]][j]
        low, high = found.get((i, j, lo_rank)), found.get((i, j, hi_rank))
        if low is None or high is None:
            low, high = _ranks_by_total(df, c, lo_rank, hi_rank)
        target = (first[f"n{i}"] - 1) * q
        result[c][q] = low + (high - low) * (target - lo_rank) if interpolate else low
    return result


def _bracket_table(df: DataFrame, brackets: list[tuple]) -> DataFrame:
    """One row per column and percentile, small enough to broadcast whatever the data."""
    table = df.sparkSession.createDataFrame(
        brackets, "bi int, j int, low double, high double, lo_rank bigint, hi_rank bigint"
    )
    return F.broadcast(table)


def _narrowed(tall: DataFrame, brackets: list[tuple], slack: float, accuracy: int) -> list[tuple]:
    joined = tall.join(_bracket_table(tall, brackets), (F.col("i") == F.col("bi")) & (F.col("v") <= F.col("high")))
    counts = {
        (r["i"], r["j"]): (r["below"], r["within"])
        for r in joined.groupBy("i", "j").agg(
            F.count_if(F.col("v") < F.col("low")).alias("below"),
            F.count_if(F.col("v") >= F.col("low")).alias("within"),
        ).collect()
    }
    aggs = []
    for i, j, _, _, lo_rank, hi_rank in brackets:
        below, within = counts[(i, j)]
        ends = (
            min(max((lo_rank - below) / within - slack, 0.0), 1.0),
            min(max((hi_rank - below) / within + slack, 0.0), 1.0),
        )
        here = (F.col("i") == i) & (F.col("j") == j) & (F.col("v") >= F.col("low"))
        aggs.append(
            F.percentile_approx(
                F.when(here, F.col("v")), F.array(*[F.lit(e) for e in ends]), F.lit(accuracy)
            ).alias(f"p_{i}_{j}")
        )
    row = joined.agg(*aggs).first()
    return [(i, j, *row[f"p_{i}_{j}"], lo_rank, hi_rank) for i, j, _, _, lo_rank, hi_rank in brackets]


def _picked(tall: DataFrame, brackets: list[tuple]) -> dict[tuple[int, int, int], float]:
    # Rows below a bracket collapse into one NULL-valued group while still in the map task.
    counted = (
        tall.join(_bracket_table(tall, brackets), (F.col("i") == F.col("bi")) & (F.col("v") <= F.col("high")))
        .groupBy("i", "j", "lo_rank", "hi_rank", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("i", "j").orderBy(F.col("v").asc_nulls_first()))
    ranked = counted.withColumn("upto", upto)

    def holds(rank: str) -> Column:
        return (F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("n") <= F.col(rank))

    # At most two rows per column and percentile.
    rows = ranked.where(F.col("v").isNotNull() & (holds("lo_rank") | holds("hi_rank"))).collect()
    out = {}
    for r in rows:
        for rank in (r["lo_rank"], r["hi_rank"]):
            if r["upto"] - r["n"] <= rank < r["upto"]:
                out[(r["i"], r["j"], rank)] = r["v"]
    return out


def _ranks_by_total(df: DataFrame, column: str, low: int, high: int) -> tuple[float, float]:
    counted = (
        df.select(F.col(f"`{column}`").cast("double").alias("v"))
        .where("v is not null")
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_total(counted, [F.col("v").asc()], "n", "upto", "bigint")

    def at(rank: int) -> Column:
        return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("v")))

    row = ranked.agg(at(low).alias("lo"), at(high).alias("hi")).first()
    return row["lo"], row["hi"]
