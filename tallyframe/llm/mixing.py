"""Mix sources to target weights by entropy balancing.

Each document d gets the rate ``min(cap, exp(lambda_s * z_d))`` with z its size
over the mean size of its source s: the exponential tilt of equal rates that
meets the source's token target and differs least from them. One Newton step
for all sources is one aggregate over (source, size) counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.ranks import with_row_number
from tallyframe.llm.common import word_count
from tallyframe.session import materialise

CAP = 3  # no document and no source exceeds so many times its size
STEPS = 40
# Exact sums: terms are rounded to this many parts of a word before they are added.
PARTS = 1 << 20
CELL = 50_000  # documents in one cell of the ranking


def _sources(sized: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Rank, weight and size of every source."""
    sums = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    ).withColumn("nameless", F.col("source").isNull())
    sums = materialise(sums, "mix-sources")
    ranked = with_row_number(sums.select("nameless", "source"), ["nameless", "source"], "rank")
    place = (F.col("rank") - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    return materialise(
        sums.join(ranked, sums.source.eqNullSafe(ranked.source)).select(
            sums.source, "source_size", "n_docs", F.col("rank").alias("source_no"), weight.alias("weight")
        ),
        "mix-weights",
    )


def _targets(sources: DataFrame, cap: int) -> DataFrame:
    """Shares of all sizes by weight; what exceeds the cap goes to the others until none is above.

    Each round fixes the sources above their cap and raises the level of the
    rest: one row goes to the driver a round, and every round but the last
    fixes a source.
    """
    level = None
    while True:
        stopped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap * F.col("source_size")
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(stopped, cap * F.col("source_size")).otherwise(0)).alias("fixed"),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["all"] or not row["open"]:
            break
        higher = (row["all"] - row["fixed"]) / row["open"]
        if level is not None and higher <= level:
            break
        level = higher
    raised = F.col("weight") * F.lit(float(level or 0.0))
    return sources.withColumn("target", F.least(raised, F.col("source_size") * F.lit(float(cap))))


def _tilts(bins: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """lambda of every source by Newton's method, kept inside a shrinking bracket."""
    state = sources.select(
        "source_no", "source_size", "n_docs", "target",
        F.lit(0.0).alias("tilt"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"), F.lit(1.0).alias("gap"),
    )
    for step in range(STEPS):
        state = materialise(state, "mix-tilts")
        # One small row; the state itself stays in tables.
        if step and not state.where(F.col("gap") > 1e-9).limit(1).count():
            break
        z = F.col("size") * F.col("n_docs") / F.col("source_size")
        rate = F.least(F.exp(F.col("tilt") * z), F.lit(float(cap)))
        tokens = F.col("n") * F.col("size") * rate
        slope = F.when(rate < cap, tokens * z).otherwise(F.lit(0.0))

        def exact(value):
            return (F.sum(F.round(value * PARTS).cast("decimal(38,0)")).cast("double") / PARTS)

        sums = (
            bins.join(state.where("source_size > 0"), "source_no").groupBy("source_no")
            .agg(exact(tokens).alias("tokens"), exact(slope).alias("slope"))
        )
        over = F.col("tokens") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("tilt"))
        high = F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - (F.col("tokens") - F.col("target")) / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        state = state.join(sums, "source_no", "left").select(
            "source_no", "source_size", "n_docs", "target",
            F.when(F.col("tokens").isNull() | (F.col("gap") <= 1e-9), F.col("tilt"))
            .when(inside, newton).otherwise((low + high) / 2).alias("tilt"),
            low.alias("low"), high.alias("high"),
            F.when(F.col("tokens").isNull(), F.lit(0.0))
            .otherwise(F.abs(F.col("tokens") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)))
            .alias("gap"),
        )
    return state


def _copies(key: tuple, groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole copies for the (source, size) bins of one source, largest sizes first.

    The error left by one bin goes into the next, so the source misses its
    target by no more than half its smallest size while bins can still move.
    Input is one row for each distinct size.
    """
    bins = pd.concat(groups).sort_values("size", ascending=False)
    left, counts = 0.0, []
    for size, n, rate, cap in zip(bins["size"], bins["n"], bins["rate"], bins["cap"]):
        exact = n * rate
        if size <= 0:
            counts.append(int(n))
            continue
        count = min(max(int(exact + left / size + 0.5), 0), int(cap * n))
        left += (exact - count) * size
        counts.append(count)
    bins["copies"] = counts
    yield bins[["source_no", "size", "n", "copies"]]


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """Target and taken words of every row of ``docs`` (doc_id, text, source).

    Sources are ranked by code point with null last and weigh ``weights`` in
    turn. ``taken`` is a whole number of copies of the document. The sums behind
    the rates are exact and ties are broken by a hash of doc_id and the row's
    size, so reruns agree; rows that repeat a doc_id are rows of their own, and
    equal ones may change places. A null text has size 0 and target words are
    spread over the others; a null source is a source. If all texts are empty,
    targets and taken words are 0. Other columns are not read.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    # Read twice more below: the counted sizes are kept, not the texts.
    sized = materialise(sized, "mix-sizes")
    sources = _targets(_sources(sized, weights), cap)
    sources = materialise(sources, "mix-targets")
    known = sources.select(F.col("source").alias("name"), "source_no", "source_size", "target")
    placed = sized.join(known, sized.source.eqNullSafe(known.name)).drop("name", "source")
    bins = materialise(placed.groupBy("source_no", "size").agg(F.count(F.lit(1)).alias("n")), "mix-bins")
    tilts = _tilts(bins, sources, cap)
    z = F.col("size") * F.col("n_docs") / F.col("source_size")
    rated = bins.join(tilts, "source_no").select(
        "source_no", "size", "n", F.lit(cap).alias("cap"),
        F.when(F.col("source_size") > 0, F.least(F.exp(F.round("tilt", 9) * z), F.lit(float(cap))))
        .otherwise(F.lit(1.0)).alias("rate"),
    )
    copies = materialise(
        rated.groupBy("source_no").applyInPandas(_copies, "source_no bigint, size bigint, n bigint, copies bigint"),
        "mix-copies",
    )
    # copies div n for each document of a bin, one more for the first ones of a hash order. The order is
    # taken inside cells of bounded size, as one bin may hold a third of all documents.
    dealt = placed.join(copies, ["source_no", "size"]).withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.ceil(F.col("n") / CELL).cast("bigint"))
    )
    spread = dealt.withColumn("extra", F.col("copies") % F.col("n"))
    exact = spread.where("extra = 0").withColumn("more", F.lit(0))
    some = spread.where("extra > 0")
    cells = some.groupBy("source_no", "size", "cell").agg(F.count(F.lit(1)).alias("in_cell"))
    earlier = Window.partitionBy("source_no", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(
        "source_no", "size", "cell", F.coalesce(F.sum("in_cell").over(earlier), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("source_no", "size", "cell").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = some.withColumn("at", F.row_number().over(inside)).join(starts, ["source_no", "size", "cell"])
    ranked = ranked.withColumn("more", (F.col("at") + F.col("start") <= F.col("extra")).cast("int"))
    columns = ["doc_id", "size", "source_size", "target", "copies", "n", "more"]
    return exact.select(*columns).unionByName(ranked.select(*columns)).select(
        "doc_id", "size", "source_size", "target",
        ((F.floor(F.col("copies") / F.col("n")) + F.col("more")) * F.col("size")).cast("bigint").alias("taken"),
    )
