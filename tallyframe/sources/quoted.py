"""Delimited records that reach over line breaks inside quotes, put together in parallel.

A quote opens a field only where the field begins. So a line leaves the text
either inside a quoted field or outside, depending on where it began: of the two
answers of each line the running one follows from the last line whose answers
agree and the number of lines behind it that swap sides. That is worked out in
each block of a file, the blocks of a file are taken in order, and only the lines
of records with more than one line are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import materialise

_QUOTED = '"[^"]*+(?:""[^"]*+)*+"'


def _class(delimiters: str) -> str:
    return "".join(rf"\x{ord(d):02x}" for d in delimiters)


def field_count(value: Column, delimiter: str) -> Column:
    """Fields of a record: delimiters outside quoted fields, and one."""
    d = _class(delimiter)
    bare = F.when(value.contains('"'), F.regexp_replace(value, rf"(?:^|(?<=[{d}])){_QUOTED}", "q")).otherwise(value)
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1


def opens(value: Column, delimiters: str) -> Column:
    """Whether a line that begins outside quotes ends inside a quoted field."""
    d = _class(delimiters)
    # Possessive loops: no step is taken back, so a long line costs one walk. What is left is the last field.
    last = F.regexp_replace(value, rf'^(?:(?:{_QUOTED}|(?!"))[^{d}]*+[{d}])*+', "")
    return value.contains('"') & last.startswith('"') & ~last.rlike(f"^{_QUOTED}")


def joined_lines(lines: DataFrame, delimiters: str) -> DataFrame:
    """``value, file, start, line`` with the lines of a record joined by a line feed, placed where it begins.

    A file that ends inside quotes keeps its lines as they are. Lines come with
    their file, the start of their block and their place behind it.
    """
    # From inside, a line goes on as if a quote stood before it.
    ways = lines.withColumn("outside", opens(F.col("value"), delimiters)).withColumn(
        "inside", F.when(F.col("value").contains('"'), opens(F.concat(F.lit('"'), "value"), delimiters)).otherwise(True)
    )
    within = Window.partitionBy("file", "start").orderBy("line")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    ways = ways.withColumn("swaps", F.sum((F.col("outside") & ~F.col("inside")).cast("int")).over(so_far) % 2)
    # A line whose ends agree settles the state; swaps are counted from there.
    settled = F.when(F.col("outside") == F.col("inside"), F.col("outside").cast("int").bitwiseXOR(F.col("swaps")))
    ways = materialise(
        ways.withColumn("settled", F.last(settled, True).over(so_far)).drop("outside", "inside"), "quoted-lines"
    )

    def end(before: Column) -> Column:
        return F.coalesce("settled", before).bitwiseXOR(F.col("swaps")) == 1

    # One row for each block: its end for both starts, then the state at its start.
    blocks = ways.groupBy("file", "start").agg(F.max_by(F.struct("settled", "swaps"), "line").alias("b")).select(
        "file", "start", "b.settled", "b.swaps"
    )
    in_order = Window.partitionBy("file").orderBy("start")
    up_to = in_order.rowsBetween(Window.unboundedPreceding, 0)
    swapped = F.sum("swaps").over(up_to) % 2
    blocks = blocks.withColumn("all_swaps", swapped).withColumn(
        "known", F.last(F.when(F.col("settled").isNotNull(), F.col("settled").bitwiseXOR(F.col("swaps")).bitwiseXOR(F.col("all_swaps"))), True).over(up_to)
    )
    after = F.coalesce("known", F.lit(0)).bitwiseXOR(F.col("all_swaps"))
    blocks = blocks.withColumn("after", after).select(
        "file", "start", F.lag("after", 1, 0).over(in_order).alias("before"),
        (F.last("after").over(Window.partitionBy("file")) == 1).alias("cut_off"),
    )
    known = ways.join(materialise(blocks, "quoted-blocks"), ["file", "start"])
    marked = known.withColumn("ends_inside", end(F.col("before"))).withColumn(
        "begins_inside", F.lag("ends_inside").over(within)
    ).withColumn("begins_inside", ~F.col("cut_off") & F.coalesce("begins_inside", F.col("before") == 1)).withColumn(
        "ends_inside", ~F.col("cut_off") & F.col("ends_inside")
    )
    first = F.when(~F.col("begins_inside"), F.struct("start", "line"))
    marked = materialise(marked.select(
        "value", "file", "start", "line", "begins_inside", "ends_inside", F.last(first, True).over(so_far).alias("first"),
    ), "quoted-marks")
    # The last record begun in the blocks before a block.
    begun = marked.groupBy("file", "start").agg(F.max("first").alias("latest")).select(
        "file", "start", F.last("latest", True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier")
    )
    alone = ~F.col("begins_inside") & ~F.col("ends_inside")
    parts = marked.where(~alone).join(begun, ["file", "start"]).withColumn("first", F.coalesce("first", "earlier"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "line", "value"))), lambda p: p["value"]), "\n")
    records = parts.groupBy("file", "first").agg(text.alias("value")).select("value", "file", "first.start", "first.line")
    return marked.where(alone).select("value", "file", "start", "line").unionByName(records)
