"""Log text as events and tool artifacts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Log levels in order of detection, and how an event line begins.
LEVELS = ("ERROR", "WARNING", "WARN", "INFO", "DEBUG")
TIMESTAMP_START = r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}"


def log_level(line: Column) -> Column:
    found = F.lit("")
    for level in reversed(LEVELS):
        hit = line.contains(f"| {level}") | line.startswith(level) | line.contains(f" {level} ")
        found = F.when(hit, level).otherwise(found)
    return found


EVENT_LINES = 10_000
TASKS_PER_READ = 8  # tasks that sort the lines which one task reads, 128 MB of text at most


def log_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, event, part, number, level, text``; continuation lines belong to the event above.

    ``event`` is the number of an event's first line in its file, the same in whatever blocks the file is
    read. An event of more than ``EVENT_LINES`` lines comes in parts of so many, all with its level;
    ``number`` is the first line of the part. ``event_heads`` has one row per event.

    Lines are numbered per file block, which is of bounded size, and one row per
    block carries the line and event counts on to the blocks behind it. Lines are
    dealt over as many tasks as their text asks for, so that none sorts more of
    them where there are more in all.
    """
    raw = spark.read.text(path)
    tasks = TASKS_PER_READ * raw.rdd.getNumPartitions()
    lines = raw.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
    ).repartition(tasks, "file", "start").withColumn("level", log_level(F.col("value")))
    begins = (F.col("level") != "") | F.col("value").rlike(TIMESTAMP_START)
    inside = Window.partitionBy("file", "start").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    local = lines.withColumn("begins", begins).withColumn("line", F.row_number().over(
        Window.partitionBy("file", "start").orderBy("id")
    )).withColumn("event", F.sum(F.col("begins").cast("int")).over(inside))
    blocks = local.groupBy("file", "start").agg(F.count(F.lit(1)).alias("lines"), F.max("event").alias("events"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        "file", "start", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"),
        F.coalesce(F.sum("events").over(before), F.lit(0)).alias("events_before"),
    )
    placed = local.join(carried, ["file", "start"]).select(
        "file", "value", "level", "begins", (F.col("line") + F.col("lines_before")).alias("number"),
        (F.col("event") + F.col("events_before")).alias("event"),
    ).repartition(tasks, "file", "event")
    # A log without event starts is one event: its text is cut into rows of a bounded number of lines.
    level = F.max(F.when(F.col("begins"), F.col("level")))
    events = placed.groupBy("file", "event").agg(
        F.min("number").alias("first"), F.coalesce(F.nullif(level, F.lit("")), F.lit("TRACE")).alias("event_level")
    )
    parts = placed.join(events, ["file", "event"]).withColumn(
        "part", F.floor((F.col("number") - F.col("first")) / EVENT_LINES)
    )
    ordered = F.array_sort(F.collect_list(F.struct("number", "value")))
    return parts.repartition(tasks, "file", "first", "part").groupBy("file", F.col("first").alias("event"), "part").agg(
        F.min("number").alias("number"), F.first("event_level").alias("level"),
        F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias("text"),
    )


def event_heads(events: DataFrame) -> DataFrame:
    """``file, event, level, lines, head`` per event: its length in lines and its first line."""
    lines = F.size(F.split("text", "\n"))
    return events.groupBy("file", "event").agg(
        F.first("level").alias("level"), F.sum(lines).cast("bigint").alias("lines"),
        F.min_by(F.substring_index("text", "\n", 1), F.col("part")).alias("head"),
    )


def _with_next_lines(events: DataFrame, count: int) -> DataFrame:
    """``body``: the text of a part with the first lines of the next one, for texts that lie across both."""
    if not count:
        return events.withColumn("body", F.col("text"))
    following = F.lead(F.substring_index("text", "\n", count)).over(Window.partitionBy("file", "event").orderBy("part"))
    return events.withColumn("body", F.concat_ws("\n", "text", following))


def filter_log_events(
    events: DataFrame, run_id: str = "", query: str = "", level: str = "", limit: int | None = 500, most: int = 5000
) -> DataFrame:
    """The last ``limit`` events that hold all given texts; WARN also finds WARNING.

    An event is found by all its parts together: each text may stand in a part of its own, or lie across
    two, and every part of a found event is returned. A limit above ``most`` is refused, None means all events.
    """
    if limit is not None and not 1 <= limit <= most:
        raise ValueError(f"a search shows 1 to {most} events")
    needles = [n for n in (run_id.lower().strip(), query.lower().strip()) if n]
    breaks = max((n.count("\n") for n in needles), default=0)
    if breaks >= EVENT_LINES:
        raise ValueError(f"a text to search for has less than {EVENT_LINES} line breaks")
    out = events
    wanted = level.upper().strip()
    if wanted:
        out = out.where(F.col("level").isin([wanted, "WARNING"] if wanted == "WARN" else [wanted]))
    newest = [F.col("file").desc(), F.col("event").desc()]
    if needles:
        body = F.lower("body")
        hits = {f"has_{k}": body.contains(F.lit(n)) for k, n in enumerate(needles)}
        marked = _with_next_lines(out, breaks).select("file", "event", *[c.alias(k) for k, c in hits.items()])
        some = F.lit(False)
        for k in hits:
            some = some | F.col(k)
        found = marked.where(some).groupBy("file", "event").agg(*[F.max(k).alias(k) for k in hits])
        for k in hits:
            found = found.where(F.col(k))
        found = found.select("file", "event")
    elif limit is None:
        return out.orderBy(*newest, F.col("part").desc())
    else:
        found = out.where("part = 0").select("file", "event")
    if limit is not None:
        found = found.orderBy(*newest).limit(limit)
    return out.join(found, ["file", "event"], "left_semi").orderBy(*newest, F.col("part").desc())


def artifact_results(spark: SparkSession, run_results: str, manifest: str | None = None) -> DataFrame:
    """Node results of a transformation run, named from its manifest."""
    schema = (
        "metadata struct<generated_at:string>, results array<struct<unique_id:string,status:string,"
        "execution_time:double,message:string,failures:string>>"
    )
    raw = spark.read.schema(schema).json(run_results, multiLine=True)
    rows = raw.select(F.col("metadata.generated_at").alias("generated_at"), F.inline("results"))
    if manifest is not None:
        nodes = spark.read.schema("nodes map<string,struct<name:string>>").json(manifest, multiLine=True)
        names = nodes.select(F.explode("nodes").alias("unique_id", "node")).select("unique_id", F.col("node.name").alias("name"))
        rows = rows.join(names, "unique_id", "left")
    else:
        rows = rows.withColumn("name", F.lit(None).cast("string"))
    last = F.nullif(F.element_at(F.split("unique_id", r"\."), -1), F.lit(""))
    return rows.select(
        "unique_id", F.coalesce("name", last, F.col("unique_id")).alias("name"),
        F.lower(F.coalesce("status", F.lit("unknown"))).alias("status"),
        F.coalesce("execution_time", F.lit(0.0)).alias("execution_time"),
        F.coalesce("message", "failures", F.lit("")).alias("message"), "generated_at",
    )


def artifact_mismatches(results: DataFrame) -> DataFrame:
    """One mismatch row per failed or errored node."""
    return results.where(F.col("status").isin("fail", "error")).select(
        F.create_map(F.lit("unique_id"), F.col("unique_id")).alias("key_values"),
        F.lit("dbt_status").alias("column_name"), F.col("status").alias("source_value"),
        F.lit("pass").alias("target_value"), F.lit("dbt_result").alias("mismatch_type"),
    )
