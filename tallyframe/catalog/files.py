"""Queries over files: each writes files derived from the given tables to scratch and reads them back."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.catalog import query
from tallyframe.catalog.fixtures import ORDERS_SQL, differs_sql, orders_source, orders_target, table
from tallyframe.catalog.history import RESULTS_SQL, _results
from tallyframe.catalog.reconciling import COUNTS, _counts_sql, _differences, _records_sql
from tallyframe.operators import pairing as P
from tallyframe.operators import schemas as S
from tallyframe.operators.reconcile import Comparison, CompareOptions
from tallyframe.operators.profile import profile
from tallyframe.operators.rules import Rule, evaluate
from tallyframe.operators.schemas import snapshot
from tallyframe.plans import jobs as J
from tallyframe.session import few_listing_tasks, scratch_path
from tallyframe.sources import discovery as D
from tallyframe.sources import logs as L
from tallyframe.sources import readers as R
from tallyframe.sources import sinks as K

PAGE = 2000
# Tasks move their own files when they are done, instead of the driver all of them at the end.
COMMIT = ("mapreduce.fileoutputcommitter.algorithm.version", "2")
PAGES_PER_TASK = 64


def _pages(df: DataFrame, key: str, line: Column, head: str, tail: str, glue: str, label: str) -> str:
    """Text files of at most ``PAGE`` rows each, in key order, with a head and a tail."""
    # As many tasks as the rows ask for, each with some files.
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // (PAGES_PER_TASK * PAGE)))
    rows = df.select(F.floor(F.col(key) / PAGE).alias("page"), F.col(key).alias("k"), line.alias("v")).repartition(tasks, "page")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"])
    text = rows.groupBy("page").agg(F.concat(F.lit(head), F.array_join(lines, glue), F.lit(tail)).alias("value"))
    path = scratch_path(df.sparkSession, label)
    text.write.partitionBy("page").text(path)
    return f"{path}/*"


def _named_files(df: DataFrame, name: str, label: str) -> str:
    """One header CSV per value of the name column; Spark chooses part names, so each is renamed by the file system."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.withColumnRenamed(name, "__file").repartition("__file").sortWithinPartitions("__file").write.partitionBy("__file").option(
        "header", True
    ).option(*COMMIT).csv(f"{path}-parts")
    return _renamed(spark, path)


def _named_texts(texts: DataFrame, label: str) -> str:
    """One file for each row of (name, value)."""
    path = scratch_path(texts.sparkSession, label)
    texts.select(F.col("name").alias("__file"), "value").repartition("__file").write.partitionBy("__file").option(*COMMIT).text(
        f"{path}-parts")
    return _renamed(texts.sparkSession, path)


def _renamed(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}-parts")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = jvm.org.apache.hadoop.fs.Path(path)
    fs.mkdirs(out)

    def rename(folder) -> None:
        part = folder.getPath().getName()
        if not part.startswith("__file="):
            return
        for f in fs.listStatus(folder.getPath()):
            if f.getPath().getName().startswith("part-"):
                fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(out, part[len("__file="):]))

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(rename, fs.listStatus(root)))
    return path


# -- Scans -----------------------------------------------------------------

_CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _customers(df: DataFrame) -> DataFrame:
    return df.select("c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal", "c_mktsegment")


@query("csv_scan", _CUSTOMER_SQL)
def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = K.write_table(table(spark, folder, "customer"), scratch_path(spark, "csv"), "csv")
    return _customers(R.read_files(spark, path, "csv"))


@query("tsv_scan", _CUSTOMER_SQL)
def tsv_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tsv")
    table(spark, folder, "customer").write.option("header", True).option("sep", "\t").csv(path)
    return _customers(R.read_files(spark, path, "tsv"))


@query("csv_sniffed_scan", _CUSTOMER_SQL)
def csv_sniffed_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Pipe-separated exports under a preamble and a ruler."""
    names = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in names])
    head = "Customer export\nprepared for audit, all regions\n\n" + "|".join(names) + "\n-----\n"
    path = _pages(table(spark, folder, "customer"), "c_custkey", line, head, "\n-----", "\n", "sniff")
    return _customers(R.read_files(spark, path, "csv"))


@query(
    "csv_mixed_headers_scan",
    f"""{_CUSTOMER_SQL.replace('FROM', ", CAST(NULL AS VARCHAR) AS note FROM")} WHERE c_custkey % 3 = 0
UNION ALL {_CUSTOMER_SQL.replace('FROM', ", 'n' || c_custkey FROM")} WHERE c_custkey % 3 = 1
UNION ALL {_CUSTOMER_SQL.replace('FROM', ", NULL FROM")} WHERE c_custkey % 3 = 2""",
)
def csv_mixed_headers_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files in one scan whose column order, columns, delimiters and preambles differ."""
    customer, third = table(spark, folder, "customer"), F.col("c_custkey") % 3
    names = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    plain = K.write_table(customer.where(third == 0), scratch_path(spark, "mixed"), "csv")
    other = customer.where(third == 1).select(
        *reversed(names), F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("note")
    )
    turned = K.write_table(other, scratch_path(spark, "mixed"), "csv")
    line = F.concat_ws(";", *[F.col(c).cast("string") for c in names[1:] + names[:1]])
    head = "Customers\nall regions, all segments, final\n" + ";".join(names[1:] + names[:1]) + "\n---\n"
    piped = _pages(customer.where(third == 2), "c_custkey", line, head, "\n", "\n", "mixed")
    df = R.read_files(spark, [plain, turned, piped], "csv")
    return df.select(
        "c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal", "c_mktsegment", "note"
    )


@query(
    "csv_line_breaks_scan",
    """SELECT c_custkey, c_name || chr(10) || chr(10) || '"' || c_mktsegment || '", ' || c_nationkey AS note, c_acctbal,
  CASE WHEN c_custkey % 5 = 0 THEN c_custkey || '" wide' END AS size FROM customer""",
)
def csv_line_breaks_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Fields with line breaks, blank lines, doubled quotes and commas; others with a quote that opens nothing."""
    note = F.concat(F.lit('"'), F.col("c_name"), F.lit('\n\n""'), F.col("c_mktsegment"), F.lit('"", '), F.col("c_nationkey"), F.lit('"'))
    size = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.col("c_custkey").cast("string"), F.lit('" wide'))).otherwise(F.lit(""))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), note, F.col("c_acctbal").cast("string"), size)
    path = _pages(table(spark, folder, "customer"), "c_custkey", line, "c_custkey,note,c_acctbal,size\n", "\n", "\n", "breaks")
    return R.read_files(spark, path, "csv")


@query("json_lines_scan", _CUSTOMER_SQL)
def json_lines_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = K.write_table(table(spark, folder, "customer"), scratch_path(spark, "jsonl"), "json")
    return _customers(R.read_files(spark, path, "jsonl"))


@query("columnar_scan", f"{_CUSTOMER_SQL} UNION ALL {_CUSTOMER_SQL}")
def columnar_scan(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    parquet, orc = scratch_path(spark, "parquet"), scratch_path(spark, "orc")
    customer.write.parquet(parquet)
    customer.write.orc(orc)
    return R.union_all([_customers(R.read_files(spark, parquet, "parquet")), _customers(R.read_files(spark, orc, "orc"))])


_NESTED_SQL = """SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS "customer.key", o_orderpriority AS "customer.tag.priority",
  o_totalprice AS price FROM orders"""


def _nested_pages(spark: SparkSession, folder: str) -> str:
    order = F.to_json(F.struct(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"),
        F.struct(F.col("o_custkey").alias("key"), F.struct(F.col("o_orderpriority").alias("priority")).alias("tag")).alias("customer"),
        F.col("o_totalprice").alias("price"),
    ))
    head, tail = '{"meta": {"source": "orders", "pages": 1},\n "data": {"items": [', ']}, "after": [{"x": 1}]}'
    return _pages(table(spark, folder, "orders"), "o_orderkey", order, head, tail, ",\n", "nested")


@query("json_flatten_scan", _NESTED_SQL)
def json_flatten_scan(spark: SparkSession, folder: str) -> DataFrame:
    return R.read_files(spark, _nested_pages(spark, folder), "json").select(
        "id", "status", "`customer.key`", "`customer.tag.priority`", "price"
    )


@query("landed_pages_scan", _NESTED_SQL)
def landed_pages_scan(spark: SparkSession, folder: str) -> DataFrame:
    return R.read_pages(spark, _nested_pages(spark, folder), "data.items").select(
        "id", "status", "`customer.key`", "`customer.tag.priority`", "price"
    )


@query(
    "xml_scan",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS "customer.key",
  o_orderpriority AS customer, o_orderpriority AS "Priority Code", CAST(o_custkey AS VARCHAR) AS "Customer Code",
  'a' AS note, CASE WHEN o_orderkey % 3 = 0 THEN 'b' END AS note_2 FROM orders""",
)
def xml_scan(spark: SparkSession, folder: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    record = F.concat(
        F.lit('<x:record id="'), text("o_orderkey"), F.lit('"><status>'), text("o_orderstatus"),
        F.lit('</status><customer key="'), text("o_custkey"), F.lit('">'), text("o_orderpriority"),
        F.lit('</customer><field name="Priority Code">'), text("o_orderpriority"),
        F.lit('</field><field name="Customer Code">'), text("o_custkey"), F.lit("</field><note>a</note>"),
        F.when(F.col("o_orderkey") % 3 == 0, "<note>b</note>").otherwise(""), F.lit("</x:record>"),
    )
    head = '<?xml version="1.0"?>\n<x:export xmlns:x="urn:x"><x:meta><source>orders</source></x:meta><x:list>'
    path = _pages(table(spark, folder, "orders"), "o_orderkey", record, head, "</x:list></x:export>", "\n", "xml")
    return R.read_files(spark, path, "xml").select(
        "id", "status", "`customer.key`", "customer", "`Priority Code`", "`Customer Code`", "note", "note_2"
    )


HEADER = 10_000


@query(
    "xml_mixed_scan",
    f"""SELECT 'h' AS kind, CAST(event_id AS VARCHAR) AS id, event_type AS note FROM events
UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), o_orderstatus || ' > ' || o_orderpriority FROM orders
  WHERE o_orderkey <= (SELECT max(event_id) FROM events) // {HEADER} * {HEADER} + {HEADER - 1}
UNION ALL SELECT 'entry', CAST(c_custkey AS VARCHAR), c_name FROM customer""",
)
def xml_mixed_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files of two shapes: some with 10,000 header elements before records of another tag, some with deep wrappers."""
    text = lambda c: F.col(c).cast("string")
    heads = table(spark, folder, "events").select(F.col("event_id").alias("k"), F.lit(0).alias("part"), F.concat(
        F.lit('<h kind="h"><id>'), text("event_id"), F.lit("</id><note><![CDATA["), text("event_type"), F.lit("]]></note></h>")
    ).alias("v"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("part"), F.concat(
        F.lit('<order kind="order" mark="a > b"><!-- <h> --><note><![CDATA['), text("o_orderstatus"), F.lit(" > "),
        text("o_orderpriority"), F.lit("]]></note><id>"), text("o_orderkey"), F.lit("</id></order>"),
    ).alias("v"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("part", "k", "v"))), lambda x: x["v"])
    pages = heads.unionByName(orders).groupBy(F.floor(F.col("k") / HEADER).alias("page")).agg(
        F.max((F.col("part") == 0).cast("int")).alias("headed"),
        F.concat(F.lit("<export>"), F.array_join(parts, "\n"), F.lit("</export>")).alias("value"),
    ).where("headed = 1")
    path = scratch_path(spark, "xml-mixed")
    pages.select("page", "value").repartition("page").write.partitionBy("page").text(path)
    entry = F.concat(
        F.lit("<e:ENTRY kind='entry'><id>"), text("c_custkey"), F.lit("</id><note>"), text("c_name"), F.lit("</note></e:ENTRY>")
    )
    wrapped = _pages(
        table(spark, folder, "customer"), "c_custkey", entry, "<e:x xmlns:e='urn:e'><top>1</top>" + "<w>" * 12, "</w>" * 12 + "</e:x>",
        "", "xml-wrapped",
    )
    return R.read_files(spark, [f"{path}/*", wrapped], "xml").select("kind", "id", "note")


@query(
    "json_mixed_lists_scan",
    """SELECT o_orderkey AS id, o_orderstatus AS status, NULL::VARCHAR AS segment FROM orders
UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier""",
)
def json_mixed_lists_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files in one scan whose lists of records lie under different keys, before or behind others, or alone."""
    def line(key: str, **others: str) -> Column:
        return F.to_json(F.struct(F.col(key).alias("id"), *[F.col(c).alias(n) for n, c in others.items()]))

    orders = _pages(
        table(spark, folder, "orders"), "o_orderkey", line("o_orderkey", status="o_orderstatus"),
        '{"count": 1, "orders": [', '], "items": [{"id": -1}]}', ",\n", "json-orders",
    )
    customers = _pages(
        table(spark, folder, "customer"), "c_custkey", line("c_custkey", segment="c_mktsegment"),
        '{"z": {"text": "[{}]", "a": {"items": [', ']}},\n "orders": [{"id": -2}]}', ", ", "json-customers",
    )
    suppliers = _pages(table(spark, folder, "supplier"), "s_suppkey", line("s_suppkey", segment="s_name"), "[", "]", ",", "json-suppliers")
    return R.read_files(spark, [orders, customers, suppliers], "json").select("id", "status", "segment")


@query(
    "union_scan",
    """SELECT c_nationkey AS nation, c_acctbal AS acctbal, c_mktsegment AS segment, NULL AS supplier FROM customer
UNION ALL SELECT s_nationkey, s_acctbal, NULL, s_name FROM supplier""",
)
def union_scan(spark: SparkSession, folder: str) -> DataFrame:
    sheets = [
        table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment")),
        table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("supplier")),
    ]
    return R.union_all(sheets)


@query(
    "bound_query",
    """SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'O' GROUP BY 1""",
)
def bound_query(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "orders").createOrReplaceTempView("tf_bound_orders")
    return R.read_query(
        spark, "SELECT o_orderpriority, count(*) AS orders FROM tf_bound_orders WHERE o_totalprice > :least AND o_orderstatus = :status GROUP BY 1",
        {"least": 250000, "status": "O"},
    )


@query(
    "catalog_listing",
    """SELECT 'tf_listing_customer' AS table_name, column_name, lower(CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE column_type END) AS data_type
FROM (DESCRIBE SELECT * FROM customer)""",
)
def catalog_listing(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "customer").createOrReplaceTempView("tf_listing_customer")
    return S.catalog_tables(spark).where("table_name = 'tf_listing_customer'")


@query("preview_rows", "SELECT least(count(*), 200) AS rows FROM orders")
def preview_rows(spark: SparkSession, folder: str) -> DataFrame:
    return R.preview(table(spark, folder, "orders"), 200).agg(F.count(F.lit(1)).alias("rows"))


# -- Listings --------------------------------------------------------------


def _partitioned(spark: SparkSession, folder: str) -> str:
    path = scratch_path(spark, "hive")
    orders = table(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    orders.repartition("o_orderstatus", "year").write.partitionBy("o_orderstatus", "year").parquet(path)
    return path


_PARTITIONS_SQL = """SELECT 'o_orderstatus=' || o_orderstatus || '/year=' || year(o_orderdate) AS partition, CAST(1 AS BIGINT) AS object_count,
  count(*) AS row_count FROM orders GROUP BY 1"""


@query("partition_discovery", _PARTITIONS_SQL)
def partition_discovery(spark: SparkSession, folder: str) -> DataFrame:
    found = D.discover_partitions(spark, _partitioned(spark, folder), "parquet")
    shown = F.array_join(F.transform("partition", lambda p: F.concat_ws("=", p["column"], p["value"])), "/")
    return found.select(shown.alias("partition"), "object_count", "row_count")


@query(
    "partition_check",
    """SELECT 'partition_columns' AS column_name, 'year' AS source_value, 'o_orderstatus,year' AS target_value, 'partition_columns_mismatch' AS mismatch_type
UNION ALL SELECT 'partition_count', '5000', CAST(count(DISTINCT o_orderstatus || year(o_orderdate)) AS VARCHAR), 'partition_count_below_min' FROM orders""",
)
def partition_check(spark: SparkSession, folder: str) -> DataFrame:
    return D.partition_check(D.discover_partitions(spark, _partitioned(spark, folder)), ["year"], 5000)


@query("file_row_counts", "SELECT count(*) AS row_count FROM orders GROUP BY o_orderstatus, year(o_orderdate)")
def file_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return D.file_row_counts(spark, _partitioned(spark, folder), "parquet").select("row_count")


@query("row_count_bounds", "SELECT 'row_count' AS column_name, '10' AS source_value, CAST(count(*) AS VARCHAR) AS target_value, 'row_count_above_max' AS mismatch_type FROM orders")
def row_count_bounds(spark: SparkSession, folder: str) -> DataFrame:
    rows = D.row_count_check(table(spark, folder, "orders").count(), 1, 10)
    return spark.createDataFrame(rows, "column_name string, source_value string, target_value string, mismatch_type string")


@query("object_metadata", "SELECT count(DISTINCT o_orderstatus || year(o_orderdate)) AS files, true AS all_sized, true AS all_dated FROM orders")
def object_metadata(spark: SparkSession, folder: str) -> DataFrame:
    files = D.list_files(spark, _partitioned(spark, folder), recursive=True).where(F.col("file_name").endswith(".parquet"))
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.bool_and(F.col("length") > 0).alias("all_sized"),
        F.bool_and(F.col("modified").isNotNull()).alias("all_dated"),
    )


# -- Logs and artifacts ----------------------------------------------------


def _log_path(spark: SparkSession, folder: str) -> str:
    level = F.create_map(*[F.lit(x) for x in (
        "error", "| ERROR | ", "click", "| INFO | ", "view", "| DEBUG | ", "signup", "| WARNING | ", "purchase", "")])
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss "), level[F.col("event_type")], F.lit("run-"), F.col("user_id").cast("string"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("\n  at step "), F.col("event_id").cast("string"), F.lit("\n  caused by value"))).otherwise(""),
    )
    return _pages(table(spark, folder, "events"), "event_id", line, "service started\nready\n", "", "\n", "logs")


_LOG_SQL = """
ev AS (SELECT event_id // 2000 AS page, event_id, event_type,
   CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'DEBUG' WHEN 'signup' THEN 'WARNING' ELSE 'TRACE' END AS level,
   strftime(ts, '%Y-%m-%d %H:%M:%S ') || CASE event_type WHEN 'error' THEN '| ERROR | ' WHEN 'click' THEN '| INFO | ' WHEN 'view' THEN '| DEBUG | '
     WHEN 'signup' THEN '| WARNING | ' ELSE '' END || 'run-' || user_id ||
     CASE WHEN event_id % 4 = 0 THEN chr(10) || '  at step ' || event_id || chr(10) || '  caused by value' ELSE '' END AS text,
   3 + sum(CASE WHEN event_id % 4 = 0 THEN 3 ELSE 1 END) OVER (PARTITION BY event_id // 2000 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n
   FROM events)"""


@query(
    "log_events",
    f"""WITH {_LOG_SQL} SELECT CAST(coalesce(n, 3) AS BIGINT) AS number, level, text FROM ev
UNION ALL SELECT 1, 'TRACE', 'service started' || chr(10) || 'ready' FROM (SELECT DISTINCT page FROM ev)""",
)
def log_events(spark: SparkSession, folder: str) -> DataFrame:
    return L.log_events(spark, _log_path(spark, folder)).select(F.col("number").cast("bigint").alias("number"), "level", "text")


@query(
    "log_search",
    f"""WITH {_LOG_SQL} SELECT level, text FROM ev WHERE level = 'WARNING' AND contains(text, 'run-7') AND contains(text, 'caused by')
ORDER BY page DESC, event_id DESC LIMIT 25""",
)
def log_search(spark: SparkSession, folder: str) -> DataFrame:
    events = L.log_events(spark, _log_path(spark, folder))
    paged = events.withColumn("file", F.lpad(F.regexp_extract("file", r"page=(\d+)", 1), 12, "0"))
    return L.filter_log_events(paged, "RUN-7", "Caused By", "warn", 25).select("level", "text")


@query(
    "log_long_events",
    """SELECT event_id // 2000 AS page, 1 AS event, 'ERROR' AS level, CAST(1 + 6 * count(*) AS BIGINT) AS lines, '2024-01-01 00:00:00 | ERROR | batch' AS head,
  bool_or(user_id % 500 = 7) AND bool_or(user_id % 500 = 11) AND bool_or(event_id % 7001 = 0) AS found
FROM events GROUP BY ALL""",
)
def log_long_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of 12,000 lines: counted once, and searched for words that stand far apart."""
    line = F.concat(
        F.lit("  user "), (F.col("user_id") % 500).cast("string"), F.lit(";\n  checked "), (F.col("event_id") % 7001).cast("string"),
        F.lit(";\n  one\n  two\n  three\n  four"),
    )
    path = _pages(table(spark, folder, "events"), "event_id", line, "2024-01-01 00:00:00 | ERROR | batch\n", "", "\n", "long-logs")
    events = L.log_events(spark, path)
    heads = L.event_heads(events)
    users = L.filter_log_events(events, "user 7;", "USER 11;", "error", None).select("file", "event").distinct()
    both = L.filter_log_events(events.join(users, ["file", "event"], "left_semi"), "checked 0;", limit=None)
    marked = heads.join(both.select("file", "event", F.lit(True).alias("hit")).distinct(), ["file", "event"], "left")
    return marked.select(
        F.regexp_extract("file", r"page=(\d+)", 1).cast("bigint").alias("page"), F.col("event").cast("int").alias("event"), "level",
        "lines", "head", F.coalesce("hit", F.lit(False)).alias("found"),
    )


@query(
    "artifact_results",
    """WITH r AS (SELECT 'test.shop.check_' || s_suppkey AS unique_id, CASE WHEN s_suppkey % 4 = 0 THEN 'Named ' || s_name ELSE 'check_' || s_suppkey END AS name,
  ['pass', 'fail', 'error', 'skipped', 'pass'][s_suppkey % 5 + 1] AS status, s_acctbal AS execution_time,
  CASE WHEN s_suppkey % 5 = 1 THEN '3' WHEN s_suppkey % 5 = 2 THEN 'broke' ELSE '' END AS message FROM supplier)
SELECT *, status IN ('fail', 'error') AS mismatch FROM r""",
)
def artifact_results(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("s_suppkey")
    unique = F.concat(F.lit("test.shop.check_"), s.cast("string"))
    statuses = F.array(*[F.lit(x) for x in ("pass", "Fail", "error", "skipped", "pass")])
    result = F.to_json(F.struct(
        unique.alias("unique_id"), F.element_at(statuses, (s % 5 + 1).cast("int")).alias("status"),
        F.col("s_acctbal").alias("execution_time"), F.when(s % 5 == 2, "broke").alias("message"),
        F.when(s % 5 == 1, 3).alias("failures"),
    ))
    node = F.concat(F.lit('"'), unique, F.lit('": '), F.to_json(F.struct(F.concat(F.lit("Named "), "s_name").alias("name"))))
    supplier = table(spark, folder, "supplier")
    runs = _pages(supplier, "s_suppkey", result, '{"metadata": {"generated_at": "2024-01-01"}, "results": [', "]}", ",", "artifact")
    manifest = _pages(supplier.where(s % 4 == 0), "s_suppkey", node, '{"nodes": {', "}}", ",", "manifest")
    results = L.artifact_results(spark, runs, manifest)
    bad = L.artifact_mismatches(results).select(F.col("key_values")["unique_id"].alias("unique_id"), F.lit(True).alias("mismatch"))
    return results.join(bad, "unique_id", "left").select(
        "unique_id", "name", "status", "execution_time", "message", F.coalesce("mismatch", F.lit(False)).alias("mismatch")
    )


# -- Pairs of files --------------------------------------------------------

def _file_orders(spark: SparkSession, folder: str, target: bool) -> str:
    """Orders split to one file per priority and year; the target drops one year and drifts one priority."""
    k = F.col("o_orderkey")
    orders = table(spark, folder, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("amount"),
        F.substring("o_orderpriority", 1, 1).alias("p"), F.year("o_orderdate").cast("string").alias("y"),
    )
    if not target:
        name = F.concat(F.lit("sales_"), "p", F.lit("_"), "y", F.lit("0101.csv"))
        return _named_files(orders.withColumn("name", name).select("id", "custkey", "amount", "name"), "name", "sales")
    drifted = orders.where("y <> '1997'").withColumn(
        "amount", F.when((F.col("p") == "2") & (F.col("id") % 5 == 0), F.col("amount") + 5).otherwise(F.col("amount"))
    ).withColumn("id", F.when((F.col("p") == "3") & (F.col("y") == "1999") & (F.col("id") % 50 == 0), F.col("id") + 9000000).otherwise(F.col("id")))
    name = F.concat(F.lit("fin-"), "p", F.lit("-"), "y", F.lit("0101.csv"))
    return _named_files(drifted.withColumn("name", name).select("id", "custkey", "amount", "name"), "name", "fin")


_FILES_SQL = """
so AS (SELECT o_orderkey AS id, o_custkey AS custkey, o_totalprice AS amount, o_orderpriority[1:1] AS p, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders),
fi AS (SELECT CASE WHEN p = '3' AND y = '1999' AND id % 50 = 0 THEN id + 9000000 ELSE id END AS id, custkey,
         CASE WHEN p = '2' AND id % 5 = 0 THEN amount + 5 ELSE amount END AS amount, p, y FROM so WHERE y <> '1997'),
pairs AS (SELECT coalesce(a.p, b.p) AS p, coalesce(a.y, b.y) AS y, a.p AS ap, b.p AS bp
          FROM (SELECT DISTINCT p, y FROM so) a FULL OUTER JOIN (SELECT DISTINCT p, y FROM fi) b ON a.p = b.p AND a.y = b.y)
"""
_PAIR_JSON = """'{"p":"' || p || '","day":"' || y || '0101"}'"""
_SOURCE_PATTERN, _TARGET_PATTERN = "sales_{p:num}_{day:%Y%m%d}.csv", "fin-{p:regex([0-9]{1,2})}-{day}.*"


def _mapping(spark: SparkSession, folder: str) -> DataFrame:
    return P.pair_by_tokens(
        D.discover(spark, _file_orders(spark, folder, False), _SOURCE_PATTERN, "source"),
        D.discover(spark, _file_orders(spark, folder, True), _TARGET_PATTERN, "target"), ["p", "day"],
    )


@query(
    "pair_files_explicit",
    f"""WITH {_FILES_SQL} SELECT {_PAIR_JSON} AS pair, CASE WHEN bp IS NULL THEN 'unmatched_source' ELSE 'paired' END AS status,
  'sales_' || p || '_' || y || '0101.csv' AS source_file, CASE WHEN bp IS NOT NULL THEN 'fin-' || p || '-' || y || '0101.csv' END AS target_file FROM pairs""",
)
def pair_files_explicit(spark: SparkSession, folder: str) -> DataFrame:
    return _mapping(spark, folder).select(
        "pair", "status", F.col("source_files")[0]["file_name"].alias("source_file"), F.col("target_files")[0]["file_name"].alias("target_file")
    )


@query(
    "file_readiness",
    f"""WITH {_FILES_SQL} SELECT count(DISTINCT p || y) AS found, 3 AS expected, count(DISTINCT p || y) >= 3 AS ready FROM so""",
)
def file_readiness(spark: SparkSession, folder: str) -> DataFrame:
    return D.readiness(D.discover(spark, _file_orders(spark, folder, False), _SOURCE_PATTERN), 3)


_PAIR_RESULTS_SQL = f"""{_FILES_SQL},
 j AS (SELECT coalesce(s.p, t.p) AS p, coalesce(s.y, t.y) AS y, s.id AS sid, t.id AS tid,
   CASE WHEN s.id IS NOT NULL AND t.id IS NOT NULL AND s.custkey <> t.custkey THEN 1 ELSE 0 END
   + CASE WHEN s.id IS NOT NULL AND t.id IS NOT NULL AND abs(s.amount - t.amount) > 1e-9 THEN 1 ELSE 0 END AS bad
   FROM (SELECT * FROM so WHERE y <> '1997') s FULL OUTER JOIN fi t ON s.p = t.p AND s.y = t.y AND s.id = t.id),
 pr AS (SELECT p, y, count(sid) AS source_row_count, count(tid) AS target_row_count, count(*) FILTER (WHERE sid IS NOT NULL AND tid IS NOT NULL) AS matched_count,
   count(*) FILTER (WHERE tid IS NULL) AS missing_in_target_count, count(*) FILTER (WHERE sid IS NULL) AS missing_in_source_count,
   CAST(sum(bad) AS BIGINT) AS value_mismatch_count FROM j GROUP BY 1, 2),
 st AS (SELECT *, CASE WHEN missing_in_target_count + missing_in_source_count + value_mismatch_count = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM pr)"""


def _many(spark: SparkSession, folder: str) -> tuple[DataFrame, Comparison]:
    return J.compare_many_files(
        spark, _file_orders(spark, folder, False), _SOURCE_PATTERN, _file_orders(spark, folder, True), _TARGET_PATTERN,
        ["p", "day"], CompareOptions(key_columns=["id"]), "csv",
    )


@query(
    "multi_file_pairs",
    f"""WITH {_PAIR_RESULTS_SQL} SELECT {_PAIR_JSON} AS pair, source_row_count, target_row_count, matched_count, missing_in_target_count,
  missing_in_source_count, value_mismatch_count, status FROM st""",
)
def multi_file_pairs(spark: SparkSession, folder: str) -> DataFrame:
    mapping, comparison = _many(spark, folder)
    return P.pair_results(comparison, mapping).withColumnRenamed(P.PAIR_KEY, "pair").drop("source_files", "target_files")


@query(
    "multi_file_rollup",
    f"""WITH {_PAIR_RESULTS_SQL} SELECT count(*) AS pairs_total, count(*) FILTER (WHERE status = 'PASSED') AS pairs_passed,
  count(*) FILTER (WHERE status = 'FAILED') AS pairs_failed, CAST(0 AS BIGINT) AS pairs_errored,
  {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('source_row_count', 'target_row_count', 'matched_count', 'missing_in_target_count', 'missing_in_source_count', 'value_mismatch_count'))},
  CASE WHEN bool_and(status = 'PASSED') THEN 'PASSED' ELSE 'FAILED' END AS status FROM st""",
)
def multi_file_rollup(spark: SparkSession, folder: str) -> DataFrame:
    mapping, comparison = _many(spark, folder)
    return P.rolled_up(P.pair_results(comparison, mapping))


@query(
    "multi_file_broken_pair",
    """WITH p AS (SELECT o_orderkey % 3 AS p, count(*) AS n FROM orders GROUP BY 1)
SELECT p, CASE WHEN p = 1 THEN 'ERROR' ELSE 'PASSED' END AS status, CASE WHEN p = 1 THEN 0 ELSE n END AS matched_count FROM p
UNION ALL SELECT -1, 'ERROR', CAST(sum(n) FILTER (WHERE p <> 1) AS BIGINT) FROM p""",
)
def multi_file_broken_pair(spark: SparkSession, folder: str) -> DataFrame:
    """Three pairs of files, one of which has a line with a field too few; the last row rolls them up."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    orders = table(spark, folder, "orders").withColumn("p", (k % 3).cast("string"))
    good = orders.select(F.concat(F.lit("s_"), "p", F.lit(".csv")).alias("name"), k.alias("id"), price.alias("price"))
    line = F.concat_ws(",", k.cast("string"), price)
    cut = orders.select(
        F.concat(F.lit("t_"), "p", F.lit(".csv")).alias("name"),
        F.when((k % 3 == 1) & (k == 1), k.cast("string")).otherwise(line).alias("id,price"),
    )
    source, target = _named_files(good, "name", "pairs-source"), scratch_path(spark, "pairs-target")
    text = cut.groupBy("name").agg(F.concat(F.lit("id,price\n"), F.array_join(F.collect_list("id,price"), "\n")).alias("value"))
    text.repartition("name").write.partitionBy("name").text(target)
    mapping = P.with_errors(spark, P.pair_by_tokens(
        D.discover(spark, source, "s_{p}.csv", "source"),
        spark.read.format("binaryFile").load(f"{target}/*").select("path").select(
            "path", F.element_at(F.split("path", "/"), -1).alias("file_name"),
            F.create_map(F.lit("p"), F.regexp_extract("path", "name=t_([0-9])", 1)).alias("tokens"),
        ), ["p"],
    ), "csv")
    found = P.compare_pairs(
        P.pair_rows(spark, mapping, "source", "csv"), P.pair_rows(spark, mapping, "target", "csv"),
        CompareOptions(key_columns=["id"]),
    )
    results = P.pair_results(found, mapping)
    each = results.select(F.get_json_object(P.PAIR_KEY, "$.p").cast("bigint").alias("p"), "status", "matched_count")
    whole = P.rolled_up(results).select(F.lit(-1).cast("bigint").alias("p"), "status", "matched_count")
    return each.unionByName(whole)


@query(
    "multi_file_documents",
    f"""WITH o AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'xml' ELSE 'json' END AS kind, o_orderkey // {PAGE} AS page
  FROM orders WHERE o_orderkey % 4 < 2)
SELECT kind, page, count(*) AS source_row_count, count(*) FILTER (WHERE kind = 'xml' OR k % 7 <> 0) AS matched_count,
  count(*) FILTER (WHERE kind = 'json' AND k % 7 = 0) AS missing_in_target_count,
  count(*) FILTER (WHERE kind = 'xml' AND k % 10 = 0) AS value_mismatch_count FROM o GROUP BY ALL""",
)
def multi_file_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of files of different formats: XML against CSV, JSON against Parquet."""
    k = F.col("o_orderkey")
    page = F.floor(k / PAGE).cast("string")
    orders = table(spark, folder, "orders").select(k.alias("id"), F.col("o_totalprice").alias("amount"), page.alias("page"), (k % 4).alias("p"))

    def joined(v: Column, glue: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", v.alias("v")))), lambda x: x["v"]), glue)

    element = F.concat(F.lit("<o id='"), F.col("id").cast("string"), F.lit("'><amount>"), F.col("amount").cast("string"), F.lit("</amount></o>"))
    in_xml, in_json = orders.where("p = 0"), orders.where("p = 1")
    xml = in_xml.groupBy("page").agg(F.concat(F.lit("<all><list>"), joined(element, "\n"), F.lit("</list></all>")).alias("value"))
    documents = in_json.groupBy("page").agg(
        F.concat(F.lit('{"n": 0, "rows": ['), joined(F.to_json(F.struct("id", "amount")), ","), F.lit("]}")).alias("value")
    )
    source = _named_texts(
        xml.select(F.concat(F.lit("xml_"), "page", F.lit(".xml")).alias("name"), "value").unionByName(
            documents.select(F.concat(F.lit("json_"), "page", F.lit(".json")).alias("name"), "value")
        ), "documents",
    )
    drifted = F.when(F.col("id") % 10 == 0, F.col("amount") + 5).otherwise(F.col("amount")).alias("amount")
    csv = _named_files(in_xml.select("id", drifted, F.concat(F.lit("xml_"), "page", F.lit(".csv")).alias("name")), "name", "documents-csv")
    parquet = scratch_path(spark, "documents-parquet")
    in_json.where("id % 7 <> 0").select("id", "amount", "page").repartition("page").write.partitionBy("page").option(*COMMIT).parquet(parquet)
    with few_listing_tasks(spark):
        listed = spark.read.format("binaryFile").load(f"{parquet}/*/*.parquet")
    found = D.discover(spark, csv, "{kind}_{page}.csv", "target").select("path", "file_name", "tokens").unionByName(
        listed.select(
            "path", F.element_at(F.split("path", "/"), -1).alias("file_name"),
            F.create_map(F.lit("kind"), F.lit("json"), F.lit("page"), F.regexp_extract("path", "page=([0-9]+)", 1)).alias("tokens"),
        )
    )
    mapping = P.with_errors(spark, P.pair_by_tokens(
        D.discover(spark, source, "{kind}_{page}.{rest}", "source").select(
            "path", "file_name", F.map_filter("tokens", lambda name, _: name != "rest").alias("tokens")
        ), found, ["kind", "page"],
    ))
    results = P.pair_results(
        P.compare_pairs(P.pair_rows(spark, mapping, "source"), P.pair_rows(spark, mapping, "target"), CompareOptions(key_columns=["id"])),
        mapping,
    )
    return results.select(
        F.get_json_object(P.PAIR_KEY, "$.kind").alias("kind"), F.get_json_object(P.PAIR_KEY, "$.page").cast("bigint").alias("page"),
        "source_row_count", "matched_count", "missing_in_target_count", "value_mismatch_count",
    )


@query(
    "multi_file_records",
    f"""WITH {_PAIR_RESULTS_SQL} SELECT {_PAIR_JSON} AS pair, coalesce(sid, tid) AS id, CASE WHEN tid IS NULL THEN 'missing_in_target'
  WHEN sid IS NULL THEN 'missing_in_source' ELSE 'value_diff' END AS mismatch_type FROM j WHERE sid IS NULL OR tid IS NULL OR bad > 0""",
)
def multi_file_records(spark: SparkSession, folder: str) -> DataFrame:
    _, comparison = _many(spark, folder)
    key = F.col("key_values")
    return comparison.records().select(key[P.PAIR_KEY].alias("pair"), key["id"].cast("bigint").alias("id"), "mismatch_type")


@query(
    "pair_files_similarity",
    f"""WITH {_FILES_SQL} SELECT 'sales_' || p || '_' || y || '0101.csv' AS source_file, 'fin-' || p || '-' || y || '0101.csv' AS target_file,
  CAST(1 AS DOUBLE) AS column_signature, CAST(1 AS DOUBLE) AS row_count_ratio FROM pairs WHERE bp IS NOT NULL""",
)
def pair_files_similarity(spark: SparkSession, folder: str) -> DataFrame:
    source = D.list_files(spark, _file_orders(spark, folder, False)).where("file_name not like '%_19970101.csv'")
    target = D.list_files(spark, _file_orders(spark, folder, True))
    pairs = P.pair_by_likeness(
        D.describe_delimited(spark, source.select("path", "file_name")), D.describe_delimited(spark, target.select("path", "file_name")), 0.7
    )
    return pairs.select("source_file", "target_file", "column_signature", "row_count_ratio")


# -- Exports ---------------------------------------------------------------


def _comparison(spark: SparkSession, folder: str) -> Comparison:
    return Comparison(orders_source(spark, folder), orders_target(spark, folder), CompareOptions(key_columns=["o_orderkey"]))


@query(
    "difference_export",
    f"""WITH {ORDERS_SQL}, r AS ({_records_sql()}), f AS (SELECT unnest(['csv', 'json', 'parquet']) AS format)
SELECT format, column_name, mismatch_type, count(*) AS n, count(*) FILTER (WHERE coalesce(target_value, '') = '') AS blank_targets,
  round(sum(delta), 2) AS delta, count(*) AS pairs FROM r, f GROUP BY 1, 2, 3""",
)
def difference_export(spark: SparkSession, folder: str) -> DataFrame:
    records = _comparison(spark, folder).records()
    kinds = {"delta": "double", "relative_delta": "double", "pair_count": "bigint"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in K.DIFFERENCE_FIELDS)
    parts = []
    for fmt in ("csv", "json", "parquet"):
        path = K.export_differences(records, "orders", scratch_path(spark, "export"), fmt)
        reader = spark.read.schema(schema).option("header", True).option("escape", '"')
        parts.append(reader.format(fmt).load(path).withColumn("format", F.lit(fmt)))
    return R.union_all(parts).groupBy("format", "column_name", "mismatch_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce("target_value", F.lit("")) == "").alias("blank_targets"), F.round(F.sum("delta"), 2).alias("delta"),
        F.sum("pair_count").alias("pairs"),
    )


@query(
    "stored_difference_export",
    f"""WITH {ORDERS_SQL}, r AS ({_records_sql()}) SELECT column_name, count(*) AS n FROM r WHERE o_orderkey % 2 = 1 GROUP BY 1""",
)
def stored_difference_export(spark: SparkSession, folder: str) -> DataFrame:
    """Records of two runs appended to a history table, one of them exported again."""
    records = _comparison(spark, folder).records().withColumn("test_name", F.lit("orders"))
    key = F.col("key_values")["o_orderkey"].cast("bigint")
    store = scratch_path(spark, "records")
    K.append_history(records.where(key % 2 == 0), store, "r1")
    K.append_history(records.where(key % 2 == 1), store, "r2")
    path = K.export_stored_differences(spark.read.parquet(store), "r2", scratch_path(spark, "export"), "parquet")
    return spark.read.parquet(path).groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "appended_profiles",
    f"""WITH {ORDERS_SQL}, p AS (
  SELECT 'r1' AS run_id, o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders
  UNION ALL SELECT 'r2', o_orderkey, o_totalprice, o_orderstatus FROM tgt)
SELECT run_id, 'o_orderkey' AS column_name, count(DISTINCT k) AS distinct_count, round(avg(k), 4) AS mean_val, 'bigint' AS dtype FROM p GROUP BY 1
UNION ALL SELECT run_id, 'o_totalprice', count(DISTINCT price), round(avg(price), 4), 'double' FROM p GROUP BY 1
UNION ALL SELECT run_id, 'o_orderstatus', count(DISTINCT status), NULL, 'string' FROM p GROUP BY 1""",
)
def appended_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles and schema snapshots of two runs appended to history tables and read back together."""
    profiles, snapshots = scratch_path(spark, "profiles"), scratch_path(spark, "snapshots")
    for run, df in (("r1", table(spark, folder, "orders")), ("r2", orders_target(spark, folder))):
        K.append_history(profile(df, ["o_orderkey", "o_totalprice", "o_orderstatus"]), profiles, run)
        K.append_history(snapshot(df), snapshots, run)
    types = spark.read.parquet(snapshots).select("run_id", F.col("name").alias("column_name"), "dtype")
    return spark.read.parquet(profiles).join(types, ["run_id", "column_name"]).select(
        "run_id", "column_name", "distinct_count", F.round("mean_val", 4).alias("mean_val"), "dtype"
    )


@query(
    "history_retried",
    """SELECT 'r1' AS run_id, o_orderstatus AS job_name, count(*) AS rows, sum(o_custkey) AS keys FROM orders GROUP BY 2
UNION ALL SELECT 'r2', o_orderstatus, count(*), sum(o_custkey) FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 2""",
)
def history_retried(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs stored job by job; all jobs of the first are stored again, as by a retry, after a partial first try."""
    orders, store = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), scratch_path(spark, "history")
    half = orders.where("o_orderkey % 2 = 0")
    statuses = ("F", "O", "P")
    for run, rows in (("r1", half), ("r2", half), ("r1", orders), ("r1", orders)):
        for status in statuses:
            K.append_history(rows.where(F.col("o_orderstatus") == status).drop("o_orderstatus"), store, run, status)
    return spark.read.parquet(store).groupBy("run_id", "job_name").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("o_custkey").alias("keys")
    )


@query(
    "capped_export",
    f"""WITH {ORDERS_SQL}, r AS ({_records_sql()}) SELECT least(count(*), 50) AS rows, 6 AS fields FROM r""",
)
def capped_export(spark: SparkSession, folder: str) -> DataFrame:
    path = K.export_capped(_comparison(spark, folder).records(), "orders", scratch_path(spark, "capped"), limit=50)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(back.columns)).alias("fields"))


@query(
    "results_export",
    f"""WITH {RESULTS_SQL} SELECT run_id, job_name AS query_name, status, effective AS effective_status, source_row_count, value_mismatch_count FROM eff""",
)
def results_export(spark: SparkSession, folder: str) -> DataFrame:
    results = _results(spark, folder).withColumn("target_row_count", F.col("source_row_count"))
    path = K.export_results(results, scratch_path(spark, "results"))
    back = R.read_delimited(spark, path)
    return back.select("run_id", "query_name", "status", "effective_status", "source_row_count", "value_mismatch_count")


@query(
    "metrics_export",
    f"""WITH {RESULTS_SQL} SELECT run_id, count(*) AS total_tests, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM eff GROUP BY 1""",
)
def metrics_export(spark: SparkSession, folder: str) -> DataFrame:
    path = K.write_metrics(_results(spark, folder), scratch_path(spark, "metrics"))
    return R.read_json_lines(spark, path).select("run_id", "total_tests", "failed")


@query(
    "manifest_export",
    f"""WITH {_FILES_SQL} SELECT 'r1' AS run_id, 'explicit' AS strategy, CASE WHEN bp IS NULL THEN 'unmatched_source' ELSE 'paired' END AS status, count(*) AS groups
FROM pairs GROUP BY 3""",
)
def manifest_export(spark: SparkSession, folder: str) -> DataFrame:
    path = K.write_manifest(_mapping(spark, folder), "r1", "orders by file", "explicit", scratch_path(spark, "manifest"))
    return R.read_json_lines(spark, path).groupBy("run_id", "strategy", "status").agg(F.count(F.lit(1)).alias("groups"))


@query(
    "artifact_reload",
    f"""WITH {_FILES_SQL} SELECT count(*) AS rows, count(DISTINCT p || y) AS pairs, round(sum(amount), 2) AS amount FROM so WHERE y <> '1997'""",
)
def artifact_reload(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all pairs kept by one run and loaded again through its results."""
    rows = P.pair_rows(spark, _mapping(spark, folder), "source", "csv")
    place = K.persist_pairs(rows, scratch_path(spark, "pairs"), "r1", "orders", "source")
    results = spark.createDataFrame([("r1", "orders", place)], "run_id string, job_name string, source_artifact_path string")
    return K.load_artifact(results, "r1", "orders").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(P.PAIR_KEY).alias("pairs"), F.round(F.sum("amount"), 2).alias("amount")
    )


# -- Jobs ------------------------------------------------------------------


@query(
    "transform_case",
    """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS revenue FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
 e AS (SELECT day, CASE WHEN day(day) = 13 THEN revenue + 1 ELSE revenue END AS revenue FROM o WHERE month(day) <> 2)
SELECT CASE WHEN e.day IS NULL THEN 'missing_in_target' ELSE 'value_diff' END AS mismatch_type, CAST(o.day AS VARCHAR) AS day
FROM o LEFT JOIN e ON o.day = e.day WHERE e.day IS NULL OR abs(o.revenue - e.revenue) > 0.5""",
)
def transform_case(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    expected = orders.where("o_orderstatus <> 'P'").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.sum("o_totalprice").alias("revenue")
    ).where(F.month("day") != 2).withColumn(
        "revenue", F.when(F.dayofmonth("day") == 13, F.col("revenue") + 1).otherwise(F.col("revenue"))
    )
    case = J.TransformCase(
        "SELECT to_date(o_orderdate) AS day, sum(o_totalprice) AS revenue FROM sales WHERE o_orderstatus <> 'P' GROUP BY 1",
        {"sales": orders}, expected, ["day"], 0.5,
    )
    return case.run().records().select("mismatch_type", F.to_date(F.col("key_values")["day"]).cast("string").alias("day"))


@query(
    "query_against_query",
    _counts_sql(
        """
src AS (SELECT o_custkey AS k, count(*) AS orders, max(o_totalprice) AS top FROM orders GROUP BY 1),
tgt AS (SELECT o_custkey AS k, count(*) AS orders, max(o_totalprice) AS top FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY 1)
""",
        "s.k = t.k", {"orders": differs_sql("orders"), "top": differs_sql("top", 1e-9)},
    ),
)
def query_against_query(spark: SparkSession, folder: str) -> DataFrame:
    sql = "SELECT o_custkey AS customer_id, count(*) AS orders, max(o_totalprice) AS top FROM o{} GROUP BY 1"
    found = J.compare_queries(
        spark, sql.format(""), sql.format(" WHERE o_orderkey % 50 <> 0"), CompareOptions(), {"o": table(spark, folder, "orders")}
    )
    return found.summary().select(*COUNTS)


@query(
    "file_against_file",
    _counts_sql(ORDERS_SQL, "s.o_orderkey = t.o_orderkey", _differences(skip=("o_orderdate", "o_orderpriority"))),
)
def file_against_file(spark: SparkSession, folder: str) -> DataFrame:
    """A CSV export against a JSON-lines export."""
    drop = ("o_orderdate", "o_orderpriority")
    a = K.write_table(orders_source(spark, folder).drop(*drop), scratch_path(spark, "file-a"), "csv")
    b = K.write_table(orders_target(spark, folder).drop(*drop), scratch_path(spark, "file-b"), "json")
    found = J.compare_files(spark, a, b, CompareOptions(key_columns=["o_orderkey"]), "csv", "jsonl")
    return found.summary().select(*COUNTS)


@query(
    "pages_against_pages",
    """SELECT count(*) AS matched_count, CAST(0 AS BIGINT) AS value_mismatch_count, 'PASSED' AS status FROM orders""",
)
def pages_against_pages(spark: SparkSession, folder: str) -> DataFrame:
    found = J.compare_pages(
        spark, _nested_pages(spark, folder), _nested_pages(spark, folder), CompareOptions(), "data.items"
    )
    return found.summary().select("matched_count", "value_mismatch_count", "status")


@query(
    "pass_condition",
    f"""WITH {RESULTS_SQL}, c AS (SELECT *, [x for x in [CASE WHEN source_row_count < 50 THEN 1 END, CASE WHEN value_mismatch_count > 8 THEN 1 END,
   CASE WHEN missing_in_target_count > 2 THEN 1 END, CASE WHEN status NOT IN ('PASSED', 'SLOW') THEN 1 END, 1] if x IS NOT NULL] AS v FROM hist)
SELECT run_id, job_name, CAST(len(v) AS INTEGER) AS violations, value_mismatch_count + len(v) AS value_mismatch_count, 'FAILED' AS status FROM c""",
)
def pass_condition(spark: SparkSession, folder: str) -> DataFrame:
    condition = J.PassCondition(
        min_row_count=50, max_value_mismatches=8, max_missing_in_target=2, require_status=("PASSED", "SLOW"),
        pass_sql="SELECT * FROM customer WHERE c_acctbal < 0", pass_sql_mode="rows_mean_fail",
        views={"customer": table(spark, folder, "customer")},
    )
    return J.apply_pass_condition(_results(spark, folder), condition).select(
        "run_id", "job_name", F.size("violations").alias("violations"), "value_mismatch_count", "status"
    )


@query(
    "violations_folded",
    """WITH r AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS bad FROM customer)
SELECT 'c_acctbal' AS column_name, 1 AS mismatch_count, n AS compared_rows, 'FAILED' AS status, CAST(2 AS BIGINT) AS total FROM r
UNION ALL SELECT '(none)', 1, n, 'FAILED', 2 FROM r
UNION ALL SELECT c, 0, n, 'FAILED', 2 FROM r, (SELECT unnest(['c_name', 'c_nationkey', 'c_mktsegment']) AS c)""",
)
def violations_folded(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    comparison = Comparison(customer, customer, CompareOptions(key_columns=["c_custkey"]))
    found = evaluate(customer, [
        Rule("column_value_between", "c_acctbal", min_value=0), Rule("row_count_max", max_value=10, severity="warn"),
    ])
    result = J.fold_violations(comparison.summary(), found).first()
    summary = J.summary_with_violations(comparison.by_column(), found, comparison.census.source_rows)
    return summary.select(
        "column_name", F.col("mismatch_count").cast("int").alias("mismatch_count"), "compared_rows",
        F.lit(result["status"]).alias("status"), F.lit(result["value_mismatch_count"]).cast("bigint").alias("total"),
    )


@query(
    "two_environments",
    f"""WITH {RESULTS_SQL}, b AS (SELECT *, CASE WHEN job_name = 'click' THEN 'PASSED' WHEN job_name = 'view' THEN 'FAILED' ELSE effective END AS other FROM eff WHERE run_id = '2024-01-06')
SELECT job_name AS test_name, effective AS status_a, other AS status_b, CASE WHEN effective = 'PASSED' AND other <> 'PASSED' THEN 'regressed'
  WHEN effective <> 'PASSED' AND other = 'PASSED' THEN 'improved' ELSE 'unchanged' END AS change FROM b""",
)
def two_environments(spark: SparkSession, folder: str) -> DataFrame:
    a = _results(spark, folder).where("run_id = '2024-01-06'")
    b = a.withColumn(
        "override_status",
        F.when(F.col("job_name") == "click", "PASSED").when(F.col("job_name") == "view", "FAILED").otherwise(F.col("override_status")),
    )
    return J.compare_environments(a, b).select("test_name", "status_a", "status_b", "change")


@query(
    "format_validation",
    """WITH n AS (SELECT count(*) FROM customer)
SELECT 'parquet' AS format, 'c_acctbal' AS column_name, 'type_mismatch' AS problem, 'int64' AS expected_type, 'float64' AS actual_type FROM n
UNION ALL SELECT 'csv', 'c_phone', 'missing_in_target', 'string', NULL FROM n
UNION ALL SELECT 'csv', 'c_mktsegment', 'extra_in_target', NULL, 'string' FROM n
UNION ALL SELECT 'json', 'c_custkey', 'type_mismatch', 'int64', 'string' FROM n""",
)
def format_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Written files parsed strictly and held against an expected schema."""
    customer = table(spark, folder, "customer")
    text = {c: "string" for c in customer.columns}
    expected = {
        "parquet": {"c_custkey": "int64", "c_name": "string", "c_nationkey": "int", "c_acctbal": "bigint", "c_mktsegment": "string"},
        "csv": {**{c: t for c, t in text.items() if c != "c_mktsegment"}, "c_phone": "str"},
        "json": {**text, "c_custkey": "long"},
    }
    parts = []
    for fmt, schema in expected.items():
        path = K.write_table(customer, scratch_path(spark, "validate"), fmt)
        parts.append(R.validate_files(spark, path, fmt, schema).withColumn("format", F.lit(fmt)))
    return R.union_all(parts)
