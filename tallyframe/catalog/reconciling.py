"""Reconciliation queries: the drifted orders and tables with repeated or null keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.catalog import query
from tallyframe.catalog.fixtures import (
    ORDER_COLUMNS, ORDERS_SQL, differs_sql, orders_source, orders_target, table,
)
from tallyframe.operators.reconcile import Comparison, CompareOptions, reconcile, same_content

COUNTS = [
    "source_row_count", "target_row_count", "matched_count", "missing_in_target_count",
    "missing_in_source_count", "value_mismatch_count", "status",
]


def _orders(spark: SparkSession, folder: str, **options) -> Comparison:
    options.setdefault("key_columns", ["o_orderkey"])
    return Comparison(
        orders_source(spark, folder), orders_target(spark, folder), CompareOptions(**options)
    )


def _differences(overrides: dict[str, str] | None = None, tolerance: float = 1e-9,
                 skip: tuple[str, ...] = ()) -> dict[str, str]:
    out = {}
    for c in ORDER_COLUMNS:
        if c not in skip:
            out[c] = differs_sql(c, tolerance if c == "o_totalprice" else None)
    out.update(overrides or {})
    return out


def _counts_sql(ctes: str, on: str, diffs: dict[str, str], key: str = "o_orderkey",
                where_s: str = "true", where_t: str = "true") -> str:
    total = " + ".join(diffs.values())
    return f"""
WITH {ctes},
s0 AS (SELECT *, 1 AS present FROM src WHERE {where_s}),
t0 AS (SELECT *, 1 AS present FROM tgt WHERE {where_t}),
j AS (
  SELECT s.present AS in_s, t.present AS in_t,
         CASE WHEN s.present = 1 AND t.present = 1 THEN {total} ELSE 0 END AS bad
  FROM s0 s FULL OUTER JOIN t0 t ON {on}),
c AS (
  SELECT count(*) FILTER (WHERE in_s = 1 AND in_t = 1) AS matched_count,
         count(*) FILTER (WHERE in_t IS NULL) AS missing_in_target_count,
         count(*) FILTER (WHERE in_s IS NULL) AS missing_in_source_count,
         CAST(coalesce(sum(bad), 0) AS BIGINT) AS value_mismatch_count
  FROM j)
SELECT (SELECT count(*) FROM s0) AS source_row_count, (SELECT count(*) FROM t0) AS target_row_count,
       c.*, CASE WHEN missing_in_target_count + missing_in_source_count + value_mismatch_count = 0
                 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM c"""


_ON = "s.o_orderkey = t.o_orderkey"


@query("reconcile_orders_summary", _counts_sql(ORDERS_SQL, _ON, _differences()))
def reconcile_orders_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).summary().select(*COUNTS)


def _records_sql() -> str:
    parts = [
        """SELECT s.o_orderkey, '<row>' AS column_name, 'present' AS source_value, 'missing' AS target_value,
        'missing_in_target' AS mismatch_type, NULL AS delta, NULL AS relative_delta
        FROM src s WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE t.o_orderkey = s.o_orderkey)""",
        """SELECT t.o_orderkey, '<row>', 'missing', 'present', 'missing_in_source', NULL, NULL
        FROM tgt t WHERE NOT EXISTS (SELECT 1 FROM src s WHERE t.o_orderkey = s.o_orderkey)""",
    ]
    for c, diff in _differences().items():
        numeric = c in ("o_totalprice", "o_custkey")
        d = f"CAST(t.{c} - s.{c} AS DOUBLE)" if numeric else "NULL"
        r = f"CAST(t.{c} - s.{c} AS DOUBLE) / nullif(s.{c}, 0)" if numeric else "NULL"
        parts.append(
            f"SELECT s.o_orderkey, '{c}', CAST(s.{c} AS VARCHAR), CAST(t.{c} AS VARCHAR), 'value_diff', {d}, {r} "
            f"FROM src s JOIN tgt t ON {_ON} WHERE {diff} = 1"
        )
    return " UNION ALL ".join(parts)


@query(
    "reconcile_orders_records",
    f"""WITH {ORDERS_SQL}, r AS ({_records_sql()})
SELECT '{{"o_orderkey":"' || o_orderkey || '"}}' AS key_values, column_name, source_value, target_value,
       mismatch_type, round(delta, 4) AS delta, round(relative_delta, 9) AS relative_delta FROM r""",
)
def reconcile_orders_records(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).records().select(
        F.to_json("key_values").alias("key_values"), "column_name", "source_value", "target_value",
        "mismatch_type", F.round("delta", 4).alias("delta"),
        F.round("relative_delta", 9).alias("relative_delta"),
    )


@query(
    "reconcile_records_capped",
    f"""WITH {ORDERS_SQL}, r AS ({_records_sql()})
SELECT o_orderkey, column_name, source_value, target_value, mismatch_type FROM r
ORDER BY CASE mismatch_type WHEN 'missing_in_target' THEN 0 WHEN 'missing_in_source' THEN 1 ELSE 2 END,
         CASE column_name WHEN 'o_custkey' THEN 1 WHEN 'o_orderstatus' THEN 2 WHEN 'o_totalprice' THEN 3
              WHEN 'o_orderdate' THEN 4 WHEN 'o_orderpriority' THEN 5 ELSE 0 END, o_orderkey
LIMIT 500""",
)
def reconcile_records_capped(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).records(limit=500).select(
        F.col("key_values")["o_orderkey"].cast("bigint").alias("o_orderkey"),
        "column_name", "source_value", "target_value", "mismatch_type",
    )


def _by_column_sql() -> str:
    columns = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(sum({d}) AS BIGINT) AS mismatch_count, count(*) AS compared_rows "
        f"FROM src s JOIN tgt t ON {_ON}"
        for c, d in _differences().items()
    )
    return f"""WITH {ORDERS_SQL}, k AS (
  SELECT count(*) AS n FROM src s FULL OUTER JOIN tgt t ON {_ON}
  WHERE s.o_orderkey IS NULL OR t.o_orderkey IS NULL),
  bc AS ({columns} UNION ALL SELECT '<row>', n, n FROM k WHERE n > 0)"""


@query("reconcile_by_column", f"{_by_column_sql()} SELECT * FROM bc")
def reconcile_by_column(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).by_column().drop("ordinal")


@query(
    "match_pct",
    f"""{_by_column_sql()} SELECT *, greatest(round(100 * (1 - mismatch_count / compared_rows), 4), 0) AS match_pct
FROM bc""",
)
def match_pct(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).match_percent()


@query(
    "mismatch_by_type",
    f"""WITH {ORDERS_SQL}, r AS ({_records_sql()})
SELECT mismatch_type, count(*) AS mismatch_count FROM r GROUP BY 1""",
)
def mismatch_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).by_type()


@query(
    "reconcile_tolerance",
    _counts_sql(
        ORDERS_SQL, _ON,
        _differences({
            "o_orderdate": "CASE WHEN abs(epoch_us(s.o_orderdate) - epoch_us(t.o_orderdate)) <= 1000000 THEN 0 ELSE 1 END"
        }, tolerance=0.01),
    ),
)
def reconcile_tolerance(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(
        spark, folder, float_tolerance=1e-9, column_tolerances={"o_totalprice": 0.01},
        datetime_tolerance_seconds=1.0,
    ).summary().select(*COUNTS)


_TIDY_S = "trim(regexp_replace(s.o_orderpriority, '\\s+', ' ', 'g'))"


@query(
    "reconcile_case_ws",
    _counts_sql(
        ORDERS_SQL, _ON,
        _differences({
            "o_orderpriority": f"CASE WHEN lower({_TIDY_S}) = lower({_TIDY_S.replace('s.o_', 't.o_')}) THEN 0 ELSE 1 END"
        }),
    ),
)
def reconcile_case_ws(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(
        spark, folder, case_insensitive_columns=["o_orderpriority"],
        whitespace_columns=["o_orderpriority"],
    ).summary().select(*COUNTS)


@query(
    "reconcile_excluded",
    _counts_sql(ORDERS_SQL, _ON, _differences(skip=("o_totalprice", "o_orderdate"))),
)
def reconcile_excluded(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(
        spark, folder, exclude_columns=["O TotalPrice", "o-order-date"]
    ).summary().select(*COUNTS)


@query(
    "reconcile_incremental",
    _counts_sql(
        ORDERS_SQL, _ON, _differences(),
        where_s="o_orderdate IS NULL OR o_orderdate >= TIMESTAMP '1998-01-01'",
        where_t="o_orderdate IS NULL OR o_orderdate >= TIMESTAMP '1998-01-01'",
    ),
)
def reconcile_incremental(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(
        spark, folder, change_column="o_orderdate", since="1998-01-01 00:00:00"
    ).summary().select(*COUNTS)


_BOTH_NULL = "CASE WHEN s.o_orderstatus = t.o_orderstatus THEN 0 ELSE 1 END"


@query(
    "reconcile_nulls_differ",
    _counts_sql(ORDERS_SQL, _ON, _differences({"o_orderstatus": _BOTH_NULL})),
)
def reconcile_nulls_differ(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder, null_equals_null=False).summary().select(*COUNTS)


_NULL_KEY_SQL = """
src AS (SELECT nullif(c_custkey % 50, 0) AS k, max(c_acctbal) AS bal, max(c_name) AS name FROM customer GROUP BY 1),
tgt AS (SELECT nullif(c_custkey % 50, 0) AS k, max(c_acctbal) + CASE WHEN nullif(c_custkey % 50, 0) % 7 = 0 THEN 1 ELSE 0 END
          AS bal, max(c_name) AS name
        FROM customer WHERE c_custkey % 50 <> 3 GROUP BY 1, nullif(c_custkey % 50, 0) % 7)
"""


@query(
    "reconcile_null_keys",
    _counts_sql(
        _NULL_KEY_SQL, "s.k IS NOT DISTINCT FROM t.k",
        {"bal": differs_sql("bal", 1e-9), "name": differs_sql("name")},
    ),
)
def reconcile_null_keys(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    k = F.nullif(F.col("c_custkey") % 50, F.lit(0))
    source = customer.groupBy(k.alias("k")).agg(
        F.max("c_acctbal").alias("bal"), F.max("c_name").alias("name")
    )
    target = (
        customer.where(F.col("c_custkey") % 50 != 3).groupBy(k.alias("k"))
        .agg(F.max("c_acctbal").alias("bal"), F.max("c_name").alias("name"))
        .withColumn("bal", F.when(F.col("k") % 7 == 0, F.col("bal") + 1).otherwise(F.col("bal")))
    )
    return Comparison(source, target, CompareOptions(key_columns=["k"])).summary().select(*COUNTS)


_LINE_COLUMNS = ["l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"]
_LINES_SQL = """
src AS (SELECT * FROM lineitem),
tgt AS (SELECT * REPLACE (CASE WHEN l_partkey % 11 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
                          CASE WHEN l_suppkey % 13 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag)
        FROM lineitem WHERE l_orderkey % 89 <> 0)
"""


def _line_pair(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, folder, "lineitem")
    drifted = lines.where(F.col("l_orderkey") % 89 != 0).withColumn(
        "l_quantity",
        F.when(F.col("l_partkey") % 11 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")),
    ).withColumn(
        "l_returnflag",
        F.when(F.col("l_suppkey") % 13 == 0, F.lit("X")).otherwise(F.col("l_returnflag")),
    )
    return lines, drifted


def _line_differences(columns: list[str]) -> dict[str, str]:
    floats = {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}
    return {c: differs_sql(c, 1e-9 if c in floats else None) for c in columns}


_ALL_LINE_COLUMNS = [
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


@query(
    "reconcile_composite_key",
    _counts_sql(
        _LINES_SQL, "s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber",
        _line_differences(_ALL_LINE_COLUMNS),
    ),
)
def reconcile_composite_key(spark: SparkSession, folder: str) -> DataFrame:
    source, target = _line_pair(spark, folder)
    return Comparison(
        source, target, CompareOptions(key_columns=["l_orderkey", "l_linenumber"])
    ).summary().select(*COUNTS)


@query(
    "duplicate_keys",
    """WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS m,
         count(*) FILTER (WHERE l_orderkey % 89 <> 0) AS n FROM lineitem GROUP BY 1, 2)
SELECT CAST(sum(CASE WHEN m > 1 THEN m - 1 ELSE 0 END) AS BIGINT) AS duplicate_keys_source,
       CAST(sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS duplicate_keys_target FROM k""",
)
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    source, target = _line_pair(spark, folder)
    return Comparison(
        source, target, CompareOptions(key_columns=["l_orderkey", "l_linenumber"])
    ).summary().select("duplicate_keys_source", "duplicate_keys_target")


# A third of all rows share one key on both sides, and a tolerance spans many of
# their values; the check multiplies the pairs out.
_HOT_SQL = """
src AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_orderkey END AS k, o_orderstatus AS status,
               o_totalprice AS price, o_orderdate AS day FROM orders),
tgt AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_orderkey END AS k,
               CASE WHEN o_orderkey % 53 <> 0 THEN o_orderstatus END AS status,
               CASE WHEN o_orderkey % 31 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price,
               o_orderdate AS day FROM orders WHERE o_orderkey % 97 <> 0)
"""
_HOT_DIFFS = {
    "status": differs_sql("status"), "price": differs_sql("price", 1500.25),
    "day": "CASE WHEN abs(epoch_us(s.day) - epoch_us(t.day)) <= 172800000000 THEN 0 ELSE 1 END",
}


def _hot_pair(spark: SparkSession, folder: str) -> Comparison:
    orders = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    key = F.when(k % 3 == 0, F.lit(-1)).otherwise(k).alias("k")
    source = orders.select(
        key, F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("day"),
    )
    target = orders.where(k % 97 != 0).select(
        key, F.when(k % 53 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(k % 31 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("price"),
        F.col("o_orderdate").alias("day"),
    )
    return Comparison(
        source, target,
        CompareOptions(key_columns=["k"], float_tolerance=1500.25, datetime_tolerance_seconds=172800.0,
                       heavy_pairs=10_000),
    )


@query("reconcile_heavy_key", _counts_sql(_HOT_SQL, "s.k = t.k", _HOT_DIFFS))
def reconcile_heavy_key(spark: SparkSession, folder: str) -> DataFrame:
    return _hot_pair(spark, folder).summary().select(*COUNTS)


@query(
    "reconcile_heavy_key_records",
    f"""WITH {_HOT_SQL}, j AS (
  SELECT {_HOT_DIFFS['status']} AS status, {_HOT_DIFFS['price']} AS price, {_HOT_DIFFS['day']} AS day
  FROM src s JOIN tgt t ON s.k = t.k)
SELECT 'status' AS column_name, 'value_diff' AS mismatch_type, CAST(sum(status) AS BIGINT) AS pairs FROM j
UNION ALL SELECT 'price', 'value_diff', CAST(sum(price) AS BIGINT) FROM j
UNION ALL SELECT 'day', 'value_diff', CAST(sum(day) AS BIGINT) FROM j
UNION ALL SELECT '<row>', 'missing_in_target', count(*) FROM src s
  WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE s.k = t.k)""",
)
def reconcile_heavy_key_records(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _hot_pair(spark, folder).records().groupBy("column_name", "mismatch_type")
        .agg(F.sum("pair_count").alias("pairs")).where("pairs > 0")
    )


@query(
    "reconcile_heavy_key_units",
    f"""WITH {_HOT_SQL}, j AS (SELECT s.k, s.status, t.status AS other, s.price, t.price AS cost,
    {_HOT_DIFFS['status']} AS bad_status, {_HOT_DIFFS['price']} AS bad_price FROM src s JOIN tgt t ON s.k = t.k)
SELECT k, 'status' AS column_name, status AS source_text, min(other) AS target_text, CAST(NULL AS DOUBLE) AS source_number,
  CAST(NULL AS DOUBLE) AS target_number, CAST(NULL AS DOUBLE) AS delta, count(*) AS pair_count FROM j WHERE bad_status = 1 GROUP BY k, status
UNION ALL SELECT k, 'price', NULL, NULL, price, min(cost), round(min(cost) - price, 4), count(*) FROM j WHERE bad_price = 1 GROUP BY k, price""",
)
def reconcile_heavy_key_units(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the heavy and the light keys with its smallest target value, row by row."""
    units = _hot_pair(spark, folder).records().where("column_name in ('status', 'price')")
    number = F.col("column_name") == "price"
    return units.select(
        F.col("key_values")["k"].cast("bigint").alias("k"), "column_name",
        F.when(~number, F.col("source_value")).alias("source_text"), F.when(~number, F.col("target_value")).alias("target_text"),
        F.when(number, F.col("source_value").try_cast("double")).alias("source_number"),
        F.when(number, F.col("target_value").try_cast("double")).alias("target_number"),
        F.round("delta", 4).alias("delta"), "pair_count",
    )


@query(
    "checksum_first",
    """WITH orders2 AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS a,
    CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS b FROM orders)
SELECT 'moved' AS target, count(*) AS matched_count, CAST(2 * count(*) AS BIGINT) AS value_mismatch_count, 'FAILED' AS status FROM orders2
UNION ALL SELECT 'same', count(*), CAST(0 AS BIGINT), 'PASSED' FROM orders2
UNION ALL SELECT 'repeated', CAST(count(*) + 3 * count(*) FILTER (WHERE k % 10 = 0) AS BIGINT),
  CAST(2 * count(*) FILTER (WHERE k % 10 = 0) AS BIGINT), 'FAILED' FROM orders2""",
)
def checksum_first(spark: SparkSession, folder: str) -> DataFrame:
    """Nulls that change columns, equal tables, and repeated keys whose rows differ, under the checksum option."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    orders = table(spark, folder, "orders").select(
        k.alias("k"), F.when(k % 2 == 0, status).alias("a"), F.when(k % 2 == 1, status).alias("b")
    )
    moved = orders.select("k", F.col("b").alias("a"), F.col("a").alias("b"))
    twice = orders.unionByName(orders.where("k % 10 = 0").withColumn("a", F.lit("other")))
    options = CompareOptions(key_columns=["k"])
    parts = [
        reconcile(orders, moved, options, checksum_first=True).withColumn("target", F.lit("moved")),
        reconcile(orders, orders.repartition("a"), options, checksum_first=True).withColumn("target", F.lit("same")),
        reconcile(twice, twice, options, checksum_first=True).withColumn("target", F.lit("repeated")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(
        "target", "matched_count", "value_mismatch_count", "status"
    )


_POSITIONAL_COLUMNS = ["o_orderstatus", "o_orderpriority", "o_totalprice"]


@query(
    "reconcile_positional",
    _counts_sql(
        """
src AS (SELECT o_orderstatus, o_orderpriority, round(o_totalprice, -4) AS o_totalprice,
          row_number() OVER (ORDER BY o_orderstatus NULLS FIRST, o_orderpriority NULLS FIRST, round(o_totalprice, -4) NULLS FIRST) AS k
        FROM orders),
tgt AS (SELECT o_orderstatus, o_orderpriority, p AS o_totalprice,
          row_number() OVER (ORDER BY o_orderstatus NULLS FIRST, o_orderpriority NULLS FIRST, p NULLS FIRST) AS k
        FROM (SELECT CASE WHEN o_orderkey % 53 <> 0 THEN o_orderstatus END AS o_orderstatus, o_orderpriority,
                CASE WHEN o_orderkey % 31 = 0 THEN round(o_totalprice, -4) + 1 ELSE round(o_totalprice, -4) END AS p
              FROM orders WHERE o_orderkey % 97 <> 0))
""",
        "s.k = t.k",
        {c: differs_sql(c, 1e-9 if c == "o_totalprice" else None) for c in _POSITIONAL_COLUMNS},
    ),
)
def reconcile_positional(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("o_totalprice", F.round("o_totalprice", -4))
    k = F.col("o_orderkey")
    source = orders.select(*_POSITIONAL_COLUMNS)
    target = orders.where(k % 97 != 0).select(
        F.when(k % 53 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority",
        F.when(k % 31 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
    )
    return Comparison(source, target).summary().select(*COUNTS)


@query(
    "positional_row_number",
    """SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey NULLS FIRST, o_orderkey NULLS FIRST) AS row_no
FROM orders""",
)
def positional_row_number(spark: SparkSession, folder: str) -> DataFrame:
    from tallyframe.functions.ranks import with_row_number

    return with_row_number(table(spark, folder, "orders"), ["o_custkey", "o_orderkey"], "row_no")


@query(
    "reconcile_sampled",
    """SELECT CAST(0 AS BIGINT) AS invented_missing, true AS near_fraction, true AS subset_of_full
FROM orders HAVING count(*) > 0""",
)
def reconcile_sampled(spark: SparkSession, folder: str) -> DataFrame:
    """A sampled run reports only what the full run reports."""
    full = _orders(spark, folder)
    sampled = _orders(spark, folder, sample_fraction=0.2, sample_seed=7)
    key = [F.to_json("key_values").alias("k"), "column_name", "mismatch_type"]
    extra = sampled.records().select(*key).join(
        full.records().select(*key), ["k", "column_name", "mismatch_type"], "left_anti"
    ).agg(F.count(F.lit(1)).alias("extra"), F.count_if(F.col("column_name") == "<row>").alias("rows"))
    share = sampled.census.source_rows / max(full.census.source_rows, 1)
    return extra.select(
        F.col("rows").alias("invented_missing"),
        F.lit(0.15 < share < 0.25).alias("near_fraction"),
        (F.col("extra") == 0).alias("subset_of_full"),
    )


_SAME = """SELECT NOT EXISTS ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL
  (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS identical"""


@query(
    "checksum_precheck",
    f"""SELECT 'copy' AS target, s.*, (SELECT count(*) FROM orders) AS source_row_count,
        (SELECT count(*) FROM orders) AS target_row_count
FROM (WITH a AS (FROM orders), b AS (FROM orders) {_SAME}) s
UNION ALL
SELECT 'drifted', s.*, (SELECT count(*) FROM orders),
       (SELECT count(*) FROM orders WHERE o_orderkey % 97 <> 0) + (SELECT count(*) FROM orders WHERE o_orderkey % 101 = 0)
FROM (WITH {ORDERS_SQL}, a AS (FROM orders), b AS (FROM tgt) {_SAME}) s""",
)
def checksum_precheck(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    shuffled = orders.repartition("o_custkey")
    copy = same_content(orders, shuffled).withColumn("target", F.lit("copy"))
    drifted = same_content(orders, orders_target(spark, folder)).withColumn("target", F.lit("drifted"))
    return copy.unionByName(drifted).select("target", "identical", "source_row_count", "target_row_count")


@query(
    "schema_mismatch",
    """WITH c AS (SELECT DISTINCT unnest(['o_clerk']) AS column_name, 'missing_in_target' AS side
  UNION ALL SELECT 'o_comment', 'extra_in_target')
SELECT c.*, (SELECT count(*) FROM orders) AS matched_count FROM c""",
)
def schema_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    c = Comparison(
        orders.withColumn("o_clerk", F.lit("c")), orders.withColumn("o_comment", F.lit("d")),
        CompareOptions(key_columns=["o_orderkey"]),
    )
    rows = [(n, "missing_in_target") for n in c.missing_in_target]
    rows += [(n, "extra_in_target") for n in c.extra_in_target]
    return spark.createDataFrame(rows, "column_name string, side string").withColumn(
        "matched_count", F.lit(c.census.matched).cast("bigint")
    )


@query(
    "type_normalise",
    """SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS maybe_nan,
  CASE WHEN o_orderkey % 2 = 0 THEN upper(md5_id) ELSE o_orderpriority END AS tag
FROM (SELECT *, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 9, 4)
  || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 17, 4)
  || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 21, 12) AS md5_id FROM orders)""",
)
def type_normalise(spark: SparkSession, folder: str) -> DataFrame:
    from tallyframe.functions.cells import normalised

    k = F.col("o_orderkey")
    h = F.md5(k.cast("string"))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    raw = table(spark, folder, "orders").select(
        k, F.col("o_totalprice").cast("decimal(12,2)").alias("price"),
        F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(k.cast("double")).alias("maybe_nan"),
        F.when(k % 2 == 0, uuid).otherwise(F.col("o_orderpriority")).alias("tag"),
    )
    return normalised(raw)


@query(
    "reconcile_row_guard",
    """SELECT 2 * count(*) AS total_rows, 2 * count(*) > 1000 AS rejected FROM orders""",
)
def reconcile_row_guard(spark: SparkSession, folder: str) -> DataFrame:
    from tallyframe.operators.keys import RowLimitExceeded

    orders = table(spark, folder, "orders")
    total = 2 * orders.count()
    try:
        Comparison(orders, orders, CompareOptions(key_columns=["o_orderkey"], max_compare_rows=1000))
        rejected = False
    except RowLimitExceeded:
        rejected = True
    return spark.range(1).select(
        F.lit(total).cast("bigint").alias("total_rows"), F.lit(rejected).alias("rejected")
    )


@query(
    "reconcile_segments_carried",
    f"""WITH {ORDERS_SQL}
SELECT segment, count(*) AS records FROM (
  SELECT s.o_orderkey, coalesce(s.o_orderpriority, t.o_orderpriority) AS segment FROM src s
  FULL OUTER JOIN tgt t ON {_ON} WHERE s.o_orderkey IS NULL OR t.o_orderkey IS NULL
  UNION ALL SELECT s.o_orderkey, s.o_orderpriority FROM src s JOIN tgt t ON {_ON} WHERE {differs_sql('o_totalprice', 1e-9)} = 1
) GROUP BY 1""",
)
def reconcile_segments_carried(spark: SparkSession, folder: str) -> DataFrame:
    c = _orders(spark, folder, segment_columns=["o_orderpriority"])
    return (
        c.records().where("column_name in ('<row>', 'o_totalprice')")
        .groupBy(F.col("segment_values")["o_orderpriority"].alias("segment"))
        .agg(F.count(F.lit(1)).alias("records"))
    )
