import pytest
from pyspark.sql import functions as F

from tallyframe.operators import coverage as V
from tallyframe.operators import history as H
from tallyframe.operators import schemas as S
from tallyframe.operators import search as Q
from tallyframe.plans import jobs as J

ROWS = [
    ("orders", "amount", "value_diff", {"id": "1042"}, "100.00", "100.01"),
    ("orders", "<row>", "missing_in_target", {"id": "7"}, "present", "missing"),
    ("invoices", "status", "value_diff", {"id": "9"}, "two words", None),
    ("invoices", "notes", "value_diff", {"id": "11"}, "words two", "x"),
]
# Golden queries of the search box, as (query, columns found).
SEARCHES = [
    ("", ["amount", "<row>", "status", "notes"]), ("amount", ["amount"]), ("100.01", ["amount"]), ("1042", ["amount"]),
    ("col:amount", ["amount"]), ("column:status", ["status"]), ("col:orders", []), ("test:orders", ["amount", "<row>"]),
    ("type:missing", ["<row>"]), ("key:9", ["status"]), ("src:present", ["<row>"]), ("tgt:missing", ["<row>"]),
    ("src:100.01", []), ("val:100.01", ["amount"]), ('"two words"', ["status"]), ("two words", ["status", "notes"]),
    ("orders -type:missing", ["amount"]), ("-col:amount", ["<row>", "status", "notes"]), ("AMOUNT", ["amount"]),
    ("col:AMOUNT", ["amount"]), ("nothingmatches", []),
]


def test_search(spark):
    df = spark.createDataFrame(
        ROWS, "test_name string, column_name string, mismatch_type string, key_values map<string,string>, "
        "source_value string, target_value string",
    ).cache()
    for query, expected in SEARCHES:
        assert sorted(r.column_name for r in Q.search(df, query).collect()) == sorted(expected), query
    paired = df.withColumn("key_values", F.map_concat("key_values", F.create_map(F.lit("__pair__"), F.lit("region=west"))))
    assert Q.search(paired, "pair:west").count() == 4 and Q.search(paired, "key:west").count() == 0
    assert Q.parse("""note:"a b" src:'x y' -"c d" don't "open col:""" + '""') == [
        Q.Term("any", 'note:"a b"', False), Q.Term("src", "x y", False), Q.Term("any", "c d", True),
        Q.Term("any", "don't", False), Q.Term("any", "open col:", False), Q.Term("any", '"', False)]
    assert Q.parse("http://host col: -")[0] == Q.Term("any", "http://host", False)


def test_tables_in_sql(spark):
    cases = {
        "SELECT * FROM dbo.Orders o JOIN [Sales].[Line Items] l ON 1=1": ["dbo.orders", "sales.line items"],
        'with a as (select 1 from x), b AS (select 2 from "Y") select * from a join b': ["x", "y"],
        "": [],
        "select * from (select 1) s": [],
        "select 'from hidden', x -- from gone\nfrom a . b /* join c */ left join \"D d\".[e]]": ["a.b", "d d.e"],
        "with recursive t as (select 1 union all select 2 from T join u) select * from t, v": ["u"],
    }
    for sql, expected in cases.items():
        got = spark.range(1).select(V.referenced_tables(F.lit(sql)).alias("t")).first().t
        assert sorted(got) == expected


def test_flat_history_drifts_on_any_change(spark):
    rows = [("a", f"r{i}", f"2024-01-0{i}", v) for i, v in enumerate([1.0, 1.0, 1.0, 0.5], 1)]
    rows += [("b", "r1", "2024-01-01", 1.0), ("b", "r2", "2024-01-02", 9.0)]
    points = spark.createDataFrame(rows, "job_name string, run_id string, completed_at string, value double")
    got = {r.job_name: r.drift_detected for r in H.trend_drift(points).collect()}
    assert got == {"a": True, "b": False}


def test_plain_number_text(spark):
    values = spark.createDataFrame([("9.0",), ("9",), ("9.50",), ("x.0",), ("-3.00",)], "v string")
    assert [r[0] for r in values.select(H.plain_number_text(F.col("v"))).collect()] == ["9", "9", "9.50", "x.0", "-3"]


def test_empty_reports_fail(spark):
    empty = spark.createDataFrame([], "test_name string, status string, source_row_count int, target_row_count int, total_issues int")
    row = H.report_stats_result(empty, empty).first()
    assert (row.status, row.value_mismatch_count) == ("FAILED", 1)


def test_first_snapshot_passes(spark):
    one = S.snapshot(spark.range(1))
    assert S.snapshot_verdict(one, None) == "PASSED"
    assert S.snapshot_verdict(one, one) == "PASSED"
    assert S.snapshot_verdict(one, S.snapshot(spark.range(1).withColumn("x", F.lit(1)))) == "FAILED"
    assert S.compatibility(S.schema_diff(one, one)).first().compatibility == "full"


def test_daily_revenue_case(spark):
    orders = spark.createDataFrame(
        [("2024-07-01", 60.0, "paid"), ("2024-07-01", 40.0, "paid"), ("2024-07-02", 75.0, "paid"), ("2024-07-02", 5.0, "void")],
        "order_date string, amount double, status string",
    )
    expected = spark.createDataFrame([("2024-07-01", 100.0), ("2024-07-02", 75.0)], "order_date string, revenue double")
    case = J.TransformCase(
        "SELECT order_date, sum(amount) AS revenue FROM orders WHERE status = 'paid' GROUP BY order_date",
        {"orders": orders}, expected, ["order_date"],
    )
    assert case.run().summary().first().status == "PASSED"
    assert not spark.catalog.tableExists("orders")


def test_pass_sql_error_is_a_violation(spark):
    results = spark.createDataFrame(
        [("PASSED", 5, 0, 0, 0)],
        "status string, source_row_count int, value_mismatch_count int, missing_in_target_count int, missing_in_source_count int",
    )
    row = J.apply_pass_condition(results, J.PassCondition(pass_sql="SELECT * FROM nowhere")).first()
    assert row.status == "FAILED" and row.violations[0].startswith("pass_sql failed")
    assert J.apply_pass_condition(results, J.PassCondition(min_row_count=5)).first().status == "PASSED"


def test_missing_target_is_skipped():
    assert J.compare_pages(None, "x", None, None) is None


@pytest.mark.parametrize("rows,status", [([], "PASSED"), ([(None,)], "FAILED"), ([("2024-01-01 00:00:00",)], "FAILED")])
def test_freshness(spark, rows, status):
    df = spark.createDataFrame(rows, "at string")
    assert H.freshness(df, "at", 24, "2024-01-03 00:00:00").first().status == status


def test_history_is_stored_once(spark, tmp_path):
    """A retry replaces its own run, and a writer that fails half-way leaves the table as it was."""
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from tallyframe.sources import sinks

    store = str(tmp_path / "history")
    first, second = spark.range(10), spark.range(100, 103)
    for run, rows in (("r1", first), ("r2", second), ("r1", first), ("r1", first)):
        sinks.append_history(rows, store, run)
    stored = lambda: sorted((r.run_id, r.id) for r in spark.read.parquet(store).collect())
    want = sorted([("r1", k) for k in range(10)] + [("r2", k) for k in range(100, 103)])
    assert stored() == want
    failing = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") < 700, F.col("id")).otherwise(F.raise_error("gone").cast("bigint")).alias("id"))
    with pytest.raises(PySparkException):
        sinks.append_history(failing, store, "r2")
    assert stored() == want
    sinks.append_history(spark.range(5), store, "r2")
    assert [k for run, k in stored() if run == "r2"] == list(range(5))
    jobs = str(tmp_path / "jobs")
    for job in ("a", "b", "a"):
        sinks.append_history(first, jobs, "r1", job)
    assert spark.read.parquet(jobs).count() == 20
