import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.profile import profile
from tallyframe.operators.rules import Rule, evaluate, java_pattern


def fires(df, rule, views=None):
    found = evaluate(df, [rule], views)
    return found[0].actual_value if found else None


@pytest.mark.parametrize("seed", range(3))
def test_rules_against_plain_python(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([None, rng.randint(-5, 5)]) for _ in range(rng.randint(1, 20))]
    words = [rng.choice([None, " a", "a ", "abc", "x1", "\tz", "10", "a\nb"]) for _ in values]
    df = spark.createDataFrame(list(zip(values, words)), "v int, w string")
    known = [v for v in values if v is not None]
    texts = [w for w in words if w is not None]
    expected = [
        (Rule("not_null", "v"), values.count(None)),
        (Rule("unique", "v"), len(values) - len(set(values))),
        (Rule("positive_values", "v"), sum(v is None or v <= 0 for v in values)),
        (Rule("negative_values", "v"), sum(v is None or v >= 0 for v in values)),
        (Rule("column_value_between", "v", min_value=-2, max_value=3), sum(not -2 <= v <= 3 for v in known)),
        (Rule("column_max_length", "w", max_value=2), sum(len(w) > 2 for w in texts)),
        (Rule("column_min_length", "w", min_value=3), sum(len(w) < 3 for w in texts)),
        (Rule("no_whitespace", "w"), sum(w != w.strip() for w in texts)),
        (Rule("column_contains", "w", pattern="a"), sum("a" not in w for w in texts)),
        (Rule("match_regex", "w", pattern="[a-z]"), sum(not re.match("[a-z]", str(w)) for w in words)),
        (Rule("pii_mask_check", "w", pattern=r"\w\d"), sum(bool(re.match(r"\w\d", str(w))) for w in words)),
        (Rule("value_in_set", "w", sql="abc, x1"), sum(str(w) not in ("abc", "x1") for w in words)),
        (Rule("value_not_in_set", "w", values=("abc", "None")), sum(str(w) in ("abc", "None") for w in words)),
        (Rule("column_type_check", "w", expected_type="int"), sum(w != "10" for w in texts)),
    ]
    found = {v.rule_index: v.actual_value for v in evaluate(df, [r for r, _ in expected])}
    assert found == {i: n for i, (_, n) in enumerate(expected) if n}


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-03-01",), ("soon",), (None,)], "d string")
    assert fires(df, Rule("date_range", "d", min_date="2024-01-01", max_date="2024-02-01")) == 3
    assert fires(df, Rule("date_range", "d")) == 2
    assert fires(df, Rule("column_type_check", "d", expected_type="date")) == 1


def test_regex_dialect(spark):
    assert java_pattern("(?P<year_no>\\d+)-(?P=year_no)\\Z") == r"(?U)\A(?:(?<yearno>\d+)-\k<yearno>\z)"
    assert java_pattern("(") is None
    df = spark.createDataFrame([("12-12",), ("12-13",)], "w string")
    assert fires(df, Rule("match_regex", "w", pattern="(?P<a_b>\\d+)-(?P=a_b)\\Z")) == 1
    assert fires(df, Rule("match_regex", "w", pattern="(")) is None


def test_absent_column_and_empty_table(spark):
    df = spark.createDataFrame([], "v double")
    assert evaluate(df, [Rule("not_null", "x"), Rule("completeness_ratio", "v", min_value=1)]) == []
    assert math.isnan(fires(df, Rule("column_mean_between", "v", min_value=0)) or math.nan)
    assert len(evaluate(df, [Rule("column_percentile", "v", percentile=50, min_value=0)])) == 1


def test_lookup_counts_rows(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    look = spark.createDataFrame([("a",)], "code string")
    assert fires(df, Rule("referential_check", "k", lookup_query="SELECT code FROM look"), {"look": look}) == 2


def test_sql_assert(spark):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    assert fires(df, Rule("custom_sql_assert", sql="SELECT sum(v) FROM t", operator="<=", min_value=2), {"t": df}) == 3.0
    broken = evaluate(df, [Rule("custom_sql_assert", sql="SELECT * FROM nowhere", operator="==", severity="warn")])
    assert broken[0].severity == "warn" and broken[0].actual_value is None


def test_flat_rolling_window(spark):
    df = spark.createDataFrame([(i, 5.0 if i != 8 else 6.0) for i in range(12)], "i int, v double")
    assert fires(df, Rule("anomaly_detection_sigma", "v", window=3, order_by=["i"])) == 1
    with pytest.raises(ValueError):
        fires(df, Rule("anomaly_detection_sigma", "v"))


def test_normality(spark):
    rng = random.Random(1)
    normal = spark.createDataFrame([(rng.gauss(0, 1),) for _ in range(400)], "v double")
    skewed = spark.createDataFrame([(rng.expovariate(1),) for _ in range(400)], "v double")
    for kind in ("distribution_ks_test", "distribution_anderson_darling"):
        assert fires(normal, Rule(kind, "v")) is None
        assert fires(skewed, Rule(kind, "v")) is not None
    assert fires(skewed, Rule("distribution_ks_test", "v", distribution="exp")) is None
    assert fires(normal, Rule("distribution_chi_square", "v", bins=3, expected_frequencies=[1, 1])) is None


def test_approximate_profile(spark):
    df = spark.range(1000).withColumn("w", F.lit("x"))
    rows = {r.column_name: r for r in profile(df, approximate=True).collect()}
    assert rows["id"].p50 == pytest.approx(499.5, abs=1) and rows["w"].distinct_count == 1
