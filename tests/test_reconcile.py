import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import keys as K
from tallyframe.operators.reconcile import Comparison, CompareOptions, reconcile
from tallyframe.operators.segments import segment_summary


def result(source, target, **options):
    return Comparison(source, target, CompareOptions(**options)).summary().first()


def test_three_orders(spark):
    s = spark.createDataFrame([(1, "A", 10.0), (2, "B", 20.0), (3, "C", 30.0)], "id int, sku string, amount double")
    t = spark.createDataFrame([(1, "A", 10.0), (2, "B", 25.0), (4, "D", 40.0)], "id int, sku string, amount double")
    r = result(s, t)
    assert (r.matched_count, r.missing_in_target_count, r.missing_in_source_count, r.value_mismatch_count) == (2, 1, 1, 1)
    assert r.status == "FAILED"
    records = Comparison(s, t).records().orderBy("mismatch_type").collect()
    assert [(x.mismatch_type, x.source_value, x.target_value, x.delta) for x in records] == [
        ("missing_in_source", "missing", "present", None), ("missing_in_target", "present", "missing", None),
        ("value_diff", "20.0", "25.0", 5.0),
    ]
    assert records[2].relative_delta == 0.25


def test_zero_source_has_no_relative_delta(spark):
    s = spark.createDataFrame([(1, 0.0)], "id int, v double")
    t = spark.createDataFrame([(1, 2.0)], "id int, v double")
    r = Comparison(s, t).records().first()
    assert (r.delta, r.relative_delta) == (2.0, None)


def test_nan_is_null(spark):
    s = spark.createDataFrame([(1, float("nan")), (2, float("nan"))], "id int, v double")
    t = spark.createDataFrame([(1, None), (2, 1.0)], "id int, v double")
    assert result(s, t).value_mismatch_count == 1
    assert result(s, t, null_equals_null=False).value_mismatch_count == 2


def test_infinities_and_ints(spark):
    inf = float("inf")
    s = spark.createDataFrame([(1, inf, 1), (2, inf, 2), (3, 1.0, 3)], "id int, v double, n int")
    t = spark.createDataFrame([(1, inf, 1), (2, -inf, 2), (3, 1.5, 4)], "id int, v double, n bigint")
    # the tolerance is for fractional columns only
    assert result(s, t, float_tolerance=1.0).value_mismatch_count == 2


def test_incompatible_types_never_match(spark):
    s = spark.createDataFrame([(1, "5"), (2, None)], "id int, v string")
    t = spark.createDataFrame([(1, 5), (2, None)], "id int, v int")
    assert result(s, t).value_mismatch_count == 1
    with pytest.raises(ValueError):
        Comparison(s, t, CompareOptions(key_columns=["v"]))


def test_nested_values(spark):
    s = spark.createDataFrame([(1, [1, 2], {"a": 1})], "id int, a array<int>, m map<string,int>")
    t = spark.createDataFrame([(1, [1, 3], {"a": 1})], "id int, a array<int>, m map<string,int>")
    assert [r.column_name for r in Comparison(s, t).records().collect()] == ["a"]


def test_key_resolution(spark):
    two = spark.createDataFrame([(1, "a")], "Id int, v string")
    assert Comparison(two, two).keys == ["Id"]
    lone = spark.createDataFrame([("a", 1)], "code string, n int")
    other = spark.createDataFrame([("a", 1)], "code string, m int")
    assert Comparison(lone, other).keys == ["code"]
    both = spark.createDataFrame([("a", 1)], "code string, n int")
    assert Comparison(both, both).keys == [K.ROW_KEY]
    named = spark.createDataFrame([(1, "a")], "Order_ID int, v string")
    assert Comparison(named, named, CompareOptions(ad_hoc_keys=True)).keys == ["Order_ID"]
    with pytest.raises(ValueError):
        Comparison(two, two, CompareOptions(key_columns=["nope"]))


def test_schema_policy(spark):
    s = spark.createDataFrame([(1, "a", 1)], "id int, v string, x int")
    t = spark.createDataFrame([(1, "a", 1)], "id int, v string, y int")
    assert Comparison(s, t).missing_in_target == ["x"]
    assert result(s, t).status == "PASSED"
    with pytest.raises(K.SchemaMismatch):
        Comparison(s, t, CompareOptions(schema_policy="error"))
    assert Comparison(s, t, CompareOptions(schema_policy="error", exclude_columns=["X", "y"])).columns == ["v"]


def test_row_limit_and_slow(spark):
    s = spark.range(10).withColumn("v", F.lit(1))
    with pytest.raises(K.RowLimitExceeded):
        Comparison(s, s, CompareOptions(max_compare_rows=19))
    c = Comparison(s, s, CompareOptions(max_compare_rows=20))
    assert c.summary(duration=9, max_duration=5).first().status == "SLOW"
    bad = Comparison(s, s.withColumn("v", F.lit(2)))
    row = bad.summary(duration=9, max_duration=5).first()
    assert (row.status, row.slow) == ("FAILED", True)


def test_cap_keeps_counts(spark):
    s = spark.range(50).withColumn("v", F.lit(1))
    t = spark.range(10, 60).withColumn("v", F.lit(2))
    c = Comparison(s, t)
    first = c.records(limit=12).collect()
    assert [r.mismatch_type for r in first] == ["missing_in_target"] * 10 + ["missing_in_source"] * 2
    assert c.summary().first().value_mismatch_count == 40
    assert c.records().count() == 60


def test_dotted_names(spark):
    s = spark.createDataFrame([(1, 2.0)], "id int, `a.b` double")
    t = spark.createDataFrame([(1, 3.0)], "id int, `a.b` double")
    assert Comparison(s, t).records().first().column_name == "a.b"


def test_checksum_first(spark):
    s = spark.range(20).withColumn("v", F.col("id") * 2.5)
    assert reconcile(s, s.repartition(3), CompareOptions(key_columns=["id"]), checksum_first=True).first().matched_count == 20
    # pairs of equal rows cancel in an xor, but not in the sum
    doubled = s.where("id < 2").unionAll(s.where("id < 2"))
    other = s.where("id in (2, 3)").unionAll(s.where("id in (2, 3)"))
    assert reconcile(doubled, other, CompareOptions(key_columns=["id"]), checksum_first=True).first().status == "FAILED"


def brute(source, target, equal, nulls_match):
    """Cell mismatches per column over all row pairs of equal keys."""
    wrong, pairs = {}, 0
    for (ks, vs), (kt, vt) in itertools.product(source, target):
        if ks != kt:
            continue
        pairs += 1
        for i, (a, b) in enumerate(zip(vs, vt)):
            if a is None or b is None:
                bad = not (a is None and b is None and nulls_match)
            else:
                bad = not equal[i](a, b)
            wrong[i] = wrong.get(i, 0) + bad
    return pairs, wrong


@pytest.mark.parametrize("seed,nulls_match,tolerance", [(2, False, 1.0), (3, True, 0.3)])
def test_heavy_keys_match_brute_force(spark, seed, nulls_match, tolerance):
    rng = random.Random(seed)

    def rows(n):
        out = []
        for _ in range(n):
            key = rng.choice(["hot", "hot", "hot", "warm", None, rng.choice("abcdef")])
            x = rng.choice([None, round(rng.uniform(-3, 3), 1), round(rng.uniform(-3, 3), 1)])
            out.append((key, (x, rng.choice([None, "p", "q", "r"]), rng.choice([None, rng.randint(0, 3)]))))
        return out

    s, t = rows(120), rows(90)
    schema = "k string, x double, c string, n int"
    sdf = spark.createDataFrame([(k, *v) for k, v in s], schema)
    tdf = spark.createDataFrame([(k, *v) for k, v in t], schema)
    options = dict(key_columns=["k"], float_tolerance=tolerance, null_equals_null=nulls_match)
    equal = [lambda a, b: abs(a - b) <= tolerance, lambda a, b: a == b, lambda a, b: a == b]
    pairs, wrong = brute(s, t, equal, nulls_match)
    for heavy in (10**9, 50):
        c = Comparison(sdf, tdf, CompareOptions(heavy_pairs=heavy, **options))
        assert c.census.matched == pairs
        assert {r.ordinal: r.mismatch_count for r in c.column_counts.collect()} == wrong
        found = {
            r.column_name: r.n for r in c.records().where("mismatch_type = 'value_diff'").groupBy("column_name")
            .agg(F.sum("pair_count").alias("n")).collect()
        }
        assert found == {"xcn"[i]: n for i, n in wrong.items() if n}
        missing = c.records().where("column_name = '<row>'").count()
        assert missing == c.census.missing_in_target + c.census.missing_in_source


def test_heavy_time_tolerance(spark):
    rows = [("h", f"2024-01-01 00:00:{i:02d}") for i in range(20)]
    df = spark.createDataFrame(rows, "k string, at string").select("k", F.col("at").cast("timestamp_ntz").alias("at"))
    expected = sum(abs(a - b) > 3 for a in range(20) for b in range(20))
    for heavy in (10**9, 10):
        c = Comparison(df, df, CompareOptions(key_columns=["k"], datetime_tolerance_seconds=3, heavy_pairs=heavy))
        assert c.summary().first().value_mismatch_count == expected


def test_one_sided_heavy_key(spark):
    s = spark.range(300).select(F.when(F.col("id") < 250, F.lit(-1)).otherwise(F.col("id")).alias("id"), F.lit(1).alias("v"))
    t = spark.range(250, 310).withColumn("v", F.lit(1))
    c = Comparison(s, t, CompareOptions(heavy_rows=100))
    assert c.census.heavy_keys == 1
    r = c.summary().first()
    assert (r.missing_in_target_count, r.missing_in_source_count, r.value_mismatch_count) == (250, 10, 0)
    assert c.records().count() == 260


def test_positional_duplicates(spark):
    s = spark.createDataFrame([("a", 1)] * 40 + [("b", 2)] * 3 + [(None, 0)], "x string, y int")
    t = spark.createDataFrame([("a", 1)] * 39 + [("b", 2)] * 3 + [(None, 0)], "x string, y int")
    r = result(s, t)
    assert (r.matched_count, r.missing_in_target_count) == (43, 1)
    assert r.value_mismatch_count == 2  # one row shifted from a to b


def test_segments(spark):
    records = spark.createDataFrame(
        [("value_diff", {"region": "EMEA"}, 1), ("value_diff", {"region": "EMEA"}, 1),
         ("missing_in_target", {"region": "EMEA"}, 1), ("value_diff", {"region": "APAC"}, 1)],
        "mismatch_type string, segment_values map<string,string>, pair_count bigint",
    )
    rows = {r.value: r for r in segment_summary(records, ["region"]).collect()}
    assert (rows["EMEA"].mismatch_count, rows["EMEA"].pct_of_total, rows["EMEA"].missing_in_target) == (3, 75.0, 1)
    assert (rows["APAC"].mismatch_count, rows["APAC"].pct_of_total) == (1, 25.0)


def test_sample_of_mixed_key_types(spark):
    s = spark.range(2000).select(F.col("id").cast("int").alias("id"), F.lit(1).alias("v"))
    t = spark.range(2000).withColumn("v", F.lit(1))
    c = Comparison(s, t, CompareOptions(sample_fraction=0.1))
    assert c.census.missing_in_target == c.census.missing_in_source == 0
    assert 100 < c.census.matched < 320


def test_checksum_sees_moved_nulls(spark):
    """A settled result is the full result: nulls that change places, repeated keys and options count."""
    from tallyframe.operators.reconcile import same_content

    schema = "k int, a string, b string"
    left = spark.createDataFrame([(1, "x", None), (2, None, "y"), (3, "z", "z")], schema)
    moved = spark.createDataFrame([(1, None, "x"), (2, "y", None), (3, "z", "z")], schema)
    assert not same_content(left, moved).first().identical
    assert same_content(left, left.orderBy(F.desc("k"))).first().identical
    twice = left.unionByName(spark.createDataFrame([(3, "q", "z")], schema))
    for source, target, options in (
        (left, moved, CompareOptions(key_columns=["k"])), (left, left, CompareOptions(key_columns=["k"])),
        (twice, twice, CompareOptions(key_columns=["k"])),
        (left, left, CompareOptions(key_columns=["k"], null_equals_null=False)),
        (left, moved, CompareOptions(key_columns=["k"], exclude_columns=["a", "b"])),
    ):
        quick = reconcile(source, target, options, checksum_first=True).first().asDict()
        assert quick == reconcile(source, target, options).first().asDict()


def plain_records(source, target, tolerance):
    """(key, column, source value, segment): pairs and the smallest differing target value, by all pairs."""
    out = {}
    for k in {r[0] for r in source} & {r[0] for r in target}:
        seg = min((r[3] for r in target if r[0] == k and r[3] is not None), default=None)
        for a in (r for r in source if r[0] == k):
            for i, column in ((1, "x"), (2, "c"), (3, "g")):
                for b in (r for r in target if r[0] == k):
                    s, t = a[i], b[i]
                    if s is None and t is None:
                        continue
                    if s is not None and t is not None and (abs(s - t) <= tolerance if i == 1 else s == t):
                        continue
                    unit = out.setdefault((k, column, s, a[3] if a[3] is not None else seg), [0, []])
                    unit[0] += 1
                    unit[1].append(t)
    return {
        key: (n, min((t for t in values if t is not None), default=None)) for key, (n, values) in out.items()
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_records_do_not_depend_on_size(spark, seed):
    """Any threshold gives the same records, and they are those of all pairs."""
    rng = random.Random(seed)

    def rows(n):
        return [(rng.choice("aaab"), rng.choice([None, 1.0, 1.5, 2.0, 2.5, 7.0]), rng.choice([None, "p", "q", "r"]),
                 rng.choice([None, "east", "west"])) for _ in range(n)] + [("u", 1.0, "p", None)]

    s, t = rows(40), rows(30)
    schema = "k string, x double, c string, g string"
    sdf, tdf = spark.createDataFrame(s, schema), spark.createDataFrame(t, schema)
    want = plain_records(s, t, 0.5)
    seen = []
    for heavy in (1_000_000, 2):
        c = Comparison(sdf, tdf, CompareOptions(
            key_columns=["k"], column_tolerances={"x": 0.5}, segment_columns=["g"], heavy_pairs=heavy))
        found = c.records().collect()
        seen.append(sorted((tuple(r) for r in found), key=str))
        assert c.records(5).count() == 5
        got = {}
        for r in found:
            value = float(r.source_value) if r.column_name == "x" and r.source_value else r.source_value
            target = float(r.target_value) if r.column_name == "x" and r.target_value else r.target_value
            got[r.key_values["k"], r.column_name, value, r.segment_values["g"]] = (r.pair_count, target)
            if r.column_name == "x":
                assert r.delta == (None if None in (value, target) else target - value)
        assert got == want
    assert seen[0] == seen[1]
