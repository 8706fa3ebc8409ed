import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import normal, ranks, stats
from tallyframe.operators.rules import rolling_zscore


def test_row_number_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_BLOCK", 8)
    rng = random.Random(5)
    rows = [(rng.choice("aaaab"), rng.randint(0, 2)) for _ in range(100)] + [(None, 1)] * 3
    df = spark.createDataFrame(rows, "x string, y int")
    got = [(r.x, r.y) for r in ranks.with_row_number(df, ["x", "y"], "n").orderBy("n").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    numbers = [r.n for r in ranks.with_row_number(df, ["x", "y"], "n").collect()]
    assert sorted(numbers) == list(range(1, 104))


def test_row_numbers_are_never_broadcast(spark):
    """Few groups stand for many rows; a join by number must not take them for a small table."""
    from tallyframe.operators.reconcile import Comparison

    df = spark.range(3000).select((F.col("id") % 3).alias("x"), (F.col("id") % 2).alias("y"))
    found = Comparison(df, df.where("x > 0 or y > 0"))
    assert "SortMergeJoin [sk0" in found.column_counts._jdf.queryExecution().executedPlan().toString()
    row = found.summary().first()
    assert (row.source_row_count, row.matched_count, row.missing_in_target_count) == (3000, 2500, 500)


def test_running_total(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), (F.col("id") % 5).alias("w"))
    got = {r.v: int(r.running_total) for r in ranks.running_total(df, [F.col("v").asc()], "w").collect()}
    total, expected = 0, {}
    for v, w in sorted((i * 7 % 1000, i % 5) for i in range(1000)):
        total += w
        expected[v] = total
    assert got == expected


@pytest.mark.parametrize("accuracy,limit", [(10_000, 2_000_000), (20, 50)])
def test_exact_percentiles(spark, accuracy, limit):
    rng = np.random.default_rng(3)
    a = rng.exponential(10, 4000).round(2)
    b = rng.choice([1.0, 1.0, 1.0, 2.0, 9.0], 4000)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double").repartition(6)
    qs = [0.0, 0.25, 0.5, 0.95, 0.999, 1.0]
    got = ranks.exact_percentiles(df, {"a": qs, "b": qs}, accuracy=accuracy, rows_per_bracket=limit)
    for name, data in (("a", a), ("b", b)):
        for q in qs:
            assert got[name][q] == pytest.approx(np.quantile(data, q), abs=1e-9)


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert ranks.exact_percentiles(df, {"a": [0.5]}) == {"a": {0.5: None}}


def test_rolling_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_BLOCK", 16)
    rng = random.Random(9)
    rows = [(i, rng.choice("pq"), None if rng.random() < 0.1 else rng.uniform(0, 10)) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, g string, x double")
    got = {r.i: r.z for r in rolling_zscore(df, F.col("x"), 4, ["i"], ["g"]).collect()}
    assert len(got) == 200
    for i, g, x in rows:
        before = [v for j, h, v in rows if h == g and j < i][-4:]
        known = [v for v in before if v is not None]
        if x is None or len(known) < 2:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(abs(x - np.mean(known)) / np.std(known, ddof=1))


def test_with_previous(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_BLOCK", 8)
    df = spark.createDataFrame([(i % 3, i, i * 10) for i in range(60)], "g int, i int, v int")
    got = {r.i: r.previous_v for r in ranks.with_previous(df, ["g"], ["i"], ["v"]).collect()}
    assert got == {i: (i - 3) * 10 if i >= 3 else None for i in range(60)}


def test_tail_probabilities():
    # published table values
    assert stats.chi_square_tail(16.919, 9) == pytest.approx(0.05, abs=1e-5)
    assert stats.chi_square_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi_square_tail(124.342, 100) == pytest.approx(0.05, abs=1e-5)
    assert stats.student_upper_point(0.025, 10) == pytest.approx(2.228139, abs=1e-5)
    assert stats.student_upper_point(0.05, 1) == pytest.approx(6.313752, abs=1e-5)
    assert stats.student_upper_point(1e-7, 100_000) == pytest.approx(5.19953, abs=1e-2)
    assert stats.normal_tail(1.959964) == pytest.approx(0.025, abs=1e-7)
    assert stats.grubbs_critical(10, 0.05) == pytest.approx(2.2900, abs=1e-3)
    assert stats.grubbs_critical(20, 0.05) == pytest.approx(2.7082, abs=1e-3)
    # Kolmogorov: exact values of the 2003 paper and the limit law
    assert 1 - stats.kolmogorov_tail(0.274, 10) == pytest.approx(0.6284796154565, abs=1e-7)
    assert stats.kolmogorov_tail(1.358 / 1000, 1_000_000) == pytest.approx(0.05, abs=5e-4)
    assert stats.kolmogorov_tail(0.409, 10) == pytest.approx(0.05, abs=1e-3)


def test_kolmogorov_law_is_one():
    """The exact law and its expansion agree where one takes over from the other."""
    from tallyframe.functions import stats

    for z in (0.3, 0.5, 0.8, 1.0, 1.3, 1.6, 1.9):
        for n in (2_000, 9_999, 10_000, 10_001):
            d = z / n**0.5
            assert abs(stats._kolmogorov_exact(d, n) - stats._kolmogorov_expansion(z, n)) < 1e-7
        tails = [stats.kolmogorov_tail(z / n**0.5, n) for n in (9_999, 10_000, 10_001)]
        assert max(tails) - min(tails) < 1e-6


def test_running_total_with_ties(spark, monkeypatch):
    """A third of all rows have one order value, some are equal, and ranges are small: totals still run on."""
    from tallyframe.functions import ranks

    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 50)
    rows = [(7 if k % 3 == 0 else k % 40, k % 5, 1) for k in range(600)]
    df = spark.createDataFrame(rows, "v int, other int, w int")
    got = ranks.running_total(df, [F.col("v").asc()], "w").collect()
    assert sorted(int(r.running_total) for r in got) == list(range(1, 601))
    by_value = sorted((r.v, int(r.running_total)) for r in got)
    assert [v for v, _ in by_value] == [v for v, _ in sorted((r.v, int(r.running_total)) for r in got)]
    last = 0
    for v in sorted({r.v for r in got}):
        own = [int(r.running_total) for r in got if r.v == v]
        assert sorted(own) == list(range(last + 1, last + len(own) + 1))
        last += len(own)


def test_normal_law(spark):
    """Columns against the standard library: both ends, every border of the three ranges, and no Python in the plan."""
    edges = [s * e * math.sqrt(2) for e in (normal.NEAR, normal.FAR) for s in (1, -1)]
    values = [k / 40 for k in range(-1440, 1441)] + edges + [math.nextafter(e, 0) for e in edges] + [0.0, -0.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "z double")
    found = df.select("z", normal.normal_cdf(F.col("z")).alias("p"), normal.log_normal_cdf(F.col("z")).alias("l"))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    for row in found.collect():
        if row.z is None:
            assert row.p is None and row.l is None
            continue
        lower, upper = 0.5 * math.erfc(-row.z / math.sqrt(2)), 0.5 * math.erfc(row.z / math.sqrt(2))
        assert row.p == pytest.approx(lower, rel=1e-12)
        assert row.l == pytest.approx(math.log(lower) if row.z < 1 else math.log1p(-upper), rel=1e-12)
    ends = spark.createDataFrame([(-1e6,), (-60.0,), (60.0,), (float("inf"),)], "z double").select(
        normal.normal_cdf(F.col("z")), normal.log_normal_cdf(F.col("z"))
    ).collect()
    assert [r[0] for r in ends] == [0.0, 0.0, 1.0, 1.0] and [r[1] for r in ends[2:]] == [0.0, 0.0]
    assert ends[0][1] == pytest.approx(-5e11 - math.log(1e6) - 0.5 * math.log(2 * math.pi), rel=1e-14)
    assert ends[1][1] == pytest.approx(-1800 - math.log(60) - 0.5 * math.log(2 * math.pi) - 1 / 3600, rel=1e-9)
