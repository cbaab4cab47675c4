"""Statutory ranges; expected values from the statute's own figures."""

import pytest
from pyspark.sql import functions as F

from corvia.operators import statute as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def bounds(x):
    return None if x is None else (x["min_months"], x["max_months"])


@pytest.mark.parametrize(
    ("behavior", "level", "weight", "expected"),
    [
        ("施用", 2, None, (0, 36)), ("施用", 9, None, None), ("飛", 1, None, None), ("持有", 1, 5.0, (0, 36)), ("持有", 1, 10.0, (12, 84)),
        ("持有", 1, None, (0, 36)), ("持有", 2, 10.0, (0, 24)), ("持有", 2, 25.0, (6, 60)), ("持有", 3, 1000.0, (0, 12)), ("販賣", 4, None, (60, 144)),
    ],
)
def test_base_range(spark, behavior, level, weight, expected):
    assert bounds(one(spark, S.base_range(F.lit(behavior), F.lit(level), weight_g=F.lit(weight).cast("double")))) == expected


@pytest.mark.parametrize(("n", "recidivism", "expected"), [(0, False, (120, 360)), (1, False, (60, 180)), (2, False, (30, 90)), (0, True, (120, 360)), (1, True, (60, 270))])
def test_reductions(spark, n, recidivism, expected):
    flags = [F.lit(i < n) for i in range(5)]
    got = one(spark, S.with_reductions(S.constraint(120, 360, True, True), flags, F.lit(recidivism)))
    assert bounds(got) == expected and got["includes_life"] is (n == 0)


def binding(spark, behaviors, levels, summary=False, **k):
    no = [F.lit(False)] * 5
    b = F.array(*map(F.lit, behaviors)).cast("array<string>")
    v = F.array(*map(F.lit, levels)).cast("array<int>")
    return bounds(one(spark, S.binding(b, v, k.pop("flags", no), F.lit(False), F.lit(summary), **k)))


def test_binding(spark):
    assert binding(spark, ["持有", "販賣"], [1, 2]) == (180, 360)
    assert binding(spark, [], [1]) is None and binding(spark, ["持有"], [9]) is None
    assert binding(spark, ["施用"], [1]) == (6, 60) and binding(spark, ["施用"], [1], summary=True) == (3, 60)
    halves = [F.lit(True)] + [F.lit(False)] * 4
    assert binding(spark, ["施用"], [1], flags=halves) == (3, 30)
    assert binding(spark, ["施用"], [1], flags=halves, article_17=2, eligible=("販賣",)) == (6, 60)


def test_clip_and_within(spark):
    c = S.constraint(6, 60)
    assert [one(spark, S.clip(F.lit(float(x)), c)) for x in (3, 100, 24)] == [6, 60, 24]
    d = S.constraint(3.5, 31.5)
    assert [one(spark, S.is_within(F.lit(x), d)) for x in (3.5, 31.5, 3.0, 32.0)] == [True, True, False, False]


def test_constrained(spark):
    triple = lambda a, b, d, c: one(spark, S.constrained(*(F.lit(float(x)) for x in (a, b, d)), c))
    got = triple(4, 30, 200, S.constraint(12, 60))
    assert (got["p25"], got["p50"], got["p75"], got["clipped"], got["rule_applied"]) == (12, 30, 60, True, True)
    assert tuple(triple(1, 2, 3, S.constraint(24, 360)))[:3] == (24, 24, 24)
    nothing = F.when(F.lit(False), S.constraint(0, 1))
    assert tuple(triple(5, 4, 3, nothing)) == (5, 4, 3, False, False)


def test_aggregate_bounds(spark):
    for terms, expected in (([12.0, 8.0, 6.0], (12, 26)), ([], (0, 0)), ([200.0, 200.0], (200, 360))):
        assert tuple(one(spark, S.aggregate_bounds(F.array(*map(F.lit, terms)).cast("array<double>")))) == expected


def test_violations(spark):
    df = spark.createDataFrame([(3.0, 6.0), (24.0, 6.0), (100.0, 6.0), (1.0, None)], "m double, lo double")
    c = F.when(F.col("lo").isNotNull(), S.constraint(F.col("lo"), 60.0))
    (r,) = S.violations(df, F.col("m"), c).collect()
    assert (r.n_checked, r.n_violations, round(r.rate, 6)) == (3, 2, round(2 / 3, 6))
    (r,) = S.violations(df.limit(0), F.col("m"), c).collect()
    assert tuple(r) == (0, 0, 0.0)
