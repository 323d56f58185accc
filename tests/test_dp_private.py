"""Group keys and bounds released privately."""

import math

import pytest
from pyspark.sql import functions as F

from veilframe.operators import dp_private


def test_small_groups_stay_hidden_and_large_ones_show(spark):
    rows = [(p, "big") for p in range(2000)] + [(p, f"own {p}") for p in range(2000)] + [(None, "big"), (1, None)]
    df = spark.createDataFrame(rows, "person int, g string")
    found = dp_private.grouped_private(df, "person", "g", "s", "q", 1.0, 1e-6, groups_per_person=2).collect()
    assert [r["g"] for r in found] == ["big"] and abs(found[0]["persons"] - 2000) < 60
    assert dp_private.grouped_private(df.limit(0), "person", "g", "s", "q").collect() == []


def test_a_person_counts_in_a_bounded_number_of_groups(many_partitions):
    # one person has a third of all rows and every group
    rows = [(0, f"g{i % 500}", 1.0) for i in range(3000)] + [(1 + i % 400, f"g{i % 7}", 2.0) for i in range(6000)]
    df = many_partitions.createDataFrame(rows, "person int, g string, v double")
    pairs = dp_private.bounded_pairs(df, "person", "g", "s", "q", 3, F.col("v"))
    per_person = pairs.groupBy("person" if "person" in pairs.columns else "_person").count().collect()
    assert len(per_person) == 401 and max(r["count"] for r in per_person) == 3
    again = dp_private.bounded_pairs(df.repartition(3), "person", "g", "s", "q", 3, F.col("v"))
    assert sorted(map(str, pairs.collect())) == sorted(map(str, again.collect()))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # the rank is cut before the shuffle


def test_totals_are_clipped_per_person(spark):
    df = spark.createDataFrame([(p, "g", 1e9 if p == 0 else 1.0) for p in range(500)], "person int, g string, v double")
    found = dp_private.grouped_private(df, "person", "g", "s", "q", 10.0, 1e-6, field="v", lower=0, upper=5).first()
    assert abs(found["total"] - 504) < 20
    with pytest.raises(ValueError):
        dp_private.grouped_private(df, "person", "g", "s", "q", field="v", lower=1, upper=1)


def test_threshold():
    assert dp_private.release_threshold(1.0, 1e-6, 1) == pytest.approx(1 + math.log(5e5))
    for bad in ((0, 0.1, 1), (1, 0, 1), (1, 1, 1), (1, 0.1, 0)):
        with pytest.raises(ValueError):
            dp_private.release_threshold(*bad)


def test_bins_at_powers_of_two(spark):
    values = [s * 2.0**e * f for e in range(-31, 63) for f in (1.0, 1.999999) for s in (1, -1)]
    extra = [(0.0, 0), (1e-300, 1), (-1e-300, -1), (1e300, 96), (-1e300, -96), (math.inf, 96), (-math.inf, -96)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", dp_private.power_bin(F.col("v")).alias("b")).collect():
        size = math.frexp(abs(row["v"]))[1] - 1 + 33
        assert row["b"] == (size if row["v"] > 0 else -size)
    df = spark.createDataFrame(extra, "v double, want int")
    assert all(r["b"] == r["want"] for r in df.select("want", dp_private.power_bin(F.col("v")).alias("b")).collect())


def test_bounds_enclose_the_values(spark):
    df = spark.range(5000).select((F.col("id") - 1000).cast("double").alias("v"))
    found = dp_private.private_bounds(df, "v", "s", "q", 1.0).first()
    assert (found["lower"], found["upper"]) == (-1024.0, 4096.0)
    one = df.unionByName(spark.createDataFrame([(1e15,), (float("nan"),), (None,)], "v double"))
    assert dp_private.private_bounds(one, "v", "s", "q", 1.0).first() == found  # one row does not show
    assert tuple(dp_private.private_bounds(df.limit(0), "v", "s", "q").first()) == (None, None)
    mean = dp_private.dp_aggregate_unbounded(df, "v", "mean", "s", "q", 1.0).first()
    assert abs(mean["result"] - 1499.5) < 200 and mean["effective_epsilon"] > 1.0
    with pytest.raises(ValueError, match="too few"):
        dp_private.dp_aggregate_unbounded(df.limit(0), "v", "mean", "s", "q")
