"""Differentially private answers where neither the groups nor the bounds are public.

``grouped_private`` releases the keys of groups. Every person counts in a bounded number of groups,
chosen by keyed draws, and a group is released only if its noisy number of persons reaches a threshold that a group of one
person passes with probability delta at most. ``private_bounds`` finds the bounds that clipping needs, from
a noisy histogram over powers of two.

A person is cut to its groups by rank; the rank filter keeps that many rows per person in every map task, so no
person is gathered. Counts combine on the map side. Noise is keyed: a retried task
draws the same, and equal questions get equal answers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keyed
from .dp import clip, dp_aggregate

LOWEST, HIGHEST = -32, 63  # exponents of two; smaller values count as the lowest, larger ones as the highest


def release_threshold(epsilon: float, delta: float, groups_per_person: int) -> float:
    """Noisy number of persons from which a group is released.

    A group of one person passes with probability exp(-(t - 1) epsilon / c) / 2, and one person is alone in c groups at most.
    """
    if not (epsilon > 0 and 0 < delta < 1 and groups_per_person >= 1):
        raise ValueError("epsilon must be positive, delta between 0 and 1, groups_per_person at least 1")
    return 1.0 + groups_per_person / epsilon * max(0.0, math.log(groups_per_person / (2.0 * delta)))


def bounded_pairs(
    df: DataFrame, person: str, group: str, secret: str, query_id: str, groups_per_person: int, value: Column | None = None
) -> DataFrame:
    """One row per person and group, at most ``groups_per_person`` of each person, with the sum of ``value``."""
    who, where = F.col(f"`{person}`"), F.col(f"`{group}`")
    rows = df.where(who.isNotNull() & where.isNotNull()).select(who.alias("_person"), where.alias(group), (F.lit(1) if value is None else value).alias("_value"))
    pairs = rows.groupBy("_person", group).agg(F.sum("_value").alias("_value"))
    pick = keyed.digest(secret, "group_pick", query_id, F.concat_ws("|", F.col("_person").cast("string"), F.col(f"`{group}`").cast("string")))
    nth = F.row_number().over(Window.partitionBy("_person").orderBy("_pick", F.col(f"`{group}`")))
    return pairs.withColumn("_pick", pick).withColumn("_nth", nth).where(F.col("_nth") <= groups_per_person).drop("_pick", "_nth")


def grouped_private(
    df: DataFrame,
    person: str,
    group: str,
    secret: str,
    query_id: str,
    epsilon: float = 1.0,
    delta: float = 1e-6,
    groups_per_person: int = 1,
    field: str | None = None,
    lower: float = 0.0,
    upper: float = 1.0,
) -> DataFrame:
    """``group`` and the noisy number of ``persons`` of the groups that are released.

    With ``field`` also the noisy ``total`` of every person's sum, clipped to the bounds; the number of persons and
    the total then spend half of epsilon each. Rows without a person or a group take no part.
    """
    if field is not None and not lower < upper:
        raise ValueError("the lower bound must be below the upper bound")
    share = epsilon if field is None else epsilon / 2.0
    threshold = release_threshold(share, delta, groups_per_person)
    value = None if field is None else F.coalesce(F.col(f"`{field}`").cast("double"), F.lit(0.0))
    pairs = bounded_pairs(df, person, group, secret, query_id, groups_per_person, value)
    found = pairs.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(clip(F.col("_value").cast("double"), lower, upper)).alias("_sum")
    )
    name = F.col(f"`{group}`").cast("string")
    noisy = F.col("_n") + keyed.laplace(keyed.uniform(secret, "group_release", query_id, name), groups_per_person / share)
    released = found.withColumn("_noisy", noisy).where(F.col("_noisy") >= threshold)
    columns = [F.col(f"`{group}`"), F.rint("_noisy").cast("bigint").alias("persons")]
    if field is not None:
        reach = groups_per_person * max(abs(lower), abs(upper))
        u = keyed.uniform(secret, "group_total", query_id, name)
        columns.append((F.col("_sum") + keyed.laplace(u, reach / share)).alias("total"))
    return released.select(*columns)


def power_bin(c: Column) -> Column:
    """Number of the power-of-two bin of a value, in value order: 0 for zero, positive bins above, negative below.

    A value of exponent e (2^e up to 2^(e+1), the latter excluded) has bin e - LOWEST + 1, a negative one its negative.
    """
    size = F.abs(c.cast("double"))
    guess = F.floor(F.log2(size))
    # the logarithm may be off by one at a power of two
    exponent = guess + F.when(F.pow(F.lit(2.0), guess + 1) <= size, 1).when(F.pow(F.lit(2.0), guess) > size, -1).otherwise(0)
    kept = F.least(F.greatest(exponent, F.lit(LOWEST)), F.lit(HIGHEST)) - F.lit(LOWEST - 1)
    known = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(HIGHEST - LOWEST + 1)).otherwise(kept)
    return (F.when(c.cast("double") < 0, -known).otherwise(known)).cast("int")


def private_bounds(
    df: DataFrame, field: str, secret: str, query_id: str, epsilon: float = 0.1, failure: float = 1e-6, outside: float = 0.0
) -> DataFrame:
    """One row: ``lower`` and ``upper`` bounds of a column, found with ``epsilon``; null if too few rows tell.

    Every row falls into one of a fixed list of bins and moves one count by one. Bins whose noisy count stays below
    the noise that any bin reaches with probability ``failure`` count as empty. The bounds are the edges of
    the bins between which the running total of the others goes from the share ``outside`` to one minus it. Null and
    NaN take no part.
    """
    if not (epsilon > 0 and 0 < failure < 1 and 0 <= outside < 0.5):
        raise ValueError("epsilon must be positive, failure between 0 and 1, outside from 0 to below a half")
    top = HIGHEST - LOWEST + 1
    value = F.col(f"`{field}`").cast("double")
    counts = df.where(value.isNotNull() & ~F.isnan(value)).groupBy(power_bin(value).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.range(-top, top + 1).select(F.col("id").cast("int").alias("bin"))  # the fixed list, whatever the data hold
    u = keyed.uniform(secret, "bounds", query_id, F.col("bin"))
    noisy = F.coalesce(F.col("n"), F.lit(0)) + keyed.laplace(u, 1.0 / epsilon)
    least = math.log((2 * top + 1) / (2.0 * failure)) / epsilon
    kept = bins.join(F.broadcast(counts), "bin", "left").select("bin", noisy.alias("noisy")).where(F.col("noisy") >= least)
    # at most one row per bin
    order = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("noisy").over(Window.partitionBy())
    running = kept.select("bin", F.sum("noisy").over(order).alias("sum"), total.alias("all"))
    edge = F.pow(F.lit(2.0), F.abs(F.col("bin")) + F.lit(LOWEST - 1))  # the edge next to zero
    low = F.when(F.col("bin") > 0, edge).when(F.col("bin") < 0, -2.0 * edge).otherwise(F.lit(0.0))
    high = F.when(F.col("bin") > 0, 2.0 * edge).when(F.col("bin") < 0, -edge).otherwise(F.lit(0.0))
    return running.agg(
        F.min(F.when(F.col("sum") > F.lit(outside) * F.col("all"), low)).alias("lower"),
        F.min(F.when(F.col("sum") >= F.lit(1.0 - outside) * F.col("all"), high)).alias("upper"),
    )


def dp_aggregate_unbounded(
    df: DataFrame, field: str, query_type: str, secret: str, query_id: str, bounds_epsilon: float = 0.1, degradation: float = 1.0
) -> DataFrame:
    """``dp.dp_aggregate`` with bounds found privately; spends ``bounds_epsilon`` on top."""
    low, high = private_bounds(df, field, secret, query_id, bounds_epsilon).first()
    if low is None or not low < high:
        raise ValueError(f"too few rows to find bounds of {field}")
    answer = dp_aggregate(df, field, query_type, low, high, secret, query_id, degradation)
    return answer.withColumn("effective_epsilon", F.col("effective_epsilon") + F.lit(bounds_epsilon))
