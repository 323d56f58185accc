"""l-diversity enforced by grouping rows, with values kept as they are (anatomy).

Rows in the order of their sensitive value are dealt round to a fixed number of groups, one for every l known rows.
A value that holds no more rows than there are groups stands in consecutive places, so no group receives it twice:
every group has l different values or more. The deal needs one global, range-partitioned sort; a frequent value is
spread by keyed draws, and neither a value nor a group is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keyed
from .ordering import with_position


def l_diversify(df: DataFrame, sensitive: str, l: int, key: str, secret: str) -> DataFrame:
    """The rows with ``group_id``; every group holds at least l different values of ``sensitive``.

    Rows without a value count for no group and are dealt to the groups evenly behind the others. A value that holds
    more than one in l of the known rows cannot be hidden among l values and is refused, as is a table of rows without
    values; an empty table stays empty. Row keys must not be null. Rows that repeat key and value are dealt in any order.
    """
    if l < 1:
        raise ValueError("l must be at least 1")
    value = F.col(f"`{sensitive}`")
    counts = df.groupBy(value.alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    known = F.when(F.col("_value").isNotNull(), F.col("_n"))
    rows, total, most = counts.agg(F.sum("_n"), F.sum(known), F.max(known)).first()
    if rows and (not total or most * l > total):
        raise ValueError(f"{most or 0} of {total or 0} known rows share a value; groups of {l} different values cannot be formed")
    row_key = F.coalesce(F.col(f"`{key}`").cast("string"), F.raise_error(F.lit(f"row key {key} must not be null")))
    ordered = df.withColumns({
        "_unknown": value.isNull(), "_value": value, "_draw": keyed.digest(secret, "l_diversify", sensitive, row_key), "_key": F.col(f"`{key}`"),
    })
    placed = with_position(ordered, ["_unknown", "_value", "_draw", "_key"], "_place")
    groups = max((total or 0) // l, 1)
    return placed.withColumn("group_id", F.col("_place") % groups).drop("_unknown", "_value", "_draw", "_key", "_place")


def anatomize(df: DataFrame, sensitive: str, l: int, key: str, secret: str) -> tuple[DataFrame, DataFrame]:
    """Two tables to release: the rows with ``group_id`` in place of the sensitive value, and each group's values with their ``n``."""
    dealt = l_diversify(df, sensitive, l, key, secret)
    values = dealt.groupBy("group_id", F.col(f"`{sensitive}`")).agg(F.count(F.lit(1)).alias("n"))
    shown = [F.col(f"`{c}`") for c in df.columns if c not in (sensitive, key, "group_id")]
    return dealt.select("group_id", *shown), values
