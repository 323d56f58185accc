"""Global positions and running totals without a single-partition window.

Rows are range-partitioned on the order key (which therefore may not repeat),
sorted inside each partition and written once; a row's global position is the
sum of the earlier partitions' sizes plus its place in its own partition. The
only ungrouped window runs over one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_ROW_BITS = 33  # layout of monotonically_increasing_id: partition above, row below


def in_global_order(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Materialized rows in range partitions, with ``_part`` and ``_row``."""
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    numbered = ranged.withColumn("_id", F.monotonically_increasing_id())
    placed = numbered.withColumn("_part", F.shiftright("_id", _ROW_BITS)).withColumn(
        "_row", F.col("_id").bitwiseAND(F.lit(2**_ROW_BITS - 1))
    )
    return materialize(placed.drop("_id"))


def _offsets(sizes: DataFrame, total: str) -> DataFrame:
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        "_part", F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias("_offset")
    )


def with_position(df: DataFrame, order_by: list[str], name: str = "pos") -> DataFrame:
    """Add the 0-based global position by a unique order key."""
    placed = in_global_order(df, order_by)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the partition count, not by the data
    offsets = F.broadcast(_offsets(sizes, "_n"))
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_row"))
        .drop("_part", "_row", "_offset")
    )


def with_running_total(
    df: DataFrame, order_by: list[str], values: dict[str, Column]
) -> DataFrame:
    """Add inclusive global running totals, one per entry of ``values``."""
    placed = in_global_order(df, order_by)
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    result = placed.select(
        "*", *[F.sum(v).over(inside).alias(f"_in_{name}") for name, v in values.items()]
    )
    sizes = placed.groupBy("_part").agg(*[F.sum(v).alias(f"_n_{name}") for name, v in values.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        *[F.coalesce(F.sum(f"_n_{n}").over(earlier), F.lit(0)).alias(f"_offset_{n}") for n in values],
    )
    result = result.join(F.broadcast(offsets), "_part")
    for name in values:
        result = result.withColumn(name, F.col(f"_in_{name}") + F.col(f"_offset_{name}"))
    helpers = [f"{p}_{n}" for n in values for p in ("_in", "_offset")]
    return result.drop("_part", "_row", *helpers)


def first_middle_last(df: DataFrame, order_by: list[str], each: int = 5) -> DataFrame:
    """The first, middle and last rows by order key; all rows of a small dataset.

    Positions are computed on the key columns alone; the wide rows are only
    touched by a semi join with at most ``3 * each`` keys.
    """
    keys = with_position(df.select(*order_by), order_by)
    n = keys.agg(F.count(F.lit(1))).first()[0]
    if n <= 3 * each:
        return df
    middle = n // 2 - each // 2
    wanted = keys.where(
        (F.col("pos") < each)
        | F.col("pos").between(middle, middle + each - 1)
        | (F.col("pos") >= n - each)
    )
    return df.join(F.broadcast(wanted.select(*order_by)), order_by, "left_semi")
