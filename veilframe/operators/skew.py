"""Joins of rows with per-value tables when a few values hold most rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BROADCAST_BYTES = 32 * 1024 * 1024
BROADCAST_ROWS = 1_000_000
HEAVY_PARTS = 1000  # a value is heavy when it holds more than 1/1000 of the rows


def fits_broadcast(rows: int, text_bytes: int | None) -> bool:
    """Whether a table of this measured size may be broadcast."""
    return rows <= BROADCAST_ROWS and (text_bytes or 0) <= BROADCAST_BYTES


def heavy_values(counts: DataFrame, total: int, count: str = "n") -> DataFrame:
    """Values holding more than 1/1000 of all rows: fewer than 1000 by counting."""
    return counts.where(F.col(count) > F.lit(total / HEAVY_PARTS))


def join_by_value(
    df: DataFrame,
    table: DataFrame,
    key: str,
    counts: Callable[[], DataFrame],
    total: int,
    rows: int,
    text_bytes: int | None,
    how: str = "inner",
) -> DataFrame:
    """Join rows with a table that has one row per value of ``key``.

    Small tables are broadcast after the size check. Larger ones are split:
    rows with a heavy value meet the (fewer than 1000) heavy table rows by
    broadcast and are not shuffled, the rest joins by shuffle, where no key
    exceeds 1/1000 of the rows.
    """
    if fits_broadcast(rows, text_bytes):
        return df.join(F.broadcast(table), key, how)
    heavy = F.broadcast(heavy_values(counts(), total).select(key))
    hot = df.join(heavy, key, "left_semi")
    cold = df.join(heavy, key, "left_anti")
    hot_table = F.broadcast(table.join(heavy, key, "left_semi"))
    return hot.join(hot_table, key, how).unionByName(cold.join(table, key, how))


def look_up(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join with a table that has at most one row per key, whatever the key frequencies."""
    size = F.lit(0)
    for c in table.columns:
        size = size + text_size(F.col(f"`{c}`"))
    rows, text_bytes = table.agg(F.count(F.lit(1)), F.sum(size)).first()
    if fits_broadcast(rows, text_bytes):
        return df.join(F.broadcast(table), key, "left")
    counts = materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_by_value(df, table, key, lambda: counts, total, rows, text_bytes, "left")


def text_size(c: Column) -> Column:
    """Bytes of the text form of a value, for size checks."""
    return F.coalesce(F.octet_length(c.cast("string")), F.lit(0))
