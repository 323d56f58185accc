"""k-anonymity over the combination of quasi-identifiers, enforced by recursive median cuts.

The table is one box at first. Every box is cut at the median of its widest column, as long as both sides keep k
rows; a box that no column can cut is a class, and its rows show the box's ranges in place of their values.

The cuts work on the different combinations of values with their numbers of rows, written once per level. All
open boxes of a level are cut together: values are counted per box and column, running totals in one global
order of (box, column, value) give every value's exact rank, and the value nearest the middle that leaves k rows
on both sides is the cut. The global order is range-partitioned, so the first box, which holds all rows, is
spread like any other. Boxes are looked up by broadcast while they are few, and by shuffle once there are so
many that none is large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .ordering import with_running_total

FEW_BOXES = 20_000  # rows of a box table that is broadcast, about 100 bytes each
FEW_CELLS = 200_000


def _by_box(rows: DataFrame, boxes: DataFrame, keys: list[str], number: int) -> DataFrame:
    return rows.join(F.broadcast(boxes) if number <= FEW_BOXES else boxes, keys)


def _cells(df: DataFrame, quasi: list[str]) -> tuple[DataFrame, int]:
    """Combinations of values with ``n``, each column's value as ``_v0`` ... from 0 to 1, null as the lowest."""
    for c in quasi:
        if not isinstance(df.schema[c].dataType, (T.NumericType, T.DateType, T.TimestampType, T.BooleanType)):
            raise ValueError(f"{c} has no numbers to cut at; give the rank of its values instead")

    def number(c: str):
        kind = df.schema[c].dataType
        value = F.col(f"`{c}`")
        if isinstance(kind, T.DateType):
            return F.unix_date(value).cast("double")
        return (F.unix_micros(value) if isinstance(kind, T.TimestampType) else value).cast("double")

    counted = materialize(df.groupBy(*[F.col(f"`{c}`") for c in quasi]).agg(F.count(F.lit(1)).alias("_n")))
    ends = counted.agg(F.sum("_n"), *[f(number(c)) for c in quasi for f in (F.min, F.max)]).first()
    columns = []
    for i, c in enumerate(quasi):
        low, high = ends[1 + 2 * i], ends[2 + 2 * i]
        width = (high - low) if low is not None and high > low else 1.0
        share = (number(c) - F.lit(low or 0.0)) / F.lit(width)
        columns.append(F.coalesce(share, F.lit(0.0)).alias(f"_v{i}"))
    return counted.select("*", *columns), ends[0] or 0


def boxes_of(df: DataFrame, quasi: list[str], k: int) -> DataFrame:
    """Combinations of values with ``_n`` rows and their ``_box``; every box has k rows at least."""
    if k < 1 or not quasi:
        raise ValueError("k must be at least 1, with one quasi-identifier or more")
    cells, total = _cells(df, quasi)
    if 0 < total < k:
        raise ValueError(f"{total} rows cannot be {k}-anonymous")
    opened = materialize(cells.withColumn("_box", F.lit("")))
    closed: list[DataFrame] = []
    number = min(total, 1)
    while number:
        places = [F.struct(F.lit(i).alias("_dim"), F.col(f"_v{i}").alias("_value")) for i in range(len(quasi))]
        values = opened.select("_box", "_n", F.inline(F.array(*places))).groupBy("_box", "_dim", "_value").agg(F.sum("_n").alias("_n"))
        ranked = with_running_total(values, ["_box", "_dim", "_value"], {"_upto": F.col("_n")})
        sides = ranked.groupBy("_box", "_dim").agg(
            F.min(F.col("_upto") - F.col("_n")).alias("_base"), F.sum("_n").alias("_all"),
            (F.max("_value") - F.min("_value")).alias("_width"),
        )
        left = F.col("_upto") - F.col("_base")
        able = _by_box(ranked, sides, ["_box", "_dim"], number * len(quasi)).where((left >= k) & (F.col("_all") - left >= k))
        nearest = F.struct(F.abs(2 * left - F.col("_all")), F.col("_value"))
        cuts = able.groupBy("_box", "_dim").agg(F.min_by("_value", nearest).alias("_cut"), F.max("_width").alias("_width"))
        widest = F.struct(-F.col("_width"), F.col("_dim"))
        chosen = materialize(cuts.groupBy("_box").agg(F.min_by(F.struct("_dim", "_cut"), widest).alias("_at")))
        few = chosen.count()
        side = reduce(lambda c, i: c.when(F.col("_at._dim") == i, F.col(f"_v{i}") > F.col("_at._cut")), range(len(quasi)), F)
        halves = _by_box(opened, chosen, ["_box"], few)
        halves = halves.withColumn("_box", F.concat("_box", F.when(side, "1").otherwise("0"))).drop("_at")
        done = chosen.select("_box")
        closed.append(opened.join(F.broadcast(done) if few <= FEW_BOXES else done, "_box", "left_anti"))
        opened, number = materialize(halves.select(*opened.columns)), 2 * few  # both halves have rows
    if not closed:
        return opened
    return materialize(reduce(DataFrame.unionByName, closed))


def k_anonymize_mondrian(df: DataFrame, quasi: list[str], k: int = 5) -> DataFrame:
    """The rows with the ranges of their class in place of the quasi-identifiers, as text ``low - high``, or one value.

    Columns may be numbers, dates, times or booleans. Null counts as a column's lowest value and is covered by the range of its
    class, which is null only if all its values are. Every class of equal ranges has k rows or more; a table with
    fewer rows is refused, an empty table stays empty.
    """
    boxes = boxes_of(df, quasi, k)
    shown = []
    for c in quasi:
        low, high = (f(F.col(f"`{c}`")).cast("string") for f in (F.min, F.max))
        shown.append(F.when(low == high, low).otherwise(F.concat(low, F.lit(" - "), high)).alias(f"_shown_{c}"))
    ranges = boxes.groupBy("_box").agg(*shown)
    number = boxes.count()
    names = [f"_own_{i}" for i in range(len(quasi))]
    looked = boxes.select("_box", *[F.col(f"`{c}`").alias(n) for c, n in zip(quasi, names)])
    looked = _by_box(looked, ranges, ["_box"], number).drop("_box")
    if number <= FEW_CELLS:
        looked = F.broadcast(looked)
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(F.col(n)) for c, n in zip(quasi, names)])
    joined = df.join(looked, same)
    return joined.select(*[F.col(f"`_shown_{c}`").alias(c) if c in quasi else df[c] for c in df.columns])
