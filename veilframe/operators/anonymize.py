"""Column treatments that need the whole column, not one value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import keyed, masks, parse, randomized, ranges
from . import skew
from .ordering import with_position


@dataclass
class Categories:
    """The numbered values of one column: ``_value``, ``n``, ``_target`` from 0, with their measured size."""

    table: DataFrame
    rows: int
    total: int
    text_bytes: int | None


def count_categories(df: DataFrame, columns: list[str]) -> dict[str, Categories]:
    """The categories of several text columns from one pass over the rows and one sort of their counts."""
    entries = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(f"`{c}`").alias("_value")) for c in columns])
    counts = df.select(F.inline(entries)).where(F.col("_value").isNotNull()).groupBy("_column", "_value").agg(F.count(F.lit(1)).alias("n"))
    placed = with_position(counts, ["_column", "_value"], "_place")
    sizes = placed.groupBy("_column").agg(
        F.min("_place").alias("start"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"), F.sum(skew.text_size(F.col("_value"))).alias("bytes")
    )
    # one row per column of the schema
    measured = {r["_column"]: r for r in sizes.collect()}
    found = {}
    for c in columns:
        r = measured.get(c)
        target = (F.col("_place") - F.lit(r["start"] if r else 0)).alias("_target")
        table = placed.where(F.col("_column") == c).select("_value", "n", target)
        found[c] = Categories(table, r["rows"], r["total"], r["bytes"]) if r else Categories(table, 0, 0, 0)
    return found


def _categories(df: DataFrame, column: str) -> Categories:
    values = df.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").alias("_value"))
    numbered = with_position(values.groupBy("_value").agg(F.count(F.lit(1)).alias("n")), ["_value"], "_target")
    size = F.sum(skew.text_size(F.col("_value")))
    return Categories(numbered, *numbered.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), size).first())


def k_anonymize(
    df: DataFrame,
    column: str,
    k: int,
    secret: str,
    key: str,
    p: float = K.TRUTH_PROBABILITY,
    source: DataFrame | None = None,
    counted: Categories | None = None,
) -> DataFrame:
    """Keep values seen at least k times; answer the others by randomized response.

    The categories stay a table, numbered by global position, so a column may
    have any number of distinct values. Only a rare value that loses its coin
    changes: it takes the category number ``floor(u * n)``, which spreads
    evenly over that table.

    ``source`` may name an earlier frame with the same values of ``column``,
    to count them without the work done on the other columns since; ``counted`` its
    categories, where ``count_categories`` has them already.
    """
    value = F.col(f"`{column}`")
    found = counted or _categories(source if source is not None else df, column)
    categories, rows, total, text_bytes = found.table, found.rows, found.total, found.text_bytes
    if rows == 0:
        return df

    hexdigest = keyed.digest(secret, "k_anonymity", column, F.col(f"`{key}`"))
    coin_lost = F.coalesce(keyed.uniform_of(hexdigest, 0) >= p, F.lit(False))
    target = F.floor(keyed.uniform_of(hexdigest, 1) * F.lit(rows)).cast("bigint")
    names = [F.col(f"`{n}`") for n in df.columns]
    changed = [F.coalesce("_other", "_value").alias(n) if n == column else F.col(f"`{n}`") for n in df.columns]
    with_value = df.withColumn("_value", value)
    other = categories.select(F.col("_value").alias("_other"), "_target")
    rare = categories.where(F.col("n") < k).select("_value", F.lit(True).alias("_rare"))

    if skew.fits_broadcast(rows, text_bytes):
        marked = with_value.join(F.broadcast(rare), "_value", "left")
        marked = marked.withColumn("_target", F.when(F.col("_rare") & coin_lost, target))
        replaced = marked.join(F.broadcast(other), "_target", "left")
        return replaced.select(*changed)

    # Rows that win the coin, and rows of a common value, stay as they are without a shuffle.
    common = skew.heavy_values(categories, total).where(F.col("n") >= k)
    marked = with_value.join(F.broadcast(common.select("_value", F.lit(True).alias("_common"))), "_value", "left")
    needs_look = coin_lost & F.col("_value").isNotNull() & F.col("_common").isNull()
    unchanged = marked.where(~needs_look).select(*names)
    looked = marked.where(needs_look).join(rare, "_value", "left")
    # values that turn out not to be rare match no category; their keys are spread, not null
    nowhere = -F.lit(1) - F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(2**31))
    looked = looked.withColumn("_target", F.when(F.col("_rare"), target).otherwise(nowhere))
    replaced = looked.join(other, "_target", "left").select(*changed)
    return unchanged.unionByName(replaced)


def generalize_categories(df: DataFrame, column: str, limit: int = K.CATEGORY_LIMIT) -> DataFrame:
    """``[CATEGORY]`` everywhere when the column has more than ``limit`` values."""
    value = F.col(f"`{column}`")
    distinct = df.agg(F.countDistinct(value).alias("d")).scalar()
    return df.withColumn(column, masks.generalize_category(value, distinct, limit))


def bucket_equal_width(df: DataFrame, column: str, name: str, buckets: int = 10) -> DataFrame:
    """Add the midpoint of the value's equal-width bucket."""
    bounds = df.agg(F.struct(F.min(f"`{column}`").alias("low"), F.max(f"`{column}`").alias("high")).alias("b")).scalar()
    value = F.col(f"`{column}`").cast("double")
    low, high = bounds["low"].cast("double"), bounds["high"].cast("double")
    return df.withColumn(name, ranges.equal_width(value, low, high, buckets))


def release_numeric(df: DataFrame, column: str, secret: str, key: str, name: str | None = None) -> DataFrame:
    """Noise on a number column; an all-zero column is left as it is."""
    name = name or column
    nonzero = df.agg(F.max(F.col(f"`{column}`") != 0).alias("nz")).scalar()
    released = randomized.numeric_release(F.col(f"`{column}`"), name, secret, F.col(f"`{key}`"))
    unchanged = F.col(f"`{column}`").cast("double" if parse.has_any(name, K.ROUNDED_WORDS) else "bigint")
    return df.withColumn(column, F.when(nonzero, released).otherwise(unchanged))


def estimate_shares(responses: DataFrame, column: str, categories: int, p: float = K.TRUTH_PROBABILITY) -> DataFrame:
    """Observed and debiased share per category of randomized responses."""
    counts = responses.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("observed"))
    total = counts.agg(F.sum("observed").alias("t")).scalar()
    share = F.col("observed") / total
    return counts.withColumn("observed_share", share).withColumn(
        "estimated_share", randomized.rr_share(share, categories, p)
    )
