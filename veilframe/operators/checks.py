"""Checks on released tables: k-anonymity, l-diversity, t-closeness of plain and of ordered values, utility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import materialize
from . import skew
from .ordering import with_running_total


def equivalence_classes(df: DataFrame, quasi: list[str], k: int) -> DataFrame:
    """Size of every class of equal quasi-identifiers and whether it reaches k."""
    sizes = df.dropna(subset=quasi).groupBy(*quasi).agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("meets_k", F.col("size") >= k)


def diversity_classes(df: DataFrame, quasi: list[str], sensitive: str) -> DataFrame:
    """Distinct sensitive values per class; rows with an unknown quasi-identifier are left out."""
    return df.dropna(subset=quasi).groupBy(*quasi).agg(F.countDistinct(sensitive).alias("diversity"))


def l_diversity(df: DataFrame, quasi: list[str], sensitive: str, l: int = 2) -> DataFrame:
    """One row: classes, classes with fewer than l sensitive values, verdict."""
    classes = diversity_classes(df, quasi, sensitive)
    result = classes.agg(
        F.count(F.lit(1)).alias("classes"),
        F.count_if(F.col("diversity") < l).alias("violations_found"),
    )
    return result.select(
        "classes",
        F.lit(l).alias("l_threshold"),
        "violations_found",
        (F.col("violations_found") == 0).alias("satisfies_l_diversity"),
    )


def _cells(df: DataFrame, quasi: list[str], sensitive: str) -> DataFrame:
    """Known rows counted by ``_class`` and sensitive value; counted once and written, no later step reads the rows again."""
    known = df.dropna(subset=[*quasi, sensitive])
    of_class = F.struct(*[F.col(f"`{c}`") for c in quasi]).alias("_class")
    return materialize(known.groupBy(of_class, F.col(f"`{sensitive}`").alias("_value")).agg(F.count(F.lit(1)).alias("n")))


def _with_totals(cells: DataFrame, **totals: DataFrame) -> DataFrame:
    """Cells joined with tables of one row per key and ``_n_cells``, given by key; frequent keys are split on their number of cells.

    All tables are measured in one action.
    """
    measured = [
        t.agg(
            F.lit(key).alias("key"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_n_cells"), F.lit(0)).alias("cells"),
            F.sum(skew.text_size(F.col(key))).alias("bytes"),
        )
        for key, t in totals.items()
    ]
    for key, rows, cell_rows, text_bytes in reduce(DataFrame.unionByName, measured).collect():
        table = totals[key]
        counts = table.select(key, F.col("_n_cells").alias("n"))
        cells = skew.join_by_value(cells, table.drop("_n_cells"), key, lambda counts=counts: counts, cell_rows, rows, text_bytes)
    return cells


def _class_sizes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("_class").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("_n_cells"))


def t_closeness(df: DataFrame, quasi: list[str], sensitive: str, t: float = 0.2) -> DataFrame:
    """Total-variation distance of each class's sensitive values from the whole table's.

    Values absent from a class are not joined in: together they contribute the
    global share the class does not cover.
    """
    cells = _cells(df, quasi, sensitive)
    overall = cells.groupBy("_value").agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("_n_cells"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = _with_totals(cells, _value=overall, _class=_class_sizes(cells))
    local, world = F.col("n") / F.col("size"), F.col("all_n") / F.lit(float(max(total, 1)))
    distance = F.lit(0.5) * (F.sum(F.abs(local - world)) + F.lit(1.0) - F.sum(world))
    classes = joined.groupBy("_class").agg(F.max("size").alias("size"), distance.alias("distance"))
    return classes.select("_class.*", "size", "distance", (F.col("distance") <= t).alias("meets_t"))


def t_closeness_ordered(df: DataFrame, quasi: list[str], sensitive: str, t: float = 0.2) -> DataFrame:
    """Earth mover's distance of each class's ordered sensitive values from the whole table's.

    A step from one of the table's m values to the next costs 1 / (m - 1), so the distance is the mean gap between
    the cumulative shares of class and table. Rows with an unknown quasi-identifier or value are left out; a table
    with one value has distance 0.

    Values absent from a class are not joined in. Between two of its values a class's share P stands still while the
    table's share Q grows, so the gaps up to a value are known from the sums of Q up to there and up to where Q passes P.
    Both come from running totals in one global order: the places of all P among the Q are found in one sort,
    whatever the size of a class.
    """
    cells = _cells(df, quasi, sensitive)
    whole = cells.groupBy("_value").agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_n_cells"))
    places = with_running_total(whole, ["_value"], {"_upto": F.col("_all"), "_place": F.lit(1)})
    # sums of shares can pass the range of a long
    exact = F.col("_upto").cast("decimal(38,0)")
    places = materialize(with_running_total(places, ["_value"], {"_sum": exact}))
    total, values, all_sums = places.agg(F.coalesce(F.sum("_all"), F.lit(0)), F.count(F.lit(1)), F.sum(exact)).first()
    before = places.select(
        "_value", "_n_cells", (F.col("_place") - 1).alias("_place"), (F.col("_sum") - exact).alias("_sum")
    )
    ranked = with_running_total(cells, ["_class", "_value"], {"_in_order": F.col("n")})
    starts = ranked.groupBy("_class").agg(
        F.sum("n").alias("size"), F.min(F.col("_in_order") - F.col("n")).alias("_start"), F.count(F.lit(1)).alias("_n_cells")
    )
    joined = _with_totals(ranked, _value=before, _class=starts)
    upto = F.col("_in_order") - F.col("_start")
    # a cell ends the stretch of the share before it and begins that of its own: the gaps up to its place count once with either sign
    ends = F.array(
        F.struct(F.lit(1).alias("_sign"), (upto - F.col("n")).alias("_rows")), F.struct(F.lit(-1).alias("_sign"), upto.alias("_rows"))
    )
    probes = joined.select("_class", "size", "_place", "_sum", F.inline(ends))
    probes = probes.withColumn(
        "_at", F.expr(f"(CAST(_rows AS DECIMAL(19,0)) * CAST({total} AS DECIMAL(19,0))) div CAST(size AS DECIMAL(19,0))")
    )
    table = places.select(F.col("_upto").alias("_at"), exact.alias("_q"))
    mixed = table.withColumn("_kind", F.lit(0)).unionByName(probes.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    order = ["_at", "_kind", "_class", "_place", "_sign"]
    passed = with_running_total(mixed, order, {"_below": 1 - F.col("_kind"), "_below_sum": F.coalesce("_q", F.lit(0).cast("decimal(38,0)"))})
    every = F.lit(float(max(total, 1)))
    share = F.col("_rows") / F.col("size")
    inside = F.col("_below") < F.col("_place")
    low = F.when(inside, F.col("_below")).otherwise(F.col("_place"))
    low_sum = F.when(inside, F.col("_below_sum")).otherwise(F.col("_sum")).cast("double") / every
    gaps = share * (2 * low - F.col("_place")) + F.col("_sum").cast("double") / every - 2 * low_sum
    moved = F.sum(F.col("_sign") * gaps) + F.lit(values - float(all_sums or 0) / max(total, 1))
    classes = passed.where("_kind = 1").groupBy("_class").agg(
        F.max("size").alias("size"), F.greatest(F.lit(0.0), moved / F.lit(float(max(values - 1, 1)))).alias("distance")
    )
    return classes.select("_class.*", "size", "distance", (F.col("distance") <= t).alias("meets_t"))


def utility(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of cells that still carry a value instead of a marker text."""
    columns = columns or df.columns
    lost = F.lit(0)
    for c in columns:
        marked = F.coalesce(F.col(f"`{c}`").cast("string").isin(*K.UTILITY_MARKERS), F.lit(False))
        lost = lost + marked.cast("int")
    result = df.agg(
        (F.count(F.lit(1)) * F.lit(len(columns))).alias("total_values"),
        F.coalesce(F.sum(lost), F.lit(0)).alias("redacted_values"),
    )
    kept = F.col("total_values") - F.col("redacted_values")
    score = F.bround(kept / F.nullif(F.col("total_values"), F.lit(0)) * 100.0, 2)
    return result.select(
        "total_values",
        "redacted_values",
        kept.alias("preserved_values"),
        F.coalesce(score, F.lit(0.0)).alias("utility_preservation_score"),
    )
