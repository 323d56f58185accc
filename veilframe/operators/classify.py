"""Column classification from names, value patterns and uniqueness.

All columns are profiled in one job. In the exact mode equal values are
counted first, after they were dealt by value and turn: no task holds more values
than its share, and a value holding a third of all rows is counted in several
tasks. The approximate mode skips that shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import parse
from ..functions.randomized import is_currency

TURNS = 32  # tasks that count one value


def classify_name(name: str) -> tuple[str, str] | None:
    """(type, sensitivity) by column name, or None."""
    for kind, sensitivity, patterns in K.NAME_RULES:
        if any(re.search(p, name.lower(), re.I) for p in patterns):
            return kind, sensitivity
    return None


def _names_table(spark: SparkSession, columns: list[str]) -> DataFrame:
    """One row per column of the schema with what its name says."""
    rows = []
    for position, name in enumerate(columns):
        found = classify_name(name)
        kind, sensitivity = (parse.sql_text(v) for v in found) if found else ("CAST(NULL AS STRING)",) * 2
        currency = str(is_currency(name)).lower()
        rows.append(f"({parse.sql_text(name)}, {position}, {kind}, {sensitivity}, {currency})")
    return spark.sql(
        f"SELECT * FROM VALUES {', '.join(rows)} AS t(column, position, name_type, name_sensitivity, currency)"
    )


def long_form(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Non-null values as (column, value) text rows."""
    pairs = ", ".join(
        f"named_struct('column', {parse.sql_text(c)}, 'value', CAST({parse.sql_name(c)} AS STRING))" for c in columns
    )
    return df.selectExpr(*keep, f"inline(array({pairs}))").where("value IS NOT NULL")


def _pattern_column(name: str) -> str:
    return f"m_{name}"


# A cheap test every match must pass, tried before the pattern itself.
_NEEDS = {
    "email": "contains(value, '@')",
    "uuid": "length(value) BETWEEN 36 AND 38",
    "ssn": "length(value) BETWEEN 9 AND 13",
    "credit_card": "length(value) BETWEEN 16 AND 21",
    "date_iso": "contains(value, '-')",
    "timestamp": "contains(value, ':')",
    "gps": "contains(value, ',')",
    "url": "contains(value, '://')",
    "ip_address": "contains(value, '.')",
    "password_hash": "(length(value) >= 32 OR startswith(value, '$'))",
}


def _value_tests() -> dict[str, str]:
    """SQL conditions on ``value``, by the name of their count."""
    tests = {}
    for name, pattern, _, _ in K.VALUE_PATTERNS:
        matched = f"value RLIKE {parse.sql_text('(?iU)' + pattern)}"
        tests[_pattern_column(name)] = f"{_NEEDS[name]} AND {matched}" if name in _NEEDS else matched
    blanks, number = parse.sql_text(parse.BLANKS), parse.sql_text(parse.FLOAT_PATTERN)
    bare = f"btrim(translate(value, '$,', ''), {blanks})"
    tests["m_float"] = f"btrim(value, {blanks}) RLIKE {number}"
    tests["m_number"] = f"{bare} RLIKE {number}"
    # a digit other than zero before the exponent
    tests["m_nonzero"] = f"{bare} RLIKE {number} AND {bare} RLIKE '^[^eE]*[1-9]'"
    tests["m_blank"] = "NOT value RLIKE '\\\\S'"
    return tests


def profile_columns(
    df: DataFrame,
    columns: list[str] | None = None,
    distinct: str = "exact",
    sample_by: list[str] | None = None,
) -> DataFrame:
    """One row per column: name verdict, counts, distinct values, pattern counts.

    ``sample_by`` profiles the first 100 rows by that order key (patterns on
    the first 50 values of each column) instead of the whole table.
    """
    columns = columns or df.columns
    tests = _value_tests()
    if sample_by:
        head = df.orderBy(*sample_by).limit(K.CLASSIFY_SAMPLE_ROWS)
        keys = [f"_k{i}" for i in range(len(sample_by))]
        keyed = head.select(*[F.col(k).alias(name) for k, name in zip(sample_by, keys)], *columns)
        place = Window.partitionBy("column").orderBy(*keys)
        values = long_form(keyed, columns, keys)
        values = values.withColumn("early", F.row_number().over(place) <= K.PATTERN_SAMPLE_VALUES)
        every = ("m_number", "m_nonzero", "m_blank")
        stats = values.groupBy("column").agg(
            F.expr("count(1) AS n"),
            F.expr("count(DISTINCT value) AS distinct"),
            F.expr("count_if(early) AS pattern_n"),
            F.expr("count(DISTINCT CASE WHEN early THEN value END) AS pattern_distinct"),
            *[F.expr(f"count_if(({t}) AND ({str(s in every).lower()} OR early)) AS {s}") for s, t in tests.items()],
        )
    elif distinct == "exact":
        # only a 128-bit digest of each value and the outcome of the tests are shuffled, never its text
        bits = " | ".join(f"CASE WHEN {t} THEN {1 << i}L ELSE 0L END" for i, t in enumerate(tests.values()))
        marked = long_form(df, columns).selectExpr(
            "column", "xxhash64(value) AS h1", "xxhash64(1, value) AS h2", f"{bits} AS bits"
        )
        # dealt by value and turn before they are counted: a task that reads many rows keeps no table of all its values,
        # and a value that many rows hold is counted in ``TURNS`` tasks first
        dealt = marked.withColumn("turn", F.pmod(F.monotonically_increasing_id(), F.lit(TURNS)).cast("int"))
        dealt = dealt.repartition("column", "h1", "h2", "turn")
        counted = dealt.groupBy("column", "h1", "h2").agg(F.count(F.lit(1)).alias("c"), F.max("bits").alias("bits"))
        stats = counted.groupBy("column").agg(
            F.expr("sum(c) AS n"),
            F.expr("count(1) AS distinct"),
            *[F.expr(f"coalesce(sum(c) FILTER (WHERE bits & {1 << i}L <> 0), 0) AS {s}") for i, s in enumerate(tests)],
        )
        stats = stats.selectExpr("*", "n AS pattern_n", "distinct AS pattern_distinct")
    elif distinct == "approx":
        stats = long_form(df, columns).groupBy("column").agg(
            F.expr("count(1) AS n"),
            F.expr("approx_count_distinct(value, 0.01) AS distinct"),
            *[F.expr(f"count_if({t}) AS {s}") for s, t in tests.items()],
        )
        stats = stats.selectExpr("*", "n AS pattern_n", "distinct AS pattern_distinct")
    else:
        raise ValueError("distinct is 'exact' or 'approx'")
    names = _names_table(df.sparkSession, columns)
    counts = ["n", "distinct", "pattern_n", "pattern_distinct", *tests]
    return names.join(stats, "column", "left").fillna(0, subset=counts)


def _signal(kind: str, sensitivity: str, confidence: str, reasoning: str) -> str:
    return (
        f"named_struct('type', {kind}, 'sensitivity', {sensitivity}, "
        f"'confidence', CAST({confidence} AS DOUBLE), 'reasoning', {reasoning})"
    )


def with_signals(profile: DataFrame) -> DataFrame:
    """Add what each source says about a column; null where it is silent.

    by_name:       the column name
    by_values:     best value pattern, else numeric share, else few distinct values
    by_uniqueness: share of distinct values
    """
    candidates = ", ".join(
        f"named_struct('share', {_pattern_column(name)} / pattern_n, 'rank', {-rank}, 'name', '{name}', "
        f"'type', '{kind}', 'sensitivity', '{sensitivity}')"
        for rank, (name, _, kind, sensitivity) in enumerate(K.VALUE_PATTERNS)
    )
    # no values, no candidates: the shares are only formed for columns that have some
    best = profile.selectExpr(
        "*",
        f"CASE WHEN pattern_n > 0 THEN array_max(filter(array({candidates}), s -> s.share > {K.PATTERN_SHARE})) END "
        "AS _best",
        "CASE WHEN n > 0 THEN distinct / n END AS _share",
    )
    by_name = _signal(
        "name_type", "name_sensitivity", f"{K.NAME_CONFIDENCE}", "concat('Column name matches ', name_type, ' pattern')"
    )
    matched = _signal(
        "_best.type", "_best.sensitivity", "_best.share", "concat('Matches ', _best.name, ' pattern')"
    )
    numeric = _signal("'numeric'", "'low'", "0.7", "'Values are primarily numeric'")
    few = _signal("'categorical'", "'low'", "0.6", "'Limited unique values suggest categorical'")

    def unique(kind: str, sensitivity: str, confidence: str, label: str) -> str:
        shown = f"concat('{label} uniqueness ', format_string('(%.2f%%)', _share * 100D))"
        return _signal(f"'{kind}'", f"'{sensitivity}'", confidence, shown)

    return best.selectExpr(
        "*",
        f"CASE WHEN name_type IS NOT NULL THEN {by_name} END AS by_name",
        f"CASE WHEN pattern_n = 0 THEN NULL WHEN _best IS NOT NULL THEN {matched} "
        f"WHEN m_float / pattern_n > {K.PATTERN_SHARE} THEN {numeric} "
        f"WHEN pattern_distinct / pattern_n < 0.5 THEN {few} END AS by_values",
        f"CASE WHEN _share > 0.95 THEN {unique('identifier', 'high', '0.7', 'Very high')} "
        f"WHEN _share > 0.7 THEN {unique('quasi_identifier', 'moderate', '0.6', 'High')} "
        f"WHEN _share < 0.3 THEN {unique('categorical', 'low', '0.6', 'Low')} END AS by_uniqueness",
    ).drop("_best", "_share")


def recommended_mechanism() -> str:
    """SQL: mechanism by type; critical columns are always redacted."""
    by_type = " ".join(f"WHEN '{kind}' THEN '{mechanism}'" for kind, mechanism in K.RECOMMENDED.items())
    return f"CASE WHEN sensitivity = 'critical' THEN 'redaction' ELSE CASE type {by_type} ELSE 'suppression' END END"


def combine_signals(profile: DataFrame) -> DataFrame:
    """The strongest signal per column: name x1.2, values x1.0, uniqueness x0.8."""
    weights = [("by_name", K.NAME_WEIGHT), ("by_values", 1.0), ("by_uniqueness", K.STATISTICS_WEIGHT)]
    weighted = ", ".join(
        f"CASE WHEN {signal} IS NOT NULL THEN named_struct('weight', {signal}.confidence * {weight}D, "
        f"'rank', {-rank}, 'signal', {signal}) END"
        for rank, (signal, weight) in enumerate(weights)
    )
    silent = _signal("'generic'", "'low'", "0.5", "'Default classification'")
    empty = _signal("'generic'", "'low'", "0.0", "'No data available'")
    chosen = with_signals(profile).selectExpr("*", f"array_max(array({weighted})) AS _win")
    decided = chosen.selectExpr(
        "*", f"CASE WHEN n = 0 THEN {empty} WHEN _win IS NULL THEN {silent} ELSE _win.signal END AS _s"
    ).selectExpr(
        "* EXCEPT (_s, _win, by_name, by_values, by_uniqueness)",
        "_s.type AS type",
        "_s.sensitivity AS sensitivity",
        "CASE WHEN n = 0 OR _win IS NULL THEN _s.confidence ELSE least(_win.weight, 1D) END AS confidence",
        "_s.reasoning AS reasoning",
    )
    return decided.selectExpr("*", f"CASE WHEN n = 0 THEN 'suppression' ELSE {recommended_mechanism()} END AS mechanism")


def classify_columns(
    df: DataFrame,
    columns: list[str] | None = None,
    distinct: str = "exact",
    sample_by: list[str] | None = None,
) -> DataFrame:
    """Type, sensitivity, confidence, mechanism and reasoning of every column."""
    combined = combine_signals(profile_columns(df, columns, distinct, sample_by))
    return combined.select("column", "type", "sensitivity", "confidence", "mechanism", "reasoning")


def signal_table(profile: DataFrame, signal: str) -> DataFrame:
    """One signal alone (a column of ``with_signals``); generic with confidence 0 where it is silent."""
    silent = _signal("'generic'", "'low'", "0.0", "''")
    chosen = with_signals(profile).selectExpr("column", f"coalesce({signal}, {silent}) AS s")
    return chosen.select("column", "s.type", "s.sensitivity", "s.confidence")


def numeric_override(classified: DataFrame) -> DataFrame:
    """Effective type after treating numeric-looking and money columns as numeric.

    Takes the output of ``combine_signals``.
    """
    filled = F.col("n") - F.col("m_blank")
    numeric = F.coalesce(F.col("m_number") / F.nullif(filled, F.lit(0)) >= K.NUMERIC_SHARE, F.lit(False))
    open_type = F.col("type").isin("sensitive", "generic", "identifier", "quasi_identifier") & (F.col("n") > 0)
    effective = F.when(open_type & (numeric | F.col("currency")), "numeric").otherwise(F.col("type"))
    return classified.withColumn("looks_numeric", numeric).withColumn("effective_type", effective)


def report(classified: DataFrame) -> DataFrame:
    """Columns grouped by type; at most one entry per column of the schema."""
    entry = F.struct("column", "sensitivity", "confidence", "mechanism")
    return classified.groupBy("type").agg(
        F.count(F.lit(1)).alias("columns"), F.array_sort(F.collect_list(entry)).alias("details")
    )


def layout_defaults(layout: DataFrame, name: str = "name") -> DataFrame:
    """Default treatment of layout fields by name: hash, noise or none."""
    field = F.lower(F.col(name))

    def any_of(words: list[str]) -> Column:
        return field.rlike("|".join(re.escape(w) for w in words))

    return layout.withColumn(
        "treatment",
        F.when(any_of(K.LAYOUT_HASH_WORDS), "hash").when(any_of(K.LAYOUT_NOISE_WORDS), "noise").otherwise("none"),
    )
