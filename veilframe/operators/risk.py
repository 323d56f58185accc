"""Re-identification risk of records, datasets and groups.

A record's risk combines independent hits: 100 * (1 - prod(1 - p/100)). It is
built here as one product of CASE factors per row (the share of risk that
survives each hit), so scoring is a single code-generated projection followed
by a two-number aggregate, whatever the number of columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import parse
from .ordering import first_middle_last

_INTEGRAL = {"tinyint", "smallint", "int", "bigint"}
_FRACTIONAL = {"float", "double"}


@dataclass
class Hit:
    """One rule on one column: SQL condition, weight and driver text."""

    check: str
    condition: str
    weight: int
    driver: str


def _kind(data_type: str) -> str:
    if data_type in _INTEGRAL or re.fullmatch(r"decimal\(\d+,0\)", data_type):
        return "integral"
    if data_type in _FRACTIONAL or data_type.startswith("decimal"):
        return "fractional"
    return "text"


def _rlike(text: str, pattern: str) -> str:
    return f"{text} RLIKE {parse.sql_text(pattern)}"


def _contains(text: str, part: str) -> str:
    return f"contains({text}, {parse.sql_text(part)})"


# A cheap test every match must pass, tried before the pattern itself.
_NEEDS = {
    r"^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$": "-",
    r"^[\w\.-]+@[\w\.-]+\.\w+$": "@",
    r"^\d+\.\d{4,}$": ".",
    r"^\d{4}-\d{2}-\d{2}.\d{2}:\d{2}:\d{2}": ":",
    r"^-?\d+\.\d{4,},\s*-?\d+\.\d{4,}$": ",",
}


def anonymized_sql(text: str) -> str:
    """Condition: the value already looks like a hash, marker or range."""
    markers = ", ".join(parse.sql_text(m) for m in K.ANONYMIZED_MARKERS)
    hashed = f"length({text}) >= 32 AND {_rlike(text, '(?i)^[a-f0-9]{32,}$')}"
    dashed = f"({_contains(text, '-')} OR {_contains(text, '–')}) AND " + _rlike(text, r"(?U)^\d+[k]?[-–]\d+[k]?$")
    return f"({hashed} OR endswith({text}, '...') OR {text} IN ({markers}) OR {dashed})"


def _value_rule(text: str, pattern: str, ignore_case: bool) -> str:
    if pattern == "long":
        return f"length({text}) > 20 AND NOT ({_rlike(text, '(?i)^[a-f0-9]+$')})"
    matched = _rlike(text, ("(?iU)" if ignore_case else "(?U)") + pattern)
    return f"{_contains(text, _NEEDS[pattern])} AND {matched}" if pattern in _NEEDS else matched


def _value_rule_possible(pattern: str, kind: str) -> bool:
    """Whether the text of a number can satisfy a value rule at all."""
    if kind == "integral":
        return pattern == r"^\+?\d{10,13}$"
    if kind == "fractional":
        return pattern in (r"^\d+\.\d{4,}$", "long")
    return True


def _open_rules(field: str) -> list[tuple[str, str, int]]:
    """Sensitivity rules the field name does not decide by itself."""
    return [rule for rule in K.SENSITIVE_RULES if not re.search(rule[0], field + " ", re.I)]


# Above this length plain substring searches beat a pattern with many alternatives,
# below it the pattern beats the many searches.
_LONG_TEXT = 256


def _alternatives(pattern: str) -> str:
    return pattern.removeprefix(r"\b").removesuffix(r"\b").strip("()")


def _mentions(words: str, pattern: str) -> str:
    """Condition: the text contains the literal beginning of one of a rule's alternatives.

    The long s equals s when case is ignored, so it counts as a beginning too.
    """
    beginnings = [re.match("[a-z]+", a).group() for a in _alternatives(pattern).split("|")]
    return " OR ".join(_contains(words, b) for b in [*beginnings, "ſ"])


def _any_word(words: str, field: str) -> str:
    """Condition: a sensitive word may occur, for all rules at once.

    ASCII word ends admit every match the exact rules, with word ends of any
    script, can make.
    """
    patterns = [p for p, _, _ in _open_rules(field)]
    short = _rlike(words, r"\b(" + "|".join(_alternatives(p) for p in patterns) + r")\b")
    long = " OR ".join(_mentions(words, p) for p in patterns)
    return f"CASE WHEN length({words}) > {_LONG_TEXT} THEN {long} ELSE {short} OR {_contains(words, 'ſ')} END"


def _sensitive(i: int, pattern: str) -> str:
    """Condition: a sensitivity rule holds for scanned column number ``i``."""
    words = f"_w{i}"
    guarded = f"(length({words}) <= {_LONG_TEXT} OR {_mentions(words, pattern)})"
    return f"_a{i} AND {guarded} AND {_rlike(words, '(?iU)' + pattern)}"


@dataclass
class Scan:
    """Rows prepared for scoring and the rules that apply to them.

    The frame carries one column per scanned column with the text that counts
    (null when blank or anonymized already), one with its lower-case ``field
    value`` form and one telling whether any sensitive word occurs in it, so
    every rule reads a finished value instead of repeating the tests before it.
    """

    df: DataFrame
    hits: list[Hit]


def _types(df: DataFrame, columns: list[str] | None) -> list[tuple[str, str]]:
    types = dict(df.dtypes)
    return [(name, types[name]) for name in (columns or df.columns)]


def scan(df: DataFrame, columns: list[str] | None = None) -> Scan:
    """Prepare a table: adds ``filled`` and the working columns."""
    typed = [(i, name, _kind(t)) for i, (name, t) in enumerate(_types(df, columns))]
    texts = [(i, name) for i, name, kind in typed if kind == "text"]
    cast = {i: f"CAST({parse.sql_name(name)} AS STRING)" for i, name, _ in typed}

    known = df.selectExpr("*", *[f"coalesce({_rlike(cast[i], chr(92) + 'S')}, false) AS _p{i}" for i, _ in texts])
    present = [
        f"_p{i}" if kind == "text" else f"{parse.sql_name(name)} IS NOT NULL" for i, name, kind in typed
    ]
    filled = " + ".join(f"CAST({p} AS INT)" for p in present)
    live = [
        f"CASE WHEN _p{i} AND NOT {anonymized_sql(cast[i])} THEN {cast[i]} END" if kind == "text" else cast[i]
        for i, _, kind in typed
    ]
    lived = known.selectExpr("*", f"{filled} AS filled", *[f"{live[i]} AS _l{i}" for i, _, _ in typed])
    lowered = lived.selectExpr(
        "*", *[f"concat({parse.sql_text(name.lower() + ' ')}, lower(_l{i})) AS _w{i}" for i, name in texts]
    )
    flagged = lowered.selectExpr("*", *[f"{_any_word(f'_w{i}', name.lower())} AS _a{i}" for i, name in texts])
    return Scan(flagged, [hit for i, name, kind in typed for hit in column_hits(i, name, kind)])


def column_hits(i: int, name: str, kind: str) -> list[Hit]:
    """The rules that can fire for scanned column number ``i``.

    Rules that depend on the column name alone are decided here, once, and
    rules that the column's type rules out are left out of the plan.
    """
    field, live, present = name.lower(), f"_l{i}", f"_l{i} IS NOT NULL"
    hits = []
    for pattern, ignore_case, weight, driver in K.UNIQUENESS_RULES:
        if _value_rule_possible(pattern, kind):
            hits.append(Hit("uniqueness", _value_rule(live, pattern, ignore_case), weight, driver))

    if re.search(K.NAME_FIELD_PATTERN, field, re.I):
        hits.append(Hit("sensitivity", present, K.NAME_FIELD_WEIGHT, K.NAME_FIELD_DRIVER))
    elif field.strip() == "name":
        hits.append(Hit("sensitivity", present, K.PLAIN_NAME_WEIGHT, K.PLAIN_NAME_DRIVER))
    open_rules = _open_rules(field)
    for rule in K.SENSITIVE_RULES:
        pattern, driver, weight = rule
        if rule not in open_rules:
            hits.append(Hit("sensitivity", present, weight, driver))
        elif kind == "text":
            hits.append(Hit("sensitivity", _sensitive(i, pattern), weight, driver))
    if parse.has_any(field, K.ID_FIELD_WORDS):
        if parse.has_any(field, K.SEQUENCE_FIELD_WORDS):
            hits.append(Hit("sensitivity", present, K.SEQUENCE_WEIGHT, K.SEQUENCE_DRIVER))
        else:
            hits.append(Hit("sensitivity", present, K.DIRECT_ID_WEIGHT, K.DIRECT_ID_DRIVER))
    if kind == "integral":
        small = f"{parse.sql_name(name)} BETWEEN 1 AND 119"
        hits.append(Hit("sensitivity", small, K.AGE_VALUE_WEIGHT, K.AGE_VALUE_DRIVER))
    elif kind == "text":
        small = _rlike(live, "^([1-9]|0[1-9]|[1-9][0-9]|00[1-9]|0[1-9][0-9]|1[01][0-9])$")
        hits.append(Hit("sensitivity", f"length({live}) <= 3 AND {small}", K.AGE_VALUE_WEIGHT, K.AGE_VALUE_DRIVER))

    for pattern, weight, driver in K.PRECISION_RULES:
        if _value_rule_possible(pattern, kind):
            hits.append(Hit("precision", _value_rule(live, pattern, False), weight, driver))
    return hits


def survival(hits: list[Hit]) -> Column:
    """Product of (1 - weight/100) over the hits that fire."""
    factors = [f"CASE WHEN {h.condition} THEN {1.0 - h.weight / 100.0}D ELSE 1D END" for h in hits]
    return F.expr(" * ".join(["1D", *factors]))


def is_anonymized(name: str) -> Column:
    """Whether a column's value already looks like a hash, marker or range."""
    return F.expr(anonymized_sql(f"CAST({parse.sql_name(name)} AS STRING)"))


def combination_risk(filled: Column) -> Column:
    """Weight of the number of filled attributes."""
    result = F.lit(0)
    for at_least, weight, _ in reversed(K.COMBINATION_RULES):
        result = F.when(filled >= at_least, F.lit(weight)).otherwise(result)
    return result.cast("double")


def _combination_driver(filled: Column) -> Column:
    label = None
    for at_least, _, text in K.COMBINATION_RULES:
        before, _, after = text.partition("{n}")
        shown = F.concat(F.lit(before), filled.cast("string"), F.lit(after)) if "{n}" in text else F.lit(text)
        label = F.when(filled >= at_least, shown) if label is None else label.when(filled >= at_least, shown)
    return label


def noisy_or(factors: Column) -> Column:
    """100 * (1 - prod(1 - p/100)) over an array of positive factors, at most 100."""
    left = F.aggregate(
        factors,
        F.lit(1.0),
        lambda acc, p: acc * F.when(p > 0, 1.0 - F.least(p, F.lit(100.0)) / 100.0).otherwise(F.lit(1.0)),
    )
    return F.least(F.lit(100.0), (F.lit(1.0) - left) * 100.0)


def score_records(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add the four check results and ``risk`` to every record."""
    scanned = scan(df, columns)

    def left(check: str) -> Column:
        return survival([hit for hit in scanned.hits if hit.check == check])

    originals = [F.col(f"`{c}`") for c in df.columns]
    combination = combination_risk(F.col("filled"))
    scored = scanned.df.select(
        *originals,
        "filled",
        left("uniqueness").alias("_u"),
        left("sensitivity").alias("_s"),
        left("precision").alias("_p"),
        combination.alias("combination_risk"),
    )
    left_over = F.col("_u") * F.col("_s") * F.col("_p") * (1.0 - F.col("combination_risk") / 100.0)
    return scored.select(
        *originals,
        "filled",
        ((1.0 - F.col("_u")) * 100.0).alias("uniqueness_risk"),
        ((1.0 - F.col("_s")) * 100.0).alias("sensitivity_risk"),
        "combination_risk",
        ((1.0 - F.col("_p")) * 100.0).alias("precision_risk"),
        F.when(F.col("filled") == 0, F.lit(K.EMPTY_RECORD_RISK))
        .otherwise(F.least(F.lit(100.0), (1.0 - left_over) * 100.0))
        .alias("risk"),
    )


def dataset_score(risk: Column) -> Column:
    """Aggregate: 0.4 * max + 0.6 * mean, rounded half to even, 0-100; 10 when empty."""
    blended = F.rint(F.lit(K.MAX_SHARE) * F.max(risk) + F.lit(K.MEAN_SHARE) * F.avg(risk))
    known = F.coalesce(blended, F.lit(float(K.NO_DATA_RISK)))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), known)).cast("int")


def risk_level(score: Column) -> Column:
    """Name of the risk band."""
    label = None
    for bound, name in K.RISK_LEVELS:
        label = F.when(score <= bound, name) if label is None else label.when(score <= bound, name)
    return label.otherwise(K.TOP_RISK_LEVEL)


def risk_meter(score: Column) -> Column:
    """Text bar of 20 cells."""
    filled = F.floor(score / F.lit(100.0) * F.lit(K.METER_CELLS)).cast("int")
    bar = F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(K.METER_CELLS) - filled))
    return F.concat(F.lit("["), bar, F.lit("] "), score.cast("string"), F.lit(" / 100"))


def _with_labels(scores: DataFrame) -> DataFrame:
    return scores.withColumn("risk_level", risk_level(F.col("risk_score"))).withColumn(
        "risk_meter", risk_meter(F.col("risk_score"))
    )


def dataset_risk(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: record count, score, level and meter over all records."""
    scored = score_records(df, columns)
    return _with_labels(
        scored.agg(
            F.count(F.lit(1)).alias("records"), dataset_score(F.col("risk")).alias("risk_score")
        )
    )


def sampled_dataset_risk(df: DataFrame, order_by: list[str], columns: list[str] | None = None) -> DataFrame:
    """The score of the first, middle and last five records only."""
    return dataset_risk(first_middle_last(df, order_by), columns or df.columns)


def group_risk(df: DataFrame, group: str, columns: list[str] | None = None) -> DataFrame:
    """One score per group; partial aggregation keeps a dominant group cheap."""
    columns = columns or [c for c in df.columns if c != group]
    scored = score_records(df, columns)
    return _with_labels(
        scored.groupBy(group).agg(
            F.count(F.lit(1)).alias("records"), dataset_score(F.col("risk")).alias("risk_score")
        )
    )


def record_drivers(scanned: Scan) -> Column:
    """Array of driver texts of a scanned record, in the order the checks find them."""

    def found(check: str) -> Column:
        texts = [
            f"CASE WHEN {h.condition} THEN {parse.sql_text(h.driver)} END" for h in scanned.hits if h.check == check
        ]
        return F.expr(f"array_compact(array({', '.join(texts)}))") if texts else F.array().cast("array<string>")

    filled = F.col("filled")
    combination = F.array_compact(F.array(_combination_driver(filled)))
    drivers = F.concat(
        found("uniqueness"), F.array_distinct(found("sensitivity")), combination, found("precision")
    )
    return F.when(filled == 0, F.array(F.lit(K.EMPTY_RECORD_DRIVER))).otherwise(drivers)


def top_drivers(
    df: DataFrame, order_by: list[str], columns: list[str] | None = None, limit: int = 5
) -> DataFrame:
    """The most frequent drivers; ties go to the driver that appears first."""
    scanned = scan(df, columns)
    found = scanned.df.select(*order_by, record_drivers(scanned).alias("_drivers"))
    # the outer form: an inner explode would push a filter that scores every record twice
    rows = found.select(*order_by, F.posexplode_outer("_drivers").alias("_pos", "driver"))
    place = F.struct(*order_by, "_pos")
    if len(order_by) == 1 and dict(found.dtypes).get(order_by[0]) in _INTEGRAL:
        # key and position as one number: a least number is kept in a hash table, a least struct sorts all rows
        key = F.coalesce(F.col(f"`{order_by[0]}`").cast("decimal(20,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(20,0)"))
        place = key * F.lit(10**6).cast("decimal(7,0)") + F.col("_pos")
    counted = rows.where(F.col("driver").isNotNull()).groupBy("driver").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(place).alias("_first"),
    )
    return counted.orderBy(F.desc("n"), "_first").limit(limit).select("driver", "n")


def anonymized_share(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: values present and values that already look anonymized."""
    types = _types(df, columns)
    measures = []
    for name, _ in types:
        text = F.col(f"`{name}`").cast("string")
        present = ~parse.is_blank(text)
        measures.append(F.count_if(present).alias(f"p_{name}"))
        measures.append(F.count_if(present & is_anonymized(name)).alias(f"a_{name}"))
    wide = df.agg(*measures)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.col(f"`p_{name}`").alias("present"),
                F.col(f"`a_{name}`").alias("anonymized"),
            )
            for name, _ in types
        ]
    )
    return wide.select(F.inline(rows)).withColumn(
        "share", F.coalesce(F.col("anonymized") / F.nullif(F.col("present"), F.lit(0)), F.lit(0.0))
    )


# ------------------------------------------------------------------ residual risk
def protection_group(mechanism: Column, guarantee: Column) -> Column:
    """Group of protection a column received."""
    dp = guarantee.contains("DIFFERENTIAL_PRIVACY") | mechanism.isin(*K.MECHANISM_GROUPS["dp"])
    label = F.when(dp, "dp")
    for group in ("hashed", "masked", "suppressed", "generalized"):
        label = label.when(mechanism.isin(*K.MECHANISM_GROUPS[group]), group)
    return label.otherwise("untouched")


def default_mechanism(mechanism: Column, column_type: Column) -> Column:
    """The stated mechanism, or the usual one of the column type when none is stated."""
    usual = (
        F.when(column_type == "identifier", "hashing")
        .when(column_type == "sensitive", "redaction")
        .when(column_type == "quasi_identifier", "k_anonymity")
        .when(column_type.isin("temporal", "geospatial"), "generalization")
        .when(column_type == "numeric", "laplace_noise")
        .otherwise("")
    )
    stated = F.lower(F.coalesce(mechanism, F.lit("")))
    return F.when(stated == "", usual).otherwise(stated)


def grouped_columns(metadata: DataFrame) -> DataFrame:
    """Column metadata with its protection group and weight.

    ``metadata`` has one row per column: column, position, type, mechanism, guarantee.
    """
    mechanism = default_mechanism(F.col("mechanism"), F.lower("type"))
    group = protection_group(mechanism, F.upper(F.coalesce("guarantee", F.lit(""))))
    grouped = metadata.withColumn("protection", group)
    weights = F.create_map(*[F.lit(x) for pair in K.PROTECTION_WEIGHTS.items() for x in pair])
    return grouped.withColumn("weight", F.element_at(weights, F.col("protection")))


def residual_score(anonymized_score: Column, coverage: Column) -> Column:
    """Score after the discount for coverage, with its floor; undiscounted without metadata."""
    discounted = anonymized_score * (1.0 - F.least(coverage, F.lit(1.0)) * K.COVERAGE_DISCOUNT)
    floor = F.greatest(F.lit(K.RISK_FLOOR), anonymized_score * K.RISK_FLOOR_SHARE)
    final = F.least(F.lit(100.0), F.rint(F.greatest(discounted, floor)))
    return F.when(coverage.isNull(), anonymized_score).otherwise(final).cast("int")


def residual_risk(anonymized: DataFrame, metadata: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Risk left after treatment: what the scanner still finds, less the coverage discount."""
    coverage = grouped_columns(metadata).agg(F.avg("weight")).scalar()
    found = dataset_risk(anonymized, columns).select(F.col("risk_score").alias("scanner_score"))
    result = found.withColumn("coverage", coverage)
    score = residual_score(F.col("scanner_score").cast("double"), F.col("coverage"))
    return _with_labels(result.withColumn("risk_score", score))


def residual_drivers(
    anonymized: DataFrame,
    metadata: DataFrame,
    epsilon: str,
    order_by: list[str],
    columns: list[str] | None = None,
) -> DataFrame:
    """Ordered driver texts of the residual risk (position, driver)."""
    grouped = grouped_columns(metadata)
    counts = {
        group: F.count_if(F.col("protection") == group).alias(group) for group in K.PROTECTION_WEIGHTS
    }
    names = F.transform(
        F.array_sort(
            F.collect_list(F.when(F.col("protection") == "untouched", F.struct("position", "column")))
        ),
        lambda s: s["column"],
    )
    # one row per column of the table: bounded by the schema
    summary = grouped.agg(*counts.values(), names.alias("names"))
    more = F.when(
        F.col("untouched") > 3, F.concat(F.lit(" (+"), (F.col("untouched") - 3).cast("string"), F.lit(" more)"))
    ).otherwise("")

    def line(group: str, *parts: Column) -> Column:
        return F.when(F.col(group) > 0, F.concat(F.col(group).cast("string"), *parts))

    texts = [
        line("dp", F.lit(f" numeric column(s) protected with Differential Privacy (ε={epsilon})")),
        line("hashed", F.lit(" identifier(s) hashed/pseudonymized — direct re-identification removed")),
        line("masked", F.lit(" quasi-identifier(s) masked/k-anonymized — partial linkage risk remains")),
        line("generalized", F.lit(" column(s) generalized/bucketed — exact values no longer present")),
        line("suppressed", F.lit(" column(s) suppressed — values removed but field exists")),
        line(
            "untouched",
            F.lit(" column(s) received no protection ("),
            F.concat_ws(", ", F.slice("names", 1, 3)),
            more,
            F.lit(") — residual risk"),
        ),
    ]
    score = dataset_risk(anonymized, columns).select("risk_score").scalar()
    top = top_drivers(anonymized, order_by, columns, limit=1).select("driver").scalar()
    texts.append(F.when((score > 30) & top.isNotNull(), F.concat(F.lit("Residual data patterns detected: "), top)))
    found = F.array_compact(F.array(*texts))
    none = F.array(F.lit("Full protection applied — no significant residual risk detected"))
    chosen = F.when(F.size(found) > 0, found).otherwise(none)
    return summary.select(F.posexplode(chosen).alias("position", "driver"))


def risk_reduction(before: Column, after: Column) -> Column:
    """Reduction in percent, two decimals; 0 when there was no risk."""
    share = F.bround((before - after) / F.nullif(before, F.lit(0)) * 100.0, 2)
    return F.when(before > 0, share).otherwise(F.lit(0.0))
