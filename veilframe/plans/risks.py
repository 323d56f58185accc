"""Queries for classification and risk scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import parse
from ..operators import classify, risk
from ..operators.ordering import first_middle_last
from ..sources import tables
from .base import PEOPLE_COLUMNS, PEOPLE_SQL, people, query, quoted, table

# ------------------------------------------------------------------ SQL generators
_WORD = r"[\pL\pN\pM_]"


def unicode_words(pattern: str) -> str:
    r"""A pattern wrapped in \b with word boundaries spelled out for any script."""
    body = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return rf"(^|[^\pL\pN\pM_]){body}($|[^\pL\pN\pM_])"


def cells_sql(source: str, key: str, columns: list[str]) -> str:
    """Long form (key, field, ord, v) of a table, all values as text."""
    return " UNION ALL ".join(
        f"SELECT {key}, '{c}' AS field, {i} AS ord, CAST({c} AS VARCHAR) AS v FROM {source}"
        for i, c in enumerate(columns)
    )


_ANONYMIZED = (
    r"(regexp_matches(v, '(?i)^[a-f0-9]{32,}$') OR ends_with(v, '...') OR v IN ("
    + ", ".join(quoted(m) for m in K.ANONYMIZED_MARKERS)
    + r") OR regexp_matches(v, '^\d+[k]?[-–]\d+[k]?$'))"
)


def _rule_rows(key: str) -> str:
    """One SELECT per risk rule over the live cells: (key, chk, ord, rank, w, driver)."""
    parts = []
    rank = 0

    def add(check: str, condition: str, weight: int, driver: str) -> None:
        nonlocal rank
        rank += 1
        parts.append(
            f"SELECT {key}, '{check}' AS chk, ord, {rank} AS rank, {weight} AS w, {quoted(driver)} AS driver "
            f"FROM live WHERE {condition}"
        )

    for pattern, ignore_case, weight, driver in K.UNIQUENESS_RULES:
        if pattern == "long":
            add("u", "length(v) > 20 AND NOT regexp_matches(v, '(?i)^[a-f0-9]+$')", weight, driver)
        else:
            add("u", f"regexp_matches(v, {quoted(('(?i)' if ignore_case else '') + pattern)})", weight, driver)
    name_field = f"regexp_matches(lower(field), {quoted('(?i)' + K.NAME_FIELD_PATTERN)})"
    add("s", name_field, K.NAME_FIELD_WEIGHT, K.NAME_FIELD_DRIVER)
    add("s", f"NOT {name_field} AND trim(lower(field)) = 'name'", K.PLAIN_NAME_WEIGHT, K.PLAIN_NAME_DRIVER)
    for pattern, driver, weight in K.SENSITIVE_RULES:
        add("s", f"regexp_matches(concat(lower(field), ' ', lower(v)), {quoted('(?i)' + unicode_words(pattern))})",
            weight, driver)
    any_of = lambda words: "(" + " OR ".join(f"contains(lower(field), '{w}')" for w in words) + ")"
    add("s", f"{any_of(K.ID_FIELD_WORDS)} AND {any_of(K.SEQUENCE_FIELD_WORDS)}", K.SEQUENCE_WEIGHT, K.SEQUENCE_DRIVER)
    add("s", f"{any_of(K.ID_FIELD_WORDS)} AND NOT {any_of(K.SEQUENCE_FIELD_WORDS)}", K.DIRECT_ID_WEIGHT, K.DIRECT_ID_DRIVER)
    add("s", r"regexp_matches(v, '^\d{1,3}$') AND TRY_CAST(v AS INT) BETWEEN 1 AND 119",
        K.AGE_VALUE_WEIGHT, K.AGE_VALUE_DRIVER)
    for pattern, weight, driver in K.PRECISION_RULES:
        add("p", f"regexp_matches(v, {quoted(pattern)})", weight, driver)
    return " UNION ALL ".join(parts)


def scored_sql(ctes: str, source: str, key: str, columns: list[str]) -> str:
    """CTEs ending in ``scored``: one row per record with the four checks and the risk."""
    return (
        f"WITH {ctes + ', ' if ctes else ''}cells AS ({cells_sql(source, key, columns)}), "
        "filled_cells AS (SELECT * FROM cells WHERE v IS NOT NULL AND trim(v, ' \t\n\r') <> ''), "
        f"live AS (SELECT * FROM filled_cells WHERE NOT {_ANONYMIZED}), "
        f"hits AS ({_rule_rows(key)}), "
        f"filled AS (SELECT {key}, count(*) FILTER (WHERE v IS NOT NULL AND trim(v, ' \t\n\r') <> '') AS filled "
        f"FROM cells GROUP BY {key}), "
        f"surv AS (SELECT {key}, product(1 - w / 100.0) FILTER (WHERE chk = 'u') AS u, "
        "product(1 - w / 100.0) FILTER (WHERE chk = 's') AS s, product(1 - w / 100.0) FILTER (WHERE chk = 'p') AS p "
        f"FROM hits GROUP BY {key}), "
        f"scored AS (SELECT {key}, filled, coalesce(u, 1) AS u, coalesce(s, 1) AS s, coalesce(p, 1) AS p, "
        "CASE WHEN filled >= 15 THEN 40 WHEN filled >= 8 THEN 25 WHEN filled >= 4 THEN 20 ELSE 0 END AS combo, "
        "CASE WHEN filled = 0 THEN 10.0 ELSE least(100.0, 100 * (1 - coalesce(u, 1) * coalesce(s, 1) * coalesce(p, 1) "
        "* (1 - (CASE WHEN filled >= 15 THEN 40 WHEN filled >= 8 THEN 25 WHEN filled >= 4 THEN 20 ELSE 0 END) / 100.0))) "
        f"END AS risk FROM filled LEFT JOIN surv USING ({key})) "
    )


_SCORE = "CAST(round_even(0.4 * max(risk) + 0.6 * avg(risk), 0) AS INT)"
_LEVEL = (
    "CASE WHEN risk_score <= 20 THEN 'Very Low Risk' WHEN risk_score <= 40 THEN 'Low Risk' "
    "WHEN risk_score <= 60 THEN 'Moderate Risk' WHEN risk_score <= 80 THEN 'High Risk' ELSE 'Very High Risk' END"
)
_METER = (
    "concat('[', repeat('█', CAST(floor(risk_score / 100.0 * 20) AS INT)), "
    "repeat('░', 20 - CAST(floor(risk_score / 100.0 * 20) AS INT)), '] ', CAST(risk_score AS VARCHAR), ' / 100')"
)
_PEOPLE_SCORED = scored_sql(PEOPLE_SQL, "people", "id", PEOPLE_COLUMNS)


def _check_sql(ctes: str, source: str, key: str, columns: list[str], letter: str, name: str) -> str:
    return scored_sql(ctes, source, key, columns) + f"SELECT {key}, round(100 * (1 - {letter}), 6) AS {name} FROM scored"


# ------------------------------------------------------------------ record checks
@query("risk_uniqueness", _check_sql("", "pages", "page_id", ["page_id", "url", "html"], "u", "uniqueness_risk"))
def risk_uniqueness(spark, sf):
    scored = risk.score_records(table(spark, sf, "pages"), ["page_id", "url", "html"])
    return scored.select("page_id", F.round("uniqueness_risk", 6).alias("uniqueness_risk"))


@query(
    "risk_sensitivity",
    _check_sql("", "documents", "doc_id", ["doc_id", "text", "lang", "source"], "s", "sensitivity_risk"),
)
def risk_sensitivity(spark, sf):
    scored = risk.score_records(table(spark, sf, "documents"), ["doc_id", "text", "lang", "source"])
    return scored.select("doc_id", F.round("sensitivity_risk", 6).alias("sensitivity_risk"))


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "risk_combination",
    scored_sql("", "orders", "o_orderkey", _ORDER_COLUMNS)
    + "SELECT o_orderkey, filled, CAST(combo AS DOUBLE) AS combination_risk FROM scored",
)
def risk_combination(spark, sf):
    scored = risk.score_records(table(spark, sf, "orders"), _ORDER_COLUMNS)
    return scored.select("o_orderkey", "filled", "combination_risk")


@query(
    "risk_precision",
    _check_sql(PEOPLE_SQL + ", e AS (SELECT event_id, ts, value, props FROM events)",
               "e", "event_id", ["event_id", "ts", "value", "props"], "p", "precision_risk"),
)
def risk_precision(spark, sf):
    scored = risk.score_records(table(spark, sf, "events"), ["event_id", "ts", "value", "props"])
    return scored.select("event_id", F.round("precision_risk", 6).alias("precision_risk"))


_FACTORS = "[CAST(age AS DOUBLE), CAST(id % 7 * 10 AS DOUBLE), CAST(abs(salary) / 200 AS DOUBLE)]"


@query(
    "risk_noisy_or",
    f"WITH {PEOPLE_SQL} SELECT id, round(100 * (1 - list_product(list_transform({_FACTORS}, "
    "lambda p: CASE WHEN p > 0 THEN 1 - least(p, 100) / 100.0 ELSE 1 END))), 9) AS risk FROM people",
)
def risk_noisy_or(spark, sf):
    factors = F.array(
        F.col("age").cast("double"), (F.col("id") % 7 * 10).cast("double"), F.abs("salary") / F.lit(200.0)
    )
    return people(spark, sf).select("id", F.round(risk.noisy_or(factors), 9).alias("risk"))


@query(
    "risk_records",
    _PEOPLE_SCORED
    + "SELECT id, filled, round(100 * (1 - u), 6) AS uniqueness_risk, round(100 * (1 - s), 6) AS sensitivity_risk, "
    "CAST(combo AS DOUBLE) AS combination_risk, round(100 * (1 - p), 6) AS precision_risk, round(risk, 6) AS risk "
    "FROM scored",
)
def risk_records(spark, sf):
    scored = risk.score_records(people(spark, sf))
    return scored.select(
        "id",
        "filled",
        F.round("uniqueness_risk", 6).alias("uniqueness_risk"),
        F.round("sensitivity_risk", 6).alias("sensitivity_risk"),
        "combination_risk",
        F.round("precision_risk", 6).alias("precision_risk"),
        F.round("risk", 6).alias("risk"),
    )


# ------------------------------------------------------------------ datasets
@query(
    "risk_dataset",
    _PEOPLE_SCORED + f", d AS (SELECT count(*) AS records, {_SCORE} AS risk_score FROM scored) "
    f"SELECT records, risk_score, {_LEVEL} AS risk_level, {_METER} AS risk_meter FROM d",
)
def risk_dataset(spark, sf):
    return risk.dataset_risk(people(spark, sf))


@query(
    "risk_sample",
    f"WITH {PEOPLE_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM people) "
    "SELECT id, email FROM p WHERE n <= 15 OR pos < 5 OR (pos >= n // 2 - 2 AND pos < n // 2 + 3) OR pos >= n - 5",
)
def risk_sample(spark, sf):
    return first_middle_last(people(spark, sf), ["id"]).select("id", "email")


@query(
    "risk_by_group",
    scored_sql("", "customer", "c_custkey", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    + f", d AS (SELECT c_nationkey, count(*) AS records, {_SCORE} AS risk_score FROM scored JOIN customer "
    f"USING (c_custkey) GROUP BY c_nationkey) SELECT c_nationkey, records, risk_score, {_LEVEL} AS risk_level, "
    f"{_METER} AS risk_meter FROM d",
)
def risk_by_group(spark, sf):
    return risk.group_risk(
        table(spark, sf, "customer"), "c_nationkey", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    )


_COMBO_DRIVER = (
    "CASE WHEN filled >= 15 THEN concat('High attribute count (', filled, ' fields) increases re-identification risk') "
    "WHEN filled >= 8 THEN concat('Multiple attributes (', filled, ' fields) enable linking attacks') "
    "ELSE 'Combination of multiple data points' END"
)
# driver rows of the whole table with the place a record reports them: checks in the order
# u, s, c, p; inside a check by column, then rule; s reports a driver once per record
_DRIVERS = (
    ", found AS (SELECT id, CASE chk WHEN 'u' THEN 1 WHEN 's' THEN 2 ELSE 4 END AS part, ord, rank, driver FROM hits "
    "WHERE chk <> 's' UNION ALL SELECT id, 2, min(ord * 100 + rank), 0, driver FROM hits WHERE chk = 's' "
    f"GROUP BY id, driver UNION ALL SELECT id, 3, 0, 0, {_COMBO_DRIVER} FROM filled WHERE filled >= 4 "
    f"UNION ALL SELECT id, 1, 0, 0, 'Empty record' FROM filled WHERE filled = 0), "
    "ranked AS (SELECT driver, count(*) AS n, min(struct_pack(id := id, part := part, ord := ord, rank := rank)) AS f "
    "FROM found GROUP BY driver) "
)


@query("risk_top_drivers", _PEOPLE_SCORED + _DRIVERS + "SELECT driver, n FROM ranked ORDER BY n DESC, f LIMIT 5")
def risk_top_drivers(spark, sf):
    return risk.top_drivers(people(spark, sf), ["id"])


_TREATED = [
    "id",
    "substr(sha2(full_name, 256), 1, 32 + CAST(id % 2 AS INT) * 16) AS full_name",
    "CASE WHEN id % 3 = 0 THEN '[REDACTED]' WHEN id % 3 = 1 THEN email ELSE ' ' END AS email",
    "CASE WHEN age < 40 THEN '18-40' ELSE CAST(age AS STRING) END AS age",
    "concat(substring(gps, 1, 4), '...') AS gps",
]
_TREATED_SQL = (
    PEOPLE_SQL + ", treated AS (SELECT " + ", ".join(_TREATED).replace("sha2(full_name, 256)", "sha256(full_name)")
    + " FROM people)"
)
_TREATED_COLUMNS = ["id", "full_name", "email", "age", "gps"]


def _treated(spark, sf) -> DataFrame:
    return people(spark, sf).selectExpr(*_TREATED)


@query(
    "risk_anonymized_share",
    f"WITH {_TREATED_SQL}, cells AS ({cells_sql('treated', 'id AS k', _TREATED_COLUMNS)}), "
    "live AS (SELECT * FROM cells WHERE v IS NOT NULL AND trim(v) <> ''), "
    f"a AS (SELECT field, count(*) AS present, count(*) FILTER (WHERE {_ANONYMIZED}) AS anonymized FROM live GROUP BY field) "
    'SELECT field AS "column", present, anonymized, round(anonymized / present, 6) AS share FROM a',
)
def risk_anonymized_share(spark, sf):
    shares = risk.anonymized_share(_treated(spark, sf))
    return shares.select("column", "present", "anonymized", F.round("share", 6).alias("share"))


_METADATA = [
    ("id", 0, "identifier", None, "NON_DP_ANONYMIZATION"),
    ("full_name", 1, "identifier", "hashing", "NON_DP_ANONYMIZATION"),
    ("email", 2, "quasi_identifier", "masking", "NON_DP_ANONYMIZATION"),
    ("age", 3, "numeric", "laplace_noise", "DIFFERENTIAL_PRIVACY"),
    ("gps", 4, "generic", "none", "NON_DP_ANONYMIZATION"),
]


def _metadata(spark) -> DataFrame:
    schema = "column string, position int, type string, mechanism string, guarantee string"
    return spark.createDataFrame(_METADATA, schema)


# weights 0.95 + 0.95 + 0.70 + 1.00 + 0.00 over five columns
_RESIDUAL_SQL = (
    scored_sql(_TREATED_SQL, "treated", "id", _TREATED_COLUMNS)
    + f", scan AS (SELECT {_SCORE} AS scanner_score FROM scored), r AS (SELECT scanner_score, 0.72 AS coverage, "
    "CAST(round_even(greatest(scanner_score * (1 - 0.72 * 0.4), greatest(5.0, scanner_score * 0.05)), 0) AS INT) "
    "AS risk_score FROM scan)"
)


@query(
    "risk_residual",
    _RESIDUAL_SQL + f" SELECT scanner_score, CAST(coverage AS DOUBLE) AS coverage, risk_score, {_LEVEL} AS risk_level, "
    f"{_METER} AS risk_meter FROM r",
)
def risk_residual(spark, sf):
    found = risk.residual_risk(_treated(spark, sf), _metadata(spark))
    return found.withColumn("coverage", F.round("coverage", 6))


@query(
    "risk_residual_drivers",
    scored_sql(_TREATED_SQL, "treated", "id", _TREATED_COLUMNS) + _DRIVERS
    + f", scan AS (SELECT {_SCORE} AS score FROM scored), lines AS ("
    "SELECT 1 AS o, '1 numeric column(s) protected with Differential Privacy (ε=2.0)' AS driver "
    "UNION ALL SELECT 2, '2 identifier(s) hashed/pseudonymized — direct re-identification removed' "
    "UNION ALL SELECT 3, '1 quasi-identifier(s) masked/k-anonymized — partial linkage risk remains' "
    "UNION ALL SELECT 4, '1 column(s) received no protection (gps) — residual risk' "
    "UNION ALL SELECT 5, concat('Residual data patterns detected: ', (SELECT driver FROM ranked ORDER BY n DESC, f LIMIT 1)) "
    "FROM scan WHERE score > 30) SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INT) AS position, driver FROM lines",
)
def risk_residual_drivers(spark, sf):
    return risk.residual_drivers(_treated(spark, sf), _metadata(spark), "2.0", ["id"])


@query(
    "risk_reduction",
    scored_sql(_TREATED_SQL, "treated", "id", _TREATED_COLUMNS)
    + ", before_cells AS (SELECT 1), after_score AS (SELECT CAST(round_even(greatest(score * (1 - 0.72 * 0.4), "
    f"greatest(5.0, score * 0.05)), 0) AS INT) AS new_risk_score FROM (SELECT {_SCORE} AS score FROM scored)), "
    f"before_score AS ({_PEOPLE_SCORED} SELECT {_SCORE} AS risk_score FROM scored) "
    "SELECT risk_score, new_risk_score, round((risk_score - new_risk_score) / risk_score * 100, 2) "
    "AS risk_reduction_percent FROM before_score, after_score",
)
def risk_reduction(spark, sf):
    before = risk.dataset_risk(people(spark, sf)).select("risk_score")
    after = risk.residual_risk(_treated(spark, sf), _metadata(spark)).select("risk_score")
    scores = before.withColumn("new_risk_score", after.scalar())
    return scores.withColumn(
        "risk_reduction_percent", risk.risk_reduction(F.col("risk_score"), F.col("new_risk_score"))
    )


@query(
    "risk_of_query",
    scored_sql(
        "q AS (SELECT coalesce(c_mktsegment, '') AS segment, avg(c_acctbal) AS mean_balance, count(*) AS people, "
        "min(c_name) AS customer_name FROM customer GROUP BY c_mktsegment)",
        "q", "segment", ["segment", "mean_balance", "people", "customer_name"],
    )
    + f", d AS (SELECT count(*) AS records, {_SCORE} AS risk_score FROM scored) "
    f"SELECT records, risk_score, {_LEVEL} AS risk_level, {_METER} AS risk_meter FROM d",
)
def risk_of_query(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("customer_rows")
    # five segments, so the cap of the guarded form does not cut anything here
    result = tables.guarded_sql(
        spark,
        "SELECT c_mktsegment AS segment, avg(c_acctbal) AS mean_balance, count(*) AS people, "
        "min(c_name) AS customer_name FROM customer_rows GROUP BY c_mktsegment;",
    )
    return risk.dataset_risk(result)


# ------------------------------------------------------------------ classification
def _bool_count(condition: str) -> str:
    return f"coalesce(sum(c) FILTER (WHERE {condition}), 0)"


def classified_sql(ctes: str, source: str, columns: list[str]) -> str:
    """CTEs ending in ``k``: per-column counts, the three signals and the combined one."""
    number = "trim(translate(v, '$,', ''), ' \t\n\r')"
    tests = ", ".join(
        f"{_bool_count(f'regexp_matches(v, {quoted(chr(40) + '?i)' + p)})')} / sum(c) AS m_{n}" for n, p, _, _ in K.VALUE_PATTERNS
    )
    best = "list_max([" + ", ".join(
        f"CASE WHEN m_{n} > 0.8 THEN struct_pack(share := m_{n}, r := {-i}, t := '{t}', s := '{s}', name := '{n}') END"
        for i, (n, _, t, s) in enumerate(K.VALUE_PATTERNS)
    ) + "])"
    names = " ".join(
        f"WHEN regexp_matches(lower(f), {quoted('|'.join(ps))}) THEN struct_pack(t := '{kind}', s := '{s}')"
        for kind, s, ps in K.NAME_RULES
    )
    positions = ", ".join(f"('{c}', {i})" for i, c in enumerate(columns))
    currency = " OR ".join(f"contains(lower(f), '{w}')" for w in K.CURRENCY_WORDS)
    return (
        f"WITH {ctes + ', ' if ctes else ''}cells AS ({cells_sql(source, '0 AS k', columns)}), "
        "vals AS (SELECT field AS f, v, count(*) AS c FROM cells WHERE v IS NOT NULL GROUP BY field, v), "
        f"stats AS (SELECT f, sum(c) AS n, count(*) AS d, {tests}, "
        f"{_bool_count(f'regexp_matches(trim(v), {quoted(parse.FLOAT_PATTERN)})')} / sum(c) AS m_float, "
        f"{_bool_count(f'regexp_matches({number}, {quoted(parse.FLOAT_PATTERN)})')} AS m_number, "
        f"{_bool_count('trim(v) = ' + quoted(''))} AS blank FROM vals GROUP BY f), "
        f"names(f, pos) AS (VALUES {positions}), "
        f"sig AS (SELECT names.f, n, d, m_number, blank, CASE {names} END AS nm, {best} AS b, m_float, d / n AS uq, "
        f"({currency}) AS currency FROM names LEFT JOIN stats USING (f)), "
        "three AS (SELECT *, CASE WHEN nm IS NOT NULL THEN struct_pack(t := nm.t, s := nm.s, conf := CAST(0.8 AS DOUBLE)) END AS sn, "
        "CASE WHEN b IS NOT NULL THEN struct_pack(t := b.t, s := b.s, conf := CAST(b.share AS DOUBLE)) "
        "WHEN m_float > 0.8 THEN struct_pack(t := 'numeric', s := 'low', conf := CAST(0.7 AS DOUBLE)) "
        "WHEN uq < 0.5 THEN struct_pack(t := 'categorical', s := 'low', conf := CAST(0.6 AS DOUBLE)) END AS sv, "
        "CASE WHEN uq > 0.95 THEN struct_pack(t := 'identifier', s := 'high', conf := CAST(0.7 AS DOUBLE)) "
        "WHEN uq > 0.7 THEN struct_pack(t := 'quasi_identifier', s := 'moderate', conf := CAST(0.6 AS DOUBLE)) "
        "WHEN uq < 0.3 THEN struct_pack(t := 'categorical', s := 'low', conf := CAST(0.6 AS DOUBLE)) END AS ss FROM sig), "
        "won AS (SELECT *, list_max([CASE WHEN sn IS NOT NULL THEN struct_pack(w := sn.conf * 1.2, r := 0, t := sn.t, s := sn.s) END, "
        "CASE WHEN sv IS NOT NULL THEN struct_pack(w := sv.conf, r := -1, t := sv.t, s := sv.s) END, "
        "CASE WHEN ss IS NOT NULL THEN struct_pack(w := ss.conf * 0.8, r := -2, t := ss.t, s := ss.s) END]) AS win FROM three), "
        "k AS (SELECT *, CASE WHEN n IS NULL THEN 'generic' ELSE coalesce(win.t, 'generic') END AS type, "
        "CASE WHEN n IS NULL THEN 'low' ELSE coalesce(win.s, 'low') END AS sensitivity, "
        "CASE WHEN n IS NULL THEN 0.0 WHEN win IS NULL THEN 0.5 ELSE least(win.w, 1.0) END AS confidence FROM won)"
    )


_MECHANISM = (
    "CASE WHEN n IS NULL THEN 'suppression' WHEN sensitivity = 'critical' THEN 'redaction' ELSE CASE type "
    + " ".join(f"WHEN '{t}' THEN '{m}'" for t, m in K.RECOMMENDED.items())
    + " ELSE 'suppression' END END"
)
_REASON = (
    "CASE WHEN n IS NULL THEN 'No data available' WHEN win IS NULL THEN 'Default classification' "
    "WHEN win.r = 0 THEN concat('Column name matches ', nm.t, ' pattern') "
    "WHEN win.r = -1 AND b IS NOT NULL THEN concat('Matches ', b.name, ' pattern') "
    "WHEN win.r = -1 AND m_float > 0.8 THEN 'Values are primarily numeric' "
    "WHEN win.r = -1 THEN 'Limited unique values suggest categorical' "
    "ELSE concat(CASE WHEN uq > 0.95 THEN 'Very high uniqueness ' WHEN uq > 0.7 THEN 'High uniqueness ' "
    "ELSE 'Low uniqueness ' END, printf('(%.2f%%)', uq * 100)) END"
)


@query(
    "classify_columns",
    classified_sql(PEOPLE_SQL, "people", PEOPLE_COLUMNS)
    + f' SELECT f AS "column", type, sensitivity, round(confidence, 6) AS confidence, {_MECHANISM} AS mechanism, '
    f"{_REASON} AS reasoning FROM k",
)
def classify_columns(spark, sf):
    found = classify.classify_columns(people(spark, sf))
    return found.withColumn("confidence", F.round("confidence", 6))


_EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def _signal_sql(ctes: str, source: str, columns: list[str], signal: str) -> str:
    return classified_sql(ctes, source, columns) + (
        f" SELECT f AS \"column\", coalesce({signal}.t, 'generic') AS type, coalesce({signal}.s, 'low') AS sensitivity, "
        f"round(coalesce({signal}.conf, 0), 6) AS confidence FROM k"
    )


@query("classify_by_pattern", _signal_sql("", "events", _EVENT_COLUMNS, "sv"))
def classify_by_pattern(spark, sf):
    profile = classify.profile_columns(table(spark, sf, "events"), _EVENT_COLUMNS)
    found = classify.signal_table(profile, "by_values")
    return found.withColumn("confidence", F.round("confidence", 6))


@query("classify_by_uniqueness", _signal_sql("", "orders", _ORDER_COLUMNS, "ss"))
def classify_by_uniqueness(spark, sf):
    profile = classify.profile_columns(table(spark, sf, "orders"), _ORDER_COLUMNS)
    found = classify.signal_table(profile, "by_uniqueness")
    return found.withColumn("confidence", F.round("confidence", 6))


@query(
    "numeric_override",
    classified_sql(PEOPLE_SQL, "people", PEOPLE_COLUMNS)
    + ' SELECT f AS "column", type, coalesce(m_number / (n - blank) >= 0.8, false) AS looks_numeric, '
    "CASE WHEN type IN ('sensitive', 'generic', 'identifier', 'quasi_identifier') AND n > 0 "
    "AND (coalesce(m_number / (n - blank) >= 0.8, false) OR currency) THEN 'numeric' ELSE type END AS effective_type FROM k",
)
def numeric_override(spark, sf):
    found = classify.numeric_override(classify.combine_signals(classify.profile_columns(people(spark, sf))))
    return found.select("column", "type", "looks_numeric", "effective_type")
