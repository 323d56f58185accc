"""Queries for whole-table privatization, checks, JSON and DP aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import keyed
from ..operators import anatomy, checks, dp, dp_private, json_rewrite, ledger, mondrian, policy, privatize, teams
from ..sources import tables
from . import budgets
from .base import (
    DEMOGRAPHIC_SQL, PEOPLE_COLUMNS, PEOPLE_SQL, SECRET, demographic, digest_sql, laplace_sql, people,
    pool_noise_sql, query, query_log, table, uniform_of_sql, uniform_sql, LOG_SQL,
)
from .risks import _LEVEL, _ORDER_COLUMNS, _PEOPLE_SCORED, _SCORE, scored_sql
from .transforms import SEED_KEY, _EVENT_SEED


# ------------------------------------------------------------------ whole table
def _k_column_sql(source: str, key: str, column: str, k: int) -> tuple[str, str]:
    """(CTEs, result CTE name) that give (key, column) after k-anonymity."""
    digest = digest_sql("k_anonymity", column, key)
    name = f"ka_{column}"
    return (
        f"{name}_cats AS (SELECT v, n, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT {column} AS v, "
        f"count(*) AS n FROM {source} GROUP BY {column})), "
        f"{name} AS (SELECT s.{key}, CASE WHEN c.n < {k} AND {uniform_of_sql(digest, 0)} >= 0.75 THEN o.v "
        f"ELSE s.{column} END AS {column} FROM {source} s JOIN {name}_cats c ON s.{column} = c.v JOIN {name}_cats o "
        f"ON o.i = CAST(floor({uniform_of_sql(digest, 1)} * (SELECT count(*) FROM {name}_cats)) AS BIGINT))",
        name,
    )


def _hash_sql(c: str) -> str:
    return f"substr(sha256({c}), 1, length({c}))"


_PSEUDONYM = (
    "concat('Person_', lpad(CAST(CAST(concat('0x', substr(sha256(full_name), 1, 16)) AS UBIGINT) % 100000 AS VARCHAR), 5, '0'))"
)
_STATUS_CTE, _STATUS = _k_column_sql("people", "id", "status", 10)
_RELEASED = (
    f"WITH {PEOPLE_SQL}, {_STATUS_CTE}, released AS (SELECT people.id AS row_key, "
    f"{pool_noise_sql('CAST(people.id AS DOUBLE)', 'id', 'people.id')} AS id, {_PSEUDONYM} AS full_name, "
    f"{_hash_sql('email')} AS email, {pool_noise_sql('CAST(phone AS DOUBLE)', 'phone', 'people.id')} AS phone, "
    f"{pool_noise_sql('CAST(age AS DOUBLE)', 'age', 'people.id')} AS age, "
    f"{pool_noise_sql('salary', 'salary', 'people.id')} AS salary, {_STATUS}.status AS status, "
    f"{pool_noise_sql('CAST(pincode AS DOUBLE)', 'pincode', 'people.id')} AS pincode, '[REGION]' AS gps "
    f"FROM people JOIN {_STATUS} ON people.id = {_STATUS}.id) "
)


@query("privatize_table", _RELEASED + f"SELECT {', '.join(PEOPLE_COLUMNS)} FROM released")
def privatize_table(spark, sf):
    released, _ = privatize.privatize(people(spark, sf), SECRET, "id")
    return released


_FIXED_CTES = [_k_column_sql("demographic", "record_id", c, 20) for c in ("gender", "district", "area_type")]


def _d_noise(column: str) -> str:
    return f"{pool_noise_sql(f'CAST(d.{column} AS DOUBLE)', column, 'd.record_id')} AS {column}"


@query(
    "privatize_fixed_risk",
    f"WITH {DEMOGRAPHIC_SQL}, {', '.join(c for c, _ in _FIXED_CTES)} SELECT {_d_noise('record_id')}, {_d_noise('age')}, "
    "ka_gender.gender, '[REGION]' AS state, ka_district.district, ka_area_type.area_type, "
    f"{_d_noise('monthly_income')}, {_d_noise('household_size')}, {_d_noise('land_owned_acres')}, "
    f"{_hash_sql('aadhaar')} AS aadhaar, {_hash_sql('pan')} AS pan FROM demographic d "
    "JOIN ka_gender ON d.record_id = ka_gender.record_id JOIN ka_district ON d.record_id = ka_district.record_id "
    "JOIN ka_area_type ON d.record_id = ka_area_type.record_id",
)
def privatize_fixed_risk(spark, sf):
    released, _ = privatize.privatize(
        demographic(spark, sf), SECRET, "record_id", risk_score=85, policy_name="maximum"
    )
    return released


@query(
    "privatize_metadata",
    _PEOPLE_SCORED + f", d AS (SELECT {_SCORE} AS risk_score, count(*) AS n FROM scored), v AS (SELECT count(*) AS bad FROM "
    "(SELECT 1 FROM people GROUP BY full_name, phone, age, pincode HAVING count(DISTINCT salary) < 2)) "
    "SELECT risk_score, CAST(0.5 AS DOUBLE) AS epsilon_total, CAST(0.00001 AS DOUBLE) AS delta, 10 AS k_anonymity, "
    "true AS strict_mode, 'Very Strong' AS privacy_level, 9 AS columns_transformed, n * 9 AS total_values, "
    "n AS redacted_values, n * 8 AS preserved_values, round(n * 8 / (n * 9) * 100, 2) AS utility_preservation_score, "
    "bad AS l_violations FROM d, v",
)
def privatize_metadata(spark, sf):
    rows = people(spark, sf)
    released, plan = privatize.privatize(rows, SECRET, "id", compat="risk")
    return privatize.release_summary(rows, released, plan)


# mechanisms: hashing 0.95 (id, email), redaction 0.95 (salary), k-anonymity 0.70 (full_name, phone,
# age, status, pincode), generalization 0.55 (gps)
_COVERAGE = "((3 * 0.95 + 5 * 0.70 + 0.55) / 9)"


@query(
    "assess_and_privatize",
    scored_sql(_RELEASED.removeprefix("WITH ").strip(), "released", "row_key", PEOPLE_COLUMNS)
    + f", scan AS (SELECT {_SCORE} AS found FROM scored), after_score AS (SELECT CAST(round_even(greatest(found * (1 - {_COVERAGE} * 0.4), "
    f"greatest(5.0, found * 0.05)), 0) AS INT) AS risk_score FROM scan), before_score AS ({_PEOPLE_SCORED} SELECT {_SCORE} AS risk_score "
    f"FROM scored) SELECT 'standard' AS policy_used, b.risk_score, (SELECT {_LEVEL} FROM before_score) AS risk_level, "
    f"a.risk_score AS new_risk_score, (SELECT {_LEVEL} FROM after_score) AS new_risk_level, round({_COVERAGE}, 6) AS coverage, "
    "round((b.risk_score - a.risk_score) / b.risk_score * 100, 2) AS risk_reduction_percent FROM before_score b, after_score a",
)
def assess_and_privatize(spark, sf):
    _, report = privatize.assess_and_privatize(people(spark, sf), SECRET, "id")
    return report.withColumn("coverage", F.round("coverage", 6))


@query(
    "anonymization_proof",
    _RELEASED + "SELECT o.id, o.full_name AS original_name, r.full_name AS anonymized_name, o.email AS original_email, "
    "r.email AS anonymized_email, o.salary AS original_salary, r.salary AS anonymized_salary, "
    "o.gps AS original_gps, r.gps AS anonymized_gps FROM people o JOIN released r ON r.row_key = o.id ORDER BY o.id LIMIT 5",
)
def anonymization_proof(spark, sf):
    rows = people(spark, sf)
    pairs = privatize.proof(rows, privatize.plan_privacy(rows), SECRET, "id", rows=5)
    return pairs.select(
        F.col("original.id").alias("id"),
        F.col("original.full_name").alias("original_name"),
        F.col("anonymized.full_name").alias("anonymized_name"),
        F.col("original.email").alias("original_email"),
        F.col("anonymized.email").alias("anonymized_email"),
        F.col("original.salary").alias("original_salary"),
        F.col("anonymized.salary").alias("anonymized_salary"),
        F.col("original.gps").alias("original_gps"),
        F.col("anonymized.gps").alias("anonymized_gps"),
    )


# ------------------------------------------------------------------ checks
@query(
    "k_anonymity_classes",
    f"WITH {PEOPLE_SQL} SELECT age, status, count(*) AS size, count(*) >= 5 AS meets_k FROM people GROUP BY age, status",
)
def k_anonymity_classes(spark, sf):
    return checks.equivalence_classes(people(spark, sf), ["age", "status"], 5)


_NULLED = (
    "SELECT id, CASE WHEN id % 13 = 0 THEN NULL ELSE age END AS age, status, "
    "CASE WHEN id % 5 = 0 THEN NULL ELSE floor(salary / 1000) END AS band FROM people"
)


def _nulled(spark, sf) -> DataFrame:
    return people(spark, sf).selectExpr(
        "id", "CASE WHEN id % 13 = 0 THEN NULL ELSE age END AS age", "status",
        "CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(floor(salary / 1000) AS DOUBLE) END AS band",
    )


@query(
    "k_anonymize_mondrian",
    f"WITH {PEOPLE_SQL} SELECT id, true AS age_inside, true AS salary_inside, true AS class_reaches_k FROM people",
)
def k_anonymize_mondrian(spark, sf):
    """Every person's own values lie in the ranges shown, and every class of equal ranges has ten rows or more."""
    rows = people(spark, sf).select("id", "age", "salary", F.col("age").alias("own_age"), F.col("salary").alias("own_salary"))
    released = mondrian.k_anonymize_mondrian(rows, ["age", "salary"], 10)
    classes = checks.equivalence_classes(released, ["age", "salary"], 10).select(
        F.col("age").alias("_age"), F.col("salary").alias("_salary"), "meets_k"
    )

    def inside(shown: str, own: str):
        ends = F.split(F.col(shown), " - ")
        return F.col(own).between(ends[0].cast("double"), F.element_at(ends, -1).cast("double")).alias(f"{shown}_inside")

    same = (F.col("age") == F.col("_age")) & (F.col("salary") == F.col("_salary"))
    return released.join(classes, same).select(
        "id", inside("age", "own_age"), inside("salary", "own_salary"), F.col("meets_k").alias("class_reaches_k")
    )


@query(
    "l_diversity",
    f"WITH {PEOPLE_SQL}, s AS ({_NULLED}), c AS (SELECT age, status, count(DISTINCT band) AS d FROM s "
    "WHERE age IS NOT NULL GROUP BY age, status) SELECT count(*) AS classes, 2 AS l_threshold, "
    "count(*) FILTER (WHERE d < 2) AS violations_found, count(*) FILTER (WHERE d < 2) = 0 AS satisfies_l_diversity FROM c",
)
def l_diversity(spark, sf):
    return checks.l_diversity(_nulled(spark, sf), ["age", "status"], "band")


@query(
    "t_closeness",
    f"WITH {PEOPLE_SQL}, s AS ({_NULLED}), k AS (SELECT * FROM s WHERE age IS NOT NULL AND band IS NOT NULL), "
    "g AS (SELECT band, count(*) / (SELECT count(*) FROM k) AS q FROM k GROUP BY band), "
    "c AS (SELECT age, status, count(*) AS size FROM k GROUP BY age, status), "
    "p AS (SELECT age, status, band, count(*) AS n FROM k GROUP BY age, status, band), "
    "d AS (SELECT c.age, c.status, c.size, 0.5 * sum(abs(coalesce(p.n, 0) / c.size - g.q)) AS distance FROM c CROSS JOIN g "
    "LEFT JOIN p ON p.age = c.age AND p.status = c.status AND p.band = g.band GROUP BY c.age, c.status, c.size) "
    "SELECT age, status, size, round(distance, 6) AS distance, distance <= 0.6 AS meets_t FROM d",
)
def t_closeness(spark, sf):
    found = checks.t_closeness(_nulled(spark, sf), ["age", "status"], "band", 0.6)
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "t_closeness_ordered",
    f"WITH {PEOPLE_SQL}, s AS ({_NULLED}), k AS (SELECT * FROM s WHERE age IS NOT NULL AND band IS NOT NULL), "
    "g AS (SELECT band, count(*) AS n FROM k GROUP BY band), c AS (SELECT age, status, count(*) AS size FROM k GROUP BY age, status), "
    "p AS (SELECT age, status, band, count(*) AS n FROM k GROUP BY age, status, band), "
    "e AS (SELECT c.age, c.status, c.size, sum(coalesce(p.n, 0)) OVER w / c.size - sum(g.n) OVER w / (SELECT count(*) FROM k) AS gap "
    "FROM c CROSS JOIN g LEFT JOIN p ON p.age = c.age AND p.status = c.status AND p.band = g.band "
    "WINDOW w AS (PARTITION BY c.age, c.status ORDER BY g.band)), "
    "d AS (SELECT age, status, size, sum(abs(gap)) / greatest((SELECT count(*) FROM g) - 1, 1) AS distance FROM e GROUP BY age, status, size) "
    "SELECT age, status, size, round(distance, 6) AS distance, distance <= 0.3 AS meets_t FROM d",
)
def t_closeness_ordered(spark, sf):
    found = checks.t_closeness_ordered(_nulled(spark, sf), ["age", "status"], "band", 0.3)
    return found.withColumn("distance", F.round("distance", 6))


# dealt round in the order of value and keyed draw, one group for every three rows
_DEALT_SQL = (
    f"WITH {PEOPLE_SQL}, dealt AS (SELECT id, status, (row_number() OVER (ORDER BY status, {digest_sql('l_diversify', 'status', 'id')}, id) - 1) "
    "% (SELECT count(*) // 3 FROM people) AS group_id FROM people) "
)


@query("l_diversify", _DEALT_SQL + "SELECT id, group_id FROM dealt")
def l_diversify(spark, sf):
    return anatomy.l_diversify(people(spark, sf).select("id", "status"), "status", 3, "id", SECRET).select("id", "group_id")


@query(
    "l_diversify_check",
    _DEALT_SQL + "SELECT count(DISTINCT group_id) AS classes, 3 AS l_threshold, CAST(0 AS BIGINT) AS violations_found, "
    "true AS satisfies_l_diversity FROM dealt",
)
def l_diversify_check(spark, sf):
    """No group of the dealt rows has fewer than three values."""
    dealt = anatomy.l_diversify(people(spark, sf).select("id", "status"), "status", 3, "id", SECRET)
    return checks.l_diversity(dealt, ["group_id"], "status", 3)


@query("anatomy_values", _DEALT_SQL + "SELECT group_id, status, count(*) AS n FROM dealt GROUP BY group_id, status")
def anatomy_values(spark, sf):
    return anatomy.anatomize(people(spark, sf).select("id", "age", "status"), "status", 3, "id", SECRET)[1]


@query(
    "utility_metrics",
    _RELEASED + "SELECT count(*) * 9 AS total_values, count(*) AS redacted_values, count(*) * 8 AS preserved_values, "
    "round(count(*) * 8 / (count(*) * 9) * 100, 2) AS utility_preservation_score FROM released WHERE gps = '[REGION]'",
)
def utility_metrics(spark, sf):
    return checks.utility(privatize_table(spark, sf))


_PRIORITY_CLASSES = scored_sql("", "orders", "o_orderkey", _ORDER_COLUMNS) + (
    f", scores AS (SELECT c_mktsegment AS segment, {_SCORE} AS risk_score FROM scored JOIN orders USING (o_orderkey) "
    "JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment)"
)
_POLICY_ROWS = ", ".join(
    f"('{p[0]}', {K.LEVELS[p[2]]}, CAST({p[3]} AS DOUBLE), {p[5]})" for p in K.POLICIES
)
_BAND_ROWS = ", ".join(
    f"({start}, CAST({high} AS DOUBLE), {k}, {str(strict).lower()})" for start, _, high, k, strict, _, _ in K.RISK_BANDS
)


@query(
    "policy_compliance",
    _PRIORITY_CLASSES + f", policies(policy, level, epsilon, k) AS (VALUES {_POLICY_ROWS}), "
    f"bands(from_score, max_epsilon, min_k, strict) AS (VALUES {_BAND_ROWS}), "
    "j AS (SELECT s.segment, s.risk_score, p.*, b.* FROM scores s, policies p, bands b WHERE b.from_score = "
    "(SELECT max(from_score) FROM bands x WHERE x.from_score <= s.risk_score)), "
    "i AS (SELECT segment, risk_score, policy, concat_ws('; ', "
    "CASE WHEN epsilon > max_epsilon THEN concat('Epsilon too high (', epsilon, ' > ', max_epsilon, ') for risk level') END, "
    "CASE WHEN k < min_k THEN concat('k-anonymity too low (', k, ' < ', min_k, ')') END, "
    "CASE WHEN strict AND level < 3 THEN 'Strict mode required for this risk level' END) AS issues FROM j) "
    "SELECT segment, risk_score, policy, issues, issues = '' AS is_compliant FROM i",
)
def policy_compliance(spark, sf):
    from ..operators import risk

    orders = table(spark, sf, "orders")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    scores = risk.group_risk(orders.join(customers, "o_custkey"), "segment", _ORDER_COLUMNS)
    checked = policy.compliance(scores.select("segment", "risk_score"))
    return checked.select(
        "segment", "risk_score", "policy", F.array_join("issues", "; ").alias("issues"), "is_compliant"
    )


# ------------------------------------------------------------------ JSON
@query(
    "anonymize_json",
    "SELECT event_id, concat('{\"k\":', "
    + pool_noise_sql("CAST(json_extract(props, '$.k') AS DOUBLE)", "k", "concat(CAST(event_id AS VARCHAR), '|$.k')")
    + ", '}') AS props FROM events",
)
def anonymize_json(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "props")
    return json_rewrite.anonymize_json(rows, "props", SECRET, "event_id")


def _located(path: str) -> str:
    return f"concat(CAST(id AS VARCHAR), '|{path}')"


@query(
    "anonymize_json_nested",
    f"WITH {PEOPLE_SQL} SELECT id, {_PSEUDONYM} AS name, "
    "concat(substr(email, 1, 2), repeat('*', strpos(email, '@') - 3), substr(email, strpos(email, '@'))) AS email, "
    "concat(repeat('*', length(phone) - 4), right(phone, 4)) AS phone, "
    f"{_hash_sql(chr(39) + 'AC-' + chr(39) + ' || CAST(id AS VARCHAR)')} AS account, status AS city, "
    f"{pool_noise_sql('CAST(age AS DOUBLE)', 'history', _located('0|$.history[]'))} AS first_item, "
    f"CASE WHEN id % 2 = 0 THEN {pool_noise_sql('CAST(id % 50 AS DOUBLE)', 'history', _located('1|$.history[]'))} END AS second_item, "
    f"CAST({pool_noise_sql('CAST(id AS DOUBLE)', 'points', _located('$.points'))} AS VARCHAR) AS points, "
    "'free text' AS remark, CASE WHEN id % 3 = 0 THEN "
    f"{pool_noise_sql('salary', 'salary', _located('$.salary'))} END AS salary FROM people "
    "UNION ALL SELECT -s_suppkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM supplier",
)
def anonymize_json_nested(spark, sf):
    # lists of different lengths, a key only some documents have, an inner object
    rows = people(spark, sf).select(
        "id",
        F.to_json(
            F.struct(
                F.col("full_name").alias("name"),
                F.struct("email", F.translate("phone", "+", "0").alias("phone")).alias("contact"),
                F.concat(F.lit("AC-"), F.col("id").cast("string")).alias("accountNo"),
                F.col("status").alias("city"),
                F.when(F.col("id") % 2 == 0, F.array(F.col("age").cast("bigint"), F.col("id") % 50))
                .otherwise(F.array(F.col("age").cast("bigint"))).alias("history"),
                F.col("id").cast("string").alias("points"),
                F.lit("free text").alias("remark"),
                F.when(F.col("id") % 3 == 0, F.col("salary")).alias("salary"),
            )
        ).alias("data"),
    )
    # lists and plain values among the objects
    other = table(spark, sf, "supplier").selectExpr(
        "-s_suppkey AS id", "CASE WHEN s_suppkey % 2 = 0 THEN concat('[', s_suppkey, ']') ELSE CAST(s_suppkey AS STRING) END AS data"
    )
    rewritten = json_rewrite.anonymize_json(rows.unionByName(other), "data", SECRET, "id")

    def at(path: str):
        return F.get_json_object("data", path)

    return rewritten.select(
        "id",
        at("$.name").alias("name"),
        at("$.contact.email").alias("email"),
        at("$.contact.phone").alias("phone"),
        at("$.accountNo").alias("account"),
        at("$.city").alias("city"),
        at("$.history[0]").cast("bigint").alias("first_item"),
        at("$.history[1]").cast("bigint").alias("second_item"),
        at("$.points").alias("points"),
        at("$.remark").alias("remark"),
        at("$.salary").cast("bigint").alias("salary"),
    )


_RAGGED = (
    "CASE event_id % 4 WHEN 0 THEN concat('{\"u', user_id, '\":{\"k\":', user_id, ',\"list\":[', event_id, ',true,null]}}') "
    "WHEN 1 THEN concat('[', event_id, ',{\"n', event_id, '\":\"a', user_id, '@x.org\"}]') WHEN 2 THEN CAST(user_id AS STRING) "
    "ELSE concat('{\"mix\":', CASE WHEN event_id % 8 = 3 THEN concat('{\"K ', user_id, '\":', user_id, '}') ELSE CAST(user_id AS STRING) END, '}') END"
)


def _ragged_noise(value: str, key: str, row: str, path: str) -> str:
    return pool_noise_sql(f"CAST({value} AS DOUBLE)", "", f"concat({key}, '|', {row}, '|', {path})")


@query(
    "anonymize_json_ragged",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('{\"u', user_id, '\":{\"k\":', "
    + _ragged_noise("user_id", "'k'", "event_id", "concat('$.u', user_id, '.k')")
    + ", ',\"list\":[', " + _ragged_noise("event_id", "'list'", "concat(event_id, '|0')", "concat('$.u', user_id, '.list[]')")
    + ", ',', " + _ragged_noise("1", "'list'", "concat(event_id, '|1')", "concat('$.u', user_id, '.list[]')")
    + ", ',null]}}') WHEN 1 THEN concat('[', " + _ragged_noise("event_id", "''", "concat(event_id, '|0')", "'$[]'")
    + ", ',{\"n', event_id, '\":\"', substr(concat('a', user_id), 1, 2), repeat('*', greatest(1, length(concat('a', user_id)) - 2)), '@x.org\"}]') "
    "WHEN 2 THEN substr(sha256(CAST(user_id AS VARCHAR)), 1, length(CAST(user_id AS VARCHAR))) "
    "WHEN 3 THEN CASE WHEN event_id % 8 = 3 THEN concat('{\"mix\":{\"K ', user_id, '\":', "
    + _ragged_noise("user_id", "concat('k ', user_id)", "event_id", "concat('$.mix.K ', user_id)")
    + ", '}}') ELSE concat('{\"mix\":', " + _ragged_noise("user_id", "'mix'", "event_id", "'$.mix'") + ", '}') END END AS data FROM events",
)
def anonymize_json_ragged(spark, sf):
    """Documents with ids as keys; lists, plain values and mixed kinds among them."""
    rows = table(spark, sf, "events").selectExpr("event_id", f"{_RAGGED} AS data")
    return json_rewrite.anonymize_json_ragged(rows, "data", SECRET, "event_id")


@query(
    "scan_json_dataset",
    "SELECT CAST(c_custkey AS BIGINT) AS row_index, c_name AS name, c_acctbal AS balance, "
    "CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS segment FROM customer",
)
def scan_json_dataset(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.lit("customers").alias("dataset_name"),
        F.col("c_custkey").alias("row_index"),
        F.to_json(
            F.struct(
                F.col("c_name").alias("name"),
                F.col("c_acctbal").alias("balance"),
                F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).alias("segment"),
            )
        ).alias("data"),
    )
    suppliers = table(spark, sf, "supplier").select(
        F.lit("suppliers").alias("dataset_name"),
        F.col("s_suppkey").alias("row_index"),
        F.to_json(F.struct(F.col("s_name").alias("name"))).alias("data"),
    )
    found = tables.scan_dataset(customers.unionByName(suppliers), "customers")
    return found.select("row_index", "name", F.col("balance").cast("double").alias("balance"), "segment")


@query(
    "union_ragged",
    "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL AS nation FROM customer "
    "UNION ALL SELECT s_name, s_acctbal, NULL, s_nationkey FROM supplier "
    "UNION ALL SELECT n_name, NULL, NULL, n_nationkey FROM nation",
)
def union_ragged(spark, sf):
    customers = table(spark, sf, "customer").selectExpr("c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment")
    suppliers = table(spark, sf, "supplier").selectExpr("s_name AS name", "s_acctbal AS balance", "s_nationkey AS nation")
    nations = table(spark, sf, "nation").selectExpr("n_name AS name", "n_nationkey AS nation")
    return tables.union_ragged(customers, suppliers, nations)


# ------------------------------------------------------------------ DP aggregates
def _u(kind: str, field: str, query_id: str) -> str:
    return uniform_sql("dp_" + kind, field, f"'{query_id}'")


def _cdf(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN 0.5 * exp(-abs({x}) / b) ELSE 1 - 0.5 * exp(-abs({x}) / b) END)"


_BOUNDED_RESULT = (
    "least(greatest(m + CASE WHEN p < 0.5 THEN b * ln(2 * p) ELSE -b * ln(2 * (1 - p)) END, lo), hi)"
)


def scale_sql(stats: str) -> str:
    """CTEs from ``stats`` (k, eps, m, lo, hi, sens) to ``scale`` (k, m, lo, hi, b), one bisection per row."""

    def too_small(b: str) -> str:
        reach = "least(sens, hi - lo)"
        log_c = f"ln((2 - exp(-{reach} / {b}) - exp(({reach} - (hi - lo)) / {b})) / (1 - exp(-(hi - lo) / {b})))"
        return f"{b} * (eps - {log_c}) < sens"

    middle = "((lw + hg) / 2)"
    return (
        f"stats AS ({stats}), dbl AS (SELECT 0 AS i, k, eps, m, lo, hi, sens, sens / eps AS b FROM stats UNION ALL "
        f"SELECT i + 1, k, eps, m, lo, hi, sens, CASE WHEN {too_small('b')} THEN b * 2 ELSE b END FROM dbl WHERE i < 40), "
        "bis AS (SELECT 0 AS i, k, eps, m, lo, hi, sens, sens / eps AS lw, b AS hg FROM dbl WHERE i = 40 UNION ALL "
        f"SELECT i + 1, k, eps, m, lo, hi, sens, CASE WHEN {too_small(middle)} THEN {middle} ELSE lw END, "
        f"CASE WHEN {too_small(middle)} THEN hg ELSE {middle} END FROM bis WHERE i < 60), "
        "scale AS (SELECT k, m, lo, hi, hg AS b FROM bis WHERE i = 60)"
    )


def bounded_sql(stats: str, u: str, epsilon: float) -> str:
    """CTEs from one row (m, lo, hi, sens) to ``drawn`` with the result column r."""
    return (
        scale_sql(f"SELECT 0 AS k, CAST({epsilon} AS DOUBLE) AS eps, * FROM ({stats})")
        + f", prob AS (SELECT *, {_cdf('(lo - m)')} + {u} * ({_cdf('(hi - m)')} - {_cdf('(lo - m)')}) AS p FROM scale), "
        f"drawn AS (SELECT {_BOUNDED_RESULT} AS r FROM prob) "
    )


def _dp_row(kind: str, field: str, result: str, source: str) -> str:
    epsilon = K.QUERY_COST_CENTS[kind] / 100
    return (
        f"SELECT '{kind}' AS query_type, '{field}' AS field, {result} AS result, "
        f"CAST({epsilon} AS DOUBLE) AS effective_epsilon FROM {source}"
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("result", F.round("result", 4))


@query(
    "dp_count",
    "WITH s AS (SELECT count(*) FILTER (WHERE l_tax <> 0) AS n FROM lineitem) "
    + _dp_row("count", "l_tax", f"greatest(round_even(n + {laplace_sql(_u('count', 'l_tax', 'q-count'), '1 / 0.01')}, 0), 0)", "s"),
)
def dp_count(spark, sf):
    return dp.dp_aggregate(table(spark, sf, "lineitem"), "l_tax", "count", 0, 1, SECRET, "q-count")


@query(
    "dp_mean",
    "WITH s AS (SELECT count(o_totalprice) AS n, avg(least(greatest(o_totalprice, 1000), 400000)) AS m FROM orders) "
    + _dp_row(
        "mean", "o_totalprice",
        f"round(least(greatest(m + {laplace_sql(_u('mean', 'o_totalprice', 'q-mean'), '399000 / 0.05 / n')}, 1000), 400000), 4)",
        "s",
    ),
)
def dp_mean(spark, sf):
    return _rounded(dp.dp_aggregate(table(spark, sf, "orders"), "o_totalprice", "mean", 1000, 400000, SECRET, "q-mean"))


@query(
    "dp_sum",
    "WITH RECURSIVE "
    + bounded_sql(
        "SELECT sum(least(greatest(l_quantity, 0), 40)) AS m, CAST(0 AS DOUBLE) AS lo, CAST(40 * count(l_quantity) AS DOUBLE) "
        "AS hi, CAST(40 AS DOUBLE) AS sens FROM lineitem",
        _u("sum", "l_quantity", "q-sum"), 0.1,
    )
    + _dp_row("sum", "l_quantity", "round(r, 4)", "drawn"),
)
def dp_sum(spark, sf):
    return _rounded(dp.dp_aggregate(table(spark, sf, "lineitem"), "l_quantity", "sum", 0, 40, SECRET, "q-sum"))


def _variance_stats(column: str, source: str, lower: int, upper: int) -> str:
    width = upper - lower
    return (
        f"SELECT var_pop(least(greatest({column}, {lower}), {upper})) AS m, CAST(0 AS DOUBLE) AS lo, "
        f"CAST({width} * {width} / 4 AS DOUBLE) AS hi, {width}.0 * {width} * (count({column}) - 1) / "
        f"(CAST(count({column}) AS DOUBLE) * count({column})) AS sens FROM {source}"
    )


@query(
    "dp_variance",
    "WITH RECURSIVE " + bounded_sql(_variance_stats("l_quantity", "lineitem", 0, 50), _u("variance", "l_quantity", "q-var"), 0.1)
    + _dp_row("variance", "l_quantity", "round(r, 4)", "drawn"),
)
def dp_variance(spark, sf):
    return _rounded(dp.dp_aggregate(table(spark, sf, "lineitem"), "l_quantity", "variance", 0, 50, SECRET, "q-var"))


@query(
    "dp_std",
    "WITH RECURSIVE " + bounded_sql(_variance_stats("value", "events", 0, 100), _u("std", "value", "q-std"), 0.1)
    + _dp_row("std", "value", "round(sqrt(r), 4)", "drawn"),
)
def dp_std(spark, sf):
    return _rounded(dp.dp_aggregate(table(spark, sf, "events"), "value", "std", 0, 100, SECRET, "q-std"))


_GROUP_U = uniform_sql("dp_mean", "c_acctbal", "concat('q-group|', CAST(n_nationkey AS VARCHAR))")


@query(
    "dp_grouped",
    "WITH s AS (SELECT n_nationkey, greatest(count(c_acctbal), 1) AS n, coalesce(avg(least(greatest(c_acctbal, 0), 8000)), 4000) "
    "AS m FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey) "
    f"SELECT n_nationkey AS c_nationkey, round(least(greatest(m + {laplace_sql(_GROUP_U, '8000 / 0.05 / n')}, 0), 8000), 4) AS result FROM s",
)
def dp_grouped(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return _rounded(
        dp.dp_grouped(
            table(spark, sf, "customer"), "c_nationkey", nations, "c_acctbal", "mean", 0, 8000, SECRET, "q-group"
        )
    )


_MONTH_U = uniform_sql("group_release", "q-months", "month")
_TOTAL_U = uniform_sql("group_total", "q-months", "month")
_MONTH_T = dp_private.release_threshold(1.0, 1e-5, 3)


@query(
    "dp_grouped_private",
    "WITH pairs AS (SELECT o_custkey, substr(CAST(o_orderdate AS VARCHAR), 1, 7) AS month, sum(CAST(o_totalprice AS DOUBLE)) AS v FROM orders "
    f"GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {digest_sql('group_pick', 'q-months', "concat_ws('|', CAST(o_custkey AS VARCHAR), month)")}, "
    "month) AS nth FROM pairs), g AS (SELECT month, count(*) AS n, sum(least(greatest(v, 0), 300000)) AS s FROM ranked WHERE nth <= 3 GROUP BY month), "
    f"noisy AS (SELECT *, n + {laplace_sql(_MONTH_U, '3.0')} AS c, s + {laplace_sql(_TOTAL_U, '900000.0')} AS t FROM g) "
    f"SELECT month, CAST(round_even(c, 0) AS BIGINT) AS persons, round(t, 2) AS total FROM noisy WHERE c >= {_MONTH_T!r}",
)
def dp_grouped_private(spark, sf):
    """Months with enough customers, each customer counting in three months at most."""
    orders = table(spark, sf, "orders").selectExpr(
        "o_custkey", "substr(CAST(o_orderdate AS STRING), 1, 7) AS month", "CAST(o_totalprice AS DOUBLE) AS price"
    )
    found = dp_private.grouped_private(orders, "o_custkey", "month", SECRET, "q-months", 2.0, 1e-5, 3, "price", 0, 300000)
    return found.withColumn("total", F.round("total", 2))


_BINS = dp_private.HIGHEST - dp_private.LOWEST + 1
_BIN_LIMIT = math.log((2 * _BINS + 1) / 2e-6) / 0.1
_EXPONENT = "CAST(floor(log2(abs(v))) AS BIGINT)"


@query(
    "dp_private_bounds",
    "WITH x AS (SELECT CAST(l_extendedprice AS DOUBLE) - 30000 AS v FROM lineitem), b AS (SELECT CASE WHEN v = 0 THEN 0 ELSE sign(v) * "
    f"(least(greatest({_EXPONENT} + CASE WHEN pow(2.0, {_EXPONENT} + 1) <= abs(v) THEN 1 WHEN pow(2.0, {_EXPONENT}) > abs(v) THEN -1 ELSE 0 END, "
    f"{dp_private.LOWEST}), {dp_private.HIGHEST}) + {1 - dp_private.LOWEST}) END AS bin FROM x), "
    f"h AS (SELECT k AS bin, count(b.bin) AS n FROM range({-_BINS}, {_BINS + 1}) r(k) LEFT JOIN b ON CAST(b.bin AS BIGINT) = k GROUP BY k), "
    f"noisy AS (SELECT bin, n + {laplace_sql(uniform_sql('bounds', 'q-bounds', 'bin'), '10.0')} AS c FROM h), "
    f"kept AS (SELECT bin, sum(c) OVER (ORDER BY bin) AS s, sum(c) OVER () AS a FROM noisy WHERE c >= {_BIN_LIMIT!r}), "
    f"edges AS (SELECT *, pow(2.0, abs(bin) + {dp_private.LOWEST - 1}) AS e FROM kept) "
    "SELECT min(CASE WHEN s > 0.01 * a THEN CASE WHEN bin > 0 THEN e WHEN bin < 0 THEN -2 * e ELSE 0 END END) AS lower, "
    "min(CASE WHEN s >= 0.99 * a THEN CASE WHEN bin > 0 THEN 2 * e WHEN bin < 0 THEN -e ELSE 0 END END) AS upper FROM edges",
)
def dp_private_bounds(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("CAST(l_extendedprice AS DOUBLE) - 30000 AS v")
    return dp_private.private_bounds(rows, "v", SECRET, "q-bounds", 0.1, outside=0.01)


@query(
    "dp_filtered_query",
    f"WITH {DEMOGRAPHIC_SQL}, s AS (SELECT count(age) AS n, avg(CAST(least(greatest(age, 0), 120) AS DOUBLE)) AS m "
    "FROM demographic WHERE age > 18 AND area_type = 'urban') "
    + _dp_row("mean", "age", f"round(least(greatest(m + {laplace_sql(_u('mean', 'age', 'q-filter'), '120 / 0.05 / n')}, 0), 120), 4)", "s"),
)
def dp_filtered_query(spark, sf):
    request = {
        "query_id": "q-filter",
        "table_name": "demographic",
        "field_name": "age",
        "query_type": "mean",
        "filters": {
            "age": {"operator": ">", "value": 18},
            "area_type": {"operator": "=", "value": "urban"},
        },
    }
    return _rounded(dp.dp_query({"demographic": demographic(spark, sf)}, request, 1000, SECRET))


_TRUE = (
    "SELECT count(l_quantity) AS n, count(*) FILTER (WHERE l_quantity <> 0) AS nz, sum(least(greatest(l_quantity, 0), 50)) AS s, "
    "avg(least(greatest(l_quantity, 0), 50)) AS a, var_pop(least(greatest(l_quantity, 0), 50)) AS v FROM lineitem"
)
_COSTS = ", ".join(f"('{t}', {c / 100})" for t, c in K.QUERY_COST_CENTS.items())
_ANSWER_U = uniform_sql("dp_answer", "l_quantity", "query_id")


@query(
    "dp_answer_log",
    budgets.fold_sql()
    + f", t AS ({_TRUE}), cost(qt, c) AS (VALUES {_COSTS}), deg(d) AS (VALUES (1), (2), (5), (10)), "
    "kinds AS (SELECT qt, CAST(d AS DOUBLE) AS d, CAST(c AS DOUBLE) / d AS eps, CASE qt WHEN 'count' THEN CAST(nz AS DOUBLE) "
    "WHEN 'mean' THEN a WHEN 'sum' THEN s ELSE v END AS m, CAST(0 AS DOUBLE) AS lo, CASE qt WHEN 'sum' THEN 50.0 * n "
    "WHEN 'mean' THEN 50 ELSE 625 END AS hi, CASE qt WHEN 'count' THEN 1 WHEN 'mean' THEN CAST(50 AS DOUBLE) / n WHEN 'sum' THEN 50 "
    "ELSE CAST(2500 AS DOUBLE) * (n - 1) / (CAST(n AS DOUBLE) * n) END AS sens FROM t, cost, deg), "
    + scale_sql("SELECT concat(qt, d) AS k, eps, m, lo, CAST(hi AS DOUBLE) AS hi, sens FROM kinds WHERE qt IN ('sum', 'variance', 'std')")
    + ", mech AS (SELECT kinds.*, coalesce(scale.b, sens / eps) AS b FROM kinds LEFT JOIN scale ON k = concat(qt, d)), "
    "q AS (SELECT holder, query_id, query_type, cents, accepted, units, units * 100 / max AS pct, CAST(CASE WHEN units * 100 / max > 50 "
    "THEN 1 WHEN units * 100 / max > 25 THEN 2 WHEN units * 100 / max > 10 THEN 5 ELSE 10 END AS DOUBLE) AS d FROM fold), "
    f"j AS (SELECT q.*, mech.*, {_ANSWER_U} AS u FROM q JOIN mech ON qt = query_type AND mech.d = q.d), "
    f"p AS (SELECT *, {_cdf('(lo - m)')} + u * ({_cdf('(hi - m)')} - {_cdf('(lo - m)')}) AS p, "
    f"m + {laplace_sql('u', 'b')} AS plain FROM j), r AS (SELECT *, {_BOUNDED_RESULT} AS inside FROM p) "
    "SELECT query_id, holder AS user_id, query_type, CASE WHEN accepted THEN round(CASE query_type WHEN 'count' THEN "
    "greatest(round_even(plain, 0), 0) WHEN 'mean' THEN least(greatest(plain, 0), 50) WHEN 'std' THEN sqrt(inside) ELSE inside END, 4) "
    "END AS result, CASE WHEN NOT accepted THEN 'BUDGET_EXHAUSTED' END AS error, units / 100 AS epsilon_remaining, "
    "round(pct, 2) AS budget_percentage, CASE WHEN accepted THEN round(eps, 6) END AS effective_epsilon, "
    "CASE WHEN pct > 50 THEN 'HIGH' WHEN pct > 25 THEN 'MEDIUM' WHEN pct > 10 THEN 'LOW' ELSE 'CRITICAL' END AS budget_status, "
    "CASE WHEN pct > 50 THEN NULL WHEN pct > 25 THEN printf('Your privacy budget is at %.1f%%. Noise has been increased %.1fx "
    "for stronger privacy protection.', pct, CAST(2 AS DOUBLE)) WHEN pct > 10 THEN printf('⚠️ Your privacy budget is running low "
    "(%.1f%% remaining). Noise has been increased %.1fx for stronger privacy protection.', pct, CAST(5 AS DOUBLE)) ELSE "
    "printf('🚨 CRITICAL: Only %.1f%% budget remaining! Noise has been increased %.1fx. Consider requesting a budget reset.', "
    "pct, CAST(10 AS DOUBLE)) END AS warning FROM r",
)
def dp_answer_log(spark, sf):
    # every query of the log, decided by the ledger, asks about the quantity of the line items
    decided = ledger.decisions(budgets._fold(spark, sf))
    answers = dp.answer_log(decided, table(spark, sf, "lineitem"), "l_quantity", 0, 50, SECRET)
    return answers.select(
        "query_id", "user_id", "query_type", F.round("result", 4).alias("result"), "error", "epsilon_remaining",
        "budget_percentage", F.round("effective_epsilon", 6).alias("effective_epsilon"), "budget_status", "warning",
    )


# ------------------------------------------------------------------ noise with a seed
_EVENT_U = [uniform_of_sql(_EVENT_SEED, i) for i in (0, 1)]


@query(
    "noise_laplace_seeded",
    f"SELECT event_id, round(value + {laplace_sql(_EVENT_U[0], '2.0')}, 6) AS noisy FROM events",
)
def noise_laplace_seeded(spark, sf):
    noisy = dp.seeded_laplace(table(spark, sf, "events"), "value", "event_id", "ts", SEED_KEY, 2.0)
    return noisy.select("event_id", F.round("noisy", 6).alias("noisy"))


@query(
    "noise_gaussian_seeded",
    f"SELECT event_id, round(value + 2.0 * sqrt(-2 * ln({_EVENT_U[0]})) * cos(2 * pi() * {_EVENT_U[1]}), 6) AS noisy FROM events",
)
def noise_gaussian_seeded(spark, sf):
    noisy = dp.seeded_gaussian(table(spark, sf, "events"), "value", "event_id", "ts", SEED_KEY, 2.0)
    return noisy.select("event_id", F.round("noisy", 6).alias("noisy"))


_BOUNDED_U = uniform_sql("bounded", "value", "event_id")


@query(
    "noise_laplace_bounded",
    "WITH RECURSIVE "
    + bounded_sql("SELECT CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS lo, CAST(100 AS DOUBLE) AS hi, CAST(5 AS DOUBLE) AS sens", "0.5", 1.0)
    + f", e AS (SELECT event_id, least(greatest(value, 0), 100) AS m, 0.0 AS lo, 100.0 AS hi, (SELECT b FROM scale) AS b, "
    f"{_BOUNDED_U} AS u FROM events), pr AS (SELECT *, {_cdf('(lo - m)')} + u * ({_cdf('(hi - m)')} - {_cdf('(lo - m)')}) AS p FROM e) "
    f"SELECT event_id, round({_BOUNDED_RESULT}, 6) AS noisy FROM pr",
)
def noise_laplace_bounded(spark, sf):
    # the scale is the same for every row: solved once, then a scalar subquery
    low, high = F.lit(0.0), F.lit(100.0)
    scale = spark.range(1).select(keyed.bounded_laplace_scale(1.0, F.lit(5.0), high - low).alias("b")).scalar()
    u = keyed.uniform(SECRET, "bounded", "value", F.col("event_id"))
    noisy = keyed.bounded_laplace(dp.clip(F.col("value"), 0, 100), u, scale, low, high)
    return table(spark, sf, "events").select("event_id", F.round(noisy, 6).alias("noisy"))


# ------------------------------------------------------------------ similar queries
_QUESTION = [
    "query_id", "user_id", "CAST(user_id % 10 AS BIGINT) AS team_id", "ts",
    "concat('table ', CAST(query_id % 2 AS STRING)) AS table_name", "'value' AS field_name", "query_type",
]


@query(
    "similar_queries",
    f"WITH {LOG_SQL}, q AS (SELECT {', '.join(_QUESTION)} FROM log), "
    "n AS (SELECT *, count(*) OVER (PARTITION BY team_id, table_name, field_name, query_type ORDER BY epoch_us(ts) "
    "RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1 AS alike, count(*) OVER (PARTITION BY team_id, user_id, "
    "table_name, field_name, query_type ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1 AS own FROM q) "
    "SELECT query_id, user_id, team_id, alike AS similar_queries_detected, alike > own AS cross_user_detection, "
    "CAST(CASE WHEN alike = 0 THEN 1 WHEN alike > own THEN 3 ELSE 2 END AS DOUBLE) AS budget_multiplier FROM n",
)
def similar_queries(spark, sf):
    return teams.similar_queries(query_log(spark, sf).selectExpr(*_QUESTION))
