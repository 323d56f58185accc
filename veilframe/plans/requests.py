"""Queries for requests under a budget, policies asked for, and reports of single users."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import classify, dp, ledger, policy, reports, teams
from ..session import materialize, scratch_path
from ..sources import tables
from . import budgets
from .base import (
    LOG_SQL, MAX_CENTS, PEOPLE_COLUMNS, PEOPLE_SQL, REFILL_CENTS, SECRET, laplace_sql, people, query, query_log, table, uniform_sql,
)
from .privacy import _QUESTION
from .risks import _MECHANISM, classified_sql

# ------------------------------------------------------------------ similar queries, charged
_SIMILAR_SQL = (
    "alike AS (SELECT *, count(*) OVER (PARTITION BY team_id, table_name, field_name, query_type ORDER BY epoch_us(ts) "
    "RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1 AS likes, count(*) OVER (PARTITION BY team_id, user_id, "
    "table_name, field_name, query_type ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1 "
    "AS own FROM asked), charged AS (SELECT *, CASE WHEN likes = 0 THEN 1 WHEN likes > own THEN 3 ELSE 2 END AS factor FROM alike)"
)


@query(
    "similar_queries_charged",
    budgets.fold_sql(
        ctes=f"asked AS (SELECT {', '.join(_QUESTION)}, cost_cents FROM log), {_SIMILAR_SQL}",
        source="SELECT user_id, query_id, ts, query_type, cost_cents * factor AS cost_cents, 2 AS kind FROM charged",
    )
    + " SELECT f.holder AS user_id, f.query_id // 3 AS query_id, c.cost_cents / 100 AS base_epsilon_cost, f.cents / 100 AS effective_epsilon_cost, "
    "CAST(c.factor AS DOUBLE) AS budget_multiplier, f.accepted, f.units / 100 AS epsilon_remaining FROM fold f JOIN charged c USING (query_id)",
)
def similar_queries_charged(spark, sf):
    """The log folded at the cost that similar queries raise; three queries share each id."""
    log = query_log(spark, sf).selectExpr(*_QUESTION, "cost_cents").withColumn("query_id", F.expr("query_id DIV 3"))
    folded = ledger.ledger_fold(
        teams.charged(log), max_cents=MAX_CENTS, refill_cents=REFILL_CENTS, carry=["base_cost_cents", "budget_multiplier"]
    )
    return ledger.decisions(folded).select(
        "user_id", "query_id", (F.col("base_cost_cents") / 100.0).alias("base_epsilon_cost"),
        F.col("epsilon_cost").alias("effective_epsilon_cost"), "budget_multiplier", "accepted", "epsilon_remaining",
    )


# ------------------------------------------------------------------ requests with fields and filters
_REQUEST = [
    "event_id AS query_id", "user_id", "CAST(user_id % 10 AS BIGINT) AS team_id", "CAST(ts AS TIMESTAMP) AS ts",
    "'lineitem' AS table_name",
    "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'l_quantity' WHEN event_id % 13 = 1 THEN 'l_comment' "
    "ELSE 'l_discount' END AS field_name",
    "CASE event_type WHEN 'click' THEN 'count' WHEN 'signup' THEN 'count' WHEN 'error' THEN 'median' ELSE 'mean' END AS query_type",
    "CASE WHEN event_id % 2 = 0 THEN 'l_linenumber' END AS filter_field",
    "CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 7 = 0 THEN 'like' ELSE '>' END END AS filter_operator",
    "CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 3 AS DOUBLE) END AS filter_value",
]
_FIELDS = ["l_quantity", "l_discount", "l_linenumber"]
_BOUNDS = {"l_quantity": (0, 50), "l_discount": (0, 1), "l_linenumber": (0, 10)}
_REQUEST_U = uniform_sql("dp_answer", "request", "concat(field_name, '|', CAST(query_id AS VARCHAR))")


@query(
    "dp_request_log",
    budgets.fold_sql(
        ctes=f"req AS (SELECT {', '.join(_REQUEST)} FROM events), checked AS (SELECT *, CASE WHEN field_name IS NULL THEN "
        "'field_name required' WHEN field_name = 'l_comment' THEN 'Unknown field' WHEN query_type = 'median' THEN 'Invalid query type' "
        "WHEN filter_operator = 'like' THEN 'Invalid filter operator' END AS wrong, CASE query_type WHEN 'count' THEN 1 ELSE 5 END "
        f"AS cost_cents FROM req), asked AS (SELECT * FROM checked WHERE wrong IS NULL), {_SIMILAR_SQL}",
        source="SELECT user_id, query_id, ts, query_type, cost_cents * factor AS cost_cents, 2 AS kind FROM charged",
    )
    + ", specs AS (SELECT DISTINCT field_name, filter_value FROM charged), stat AS (SELECT s.field_name, s.filter_value, "
    "greatest(count(x), 1) AS n, count(*) FILTER (WHERE x <> 0) AS nz, avg(least(greatest(x, 0), CASE s.field_name WHEN 'l_quantity' "
    "THEN 50 ELSE 1 END)) AS a, CAST(CASE s.field_name WHEN 'l_quantity' THEN 50 ELSE 1 END AS DOUBLE) AS hi FROM specs s JOIN (SELECT "
    "l_linenumber, unnest(['l_quantity', 'l_discount']) AS field, CAST(unnest([CAST(l_quantity AS DOUBLE), CAST(l_discount AS DOUBLE)]) AS DOUBLE) AS x "
    "FROM lineitem) t ON t.field = s.field_name AND (s.filter_value IS NULL OR t.l_linenumber > s.filter_value) GROUP BY ALL), "
    "j AS (SELECT c.query_id, c.user_id, c.query_type, c.field_name, c.cost_cents, f.cents, f.accepted, f.units, f.units * 100 / f.max AS pct, "
    "s.n, s.nz, s.a, s.hi, CAST(CASE WHEN f.units * 100 / f.max > 50 THEN 1 WHEN f.units * 100 / f.max > 25 THEN 2 "
    f"WHEN f.units * 100 / f.max > 10 THEN 5 ELSE 10 END AS DOUBLE) AS d, {_REQUEST_U.replace('field_name', 'c.field_name').replace('query_id', 'c.query_id')} AS u "
    "FROM charged c JOIN fold f USING (query_id) JOIN stat s ON s.field_name = c.field_name AND s.filter_value IS NOT DISTINCT FROM c.filter_value), "
    "e AS (SELECT *, CASE query_type WHEN 'count' THEN 0.01 ELSE 0.05 END / d AS eps FROM j) "
    "SELECT query_id, user_id, CASE WHEN accepted THEN round(CASE query_type WHEN 'count' THEN greatest(round_even(nz + "
    f"{laplace_sql('u', '1 / eps')}, 0), 0) ELSE least(greatest(a + {laplace_sql('u', 'hi / n / eps')}, 0), hi) END, 4) END AS result, "
    "CASE WHEN NOT accepted THEN 'BUDGET_EXHAUSTED' END AS error, cost_cents / 100 AS base_epsilon_cost, cents / 100 AS "
    "effective_epsilon_cost, units / 100 AS epsilon_remaining, CASE WHEN pct > 50 THEN 'HIGH' WHEN pct > 25 THEN 'MEDIUM' WHEN pct > 10 "
    "THEN 'LOW' ELSE 'CRITICAL' END AS budget_status FROM e UNION ALL SELECT query_id, user_id, NULL, wrong, NULL, NULL, NULL, NULL "
    "FROM checked WHERE wrong IS NOT NULL",
)
def dp_request_log(spark, sf):
    """Requests from check to answer: invalid ones are told why and pay nothing, similar ones pay more."""
    asked = table(spark, sf, "events").selectExpr(*_REQUEST).withColumn("wrong", dp.invalid_request({"lineitem": _FIELDS}))
    cents = F.create_map(*[F.lit(x) for pair in K.QUERY_COST_CENTS.items() for x in pair])
    valid = materialize(asked.where("wrong IS NULL").withColumn("cost_cents", F.element_at(cents, F.col("query_type"))))
    request = ["base_cost_cents", "field_name", "filter_field", "filter_operator", "filter_value"]
    folded = ledger.ledger_fold(teams.charged(valid), max_cents=MAX_CENTS, refill_cents=REFILL_CENTS, carry=request)
    decided = materialize(ledger.decisions(folded))
    answers = dp.answer_requests(decided, table(spark, sf, "lineitem"), _BOUNDS, SECRET, keep=["base_cost_cents"])
    told = answers.select(
        "query_id", "user_id", F.round("result", 4).alias("result"), "error",
        (F.col("base_cost_cents") / 100.0).alias("base_epsilon_cost"),
        F.col("epsilon_cost").alias("effective_epsilon_cost"), "epsilon_remaining", "budget_status",
    )
    refused = asked.where("wrong IS NOT NULL").select("query_id", "user_id", F.col("wrong").alias("error"))
    return told.unionByName(refused, allowMissingColumns=True)


# ------------------------------------------------------------------ reports and policies
@query(
    "classification_report",
    classified_sql(PEOPLE_SQL, "people", PEOPLE_COLUMNS)
    + f' SELECT type, count(*) AS columns, string_agg(concat(f, \':\', sensitivity, \':\', {_MECHANISM}), \',\' ORDER BY f) AS details '
    "FROM k GROUP BY type",
)
def classification_report(spark, sf):
    found = classify.report(classify.classify_columns(people(spark, sf)))
    entry = F.transform("details", lambda d: F.concat_ws(":", d["column"], d["sensitivity"], d["mechanism"]))
    return found.select("type", "columns", F.array_join(entry, ",").alias("details"))


@query(
    "custom_policy",
    "SELECT n_nationkey, CAST(n_nationkey % 9 AS DOUBLE) / 2 AS epsilon, 3 + n_nationkey % 8 AS k_anonymity, "
    "CASE WHEN n_nationkey % 9 >= 6 THEN 'MINIMAL' WHEN n_nationkey % 9 >= 3 THEN 'STANDARD' WHEN n_nationkey % 9 >= 2 THEN 'STRICT' "
    "ELSE 'MAXIMUM' END AS level, CAST(0.00001 AS DOUBLE) AS delta, "
    "concat('Custom policy (ε=', CAST(n_nationkey % 9 AS DOUBLE) / 2, ', k=', 3 + n_nationkey % 8, ')') AS description FROM nation",
)
def custom_policy(spark, sf):
    wanted = table(spark, sf, "nation").selectExpr(
        "n_nationkey", "CAST(n_nationkey % 9 AS DOUBLE) / 2 AS epsilon", "3 + n_nationkey % 8 AS k_anonymity"
    )
    return policy.custom_policies(wanted).drop("level_value")


_RULES = ", ".join(
    f"({i}, '{name}', '{','.join(methods)}', '{protection}', '"
    + ",".join(f"{k}={v}" for k, v in K.COLUMN_RULE_LIMITS[name].items())
    + "')"
    for i, (name, methods, protection) in enumerate(K.COLUMN_RULES)
)


@query(
    "column_rules",
    classified_sql(PEOPLE_SQL, "people", PEOPLE_COLUMNS)
    + f", m AS (SELECT f, {_MECHANISM} AS mechanism FROM k), rules(i, rule, methods, protection, limits) AS (VALUES {_RULES}), "
    "hit AS (SELECT m.*, rules.*, row_number() OVER (PARTITION BY f ORDER BY i) AS rn FROM m LEFT JOIN rules ON contains(lower(f), rule)) "
    'SELECT f AS "column", mechanism, rule, methods AS allowed_methods, i IS NOT NULL AS must_transform, protection AS min_protection, '
    "limits, CASE WHEN rule IS NOT NULL THEN contains(concat(',', methods, ','), concat(',', mechanism, ',')) END AS method_allowed "
    "FROM hit WHERE rn = 1",
)
def column_rules(spark, sf):
    found = policy.column_rule_check(classify.classify_columns(people(spark, sf)).select("column", "mechanism"))
    limits = F.transform(F.map_entries("limits"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select(
        "column", "mechanism", "rule", F.array_join("allowed_methods", ",").alias("allowed_methods"),
        F.coalesce("must_transform", F.lit(False)).alias("must_transform"), "min_protection",
        F.array_join(limits, ",").alias("limits"), "method_allowed",
    )


@query(
    "audit_export_user",
    budgets.fold_sql() + budgets._TRANSACTIONS + f" SELECT {budgets._AUDIT} FROM t WHERE user_id = (SELECT min(user_id) FROM t)",
)
def audit_export_user(spark, sf):
    """The audit log of one user as JSON lines, written and read again."""
    entries = reports.audit_entries(budgets._ledgers(spark, sf)[1])
    one = reports.entries_of(entries, entries.agg(F.min("user_id").alias("u")).first()["u"])
    path = scratch_path(spark, "audit")
    tables.write_audit_log(one, path, "json")
    return budgets._flat_audit(spark.read.schema(one.schema).json(path))
