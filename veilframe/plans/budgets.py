"""Queries for the budget ledger, reports and teams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import ledger, reports, teams as team_ops
from ..session import materialize
from .base import (
    LOG_SQL, MAX_CENTS, MEMBERSHIPS_SQL, REFILL_CENTS, TEAMS_SQL, memberships, query, query_log, table, teams,
)


# ------------------------------------------------------------------ SQL generators
def fold_sql(
    rule: str = "hourly",
    max_cents: int = MAX_CENTS,
    rate: int = REFILL_CENTS,
    holder: str = "user_id",
    source: str = "SELECT user_id, query_id, ts, query_type, cost_cents, 2 AS kind FROM log",
    ctes: str = "",
) -> str:
    """CTEs ending in ``fold``: one sequential step per event of each holder."""
    unit = ledger.UNITS_PER_CENT[rule]
    elapsed = "(e.at_s - f.last)"
    if rule == "hourly":
        ignored = "false"
        moves = f"{elapsed} >= 3600"
        due = f"{rate} * ({elapsed} // 3600)"
        full_after = "f.fresh"
    else:
        ignored = f"e.cents > f.max"
        moves = f"({elapsed} >= 3600 AND NOT f.fresh)"
        due = f"f.max * {elapsed}"
        full_after = "false"
    refill = f"CASE WHEN {ignored} OR NOT {moves} THEN 0 ELSE least({due}, f.max * {unit} - f.units) END"
    before = f"(f.units + {refill})"
    accepted = f"(NOT ({ignored}) AND {before} >= e.cents * {unit})"
    first_set = "kind = 1"
    return (
        f"WITH RECURSIVE {LOG_SQL}, {ctes + ', ' if ctes else ''}"
        f"ev AS (SELECT {holder} AS holder, query_id, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS at_s, query_type, "
        "CAST(cost_cents AS BIGINT) AS cents, kind, row_number() OVER (PARTITION BY "
        f"{holder} ORDER BY ts, kind, query_id) AS rn FROM ({source})), "
        "fold AS (SELECT holder, query_id, us, at_s, query_type, cents, kind, rn, at_s AS last, "
        f"CASE WHEN {first_set} THEN cents ELSE CAST({max_cents} AS BIGINT) END AS max, {first_set} AS fresh, "
        # a reset of a holder nobody knew yet first creates the default ledger
        f"CASE WHEN {first_set} THEN (cents - {max_cents}) * {unit} ELSE CAST(0 AS BIGINT) END AS refill, "
        f"CAST({max_cents * unit} AS BIGINT) AS before, "
        f"CASE WHEN {first_set} THEN NULL ELSE cents <= {max_cents} END AS accepted, "
        f"CASE WHEN {first_set} THEN cents * {unit} WHEN cents <= {max_cents} THEN ({max_cents} - cents) * {unit} "
        f"ELSE CAST({max_cents * unit} AS BIGINT) END AS units FROM ev WHERE rn = 1 "
        "UNION ALL SELECT e.holder, e.query_id, e.us, e.at_s, e.query_type, e.cents, e.kind, e.rn, "
        f"CASE WHEN e.kind = 1 THEN e.at_s WHEN NOT ({ignored}) AND {moves} THEN e.at_s ELSE f.last END, "
        f"CASE WHEN e.kind = 1 THEN e.cents ELSE f.max END, CASE WHEN e.kind = 1 THEN true WHEN {ignored} THEN f.fresh "
        f"ELSE false END, CASE WHEN e.kind = 1 THEN e.cents * {unit} - f.units ELSE {refill} END, "
        f"CASE WHEN e.kind = 1 THEN f.units ELSE {before} END, CASE WHEN e.kind = 1 THEN NULL ELSE {accepted} END, "
        f"CASE WHEN e.kind = 1 THEN e.cents * {unit} WHEN {accepted} THEN {before} - e.cents * {unit} ELSE {before} END "
        "FROM fold f JOIN ev e ON e.holder = f.holder AND e.rn = f.rn + 1)"
    )


_DECISIONS = (
    "SELECT holder AS user_id, query_id, query_type, cents / 100 AS epsilon_cost, accepted, refill AS refill_units, "
    "units AS remaining_units FROM fold WHERE kind = 2"
)


def _fold(spark, sf, **options) -> DataFrame:
    return ledger.ledger_fold(query_log(spark, sf), max_cents=MAX_CENTS, refill_cents=REFILL_CENTS, **options)


def _decided(folded: DataFrame, holder: str = "user_id") -> DataFrame:
    return folded.where(F.col("kind") == ledger.QUERY).select(
        F.col("holder").alias(holder),
        F.col("event_id").alias("query_id"),
        "query_type",
        (F.col("cents") / F.lit(100)).alias("epsilon_cost"),
        "accepted",
        "refill_units",
        "remaining_units",
    )


# ------------------------------------------------------------------ folds
@query("ledger_fold", fold_sql() + " " + _DECISIONS)
def ledger_fold(spark, sf):
    return _decided(_fold(spark, sf))


@query("ledger_fold_db", fold_sql("fractional") + " " + _DECISIONS)
def ledger_fold_db(spark, sf):
    return _decided(_fold(spark, sf, rule="fractional"))


# sign-ups double as admin resets to 25 or 35 hundredths
_RESET_SOURCE = (
    "SELECT user_id, query_id, ts, query_type, cost_cents, 2 AS kind FROM log UNION ALL "
    "SELECT user_id, event_id, ts, NULL, CAST(25 + event_id % 2 * 10 AS INT), 1 FROM events WHERE event_type = 'signup'"
)


@query(
    "ledger_admin_reset",
    fold_sql(source=_RESET_SOURCE)
    + " SELECT holder AS user_id, us AS at_us, CASE WHEN kind = 1 THEN 'ADMIN' ELSE 'AUTOMATIC' END AS refill_type, "
    "round(refill / 100, 6) AS refill_amount, round((CASE WHEN kind = 1 THEN before ELSE before - refill END) / 100, 6) "
    "AS epsilon_before, round((CASE WHEN kind = 1 THEN before + refill ELSE before END) / 100, 6) AS epsilon_after "
    "FROM fold WHERE rn > 0 AND (kind = 1 OR refill > 0)",
)
def ledger_admin_reset(spark, sf):
    signups = table(spark, sf, "events").where("event_type = 'signup'")
    resets = signups.selectExpr("user_id", "event_id AS reset_id", "ts", "CAST(25 + event_id % 2 * 10 AS BIGINT) AS max_cents")
    log = ledger.refills(_fold(spark, sf, resets=resets))
    return log.select(
        "user_id",
        F.unix_micros("ts").alias("at_us"),
        "refill_type",
        *[F.round(c, 6).alias(c) for c in ("refill_amount", "epsilon_before", "epsilon_after")],
    )


_TEAM_HOLDER = (
    "CASE WHEN user_id % 10 % 2 = 0 THEN concat('team:', CAST(user_id % 10 AS VARCHAR)) "
    "ELSE concat('user:', CAST(user_id AS VARCHAR)) END"
)


@query(
    "ledger_fold_team",
    fold_sql(holder=_TEAM_HOLDER) + " " + _DECISIONS.replace("AS user_id", "AS holder"),
)
def ledger_fold_team(spark, sf):
    # members of a team with a shared budget spend from the team's ledger
    log = ledger.team_holder(query_log(spark, sf), memberships(spark, sf), teams(spark, sf))
    folded = ledger.ledger_fold(log, "holder", max_cents=MAX_CENTS, refill_cents=REFILL_CENTS)
    return _decided(folded, "holder")


# ------------------------------------------------------------------ reports
_LEDGER = (
    ", ledgers AS (SELECT holder AS user_id, arg_max(max, rn) / 100 AS max_epsilon, arg_max(units, rn) / 100 AS epsilon_remaining, "
    "arg_max(units, rn) AS units, arg_max(last, rn) AS last_refill_s, count(*) FILTER (WHERE accepted) AS total_queries, "
    "max(us) FILTER (WHERE accepted) AS last_query_us, min(us) AS created_us FROM fold GROUP BY holder), "
    "pct AS (SELECT *, epsilon_remaining / max_epsilon * 100 AS p FROM ledgers), "
    "status AS (SELECT *, CASE WHEN p > 50 THEN 'HIGH' WHEN p > 25 THEN 'MEDIUM' WHEN p > 10 THEN 'LOW' ELSE 'CRITICAL' END AS status, "
    "CAST(CASE WHEN p > 50 THEN 1 WHEN p > 25 THEN 2 WHEN p > 10 THEN 5 ELSE 10 END AS DOUBLE) AS degradation FROM pct)"
)


def _ledgers(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(ledgers, transactions) of the query log, from one stored fold."""
    folded = materialize(_fold(spark, sf))
    return ledger.ledger_table(folded), ledger.transactions(folded)


@query(
    "budget_status",
    fold_sql() + _LEDGER + " SELECT user_id, round(epsilon_remaining, 6) AS epsilon_remaining, max_epsilon AS epsilon_total, "
    "round(p, 2) AS budget_percentage, status, degradation AS degradation_factor, total_queries, last_refill_s FROM status",
)
def budget_status(spark, sf):
    found = reports.budget_status(_ledgers(spark, sf)[0])
    return found.withColumn("last_refill_s", F.unix_seconds("last_refill")).drop("last_refill")


@query(
    "all_budgets",
    fold_sql() + _LEDGER + " SELECT user_id, round(epsilon_remaining, 6) AS epsilon_remaining, max_epsilon AS epsilon_total, "
    "round(p, 2) AS budget_percentage, status, total_queries, last_query_us, last_refill_s FROM status",
)
def all_budgets(spark, sf):
    found = reports.all_budgets(*_ledgers(spark, sf))
    return found.select(
        "user_id", "epsilon_remaining", "epsilon_total", "budget_percentage", "status", "total_queries",
        F.unix_micros("last_query").alias("last_query_us"), F.unix_seconds("last_refill").alias("last_refill_s"),
    )


@query(
    "user_list",
    fold_sql() + _LEDGER + " SELECT user_id, user_id % 10 AS team_id, round(epsilon_remaining, 4) AS epsilon_remaining, "
    "max_epsilon AS epsilon_total, round(p, 1) AS budget_percent, status, created_us FROM status",
)
def user_list(spark, sf):
    owned = _ledgers(spark, sf)[0].join(memberships(spark, sf).select("user_id", "team_id"), "user_id", "left")
    found = reports.user_list(owned)
    return found.withColumn("created_us", F.unix_micros("created_at")).drop("created_at")


@query(
    "system_stats",
    fold_sql() + _LEDGER + " SELECT count(*) AS total_users, (SELECT count(*) FROM fold WHERE accepted) AS total_queries, "
    "round(avg((max_epsilon - epsilon_remaining) / max_epsilon * 100), 2) AS average_budget_used_percent FROM ledgers",
)
def system_stats(spark, sf):
    return reports.system_stats(*_ledgers(spark, sf))


@query("query_breakdown", fold_sql() + " SELECT query_type, count(*) AS n FROM fold WHERE accepted GROUP BY query_type")
def query_breakdown(spark, sf):
    return reports.query_breakdown(_ledgers(spark, sf)[1])


@query(
    "status_histogram",
    fold_sql() + _LEDGER + ", levels(position, status) AS (VALUES (0, 'HIGH'), (1, 'MEDIUM'), (2, 'LOW'), (3, 'CRITICAL')) "
    "SELECT position, levels.status, count(user_id) AS users FROM levels LEFT JOIN status ON levels.status = status.status "
    "GROUP BY position, levels.status",
)
def status_histogram(spark, sf):
    return reports.status_histogram(_ledgers(spark, sf)[0])


@query(
    "queries_remaining",
    fold_sql() + _LEDGER + " SELECT user_id, units // 1 AS count_queries, units // 5 AS mean_queries, units // 10 AS sum_queries FROM ledgers",
)
def queries_remaining(spark, sf):
    closing = ledger.ledgers(_fold(spark, sf)).withColumnRenamed("holder", "user_id")
    return reports.queries_remaining(closing, F.col("remaining_units"))


_TRANSACTIONS = (
    ", t AS (SELECT holder AS user_id, query_id, us, query_type, cents / 100 AS epsilon_cost, units / 100 AS epsilon_remaining, "
    "CASE WHEN units * 100 / max > 50 THEN 1 WHEN units * 100 / max > 25 THEN 2 WHEN units * 100 / max > 10 THEN 5 ELSE 10 END "
    "AS factor FROM fold WHERE accepted)"
)
_AUDIT = (
    "user_id, us AS at_us, query_id, query_type, round(epsilon_cost, 6) AS epsilon_cost, round(epsilon_remaining, 6) "
    "AS epsilon_remaining, 'LaplaceBoundedDomain' AS mechanism, round(epsilon_cost / factor, 6) AS effective_epsilon, "
    "printf('Laplace(μ=0, b=%.2f)', 1 / (epsilon_cost / factor)) AS noise_distribution, "
    "concat(factor, '.0x') AS degradation_applied"
)


def _flat_audit(entries: DataFrame, *extra: str) -> DataFrame:
    return entries.select(
        "user_id", F.unix_micros("timestamp").alias("at_us"), "query_id", "query_type", "epsilon_cost",
        "epsilon_remaining", "mechanism", "mathematical_output.effective_epsilon",
        "mathematical_output.noise_distribution", "mathematical_output.degradation_applied", *extra,
    )


@query(
    "audit_log_topn",
    fold_sql() + _TRANSACTIONS + f", r AS (SELECT {_AUDIT}, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, "
    "query_id DESC) AS entry FROM t) SELECT * FROM r WHERE entry <= 20",
)
def audit_log_topn(spark, sf):
    return _flat_audit(reports.audit_log(_ledgers(spark, sf)[1], limit=20), "entry")


@query(
    "ledger_reset_all",
    fold_sql() + _LEDGER + " SELECT user_id, CAST(10 AS DOUBLE) AS max_epsilon, CAST(10 AS DOUBLE) AS epsilon_remaining, "
    "epoch_us(TIMESTAMP '2024-02-01 00:00:00') // 1000000 AS last_refill_s, total_queries FROM ledgers",
)
def ledger_reset_all(spark, sf):
    cleared = ledger.reset_all(_ledgers(spark, sf)[0], 10.0, "2024-02-01 00:00:00")
    return cleared.select(
        "user_id", "max_epsilon", "epsilon_remaining", F.unix_seconds("last_refill").alias("last_refill_s"), "total_queries"
    )


@query(
    "ledger_open",
    fold_sql() + _LEDGER + " SELECT o.o_custkey AS user_id, coalesce(max(max_epsilon), 10) AS max_epsilon, "
    "coalesce(max(epsilon_remaining), 10) AS epsilon_remaining FROM (SELECT o_custkey FROM orders UNION SELECT user_id FROM ledgers) "
    "o LEFT JOIN ledgers ON user_id = o_custkey GROUP BY o.o_custkey",
)
def ledger_open(spark, sf):
    # customers with orders ask for the first time; known analysts keep their ledger
    newcomers = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"))
    return ledger.open_ledgers(newcomers, _ledgers(spark, sf)[0])


# ------------------------------------------------------------------ teams
@query(
    "team_roster",
    fold_sql(ctes=f"{MEMBERSHIPS_SQL}, {TEAMS_SQL}") + _LEDGER + " SELECT m.team_id, team_name, m.user_id, role, "
    "epoch_us(joined_at) AS joined_us, CASE WHEN m.user_id % 4 = 0 THEN NULL ELSE epsilon_remaining END AS epsilon_remaining "
    "FROM memberships m JOIN teams USING (team_id) LEFT JOIN ledgers ON ledgers.user_id = m.user_id WHERE is_active",
)
def team_roster(spark, sf):
    # a quarter of the members have not opened a ledger
    some = _ledgers(spark, sf)[0].where("user_id % 4 <> 0")
    found = team_ops.roster(memberships(spark, sf), teams(spark, sf), some)
    return found.withColumn("joined_us", F.unix_micros(F.col("joined_at").cast("timestamp"))).drop("joined_at")


@query(
    "team_capacity",
    f"WITH {MEMBERSHIPS_SQL}, {TEAMS_SQL} SELECT t.team_id, count(m.user_id) AS members, max_members, "
    "count(m.user_id) >= max_members AS is_full FROM teams t LEFT JOIN memberships m USING (team_id) GROUP BY t.team_id, max_members",
)
def team_capacity(spark, sf):
    return team_ops.capacity(teams(spark, sf), memberships(spark, sf))


@query(
    "team_assignment",
    "WITH a AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN 'leave' ELSE 'join' END AS action, "
    "event_id % 10 AS team_id FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, "
    "event_id DESC) AS rn FROM a) SELECT user_id, CASE WHEN action = 'join' THEN team_id END AS team_id, "
    "epoch_us(ts) AS changed_us FROM l WHERE rn = 1",
)
def team_assignment(spark, sf):
    changes = table(spark, sf, "events").selectExpr(
        "user_id", "ts", "event_id", "CASE WHEN event_type = 'error' THEN 'leave' ELSE 'join' END AS action",
        "event_id % 10 AS team_id",
    )
    found = team_ops.assignment(changes)
    return found.select("user_id", "team_id", F.unix_micros(F.col("changed_at").cast("timestamp")).alias("changed_us"))


@query(
    "erase_users",
    fold_sql(ctes=MEMBERSHIPS_SQL) + ", gone AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 90) "
    "SELECT 'ledger' AS part, holder AS user_id, count(*) AS rows_left FROM (SELECT DISTINCT holder FROM fold) GROUP BY holder "
    "HAVING holder NOT IN (SELECT user_id FROM gone) UNION ALL SELECT 'history', holder, count(*) FROM fold WHERE accepted "
    "AND holder NOT IN (SELECT user_id FROM gone) GROUP BY holder UNION ALL SELECT 'membership', user_id, count(*) "
    "FROM memberships WHERE user_id NOT IN (SELECT user_id FROM gone) GROUP BY user_id",
)
def erase_users(spark, sf):
    gone = table(spark, sf, "events").where("event_type = 'error' AND value > 90").select("user_id").distinct()
    ledgers, history = _ledgers(spark, sf)
    parts = [("ledger", ledgers), ("history", history), ("membership", memberships(spark, sf))]
    left = [
        reports.erase_users(rows.select("user_id"), gone).select(F.lit(name).alias("part"), "user_id") for name, rows in parts
    ]
    everything = left[0].unionByName(left[1]).unionByName(left[2])
    return everything.groupBy("part", "user_id").agg(F.count(F.lit(1)).alias("rows_left"))
