"""Registry of queries, test fixtures derived from the tables, and SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K
from ..session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SECRET = "demonstration-secret"


def query(name: str, sql: str | None = None):
    """Register a query and, when SQL can express it, its counterpart."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ fixtures
# Select lists that mean the same in Spark SQL and DuckDB.
PEOPLE = [
    "c_custkey AS id",
    "c_name AS full_name",
    "concat('user', CAST(c_custkey AS STRING), '@mail', CAST(c_nationkey AS STRING), '.example.com') AS email",
    "concat('+91', lpad(CAST((c_custkey*7919)%10000000000 AS STRING),10,'0')) AS phone",
    "CAST((c_custkey*7)%90 AS INT) AS age",
    "c_acctbal AS salary",
    "c_mktsegment AS status",
    "concat('1', lpad(CAST(c_custkey%100000 AS STRING),5,'0')) AS pincode",
    "concat(CAST(8 + c_custkey%28 AS STRING), '.', lpad(CAST(c_custkey AS STRING),5,'1'), ', 7', "
    "CAST(c_nationkey%10 AS STRING), '.12345') AS gps",
]
PEOPLE_COLUMNS = ["id", "full_name", "email", "phone", "age", "salary", "status", "pincode", "gps"]

DEMOGRAPHIC = [
    "c_custkey AS record_id",
    "CAST((c_custkey*7)%111 AS INT) AS age",
    "CASE c_custkey%3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'X' END AS gender",
    "concat('State ', CAST(c_nationkey AS STRING)) AS state",
    "concat('Place ', CAST((c_custkey*13)%97 AS STRING)) AS district",
    "CASE WHEN c_custkey%2 = 0 THEN 'urban' ELSE 'rural' END AS area_type",
    "CAST(floor(abs(c_acctbal) * 25) AS BIGINT) AS monthly_income",
    "CAST(1 + c_custkey%12 AS INT) AS household_size",
    "CAST(c_custkey%700 AS DOUBLE) / CAST(10 AS DOUBLE) AS land_owned_acres",
    "CASE WHEN c_custkey%2 = 0 THEN concat(lpad(CAST((c_custkey*7919)%10000 AS STRING),4,'0'), ' ', "
    "lpad(CAST(c_custkey%10000 AS STRING),4,'0'), ' ', lpad(CAST((c_custkey*31)%10000 AS STRING),4,'0')) "
    "WHEN c_custkey%5 = 1 THEN substring(CAST(c_custkey AS STRING),1,3) "
    "ELSE lpad(CAST((c_custkey*7919)%1000000000000 AS STRING),12,'0') END AS aadhaar",
    "CASE WHEN c_custkey%4 = 0 THEN concat(' abcde', lpad(CAST(c_custkey%10000 AS STRING),4,'0'), 'f ') "
    "WHEN c_custkey%4 = 1 THEN concat('ABC', CAST(c_custkey AS STRING), 'WXYZ') "
    "ELSE concat('Q', CAST(c_custkey%1000 AS STRING)) END AS pan",
]

QUERY_LOG = [
    "event_id AS query_id",
    "user_id",
    "CAST(ts AS TIMESTAMP) AS ts",
    "CASE event_type WHEN 'click' THEN 'count' WHEN 'view' THEN 'mean' WHEN 'purchase' THEN 'sum' "
    "WHEN 'signup' THEN 'variance' ELSE 'std' END AS query_type",
    "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 5 ELSE 10 END AS cost_cents",
]

# Budget that makes both acceptance and refusal frequent on the query log.
MAX_CENTS, REFILL_CENTS = 20, 1

MEMBERSHIPS = [
    "user_id",
    "CAST(user_id % 10 AS BIGINT) AS team_id",
    "CASE user_id % 7 WHEN 0 THEN 'admin' WHEN 1 THEN 'viewer' ELSE 'member' END AS role",
    "user_id % 6 <> 0 AS is_active",
    "joined_at",
]
TEAMS = [
    "team_id",
    "concat('Team ', CAST(team_id AS STRING)) AS team_name",
    "CAST(10 + team_id % 3 * 3 AS INT) AS max_members",
    "team_id % 2 = 0 AS shared_budget",
]


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*PEOPLE)


def demographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*DEMOGRAPHIC)


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*QUERY_LOG)


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    users = events.groupBy("user_id").agg({"ts": "min"}).withColumnRenamed("min(ts)", "joined_at")
    return users.selectExpr(*MEMBERSHIPS)


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").selectExpr("CAST(user_id % 10 AS BIGINT) AS team_id").distinct()
    return ids.selectExpr(*TEAMS)


# ------------------------------------------------------------------ SQL blocks
def select_sql(columns: list[str], source: str) -> str:
    return f"SELECT {', '.join(columns)} FROM {source}"


PEOPLE_SQL = f"people AS ({select_sql(PEOPLE, 'customer')})"
DEMOGRAPHIC_SQL = f"demographic AS ({select_sql(DEMOGRAPHIC, 'customer')})"
LOG_SQL = f"log AS ({select_sql(QUERY_LOG, 'events')})"
MEMBERSHIPS_SQL = (
    "memberships AS (" + select_sql(MEMBERSHIPS, "(SELECT user_id, min(ts) AS joined_at FROM events GROUP BY user_id)") + ")"
)
TEAMS_SQL = (
    "teams AS (" + select_sql(TEAMS, "(SELECT DISTINCT CAST(user_id % 10 AS BIGINT) AS team_id FROM events)") + ")"
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def digest_sql(operation: str, column: str, key: str) -> str:
    return f"sha256(concat('{SECRET}|{operation}|{column}|', CAST({key} AS VARCHAR)))"


def hex_sql(hexdigits: str) -> str:
    return f"CAST(concat('0x', {hexdigits}) AS BIGINT)"


def uniform_of_sql(digest: str, slot: int = 0) -> str:
    number = hex_sql(f"substr({digest}, {1 + 13 * slot}, 13)")
    return f"((CAST({number} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))"


def uniform_sql(operation: str, column: str, key: str, slot: int = 0) -> str:
    return uniform_of_sql(digest_sql(operation, column, key), slot)


def pick_sql(options: list, u: str) -> str:
    listed = ", ".join(quoted(o) if isinstance(o, str) else str(o) for o in options)
    return f"([{listed}])[CAST(floor({u} * {len(options)}) AS BIGINT) + 1]"


def laplace_sql(u: str, scale: str) -> str:
    return f"(-({scale}) * sign({u} - 0.5) * ln(1 - 2 * abs({u} - 0.5)))"


def is_currency(name: str) -> bool:
    return any(w in name.lower() for w in K.CURRENCY_WORDS)


def pool_noise_sql(value: str, name: str, key: str) -> str:
    rounded = f"CAST(round_even({value}, 0) AS BIGINT)"
    u = uniform_sql("pool_noise", name, key)
    if is_currency(name):
        return f"({rounded} + {pick_sql(K.CURRENCY_POOL, u)})"
    return f"CASE WHEN {value} < 0 THEN {rounded} ELSE greatest(0, {rounded} + {pick_sql(K.INTEGER_POOL, u)}) END"
