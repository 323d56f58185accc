"""Queries for sources, sinks and streams.

Files are written by Spark from the given tables into a fresh folder below the
shared checkpoint folder and read back with the reader under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import classify, privatize, reports
from ..session import scratch_path
from ..sources import files, tables
from ..streaming import jobs, keyed
from . import budgets
from .base import (
    MAX_CENTS, PEOPLE, PEOPLE_COLUMNS, QUERY_LOG, REFILL_CENTS, SECRET, SQL, people, query, table,
)
from .privacy import _QUESTION, _RELEASED

# ------------------------------------------------------------------ CSV
# odd headers and values: outer blanks, commas, quotes, line ends, missing cells
_AWKWARD = (
    "CASE c_custkey % 4 WHEN 0 THEN concat('  ', c_name, ' ') WHEN 1 THEN concat(c_name, ', \"Jr\"') "
    "WHEN 2 THEN concat('line one\n', c_name) ELSE NULL END"
)


def _awkward(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS `Key `", f"{_AWKWARD} AS `Full Name`", "c_mktsegment AS `a-b`",
        "CAST(c_nationkey AS STRING) AS id",
    )


def _strip_sql(c: str) -> str:
    return f"coalesce(trim({c}, ' \t\n\r'), '')"


@query(
    "scan_csv_clean",
    f"SELECT CAST(c_custkey AS VARCHAR) AS key, {_strip_sql(_AWKWARD)} AS name, c_mktsegment AS segment, "
    "CAST(c_nationkey AS VARCHAR) AS nation FROM customer",
)
def scan_csv_clean(spark, sf):
    """One file, split among tasks although line ends stand inside its quotes."""
    path = scratch_path(spark, "csv")
    files.write_csv(_awkward(spark, sf).coalesce(1), path)
    return files.read_csv(spark, path).toDF("key", "name", "segment", "nation")


@query(
    "sink_csv_roundtrip",
    f"SELECT c_custkey, coalesce({_AWKWARD}, '') AS text, c_acctbal FROM customer",
)
def sink_csv_roundtrip(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey", f"{_AWKWARD} AS text", "c_acctbal")
    path = scratch_path(spark, "csv")
    files.write_csv(rows, path)
    # the plain reader shows what was written, untrimmed
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("c_acctbal").cast("double").alias("c_acctbal"),
    )


@query(
    "load_csv_table",
    f"WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS id FROM customer), o AS (SELECT * FROM c UNION ALL "
    "SELECT * REPLACE (id + (SELECT count(*) FROM customer) AS id) FROM c) "
    f"SELECT id, CAST(c_custkey AS VARCHAR) AS key, {_strip_sql(_AWKWARD)} AS full_name, c_mktsegment AS a_b, "
    "CAST(c_nationkey AS VARCHAR) AS id_1 FROM o",
)
def load_csv_table(spark, sf):
    path = scratch_path(spark, "csv")
    files.write_csv(_awkward(spark, sf), path)
    rows = files.read_csv(spark, path, multiline=True).withColumn("_order", F.col("Key").cast("bigint"))
    target = scratch_path(spark, "table")
    name = files.table_name_for(target)
    # created, then appended to: ids go on
    for _ in range(2):
        loaded = files.load_table(rows, name, ["_order"], path=target)
    return loaded.drop("_order")


# ------------------------------------------------------------------ fixed width
_HOUSEHOLD = [
    "lpad(CAST(c_custkey % 100000 AS STRING), 5, '0')", "'104'", "concat('Q', CAST(1 + c_custkey % 4 AS STRING))",
    "lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0')", "'V1'", "CAST(1 + c_custkey % 2 AS STRING)",
    "lpad(CAST(c_nationkey AS STRING), 2, '0')", "rpad(CAST(c_custkey % 90 AS STRING), 2, ' ')",
]
_LINE = (
    "CASE c_custkey % 5 WHEN 0 THEN concat(rpad(concat(" + ", ".join(_HOUSEHOLD) + "), 49, ' '), "
    "lpad(CAST(1 + c_custkey % 9 AS STRING), 2, ' '), '1', 'é', '3', lpad(CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS STRING), 10, ' ')) "
    "WHEN 1 THEN concat(" + ", ".join(_HOUSEHOLD[:3]) + ") WHEN 2 THEN '' ELSE concat("
    + ", ".join(_HOUSEHOLD) + ", ' a b') END"
)


def _cut_sql(layout) -> str:
    return ", ".join(f"trim(substr(v, {f.start}, {f.end - f.start + 1})) AS {f.name}" for f in layout)


def _write_latin1(lines: DataFrame, path: str) -> None:
    """Append lines as Latin-1 bytes, as survey files come."""
    lines.select(F.encode("v", "ISO-8859-1").cast("string").alias("v")).write.mode("append").text(path)


_DAY_TEXT = "lpad(CAST((o_orderkey * 31 + o_custkey * {d}) % 100 AS STRING), 2, '0')"
_BLOCK = (
    "concat(" + _DAY_TEXT + ", '7', '1', '08', lpad(CAST(o_custkey % 900 * {d} AS STRING), 5, ' '), "
    "'  ', '  ', '  ', '     ', '08', '00')"
)


def _person_line() -> str:
    head = "rpad(concat('P', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'), substring(o_orderpriority, 1, 1)), 56, ' ')"
    blocks = ", ".join(_BLOCK.replace("{d}", str(d)) for d in range(1, 8))
    return f"concat({head}, {blocks}, lpad(CAST(o_custkey AS STRING), 29, '0'))"


@query(
    "scan_fixed_width",
    f"WITH h AS (SELECT {_LINE} AS v FROM customer), p AS (SELECT {_person_line()} AS v FROM orders) "
    f"SELECT {_cut_sql(files.household_layout())} FROM h WHERE v <> '' UNION ALL BY NAME "
    f"SELECT {_cut_sql(files.person_layout())} FROM p",
)
def scan_fixed_width(spark, sf):
    """One folder with files of both layouts."""
    path = scratch_path(spark, "fixed")
    _write_latin1(table(spark, sf, "customer").selectExpr(f"{_LINE} AS v"), path)
    _write_latin1(table(spark, sf, "orders").selectExpr(f"{_person_line()} AS v"), path)
    return files.read_fixed_width(spark, path)


@query(
    "fwf_unpivot_days",
    f"WITH l AS (SELECT {_person_line()} AS v FROM orders), d AS (SELECT unnest(range(1, 8)) AS n) "
    "SELECT trim(substr(v, 1, 5)) AS FILE_ID, trim(substr(v, 6, 3)) AS SCHEDULE, CAST(8 - n AS INT) AS day, "
    "trim(substr(v, 57 + (n - 1) * 26, 2)) AS das1, trim(substr(v, 57 + (n - 1) * 26 + 6, 5)) AS ern1, "
    "trim(substr(v, 57 + (n - 1) * 26 + 11, 2)) AS das2, trim(substr(v, 57 + (n - 1) * 26 + 22, 2)) AS hr FROM l, d",
)
def fwf_unpivot_days(spark, sf):
    path = scratch_path(spark, "fixed")
    table(spark, sf, "orders").selectExpr(f"{_person_line()} AS v").write.text(path)
    persons = files.read_fixed_width(spark, path)  # layout found by line length
    days = files.unpivot_days(persons, ["FILE_ID", "SCHEDULE"])
    return days.select("FILE_ID", "SCHEDULE", "day", "das1", "ern1", "das2", "hr")


_WIDTHS = [("customer id", 8), ("full name", 22), ("salary", 12), ("segment", 10)]
_WIDE_LINE = (
    "concat(lpad(CAST(c_custkey AS STRING), 8, ' '), rpad(c_name, 22, ' '), lpad(CAST(c_acctbal AS STRING), 12, ' '), "
    "c_mktsegment)"
)


@query(
    "scan_fwf_widths",
    "SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS full_name, CAST(c_acctbal AS VARCHAR) AS salary, "
    "c_mktsegment AS segment, 'hash hash noise none' AS treatments FROM customer",
)
def scan_fwf_widths(spark, sf):
    path, layout_path = scratch_path(spark, "fixed"), scratch_path(spark, "layout")
    table(spark, sf, "customer").selectExpr(f"{_WIDE_LINE} AS v").write.text(path)
    described = [*((n, str(w)) for n, w in _WIDTHS), ("bad row", "wide"), ("", "3")]
    files.write_csv(spark.createDataFrame(described, "`Field name` string, `Length` string").coalesce(1), layout_path)
    layout = files.read_layout(spark, layout_path)
    rows = files.read_fixed_width(spark, path, layout, encoding="UTF-8")
    names = spark.createDataFrame([(i, f.name) for i, f in enumerate(layout)], "i int, name string")
    chosen = classify.layout_defaults(names).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "treatment"))), lambda s: s["treatment"]), " ").alias("t")
    )
    return rows.toDF(*parse.safe_names(rows.columns)).withColumn("treatments", chosen.scalar())


# ------------------------------------------------------------------ tables
@query(
    "scan_table_capped",
    "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END, '') AS priority "
    "FROM orders ORDER BY o_orderkey LIMIT 500",
)
def scan_table_capped(spark, sf):
    # the cap of 500 rows is the operator's feature
    table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority"
    ).createOrReplaceTempView("order_priorities")
    return tables.scan_table(spark, "order_priorities", cap=500, order_by=["o_orderkey"])


@query(
    "sink_anonymized_json",
    _RELEASED + f"SELECT 'people' AS source_table, {', '.join(PEOPLE_COLUMNS)} FROM released",
)
def sink_anonymized_json(spark, sf):
    released, _ = privatize.privatize(people(spark, sf), SECRET, "id")
    path = scratch_path(spark, "records")
    tables.write_records(released, "people", path)
    stored = spark.read.parquet(path)
    document = F.from_json("data", released.schema)
    return stored.select("source_table", document.alias("d")).select("source_table", "d.*")


@query("audit_export", budgets.fold_sql() + budgets._TRANSACTIONS + f" SELECT {budgets._AUDIT} FROM t")
def audit_export(spark, sf):
    entries = reports.audit_entries(budgets._ledgers(spark, sf)[1])
    path = scratch_path(spark, "audit")
    tables.write_audit_log(entries, path, "csv")
    back = spark.read.option("header", True).option("escape", '"').schema(
        "user_id bigint, timestamp timestamp, query_id bigint, query_type string, epsilon_cost double, "
        "epsilon_remaining double, mechanism string, mathematical_output string"
    ).csv(path)
    details = F.from_json(
        "mathematical_output",
        "effective_epsilon double, noise_distribution string, degradation_applied string",
    )
    return budgets._flat_audit(back.withColumn("mathematical_output", details))


@query(
    "audit_events_daily",
    "SELECT strftime(ts, '%Y-%m-%d') AS dt, event_type, user_id, epoch_us(ts) AS at_us, "
    "CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def audit_events_daily(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"), "event_type", F.col("user_id").cast("string").alias("user_id"),
        F.from_json("props", "k bigint").alias("details"),
    )
    path = scratch_path(spark, "events")
    tables.write_audit_events(events, path)
    back = spark.read.schema(
        "timestamp timestamp, event_type string, user_id string, details struct<k: bigint>, dt date"
    ).json(path)
    return back.select(
        F.date_format("dt", "yyyy-MM-dd").alias("dt"), "event_type", F.col("user_id").cast("bigint").alias("user_id"),
        F.unix_micros("timestamp").alias("at_us"), F.col("details.k").alias("k"),
    )


# ------------------------------------------------------------------ streams
def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _finish(running):
    running.awaitTermination()


@query(
    "ledger_stream",
    budgets.fold_sql() + " " + budgets._DECISIONS,
)
def ledger_stream(spark, sf):
    path = scratch_path(spark, "ledger-stream")
    log = _event_stream(spark, sf).selectExpr(*QUERY_LOG)
    _finish(jobs.ledger_stream(log, path, f"{path}/checkpoint", max_cents=MAX_CENTS, refill_cents=REFILL_CENTS))
    return budgets._decided(jobs.read_decisions(spark, path))


@query(
    "privatize_stream",
    # status needs the whole column and is generalized in the stream
    _RELEASED + "SELECT id, full_name, email, phone, age, salary, '[CATEGORY]' AS status, pincode, gps FROM released",
)
def privatize_stream(spark, sf):
    rows = people(spark, sf)
    plan = privatize.plan_privacy(rows)
    customers = table(spark, sf, "customer")
    incoming = (
        spark.readStream.schema(customers.schema).option("pathGlobFilter", "customer.parquet").parquet(sf).selectExpr(*PEOPLE)
    )
    released = jobs.privatize_stream(incoming, plan, SECRET, "id")
    path = scratch_path(spark, "privatize-stream")
    _finish(jobs.append_to(released, f"{path}/rows", f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/rows")


@query(
    "audit_window_counts",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def audit_window_counts(spark, sf):
    counts = jobs.window_counts(_event_stream(spark, sf), "ts", "event_type")
    path = scratch_path(spark, "window-stream")
    _finish(jobs.keep_result(counts, f"{path}/rows", f"{path}/checkpoint"))
    found = jobs.latest_result(spark, f"{path}/rows")
    return found.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(
    "audit_window_totals",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def audit_window_totals(spark, sf):
    """The same windows over the table at rest."""
    events = table(spark, sf, "events")
    counts = jobs.window_counts(events, "ts", "event_type")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


# ------------------------------------------------------------------ keyed streams
def _in_slices(spark, sf, start) -> None:
    """Run a stream over the events of each third of the time, one after the other, from one checkpoint."""
    folder = scratch_path(spark, "event-slices")
    events = table(spark, sf, "events")
    low, high = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    third = ((high or 0) - (low or 0)) // 3 + 1
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(low or 0)) / F.lit(third))
    for k in range(3):
        events.where(part == k).write.mode("append").parquet(folder)
        _finish(start(spark.readStream.schema(events.schema).parquet(folder)))


@query("ledger_stream_keyed", budgets.fold_sql() + " " + budgets._DECISIONS)
def ledger_stream_keyed(spark, sf):
    path = scratch_path(spark, "ledger-keyed")

    def start(events):
        log = events.selectExpr(*QUERY_LOG)
        return keyed.ledger_stream_keyed(log, f"{path}/rows", f"{path}/checkpoint", max_cents=MAX_CENTS, refill_cents=REFILL_CENTS)

    _in_slices(spark, sf, start)
    return budgets._decided(keyed.read_keyed(spark, f"{path}/rows"))


@query("similar_queries_stream", SQL["similar_queries"])
def similar_queries_stream(spark, sf):
    path = scratch_path(spark, "similar-keyed")

    def start(events):
        log = events.selectExpr(*QUERY_LOG).selectExpr(*_QUESTION)
        return keyed.similar_queries_stream(log, f"{path}/rows", f"{path}/checkpoint")

    _in_slices(spark, sf, start)
    return keyed.read_similar(spark, f"{path}/rows")
