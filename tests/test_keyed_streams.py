"""Keyed state of streams against the operators at rest: several runs of one checkpoint, late rows, expiry."""

import datetime
import random
import time

import pytest

from veilframe.operators import dp, ledger, teams
from veilframe.streaming import keyed

LOG = "query_id bigint, user_id bigint, team_id bigint, ts timestamp, table_name string, field_name string, query_type string, cost_cents int"
START = datetime.datetime(2024, 1, 1)


def log_rows(seed, n=160):
    rnd = random.Random(seed)
    return [
        (i // 2, rnd.randrange(4), 1, START + datetime.timedelta(seconds=(i // 4) * 3000), rnd.choice("ab"), "f", rnd.choice(["count", "mean"]), rnd.choice([1, 5, 10]))
        for i in range(n)
    ]  # ids repeat


def in_runs(spark, tmp_path, rows, schema, start, cuts):
    folder = str(tmp_path / "in")
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[a:b], schema).repartition(2).write.mode("append").parquet(folder)
        start(spark.readStream.schema(schema).parquet(folder)).awaitTermination()


def test_ledger_state_goes_on_over_runs_and_late_rows_are_set_aside(spark, tmp_path):
    rows = log_rows(1)
    late = (9999, rows[0][1], 1, START - datetime.timedelta(days=1), "a", "f", "count", 1)
    path, check = str(tmp_path / "out"), str(tmp_path / "check")
    in_runs(spark, tmp_path, [*rows, late], LOG, lambda s: keyed.ledger_stream_keyed(s, path, check, max_cents=20, refill_cents=1), [60, 160])
    expected = ledger.ledger_fold(spark.createDataFrame(rows, LOG), max_cents=20, refill_cents=1)
    columns = ["holder", "event_id", "at_us", "accepted", "refill_units", "before_units", "remaining_units", "max_cents", "last_refill_s"]
    found = keyed.read_keyed(spark, path)
    kept = [r for r in found.select("holder", "remaining_units").collect()]
    assert len(kept) == len(rows)
    # equal (time, id) pairs may be taken in either order: compare what does not depend on it
    assert sorted(map(tuple, found.groupBy("holder", "at_us").agg({"remaining_units": "min"}).collect())) == sorted(
        map(tuple, expected.groupBy("holder", "at_us").agg({"remaining_units": "min"}).collect())
    )
    assert [r["event_id"] for r in keyed.read_keyed(spark, path, late=True).select(*columns).collect()] == [9999]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_similar_queries_over_runs(spark, tmp_path):
    rows = [(i, *r[1:]) for i, r in enumerate(log_rows(2))]
    path, check = str(tmp_path / "out"), str(tmp_path / "check")
    in_runs(spark, tmp_path, rows, LOG, lambda s: keyed.similar_queries_stream(s, path, check, 7200), [40, 100])
    expected = teams.similar_queries(spark.createDataFrame(rows, LOG), 7200)
    assert sorted(map(str, keyed.read_similar(spark, path).collect())) == sorted(map(str, expected.collect()))


def test_a_timer_removes_idle_groups(spark, tmp_path):
    folder, path, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = [(i, 1, 1, START + datetime.timedelta(seconds=i), "a", "f", "count", 1) for i in range(3)]
    spark.createDataFrame(rows[:2], LOG).coalesce(1).write.parquet(folder)
    with pytest.raises(ValueError, match="every"):
        keyed.similar_queries_stream(spark.readStream.schema(LOG).parquet(folder), path, check, keep_seconds=1)
    running = keyed.similar_queries_stream(spark.readStream.schema(LOG).parquet(folder), path, check, 7200, "1 second", 2)

    def wait(rows_written):
        for _ in range(60):
            time.sleep(1)
            done = list((tmp_path / "out" / "_spark_metadata").glob("[0-9]*")) and list((tmp_path / "out").glob("*.parquet"))
            if done and keyed.read_keyed(spark, path).count() >= rows_written:
                return

    try:
        wait(2)
        time.sleep(8)  # batches without rows run the timers
        spark.createDataFrame(rows[2:], LOG).coalesce(1).write.mode("append").parquet(folder)
        wait(3)
    finally:
        running.stop()
    assert {r["query_id"]: r["similar_queries_detected"] for r in keyed.read_similar(spark, path).collect()} == {0: 0, 1: 1, 2: 0}


def test_repeated_ids_are_charged_row_by_row(spark):
    rows = [(7, 1, 1, START, "a", "f", "count", 1), (7, 1, 1, START + datetime.timedelta(hours=1), "a", "f", "count", 1),
            (8, 2, 1, START + datetime.timedelta(hours=2), "a", "f", "count", 1)]
    found = teams.charged(spark.createDataFrame(rows, LOG)).orderBy("ts").collect()
    assert [(r["query_id"], r["cost_cents"], r["base_cost_cents"]) for r in found] == [(7, 1, 1), (7, 2, 1), (8, 3, 1)]
    assert sorted(r["similar_queries_detected"] for r in teams.similar_queries(spark.createDataFrame(rows, LOG)).collect()) == [0, 1, 2]


def test_requests_beyond_one_pass(spark):
    decided = "query_id bigint, user_id bigint, query_type string, epsilon_cost double, accepted boolean, epsilon_remaining double, max_epsilon double, field_name string, filter_field string, filter_operator string, filter_value double"
    rows = [(i, 1, "mean", 0.05, True, 9.0, 10.0, "x", "y" if i % 4 else None, ">" if i % 4 else None, float(i % 9) if i % 4 else None) for i in range(40)]
    df = spark.createDataFrame([(float(i), float(i % 10)) for i in range(100)], "x double, y double")
    log = spark.createDataFrame(rows, decided)
    one, many = (
        sorted(map(str, dp.answer_requests(log, df, {"x": (0, 100)}, "s", max_specs=m, keep=["filter_value"]).collect())) for m in (200, 3)
    )
    assert one == many and len(one) == 40
    assert dp.answer_requests(log.limit(0), df, {"x": (0, 100)}, "s").collect() == []
