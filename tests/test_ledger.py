"""The distributed fold against a plain loop, with one holder spread over many partitions."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.operators import ledger

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def micros(t):
    return round((t - EPOCH) / timedelta(microseconds=1))


def loop(rows, rule, default_max, rate, opening=None):
    """rows: (holder, micros, kind, id, cents) in any order."""
    unit = ledger.UNITS_PER_CENT[rule]
    state, out = {}, {}
    for holder, (max_cents, units, last) in (opening or {}).items():
        state[holder] = {"max": max_cents, "units": units, "last": last}
    for holder, at_us, kind, event, cents in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        at = at_us // 1_000_000
        s = state.setdefault(holder, {"max": default_max, "units": default_max * unit, "last": at})
        top = s["max"] * unit
        if kind == ledger.RESET:
            s.update(max=cents, units=cents * unit, last=at)
            continue
        if rule == "hourly":
            if at - s["last"] >= 3600:
                s["units"] = min(top, s["units"] + rate * ((at - s["last"]) // 3600))
                s["last"] = at
        elif cents <= s["max"] and at - s["last"] >= 3600:
            amount = min(s["max"] * (at - s["last"]), top - s["units"])
            if amount > 0:  # the clock stays while the ledger is full
                s["units"] += amount
                s["last"] = at
        accepted = s["units"] >= cents * unit
        if accepted:
            s["units"] -= cents * unit
        out[event] = (accepted, s["units"])
    return out, {h: (s["max"], s["units"], s["last"]) for h, s in state.items()}


def make_rows(seed, n, dense, with_resets, hot_share=0.7):
    rng = random.Random(seed)
    rows, t = [], {h: START for h in range(6)}
    for i in range(n):
        holder = 0 if rng.random() < hot_share else rng.randrange(1, 6)
        gap = rng.choice([0, 1, 30, 900, 1800]) if dense else rng.choice([60, 3599, 3600, 3601, 9000, 40000, 400000])
        t[holder] += timedelta(seconds=gap, microseconds=rng.randrange(1_000_000))
        if with_resets and rng.random() < 0.004:
            rows.append((holder, micros(t[holder]), ledger.RESET, i, rng.choice([15, 20, 30])))
        else:
            rows.append((holder, micros(t[holder]), ledger.QUERY, i, rng.choice([1, 5, 10, 10, 12])))
    return rows


def frames(spark, rows):
    schema = "user_id bigint, us bigint, kind int, query_id bigint, cents bigint"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("us"))
    queries = df.where(F.col("kind") == ledger.QUERY).select(
        "user_id", "query_id", "ts", F.lit("count").alias("query_type"), F.col("cents").alias("cost_cents")
    )
    resets = df.where(F.col("kind") == ledger.RESET).select(
        "user_id", F.col("query_id").alias("reset_id"), "ts", F.col("cents").alias("max_cents")
    )
    return queries, resets


@pytest.mark.parametrize("rule", ["hourly", "fractional"])
@pytest.mark.parametrize("dense,with_resets", [(True, False), (False, False), (True, True), (False, True)])
def test_fold_equals_loop(many_partitions, rule, dense, with_resets):
    rows = make_rows(7, 3000, dense, with_resets)
    queries, resets = frames(many_partitions, rows)
    folded = ledger.ledger_fold(queries, rule=rule, max_cents=20, refill_cents=1, resets=resets)
    got = {
        r["event_id"]: (r["accepted"], r["remaining_units"])
        for r in folded.where(F.col("kind") == ledger.QUERY).collect()
    }
    expected, closing = loop(rows, rule, 20, 1)
    assert got == expected
    accepted = sum(a for a, _ in expected.values())
    assert 0 < accepted < len(expected)
    final = {r["holder"]: (r["max_cents"], r["remaining_units"], r["last_refill_s"]) for r in ledger.ledgers(folded).collect()}
    assert final == closing


def test_hot_holder_really_spans_partitions(many_partitions):
    from veilframe.operators.ordering import in_global_order

    queries, _ = frames(many_partitions, make_rows(7, 3000, True, False))
    placed = in_global_order(ledger.normalize(queries, "user_id"), ["holder", "at_us", "kind", "event_id"])
    assert placed.where("holder = 0").select("_part").distinct().count() > 5
    assert len(ledger._opening_states(placed, "hourly", 20, 1)) > 5


@pytest.mark.parametrize("rule", ["hourly", "fractional"])
def test_opening_ledgers_continue_a_fold(many_partitions, rule):
    rows = sorted(make_rows(3, 2000, False, False), key=lambda r: r[1])
    head, tail = rows[:900], rows[900:]
    whole, _ = loop(rows, rule, 20, 1)
    first = ledger.ledger_fold(frames(many_partitions, head)[0], rule=rule, max_cents=20, refill_cents=1)
    second = ledger.ledger_fold(
        frames(many_partitions, tail)[0], rule=rule, max_cents=20, refill_cents=1, opening=ledger.ledgers(first)
    )
    got = {
        r["event_id"]: (r["accepted"], r["remaining_units"])
        for part in (first, second)
        for r in part.where(F.col("kind") == ledger.QUERY).collect()
    }
    assert got == whole


def test_packed_tables_return_every_entry():
    rng = np.random.default_rng(5)
    for table in (
        np.arange(500) * 1 - 3,
        np.repeat(rng.integers(0, 9, 50), 10),
        rng.integers(-5, 5, 300),
    ):
        packed = ledger._pack(table)
        assert [ledger._look_up(packed, i) for i in range(table.size)] == table.tolist()


def test_cost_must_be_positive(spark):
    queries, _ = frames(spark, [(1, micros(START), ledger.QUERY, 1, 0)])
    with pytest.raises(Exception, match="positive"):
        ledger.ledger_fold(queries).collect()


def test_refill_log_balances(spark):
    rows = make_rows(11, 400, False, True)
    queries, resets = frames(spark, rows)
    folded = ledger.ledger_fold(queries, max_cents=20, refill_cents=1, resets=resets)
    log = ledger.refills(folded)
    assert log.where("abs(epsilon_before + refill_amount - epsilon_after) > 1e-9").count() == 0
    assert log.where("refill_type = 'ADMIN'").count() == sum(r[2] == ledger.RESET for r in rows)


def test_queries_in_streamed_batches_equal_one_batch(spark, tmp_path):
    from veilframe.streaming import jobs

    rows = sorted(make_rows(17, 600, False, False), key=lambda r: r[1])
    source = str(tmp_path / "in")
    for part in range(3):  # three files, one per micro-batch, in time order
        piece = rows[part * 200 : (part + 1) * 200]
        frames(spark, piece)[0].coalesce(1).write.mode("append").parquet(f"{source}/p{part}")
    schema = frames(spark, rows[:1])[0].schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    out = str(tmp_path / "out")
    jobs.ledger_stream(stream, out, f"{out}/checkpoint", max_cents=20, refill_cents=1).awaitTermination()
    got = {r["event_id"]: (r["accepted"], r["remaining_units"]) for r in jobs.read_decisions(spark, out).collect()}
    assert got == loop(rows, "hourly", 20, 1)[0]


def test_late_queries_of_a_stream_are_set_aside(spark, tmp_path):
    from veilframe.streaming import jobs

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [[(1, 10, 100, 1), (2, 11, 100, 1)], [(1, 12, 50, 1), (1, 13, 200, 1), (2, 14, 100, 1)], [(1, 15, 150, 1)]]
    for k, rows in enumerate(parts):
        small_log(spark, rows).coalesce(1).write.parquet(f"{source}/part={k}")
    schema = spark.read.parquet(f"{source}/part=0").schema
    jobs.ledger_stream(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*"),
        out, f"{out}/checkpoint", max_cents=20, refill_cents=1,
    ).awaitTermination()
    decided = {r.event_id for r in jobs.read_decisions(spark, out).collect()}
    late = {r.query_id for r in spark.read.parquet(f"{out}/late").collect()}
    assert decided | late == {10, 11, 12, 13, 14, 15} and not decided & late
    assert late == {12, 15}


def small_log(spark, rows):
    found = spark.createDataFrame(rows, "user_id bigint, query_id bigint, at_s bigint, cost_cents bigint")
    return found.select("user_id", "query_id", F.timestamp_seconds("at_s").alias("ts"), F.lit("count").alias("query_type"), "cost_cents")


def test_ids_beyond_double_precision_stay_exact(spark):
    big = 2**53
    rows = [(big + 1, big + 7, 0, 10), (big + 2, big + 9, 0, 10), (big + 1, None, 1, 10), (big + 2, big + 11, 1, 10)]
    folded = ledger.ledger_fold(small_log(spark, rows), max_cents=15)
    found = {(r["holder"], r["event_id"], r["accepted"]) for r in folded.collect()}
    assert found == {(big + 1, big + 7, True), (big + 2, big + 9, True), (big + 1, None, False), (big + 2, big + 11, False)}


def test_unknown_holders_are_refused(spark):
    rows = [(None, 1, 0, 1), (5, 2, 0, 1)]
    with pytest.raises(Exception, match="user_id must not be null"):
        ledger.ledger_fold(small_log(spark, rows)).collect()


@pytest.mark.parametrize("seed", range(4))
def test_pieces_equal_all_balances(seed):
    rng = random.Random(seed)
    top = 1001
    pieces, plain = ledger._Pieces(top), np.arange(top + 1)
    for _ in range(60):
        if rng.random() < 0.4:
            units = rng.choice([0, 3, 7, 90, top - 1, top, top + 5] if rng.random() < 0.1 else [1, 3, 11])
            pieces.refill(units)
            plain = np.minimum(plain + units, top)
        else:
            cost = rng.choice([1, 5, 10, 250, 997])
            pieces.spend(cost)
            plain = np.where(plain >= cost, plain - cost, plain)
        packed = pieces.pack()
        assert [ledger._Pieces.closing(packed, i) for i in range(top + 1)] == plain.tolist()


def test_odd_maximum_of_a_dominant_holder(many_partitions):
    rng = random.Random(5)
    rows, at = [], 0
    for i in range(6000):
        at += rng.choice([1, 60, 1800, 3600, 7000])
        rows.append((0, at * 1_000_000, ledger.QUERY, i, rng.choice([1, 5, 10, 250])))
    queries, _ = frames(many_partitions, rows)
    folded = ledger.ledger_fold(queries, rule="fractional", max_cents=1001)
    found = {r["event_id"]: (r["accepted"], r["remaining_units"]) for r in folded.collect()}
    assert found == loop(rows, "fractional", 1001, 1)[0]
