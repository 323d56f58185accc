"""Budget ledgers and similar-query counts as keyed state of a stream.

``jobs.ledger_stream`` folds every micro-batch as a distributed batch job and rewrites all ledgers.
Here a holder's ledger, or a group's recent queries, is a value in the state store: a batch reads
and writes the state of the keys it holds, and with change logs the bytes written follow the batch, not
the number of users. State and output commit together, so a replayed batch decides the same.

A key's rows of one batch meet in one task, which is what keyed state means; rows per
trigger bound them. A stream in which one holder has most rows of every batch is
better served by ``jobs.ledger_stream``, which spreads them.

Rows that come after later ones of their key are set aside with ``late`` true and undecided, never
dropped; there is no watermark.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import constants as K
from ..operators import ledger, teams

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
SECOND = 1_000_000
BUCKET_SECONDS = 3600


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """Store settings for queries started inside; a running query keeps those it was started with."""
    before = {key: spark.conf.get(key, None) for key in STORE}
    try:
        for key, value in STORE.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _write(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    trigger = {"processingTime": every} if every else {"availableNow": True}
    with keyed_store(rows.sparkSession):
        return (
            rows.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(**trigger)
            .start()
        )


# ------------------------------------------------------------------ ledgers
class LedgerProcessor(StatefulProcessor):
    """One holder's ledger: decides the queries and resets of a batch in time order."""

    def __init__(self, rule: str, default_max: int, rate: int, id_type: str):
        self.rule, self.default_max, self.rate, self.id_type = rule, default_max, rate, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "ledger", f"last_s bigint, fresh boolean, max_cents bigint, units bigint, at_us bigint, kind int, event_id {self.id_type}"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fold = ledger._Fold(self.rule, self.default_max, self.rate)
        kept = self.state.get() if self.state.exists() else None
        order = itemgetter("at_us", "kind", "event_id")
        seen = None
        if kept is not None:
            fold.restore(*kept[:4])
            seen = tuple(kept[4:])
        for row in sorted(rows, key=order):
            values = row.asDict()
            if seen is not None and order(row) < seen:
                yield Row(**values, accepted=None, refill_units=None, before_units=None, remaining_units=None,
                          max_cents=None, last_refill_s=None, late=True)
                continue
            if seen is None:
                fold.create(row.at_s)
            if row.kind == ledger.QUERY:
                accepted, refill, before = fold.query(row.at_s, row.cents)
            else:
                before = fold.units if row.kind == ledger.RESET else row.set_units
                fold.set(row.at_s, row.cents, row.set_units)
                accepted, refill = None, row.set_units - before
            seen = order(row)
            yield Row(**values, accepted=accepted, refill_units=refill, before_units=before, remaining_units=fold.units,
                      max_cents=fold.max, last_refill_s=fold.last, late=False)
            kept = (fold.last, fold.fresh, fold.max, fold.units, *seen)
        if kept is not None:
            self.state.update(tuple(kept))

    def close(self) -> None:
        pass


def ledger_stream_keyed(
    queries: DataFrame,
    path: str,
    checkpoint: str,
    holder: str = "user_id",
    rule: str = "hourly",
    max_cents: int = K.DEFAULT_BUDGET_CENTS,
    refill_cents: int = K.HOURLY_REFILL_CENTS,
    resets: DataFrame | None = None,
) -> StreamingQuery:
    """Budget decisions on a stream of queries, and of admin resets; ``read_keyed`` reads them.

    Equals the fold of all rows at rest, as long as no row comes late.
    """
    if rule not in ledger.UNITS_PER_CENT:
        raise ValueError(f"rule is one of {list(ledger.UNITS_PER_CENT)}")
    events = ledger.normalize(queries, holder, resets, rule=rule)
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    decided = events.groupBy("holder").transformWithState(
        LedgerProcessor(rule, max_cents, refill_cents, dict(events.dtypes)["event_id"]), f"{schema}, {ledger._FOLD_COLUMNS}, late boolean", "append", "none"
    )
    return _write(decided, path, checkpoint)


def read_keyed(spark: SparkSession, path: str, late: bool = False) -> DataFrame:
    """The rows a keyed stream has written: those in order, or those set aside as late."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("late") == late).drop("late")


# ------------------------------------------------------------------ similar queries
class SimilarProcessor(StatefulProcessor):
    """The recent queries of one group of like queries, counted by time bucket.

    Per bucket of an hour the state holds the number of queries, the number of each user, and the
    moments in order. A window covers whole buckets, whose numbers are added, and part of its first,
    whose moments are looked up; earlier buckets go. With ``keep_seconds`` a timer removes what a group
    without new queries leaves.
    """

    def __init__(self, window_seconds: int, keep_seconds: int | None, id_type: str):
        self.window, self.keep_seconds, self.id_type = window_seconds * SECOND, keep_seconds, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getMapState("totals", "bucket bigint", "n bigint, users array<string>, counts array<bigint>")
        self.moments = handle.getMapState("moments", "bucket bigint", "at_us array<bigint>, users array<string>")
        self.seen = handle.getValueState("seen", f"at_us bigint, query_id {self.id_type}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        width = BUCKET_SECONDS * SECOND
        order = itemgetter("at", "query_id")
        seen = tuple(self.seen.get()) if self.seen.exists() else None
        numbers = {b[0]: (v[0], dict(zip(v[1], v[2]))) for b, v in self.totals.iterator()}
        loaded: dict[int, tuple[list[int], list[str]]] = {}
        touched = set()

        def moments(bucket: int) -> tuple[list[int], list[str]]:
            if bucket not in loaded:
                known = bucket in numbers and self.moments.containsKey((bucket,))
                value = self.moments.getValue((bucket,)) if known else ([], [])
                loaded[bucket] = (list(value[0]), list(value[1]))
            return loaded[bucket]

        last = None
        for row in sorted(rows, key=order):
            values = {n: row[n] for n in ("query_id", "user_id", "team_id")}
            if seen is not None and order(row) < seen:
                yield Row(**values, similar=None, own=None, late=True)
                continue
            start, user = row.at - self.window, str(row.user_id)
            border = start // width
            similar = own = 0
            for bucket, (n, users) in numbers.items():
                if bucket > border:
                    similar += n
                    own += users.get(user, 0)
            if border in numbers:
                at, by = moments(border)
                first = bisect_left(at, start)
                similar += len(at) - first
                own += sum(u == user for u in by[first:])
            bucket = row.at // width
            at, by = moments(bucket)
            at.append(row.at)
            by.append(user)
            n, users = numbers.get(bucket, (0, {}))
            users[user] = users.get(user, 0) + 1
            numbers[bucket] = (n + 1, users)
            touched.add(bucket)
            last = order(row)
            yield Row(**values, similar=similar, own=own, late=False)
        if last is None:
            return
        self.seen.update(last)
        oldest = (last[0] - self.window) // width
        for bucket in [b for b in numbers if b < oldest]:
            touched.discard(bucket)
            if self.totals.containsKey((bucket,)):
                self.totals.removeKey((bucket,))
                self.moments.removeKey((bucket,))
        for bucket in touched:
            n, users = numbers[bucket]
            self.totals.updateValue((bucket,), (n, list(users), list(users.values())))
            self.moments.updateValue((bucket,), loaded[bucket])
        if self.keep_seconds is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_seconds * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.totals.clear()
        self.moments.clear()
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def similar_queries_stream(
    log: DataFrame,
    path: str,
    checkpoint: str,
    window_seconds: int = K.SIMILAR_WINDOW_SECONDS,
    every: str | None = None,
    keep_seconds: int | None = None,
) -> StreamingQuery:
    """``teams.similar_queries`` on a stream; ``read_similar`` reads the result.

    Without ``every`` all that is there is taken, then the stream stops; a group keeps the queries of its
    last window. With ``every``, a trigger interval, the stream goes on, and a group's state goes ``keep_seconds`` by the
    clock after its last batch (twice the window by default), so the stream may be behind by the difference to
    the window before counts are lost. A timer would keep a stream that stops by itself from stopping.
    """
    if every is None and keep_seconds is not None:
        raise ValueError("keep_seconds needs a stream that goes on: give every")
    if every is not None and keep_seconds is None:
        keep_seconds = 2 * window_seconds
    base = log.select(
        "query_id", "user_id", "team_id",
        teams.fingerprint("team_id", "table_name", "field_name", "query_type").alias("print"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
    )
    types = dict(base.dtypes)
    schema = ", ".join(f"{n} {types[n]}" for n in ("query_id", "user_id", "team_id"))
    processor = SimilarProcessor(window_seconds, keep_seconds, types["query_id"])
    counted = base.groupBy("print").transformWithState(
        processor, f"{schema}, similar bigint, own bigint, late boolean", "append", "processingTime" if every else "none"
    )
    return _write(counted, path, checkpoint, every)


def read_similar(spark: SparkSession, path: str) -> DataFrame:
    """Counts and cost factors of the queries that came in order."""
    return read_keyed(spark, path).select("query_id", "user_id", "team_id", *teams.factors("similar", "own"))
