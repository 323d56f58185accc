"""Streaming forms: privatized rows, budget ledger, audit counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..operators import ledger
from ..operators.privatize import PrivacyPlan, value_expression
from ..session import materialize


def privatize_stream(rows: DataFrame, plan: PrivacyPlan, secret: str, key: str) -> DataFrame:
    """Apply a plan's per-value treatments to a stream; stateless.

    Columns that need the whole column (k-anonymity) cannot be decided row by
    row; they are generalized to ``[CATEGORY]`` instead.
    """
    types = dict(rows.dtypes)
    planned = {c.column: c for c in plan.columns}
    out = []
    for name in rows.columns:
        if name not in planned:  # what no plan covers is not released
            continue
        expression = value_expression(planned[name], types[name], secret, key)
        if expression is None:
            expression = F.when(F.col(f"`{name}`").isNotNull(), F.lit("[CATEGORY]"))
        out.append(expression.alias(name))
    return rows.select(*out)


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to parquet, taking everything available, then stop."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def keep_result(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream's whole result after every batch, each to a folder of its own; ``latest_result`` reads the last."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        df.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )


def latest_result(spark: SparkSession, path: str) -> DataFrame:
    """The result written by the last finished batch of ``keep_result``."""
    batches = spark.read.parquet(path)
    last = batches.agg(F.max("batch").alias("b")).first()["b"]
    return batches.where(F.col("batch") == last).drop("batch")


def window_counts(events: DataFrame, ts: str, kind: str, window: str = "1 day") -> DataFrame:
    """Events per rotation window and type.

    No event is too late: the state is one number per window and type, small enough to
    be kept for good, so there is no watermark to drop rows behind.
    """
    moments = events.withColumn("_at", F.col(ts).cast("timestamp"))
    counts = moments.groupBy(F.window("_at", window), F.col(kind)).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), kind, "n")


def ledger_stream(
    queries: DataFrame,
    path: str,
    checkpoint: str,
    holder: str = "user_id",
    rule: str = "hourly",
    max_cents: int = K.DEFAULT_BUDGET_CENTS,
    refill_cents: int = K.HOURLY_REFILL_CENTS,
) -> StreamingQuery:
    """Budget decisions on a stream of queries.

    Every micro-batch goes through the same distributed fold as a batch job,
    opened with the ledgers the previous batch left, so a dominant holder
    spreads over partitions here too. Each batch overwrites its own two folders
    (decisions and ledgers by batch number), so a replay after a failure writes
    the same files again. A query older than one of its holder that an earlier batch
    decided comes too late to be folded in order: it is not decided but written to
    ``late``.
    """

    def decide(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        opening = session.read.parquet(f"{path}/ledgers/batch={number - 1}") if number > 0 else None
        decided_path, ledger_path = f"{path}/decisions/batch={number}", f"{path}/ledgers/batch={number}"
        if opening is not None:
            seen = opening.select(F.col("holder").alias("_holder"), "seen_us")
            joined = materialize(batch.join(seen, batch[holder] == seen["_holder"], "left").drop("_holder"))
            late = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) < F.col("seen_us"), F.lit(False))
            joined.where(late).drop("seen_us").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            batch = joined.where(~late).drop("seen_us")
        folded = ledger.ledger_fold(batch, holder, rule, max_cents, refill_cents, opening=opening)
        folded.write.mode("overwrite").parquet(decided_path)
        written = session.read.schema(folded.schema).parquet(decided_path)
        closing = ledger.ledgers(written).select("holder", "max_cents", "remaining_units", "last_refill_s")
        last = written.where(F.col("kind") != ledger.OPEN).groupBy("holder").agg(F.max("at_us").alias("seen_us"))
        if opening is not None:
            last = last.unionByName(opening.select("holder", "seen_us")).groupBy("holder").agg(F.max("seen_us").alias("seen_us"))
        closing.join(last, "holder", "left").write.mode("overwrite").parquet(ledger_path)

    return (
        queries.writeStream.foreachBatch(decide)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Query decisions of all finished batches, that is of those whose ledgers are written."""
    finished = spark.read.parquet(f"{path}/ledgers").agg(F.max("batch").alias("b")).first()["b"]
    decided = spark.read.parquet(f"{path}/decisions").where(F.col("batch") <= finished)
    return decided.drop("batch").where(F.col("kind") == ledger.QUERY)
