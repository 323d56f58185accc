"""Stored tables, stored JSON datasets, guarded SQL, and result sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import constants as K
from ..operators.json_rewrite import infer_schema, opens_with

_NAME = re.compile(r"^[a-zA-Z0-9_]+$")
# the writers' default stops at milliseconds
_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def nulls_to_empty(df: DataFrame) -> DataFrame:
    """Text columns with null as empty text; other types keep null, which scoring skips too."""
    texts = {n for n, t in df.dtypes if t == "string"}
    return df.select(
        *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns]
    )


def scan_table(
    spark: SparkSession,
    table: str,
    schema: str | None = None,
    cap: int | None = None,
    order_by: list[str] | None = None,
    empty_nulls: bool = True,
) -> DataFrame:
    """A stored table by plain name; the whole table unless a cap is asked for.

    A capped scan needs an order, since rows have none of their own.
    """
    for name in filter(None, (schema, table)):
        if not _NAME.match(name):
            raise ValueError(f"invalid name {name!r}")
    df = spark.table(f"`{schema}`.`{table}`" if schema else f"`{table}`")
    if empty_nulls:
        df = nulls_to_empty(df)
    if cap is None:
        return df
    if not order_by:
        raise ValueError("a capped scan needs order_by")
    return df.orderBy(*order_by).limit(cap)


def guarded_sql(
    spark: SparkSession, query: str, cap: int | None = None, order_by: list[str] | None = None
) -> DataFrame:
    """A single SELECT without blocked words; the whole result unless a cap is asked for.

    Words are looked for anywhere in the text, so a column ``updated_at`` is refused.
    A cap needs an order, and leaves a text with its own LIMIT alone.
    """
    text = query.strip()
    upper = text.upper()
    if not upper.startswith("SELECT"):
        raise ValueError("Only SELECT queries allowed")
    for word in K.BLOCKED_SQL_WORDS:
        if word in upper:
            raise ValueError(f"Disallowed keyword: {word}")
    body = text[:-1] if text.endswith(";") else text
    if ";" in body:
        raise ValueError("Multiple statements not allowed")
    if cap is not None and not order_by:
        raise ValueError("a cap needs order_by")
    df = spark.sql(body)
    if cap is not None and "LIMIT" not in upper:
        df = df.orderBy(*order_by).limit(cap)
    return nulls_to_empty(df)


def scan_dataset(stored: DataFrame, name: str) -> DataFrame:
    """Rows of one stored JSON dataset (dataset_name, row_index, data) as columns.

    The schema is the union of the documents' keys; ``row_index`` gives the order. Documents that are no objects
    keep their row, with nulls.
    """
    rows = stored.where(F.col("dataset_name") == name)
    schema = infer_schema(rows, "data")
    if not isinstance(schema, StructType):  # no object at all
        return rows.select("row_index")
    document = F.when(opens_with(F.col("data")) == "{", F.from_json("data", schema))
    return rows.select("row_index", document.alias("d")).select("row_index", "d.*")


def union_ragged(*parts: DataFrame) -> DataFrame:
    """Rows of tables with different columns; absent columns are null."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def to_records(df: DataFrame, source_table: str) -> DataFrame:
    """Rows as (source_table, data) with the row as a JSON document."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(F.lit(source_table).alias("source_table"), whole.alias("data"))


def write_records(df: DataFrame, source_table: str, path: str) -> None:
    """Append anonymized rows as JSON documents with their origin and time."""
    to_records(df, source_table).withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_audit_log(entries: DataFrame, path: str, file_format: str = "json") -> None:
    """Export audit entries, newest first; CSV keeps the nested details as JSON text.

    The order holds across the part files (range-partitioned sort).
    """
    ordered = entries.orderBy(F.desc("timestamp"), F.desc("query_id"))
    if file_format == "json":
        ordered.write.mode("errorifexists").option("timestampFormat", _TIMESTAMP).json(path)
    elif file_format == "csv":
        flat = ordered.withColumn("mathematical_output", F.to_json("mathematical_output"))
        (
            flat.write.mode("errorifexists")
            .option("header", True)
            .option("escape", '"')
            .option("timestampFormat", _TIMESTAMP)
            .csv(path)
        )
    else:
        raise ValueError("file_format is 'json' or 'csv'")


def audit_events(df: DataFrame) -> DataFrame:
    """Events as (timestamp, event_type, user_id, details) with their day."""
    return df.select("timestamp", "event_type", "user_id", "details").withColumn(
        "dt", F.to_date("timestamp")
    )


def write_audit_events(df: DataFrame, path: str) -> None:
    """Append events as JSON lines, one folder per day.

    Rows are rebalanced by day first, so a day is written by as many tasks as
    its size asks for instead of by every task of the job.
    """
    by_day = audit_events(df).hint("rebalance", "dt")
    by_day.write.mode("append").partitionBy("dt").option("timestampFormat", _TIMESTAMP).json(path)
