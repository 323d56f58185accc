"""Registry of the subpackage's queries and helpers for Arrow batches.

Operators read only the columns they name and keep every other column of their
input. A computed column replaces an input column of the same name; helper
columns start with ``_vf_``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Arrow batches are cut by rows and by bytes, so a run of long texts stays small in memory.
BATCH_ROWS = "512"
BATCH_BYTES = str(8 * 1024 * 1024)


def prepare(spark: SparkSession) -> None:
    """Session settings the operators count on."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def query(name: str, sql: str | None = None):
    """Register a query and, when SQL can express it, its counterpart."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str) -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))


def by_row(make: Callable[[], Callable[..., dict]], returns: str, arrow_type: pa.DataType):
    """An Arrow UDF from a function of one row's values; ``make`` runs once per task."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        fn = make()
        for arrays in batches:
            yield pa.array([fn(*values) for values in zip(*(a.to_pylist() for a in arrays))], arrow_type)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns)


def by_text(make: Callable[[], Callable[[bytes], dict]], returns: str, arrow_type: pa.DataType):
    """As ``by_row``, for functions of one text's bytes."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = make()
        for array in batches:
            yield pa.array([fn(value) for value in array.to_pylist()], arrow_type)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str, arrow: pa.Schema) -> DataFrame:
    """``mapInArrow`` from a function of one batch to columns; ``make`` runs once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            columns = fn(batch)
            if columns is not None:
                yield pa.RecordBatch.from_pydict(columns, schema=arrow)

    return df.mapInArrow(run, schema)


# crc32 of a text's bytes in DuckDB, which lacks the function; {0} is the text
CRC32_SQL = """xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode({0}))),
 lambda i: CAST('0x' || hex(encode({0}))[2 * i + 1 : 2 * i + 2] AS BIGINT))),
 lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
