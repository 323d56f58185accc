"""CSV and fixed-width readers and the matching writers."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import parse
from ..operators.ordering import with_position
from . import quoted


def read_csv(spark: SparkSession, path: str, multiline: bool | None = None, encoding: str = "UTF-8") -> DataFrame:
    """All-text CSV with stripped header names and values; missing cells are empty text.

    Files are split among tasks. Whether line ends stand inside quotes is found by a pass over the
    lines with quotes; if some do, records are cut from the split files by ``quoted.records``. ``multiline=False`` leaves that
    pass out where there are known to be none, ``multiline=True`` reads each file in one task.
    """
    if multiline is None and encoding.upper().startswith(("UTF-16", "UTF-32")):
        multiline = True  # their line ends are no single bytes
    records = quoted.records(spark, path, encoding=encoding) if multiline is None else None
    raw = (
        spark.read.option("header", True)
        .option("multiLine", bool(multiline) or records is not None)
        .option("encoding", encoding)
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )
    names = raw.columns
    if records is not None:
        places = ", ".join(f"_{k} string" for k in range(len(names)))
        raw = records.select(F.from_csv("record", places, {"escape": '"'}).alias("r")).select("r.*").toDF(*names)
    return raw.select(*[parse.blank_to_empty(F.col(f"`{c}`")).alias(c.strip()) for c in names])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header; values with comma, quote or line end are quoted, quotes doubled."""
    texts = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    (
        texts.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def table_name_for(file_name: str) -> str:
    """``dataset_<safe file name>``."""
    base = file_name.rsplit("/", 1)[-1]
    if base.lower().endswith(".csv"):
        base = base[:-4]
    return "dataset_" + parse.safe_name(base)


def load_table(
    df: DataFrame, table: str, order_by: list[str], clear: bool = False, path: str | None = None
) -> DataFrame:
    """Store an all-text table with a running ``id`` that continues on append.

    ``clear`` replaces the table; otherwise it is created if missing and
    appended to. Ids follow the global order of ``order_by``.
    """
    spark = df.sparkSession
    safe = parse.safe_names(df.columns)
    numbered = with_position(df, order_by, "_pos")
    start = 0
    if not clear and spark.catalog.tableExists(table):
        start = spark.table(table).agg(F.max("id")).first()[0] or 0
    stored = numbered.select(
        (F.col("_pos") + F.lit(start + 1)).alias("id"),
        *[F.col(f"`{c}`").cast("string").alias(s) for c, s in zip(df.columns, safe)],
    )
    writer = stored.write.mode("overwrite" if clear else "append").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return spark.table(table)


# ------------------------------------------------------------------ fixed width
@dataclass(frozen=True)
class FieldSpan:
    """A field and its bytes, 1-based and inclusive."""

    name: str
    start: int
    end: int


def household_layout() -> list[FieldSpan]:
    """Household record, 39 fields."""
    return [FieldSpan(*f) for f in K.HOUSEHOLD_LAYOUT]


def day_layout(day: int) -> list[FieldSpan]:
    """The ten fields of one day block; blocks run from 1 to 7."""
    start = K.DAY_BLOCK_START + (day - 1) * K.DAY_BLOCK_WIDTH
    return [
        FieldSpan(name.format(n=day), start + offset, start + offset + width - 1)
        for name, offset, width in K.DAY_FIELDS
    ]


def person_layout() -> list[FieldSpan]:
    """Person record, 101 fields: shared head, person, seven day blocks, week totals."""
    shared = [f for f in household_layout() if f.end <= 44]
    days = [f for day in range(1, K.DAYS + 1) for f in day_layout(day)]
    return [*shared, *(FieldSpan(*f) for f in K.PERSON_FIELDS), *days, *(FieldSpan(*f) for f in K.WEEK_FIELDS)]


def widths_layout(fields: list[tuple[str, int]]) -> list[FieldSpan]:
    """Layout from consecutive field widths."""
    spans, start = [], 1
    for name, width in fields:
        spans.append(FieldSpan(name, start, start + width - 1))
        start += width
    return spans


def read_layout(spark: SparkSession, path: str) -> list[FieldSpan]:
    """Layout file: a name/field column and a length/width column; unusable rows are skipped.

    A layout describes one record, so its size is that of a schema.
    """
    table = read_csv(spark, path)

    def column_with(*words: str) -> str:
        for c in table.columns:
            if any(w in c.lower() for w in words):
                return c
        raise ValueError("a layout needs a name column and a length column")

    name, length = column_with("name", "field"), column_with("length", "width")
    width = parse.float_text(F.col(f"`{length}`")).cast("int")
    rows = table.select(F.col(f"`{name}`").alias("name"), width.alias("width"))
    usable = rows.where((F.col("name") != "") & F.col("width").isNotNull()).collect()
    return widths_layout([(r["name"], r["width"]) for r in usable])


def _single_bytes(encoding: str) -> bool:
    return encoding.upper() not in ("UTF-8", "UTF8")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files as they are; empty lines are left out."""
    return spark.read.text(paths).where(F.octet_length("value") > 0)


def cut_fields(line: Column, layout: list[FieldSpan], encoding: str = "UTF-8") -> list[Column]:
    """One stripped text per field; fields beyond a short line are empty.

    In an encoding of one byte per character each field is cut from the bytes and decoded alone.
    """
    if not _single_bytes(encoding):
        return [parse.strip(F.substring(line, f.start, f.end - f.start + 1)).alias(f.name) for f in layout]
    raw = line.cast("binary")
    return [
        parse.strip(F.decode(F.substring(raw, f.start, f.end - f.start + 1), encoding)).alias(f.name) for f in layout
    ]


def read_fixed_width(
    spark: SparkSession, path: str, layout: list[FieldSpan] | None = None, encoding: str = "ISO-8859-1"
) -> DataFrame:
    """Fixed-width records; without a layout each file's follows from its first line.

    Files of both layouts give the fields of both; those a record's layout lacks are null. Each layout is one scan
    of its own files, whose byte ranges Spark splits as ever: lines are neither shuffled nor joined, and
    unused fields are not cut.
    """
    if layout:
        return read_lines(spark, path).select(*cut_fields(F.col("value"), layout, encoding))
    layouts = detect_layouts(spark, path, encoding)
    if not layouts:
        raise ValueError("no lines to detect a layout from")
    scans = []
    for person, fields in ((False, household_layout()), (True, person_layout())):
        if files := sorted(f for f, kind in layouts.items() if kind == person):
            lines = read_lines(spark, [_as_path(spark, f) for f in files])
            scans.append(lines.select(*cut_fields(F.col("value"), fields, encoding)))
    both = scans[0] if len(scans) == 1 else scans[0].unionByName(scans[1], allowMissingColumns=True)
    return both


HEAD_BYTES = 4096
HEAD_READERS = 16


def _hadoop_path(spark: SparkSession, uri: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))


def _as_path(spark: SparkSession, uri: str) -> str:
    """A listed file as a path for a reader, in which pattern characters stand for themselves."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", _hadoop_path(spark, uri).toString())


def first_line(spark: SparkSession, uri: str, enough: int) -> bytes | None:
    """The first line of a file that is not blank, or its beginning if it has ``enough`` bytes; null without such a line.

    Read from the head of the file through the file system that Spark itself uses, compressed or not.
    """
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    at = _hadoop_path(spark, uri)
    stream = at.getFileSystem(conf).open(at)
    codec = spark.sparkContext._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    if codec is not None:
        stream = codec.createInputStream(stream)
    rest = b""
    try:
        while more := bytes(stream.readNBytes(HEAD_BYTES)):
            *lines, rest = re.split(rb"\r\n|\r|\n", rest + more)
            for line in lines:
                if line.strip():
                    return line
            if rest.strip():
                if len(rest) >= enough:
                    return rest
            elif len(rest) > enough:  # blanks so far; only their number matters
                rest = rest[:enough]
        return rest if rest.strip() else None
    finally:
        stream.close()


def detect_layouts(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> dict[str, bool]:
    """By file whether it has the person layout; files without lines are left out.

    It has when its first non-blank line, line end included, has 200 characters or more. Only the heads of the
    files are read, several at a time; the result is as long as the list of files that every scan keeps.
    """
    enough = 4 * K.PERSON_LINE_LENGTH  # a character has four bytes at most

    def person(uri: str) -> bool | None:
        line = first_line(spark, uri, enough)
        return None if line is None else len(line.decode(encoding, "replace")) + 1 >= K.PERSON_LINE_LENGTH

    listed = spark.read.text(path).inputFiles()
    with ThreadPoolExecutor(HEAD_READERS) as readers:
        kinds = dict(zip(listed, readers.map(person, listed)))
    return {file: kind for file, kind in kinds.items() if kind is not None}


def unpivot_days(persons: DataFrame, keys: list[str]) -> DataFrame:
    """One row per person and day block instead of seven column groups."""
    labels = [name.format(n="").lower() for name, _, _ in K.DAY_FIELDS]
    blocks = [
        F.struct(
            F.lit(K.DAYS + 1 - day).alias("day"),
            *[F.col(f.name).alias(label) for f, label in zip(day_layout(day), labels)],
        )
        for day in range(1, K.DAYS + 1)
    ]
    return persons.select(*keys, F.inline(F.array(*blocks)))
