"""CSV records with line ends inside quotes, read from files that are split among tasks.

A byte range of a file cannot tell by itself whether it begins inside quotes. What it can tell is
what it does to either answer: a range is a function of two states (outside, inside), and
functions of consecutive ranges compose. So

1. one pass folds the lines that hold a quote, range by range, into such functions, two bits a
   range;
2. a prefix scan over the ranges of each file gives the state every range begins in;
3. every range is then cut into records from its true start, and the few records that
   cross borders are put together from their fragments, at most two per range.

Files without line ends in quotes are found by the first step, which costs a scan but
neither a shuffle nor, for lines without quotes, Python.

A quote opens a field only at the field's beginning; doubled quotes inside are text. A quote that is never
closed is an error, since all that follows it would be one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, HEAD, TAIL = range(3)  # a record; the rest of one begun in an earlier range; the beginning of one

_FOLDED = "file string, block bigint, outside boolean, inside boolean"
_CUT = "kind int, file string, block bigint, record string"


def stays_open(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether a line that begins outside or inside quotes ends inside them."""
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(delimiter, at)
                if at < 0:
                    return False
                at += len(delimiter)
                continue
            at += 1
        inside = False
        at = line.find('"', at)
        while at >= 0 and line.startswith('"', at + 1):  # doubled: text
            at = line.find('"', at + 2)
        if at < 0:
            return True
        at = line.find(delimiter, at + 1)
        if at < 0:
            return False
        at += len(delimiter)


def range_lines(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """Lines in file order within each range, with ``file`` and the range's first byte, ``block``."""
    value = F.col("value")
    if encoding.upper() not in ("UTF-8", "UTF8"):
        value = F.decode(value.cast("binary"), encoding)
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.select(
        value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def fold_ranges(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """Per range with quotes the state at its end, for a start ``outside`` and ``inside`` quotes; true is inside.

    ``crossed`` counts the line ends inside quotes for the start outside.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends, crossed = None, [False, True], 0

        def row() -> pa.RecordBatch:
            values = [[key[0]], [key[1]], [ends[0]], [ends[1]], [crossed]]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["file", "block", "outside", "inside", "crossed"])

        for batch in batches:
            for value, file, block in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (file, block) != key:
                    if key is not None:
                        yield row()
                    key, ends, crossed = (file, block), [False, True], 0
                ends = [stays_open(value, state, delimiter) for state in ends]
                crossed += ends[0]
        if key is not None:
            yield row()

    with_quotes = lines.where(F.contains("value", F.lit('"'))).select("value", "file", "block")
    return with_quotes.mapInArrow(fold, _FOLDED + ", crossed bigint")


def quoted_spans(folded: DataFrame) -> tuple[dict[str, list[tuple[int, int]]], bool]:
    """By file the spans whose later borders stand inside quotes, and whether any line end stands inside quotes at all.

    A span (first, last) goes from the range that opens the quote to the next range with a quote; ranges in
    between have none and keep the state. ``folded`` has at most one short row per range, less than the
    scan's own list of ranges holds on the driver.
    """
    spans: dict[str, list[tuple[int, int]]] = {}
    crossed, inside, file, last = False, False, None, 0
    for row in folded.orderBy("file", "block").collect():
        if row["file"] != file:
            if inside:
                break
            file = row["file"]
        if inside:
            spans.setdefault(file, []).append((last, row["block"]))
        crossed = crossed or inside or row["crossed"] > 0
        inside, last = (row["inside"] if inside else row["outside"]), row["block"]
    if inside:
        raise ValueError(f"a quote is not closed in {file}")
    return spans, crossed


def cut_records(lines: DataFrame, spans: dict[str, list[tuple[int, int]]], header: bool, delimiter: str = ",") -> DataFrame:
    """Records and fragments of every range, cut from its true start.

    Blank lines outside quotes are no records, and each file's first record is left out if it is a ``header``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, head, first = None, [], False, False
        out: list[tuple] = []

        def close(done: bool) -> None:
            nonlocal kept, head, first
            record, kind = "\n".join(kept), HEAD if head else WHOLE if done else TAIL
            kept, head = [], False
            if kind == WHOLE and not record.strip():
                return
            if first and kind != HEAD:
                first = False
                if kind == WHOLE:
                    return
                kind = -TAIL  # a header that goes on in the next range
            out.append((kind, *key, record.removesuffix("\r") if done else record))

        for batch in batches:
            for value, file, block in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (file, block) != key:
                    if kept:
                        close(False)
                    key, first = (file, block), header and block == 0
                    head = any(begin < block <= end for begin, end in spans.get(file, ()))
                inside = head or bool(kept)
                kept.append(value)
                if not ((inside or '"' in value) and stays_open(value, inside, delimiter)):
                    close(True)
            yield _batch(out)
            out.clear()
        if kept:
            close(False)
            yield _batch(out)

    return lines.select("value", "file", "block").mapInArrow(cut, _CUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds, files, blocks, records = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(files, pa.string()), pa.array(blocks, pa.int64()), pa.array(records, pa.string())],
        ["kind", "file", "block", "record"],
    )


def joined_fragments(cut: DataFrame) -> DataFrame:
    """``record``s that cross range borders, from their fragments in file order."""
    tail = F.abs("kind") == TAIL
    order = Window.partitionBy("file").orderBy("block", F.abs("kind"))
    numbered = cut.where(F.col("kind") != WHOLE).withColumn("begun", F.sum(tail.cast("int")).over(order))
    pieces = F.sort_array(F.collect_list(F.struct("block", F.abs("kind").alias("k"), "record")))
    whole = numbered.groupBy("file", "begun").agg(
        F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record"), F.min("kind").alias("least")
    )
    return whole.where(F.col("least") >= 0).select("record")


def records(spark: SparkSession, path: str, header: bool = True, encoding: str = "UTF-8", delimiter: str = ",") -> DataFrame | None:
    """One text per record, line ends in quotes included; None if no file has any, so that plain lines are records."""
    lines = range_lines(spark, path, encoding)
    spans, crossed = quoted_spans(fold_ranges(lines, delimiter))
    if not crossed:
        return None
    whole = cut_records(lines, spans, header, delimiter).where(F.col("kind") == WHOLE).select("record")
    if not spans:
        return whole
    # only ranges beside a border inside quotes have fragments; the lines of all others are left out before Python
    beside = spark.createDataFrame([(f, *s) for f, found in spans.items() for s in found], "at string, first bigint, last bigint")
    near = (F.col("file") == F.col("at")) & F.col("block").between(F.col("first"), F.col("last"))
    some = lines.join(F.broadcast(beside), near, "left_semi")
    return whole.unionByName(joined_fragments(cut_records(some, spans, header, delimiter)))
