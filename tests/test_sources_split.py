"""Files that are split among tasks: quoted line ends across ranges, and layouts found from the heads of files."""

import csv
import gzip
import io
import random

import pytest

from veilframe.plans import QUERIES
from veilframe.sources import files, quoted


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few dozen bytes, as large files would have of 128 MB."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def write(path, rows, end="\r\n"):
    text = io.StringIO()
    csv.writer(text, lineterminator=end).writerows(rows)
    path.write_bytes(text.getvalue().encode())


WORDS = ["", "a", 'say "hi"', "two\nlines", "x,y", '"', "\n", "é\n\nü", '5" pipe', "long " * 8, "in\n" * 30, '""\n""']


@pytest.mark.parametrize("seed", range(3))
def test_quoted_line_ends_in_many_ranges(small_ranges, tmp_path, seed):
    rnd = random.Random(seed)
    expected = []
    for name in ("one.csv", "two.csv"):
        rows = [(f"{name}{i}", rnd.choice(WORDS), rnd.choice(WORDS), "z") for i in range(40)]
        expected += [tuple(v.strip() for v in r) for r in rows]
        write(tmp_path / name, [("id", " first\nname", "b", "c"), *rows], rnd.choice(["\n", "\r\n"]))
    found = files.read_csv(small_ranges, str(tmp_path))
    assert found.columns == ["id", "first\nname", "b", "c"]
    assert rows_of(found) == sorted(expected)
    assert quoted.range_lines(small_ranges, str(tmp_path)).rdd.getNumPartitions() > 8


def test_plain_files_are_read_by_the_reader_of_spark(small_ranges, tmp_path):
    write(tmp_path / "a.csv", [("k", "v"), *((i, 'say "hi", you') for i in range(50))], "\n")
    assert quoted.records(small_ranges, str(tmp_path)) is None
    assert rows_of(files.read_csv(small_ranges, str(tmp_path))) == sorted((str(i), 'say "hi", you') for i in range(50))


def test_quotes_inside_open_fields_are_text(small_ranges, tmp_path):
    lines = ["k,v,w", 'a,5" pipe,"x', 'y"', 'b,"c"d,e', ' "f,g,"h', '"', "", "  ", 'i,"j""",k']
    (tmp_path / "a.csv").write_text("\n".join(lines))
    assert rows_of(files.read_csv(small_ranges, str(tmp_path))) == [
        ('"f', "g", "h"), ("a", '5" pipe', "x\ny"), ("b", '"c"d', "e"), ("i", 'j"', "k"),
    ]


def test_one_value_over_many_ranges(small_ranges, tmp_path):
    value = "\n".join(["no quote in these lines"] * 40)
    write(tmp_path / "a.csv", [("k", "v"), ("1", value), ("2", "x"), ("3", value + "\n"), ("4", value)], "\n")
    assert rows_of(files.read_csv(small_ranges, str(tmp_path))) == [("1", value), ("2", "x"), ("3", value), ("4", value)]


def test_a_quote_that_is_not_closed_is_an_error(small_ranges, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"open\n2,x\n' + "3,y\n" * 20)
    with pytest.raises(ValueError, match="not closed"):
        files.read_csv(small_ranges, str(tmp_path))


@pytest.mark.parametrize(
    "line,outside,inside",
    [("", False, True), ("a,b", False, True), ('"', True, False), ('a,"b', True, False), ('a"b', False, False), ('""', False, True),
     ('"a""', True, False), ('"a"",b",c', False, False), ('x","y', True, True), ('","', False, True)],
)
def test_what_a_line_does_to_both_states(line, outside, inside):
    assert quoted.stays_open(line, False) is outside and quoted.stays_open(line, True) is inside


def test_other_encodings(small_ranges, tmp_path):
    text = 'k,v\n1,"é\nü"\n' + "2,ß\n" * 20
    for name, multiline in (("ISO-8859-1", None), ("UTF-16", None), ("UTF-8", True)):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(name))
        rows = rows_of(files.read_csv(small_ranges, str(tmp_path / f"{name}.csv"), multiline, name))
        assert rows == [("1", "é\nü")] + [("2", "ß")] * 20


# fixed width


def test_fixed_width_scan_has_no_exchange(spark):
    df = QUERIES["scan_fixed_width"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Union" in plan


def test_heads_alone_decide_the_layout(spark, tmp_path):
    person = "P" * 267
    (tmp_path / "blank first.txt").write_bytes(b"\n \r\n" + b" " * 9000 + b"\n" + person.encode() + b"\n" + b"x" * 50 + b"\n")
    (tmp_path / "no end [1]{a}.txt").write_bytes(b"H" * 198)
    (tmp_path / "edge.txt").write_bytes(b"H" * 199)
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "blank.txt").write_bytes(b"\n\n   \n")
    (tmp_path / "packed.txt.gz").write_bytes(gzip.compress((person + "\n").encode()))
    (tmp_path / "endless.txt").write_bytes(b"Q" * 100_000)
    kinds = {f.rsplit("/", 1)[1]: kind for f, kind in files.detect_layouts(spark, str(tmp_path)).items()}
    assert kinds == {
        "blank%20first.txt": True, "no%20end%20%5B1%5D%7Ba%7D.txt": False, "edge.txt": True, "packed.txt.gz": True, "endless.txt": True,
    }
    found = files.read_fixed_width(spark, str(tmp_path))
    assert found.where("FILE_ID = 'HHHHH'").count() == 2 and found.where("FILE_ID = 'PPPPP'").count() == 2


def test_no_lines_no_layout(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\n")
    with pytest.raises(ValueError, match="no lines"):
        files.read_fixed_width(spark, str(tmp_path))


def test_unused_fields_are_not_cut(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"H" * 128)
    plan = files.read_fixed_width(spark, str(tmp_path)).select("FILE_ID")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring") == 1
