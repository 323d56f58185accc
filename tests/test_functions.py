"""Column functions against plain Python on edge values."""

import hashlib
import hmac
import math
import statistics
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from veilframe.functions import keyed, masks, parse, randomized, ranges


def apply(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


TEXTS = [None, "", " ", "x", "Zoë Ångström", "Customer#000000001", "a" * 80, "日本語"]


def test_hash_keeps_length(spark):
    expected = [None if t is None else sha(t)[: len(t)] for t in TEXTS]
    assert apply(spark, TEXTS, masks.hash_keep_length) == expected


def test_pseudonym(spark):
    expected = [None if t is None else f"Person_{int(sha(t)[:16], 16) % 100000:05d}" for t in TEXTS]
    assert apply(spark, TEXTS, masks.pseudonym) == expected


@pytest.mark.parametrize(
    "value,expected",
    [
        ("john@mail.com", "jo**@mail.com"),
        ("j@x.org", "j*@x.org"),
        ("jo@x.org", "jo*@x.org"),
        ("a@b@c", "a*@b@c"),
        ("@x", "*@x"),
        ("nobody", "[MASKED]"),
        (None, None),
    ],
)
def test_email(spark, value, expected):
    assert apply(spark, [value], masks.mask_email) == [expected]


def test_phone(spark):
    values = ["(987) 654-3210", "98765 43210", "12345", "+919876543210", None]
    assert apply(spark, values, masks.mask_phone) == ["******3210", "******3210", "[MASKED]", "*********3210", None]


def test_aadhaar_and_pan(spark):
    values = ["1234 5678 9012", "123456789012", "12", "ab1", None]
    assert apply(spark, values, masks.mask_aadhaar) == ["XXXX XXXX 9012", "XXXXXXXX9012", "XX", "XXX", None]
    values = [" abcde1234f ", "ABCDEFGH", "ABC", None]
    assert apply(spark, values, masks.mask_pan) == ["ABCDE****F", "ABC**FGH", "***", None]


def test_district(spark):
    values = ["Pune", "DELHI", "Zürich"]
    expected = [
        f"District {int(hashlib.md5(v.lower().encode()).hexdigest()[:8], 16) % 10 + 1}" for v in values
    ]
    assert apply(spark, values, masks.district_alias) == expected


def java_hash(text):
    h = 0
    units = text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
    return "hash_%x" % abs(h - (1 << 32) if h >= 1 << 31 else h)


def test_java_hash(spark):
    values = ["", "a", "hello world", "Zoë", "😀 smile", "x" * 100]
    assert apply(spark, values, masks.java_hash) == [java_hash(v) for v in values]


def test_dates(spark):
    values = ["12/05/1999", "year 2024.", "1899", "x2024", "20245", "in 1950 and 2001", None]
    expected = ["1999", "2024", "[DATE]", "[DATE]", "[DATE]", "1950", None]
    assert apply(spark, values, masks.generalize_date) == expected


def test_safe_numeric(spark):
    values = ["$1,234.50", " 12 ", "1e3", "5d", "nan", "inf", "", "1_000", "_1", ".5", "-3.", "0x10", None]
    expected = [1234.5, 12.0, 1000.0, None, None, None, None, 1000.0, None, 0.5, -3.0, None, None]
    assert apply(spark, values, parse.safe_numeric) == expected


def test_safe_names():
    assert parse.safe_names(["Name ", "name", "a-b", "id", "", "%%", "a b"]) == [
        "name", "name_1", "a_b", "id_1", "empty_column", "_", "a_b_1",
    ]


def test_ranges(spark):
    assert apply(spark, [17.9, 18.0, 25.0, 26.0, 95.0, 96.0, None], ranges.age_range, "v double") == [
        "0-17", "18-25", "18-25", "26-35", "86-95", "96-120", None,
    ]
    assert apply(spark, [9999.0, 10000.0, 25000.0, 200001.0], ranges.income_range, "v double") == [
        "0-10000", "10000-25000", "10000-25000", "200000+",
    ]
    assert apply(spark, [0.4, 0.5, 1.0, 51.0], ranges.land_range, "v double") == ["0-0.5", "0.5-1.0", "0.5-1.0", "50.0+"]
    assert apply(spark, [0.0, 3.0, 9.0], ranges.household_range, "v double") == ["1-2", "3-5", "9-20"]


def test_equal_width_of_a_constant_column(spark):
    fn = lambda c: ranges.equal_width(c, F.lit(5.0), F.lit(5.0))
    assert apply(spark, [5.0, None], fn, "v double") == [5.0, None]
    fn = lambda c: ranges.equal_width(c, F.lit(0.0), F.lit(10.0))
    assert apply(spark, [0.0, 9.99, 10.0, None], fn, "v double") == [0.5, 9.5, 9.5, None]


def test_pool_noise_support(spark):
    df = spark.range(3000).withColumn("v", (F.col("id") % 7 - 1).cast("double"))
    ages = df.select("v", randomized.pool_noise(F.col("v"), "age", "s", F.col("id")).alias("n")).collect()
    for v, n in ages:
        if v < 0:
            assert n == v
        else:
            assert n >= 0 and (n - v in (-3, -2, -1, 1, 2, 3) or n == 0)
    money = df.select("v", randomized.pool_noise(F.col("v"), "salary", "s", F.col("id")).alias("n")).collect()
    assert {n - v for v, n in money} == {s * x for s in (-1, 1) for x in (500, 600, 700, 1000, 1500)}
    for name in ("age", "salary", "score"):
        fn = lambda c: randomized.numeric_release(c, name, "s", F.lit(1))
        assert apply(spark, [None], fn, "v double") == [None]
    halves = apply(spark, [0.5, 1.5, 2.5], lambda c: randomized.numeric_release(c, "x", "s", F.lit(1), False), "v double")
    assert halves == [0, 2, 2]


def test_uniforms_are_uniform_and_reproducible(spark):
    u = keyed.uniform("s", "op", "c", F.col("id"))
    df = spark.range(20000).select(u.alias("u"))
    values = [r[0] for r in df.collect()]
    assert values == [r[0] for r in df.repartition(7).sort("u").join(df, "u").select("u").collect()] or sorted(values) == sorted(
        r[0] for r in df.repartition(7).collect()
    )
    assert abs(statistics.mean(values) - 0.5) < 0.01 and abs(statistics.pvariance(values) - 1 / 12) < 0.003
    assert 0 < min(values) and max(values) < 1


def test_laplace_and_gaussian_moments(spark):
    d = keyed.digest("s", "op", "c", F.col("id"))
    rows = spark.range(40000).select(
        keyed.laplace(keyed.uniform_of(d), 3.0).alias("l"),
        keyed.gaussian(keyed.uniform_of(d, 1), keyed.uniform_of(d, 2), 2.0).alias("g"),
    ).collect()
    lap, gauss = [r.l for r in rows], [r.g for r in rows]
    assert abs(statistics.mean(lap)) < 0.1 and abs(statistics.pvariance(lap) - 18) < 1
    assert abs(statistics.mean(gauss)) < 0.05 and abs(statistics.pvariance(gauss) - 4) < 0.15


def test_bounded_laplace_stays_inside_and_scale_solves_its_equation(spark):
    u = keyed.uniform("s", "op", "c", F.col("id"))
    low, high = F.lit(0.0), F.lit(10.0)
    rows = spark.range(5000).select(keyed.bounded_laplace(F.lit(9.5), u, F.lit(4.0), low, high).alias("x")).collect()
    assert all(0 <= r.x <= 10 for r in rows)
    for epsilon, sensitivity, width in ((0.1, 5.0, 100.0), (1.0, 1.0, 1.0), (0.01, 40.0, 1e7), (3.0, 2.0, 50.0)):
        b = spark.range(1).select(
            keyed.bounded_laplace_scale(epsilon, F.lit(sensitivity), F.lit(width))
        ).first()[0]
        reach = min(sensitivity, width)
        c = (2 - math.exp(-reach / b) - math.exp(-(width - reach) / b)) / (1 - math.exp(-width / b))
        assert b == pytest.approx(sensitivity / (epsilon - math.log(c)), rel=1e-6)
        assert b >= sensitivity / epsilon


def test_hmac_seed(spark):
    for key in ("k", "x" * 100):
        got = apply(spark, ["q1||2024-01-01-00", "é"], lambda c: keyed.hmac_sha256(key, c))
        assert got == [
            hmac.new(key.encode(), m.encode(), hashlib.sha256).hexdigest() for m in ("q1||2024-01-01-00", "é")
        ]


def test_rotation_windows(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    start = datetime(2023, 12, 25, tzinfo=timezone.utc)
    times = [start + timedelta(hours=31 * i) for i in range(400)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp")
    rows = df.select(*[keyed.rotation_window(F.col("t"), h) for h in (24, 1, 168, 6)]).collect()
    for t, (day, hour, week, custom) in zip(times, rows):
        assert day == t.strftime("%Y-%m-%d-00") and hour == t.strftime("%Y-%m-%d-%H")
        assert week == t.strftime("%Y-W%U") and custom == f"bucket-{int(t.timestamp() // 3600) // 6}"


def test_randomized_response_estimates(spark):
    rows = spark.range(40000).select((F.col("id") % 10 < 3).alias("v"), "id")
    answers = rows.select(randomized.rr_boolean(F.col("v"), "s", "c", F.col("id")).alias("a"))
    share = answers.agg(F.avg(F.col("a").cast("int"))).first()[0]
    assert (share - 0.125) / 0.75 == pytest.approx(0.3, abs=0.02)
    assert randomized.rr_epsilon(0.75) == pytest.approx(math.log(1.75 / 0.25))
