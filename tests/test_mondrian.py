"""k-anonymity over combinations: every class reaches k, and the cuts equal those of a plain recursion."""

import datetime
import random

import pytest

from veilframe.operators import checks, mondrian


def plain(rows, k, widths):
    """Classes of a plain recursion over rows of values from 0 to 1."""
    best = None
    for d in range(len(widths)):
        values = sorted(r[d] for r in rows)
        cuts = [(abs(2 * sum(v <= m for v in values) - len(values)), m) for m in set(values)]
        cuts = [(far, m) for far, m in cuts if k <= sum(v <= m for v in values) <= len(values) - k]
        if cuts:
            option = (-(values[-1] - values[0]) / widths[d], d, min(cuts)[1])
            best = option if best is None or option < best else best
    if best is None:
        return [sorted(rows)]
    _, d, m = best
    return plain([r for r in rows if r[d] <= m], k, widths) + plain([r for r in rows if r[d] > m], k, widths)


@pytest.mark.parametrize("seed", [1])
def test_cuts_equal_a_plain_recursion(many_partitions, seed):
    rnd = random.Random(seed)
    # a third of all rows share one combination
    rows = [(64, 64)] * 60 + [(rnd.randrange(129), rnd.choice([0, 1, 2, 128])) for _ in range(120)] + [(0, 0), (128, 128)]
    df = many_partitions.createDataFrame([(*r, i) for i, r in enumerate(rows)], "a int, b int, id int")
    boxes = mondrian.boxes_of(df, ["a", "b"], 5).collect()
    found = {}
    for r in boxes:
        found.setdefault(r["_box"], []).extend([(r["a"], r["b"])] * r["_n"])
    assert sorted(sorted(v) for v in found.values()) == sorted(plain(rows, 5, [128, 128]))
    released = mondrian.k_anonymize_mondrian(df, ["a", "b"], 5)
    assert released.columns == df.columns and released.count() == len(rows)
    assert checks.equivalence_classes(released, ["a", "b"], 5).where("not meets_k").count() == 0
    for row in released.collect():
        for shown, own in zip(row[:2], rows[row["id"]]):
            low, _, high = shown.partition(" - ")
            assert int(low) <= own <= int(high or low)


def test_nulls_dates_and_names_with_dots(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(None if i % 5 == 0 else day + datetime.timedelta(days=i), i % 2 == 0, float(i), str(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "`born.on` date, flag boolean, pay double, name string")
    released = mondrian.k_anonymize_mondrian(df.withColumnRenamed("born.on", "born"), ["born", "flag", "pay"], 4)
    assert released.count() == 40 and released.select("name").distinct().count() == 40
    sizes = released.groupBy("born", "flag", "pay").count().collect()
    assert len(sizes) > 4 and min(r["count"] for r in sizes) >= 4
    nothing = spark.createDataFrame([(None, "x")] * 6, "a int, name string")
    assert [tuple(r) for r in mondrian.k_anonymize_mondrian(nothing, ["a"], 3).distinct().collect()] == [(None, "x")]


def test_what_cannot_be_released(spark):
    df = spark.createDataFrame([(1, "x")] * 3, "a int, name string")
    with pytest.raises(ValueError, match="3 rows"):
        mondrian.k_anonymize_mondrian(df, ["a"], 4)
    with pytest.raises(ValueError, match="no numbers"):
        mondrian.k_anonymize_mondrian(df, ["name"], 2)
    with pytest.raises(ValueError):
        mondrian.k_anonymize_mondrian(df, [], 2)
    assert mondrian.k_anonymize_mondrian(df.limit(0), ["a"], 2).collect() == []
