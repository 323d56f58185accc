"""Ordered t-closeness against plain sums, and l-diversity enforced by dealing rows to groups."""

import random
from collections import Counter, defaultdict

import pytest

from veilframe.operators import anatomy, checks, skew


@pytest.mark.parametrize("broadcast", [True, False])
def test_ordered_closeness_equals_plain_sums(many_partitions, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    rnd = random.Random(5)
    # one class and one value hold a third of all rows each
    rows = [
        (0 if rnd.random() < 0.33 else rnd.choice([None, *range(25)]), 7 if rnd.random() < 0.33 else rnd.choice([None, *range(-20, 60)]))
        for _ in range(3000)
    ]
    rows += [(99, 59), (98, -20)]
    df = many_partitions.createDataFrame(rows, "`q.x` int, s int").withColumnRenamed("q.x", "q")
    got = {r.q: (r.size, r.distance, r.meets_t) for r in checks.t_closeness_ordered(df, ["q"], "s", 0.1).collect()}
    known = [(q, s) for q, s in rows if q is not None and s is not None]
    world, classes = Counter(s for _, s in known), defaultdict(Counter)
    for q, s in known:
        classes[q][s] += 1
    assert got.keys() == classes.keys()
    for q, local in classes.items():
        size, gap, distance = sum(local.values()), 0.0, 0.0
        for s in sorted(world):
            gap += local[s] / size - world[s] / len(known)
            distance += abs(gap) / (len(world) - 1)
        assert got[q][0] == size and got[q][1] == pytest.approx(distance, abs=1e-9)
        assert got[q][2] == (distance <= 0.1)


def test_ordered_closeness_of_few_rows(spark):
    schema = "q int, r string, s double"
    one = spark.createDataFrame([(1, "a", 5.0), (2, "a", 5.0), (2, None, 9.0)], schema)
    assert sorted(tuple(r) for r in checks.t_closeness_ordered(one, ["q", "r"], "s").collect()) == [
        (1, "a", 1, 0.0, True), (2, "a", 1, 0.0, True),
    ]
    assert checks.t_closeness_ordered(spark.createDataFrame([], schema), ["q"], "s").collect() == []
    assert checks.t_closeness(spark.createDataFrame([], schema), ["q"], "s").collect() == []


def test_every_group_has_l_values(many_partitions):
    rnd = random.Random(6)
    values = ["hot"] * 100 + [None] * 40 + [rnd.choice("abcdefg") for _ in range(207)]
    rnd.shuffle(values)
    df = many_partitions.createDataFrame(list(enumerate(values)), "id int, `s.v` string")
    dealt = anatomy.l_diversify(df, "s.v", 3, "id", "secret")
    assert dealt.columns == ["id", "s.v", "group_id"]
    rows = dealt.collect()
    assert sorted((r[0], r[1] or "") for r in rows) == sorted((i, v or "") for i, v in enumerate(values))
    groups = defaultdict(list)
    for _, v, g in rows:
        groups[g].append(v)
    assert len(groups) == 307 // 3
    for held in groups.values():
        known = [v for v in held if v is not None]
        assert len(known) == len(set(known)) >= 3 and len(held) - len(known) <= 1
    assert sorted(map(tuple, anatomy.l_diversify(df, "s.v", 3, "id", "secret").select("id", "group_id").collect())) == sorted((r[0], r[2]) for r in rows)


def test_anatomy_parts_rows_from_values(spark):
    df = spark.createDataFrame([(i, 20 + i, "xyz"[i % 3]) for i in range(12)], "id int, age int, ill string")
    shown, listed = anatomy.anatomize(df, "ill", 3, "id", "secret")
    assert shown.columns == ["group_id", "age"] and shown.count() == 12
    assert sorted(map(tuple, listed.collect())) == [(g, v, 1) for g in range(4) for v in "xyz"]


def test_what_cannot_be_dealt(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, s string")
    with pytest.raises(ValueError, match="2 of 3"):
        anatomy.l_diversify(df, "s", 2, "id", "secret")
    with pytest.raises(ValueError, match="0 of 0"):
        anatomy.l_diversify(spark.createDataFrame([(1, None)], "id int, s string"), "s", 1, "id", "secret")
    with pytest.raises(ValueError, match="at least 1"):
        anatomy.l_diversify(df, "s", 0, "id", "secret")
    assert anatomy.l_diversify(df.limit(0), "s", 2, "id", "secret").collect() == []
