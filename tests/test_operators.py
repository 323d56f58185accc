"""Operators on skewed, ragged and empty data, checked against plain Python."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilframe.functions import keyed
from veilframe.operators import anonymize, checks, classify, dp, json_rewrite, ordering, policy, privatize, risk, skew, teams
from veilframe.sources import files, tables


def test_positions(many_partitions):
    rng = random.Random(1)
    keys = rng.sample(range(10**6), 5000)
    df = many_partitions.createDataFrame([(k,) for k in keys], "k bigint")
    placed = ordering.with_position(df, ["k"])
    assert placed.select(F.spark_partition_id()).distinct().count() > 5
    assert [r.k for r in placed.orderBy("pos").collect()] == sorted(keys)
    assert [r.pos for r in placed.orderBy("k").collect()] == list(range(5000))


def test_running_total(many_partitions):
    df = many_partitions.range(4000).withColumn("v", F.col("id") % 5)
    got = ordering.with_running_total(df, ["id"], {"t": F.col("v")}).orderBy("id").collect()
    total = 0
    for r in got:
        total += r.v
        assert r.t == total


@pytest.mark.parametrize("n", [0, 3, 15, 16, 17, 100])
def test_first_middle_last(spark, n):
    got = sorted(r.id for r in ordering.first_middle_last(spark.range(n), ["id"]).collect())
    rows = list(range(n))
    expected = rows if n <= 15 else rows[:5] + rows[n // 2 - 2 : n // 2 + 3] + rows[-5:]
    assert got == sorted(set(expected))


def draws(spark, ids, column):
    d = keyed.digest("s", "k_anonymity", column, F.col("id"))
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", keyed.uniform_of(d, 0), keyed.uniform_of(d, 1))
    return {r[0]: (r[1], r[2]) for r in rows.collect()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_k_anonymity_with_a_value_holding_half_the_rows(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    rng = random.Random(2)
    rows = [(i, "hot" if i % 2 else rng.choice([None, f"v{rng.randrange(400)}"])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, v string")
    got = {r.id: r.v for r in anonymize.k_anonymize(df, "v", 4, "s", "id").collect()}
    counts = Counter(v for _, v in rows if v is not None)
    names = sorted(counts)
    u = draws(spark, [i for i, _ in rows], "v")
    expected = {}
    for i, v in rows:
        lost = v is not None and counts[v] < 4 and u[i][0] >= 0.75
        expected[i] = names[int(u[i][1] * len(names))] if lost else v
    assert got == expected
    assert sum(expected[i] != v for i, v in rows) > 10


@pytest.mark.parametrize("broadcast", [True, False])
def test_t_closeness(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), "hot" if rng.random() < 0.4 else rng.choice([None, *"abcdef"])) for _ in range(3000)]
    got = {r.q: r.distance for r in checks.t_closeness(spark.createDataFrame(rows, "q int, s string"), ["q"], "s").collect()}
    known = [(q, s) for q, s in rows if q is not None and s is not None]
    world = Counter(s for _, s in known)
    for q in {q for q, _ in known}:
        local = Counter(s for x, s in known if x == q)
        size = sum(local.values())
        expected = 0.5 * sum(abs(local[s] / size - world[s] / len(known)) for s in world)
        assert got[q] == pytest.approx(expected)


def test_heavy_values_are_few(spark):
    counts = spark.range(1, 5000).select(F.col("id").alias("v"), (F.lit(100000) / F.col("id")).cast("bigint").alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    assert skew.heavy_values(counts, total).count() < 1000


def test_l_diversity_ignores_unknown(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "a"), (None, "x"), (3, None)]
    got = checks.l_diversity(spark.createDataFrame(rows, "q int, s string"), ["q"], "s").first()
    assert (got.classes, got.violations_found, got.satisfies_l_diversity) == (3, 2, False)


def test_similar_queries_against_all_pairs(many_partitions):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [
        (i, rng.randrange(6), rng.randrange(2) if rng.random() < 0.3 else 0, start + timedelta(minutes=rng.randrange(6000)),
         rng.choice("ab"), "f", rng.choice(["count", "mean"]))
        for i in range(800)
    ]
    schema = "query_id bigint, user_id bigint, team_id bigint, ts timestamp, table_name string, field_name string, query_type string"
    got = {r.query_id: r for r in teams.similar_queries(many_partitions.createDataFrame(rows, schema)).collect()}
    for i, user, team, ts, t, f, kind in rows:
        like = [r for r in rows if r[0] != i and r[2] == team and r[4:] == (t, f, kind) and (r[3], r[0]) < (ts, i) and ts - r[3] <= timedelta(days=1)]
        others = any(r[1] != user for r in like)
        assert got[i].similar_queries_detected == len(like)
        assert got[i].cross_user_detection == others
        assert got[i].budget_multiplier == (1.0 if not like else 3.0 if others else 2.0)


# ------------------------------------------------------------------ risk and classification
def test_risk_of_edge_records(spark):
    rows = [(None, "  ", None), ("x", None, 30), ("a@b.co", "2024-01-01 10:00:00", 500)]
    df = spark.createDataFrame(rows, "name string, note string, n int")
    got = risk.score_records(df).collect()
    assert got[0].risk == 10.0 and got[0].filled == 0
    # generic name field 50, small integer 25
    assert got[1].risk == pytest.approx(100 * (1 - 0.5 * 0.75))
    assert got[2].uniqueness_risk == pytest.approx(90) and got[2].precision_risk == pytest.approx(70)


def test_risk_of_nothing(spark):
    got = risk.dataset_risk(spark.range(0).select(F.col("id").cast("string").alias("v"))).first()
    assert (got.records, got.risk_score, got.risk_level) == (0, 10, "Very Low Risk")


def test_words_next_to_accents_are_not_words(spark):
    rows = [("mon âge", 0), ("page", 0), ("the age", 35), ("éage x", 0), ("age", 35), ("my SECRET", 100), ("ſecret", 100)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    got = [r.sensitivity_risk for r in risk.score_records(df).collect()]
    assert got == pytest.approx([w for _, w in rows])
    # long texts are searched in another way, with the same result
    padded = df.select(F.concat(F.repeat(F.lit("mot "), F.lit(200)), "t", F.repeat(F.lit(" mot"), F.lit(200))).alias("t"))
    got = [r.sensitivity_risk for r in risk.score_records(padded).collect()]
    assert got == pytest.approx([w for _, w in rows])


@pytest.mark.parametrize("distinct", ["exact", "approx"])
def test_classification_of_edge_columns(spark, distinct):
    df = spark.range(200).select(
        F.lit(None).cast("string").alias("empty"),
        F.date_format(F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")), "yyyy-MM-dd").alias("when"),
        F.concat(F.lit("4111 1111 1111 "), F.lpad(F.col("id").cast("string"), 4, "0")).alias("plastic"),
        F.when(F.col("id") % 2 == 0, "yes").otherwise("no").alias("flag"),
        F.col("id").cast("string").alias("user_id"),
        F.lit("x").alias("first name"),
    )
    got = {r.column: r for r in classify.classify_columns(df, distinct=distinct).collect()}
    assert (got["empty"].type, got["empty"].confidence, got["empty"].mechanism) == ("generic", 0.0, "suppression")
    # dates and card numbers also look like phone numbers, which come first
    assert got["when"].type == "quasi_identifier" and got["plastic"].type == "quasi_identifier"
    assert (got["flag"].type, got["flag"].mechanism) == ("categorical", "k_anonymity")
    assert got["user_id"].type == "numeric"  # the underscore keeps the name rules from matching
    assert got["first name"].reasoning == "Column name matches quasi_identifier pattern"


def test_classification_of_the_first_rows(spark):
    df = spark.range(1000).select(
        "id", F.when(F.col("id") < 100, F.lit("a@b.co")).otherwise(F.col("id").cast("string")).alias("v")
    )
    sampled = {r.column: r.type for r in classify.classify_columns(df, ["v"], sample_by=["id"]).collect()}
    whole = {r.column: r.type for r in classify.classify_columns(df, ["v"]).collect()}
    assert sampled["v"] == "identifier" and whole["v"] == "numeric"


# ------------------------------------------------------------------ privatization
def test_privatized_table_keeps_rows_and_types_of_columns(spark):
    df = spark.createDataFrame(
        [(i, f"n{i}", f"u{i}@x.org", 20 + i % 50, "0", f"c{i % 3}", json.dumps({"name": f"n{i}", "n": i})) for i in range(60)],
        "id bigint, `full name` string, email string, age int, zero string, kind string, data string",
    )
    released, plan = privatize.privatize(df, "s", "id")
    rows = released.orderBy("email").collect()
    assert len(rows) == 60 and released.columns == df.columns
    assert {c.column: c.treatment for c in plan.columns}["data"] == "json"
    assert all(r["full name"].startswith("Person_") for r in rows)
    assert {r.zero for r in rows} == {"0"}
    assert {r.kind for r in rows} == {"c0", "c1", "c2"}
    assert all(json.loads(r.data)["name"].startswith("Person_") for r in rows)
    assert sum(c.epsilon or 0 for c in plan.columns) <= plan.epsilon
    summary = privatize.release_summary(df, released, plan).first()
    assert summary.total_values == 60 * 7


def test_every_epsilon_share_is_affordable():
    for parts in range(1, 40):
        for total in ("0.5", "1", "2", "3"):
            shares = privatize.epsilon_shares(privatize.Decimal(total), parts)
            assert len(shares) == parts and sum(shares) <= privatize.Decimal(total)


def test_json_that_is_no_json_is_hashed(spark):
    df = spark.createDataFrame([(1, '{"a": 5}'), (2, "oops"), (3, None), (4, '{"a": "7", "b": [1, {"c": true}]}')], "id int, d string")
    got = {r.id: r.d for r in json_rewrite.anonymize_json(df, "d", "s", "id").collect()}
    assert got[3] is None and len(got[2]) == 4 and got[2] != "oops"
    assert got[1] != '{"a": 5}'


def test_nested_columns_are_rewritten_in_place(spark):
    df = spark.createDataFrame(
        [(1, ("Ann Lee", "ann@x.org", [5, -1]))], "id int, data struct<name: string, mail: string, codes: array<int>>"
    )
    got = json_rewrite.anonymize_json(df, "data", "s", "id").first().data
    assert got.name.startswith("Person_") and got.mail == "an*@x.org"
    assert got.codes[1] == -1 and abs(got.codes[0] - 5) in (1, 2, 3)


@pytest.mark.parametrize("broadcast", [True, False])
def test_look_up_of_a_frequent_key(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    rows = [(i, 0 if i % 3 else i) for i in range(900)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id int, k int")
    table = spark.createDataFrame([(k, f"t{k}") for k in range(0, 900, 6)], "k int, t string")
    got = {r.id: r.t for r in skew.look_up(df, table, "k").collect()}
    assert got == {i: (f"t{k}" if k is not None and k % 6 == 0 else None) for i, k in rows}


# ------------------------------------------------------------------ DP, policy, SQL guard
def test_dp_results_stay_in_bounds_and_reject_bad_requests(spark):
    df = spark.range(1000).select((F.col("id") % 100).cast("double").alias("v"))
    for kind, low, high in (("mean", 0, 100), ("variance", 0, 2500), ("std", 0, 50), ("sum", 0, 100000)):
        for q in range(5):
            got = dp.dp_aggregate(df, "v", kind, 0, 100, "s", f"q{q}", degradation=10).first().result
            assert low <= got <= high
    gaps = df.withColumn("v", F.when(F.col("v") > 50, F.col("v")))  # unknown values do not count as zeros
    exact = gaps.agg(F.avg("v")).first()[0]
    near = dp.dp_aggregate(gaps, "v", "mean", 0, 100, "s", "q", degradation=1e-6).first().result
    assert near == pytest.approx(exact, abs=0.01)
    assert dp.dp_aggregate(df.where("v < 0"), "v", "mean", 0, 100, "s", "q").first().result is not None
    with pytest.raises(ValueError):
        dp.dp_aggregate(df, "v", "median", 0, 100, "s", "q")
    request = {"query_id": "q", "table_name": "t", "field_name": "v", "query_type": "sum"}
    assert dp.dp_query({"t": df}, request, 9, "s").first().error == "BUDGET_EXHAUSTED"
    assert dp.dp_query({"t": df}, {**request, "query_type": "median"}, 9, "s").first().error == "Invalid query type"
    assert dp.dp_query({"t": df}, {**request, "table_name": ""}, 9, "s").first().error == "table_name required"
    with pytest.raises(ValueError):
        dp.apply_filters(df, {"v": {"operator": "like", "value": 1}})


def test_field_sensitivity_takes_the_first_word():
    assert dp.field_sensitivity("wage") == (1.5, 0, 120)  # contains "age"
    assert dp.field_sensitivity("monthlyincome")[2] == 1000000
    assert dp.field_sensitivity("xyz", 50) == (5.0, 0, 1000) and dp.field_sensitivity("xyz") == (1.0, 0, 1000)


def test_policies(spark):
    scores = spark.createDataFrame([("g", 85), ("h", 10)], "g string, risk_score int")
    rows = {(r.g, r.policy): r for r in policy.compliance(scores).collect()}
    assert len(rows) == 16
    assert len(rows["g", "minimal"].issues) == 3 and rows["g", "maximum"].is_compliant
    assert rows["h", "minimal"].is_compliant
    asked = spark.createDataFrame([("STRICT",), ("unknown",)], "policy string")
    assert sorted(r.epsilon for r in policy.resolve_policies(asked).collect()) == [1.0, 2.0]
    assert policy.custom_policy(0.9, 4).level == "STRICT"


def test_rules_per_kind_of_column(spark):
    df = spark.createDataFrame(
        [("home_email", "hashing"), ("user_password", "masking"), ("other", "masking")], "column string, mechanism string"
    )
    got = {r.column: (r.rule, r.method_allowed) for r in policy.column_rule_check(df).collect()}
    assert got == {"home_email": ("email", True), "user_password": ("password", False), "other": (None, None)}


def test_report_groups_columns_by_type(spark):
    found = spark.range(50).select(F.col("id").alias("total"), F.col("id").alias("cost"), F.lit("a@b.co").alias("email"))
    got = {r.type: [d["column"] for d in r.details] for r in classify.report(classify.classify_columns(found)).collect()}
    assert got == {"numeric": ["cost", "total"], "identifier": ["email"]}


@pytest.mark.parametrize(
    "text", ["DROP TABLE x", "SELECT updated_at FROM t", "SELECT 1; SELECT 2", "SELECT 1 UNION SELECT 2"]
)
def test_guarded_sql_refuses(spark, text):
    with pytest.raises(ValueError):
        tables.guarded_sql(spark, text)


def test_guarded_sql_reads_everything_unless_capped_in_order(spark):
    spark.range(500).createOrReplaceTempView("many")
    assert tables.guarded_sql(spark, "SELECT id FROM many;").count() == 500
    assert tables.guarded_sql(spark, "SELECT id FROM many LIMIT 300").count() == 300
    with pytest.raises(ValueError):
        tables.guarded_sql(spark, "SELECT id FROM many", cap=3)
    first = tables.guarded_sql(spark, "SELECT id FROM many", cap=3, order_by=["id"])
    assert sorted(r.id for r in first.collect()) == [0, 1, 2]


def test_layout_is_decided_per_file(spark, tmp_path):
    household, person = "H" * 128, "P" * 300
    (tmp_path / "a.txt").write_bytes(("\n" + household + "\n").encode("latin-1"))
    (tmp_path / "b.txt").write_bytes((person + "\n" + "Ö" * 300 + "\n").encode("latin-1"))
    both = files.read_fixed_width(spark, str(tmp_path))
    rows = {(r["FILE_ID"], r["HH_SIZE"], r["AGE"]) for r in both.collect()}
    assert rows == {("HHHHH", "HH", None), ("PPPPP", None, "PPP"), ("ÖÖÖÖÖ", None, "ÖÖÖ")}
    alone = files.read_fixed_width(spark, str(tmp_path / "a.txt"))
    assert alone.columns == [f.name for f in files.household_layout()]


# ------------------------------------------------------------------ nothing lost, nothing leaked
def test_unlisted_columns_are_not_released(spark):
    df = spark.createDataFrame([(i, f"u{i}@x.org", f"Name {i}") for i in range(20)], "id long, email string, full_name string")
    released, plan = privatize.privatize(df, "s", "id", columns=["id", "email"])
    assert released.columns == ["id", "email"]
    kept = privatize.apply_plan(df, plan, "s", "id", keep=["full_name"])
    assert kept.columns == df.columns


def test_null_row_keys_are_refused(spark):
    df = spark.createDataFrame([(None, 5), (1, 6)], "id long, age int")
    with pytest.raises(Exception, match="must not be null"):
        privatize.privatize(df, "s", "id")[0].collect()


def test_dotted_column_names(spark):
    df = spark.createDataFrame([(i, f"c{i % 7}", '{"name": "x"}', i * 1.0) for i in range(30)], "id long, `a.b` string, `d.data` string, `n.o` double")
    treated = anonymize.k_anonymize(df, "a.b", 10, "s", "id")
    assert treated.columns == df.columns and treated.count() == 30
    assert anonymize.generalize_categories(df, "a.b").columns == df.columns
    assert anonymize.release_numeric(df, "n.o", "s", "id").count() == 30
    assert json_rewrite.anonymize_json(df, "d.data", "s", "id").columns == df.columns
    assert privatize.privatize(df, "s", "id")[0].columns == df.columns


def test_whole_decimals_score_like_integers(spark):
    whole = spark.createDataFrame([(9876543210, 30)], "phone long, age int")
    decimals = whole.selectExpr("CAST(phone AS DECIMAL(10,0)) AS phone", "CAST(age AS DECIMAL(3,0)) AS age")
    score = [risk.dataset_risk(df).select("risk_score").first()[0] for df in (whole, decimals)]
    assert score[0] == score[1] > 0


def test_nan_is_unknown_to_dp(spark):
    nan = float("nan")
    with_nan = spark.createDataFrame([(1.0,), (nan,), (3.0,), (None,)], "x double")
    without = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    for kind in ("count", "mean", "sum", "variance"):
        found = [dp.dp_aggregate(df, "x", kind, 0.0, 10.0, "s", "q").first()["result"] for df in (with_nan, without)]
        assert found[0] == found[1]


def test_unknown_scores_keep_their_row(spark):
    scores = spark.createDataFrame([("a", 80.0), ("b", None)], "who string, risk_score double")
    checked = policy.compliance(scores)
    known = checked.where("who = 'a'").count()
    unknown = checked.where("who = 'b'").collect()
    assert known == len(unknown) > 0
    assert all(r["is_compliant"] is None and r["issues"] is None for r in unknown)


def test_release_summary_checks_every_sensitive_column(spark):
    df = spark.createDataFrame([(i % 3, i, 1) for i in range(12)], "q int, varied int, uniform int")
    plan = privatize.PrivacyPlan(50, privatize.Decimal(1), 5, False, 12, l_diversity=True)
    kinds = [("q", "quasi_identifier"), ("varied", "sensitive"), ("uniform", "sensitive")]
    plan.columns = [privatize.ColumnPlan(n, i, t, "", "", "none", False) for i, (n, t) in enumerate(kinds)]
    assert privatize.release_summary(df, df, plan).first()["l_violations"] == 3


# ------------------------------------------------------------------ layouts
def test_layouts_are_gapless():
    for layout, n, end in ((files.household_layout(), 39, 128), (files.person_layout(), 101, 267)):
        assert len(layout) == n and layout[-1].end == end
        assert all(b.start == a.end + 1 for a, b in zip(layout, layout[1:]))


def test_latin1_and_crlf_lines(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes("AB é  x\r\n\r\nCD\r\n".encode("latin-1"))
    layout = files.widths_layout([("a", 2), ("b", 3), ("c", 3)])
    rows = files.read_fixed_width(spark, str(tmp_path / "f.txt"), layout).collect()
    assert [tuple(r) for r in rows] == [("AB", "é", "x"), ("CD", "", "")]


def test_json_keeps_its_shape(spark):
    documents = [
        '{"VOID":"secretname","a":null,"name":"Bob"}',
        '{"Name":"Ann","name":"Bob","k":1,"OBJECT":{"x":true}}',
        '{"k":"free","list":[1,null,"t"],"it\'s":"v"}',
        '{"k":{"inner":"x"},"list":[],"empty":{}}',
    ]
    df = spark.createDataFrame(list(enumerate(documents)), "id long, d string")
    rows = {r.id: json.loads(r.d) for r in json_rewrite.anonymize_json(df, "d", "s", "id").collect()}
    for i, text in enumerate(documents):
        assert list(sorted(rows[i])) == sorted(json.loads(text))
    assert rows[0]["a"] is None and len(rows[0]["VOID"]) == 10 and rows[0]["name"].startswith("Person_")
    assert rows[1]["Name"].startswith("Person_") and isinstance(rows[1]["k"], int)
    assert rows[2]["k"] == "free" and rows[2]["list"][1] is None and isinstance(rows[2]["list"][0], int)
    assert isinstance(rows[3]["k"], str) and "inner" not in rows[3]["k"] and rows[3]["empty"] == {}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_drivers_are_kept_in_a_hash_table(spark):
    rows = [(None, "a@b.org", "x"), (-5, None, "y"), (7, "c@d.org", None), (-5, "e@f.org", "z"), (3, None, "w")]
    df = spark.createDataFrame(rows, "id bigint, email string, full_name string")
    found = risk.top_drivers(df, ["id"])
    assert "SortAggregate" not in _plan(found)
    columns = ["email", "full_name"]
    by_struct = risk.top_drivers(df.withColumn("zero", F.lit(0)), ["id", "zero"], columns)
    assert risk.top_drivers(df, ["id"], columns).collect() == by_struct.collect()


def test_values_are_dealt_before_they_are_counted(many_partitions):
    rows = [(k, "same" if k % 3 else f"v{k}") for k in range(3000)]
    df = many_partitions.createDataFrame(rows, "id bigint, label string").coalesce(1)
    found = classify.profile_columns(df)
    plan = _plan(found)
    # the first exchange below the counting comes before any table of values
    scan = plan.rindex("Generate inline")
    assert "HashAggregate" not in plan[plan.rindex("Exchange hashpartitioning", 0, scan) : scan]
    assert {r.column: (r.n, r.distinct) for r in found.collect()} == {"id": (3000, 3000), "label": (3000, 1001)}
