"""JSON columns with objects, lists and plain values, and documents whose keys are data."""

import json

from veilframe.operators import json_rewrite
from veilframe.sources import tables

TEXTS = [
    '{"name":"Bob","email":"bob@x.org","n":5}', " [1,2]", "5", '"text"', "null", None, "no json", "{}", "[]",
    '\n{"name":{"first":"Al"},"n":[1,{"city":"Rome"}]}', '{"u17":{"u18":{"salary":100000,"age":30,"ok":true,"void":null}}}',
]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "id int, data string")


def test_each_kind_is_treated_by_itself(spark):
    rows = {r.id: r.data for r in json_rewrite.anonymize_json(frame(spark), "data", "s", "id").collect()}
    alone = {r.id: r.data for r in json_rewrite.anonymize_json(frame(spark, TEXTS[:1]), "data", "s", "id").collect()}
    first = json.loads(rows[0])
    assert first["name"].startswith("Person_") and first["email"] == "bo*@x.org" and first == json.loads(alone[0])
    assert len(json.loads(rows[1])) == 2 and rows[4] == "null" and rows[5] is None
    assert len(rows[2]) == 1 and len(rows[3]) == len('"text"') and rows[3] != '"text"' and "no json" not in rows[6]
    assert rows[7] == "{}" and rows[8] == "[]"


def test_keys_that_are_data(spark):
    df = frame(spark)
    assert json_rewrite.json_depth(df, "data") == 3
    assert json_rewrite.json_depth(frame(spark, ['"{[{"', "x", '{"a\\"[[[":1}']), "data") == 1
    rows = {r.id: r.data for r in json_rewrite.anonymize_json_ragged(df, "data", "s", "id").collect()}
    first = json.loads(rows[0])
    assert list(first) == ["email", "n", "name"] or set(first) == {"name", "email", "n"}
    assert first["name"].startswith("Person_") and first["email"] == "bo*@x.org" and abs(first["n"] - 5) <= 3
    mixed = json.loads(rows[9])
    assert mixed["name"]["first"].startswith("Person_") and mixed["n"][1]["city"] == "Rome"
    deep = json.loads(rows[10])["u17"]["u18"]
    assert 500 <= abs(deep["salary"] - 100000) <= 1500 and abs(deep["age"] - 30) <= 3 and deep["void"] is None
    assert rows[5] is None and rows[7] == "{}" and rows[8] == "[]" and "no json" not in rows[6]
    cut = {r.id: r.data for r in json_rewrite.anonymize_json_ragged(df, "data", "s", "id", depth=1).collect()}
    assert isinstance(json.loads(cut[10])["u17"], str) and "salary" not in cut[10]
    assert json_rewrite.anonymize_json_ragged(df.limit(0), "data", "s", "id").collect() == []


def test_the_plan_does_not_grow_with_the_keys(spark):
    many = frame(spark, [json.dumps({f"user{i}": {f"k{i}": i}}) for i in range(300)])
    few = frame(spark, [json.dumps({"user1": {"k1": 1}})])
    sizes = [
        len(json_rewrite.anonymize_json_ragged(df.repartition(2), "data", "s", "id")._jdf.queryExecution().optimizedPlan().toString())
        for df in (many, few)
    ]
    assert abs(sizes[0] - sizes[1]) < 0.05 * sizes[1]


def test_stored_documents_that_are_no_objects_keep_their_row(spark):
    stored = spark.createDataFrame(
        [("d", 0, '{"a":1}'), ("d", 1, "[1]"), ("d", 2, "5"), ("d", 3, None), ("d", 4, '[{"a":3}]'), ("e", 0, "[2]")],
        "dataset_name string, row_index int, data string",
    )
    found = tables.scan_dataset(stored, "d").orderBy("row_index").collect()
    assert [(r["row_index"], r["a"]) for r in found] == [(0, 1), (1, None), (2, None), (3, None), (4, None)]
    assert tables.scan_dataset(stored, "e").columns == ["row_index"]


def test_values_are_read_once_however_often_they_are_used(spark):
    df = spark.createDataFrame([(1, '{"name": "Bob", "remark": "x"}')], "id bigint, data string")
    found = json_rewrite.anonymize_json(df, "data", "s", "id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$['name']") == 1 and plan.count("$['remark']") == 1
