import json
import os

import __spark_entry__ as entry
import pytest
from keyloom.operators.nested import Flattener, compile_fields, flatten, object_paths, one_copy, route, subtype_table
from pyspark.sql import functions as F

SCHEMA = compile_fields([
    ("c", "id", "string"), ("c", "tags", "string[]"), ("c", "free", "json"),
    ("c", "items", '{"array":{"object":[{"name":"n","type":"int32"},{"name":"in","type":{"object":[{"name":"rows","type":{"array":{"object":[{"name":"v","type":"float","optional":true}]}}}]}}]}}'),
    ("c", "grid", '{"array":{"array":{"object":[{"name":"x","type":"int32"}]}}}'),
])
DOC = "store_id string, lsn bigint, collection string, document string, arrived_at timestamp_ntz"


def found(doc):
    return [(r[0], r[1]) for r in Flattener(SCHEMA["c"]).rows(doc if doc is None or isinstance(doc, str) else json.dumps(doc))]


def test_positions_and_parents():
    doc = {"items": [{"n": 1, "in": {"rows": [{"v": 1}, None, {"v": 2}]}}, 5, {"n": 2}]}
    assert found(doc) == [("items", "0"), ("items.in.rows", "0.0"), ("items.in.rows", "0.2"), ("items", "2")]
    links = {(r[0], r[1]): (r[2], r[3]) for r in Flattener(SCHEMA["c"]).rows(json.dumps(doc))}
    assert links[("items.in.rows", "0.2")] == ("items", "0") and links[("items", "2")] == ("", "")


def test_object_for_array_and_text_for_values():
    assert found({"items": {"n": 1}}) == [("items", "0")]
    assert found({"items": json.dumps([{"n": 1}, json.dumps({"in": json.dumps({"rows": json.dumps({"v": 1})})})])}) == [("items", "0"), ("items", "1"), ("items.in.rows", "1.0")]
    assert found({"items": json.dumps(json.dumps([{"n": 1}]))}) == [("items", "0")]
    assert found({"items": "no json [", "free": [{"a": 1}], "other": [{"b": 1}]}) == []
    assert found({"grid": [[{"x": 1}, {"x": 2}], "x", [{"x": 3}]]}) == [("grid", "0.0"), ("grid", "0.1"), ("grid", "2.0")]


def test_ill_formed_documents_give_nothing():
    for text in (None, "", "{", '{"items":[{"n":NaN}]}', '{"items":[{"n":1}]} x', "[1]", "null", '"text"', "[" * 100000):
        assert found(text) == []


def test_text_in_text_is_read_however_often():
    doc = {"items": [{"n": 1}]}
    for _ in range(20):
        doc["items"] = json.dumps(doc["items"])
        if len(doc["items"]) > 1 << 22:
            break
        assert found(doc) == [("items", "0")]
    text = json.dumps([{"n": 1}])
    for times in range(17):
        text = json.dumps(text)
    assert found('{"items":' + text + "}") == [("items", "0")]


def test_depth_of_other_fields_does_not_matter(spark):
    for deep in ("[" * 200000 + "]" * 200000, '{"a":' * 3000 + "1" + "}" * 3000):
        text = '{"items":[{"n":1,"more":' + deep + "}],\"other\":" + deep + "}"
        assert found(text) == [("items", "0")]
        kids = flatten(spark.createDataFrame([("s", 1, "c", text, None)], DOC), SCHEMA, ["lsn"])
        row = subtype_table(kids, SCHEMA, "c", "items", ["lsn"]).first()
        assert row["n"] == 1 and json.loads(row["payload"])["more"] == deep
    assert found('{"items":[{"n":1}],"other":' + "[" * 200000 + "}") == []


def test_long_numbers():
    assert found('{"items":[{"n":' + "9" * 6000 + "}]}") == [("items", "0")]


def test_equal_shapes_share_a_state():
    walk = Flattener(SCHEMA["c"])
    shapes = [r[4] for r in walk.rows(json.dumps({"items": [{"n": 1}, {"n": 9}, {"n": "x"}, {"n": 1, "extra": 0}, {"in": {"rows": []}}]}))]
    assert shapes[0] == shapes[1] and len(set(shapes)) == 4
    assert Flattener(SCHEMA["c"]).rows(json.dumps({"items": [{"n": 7}]}))[0][4] == shapes[0]


def test_flatten_and_typed_tables(spark):
    doc = json.dumps({"items": [{"n": 1, "in": {"rows": [{"v": 1.5}, {"v": "bad"}, {}]}}]})
    data = [("s", 1, "c", doc, None), ("s", 1, "c", " " + doc, None), ("s", 2, "c", None, None), ("s", 3, "zz", doc, None), (None, None, None, None, None), ("s", 4, "c", "\ud83d bad".encode("utf-8", "replace").decode(), None)]
    df = spark.createDataFrame(data, DOC).withColumn("path", F.lit("clash")).withColumn("shape", F.lit(1))
    kids = flatten(one_copy(df, ["store_id", "lsn"]), SCHEMA, ["store_id", "lsn"])
    assert kids.count() == 4
    table = subtype_table(kids, SCHEMA, "c", "items.in.rows", ["store_id", "lsn"])
    assert sorted((r.ordinals, r.parent_ordinals, r.v) for r in table.collect()) == [("0.0", "0", 1.5), ("0.1", "0", None), ("0.2", "0", None)]
    one = table.first()["shape"]
    assert subtype_table(kids, SCHEMA, "c", "items.in.rows", ["lsn"], shape=one).count() >= 1
    assert flatten(df.limit(0), SCHEMA, ["lsn"]).count() == 0


def test_paths_of_a_schema():
    assert [p for p, _ in object_paths(SCHEMA["c"])] == ["items", "items.in.rows", "grid"]


FLAT = compile_fields([("c", "items", json.dumps({"array": {"object": [
    {"name": "n", "type": "int32"}, {"name": "marks", "type": "int32[]"}, {"name": "grid", "type": {"array": {"array": "string"}}},
    {"name": "terms", "type": {"object": [{"name": "currency", "type": "string"}, {"name": "geo", "type": {"object": [{"name": "lat", "type": "float"}]}}, {"name": "rows", "type": {"array": {"object": [{"name": "v", "type": "int32"}]}}}]}},
]}}))])


def test_tables_keep_values_of_inline_objects_and_misfits(spark):
    items = [
        {"n": 1, "marks": [1, 2], "grid": [["a"], []], "terms": {"currency": "c", "geo": {"lat": 1.5}, "rows": [{"v": 1}, 7, None]}},
        {"n": "x", "marks": "[3]", "terms": json.dumps({"currency": "d", "geo": "none"})}, {"marks": [1, "y"], "terms": 5, "more": 1, "terms.currency": "no"}, {"n": 3, "terms": {"rows": "z", "x": [1]}},
    ]
    df = spark.createDataFrame([("s", 1, "c", json.dumps({"items": items}), None)], DOC)
    kids = flatten(df, FLAT, ["lsn"])
    got = {r.ordinals: r for r in subtype_table(kids, FLAT, "c", "items", ["lsn"]).collect()}
    assert [(r["n"], r["terms.currency"], r["terms.geo.lat"]) for _, r in sorted(got.items())] == [(1, "c", 1.5), (None, "d", None), (None, None, None), (3, None, None)]
    assert got["0"]["marks"] == [1, 2] and got["0"]["grid"] == [["a"], []] and got["1"]["marks"] == [3]
    assert {k: json.loads(r.payload) for k, r in got.items()} == {
        "0": {"n": 1, "marks": [1, 2], "grid": [["a"], []], "terms.currency": "c", "terms.geo.lat": 1.5, "terms.rows": {"1": 7, "2": None}},
        "1": {"n": "x", "marks": [3], "terms.currency": "d", "terms.geo": "none"}, "2": {"marks": [1, "y"], "terms": 5, "more": 1, '"terms.currency"': "no"}, "3": {"n": 3, "terms.rows": "z", "terms.x": [1]},
    }
    assert [r.v for r in subtype_table(kids, FLAT, "c", "items.terms.rows", ["lsn"]).collect()] == [1]


def test_all_paths_and_variants_are_routed(spark, tmp_path, as_rows):
    items = [{"n": 1, "in": {"rows": [{"v": 1}, {"v": "bad"}]}}, {"n": 2, "in": {"rows": [{}]}}, {"n": 3}]
    df = spark.createDataFrame([("s", 1, "c", json.dumps({"items": items, "grid": [[{"x": 1}], [{"x": 2}]]}), None)], DOC)
    kids = flatten(df, SCHEMA, ["lsn"])
    folder = f"{tmp_path}/routed"
    routed = route(kids, SCHEMA, ["lsn"], folder)
    tables = {at: routed.table(*at) for at in routed.paths()}
    assert as_rows(routed.supertype(), "path", "ordinals") == as_rows(kids, "path", "ordinals")
    assert sorted(tables) == [("c", "grid"), ("c", "items"), ("c", "items.in.rows")]
    link = ["ordinals", "parent_path", "parent_ordinals"]
    assert as_rows(tables["c", "items.in.rows"], *link, "v") == [("0.0", "items", "0", 1.0), ("0.1", "items", "0", None), ("1.0", "items", "1", None)]
    assert as_rows(tables["c", "grid"], *link, "x") == [("0.0", "", "", 1), ("1.0", "", "", 2)] and as_rows(tables["c", "items"], "n") == [(1,), (2,), (3,)]
    for (c, p), t in tables.items():
        shapes = [r["shape"] for r in t.select("shape").distinct().collect()]
        parts = [as_rows(routed.table(c, p, s), "ordinals") for s in shapes]
        assert sorted(sum(parts, [])) == as_rows(t, "ordinals") and len(shapes) == {"items": 3, "items.in.rows": 3, "grid": 1}[p]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_routed_rows_are_all_rows(spark, as_rows):
    rows = {name: entry.queries()[name](spark, "/root/testdata/sf0.001") for name in ("p4_routed_rows", "p4_found")}
    ident = ["store_id", "lsn", "path", "ordinals"]
    assert as_rows(rows["p4_routed_rows"], *ident) == as_rows(rows["p4_found"], *ident)
