"""Documents of all collections against all their declared fields."""

import json

import __spark_entry__ as entry
import pytest

FLAGS = ["primary", "optional", "indexed", "stored", "unique", "sort", "range_index"]
FIELDS = [
    ("users", "id", "string", ["primary", "stored"]), ("users", "age", "int32", ["optional", "stored"]), ("users", "created_at", "int64", ["stored"]),
    ("users", "profile", '{"object":[{"name":"name","type":"string"},{"name":"contacts","type":{"array":{"object":[{"name":"kind","type":"string"},{"name":"ok","type":"bool","optional":true}]}},"optional":true}]}', ["stored"]),
    ("users", "tags", "string[]", ["optional", "stored"]), ("firms", "id", "string", ["primary", "stored"]), ("firms", "rate", "float", ["stored"]), ("firms", "free", "json", ["stored"]),
]
USER = {"id": "u", "created_at": 1, "profile": {"name": "n"}}


@pytest.fixture
def validate(spark, tmp_path):
    """Errors by LSN that the query finds in (collection, document) pairs."""
    ddl = "collection string, name string, field_type string, " + ", ".join(f"is_{f} boolean" for f in FLAGS) + ", ref_collection string, ref_field string"
    rows = [(c, n, t, *[f in flags for f in FLAGS], None, None) for c, n, t, flags in FIELDS]
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/schema_fields.parquet")

    def run(docs):
        data = [("s", i, c, d if d is None or isinstance(d, str) else json.dumps(d)) for i, (c, d) in enumerate(docs)]
        spark.createDataFrame(data, "store_id string, lsn bigint, collection string, document string").write.mode("overwrite").parquet(f"{tmp_path}/schema_flush.parquet")
        return {r.lsn: r.errors for r in entry.queries()["document_validation"](spark, str(tmp_path)).collect()}

    return run


def test_all_collections_and_fields(validate):
    cases = [
        ("users", USER, ""), ("users", {**USER, "created_at": "1"}, "created_at: type"), ("users", {"id": "u", "created_at": None}, "created_at: null; profile: missing"),
        ("users", {**USER, "age": 2**31, "profile": 5, "tags": "x"}, "age: range; profile: type; tags: type"), ("users", {**USER, "age": None, "tags": []}, ""),
        ("firms", {"id": "f", "rate": 1, "free": [1]}, ""), ("firms", {"id": 1, "rate": "1"}, "free: missing; id: type; rate: type"),
        ("firms", "{", "document: malformed"), ("firms", None, None), ("other", {"id": "x"}, "collection: undeclared"),
    ]
    assert validate([(c, d) for c, d, _ in cases]) == {i: e for i, (_, _, e) in enumerate(cases) if e is not None}


def test_nested_values(validate):
    def user(**over):
        return ("users", {**USER, **over})

    cases = [
        (user(tags=["a", 1, None, "b"]), "tags[1]: type; tags[2]: type"), (user(profile={"name": 3}), "profile.name: type"), (user(profile={}), "profile.name: missing"), (user(profile={"name": None, "contacts": None}), "profile.name: null"),
        (user(profile={"name": "n", "contacts": [{"kind": "k", "ok": "yes"}, 7, {"ok": None, "more": 1}]}), "profile.contacts[0].ok: type; profile.contacts[1]: type; profile.contacts[2].kind: missing"),
        (user(profile={"name": "n", "contacts": {"kind": "k"}}), "profile.contacts: type"), (user(profile={"name": "n", "contacts": []}), ""), (user(profile=json.dumps({"name": "n"})), "profile: type"),
        (user(created_at=True), "created_at: type"), (user(created_at=2**63), "created_at: type"), (user(created_at=1.0), "created_at: type"), (user(age=False), "age: type"),
        (("firms", '{"id":"f","free":null,"rate":1e999}'), "rate: not_finite"), (("firms", '{"id":"f","free":1,"rate":1' + "0" * 5000 + "}"), "rate: not_finite"), (("firms", '{"id":"f","free":1,"rate":NaN}'), "document: malformed"),
        (("firms", '{"id":"f","free":1,"rate":1,"rate":2}'), "document: malformed"), (("firms", "[1]"), "document: type"),
    ]
    assert validate([c for c, _ in cases]) == {i: e for i, (_, e) in enumerate(cases)}
