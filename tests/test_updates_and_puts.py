import json

import pytest

from keyloom.operators import documents as D
from pyspark.sql import functions as F

U = D.Update


def test_paths_are_made_and_steps_run_in_order(spark):
    df = spark.createDataFrame([("a", ("x", 1), 5), ("b", None, None), ("c", ("z", None), 2**31 - 1)], "id string, p struct<email:string,n:int>, age int")
    steps = [U("set", "p.email", "new"), U("set", "p.at.town", F.concat(F.lit("t-"), "id")), U("increment", "p.n", 2), U("increment", "p.seen", 3), U("increment", "hits", 1), U("increment", "hits", 1), U("increment", "age", 1), U("unset", "p.nothing")]
    got = {r.id: r for r in D.update_documents(df, "id", steps).collect()}
    assert (got["a"].p.email, got["a"].p.at.town, got["a"].p.n, got["a"].p.seen, got["a"].hits, got["a"].age) == ("new", "t-a", 3, 3, 2, 6)
    assert (got["b"].p.email, got["b"].p.n, got["b"].age, got["b"].update_error) == ("new", 2, 1, None)
    # A document that would overflow stays as it was.
    assert (got["c"].p.email, got["c"].p.at, got["c"].hits, got["c"].age, got["c"].update_error) == ("z", None, None, 2**31 - 1, "age: overflow")
    later = D.update_documents(df, "id", [U("set", "age", 7), U("unset", "age"), U("set", "age", 8)], where=F.col("id") == "a")
    assert {r.id: (r.age, r.update_error) for r in later.collect()} == {"a": (8, None), "b": (None, None), "c": (2**31 - 1, None)}


def test_what_an_update_must_not_do(spark):
    df = spark.createDataFrame([("a", "x", 2**63 - 1, 1.5)], "id string, email string, n bigint, f double")
    for steps, rule in ([U("set", "id", "b")], "primary_key_update"), ([U("set", "email.x", 1)], "path_not_object"), ([U("increment", "email", 1)], "not_incrementable"), ([U("drop", "email")], "unknown_update"):
        with pytest.raises(D.SchemaError) as e:
            D.update_documents(df, "id", steps)
        assert e.value.rule == rule
    r = D.update_documents(df, "id", [U("unset", "email"), U("increment", "f", 2)], required=["email"]).first()
    assert (r.email, r.f, r.update_error) == ("x", 1.5, "email: missing")
    r = D.update_documents(df, "id", [U("increment", "n", 1)]).first()
    assert (r.n, r.update_error) == (2**63 - 1, "n: overflow")
    assert D.update_documents(df, "id", [U("increment", "n", -1), U("increment", "n", 1), U("increment", "f", 2)]).first()[2:4] == (2**63 - 1, 3.5)
    with pytest.raises(Exception, match="overflow"):
        D.partial_update(df, "id", increment={"n": 1}).collect()
    assert D.update_documents(df.limit(0), "id", [U("set", "q", 1)]).count() == 0


def test_create_only_takes_one_of_a_batch(spark):
    current = spark.createDataFrame([("a", 0)], "k string, n int")
    batch = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2), ("c", 4), (None, 5), (None, 6)], "k string, n int")
    new, old = D.create_only(current, batch, "k", ["n"])
    assert sorted(map(tuple, new.collect()), key=repr) == sorted([("b", 2), ("c", 4), (None, 5)], key=repr)
    assert sorted(map(tuple, old.collect()), key=repr) == sorted([("a", 1), ("b", 3), (None, 6)], key=repr)


def test_put_documents(spark):
    s, i = D.FieldType("string"), D.FieldType("int32")
    schema = D.Schema("users", (D.Field("id", s, primary=True, indexed=True), D.Field("email", s, indexed=True, unique=True), D.Field("age", i, optional=True)))
    doc = lambda **kw: json.dumps(kw)
    current = spark.createDataFrame([("a", doc(id="a", email="x"), 3), ("b", doc(id="b", email="y"), 1)], "key string, document string, version bigint")
    batch = [
        ("c", doc(id="c", email="x")), ("c", doc(id="c", email="z")), ("d", doc(id="d", email="z")), ("a", doc(id="a", email="x", age=4)), ("a", doc(id="a", email="x", age="4")),
        ("e", doc(id="f", email="q")), ("b", None), ("g", "{"), ("a", doc(id="a", email="w")), ("h", None), ("i", doc(id="i", email="p", more=[[1]])),
    ]
    state, rejected = D.put_documents(current, spark.createDataFrame([(k, d, n) for n, (k, d) in enumerate(batch)], "key string, document string, seq int"), schema)
    assert {r.key: (json.loads(r.document)["email"], r.version) for r in state.collect()} == {"a": ("w", 5), "c": ("z", 1), "i": ("p", 1)}
    assert {r.seq: r.reason for r in rejected.collect()} == {0: "email: not unique", 2: "email: not unique", 4: "age: type", 5: "key: differs", 7: "document: malformed"}
