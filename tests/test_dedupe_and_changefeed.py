import random
from datetime import datetime, timedelta

import pytest

from keyloom.operators.changefeed import as_changes, fold_changes, live
from keyloom.operators.dedupe import first_copies, new_messages, repeated
from pyspark.sql import functions as F

T0 = datetime(2025, 1, 1)
MSG = "store string, ident bigint, at timestamp_ntz, batch bigint, body string"


def messages():
    rng = random.Random(1)
    out = [(rng.choice(["a", "b", None]), rng.choice([None, *range(12)]), rng.choice([None, *(T0 + timedelta(hours=h) for h in range(4))]), rng.choice([None, 1, 2]), rng.choice([None, "", "x", "y" * 5000])) for _ in range(300)]
    return out + out[:40]


def key(m):
    return (m[2] is None, m[2] or T0, m[3] is None, m[3] or 0, m[4] is None, m[4] or "")


def test_first_copies(spark):
    data = messages()
    want = {}
    for m in data:
        if m[:2] not in want or key(m) < key(want[m[:2]]):
            want[m[:2]] = m
    df = spark.createDataFrame(data, MSG).withColumn("rank", F.lit(0))
    got = first_copies(df, ["store", "ident"], "at", ["batch", "body"])
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == sorted(want.values(), key=repr)
    many = {k for k in want if sum(m[:2] == k for m in data) > 1}
    assert {tuple(r) for r in repeated(df, ["store", "ident"], "at", ["batch"]).collect()} == many


def test_new_messages_skip_stored(spark):
    df = spark.createDataFrame(messages(), MSG)
    stored = df.where("ident < 6 or ident is null").select("store", "ident")
    got = {(r.store, r.ident) for r in new_messages(df, stored, ["store", "ident"], "at").collect()}
    assert got == {m[:2] for m in messages() if m[1] is not None and m[1] >= 6}
    assert new_messages(df, df.limit(0), ["store", "ident"], "at").count() == len({m[:2] for m in messages()})
    assert first_copies(df.limit(0), ["store"], "at").count() == 0


FEED = "k string, seq bigint, op string, v string"


def test_copies_that_differ_in_other_columns_meet(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "c", 3), (2, "x", 1), (None, "n", 1), (None, "m", 2)], "id int, k string, at int")
    assert {tuple(r) for r in repeated(df, ["id"], "at", [], ["k"]).collect()} == {(1, "a"), (None, "n")}


def feed():
    rng = random.Random(2)
    out = [(rng.choice(["a", "b", "c", "A", "a ", "", None]), s, rng.choice(["put", "PUT", "Put", "1", "delete", "Delete", "2", "noop", None]), rng.choice([None, "", "v"])) for s in range(1, 200)]
    out += [("z", None, "put", "x")]
    rng.shuffle(out)
    return out + out[:60]


def state(rows):
    best = {}
    for k, s, op, v in rows:
        p = {"put": True, "1": True, "delete": False, "2": False}.get((op or "").lower())
        if s is not None and p is not None and (k not in best or s > best[k][0]):
            best[k] = (s, p, v if p else None)
    return best


@pytest.mark.parametrize("payload", [[], ["v"]])
def test_fold_is_the_same_in_any_order_and_split(spark, payload):
    rows = feed()
    want = {(k, s, p, *([v] if payload else [])) for k, (s, p, v) in state(rows).items()}
    df = as_changes(spark.createDataFrame(rows, FEED), ["k"], "seq", "op", payload)
    assert {tuple(r) for r in fold_changes(df, ["k"], payload).collect()} == want
    base = fold_changes(df.where("kl_seq > 100"), ["k"], payload)
    assert {tuple(r) for r in fold_changes(df.where("kl_seq <= 100"), ["k"], payload, base=base).collect()} == want
    assert live(fold_changes(df, ["k"], payload)).count() == sum(w[2] for w in want)


def test_tombstone_outlives_late_put(spark):
    base = fold_changes(as_changes(spark.createDataFrame([("a", 9, "delete", None)], FEED), ["k"], "seq", "op"), ["k"])
    late = as_changes(spark.createDataFrame([("a", 3, "put", "old")], FEED), ["k"], "seq", "op")
    assert live(fold_changes(late, ["k"], base=base)).count() == 0


def test_ties_empty_and_large_sequences(spark):
    tie = as_changes(spark.createDataFrame([("a", 1, "put", "x"), ("a", 1, "delete", None), ("n", -5, "put", "x")], FEED), ["k"], "seq", "op")
    assert {(r.k, r.kl_seq, r.kl_live) for r in fold_changes(tie, ["k"]).collect()} == {("a", 1, True), ("n", -5, True)}
    assert fold_changes(tie.limit(0), ["k"]).count() == 0
    top = (1 << 63) - 1
    big = as_changes(spark.createDataFrame([("a", top, "put", None), ("a", top - 1, "delete", None), ("b", -top - 1, "delete", None), ("c", 1 << 62, "put", None), ("c", top, "delete", None)], FEED), ["k"], "seq", "op")
    assert {(r.k, r.kl_seq, r.kl_live) for r in fold_changes(big, ["k"]).collect()} == {("a", top, True), ("b", -top - 1, False), ("c", top, False)}
