import random
from datetime import datetime, timedelta

import pytest

from keyloom.functions.keys import key_parts
from keyloom.operators.orphans import declared_references, key_runs, orphans, parent_summary
from pyspark.sql import functions as F

REF = "ref_collection string, reference_key string, arrived_at timestamp_ntz, tag int"
PAR = "collection string, id string, version bigint, tombstone boolean, arrived_at timestamp_ntz"
T0 = datetime(2025, 1, 1)


def day(n):
    return T0 + timedelta(days=n)


def brute(refs, parents):
    out = []
    for r in refs:
        coll, key, t, _ = r
        if key is None:
            continue
        own = [(p[2] or 0, bool(p[3]), p[4] or datetime(9999, 12, 31)) for p in parents if p[0] == coll and p[1] == key]
        last = max(((v, d) for v, d, _ in own), default=None)
        then = max(((v, d) for v, d, a in own if t is not None and a <= t), default=None)
        if last is None or last[1] or (t is not None and (then is None or then[1])):
            out.append(r)
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(5)
    keys = [f"u{n:06d}" for n in [*range(40), *range(1020, 1030), 5000]] + ["u7", "u007", "U000001", "u000001 ", "plain", "", "x" * 3000 + "12", "9" * 30]
    parents, refs = [], []
    for k in keys:
        for _ in range(rng.choice([0, 1, 1, 1, 2, 4])):
            parents.append((rng.choice(["users", "firms"]), k, rng.choice([1, 2, 3, None]), rng.choice([True, False, False, None]), rng.choice([None, *map(day, range(8))])))
    parents += parents[:20] + [("users", None, 1, False, day(0))]
    for i in range(600):
        refs.append((rng.choice(["users", "firms", "void", None]), rng.choice([None, *keys, "u000041", "u001031", "zzz"]), rng.choice([None, *map(day, range(9))]), i % 50))
    refs += refs[:30]
    got = orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(refs, parents)


def test_runs_compress(spark):
    parents = spark.createDataFrame([("users", f"u{n:05d}", 1, False, day(0)) for n in [*range(10, 20), 25, *range(1020, 1030)]], PAR)
    runs = sorted((r.block, r.kl_start, r.kl_end) for r in key_runs(parent_summary(parents)).collect())
    assert runs == [(0, 10, 19), (0, 25, 25), (0, 1020, 1023), (1, 1024, 1029)]


def test_empty_and_clashing_names(spark):
    refs = spark.createDataFrame([("users", "u1", day(1), 1)], REF).withColumn("collection", F.lit("c")).withColumn("prefix", F.lit("p")).withColumn("id", F.lit("i")).withColumn("block", F.lit(3))
    none = spark.createDataFrame([], PAR)
    assert orphans(refs, none).columns == refs.columns
    assert orphans(refs, none).count() == 1
    assert orphans(refs.limit(0), none).count() == 0


@pytest.mark.parametrize("key", ["", "u0001", "0001", "a", "u1b", "12345678901234567890", "u 1", "é7", "line\n12"])
def test_key_parts_are_reversible(spark, key):
    p = key_parts(F.col("k"))
    r = spark.createDataFrame([(key,)], "k string").select(p["prefix"].alias("p"), p["width"].alias("w"), p["number"].alias("n")).first()
    assert r.p + (str(r.n).zfill(r.w) if r.w else "") == key


def test_only_declared_fields_refer(spark):
    fields = spark.createDataFrame([("projects", "owner_id", "users"), ("projects", "mentor_id", None), ("users", "company_id", "companies")], "collection string, name string, ref_collection string")
    inc = spark.createDataFrame([("projects", "p1", "owner_id", "u1", day(0)), ("projects", "p1", "mentor_id", "u1", day(0)), ("projects", "p2", "owner_id", None, day(0))], "collection string, primary_key string, field string, reference_key string, arrived_at timestamp_ntz")
    users = spark.createDataFrame([("u1", "c1", day(0))], "id string, company_id string, arrived_at timestamp_ntz")
    got = declared_references({"users": (users, ["company_id"])}, inc, fields)
    assert sorted((r.collection, r.rec_key, r.ref_field, r.ref_collection) for r in got.collect()) == [("projects", "p1", "owner_id", "users"), ("users", "u1", "company_id", "companies")]
