import random

import pytest

from keyloom.operators import expiry, log, recovery, refs, summary
from pyspark.sql import functions as F

LOG = "lsn bigint, key string, op string, value string"
FIVE = [(1, "user:1", "put", "ada"), (2, "user:2", "put", "grace"), (3, "user:1", "put", "ada-updated"), (4, "user:2", "delete", None), (5, "user:3", "put", "katherine")]


def test_recovery_from_snapshot_and_suffix(spark):
    df = spark.createDataFrame(FIVE, LOG)
    snap = recovery.snapshot_at(df, ["key"], "lsn", 2)
    assert {(r.key, r.value) for r in snap.collect()} == {("user:1", "ada"), ("user:2", "grace")}
    live = recovery.recover(snap, df, ["key"], "lsn", 2)
    assert {(r.key, r.value) for r in live.collect()} == {("user:1", "ada-updated"), ("user:3", "katherine")}
    full = recovery.recover(df.limit(0), df, ["key"], "lsn", None)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, live.collect()))
    assert df.where("lsn > 2").count() == 3


def test_versions_run_on_through_tombstones(spark, as_rows):
    df = spark.createDataFrame([(1, "a", "delete", None), (2, "a", "put", "x"), (3, "b", "put", "y"), (4, "a", "delete", None)], LOG)
    assert as_rows(log.assign_versions(df, ["key"], "lsn"), "key", "version") == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    assert as_rows(log.previous_value(df, ["key"], "lsn", "value"), "lsn", "previous") == [(1, None), (2, None), (3, None), (4, "x")]
    assert as_rows(log.tombstone_versions(df, ["key"], "lsn")) == [("a", 4)]


def test_latest_keeps_null_payloads_and_empty_input(spark):
    df = spark.createDataFrame([(1, "a", "put", "x"), (2, "a", "put", None), (None, "b", "put", "z"), (1, None, "put", "n")], LOG).withColumn("extra col", F.lit(1))
    assert {(r.key, r.value) for r in log.latest(df, ["key"], "lsn").collect()} == {("a", None), ("b", "z"), (None, "n")}
    assert log.latest(df.limit(0), ["key"], "lsn").count() == 0


def test_expected_version(spark):
    held = spark.createDataFrame([("a", 3), ("dead", 2)], "key string, version bigint")
    batch = spark.createDataFrame([("a", 3), ("dead", 0), ("new", 0), ("other", 5), ("a2", None)], "key string, expected_version bigint")
    ok, bad = log.split_conflicts(batch, held, ["key"])
    assert {r.key for r in ok.collect()} == {"a", "new", "a2"}
    assert {(r.key, r.actual_version) for r in bad.collect()} == {("dead", 2), ("other", 0)}


def test_appended_numbers_are_dense_and_ordered(spark):
    df = spark.createDataFrame(FIVE, LOG)
    batch = spark.range(100).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("key"))
    got = sorted((r.lsn, r.key) for r in log.append_with_lsn(df, batch, ["key"]).collect())
    assert got == [(6 + i, f"k{i:03d}") for i in range(100)]
    assert log.append_with_lsn(df.limit(0), batch.limit(0), ["key"]).count() == 0


def test_checkpoint_store(spark, tmp_path):
    store = recovery.CheckpointStore(spark, f"file://{tmp_path}/ck")
    assert store.load_latest() is None
    df = spark.createDataFrame(FIVE, LOG)
    for lsn in (2, 3, 5):
        store.write(recovery.snapshot_at(df, ["key"], "lsn", lsn), lsn)
    (tmp_path / "ck" / "ckpt-00000000000000000009").mkdir()
    lsn, snap = store.load_latest()
    assert lsn == 5 and snap.count() == 3
    assert store.prune(0) == [] and store.prune(2) == [2] and store.lsns() == [5, 3]


def test_checkpoint_and_reset(spark, tmp_path):
    store = recovery.CheckpointStore(spark, f"file://{tmp_path}/ck")
    df = spark.createDataFrame(FIVE, LOG)
    lsn, rest = store.checkpoint_and_reset(df.where("lsn <= 3"), ["key"], "lsn")
    assert lsn == 3 and rest.count() == 0
    lsn, _ = store.checkpoint_and_reset(df.where("lsn > 3"), ["key"], "lsn")
    live = recovery.recover(store.load_latest()[1], df, ["key"], "lsn", lsn)
    assert lsn == 5 and {(r.key, r.value) for r in live.collect()} == {("user:1", "ada-updated"), ("user:3", "katherine")}


def test_sequence_faults(spark):
    df = spark.createDataFrame([("s", 1, 5), ("s", 2, 5), ("s", 3, 9), ("s", 4, 7)], "seg string, pos int, lsn bigint")
    assert sorted((r.lsn, r.previous_lsn) for r in recovery.sequence_faults(df, ["seg"], "pos", "lsn").collect()) == [(5, 5), (7, 9)]


def test_object_recovery_joins_expiry_of_the_same_version(spark):
    meta = '{"version":%d,"last_touch":%d,"expires_at":%d,"tti_ticks":%d}'
    rows = [("k", 1, "put", "v1"), ("@exp/k", 1, "put", meta % (1, 1, 5, 0)), ("k", 7, "put", "v2"), ("e", 3, "put", "v"), ("@exp/e", 3, "put", meta % (3, 3, 9, 0)), ("i", 4, "put", "v"), ("@exp/i", 4, "put", meta % (4, 6, 0, 4)), ("d", 5, "delete", None)]
    df = spark.createDataFrame(rows, "key string, version bigint, op string, value string")
    assert {(r.key, r.expires_at, r.tti_ticks) for r in recovery.recover_objects(df, "@exp/").collect()} == {("k", 0, 0), ("e", 9, 0), ("i", 0, 4)}
    assert {r.key for r in recovery.recover_objects(df, "@exp/", now=9).collect()} == {"k", "i"}
    assert {r.key for r in recovery.recover_objects(df, "@exp/", now=10).collect()} == {"k"}


@pytest.mark.parametrize("now,touch,at,tti,gone", [(10, 0, 0, 0, False), (10, 0, 10, 0, True), (9, 0, 10, 0, False), (10, 5, 0, 5, True), (10, 6, 0, 5, False), (3, 9, 0, 5, False), (None, 1, 1, 1, False)])
def test_expired(spark, now, touch, at, tti, gone):
    r = spark.createDataFrame([(now, touch, at, tti)], "n bigint, t bigint, a bigint, i bigint").select(expiry.expired(F.col("n"), F.col("t"), F.col("a"), F.col("i"))).first()[0]
    assert r is gone


def test_sessions_close_at_exactly_the_idle_time(spark, as_rows):
    df = spark.createDataFrame([("a", 0), ("a", 4), ("a", 9), ("a", 13), ("b", 1)], "k string, t bigint")
    assert as_rows(expiry.tti_sessions(df, ["k"], "t", F.lit(5)), "k", "t", "session") == sorted([("a", 0, 1), ("a", 4, 1), ("a", 9, 2), ("a", 13, 2), ("b", 1, 1)], key=lambda r: [(True, str(x)) for x in r])


def hot(spark):
    rng = random.Random(4)
    rows = [(f"k{i:03d}", i, rng.randrange(50), rng.random() < 0.3, False, f"v{i}") for i in range(100)]
    return rows, spark.createDataFrame(rows, "key string, version bigint, last_touch bigint, dirty boolean, tombstone boolean, value string")


def test_demotion(spark):
    rows, df = hot(spark)
    want = sorted(((t, v, k) for k, v, t, d, _, _ in rows if not d and 60 - t >= 20))
    assert [(r.last_touch, r.version, r.key) for r in expiry.demote(df, 60, 20, 7).collect()] == want[:7]
    assert expiry.demote(df, 60, 20, 50, soft_limit=97).count() == 3
    assert expiry.demote(df, 60, 0, 50, soft_limit=100).count() == 0
    assert {r.disposition for r in expiry.demotion_report(df, 60, 20).collect()} == {"skipped_dirty", "skipped_recent", "candidate"}


def test_cold_tier(spark):
    cold = spark.createDataFrame([("a", 1, 1, "old"), ("a", 2, 5, "new"), ("b", 1, 2, "b"), ("c", 1, 9, "c"), ("x", 1, 1, "x")], "key string, generation int, version bigint, value string")
    cold = cold.withColumn("last_touch", F.col("version")).withColumn("expires_at", F.when(F.col("key") == "x", 3).otherwise(0)).withColumn("tti_ticks", F.lit(0))
    dead = spark.createDataFrame([("b", 2), ("b", 1), ("c", 8)], "key string, version bigint")
    assert {(r.key, r.version, r.generation) for r in expiry.compact_cold(cold, dead, ["key"], now=3, to_generation=7).collect()} == {("a", 5, 7), ("c", 9, 7)}
    heat = spark.createDataFrame([("a", 6, "hot", False), ("c", 9, None, True), ("h", 1, "h", False)], "key string, version bigint, value string, tombstone boolean")
    assert {(r.key, r.value, r.tier) for r in expiry.read_through(heat, cold, dead, ["key"]).collect()} == {("a", "hot", "hot"), ("h", "h", "hot"), ("x", "x", "cold")}


def test_includes(spark):
    users = spark.createDataFrame([("u1", "c1"), ("u2", None), ("u3", "gone")], "id string, company_id string")
    firms = spark.createDataFrame([("c1", "One"), ("c2", "Two")], "id string, name string")
    assert {(r.id, r.ref_name) for r in refs.include_forward(users, firms, "company_id", "id").collect()} == {("u1", "One"), ("u2", None), ("u3", None)}
    wanted = spark.createDataFrame([("c1",), ("gone",), ("c2",)], "id string")
    assert {(r.target_key, r.id) for r in refs.include_reverse(wanted, users, "id", "company_id").collect()} == {("c1", "u1"), ("gone", "u3")}
    assert {tuple(r) for r in refs.reverse_counts(firms, users, "id", "company_id").collect()} == {("c1", 1), ("c2", 0)}
    assert [r.id for r in refs.dangling(users, firms, "company_id", "id").collect()] == ["u3"]


def test_percentiles_by_rank(spark):
    rng = random.Random(6)
    data = [(g, rng.choice([None, *map(float, range(30))])) for g in "ab" for _ in range(101)]
    df = spark.createDataFrame(data, "g string, v double")
    for r in summary.percentiles(df, ["g"], "v", {"p50": 0.5, "p99": 0.99, "p0": 0.0, "p100": 1.0}).collect():
        xs = sorted(v for g, v in data if g == r.g and v is not None)
        at = lambda p: xs[int((len(xs) - 1) * p + 0.5)]
        assert (r.n, r.p50, r.p99, r.p0, r.p100) == (len(xs), at(0.5), at(0.99), xs[0], xs[-1])
    assert summary.run_summary(df, [], "v").count() == 1
    assert summary.percentiles(df.limit(0), ["g"], "v", {"p": 0.5}).count() == 0
