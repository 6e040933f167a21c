import random
from datetime import datetime, timedelta

import pytest

from keyloom.operators.incremental import RunLedger, last_checkpoints, pending_records

T0 = datetime(2025, 1, 1)
LOG = "store_id string, rec_key string, lsn bigint, arrived_at timestamp_ntz"
CK = "store_id string, kind string, path string, checkpoint_lsn bigint, lsn bigint, record_count bigint, footer_count bigint, started_at timestamp_ntz, finished_at timestamp_ntz"


def hour(n):
    return None if n is None else T0 + timedelta(hours=n)


def ck(store="s", lsn=10, started=10, finished=11, path="p", n=5, footer=5, kind="raw"):
    return (store, kind, path, lsn if kind == "raw" else None, lsn if kind == "object" else None, n, footer, hour(started), hour(finished))


def test_against_brute_force(spark):
    rng = random.Random(3)
    log = [(rng.choice(["a", "b", "c", None]), f"k{rng.randrange(6)}", rng.choice([None, *range(25)]), hour(rng.choice([None, *range(25)]))) for _ in range(500)]
    log += log[:50]
    cks = [ck("a", 12, 9), ck("a", 15, 14, None), ck("a", 16, 15, path="x.tmp"), ck("a", 17, 15, footer=4), ck("a", 12, 11), ck("b", 20, None), ck("b", 3, 20), ck("a", 24, 24, kind="object"), ck("a", None, 3)]
    last = {"a": (12, hour(11)), "b": (3, hour(20))}
    first = {}
    for s, k, lsn, t in log:
        first.setdefault((s, k, lsn), []).append(t)
    want = set()
    for (s, k, lsn), ts in first.items():
        known = [t for t in ts if t is not None]
        c = last.get(s)
        if not (c and lsn is not None and lsn <= c[0] and known and min(known) <= c[1]):
            want.add((s, k, lsn))
    got = pending_records(spark.createDataFrame(log, LOG), spark.createDataFrame(cks, CK), "raw").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_last_checkpoint_rules(spark):
    df = spark.createDataFrame([ck(lsn=5), ck(lsn=9, finished=None), ck(lsn=8, path="a.tmp"), ck(lsn=7, footer=1), ck(lsn=6, path=None)], CK)
    assert [tuple(r) for r in last_checkpoints(df, "raw").collect()] == [("s", 5, hour(10))]


def test_empty_tables(spark):
    none, log = spark.createDataFrame([], CK), spark.createDataFrame([("s", "k", 1, hour(1))] * 3, LOG)
    assert pending_records(log, none, "raw").count() == 1
    assert pending_records(log.limit(0), none, "object").count() == 0


def test_ledger_survives_failures_without_skips_or_repeats(spark, tmp_path):
    log = [("k%d" % (i % 4), i) for i in range(20)]
    run = RunLedger(spark, f"file://{tmp_path}/ledger", ["rec_key", "lsn"], "lsn")
    frame = lambda rows: spark.createDataFrame(rows, "rec_key string, lsn bigint")
    run.commit(run.pending(frame(log[:8] + log[:3])), open_since=4)
    # A run that dies after writing its output but before publishing leaves nothing behind.
    frame(log[8:10]).write.parquet(f"file://{tmp_path}/ledger/out/dead")
    arrived = [r for r in log[:12] if r[1] != 5] + [("k1", 5), ("k1", 9)]
    second = run.pending(frame(arrived))
    assert sorted(r.lsn for r in second.collect()) == [8, 9, 10, 11]
    run.commit(second, open_since=12)
    assert sorted(r.lsn for r in run.pending(frame(log)).collect()) == list(range(12, 20))
    done = spark.read.parquet(*[m["out"] for m in run.manifests()])
    assert done.count() == done.distinct().count() == 12


def test_rename_failure_is_reported(spark, tmp_path):
    run = RunLedger(spark, f"file://{tmp_path}/l", ["k"], "k")
    path = run.commit(spark.createDataFrame([(1,)], "k bigint"))
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(Exception):
        run.commit(spark.createDataFrame([(1,)], "other bigint"))
    assert len(run.manifests()) == 1


def test_of_two_runs_from_one_state_only_the_first_counts(spark, tmp_path):
    run = RunLedger(spark, f"file://{tmp_path}/r", ["rec_key", "lsn"], "lsn")
    frame = lambda *lsns: spark.createDataFrame([("k", x) for x in lsns], "rec_key string, lsn bigint")
    state = run.state()
    a, b = run.pending(frame(1, 2)), run.pending(frame(2, 3))
    run.commit(a, based_on=state)
    with pytest.raises(RuntimeError):
        run.commit(b, based_on=state)
    assert len(run.manifests()) == 1
    run.commit(run.pending(frame(2, 3, None)))
    done = spark.read.parquet(*[m["out"] for m in run.manifests()])
    assert sorted(r.lsn or 0 for r in done.collect()) == [0, 1, 2, 3]


def test_only_the_ledger_from_the_oldest_open_number_on_is_kept(spark, tmp_path):
    run = RunLedger(spark, f"file://{tmp_path}/m", ["lsn"], "lsn")
    frame = lambda lo, hi: spark.range(lo, hi).withColumnRenamed("id", "lsn")
    for k in range(4):
        run.commit(run.pending(frame(0, 10 * k + 10)), open_since=10 * k + 5)
    assert len(run.state()["parts"]) == 1 and len(run.manifests()) == 4
    assert sorted(r.lsn for r in run.pending(frame(0, 50)).collect()) == list(range(40, 50))


def test_null_stores_and_keys_are_found_in_the_ledger(spark):
    cks = spark.createDataFrame([ck(lsn=10, started=10)], CK)
    log = spark.createDataFrame([("s", None, 3, hour(1)), ("s", None, 3, hour(20)), ("s", None, 4, hour(20)), (None, "k", 1, hour(1))], LOG)
    assert {tuple(r) for r in pending_records(log, cks, "raw").collect()} == {("s", None, 4), (None, "k", 1)}
