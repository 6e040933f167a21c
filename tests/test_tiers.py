"""Both tiers are whole: every key and every event takes part."""

import __spark_entry__ as entry
import pytest
from keyloom.operators import expiry, recovery


def test_no_key_is_left_out(spark, tmp_path, as_rows):
    cols = "event_id bigint, user_id bigint, event_type string, value double"
    late = 1024  # Blocks of 1024 take turns: hot, cold.
    data = [
        (1, 1, "view", 1.0), (late, 1, "view", 2.0), (2, 2, "view", 3.0), (3, 3, "error", 4.0), (late + 1, 3, "view", 5.0), (late + 2, 5, "view", 6.0), (late + 3, 5, "error", 7.0),
        (late + 4, 6, "view", 8.0), (2 * late, 6, "view", 9.0), (late + 5, 7, "view", 10.0), (2 * late + 1, 9, "view", 11.0), (late + 6, 9, "view", 12.0), (late + 7, 11, "view", 13.0), (2 * late + 2, 11, "error", 14.0),
    ]
    spark.createDataFrame(data, cols).write.parquet(f"{tmp_path}/events.parquet")
    run = {name: entry.queries()[name](spark, str(tmp_path)) for name in ("cold_read_through", "promotion_guard", "drop_stale_records")}
    assert sorted(map(tuple, run["cold_read_through"].select("key", "version", "value", "tier").collect())) == [
        (1, late, 2.0, "cold"), (2, 2, 3.0, "hot"), (6, 2 * late, 9.0, "hot"), (7, late + 5, 10.0, "cold"), (9, 2 * late + 1, 11.0, "hot")]
    assert sorted(map(tuple, run["promotion_guard"].collect())) == [(1, late), (3, late + 1), (7, late + 5)]
    assert sorted(map(tuple, run["drop_stale_records"].collect())) == [(late, 1), (late + 1, 3), (late + 2, 5), (late + 3, 5), (late + 5, 7)]


HOT = "key string, version bigint, last_touch bigint, dirty boolean, tombstone boolean, value string"


def test_the_cold_tier_is_stored_and_read_again(spark, tmp_path, as_rows):
    tier = expiry.ColdTier(spark, f"file://{tmp_path}/cold", ["key"])
    assert tier.records() is None and tier.compact(0) == {"generations": 0, "records": 0, "kept": 0}
    hot = spark.createDataFrame([("a", 1, 1, False, False, "a1"), ("b", 2, 2, False, False, "b2"), ("c", 3, 3, True, False, "c3"), ("d", 4, 4, False, True, None)], HOT)
    left = tier.demote(hot, 5000, most=3)
    assert as_rows(left, "key") == [("c",)] and as_rows(tier.records(), "key", "version") == [("a", 1), ("b", 2)]
    assert as_rows(tier.tombstones()) == [("d", 4)]
    record = "key string, version bigint, value string, last_touch bigint, expires_at bigint, tti_ticks bigint"
    tier.add(spark.createDataFrame([("a", 7, "a7", 7, 0, 0), ("d", 2, "d2", 2, 0, 0), ("e", 8, "e8", 8, 9, 0)], record), spark.createDataFrame([("b", 2)], "key string, version bigint"))
    seen = expiry.read_through(left, tier.records(), tier.tombstones(), ["key"])
    assert as_rows(seen, "key", "version", "tier") == [("a", 7, "cold"), ("c", 3, "hot"), ("e", 8, "cold")]
    grown = tier.promote(left, 10)
    assert as_rows(grown, "key", "version", "dirty") == [("a", 7, False), ("c", 3, True)]
    # A generation that can't be read is passed over.
    path = tier.manifest()["generations"][1]["path"].removeprefix("file://")
    for f in __import__("pathlib").Path(path).glob("part-*.parquet"):
        f.write_bytes(b"broken")
    assert as_rows(tier.records(), "key", "version") == [("a", 1), ("b", 2)]
    assert tier.compact(10) == {"generations": 2, "records": 5, "kept": 1}
    assert as_rows(tier.records(), "key", "version", "generation") == [("a", 1, 3)] and tier.tombstones() is None


def test_two_writers_of_one_state(spark, tmp_path):
    tier = expiry.ColdTier(spark, f"file://{tmp_path}/cold", ["key"])
    before = tier.manifest()
    tier._publish(before)
    with pytest.raises(RuntimeError):
        tier._publish(before)


def test_a_checkpoint_that_does_not_read_is_passed_over(spark, tmp_path):
    store = recovery.CheckpointStore(spark, f"file://{tmp_path}/ck")
    for lsn in (5, 9, 12):
        store.write(spark.range(lsn), lsn)
    for f in (tmp_path / "ck" / f"ckpt-{12:020d}" / "rows").glob("part-*.parquet"):
        f.write_bytes(b"broken")
    assert store.lsns() == [12, 9, 5] and store.load_latest()[0] == 9
    for f in (tmp_path / "ck" / f"ckpt-{9:020d}" / "rows").glob("part-*.parquet"):
        f.unlink()
        break
    assert store.load_latest()[0] == 5
    assert store.prune(1) == [] and store.lsns() == [12, 9, 5]
