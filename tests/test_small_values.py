import math

from keyloom.operators import dense, expiry, log
from keyloom.sources import wal
from pyspark.sql import functions as F


def test_values_are_packed_and_unpacked(spark):
    xs = [0.0, -0.0, 1.5, -1e300, 5e-324, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = {r.i: (r.w, r.back) for r in df.select("i", dense.packed(F.col("x"), "f64").alias("w")).select("i", "w", dense.unpacked(F.col("w"), "f64").alias("back")).collect()}
    for i, x in enumerate(xs):
        w, back = got[i]
        if x is None:
            assert w is None and back is None
        else:
            assert math.isnan(back) if math.isnan(x) else (back == x and math.copysign(1, back) == math.copysign(1, x))
    b = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert [tuple(r) for r in b.select(dense.packed(F.col("b"), "bool"), dense.unpacked(dense.packed(F.col("b"), "bool"), "bool")).collect()] == [(1, True), (0, False), (None, None)]


def test_object_snapshots_need_their_footer(spark, tmp_path):
    rows = spark.createDataFrame([(1, "put", b"a", b"x"), (2, "delete", b"b", None), (3, "put", b"c", b"")], "version bigint, op string, key binary, value binary")
    path = f"file://{tmp_path}/snap"
    assert wal.write_object_snapshot(rows.coalesce(1), path, 9) == 1
    read = lambda: sorted((r.lsn, r.version, r.op) for r in wal.read_object_snapshot(spark, f"{path}/*.obj").collect())
    assert read() == [(9, 1, "put"), (9, 2, "delete"), (9, 3, "put")]
    f = next((tmp_path / "snap").glob("*.obj"))
    f.write_bytes(f.read_bytes()[:-1])
    assert read() == []


def test_small_reads(spark, as_rows):
    rows = spark.createDataFrame([("a", 1, "put"), ("a", 2, "delete"), ("b", 3, "put"), (None, 4, "1")], "key string, lsn bigint, op string")
    assert as_rows(log.rebuilt(rows, ["key"], "lsn"), "key", "lsn") == [(None, 4), ("b", 3)]
    assert as_rows(log.high_water_mark(rows, [], "lsn")) == [(4,)] and as_rows(log.high_water_mark(rows.limit(0), ["key"], "lsn")) == []
    state = spark.createDataFrame([("a", 1, 1, 5, 0, False), ("b", 2, 2, 0, 3, True), ("c", 3, 3, 0, 0, None)], "key string, version int, last_touch int, expires_at int, tti_ticks int, tombstone boolean")
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("z",)], "key string")
    assert as_rows(expiry.expiry_meta(state, asked, ["key"])) == [("a", 1, 1, 5, 0), ("c", 3, 3, 0, 0)]


def test_clean_rows_come_and_go(spark, as_rows):
    kind = "key string, version int, dirty boolean, value string"
    state = spark.createDataFrame([("a", 2, True, "a2"), ("b", 2, False, "b2"), (None, 1, None, "n1")], kind)
    assert as_rows(expiry.evict_clean(state, spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "key string"), ["key"]), "key") == [("a",)]
    records = spark.createDataFrame([("a", 2, True, "same"), ("b", 3, True, "b3"), ("b", 1, True, "b1"), ("c", 1, True, "c1"), (None, 4, True, "n4")], kind)
    assert as_rows(expiry.load_clean(state, records, ["key"]), "key", "version", "dirty", "value") == [(None, 4, False, "n4"), ("a", 2, True, "a2"), ("b", 3, False, "b3"), ("c", 1, False, "c1")]
    assert as_rows(expiry.load_clean(state.limit(0), records.limit(0), ["key"])) == []
