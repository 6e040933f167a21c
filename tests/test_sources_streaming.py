import gzip
import random
import sqlite3
import struct
import time

import pytest

from keyloom.functions.checksums import crc32c, crc32c_many, fnv1a64
from keyloom.operators import documents as D
from keyloom.sources import files, sql_sink, wal
from keyloom.streaming import expiring, flusher
from pyspark.sql import functions as F

RECORDS = [(1, 1, "c", "put", b"a", b"x"), (2, 1, "c", "put", b"b", b""), (3, 2, "c", "delete", b"a", None), (7, 1, "d", "put", b"\xff", b"z" * 100)]


def test_checksums():
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"6789", crc32c(b"12345")) == 0xE3069283
    assert fnv1a64(b"") == 0xCBF29CE484222325 and fnv1a64(b"a") == 0xAF63DC4C8601EC8C


def test_segments(spark, tmp_path):
    data = wal.encode_segment(RECORDS)
    assert [r[1:] for r in wal.decode_segment(data)] == RECORDS
    assert len(list(wal.decode_segment(data[:-1]))) == 3
    assert len(list(wal.decode_segment(data[:-1] + bytes([data[-1] ^ 1])))) == 3
    broken = bytearray(data)
    broken[20] ^= 1
    for bad, kind in ((bytes(broken), "checksum_mismatch"), (b"XXXX" + data[4:], "bad_magic"), (wal.encode_segment([RECORDS[1], RECORDS[0]]), "non_monotonic_lsn")):
        with pytest.raises(wal.WalCorruption) as e:
            list(wal.decode_segment(bad))
        assert e.value.kind == kind
    (tmp_path / "s1.wal").write_bytes(data)
    df = wal.read_segments(spark, f"file://{tmp_path}/s1.wal", after=2)
    assert sorted((r.lsn, r.op, bytes(r.key), r.value and bytes(r.value)) for r in df.collect()) == [(3, "delete", b"a", None), (7, "put", b"\xff", b"z" * 100)]
    out = tmp_path / "out"
    assert wal.write_segments(wal.read_segments(spark, f"file://{tmp_path}/s1.wal"), f"file://{out}") >= 1
    back = wal.read_segments(spark, f"file://{out}/*.wal")
    assert sorted(r.lsn for r in back.collect()) == [1, 2, 3, 7]


def test_checksums_of_many_and_long_stretches():
    rng = random.Random(1)
    data = rng.randbytes(70000)

    def plain(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    for n in (0, 1, 63, 64, 65, 1000, 4096, 5001):
        assert crc32c(data[:n]) == plain(data[:n])
    assert crc32c(data) == crc32c(data[777:], crc32c(data[:777]))
    starts = [0, 5, 5, 100, 200, 300]
    ends = [0, 6, 70, 5000, 201, 69999]
    assert crc32c_many(data, starts, ends) == [crc32c(data[a:b]) for a, b in zip(starts, ends)]


def test_logs_go_on_behind_a_torn_tail(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    kind = "collection string, op string, key binary, value binary, n int"
    first = wal.append_segments(spark.createDataFrame([("c", "put", b"a", b"1", 1), ("c", "delete", b"a", None, 2), ("d", "put", b"a", b"2", 3)], kind), path, ["n"])
    assert sorted((r.lsn, r.version) for r in first.collect()) == [(1, 1), (2, 2), (3, 1)]
    last = sorted((tmp_path / "log").glob("*.wal"))[-1]
    last.write_bytes(last.read_bytes() + b"MFSW torn")
    more = wal.append_segments(spark.createDataFrame([("c", "put", b"a", b"3", 1), ("e", "put", b"z", b"", 2)], kind), path, ["n"])
    assert sorted((r.lsn, r.version) for r in more.collect()) == [(4, 3), (5, 1)]
    assert [r.lsn for r in wal.read_segments(spark, f"{path}/*.wal").orderBy("lsn").collect()] == [1, 2, 3, 4, 5]
    assert not last.read_bytes().endswith(b"torn")
    rows = wal.read_segments(spark, f"{path}/*.wal").where("lsn <> 4")
    assert wal.write_generic(rows.select(F.col("lsn").alias("version"), "op", "key", "value"), f"file://{tmp_path}/gen") >= 1
    assert sorted((r.version, r.op) for r in wal.read_generic(spark, f"file://{tmp_path}/gen/*.log").collect()) == [(1, "put"), (2, "delete"), (3, "put"), (5, "put")]


def test_generic_log_stops_at_the_first_bad_record(spark, tmp_path):
    data = wal.encode_generic([(1, "put", b"k", b"v"), (2, "put", b"e", b""), (3, "delete", b"k", None)])
    assert [r[1:] for r in wal.decode_generic(data)] == [(1, "put", b"k", b"v"), (2, "put", b"e", b""), (3, "delete", b"k", None)]
    (tmp_path / "g").write_bytes(data[:-5] + b"junk!" + data)
    assert wal.read_generic(spark, f"file://{tmp_path}/g").count() == 2
    body = wal.with_footer(data, 9, 3)
    assert wal.read_footer(body) == (9, 3) and wal.read_footer(b"x" + body) is None and wal.read_footer(data) is None


def test_snapshot_files():
    data = wal.encode_snapshot(5, {"c": [(1, b"a", b"x"), (2, b"b", None)], "e": []})
    assert wal.decode_snapshot(data) == (5, [("c", 1, b"a", b"x"), ("c", 2, b"b", None)])
    for bad in (data[:-1], data[:-6] + bytes([data[-6] ^ 1]) + data[-5:], b"zzzz" + data[4:], data[:4] + struct.pack("<H", 9) + data[6:]):
        with pytest.raises(wal.WalCorruption):
            wal.decode_snapshot(bad)


def test_json_lines_archives_traces_pages(spark, tmp_path):
    rows = spark.createDataFrame([("u1", b"text"), ("u2", b"\xff\xfe"), ("u3", b"")], "url string, content binary")
    files.write_jsonl(rows, f"file://{tmp_path}/j")
    assert [tuple(r) for r in files.read_jsonl(spark, f"file://{tmp_path}/j").collect()] == [("u1", "text")]

    def record(kind, url, body):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    blob = b"".join(gzip.compress(record(*r)) for r in (("warcinfo", "i", b"x"), ("conversion", "http://a", b"line\nWARC/1.0\n"), ("conversion", "http://b", b""), ("conversion", "http://c", b"c")))
    (tmp_path / "a.wet.gz").write_bytes(blob)
    (tmp_path / "b.wet.gz").write_bytes(blob[:-20])
    got = [(r.url, bytes(r.content)) for r in files.read_archives(spark, f"file://{tmp_path}/*.wet.gz").collect()]
    assert sorted(got)[:2] == [("http://a", b"line\nWARC/1.0\n")] * 2 and ("http://c", b"c") in got
    pages = spark.createDataFrame([("http://x", b"one\r\n\r\nWARC/1.0"), ("http://y", b"")], "url string, content binary")
    assert files.write_archives(pages.coalesce(1), f"file://{tmp_path}/arch") == 1
    assert [(r.url, bytes(r.content)) for r in files.read_archives(spark, f"file://{tmp_path}/arch/*.wet.gz").collect()] == [("http://x", b"one\r\n\r\nWARC/1.0")]
    (tmp_path / "t.csv").write_text("1,a\n2,b\n3,a\n")
    assert [r.key for r in files.read_trace(spark, f"file://{tmp_path}/t.csv", 2).collect()] == ["a", "b"]
    df = spark.createDataFrame([(b"hello",), (None,)], "c binary")
    part = files.page_read(F.col("c"), 3, 4)
    assert [tuple(r) for r in df.limit(1).select(part["data"], part["available"]).collect()] == [(b"lo\x00\x00", 2)]
    assert [bytes(r[0]) for r in df.select(files.page_write(F.col("c"), 7, b"!!")).collect()] == [b"hello\x00\x00!!", b"\x00" * 7 + b"!!"]
    assert bytes(df.limit(1).select(files.page_write(F.col("c"), 1, b"EL")).first()[0]) == b"hELlo"
    assert bytes(df.limit(1).select(files.page_truncate(F.col("c"), 2)).first()[0]) == b"he"


def table_schema():
    t = D.FieldType
    return D.Schema("us\"ers", (D.Field("id", t("string"), primary=True), D.Field("email", t("string"), indexed=True, unique=True), D.Field("firm.id", t("string"), reference=("companies", "id")), D.Field("made", t("int64"), indexed=True, sort=True), D.Field("note", t("json"), stored=False)), nested_names=True)


def test_statements_and_merge_agree(spark):
    schema = D.Schema("users", (D.Field("id", D.FieldType("string"), primary=True), D.Field("v", D.FieldType("string"))))
    db = sqlite3.connect(":memory:")
    for s in sql_sink.create_statements(schema):
        db.execute(s)
    steps = [("put", "a", 5, "a5"), ("put", "a", 5, "again"), ("put", "a", 4, "old"), ("delete", "a", 4, None), ("put", "b", 2, "b2"), ("delete", "b", 2, None), ("put", "c", 1, "c1"), ("put", "c", 3, "c3"), ("delete", "x", 9, None)]
    target = spark.createDataFrame([], "key string, lsn bigint, v string")
    for op, k, lsn, v in steps:
        if op == "put":
            db.execute(sql_sink.upsert_statement(schema), (k, v, k.encode(), lsn))
        else:
            db.execute(sql_sink.delete_statement(schema), (k.encode(), lsn))
        batch = spark.createDataFrame([(k, lsn, v, op)], "key string, lsn bigint, v string, op string")
        target = spark.createDataFrame(sql_sink.guarded_merge(target, batch, "key", "lsn").collect(), target.schema)
    assert sorted(map(tuple, target.collect())) == sorted(db.execute(f"select id, {sql_sink.LSN_COLUMN}, v from users").fetchall())


def test_statements_run_in_transactions(spark, tmp_path):
    schema = D.Schema("users", (D.Field("id", D.FieldType("string"), primary=True), D.Field("v", D.FieldType("int64"))))
    path = str(tmp_path / "db")
    db = sqlite3.connect(path)
    for s in sql_sink.create_statements(schema):
        db.execute(s)
    db.commit()
    connect = lambda: sqlite3.connect(path)
    kind = "key string, id string, v bigint, lsn bigint, op string"
    one = spark.createDataFrame([("a", "a", 1, 1, "put"), ("a", "a", 2, 2, "put"), ("b", "b", 1, 3, "put"), ("c", "c", None, 4, "delete")], kind)
    two = spark.createDataFrame([("a", "a", 9, 1, "put"), ("b", None, None, 3, "delete"), ("d", "d", 4, 5, "put")], kind)
    read = lambda: sorted(db.execute("select id, v from users").fetchall())
    assert sql_sink.run_batch(one, schema, connect) == 3 and read() == [("a", 2), ("b", 1)]
    for _ in range(2):
        assert sql_sink.run_batch(two, schema, connect) == 3 and read() == [("a", 2), ("d", 4)]
    bad = spark.createDataFrame([("e", "e", 1, 6, "put"), ("f", "a", 1, 7, "put")], kind)  # the second row's key clashes
    with pytest.raises(Exception):
        sql_sink.run_batch(bad.union(spark.createDataFrame([("g", "a2", 1, None, "put")], kind)), schema, connect)
    assert read() == [("a", 2), ("d", 4)] and sql_sink.run_batch(one.limit(0), schema, connect) == 0


def test_table_text():
    with pytest.raises(D.SchemaError):
        sql_sink.create_statements(table_schema())
    import dataclasses

    s = dataclasses.replace(table_schema(), name="users")
    made = sql_sink.create_statements(s)
    assert made[0].startswith('CREATE TABLE IF NOT EXISTS "users" ("id" TEXT PRIMARY KEY, "email" TEXT UNIQUE, "firm_id" TEXT REFERENCES "companies"("id"), "made" INTEGER, ')
    assert [m.split('"')[1] for m in made[1:]] == ["users_firm_id_idx", "users_made_idx"]
    assert '"k" BLOB NOT NULL UNIQUE, "seq" INTEGER NOT NULL' in sql_sink.create_statements(s, "k", "seq")[0]
    assert sql_sink.delete_statement(s, "k", "seq") == 'DELETE FROM "users" WHERE "k" = ? AND "seq" <= ?;' and sql_sink.upsert_statement(s, "k", "seq").endswith('WHERE "users"."seq" < excluded."seq";')
    assert sql_sink.quote('a"b') == '"a""b"'


def test_flusher_applies_batches_once(spark, tmp_path):
    src, dst = tmp_path / "src", f"file://{tmp_path}/dst"
    schema = "key string, lsn bigint, v string, op string"
    for i, rows in enumerate([[("a", 1, "x", "put"), ("a", 2, "y", "put"), ("b", 3, "z", "put")], [("a", 1, "late", "put"), ("b", 4, None, "delete"), ("c", 5, "c", "put")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{src}")
        time.sleep(0.05)
    stream = flusher.change_stream(spark, f"file://{src}", spark.read.parquet(f"file://{src}").schema, files_per_batch=1)
    flush = flusher.delta_sink(dst)
    assert flusher.current_rows(spark, dst, "key", "lsn") is None
    q = flusher.start_flusher(stream, ["key"], "lsn", flush, f"file://{tmp_path}/cp", every="0 seconds")
    q.processAllAvailable()
    q.stop()
    want = [("a", 2, "y"), ("c", 5, "c")]
    read = lambda: sorted(map(tuple, flusher.current_rows(spark, dst, "key", "lsn").select("key", "lsn", "v").collect()))
    assert read() == want
    flush(spark.createDataFrame([("a", 2, "repeat", "put"), ("c", 5, "c", "put")], schema), 99)
    assert read() == want
    assert flusher.compact_table(spark, dst, "key", "lsn") == 99 and read() == want
    assert len(list((tmp_path / "dst").iterdir())) == 1 and flusher.compact_table(spark, dst, "key", "lsn") == 99
    flush(spark.createDataFrame([("b", 4, "late", "put"), ("c", 5, None, "delete"), ("d", 7, "d", "put")], schema), 100)
    flush(spark.createDataFrame([("d", 7, "d", "put")], schema), 100)
    assert read() == [("a", 2, "y"), ("c", 5, "c"), ("d", 7, "d")]
    flush(spark.createDataFrame([("b", 4, "late", "put"), ("c", 5, None, "delete")], schema), 101)
    assert read() == [("a", 2, "y"), ("d", 7, "d")]


def test_expiry_stream(spark, tmp_path):
    src = f"file://{tmp_path}/touch"
    rows = [("a", 1, 5, 0, True), ("a", 3, 0, 0, False), ("a", 6, 0, 0, False), ("b", 1, 0, 4, True), ("b", 4, 0, 0, False), ("b", 7, 0, 0, False), ("b", 11, 0, 0, False), ("c", 1, 2, 0, True), ("c", 2, 0, 0, True), ("c", 50, 0, 0, False)]
    schema = "key string, tick bigint, ttl_ticks bigint, tti_ticks bigint, write boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = expiring.expiries(stream).writeStream.format("memory").queryName("expired_keys").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("expired_keys").collect())) == [("a", 6, "expired"), ("b", 11, "expired")]


def test_keys_that_nobody_touches_expire_by_timer(spark, tmp_path):
    src = f"file://{tmp_path}/touch"
    schema = "key string, tick bigint, ttl_ticks bigint, tti_ticks bigint, write boolean"
    for i, rows in enumerate([[("gone", 1, 5, 0, True), ("idle", 2, 0, 3, True), ("kept", 2, 0, 0, True)], [("other", 100, 0, 0, True)], [("late", 3, 4, 0, True), ("other", 101, 0, 0, False)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = expiring.expiries(stream).writeStream.format("memory").queryName("timed_out").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("timed_out").collect())) == [("gone", 6, "expired"), ("idle", 5, "expired"), ("late", 7, "expired")]
