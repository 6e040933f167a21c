import random

from keyloom.operators import pages


def content(df, page):
    out = {}
    for r in df.orderBy("file", "page").collect():
        f = out.setdefault(r.file, bytearray())
        f.extend(b"\0" * (r.page * page - len(f)))
        f.extend(r.data)
    return {k: bytes(v) for k, v in out.items()}


def test_writes_reads_and_cuts_match_plain_files(spark):
    rng = random.Random(1)
    files: dict = {}
    df = spark.createDataFrame([], pages.SCHEMA)
    for _ in range(4):
        writes = [(rng.choice("abc"), rng.randrange(60), rng.randbytes(rng.randrange(0, 25)), n) for n in range(12)]
        for f, o, b, _ in writes:
            if b:
                old = files.setdefault(f, b"")
                files[f] = old[:o].ljust(o, b"\0") + b + old[o + len(b) :]
        rng.shuffle(writes)
        df = pages.write_at(df, spark.createDataFrame([*writes, (None, 1, b"x", 99), ("a", None, b"x", 99), ("a", 1, None, 99)], "file string, offset bigint, data binary, seq int"), page=8)
        df = spark.createDataFrame(df.collect(), pages.SCHEMA)
        assert content(df, 8) == files
    assert {r.file: r.length for r in pages.lengths(df, 8).collect()} == {k: len(v) for k, v in files.items()}
    reads = [(rng.choice("abcz"), rng.randrange(90), rng.randrange(40), n) for n in range(40)]
    got = {r.n: (bytes(r.data), r.available) for r in pages.read_at(df, spark.createDataFrame(reads, "file string, offset bigint, length int, n int"), page=8).collect()}
    for f, o, length, n in reads:
        part = files.get(f, b"")[o : o + length]
        assert got[n] == (part.ljust(length, b"\0"), len(part))
    cut = pages.truncate(df, spark.createDataFrame([("a", 5), ("b", 200), ("new", 9), ("c", 0)], "file string, length bigint"), page=8)
    want = {"a": files["a"][:5], "b": files["b"].ljust(200, b"\0"), "new": b"\0" * 9, "c": b""}
    assert content(cut, 8) == want and {r.file: r.length for r in pages.lengths(cut, 8).collect()} == {k: len(v) for k, v in want.items()}
    assert {r.file for r in pages.delete(df, spark.createDataFrame([("a",)], "file string")).collect()} == {"b", "c"}
    assert pages.read_at(df.limit(0), spark.createDataFrame([("a", 0, 3)], "file string, offset bigint, length int")).first()["available"] == 0
