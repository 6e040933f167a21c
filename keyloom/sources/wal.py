"""Log segments and snapshots in the binary formats, as DataFrames.

The native form of a log is a Parquet table; these readers and writers move
data in and out.  Each segment file is decoded by one task.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession, functions as F

from keyloom.functions.checksums import crc32c, crc32c_many, fnv1a64
from keyloom.operators.log import append_with_lsn, assign_versions
from keyloom.session import cut

# Marks, versions and codes of the binary formats.
SEGMENT_MAGIC = int.from_bytes(b"MFSW", "little")
SNAPSHOT_MAGIC = int.from_bytes(b"MFSC", "little")
GENERIC_MAGIC = 0x4D465750
FOOTER_MAGIC = b"MFSOCFTR"
SEGMENT_VERSION, SNAPSHOT_VERSION = 2, 1
PUT, DELETE = 1, 2
GENERIC_PUT, GENERIC_DELETE = 0, 1
MAX_PAYLOAD, MAX_GENERIC_PAYLOAD, MAX_FIELD = 64 << 20, 128 << 20, 64 << 20

SEGMENT_SCHEMA = "segment string, position bigint, lsn bigint, version bigint, collection string, op string, key binary, value binary"
GENERIC_SCHEMA = "segment string, position bigint, version bigint, op string, key binary, value binary"


class WalCorruption(ValueError):
    """A segment broken elsewhere than at its torn tail; ``kind`` says how."""

    def __init__(self, kind: str, offset: int):
        super().__init__(f"{kind} at byte {offset}")
        self.kind, self.offset = kind, offset


def _blob(b: bytes) -> bytes:
    return struct.pack("<I", len(b)) + b


def _framed(magic: int, payloads: Iterable[bytes]) -> bytes:
    """Each payload with mark and length before it and a checksum over all of that behind."""
    frames = [struct.pack("<II", magic, len(p)) + p for p in payloads]
    ends = np.cumsum([len(f) for f in frames])
    sums = crc32c_many(b"".join(frames), ends - [len(f) for f in frames], ends) if frames else []
    return b"".join(x for f, c in zip(frames, sums) for x in (f, struct.pack("<I", c)))


def encode_segment(records: Iterable[tuple[int, int, str, str, bytes, bytes | None]]) -> bytes:
    """(lsn, version, collection, op, key, value) records as a segment."""

    def payload(lsn: int, version: int, collection: str, op: str, key: bytes, value: bytes | None) -> bytes:
        put = op == "put"
        return struct.pack("<HQQ", SEGMENT_VERSION, lsn, version) + _blob(collection.encode()) + bytes([PUT if put else DELETE]) + _blob(key) + _blob((value or b"") if put else b"")

    return _framed(SEGMENT_MAGIC, (payload(*r) for r in records))


def encode_generic(records: Iterable[tuple[int, str, bytes, bytes | None]]) -> bytes:
    """(version, op, key, value) records in the generic form."""
    return _framed(GENERIC_MAGIC, (bytes([GENERIC_PUT if op == "put" else GENERIC_DELETE]) + struct.pack("<Q", v) + _blob(k) + _blob(x or b"") for v, op, k, x in records))


def _frames(data: bytes, magic: int, most: int) -> tuple[list[int], list[int], list[bool], tuple[str, int] | None]:
    """Begin and end of each whole frame, whether its checksum holds, and what stopped the walk (None: the end or a record cut short)."""
    starts, ends, stop, at = [], [], None, 0
    while len(data) - at >= 8:
        mark, size = struct.unpack_from("<II", data, at)
        end = at + 8 + size + 4
        if mark != magic:
            stop = "bad_magic", at
        elif end > len(data):
            break
        elif size > most:
            stop = "payload_too_large", at
        if stop:
            break
        starts.append(at)
        ends.append(end)
        at = end
    sums = crc32c_many(data, starts, [e - 4 for e in ends]) if starts else []
    return starts, ends, [c == struct.unpack_from("<I", data, e - 4)[0] for c, e in zip(sums, ends)], stop


class _Cursor:
    def __init__(self, data: bytes, offset: int):
        self.data, self.at, self.offset = data, 0, offset

    def take(self, n: int) -> bytes:
        if len(self.data) - self.at < n:
            raise WalCorruption("malformed_record", self.offset)
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, fmt: str) -> int:
        return struct.unpack(fmt, self.take(struct.calcsize(fmt)))[0]

    def blob(self) -> bytes:
        n = self.number("<I")
        if n > MAX_FIELD:
            raise WalCorruption("field_too_large", self.offset)
        return self.take(n)

    def done(self) -> bool:
        return self.at == len(self.data)


def decode_segment(data: bytes) -> Iterator[tuple[int, int, int, str, str, bytes, bytes | None]]:
    """(offset, lsn, version, collection, op, key, value) of each record.

    A torn tail ends the segment quietly: a record cut short, or a wrong
    checksum on the last one.  Any other fault raises :class:`WalCorruption`.
    """
    starts, ends, sound, stop = _frames(data, SEGMENT_MAGIC, MAX_PAYLOAD)
    last = 0
    for at, end, good in zip(starts, ends, sound):
        if not good:
            if end == len(data):
                return
            raise WalCorruption("checksum_mismatch", at)
        c = _Cursor(data[at + 8 : end - 4], at)
        if c.number("<H") != SEGMENT_VERSION:
            raise WalCorruption("unknown_format_version", at)
        lsn, version = c.number("<Q"), c.number("<Q")
        try:
            collection = c.blob().decode()
        except UnicodeDecodeError as e:
            raise WalCorruption("malformed_record", at) from e
        code = c.take(1)[0]
        if code not in (PUT, DELETE):
            raise WalCorruption("unknown_operation", at)
        key, value = c.blob(), c.blob()
        if not collection or not c.done() or code == DELETE and value:
            raise WalCorruption("malformed_record", at)
        if lsn <= last:
            raise WalCorruption("non_monotonic_lsn", at)
        yield at, lsn, version, collection, "put" if code == PUT else "delete", key, value if code == PUT else None
        last = lsn
    if stop:
        raise WalCorruption(*stop)


def good_length(data: bytes) -> int:
    """Bytes of a segment up to the end of its last whole record; what follows is a torn tail."""
    starts, ends, sound, _ = _frames(data, SEGMENT_MAGIC, MAX_PAYLOAD)
    for start, good in zip(starts, sound):
        if not good:
            return start
    return ends[-1] if ends else 0


def decode_generic(data: bytes) -> Iterator[tuple[int, int, str, bytes, bytes | None]]:
    """(offset, version, op, key, value) of each record up to the first that is bad in any way.

    An empty value of a Put stays an empty value here.
    """
    starts, ends, sound, _ = _frames(data, GENERIC_MAGIC, MAX_GENERIC_PAYLOAD)
    for at, end, good in zip(starts, ends, sound):
        if not good:
            return
        c = _Cursor(data[at + 8 : end - 4], at)
        try:
            code, version, key, value = c.take(1)[0], c.number("<Q"), c.blob(), c.blob()
        except WalCorruption:
            return
        if code not in (GENERIC_PUT, GENERIC_DELETE) or not c.done():
            return
        yield at, version, "put" if code == GENERIC_PUT else "delete", key, value if code == GENERIC_PUT else None


def encode_snapshot(lsn: int, collections: dict[str, list[tuple[int, bytes, bytes | None]]], most: int = 1024, capacity: int = 1024) -> bytes:
    """Collections of (version, key, value or None for a tombstone) as a snapshot file."""
    body = struct.pack("<QQQIQ", lsn, most, capacity, len(collections), sum(map(len, collections.values())))
    for name, records in collections.items():
        body += _blob(name.encode()) + struct.pack("<Q", len(records))
        for version, key, value in records:
            body += struct.pack("<Q", version) + _blob(key) + (b"\x00" if value is None else b"\x01" + _blob(value))
    out = struct.pack("<IHQ", SNAPSHOT_MAGIC, SNAPSHOT_VERSION, len(body)) + body
    return out + struct.pack("<I", crc32c(out))


def decode_snapshot(data: bytes) -> tuple[int, list[tuple[str, int, bytes, bytes | None]]]:
    """(lsn, [(collection, version, key, value)]); any fault raises :class:`WalCorruption`."""
    if len(data) < 18:
        raise WalCorruption("malformed_checkpoint", 0)
    magic, version, size = struct.unpack_from("<IHQ", data)
    if magic != SNAPSHOT_MAGIC:
        raise WalCorruption("bad_magic", 0)
    if version != SNAPSHOT_VERSION:
        raise WalCorruption("unknown_format_version", 0)
    if len(data) != 18 + size:
        raise WalCorruption("malformed_checkpoint", 0)
    if crc32c(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise WalCorruption("checksum_mismatch", 0)
    c = _Cursor(data[14:-4], 0)
    lsn, _, _, n, total = (c.number(f) for f in ("<Q", "<Q", "<Q", "<I", "<Q"))
    out = []
    for _ in range(n):
        name = c.blob().decode()
        for _ in range(c.number("<Q")):
            v, key, mark = c.number("<Q"), c.blob(), c.take(1)[0]
            if v == 0 or mark > 1 or not name:
                raise WalCorruption("malformed_checkpoint", 0)
            out.append((name, v, key, c.blob() if mark else None))
    if not c.done() or len(out) != total:
        raise WalCorruption("malformed_checkpoint", 0)
    return lsn, out


def with_footer(body: bytes, lsn: int, records: int) -> bytes:
    """An object snapshot: a generic log followed by a footer with its LSN, count and checksum."""
    return body + FOOTER_MAGIC + struct.pack("<QQQ", lsn, records, fnv1a64(body))


def read_footer(data: bytes) -> tuple[int, int] | None:
    """(lsn, records) if the footer and what it says of the body hold, else None."""
    if len(data) < 32 or data[-32:-24] != FOOTER_MAGIC:
        return None
    lsn, records, checksum = struct.unpack("<QQQ", data[-24:])
    return (lsn, records) if fnv1a64(data[:-32]) == checksum else None


def read_segments(spark: SparkSession, path: str, after: int | None = None) -> DataFrame:
    """Records of all segment files under ``path``, strictly checked; only those beyond ``after`` if given."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [(name, *r) for r in decode_segment(data) if after is None or r[1] > after]
                yield _batch(rows, ["segment", "position", "lsn", "version", "collection", "op", "key", "value"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, SEGMENT_SCHEMA)


def read_generic(spark: SparkSession, path: str) -> DataFrame:
    """Records of all generic log files under ``path``, each up to its first bad record."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                yield _batch([(name, *r) for r in decode_generic(data)], ["segment", "position", "version", "op", "key", "value"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, GENERIC_SCHEMA)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)


def _write_files(rows: DataFrame, path: str, names: list[str], encode, suffix: str) -> int:
    """Write each partition of ``rows`` as one file named by its first number; files appear whole or not at all.

    Workers reach ``path`` through Arrow's file systems, so it may be any URI
    that those know.  A partition is written batch by batch as it comes.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, out, tmp = None, None, ""
        fs, root = FileSystem.from_uri(path)
        for batch in batches:
            records = list(zip(*(batch.column(c).to_pylist() for c in names)))
            if not records:
                continue
            if out is None:
                first = records[0][0]
                tmp = f"{root}/.{suffix}-{first:020d}-{uuid.uuid4().hex}.tmp"
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(tmp)
            out.write(encode(records))
        if out is not None:
            out.close()
            fs.move(tmp, f"{root}/segment-{first:020d}.{suffix}")
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64())], names=["first"])

    return rows.mapInArrow(work, "first bigint").count()


def write_segments(log: DataFrame, path: str) -> int:
    """Write a log (lsn, version, collection, op, key, value) as segment files, one per partition of its range; how many.

    The log is range-partitioned by LSN first, so that each segment is ordered
    and segments follow each other.  ``path`` is a URI.
    """
    names = ["lsn", "version", "collection", "op", "key", "value"]
    rows = log.select("lsn", "version", "collection", "op", F.col("key").cast("binary"), F.col("value").cast("binary"))
    return _write_files(rows.repartitionByRange("lsn").sortWithinPartitions("lsn"), path, names, encode_segment, "wal")


def write_generic(log: DataFrame, path: str) -> int:
    """Write a log (version, op, key, value) in the generic form, in order of version; how many files."""
    rows = log.select("version", "op", F.col("key").cast("binary"), F.col("value").cast("binary"))
    return _write_files(rows.repartitionByRange("version").sortWithinPartitions("version"), path, ["version", "op", "key", "value"], encode_generic, "log")


def write_object_snapshot(state: DataFrame, path: str, lsn: int) -> int:
    """Write a state (version, op, key, value) as object snapshot files, each a generic log with a footer of its own; how many.

    A task holds one file at a time; files have at most the rows of a partition.
    """
    names = ["version", "op", "key", "value"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names))]
        if records:
            fs, root = FileSystem.from_uri(path)
            fs.create_dir(root, recursive=True)
            name = f"{root}/snapshot-{lsn:020d}-{uuid.uuid4().hex}"
            with fs.open_output_stream(name + ".tmp") as out:
                out.write(with_footer(encode_generic(records), lsn, len(records)))
            fs.move(name + ".tmp", name + ".obj")
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["n"])

    rows = state.select("version", "op", F.col("key").cast("binary"), F.col("value").cast("binary"))
    return rows.mapInArrow(work, "n bigint").count()


def read_object_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Records of the object snapshot files under ``path`` with their snapshot's ``lsn``; a file whose footer doesn't hold, or with fewer records than it says, is left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                foot = read_footer(data)
                rows = list(decode_generic(data[:-32])) if foot else []
                if foot and len(rows) == foot[1]:
                    yield _batch([(foot[0], *r[1:]) for r in rows], ["lsn", "version", "op", "key", "value"], [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, "lsn bigint, version bigint, op string, key binary, value binary")


def truncate_torn_tails(spark: SparkSession, path: str) -> DataFrame:
    """Cut each segment file under ``path`` behind its last whole record; the files that were cut: segment, length, kept."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = []
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                kept = good_length(data)
                if kept < len(data):
                    fs, at = FileSystem.from_uri(name if "://" in name else name.replace("file:", "file://", 1))
                    with fs.open_output_stream(at + ".tmp") as out:
                        out.write(data[:kept])
                    fs.move(at + ".tmp", at)
                    cut.append((name, len(data), kept))
            yield _batch(cut, ["segment", "length", "kept"], [pa.string(), pa.int64(), pa.int64()])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "segment string, length bigint, kept bigint")
    return spark.createDataFrame(rows.collect(), rows.schema)


def append_segments(batch: DataFrame, path: str, order: Sequence[str]) -> DataFrame:
    """Append records (collection, op, key, value) to the log under ``path`` and return them with their lsn and version.

    Goes on from what is there: torn tails are cut, LSNs follow the last one, and
    the versions of each key its last one, as tombstones count too.
    """
    spark = batch.sparkSession
    fs, root = FileSystem.from_uri(path)
    if fs.get_file_info(root).type != FileType.NotFound:
        truncate_torn_tails(spark, f"{path}/*.wal")
        held = read_segments(spark, f"{path}/*.wal")
    else:
        held = spark.createDataFrame([], SEGMENT_SCHEMA)
    rows = append_with_lsn(held, batch, order)
    last = held.groupBy("collection", "key").agg(F.max("version").alias("kl_last"))
    counted = assign_versions(rows, ["collection", "key"], "lsn", "kl_n").join(last, ["collection", "key"], "left")
    done = cut(counted.withColumn("version", (F.coalesce("kl_last", F.lit(0)) + F.col("kl_n")).cast("bigint")).select("lsn", "version", "collection", "op", "key", "value"))
    write_segments(done, path)
    return done
