"""Other readers and writers: JSON lines, web archives, traces and byte-addressed files."""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_jsonl(spark: SparkSession, path: str, key: str = "url", value: str = "content") -> DataFrame:
    """JSON lines with a key and a value; lines where either is empty or missing are dropped."""
    rows = spark.read.schema(f"`{key}` string, `{value}` string").json(path)
    return rows.where((F.col(key) != "") & (F.col(value) != ""))


def write_jsonl(rows: DataFrame, path: str, columns: tuple[str, ...] = ("url", "content")) -> None:
    """Write the columns as JSON lines; binary content that is not UTF-8 becomes empty."""
    kinds = dict(rows.dtypes)
    cols = [F.when(F.is_valid_utf8(F.col(c).cast("string")), F.col(c).cast("string")).otherwise("").alias(c) if kinds[c] == "binary" else F.col(c) for c in columns]
    rows.select(*cols).write.mode("overwrite").json(path)


#: Compressed bytes that are read at a time, and content bytes that go into one Arrow batch.
CHUNK, BATCH_BYTES = 1 << 18, 8 << 20


class _Inflated(io.RawIOBase):
    """All gzip members of a stream one after the other, as far as they are whole, a chunk at a time."""

    def __init__(self, source) -> None:
        self.source, self.member, self.held, self.over = source, zlib.decompressobj(wbits=31), b"", False

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.over:
            try:
                data = self.member.decompress(self.held, len(into))
            except zlib.error:
                break
            self.held = self.member.unconsumed_tail
            if self.member.eof:
                self.held, self.member = self.member.unused_data, zlib.decompressobj(wbits=31)
            if data:
                into[: len(data)] = data
                return len(data)
            if not self.held:
                self.held = self.source.read(CHUNK)
                self.over = not self.held
        self.over = True
        return 0


def archive_records(source) -> Iterator[tuple[str, bytes]]:
    """(url, content) of the conversion records of a gzipped archive of one or more members, read from a stream; a record is held at a time."""
    f = io.BufferedReader(_Inflated(source), CHUNK)
    while line := f.readline():
        if not line.startswith(b"WARC/1.0"):
            continue
        head: dict[str, str] = {}
        while (line := f.readline()).strip():
            name, _, text = line.decode("utf-8", "replace").partition(":")
            head[name.strip()] = text.strip()
        size = int(head["Content-Length"]) if head.get("Content-Length", "").isdigit() else 0
        body = f.read(size)
        if len(body) < size:
            return
        if head.get("WARC-Type") == "conversion" and head.get("WARC-Target-URI") and size:
            yield head["WARC-Target-URI"], body


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """url and content (binary) of all conversion records under ``path``; a truncated file gives what precedes the cut.

    Spark only lists the files; workers read them as streams through Arrow's file systems.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                fs, at = FileSystem.from_uri(name if "://" in name else name.replace("file:", "file://", 1))
                urls, bodies, size = [], [], 0
                with fs.open_input_stream(at, compression=None) as source:
                    for url, body in archive_records(source):
                        urls.append(url)
                        bodies.append(body)
                        size += len(body)
                        if size >= BATCH_BYTES:
                            yield _pages(urls, bodies)
                            urls, bodies, size = [], [], 0
                yield _pages(urls, bodies)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(work, "url string, content binary")


def _pages(urls: list[str], bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(bodies, pa.binary())], names=["url", "content"])


def write_archives(rows: DataFrame, path: str, url: str = "url", content: str = "content") -> int:
    """Write (url, content) rows as gzipped archives of conversion records, a member a record and a file a partition; how many files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(path)
        out, tmp = None, f"{root}/.{uuid.uuid4().hex}.tmp"
        for batch in batches:
            for u, data in zip(batch.column("url").to_pylist(), batch.column("content").to_pylist()):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(tmp)
                body = data or b""
                head = f"WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: {u}\r\nContent-Length: {len(body)}\r\n\r\n"
                out.write(gzip.compress(head.encode() + body + b"\r\n\r\n", 1, mtime=0))
        if out is not None:
            out.close()
            fs.move(tmp, f"{root}/part-{tmp[-36:-4]}.wet.gz")
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["n"])

    return rows.select(F.col(url).cast("string").alias("url"), F.col(content).cast("binary").alias("content")).mapInArrow(work, "n bigint").count()


def read_trace(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """An access trace: the second column of CSV files, numbered in file order, at most ``limit`` rows."""
    rows = spark.read.schema("first string, key string").csv(path).select(F.monotonically_increasing_id().alias("seq"), "key").where("key is not null")
    return rows if limit is None else rows.orderBy("seq").limit(limit)


def page_read(content: Column, offset: int, length: int) -> dict[str, Column]:
    """Bytes of a file from ``offset``, filled with zeros to ``length``, and how many of them it has."""
    size = F.length(content)
    there = F.greatest(F.least(size - offset, F.lit(length)), F.lit(0))
    part = F.substring(content, offset + 1, length)
    return {"data": F.rpad(part, length, F.lit(b"\x00")), "available": there}


def page_write(content: Column, offset: int, data: bytes) -> Column:
    """The file with ``data`` at ``offset``; a hole before it is filled with zeros."""
    base = F.coalesce(content, F.lit(b""))
    before = F.rpad(F.substring(base, 1, offset), offset, F.lit(b"\x00")) if offset else F.lit(b"")
    return F.concat(before, F.lit(data), F.substring(base, F.lit(offset + len(data) + 1), F.greatest(F.length(base) - offset - len(data), F.lit(0))))


def page_truncate(content: Column, size: int) -> Column:
    """The file cut, or extended with zeros, to ``size`` bytes."""
    return F.rpad(F.substring(content, 1, size), size, F.lit(b"\x00")) if size else F.lit(b"")
