"""Byte-addressed files as tables of pages, so that no file has to fit a row or a task.

A page row is (file, page, data): ``data`` holds up to PAGE bytes, shorter only
if the file ends there or the rest was never written; bytes that were never
written read as zeros.  A file's length is kept as where its last page ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of a page.
PAGE = 1 << 16
SCHEMA = "file string, page bigint, data binary"


def _zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n.cast("int")))


def _padded(data: Column, size: Column) -> Column:
    return F.concat(data, _zeros(F.greatest(size - F.octet_length(data), F.lit(0))))


def _overlaid(base: Column, start: Column, piece: Column) -> Column:
    """``base`` with ``piece`` written at ``start``; a hole before it is zeros."""
    head = F.substring(_padded(base, start), F.lit(1), start.cast("int"))
    tail = F.substring(base, (start + F.octet_length(piece) + 1).cast("int"), F.greatest(F.octet_length(base), F.lit(1)))
    return F.concat(head, piece, F.when(F.octet_length(base) > start + F.octet_length(piece), tail).otherwise(F.lit(b"")))


def write_at(pages: DataFrame, writes: DataFrame, page: int = PAGE) -> DataFrame:
    """The files after writes (file, offset, data, seq), applied in order of ``seq``.

    Each write is cut at page borders and only pages that are written to are
    changed; later writes win byte by byte.  Of a page that is written over and
    over only the last write of each range of bytes is shuffled by each task, so
    what is folded depends on the page, not on the number of writes.  Pages
    skipped between the end of a file and a write are not stored.  Writes with a null file, offset or data
    are none; an empty write changes nothing.
    """
    size = F.lit(page).cast("bigint")
    w = writes.where("file is not null and offset >= 0 and octet_length(data) > 0").select("file", F.col("offset").cast("bigint").alias("o"), "data", "seq")
    first, last = F.floor(F.col("o") / size).cast("bigint"), F.floor((F.col("o") + F.octet_length("data") - 1) / size).cast("bigint")
    cut = w.select("file", "o", "data", "seq", F.explode(F.sequence(first, last)).alias("page"))
    begin = F.greatest(F.col("page") * size, F.col("o"))
    end = F.least((F.col("page") + 1) * size, F.col("o") + F.octet_length("data"))
    piece = F.substring(F.col("data"), (begin - F.col("o") + 1).cast("int"), (end - begin).cast("int"))
    parts = cut.select("file", "page", "seq", (begin - F.col("page") * size).alias("start"), piece.alias("piece")).withColumn("n", F.octet_length("piece"))
    parts = parts.groupBy("file", "page", "start", "n").agg(F.max(F.struct("seq", "piece")).alias("b"))  # a later write of the same range hides all before
    parts = parts.groupBy("file", "page").agg(F.array_sort(F.collect_list(F.struct("b.seq", "start", "b.piece"))).alias("ps"))
    old = pages.select(F.col("file").alias("kl_f"), F.col("page").alias("kl_p"), F.col("data").alias("kl_d"))
    j = old.join(parts, (F.col("kl_f") == F.col("file")) & (F.col("kl_p") == F.col("page")), "full_outer")
    new = F.aggregate("ps", F.coalesce("kl_d", F.lit(b"")), lambda acc, x: _overlaid(acc, x["start"], x["piece"]))
    return j.select(F.coalesce("file", "kl_f").alias("file"), F.coalesce("page", "kl_p").alias("page"), F.when(F.col("ps").isNull(), F.col("kl_d")).otherwise(new).alias("data"))


def lengths(pages: DataFrame, page: int = PAGE) -> DataFrame:
    """Each file with its length."""
    return pages.groupBy("file").agg(F.max(F.col("page") * page + F.octet_length("data")).alias("length"))


def read_at(pages: DataFrame, reads: DataFrame, page: int = PAGE) -> DataFrame:
    """Each read (file, offset, length and any id columns) with its ``data``, and how many bytes of it the file has (``available``).

    What lies beyond the end or was never written is zeros.  Only the pages of
    the range are joined; the result of one read must fit a row.
    """
    ids = [c for c in reads.columns if c not in ("data", "available")]
    size = F.lit(page).cast("bigint")
    r = reads.select(*ids).withColumn("kl_id", F.struct(*ids)).withColumn("kl_n", F.greatest(F.col("length"), F.lit(0)))
    last = F.floor((F.col("offset") + F.greatest(F.col("kl_n"), F.lit(1)) - 1) / size).cast("bigint")
    need = r.select("kl_id", "kl_n", F.col("file").alias("kl_f"), F.col("offset").alias("kl_o"), F.explode(F.sequence(F.floor(F.col("offset") / size).cast("bigint"), last)).alias("kl_p")).distinct()
    j = need.join(pages, (F.col("kl_f") == F.col("file")) & (F.col("kl_p") == F.col("page")), "left")
    whole = _padded(F.coalesce("data", F.lit(b"")), size)
    got = j.groupBy("kl_id", "kl_n", "kl_f", "kl_o").agg(F.array_sort(F.collect_list(F.struct("kl_p", whole.alias("d")))).alias("ps"))
    body = F.aggregate("ps", F.lit(b""), lambda acc, x: F.concat(acc, x["d"]))
    data = F.substring(body, (F.pmod(F.col("kl_o"), size) + 1).cast("int"), F.col("kl_n").cast("int"))
    out = got.join(lengths(pages, page).withColumnRenamed("length", "kl_len"), F.col("kl_f") == F.col("file"), "left")
    there = F.greatest(F.least(F.coalesce("kl_len", F.lit(0)) - F.col("kl_o"), F.col("kl_n")), F.lit(0))
    return out.select(*[F.col(f"kl_id.{c}").alias(c) for c in ids], data.alias("data"), there.cast("bigint").alias("available"))


def truncate(pages: DataFrame, sizes: DataFrame, page: int = PAGE) -> DataFrame:
    """The files cut, or extended with zeros, to (file, length); length 0 leaves an empty file, other files stay as they are."""
    size = F.lit(page).cast("bigint")
    to = sizes.where("file is not null and length >= 0").groupBy(F.col("file").alias("kl_f")).agg(F.min("length").cast("bigint").alias("kl_l"))
    last = F.greatest(F.floor((F.col("kl_l") - 1) / size), F.lit(0)).cast("bigint")
    kept = pages.join(to, F.col("file") == F.col("kl_f"), "left").where(F.col("kl_l").isNull() | (F.col("page") < last)).select("file", "page", "data")
    ends = to.select("kl_f", "kl_l", last.alias("kl_p")).join(pages, (F.col("kl_f") == F.col("file")) & (F.col("kl_p") == F.col("page")), "left")
    n = F.col("kl_l") - F.col("kl_p") * size
    return kept.unionByName(ends.select(F.col("kl_f").alias("file"), F.col("kl_p").alias("page"), F.substring(_padded(F.coalesce("data", F.lit(b"")), n), F.lit(1), n.cast("int")).alias("data")))


def delete(pages: DataFrame, files: DataFrame) -> DataFrame:
    """The pages without those of the given files."""
    return pages.join(files.select("file").distinct(), "file", "left_anti")
