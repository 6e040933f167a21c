"""Write-behind as Structured Streaming: change streams into versioned tables.

A micro-batch is the unit of flushing.  Delivery is at least once and sinks are
guarded by version, so applying a batch twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from keyloom.functions.keys import is_put
from keyloom.operators.log import latest
from keyloom.session import file_system


def change_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """A directory of Parquet files as a stream; ``files_per_batch`` bounds a group commit."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start_flusher(changes: DataFrame, keys: Sequence[str], seq: str, flush: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Hand each micro-batch, reduced to the latest row per key, to ``flush``.

    ``flush`` may get a batch again after a failure, with the same number, and
    must be idempotent.  Stop with ``processAllAvailable()`` and ``stop()``.
    """

    def each(batch: DataFrame, number: int) -> None:
        flush(latest(batch, keys, seq), number)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def delta_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that stores each batch (key, sequence number, operation, columns) as a delta of its own and rewrites nothing.

    A batch that comes again replaces its own delta.  :func:`current_rows` reads
    the table, :func:`compact_table` folds old deltas into a base now and then.
    """

    def flush(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/delta-{number:012d}")

    return flush


def _parts(spark: SparkSession, path: str) -> tuple[int, str | None, list[tuple[int, str]]]:
    """Number and path of the newest complete base (-1 and None if there is none), and the complete deltas after it."""
    p, fs = file_system(spark, path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
    whole = [n for n in names if n[:6] in ("base-0", "delta-") and fs.exists(file_system(spark, f"{path}/{n}/_SUCCESS")[0])]
    base = max((n for n in whole if n.startswith("base-")), default=None)
    top = int(base[5:]) if base else -1
    deltas = [(int(n[6:]), f"{path}/{n}") for n in whole if n.startswith("delta-") and int(n[6:]) > top]
    return top, f"{path}/{base}" if base else None, deltas


def _folded(spark: SparkSession, path: str, key: str, lsn: str, op: str) -> tuple[int, DataFrame | None]:
    """The newest row per key of base and deltas, deletes included, and the number of the last delta.

    Of rows with one LSN a delete holds, else the one of the earliest batch, as
    if each batch had been merged in turn by version guard.
    """
    top, base, deltas = _parts(spark, path)
    frames = ([spark.read.parquet(base).withColumn("kl_batch", F.lit(-1).cast("bigint"))] if base else []) + [spark.read.parquet(d).withColumn("kl_batch", F.lit(n).cast("bigint")) for n, d in deltas]
    if not frames:
        return top, None
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    rest = [c for c in rows.columns if c not in (key, lsn, "kl_batch")]
    best = rows.groupBy(key).agg(F.max(F.struct(F.col(lsn), (~is_put(F.col(op))).alias("kl_gone"), (-F.col("kl_batch")).alias("kl_early"), *rest)).alias("kl_b"))
    names = [c for c in rows.columns if c != "kl_batch"]
    return max([top, *(n for n, _ in deltas)]), best.select(*[F.col(key) if c == key else F.col(f"kl_b.`{c}`").alias(c) for c in names])


def current_rows(spark: SparkSession, path: str, key: str, lsn: str, op: str = "op") -> DataFrame | None:
    """The live rows of a table that :func:`delta_sink` writes; None before the first batch."""
    _, rows = _folded(spark, path, key, lsn, op)
    return None if rows is None else rows.where(is_put(F.col(op))).drop(op)


def compact_table(spark: SparkSession, path: str, key: str, lsn: str, op: str = "op") -> int:
    """Fold all deltas into a new base and delete what it replaces; the number of the last delta in it.

    Tombstones stay in the base, so that late rows can't revive their keys.  The
    base counts once it is complete; readers of the old parts must have ended.
    """
    top, base, deltas = _parts(spark, path)
    last, rows = _folded(spark, path, key, lsn, op)
    if rows is None or not deltas:
        return last
    rows.write.mode("overwrite").parquet(f"{path}/base-{last:012d}")
    for old in ([base] if base else []) + [d for _, d in deltas]:
        p, fs = file_system(spark, old)
        fs.delete(p, True)
    return last


def append_log(changes: DataFrame, path: str, checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Append a stream to a Parquet log; a record is durable once its micro-batch is committed."""
    return changes.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def deduplicated(changes: DataFrame, ident: Sequence[str], arrived: str, horizon: str) -> DataFrame:
    """The first of each message within the watermark; for copies beyond it use the batch anti-join on stored identifiers."""
    return changes.withWatermark(arrived, horizon).dropDuplicatesWithinWatermark(list(ident))
