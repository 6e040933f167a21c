"""Snapshot plus log suffix: checkpoints, recovery, retention and their checks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from keyloom.operators.log import latest, live_rows
from keyloom.operators.segments import neighbour
from keyloom.session import file_bytes, file_system, publish_bytes


def recover(snapshot: DataFrame, log: DataFrame, keys: Sequence[str], seq: str, checkpoint_lsn: int | None, op: str = "op") -> DataFrame:
    """Current live rows from a snapshot and the log records after its sequence number.

    The suffix filter reaches the scan; a log partitioned or clustered by
    sequence number is read from there on only.  Without a checkpoint the whole
    log is replayed.  The last record in log order wins.
    """
    suffix = log if checkpoint_lsn is None else log.where(F.col(seq) > F.lit(checkpoint_lsn))
    return live_rows(latest(snapshot.unionByName(suffix), keys, seq), op)


def snapshot_at(log: DataFrame, keys: Sequence[str], seq: str, lsn: int) -> DataFrame:
    """All keys as of ``lsn``, tombstones included, in the shape of the log."""
    return latest(log.where(F.col(seq) <= F.lit(lsn)), keys, seq)


def checkpoint_metadata(snapshot: DataFrame, collection: str = "collection") -> DataFrame:
    """Records per collection; tombstones count."""
    return snapshot.groupBy(collection).agg(F.count(F.lit(1)).alias("record_count"))


def keep_last(rows: DataFrame, by: Sequence[str], order: str, n: int) -> DataFrame:
    """The ``n`` newest rows per group; with 0, all (retention switched off).

    Ranks are limited on the map side, so a hot group sends ``n`` rows per task.
    """
    if n == 0:
        return rows
    return rows.withColumn("kl_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))).where(F.col("kl_rn") <= n).drop("kl_rn")


def sequence_faults(log: DataFrame, by: Sequence[str], position: str, seq: str) -> DataFrame:
    """Log rows whose sequence number does not exceed the one before it, in order of the timestamp ``position``, then of ``seq``; adds ``previous_lsn``.

    A group is split by ranges of time (of 2**36 microseconds, some 19 hours), so
    a long log is no one task's burden.
    """
    rows = log.withColumn("kl_micros", F.unix_micros(F.col(position).cast("timestamp")))
    found = neighbour(rows, by, "kl_micros", F.col(seq), "previous_lsn", bits=36, tie=(seq,))
    return found.where(F.col(seq) <= F.col("previous_lsn")).drop("kl_micros")


def recover_objects(log: DataFrame, metadata_prefix: str, key: str = "key", version: str = "version", now: int | None = None) -> DataFrame:
    """Live objects with their expiry, from one log that holds both values and expiry records.

    A record under ``metadata_prefix`` + key carries, as JSON, the expiry of the
    value of the same key and version; it says nothing about other versions.
    Objects expired at tick ``now`` are left out (none if ``now`` is not given).
    """
    from keyloom.operators.expiry import expired

    n = len(metadata_prefix)
    text = F.col(key).cast("string")
    meta_row = text.startswith(metadata_prefix)
    values = live_rows(latest(log.where(~meta_row), [key], version))
    schema = "version bigint, last_touch bigint, expires_at bigint, tti_ticks bigint"
    meta = live_rows(log.where(meta_row)).select(F.substring(text, F.lit(n + 1), F.length(text)).alias("kl_mk"), F.col(version).alias("kl_mv"), F.from_json(F.col("value").cast("string"), schema).alias("kl_m"))
    meta = meta.groupBy("kl_mk", "kl_mv").agg(F.max("kl_m").alias("kl_m"))
    joined = values.join(meta, (text == F.col("kl_mk")) & (F.col(version) == F.col("kl_mv")), "left")
    out = joined.select(*values.columns, F.col("kl_m.last_touch").alias("last_touch"), F.coalesce("kl_m.expires_at", F.lit(0).cast("bigint")).alias("expires_at"), F.coalesce("kl_m.tti_ticks", F.lit(0).cast("bigint")).alias("tti_ticks"))
    return out if now is None else out.where(~expired(F.lit(now), F.coalesce("last_touch", version), F.col("expires_at"), F.col("tti_ticks")))


class CheckpointStore:
    """Snapshots as Parquet directories; one counts once its marker, written last, says how many records it has."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, lsn: int) -> str:
        return f"{self.root}/ckpt-{lsn:020d}"

    def write(self, snapshot: DataFrame, lsn: int) -> str:
        """Write the rows, then the marker: readers see all of it or nothing."""
        final = self.path(lsn)
        p, fs = file_system(self.spark, final)
        fs.delete(p, True)
        snapshot.write.mode("error").parquet(f"{final}/rows")
        n = self.spark.read.parquet(f"{final}/rows").count()
        publish_bytes(self.spark, f"{final}/marker.json", json.dumps({"lsn": lsn, "records": n}).encode())
        return final

    def lsns(self) -> list[int]:
        """Sequence numbers of marked snapshots, newest first."""
        root, fs = file_system(self.spark, self.root)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        found = [int(n[5:]) for n in names if n.startswith("ckpt-")]
        return sorted((x for x in found if fs.exists(file_system(self.spark, f"{self.path(x)}/marker.json")[0])), reverse=True)

    def load(self, lsn: int) -> DataFrame | None:
        """The snapshot, or None if it can't be read or has not as many records as its marker says (Parquet footers tell)."""
        try:
            head = json.loads(file_bytes(self.spark, f"{self.path(lsn)}/marker.json").decode())
            rows = self.spark.read.parquet(f"{self.path(lsn)}/rows")
            return rows if head["lsn"] == lsn and rows.count() == head["records"] else None
        except (ValueError, KeyError, TypeError, Py4JError, PySparkException):
            return None

    def load_latest(self) -> tuple[int, DataFrame] | None:
        """The newest snapshot that can be read; broken ones are passed over."""
        for lsn in self.lsns():
            rows = self.load(lsn)
            if rows is not None:
                return lsn, rows
        return None

    def checkpoint_and_reset(self, log: DataFrame, keys: Sequence[str], seq: str, keep: int = 2) -> tuple[int, DataFrame]:
        """Write a snapshot of the whole log, prune old ones, and return its number and the log that remains: none of it."""
        lsn = log.agg(F.max(seq)).first()[0] or 0
        before = self.load_latest()
        base = latest(log if before is None else before[1].unionByName(log), keys, seq)
        self.write(base, lsn)
        self.prune(keep)
        return lsn, log.where(F.col(seq) > F.lit(lsn))

    def prune(self, keep: int = 2) -> list[int]:
        """Delete all but the newest ``keep`` snapshots that can be read, and those that can't and are older; 0 keeps everything."""
        lsns, gone, sound = self.lsns(), [], 0
        for lsn in lsns if keep else []:
            if sound >= keep:
                p, fs = file_system(self.spark, self.path(lsn))
                fs.delete(p, True)
                gone.append(lsn)
            elif self.load(lsn) is not None:
                sound += 1
        return gone
