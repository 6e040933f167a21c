"""The change log: versions, latest-wins resolution, guards and counts.

A log is a DataFrame with key columns, a sequence column (``lsn``), an operation
and payload columns.  Deletes are tombstone rows, also for keys that never
existed, and they take part in version counting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from keyloom.functions.keys import is_put
from keyloom.operators.segments import neighbour, running_sum
from keyloom.session import cut


def latest(log: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The row with the highest ``seq`` per key, tombstones included.

    An aggregate of maximum structs: order does not matter, copies do not
    matter, and a hot key sends one row per task.  Rows with a null ``seq``
    rank below all others.
    """
    rest = [c for c in log.columns if c not in keys and c != seq]
    best = log.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("kl_b"))
    return best.select(*keys, *[F.col(f"kl_b.`{c}`").alias(c) for c in (seq, *rest)]).select(*log.columns)


def live_rows(state: DataFrame, op: str = "op") -> DataFrame:
    """Rows whose last operation is a Put; an unknown operation is not live."""
    return state.where(is_put(F.col(op)))


def assign_versions(log: DataFrame, keys: Sequence[str], seq: str, to: str = "version") -> DataFrame:
    """Dense versions 1, 2, 3, … per key in log order, running on through tombstones."""
    return running_sum(log, keys, seq, F.lit(1).cast("bigint"), to)


def previous_value(log: DataFrame, keys: Sequence[str], seq: str, value: str, to: str = "previous") -> DataFrame:
    """What a key held before each write; null for its first."""
    return neighbour(log, keys, seq, F.col(value), to)


def count_live(log: DataFrame, keys: Sequence[str], seq: str, collection: str, op: str = "op") -> DataFrame:
    """Live keys per collection."""
    return live_rows(latest(log.select(*dict.fromkeys([*keys, collection, seq, op])), keys, seq), op).groupBy(collection).agg(F.count(F.lit(1)).alias("live"))


def tombstone_versions(log: DataFrame, keys: Sequence[str], seq: str, op: str = "op") -> DataFrame:
    """The largest deleted sequence number per key."""
    return log.where(~is_put(F.col(op))).groupBy(*keys).agg(F.max(seq).alias("tombstone"))


def drop_stale(batch: DataFrame, current: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows of a batch that are newer than what is stored; older ones never overwrite."""
    held = current.groupBy(*keys).agg(F.max(version).alias("kl_held"))
    return batch.join(held, list(keys), "left").where(F.col("kl_held").isNull() | (F.col(version) > F.col("kl_held"))).select(*batch.columns)


def split_conflicts(batch: DataFrame, current: DataFrame, keys: Sequence[str], version: str = "version", expected: str = "expected_version") -> tuple[DataFrame, DataFrame]:
    """Rows whose expected version is the current one, and the others with ``actual_version``.

    A missing key has version 0; a tombstone keeps its version.  A null
    expectation is unconditional.  The batch should hold a key at most once.
    """
    held = current.groupBy(*keys).agg(F.max(version).alias("actual_version"))
    joined = batch.join(held, list(keys), "left").withColumn("actual_version", F.coalesce("actual_version", F.lit(0).cast("bigint")))
    fits = F.col(expected).isNull() | (F.col(expected) == F.col("actual_version"))
    return joined.where(fits).drop("actual_version"), joined.where(~fits)


def append_with_lsn(log: DataFrame, batch: DataFrame, order: Sequence[str], lsn: str = "lsn") -> DataFrame:
    """Give the rows of ``batch`` the sequence numbers after the log's last, in ``order``.

    Positions are counted per partition of a range-partitioned sort and shifted
    by the sizes of the partitions before, so no task sees all rows.  The sorted
    partitions are written to the shared folder once: the bounds come from a
    sample, and both the counting and the shifting must see the same ones.
    """
    spark = batch.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(batch.repartitionByRange(parts, *order).withColumn("kl_p", F.spark_partition_id()))
    local = ranged.withColumn("kl_n", F.row_number().over(Window.partitionBy("kl_p").orderBy(*order)))
    sizes = ranged.groupBy("kl_p").agg(F.count(F.lit(1)).alias("kl_size"))
    before = F.coalesce(F.sum("kl_size").over(Window.orderBy("kl_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("kl_p", before.alias("kl_before"))  # one row per partition
    last = log.agg(F.coalesce(F.max(lsn), F.lit(0)).alias("m")).scalar()
    return local.join(F.broadcast(shifts), "kl_p").withColumn(lsn, (last + F.col("kl_before") + F.col("kl_n")).cast("bigint")).drop("kl_p", "kl_n", "kl_before")


def high_water_mark(log: DataFrame, by: Sequence[str], seq: str) -> DataFrame:
    """The highest sequence number given out so far, per group: what a checkpoint taken now covers."""
    return log.groupBy(*by).agg(F.max(seq).alias("high_water_mark"))


def rebuilt(log: DataFrame, keys: Sequence[str], seq: str, op: str = "op") -> DataFrame:
    """The log without superseded rows and tombstones, for a compact rewrite."""
    return live_rows(latest(log, keys, seq), op)


def store_stats(log: DataFrame, keys: Sequence[str], seq: str, dirty: Column, op: str = "op") -> DataFrame:
    """One row: live keys, tombstones, dirty keys, and the clock."""
    state = latest(log.select(*keys, seq, op, dirty.alias("kl_dirty")), keys, seq)
    live = is_put(F.col(op))
    return state.agg(F.count_if(live).alias("live"), F.count_if(~live).alias("tombstones"), F.count_if("kl_dirty").alias("dirty"), F.max(seq).alias("clock"))


def frequencies(log: DataFrame, keys: Sequence[str], most: int | None = None) -> DataFrame:
    """Exact accesses per key; with ``most`` as a saturating counter would show them."""
    n = F.count(F.lit(1))
    return log.groupBy(*keys).agg((F.least(n, F.lit(most).cast("bigint")) if most else n).alias("accesses"))


def sketch_frequencies(log: DataFrame, key: str, eps: float = 0.001, confidence: float = 0.99, seed: int = 7) -> DataFrame:
    """A count-min sketch of key accesses as one binary value; sketches of parts merge before the shuffle."""
    return log.agg(F.count_min_sketch(F.col(key), F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))
