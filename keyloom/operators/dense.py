"""Dense lanes and keyed maps of small values: gather, scatter, dirty slots, conditional writes.

A lane is (idx, value, dirty); values have 63 bits.  Batches of commands come
as DataFrames, since one job per point write would be absurd.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from keyloom.operators.log import latest
from keyloom.operators.segments import neighbour, running_sum

MASK63 = (1 << 63) - 1
# Fixed value: the bits of a quiet NaN.
NAN_BITS = 0x7FF8000000000000


def gather(lane: DataFrame, wanted: DataFrame, missing: int = 0) -> DataFrame:
    """One value per wanted (ordinal, idx), repeats included; untouched slots hold ``missing``."""
    return wanted.select("ordinal", "idx").join(lane.select("idx", "value"), "idx", "left").select("ordinal", "idx", F.coalesce("value", F.lit(missing).cast("bigint")).alias("value"))


def scatter(lane: DataFrame, writes: DataFrame, seq: str, dirty: bool = True) -> DataFrame:
    """The lane after writes (idx, value, seq): the last write per slot holds, cut to 63 bits; clean loads pass ``dirty=False``."""
    last = latest(writes.select("idx", seq, "value"), ["idx"], seq).select("idx", F.col("value").bitwiseAND(F.lit(MASK63)).alias("kl_v"))
    j = lane.select("idx", "value", "dirty").join(last, "idx", "full_outer")
    hit = F.col("kl_v").isNotNull()
    return j.select("idx", F.coalesce("kl_v", "value").alias("value"), F.when(hit, F.lit(dirty)).otherwise(F.col("dirty")).alias("dirty"))


def fetch_add(lane: DataFrame, deltas: DataFrame, seq: str) -> DataFrame:
    """What each (idx, delta, seq) finds before it adds, modulo 2**63."""
    j = running_sum(deltas, ["idx"], seq, F.col("delta").cast("decimal(28,0)"), "kl_b", inclusive=False).join(lane.select("idx", F.col("value").alias("kl_start")), "idx", "left")
    total = F.coalesce("kl_start", F.lit(0).cast("bigint")).cast("decimal(37,0)") + F.col("kl_b").cast("decimal(37,0)")
    return j.withColumn("previous", F.pmod(total, F.lit("9223372036854775808").cast("decimal(38,0)")).cast("bigint")).drop("kl_b", "kl_start")


def dirty_slots(lane: DataFrame, most: int) -> DataFrame:
    """The first ``most`` dirty slots in order of their index."""
    return lane.where("dirty").orderBy("idx").limit(most)


def mark_clean(lane: DataFrame, slots: DataFrame) -> DataFrame:
    """Clear the dirty flag of the given slots; values stay."""
    done = slots.select("idx").distinct().withColumn("kl_done", F.lit(True))
    return lane.join(done, "idx", "left").withColumn("dirty", F.col("dirty") & F.col("kl_done").isNull()).drop("kl_done")


def bounded_drain(queue: DataFrame, shard: Column, order: Sequence[str], most: int) -> DataFrame:
    """Take up to ``most`` entries from a queue, first in first out in each shard, shard by shard.

    Entries of a shard beyond ``most`` can't be taken, so they are cut off on
    the map side before anything is sorted globally.
    """
    ranked = queue.withColumn("kl_shard", shard).withColumn("kl_rn", F.row_number().over(Window.partitionBy("kl_shard").orderBy(*order)))
    return ranked.where(F.col("kl_rn") <= most).orderBy("kl_shard", "kl_rn").limit(most).drop("kl_shard", "kl_rn")


def update_existing(table: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    """Replace the values of keys that exist; others are not inserted.  A key at most once in ``writes``."""
    new = writes.select(key, F.struct("value").alias("kl_new"))
    return table.join(new, key, "left").withColumn("value", F.when(F.col("kl_new").isNotNull(), F.col("kl_new.value")).otherwise(F.col("value"))).drop("kl_new")


def remove_if_value(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Remove keys that still hold the given value; null equals null."""
    w = wanted.select(F.col(key).alias("kl_k"), F.col("value").alias("kl_v"))
    return table.join(w, (F.col(key) == F.col("kl_k")) & F.col("value").eqNullSafe(F.col("kl_v")), "left_anti")


def insert_returning_old(table: DataFrame, writes: DataFrame, key: str, seq: str) -> DataFrame:
    """Each write with the value it replaced: the write before it, or what the table held."""
    j = neighbour(writes, [key], seq, F.struct("value"), "kl_p").join(table.select(key, F.struct("value").alias("kl_t")), key, "left")
    return j.withColumn("old_value", F.coalesce("kl_p", "kl_t")["value"]).drop("kl_p", "kl_t")


def packed(value: Column, kind: str) -> Column:
    """A value of up to 8 bytes as the bigint that a dense lane keeps: ``i64``, ``f64`` (its bits) or ``bool``; null stays null."""
    if kind == "f64":

        @F.pandas_udf("bigint")
        def bits(x: pd.Series) -> pd.Series:
            return pd.Series(x.to_numpy(np.float64, na_value=0.0).view(np.int64))

        x = value.cast("double")
        return F.when(x.isNotNull() & ~F.isnan(x), bits(F.when(x.isNotNull() & ~F.isnan(x), x).otherwise(0.0))).when(F.isnan(x), F.lit(NAN_BITS))
    if kind not in ("i64", "bool"):
        raise ValueError(f"unknown kind {kind!r}")
    return value.cast("bigint")


def unpacked(value: Column, kind: str) -> Column:
    """The value that :func:`packed` packed."""
    if kind == "f64":

        @F.pandas_udf("double")
        def number(x: pd.Series) -> pd.Series:
            return pd.Series(x.fillna(0).to_numpy(np.int64).view(np.float64))

        # Arrow takes a NaN from Pandas for a null.
        return F.when(value.isNotNull(), F.coalesce(number(F.coalesce(value, F.lit(0).cast("bigint"))), F.lit(float("nan"))))
    return value.cast("boolean") if kind == "bool" else value
