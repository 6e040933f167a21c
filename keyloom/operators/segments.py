"""Running values per key in which a hot key is split among tasks.

A plain window hands all rows of a key to one task.  Here the rows of a key are
split by ranges of their sequence number, each range is processed on its own,
and what it takes from the ranges before it comes from one small row per key
and range.  Ranges are fixed by the numbers alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Sequence numbers per range, as a power of two: at most as many rows of a key in a task if they are unique per key.
SEGMENT_BITS = 18


def _carry(df: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join ``parts`` (keys, kl_seg, carried columns) back; null key parts match."""
    names = {k: f"kl_j{i}" for i, k in enumerate(keys)}
    right = parts.withColumnsRenamed({**names, "kl_seg": "kl_js"})
    cond = F.col("kl_seg").eqNullSafe(F.col("kl_js"))
    for k, n in names.items():
        cond = cond & F.col(k).eqNullSafe(F.col(n))
    return df.join(right, cond, "left").drop("kl_js", *names.values())


def _segmented(df: DataFrame, seq: str, bits: int) -> DataFrame:
    return df.withColumn("kl_seg", F.shiftright(F.col(seq).cast("bigint"), bits))


def running_sum(df: DataFrame, keys: Sequence[str], seq: str, value: Column, to: str, inclusive: bool = True, bits: int = SEGMENT_BITS) -> DataFrame:
    """Sum of ``value`` over a key's rows up to each row in order of ``seq``, with or without the row itself.

    Rows of a key with one ``seq`` are ordered arbitrarily among each other;
    rows without one come first.
    """
    rows = _segmented(df.withColumn("kl_val", value), seq, bits)
    sums = rows.groupBy(*keys, "kl_seg").agg(F.sum("kl_val").alias("kl_sum"))
    before = Window.partitionBy(*keys).orderBy("kl_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("kl_base", F.sum("kl_sum").over(before)).drop("kl_sum")
    own = Window.partitionBy(*keys, "kl_seg").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    kind = sums.schema["kl_sum"].dataType
    zero = F.lit(0).cast(kind)
    out = _carry(rows.withColumn("kl_own", F.sum("kl_val").over(own)), carried, keys)
    return out.withColumn(to, (F.coalesce(F.col("kl_base").cast(kind), zero) + F.coalesce(F.col("kl_own"), zero)).cast(kind)).drop("kl_val", "kl_seg", "kl_base", "kl_own")


def neighbour(df: DataFrame, keys: Sequence[str], seq: str, value: Column, to: str, ahead: bool = False, bits: int = SEGMENT_BITS, tie: Sequence[str] = ()) -> DataFrame:
    """The value of the row before each row of a key in order of ``seq``, then ``tie``, or of the row after it; null at the end."""
    rows = _segmented(df.withColumn("kl_val", F.struct(value.alias("v"))), seq, bits)
    pick = F.min_by if ahead else F.max_by
    edge = rows.groupBy(*keys, "kl_seg").agg(pick("kl_val", F.struct(seq, *tie) if tie else F.col(seq)).alias("kl_edge"))
    by_seg = Window.partitionBy(*keys).orderBy("kl_seg")
    shift = F.lead if ahead else F.lag
    carried = edge.withColumn("kl_far", shift("kl_edge").over(by_seg)).drop("kl_edge")
    own = Window.partitionBy(*keys, "kl_seg").orderBy(seq, *tie)
    out = _carry(rows.withColumn("kl_near", shift("kl_val").over(own)), carried, keys)
    return out.withColumn(to, F.coalesce("kl_near", "kl_far")["v"]).drop("kl_val", "kl_seg", "kl_near", "kl_far")
