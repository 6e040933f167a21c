"""Rebuilding current state from a feed of inserts, updates and deletes (problem 6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from keyloom.functions.keys import is_put


def as_changes(df: DataFrame, keys: Sequence[str], seq: str, op: str, payload: Sequence[str] = ()) -> DataFrame:
    """Bring a feed into the fold's shape: keys, ``kl_seq``, ``kl_live``, payload.

    Rows whose operation is neither Put nor Delete, or that lack a sequence
    number, can't be ordered and are left out.  The payload of a Delete means
    nothing and is emptied.
    """
    live = is_put(F.col(op))
    rows = df.select(*keys, F.col(seq).cast("bigint").alias("kl_seq"), live.alias("kl_live"), *[F.when(live, F.col(p)).alias(p) for p in payload])
    return rows.where("kl_seq is not null and kl_live is not null")


def fold_changes(changes: DataFrame, keys: Sequence[str], payload: Sequence[str] = (), base: DataFrame | None = None) -> DataFrame:
    """Fold changes, in any order and with any repetition, into one row per key.

    Takes the maximum of (sequence, operation, payload) per key.  The maximum
    is commutative, associative and idempotent, so copies, late and early
    arrivals all give the same result, partial results combine before the
    shuffle, and a hot key sends one row per task.  ``base`` is an earlier
    result of this function; its rows take part like any others.  Deleted keys
    stay as tombstones (``kl_live`` false) so that an older Put which arrives
    afterwards can't revive them.  Of two changes with one sequence number a Put
    outranks a Delete, then the larger payload wins.  Null key parts are keys
    like any other.

    Without payload the greatest (sequence, operation) is that of the greatest
    Put and the greatest Delete, so two numbers are folded, which keeps the
    aggregate in a hash table.
    """
    cols = [*keys, "kl_seq", "kl_live", *payload]
    rows = changes.select(*cols)
    if base is not None:
        rows = rows.unionByName(base.select(*cols))
    if not payload:
        put, gone = (F.max(F.when(F.col("kl_live") == x, F.col("kl_seq"))) for x in (True, False))
        best = rows.groupBy(*keys).agg(put.alias("kl_put"), gone.alias("kl_gone"))
        live = F.col("kl_put").isNotNull() & (F.col("kl_gone").isNull() | (F.col("kl_put") >= F.col("kl_gone")))
        return best.select(*keys, F.greatest("kl_put", "kl_gone").alias("kl_seq"), live.alias("kl_live"))
    best = rows.groupBy(*keys).agg(F.max(F.struct("kl_seq", "kl_live", *payload)).alias("kl_best"))
    return best.select(*keys, "kl_best.kl_seq", "kl_best.kl_live", *[f"kl_best.{p}" for p in payload])


def live(state: DataFrame) -> DataFrame:
    """The keys of a folded state that hold a value."""
    return state.where("kl_live").drop("kl_live")
