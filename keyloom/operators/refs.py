"""Declared references between collections, followed as joins; nothing is stored for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def include_forward(source: DataFrame, target: DataFrame, reference: str, key: str, prefix: str = "ref_") -> DataFrame:
    """Each source document with the document it refers to; null columns if there is none (N:1)."""
    renamed = target.select(*[F.col(c).alias(prefix + c) for c in target.columns])
    return source.join(renamed, F.col(reference) == F.col(prefix + key), "left")


def include_reverse(target_keys: DataFrame, source: DataFrame, key: str, reference: str) -> DataFrame:
    """Each wanted key with every source document that refers to it, one row each (1:N).

    Current rows are joined, so a source that was moved or deleted never shows
    up under its old target.  A wanted key need not exist itself.
    """
    return target_keys.select(F.col(key).alias("target_key")).distinct().join(source, F.col("target_key") == F.col(reference))


def reverse_counts(target: DataFrame, source: DataFrame, key: str, reference: str) -> DataFrame:
    """References per target key, 0 where none.  Sources are counted before the join, so a popular target costs one row a task."""
    counts = source.groupBy(F.col(reference).alias("kl_ref")).agg(F.count(F.lit(1)).alias("kl_n"))
    return target.select(key).join(counts, F.col(key) == F.col("kl_ref"), "left").select(key, F.coalesce("kl_n", F.lit(0).cast("bigint")).alias("references"))


def dangling(source: DataFrame, target: DataFrame, reference: str, key: str) -> DataFrame:
    """Source rows whose reference is not null and whose target does not exist."""
    keys = target.select(F.col(key).alias("kl_key")).distinct()
    return source.where(F.col(reference).isNotNull()).join(keys, F.col(reference) == F.col("kl_key"), "left_anti")
