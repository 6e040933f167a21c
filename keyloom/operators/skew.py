"""Per-key results when a few keys hold most of the rows (problem 2)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: A key is heavy from this share of the rows on; at most 1 / HEAVY_SHARE keys can be.
HEAVY_SHARE = 0.001
#: Counters of the frequent-items sketch.  Its error is below 4 / SKETCH_ITEMS of
#: all rows, a quarter of HEAVY_SHARE, so no heavy key goes unseen.
SKETCH_ITEMS = 16384
#: Salts that a heavy key is spread over.
SALTS = 64


@dataclass(frozen=True)
class Fold:
    """A decomposable aggregate: ``kind`` is count, sum, min or max over ``value``."""

    name: str
    kind: str
    value: Column | None = None

    def partial(self) -> Column:
        if self.kind == "count":
            return F.count(F.lit(1) if self.value is None else self.value).alias(self.name)
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](self.value).alias(self.name)

    def merge(self) -> Column:
        return {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}[self.kind](F.col(self.name)).alias(self.name)


def _sketch(share: float) -> Column:
    """A frequent-items sketch of the column kl_hash, merged from fixed-size parts; its result has at most ``1 / share`` items."""
    return F.expr(f"approx_top_k(kl_hash, {int(1 / share)}, {SKETCH_ITEMS})").alias("kl_top")


def heavy_hashes(df: DataFrame, keys: Sequence[str], share: float = HEAVY_SHARE) -> DataFrame:
    """Hashes of the keys that hold at least ``share`` of the rows, perhaps a few lighter ones.

    One scan of the key columns, merged as fixed-size sketches; at most
    ``1 / share`` rows come out, which is the size bound for broadcasting it.
    """
    rows = df.select(F.xxhash64(*keys).alias("kl_hash"))
    sketch = rows.agg(_sketch(share))
    return sketch.select(F.explode("kl_top").alias("kl_item")).select(F.col("kl_item.item").alias("kl_hash")).where("kl_hash is not null")


def _salted(rows: DataFrame, keys: Sequence[str], folds: Sequence[Fold], salt: Column) -> DataFrame:
    """Partial results per key and salt, then per key."""
    stage1 = rows.withColumn("kl_salt", salt).groupBy(*keys, "kl_salt").agg(*[f.partial() for f in folds])
    return stage1.groupBy(*keys).agg(*[f.merge() for f in folds])


def _running_salt(salts: int) -> Column:
    return F.pmod(F.monotonically_increasing_id(), F.lit(salts))


def salted_fold(df: DataFrame, keys: Sequence[str], folds: Sequence[Fold], share: float = HEAVY_SHARE, salts: int = SALTS) -> DataFrame:
    """Aggregate per key in two stages, heavy keys by way of ``salts`` partial results.

    Stage one groups by key and salt, where only heavy keys have salts other
    than 0; stage two merges the partial results by key.  The salt is a row's
    running number, not a random draw: it spreads identical rows as well and is
    the same when a lost task runs again.  Results are exact whichever keys are
    taken for heavy.  Null keys form groups like any other value; an empty input
    gives no rows; other columns of ``df`` are ignored whatever their names.
    """
    kl_keys = [f"kl_k{i}" for i in range(len(keys))]
    values = [f.value.alias(f"kl_v{i}") for i, f in enumerate(folds) if f.value is not None]
    rows = df.select(*[F.col(k).alias(a) for k, a in zip(keys, kl_keys)], *values)
    inner = [Fold(f.name, f.kind, None if f.value is None else F.col(f"kl_v{i}")) for i, f in enumerate(folds)]
    heavy = heavy_hashes(rows.select(*kl_keys), kl_keys, share).withColumn("kl_heavy", F.lit(True))
    marked = rows.withColumn("kl_hash", F.xxhash64(*kl_keys)).join(F.broadcast(heavy), "kl_hash", "left")
    merged = _salted(marked, kl_keys, inner, F.when(F.col("kl_heavy"), _running_salt(salts)).otherwise(F.lit(0).cast("bigint")))
    return merged.select(*[F.col(a).alias(k) for k, a in zip(keys, kl_keys)], *[f.name for f in folds])


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float, salts: int = SALTS) -> DataFrame:
    """The keys that hold at least ``share`` of all rows, with their ``records``.

    One scan counts the rows and takes a sketch, whose error is below
    4 / SKETCH_ITEMS of the rows, so with ``share`` of at least HEAVY_SHARE every
    such key is among the at most ``1 / HEAVY_SHARE`` candidates (hashes, read to
    the driver).  A second scan counts the candidates alone, exactly and by way
    of salts; rows of other keys are never shuffled.  An empty input gives no rows.
    """
    if share < HEAVY_SHARE:
        raise ValueError(f"share must be at least {HEAVY_SHARE}")
    names = [f"kl_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(a) for k, a in zip(keys, names)]).withColumn("kl_hash", F.xxhash64(*names))
    top, total = rows.agg(_sketch(HEAVY_SHARE), F.count(F.lit(1))).first()
    candidates = [x["item"] for x in top or [] if x["item"] is not None and x["count"] > 0]
    merged = _salted(rows.where(F.col("kl_hash").isin(candidates)), names, [Fold("records", "count")], _running_salt(salts))
    return merged.where(F.col("records") >= F.lit(share) * total).select(*[F.col(a).alias(k) for k, a in zip(keys, names)], "records")
