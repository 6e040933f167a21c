"""Cache policies replayed over access traces: S3-FIFO with optional frequency admission.

A policy's state depends on every access before, so a trace is split by shard,
as the cache itself is, and each shard is replayed in order by one task that
reads it as a stream of batches; only the cache's own state is held.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Saturation of the reference bits and of frequency counts, and the sketch's depth.
MAX_REFERENCED, MAX_FREQUENCY, DEPTH = 2, 15, 4
MASK64 = (1 << 64) - 1


@dataclass(frozen=True)
class PolicyConfig:
    capacity: int
    shards: int = 8
    hot_percent: int = 90
    ghost_percent: int = 25
    promote_at: int = 1
    admission: str | None = None  # None, "plain", "packed", "doorkeeper" or "two_counter"
    gate: int | None = None  # newcomers seen at most so often before are turned away when full
    min_width: int = 64
    sample_floor: int = 0


class FrequencySketch:
    """Count-min sketch of recent accesses that is halved every ``sample`` of them."""

    def __init__(self, capacity: int, kind: str = "plain", min_width: int = 64, sample_floor: int = 0, sample: int | None = None) -> None:
        want = max(64, 4 * max(16, capacity), min_width)
        self.width = 1 << (want - 1).bit_length()
        self.sample = sample or max(8 * max(1, capacity), 64, sample_floor)
        self.most = MAX_FREQUENCY if kind in ("packed", "two_counter") else 255
        self.tables = [np.zeros((DEPTH, self.width), np.int32) for _ in range(2 if kind == "two_counter" else 1)]
        self.active, self.seen = 0, 0
        self.door: set[int] | None = set() if kind == "doorkeeper" else None

    def _columns(self, h: int) -> list[int]:
        return [_mix((h + row * 0x9E3779B97F4A7C15) & MASK64) & (self.width - 1) for row in range(DEPTH)]

    def estimate(self, h: int) -> int:
        cols = self._columns(h)
        return max(int(min(t[r, c] for r, c in enumerate(cols))) for t in self.tables)

    def add(self, h: int) -> int:
        """Count an access and return the estimate after it; with a doorkeeper the first access only opens the door."""
        if self.door is not None and h not in self.door:
            self.door.add(h)
        else:
            t = self.tables[self.active]
            for r, c in enumerate(self._columns(h)):
                if t[r, c] < self.most:
                    t[r, c] += 1
        self.seen += 1
        if self.seen >= self.sample:
            self._age()
        return self.estimate(h)

    def _age(self) -> None:
        self.seen = 0
        if len(self.tables) == 2:  # the table that rested is halved and takes over
            self.active ^= 1
        self.tables[self.active] >>= 1
        if self.door is not None:
            self.door.clear()


def _mix(h: int) -> int:
    h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & MASK64
    return h ^ (h >> 29)


class S3Fifo:
    """One shard: a cold and a hot queue of residents and a ghost queue of keys lately evicted from cold.

    New keys enter cold, keys remembered as ghosts enter hot.  Eviction takes
    the oldest cold key, which moves to hot instead if it was referenced often
    enough; the oldest hot key gets another round as long as it has references.
    With admission a victim seen more often than the newcomer stays resident in
    its stead, but in no queue, so it goes only when the queues are empty.
    """

    def __init__(self, capacity: int, config: PolicyConfig) -> None:
        self.capacity = max(1, capacity)
        self.hot_most = min(max(1, self.capacity * config.hot_percent // 100), self.capacity)
        self.ghost_most = self.capacity * config.ghost_percent // 100
        self.promote_at = min(max(1, config.promote_at), MAX_FREQUENCY)
        self.cold: OrderedDict = OrderedDict()
        self.hot: OrderedDict = OrderedDict()
        self.ghost: OrderedDict = OrderedDict()
        self.loose: OrderedDict = OrderedDict()
        self.loose_hot: set[int] = set()
        self.seen = FrequencySketch(self.capacity, "packed") if self.promote_at > 1 else None
        self.admission = FrequencySketch(self.capacity, config.admission, config.min_width, config.sample_floor) if config.admission else None
        self.gate = config.gate

    def read(self, key: int) -> bool:
        for queue in (self.cold, self.hot, self.loose):
            if key in queue:
                queue[key] = min(queue[key] + 1, MAX_REFERENCED)
                if self.seen is not None:
                    self.seen.add(key)
                return True
        return False

    def insert(self, key: int) -> None:
        if self.read(key):
            if self.admission is not None:
                self.admission.add(key)
            return
        rival = None
        if self.admission is not None:
            before = self.admission.estimate(key)
            rival = (key, self.admission.add(key))
            if self.gate is not None and len(self) >= self.capacity and before <= self.gate:
                return
        if self.seen is not None:
            self.seen.add(key)
        if key in self.ghost:
            del self.ghost[key]
            self.hot[key] = 1
        else:
            self.cold[key] = 0
        self._shrink(rival)

    def __len__(self) -> int:
        return len(self.cold) + len(self.hot) + len(self.loose)

    def remove(self, key: int) -> bool:
        self.loose_hot.discard(key)
        return any(queue.pop(key, None) is not None for queue in (self.cold, self.hot, self.loose))

    def _shrink(self, rival) -> None:
        while len(self) > self.capacity:
            if self.cold:
                self._evict_cold(rival)
            elif self.hot:
                self._evict_hot(rival)
            else:
                self.loose_hot.discard(self.loose.popitem(last=False)[0])
        while self.hot and len(self.hot) + len(self.loose_hot) > self.hot_most:
            self._evict_hot(rival)
        while len(self.ghost) > self.ghost_most:
            self.ghost.popitem(last=False)

    def _newcomer_yields(self, rival, victim: int) -> bool:
        if rival is None or rival[0] == victim or self.admission.estimate(victim) <= rival[1]:
            return False
        return self.remove(rival[0])

    def _evict_cold(self, rival) -> None:
        key, refs = self.cold.popitem(last=False)
        if refs >= self.promote_at or self.seen is not None and self.seen.estimate(key) >= self.promote_at:
            self.hot[key] = max(refs - 1, 0)
        elif self._newcomer_yields(rival, key):
            self.loose[key] = refs
        else:
            self.ghost[key] = None

    def _evict_hot(self, rival) -> None:
        key, refs = self.hot.popitem(last=False)
        if refs:
            self.hot[key] = refs - 1
        elif self._newcomer_yields(rival, key):
            self.loose[key] = 0
            self.loose_hot.add(key)


def replay(trace: DataFrame, config: PolicyConfig) -> DataFrame:
    """Replay reads (seq, key) through the policy, inserting on a miss: seq, key, shard, hit.

    Null keys are no accesses.  Accesses with one ``seq`` are taken in key order.
    """
    shards = 1 << (max(1, config.shards) - 1).bit_length()
    per_shard = max(1, -(-config.capacity // shards))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches: dict[int, S3Fifo] = {}
        for batch in batches:
            keys, shard = batch.column("key").to_pylist(), batch.column("shard").to_pylist()
            hits = []
            for k, s in zip(keys, shard):
                cache = caches.get(s)
                if cache is None:
                    caches.clear()  # sorted by shard: the one before is done
                    cache = caches[s] = S3Fifo(per_shard, config)
                hit = cache.read(k)
                if not hit:
                    cache.insert(k)
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("key"), batch.column("shard"), pa.array(hits, pa.bool_())], names=["seq", "key", "shard", "hit"])

    rows = trace.where("key is not null").select(F.col("seq").cast("bigint"), F.col("key").cast("bigint"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "seq", "key").mapInArrow(work, "seq bigint, key bigint, shard int, hit boolean")


def hit_ratio(replayed: DataFrame) -> DataFrame:
    """Accesses, hits and the hit ratio in per cent."""
    return replayed.agg(F.count(F.lit(1)).alias("accesses"), F.count_if("hit").alias("hits"), F.round(F.try_divide(100.0 * F.count_if("hit"), F.count(F.lit(1))), 3).alias("hit_percent"))


def sketch_estimates(trace: DataFrame, config: PolicyConfig, sample: int | None = None) -> DataFrame:
    """Each key of a trace (seq, key) with what its shard's frequency sketch thinks of it after all accesses.

    ``config.admission`` names the kind of sketch; ``sample`` is after how many
    accesses it ages, by default as the policy sets it.  A worker holds the distinct keys of its shards; null keys are no accesses.
    """
    shards = 1 << (max(1, config.shards) - 1).bit_length()
    per_shard = max(1, -(-config.capacity // shards))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches: dict[int, tuple[FrequencySketch, dict[int, None]]] = {}
        for batch in batches:
            for k, s in zip(batch.column("key").to_pylist(), batch.column("shard").to_pylist()):
                if s not in sketches:
                    sketches[s] = FrequencySketch(per_shard, config.admission or "plain", config.min_width, config.sample_floor, sample), {}
                sketches[s][0].add(k)
                sketches[s][1][k] = None
        for sketch, keys in sketches.values():
            yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.int64()), pa.array([sketch.estimate(k) for k in keys], pa.int64())], names=["key", "estimate"])

    rows = trace.where("key is not null").select(F.col("seq").cast("bigint"), F.col("key").cast("bigint"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "seq", "key").mapInArrow(work, "key bigint, estimate bigint")


def zipf_trace(spark: SparkSession, accesses: int, support: int, alpha: float, seed: int = 1) -> DataFrame:
    """A Zipf-distributed trace (seq, key): inverse distribution over hashed positions, the same on every run."""

    @F.pandas_udf("bigint")
    def draw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = np.cumsum(1.0 / np.arange(1, support + 1) ** alpha)  # once a task
        for u in batches:
            yield pd.Series(np.minimum(np.searchsorted(weights, u.to_numpy() * weights[-1]), support - 1))

    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return spark.range(accesses).select(F.col("id").alias("seq"), draw(u).alias("key"))


def hot_key_trace(spark: SparkSession, accesses: int, keys: int, hot_percent: int = 80, seed: int = 1) -> DataFrame:
    """A trace in which ``hot_percent`` of the accesses go to the first fifth of the keys."""
    pick = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(100))
    draw = F.xxhash64("id", F.lit(seed + 1))
    hot = max(1, keys // 5)
    return spark.range(accesses).select(F.col("id").alias("seq"), F.when(pick < hot_percent, F.pmod(draw, F.lit(hot))).otherwise(F.pmod(draw, F.lit(keys))).alias("key"))
