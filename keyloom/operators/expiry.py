"""Expiry in logical ticks, idle selection and the cold tier."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keyloom.operators.segments import neighbour, running_sum
from keyloom.session import cut, file_bytes, file_system, publish_bytes


def expired(now: Column, last_touch: Column, expires_at: Column, tti_ticks: Column) -> Column:
    """True once the time to live has passed or the key was idle for its time to idle; 0 switches either off."""
    idle = F.greatest(now - last_touch, F.lit(0))
    return F.coalesce(((expires_at != 0) & (now >= expires_at)) | ((tti_ticks != 0) & (idle >= tti_ticks)), F.lit(False))


def ttl_spans(log: DataFrame, keys: Sequence[str], tick: str, ttl: Column) -> DataFrame:
    """When each write of a key ends: at its time to live or at the next write, whichever is first.

    Any later write removes the expiry of the one before, so only the last
    write's own time to live counts for it.
    """
    following, ends = F.col("next_write"), F.col(tick) + ttl
    rows = neighbour(log, keys, tick, F.col(tick), "next_write", ahead=True)
    return rows.withColumn("ends", F.least(ends, F.coalesce(following, ends))).withColumn("outlived", following.isNull() | (following >= ends))


def tti_sessions(log: DataFrame, keys: Sequence[str], tick: str, tti: Column) -> DataFrame:
    """Number the sessions of each key; a gap equal to ``tti`` already begins a new one."""
    rows = neighbour(log, keys, tick, F.col(tick), "kl_last")
    fresh = F.when(F.col("kl_last").isNull() | (F.col(tick) - F.col("kl_last") >= tti), 1).otherwise(0)
    return running_sum(rows, keys, tick, fresh, "session").drop("kl_last")


def expiry_meta(state: DataFrame, requested: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Version, last touch and times of the requested keys that hold a value; deleted and unknown keys have none."""
    rows = state.where(~F.coalesce("tombstone", F.lit(False))).select(*keys, "version", "last_touch", "expires_at", "tti_ticks")
    return requested.select(*keys).distinct().join(rows, list(keys))


def idle_dirty(state: DataFrame, now: Column, idle_ticks: int, limit: int | None = None, order: Sequence[str] = ("last_touch", "version")) -> DataFrame:
    """Dirty rows untouched for at least ``idle_ticks``, oldest first, at most ``limit``."""
    rows = state.where(F.col("dirty") & (now - F.col("last_touch") >= idle_ticks))
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def flush_idle(state: DataFrame, now: int, idle_ticks: int) -> tuple[DataFrame, DataFrame]:
    """The dirty rows idle for ``idle_ticks``, to be written behind, and the state without them: a flushed row is evicted."""
    idle = F.coalesce(F.col("dirty") & (F.lit(now) - F.col("last_touch") >= idle_ticks), F.lit(False))
    return state.where(idle), state.where(~idle)


def evict_idle(state: DataFrame, now: Column, idle_ticks: int) -> DataFrame:
    """Live rows idle for ``idle_ticks`` go, flushed or not; tombstones stay."""
    return state.where(F.col("tombstone") | (now - F.col("last_touch") < idle_ticks))


def _same(keys: Sequence[str], names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k, n in zip(keys, names):
        cond = cond & F.col(k).eqNullSafe(F.col(n))
    return cond


def evict_clean(state: DataFrame, requested: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state without the requested rows that need no flush; dirty ones stay."""
    names = [f"kl_k{i}" for i in range(len(keys))]
    asked = requested.select(*[F.col(k).alias(n) for k, n in zip(keys, names)]).distinct()
    return state.join(asked, _same(keys, names) & ~F.coalesce("dirty", F.lit(False)), "left_anti")


def load_clean(state: DataFrame, records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state with stored records (same columns) loaded as clean rows; a row held with the same or a higher version stays, tombstone or not.

    Of several records of a key the highest version is loaded.
    """
    names = [f"kl_k{i}" for i in range(len(keys))]
    rest = [c for c in state.columns if c not in (*keys, "version")]
    newest = records.groupBy(*keys).agg(F.max(F.struct("version", *rest)).alias("kl_b")).select(*keys, *[F.col(f"kl_b.`{c}`").alias(c) for c in ("version", *rest)])
    incoming = newest.withColumn("dirty", F.lit(False)).select(*state.columns)
    held = state.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("version").alias("kl_v"))
    loaded = incoming.join(held, _same(keys, names) & (F.col("kl_v") >= F.col("version")), "left_anti")
    gone = loaded.select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    return state.join(gone, _same(keys, names), "left_anti").unionByName(loaded)


def _old_enough(now: int, idle_ticks: int, min_clean_age: int) -> Column:
    """Untouched and unchanged for long enough; ticks ahead of the clock count as now, and 0 asks for no age."""
    return (F.greatest(F.lit(now) - F.col("last_touch"), F.lit(0)) >= idle_ticks) & (F.greatest(F.lit(now) - F.col("version"), F.lit(0)) >= min_clean_age)


def demote(hot: DataFrame, now: int, idle_ticks: int = 1024, most: int = 128, min_clean_age: int = 0, soft_limit: int | None = None) -> DataFrame:
    """The clean rows to move to the cold tier: old enough, coldest first, at most ``most``.

    With ``soft_limit`` no more than the rows beyond it go; at or below it none
    go unless an age is asked for.  Order: last touch, version, key.
    """
    if soft_limit is not None:
        size = hot.count()
        if size > soft_limit:
            most = min(most, size - soft_limit)
        elif idle_ticks == 0 and min_clean_age == 0:
            most = 0
    return hot.where(~F.col("dirty") & _old_enough(now, idle_ticks, min_clean_age)).orderBy("last_touch", "version", "key").limit(most)


def demotion_report(hot: DataFrame, now: int, idle_ticks: int = 1024, min_clean_age: int = 0) -> DataFrame:
    """Rows by what the demotion policy does with them."""
    what = F.when(F.col("dirty"), "skipped_dirty").when(~_old_enough(now, idle_ticks, min_clean_age), "skipped_recent").otherwise("candidate")
    return hot.groupBy(what.alias("disposition")).agg(F.count(F.lit(1)).alias("n"))


def not_buried(records: DataFrame, tombstones: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """Records that no tombstone of at least their version covers.

    Tombstones are first reduced to the largest version per key, which also
    keeps the join to one match a record.
    """
    top = tombstones.groupBy(*keys).agg(F.max(version).alias("kl_buried"))
    return records.join(top, list(keys), "left").where(F.col("kl_buried").isNull() | (F.col("kl_buried") < F.col(version))).drop("kl_buried")


def newest_cold(cold: DataFrame, keys: Sequence[str], generation: str = "generation") -> DataFrame:
    """The record of the newest generation per key."""
    rest = [c for c in cold.columns if c not in keys and c != generation]
    best = cold.groupBy(*keys).agg(F.max(F.struct(generation, *rest)).alias("kl_b"))
    return best.select(*keys, *[F.col(f"kl_b.`{c}`").alias(c) for c in (generation, *rest)])


def compact_cold(cold: DataFrame, tombstones: DataFrame, keys: Sequence[str], now: int, to_generation: int) -> DataFrame:
    """One new generation: newest per key, without what is deleted or expired."""
    rows = not_buried(newest_cold(cold, keys), tombstones, keys)
    rows = rows.where(~expired(F.lit(now), F.col("last_touch"), F.col("expires_at"), F.col("tti_ticks")))
    return rows.withColumn("generation", F.lit(to_generation))


def compaction_report(cold: DataFrame, tombstones: DataFrame, keys: Sequence[str], now: int) -> DataFrame:
    """Records by what :func:`compact_cold` does with them: superseded by a newer generation, deleted, expired or kept."""
    newest = newest_cold(cold, keys)
    alive = not_buried(newest, tombstones, keys)
    gone = F.count_if(expired(F.lit(now), F.col("last_touch"), F.col("expires_at"), F.col("tti_ticks")))
    counts = {"a": cold.agg(F.count(F.lit(1)).alias("n")), "b": newest.agg(F.count(F.lit(1)).alias("n")), "c": alive.agg(F.count(F.lit(1)).alias("n")), "d": alive.agg(gone.alias("n"))}
    rows = None
    for name, count in counts.items():
        part = count.select(F.lit(name).alias("name"), "n")
        rows = part if rows is None else rows.unionByName(part)
    row = rows.agg(*[F.max(F.when(F.col("name") == c, F.col("n"))).alias(c) for c in counts])
    what = {"superseded": F.col("a") - F.col("b"), "deleted": F.col("b") - F.col("c"), "expired": F.col("d"), "kept": F.col("c") - F.col("d")}
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("disposition"), v.cast("bigint").alias("n")) for k, v in what.items()])).alias("r")).select("r.*")


def read_through(hot: DataFrame, cold: DataFrame, tombstones: DataFrame, keys: Sequence[str], version: str = "version", value: str = "value") -> DataFrame:
    """What a read sees: the hot row, else the newest cold record that is not deleted.

    A hot tombstone hides any cold record; of a hot and a cold row the higher
    version wins, the hot one if equal.  ``hot``: keys, version, value,
    tombstone.  ``tier`` tells where the row came from; promoted rows come from cold.
    """
    c = not_buried(newest_cold(cold, keys), tombstones, keys).select(*keys, F.col(version).alias("kl_cv"), F.col(value).alias("kl_cx"))
    h = hot.select(*keys, F.col(version).alias("kl_hv"), F.col(value).alias("kl_hx"), "tombstone")
    j = h.join(c, list(keys), "full_outer")
    from_hot = F.col("kl_hv").isNotNull() & (F.col("tombstone") | F.col("kl_cv").isNull() | (F.col("kl_hv") >= F.col("kl_cv")))
    out = j.where(~(from_hot & F.coalesce("tombstone", F.lit(False))))
    return out.select(*keys, F.when(from_hot, F.col("kl_hv")).otherwise(F.col("kl_cv")).alias(version), F.when(from_hot, F.col("kl_hx")).otherwise(F.col("kl_cx")).alias(value), F.when(from_hot, "hot").otherwise("cold").alias("tier"))


def promotable(cold: DataFrame, hot: DataFrame, tombstones: DataFrame, keys: Sequence[str], now: int, version: str = "version") -> DataFrame:
    """Cold records that may become hot: newest, not deleted, not expired, and newer than any hot row, tombstone or not."""
    rows = not_buried(newest_cold(cold, keys), tombstones, keys, version)
    rows = rows.where(~expired(F.lit(now), F.col("last_touch"), F.col("expires_at"), F.col("tti_ticks")))
    held = hot.groupBy(*keys).agg(F.max(version).alias("kl_held"))
    return rows.join(held, list(keys), "left").where(F.col("kl_held").isNull() | (F.col("kl_held") < F.col(version))).drop("kl_held")


class ColdTier:
    """A stored cold tier: generations of demoted records and tombstones, listed by a numbered manifest that is published last.

    A record has the key columns, version, value, last_touch, expires_at and
    tti_ticks; a tombstone the key columns and version.  What a manifest doesn't
    list doesn't count, so a failed demotion or compaction leaves the tier as it
    was.  Of two writers from one state the second is refused.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)

    def manifest(self) -> dict:
        """The newest manifest; of an empty tier one that lists nothing."""
        p, fs = file_system(self.spark, f"{self.root}/_manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        last = max((n for n in names if n.endswith(".json") and n[:1] != "_"), default=None)
        return {"number": -1, "next": 1, "generations": [], "tombstones": []} if last is None else json.loads(file_bytes(self.spark, f"{self.root}/_manifests/{last}").decode())

    def _store(self, rows: DataFrame, kind: str) -> dict:
        path = f"{self.root}/{kind}/{uuid.uuid4().hex}"
        rows.sortWithinPartitions(*self.keys).write.mode("error").parquet(path)
        return {"path": path, "records": self.spark.read.schema(rows.schema).parquet(path).count()}

    def _publish(self, before: dict, **changes) -> dict:
        body = before | changes | {"number": before["number"] + 1}
        if not publish_bytes(self.spark, f"{self.root}/_manifests/{body['number']:020d}.json", json.dumps(body).encode(), overwrite=False):
            raise RuntimeError("the cold tier was changed by another writer")
        return body

    def add(self, records: DataFrame, tombstones: DataFrame | None = None) -> dict:
        """Store a new generation and the tombstones that came with it, and publish both."""
        m = self.manifest()
        generations = [*m["generations"], self._store(records, "generations") | {"id": m["next"]}]
        buried = m["tombstones"] if tombstones is None else [*m["tombstones"], self._store(tombstones.select(*self.keys, "version"), "tombstones")]
        return self._publish(m, generations=generations, tombstones=buried, next=m["next"] + 1)

    def _read(self, part: dict) -> DataFrame | None:
        """Stored rows, or None if they can't be read or aren't all there (Parquet footers tell)."""
        try:
            rows = self.spark.read.parquet(part["path"])
            return rows if rows.count() == part["records"] else None
        except (Py4JError, PySparkException):
            return None

    def records(self) -> DataFrame | None:
        """The records of all generations that can be read, with their ``generation``; None if there are none."""
        out = None
        for g in self.manifest()["generations"]:
            rows = self._read(g)
            if rows is not None:
                rows = rows.withColumn("generation", F.lit(g["id"]))
                out = rows if out is None else out.unionByName(rows)
        return out

    def tombstones(self) -> DataFrame | None:
        """All tombstones; that some can't be read is an error, since deleted records would come back."""
        out = None
        for t in self.manifest()["tombstones"]:
            rows = self._read(t)
            if rows is None:
                raise OSError(f"tombstones in {t['path']} can't be read")
            out = rows if out is None else out.unionByName(rows)
        return out

    def demote(self, hot: DataFrame, now: int, **policy) -> DataFrame:
        """Move what :func:`demote` picks to a new generation; the hot rows that stay.

        Rows leave the hot tier only after the generation is published.
        """
        picked = cut(demote(hot, now, **policy))
        live = picked.where(~F.col("tombstone"))
        meta = [F.col(c) if c in hot.columns else F.lit(0).cast("bigint").alias(c) for c in ("last_touch", "expires_at", "tti_ticks")]
        self.add(live.select(*self.keys, "version", "value", *meta), picked.where("tombstone"))
        gone = picked.select(*[F.col(k).alias(f"kl_{k}") for k in self.keys], F.col("version").alias("kl_version"))
        same = _same(self.keys, [f"kl_{k}" for k in self.keys]) & (F.col("version") == F.col("kl_version"))
        return hot.join(gone, same, "left_anti")

    def compact(self, now: int) -> dict:
        """One new generation instead of all: the newest per key, without what is deleted or expired; reports what went."""
        m, records, buried = self.manifest(), self.records(), self.tombstones()
        if records is None:
            return {"generations": 0, "records": 0, "kept": 0}
        none = records.select(*self.keys, "version").limit(0)
        kept = compact_cold(records, none if buried is None else buried, self.keys, now, m["next"]).drop("generation")
        stored = self._store(kept, "generations") | {"id": m["next"]}
        self._publish(m, generations=[stored], tombstones=[], next=m["next"] + 1)
        return {"generations": len(m["generations"]), "records": sum(g["records"] for g in m["generations"]), "kept": stored["records"]}

    def promote(self, hot: DataFrame, now: int) -> DataFrame:
        """The hot tier with the records that :func:`promotable` lets in, clean; they stay cold until they are compacted away or overwritten."""
        records, buried = self.records(), self.tombstones()
        if records is None:
            return hot
        none = records.select(*self.keys, "version").limit(0)
        new = promotable(records, hot, none if buried is None else buried, self.keys, now)
        cols = {"dirty": F.lit(False), "tombstone": F.lit(False), "last_touch": F.lit(now).cast("bigint")}
        new = new.select(*[(cols[c].alias(c) if c in cols else F.col(c) if c in new.columns else F.lit(None).cast(hot.schema[c].dataType).alias(c)) for c in hot.columns])
        stale = new.select(*[F.col(k).alias(f"kl_{k}") for k in self.keys])
        return hot.join(stale, _same(self.keys, [f"kl_{k}" for k in self.keys]), "left_anti").unionByName(new)
