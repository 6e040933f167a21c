"""Typed objects in long format: counters, bytes, lists, hashes, sets and scored sets.

A container is one row per element; a key without elements does not exist.
Command logs have a total order (``seq``); where commands commute with others
on other elements they are aggregates, elsewhere windows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from keyloom.operators.segments import running_sum

MAX_I64 = (1 << 63) - 1


def rank_range(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], start: int, stop: int) -> DataFrame:
    """Elements by 0-based rank from ``start`` to ``stop`` inclusive; negative ranks count from the end.

    A head range needs ranks from the front only and a tail range from the back,
    both of which Spark limits on the map side.  A range from the front to the
    back is all rows without a head and a tail, which are sets of rows with
    repetitions, so order among equal rows doesn't matter.  A range from the back
    to the front can hold something only of keys with few elements.
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    front = Window.partitionBy(*keys).orderBy(*cols)
    back = Window.partitionBy(*keys).orderBy(*[c.desc() for c in cols])
    if start >= 0 and stop >= 0:
        out = rows.withColumn("kl_r", F.row_number().over(front) - 1)
        return out.where(F.col("kl_r") <= stop).where(F.col("kl_r") >= start).drop("kl_r")
    if start < 0 and stop < 0:
        out = rows.withColumn("kl_r", F.row_number().over(back))
        return out.where(F.col("kl_r") <= -start).where(F.col("kl_r") >= -stop).drop("kl_r")
    if start >= 0:
        out = rows
        for part in ([(0, start - 1)] if start else []) + ([(stop + 1, -1)] if stop < -1 else []):
            out = out.exceptAll(rank_range(rows, keys, order, *part))
        return out
    few = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("kl_n")).where(F.col("kl_n") <= stop + 1 - start)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"kl_k{i}"))
    out = rows.join(few.select(*[F.col(k).alias(f"kl_k{i}") for i, k in enumerate(keys)], "kl_n"), same).withColumn("kl_r", F.row_number().over(front) - 1)
    return out.where((F.col("kl_r") <= stop) & (F.col("kl_r") >= F.col("kl_n") + start)).select(*rows.columns)


def array_range(arr: Column, start: int, stop: int) -> Column:
    """The same range over an array column."""
    n = F.size(arr)
    lo = F.greatest(F.lit(start) + (n if start < 0 else F.lit(0)), F.lit(0))
    hi = F.least(F.lit(stop) + (n if stop < 0 else F.lit(0)), n - 1)
    return F.when((n == 0) | (hi < lo), F.array_distinct(F.slice(arr, 1, 0))).otherwise(F.slice(arr, lo + 1, F.greatest(hi - lo + 1, F.lit(0))))


def list_index(arr: Column, i: int) -> Column:
    """Element ``i``, from the end if negative; null when out of range."""
    return F.get(arr, F.lit(i)) if i >= 0 else F.try_element_at(arr, F.lit(i))


def scored_set(commands: DataFrame, key: str, member: str, score: str, seq: str) -> DataFrame:
    """Members with their last score; scores must be finite."""
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    checked = commands.select(key, member, seq, F.when(finite, F.col(score)).otherwise(F.raise_error(F.lit("score is not finite"))).alias(score))
    return checked.groupBy(key, member).agg(F.max_by(score, seq).alias(score))


def score_order(score: str, member: str) -> list[Column]:
    """Order of a scored set: score with -0.0 before 0.0, then member."""
    minus_zero = F.when((F.col(score) == 0) & F.col(score).cast("string").startswith("-"), 0).otherwise(1)
    return [F.col(score), minus_zero, F.col(member)]


def without_members(rows: DataFrame, removed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Remove elements; keys left empty are gone with their rows."""
    return rows.join(removed.select(*on).distinct(), list(on), "left_anti")


def assign(rows: DataFrame, containers: DataFrame, key: str) -> DataFrame:
    """Replace whole lists, hashes or sets: of a key that ``containers`` has rows for, only those stay."""
    new = containers.select(F.col(key).alias("kl_key")).distinct()
    return rows.join(new, F.col(key).eqNullSafe(F.col("kl_key")), "left_anti").unionByName(containers)


def hash_fields(commands: DataFrame, key: str, field: str, value: str, seq: str) -> DataFrame:
    """Last value per field; a field whose last value is null is deleted."""
    return commands.groupBy(key, field).agg(F.max_by(F.struct(value), seq).alias("kl_v")).select(key, field, F.col(f"kl_v.`{value}`").alias(value)).where(F.col(value).isNotNull())


def set_members(commands: DataFrame, key: str, member: str) -> DataFrame:
    """Distinct members."""
    return commands.select(key, member).distinct()


def contains(requested: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each request once, with whether its element is there (``present``); nulls are values like any other."""
    names = [f"kl_k{i}" for i in range(len(on))]
    held = rows.select(*[F.col(c).alias(n) for c, n in zip(on, names)]).distinct().withColumn("kl_there", F.lit(True))
    same = F.lit(True)
    for c, n in zip(on, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return requested.select(*on).distinct().join(held, same, "left").select(*on, F.col("kl_there").isNotNull().alias("present"))


def cardinality(requested: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Elements per requested key; a missing key has 0."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("kl_n"))
    return requested.select(key).join(sizes, key, "left").select(key, F.coalesce("kl_n", F.lit(0).cast("bigint")).alias("size"))


def counters(commands: DataFrame, key: str, delta: str, seq: str | None = None) -> DataFrame:
    """Checked sums from 0; a key whose sum leaves the 64-bit range gets null and ``overflow`` true.

    This is the state after all commands where none overflows on the way.  With
    ``seq``, commands that overflow in its order are refused as by
    :func:`counter_log`: the value is what the others leave, and ``overflow``
    tells whether any was refused.
    """
    if seq is not None:
        log = counter_log(commands, key, delta, seq)
        return log.groupBy(key).agg(F.max_by(F.struct("after"), seq)["after"].alias("value"), F.bool_or("overflow").alias("overflow"))
    total = F.sum(F.col(delta).cast("decimal(38,0)"))
    out = commands.groupBy(key).agg(total.alias("kl_t"))
    fits = F.col("kl_t").between(F.lit(-MAX_I64 - 1), F.lit(MAX_I64))
    return out.select(key, F.when(fits, F.col("kl_t").cast("bigint")).alias("value"), (~fits).alias("overflow"))


def counter_log(commands: DataFrame, key: str, delta: str, seq: str) -> DataFrame:
    """Each command with the counter before and after it; one that overflows is refused, marked and leaves it as it was.

    Keys whose increments or decrements add up to less than the 64-bit range
    can't overflow and get a running sum.  The others are replayed, a key by one
    task in order of ``seq``, as a stream of sorted batches.
    """
    d = F.col(delta).cast("decimal(28,0)")
    ups, downs = F.sum(F.when(d > 0, d)), F.sum(F.when(d < 0, d))
    able = commands.groupBy(F.col(key).alias("kl_able")).agg(ups.alias("kl_up"), downs.alias("kl_down"))
    able = able.where((F.col("kl_up") > F.lit(MAX_I64)) | (F.col("kl_down") < F.lit(-MAX_I64 - 1))).select("kl_able")
    match = F.col(key).eqNullSafe(F.col("kl_able"))
    sums = running_sum(commands.join(able, match, "left_anti"), [key], seq, d, "kl_a")
    sums = sums.withColumn("after", F.col("kl_a").cast("bigint")).withColumn("before", (F.col("kl_a") - F.col(delta)).cast("bigint")).withColumn("overflow", F.lit(False)).drop("kl_a")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, value = object(), 0
        for batch in batches:
            after, before, refused = [], [], []
            for k, by in zip(batch.column(key).to_pylist(), batch.column(delta).to_pylist()):
                if k != current:
                    current, value = k, 0
                fits = by is None or -MAX_I64 - 1 <= value + by <= MAX_I64
                before.append(None if by is None else value)
                value += (by or 0) if fits else 0
                after.append(value)
                refused.append(not fits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(after, pa.int64()), pa.array(before, pa.int64()), pa.array(refused, pa.bool_())], names=[*batch.schema.names, "after", "before", "overflow"])

    schema = T.StructType([*commands.schema.fields, T.StructField("after", T.LongType()), T.StructField("before", T.LongType()), T.StructField("overflow", T.BooleanType())])
    return sums.unionByName(commands.join(able, match, "left_semi").repartition(key).sortWithinPartitions(key, seq).mapInArrow(work, schema))


def wrapping_counters(commands: DataFrame, key: str, delta: str) -> DataFrame:
    """Sums modulo 2**63, as 63-bit dense counters hold them."""
    total = F.sum(F.col(delta).cast("decimal(38,0)"))
    return commands.groupBy(key).agg(F.pmod(total, F.lit("9223372036854775808").cast("decimal(38,0)")).cast("bigint").alias("value"))


def appended(commands: DataFrame, key: str, suffix: str, seq: str) -> DataFrame:
    """All suffixes of a key concatenated in order.  The result is one value, so it must fit a row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(seq, F.col(suffix).alias("kl_s")))), lambda x: x["kl_s"])
    return commands.groupBy(key).agg(F.array_join(parts, "").alias("value"))


def append_positions(lists: DataFrame, pushed: DataFrame, key: str, seq: str) -> DataFrame:
    """Push elements to the tails of lists (key, pos, value) in order of ``seq``."""
    ends = lists.groupBy(key).agg((F.max("pos") + 1).alias("kl_end"))
    numbered = running_sum(pushed, [key], seq, F.lit(1), "kl_at", inclusive=False)
    rows = numbered.join(ends, key, "left").withColumn("pos", (F.coalesce("kl_end", F.lit(0)) + F.col("kl_at")).cast("int"))
    return lists.unionByName(rows.select(*lists.columns))


def pop(lists: DataFrame, key: str, front: bool = True) -> tuple[DataFrame, DataFrame]:
    """Take one element off each list: the popped rows and the lists that remain.

    Ends are found by an aggregate that combines before the shuffle.  Of several
    elements at one end position the one with the least other columns is taken;
    rows without a key or position are in no list.
    """
    ends = lists.groupBy(key).agg((F.min if front else F.max)("pos").alias("kl_end"))
    marked = lists.join(ends, key)
    at_end = marked.where(F.col("pos") == F.col("kl_end")).drop("kl_end")
    ranked = at_end.withColumn("kl_r", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in lists.columns if c not in (key, "pos")])))
    others = marked.where(F.col("pos") != F.col("kl_end")).drop("kl_end")
    return ranked.where(F.col("kl_r") <= 1).drop("kl_r"), others.unionByName(ranked.where("kl_r > 1").drop("kl_r"))


def list_commands(commands: DataFrame, key: str = "key") -> DataFrame:
    """Replay interleaved list commands per key: ``op`` push, pop_front, pop_back; what each popped and left.

    Pops among pushes depend on order, so a key's commands are folded by one
    task in order of ``seq``.  They are read as a stream of sorted batches: only
    the list itself is held, never all commands of a key.  Null values are
    elements like any other.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, items = object(), deque()
        for batch in batches:
            popped, lengths = [], []
            for k, op, value in zip(*(batch.column(c).to_pylist() for c in ("key", "op", "value"))):
                if k != current:
                    current, items = k, deque()
                out = None
                if op == "push":
                    items.append(value)
                elif items:
                    out = items.popleft() if op == "pop_front" else items.pop()
                popped.append(out)
                lengths.append(len(items))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("seq"), batch.column("op"), pa.array(popped, pa.string()), pa.array(lengths, pa.int32())], names=["key", "seq", "op", "popped", "length"])

    rows = commands.select(F.col(key).cast("string").alias("key"), F.col("seq").cast("bigint"), F.col("op").cast("string"), F.col("value").cast("string"))
    out = rows.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(work, "key string, seq bigint, op string, popped string, length int")
    return out.withColumnRenamed("key", key)


def type_guard(value: Column, tag: Column, wanted: str) -> Column:
    """The value if its tag is the wanted type; null for a missing key; an error otherwise."""
    return F.when(tag.isNull(), F.lit(None)).when(tag == wanted, value).otherwise(F.raise_error(F.concat(F.lit(f"expected {wanted}, found "), tag)))
