"""References to records that do not exist (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from keyloom.functions.keys import key_parts
from keyloom.session import cut

#: Runs are cut at multiples of 2**BLOCK_BITS, so that a block holds at most half
#: as many runs and an as-of match never leaves its block.
BLOCK_BITS = 10
#: Stands for "arrived after everything" where a parent row has no time.
NEVER = "9999-12-31 00:00:00"

PARTS = ("prefix", "width", "block")


def _events(parents: DataFrame) -> DataFrame:
    """Versions of parents with defaults for nulls: collection, id, kl_v, kl_dead, kl_at."""
    return parents.where("id is not null").select(
        "collection", "id", F.coalesce("version", F.lit(0)).cast("bigint").alias("kl_v"), F.coalesce("tombstone", F.lit(False)).alias("kl_dead"), F.coalesce(F.col("arrived_at"), F.lit(NEVER).cast("timestamp_ntz")).alias("kl_at")
    )


def parent_summary(parents: DataFrame) -> DataFrame:
    """Per parent key that holds in the end: first arrival, whether it was ever deleted.

    ``parents``: collection, id, version, tombstone, arrived_at, one row per
    version, in any order, with repetitions.  All aggregates are of fixed width
    and combine before the shuffle.  A null version counts as 0, a null
    tombstone as false, a null arrival as after everything; rows without id are
    no parents.  Of two rows with one version the tombstone holds.
    """
    top, gone = F.max(F.when(~F.col("kl_dead"), F.col("kl_v"))), F.max(F.when(F.col("kl_dead"), F.col("kl_v")))
    per_key = _events(parents).groupBy("collection", "id").agg(F.min("kl_at").alias("kl_first"), top.alias("kl_top"), gone.alias("kl_gone"))
    held = per_key.where(F.col("kl_top").isNotNull() & (F.col("kl_gone").isNull() | (F.col("kl_top") > F.col("kl_gone"))))
    return held.select("collection", "id", "kl_first", F.col("kl_gone").isNotNull().alias("kl_deleted"))


def key_runs(live: DataFrame) -> DataFrame:
    """Compress the keys of each collection into runs of consecutive integers.

    A key is its prefix, digit count and number (:func:`key_parts`).  Of each
    run come its first and last number, the start of the run after it in the
    block, and, key by key (at most a block of them), since when each holds and
    whether it was ever deleted.
    """
    parts = key_parts(F.col("id"))
    rows = live.select("collection", parts["prefix"].alias("prefix"), parts["width"].alias("width"), F.shiftright(parts["number"], BLOCK_BITS).alias("block"), parts["number"].alias("kl_n"), "kl_first", "kl_deleted")
    group = Window.partitionBy("collection", *PARTS).orderBy("kl_n")
    rows = rows.withColumn("kl_run", F.col("kl_n") - F.row_number().over(group))
    each = F.array_sort(F.collect_list(F.struct("kl_n", "kl_first", "kl_deleted")))
    runs = rows.groupBy("collection", *PARTS, "kl_run").agg(F.min("kl_n").alias("kl_start"), F.max("kl_n").alias("kl_end"), each.alias("kl_each"))
    starts = Window.partitionBy("collection", *PARTS).orderBy("kl_start")
    return runs.drop("kl_run").withColumn("kl_next", F.lead("kl_start").over(starts))


def _lifetimes(parents: DataFrame, keys: DataFrame) -> DataFrame:
    """Spans in which keys that were deleted and came back held: collection, id, kl_from, kl_to."""
    rows = _events(parents).join(keys.select("collection", "id"), ["collection", "id"], "left_semi")
    points = rows.groupBy("collection", "id", "kl_at").agg(F.max(F.struct("kl_v", "kl_dead")).alias("kl_code"))
    w = Window.partitionBy("collection", "id").orderBy("kl_at")
    points = points.withColumn("kl_top", F.max("kl_code").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("kl_to", F.lead("kl_at").over(w))
    return points.where(~F.col("kl_top.kl_dead")).select("collection", "id", F.col("kl_at").alias("kl_from"), "kl_to")


def orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """References whose target does not hold when they are made, or in the end.

    ``references``: ref_collection, reference_key, arrived_at and any columns
    to pass through; ``parents`` as in :func:`parent_summary`.  Returns the
    orphan rows of ``references`` unchanged.

    1. Parent keys that hold in the end are compressed into runs, once: the
       summary is written to the shared folder.
    2. Each reference is matched as of the run that starts at or before its
       number; beyond that run's end, or with no such run, it is an orphan.
    3. The run also tells since when the key holds.  Only references to keys
       that were deleted and came back need their lifetimes.

    A null key is no reference.  A reference without time is checked against
    the end state alone.  The run index holds a few rows per gap in the keys
    and joins on blocks of keys; Spark broadcasts it only if its measured size
    allows that, else a skewed block is split by adaptive execution.
    """
    live = cut(parent_summary(parents))
    parts = key_parts(F.col("reference_key"))
    passed = [F.col(c).alias(f"kl_c{i}") for i, c in enumerate(references.columns)]
    back = [F.col(f"kl_c{i}").alias(c) for i, c in enumerate(references.columns)]
    refs = references.where("reference_key is not null").select(*passed, F.col("ref_collection").alias("kl_rc"), F.col("reference_key").alias("kl_key"), F.col("arrived_at").alias("kl_t"), *[parts[p].alias(f"kl_{p}") for p in ("prefix", "width")], F.shiftright(parts["number"], BLOCK_BITS).alias("kl_block"), parts["number"].alias("kl_num"))
    runs = key_runs(live)
    as_of = (
        (F.col("kl_rc") == F.col("collection")) & (F.col("kl_prefix") == F.col("prefix")) & (F.col("kl_width") == F.col("width")) & (F.col("kl_block") == F.col("block"))
        & (F.col("kl_start") <= F.col("kl_num")) & (F.col("kl_next").isNull() | (F.col("kl_num") < F.col("kl_next")))
    )
    own = F.get("kl_each", (F.col("kl_num") - F.col("kl_start")).cast("int"))
    within = F.coalesce(F.col("kl_num") <= F.col("kl_end"), F.lit(False))
    matched = refs.join(runs, as_of, "left").select(*[f"kl_c{i}" for i in range(len(back))], "kl_rc", "kl_key", "kl_t", within.alias("kl_within"), F.when(within, own).alias("kl_own"))
    early = F.coalesce(F.col("kl_t") < F.col("kl_own.kl_first"), F.lit(False))
    again = F.coalesce(F.col("kl_own.kl_deleted"), F.lit(False)) & F.col("kl_t").isNotNull()
    open_refs = matched.withColumn("kl_lost", ~F.col("kl_within") | early).withColumn("kl_again", again).where(F.col("kl_lost") | F.col("kl_again")).drop("kl_own", "kl_within")
    spans = _lifetimes(parents, live.where("kl_deleted")).select(F.col("collection").alias("kl_sc"), F.col("id").alias("kl_sid"), "kl_from", "kl_to")
    held = (
        F.col("kl_again") & (F.col("kl_rc") == F.col("kl_sc")) & (F.col("kl_key") == F.col("kl_sid"))
        & (F.col("kl_from") <= F.col("kl_t")) & (F.col("kl_to").isNull() | (F.col("kl_t") < F.col("kl_to")))
    )
    spanned = open_refs.join(spans, held, "left")
    return spanned.where(F.col("kl_lost") | (F.col("kl_again") & F.col("kl_from").isNull())).select(*back)


def declared_references(tables: dict[str, DataFrame], includes: DataFrame, fields: DataFrame) -> DataFrame:
    """All references that the schema declares: collection, rec_key, ref_field, ref_collection, reference_key, arrived_at.

    ``tables`` maps a collection to a table with ``id``, ``arrived_at`` and one
    column per reference field; ``includes`` holds the references of other
    collections row by row.  ``fields`` is the schema and decides which fields
    refer to what; it is as small as a schema is.
    """
    declared = fields.where("ref_collection is not null").select(F.col("collection").alias("kl_dc"), F.col("name").alias("kl_df"), F.col("ref_collection")).distinct()
    rows = includes.select("collection", F.col("primary_key").alias("rec_key"), F.col("field").alias("ref_field"), "reference_key", "arrived_at")
    for name, (df, columns) in tables.items():
        for c in columns:
            rows = rows.unionByName(df.select(F.lit(name).alias("collection"), F.col("id").alias("rec_key"), F.lit(c).alias("ref_field"), F.col(c).alias("reference_key"), "arrived_at"))
    return rows.where("reference_key is not null").join(declared, (F.col("collection") == F.col("kl_dc")) & (F.col("ref_field") == F.col("kl_df"))).drop("kl_dc", "kl_df")
