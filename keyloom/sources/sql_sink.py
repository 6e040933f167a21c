"""Documents into SQL tables: statements, and the same guarded merge on DataFrames."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keyloom.functions.keys import is_put
from keyloom.operators.documents import Schema, SchemaError, validate_schema

# Columns that every exported table has unless the caller names others, and SQL types by field type.
KEY_COLUMN, LSN_COLUMN = "mfs_key", "mfs_lsn"
SQL_TYPES = {"string": "TEXT", "int32": "INTEGER", "int64": "INTEGER", "bool": "INTEGER", "float": "REAL"}


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def column_name(field: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", field)


def columns(schema: Schema, key_column: str = KEY_COLUMN, lsn_column: str = LSN_COLUMN) -> list[tuple[str, object]]:
    """(column, field) for each stored field; reserved and colliding names are errors."""
    validate_schema(schema)
    out: dict[str, object] = {}
    for f in schema.fields:
        if not f.stored:
            continue
        name = column_name(f.name)
        if name in (key_column, lsn_column):
            raise SchemaError("reserved_column", f.name)
        if name in out:
            raise SchemaError("duplicate_column", f.name)
        out[name] = f
    return list(out.items())


def create_statements(schema: Schema, key_column: str = KEY_COLUMN, lsn_column: str = LSN_COLUMN) -> list[str]:
    """The table, then an index per indexed, sorted, ranged or referring column that is not unique anyway."""
    table, defs, indexes = quote(schema.name), [], []
    for name, f in columns(schema, key_column, lsn_column):
        words = [quote(name), SQL_TYPES.get(f.type.kind, "BLOB")]
        if f.primary:
            words.append("PRIMARY KEY")
        elif f.unique:
            words.append("UNIQUE")
        if f.reference:
            words.append(f"REFERENCES {quote(f.reference[0])}({quote(column_name(f.reference[1]))})")
        defs.append(" ".join(words))
        if not f.primary and not f.unique and (f.indexed or f.sort or f.range_index or f.reference):
            indexes.append(f"CREATE INDEX IF NOT EXISTS {quote(f'{schema.name}_{name}_idx')} ON {table} ({quote(name)});")
    defs += [f"{quote(key_column)} BLOB NOT NULL UNIQUE", f"{quote(lsn_column)} INTEGER NOT NULL"]
    return [f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(defs)});", *indexes]


def upsert_statement(schema: Schema, key_column: str = KEY_COLUMN, lsn_column: str = LSN_COLUMN) -> str:
    """Insert, or update a row that is older than the incoming one."""
    table, primary = quote(schema.name), quote(column_name(schema.primary.name))
    names = [*(quote(n) for n, _ in columns(schema, key_column, lsn_column)), quote(key_column), quote(lsn_column)]
    sets = ", ".join(f"{n} = excluded.{n}" for n in names if n != primary)
    marks = ", ".join("?" * len(names))
    lsn = quote(lsn_column)
    return f"INSERT INTO {table} ({', '.join(names)}) VALUES ({marks}) ON CONFLICT ({primary}) DO UPDATE SET {sets} WHERE {table}.{lsn} < excluded.{lsn};"


def delete_statement(schema: Schema, key_column: str = KEY_COLUMN, lsn_column: str = LSN_COLUMN) -> str:
    """Delete a row that is not newer than the delete."""
    validate_schema(schema)
    return f"DELETE FROM {quote(schema.name)} WHERE {quote(key_column)} = ? AND {quote(lsn_column)} <= ?;"


def run_batch(batch: DataFrame, schema: Schema, connect, key: str = "key", lsn: str = "lsn", op: str = "op", parts: int = 1, key_column: str = KEY_COLUMN, lsn_column: str = LSN_COLUMN) -> int:
    """Run a batch of puts and deletes through the statements on a database; how many rows were sent.

    ``connect`` makes a connection (DB-API, ``?`` marks) on a worker.  The batch
    is reduced to its latest row per key and split by key into ``parts``, each
    one transaction: all of it or nothing.  Statements are guarded by LSN, so a
    task that runs again changes nothing.  Columns are named as the fields of the schema.
    """
    names = [f.name for _, f in columns(schema, key_column, lsn_column)]
    put, drop = upsert_statement(schema, key_column, lsn_column), delete_statement(schema, key_column, lsn_column)
    cols = [F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]
    rows = batch.select(F.encode(F.col(key).cast("string"), "UTF-8").alias("k"), F.col(lsn).cast("bigint").alias("l"), is_put(F.col(op)).alias("p"), *cols)
    rest = [c for c in rows.columns if c not in ("k", "l")]
    newest = rows.groupBy("k").agg(F.max(F.struct("l", *rest)).alias("b")).select("k", "b.*")

    def work(batches):
        db, sent = connect(), 0
        try:
            for b in batches:
                data = b.to_pylist()
                db.executemany(put, [[*(r[f"c{i}"] for i in range(len(names))), r["k"], r["l"]] for r in data if r["p"]])
                db.executemany(drop, [[r["k"], r["l"]] for r in data if not r["p"]])
                sent += len(data)
            db.commit()
        except BaseException:
            db.rollback()
            raise
        finally:
            db.close()
        yield pa.RecordBatch.from_arrays([pa.array([sent], pa.int64())], names=["n"])

    done = newest.repartition(parts, "k").mapInArrow(work, "n bigint")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def guarded_merge(target: DataFrame, batch: DataFrame, key: str, lsn: str, op: str = "op") -> DataFrame:
    """Apply a batch of puts and deletes to a table by the statements' rules.

    A put replaces a row with a smaller LSN, a delete removes one with an LSN
    no larger than its own; everything else leaves the row as it is.  The batch
    is reduced to its latest row per key first.  Applying a batch again changes
    nothing.  One shuffle join on the key; columns are those of ``target``.
    """
    payload = [c for c in target.columns if c != key]
    renamed = batch.select(F.col(key), F.col(lsn).alias("kl_l"), is_put(F.col(op)).alias("kl_put"), *[F.col(c).alias(f"kl_{i}") for i, c in enumerate(payload)])
    rest = [c for c in renamed.columns if c not in (key, "kl_l")]
    newest = renamed.groupBy(key).agg(F.max(F.struct("kl_l", *rest)).alias("kl_b")).select(key, F.col("kl_b.*"))
    held = target.withColumn("kl_held", F.lit(True))
    j = held.join(newest, key, "full_outer")
    absent, incoming = F.col("kl_held").isNull(), F.col("kl_l").isNotNull()
    takes = incoming & F.col("kl_put") & (absent | (F.col(lsn) < F.col("kl_l")))
    drops = incoming & ~F.col("kl_put") & (absent | (F.col(lsn) <= F.col("kl_l")))
    kept = j.where(~F.coalesce(drops, F.lit(False)) & (~absent | F.coalesce(takes, F.lit(False))))
    cols = {c: F.when(F.coalesce(takes, F.lit(False)), F.col(f"kl_{i}")).otherwise(F.col(c)).alias(c) for i, c in enumerate(payload)}
    return kept.select(*[F.col(key) if c == key else cols[c] for c in target.columns])
