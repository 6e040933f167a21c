"""Document collections: schema rules, validation, lookups, unique checks and updates."""

from __future__ import annotations

import json
import math
import re
import sys
from collections.abc import Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from keyloom.functions.jsontext import parse
from keyloom.operators.dedupe import first_copies

#: Array levels that a type string may have, nesting and sizes that a value may have.
MAX_ARRAY_LEVELS, MAX_DEPTH, MAX_ITEMS, MAX_BYTES = 8, 64, 1 << 20, 64 << 20
SPARK_SCALARS = {"string": T.StringType(), "int32": T.IntegerType(), "int64": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "json": T.StringType(), "bytes": T.BinaryType()}
KEY_TYPES = ("string", "int32", "int64", "bytes")
NUMERIC = ("int32", "int64", "float")
#: An integer beyond it is no finite float.
MAX_FLOAT = int(sys.float_info.max)
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")


class SchemaError(ValueError):
    """A schema that breaks a rule; ``rule`` names it."""

    def __init__(self, rule: str, name: str = ""):
        super().__init__(f"{rule}: {name}" if name else rule)
        self.rule = rule


@dataclass(frozen=True)
class FieldType:
    """A scalar by name, an ``array`` of one inner type, or an ``object`` of fields."""

    kind: str
    inner: FieldType | None = None
    fields: tuple[Field, ...] = ()

    def spark(self) -> T.DataType:
        if self.kind == "array":
            return T.ArrayType(self.inner.spark())
        if self.kind == "object":
            return T.StructType([T.StructField(f.name, f.type.spark(), f.optional) for f in self.fields])
        return SPARK_SCALARS[self.kind]

    @property
    def indexable(self) -> bool:
        if self.kind == "array":
            return self.inner.kind != "array" and self.inner.indexable
        return self.kind not in ("object", "json")

    @property
    def sortable(self) -> bool:
        return self.kind not in ("object", "array", "json")


@dataclass(frozen=True)
class Field:
    name: str
    type: FieldType
    primary: bool = False
    optional: bool = False
    indexed: bool = False
    stored: bool = True
    unique: bool = False
    reference: tuple[str, str] | None = None
    sort: bool = False
    range_index: bool = False


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[Field, ...]
    nested_names: bool = False
    default_sort: str | None = None

    @property
    def primary(self) -> Field:
        return next(f for f in self.fields if f.primary)

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def spark(self) -> T.StructType:
        """Declared fields plus one string column for undeclared content."""
        return T.StructType([*[T.StructField(f.name, f.type.spark(), f.optional) for f in self.fields], T.StructField("extras", T.StringType())])


def parse_type(declared) -> FieldType:
    """``int64[][]``, or the JSON form ``{"array": …}`` / ``{"object": [fields]}``."""
    if isinstance(declared, str):
        text = declared.strip()
        levels = 0
        while text.endswith("[]"):
            text, levels = text[:-2], levels + 1
        if levels > MAX_ARRAY_LEVELS:
            raise SchemaError("too_many_array_levels", declared)
        if text not in SPARK_SCALARS:
            raise SchemaError("unknown_type", declared)
        out = FieldType(text)
        for _ in range(levels):
            out = FieldType("array", out)
        return out
    if isinstance(declared, dict) and "array" in declared:
        return FieldType("array", parse_type(declared["array"]))
    if isinstance(declared, dict) and "object" in declared:
        return FieldType("object", fields=tuple(parse_field(f) for f in declared["object"]))
    raise SchemaError("unknown_type", repr(declared))


def parse_field(spec: dict) -> Field:
    ref = spec.get("reference")
    if isinstance(ref, str):
        target, _, key = ref.partition(".")
        ref = (target, key)
    elif isinstance(ref, dict):
        ref = (ref["collection"], ref["field"])
    flags = {k: bool(spec[k]) for k in ("primary", "optional", "indexed", "stored", "unique", "sort", "range_index") if k in spec}
    return Field(spec["name"], parse_type(spec["type"]), reference=ref, **flags)


def schema_from_json(text: str) -> Schema:
    """Load and check a schema."""
    try:
        spec = json.loads(text)
    except ValueError as e:
        raise SchemaError("not_json") from e
    out = Schema(spec["name"], tuple(parse_field(f) for f in spec["fields"]), bool(spec.get("enable_nested_fields", False)), spec.get("default_sort_field"))
    validate_schema(out)
    return out


def declared_schemas(fields: DataFrame) -> dict[str, Schema]:
    """The schema of each collection from rows (collection, name, field_type, flags, reference), fields in order of name.

    The declaration itself (tens of rows) is read to the driver.
    """
    specs: dict[str, list[dict]] = {}
    for r in fields.orderBy("collection", "name").collect():
        kind = r["field_type"].strip()
        spec = {"name": r["name"], "type": json.loads(kind) if kind[:1] == "{" else kind}
        spec |= {k: r[f"is_{k}"] for k in ("primary", "optional", "indexed", "stored", "unique", "sort", "range_index")}
        if r["ref_collection"] is not None:
            spec["reference"] = {"collection": r["ref_collection"], "field": r["ref_field"]}
        specs.setdefault(r["collection"], []).append(spec)
    out = {c: Schema(c, tuple(map(parse_field, rows))) for c, rows in specs.items()}
    for schema in out.values():
        validate_schema(schema)
    return out


def validate_schema(schema: Schema) -> None:
    """Raise :class:`SchemaError` at the first rule the schema breaks."""
    if not IDENTIFIER.fullmatch(schema.name):
        raise SchemaError("collection_name", schema.name)
    if not schema.fields:
        raise SchemaError("no_fields")
    seen: set[str] = set()
    for f in schema.fields:
        checks = [
            ("field_name", all(IDENTIFIER.fullmatch(p) for p in f.name.split("."))),
            ("nested_names_disabled", schema.nested_names or "." not in f.name),
            ("nested_flag", _plain_children(f.type)),
            ("index_type", not f.indexed or f.type.indexable),
            ("unique_needs_index", not f.unique or f.indexed),
            ("unique_optional", not (f.unique and f.optional)),
            ("sort_needs_index", not f.sort or f.indexed),
            ("sort_type", not f.sort or f.type.sortable),
            ("range_needs_index", not f.range_index or f.indexed),
            ("range_type", not f.range_index or f.type.kind in NUMERIC),
            ("reference_type", f.reference is None or f.type.kind in KEY_TYPES),
            ("reference_name", f.reference is None or all(IDENTIFIER.fullmatch(p) for r in f.reference for p in r.split("."))),
            ("duplicate_field", f.name not in seen),
            ("primary_optional", not (f.primary and f.optional)),
            ("primary_not_stored", not f.primary or f.stored),
            ("primary_type", not f.primary or f.type.kind in KEY_TYPES),
        ]
        for rule, holds in checks:
            if not holds:
                raise SchemaError(rule, f.name)
        seen.add(f.name)
    primaries = sum(f.primary for f in schema.fields)
    if primaries != 1:
        raise SchemaError("no_primary" if primaries == 0 else "many_primaries")
    if schema.default_sort is not None:
        by = schema.field(schema.default_sort)
        if by is None or not by.sort:
            raise SchemaError("default_sort", schema.default_sort)


def _plain_children(t: FieldType) -> bool:
    """Fields inside objects carry no flags of their own."""
    if t.kind == "array":
        return _plain_children(t.inner)
    return all(replace(f, optional=False, stored=True, type=t) == Field(f.name, t) and _plain_children(f.type) for f in t.fields)


class Catalog:
    """Registered collections: names are unique and limited in number."""

    def __init__(self, most: int = 1024):
        self.most, self.schemas = most, {}

    def register(self, schema: Schema | str) -> None:
        name = schema if isinstance(schema, str) else schema.name
        if isinstance(schema, Schema):
            validate_schema(schema)
        if name in self.schemas:
            raise SchemaError("collection_exists", name)
        if len(self.schemas) >= self.most:
            raise SchemaError("too_many_collections", name)
        self.schemas[name] = schema if isinstance(schema, Schema) else None

    def names(self) -> list[str]:
        return sorted(self.schemas)

    def check_references(self, schema: Schema) -> None:
        """Targets must be registered and refer to their primary field; target rows need not exist."""
        for f in schema.fields:
            if f.reference:
                target = self.schemas.get(f.reference[0])
                if target is None or target.primary.name != f.reference[1]:
                    raise SchemaError("reference_target", f.name)


def value_at(doc: Column, path: str) -> Column:
    """A dotted path into a JSON text; null if it is missing or leads through a non-object."""
    return F.get_json_object(doc, "$." + path)


def _unique_names(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated name")
    return out


def _value_faults(value, t: FieldType, path: str, out: list[str]) -> None:
    fault = None
    if t.kind == "object":
        if isinstance(value, dict):
            _field_faults(value, t.fields, path + ".", out)
        else:
            fault = "type"
    elif t.kind == "array":
        if isinstance(value, list):
            for i, item in enumerate(value):
                _value_faults(item, t.inner, f"{path}[{i}]", out)
        else:
            fault = "type"
    elif t.kind in ("int32", "int64"):
        if type(value) is not int or not -(1 << 63) <= value < 1 << 63:
            fault = "type"
        elif t.kind == "int32" and not -(1 << 31) <= value < 1 << 31:
            fault = "range"
    elif t.kind == "float":
        if type(value) not in (int, float):
            fault = "type"
        elif not math.isfinite(value) if isinstance(value, float) else abs(value) > MAX_FLOAT:
            fault = "not_finite"
    elif t.kind == "bool":
        fault = None if isinstance(value, bool) else "type"
    elif t.kind in ("string", "bytes"):
        fault = None if isinstance(value, str) else "type"
    if fault is not None:
        out.append(f"{path}: {fault}")


def _field_faults(obj: dict, fields: tuple[Field, ...], prefix: str, out: list[str]) -> None:
    for f in fields:
        value = obj
        for part in f.name.split("."):
            if not isinstance(value, dict) or part not in value:
                if not f.optional:
                    out.append(f"{prefix}{f.name}: missing")
                break
            value = value[part]
        else:
            if value is not None:
                _value_faults(value, f.type, prefix + f.name, out)
            elif not f.optional and f.type.kind != "json":
                out.append(f"{prefix}{f.name}: null")


def _document_faults(text: str | None, schema: Schema) -> list[str]:
    try:
        doc = parse(text, _unique_names)
    except (TypeError, ValueError):
        return ["document: malformed"]
    if not isinstance(doc, dict):
        return ["document: type"]
    out: list[str] = []
    _field_faults(doc, schema.fields, "", out)
    return out


def collection_errors(collection: Column, doc: Column, schemas: dict[str, Schema]) -> Column:
    """:func:`validation_errors` of documents of several collections, each by its own schema."""

    def errors(collections: pd.Series, docs: pd.Series) -> pd.Series:
        return pd.Series([_document_faults(t, schemas[c]) if c in schemas else ["collection: undeclared"] for c, t in zip(collections, docs)], dtype=object)

    return F.pandas_udf(errors, T.ArrayType(T.StringType()))(collection, doc)


def validation_errors(doc: Column, schema: Schema) -> Column:
    """Array of "path: fault" for a document given as JSON text; empty if it is valid.

    Faults: ``malformed`` (for the document), ``missing``, ``null``, ``type``,
    ``range`` (int32), ``not_finite``.  Declared objects and arrays are checked
    to their innermost values, as in ``profile.name`` or ``tags[1]``; a null
    element is of another type.  Undeclared fields are accepted.  A ``json``
    field accepts anything.
    """
    return collection_errors(F.lit(schema.name), doc, {schema.name: schema})


def _codec_fault(text: str | None) -> str | None:
    if text is None:
        return "malformed"
    if len(text.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        return "too_large"
    try:
        level, depth = [parse(text)], 0
    except ValueError:
        return "malformed"
    while level:
        depth += 1
        below = []
        for v in level:
            if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
                return "not_finite"
            if isinstance(v, (list, dict)):
                if len(v) > MAX_ITEMS:
                    return "too_many_items"
                below.extend(v if isinstance(v, list) else v.values())
        if depth > MAX_DEPTH + 1:
            return "too_deep"
        level = below
    return None


def codec_fault(doc: Column) -> Column:
    """Why a JSON document can't be stored: ``malformed``, ``too_large``, ``too_deep``, ``too_many_items``, ``not_finite``; null if it can."""

    def faults(docs: pd.Series) -> pd.Series:
        return docs.map(_codec_fault).astype(object)

    return F.pandas_udf(faults, T.StringType())(doc)


def lookup(docs: DataFrame, schema: Schema, name: str, value) -> DataFrame:
    """Equality on an indexed field, pushed down to the scan; an unindexed field is an error.  Ordered by key."""
    f = schema.field(name)
    if f is None or not (f.indexed or f.primary):
        raise SchemaError("not_indexed", name)
    match = F.array_contains(F.col(name), F.lit(value)) if f.type.kind == "array" else F.col(name) == F.lit(value)
    return docs.where(match).orderBy(schema.primary.name)


def index_entries(docs: DataFrame, name: str, key: str) -> DataFrame:
    """Rebuild an exact index: one row per value and key, values of arrays each on their own; nulls are not indexed."""
    col = F.explode(name) if isinstance(docs.schema[name].dataType, T.ArrayType) else F.col(name)
    return docs.select(col.alias("value"), F.col(key).alias("key")).where("value is not null").distinct()


def unique_violations(docs: DataFrame, name: str, key: str) -> DataFrame:
    """Values that more than one key holds; nulls are exempt."""
    found = docs.where(F.col(name).isNotNull()).groupBy(name).agg(F.count_distinct(key).alias("holders"), F.min(key).alias("first_key"))
    return found.where("holders > 1")


def multi_get(docs: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Requested documents once each, in order of first request; missing ones are left out.  ``requested``: key, ordinal."""
    first = requested.groupBy(key).agg(F.min("ordinal").alias("ordinal"))
    return first.join(docs, key).orderBy("ordinal")


def multi_get_positional(docs: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """One row per request, duplicates and misses included."""
    return requested.join(docs, key, "left").orderBy("ordinal")


def create_only(current: DataFrame, batch: DataFrame, key: str, order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of the batch that create their key, and those whose key exists or was created by an earlier row of the batch.

    Rows of one key are taken in ``order``, then in that of their other columns;
    of rows that are equal in all any one creates.  Null keys are one key.  Of a
    key that comes very often each task sends one row; the others are what the
    batch has beyond the creating rows, repetitions counted.
    """
    by = [*order, *(c for c in batch.columns if c != key and c not in order)] or [key]
    known = current.select(F.col(key).alias("kl_known")).distinct()
    new = first_copies(batch, [key], by[0], by[1:]).join(known, F.col(key).eqNullSafe(F.col("kl_known")), "left_anti")
    return new, batch.exceptAll(new)


@dataclass(frozen=True)
class Update:
    """One step of an update: ``set`` a path to a value, ``unset`` it, or ``increment`` it by a whole number."""

    kind: str
    path: str
    value: object = None


def _child(kind: T.DataType | None, name: str, path: str) -> T.DataType | None:
    if kind is None:
        return None
    if not isinstance(kind, T.StructType):
        raise SchemaError("path_not_object", path)
    return kind[name].dataType if name in kind.names else None


def _rebuilt(old: Column | None, kind: T.DataType | None, parts: list[str], path: str, leaf) -> tuple[Column, T.DataType]:
    """A struct with the value at ``parts`` made anew by ``leaf(old value, its type)``; missing and null parents are made."""
    if not parts:
        return leaf(old, kind)
    below, name = _child(kind, parts[0], path), parts[0]
    value, made = _rebuilt(old[name] if below is not None else None, below, parts[1:], path, leaf)
    fields = kind.fields if kind is not None else []
    cols = [(value if f.name == name else old[f.name]).alias(f.name) for f in fields]
    types = [T.StructField(f.name, made if f.name == name else f.dataType) for f in fields]
    if below is None:
        cols, types = [*cols, value.alias(name)], [*types, T.StructField(name, made)]
    return F.struct(*cols), T.StructType(types)


def _at(df: DataFrame, path: str) -> Column | None:
    """The value at a path, null where a parent is; None if no document can have one."""
    kind: T.DataType | None = df.schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    return F.col(".".join(f"`{x}`" for x in path.split(".")))


def _apply(docs: DataFrame, step: Update) -> DataFrame:
    """The documents (columns and struct paths) after one step, and in ``kl_fault`` what it must not do."""
    top, *parts = step.path.split(".")
    kind = docs.schema[top].dataType if top in docs.columns else None
    old = F.col(f"`{top}`") if kind is not None else None
    fault = F.lit(None).cast("string")
    if step.kind == "unset":
        if _at(docs, step.path) is None:
            return docs
        if not parts:
            return docs.withColumn(top, F.lit(None).cast(kind))
        new, _ = _rebuilt(old, kind, parts, step.path, lambda _, k: (F.lit(None).cast(k), k))
        return docs.withColumn(top, F.when(old.isNotNull(), new))
    if step.kind == "set":
        value = step.value if isinstance(step.value, Column) else F.lit(step.value)
        given = docs.select(value.alias("v")).schema["v"].dataType

        def leaf(_, k):
            return (value.cast(k), k) if k is not None else (value, given)
    else:
        by = F.lit(int(step.value)).cast("bigint")

        def leaf(v, k):
            nonlocal fault
            if k is None:
                return by, T.LongType()
            if isinstance(k, (T.FloatType, T.DoubleType)):
                return (F.coalesce(v, F.lit(0.0)) + by).cast(k), k
            if not isinstance(k, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                raise SchemaError("not_incrementable", step.path)
            total = F.coalesce(v.cast("bigint"), F.lit(0).cast("bigint"))
            fits = F.try_add(total, by).try_cast(k)
            fault = F.when(fits.isNull(), F.lit(f"{step.path}: overflow"))
            return fits, k

    new, _ = _rebuilt(old, kind, parts, step.path, leaf)
    return docs.withColumn("kl_fault", F.coalesce("kl_fault", fault)).withColumn(top, new)


def update_documents(docs: DataFrame, key: str, steps: Sequence[Update], where: Column | None = None, required: Sequence[str] = ()) -> DataFrame:
    """Apply updates in order to the matching documents; adds ``update_error``, null where all went well.

    Paths lead through struct columns.  Setting makes what is missing on the
    way, parents that are null included; an increment of a missing number starts
    from 0.  A document for which a step overflows, or that would lack a
    ``required`` path afterwards, stays as it was and says why.  Changing the
    key, a path through something other than an object, and incrementing
    something other than a number are errors of the call.  Documents that don't
    match ``where`` (null is no match) get columns that are new as null.
    """
    for step in steps:
        if step.kind not in ("set", "unset", "increment"):
            raise SchemaError("unknown_update", step.kind)
        if step.path.split(".")[0] == key:
            raise SchemaError("primary_key_update", step.path)
    names = docs.columns
    tops = list(dict.fromkeys(s.path.split(".")[0] for s in steps))
    applies = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    kept = [F.col(f"`{c}`").alias(f"kl_old_{i}") for i, c in enumerate(tops) if c in names]
    work = docs.select(*[F.col(f"`{c}`") for c in names], *kept, applies.alias("kl_applies"), F.lit(None).cast("string").alias("kl_fault"))
    for step in steps:
        work = _apply(work, step)
    lacks = [F.when(v.isNull() if (v := _at(work, r)) is not None else F.lit(True), F.lit(f"{r}: missing")) for r in required]
    error = F.coalesce("kl_fault", *lacks) if lacks else F.col("kl_fault")
    work = work.withColumn("update_error", F.when(F.col("kl_applies"), error))
    done = F.col("kl_applies") & F.col("update_error").isNull()
    for i, c in enumerate(tops):
        kind = work.schema[c].dataType if c in work.columns else None
        if kind is None:
            continue
        before = _widened(F.col(f"kl_old_{i}"), docs.schema[c].dataType, kind) if c in names else F.lit(None).cast(kind)
        work = work.withColumn(c, F.when(done, F.col(f"`{c}`")).otherwise(before))
    return work.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, *(t for t in tops if t in work.columns)])], "update_error")


def _widened(old: Column, kind: T.DataType, to: T.DataType) -> Column:
    """A struct with the fields that ``to`` has beyond ``kind`` as nulls."""
    if kind == to or not isinstance(to, T.StructType):
        return old.cast(to)
    fields = [(_widened(old[f.name], kind[f.name].dataType, f.dataType) if f.name in kind.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in to.fields]
    return F.when(old.isNotNull(), F.struct(*fields))


def partial_update(docs: DataFrame, key: str, sets: dict[str, Column] | None = None, unset: Sequence[str] = (), increment: dict[str, int] | None = None, where: Column | None = None) -> DataFrame:
    """:func:`update_documents` with sets first, then unsets, then increments; an overflow fails the job."""
    steps = [*(Update("set", p, v) for p, v in (sets or {}).items()), *(Update("unset", p) for p in unset), *(Update("increment", p, v) for p, v in (increment or {}).items())]
    out = update_documents(docs, key, steps, where)
    names = [c for c in out.columns if c != "update_error"]
    guard = F.when(F.col("update_error").isNotNull(), F.raise_error(F.col("update_error"))).otherwise(F.lit(True))
    return out.where(guard).select(*[F.col(f"`{c}`") for c in names])


def put_documents(current: DataFrame, batch: DataFrame, schema: Schema, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The write path of a collection: check, then write; the new state, and the rejected rows with their ``reason``.

    ``current``: key, document, version of the live documents; ``batch``: key,
    document (JSON text; null deletes) and ``seq``, their order, unique.  A put is rejected
    if the document breaks the schema or can't be stored, if its primary field
    isn't its key, or if a unique value is held by another key, in ``current`` or
    in an earlier row of the batch; a value of ``current`` counts as held even if
    the batch frees it, and a row holds its values even if another of them gets it rejected.  Of what is accepted the last row of a key holds, with the version counted on by the rows
    accepted before it.  Holders of values are found by aggregates that
    combine before the shuffle.
    """
    doc = F.col("document")
    primary = F.get_json_object(doc, "$." + schema.primary.name)
    faults = validation_errors(doc, schema)
    first = F.when(doc.isNull(), None).when(F.size(faults) > 0, faults[0]).when(codec_fault(doc).isNotNull(), F.concat(F.lit("document: "), codec_fault(doc))).when(~primary.eqNullSafe(F.col("key")), F.lit("key: differs"))
    rows = batch.select("key", "document", F.col(seq).alias("kl_seq")).withColumn("reason", first)
    for f in (f for f in schema.fields if f.unique and not f.primary):
        value = F.get_json_object(doc, "$." + f.name)
        held = current.select(value.alias("kl_value"), F.col("key").alias("kl_holder")).where("kl_value is not null").groupBy("kl_value").agg(F.min("kl_holder").alias("kl_min"), F.max("kl_holder").alias("kl_max"))
        rows = rows.withColumn("kl_value", F.when(F.col("reason").isNull(), value))
        taken = F.col("kl_min").isNotNull() & ((F.col("kl_min") != F.col("key")) | (F.col("kl_max") != F.col("key")))
        rows = rows.join(held, "kl_value", "left").withColumn("kl_taken", F.coalesce(taken, F.lit(False)))
        first = rows.where("kl_value is not null and not kl_taken").groupBy("kl_value").agg(F.min_by("key", "kl_seq").alias("kl_first"))
        rows = rows.join(first, "kl_value", "left")
        clash = F.col("kl_value").isNotNull() & (F.col("kl_taken") | ~F.col("kl_first").eqNullSafe(F.col("key")))
        rows = rows.withColumn("reason", F.coalesce("reason", F.when(clash, F.lit(f"{f.name}: not unique")))).drop("kl_value", "kl_min", "kl_max", "kl_taken", "kl_first")
    good = rows.where("reason is null")
    last = good.groupBy("key").agg(F.max(F.struct("kl_seq", "document")).alias("kl_b"), F.count(F.lit(1)).alias("kl_n"))
    held = current.select(F.col("key").alias("kl_key"), F.col("document").alias("kl_doc"), F.col("version").alias("kl_version"))
    joined = held.join(last, F.col("kl_key") == F.col("key"), "full_outer")
    state = joined.select(F.coalesce("key", "kl_key").alias("key"), F.when(F.col("key").isNull(), F.col("kl_doc")).otherwise(F.col("kl_b.document")).alias("document"), (F.coalesce("kl_version", F.lit(0)) + F.coalesce("kl_n", F.lit(0))).cast("bigint").alias("version"))
    return state.where("document is not null"), rows.where("reason is not null").select("key", "document", F.col("kl_seq").alias(seq), "reason")
