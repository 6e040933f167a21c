"""Deeply nested documents as related flat tables (problem 4).

A declared schema is compiled into a tree of object and array nodes.  Workers
parse each document once and walk it along that tree.  A bottom-up tree
automaton gives every object a state that stands for its shape: which declared
fields it has, of what kind, and the states of its children.  Equal shapes have
equal states on all workers.  Each object becomes one row that carries its path,
its position, its parent's position and its state, and :func:`route` writes all
rows in one pass to a typed subtype table per path, in which the variants lie
apart; keys and parent links that all subtypes have in common are the supertype
table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from keyloom.functions.jsontext import depth, dump, parse

# The scalar type names of the schema language and their Spark types.
SCALARS = {"string": "string", "int32": "int", "int64": "bigint", "float": "double", "bool": "boolean", "json": "string", "bytes": "binary"}

#: Levels of nesting beyond which a payload gives a value as its JSON text, since JSON readers of tables go no deeper than 1000.
PAYLOAD_LEVELS = 500

CHILD_SCHEMA = "collection string, path string, ordinals string, parent_path string, parent_ordinals string, shape bigint, extras boolean, payload string"


def compile_type(declared) -> tuple:
    """A declared field type as a node: ('object', {name: node}), ('array', node) or ('scalar', name)."""
    if isinstance(declared, str):
        text = declared.strip()
        if text[:1] == "{":
            return compile_type(json.loads(text))
        if text.endswith("[]"):
            return ("array", compile_type(text[:-2]))
        return ("scalar", text)
    if "object" in declared:
        return ("object", {f["name"]: compile_type(f["type"]) for f in declared["object"]})
    if "array" in declared:
        return ("array", compile_type(declared["array"]))
    raise ValueError(f"unknown type {declared!r}")


def compile_fields(rows: Sequence[tuple[str, str, str]]) -> dict[str, tuple]:
    """(collection, name, field_type) rows as one object node per collection."""
    out: dict[str, tuple] = {}
    for collection, name, kind in rows:
        out.setdefault(collection, ("object", {}))[1][name] = compile_type(kind)
    return out


def object_paths(node: tuple, at: str = "") -> Iterator[tuple[str, dict]]:
    """The paths of all declared arrays of objects, with the fields of their elements."""
    if node[0] == "object":
        for name, child in node[1].items():
            yield from object_paths(child, f"{at}.{name}" if at else name)
    elif node[0] == "array":
        inner = node[1]
        while inner[0] == "array":
            inner = inner[1]
        if inner[0] == "object":
            yield at, inner[1]
            yield from object_paths(inner, at)


def holds_scalars(node: tuple) -> bool:
    """Whether a node is a scalar or an array of scalars, at any level."""
    while node[0] == "array":
        node = node[1]
    return node[0] == "scalar"


def flat_columns(fields: dict[str, tuple], prefix: str = "") -> dict[str, str]:
    """Columns of an object's own values and their Spark types: scalars, arrays of scalars, and those of inline objects by dotted name."""
    out: dict[str, str] = {}
    for name, node in fields.items():
        if node[0] == "object":
            below = flat_columns(node[1], f"{prefix}{name}.")
        else:
            below = {prefix + name: _spark_type(node)} if holds_scalars(node) else {}
        if out.keys() & below.keys():
            raise ValueError(f"two fields named {sorted(out.keys() & below.keys())[0]!r}")
        out |= below
    return out


def _spark_type(node: tuple) -> str:
    return f"array<{_spark_type(node[1])}>" if node[0] == "array" else SCALARS.get(node[1], "string")


def decoded(value):
    """What a string encodes, if it is JSON text, also several times over; other values as they are."""
    while isinstance(value, str):
        try:
            value = parse(value)
        except ValueError:
            break
    return value


class ShapeAutomaton:
    """Bottom-up states for object shapes, interned by (field, kind or child state)."""

    def __init__(self) -> None:
        self.states: dict[tuple, int] = {}

    def state(self, parts: tuple) -> int:
        known = self.states.get(parts)
        if known is None:
            known = self.states[parts] = xxhash.xxh3_64_intdigest(repr(parts).encode()) - (1 << 63)
        return known


KINDS = {str: "s", bool: "b", int: "i", float: "f", type(None): "n", list: "l", dict: "o"}


class Flattener:
    """Walks documents of one collection along its compiled schema."""

    def __init__(self, root: tuple, payload: bool = True) -> None:
        self.root, self.payload, self.automaton, self.deep = root, payload, ShapeAutomaton(), False

    def rows(self, text: str | None) -> list[tuple]:
        """(path, ordinals, parent path, parent ordinals, state, extras, payload) per object; none for ill-formed text."""
        if text is None:
            return []
        try:
            doc = decoded(parse(text))
        except ValueError:
            return []
        out: list[tuple] = []
        self.deep = text.count("[") + text.count("{") > PAYLOAD_LEVELS
        if isinstance(doc, dict):
            self._object(doc, self.root[1], "", "", "", "", out, None, "")
        return out

    def _object(self, obj: dict, fields: dict, path: str, field_path: str, ordinals: str, parent: str, out: list[tuple], flat: dict | None, prefix: str) -> int:
        """Emit the objects below ``obj``; returns its state. ``path`` is that of the nearest array element, ``field_path`` of this object.

        ``flat``, unless None, takes the values of ``obj`` that are in no row below it, each under ``prefix`` and its name.
        """
        shape = []
        for name, node in fields.items():
            if name not in obj:
                continue
            given, kind = obj[name], node[0]
            if kind == "scalar":
                shape.append((name, KINDS[type(given)]))
                if flat is not None:
                    flat[prefix + name] = given
                continue
            value = decoded(given)
            below = f"{field_path}.{name}" if field_path else name
            if kind == "object":
                if isinstance(value, dict):
                    shape.append((name, self._object(value, node[1], path, below, ordinals, parent, out, flat, f"{prefix}{name}.")))
                else:
                    shape.append((name, KINDS[type(value)]))
                    if flat is not None:
                        flat[prefix + name] = given
            else:
                misfits: dict[str, object] = {}
                shape.append((name, self._array(value, node[1], path, below, ordinals, ordinals, out, misfits, "")))
                if flat is not None:
                    if holds_scalars(node):
                        flat[prefix + name] = value if isinstance(value, list) else given
                    elif not isinstance(value, list) and not (isinstance(value, dict) and node[1][0] == "object"):
                        flat[prefix + name] = given
                    elif misfits:
                        flat[prefix + name] = misfits
        extras = len(obj) > len(shape)
        if extras and flat is not None:
            flat |= {prefix + (dump(k) if "." in k else k): v for k, v in obj.items() if k not in fields}
        return self.automaton.state((*shape, "+") if extras else tuple(shape))

    def _array(self, value, element: tuple, path: str, below: str, ordinals: str, parent: str, out: list[tuple], misfits: dict, at: str):
        """Emit the elements of a declared array; the state is the set of its elements' states.

        ``parent`` is the position of the nearest element around it; in an array of
        arrays ``ordinals`` goes on from there.  ``misfits`` takes the elements that give no row, by their positions from ``at`` on.
        """
        if element[0] == "scalar":
            return KINDS[type(value)]
        if isinstance(value, dict) and element[0] == "object":
            value = [value]
        if not isinstance(value, list):
            return KINDS[type(value)]
        states = set()
        for i, given in enumerate(value):
            item = decoded(given)
            here = f"{ordinals}.{i}" if ordinals else str(i)
            if element[0] == "array":
                states.add(self._array(item, element[1], path, below, here, parent, out, misfits, f"{at}{i}."))
                if not isinstance(item, list) and not (isinstance(item, dict) and element[1][0] == "object"):
                    misfits[f"{at}{i}"] = given
            elif isinstance(item, dict):
                slot = len(out)
                out.append(())
                flat: dict | None = {} if self.payload else None
                state = self._object(item, element[1], below, below, here, parent, out, flat, "")
                payload = None
                if flat is not None:
                    if self.deep:
                        flat = {k: dump(v) if depth(v) > PAYLOAD_LEVELS else v for k, v in flat.items()}
                    payload = dump(flat)
                out[slot] = (below, here, path, parent, state, len(item) > sum(k in element[1] for k in item), payload)
                states.add(state)
            else:
                misfits[f"{at}{i}"] = given
        return self.automaton.state(("[]", *sorted(map(str, states))))


def flatten(documents: DataFrame, schema: dict[str, tuple], keep: Sequence[str], payload: bool = True) -> DataFrame:
    """One row per object in a declared array of objects, with its parent link.

    ``documents``: collection, document and the columns in ``keep``, which
    identify the document and are passed through.  Adds: path, ordinals,
    parent_path and parent_ordinals (empty for children of the document
    itself), shape (the automaton's state), extras (whether it has undeclared
    fields) and payload (JSON; null if not asked for).  The payload has all
    declared values of the object that are in no row below it: scalars, arrays of
    scalars, and those of its inline objects under dotted names such as
    ``terms.currency``; a value in place of an inline object or an array of
    objects that is none, and the elements of such an array that are no objects,
    by position.  It also has undeclared fields, names with a dot in quotes.
    A value of more than PAYLOAD_LEVELS levels stands in it as its JSON text.
    Values that belong to the document itself are in no row; they stay in the
    document.

    An object in place of an array is its element 0; text in place of an array,
    object or element is read as the JSON it encodes, also several times over.
    Elements that are no objects give no row but count as positions.  Null,
    empty and ill-formed documents, and collections without a declaration, give
    no rows.  Workers hold one Arrow batch of documents at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walkers = {c: Flattener(node, payload) for c, node in schema.items()}
        for batch in batches:
            collections, texts = batch.column("collection").to_pylist(), batch.column("document").to_pylist()
            index: list[int] = []
            found: list[tuple] = []
            for i, (c, text) in enumerate(zip(collections, texts)):
                walker = walkers.get(c)
                if walker is not None:
                    rows = walker.rows(text)
                    index.extend([i] * len(rows))
                    found.extend(rows)
            at = pa.array(index, pa.int64())
            cols = list(zip(*found)) if found else [[]] * 7
            kept = [batch.column(k).take(at) for k in keep]
            kept.append(batch.column("collection").take(at))
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(list(v), t) for v, t in zip(cols, kinds)]], names=[*keep, "collection", "path", "ordinals", "parent_path", "parent_ordinals", "shape", "extras", "payload"])

    rows = documents.select(*keep, "collection", "document").where("document is not null")
    kept = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keep)
    return rows.mapInArrow(work, f"{kept}, {CHILD_SCHEMA}")


def one_copy(documents: DataFrame, ident: Sequence[str]) -> DataFrame:
    """One copy with a document per identifier: the first to arrive, then that with the least text.

    A hash of the text breaks ties, so that only one text per identifier and
    task is shuffled (a window group limit before the exchange).
    """
    from keyloom.operators.dedupe import first_copies

    rows = documents.where("document is not null").select(*ident, "collection", "document", "arrived_at").withColumn("kl_tie", F.xxhash64("document"))
    return first_copies(rows, ident, "arrived_at", ["kl_tie"]).drop("kl_tie", "arrived_at")


def subtype_table(children: DataFrame, schema: dict[str, tuple], collection: str, path: str, keep: Sequence[str], shape: int | None = None) -> DataFrame:
    """The typed table of one path: keys, parent link, common columns, the payload, then the columns of :func:`flat_columns`.

    With ``shape`` only rows of that structural variant are routed in.  A value
    of another type than declared reads as null, or as its text in a string
    column; the payload has it as it was.
    """
    fields = dict(object_paths(schema[collection]))[path]
    columns = flat_columns(fields)
    rows = children.where((F.col("collection") == collection) & (F.col("path") == path))
    if shape is not None:
        rows = rows.where(F.col("shape") == F.lit(shape))
    ddl = ", ".join(f"`{k}` {t}" for k, t in columns.items())
    typed = F.from_json("payload", ddl, {"mode": "PERMISSIVE"})
    return rows.withColumn("kl_typed", typed).select(*keep, "ordinals", "parent_path", "parent_ordinals", "shape", "payload", *[F.col(f"kl_typed.`{k}`").alias(k) for k in columns])


@dataclass(frozen=True)
class Routed:
    """The subtype tables that :func:`route` wrote."""

    spark: SparkSession
    folder: str
    written: StructType
    schema: dict[str, tuple]
    keep: tuple[str, ...]

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.written).parquet(self.folder)

    def paths(self) -> list[tuple[str, str]]:
        return [(c, p) for c, node in self.schema.items() for p, _ in object_paths(node)]

    def table(self, collection: str, path: str, shape: int | None = None) -> DataFrame:
        """The typed table of a path, or of one of its variants: only its own folder is read, of a variant only its row groups."""
        return subtype_table(self.rows(), self.schema, collection, path, self.keep, shape)

    def supertype(self) -> DataFrame:
        """What all subtypes have in common, for all rows: keys, parent link and shape."""
        return self.rows().select(*self.keep, "collection", "path", "ordinals", "parent_path", "parent_ordinals", "shape", "extras")


def route(children: DataFrame, schema: dict[str, tuple], keep: Sequence[str], folder: str) -> Routed:
    """Write the rows of :func:`flatten` in one pass to the subtype tables of all paths and variants.

    Each collection and path has a folder; within its files rows are sorted by
    shape, so variants lie apart.  A task writes at most one file a path.
    ``folder`` must be shared by all executors and not exist.
    """
    children.sortWithinPartitions("collection", "path", "shape").write.mode("error").partitionBy("collection", "path").parquet(folder)
    return Routed(children.sparkSession, folder, children.schema, schema, tuple(keep))


def declared_schema(fields: DataFrame) -> dict[str, tuple]:
    """Compile the declared fields; the schema itself (tens of rows) is read to the driver."""
    return compile_fields([(r[0], r[1], r[2]) for r in fields.select("collection", "name", "field_type").collect()])
