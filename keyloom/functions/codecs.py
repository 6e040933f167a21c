"""Binary forms of keys and typed object values, for import and export."""

from __future__ import annotations

import math
import struct

# The tag byte of each object type.
TAGS = {"bytes": 0, "string": 1, "integer": 2, "list": 3, "hash": 4, "set": 5, "sorted_set": 6, "json": 7, "stream": 8, "null": 9}
NAMES = {v: k for k, v in TAGS.items()}
SCHEMA_TAGS = {"null": 0, "string": 1, "int32": 2, "int64": 3, "float": 4, "bool": 5, "object": 6, "array": 7, "json": 8, "bytes": 9}
KEY_TAGS = {"string": 0, "int32": 1, "int64": 2, "bytes": 3}


#: Limits of a document value.
MAX_VALUE_BYTES, MAX_VALUE_ITEMS, MAX_VALUE_LEVELS = 64 << 20, 1 << 20, 64


class CodecError(ValueError):
    """Bytes that aren't a well-formed value."""


def encode_key(value, kind: str) -> bytes:
    body = {"string": lambda: value.encode(), "int32": lambda: struct.pack("<i", value), "int64": lambda: struct.pack("<q", value), "bytes": lambda: bytes(value)}[kind]()
    return bytes([KEY_TAGS[kind]]) + body


def decode_key(data: bytes):
    kind = {v: k for k, v in KEY_TAGS.items()}.get(data[0] if data else -1)
    body = data[1:]
    if kind == "string":
        return body.decode()
    if kind == "bytes":
        return body
    size = {"int32": 4, "int64": 8}.get(kind)
    if size is None or len(body) != size:
        raise CodecError("malformed key")
    return int.from_bytes(body, "little", signed=True)


def _blob(b: bytes) -> bytes:
    return struct.pack("<I", len(b)) + b


def encode_object(kind: str, value=None) -> bytes:
    """One tagged value; hashes and sets are written in byte order, sorted sets in score order."""
    out = [bytes([TAGS[kind]])]
    if kind in ("bytes", "json"):
        out.append(_blob(value))
    elif kind == "string":
        out.append(_blob(value.encode()))
    elif kind == "integer":
        out.append(struct.pack("<q", value))
    elif kind == "list":
        out += [struct.pack("<I", len(value)), *map(_blob, value)]
    elif kind == "set":
        out += [struct.pack("<I", len(set(value))), *map(_blob, sorted(set(value)))]
    elif kind == "hash":
        out += [struct.pack("<I", len(value)), *(_blob(k) + _blob(value[k]) for k in sorted(value))]
    elif kind == "sorted_set":
        if not all(math.isfinite(s) for s, _ in value):
            raise CodecError("score is not finite")
        out += [struct.pack("<I", len(value)), *(struct.pack("<d", s) + _blob(m) for s, m in sorted(value))]
    elif kind == "stream":
        out.append(struct.pack("<I", len(value)))
        for millis, seq, fields in value:
            out += [struct.pack("<QQI", millis, seq, len(fields)), *(_blob(k) + _blob(fields[k]) for k in sorted(fields))]
    return b"".join(out)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if len(self.data) - self.at < n:
            raise CodecError("value ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, fmt: str):
        return struct.unpack(fmt, self.take(struct.calcsize(fmt)))[0]

    def blob(self) -> bytes:
        return self.take(self.number("<I"))

    def count(self, least: int) -> int:
        n = self.number("<I")
        if n * least > len(self.data) - self.at:
            raise CodecError("count beyond the value's end")
        return n

    def fields(self) -> dict[bytes, bytes]:
        return {self.blob(): self.blob() for _ in range(self.count(8))}


def decode_object(data: bytes):
    """(kind, value) of a tagged value; anything left over or missing is an error."""
    r = _Reader(data)
    kind = NAMES.get(r.take(1)[0])
    if kind in ("bytes", "json"):
        value = r.blob()
    elif kind == "string":
        try:
            value = r.blob().decode()
        except UnicodeDecodeError as e:
            raise CodecError("string is not UTF-8") from e
    elif kind == "integer":
        value = r.number("<q")
    elif kind == "list":
        value = [r.blob() for _ in range(r.count(4))]
    elif kind == "set":
        value = sorted({r.blob() for _ in range(r.count(4))})
    elif kind == "hash":
        value = r.fields()
    elif kind == "sorted_set":
        value = [(r.number("<d"), r.blob()) for _ in range(r.count(12))]
        if not all(math.isfinite(s) for s, _ in value):
            raise CodecError("score is not finite")
    elif kind == "stream":
        value = [(r.number("<Q"), r.number("<Q"), r.fields()) for _ in range(r.count(20))]
    elif kind == "null":
        value = None
    else:
        raise CodecError("unknown tag")
    if r.at != len(data):
        raise CodecError("bytes after the value")
    return kind, value


def encode_value(value, kind=None) -> bytes:
    """A document value with its tags: null, text, numbers, truth values, objects (fields in order of name) and arrays.

    ``kind`` is the declared type as :mod:`keyloom.operators.documents` has it;
    without one whole numbers are written in 32 bits where they fit, else in 64.
    Values that no reader takes are a :class:`CodecError`: numbers that aren't
    finite or too large, and more levels, items or bytes than a value may have.
    """
    out = _tagged(value, kind, 0)
    if len(out) > MAX_VALUE_BYTES:
        raise CodecError("value too large")
    return out


def _tagged(value, kind, level: int) -> bytes:
    if level > MAX_VALUE_LEVELS:
        raise CodecError("value too deep")
    name = kind.kind if kind is not None else None
    if value is None:
        return _tag("null")
    if name in ("json", "bytes"):
        return _tag(name) + _blob(value if isinstance(value, bytes) else str(value).encode())
    if isinstance(value, bool):
        return _tag("bool") + bytes([value])
    if isinstance(value, int) and name != "float":
        if name == "int32" or name is None and -(1 << 31) <= value < 1 << 31:
            return _tag("int32") + _number("<i", value)
        return _tag("int64") + _number("<q", value)
    if isinstance(value, (int, float)):
        if not math.isfinite(value):
            raise CodecError("number is not finite")
        return _tag("float") + struct.pack("<d", value)
    if isinstance(value, str):
        return _tag("string") + _blob(value.encode())
    if isinstance(value, bytes):
        return _tag("bytes") + _blob(value)
    if len(value) > MAX_VALUE_ITEMS:
        raise CodecError("too many items")
    if isinstance(value, dict):
        kinds = {f.name: f.type for f in kind.fields} if name == "object" else {}
        parts = [_blob(k.encode()) + _tagged(value[k], kinds.get(k), level + 1) for k in sorted(value, key=str.encode)]
        return _tag("object") + struct.pack("<I", len(value)) + b"".join(parts)
    inner = kind.inner if name == "array" else None
    return _tag("array") + struct.pack("<I", len(value)) + b"".join(_tagged(v, inner, level + 1) for v in value)


def _tag(name: str) -> bytes:
    return bytes([SCHEMA_TAGS[name]])


def _number(form: str, value: int) -> bytes:
    try:
        return struct.pack(form, value)
    except struct.error as e:
        raise CodecError("number out of range") from e


def decode_value(data: bytes):
    """The value that :func:`encode_value` wrote; anything left over, missing or beyond the limits is an error."""
    if len(data) > MAX_VALUE_BYTES:
        raise CodecError("value too large")
    r = _Reader(data)
    value = _read_value(r, 0)
    if r.at != len(data):
        raise CodecError("bytes after the value")
    return value


def _read_value(r: _Reader, level: int):
    if level > MAX_VALUE_LEVELS:
        raise CodecError("value too deep")
    kind = {v: k for k, v in SCHEMA_TAGS.items()}.get(r.take(1)[0])
    if kind == "null":
        return None
    if kind in ("json", "bytes"):
        return r.blob()
    if kind == "string":
        return _utf8(r.blob())
    if kind == "bool":
        mark = r.take(1)[0]
        if mark > 1:
            raise CodecError("neither true nor false")
        return mark == 1
    if kind in ("int32", "int64", "float"):
        value = r.number({"int32": "<i", "int64": "<q", "float": "<d"}[kind])
        if kind == "float" and not math.isfinite(value):
            raise CodecError("number is not finite")
        return value
    if kind == "array":
        n = r.count(1)
        if n > MAX_VALUE_ITEMS:
            raise CodecError("too many items")
        return [_read_value(r, level + 1) for _ in range(n)]
    if kind == "object":
        n = r.count(5)
        if n > MAX_VALUE_ITEMS:
            raise CodecError("too many items")
        out: dict = {}
        for _ in range(n):
            name = _utf8(r.blob())
            if name in out:
                raise CodecError("repeated field")
            out[name] = _read_value(r, level + 1)
        return out
    raise CodecError("unknown tag")


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        raise CodecError("text is not UTF-8") from e
