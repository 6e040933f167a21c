"""Expressions on keys and operation codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The operation codes of the log format and their names.
PUT_CODES = ("put", "1")
DELETE_CODES = ("delete", "2")

#: Digits that fit a bigint without overflow.
MAX_DIGITS = 18


def is_put(op: Column) -> Column:
    """True for a Put as any writer spells it, false for a Delete, null for anything else."""
    code = F.lower(F.trim(op))
    return F.when(code.isin(*PUT_CODES), True).when(code.isin(*DELETE_CODES), False)


def key_text(key: Column) -> Column:
    """A binary key as a string; a string key is unchanged."""
    return key.cast("string")


def key_parts(key: Column) -> dict[str, Column]:
    """Split a string key into prefix, digit count and trailing integer.

    The mapping is one to one for every string: up to 18 trailing digits make
    the number, whatever stands before them is the prefix.  Case, blanks and
    leading zeros therefore all keep their meaning.  Null gives nulls.
    """
    digits = F.regexp_extract(key, rf"([0-9]{{0,{MAX_DIGITS}}})$", 1)
    width = F.length(digits)
    return {
        "prefix": F.substring(key, F.lit(1), F.length(key) - width),
        "width": width,
        "number": F.when(width > 0, digits.try_cast("bigint")).otherwise(F.when(key.isNotNull(), F.lit(0).cast("bigint"))),
    }


def little_endian_hex(value: Column, bits: int) -> Column:
    """Hex of an integer's bytes, lowest byte first (32 or 64 bits)."""
    n = bits // 4
    text = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    text = F.substring(text, 17 - n, n)
    return F.array_join(F.reverse(F.regexp_extract_all(text, F.lit("(..)"), F.lit(1))), "")


def encoded_key(value: Column, kind: str) -> Column:
    """The sortable binary form of a primary key as hex: one tag byte, then the bytes.

    Kinds: ``string``, ``int32``, ``int64``, ``bytes``; integers are stored
    lowest byte first, so this order is not numeric.
    """
    # Tag byte per kind.
    tags = {"string": "00", "int32": "01", "int64": "02", "bytes": "03"}
    if kind == "string":
        body = F.hex(F.encode(value, "UTF-8"))
    elif kind == "bytes":
        body = F.hex(value)
    else:
        body = little_endian_hex(value, 32 if kind == "int32" else 64)
    return F.concat(F.lit(tags[kind]), body)
