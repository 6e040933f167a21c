"""Strict JSON texts of any depth, for the few places that read them in Python.

The standard parser does the work; where its recursion ends, a loop over tokens
takes over, so that how deep an irrelevant field is never decides about a document.
"""

from __future__ import annotations

import json
import re
import sys

if hasattr(sys, "set_int_max_str_digits"):
    sys.set_int_max_str_digits(0)  # a long number is a number

TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:(\.[0-9]+)?([eE][+-]?[0-9]+)?))|(true|false|null)|$)')
NAMES = {"true": True, "false": False, "null": None}


def _no_constant(name: str):
    raise ValueError(name)


_decode = json.JSONDecoder(parse_constant=_no_constant).decode
_encode = json.JSONEncoder(separators=(",", ":")).encode


def parse(text: str, pairs=None):
    """The value of a JSON text by the letter: NaN and Infinity are errors, as is anything after the value.  ValueError if it is ill-formed.

    ``pairs`` makes an object of its (name, value) pairs; a dictionary by default.
    """
    try:
        return _decode(text) if pairs is None else json.JSONDecoder(parse_constant=_no_constant, object_pairs_hook=pairs).decode(text)
    except RecursionError:
        return parse_deep(text, pairs)


def parse_deep(text: str, pairs=None):
    """:func:`parse` without recursion."""
    stack: list[tuple[object, str | None]] = []
    out, key, at = None, None, 0
    state = "value"  # what may come: value, first (a value or the end of an array), key, firstkey, colon, comma, end
    while True:
        m = TOKEN.match(text, at)
        if m is None or m.end() == at and at < len(text):
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        mark, string, number, fraction, exponent, name = m.groups()
        if mark is None and string is None and number is None and name is None:
            if state != "end":
                raise ValueError("the text ends early")
            return out
        if state in ("key", "firstkey") and string is not None:
            key, state = _decode(string), "colon"
            continue
        if state == "colon" and mark == ":":
            state = "value"
            continue
        if state == "comma" and mark == ",":
            state = "key" if isinstance(stack[-1][0], _Pairs) else "value"
            continue
        if mark in ("]", "}") and stack and state in ("comma", "first" if mark == "]" else "firstkey") and isinstance(stack[-1][0], list if mark == "]" else _Pairs):
            value, key = stack.pop()
            if mark == "}":
                value = dict(value.pairs) if pairs is None else pairs(value.pairs)
        elif state not in ("value", "first"):
            raise ValueError(f"unexpected text at {at}")
        elif mark in ("[", "{"):
            stack.append(([] if mark == "[" else _Pairs(), key))
            state = "first" if mark == "[" else "firstkey"
            continue
        elif mark is not None:
            raise ValueError(f"unexpected text at {at}")
        elif string is not None:
            value = _decode(string)
        elif number is not None:
            value = float(number) if fraction or exponent else int(number)
        else:
            value = NAMES[name]
        if not stack:
            out, state = value, "end"
        else:
            top = stack[-1][0]
            if isinstance(top, _Pairs):
                top.pairs.append((key, value))
            else:
                top.append(value)
            state = "comma"


class _Pairs:
    """An object that is still open."""

    def __init__(self) -> None:
        self.pairs: list[tuple[str, object]] = []


def dump(value) -> str:
    """The value as compact JSON text, however deep."""
    try:
        return _encode(value)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, _Text):
            out.append(v)
        elif isinstance(v, dict):
            parts: list = [_Text("{")]
            for i, (k, x) in enumerate(v.items()):
                parts += [_Text(("," if i else "") + _encode(k) + ":"), x]
            todo += [*parts, _Text("}")][::-1]
        elif isinstance(v, list):
            parts = [_Text("[")]
            for i, x in enumerate(v):
                parts += [_Text(","), x] if i else [x]
            todo += [*parts, _Text("]")][::-1]
        else:
            out.append(_encode(v))
    return "".join(out)


class _Text(str):
    """Text that is written as it is."""


def depth(value) -> int:
    """Levels of arrays and objects."""
    level, n = [value], 0
    while level := [v for v in level if isinstance(v, (list, dict))]:
        n += 1
        level = [x for v in level for x in (v if isinstance(v, list) else v.values())]
    return n
