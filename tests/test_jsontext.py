import json
import random

import pytest

from keyloom.functions.jsontext import depth, dump, parse, parse_deep


def value(rng, level=0):
    kind = rng.randrange(7 if level < 4 else 5)
    if kind == 5:
        return [value(rng, level + 1) for _ in range(rng.randrange(4))]
    if kind == 6:
        return {rng.choice(["a", 'q"', "\\", "é", ""]) + str(i): value(rng, level + 1) for i in range(rng.randrange(4))}
    return [None, True, rng.randrange(-99, 99), rng.choice([1.5, -2e30, 0.0]), rng.choice(["", "x\n", "\u2028", '"', "\\u0041"])][kind]


def test_agrees_with_the_standard_parser_on_good_and_broken_texts():
    rng = random.Random(1)
    for _ in range(600):
        v = value(rng)
        text = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert parse_deep(text) == v == parse(text) and json.loads(dump(v)) == v
        at = rng.randrange(len(text) + 1)
        broken = text[:at] + rng.choice(["", "]", "}", ",", ":", '"', "0", " ", "x", "\x01"]) + text[at + rng.randrange(2) :]
        try:
            want = parse(broken)
        except ValueError:
            with pytest.raises(ValueError):
                parse_deep(broken)
        else:
            assert parse_deep(broken) == want


def test_any_depth():
    for n in (10, 100000):
        text = "[" * n + "]" * n
        assert depth(parse(text)) == n and dump(parse(text)) == text
    deep = '{"a":' * 60000 + "[1,true,null]" + "}" * 60000
    assert dump(parse(deep)) == deep
    for bad in ("", "[" * 100000, "[1" + "}" * 100000, "NaN", "[Infinity]", "01", "1.", "[1,]", '{"a"}', "1 2", "tru"):
        for f in (parse, parse_deep):
            with pytest.raises(ValueError):
                f(bad)
