import random

import pytest

from keyloom.llm.packing import faults, DEFAULT_TOKENIZER, SumOfSquares, fill_report, pack, token_counter
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string"


def brute_place(levels, cap, size):
    """Sum of squares by definition: try every choice and keep the least."""
    best = None
    for level in [0, *sorted({x for x in levels if x + size <= cap}, reverse=True)]:
        after = list(levels)
        if level:
            after.remove(level)
        after.append(level + size)
        cost = sum(after.count(x) ** 2 for x in set(after) if x < cap)
        if best is None or cost < best:
            best = cost
    return best


def test_each_choice_is_least():
    rng = random.Random(1)
    for cap in (7, 16, 33):
        packer, levels = SumOfSquares(cap), []
        for _ in range(300):
            size = rng.randint(1, cap)
            want = brute_place(levels, cap, size)
            before = list(packer.fill)
            n = packer.place(size)
            levels = list(packer.fill)
            cost = sum(levels.count(x) ** 2 for x in set(levels) if x < cap)
            assert cost <= want and levels[n] == (before[n] if n < len(before) else 0) + size <= cap


def docs(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "é", "\n", "x" * 40]
    data = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 30, 90, 400])))) for i in range(400)]
    return data + [(1000, None), (1001, ""), (1002, "word " * 30000), (None, "no id"), (5, data[5][1])]


@pytest.mark.parametrize("group_items", [100, 100000])
def test_whole_documents_in_bounded_containers(spark, group_items):
    data = docs(spark)
    df = spark.createDataFrame(data, DOCS).withColumn("grp", F.lit("clash")).withColumn("n_tokens", F.lit(-1))
    specs = spark.createDataFrame([("a", 64), ("b", 1000), ("z", 0), ("n", None)], "spec_id string, capacity_tokens int")
    packed = pack(df, specs, group_items=group_items)
    out = packed.collect()
    count = token_counter(DEFAULT_TOKENIZER)
    for spec, cap in (("a", 64), ("b", 1000)):
        rows = [r for r in out if r.spec_id == spec]
        fill, parts = {}, {}
        for r in rows:
            if r.container_id is not None:
                fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
            parts.setdefault(r.doc_id, []).append(r)
        assert max(fill.values()) <= cap
        for doc, text in dict(data).items():
            n = count([text or ""])[0]
            mine = sorted(parts[doc], key=lambda r: r.part)
            copies = sum(d == doc for d, _ in data)
            assert sum(r.n_tokens for r in mine) == n * copies
            assert len(mine) == copies * max(1, -(-n // cap))
            assert all((r.container_id is None) == (n == 0) for r in mine)
            if copies == 1:
                assert [r.start_token for r in mine] == [cap * i for i in range(len(mine))]
        total = sum(fill.values())
        assert len(fill) <= 1.05 * -(-total // cap) + 2
    report = {r.spec_id: r for r in fill_report(packed, specs).collect()}
    assert report["a"].documents == report["b"].documents == len(data) and report["a"].fullest <= 64
    assert {r.spec_id for r in out} == {"a", "b"}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], DOCS)
    specs = spark.createDataFrame([("a", 64)], "spec_id string, capacity_tokens int")
    assert pack(none, specs).count() == 0
    assert pack(spark.createDataFrame([(1, "x")], DOCS), specs.limit(0)).count() == 0


def test_tokenizers_by_file_kind():
    here = DEFAULT_TOKENIZER.rsplit("/", 1)[0]
    text = "Plain words, and <|endoftext|> as text."
    same = token_counter(f"{here}/byte_bpe_50k.json")([text])
    assert token_counter(DEFAULT_TOKENIZER)([text]) == same
    assert token_counter(f"{here}/piece_bpe_32k.model")([text, ""])[1] == 0


def test_faults_are_seen(spark):
    specs = spark.createDataFrame([("a", 10)], "spec_id string, capacity_tokens int")
    kind = "spec_id string, container_id string, doc_id bigint, part int, start_token bigint, n_tokens bigint"
    good = [("a", "x", 1, 0, 0, 4), ("a", "x", 2, 0, 0, 6), ("a", "y", 3, 0, 0, 10), ("a", "z", 3, 1, 10, 2), ("a", None, 4, 0, 0, 0)]
    look = lambda rows: tuple(faults(spark.createDataFrame(rows, kind), specs).first())
    assert look(good) == ("a", 4, 0, 0, 0, 0)
    assert look([*good, ("a", "x", 5, 0, 0, 1)])[2] == 1
    assert look([*good, ("a", "u", 5, 0, 0, 1), ("a", "v", 5, 1, 1, 1)])[3:5] == (1, 1)
    assert look([*good, ("a", "u", 5, 0, 0, 10), ("a", "v", 5, 2, 20, 1)])[4] == 1
    assert look([*good, ("a", None, 5, 0, 0, 1)])[5] == 1
