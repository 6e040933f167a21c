import random

import pytest

from keyloom.llm.leakage import ItemIndex, leaks
from keyloom.llm.text import HARD, plain_words, words_and_gaps
from pyspark.sql import functions as F

WORDS = "the of keeper bridge near stone harbour lantern voted council winter morning walked carried seven forty borrowed painted kettle copper island letter river market".split()


def passage(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def items(rng, n=40):
    out = [(f"i{k}", "Answer this.", passage(rng, rng.choice([3, 8, 13, 14, 40, 90])), rng.choice(["copper", "zebra"])) for k in range(n)]
    return out + [("same", None, out[0][2], None), ("none", "q", None, "a"), ("empty", "q", " ,. ", "a")]


def disguised(rng, words):
    kind = rng.randrange(8)
    if kind == 0:
        return " ".join(words).upper()
    if kind == 1:
        return "\n".join("> " + " ".join(words[i : i + 4]) for i in range(0, len(words), 4))
    if kind == 2:
        return " ".join(w[:2] + "​" + w[2:] for w in words)
    if kind == 3:
        return " ".join(chr(ord(w[0]) + 0xFEE0) + w[1:] for w in words)
    if kind == 4:
        return " <b>".join(words)
    if kind == 5:
        return " ".join(w[:1] + "-\n> " + w[1:] if len(w) > 3 else w for w in words)
    if kind == 6:
        return ", ".join(words) + "!"
    return "&nbsp;".join(words)


def brute(text, rows, run=13):
    """All spans of all items against all words, joined across soft gaps in every way."""
    words, gaps = words_and_gaps(text or "")
    found = set()
    for item, _, p, _ in rows:
        target = plain_words(p or "")
        size = min(run, len(target))
        if not target:
            continue
        spans = {tuple(target[k : k + size]) for k in range(len(target) - size + 1)}

        def matches(span, i):
            for w in span:
                built = ""
                while i < len(words) and len(built) < len(w) and w.startswith(built + words[i]) and (not built or gaps[i] != HARD):
                    built += words[i]
                    i += 1
                if built != w:
                    return False
            return True

        if any(matches(s, i) for s in spans for i in range(len(words))):
            found.add(item)
    return found


def test_finds_exactly_what_brute_force_finds():
    rng = random.Random(11)
    rows = items(rng)
    index = ItemIndex.of(rows)
    hits, texts, wanted = 0, [], []
    for _ in range(400):
        target = plain_words(rng.choice(rows)[2] or "x")
        n = rng.choice([5, 11, 12, 13, 14, 30])
        at = rng.randrange(max(1, len(target) - n + 1))
        text = passage(rng, rng.randrange(40)) + " " + disguised(rng, target[at : at + n]) + " " + passage(rng, rng.randrange(200))
        got = {index.items[d][0] for d, *_ in index.search(text)}
        assert got == brute(text, rows)
        texts.append(text)
        wanted.append(index.search(text))
        hits += len(got)
    assert hits > 100
    together = list(index.search_all([None, "", *texts, "..."]))
    assert [(i, *row) for i, rows_ in enumerate(wanted, 2) for row in rows_] == together


def test_ranges_of_one_and_of_many_items_find_the_same(monkeypatch):
    rng = random.Random(14)
    rows = items(rng, 90)
    texts = [passage(rng, 30) + " " + " ".join(plain_words(rng.choice(rows)[2] or "x")[:20]) for _ in range(150)]
    fine = list(ItemIndex.of(rows).search_all(texts))
    monkeypatch.setattr("keyloom.llm.leakage.COARSE", 7)
    index = ItemIndex.of(rows)
    assert index.width > 1 and list(index.search_all(texts)) == fine and len(fine) > 50


def test_block_max_wand_equals_full_scoring():
    rng = random.Random(12)
    index = ItemIndex.of(items(rng, 150))
    for _ in range(300):
        terms = tuple(set(rng.sample(sorted(index.postings), rng.randrange(1, 20))))
        full = {}
        for t in terms:
            for d, x in zip(*index.postings[t][:2]):
                full[d] = full.get(d, 0) + x
        want = {d: s for d, s in full.items() if s >= 1 - 1e-9}
        got = index.retrieve(terms)
        assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in got)


@pytest.mark.parametrize("text,leak", [("one two three four", True), ("one twothree four", False), ("one two threefour", False), ("xone two three four", False), ("one two, three\nfour", True), ("one two th-\nree four", True), ("one two th ree four", False), ("one two th<i>ree four", False)])
def test_word_boundaries(text, leak):
    index = ItemIndex.of([("i", None, "One two three four", None)])
    assert bool(index.search(text)) is leak


def test_on_a_frame(spark):
    rng = random.Random(13)
    rows = items(rng)
    long = "filler word " * 30000 + rows[4][2] + " tail" * 1000
    docs = [(1, rows[0][2]), (1, rows[0][2]), (2, None), (3, ""), (None, rows[0][2]), (4, long), (5, "Answer this. " + rows[4][2] + " copper")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    frame = spark.createDataFrame(rows, "item_id string, prompt string, passage string, answer string")
    got = leaks(df, frame).collect()
    want = [(d, i) for d, t in docs for i in brute(t, rows)]
    assert sorted(((r.doc_id, r.item_id) for r in got), key=repr) == sorted(want, key=repr)
    assert any(r.prompt_overlap for r in got if r.doc_id == 5) and not any(r.prompt_overlap for r in got if r.doc_id == 1)
    scores = {(r.doc_id, r.item_id): r.score for r in got}
    small = leaks(df, frame.union(frame), index_bytes=300).collect()
    assert len(small) == len(got) and all(abs(scores[r.doc_id, r.item_id] - r.score) < 1e-9 for r in small)
    assert leaks(df.limit(0), frame).count() == 0 and leaks(df, frame.limit(0)).count() == 0
