import random

import numpy as np
import pytest

from keyloom.llm import arrays
from keyloom.llm.arrays import HashIndex, Words, blocks, plain, word_hash


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_hashes_do_not_depend_on_where_a_word_stands(monkeypatch, block):
    monkeypatch.setattr(arrays, "BLOCK_BYTES", block)
    monkeypatch.setattr(arrays, "_tables", [])
    rng = random.Random(1)
    words = ["".join(rng.choices("abcXYZ019é中", k=rng.randint(1, 9))) for _ in range(500)]
    texts = [plain(" ".join(words[i : i + 50])) for i in range(0, 500, 50)] + ["", "..."]
    w = Words(texts, digits_apart=False)
    assert w.word_hashes().tolist() == [word_hash(x) for x in words] and w.text.tolist() == [i // 50 for i in range(500)]
    n = np.arange(499)
    assert w.hashes(n, n + 1).tolist() == [word_hash(a + b) for a, b in zip(words, words[1:])]


def test_kinds_of_characters():
    w = Words([plain("It's 3rd\u00a0caf\u00e9\u2014au\x00lait_x")], digits_apart=True)
    assert [bytes(w.bytes[a:b]).decode() for a, b in zip(w.at, w.stop)] == ["it", "s", "3", "rd", "café", "au", "lait", "x"]
    assert len(Words([], digits_apart=False).at) == len(Words(["", " "], digits_apart=False).at) == 0


def test_index_finds_what_it_holds_and_nothing_else():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    index = HashIndex(keys)
    order = rng.permutation(len(keys))
    assert (index.find(keys[order]) == order).all()
    assert (index.find(np.setdiff1d(rng.integers(0, 1 << 63, 5000, dtype=np.uint64), keys)) == -1).all()
    assert len(index.find(keys[:0])) == 0 and HashIndex(keys[:0]).find(keys[:2]).tolist() == [-1, -1]


def test_blocks_cover_all_texts_in_order():
    texts = ["x" * n for n in (0, 5, 1 << 21, 3, 1 << 19, 1 << 19, 1 << 19)]
    spans = list(blocks(texts))
    assert spans[0][0] == 0 and spans[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert list(blocks([])) == []
