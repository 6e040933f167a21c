import random

import pytest

from keyloom.llm.subjects import NUMBER, SubjectModel, fit, read_posts, sentence_terms, subjects_of, train
from pyspark.sql import functions as F

TOPICS = {"boats": "rudder keel mast harbour anchor sail deck tide".split(), "bread": "flour dough oven yeast crust loaf knead rye".split(), "chess": "rook bishop pawn castle gambit endgame board clock".split()}
FRAMES = ["I think the {} matters more than the {}.", "Has anybody tried {} with {}?", "My {} broke and then the {} too.", "We talked about {} and {} all day."]
CHAT = ["Thanks a lot.", "Welcome to the forum!", "Any news on this?", "See you next week."]


def post(rng):
    subjects = rng.sample(sorted(TOPICS), rng.choice([0, 1, 1, 1, 2]))
    lines = [rng.choice(FRAMES).format(*rng.sample(TOPICS[s], 2)) for s in subjects for _ in range(rng.randint(2, 4))]
    other = rng.choice(sorted(set(TOPICS) - set(subjects)))
    if rng.random() < 0.3:
        lines.append(rng.choice(FRAMES).format(*rng.sample(TOPICS[other], 2)))
    lines += rng.sample(CHAT, rng.randint(0, 2))
    rng.shuffle(lines)
    text = " ".join(lines)
    if rng.random() < 0.3:
        text = "[quote=x]" + " ".join(rng.choice(FRAMES).format(*rng.sample(TOPICS[other], 2)) for _ in range(3)) + "[/quote]\n" + text
    return text, rng.choice(["here", "there", None]), subjects or ["none"]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    data = [post(rng) for _ in range(900)]
    data = [(t, s, rng.sample(sorted(TOPICS), 1) if rng.random() < 0.05 else y) for t, s, y in data]  # some labels are wrong
    return fit(data, list(TOPICS))


def test_held_out_accuracy(model):
    rng = random.Random(2)
    tp = fp = fn = 0
    for _ in range(400):
        text, source, labels = post(rng)
        got, want = {s for s, _ in model.predict(text, source)}, set(labels) - {"none"}
        tp, fp, fn = tp + len(got & want), fp + len(got - want), fn + len(want - got)
    assert 2 * tp / (2 * tp + fp + fn) > 0.9


def test_quotes_signatures_and_single_sentences_do_not_count(model):
    s = "I think the rudder matters more than the keel. My mast broke and then the sail too. "
    assert [x for x, _ in model.predict(s, "here")] == ["boats"]
    assert model.predict(f"[quote=a]{s}[/quote]\nThanks a lot. See you next week.", "here") == []
    for text in (None, "", "   ", "<br/>", "!!!"):
        assert model.predict(text, None) == []
    assert all(0 < p < 1 for _, p in model.predict(s * 500, None))


def test_beam_search_is_exact_when_wide_enough(model):
    rng = random.Random(3)
    from itertools import product

    import numpy as np

    texts, sources, _ = zip(*(post(rng) for _ in range(30)))
    posts = read_posts(texts)
    ev, base = model.evidence(posts, *model.known(posts)), model.base_features(posts, sources)
    chosen, _ = model.decode(ev, base)
    for i in range(30):
        best = None
        for bits in product([0, 1], repeat=3):
            score = 0.0
            for link in range(3):
                a, b = model.platt[link]
                z = a * float(model.link_features(ev[[i]], base[[i]], link, np.array([bits[:link]]))[0] @ model.chain[link]) + b
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                score += np.log(p if bits[link] else 1 - p)
            if best is None or score > best[0]:
                best = (score, bits)
        assert np.flatnonzero(chosen[i]).tolist() == sorted(model.order[j] for j, bit in enumerate(best[1]) if bit)


def test_terms():
    grams, sentence = sentence_terms(["A  b 12\x00b"])
    assert len(grams) == 7 and sentence.tolist() == [0] * 6 + [1] and NUMBER in grams
    again, _ = sentence_terms(["a, B 7"])
    assert set(again.tolist()) == set(grams.tolist()) and len(set(grams.tolist())) == 6
    assert len(sentence_terms(["..."])[0]) == 0 and len(sentence_terms([])[0]) == 0


def test_posts_together_and_alone_agree(model):
    rng = random.Random(5)
    data = [post(rng)[:2] for _ in range(60)] + [(None, "here"), ("", None), ("I think the rudder matters more than the keel. " * 30000, "here")]
    together: dict = {}
    for i, s, p in model.predict_all(*zip(*data)):
        together.setdefault(i, []).append((model.subjects[s], round(p, 5)))
    for i, (text, source) in enumerate(data):
        assert [(s, round(p, 5)) for s, p in model.predict(text, source)] == together.get(i, [])


def test_signatures_are_told_by_their_place_whatever_they_say():
    rng = random.Random(6)
    signs = ["fond of {}", "I collect every {}", "keeper of one {}", "born near a {}"]
    unseen = ["all hail the {}", "ask me about the {}"]

    def signed(kind, wording):
        text, source, labels = post(rng)
        words = TOPICS[kind]
        return text + "\n-- \n" + "\n".join(rng.choice(wording).format(rng.choice(words)) for _ in range(2)), source, labels

    data = [signed(rng.choice(sorted(TOPICS)), signs) for _ in range(900)]
    model = fit(data, list(TOPICS))
    tp = fp = fn = 0
    for _ in range(300):
        text, source, labels = signed(rng.choice(sorted(TOPICS)), unseen)
        got, want = {s for s, _ in model.predict(text, source)}, set(labels) - {"none"}
        tp, fp, fn = tp + len(got & want), fp + len(got - want), fn + len(want - got)
    assert 2 * tp / (2 * tp + fp + fn) > 0.85


def test_a_saved_model_predicts_the_same(model, spark, tmp_path):
    path = f"file://{tmp_path}/models/subjects.npz"
    model.save(spark, path)
    model.save(spark, path)
    other = SubjectModel.load(spark, path)
    rng = random.Random(7)
    for _ in range(50):
        text, source, _ = post(rng)
        assert other.predict(text, source) == model.predict(text, source)
    empty = SubjectModel(["a"])
    assert SubjectModel.from_bytes(empty.to_bytes()).predict("A word.", None) == []


def test_on_frames(spark):
    rng = random.Random(4)
    data = [(i, *post(rng)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, s) for i, t, s, _ in data] + [(900, None, None), (None, "", "x"), (3, data[3][1], data[3][2])], "doc_id bigint, text string, source string").withColumn("subject", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, _, ys in data[:300] for y in ys] + [(None, "boats"), (1, None)], "doc_id bigint, subject string")
    areas = spark.createDataFrame([(s,) for s in TOPICS] + [(None,)], "subject string")
    found = subjects_of(docs, train(docs, labels, areas)).collect()
    assert {r.subject for r in found} == set(TOPICS) and 200 < len(found) < 800
    bare = train(docs, labels.limit(0), areas)
    assert isinstance(bare, SubjectModel) and subjects_of(docs, bare).count() == 0
    assert subjects_of(docs.limit(0), bare).count() == 0
