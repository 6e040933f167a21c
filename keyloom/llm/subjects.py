"""Subject areas of posts (problem 9).

Terms are hashed n-grams of the author's own sentences.  A sentence model gives
each sentence a distribution over the subjects and none; it is trained on
posts' labels by expectation-maximisation, since labels say of what a post has
at least two sentences but not which.  A chain of calibrated classifiers then
decides on each subject from the terms of the whole post, the sentence
evidence, the source and the structure of the post and the subjects decided
before it; beam search finds the best combination.  All of it works on arrays
that hold many posts at once.
"""

from __future__ import annotations

import io
import json
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from keyloom.llm.arrays import DIGIT, HashIndex, Words, blocks, joined2, plain, word_hash
from keyloom.llm.text import ROLES, UNSEEN, own_sentences
from keyloom.session import file_bytes, publish_bytes

#: Labelled posts that are read for training, chosen by a hash of their id.
MAX_TRAIN = 8000
#: Sentences of the training posts that a term must stand in.
MIN_SENTENCES = 4
#: Terms that a model has at most, the most frequent ones; it bounds what is broadcast.
MAX_TERMS = 1 << 19
BEAM = 8
FOLDS = 2
NUMBER = np.uint64(word_hash("#"))


# ---------------------------------------------------------------- terms


@dataclass
class Posts:
    """Own sentences of some posts: hashed terms by sentence, roles and structure."""

    #: Terms in order of sentences, and the sentence of each.
    terms: np.ndarray
    term_sentence: np.ndarray
    #: The post of each sentence, and its role.
    owner: np.ndarray
    roles: np.ndarray
    #: Per post: sentences, quotes, rules, code.
    structure: np.ndarray

    def part(self, wanted: np.ndarray) -> Posts:
        """The posts of a mask, renumbered."""
        number = np.cumsum(wanted) - 1
        keep = wanted[self.owner]
        sentence = np.cumsum(keep) - 1
        inside = keep[self.term_sentence]
        return Posts(self.terms[inside], sentence[self.term_sentence[inside]], number[self.owner[keep]], self.roles[keep], self.structure[wanted])


def _seen(sentences: list[str]) -> str:
    """Sentences joined by NUL, with case, accents and letter forms folded (ASCII case is left to the arrays)."""
    text = "\x00".join(sentences)
    if not text.isascii():
        text = UNSEEN.sub("", unicodedata.normalize("NFKD", UNSEEN.sub("", unicodedata.normalize("NFKD", text)).casefold()))
        text = "\x00".join(map(plain, text.split("\x00")))
    return text


def sentence_terms(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams up to three words of sentences joined by NUL, numbers as one sign, and the sentence of each."""
    words = Words(texts, digits_apart=True)
    n = len(words.at)
    one = words.word_hashes()
    one[words.kind[words.at] == DIGIT] = NUMBER
    grams = np.zeros((n, 3), np.uint64)
    given = np.zeros((n, 3), bool)
    grams[:, 0], given[:, 0] = one, True
    if n > 1:
        grams[:-1, 1], given[:-1, 1] = joined2(one[:-1], one[1:]), words.text[:-1] == words.text[1:]
    if n > 2:
        grams[:-2, 2], given[:-2, 2] = joined2(grams[:-2, 1], one[2:]), words.text[:-2] == words.text[2:]
    return grams[given], np.repeat(words.text, 3)[given.ravel()]


def read_posts(texts: Sequence[str | None]) -> Posts:
    """The own sentences of posts as arrays; null, empty and very long texts are posts like any other."""
    joined, owner, roles, structure = [], [], [], []
    for i, text in enumerate(texts):
        sentences, st = own_sentences(text)
        structure.append((st["sentences"], st["quotes"], st["rules"], st["code"]))
        if sentences:
            joined.append(_seen(sentences))
            owner += [i] * len(sentences)
            roles += st["roles"]
    terms, where, before = [], [], 0
    for lo, hi in blocks(joined):
        t, s = sentence_terms(joined[lo:hi])
        terms.append(t)
        where.append(s + before)
        before += sum(x.count("\x00") + 1 for x in joined[lo:hi])
    none = np.zeros(0, np.int64)
    return Posts(np.concatenate([np.zeros(0, np.uint64), *terms]), np.concatenate([none, *where]), np.array(owner, np.int64), np.array(roles, np.int64), np.array(structure, float).reshape(len(structure), 4))


# ---------------------------------------------------------------- linear models


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last column of ``x`` is the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = _sigmoid(x @ w)
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        d = np.linalg.solve(h, g)
        w = w - d
        if np.abs(d).max() < 1e-6:
            break
    return w


def _scores(weights: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the weights of each row's ids over the root of their number, plus the constant (the last weight); ``rows`` are in order."""
    z = np.zeros((n, weights.shape[1]), np.float32)
    if len(ids):
        heads = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
        sums = np.add.reduceat(weights.take(ids, axis=0), heads, axis=0)
        z[rows[heads]] = sums / np.sqrt(np.diff(np.append(heads, len(ids))) + 1)[:, None]
    return z + weights[-1]


class _Sparse:
    """A linear model over sparse rows, fitted in batches that are laid out once."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, n: int, width: int, seed: int, batch: int = 256) -> None:
        self.n, self.width, self.ids, self.rows = n, width, ids, rows
        self.rng = np.random.default_rng(seed)
        counts = np.bincount(rows, minlength=n)
        offs = np.concatenate([[0], np.cumsum(counts)])
        self.batches = []
        perm = self.rng.permutation(n)
        for lo in range(0, n, batch):
            members = np.sort(perm[lo : lo + batch])
            sizes = counts[members]
            opens = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            at = np.repeat(offs[members] - opens, sizes) + np.arange(int(sizes.sum()))
            here = ids[at]
            row = np.repeat(np.arange(len(members)), sizes)
            order = np.argsort(here, kind="stable")
            known, heads = np.unique(here[order], return_index=True)
            scale = (1 / np.sqrt(sizes + 1)).astype(np.float32)
            some = sizes > 0
            self.batches.append((members, here, opens[some], some, scale[:, None], row[order], known, heads))

    def fit(self, weights: np.ndarray, squares: np.ndarray, target: np.ndarray, link, epochs: int, rate: float = 0.5, l2: float = 2e-3) -> None:
        """Adaptive gradient steps on ``weights`` and ``squares``, the sums of squared gradients, in place."""
        target = target.astype(np.float32)
        for _ in range(epochs):
            for b in self.rng.permutation(len(self.batches)):
                members, here, opens, some, scale, by_term, known, heads = self.batches[b]
                z = np.zeros((len(members), weights.shape[1]), np.float32)
                if len(here):
                    z[some] = np.add.reduceat(weights.take(here, axis=0), opens, axis=0)
                err = link(z * scale + weights[-1]) - target.take(members, axis=0)
                if len(here):
                    w = weights.take(known, axis=0)
                    g = np.add.reduceat((err * scale).take(by_term, axis=0), heads, axis=0) + l2 * w
                    s = squares.take(known, axis=0) + g * g
                    squares[known] = s
                    weights[known] = w - rate * g / np.sqrt(s)
                g = err.sum(axis=0)
                squares[-1] += g * g
                weights[-1] -= rate * g / np.sqrt(squares[-1])


# ---------------------------------------------------------------- the model


@dataclass
class SubjectModel:
    subjects: list[str]
    vocabulary: HashIndex = field(default_factory=lambda: HashIndex(np.zeros(0, np.uint64)))
    #: Of sentences: by term, then by role, then the constant; columns are the subjects and none.
    weights: np.ndarray | None = None
    #: Of whole posts: by term, then the constant; columns are the subjects.
    post_weights: np.ndarray | None = None
    sources: dict[str, int] = field(default_factory=dict)
    order: list[int] = field(default_factory=list)
    chain: list[np.ndarray] = field(default_factory=list)
    platt: list[tuple[float, float]] = field(default_factory=list)

    # ------------------------------------------------------------ sentences

    def known(self, posts: Posts) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known terms, and their sentences."""
        ids = self.vocabulary.find(posts.terms).astype(np.int64)
        return ids[ids >= 0], posts.term_sentence[ids >= 0]

    def _with_roles(self, ids: np.ndarray, sentence: np.ndarray, posts: Posts) -> tuple[np.ndarray, np.ndarray]:
        """The terms of each sentence and, as one more of them, its role."""
        n = len(self.vocabulary.keys)
        at = np.searchsorted(sentence, np.arange(len(posts.owner)), side="right")
        return np.insert(ids, at, n + posts.roles), np.insert(sentence, at, np.arange(len(posts.owner)))

    def evidence(self, posts: Posts, ids: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        """Per post and subject: greatest and second sentence probability in the post's context, expected sentences, how many are likely, and the score of the post's terms."""
        k, n = len(self.subjects), len(posts.structure)
        out = np.zeros((n, k, 5))
        out[:, :, 4] = np.clip(_scores(self.post_weights, ids, posts.owner[sentence], n), -8, 8)
        if not len(posts.owner):
            return out
        p = _softmax(_scores(self.weights, *self._with_roles(ids, sentence, posts), len(posts.owner)).astype(float))
        heads = np.concatenate([[0], np.flatnonzero(np.diff(posts.owner)) + 1])
        some = posts.owner[heads]
        seg = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(p))))
        q = p
        for _ in range(3):
            share = np.add.reduceat(q[:, :k], heads, axis=0) + 0.3
            prior = np.concatenate([share / share.max(axis=1, keepdims=True), np.full((len(heads), 1), 0.6)], axis=1)
            q = p * prior[seg]
            q = q / q.sum(axis=1, keepdims=True)
        s = q[:, :k]
        first = np.maximum.reduceat(s, heads, axis=0)
        equal = s == first[seg]
        rest = np.maximum.reduceat(np.where(equal, 0.0, s), heads, axis=0)
        second = np.where(np.add.reduceat(equal, heads, axis=0, dtype=np.int64) > 1, first, rest)
        out[some, :, 0], out[some, :, 1] = first, second
        out[some, :, 2] = np.minimum(np.add.reduceat(s, heads, axis=0), 6.0)
        out[some, :, 3] = np.minimum(np.add.reduceat(s > 0.5, heads, axis=0, dtype=np.int64), 4)
        return out

    def fit_terms(self, posts: Posts, y: np.ndarray, rounds: int = 3, seed: int = 7) -> None:
        """The sentence model by expectation-maximisation, and the model of whole posts."""
        k = y.shape[1]
        pairs = np.unique(posts.terms, return_counts=True)
        chosen = np.flatnonzero(pairs[1] >= MIN_SENTENCES)
        if len(chosen) > MAX_TERMS:
            chosen = np.sort(chosen[np.argsort(-pairs[1][chosen], kind="stable")[:MAX_TERMS]])
        self.vocabulary = HashIndex(pairs[0][chosen])
        v = len(self.vocabulary.keys)
        ids, sentence = self.known(posts)
        prior = np.full((len(y), k + 1), 0.02)
        prior[:, k] = np.where(y.any(axis=1), 0.5, 3.0)
        prior[:, :k][y > 0] = 1.0
        prior /= prior.sum(axis=1, keepdims=True)
        own = prior[posts.owner]
        given = self._with_roles(ids, sentence, posts)
        rows = _Sparse(*given, len(own), v + ROLES, seed)
        target = own
        self.weights = np.zeros((v + ROLES + 1, k + 1), np.float32)
        for r in range(rounds):
            squares = np.full_like(self.weights, 1e-2)
            rows.fit(self.weights, squares, target, _softmax, 3 if r == 0 else 2)
            target = _softmax(_scores(self.weights, *given, len(own)).astype(float)) * own
            target /= target.sum(axis=1, keepdims=True)
        self.post_weights = np.zeros((v + 1, k), np.float32)
        _Sparse(ids, posts.owner[sentence], len(y), v, seed, 128).fit(self.post_weights, np.full_like(self.post_weights, 1e-2), y, _sigmoid, 4)

    # ---------------------------------------------------------------- posts

    def base_features(self, posts: Posts, sources: Sequence[str | None]) -> np.ndarray:
        """Structure and source of each post."""
        n, quotes, rules, code = posts.structure.T
        hot = np.zeros((len(sources), len(self.sources) + 1))
        hot[np.arange(len(sources)), [self.sources.get(s, len(self.sources)) for s in sources]] = 0.3
        shape = np.stack([np.minimum(n, 12) / 4, n < 2, np.minimum(quotes, 3), np.minimum(rules, 1), np.minimum(code, 1)], axis=1)
        return np.concatenate([shape, hot], axis=1)

    def static_features(self, ev: np.ndarray, base: np.ndarray, s: int) -> np.ndarray:
        """What the link of subject ``s`` sees of each post whatever was decided before."""
        others = np.delete(ev[:, :, 1], s, axis=1)
        own = ev[:, s]
        most = others.max(axis=1) if others.shape[1] else np.zeros(len(ev))
        return np.concatenate([own, (own[:, 0] * own[:, 1])[:, None], (own[:, 3] >= 2)[:, None], most[:, None], others.sum(axis=1)[:, None], base], axis=1)

    def link_features(self, ev: np.ndarray, base: np.ndarray, link: int, decided: np.ndarray) -> np.ndarray:
        """All features of a link: the static ones, the subjects decided before, their number, the constant."""
        decided = np.asarray(decided, float)
        return np.concatenate([self.static_features(ev, base, self.order[link]), decided, decided.sum(axis=1, keepdims=True), np.ones((len(ev), 1))], axis=1)

    def fit_chain(self, ev: np.ndarray, base: np.ndarray, y: np.ndarray) -> None:
        """Logistic links on two thirds of the posts, calibrated on the rest (Platt), then refitted on all."""
        self.order = [int(s) for s in np.argsort(-y.sum(axis=0), kind="stable")]
        held = np.arange(len(y)) % 3 == 2
        self.chain, self.platt = [], []
        for link, s in enumerate(self.order):
            x, t = self.link_features(ev, base, link, y[:, self.order[:link]]), y[:, s]
            z = x[held] @ _logistic(x[~held], t[~held])
            a = _logistic(np.stack([z, np.ones_like(z)], axis=1), t[held], l2=1e-2) if held.any() and t[held].any() else np.array([1.0, 0.0])
            self.platt.append((float(a[0]), float(a[1])))
            self.chain.append(_logistic(x, t))

    def decode(self, ev: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most probable combination of subjects of each post, by beam search along the chain, and each link's probability."""
        n, k = len(ev), len(self.order)
        score, bits, ps = np.zeros((n, 1)), np.zeros((n, 1, k)), np.zeros((n, 1, k))
        for link, s in enumerate(self.order):
            w = self.chain[link]
            x = self.static_features(ev, base, s)
            m = x.shape[1]
            earlier = np.append(w[m : m + link] + w[-2], np.zeros(k - link))
            a, b = self.platt[link]
            p = np.clip(_sigmoid(a * ((x @ w[:m] + w[-1])[:, None] + bits @ earlier) + b), 1e-9, 1 - 1e-9)
            both = np.concatenate([score + np.log(p), score + np.log(1 - p)], axis=1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :BEAM]
            score = np.take_along_axis(both, best, axis=1)
            beam = best % p.shape[1]
            bits = np.take_along_axis(bits, beam[:, :, None], axis=1)
            ps = np.take_along_axis(ps, beam[:, :, None], axis=1)
            bits[:, :, link] = best < p.shape[1]
            ps[:, :, link] = np.take_along_axis(p, beam, axis=1)
        back = np.argsort(self.order)
        return bits[:, 0, back] > 0, ps[:, 0, back]

    def predict_all(self, texts: Sequence[str | None], sources: Sequence[str | None]) -> Iterator[tuple[int, int, float]]:
        """(number of the post, number of the subject, probability) of each subject of each post."""
        if self.weights is None:
            return
        posts = read_posts(texts)
        ids, sentence = self.known(posts)
        chosen, p = self.decode(self.evidence(posts, ids, sentence), self.base_features(posts, sources))
        chosen &= posts.structure[:, :1] > 0
        for i, s in zip(*(x.tolist() for x in np.nonzero(chosen))):
            yield i, s, float(p[i, s])

    def predict(self, text: str | None, source: str | None) -> list[tuple[str, float]]:
        return [(self.subjects[s], p) for _, s, p in self.predict_all([text], [source])]

    # ---------------------------------------------------------------- storage

    def to_bytes(self) -> bytes:
        """The model as one file of arrays."""
        head = {"subjects": self.subjects, "sources": self.sources, "order": self.order, "platt": self.platt, "fitted": self.weights is not None}
        arrays = {} if self.weights is None else {"keys": self.vocabulary.keys, "weights": self.weights, "post_weights": self.post_weights} | {f"chain{i}": w for i, w in enumerate(self.chain)}
        out = io.BytesIO()
        np.savez(out, head=np.frombuffer(json.dumps(head).encode(), np.uint8), **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> SubjectModel:
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            head = json.loads(z["head"].tobytes())
            out = cls(head["subjects"], sources=head["sources"], order=head["order"], platt=[(a, b) for a, b in head["platt"]])
            if head["fitted"]:
                out.vocabulary, out.weights, out.post_weights = HashIndex(z["keys"]), z["weights"], z["post_weights"]
                out.chain = [z[f"chain{i}"] for i in range(len(out.order))]
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model to a file that all machines reach; it appears whole or not at all."""
        publish_bytes(spark, path, self.to_bytes())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SubjectModel:
        return cls.from_bytes(file_bytes(spark, path))


def fit(posts: Sequence[tuple[str | None, str | None, Sequence[str]]], subjects: Sequence[str]) -> SubjectModel:
    """Fit on (text, source, labels) posts; the label 'none' and unknown labels mean no subject."""
    model = SubjectModel(sorted(subjects))
    index = {s: i for i, s in enumerate(model.subjects)}
    parsed = read_posts([t for t, _, _ in posts])
    sources = [s for _, s, _ in posts]
    model.sources = {s: i for i, s in enumerate(sorted({s for s in sources if s is not None}))}
    y = np.zeros((len(posts), len(index)))
    for i, (_, _, labels) in enumerate(posts):
        y[i, [index[x] for x in labels if x in index]] = 1
    # Evidence for the chain must come from models that did not see the post.
    fold = np.arange(len(posts)) % FOLDS
    ev = np.zeros((len(posts), len(index), 5))
    for f in range(FOLDS):
        if not (fold == f).any():
            continue
        part = SubjectModel(model.subjects)
        part.fit_terms(parsed.part(fold != f), y[fold != f])
        held = parsed.part(fold == f)
        ev[fold == f] = part.evidence(held, *part.known(held))
    model.fit_terms(parsed, y)
    model.fit_chain(ev, model.base_features(parsed, sources), y)
    return model


def training_posts(documents: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> list[tuple[str | None, str | None, list[str]]]:
    """Up to ``most`` labelled posts, chosen by a hash of their id; the sample is bounded by that parameter alone."""
    by_doc = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    chosen = by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = documents.select("doc_id", "text", "source").join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct("text", "source")).alias("post"), F.first("subjects").alias("subjects"))
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return [(r["post"]["text"], r["post"]["source"], sorted(r["subjects"])) for r in rows]


def subjects_of(documents: DataFrame, model: SubjectModel) -> DataFrame:
    """Each document with each of its subjects and the probability the chain gave it: doc_id, subject, probability.

    ``documents``: doc_id, text, source.  Whole texts are read.  Posts without
    own words, null or empty ones included, have no subject.  Repeated rows give
    repeated results.  The model is broadcast; its size depends on the training
    sample (``most`` posts), not on the corpus.  Nothing is shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = list(m.predict_all(batch.column("text").to_pylist(), batch.column("source").to_pylist()))
            docs = batch.column("doc_id").take(pa.array([x[0] for x in found], pa.int64()))
            names = [m.subjects[x[1]] for x in found]
            yield pa.RecordBatch.from_arrays([docs, pa.array(names, pa.string()), pa.array([x[2] for x in found], pa.float64())], names=["doc_id", "subject", "probability"])

    return documents.select("doc_id", "text", "source").mapInArrow(work, "doc_id bigint, subject string, probability double")


def train(documents: DataFrame, labels: DataFrame, areas: DataFrame, most: int = MAX_TRAIN) -> SubjectModel:
    """Fit a model on the labelled posts; without labels it finds no subjects."""
    subjects = [r[0] for r in areas.select("subject").distinct().collect() if r[0] is not None]
    posts = training_posts(documents, labels, most)
    return fit(posts, subjects) if posts and subjects else SubjectModel(sorted(subjects))
