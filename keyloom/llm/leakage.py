"""Test passages that stand in training texts (problem 8).

Test items are indexed as documents of a BM25 index; the texts are the queries.
A passage of text that holds the wanted run of an item's words scores at least
the least that any such run of that item can score, so this is each item's
threshold, and weights are divided by it.  Retrieval by block-max WAND thus
finds every item that may leak; an exact check of the words follows.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keyloom.llm.arrays import HashIndex, Words, blocks, plain, word_hash
from keyloom.llm.text import HARD, folded, plain_words, words_and_gaps
from keyloom.session import cut

#: Consecutive words that make a leak; a shorter passage must be there as a whole.
RUN = 13
K1, B = 1.2, 0.75
#: Postings per block of the index.
POSTINGS = 8
#: Ranges of items for the first, coarse bound: at most so many, and so many bytes of bounds.
COARSE, COARSE_BYTES = 512, 16 << 20
#: Bytes of item text per index, which bounds what is broadcast; more text is searched in several passes.
#: Weights come from all items, so neither results nor scores depend on it.
INDEX_BYTES = 4 << 20
#: Slack for rounding in score sums.
EPS = 1e-9

Item = tuple[str, list[str], list[str], list[str]]


def item_words(item: str, prompt: str | None, passage: str | None, answer: str | None) -> Item:
    """An item with the words of its prompt, passage and answer."""
    return item, plain_words(prompt or ""), plain_words(passage or ""), plain_words(answer or "")


def inverse_frequency(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


class ItemIndex:
    """BM25 postings of test items, in blocks with their greatest weight."""

    def __init__(self, items: Sequence[Item], idf: dict[str, float], mean: float, run: int = RUN) -> None:
        """``idf`` of each word and the ``mean`` length of passages are those of all items, of which ``items`` may be a part.

        Items without a word in their passage leak nowhere.
        """
        self.run = run
        self.items = [x for x in items if x[2]]
        n = len(self.items)
        raw: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.longest_run = 0
        #: Of each item the words run together in stretches of half a run, one of which stands whole in any run.
        self.halves: list[list[str]] = []
        for d, (_, _, passage, _) in enumerate(self.items):
            weights = {w: idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(passage) / mean)) for w, tf in Counter(passage).items()}
            spans = self._spans(passage)
            least = min(sum(weights[w] for w in set(s)) for s in spans)
            for w, x in weights.items():
                raw[w].append((d, x / least))
            half = (len(spans[0]) + 1) // 2
            self.halves.append(["".join(passage[k : k + half]) for k in range(0, len(passage) - half + 1, half)])
            self.longest_run = max([self.longest_run, *(len("".join(s).encode()) for s in spans)])
        self.postings: dict[str, tuple[list[int], list[float], list[float], float]] = {}
        for w, rows in raw.items():
            ids, xs = [r[0] for r in rows], [r[1] for r in rows]
            tops = [max(xs[k : k + POSTINGS]) for k in range(0, len(xs), POSTINGS)]
            self.postings[w] = (ids, xs, tops, max(xs))
        # Greatest weight of each term in each range of items: bounds for all items in one sum.
        self.width = width = max(1, -(-n // max(1, min(COARSE, COARSE_BYTES // (8 * max(1, len(self.postings)))))))
        self.rows = {w: i for i, w in enumerate(self.postings)}
        self.coarse = np.zeros((len(self.rows), max(1, -(-n // width))))
        for w, (ids, xs, _, _) in self.postings.items():
            np.maximum.at(self.coarse[self.rows[w]], np.array(ids) // width, xs)
        self.most = np.array([p[3] for p in self.postings.values()])
        self.longest_word = max((len(w.encode()) for w in self.postings), default=0)
        self.known = HashIndex(np.array([word_hash(w) for w in self.postings], np.uint64))

    @classmethod
    def of(cls, rows: Sequence[tuple[str, str | None, str | None, str | None]], run: int = RUN) -> ItemIndex:
        """The index of (item_id, prompt, passage, answer) rows that are all there is."""
        items = [x for x in (item_words(*r) for r in rows) if x[2]]
        df = Counter(w for x in items for w in set(x[2]))
        mean = sum(len(x[2]) for x in items) / len(items) if items else 1.0
        return cls(items, {w: inverse_frequency(len(items), n) for w, n in df.items()}, mean, run)

    def _spans(self, passage: list[str]) -> list[list[str]]:
        size = min(self.run, len(passage))
        return [passage[k : k + size] for k in range(len(passage) - size + 1)]

    @staticmethod
    def _span(words: list[str]) -> tuple[str, tuple[int, ...]]:
        """The words run together, and where in that a word begins (but the first)."""
        at, starts = 0, []
        for w in words[:-1]:
            at += len(w)
            starts.append(at)
        return "".join(words), tuple(starts)

    # ------------------------------------------------------------ many texts

    def search_all(self, texts: Sequence[str | None]) -> Iterator[tuple[int, int, float, int, bool, bool]]:
        """(number of the text, then as :meth:`search`) for each leak in the texts.

        The texts' words are looked up and the first two bounds of the retrieval
        taken for all passages at once; only passages that may reach a threshold
        are then searched one by one.
        """
        if not self.items:
            return
        seen = [folded(t) if t else "" for t in texts]
        terms = list(self.postings)
        for lo, hi in blocks(seen):
            best: dict[int, dict[int, float]] = {}
            for text, ids, ranges in self._may_leak([plain(t) for t in seen[lo:hi]]):
                found: dict[int, float] = {}
                if self.width == 1:  # a block of one item is bounded by its score
                    found.update(zip(ranges, map(math.fsum, self.coarse[np.ix_(ids, ranges)].T.tolist())))
                lists = [self.postings[terms[i]] for i in ids] if self.width > 1 else []
                for r in ranges if lists else []:
                    self._wand(lists, r * self.width, (r + 1) * self.width, found)
                kept = best.setdefault(text, {})
                for d, score in found.items():
                    kept[d] = max(score, kept.get(d, 0.0))
            for text, found in best.items():
                if found:
                    for row in self._checked(*words_and_gaps(seen[lo + text], as_folded=True), found):
                        yield lo + text, *row

    def _may_leak(self, texts: list[str]) -> Iterator[tuple[int, list[int], list[int]]]:
        """(text, terms, ranges of items) of each passage of the texts (folded, :func:`plain`) whose bounds reach a threshold."""
        words = Words(texts, digits_apart=False)
        n = len(words.at)
        if not n:
            return
        term, first, last = [self.known.find(words.word_hashes())], [np.arange(n)], [np.arange(n)]
        # Also words across gaps that may stand within a word.
        blank = np.concatenate([[0], np.cumsum(words.kind == 3)])
        soft = np.zeros(n, bool)
        soft[1:] = (blank[words.at[1:]] == blank[words.stop[:-1]]) & (words.text[1:] == words.text[:-1])
        begin = end = np.arange(n)
        while len(begin):
            end = end + 1
            keep = end < n
            begin, end = begin[keep], end[keep]
            keep = soft[end] & (words.end[end] - words.start[begin] <= self.longest_word)
            begin, end = begin[keep], end[keep]
            term.append(self.known.find(words.hashes(begin, end)))
            first.append(begin)
            last.append(end)
        t, f, e = np.concatenate(term), np.concatenate(first), np.concatenate(last)
        hit = t >= 0
        t, f, e = t[hit], f[hit], e[hit]
        # Passages of twice the longest run, one beginning at each multiple of it: a run lies wholly within one.
        size = self.longest_run
        opened = np.concatenate([[0], np.flatnonzero(np.diff(words.text)) + 1])
        origin, passages = np.zeros(words.texts, np.int64), np.zeros(words.texts, np.int64)
        origin[words.text[opened]] = words.start[opened]
        passages[words.text[opened]] = np.diff(np.append(words.start[opened], words.end[-1])) // size + 1
        base = np.concatenate([[0], np.cumsum(passages)])
        own = (words.start[f] - origin[words.text[f]]) // size
        number = base[words.text[f]] + own
        earlier = (own > 0) & (words.end[e] - origin[words.text[f]] <= (own + 1) * size)
        passage, what = np.concatenate([number, number[earlier] - 1]), np.concatenate([t, t[earlier]])
        bound = np.bincount(passage, self.most[what], minlength=int(base[-1]))
        keep = bound[passage] >= 1 - EPS
        pair = np.unique(passage[keep] * len(self.most) + what[keep])  # a term counts once in a passage
        passage, what = pair // len(self.most), pair % len(self.most)
        if not len(pair):
            return
        heads = np.concatenate([[0], np.flatnonzero(np.diff(passage)) + 1])
        stops = np.append(heads[1:], len(pair))
        enough = np.add.reduceat(self.most[what], heads) >= 1 - EPS
        heads, stops = heads[enough], stops[enough]
        text = np.searchsorted(base, passage[heads], side="right") - 1
        for k in range(0, len(heads), 512):
            h, s = heads[k : k + 512], stops[k : k + 512]
            opens = np.concatenate([[0], np.cumsum(s - h)[:-1]])
            rows = np.repeat(h - opens, s - h) + np.arange(int((s - h).sum()))
            able = np.add.reduceat(self.coarse[what[rows]], opens, axis=0) >= 1 - EPS
            for i in np.flatnonzero(able.any(axis=1)).tolist():
                yield int(text[k + i]), what[h[i] : s[i]].tolist(), np.flatnonzero(able[i]).tolist()

    # -------------------------------------------------------------- one text

    def retrieve(self, terms: Sequence[str]) -> dict[int, float]:
        """Items whose weights over ``terms`` (distinct) reach their threshold: block-max WAND."""
        lists = [self.postings[t] for t in terms]
        if sum(p[3] for p in lists) < 1 - EPS:
            return {}
        found: dict[int, float] = {}
        bounds = self.coarse[[self.rows[t] for t in terms]].sum(axis=0)
        for r in np.flatnonzero(bounds >= 1 - EPS).tolist():
            self._wand(lists, r * self.width, (r + 1) * self.width, found)
        return found

    @staticmethod
    def _wand(lists: list, lo: int, hi: int, found: dict[int, float]) -> None:
        """Block-max WAND over the items from ``lo`` to before ``hi``."""
        cursors = []
        for p in lists:
            at = bisect_left(p[0], lo)
            if at < len(p[0]) and p[0][at] < hi:
                cursors.append([p[0][at], at, p])
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2][3]
                if bound >= 1 - EPS:
                    pivot = k
                    break
            if pivot < 0:
                break
            d = cursors[pivot][0]
            last = pivot
            while last + 1 < len(cursors) and cursors[last + 1][0] == d:
                last += 1
            tight, nearest = 0.0, None
            for c in cursors[: last + 1]:
                ids, _, blocks, _ = c[2]
                at = bisect_left(ids, d, c[1])
                if at < len(ids):
                    b = at // POSTINGS
                    tight += blocks[b]
                    end = ids[min(len(ids), (b + 1) * POSTINGS) - 1] + 1
                    nearest = end if nearest is None or end < nearest else nearest
            if tight >= 1 - EPS:
                parts = []
                for c in cursors[: last + 1]:
                    ids, xs, _, _ = c[2]
                    at = bisect_left(ids, d, c[1])
                    if at < len(ids) and ids[at] == d:
                        parts.append(xs[at])
                score = math.fsum(parts)  # the same in any order of the terms
                if score >= 1 - EPS:
                    found[d] = score
                to = d + 1
            else:
                to = max(d + 1, nearest if nearest is not None else d + 1)
                if last + 1 < len(cursors):
                    to = max(d + 1, min(to, cursors[last + 1][0]))
            moved = []
            for c in cursors[: last + 1]:
                ids = c[2][0]
                at = bisect_left(ids, to, c[1])
                if at < len(ids) and ids[at] < hi:
                    moved.append([ids[at], at, c[2]])
            cursors = moved + cursors[last + 1 :]

    def search(self, text: str | None) -> list[tuple[int, float, int, bool, bool]]:
        """(item, best score, words in the longest matched span, prompt there, answer there) for each item that leaks."""
        return self._search(*words_and_gaps(text)) if text and self.items else []

    def _search(self, words: list[str], gaps: list[int]) -> list[tuple[int, float, int, bool, bool]]:
        hits = self._hits(words, gaps)
        if not hits:
            return []
        best: dict[int, float] = {}
        width = 2 * self.longest_run
        total = sum(map(len, words))
        for lo in range(0, max(1, total - self.longest_run), self.longest_run):
            terms = {t for s, e, t in self._between(hits, lo) if e <= lo + width}
            for d, score in self.retrieve(tuple(terms)).items():
                best[d] = max(score, best.get(d, 0.0))
        return self._checked(words, gaps, best) if best else []

    def _checked(self, words: list[str], gaps: list[int], best: dict[int, float]) -> list[tuple[int, float, int, bool, bool]]:
        """The retrieved items (and their scores) of which a run stands in the text word by word."""
        squeezed = "".join(words)
        best = {d: score for d, score in best.items() if any(h in squeezed for h in self.halves[d])}
        if not best:
            return []
        starts: dict[int, int] = {}
        at = 0
        for w, g in zip(words, gaps):
            starts[at] = g
            at += len(w)
        starts[at] = HARD
        out = []
        known = set(words)
        for d, score in sorted(best.items()):
            size = self._verify([self._span(s) for s in self._spans(self.items[d][2])], squeezed, starts)
            if size:
                _, prompt, _, answer = self.items[d]
                out.append((d, score, size, bool(prompt) and self._verify([self._span(prompt)], squeezed, starts) > 0, bool(answer) and known.issuperset(answer)))
        return out

    def _hits(self, words: list[str], gaps: list[int]) -> list[tuple[int, int, str]]:
        """(start, end, term) of all index terms in the text, also across gaps that may stand within a word."""
        hits, at, n, known, longest = [], 0, len(words), self.postings, self.longest_word
        for i in range(n):
            w = words[i]
            if w in known:
                hits.append((at, at + len(w), w))
            k = i + 1
            while k < n and gaps[k] != HARD and len(w) + len(words[k]) <= longest:
                w += words[k]
                if w in known:
                    hits.append((at, at + len(w), w))
                k += 1
            at += len(words[i])
        return hits

    def _between(self, hits: list[tuple[int, int, str]], lo: int) -> list[tuple[int, int, str]]:
        first = bisect_left(hits, (lo, -1, ""))
        last = bisect_left(hits, (lo + 2 * self.longest_run, -1, ""))
        return hits[first:last]

    @staticmethod
    def _verify(spans: list[tuple[str, tuple[int, ...]]], squeezed: str, starts: dict[int, int]) -> int:
        """Words of the first span that stands in the text word by word; 0 if none does."""
        for text, inner in spans:
            at = squeezed.find(text)
            while at >= 0:
                end = at + len(text)
                if at in starts and end in starts and all(at + k in starts for k in inner):
                    wanted = {at + k for k in inner}
                    if all(starts.get(p) != HARD or p in wanted for p in range(at + 1, end)):
                        return len(inner) + 1
                at = squeezed.find(text, at + 1)
        return 0


OUT = "doc_id bigint, item_id string, score double, matched_words int, prompt_overlap boolean, answer_overlap boolean"
ITEM = "item_id string, prompt array<string>, passage array<string>, answer array<string>, bytes bigint"


def _worded(items: DataFrame) -> DataFrame:
    """Distinct items as words, without those whose passage has none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.list_(pa.string())
        for batch in batches:
            found = [item_words(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("item_id", "prompt", "passage", "answer")))]
            found = [x for x in found if x[2]]
            cols = list(zip(*found)) if found else [[]] * 4
            size = [sum(map(len, x[1])) + sum(map(len, x[2])) + sum(map(len, x[3])) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip([*cols, size], [pa.string(), texts, texts, texts, pa.int64()])], names=["item_id", "prompt", "passage", "answer", "bytes"])

    return items.select("item_id", "prompt", "passage", "answer").distinct().mapInArrow(work, ITEM)


def indexes(items: DataFrame, run: int = RUN, index_bytes: int = INDEX_BYTES) -> Iterator[ItemIndex]:
    """Indexes of all items, one after the other, each of about ``index_bytes`` of text (or one longer item).

    Document frequencies and lengths are counted over all items by Spark; each
    item comes with the frequencies of its own words, and only the index at
    hand is in the driver's memory.
    """
    worded = _worded(items)
    n, words = worded.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("passage")), F.lit(0))).first()
    if not n:
        return
    each = worded.select("*", F.explode(F.array_distinct("passage")).alias("word"))
    df = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    key = ["item_id", "prompt", "passage", "answer", "bytes"]
    rows = each.join(df, "word").groupBy(*key).agg(F.collect_list(F.struct("word", "df")).alias("dfs")).orderBy("item_id", "prompt", "passage", "answer")
    held: list[Item] = []
    idf: dict[str, float] = {}
    size = 0
    for r in rows.toLocalIterator():
        if held and size + r["bytes"] > index_bytes:
            yield ItemIndex(held, idf, words / n, run)
            held, idf, size = [], {}, 0
        held.append((r["item_id"], r["prompt"], r["passage"], r["answer"]))
        idf.update((x["word"], inverse_frequency(n, x["df"])) for x in r["dfs"])
        size += r["bytes"]
    yield ItemIndex(held, idf, words / n, run)


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Each document with each test item that it leaks: doc_id, item_id, score, matched_words, prompt_overlap, answer_overlap.

    ``documents``: doc_id, text; ``items``: item_id, prompt, passage, answer.
    A leak: at least ``run`` consecutive words of the passage, or all of a
    shorter one, as a reader of the rendered text sees them.  Texts are searched
    whole, in overlapping passages as long as two of the longest runs, so that
    each run lies wholly within one of them.  Null and empty texts or passages
    leak nothing; repeated documents give repeated results, repeated rows of an
    item count once; items with one passage are all reported.

    Items are taken in indexes of about ``index_bytes``, each broadcast and
    searched by all documents.  If there are several, each one's results are
    written to the shared folder and its index dropped before the next, so that
    memory is bounded whatever the number of items.  Texts are never shuffled.
    """
    out, last = None, None
    for index in indexes(items, run, index_bytes):
        if last is not None:
            part = cut(_search(documents, last))
            out = part if out is None else out.unionByName(part)
        last = index
    if last is None:
        return documents.sparkSession.createDataFrame([], OUT)
    part = _search(documents, last)
    return part if out is None else out.unionByName(part)


def _search(documents: DataFrame, index: ItemIndex) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        kinds = [pa.string(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_()]
        for batch in batches:
            found = list(ix.search_all(batch.column("text").to_pylist()))
            cols = list(zip(*found)) if found else [[]] * 6
            docs = batch.column("doc_id").take(pa.array(cols[0], pa.int64()))
            names = [ix.items[d][0] for d in cols[1]]
            yield pa.RecordBatch.from_arrays([docs, *[pa.array(list(c), k) for c, k in zip([names, *cols[2:]], kinds)]], names=["doc_id", "item_id", "score", "matched_words", "prompt_overlap", "answer_overlap"])

    return documents.select("doc_id", "text").where("text is not null").mapInArrow(work, OUT)
