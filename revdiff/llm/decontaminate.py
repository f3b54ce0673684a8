"""Benchmark decontamination: every training passage queries a BM25 index of test items by block-max WAND.

Documents are cut into overlapping passages, each twice as long as the longest item of an index, so that an item always lies
whole inside one. Impacts are divided by the item's own score: a passage's score for an item is the share of the item's BM25 mass
that it covers. All items above THRESHOLD are retrieved, then the overlap of words in order and of the question's and the
answer's words is verified.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from revdiff.llm.common import keep_rows

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, SHINGLE = 0.7, 0.8, 5
BLOCK = 8
#: Items in one broadcast index; more items make more indexes, each asked by every passage.
INDEX_ITEMS = 20_000
#: Shortest passage stride, in tokens. Items above it go to indexes of the next powers of two.
STRIDE = 64
#: Passages looked at together at most, and sums of block maxima held for them.
BATCH, HELD = 1024, 2**17
ANSWER_WORDS = 5

#: ASCII characters that are neither letters nor digits part words; all else is kept.
_BLANK = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_BLANK).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The last sentences with at least ANSWER_WORDS words are the answer; an item of one such part has no answer."""
    parts = [w for w in map(words, _SENTENCE.split(text)) if w]
    answer: list[bytes] = []
    while parts and len(answer) < ANSWER_WORDS:
        answer = parts.pop() + answer
    question = [w for p in parts for w in p]
    return (question, answer) if question else (answer, [])


def shingles(tokens: list[bytes]) -> set[bytes]:
    return {b" ".join(tokens[i:i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))}


class Index:
    """Inverted index of items, postings by item number with block maxima, and what verification needs."""

    def __init__(self, items: list[tuple[object, str]], stride: int):
        self.stride = stride
        tokens = [words(t) for _, t in items]
        df = Counter(w for x in tokens for w in set(x))
        # items that share frequent words stand together: block maxima get closer to single scores
        order = sorted(range(len(items)), key=lambda i: (sorted(set(tokens[i]), key=lambda w: (-df[w], w))[:3], i))
        items, tokens = [items[i] for i in order], [tokens[i] for i in order]
        self.names = [n for n, _ in items]
        self.parts = []
        for (_, text), whole in zip(items, tokens, strict=True):
            question, answer = question_and_answer(text)
            self.parts.append((shingles(whole), set(question), set(answer)))
        self.term = {w: i + 1 for i, w in enumerate(sorted(df))}
        mean = sum(map(len, tokens)) / max(1, len(tokens))
        postings: list[list[tuple[int, float]]] = [[] for _ in range(len(df) + 1)]
        for i, x in enumerate(tokens):
            impact = {w: np.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(x) / mean)) for w, n in Counter(x).items()}
            own = sum(impact.values())
            for w, v in impact.items():
                postings[self.term[w]].append((i, v / own))
        self.at = [[i for i, _ in p] for p in postings]
        self.impact = [[v for _, v in p] for p in postings]
        self.top = [max(p, default=0.0) for p in self.impact]
        self.block_top: list[dict[int, float]] = []
        for at, impact in zip(self.at, self.impact, strict=True):
            tops: dict[int, float] = {}
            for i, v in zip(at, impact, strict=True):
                tops[i // BLOCK] = max(v, tops.get(i // BLOCK, 0.0))
            self.block_top.append(tops)
        self.blocks = len(items) // BLOCK + 1
        self.batch = max(16, min(BATCH, HELD // self.blocks))
        self.start = np.concatenate([[0], np.cumsum([len(b) for b in self.block_top])])
        self.block = np.array([k for b in self.block_top for k in b], np.int64)
        self.bound = np.array([v for b in self.block_top for v in b.values()])

    def hopeful(self, passage: np.ndarray, term: np.ndarray, count: int) -> np.ndarray:
        """Passages with a block whose summed maxima reach the threshold. (passage, term): distinct pairs; count: passages."""
        n = self.start[term + 1] - self.start[term]
        at = np.arange(n.sum()) + np.repeat(self.start[term] - (n.cumsum() - n), n)
        total = np.bincount(np.repeat(passage, n) * self.blocks + self.block[at], self.bound[at], count * self.blocks)
        return (total.reshape(count, self.blocks).max(1) >= THRESHOLD - 1e-9).nonzero()[0]

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """All (item, score) with score >= THRESHOLD for a passage's distinct terms, by block-max WAND."""
        least = THRESHOLD - 1e-9
        found = []
        # a cursor: [item it stands on, place in the postings, term]
        cursors = [[self.at[t][0], 0, t] for t in terms]

        def forward(c: list[int], to: int) -> None:
            c[1] = bisect_left(self.at[c[2]], to, c[1])

        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += self.top[c[2]]
                if total >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            head = cursors[:pivot + 1]
            block = item // BLOCK
            if sum(self.block_top[c[2]].get(block, 0.0) for c in head) < least:
                # nothing before the end of this block, or before the next cursor, can reach the threshold
                to = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                to = max(to, item + 1)
                for c in head:
                    forward(c, to)
            elif head[0][0] == item:
                score = sum(self.impact[c[2]][c[1]] for c in head)
                if score >= least:
                    found.append((item, score))
                for c in head:
                    c[1] += 1
            else:
                for c in head:
                    if c[0] < item:
                        forward(c, item)
            cursors = [c for c in cursors if c[1] < len(self.at[c[2]])]
            for c in cursors:
                c[0] = self.at[c[2]][c[1]]
        return found

    def verify(self, item: int, tokens: list[bytes]) -> tuple[float, float, float]:
        """Shares of the item's shingles, of its question's words and of its answer's words that the passage holds."""
        whole, question, answer = self.parts[item]
        have, said = set(tokens), shingles(tokens)
        # an item of fewer words than a shingle is found as a run of words
        held = sum(s in said for s in whole) if len(next(iter(whole)).split()) == SHINGLE else float(b" " + next(iter(whole)) + b" " in b" " + b" ".join(tokens) + b" ")
        return held / len(whole), len(question & have) / max(1, len(question)), len(answer & have) / len(answer) if answer else 1.0

    def search(self, texts: list[list[bytes]]) -> list[dict[int, tuple]]:
        """Per tokenised text: item -> (overlap, score, passage, question overlap, answer overlap) of its best verified passage."""
        out: list[dict[int, tuple]] = [{} for _ in texts]
        step, get = self.stride, self.term.get
        places, keys, count = [], [], 0

        def flush() -> None:
            nonlocal count
            if not count:
                return
            every = np.unique(np.concatenate(keys))
            passage, term = np.divmod(every, len(self.at))
            cut = np.searchsorted(passage, np.arange(count + 1))
            for p in self.hopeful(passage, term, count):
                text, k = places[p]
                for item, score in self.wand(term[cut[p]:cut[p + 1]].tolist()):
                    tokens = texts[text][k * step:(k + 2) * step]
                    overlap, question, answer = self.verify(item, tokens)
                    if min(overlap, question, answer) >= OVERLAP:
                        out[text][item] = max(out[text].get(item, (0.0,)), (overlap, score, -k, question, answer))
            places.clear()
            keys.clear()
            count = 0

        for text, tokens in enumerate(texts):
            n = len(tokens)
            ids = np.fromiter(map(get, tokens, [0] * n), np.int64, n)
            last = max(0, -(-n // step) - 2)  # passages 0..last; passage k holds tokens k*step..(k+2)*step-1
            at = ids.nonzero()[0]
            own, ids = at // step, ids[at]
            for k0 in range(0, last + 1, self.batch):
                k1 = min(last + 1, k0 + self.batch)
                for shift in (0, 1):
                    k = own - shift
                    ok = (k >= k0) & (k < k1)
                    keys.append((count + k[ok] - k0) * len(self.at) + ids[ok])
                places += [(text, k) for k in range(k0, k1)]
                count += k1 - k0
                if count >= self.batch:
                    flush()
        flush()
        return out


def indexes(items: DataFrame, *, item: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Indexes of at most INDEX_ITEMS items, each with items of like length, so that every index can be broadcast.

    Items without a word never match and are left out.
    """
    held: dict[int, list[tuple[object, str]]] = {}
    for r in items.filter(F.col(text).isNotNull()).select(F.col(item).alias("i"), F.col(text).alias("t")).orderBy(F.length("t"), "i", "t").toLocalIterator():
        n = len(words(r["t"]))
        if not n:
            continue
        stride = max(STRIDE, 1 << (n - 1).bit_length())
        part = held.setdefault(stride, [])
        part.append((r["i"], r["t"]))
        if len(part) == INDEX_ITEMS:
            yield Index(held.pop(stride), stride)
    for stride, part in held.items():
        yield Index(part, stride)


def matches(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it holds: key, item, score, overlap, question_overlap, answer_overlap, passage.

    A match covers THRESHOLD of the item's BM25 mass in one passage, and OVERLAP of its five-word shingles, of its question's words
    and of its answer's words. Null texts match nothing. Repeated items and null item ids match each on their own; keys pass as they are.
    """
    spark = docs.sparkSession
    kind, of = docs.schema[key].dataType, items.schema[item].dataType
    item_kind = to_arrow_type(of)
    out = None
    for index in indexes(items, item=item, text=item_text):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                found = index.search([words(t) for t in b.column(1).to_pylist()])
                rows = [(d, index.names[i], v[1], v[0], v[3], v[4], -v[2]) for d, hits in enumerate(found) for i, v in hits.items()]
                if rows:
                    d, names, *rest = zip(*rows, strict=True)
                    kinds = [pa.float64()] * 4 + [pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(d)), pa.array(names, item_kind), *(pa.array(c, t) for c, t in zip(rest, kinds, strict=True))],
                        ["k", "i", "score", "overlap", "question_overlap", "answer_overlap", "passage"])

        part = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(
            run, f"k {kind.simpleString()}, i {of.simpleString()}, score double, overlap double, question_overlap double, answer_overlap double, passage long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"k {kind.simpleString()}, i {of.simpleString()}, score double, overlap double, question_overlap double, answer_overlap double, passage long")
    return out.select(F.col("k").alias(key), F.col("i").alias(item), "score", "overlap", "question_overlap", "answer_overlap", "passage")


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that hold no item, all columns as they are."""
    for index in indexes(items, item=item, text=item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = keep_rows(docs, text, lambda texts, shared=shared: [not hits for hits in shared.value.search([words(t) for t in texts])])
    return docs
