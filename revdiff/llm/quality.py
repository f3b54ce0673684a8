"""Quality score: a generalised additive model with pairwise interactions.

Features of a text are cut into bins; shallow trees over one feature's bins (or two features' bins) are
boosted in a cycle, and all trees of a feature add up to one lookup table. A score is the sum of table
entries, so scoring is binning plus additions over whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdiff.llm.common import keep_rows

#: Labelled rows that the fit reads at most (those with the smallest key hashes).
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.1

FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digit", "mark", "symbol", "line_feeds", "exclaim", "bar", "beyond_ascii",
            "distinct_words", "repeats", "short_words", "stops", "distinct_lines", "longest_word")
_CLASSES = np.zeros((256, 8), np.float64)
_CLASSES[65:91, 0] = 1                                    # upper case
_CLASSES[48:58, 1] = 1                                    # digits
_CLASSES[[ord(c) for c in ".,;:'\"()-?"], 2] = 1          # plain punctuation
_CLASSES[[ord(c) for c in "#$%&*@^~<>{}[]\\/=+_`"], 3] = 1  # symbols
_CLASSES[10, 4] = 1
_CLASSES[ord("!"), 5] = 1
_CLASSES[ord("|"), 6] = 1
_CLASSES[128:, 7] = 1


def features(texts: list[str | None]) -> np.ndarray:
    """One row of FEATURES per text; null and empty texts give zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "replace")
        n = len(raw)
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES
        words = raw.split()
        w = len(words)
        out[i, 0] = np.log1p(n)
        out[i, 3:11] = counts / n
        if not w:
            continue
        lengths = np.fromiter(map(len, words), np.int64, w)
        lines = raw.split(b"\n")
        out[i, 1] = np.log1p(w)
        out[i, 2] = lengths.mean()
        out[i, 11] = len(set(words)) / w
        out[i, 12] = sum(map(bytes.__eq__, words, words[1:])) / w
        out[i, 13] = (lengths <= 3).mean()
        out[i, 14] = (counts[2] and raw.count(b".")) / w
        out[i, 15] = len(set(lines)) / len(lines)
        out[i, 16] = np.log1p(lengths.max())
    return out


@dataclass
class Model:
    edges: list[np.ndarray]                       # per feature: ascending cut points
    tables: list[np.ndarray]                      # per feature: value of each bin
    pairs: list[tuple[int, int, np.ndarray]]      # two features, table over their coarse bins
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        total = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[bins[j]]
        for a, b, t in self.pairs:
            total += t[_coarse(bins[a], len(self.tables[a])), _coarse(bins[b], len(self.tables[b]))]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _coarse(bins: np.ndarray, of: int) -> np.ndarray:
    return bins * PAIR_BINS // max(of, PAIR_BINS)


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Best splits of an ordered histogram of gradients and curvatures, as one value per bin."""
    gs, hs = g.cumsum(), h.cumsum()
    if depth == 0 or len(g) < 2:
        return np.full(len(g), _leaf(gs[-1], hs[-1]))
    gain = gs[:-1] ** 2 / (hs[:-1] + 1.0) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1.0)
    k = int(gain.argmax()) + 1
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _table_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One split on the first feature, then one on the second in each half."""
    best, value = -1.0, np.full(g.shape, _leaf(g.sum(), h.sum()))
    for k in range(1, len(g)):
        parts = [(g[:k].sum(0), h[:k].sum(0)), (g[k:].sum(0), h[k:].sum(0))]
        rows = [_tree(a, b, 1) for a, b in parts]
        gain = sum(float((r * a).sum()) for r, (a, _) in zip(rows, parts, strict=True))
        if gain > best:
            best, value = gain, np.vstack([np.tile(rows[0], (k, 1)), np.tile(rows[1], (len(g) - k, 1))])
    return value


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting over single features, then over the pairs with the largest first gain."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    mean = float(np.clip(y.mean(), 0.01, 0.99)) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    if not n:
        return Model(edges, tables, [], base)
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    total = np.full(n, base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[j], g, len(tables[j])), np.bincount(bins[j], h, len(tables[j])))
            tables[j] += step
            total += step[bins[j]]
    coarse = [_coarse(b, len(t)) for b, t in zip(bins, tables, strict=True)]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * PAIR_BINS + coarse[b], v, PAIR_BINS * PAIR_BINS).reshape(PAIR_BINS, PAIR_BINS)

    g, h = slopes()
    gains = []
    for a in range(d):
        for b in range(a + 1, d):
            t = _table_tree(grid(a, b, g), grid(a, b, h))
            gains.append((-float((t * grid(a, b, g)).sum()), a, b))
    pairs = [(a, b, np.zeros((PAIR_BINS, PAIR_BINS))) for _, a, b in sorted(gains)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, t in pairs:
            g, h = slopes()
            step = RATE * _table_tree(grid(a, b, g), grid(a, b, h))
            t += step
            total += step[coarse[a], coarse[b]]
    return Model(edges, tables, pairs, base)


def _feature_rows(docs: DataFrame, columns: dict[str, Column], text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(b.num_columns - 1).to_pylist())
            f = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], f], [*b.schema.names[:-1], "f"])

    slim = docs.select(*[c.alias(n) for n, c in columns.items()], F.col(text).alias("t"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{kinds}, f array<double>")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from at most FIT_ROWS labelled documents: those with the smallest key hashes where `learn` holds.

    Null keys and labels are not learned from; several labels of one key count as their largest. No rows: a constant score of one half.
    """
    chosen = (labels.filter(learn & F.col(key).isNotNull() & F.col(label).isNotNull())
              .groupBy(F.col(key).alias("k")).agg(F.max(label).cast("double").alias("y"))
              .orderBy(F.xxhash64("k"), "k").limit(FIT_ROWS))
    # FIT_ROWS pairs of key and label: a bounded broadcast
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    rows = _feature_rows(known, {"k": F.col("k"), "y": F.col("y")}, "t").dropDuplicates(["k"]).orderBy("k").collect()
    x = np.array([r["f"] for r in rows]).reshape(len(rows), len(FEATURES))
    return train(x, np.array([float(r["y"] > 0) for r in rows]))


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: key, score (0 to 1), predicted (score >= threshold).

    Null and empty texts have all-zero features and get that point's score. Keys, null or repeated, pass as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.score(features(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["k", "score"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, score double")
    return out.select(F.col("k").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows that score at least `threshold`, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text, lambda texts: list(shared.value.score(features(texts)) >= threshold))
