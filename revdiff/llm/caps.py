"""Embedding near-duplicates by spherical-cap filters.

Filter directions form a random product code: a randomly turned vector is cut into two blocks, each block has
its own code words, and a direction is one word of each. A vector is decoded to the list of all directions whose
score reaches a threshold (at least LEAST of them), without trying the product: only words that can
still reach it are combined. Vectors of one label that share a direction are compared in double precision. A pair
counts in the first direction that both share, so each link is found once and no list of pairs is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdiff.llm.common import groups
from revdiff.llm.components import Forest, components
from revdiff.staging import stage

COSINE = 0.98
#: Directions a vector falls in on average, and at least.
LISTED, LEAST = 16, 8
#: Vectors of one label aimed at in a direction; code words of a block at most.
BUCKET, WORDS = 64, 4096
#: Vectors of a direction compared in one task; more are compared cell by cell.
CELL = 1024
#: Vectors (those with the smallest hashes) that set the threshold.
SAMPLE = 2048
SEED = 20


@lru_cache(maxsize=8)
def _code(dim: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A rotation and the code words of both blocks, each scaled so that a direction has length one."""
    dim += dim % 2
    rng = np.random.default_rng([SEED, dim, words])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    blocks = [rng.standard_normal((words, dim // 2)) for _ in range(2)]
    return turn, *(b / np.linalg.norm(b, axis=1, keepdims=True) / np.sqrt(2) for b in blocks)


def _scores(x: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    turn, one, two = _code(x.shape[1], words)
    if x.shape[1] % 2:
        x = np.hstack([x, np.zeros((len(x), 1))])
    y = x @ turn
    half = y.shape[1] // 2
    return y[:, :half] @ one.T, y[:, half:] @ two.T


def decode(x: np.ndarray, words: int, threshold: float) -> list[np.ndarray]:
    """For unit vectors: ascending numbers of all directions with score >= threshold, or the LEAST best if they are fewer."""
    s1, s2 = _scores(x, words)
    k = min(words, LEAST)
    best = (-np.sort(-s1, axis=1)[:, :k, None] - np.sort(-s2, axis=1)[:, None, :k]).reshape(len(x), -1)
    limit = np.minimum(threshold, -np.partition(-best, min(LEAST, best.shape[1]) - 1, axis=1)[:, min(LEAST, best.shape[1]) - 1])
    out = []
    for a, b, t in zip(s1, s2, limit, strict=True):
        i = (a >= t - b.max() - 1e-12).nonzero()[0]
        j = (b >= t - a.max() - 1e-12).nonzero()[0]
        p, q = (a[i, None] + b[None, j] >= t - 1e-12).nonzero()
        out.append(np.sort(i[p] * words + j[q]).astype(np.int32))
    return out


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.array([np.frombuffer(r, np.float32) for r in rows], np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(label: Column, vector: Column) -> Column:
    """Vectors that can link: a label, and only finite components that are not all zero."""
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & sound & F.exists(vector, lambda v: v != 0), F.lit(False))


def _meet(t: pa.Table) -> pa.RecordBatch | None:
    """Links inside one cell: rows (u, u, n) count a vector's links, rows (u, v, 0) connect."""
    f, a, b = (t.column(c)[0].as_py() for c in ("f", "a", "b"))
    r = t.column("r").to_numpy()
    mult = t.column("mult").to_numpy()
    slot = t.column("slot").to_numpy()
    left = (slot == a).nonzero()[0]
    right = left if a == b else (slot == b).nonzero()[0]
    if not len(left) or not len(right):
        return None
    x = _unit(t.column("vec").to_pylist())
    hit = x[left] @ x[right].T >= COSINE
    if a == b:
        np.fill_diagonal(hit, False)
    if not hit.any():
        return None
    # a pair counts here only if it shares no earlier direction
    lists = [np.frombuffer(v, np.int32) for v in t.column("listed").to_pylist()]
    earlier = np.unique(np.concatenate([v[v < f] for v in lists]))
    if len(earlier):
        has = np.zeros((len(lists), len(earlier)), np.float32)
        for row, v in zip(has, lists, strict=True):
            row[np.searchsorted(earlier, v[v < f])] = 1
        hit &= has[left] @ has[right].T < 0.5
    n = np.zeros(len(r), np.int64)
    n[left] += hit @ mult[right]
    if a != b:
        n[right] += hit.T @ mult[left]
    forest = Forest(len(r))
    i, j = hit.nonzero()
    forest.add(left[i], right[j])
    u, v = forest.links()
    seen = n.nonzero()[0]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[seen], r[u]])), pa.array(np.concatenate([r[seen], r[v]])), pa.array(np.concatenate([n[seen], 0 * u]))], ["u", "v", "n"])


def neighbours(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    Vectors of equal, non-null labels and equal length with cosine >= COSINE link; null, zero and non-finite vectors link with nothing. Equal vectors
    are compared once and count as often as they occur. Null keys are rows like others; a component without any key has id null and keeps none.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(key).alias("k"), F.col(label).alias("label"), F.col(vector).cast("array<float>").alias("vec"))
    able = slim.withColumn("able", usable(F.col("label"), F.col("vec")))
    # equal vectors fold in the map tasks first
    distinct = stage(able.filter("able").groupBy("label", "vec").agg(F.min("k").alias("low"), F.count("*").alias("mult")).withColumn("r", F.monotonically_increasing_id()))
    largest = max([r["count"] for r in distinct.groupBy("label").count().orderBy(F.desc("count")).limit(1).collect()], default=0)
    words = int(np.clip(np.ceil(np.sqrt(largest * LISTED / BUCKET)), 8, WORDS))
    picked = [r["vec"] for r in distinct.orderBy(F.xxhash64("vec", "label"), "r").limit(SAMPLE).select("vec").collect()]
    threshold = _threshold(picked, words)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = [np.array(v, np.float32) for v in b.column(2).to_pylist()]
            out: list[bytes | None] = [None] * len(vecs)
            sizes = np.array([len(v) for v in vecs])
            for dim in np.unique(sizes):
                at = (sizes == dim).nonzero()[0]
                for i, found in zip(at, decode(_unit([vecs[i].tobytes() for i in at]), words, threshold), strict=True):
                    out[i] = found.tobytes()
            at = [np.frombuffer(v, np.int32) for v in out]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in at])]), pa.int32()), pa.array(np.concatenate(at)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), b.column(3), pa.array([v.tobytes() for v in vecs]), lists, pa.array(out, pa.binary())],
                                             ["r", "label", "dim", "mult", "vec", "f", "listed"])

    kind = distinct.schema["label"].dataType.simpleString()
    coded = stage(distinct.select("r", "label", "vec", "mult").mapInArrow(listed, f"r long, label {kind}, dim int, mult long, vec binary, f array<int>, listed binary"))
    bucket = ["label", "dim", "f"]
    # directions of a single vector need no task; crowded ones are cut into slots that meet two by two
    sizes = coded.select("label", "dim", F.explode("f").alias("f")).groupBy(*bucket).count().filter("count > 1").select(*bucket, F.ceil(F.col("count") / CELL).cast("int").alias("slots"))
    placed = coded.select("r", "label", "dim", "mult", "vec", "listed", F.explode("f").alias("f")).join(sizes, bucket)
    placed = placed.withColumn("slot", F.pmod(F.xxhash64("r"), F.col("slots")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    cell = [*bucket, "a", "b"]
    cells = placed.select("r", *bucket, "mult", "vec", "listed", "slot", F.least("slot", "other").alias("a"), F.greatest("slot", "other").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, cell):
            if (out := _meet(t)) is not None:
                yield out

    found = stage(cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "u long, v long, n long"))
    counts = found.groupBy(F.col("u").alias("r")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("u <> v")).withColumnRenamed("node", "r")
    known = distinct.join(counts, "r", "left").join(roots, "r", "left").withColumn("root", F.coalesce("root", "r"))
    known = stage(known.select("label", "vec", "low", "root", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links")))
    ids = known.join(known.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("label", "vec", "n_links", "component_id", F.lit(True).alias("able"))
    joined = able.join(ids, ["label", "vec", "able"], "left")
    own = F.when(F.col("able"), F.col("component_id")).otherwise(F.col("k"))
    return joined.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
                         F.coalesce(F.col("k") == own, F.lit(False)).alias("kept"))


def _threshold(vecs: list[list[float]], words: int) -> float:
    """The score that a direction exceeds for LISTED of all words * words directions on average, from the sample's best scores."""
    every = []
    sizes = {len(v) for v in vecs}
    for dim in sizes:
        x = _unit([np.array(v, np.float32).tobytes() for v in vecs if len(v) == dim])
        s1, s2 = (-np.sort(-s, axis=1)[:, : 4 * LISTED] for s in _scores(x, words))
        for a, b in zip(s1, s2, strict=True):
            every.append(-np.sort(-(a[:, None] + b[None, :]).ravel())[: 8 * LISTED])
    if not every:
        return 0.0
    pool = -np.sort(-np.concatenate(every))
    return float(pool[min(len(pool), LISTED * len(vecs)) - 1])
