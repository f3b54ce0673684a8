"""Whitening of embeddings from an exact, bit-sliced scatter matrix.

Entries become integers. Within a block of rows every dimension is shifted to start at zero and cut into bit planes; a plane is packed
across the rows into 64-bit words. The number of ones that two planes share (AND, then popcount), weighted by both planes' powers of
two, gives the block's cross-products without rounding. Spark adds the blocks up as decimals; the sums are centred as integers
(n * C - S S') and only then become the doubles that `eigh` takes.

Only the sums travel: for vectors of d entries one task sends d * (d + 3) / 2 + 1 numbers, and the driver takes as many for each vector length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdiff.staging import stage

#: x = floor(SCALE * entry) + OFFSET; entries beyond 2^33 are held there, so that every sum fits a decimal of 38 digits.
SCALE, OFFSET, LARGEST = 1024, 100_000, float(2**33)
COMPONENTS = 8
#: Rows of a block, a multiple of 64.
BLOCK = 16384
#: A component whose eigenvalue is below this share of the trace has no direction of its own.
LEAST_SHARE = 1e-12


@dataclass
class Model:
    """What whitens vectors of one length. `sums` are whole numbers; columns of `axes` are components by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float


def sound(vector: Column) -> Column:
    """Vectors without null and non-finite entries."""
    return F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def to_whole(c: np.ndarray) -> np.ndarray:
    """The integers that stand for the entries."""
    return np.floor(SCALE * np.clip(c, -LARGEST, LARGEST)).astype(np.int64) + OFFSET


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of non-negative columns, packed across rows: words (plane, word), and each plane's column and bit."""
    rows, dim = y.shape
    packed, column, bit = [], [], []
    for j in range(dim):
        for b in range(int(y[:, j].max()).bit_length()):
            ones = np.packbits((y[:, j] >> b & 1).astype(np.uint8))
            padded = np.zeros(-(-rows // 64) * 8, np.uint8)
            padded[: len(ones)] = ones
            packed.append(padded.view(np.uint64))
            column.append(j)
            bit.append(b)
    words = np.array(packed) if packed else np.zeros((0, -(-rows // 64)), np.uint64)
    return words, np.array(column, np.int64), np.array(bit, np.int64)


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Sums of the columns of x and their cross-products (from the diagonal on), as Python integers, by popcounts alone."""
    rows, dim = x.shape
    low = x.min(axis=0)
    words, column, bit = planes(x - low)
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    first = np.zeros(dim, object)
    np.add.at(first, column, [int(n) << int(b) for n, b in zip(ones, bit, strict=True)])
    cross = np.zeros((dim, dim), object)
    start = np.searchsorted(column, np.arange(dim + 1))
    narrow = 2 * int(bit.max(initial=0)) + 2 + rows.bit_length() < 63
    weight = [1 << int(b) for b in bit]
    if narrow:
        weight = np.array(weight, np.int64)
    else:
        weight = np.array(weight, object)
    for j in range(dim):
        own = words[start[j]:start[j + 1]]
        rest = words[start[j]:]
        if not len(own):
            continue
        shared = np.array([np.bitwise_count(p & rest).sum(axis=1, dtype=np.int64) for p in own])
        if not narrow:
            shared = shared.astype(object)
        by_plane = (weight[start[j]:start[j + 1]] @ shared) * weight[start[j]:]
        np.add.at(cross[j], column[start[j]:], by_plane)
    low = [int(v) for v in low]
    sums = [int(f) + rows * v for f, v in zip(first, low, strict=True)]
    return sums, [[int(cross[j, k]) + low[j] * int(first[k]) + low[k] * int(first[j]) + rows * low[j] * low[k] for k in range(j, dim)] for j in range(dim)]


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and entries (as double) of a column without nulls, one pair for each length."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy().astype(np.float64)
    start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for dim in np.unique(sizes):
        at = (sizes == dim).nonzero()[0]
        yield at, flat[start[at][:, None] + np.arange(dim)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each number that a task adds up: (dim, -1, -1) rows, (dim, -1, k) sums, (dim, j, k) cross-products."""
    total: dict[tuple[int, int, int], int] = defaultdict(int)
    for b in batches:
        for at, c in _vectors(b.column(0)):
            for i in range(0, len(at) if c.shape[1] else 0, BLOCK):
                x = to_whole(c[i:i + BLOCK])
                dim = x.shape[1]
                first, cross = scatter(x)
                total[dim, -1, -1] += len(x)
                for k, v in enumerate(first):
                    total[dim, -1, k] += v
                for j, row in enumerate(cross):
                    for k, v in enumerate(row, j):
                        total[dim, j, k] += v
    keys = list(total)
    for i in range(0, len(keys), 65536):
        part = keys[i:i + 65536]
        text = pa.array([str(total[k]) for k in part], pa.string())
        yield pa.RecordBatch.from_arrays([*(pa.array([k[f] for k in part], pa.int32()) for f in range(3)), text], ["dim", "j", "k", "v"])


def fit(vectors: DataFrame, vector: str = "embedding") -> dict[int, Model]:
    """A model for each length of the sound vectors; lengths whose vectors are all equal, or empty, have none."""
    parts = vectors.filter(sound(F.col(vector))).select(vector).mapInArrow(_sums, "dim int, j int, k int, v string")
    rows = parts.groupBy("dim", "j", "k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    by_dim: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
    for r in rows:
        by_dim[r["dim"]][r["j"], r["k"]] = int(r["v"])
    return {dim: m for dim, found in by_dim.items() if (m := _model(dim, found)) is not None}


def _model(dim: int, found: dict[tuple[int, int], int]) -> Model | None:
    n = found[-1, -1]
    sums = [found[-1, k] for k in range(dim)]
    # whole numbers until the very end; a quotient of two Python integers is rounded once
    v = np.array([[(n * found[min(j, k), max(j, k)] - sums[j] * sums[k]) / (n * n) for k in range(dim)] for j in range(dim)])
    trace = float(np.trace(v))
    if trace <= 0:
        return None
    values, axes = np.linalg.eigh(v)
    order = [i for i in np.argsort(-values, kind="stable")[:COMPONENTS] if values[i] > LEAST_SHARE * trace]
    return Model(n, sums, values[order], axes[:, order], trace)


def _deviation(x: np.ndarray, m: Model) -> list[int | None]:
    """Sum of (n * x - S)^2; null where it does not fit a long."""
    size = max(abs(m.n * int(v) - s) for v, s in [*zip(x.min(axis=0), m.sums, strict=True), *zip(x.max(axis=0), m.sums, strict=True)])
    if size * size * x.shape[1] < 2**63:
        d = m.n * x - np.array(m.sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = m.n * x.astype(object) - np.array(m.sums, object)
    return [int(v) if v < 2**63 else None for v in (d * d).sum(axis=1)]


def whiten(vectors: DataFrame, *, vector: str = "embedding") -> DataFrame:
    """All columns of the sound vectors' rows, with
    white           array<double>: the centred vector on each component, over the root of its eigenvalue
    deviation       long: sum over dimensions of (n * x - S)^2, exact; null where it does not fit
    fitted          long: vectors that the model of this length was fitted on, n
    explained       array<double>: each component's share of the variance
    identity_error  double: largest absolute entry of the covariance of `white` minus the identity

    Vectors that are null or hold null or non-finite entries are left out. Vectors of different lengths are whitened apart, each length with
    its own n and identity_error; empty vectors and lengths whose vectors are all equal have no components and are left out. Components
    with eigenvalue zero are not given. Repeated rows count as often as they occur. Columns of the input that bear one of the five names are replaced.
    """
    spark = vectors.sparkSession
    new = {"white": "array<double>", "deviation": "long", "fitted": "long", "explained": "array<double>", "identity_error": "double"}
    kept = vectors.select(*[c for c in vectors.columns if c not in new or c == vector])
    good = stage(kept.filter(sound(F.col(vector))))
    models = fit(good, vector)
    at = good.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, c in _vectors(b.column(at)):
                m = models.get(c.shape[1])
                if m is None or not len(rows):
                    continue
                x = to_whole(c)
                centred = (x * float(m.n) - np.array(m.sums, np.float64)) / m.n if m.n * int(np.abs(x).max()) < 2**53 else x - np.array([s / m.n for s in m.sums])
                white = centred @ (m.axes / np.sqrt(m.values))
                k = len(m.values)
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k)
                part = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([
                    *part.columns, pa.array([c.shape[1]] * len(rows), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(white.ravel())), pa.array(_deviation(x, m), pa.int64()),
                    pa.array([m.n] * len(rows), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.tile(m.values / m.trace, len(rows))))],
                    [*part.schema.names, "__dim", "white", "deviation", "fitted", "explained"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in good.schema), "__dim int", *(f"{c} {t}" for c, t in new.items() if c != "identity_error")])
    done = stage(good.mapInArrow(run, schema))
    pairs = [(i, j) for i in range(COMPONENTS) for j in range(i, COMPONENTS)]
    errors = done.groupBy("__dim").agg(*[F.covar_pop(F.get("white", F.lit(i)), F.get("white", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs])
    error = F.greatest(*[F.abs(F.when(F.get("explained", F.lit(j)).isNotNull(), F.col(f"c{i}_{j}") - float(i == j))) for i, j in pairs])
    known = errors.join(done.groupBy("__dim").agg(F.first("explained").alias("explained")), "__dim").select("__dim", error.alias("identity_error"))
    return done.join(F.broadcast(known), "__dim").drop("__dim") if len(models) <= 1024 else done.join(known, "__dim").drop("__dim")


def components(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per sound vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error."""
    done = whiten(vectors.select(F.col(key).alias("__key"), F.col(vector).alias("__vector")), vector="__vector")
    each = F.posexplode(F.arrays_zip("white", "explained")).alias("p", "c")
    return done.select("__key", "deviation", "fitted", "identity_error", each).select(
        F.col("__key").alias(key), (F.col("p") + 1).cast("int").alias("component"), F.col("fitted").alias("n"), "deviation", F.col("c.white").alias("whitened"),
        F.col("c.explained").alias("explained"), "identity_error")
