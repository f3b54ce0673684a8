"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank and cut into ranges, the top nodes of the index. Every node
keeps the bits that all fingerprints below it share. Two nodes meet only if the shared bits of both differ in
at most DISTANCE places; inside a meeting pair the same test runs down the levels, pruning whole groups at
once, until single fingerprints are compared. A task gives a spanning forest of the links that it finds,
not the links themselves, so a large group of near copies costs no more rows than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdiff.llm.common import as_bytes, groups
from revdiff.llm.components import Forest, components
from revdiff.staging import stage

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Fingerprints to a top node, and the most top nodes. The pattern table that reaches the driver has at most NODES rows.
NODE_ROWS, NODES = 8192, 2048
FAN = 16
#: Group pairs opened at a time.
OPEN = 4096


def fingerprint(raw: bytes) -> int:
    """64 majority bits over the hashes of all word shingles, repeats included; 0 without words."""
    words = raw.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1:].tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    every = np.array(hashes, np.uint64).view(np.uint8)
    for at in range(0, len(every), 8 * 65536):
        bits += np.unpackbits(every[at:at + 8 * 65536], bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, columns: dict[str, Column], *, text: str = "text") -> DataFrame:
    """The given columns and fp, the fingerprint as a signed long. A null text has no words: fingerprint zero."""
    slim = docs.select(*[c.alias(n) for n, c in columns.items()], as_bytes(F.col(text)).alias("__b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _signed([fingerprint(x) for x in b.column(b.num_columns - 1).to_pylist()])], [*b.schema.names[:-1], "fp"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{kinds}, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in the Gray sequence, as a long in the same order."""
    rank = fp
    for by in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, by))
    return rank.bitwiseXOR(F.lit(-(2**63)))


def _levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shared bits, their values) per level, from single fingerprints up to at most FAN groups."""
    ands, ors = fps, fps
    out = [(np.full(len(fps), ~np.uint64(0)), fps)]
    while len(ands) > FAN:
        at = np.arange(0, len(ands), FAN)
        ands, ors = np.bitwise_and.reduceat(ands, at), np.bitwise_or.reduceat(ors, at)
        mask = ~(ands ^ ors)
        out.append((mask, ands & mask))
    return out


def _near(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of nodes differ in at most DISTANCE of the bits that both share below them."""
    return np.bitwise_count((a[1][i] ^ b[1][j]) & a[0][i] & b[0][j]) <= DISTANCE


def search(left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between two runs of fingerprints in Gray order (right=None: within left), as values."""
    own = right is None
    a, b = _levels(left), _levels(left if own else right)
    forest = Forest(len(left) + (0 if own else len(right)))
    shift = 0 if own else len(left)
    top = max(len(a), len(b)) - 1
    level = lambda t, k: t[min(k, len(t) - 1)]
    i, j = np.divmod(np.arange(len(level(a, top)[0]) * len(level(b, top)[0])), len(level(b, top)[0]))
    todo = [(top, i, j)]
    spread_i, spread_j = np.divmod(np.arange(FAN * FAN), FAN)
    while todo:
        k, i, j = todo.pop()
        if own:
            i, j = i[i <= j], j[i <= j]
        near = _near(level(a, k), level(b, k), i, j)
        i, j = i[near], j[near]
        if not k:
            forest.add(i, j + shift)
            continue
        down_a, down_b = k <= len(a) - 1, k <= len(b) - 1
        for at in range(0, len(i), OPEN):
            ci, cj = i[at:at + OPEN, None], j[at:at + OPEN, None]
            ni = (ci * FAN + spread_i if down_a else ci + 0 * spread_i).ravel()
            nj = (cj * FAN + spread_j if down_b else cj + 0 * spread_j).ravel()
            ok = (ni < len(level(a, k - 1)[0])) & (nj < len(level(b, k - 1)[0]))
            if not down_a:
                ok &= np.tile(spread_i == 0, len(ci))
            if not down_b:
                ok &= np.tile(spread_j == 0, len(ci))
            todo.append((k - 1, ni[ok], nj[ok]))
    u, v = forest.links()
    every = left if own else np.concatenate([left, right])
    return every[u], every[v]


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) among distinct fingerprints (fp) that connect all within DISTANCE bits, directly or by others so linked."""
    spark = distinct.sparkSession
    count = distinct.count()
    parts = min(NODES, max(1, -(-count // NODE_ROWS)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        fps = np.concatenate(held or [np.zeros(0, np.int64)]).view(np.uint64)
        if len(fps):
            ands, ors = np.bitwise_and.reduce(fps), np.bitwise_or.reduce(fps)
            mask = ~(ands ^ ors)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), _signed([mask]), _signed([ands & mask]), pa.array([fps.tobytes()])],
                                             ["node", "mask", "value", "fps"])

    ranked = distinct.select("fp", gray_rank(F.col("fp")).alias("rank")).repartitionByRange(parts, "rank").sortWithinPartitions("rank").select("fp")
    nodes = stage(ranked.mapInArrow(build, "node int, mask long, value long, fps binary"))
    # the top level only: a mask and a value per node, at most NODES rows
    shape = nodes.select("node", "mask", "value").collect()
    names = np.array([r["node"] for r in shape], np.int64)
    pattern = tuple(np.array([r[c] for r in shape], np.int64).view(np.uint64) for c in ("mask", "value"))
    meets: dict[int, list[int]] = {int(n): [] for n in names}
    for at, n in enumerate(names):
        here = np.full(len(names), at)
        meets[int(n)] = [int(m) for m in names[_near(pattern, pattern, here, np.arange(len(names)))]]
    shared = spark.sparkContext.broadcast(meets)
    pairs = sum(map(len, meets.values())) // 2 + len(meets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                to = shared.value[node]
                for at in range(0, len(to), 8):
                    part = to[at:at + 8]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([min(node, m) for m in part], pa.int32()), pa.array([max(node, m) for m in part], pa.int32()),
                         pa.array([node] * len(part), pa.int32()), pa.array([blob] * len(part), pa.binary())], ["lo", "hi", "node", "fps"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["lo", "hi"]):
            runs = [np.frombuffer(x, np.uint64) for x in t.column("fps").to_pylist()]
            u, v = search(runs[0], runs[1] if len(runs) > 1 else None)
            if len(u):
                yield pa.RecordBatch.from_arrays([_signed(u), _signed(v)], ["u", "v"])

    dealt = nodes.select("node", "fps").mapInArrow(send, "lo int, hi int, node int, fps binary").repartition(max(1, min(4000, pairs // 4)), "lo", "hi").sortWithinPartitions("lo", "hi", "node")
    return dealt.mapInArrow(meet, "u long, v long")


def roots_of(distinct: DataFrame) -> DataFrame:
    """fp and root, a fingerprint that stands for its component, for every row of distinct fingerprints."""
    found = stage(components(links(distinct)))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def dedupe(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id (the smallest key linked, itself included).

    Fingerprints with at most DISTANCE differing bits link. Texts without words have fingerprint zero and link like any other. Null keys are
    rows like others but are no component_id unless a component has no other key.
    """
    prints = stage(fingerprints(docs, {"k": F.col(key)}, text=text))
    # one row per distinct fingerprint, pre-aggregated in the map tasks: exact copies never meet
    known = roots_of(stage(prints.groupBy("fp").agg(F.min("k").alias("low"))))
    ids = known.join(known.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(ids, "fp").select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every component, all columns as they are: the one with the smallest key (null keys last; of repeated rows the first read)."""
    fresh = "__row"
    while fresh in docs.columns:
        fresh += "_"
    rows = stage(docs.withColumn(fresh, F.monotonically_increasing_id()))
    prints = stage(fingerprints(rows, {"k": F.col(key), "r": F.col(fresh)}, text=text))
    first = F.struct(F.col("k").isNull().alias("no_key"), F.col("k").alias("k"), F.col("r").alias("r"))
    # copies of one fingerprint are reduced to their first row before they meet others
    known = roots_of(stage(prints.groupBy("fp").agg(F.min(first).alias("best"))))
    kept = known.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.r").alias(fresh))
    return rows.join(kept, fresh, "left_semi").drop(fresh)
