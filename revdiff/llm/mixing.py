"""Mixing sources to target weights by systematic sampling.

A source's target share of words fixes the expected copies of its documents. Within a source the
expected copies are summed up along an order of document sizes, one random offset is added, and a
document is emitted once for every whole number that its step crosses. Sums run over chunks of the
order, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdiff.llm.common import WORD
from revdiff.operators.scan import number_rows
from revdiff.staging import stage

WEIGHTS, SHARE, CAP, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 7
#: Rows of a source to each slot of a size band; a slot of a band is one chunk of the running sum.
SLOT_ROWS = 1_000_000
#: Sources up to which the table of targets, a few numbers per source, is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 100_000


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Target words per source.

    Sources by code point, null last, get the weights in turn. They share `share` of all words by weight; a
    target stops at `cap` times its source, and what is over goes to the others by weight until none is above.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in order if s in free)
        full = [s for s in order if s in free and left * weight[s] / total >= cap * sizes[s]]
        if not full:
            out.update({s: left * weight[s] / total for s in free})
            break
        for s in full:
            out[s] = cap * sizes[s]
            free.discard(s)
        left -= sum(out[s] for s in full)
    return out


def _offset(source: str | None, seed: int) -> float:
    """A fixed random number in [0, 1), on a grid that sums of whole numbers keep exactly."""
    return (xxhash.xxh64_intdigest(b"\0" if source is None else b"s" + source.encode("utf-8", "replace"), seed) >> 44) / 2**20


def copies(docs: DataFrame, *, row: str, key: str = "doc_id", text: str = "text", source: str = "source",
           size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """One row per input row: row, key, size, source_size, target, copies (how often the mix takes it).

    `row` names a unique row number; `size` an expression for the words of a row, by default counted in the text. A null text has size 0; a null source is a source of its own, last in the order. A source
    without words has target 0 and no copies. Rows alike in source, size and key are interchangeable.
    """
    words = F.regexp_count(F.col(text), F.lit(WORD)) if size is None else size
    slim = stage(docs.select(F.col(row).alias("r"), F.col(key).alias("k"), F.col(source).alias("s"), F.coalesce(words, F.lit(0)).cast("long").alias("size")))
    spark = docs.sparkSession
    # a row per source, pre-aggregated in the map tasks
    per = {r["s"]: (int(r["z"]), r["n"]) for r in slim.groupBy("s").agg(F.sum("size").alias("z"), F.count("*").alias("n")).collect()}
    goal = targets({s: z for s, (z, _) in per.items()}, weights, share, cap)
    plan = spark.createDataFrame(
        [(s is None, s or "", z, float(goal[s]), goal[s] / z if z else 0.0, _offset(s, seed), math.ceil(n / SLOT_ROWS)) for s, (z, n) in per.items()],
        "sn boolean, ss string, source_size long, target double, e double, u double, slots int")
    if len(per) <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    known = slim.select("*", F.col("s").isNull().alias("sn"), F.coalesce("s", F.lit("")).alias("ss")).join(plan, ["sn", "ss"])
    mixed = F.xxhash64("k", F.lit(seed))
    # twelve bands to a doubling of the size: documents of like size stand together, so the words taken come out even
    placed = known.withColumns({"h": mixed, "chunk": F.floor(F.log2(F.col("size") + 1) * 12).cast("long") * F.col("slots") + F.pmod(mixed, F.col("slots"))})
    counted = number_rows(placed, ["sn", "ss"], ["chunk", "size", "h", "r"], F.col("chunk"), "i")
    step = lambda i: F.floor(i * F.col("e") + F.col("u"))
    return counted.select(F.col("r").alias(row), F.col("k").alias(key), "size", "source_size", "target",
                          (step(F.col("i")) - step(F.col("i") - 1)).cast("int").alias("copies"))


def mix(docs: DataFrame, **named) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it, with all columns of docs.

    Takes the arguments of `copies` but `row`.
    """
    fresh = "__mix_row"
    while fresh in docs.columns:
        fresh += "_"
    rows = stage(docs.withColumn(fresh, F.monotonically_increasing_id()))
    taken = copies(rows, row=fresh, **named).filter("copies > 0").select(fresh, F.explode(F.sequence(F.lit(1), "copies")).alias("__copy"))
    return rows.join(taken.select(fresh), fresh).select(*[F.col(f"`{c}`") for c in docs.columns])
