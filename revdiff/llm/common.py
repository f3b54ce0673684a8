"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdiff.session import checkpoint_dir

#: Bytes that separate words: space and 0x09-0x0D. `bytes.split()` splits on exactly these.
WORD = "[^\\x20\\x09-\\x0D]+"


def remainder(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo `mod`; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % mod


def held_out(key: Column, mod: int, rest: int) -> Column:
    """True for rows that no model learns from. A null key is held out: it has no fold of its own."""
    return F.coalesce(remainder(key, mod) == rest, F.lit(True))


def as_bytes(text: Column) -> Column:
    """UTF-8 bytes; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply fn to every Arrow batch; batches that give None are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, text: str, fn: Callable[[list[str | None]], list[bool]], lazy: Callable[[], Callable] | None = None) -> DataFrame:
    """Rows whose text passes fn, all columns as they are. `lazy` builds fn once per task instead."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = lazy() if lazy else fn
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(test(b.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, as one table each, from batches sorted by the keys.

    Only one group is held at a time, so callers bound the size of a group.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = list(zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in keys), strict=True))
        start = 0
        for i, now in enumerate(cols):
            if now != last:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, now
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Like groups, but many complete groups together: tables of at least `rows` rows that end where a group ends."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        change = np.zeros(n - 1, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        at = change.nonzero()[0]
        if len(at):
            cut = int(at[-1]) + 1
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            n -= cut
    if held:
        yield pa.Table.from_batches(held)


def release(spark) -> None:
    """Free the shuffle files of queries that are done.

    They go when the driver collects the handles of those queries, which may be long after; steps that each shuffle about as much as
    they read ask for it once their result is written.
    """
    for _ in range(2):  # the first round lets go of the plans, the second of what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def stage_by(df: DataFrame, key: str) -> DataFrame:
    """Write a frame once to the shared folder, in buckets of a key: later steps that group by it don't shuffle it again.

    The table's name leaves the catalog at once; the frame keeps its files and their layout.
    """
    spark = df.sparkSession
    name = f"revdiff_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/revdiff-stage/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def drop_stage(df: DataFrame) -> None:
    """Delete a staged frame that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/revdiff-stage/" in folder:
            path = hadoop.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
