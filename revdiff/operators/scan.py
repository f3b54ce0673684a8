"""Ordered scans within groups that survive a group of any size.

A plain window sorts a whole group in one task. Here a group is cut into chunks along its order:
windows run inside (keys, chunk), one summary row per chunk is scanned per group, and the carried
value is joined back on (keys, chunk). A group that holds a third of all rows is spread over as
many tasks as it has chunks; only its chunk summaries meet in one place.

Where `chunk_if_large` has found no group larger than a chunk, whole groups are scanned by one plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 65536
#: Counters told apart when group sizes are bounded.
BUCKETS = 65536


def by_position(ord_col: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk of a dense integer order column."""
    return F.floor(F.col(ord_col) / rows).cast("long")


def chunk_if_large(df: DataFrame, keys: list[str], chunk: Column) -> Column | None:
    """`chunk`, or None if no group of `df` has more than CHUNK_ROWS rows.

    Counts are summed per hash bucket, which bounds every group in it with a few rows from each task; groups are counted
    one by one only where a bucket is too full to tell.
    """
    for group in ([F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("__bucket")], [F.col(k) for k in keys]):
        most = df.groupBy(*group).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0]
        if (most or 0) <= CHUNK_ROWS:
            return None
    return chunk


def within(lead: str, chunk: Column | None) -> Column | None:
    """The chunk of an order that begins with `lead`."""
    return None if chunk is None else F.struct(lead, chunk)


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column | None,
    *,
    running: dict[str, Column] | None = None,
    carry: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
) -> DataFrame:
    """Add order-dependent columns per group.

    keys       non-null grouping columns
    order      columns that order a group's rows without ties
    chunk      any function of `order` that never falls along it; None scans whole groups
    running    sum over the rows up to and including this one
    carry      last non-null value up to and including this row
    previous   value on the row before (null on the first row)
    following  value on the row after (null on the last row)
    """
    running, carry = running or {}, carry or {}
    previous, following = previous or {}, following or {}
    staged = {f"__v_{name}": expr for part in (running, carry, previous, following) for name, expr in part.items()}
    if chunk is None:
        return _whole_scan(df.withColumns(staged), df.columns, keys, order, running, carry, previous, following)
    base = df.withColumns({"__chunk": chunk, **staged})
    position = F.struct(*order)

    parts = []
    for name in running:
        parts.append(F.sum(f"__v_{name}").alias(f"__s_{name}"))
    for name in carry:
        v = F.col(f"__v_{name}")
        parts.append(F.max_by(v, F.when(v.isNotNull(), position)).alias(f"__s_{name}"))
    for name in previous:
        parts.append(F.max_by(F.struct(F.col(f"__v_{name}").alias("v")), position).alias(f"__s_{name}"))
    for name in following:
        parts.append(F.min_by(F.struct(F.col(f"__v_{name}").alias("v")), position).alias(f"__s_{name}"))
    summary = base.groupBy(*keys, "__chunk").agg(*parts)

    along = Window.partitionBy(*keys).orderBy("__chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    edges = {"__has_prev": F.lag("__chunk").over(along).isNotNull(),
             "__has_next": F.lead("__chunk").over(along).isNotNull()}
    for name in running:
        edges[f"__o_{name}"] = F.sum(f"__s_{name}").over(before)
    for name in carry:
        edges[f"__o_{name}"] = F.last(f"__s_{name}", ignorenulls=True).over(before)
    for name in previous:
        edges[f"__o_{name}"] = F.lag(f"__s_{name}").over(along)
    for name in following:
        edges[f"__o_{name}"] = F.lead(f"__s_{name}").over(along)
    # one-chunk groups need nothing carried in: keep them out of the join
    offsets = (summary.withColumns(edges)
               .filter(F.col("__has_prev") | (F.col("__has_next") if following else F.lit(False)))
               .select(*keys, "__chunk", *[c for c in edges if c.startswith("__o_")]))

    local = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    cols = {}
    for name in running:
        cols[f"__l_{name}"] = F.sum(f"__v_{name}").over(upto)
    for name in carry:
        cols[f"__l_{name}"] = F.last(f"__v_{name}", ignorenulls=True).over(upto)
    for name in previous:
        cols[f"__l_{name}"] = F.lag(F.struct(F.col(f"__v_{name}").alias("v"))).over(local)
    for name in following:
        cols[f"__l_{name}"] = F.lead(F.struct(F.col(f"__v_{name}").alias("v"))).over(local)
    joined = base.withColumns(cols).join(offsets, [*keys, "__chunk"], "left")

    out = {}
    for name in running:
        out[name] = F.col(f"__l_{name}") + F.coalesce(F.col(f"__o_{name}"), F.lit(0))
    for name in carry:
        out[name] = F.coalesce(F.col(f"__l_{name}"), F.col(f"__o_{name}"))
    for name in (*previous, *following):
        out[name] = F.coalesce(F.col(f"__l_{name}"), F.col(f"__o_{name}"))["v"]
    kept = [F.col(c) for c in df.columns if c not in out]
    return joined.select(*kept, *[expr.alias(name) for name, expr in out.items()])


def _whole_scan(base: DataFrame, columns: list[str], keys: list[str], order: list[str], running: dict, carry: dict, previous: dict, following: dict) -> DataFrame:
    """The scan by one window per group: one shuffle, and none where the rows lie by group already."""
    local = Window.partitionBy(*keys).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    out = {name: F.sum(f"__v_{name}").over(upto) for name in running}
    out.update({name: F.last(f"__v_{name}", ignorenulls=True).over(upto) for name in carry})
    out.update({name: F.lag(f"__v_{name}").over(local) for name in previous})
    out.update({name: F.lead(f"__v_{name}").over(local) for name in following})
    return base.select(*[c for c in columns if c not in out], *[expr.alias(name) for name, expr in out.items()])


def number_rows(df: DataFrame, keys: list[str], order: list[str], chunk: Column | None, out: str = "n") -> DataFrame:
    """1, 2, 3, ... within each group."""
    return ordered_scan(df, keys, order, chunk, running={out: F.lit(1)})
