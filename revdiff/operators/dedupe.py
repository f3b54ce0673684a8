"""One row per key: keep the richest (A2), merge texts (A1), last wins (U4), ordered distinct."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdiff.operators.scan import chunk_if_large


def keep_richest(df: DataFrame, keys: list[str], score: Column, ord_col: str = "ord") -> DataFrame:
    """Row with the highest score per key, the earliest on ties. An aggregate, so copies of one key
    are combined before the shuffle. The order travels once: as a column of the result it is an aggregate of its own, which goes where nobody reads it."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct((-score).alias("s"), F.col(ord_col).alias("o"))
    best = F.min_by(F.struct(*[c for c in rest if c != ord_col]), rank)
    return df.groupBy(*keys).agg(best.alias("__b"), F.min(rank).alias("__r")).select(*keys, *[F.col("__r.o").alias(c) if c == ord_col else F.col(f"__b.{c}") for c in rest])


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key, as when numbered sets are merged and later ones override."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__b"))
            .select(*keys, *[F.col(f"__b.{c}") for c in rest]))


def merge_texts(df: DataFrame, keys: list[str], fields: list[str], ord_col: str = "ord", firsts: list[str] = (), whole: bool | None = None) -> DataFrame:
    """First row per key, each text field extended by later texts it does not contain yet, and the first value of each column of `firsts`.

    A text seen before is always contained, so where keys repeat much equal texts of a key are combined first and only
    distinct ones meet in a task. Where no key has more rows than a chunk (`whole`; counted if not given) its rows meet at once: one shuffle, and none where
    they lie by some of the keys already. Rows with a null key have no texts.
    """
    rest = [c for c in df.columns if c not in keys and c not in fields and c not in firsts]
    told = [F.min_by(F.struct(*rest), F.col(ord_col)).alias("__b"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ord_col))).alias(c) for c in firsts]]

    def fold(c: Column) -> Column:
        return F.aggregate(c, F.lit(""), lambda acc, x: F.when(acc == "", x["v"])
                           .when(F.contains(acc, x["v"]), acc).otherwise(F.concat_ws(" ", acc, x["v"])))

    if whole is None:
        whole = chunk_if_large(df, keys, F.lit(0)) is None
    if whole:
        joined = df.groupBy(*keys).agg(*told, F.collect_list(F.struct(F.col(ord_col).alias("__o"), *fields)).alias("__t"))
        named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])

        def text(f: str) -> Column:
            listed = F.sort_array(F.filter(F.transform("__t", lambda r: F.struct(r["__o"].alias("o"), r[f].alias("v"))), lambda x: x["v"] != ""))
            return F.when(named, F.when(F.size("__t") == 1, F.col("__t")[0][f]).otherwise(fold(listed)))
    else:
        stacked = df.select(*keys, F.col(ord_col).alias("__o"), F.explode(F.array(*[
            F.struct(F.lit(f).alias("f"), F.coalesce(f, F.lit("")).alias("v")) for f in fields])).alias("__t"))
        distinct = (stacked.filter(F.col("__t.v") != "").groupBy(*keys, "__t")
                    .agg(F.min("__o").alias("__o")))
        listed = distinct.groupBy(*keys).agg(*[
            F.array_sort(F.collect_list(F.when(F.col("__t.f") == f, F.struct("__o", F.col("__t.v").alias("v"))))).alias(f)
            for f in fields])
        joined = df.groupBy(*keys).agg(*told).join(listed, keys, "left")

        def text(f: str) -> Column:
            return fold(F.coalesce(F.col(f), F.array()))

    return joined.select(*keys, *[F.col(f"__b.{c}") for c in rest], *firsts, *[F.nullif(text(f), F.lit("")).alias(f) for f in fields])


def ordered_distinct(df: DataFrame, keys: list[str], text: str, ord_col: str, norm: Column) -> DataFrame:
    """First spelling of each text per group, compared by `norm`; blank ones dropped."""
    return (df.withColumn("__n", norm).filter(F.col("__n") != "")
            .groupBy(*keys, "__n")
            .agg(F.min_by(text, ord_col).alias(text), F.min(ord_col).alias(ord_col)).drop("__n"))
