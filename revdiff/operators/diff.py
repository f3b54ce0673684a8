"""Comparison of two versions by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdiff.functions import text as T


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str],
               attrs: list[str] = (), keep_unchanged: bool = False) -> DataFrame:
    """Full outer comparison of two frames with unique keys.

    Result: keys, attrs (the new value unless empty), status, changes (field, old, new as given)
    and the rows of both versions. Values are equal when their comparison keys are.
    """
    a = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("v1"))
    b = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("v2"))
    joined = a.join(b, keys, "full_outer")

    def changed(f: str) -> Column:
        return T.compare_key(F.col(f"v1.{f}").cast("string")) != T.compare_key(F.col(f"v2.{f}").cast("string"))

    entries = [F.when(changed(f), F.struct(F.lit(f).alias("field"), F.col(f"v1.{f}").cast("string").alias("old"),
                                           F.col(f"v2.{f}").cast("string").alias("new"))) for f in fields]
    both = F.col("v1").isNotNull() & F.col("v2").isNotNull()
    changes = F.when(both, F.filter(F.array(*entries), lambda x: x.isNotNull())).otherwise(F.array())
    out = joined.withColumn("changes", changes).select(
        *keys, *[prefer_new(f"v2.{c}", f"v1.{c}").alias(c) for c in attrs],
        F.when(F.col("v2").isNull(), "removed").when(F.col("v1").isNull(), "added")
        .when(F.size("changes") > 0, "modified").otherwise("unchanged").alias("status"),
        "changes", "v1", "v2")
    return out if keep_unchanged else drop_unchanged(out)


def drop_unchanged(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("status") != "unchanged")


def key_union(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.select(*keys).union(new.select(*keys)).distinct()


def changes_text(c: str = "changes") -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat(
        x["field"], F.lit(":"), F.coalesce(x["old"], F.lit("")), F.lit(">"), F.coalesce(x["new"], F.lit("")))), ";")


def prefer_new(new, old) -> Column:
    """New value, or the old one where the new is empty."""
    return F.coalesce(F.when(F.col(new).cast("string") != "", F.col(new)), F.col(old))


def effective_metadata(old: DataFrame, new: DataFrame, key: str, texts: list[str], numbers: list[str]) -> DataFrame:
    """New header fields, filled from the old header: texts where empty, numbers only where null."""
    a, b = old.alias("a"), new.alias("b")
    return b.join(a, F.col(f"a.{key}") == F.col(f"b.{key}"), "left").select(
        F.col(f"b.{key}"), *[prefer_new(f"b.{c}", f"a.{c}").alias(c) for c in texts],
        *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in numbers])


def metadata_facts(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mass, scale and title facts; only where the new version has a value."""
    a, b = old.alias("a"), new.alias("b")

    def fact(kind: str, when: Column, was: Column, now: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("fact_type"), was.alias("old_value"), now.alias("new_value")))

    def text_fact(kind: str, c: str) -> Column:
        was, now = F.col(f"a.{c}"), F.col(f"b.{c}")
        return fact(kind, ~T.norm_or_null(was).eqNullSafe(T.norm_or_null(now)) & (F.coalesce(now, F.lit("")) != ""), was, now)

    facts = F.array(
        fact("mass_changed", ~F.col("a.mass_kg").eqNullSafe(F.col("b.mass_kg")) & F.col("b.mass_kg").isNotNull(),
             T.number_text(F.col("a.mass_kg")), T.number_text(F.col("b.mass_kg"))),
        text_fact("scale_changed", "scale"), text_fact("title_changed", "title"))
    return (a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"))
            .select(F.col(f"b.{key}").alias(key), F.explode(F.filter(facts, lambda x: x.isNotNull())).alias("f"))
            .select(key, "f.*", F.lit("metadata").alias("source")))


def clean_status_map(c: Column) -> Column:
    """Page → status map: whole-number pages, statuses `replace` and `new` only."""
    return F.map_from_entries(F.filter(
        F.transform(F.map_entries(c), lambda e: F.struct(
            T.strip(e["key"]).try_cast("int").alias("key"), F.lower(T.strip(e["value"])).alias("value"))),
        lambda e: e["key"].isNotNull() & e["value"].isin("replace", "new")))


def connection_diff(old: DataFrame, new: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document: whether any conductor changed, and the box of the first changed one in key order.

    Conductors differ by signal, by the number of pins on a side, or by a housing mark on a side.
    """
    # of pins only their number is compared, so only that is shuffled
    pins = [F.size(c).alias(c) for c in ("left_pins", "right_pins")]
    told = F.struct("signal", *pins, "left_housing", "right_housing", "bbox")
    a, b = old.select(doc, "key", told.alias("a")), new.select(doc, "key", told.alias("b"))
    joined = a.join(b, [doc, "key"], "full_outer")
    differs = reduce(lambda x, y: x | y, [
        F.coalesce("a.signal", F.lit("")) != F.coalesce("b.signal", F.lit("")),
        F.col("a.left_pins") != F.col("b.left_pins"), F.col("a.right_pins") != F.col("b.right_pins"),
        F.col("a.left_housing") != F.col("b.left_housing"), F.col("a.right_housing") != F.col("b.right_housing")])
    changed = F.col("a").isNull() | F.col("b").isNull() | differs
    box = F.coalesce("b.bbox", "a.bbox")
    return (joined.groupBy(doc)
            .agg(F.bool_or(changed).alias("has_changes"),
                 F.min_by(box, F.when(changed, F.col("key"))).alias("bbox"))
            .select(doc, "has_changes", "bbox", F.when(F.col("has_changes"), 3.0).otherwise(0.0).alias("change_percentage")))


def align_pages(old: DataFrame, new: DataFrame, doc: str = "doc_id", page: str = "page_num") -> DataFrame:
    """Pages of both versions with the score of common ones; one-sided pages are whole-page regions."""
    a, b = old.select(doc, page, F.col("score").alias("a")), new.select(doc, page, F.col("score").alias("b"))
    common = F.col("a").isNotNull() & F.col("b").isNotNull()
    return a.join(b, [doc, page], "full_outer").select(
        doc, page, F.when(common, "common").otherwise("one side").alias("presence"),
        F.when(common, F.col("b")).alias("score"))


def document_scores(pages: DataFrame, doc: str = "doc_id", threshold: float = 0.35) -> DataFrame:
    """Mean page score per document, half-even on the double to two decimals; small scores make no region.

    One-sided pages are regions and add a single score of 100 to the mean.
    """
    extra = F.col("presence") == "one side"
    hot = F.col("score") > threshold
    agg = pages.groupBy(doc).agg(
        F.sum(F.col("score").cast("decimal(18,6)")).alias("total"), F.count("score").alias("scored"),
        F.count_if(extra).alias("extra"), F.count_if(extra | hot).alias("regions"))
    one = (F.col("extra") > 0).cast("int")
    mean = (F.coalesce("total", F.lit(0)).cast("double") + one * 100.0) / (F.col("scored") + one)
    return agg.select(doc, (F.col("regions") > 0).alias("has_changes"), "regions", (F.rint(mean * 100) / 100).alias("change_percentage"))
