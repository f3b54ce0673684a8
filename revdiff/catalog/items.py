"""Queries on item lists."""

from pyspark.sql import functions as F

from revdiff import snapshots as S
from revdiff.catalog.base import query
from revdiff.functions import fields as X
from revdiff.functions import text as T
from revdiff.operators import dedupe, diff
from revdiff.sources import versions

KEYS = ["doc_id", "position"]
FIELDS = ["designation", "name", "quantity", "note"]


def unique_items(spark, path, version, make=S.items, base=None):
    """Richest item per (document, position); `base`, if given, is version 1 as staged by the caller."""
    df = make(spark, path, version, with_ord=False, base=base)
    return dedupe.keep_richest(df, KEYS, F.char_length(F.concat_ws(" ", "name", "designation"))).drop("ord")


def item_diff(spark, path, keep_unchanged=False, make=S.items, base=None):
    attrs = ["designation", "name"] + (["section"] if make is S.items else [])
    return diff.keyed_diff(unique_items(spark, path, 1, make, base), unique_items(spark, path, 2, make, base), KEYS, FIELDS,
                           attrs=attrs, keep_unchanged=keep_unchanged)


@query("s01_version_pairs")
def s01(spark, path):
    snaps = None
    for v, frame in ((1, S.parts(spark, path, 1)), (2, S.parts(spark, path, 2)), (3, S.parts(spark, path, 2).filter("key % 7 = 0"))):
        frame = frame.withColumn("doc_id", F.col("key") % 50).filter(F.lit(v) <= 1 + F.col("doc_id") % 3).withColumn("version", F.lit(v))
        snaps = frame if snaps is None else snaps.unionByName(frame)
    return versions.version_pairs(snaps).select("doc_id", "version", "side", "key", "name", "size")


@query("p01_drop_unchanged")
def p01(spark, path):
    d = diff.keyed_diff(S.parts(spark, path, 1), S.parts(spark, path, 2), ["key"], ["name", "size"], keep_unchanged=True)
    return diff.drop_unchanged(d).select("key", "status", diff.changes_text().alias("changes"))


@query("j01_keyed_diff")
def j01(spark, path):
    return item_diff(spark, path).select(*KEYS, "section", "designation", "name", "status", diff.changes_text().alias("changes"))


@query("j02_element_diff")
def j02(spark, path):
    return item_diff(spark, path, keep_unchanged=True, make=S.elements).select(
        *KEYS, "name", "status", diff.changes_text().alias("changes"))


@query("u01_key_union")
def u01(spark, path):
    return diff.key_union(S.items(spark, path, 1, False), S.items(spark, path, 2, False), KEYS)


@query("a01_merge_texts")
def a01(spark, path):
    return dedupe.merge_texts(S.items(spark, path, 1), KEYS, FIELDS).select(*KEYS, "section", *FIELDS)


@query("a02_keep_richest")
def a02(spark, path):
    return unique_items(spark, path, 2).select(*KEYS, "section", *FIELDS, "page_num")


@query("p09_item_quality")
def p09(spark, path):
    d = item_diff(spark, path).withColumn("clean", X.clean_item_name(F.col("name")))
    qty = F.coalesce("v2.quantity", "v1.quantity")
    odd = F.when(F.col("position") % 5 == 0, F.concat(qty, F.lit("-шт"))).otherwise(F.concat(qty, F.lit(" шт.")))
    one = d.filter("status <> 'modified'").withColumn("odd", odd).select(
        *KEYS, "status", F.lit("").alias("field"), X.item_drop_reason(F.col("section"), F.col("clean"), F.col("odd")).alias("reason"))
    many = d.filter("status = 'modified'").select(*KEYS, "status", "section", "clean", F.explode("changes").alias("c")).select(
        *KEYS, "status", F.col("c.field").alias("field"),
        X.change_drop_reason(F.col("section"), F.col("clean"), F.col("c.field"), F.col("c.old"), F.col("c.new")).alias("reason"))
    return one.unionByName(many)


@query("f14_keys")
def f14(spark, path):
    d = S.items(spark, path, 1)
    return d.select("doc_id", "ord", X.item_key(F.col("section"), F.when(F.col("ord") % 3 > 0, F.col("position").cast("string")),
                                                F.when(F.col("ord") % 2 > 0, F.col("designation")), F.col("name")).alias("item_key"),
                    X.element_key(F.concat(F.lit("E "), F.col("position").cast("string"), F.lit(" , X1"))).alias("element_key"))


@query("f15_field_cleaning")
def f15(spark, path):
    d = S.items(spark, path, 1)
    k = F.col("ord") % 6
    dirty = F.concat("name", F.when(k == 0, " Лист 3").when(k == 1, " / - ( x )").when(k == 2, " ;;  .").when(k == 3, " Формат A4 x")
                     .when(k == 4, " Кабель КМ 5").otherwise(" ,a- 1"))
    des = F.concat("designation", F.when(k == 0, "-").when(k == 1, ".434 ТУ 12").otherwise(""))
    broken = F.when(k == 0, F.concat("name", F.lit(" ТМАРК- 123-12345678-1234 x"))).otherwise(F.col("name"))
    joined_des, joined_name = X.rejoin_designation(des, broken)
    staged = d.withColumns({"clean": X.clean_item_name(F.col("name")), "clean_des": X.clean_item_name(des)})
    return staged.select("doc_id", "ord", X.clean_field(dirty).alias("field"), X.clean_item_name(dirty).alias("item_name"),
                         joined_des.alias("designation"), joined_name.alias("name"),
                         X.added_display_name(F.col("clean"), F.col("clean_des")).alias("added_name"))


@query("f16_quantities")
def f16(spark, path):
    d = S.items(spark, path, 1)
    qty = F.concat("quantity", F.when(F.col("ord") % 3 == 0, "м").when(F.col("ord") % 3 == 1, " шт").otherwise("кг2м"))
    pos = F.concat_ws(" , ", "note", "designation", F.when(F.col("ord") % 2 == 0, F.col("note")), "quantity")
    return d.select("doc_id", "ord", T.space_units(qty).alias("spaced"), T.space_last_unit(qty).alias("last_spaced"),
                    F.array_join(T.split_positions(pos), "|").alias("positions"),
                    T.number_text(F.col("quantity").cast("double") / 8).alias("number"),
                    F.col("note").try_cast("int").alias("as_int"))


@query("j04_connection_diff")
def j04(spark, path):
    def conductors(version):
        d = unique_items(spark, path, version)
        qty, pos = F.col("quantity").cast("int"), F.col("position").cast("int")
        return d.select("doc_id", F.lpad(pos.cast("string"), 3, "0").alias("key"), F.col("name").alias("signal"),
                        F.array_repeat(F.lit("p"), qty % 5).alias("left_pins"), F.array_repeat(F.lit("p"), qty % 3).alias("right_pins"),
                        (F.col("note") == "A").alias("left_housing"), (F.col("note") == "X").alias("right_housing"),
                        F.struct((pos * 10).alias("x"), (pos * 7).alias("y"), F.lit(8).alias("w"), F.lit(4).alias("h")).alias("bbox"))
    return diff.connection_diff(conductors(1), conductors(2)).select(
        "doc_id", "has_changes", "change_percentage", F.col("bbox.x").alias("x"), F.col("bbox.y").alias("y"))
