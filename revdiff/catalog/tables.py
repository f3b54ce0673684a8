"""Queries on tables of cells and on table differences."""

from pyspark.sql import functions as F

from revdiff import rules
from revdiff import snapshots as S
from revdiff.catalog.base import query
from revdiff.functions import fields as X
from revdiff.functions import text as T
from revdiff.operators import lists, pairing, table_facts, tables
from revdiff.operators.scan import by_position, chunk_if_large
from revdiff.staging import stage

FILL = (*rules.FILL_COLUMNS, "наимен")



def dealt(d):
    """Staged differences with their order and chunk; where no document is large they lie by document, so that scans within it need no shuffle."""
    chunk = chunk_if_large(d, ["doc_id"], by_position("ord"))
    return (d.repartition("doc_id") if chunk is None else d), ["ord"], chunk


def compare_rows(spark, path, version, base=None):
    rows = tables.data_rows(S.table_rows(spark, path, version, base), "table_id", S.TABLE_COLUMNS)
    return tables.fill_down(rows, "table_id", S.TABLE_COLUMNS, 5, FILL)


@query("p02_clean_rows")
def p02(spark, path):
    r = S.table_rows(spark, path, 1)
    dirty = F.transform("cells", lambda c: F.when(F.col("row_index") % 9 == 0, F.lit(" \t")).otherwise(
        F.concat(F.lit("  "), F.regexp_replace(c, " ", "  "), F.lit("\t"))))
    return tables.clean_rows(r.withColumn("cells", dirty)).select("table_id", "row_index", F.array_join("cells", "|").alias("cells"))


@query("p07_repeated_header")
def p07(spark, path):
    r = S.table_rows(spark, path, 1)
    cells = F.when(F.col("row_index") % 7 == 0, F.concat(F.array(F.lit(" КОД"), F.lit("Кол .")), F.slice("cells", 3, 3))).when(
        F.col("row_index") % 11 == 0, F.concat(F.array(F.lit("Код")), F.slice("cells", 2, 4))).otherwise(F.col("cells"))
    r = r.withColumns({"cells": F.transform(cells, T.norm_cell), "words": X.header_words(S.column_names())})
    return r.select("table_id", "row_index", X.is_repeated_header(F.col("cells"), F.col("words")).alias("is_header"))


@query("p10_table_family")
def p10(spark, path):
    d = S.table_differences(spark, path)
    return d.select("doc_id", "ord", X.is_wire_table_name(F.col("table_name")).alias("wire_table"),
                    X.is_wire_connection(F.col("table_name"), F.col("names")).alias("wire_connection"),
                    X.is_wire_column(F.col("col_name")).alias("wire_column"), X.has_wire_key(F.col("names")).alias("wire_key"),
                    X.is_unnumbered(F.col("row_key")).alias("unnumbered"), X.is_connection_column(F.col("col_name")).alias("connection"),
                    X.is_marking_column(F.col("col_name")).alias("marking"),
                    X.looks_like_header_row(F.concat(F.array("col_name"), F.col("values"))).alias("header_row"),
                    X.marking_row_key(F.concat(F.lit(" ."), F.col("row_key"), F.lit(";"))).alias("marking_key"))


@query("f11_table_headers")
def f11(spark, path):
    r = S.document_tables(spark, path)
    named = F.when(F.col("table_id") % 3 == 0, F.lit("Провод / Длина")).otherwise(F.col("name"))
    return r.select("table_id", X.header_key(F.col("names")).alias("header_key"), X.named_table_number(F.col("name")).alias("own_number"),
                    X.table_number(named, F.col("names")).alias("number"), X.table_key(named).alias("table_key"),
                    F.array_join(F.transform("names", X.canon_header), "|").alias("canon"))


@query("f12_table_heads")
def f12(spark, path):
    first = S.table_rows(spark, path, 1).filter("row_index <= 5").groupBy("table_id").agg(
        F.array_sort(F.collect_list(F.struct("row_index", "cells"))).alias("r"))
    t = first.select("table_id", F.transform("r", lambda x: x["cells"]).alias("rows"))
    k = F.col("table_id")
    second = F.when(k % 3 == 0, F.array(F.array(*map(F.lit, ["", "", "L, мм", "", "XS1"])))).when(
        k % 3 == 1, F.array(F.array(*map(F.lit, ["001", "a", "код", "1", "2"])))).otherwise(F.array().cast("array<array<string>>"))
    t = t.withColumn("rows", F.concat(F.slice("rows", 1, 1), second, F.slice("rows", 2, 3))).withColumn("depth", tables.header_depth(F.col("rows")))
    names = tables.built_column_names(F.col("rows"), F.col("depth"), F.lit(6))
    above = F.when(k % 4 == 0, F.array(F.lit("Таблица 7 x"), F.lit("продолжение таблицы 9"), F.lit("y"))).otherwise(F.array(F.lit("y")))
    return t.select("table_id", "depth", F.array_join(names, "|").alias("names"),
                    tables.table_name(above, F.when(k % 5 > 0, F.col("rows")[0]), k % 9).alias("name"))


@query("f13_row_keys")
def f13(spark, path):
    r = S.table_rows(spark, path, 1)
    k = F.col("table_id") % 4
    names = F.when(k == 0, F.array(*map(F.lit, ["Обозначение провода", "Исп.", "Номер", "Поз.", "Код"]))).when(
        k == 1, F.array(*map(F.lit, ["a", "b", "Обозначение", "c", "d"]))).when(k == 2, F.array(*map(F.lit, ["a", "b", "c", "d", "e"]))).otherwise(S.column_names())
    d = r.filter("row_index > 1").withColumn("names", names).withColumns(
        {"key_col": X.key_column(F.col("names")), "words": X.header_words(F.col("names"))})
    return d.select("table_id", "row_index", "key_col", X.row_key(F.col("cells"), F.col("words"), F.col("key_col")).alias("row_key"))


@query("f19_connector")
def f19(spark, path):
    d = S.table_differences(spark, path)
    text = F.concat_ws(" / ", "col_name", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("хs"), F.col("v1_val"), F.lit(" b"))), F.lit("LAN 4"))
    return d.select("doc_id", "ord", X.connector_of(text).alias("connector"))


@query("w05_data_rows")
def w05(spark, path):
    d = tables.data_rows(S.table_rows(spark, path, 1), "table_id", S.TABLE_COLUMNS)
    return d.select("table_id", "row_index", "row_key", "base_key", "occ")


@query("w06_fill_down")
def w06(spark, path):
    return compare_rows(spark, path, 1).select("table_id", "row_index", F.array_join("cells", "|").alias("cells"))


@query("w04_neighbour_rows")
def w04(spark, path):
    n = tables.neighbour_rows(S.table_rows(spark, path, 1), "table_id")
    return n.select("table_id", "row_index", F.array_join("prev_cells", "|").alias("prev_cells"), F.array_join("next_cells", "|").alias("next_cells"))


@query("j03_cell_diff")
def j03(spark, path):
    base = stage(S.items(spark, path, 1))
    keep = ["table_name", "page_num"]
    both = [S.table_rows(spark, path, v, base) for v in (1, 2)]
    rows = both[0].withColumn("version", F.lit(1)).unionByName(both[1].withColumn("version", F.lit(2)))
    if chunk_if_large(rows.select("table_id"), ["table_id"], F.lit(0)) is None:
        keyed = tables.data_rows(rows, "table_id", S.TABLE_COLUMNS, also=["version"])
        filled = tables.fill_down(keyed, "table_id", S.TABLE_COLUMNS, 5, FILL, also=["version"])
        return tables.cell_diff_by_table(filled, "table_id", S.TABLE_COLUMNS, keep).drop("base_key")
    a, b = (compare_rows(spark, path, v, base) for v in (1, 2))
    d = tables.cell_diff(a, b, "table_id", S.TABLE_COLUMNS, keep)
    return tables.with_table_sizes(d, a, b, "table_id").drop("base_key")


def subjects(spark, path, base=None):
    return stage(table_facts.with_subjects(S.table_differences(spark, path, base)))


@query("j14_counted_cancellation")
def j14(spark, path):
    return table_facts.drop_wire_artefacts(*dealt(subjects(spark, path))).select("doc_id", "ord", "table_key", "subject", "status")


@query("j15_two_sided_cancellation")
def j15(spark, path):
    return table_facts.cancel_both_sides(*dealt(subjects(spark, path))).select("doc_id", "ord", "table_key", "subject", "status")


def cleaned(spark, path, base=None):
    d, *by = dealt(subjects(spark, path, base))
    return stage(table_facts.cancel_both_sides(table_facts.drop_wire_artefacts(d, *by), *by)), *by


@query("a05_wire_rollup")
def a05(spark, path):
    return table_facts.wire_rollup(*dealt(subjects(spark, path)))


@query("a06_whole_column")
def a06(spark, path):
    return table_facts.column_groups(*dealt(subjects(spark, path))).select(
        "doc_id", "table_key", "column", "group_status", "changes", "subjects", "table_rows", "whole_column")


@query("a04_column_facts")
def a04(spark, path, base=None):
    d = cleaned(spark, path, base)
    return table_facts.column_facts(table_facts.column_groups(*d), table_facts.wire_rollup(*d))


@query("a04_fact_values")
def a04_values(spark, path):
    d, *by = cleaned(spark, path)
    return table_facts.fact_values(d, *by, table_facts.introduced_wires(d, ["ord"]))


@query("a07_marking_tables")
def a07(spark, path):
    return table_facts.marking_lines(*dealt(stage(S.table_differences(spark, path))))


@query("w12_range_compression")
def w12(spark, path):
    s = S.numeric_subjects(spark, path)
    return lists.compress_ranges(s, ["doc_id"], ["subject"], F.left("subject", F.lit(2))).select(
        "doc_id", F.col("place.subject").alias("first"), "item", "records")


@query("o07_top_with_rest")
def o07(spark, path):
    s = S.numeric_subjects(spark, path)
    t = lists.top_with_rest(lists.compress_ranges(s, ["doc_id"], ["subject"], F.left("subject", F.lit(2))), ["doc_id"])
    return t.select("doc_id", "n_items", "n_records", lists.quoted_list(F.col("top"), F.col("rest_records")).alias("listed"),
                    lists.wire_list(F.col("top"), F.col("rest_items")).alias("wires"))


def merged_tables(spark, path):
    base = stage(S.items(spark, path, 1))
    return tables.merge_continued(S.document_tables(spark, path, base=base), S.table_rows(spark, path, 1, base).select("table_id", "row_index", "cells"))


@query("a03_merge_continued")
def a03(spark, path):
    t, r = merged_tables(spark, path)
    n = r.groupBy("table_id").agg(F.count("*").alias("n_rows"), F.max("row_index").alias("last_row"))
    return t.join(n, "table_id", "left").select("doc_id", "table_id", "page_num", "x0", "y0", "x1", "y1", "name",
                                                F.size("names").alias("width"), "pieces", "n_rows", "last_row")


@query("a03_merged_rows")
def a03_rows(spark, path):
    _, r = merged_tables(spark, path)
    return r.select("table_id", "row_index", F.array_join("cells", "|").alias("cells"))


def ordered_tables(spark, path, version, base=None):
    return S.document_tables(spark, path, version, base).withColumn("ord", F.col("table_id") % 8)


@query("j09_table_pairing")
def j09(spark, path):
    return pairing.pair_tables(ordered_tables(spark, path, 1), ordered_tables(spark, path, 2))


@query("j09_table_pairing_tokens")
def j09_tokens(spark, path):
    return pairing.pair_tables(ordered_tables(spark, path, 1), ordered_tables(spark, path, 2), pairing.token_share)


@query("j03_table_diff")
def j03_tables(spark, path):
    base = stage(S.items(spark, path, 1))
    old, new = (stage(ordered_tables(spark, path, v, base)) for v in (1, 2))
    pairs = stage(pairing.pair_tables(old, new, pairing.token_share))
    rows = [S.table_rows(spark, path, v, base) for v in (1, 2)]
    d = tables.diff_tables(old, rows[0], new, rows[1], pairs, FILL)
    lists = [c for c, t in d.dtypes if t == "array<string>"]
    return d.select(*[F.array_join(c, "|").alias(c) if c in lists else F.col(c) for c in d.columns if c != "base_key"])
