"""Queries on facts, notes, blocks and notices."""

from pyspark.sql import functions as F

from revdiff import rules
from revdiff import snapshots as S
from revdiff.catalog.base import query
from revdiff.catalog.headers import a13, u02
from revdiff.catalog.items import KEYS, item_diff
from revdiff.catalog.tables import a04
from revdiff.catalog.texts import TOPICS, simple_facts
from revdiff.functions import fields as X
from revdiff.functions import text as T
from revdiff.operators import diff, notes as N
from revdiff.operators import notice as V
from revdiff.operators.scan import number_rows
from revdiff.sources import sinks
from revdiff.staging import stage

FACT_COLS = [*KEYS, "section", "description", "fact_type", "field", "old_value", "new_value"]


def item_facts(spark, path, base=None):
    return N.item_facts(item_diff(spark, path, base=base), KEYS)


@query("a08_item_facts")
def a08_items(spark, path):
    return item_facts(spark, path).select(*FACT_COLS)


@query("a09_section_rollup")
def a09(spark, path):
    return N.section_rollup(stage(item_facts(spark, path)))


def element_facts(spark, path, base=None):
    d = item_diff(spark, path, make=S.elements, base=base).withColumn("section", F.lit("").cast("string"))
    return N.item_facts(d, KEYS, "element_item", tidy=False).withColumn(
        "position_designation", F.concat(F.lit("E"), F.col("position").cast("string"), F.when(F.col("position") % 4 == 0, ", X1").otherwise("")))


@query("a08_element_facts")
def a08_elements(spark, path):
    return element_facts(spark, path).select(*KEYS, "description", "fact_type", "field", "old_value", "new_value")


@query("a10_element_rollup")
def a10(spark, path):
    return N.element_rollup(element_facts(spark, path))


def mixed_facts(spark, path):
    none = F.lit(None).cast("int")
    head = diff.metadata_facts(S.headers(spark, path, 1), S.headers(spark, path, 2)).select(
        "doc_id", "fact_type", F.lit("").alias("description"), "new_value", none.alias("number_old"), none.alias("number_new"),
        F.when(F.col("fact_type") == "mass_changed", 1).when(F.col("fact_type") == "scale_changed", 2).otherwise(3).alias("ord"))
    drawn = a13(spark, path).filter("has_changes").select(
        "doc_id", F.lit("graphics_changed").alias("fact_type"), F.lit("").alias("description"), F.col("change_percentage").cast("string").alias("new_value"),
        none.alias("number_old"), none.alias("number_new"), F.lit(4).alias("ord"))
    items = simple_facts(spark, path).select("doc_id", "fact_type", "description", "new_value", "number_old", "number_new",
                                             (F.lit(10) + F.coalesce("number_new", "number_old")).alias("ord"))
    moved = S.headers(spark, path, 1).select(
        "doc_id", F.lit("tech_requirement_renumbered").alias("fact_type"), F.lit("").alias("description"), F.lit(None).cast("string").alias("new_value"),
        none.alias("number_old"), none.alias("number_new"), F.lit(9).alias("ord"))
    return head.unionByName(drawn).unionByName(items).unionByName(moved)


@query("a11_family_notes")
def a11(spark, path):
    topic = T.topic_of(F.col("description"), F.col("new_value"), table=TOPICS)
    return N.family_notes(mixed_facts(spark, path), topic)


TABLE_NOTES = ('В таблице {n} в графе "Код" изменилось значение для "{k}"', 'Из таблицы {n} аннулированы записи для "{k}".', "Изменена таблица {n}",
               "Изменена таблица", "Изменена графика чертежа.", 'В таблице введены записи для "{k}"', "В таблице {m} изменились строки", "введен пункт о {k}")


def table_notes(spark, path):
    d = S.table_differences(spark, path)
    text = F.element_at(F.array(*map(F.lit, TABLE_NOTES)), ((F.col("ord") + F.col("doc_id")) % 8 + 1).cast("int"))
    for mark, value in (("{n}", (1 + F.col("doc_id") % 3).cast("string")), ("{m}", (5 + F.col("ord") % 2).cast("string")), ("{k}", F.col("v1_val"))):
        text = F.replace(text, F.lit(mark), value)
    # some documents speak of tables without details only, some of tables without numbers
    k = F.col("doc_id") % 7
    text = F.when((k <= 1) & F.contains(text, F.lit('"')), F.when(k == 0, F.lit("Изменена таблица")).otherwise(F.lit("Изменена таблица 4"))).otherwise(text)
    text = F.when((k == 0) & text.rlike("[0-9]"), F.lit("Изменились строки таблицы")).otherwise(text)
    return d.select("doc_id", "ord", text.alias("note"))


@query("a12_collapse_table_notes")
def a12(spark, path):
    return N.collapse_table_notes(table_notes(spark, path))


@query("u03_union_families")
def u03(spark, path):
    d = table_notes(spark, path)
    drawn, items = F.contains("note", F.lit("график")), F.contains("note", F.lit("пункт"))
    return N.union_families([d.filter(drawn), d.filter(items), d.filter(~drawn & ~items)])


@query("o04_note_order")
def o04(spark, path):
    d = table_notes(spark, path).withColumn("priority", N.note_priority(F.col("note")))
    chunk = F.struct("priority", F.floor(F.col("ord") / 65536))
    return number_rows(d, ["doc_id"], ["priority", "ord"], chunk, "place").orderBy("doc_id", "place")


def blocks(spark, path, version=1):
    d = S.headers(spark, path, version)
    kind = X.type_by_number(F.col("decimal_number"), F.lit(""))
    return d.select("notice_id", F.col("doc_id").alias("block_id"), kind.alias("doc_type"), "decimal_number", F.lit(rules.ACTION_REPLACE).alias("action"),
                    "title", "scale", "mass_kg", F.when(F.col("doc_id") % 2 == 0, F.lit("Журнал № 1, запись № 2.")).alias("journal_entry"))


@query("o05_block_order")
def o05(spark, path):
    d = blocks(spark, path).withColumns({"rank": N.block_rank(F.col("doc_type"), F.col("decimal_number")), "nat": N.natural_key(F.col("decimal_number"))})
    out = number_rows(d, ["notice_id"], ["rank", "nat", "doc_type", "block_id"], F.struct("rank", F.left("nat", F.lit(N.PREFIX))), "place")
    return out.select("notice_id", "block_id", "rank", "place").orderBy("notice_id", "place")


@query("o06_block_order_by_number")
def o06(spark, path):
    d = blocks(spark, path).withColumns({"base": N.natural_key(X.base_number(F.col("decimal_number"))), "rank": N.code_rank(F.col("doc_type"), F.col("decimal_number"))})
    out = number_rows(d, ["notice_id"], ["base", "rank", "decimal_number", "block_id"], F.left("base", F.lit(N.PREFIX)), "place")
    return out.select("notice_id", "block_id", "rank", "place").orderBy("notice_id", "place")


@query("p13_filled_blocks")
def p13(spark, path):
    d = blocks(spark, path)
    k = F.col("block_id") % 6
    notes = F.when(k == 1, F.array(F.lit(" "), F.lit(" x"))).when(k == 2, F.array(F.lit(" \n"))).otherwise(F.array().cast("array<string>"))
    keep = N.is_filled_block(F.when(k > 3, F.col("decimal_number")).otherwise("  "), F.when(k == 3, F.col("action")), notes, F.lit("\t"))
    return d.filter(keep).select("notice_id", "block_id")


@query("p16_search_notices")
def p16(spark, path):
    return N.search_notices(blocks(spark, path), " 77 Э4 ").select("notice_id", "block_id")


@query("j19_upsert_blocks")
def j19(spark, path):
    new = S.incoming_blocks(spark, path)
    incoming = new.select("notice_id", (F.col("doc_id") + 5000000).alias("block_id"), X.type_by_number(F.col("decimal_number"), F.lit("")).alias("doc_type"),
                          "decimal_number", "title", "scale", "mass_kg")
    return N.upsert_blocks(blocks(spark, path).select("notice_id", "block_id", "doc_type", "decimal_number", "title", "scale", "mass_kg"),
                           incoming, ["title", "scale", "mass_kg"])


def block_notes(spark, path):
    f = diff.metadata_facts(S.headers(spark, path, 1), S.headers(spark, path, 2)).join(S.headers(spark, path, 1).select("doc_id", "notice_id"), "doc_id")
    order = F.when(F.col("fact_type") == "mass_changed", 1).when(F.col("fact_type") == "scale_changed", 2).otherwise(3)
    first = F.when((F.col("doc_id") % 5 == 0) & (order == 2), F.concat(F.lit("- "), "new_value")).otherwise(F.concat_ws(" ", "fact_type", "new_value"))
    rows = F.array(F.struct(F.lit(0).alias("line_no"), first.alias("line")), F.struct(F.lit(1).alias("line_no"), F.when(F.col("doc_id") % 3 == 0, F.lit("- деталь; ")).otherwise("").alias("line")))
    return f.select("notice_id", F.col("doc_id").alias("block_id"), order.alias("note_ord"), F.explode(rows).alias("r")).select("notice_id", "block_id", "note_ord", "r.*")


@query("a18_notice_assembly")
def a18(spark, path):
    return N.assemble(blocks(spark, path), block_notes(spark, path))


def notice_blocks(spark, path):
    """Blocks of both versions' headers; every fifth document is a bill of materials."""
    fields = (["decimal_number", "title", "scale"], ["mass_kg"])
    h = diff.effective_metadata(S.headers(spark, path, 1), S.headers(spark, path, 2), "doc_id", *fields).join(S.headers(spark, path, 2).select("doc_id", "notice_id"), "doc_id")
    number = F.when(F.col("doc_id") % 5 == 0, F.concat(F.regexp_extract("decimal_number", "^[0-9]+", 0), F.lit(" СП"))).otherwise(F.col("decimal_number"))
    h = h.withColumn("decimal_number", number).join(u02(spark, path).select("doc_id", "action"), "doc_id", "left")
    return h.select("notice_id", F.col("doc_id").alias("block_id"), X.type_by_number(F.col("decimal_number"), F.lit("")).alias("doc_type"), "decimal_number",
                    F.coalesce("action", F.lit(rules.ACTION_REPLACE)).alias("action"), F.lit("").alias("journal_entry"))


@query("change_notice")
def change_notice(spark, path):
    base = stage(S.items(spark, path, 1))
    blocks = stage(notice_blocks(spark, path))
    none = F.lit(None).cast("int")
    facts = mixed_facts(spark, path).filter("fact_type <> 'graphics_changed'")
    drawn = V.graphics_facts(a13(spark, path), blocks.select(F.col("block_id").alias("doc_id"), "doc_type"))
    facts = facts.unionByName(drawn.select("doc_id", "fact_type", "description", "new_value", none.alias("number_old"), none.alias("number_new"), F.lit(4).alias("ord")))
    order = ["table_key", "column", "group_status"]
    tables = number_rows(stage(a04(spark, path, base).select("doc_id", *order, F.col("note").alias("description"))), ["doc_id"], order, F.col("table_key"), "n")
    facts = facts.unionByName(tables.select("doc_id", F.lit("table_column_changed").alias("fact_type"), "description", F.lit(None).cast("string").alias("new_value"),
                                            none.alias("number_old"), none.alias("number_new"), (F.lit(1000000) + F.col("n")).cast("int").alias("ord")))
    topic = T.topic_of(F.col("description"), F.col("new_value"), table=TOPICS)
    return V.change_notice(blocks, stage(facts), stage(item_facts(spark, path, base)), stage(element_facts(spark, path, base)), topic)


@query("s03_document_json")
def s03(spark, path):
    return sinks.document_json(S.items(spark, path, 1).select("doc_id", "ord", "section", "position", "name", "quantity"))


@query("s03_full_diff_json")
def s03_full(spark, path):
    base = stage(S.items(spark, path, 1))
    kind = F.regexp_replace("fact_type", "_changed$", "")
    head = diff.metadata_facts(S.headers(spark, path, 1), S.headers(spark, path, 2)).select(
        "doc_id", F.when(kind == "mass", 1).when(kind == "scale", 2).otherwise(3).alias("ord"), kind.alias("kind"), "new_value")
    items = simple_facts(spark, path).select("doc_id", F.coalesce("number_new", "number_old").alias("ord"), "fact_type", F.coalesce("number_new", "number_old").alias("number"))
    moves = item_facts(spark, path, base).filter("field = ''").select("doc_id", F.col("position").alias("ord"), "fact_type", "position", "section", "description")
    rows = S.table_differences(spark, path, base).select("doc_id", "ord", "table_name", "col_name", "row_key", "status")
    drawn = a13(spark, path).filter("has_changes").select("doc_id", F.lit(1).alias("ord"), "has_changes", "change_percentage")
    return sinks.json_lines({"metadata": head, "tech_requirements": items, "specification_items": moves, "tables": rows, "graphics": drawn})
