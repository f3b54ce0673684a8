"""From facts to notes and notices.

A note is a set of line rows (keys, line_no, line), line 0 being its head, so notes and notices of
any length stay distributed; nothing gathers a document's notes in one cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revdiff import rules
from revdiff.functions import fields as X
from revdiff.functions import text as T
from revdiff.operators.lists import bullet, bullets
from revdiff.operators.scan import by_position, chunk_if_large, number_rows, ordered_scan
from revdiff.staging import stage

#: Characters of a sort key that name its chunk in ordered scans; any prefix of the key keeps its order.
PREFIX = 19


# ---- facts of items and elements (A8) --------------------------------------------------------

def item_facts(diff: DataFrame, keys: list[str], prefix: str = "spec_item", tidy: bool = True) -> DataFrame:
    """A fact per added or removed item and per changed field; with `tidy`, noise is left out."""
    named = diff.withColumn("description", F.coalesce(F.nullif("name", F.lit("")), "designation"))
    named = named.withColumn("clean", X.clean_item_name(F.col("description")))
    base = [*keys, "section", "designation", "description", "clean"]
    none = F.lit(None).cast("string")
    moves = named.filter(F.col("status").isin("added", "removed")).select(
        *base, F.concat(F.lit(prefix + "_"), F.col("status")).alias("fact_type"), F.lit("").alias("field"),
        F.when(F.col("status") == "removed", T.norm_or_null(F.col("v1.quantity"))).otherwise(none).alias("old_value"),
        F.when(F.col("status") == "added", T.norm_or_null(F.col("v2.quantity"))).otherwise(none).alias("new_value"))
    changes = named.filter("status = 'modified'").select(*base, F.explode("changes").alias("c"))
    kind = F.when(F.col("c.field").isin("quantity", "note") | ((F.col("c.field") == "name") & F.lit(prefix == "element_item")),
                  F.concat(F.lit(prefix + "_"), F.col("c.field"), F.lit("_changed"))).otherwise(prefix + "_modified")
    changed = changes.select(*base, kind.alias("fact_type"), F.col("c.field").alias("field"), T.norm_or_null(F.col("c.old")).alias("old_value"),
                             T.norm_or_null(F.col("c.new")).alias("new_value"))
    if tidy:
        moves = moves.filter(X.item_drop_reason(F.col("section"), F.col("clean"), F.coalesce("old_value", "new_value")).isNull())
        changed = changed.filter(X.change_drop_reason(F.col("section"), F.col("clean"), F.col("field"), F.col("old_value"), F.col("new_value")).isNull())
    return moves.unionByName(changed)


# ---- headed bullet notes ---------------------------------------------------------------------

def headed(items: DataFrame, keys: list[str], order: list[str], chunk: Column, head: Column) -> DataFrame:
    """Distinct items of each group as bullets under a head line."""
    item = X.clean_item_name(F.col("item"))
    distinct = stage(items.withColumns({"item": item, "__n": F.lower(item)}).filter("__n <> ''").groupBy(*keys, "__n")
                     .agg(F.min_by("item", F.struct(*order)).alias("item"), F.min(F.struct(*order)).alias("p")).select(*keys, "item", "p.*"))
    heads = distinct.select(*keys).distinct().select(*keys, F.lit(0).alias("line_no"), head.alias("line"))
    return heads.unionByName(bullets(distinct, keys, order, chunk))


def section_rollup(facts: DataFrame, order: str = "position") -> DataFrame:
    """Per section and kind the items whose quantity changed, that came, went, or changed format."""
    section = F.coalesce(F.nullif(X.clean_item_name(F.col("section")), F.lit("")), F.lit("Раздел"))
    kind = (F.when(F.col("fact_type") == "spec_item_quantity_changed", 1).when(F.col("fact_type") == "spec_item_added", 2)
            .when(F.col("fact_type") == "spec_item_removed", 3)
            .when((F.col("fact_type") == "spec_item_modified") & (F.col("field") == "format"), 4))
    staged = facts.withColumns({"section": section, "kind": kind, "des": X.clean_item_name(F.col("designation")),
                                "qty": T.space_last_unit(F.coalesce("new_value", "old_value"))}).filter("kind is not null")
    counted = F.when(X.is_plausible_quantity(F.col("qty")), F.concat(F.lit(", количество "), F.col("qty"))).otherwise("")
    item = (F.when(F.col("kind") == 1, F.concat(X.display_name(F.col("clean"), F.col("des")), F.lit(" на "), F.col("qty")))
            .when(F.col("kind") == 4, F.concat(F.col("clean"), F.lit(" на "), F.col("qty")))
            .otherwise(F.concat(X.added_display_name(F.col("clean"), F.col("des")), counted)))
    verb = (F.when(F.col("kind") == 1, "изменено количество:").when(F.col("kind") == 2, "введена применяемость:")
            .when(F.col("kind") == 3, "аннулирована применяемость:").otherwise("изменен формат документа:"))
    keys = ["doc_id", "kind", "section"]
    return headed(staged.select(*keys, order, item.alias("item")), keys, [order], by_position(order),
                  F.concat(F.lit('В разделе "'), F.col("section"), F.lit('" '), verb))


def element_rollup(facts: DataFrame, order: str = "position") -> DataFrame:
    """A10: notes on renamed, removed and added elements, changed quantities and notes.

    Lines: doc_id, family, place (orders notes of a family), line_no, line.
    """
    positions = T.split_positions(F.col("position_designation"))
    quoted = F.array_join(F.transform("__p", lambda p: F.concat(F.lit('"'), p, F.lit('"'))), ", ")
    where = F.concat(F.when(F.size("__p") > 1, " для позиционных обозначений ").otherwise(" для позиционного обозначения "), quoted)
    name = F.col("clean")
    family = (F.when(F.col("fact_type") == "element_item_name_changed", 1).when(F.col("fact_type") == "element_item_removed", 2)
              .when(F.col("fact_type") == "element_item_added", 3).when(F.col("fact_type") == "element_item_quantity_changed", 4)
              .when(F.col("fact_type") == "element_item_note_changed", 5))
    staged = stage(facts.withColumns({"family": family, "__p": positions}).filter("family is not null"))
    line = (F.when(F.col("family") == 1, F.concat(F.lit("Изменено наименование элемента"), where))
            .when(F.col("family") == 2, F.concat(F.lit('Аннулирована применяемость элемента "'), name, F.lit('"'), where))
            .otherwise(F.concat_ws(" ", F.lit("Введена применяемость"), F.nullif(name, F.lit("")))))
    single = (staged.filter("family <= 3").withColumn("line", F.concat(line, F.lit("."))).withColumn("__n", F.lower(T.squeeze(F.col("line"))))
              .groupBy("doc_id", "family", "__n").agg(F.min_by("line", order).alias("line"), F.min(order).alias("place"))
              .select("doc_id", "family", "place", F.lit(0).alias("line_no"), "line"))
    qty = headed(staged.filter("family = 4").select("doc_id", order, F.concat(name, F.lit(" на "), F.coalesce(T.space_last_unit(F.col("new_value")), F.lit("—"))).alias("item")),
                 ["doc_id"], [order], by_position(order), F.lit("Изменено количество элементов:"))
    noted = staged.filter("family = 5").select("doc_id").distinct().select("doc_id", F.lit(0).alias("line_no"), F.lit('В графе "Примечание" изменены данные элементов.').alias("line"))
    zero = F.lit(0).cast("int")
    return single.unionByName(qty.select("doc_id", F.lit(4).alias("family"), zero.alias("place"), "line_no", "line")).unionByName(
        noted.select("doc_id", F.lit(5).alias("family"), zero.alias("place"), "line_no", "line"))


# ---- generic rollup (A11, U3, O4) ------------------------------------------------------------

def short_table_note(c: Column) -> Column:
    """Detailed table notes as they are, others as `Изменена таблица N.`."""
    text = T.squeeze(F.coalesce(c, F.lit("")))
    low = T.lower_plain(text)
    detailed = ((F.contains(low, F.lit("в графе")) & F.contains(low, F.lit("измен"))) | T.contains_any(low, (
        "введены записи", "введены провода", "аннулированы записи", "изменена маркировка")) | T.starts_with_any(low, ("для ", "изменилась маркировка для")))
    fixed = F.regexp_replace(text, r"(?iu)^В\s+таблице\s+(?=введены|в графе)", "В таблице 1 ")
    fixed = F.regexp_replace(fixed, r"(?iu)^Из\s+таблицы\s+(?=аннулированы)", "Из таблицы 1 ")
    dotted = F.when(F.endswith(fixed, F.lit(".")), fixed).otherwise(F.concat(fixed, F.lit(".")))
    number = X.extract(text, r"(?iu)таблиц[аые]?\s+(\d+)")
    return F.when((text != "") & detailed, dotted).otherwise(F.concat(F.concat_ws(" ", F.lit("Изменена таблица"), number), F.lit(".")))


def family_notes(facts: DataFrame, topic: Column | None = None) -> DataFrame:
    """Notes of the remaining fact kinds with their family: header data 1, graphics 2, tables 3,
    requirement items 4. Facts carry doc_id, fact_type, description, new_value, number_old,
    number_new and ord."""
    from revdiff.operators.requirements import requirement_phrase

    moved = F.col("fact_type") == "tech_requirement_renumbered"
    told = facts.filter(F.startswith("fact_type", F.lit("tech_requirement")) & ~moved).select("doc_id").distinct()
    # renumbering is worth a note only where no requirement itself has changed
    facts = facts.filter(~moved).unionByName(facts.filter(moved).join(told, "doc_id", "left_anti"))
    topic = T.topic_of(F.col("description"), F.col("new_value")) if topic is None else topic
    kind, new = F.col("fact_type"), F.col("new_value")
    told = F.coalesce(new, F.lit("")) != ""
    number = F.coalesce("number_new", "number_old")
    line = (F.when((kind == "mass_changed") & told, F.concat(F.lit('В основной надписи в графе "Масса" изменено значение на '), new, F.lit(" кг.")))
            .when((kind == "scale_changed") & told, F.concat(F.lit('В основной надписи в графе "Масштаб" изменено значение на '), new, F.lit(".")))
            .when((kind == "title_changed") & told, F.concat(F.lit('В основной надписи изменено наименование на "'), new, F.lit('".')))
            .when(kind == "graphics_changed", "Изменена графика чертежа.")
            .when(kind.isin("table_changed", "table_column_changed"), short_table_note(F.col("description")))
            .otherwise(requirement_phrase(kind, number, topic)))
    family = (F.when(kind.isin("mass_changed", "scale_changed", "title_changed"), 1).when(kind == "graphics_changed", 2)
              .when(kind.isin("table_changed", "table_column_changed"), 3).otherwise(4))
    step = F.when(kind == "tech_requirement_added", 1).when(kind == "tech_requirement_removed", 2).otherwise(3)
    notes = facts.select("doc_id", "ord", family.alias("family"), F.when(family == 4, step).otherwise(0).alias("step"), line.alias("note")).filter("note is not null")
    return (notes.withColumn("__n", F.lower(T.squeeze(F.col("note")))).groupBy("doc_id", "family", "__n")
            .agg(F.min_by("note", F.struct("step", "ord")).alias("note"), F.min(F.struct("step", "ord")).alias("p"))
            .select("doc_id", "family", "p.*", "note"))


def union_families(frames: list[DataFrame]) -> DataFrame:
    """Note frames one after the other; `family` keeps the order."""
    return reduce(DataFrame.unionByName, [f.withColumn("family", F.lit(i)) for i, f in enumerate(frames, 1)])


def note_priority(c: Column) -> Column:
    """Graphics, tables, requirements, header data, the rest."""
    low = F.lower(F.trim(c))
    return (F.when(F.contains(low, F.lit("график")), 10).when(F.contains(low, F.lit("таблиц")), 20)
            .when(T.starts_with_any(low, ("изменены тт", "изменены технические требования")) | F.contains(low, F.lit("пункт")), 30)
            .when(F.contains(low, F.lit("основной надписи")), 40).otherwise(90))


# ---- table notes (A12) -----------------------------------------------------------------------

def collapse_table_notes(notes: DataFrame) -> DataFrame:
    """One note per table number: a single body in one line, several as bullets.

    Notes: doc_id, ord, note. Lines: doc_id, ord (place of the first note), line_no, line. A general
    mention of a table goes if it has details; notes on other things pass unchanged.
    """
    inside, outside = r"(?iu)^В\s+таблице(?:\s+(\d+))?\s+(.+)$", r"(?iu)^Из\s+таблицы(?:\s+(\d+))?\s+(.+)$"
    # every pattern is matched once per note, and what it finds is all that is staged
    read = notes.withColumn("text", F.trim("note")).withColumn("low", T.lower_plain(F.col("text")))
    read = read.withColumn("related", F.contains("low", F.lit("таблиц")) | F.startswith("low", F.lit("изменилась маркировка для")) | F.contains("low", F.lit("изменена маркировка")))
    read = read.withColumn("short", F.when(F.col("related"), short_table_note(F.col("text"))))
    read = read.withColumns({"b_in": F.regexp_extract("short", inside, 2), "b_out": F.regexp_extract("short", outside, 2)}).withColumn("low_in", T.lower_plain(F.col("b_in")))
    read = read.withColumns({
        "is_in": F.contains("low_in", F.lit("в графе")) | T.starts_with_any(F.col("low_in"), ("введены", "изменена маркировка", "изменилась маркировка")),
        "is_out": F.startswith(T.lower_plain(F.col("b_out")), F.lit("аннулированы"))})
    is_in, is_out = F.col("is_in"), F.col("is_out")
    kind = (F.when(~F.col("related"), "other").when(is_in | is_out, "detail")
            .when(~F.contains(T.lower_plain(F.col("short")), F.lit("в графе")), "general"))
    number = F.coalesce(F.when(is_in, F.nullif(F.regexp_extract("short", inside, 1), F.lit(""))),
                        F.when(is_out, F.nullif(F.regexp_extract("short", outside, 1), F.lit(""))), F.lit("1"))
    body = T.lower_first(T.strip(F.when(is_in, F.col("b_in")).otherwise(F.col("b_out")), " .;"))
    # no filter here: it would be pushed below, with all patterns spelt out in it once more
    read = read.withColumn("kind", kind)
    told = stage(read.select(
        "doc_id", "ord", "kind",
        F.when(F.col("kind") == "detail", number).when(F.col("kind") == "general", X.extract(F.col("short"), r"(?iu)таблиц[аые]?\s+(\d+)")).alias("number"),
        F.when(F.col("kind") == "detail", body).when(F.col("kind") == "other", F.col("text")).alias("item")))
    keys = ["doc_id", "number"]
    detail = told.filter("kind = 'detail'").withColumn("__n", F.lower("item")).filter("__n <> ''").drop("kind")
    chunk = chunk_if_large(detail, keys, by_position("ord"))
    dealt = detail.repartition(*keys) if chunk is None else detail
    distinct = dealt.groupBy(*keys, "__n").agg(F.min_by("item", "ord").alias("item"), F.min("ord").alias("ord")).drop("__n")
    if chunk is None:
        group = Window.partitionBy(*keys)
        placed = distinct.withColumns({"n": F.row_number().over(group.orderBy("ord")), "of": F.count("*").over(group), "place": F.min("ord").over(group)})
    else:
        distinct = stage(distinct)
        sizes = distinct.groupBy(*keys).agg(F.min("ord").alias("place"), F.count("*").alias("of"))
        placed = number_rows(distinct, keys, ["ord"], chunk, "n").join(sizes, keys)
    placed = stage(placed)
    first = placed.filter("n = 1")
    label = F.concat(F.lit("Изменена таблица "), F.col("number"))
    heads = first.select("doc_id", F.col("place").alias("ord"), F.lit(0).alias("line_no"),
                         F.when(F.col("of") == 1, F.concat(label, F.lit(" - "), F.col("item"), F.lit("."))).otherwise(F.concat(label, F.lit(":"))).alias("line"))
    lines = placed.filter("of > 1").select("doc_id", F.col("place").alias("ord"), F.col("n").cast("int").alias("line_no"),
                                           bullet(F.col("item"), F.col("n") == F.col("of")).alias("line"))
    named = told.filter("kind = 'general'")
    bare = named.filter("number is not null").groupBy(*keys).agg(F.min("ord").alias("ord")).join(first.select(*keys), keys, "left_anti").select(
        "doc_id", "ord", F.lit(0).alias("line_no"), F.concat(label, F.lit(".")).alias("line"))
    known = first.select("doc_id").unionByName(bare.select("doc_id")).distinct()
    nameless = named.filter("number is null").groupBy("doc_id").agg(F.min("ord").alias("ord")).join(known, "doc_id", "left_anti").select(
        "doc_id", "ord", F.lit(0).alias("line_no"), F.lit("Изменена таблица.").alias("line"))
    others = told.filter("kind = 'other'").select("doc_id", "ord", F.lit(0).alias("line_no"), F.col("item").alias("line"))
    return reduce(DataFrame.unionByName, [heads, lines, bare, nameless, others])


# ---- blocks and notices (P13, P16, J19, O5, O6, A18) -----------------------------------------

def natural_key(c: Column) -> Column:
    """Text key that sorts digit runs by value."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?s)(\d+|\D+)"), F.lit(1))

    def sortable(run: Column) -> Column:
        bare = F.regexp_replace(run, r"^0+(?=\d)", "")
        # longer runs of digits are larger numbers, so the length goes first
        return F.when(run.rlike(r"^\d"), F.concat(F.lit("\u0001"), F.lpad(F.length(bare).cast("string"), 10, "0"), bare, F.lit("\u0001"))).otherwise(run)

    return F.array_join(F.transform(runs, sortable), "")


def block_rank(doc_type: Column, number: Column) -> Column:
    """Rank of a block by its document type."""
    low, num = F.lower(F.coalesce(doc_type, F.lit(""))), F.coalesce(number, F.lit(""))

    def has(m):
        return F.contains(low, F.lit(m))

    return (F.when(has("комплект"), 0).when(has("специфика"), 1)
            .when(has("переч") | F.contains(F.lower(num), F.lit("пэ4")) | F.contains(F.lower(num), F.lit(" пэ")), 2)
            .when(has("сбор") | F.endswith(num, F.lit(" СБ")), 3).when(has("схема") | F.endswith(num, F.lit(" Э4")), 4)
            .when(has("ввод"), 9).otherwise(8))


def code_rank(doc_type: Column, number: Column) -> Column:
    """Rank of a block by its document code."""
    code = X.extract(T.squeeze(F.upper(F.coalesce(number, F.lit("")))), r"(?u)\s(СП|ПЭ4|СБ|Э4)$")
    low = F.lower(F.coalesce(doc_type, F.lit("")))
    by_type = (F.when(F.contains(low, F.lit("спецификация")), "СП").when(F.contains(low, F.lit("перечень")), "ПЭ4")
               .when(F.contains(low, F.lit("сборочный")), "СБ").when(F.contains(low, F.lit("схема")), "Э4"))
    use = F.coalesce(code, by_type)
    return F.when(use == "СП", 1).when(use == "ПЭ4", 2).when(use == "СБ", 3).when(use == "Э4", 4).otherwise(999)


def is_filled_block(number: Column, action: Column, notes: Column, text: Column) -> Column:
    """The block has a number, an action, a note or a text."""
    any_note = F.coalesce(F.exists(notes, lambda n: T.strip(F.coalesce(n, F.lit(""))) != ""), F.lit(False))
    return reduce(lambda a, b: a | b, [T.strip(F.coalesce(c, F.lit(""))) != "" for c in (number, action, text)]) | any_note


def search_notices(blocks: DataFrame, term: str) -> DataFrame:
    """Blocks of the notices whose id or any block matches the term; a blank term keeps all."""
    wanted = term.strip().lower()
    if not wanted:
        return blocks
    label = F.lower(F.concat_ws(" ", "decimal_number", "doc_type"))
    hit = F.contains(F.lower(F.col("notice_id").cast("string")), F.lit(wanted)) | F.contains(label, F.lit(wanted))
    return blocks.join(blocks.filter(hit).select("notice_id").distinct(), "notice_id", "left_semi")


def upsert_blocks(current: DataFrame, incoming: DataFrame, values: list[str], keys: list[str] = ("notice_id", "decimal_number", "doc_type")) -> DataFrame:
    """Known blocks take the incoming values that are there and keep their id; unknown ones are added."""
    cols = [*values, "block_id"]
    a, b = (f.select(*keys, F.struct(*cols).alias(n)) for f, n in ((current, "a"), (incoming, "b")))
    return a.join(b, list(keys), "full_outer").select(
        *keys, F.coalesce("a.block_id", "b.block_id").alias("block_id"), *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in values])


def assemble(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """Notices as numbered lines: block number, action, numbered notes, journal line.

    blocks: notice_id, block_id, doc_type, decimal_number, action, journal_entry
    notes:  notice_id, block_id, note_ord, line_no, line
    Notes that start with a bullet keep no number.
    """
    rank, nat = block_rank(F.col("doc_type"), F.col("decimal_number")), natural_key(F.col("decimal_number"))
    placed = stage(blocks.withColumns({"rank": rank, "nat": nat}))
    key = ["notice_id", "block_id"]
    clean = stage(notes.filter(T.strip(F.coalesce("line", F.lit(""))) != ""))
    opens = clean.groupBy(*key, "note_ord").agg(F.min_by("line", "line_no").alias("first"), F.min("line_no").alias("first_no"))
    numbered = ordered_scan(opens.withColumn("counts", ~F.startswith(F.ltrim("first"), F.lit("-"))), key, ["note_ord"], by_position("note_ord"),
                            running={"note_no": F.col("counts").cast("int")})
    shown = F.when(F.col("counts") & (F.col("line_no") == F.col("first_no")), F.concat_ws(" ", F.col("note_no").cast("string"), T.strip(F.col("line")))).otherwise(F.rtrim("line"))
    note_lines = clean.join(numbered, [*key, "note_ord"]).select(*key, F.lit(3).alias("part"), F.col("note_ord").cast("int").alias("note_ord"), F.col("line_no").cast("int").alias("sub"), shown.alias("line"))
    has_notes = opens.select(*key).distinct()

    def part(no: int, df: DataFrame, line: Column) -> DataFrame:
        return df.select(*key, F.lit(no).alias("part"), F.lit(0).alias("note_ord"), F.lit(0).alias("sub"), line.alias("line"))

    parts = [part(0, placed, F.col("decimal_number")), part(1, placed, F.col("action")),
             part(2, placed.join(has_notes, key, "left_semi"), F.lit(rules.NOTES_HEADER)), note_lines,
             part(4, placed, F.coalesce(F.nullif("journal_entry", F.lit("")), F.lit(rules.DEFAULT_JOURNAL)))]
    lines = reduce(DataFrame.unionByName, parts).filter(F.coalesce("line", F.lit("")) != "").join(placed.select(*key, "rank", "nat"), key)
    order = ["rank", "nat", "block_id", "part", "note_ord", "sub"]
    chunk = F.struct("rank", F.left("nat", F.lit(PREFIX)))
    out = ordered_scan(stage(lines), ["notice_id"], order, chunk, running={"n": F.lit(1)})
    return out.select("notice_id", F.col("n").cast("int").alias("line_no"), "block_id", "line")
